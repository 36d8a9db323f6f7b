"""Work of encoding: how often the library is asked, and that it is the library's ids that are kept."""

import numpy as np

from terrachron.llm import common, token_files

BPE = common.tokenizer_path("word_bpe_49k.json")


class Counted:
    """The library, with its calls and the texts of each counted."""

    def __init__(self, library):
        self.library, self.asked = library, []

    def encode_batch_fast(self, texts, **how):
        self.asked += texts
        return self.library.encode_batch_fast(texts, **how)


def test_new_words_of_many_texts_are_learned_at_once():
    ids = token_files.LibraryIds(BPE)
    texts = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)} it's, 12 Ünder--'ll {k}<|endoftext|> (so)" for k in range(200)] + [None, "", "Σίσυφος ΑΣ", "cat's'll ''re"]
    want = [b"".join(x.to_bytes(4, "little") for x in ids.library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    ids.library = Counted(ids.library)
    assert ids.of_all(texts) == want
    assert 0 < len(ids.library.asked) <= 2
    n = len(ids.library.asked)
    assert [ids.of(t) for t in texts] == want and len(ids.library.asked) == n


def test_a_full_cache_is_cleared(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_ENTRIES", 10)
    ids = token_files.LibraryIds(BPE)
    texts = ["one two three four five six", "seven eight nine ten eleven twelve", "one two"]
    want = [b"".join(x.to_bytes(4, "little") for x in ids.library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [ids.of(t) for t in texts] == want and ids.of_all(texts) == want and len(ids) == 0


def test_pretokens_of_ascii():
    rng = np.random.default_rng(3)
    letters = [*range(128), *(ord(c) for c in "''''stremvld")]
    for _ in range(20_000):
        text = "".join(map(chr, rng.choice(letters, rng.integers(1, 12))))
        assert token_files.ASCII_PRETOKEN.findall(text) == token_files.PRETOKEN.findall(text), repr(text)
