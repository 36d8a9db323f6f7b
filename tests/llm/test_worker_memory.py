"""What a Python worker keeps between tasks."""

from terrachron.llm import bpe, common


def test_words_that_come_once_are_not_kept_for_long():
    words = [f"w{k}x" for k in range(100_000)]
    found = common.word_hashes(" ".join(words)).tolist()
    assert len(common._WORDS) <= 50_000
    assert common.word_hashes(" ".join(words[::-1])).tolist() == found[::-1]


def test_a_task_leaves_no_chunks():
    path = common.tokenizer_path("word_bpe_49k.json")
    cache = bpe.loaded(path)[1]
    before = bpe.columns("Some words, and some more.", path)
    assert len(cache) and len(cache.words)
    cache.release()
    assert not len(cache) and not len(cache.words)
    assert bpe.columns("Some words, and some more.", path) == before
