"""BPE encoding and decoding with word ends (operator 5).

Method: tree concatenation. A text without break points is cut in halves until
a piece is short; the halves are encoded on their own and joined by re-encoding
a growing window of tokens around the cut, until the first token of the window
equals the left side's and the last equals the right side's. A token sequence is
the BPE encoding of its text exactly if each adjacent pair is, so agreement at
both edges makes the joined sequence exact. Documents longer than
``segment_chars`` are cut into segments which Spark encodes as separate rows, in
parallel, and joins by the same rule.

Defined results: null text counts as empty; an empty text has no ids, and the
hash of the empty string for both digests; special strings within a text become
their special id, as is the library's default; rows are independent, so ties,
repeated rows and further columns have no effect; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_stamp, nfc, small_batches, tokenizer_path

#: Unicode White_Space, which ends a chunk; str.split() also takes 0x1c-0x1f.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
NOT_SPACE = re.compile("[\x1c-\x1f]")
#: Fixed value: the split pattern named in the vocabulary file.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
LETTERS = re.compile("[A-Za-z]{40}")
WORD = regex.compile(r"\p{L}*")
LEAF = 64
CACHE_ENTRIES = 250_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    names = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [names[b] for b in range(256)]


class Merges:
    """Ranked merges over string symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank: dict[tuple[str, str], int] = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.text_id = {t: str(k) for t, k in self.vocab.items()}
        self.byte_id = {t: k.to_bytes(4, "little") for t, k in self.vocab.items()}
        self.bytes = byte_symbols()
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def symbols(self, piece: str, *, ends: bool = True) -> list[str]:
        names = self.bytes
        out = [names[b] for b in piece.encode("utf-8", "surrogatepass")]
        if ends and out and self.end:
            out[-1] += self.end
        return out

    def parts(self, token: str) -> list[str]:
        """A token's base symbols."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def short(self, s: list[str]) -> list[str]:
        """Merge the pair of least rank, leftmost first, until none has a rank."""
        rank, none = self.rank.get, 1 << 60
        ranks = [rank(p, none) for p in zip(s, s[1:])]
        while ranks:
            r = min(ranks)
            if r == none:
                break
            k = ranks.index(r)
            s[k : k + 2] = [s[k] + s[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((s[k - 1], s[k]), none)
            if k < len(ranks):
                ranks[k] = rank((s[k], s[k + 1]), none)
        return s

    def window(self, s: list[str]) -> list[str]:
        """The same result as short() with a heap, for windows of any length."""
        if len(s) <= 2 * LEAF:
            return self.short(s)
        rank, n = self.rank, len(s)
        s, left, right = list(s), list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, k, s[k], s[k + 1]) for k in range(n - 1) if (r := rank.get((s[k], s[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            nxt = right[k]
            if s[k] != a or nxt < 0 or s[nxt] != b:
                continue
            s[k], s[nxt] = a + b, ""
            right[k] = after = right[nxt]
            if after >= 0:
                left[after] = k
            for x, y in ((left[k], k), (k, after)):
                if x >= 0 and y >= 0 and (r := rank.get((s[x], s[y]))) is not None:
                    heapq.heappush(heap, (r, x, s[x], s[y]))
        return [x for x in s if x]

    def join(self, left: list[str], right: list[str]) -> list[str]:
        """Tokens of a text from those of its two parts, each encoded on its own."""
        if not left or not right:
            return left or right
        w = 1
        while True:
            i, j = min(w, len(left)), min(w, len(right))
            got = self.window([x for t in (*left[-i:], *right[:j]) for x in self.parts(t)])
            if (i == len(left) or got[0] == left[-i]) and (j == len(right) or got[-1] == right[j - 1]):
                return left[:-i] + got + right[j:]
            w *= 2

    def tree(self, s: list[str]) -> list[str]:
        if len(s) <= LEAF:
            return self.short(s)
        level = [self.short(s[k : k + LEAF]) for k in range(0, len(s), LEAF)]
        while len(level) > 1:
            level = [self.join(level[k], level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0]


class Chunks(dict):
    """Chunk between white space -> (ids joined by a space, tokens joined by a space, ids as 32-bit little-endian bytes, number of ids)."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.words: dict[str, tuple] = {}  # of pre-tokens

    def word(self, piece: str):
        found = self.words.get(piece)
        if found is None:
            m = self.merges
            found = packed(m, m.tree(m.symbols(piece)))
            if len(piece) <= 64:
                if len(self.words) >= CACHE_ENTRIES:
                    self.words.clear()
                self.words[piece] = found
        return found

    def release(self) -> None:
        """Empty the cache at the end of a task: its worker waits with what it holds, or goes on with another operator."""
        self.clear()
        self.words.clear()

    def __missing__(self, chunk: str):
        parts = [self.word(p) for p in PRETOKEN.findall(chunk)]
        if len(parts) == 1:
            found = parts[0]
        elif parts:
            ids, tokens, raw, n = zip(*parts)
            found = " ".join(ids), " ".join(tokens), b"".join(raw), sum(n)
        else:
            found = packed(self.merges, [])
        if len(chunk) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = found
        return found


def packed(m: Merges, tokens: list[str]):
    if len(tokens) == 1:
        return m.text_id[tokens[0]], tokens[0], m.byte_id[tokens[0]], 1
    return " ".join([m.text_id[t] for t in tokens]), " ".join(tokens), b"".join([m.byte_id[t] for t in tokens]), len(tokens)


_LOADED: dict[str, tuple[Merges, Chunks]] = {}


def loaded(path: str) -> tuple[Merges, Chunks]:
    key = file_stamp(path)
    if key not in _LOADED:
        m = Merges(path)
        _LOADED[key] = m, Chunks(m)
    return _LOADED[key]


def normal(text: str) -> str:
    text = nfc(text)
    return "".join(c.lower() for c in text) if "Σ" in text or "İ" in text else text.lower()


def chunks_of(text: str) -> list[str]:
    return [c for c in SPACE.split(text) if c] if NOT_SPACE.search(text) else text.split()


def pieces(text: str, path: str) -> Iterator[tuple]:
    """Packed results of a text's chunks and special strings, in order."""
    m, cache = loaded(path)
    if not (m.split_special and "<|" in text):
        return map(cache.__getitem__, chunks_of(normal(text)))
    return special_pieces(text, m, cache)


def special_pieces(text: str, m: Merges, cache: Chunks) -> Iterator[tuple]:
    for k, part in enumerate(m.split_special.split(text)):
        if k % 2:
            yield str(m.special[part]), part, m.special[part].to_bytes(4, "little"), 1
        elif part:
            yield from map(cache.__getitem__, chunks_of(normal(part)))


def encoded(text: str | None, path: str) -> tuple[str, str, bytes]:
    """Ids joined by a space, decoded text, ids as bytes."""
    ids, tokens, raw, _ = columns(text, path)
    return " ".join(ids), " ".join(tokens), b"".join(raw)


def columns(text: str | None, path: str) -> tuple[tuple, tuple, tuple, tuple]:
    """Packed results of a text's chunks, less those without a token, by column."""
    got = list(pieces(text or "", path))
    found = tuple(zip(*got)) or ((), (), (), ())
    return tuple(zip(*(p for p in got if p[3]))) or ((), (), (), ()) if 0 in found[3] else found


def encode(text: str | None, path: str | None = None) -> list[int]:
    """Ids of a text."""
    import numpy as np

    return np.frombuffer(encoded(text, path or tokenizer_path("word_bpe_49k.json"))[2], "<u4").tolist()


def decode(ids: list[int], path: str | None = None) -> str:
    """The library's decode(ids, skip_special_tokens=False): this vocabulary names no decoder, so tokens are joined by a space. Unknown ids are left out."""
    m, _ = loaded(path or tokenizer_path("word_bpe_49k.json"))
    names = _NAMES.setdefault(id(m), {v: k for k, v in (m.vocab | m.special).items()})
    return " ".join(names[i] for i in ids if i in names)


_NAMES: dict[int, dict[int, str]] = {}


def segments(text: str, size: int) -> list[tuple[str, bool]]:
    """Cut a long text into (segment, goes on within a word) near every `size` characters: at white space, else between letters; elsewhere it isn't cut."""
    out, at, n = [], 0, len(text)
    while n - at > size:
        found, lo = None, at + size // 2
        for m in re.finditer(r"[ \n]", text[lo : at + size]):
            found = (lo + m.start(), False)
        if not found and (m := LETTERS.search(text, at + size // 2, at + size)):
            found = (m.start() + 20, True)
        if not found:
            m = re.compile(r"[ \n]|[A-Za-z]{40}").search(text, at + size)
            if not m:
                break
            found = (m.start(), False) if m[0].isspace() else (m.start() + 20, True)
        out.append((text[at : found[0]], found[1]))
        at = found[0]
    out.append((text[at:], False))
    return out


def open_encoded(text: str, opens: bool, goes_on: bool, path: str) -> tuple[list[str], list[str], list[str]]:
    """Tokens of a segment: head (continues the word before it), body, tail (goes on in the next). A segment within one word is all tail. Head and tail are the whole of the pre-token that is cut: cuts stand between 20 letters on either side, so it is a run of letters, and no contraction."""
    m, cache = loaded(path)
    parts = m.split_special.split(text) if m.split_special else [text]  # every second one is a special string
    parts[::2] = map(normal, parts[::2])
    head_text = tail_text = ""
    if opens:
        head_text = WORD.match(parts[0])[0]
        parts[0] = parts[0][len(head_text) :]
    if goes_on and not any(parts):
        head_text, tail_text = "", head_text
    elif goes_on:
        tail_text = PRETOKEN.findall(chunks_of(parts[-1])[-1])[-1]
        parts[-1] = parts[-1][: -len(tail_text)]
    body = [t for k, p in enumerate(parts) for t in ([p] if k % 2 else [t for c in chunks_of(p) for t in cache[c][1].split(" ") if t])]
    head = m.tree(m.symbols(head_text)) if head_text else []
    tail = m.tree(m.symbols(tail_text, ends=False)) if tail_text else []
    return head, body, tail


def joined(parts: list[tuple[list[str], list[str], list[str], bool, bool]], path: str) -> list[str]:
    """Tokens of a text from its segments' (head, body, tail, opens, goes on), in order."""
    m, _ = loaded(path)
    out: list[str] = []
    run: list[list[str]] = []
    for head, body, tail, opens, goes_on in parts:
        if opens:
            if goes_on and not head and not body:  # within one word
                run.append(tail)
                continue
            run.append(head)
            while len(run) > 1:
                run = [m.join(run[k], run[k + 1]) if k + 1 < len(run) else run[k] for k in range(0, len(run), 2)]
            out += run[0]
            run = []
        out += body
        if goes_on:
            run = [tail]
    for r in run:
        out += r
    return out


def digests(ids: str, tokens: str, n: int) -> tuple[int, str, str]:
    return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(tokens.encode()).hexdigest()


def encode_documents(docs: DataFrame, *, path: str | None = None, segment_chars: int = 65_536, with_tokens: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, and ids and decoded text if with_tokens."""
    path = path or tokenizer_path("word_bpe_49k.json")
    small_batches(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {key}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_tokens else "")
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def rows(keys: pa.Array, got: list[tuple[str, str, int]]) -> pa.RecordBatch:
        n, a, b = zip(*(digests(*g) for g in got)) if got else ((), (), ())
        columns = [keys, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_tokens:
            columns += [pa.array([[int(x) for x in g[0].split()] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.string())]
            names += ["ids", "decoded"]
        return pa.RecordBatch.from_arrays(columns, names)

    def whole(batches):
        for b in batches:
            got = []
            for t in b.column("text"):
                ids, tokens, _, n = columns(t.as_py(), path)
                got.append((" ".join(ids), " ".join(tokens), sum(n)))
            yield rows(b.column("doc_id"), got)
        loaded(path)[1].release()

    def cut(batches):
        for b in batches:
            for d, r, t in zip(b.column("doc_id"), b.column("_row"), b.column("text")):
                parts = segments(t.as_py(), segment_chars)
                opens = [False, *(p[1] for p in parts[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array([d.as_py()] * len(parts), d.type), pa.array([r.as_py()] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array([p[0] for p in parts]), pa.array(opens), pa.array([p[1] for p in parts])], ["doc_id", "_row", "seg", "text", "opens", "goes_on"])

    def apart(batches):
        for b in batches:
            got = [open_encoded(t.as_py(), o.as_py(), g.as_py(), path) for t, o, g in zip(b.column("text"), b.column("opens"), b.column("goes_on"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_row"), b.column("seg"), b.column("opens"), b.column("goes_on"), *(pa.array([g[k] for g in got], pa.list_(pa.string())) for k in range(3))], ["doc_id", "_row", "seg", "opens", "goes_on", "head", "body", "tail"])

    def together(batches):
        for b in batches:
            got = []
            for s in b.column("segs"):
                parts = sorted(s.as_py(), key=lambda x: x["seg"])
                tokens = joined([(x["head"], x["body"], x["tail"], x["opens"], x["goes_on"]) for x in parts], path)
                m, _ = loaded(path)
                got.append((" ".join(str(m.special[t]) if t in m.special else str(m.vocab[t]) for t in tokens), " ".join(tokens), len(tokens)))
            yield rows(b.column("doc_id"), got)

    long = F.length("text") > segment_chars
    short_docs = source.filter(~long).mapInArrow(whole, out)
    pieces_of = source.filter(long).withColumn("_row", F.monotonically_increasing_id()).mapInArrow(cut, f"doc_id {key}, _row bigint, seg int, text string, opens boolean, goes_on boolean")
    done = pieces_of.repartition(F.col("doc_id"), F.col("_row"), F.col("seg")).mapInArrow(apart, f"doc_id {key}, _row bigint, seg int, opens boolean, goes_on boolean, head array<string>, body array<string>, tail array<string>")
    long_docs = done.groupBy("doc_id", "_row").agg(F.collect_list(F.struct("seg", "opens", "goes_on", "head", "body", "tail")).alias("segs")).select("doc_id", "segs").mapInArrow(together, out)
    return short_docs.unionByName(long_docs)
