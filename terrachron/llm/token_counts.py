"""Token counts without building ids (operator 6).

Method: whole-token shortcut. Once, on the driver, every vocabulary string is
merged from its bytes; those that end as one token are proven to count as one
wherever they stand as a pre-token. Executors count matching pre-tokens from
that table directly and merge only the rest.

Defined results: null text counts as empty (0 tokens); a special string inside a
text is one token, as is the library's default; rows are independent of each
other and of further columns; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPACE, Merges
from .common import file_stamp, small_batches, tokenizer_path

_WHITE = SPACE.pattern[1:-2]
#: Fixed value: the byte-level split pattern, with white space spelled out.
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
#: A text in which the only white space is single blanks and single line ends between chunks splits chunk by chunk.
UNEVEN = regex.compile(rf"[{_WHITE.replace(' ', '', 1)}\x1c-\x1f--\n]|[ \n][ \n]|^[ \n]|[ \n]$", regex.V1)
CACHE_ENTRIES = 250_000

_MERGES: dict[str, Merges] = {}


def merges(path: str) -> Merges:
    key = file_stamp(path)
    if key not in _MERGES:
        _MERGES[key] = Merges(path)
    return _MERGES[key]


def proven_single(path: str) -> set[str]:
    """Vocabulary strings, as symbols, whose merges from bytes end in one token."""
    m = merges(path)
    return {t for t in m.vocab if t not in m.special and len(m.tree(list(t))) == 1}


class Counts(dict):
    """Chunk -> tokens. `lead` is what stands before the chunk: a blank or nothing."""

    def __init__(self, path: str, single: set[str], lead: str):
        self.m, self.single, self.lead = merges(path), single, lead

    def __missing__(self, chunk: str) -> int:
        n = 0
        for p in PRETOKEN.findall(self.lead + chunk):
            s = self.m.symbols(p)
            n += 1 if "".join(s) in self.single else len(self.m.tree(s))
        if len(chunk) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = n
        return n


class Counter:
    def __init__(self, path: str, single: set[str]):
        self.m = merges(path)
        self.first, self.after = Counts(path, single, ""), Counts(path, single, " ")

    def part(self, text: str) -> int:
        if not text:
            return 0
        first, after = self.first, self.after
        if UNEVEN.search(text):
            return sum([first[p] if p[0] != " " or len(p) == 1 else after[p[1:]] for p in PRETOKEN.findall(text)])
        lines = text.split("\n")
        n = (len(lines) - 1) * first["\n"]
        for line in lines:
            head, *rest = line.split(" ")
            n += first[head] + sum(map(after.__getitem__, rest))
        return n

    def __call__(self, text: str) -> int:
        if self.m.split_special and any(s in text for s in self.m.special):
            return sum(1 if k % 2 else self.part(p) for k, p in enumerate(self.m.split_special.split(text)))
        return self.part(text)


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, *, path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every document."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    spark = docs.sparkSession
    small_batches(spark)
    proven = spark.sparkContext.broadcast(proven_single(path))  # bounded by the vocabulary
    key = docs.schema["doc_id"].dataType.simpleString()

    def count(batches):
        stamp = file_stamp(path)
        if stamp not in _COUNTERS:
            _COUNTERS[stamp] = Counter(path, proven.value)
        counter = _COUNTERS[stamp]
        for b in batches:
            texts = [t.as_py() for t in b.column("text")]
            n = [counter(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, f"doc_id {key}, n_bytes bigint, n_tokens bigint, over_limit boolean")
