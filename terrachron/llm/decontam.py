"""Benchmark decontamination (operator 7).

Method: for each benchmark item, windows of the item's size slide over a
document, and each window has a SimHash of its 5-word shingles. Fingerprints are
cut into blocks; two that differ in at most ``radius`` bits differ in at most
radius/blocks bits in one block (pigeonhole), so a table of near block values
gives every item within the radius. Candidates are verified by exact weighted
Jaccard similarity of shingles, 0.8 or more.

A window that shares no shingle with any item has similarity 0 with all of them,
so windows are fingerprinted around shared shingles only; nothing is lost by it.

The items are the query set. They are handled in blocks of at most
``block_items`` items and ``block_chars`` characters, so what is broadcast is
bounded; each further block is a further pass over the documents.

Defined results: null and empty texts, and items without a word, match nothing;
items of fewer than five words match where their words stand one after another;
equal best windows: the first; repeated rows give repeated results, and each row
is kept or dropped by its own text, whatever its doc_id, null included; further
columns have no effect; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SIMILARITY, WORDS_PER_SHINGLE, shingle_hashes, small_batches, weighted_jaccard, word_hashes

BLOCKS = 8
RADIUS = 28
BITS = np.arange(64, dtype=np.uint64)
NEAR = np.array([[bin(a ^ b).count("1") for b in range(256)] for a in range(256)], np.uint8)


def signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle."""
    return (((shingles[:, None] >> BITS) & np.uint64(1)).astype(np.int16) << 1) - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """64-bit SimHash, as 8 bytes, of rows of summed signs."""
    return np.packbits(sums > 0, axis=-1)


class Items:
    """Index of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS, similarity: float = SIMILARITY):
        self.radius, self.similarity = radius, similarity
        self.ids, self.words, self.shingles = [], [], []
        for item, text in items:
            words = word_hashes(text)
            if len(words):
                self.ids.append(item)
                self.words.append(len(words))
                self.shingles.append(shingle_hashes(words))
        self.width = [min(n, WORDS_PER_SHINGLE) for n in self.words]
        self.prints = np.array([fingerprint(signs(s).sum(0)) for s in self.shingles], np.uint8).reshape(-1, 8)
        # for each shingle width: sorted shingle hashes, the items of each, a bit map of their upper bits
        self.by_width = {}
        for w in sorted(set(self.width)):
            pairs = sorted({(int(h), k) for k, s in enumerate(self.shingles) if self.width[k] == w for h in s})
            keys = np.array([p[0] for p in pairs], np.uint64)
            there = np.zeros(1 << 20, bool)
            there[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.by_width[w] = keys, np.array([p[1] for p in pairs], np.int64), there
        # multi-index: for each block and value, which items have a near value there
        reach = radius // BLOCKS
        self.table = [NEAR[:, self.prints[:, b]] <= reach for b in range(BLOCKS)]

    def candidates(self, prints: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Windows x items: within the radius. The blocks' tables first, then the whole distance."""
        near = np.zeros((len(prints), len(items)), bool)
        for b in range(BLOCKS):
            near |= self.table[b][prints[:, b]][:, items]
        far = np.zeros(near.shape, np.int16)
        for b in range(BLOCKS):
            far += NEAR[prints[:, b][:, None], self.prints[items, b][None, :]]
        return near & (far <= self.radius)

    def find(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item_id, similarity, first word, word behind the last) of the best window for each item that the text holds."""
        words, out = word_hashes(text), []
        for w, (keys, items, there) in self.by_width.items():
            if len(words) < w:
                continue
            h = shingle_hashes(words, w)
            maybe = np.flatnonzero(there[(h >> np.uint64(44)).astype(np.int64)])
            if not len(maybe):
                continue
            at = np.searchsorted(keys, h[maybe])
            at[at == len(keys)] = 0
            anchors = maybe[keys[at] == h[maybe]]
            if not len(anchors):
                continue
            lo, hi = np.searchsorted(keys, h[anchors], "left"), np.searchsorted(keys, h[anchors], "right")
            hit = np.concatenate([items[a:b] for a, b in zip(lo, hi)])
            where = np.repeat(anchors, hi - lo)
            for k in np.unique(hit):
                best = self.best(h, where[hit == k], int(k))
                if best:
                    out.append((self.ids[k], best[0], best[1], best[1] + best[2] + w - 1))
        return out

    def best(self, h: np.ndarray, anchors: np.ndarray, k: int) -> tuple[float, int, int] | None:
        item = self.shingles[k]
        n = min(len(item), len(h))
        starts = np.unique(np.clip(anchors[:, None] - np.arange(n)[None, :], 0, len(h) - n).ravel()) if len(anchors) * n <= 1 << 20 else np.arange(len(h) - n + 1)
        # at least so many of a window's shingles are the item's, counted with repetitions
        shared = np.searchsorted(anchors, starts + n) - np.searchsorted(anchors, starts)
        starts = starts[shared * (1 + self.similarity) >= self.similarity * (n + len(item)) - 1e-9]
        found = None
        for a in range(0, len(starts), 256):
            part = starts[a : a + 256]
            windows = h[part[:, None] + np.arange(n)]
            sums = np.stack([signs(x).sum(0) for x in windows]) if len(part) else np.empty((0, 64))
            ok = self.candidates(fingerprint(sums), np.array([k]))[:, 0]
            for s, x in zip(part[ok].tolist(), windows[ok]):
                sim = weighted_jaccard(x, item)
                if sim >= self.similarity and (found is None or sim > found[0]):
                    found = sim, s, n
        return found


def blocks_of(benchmark: DataFrame, block_items: int, block_chars: int):
    """Lists of (item_id, text), one at least; items without a text are left out."""
    block, chars, any_ = [], 0, False
    for r in benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).toLocalIterator():
        block.append((r[0], r[1]))
        chars += len(r[1])
        if len(block) >= block_items or chars >= block_chars:
            yield block
            block, chars, any_ = [], 0, True
    if block or not any_:
        yield block


def find_items(docs: DataFrame, benchmark: DataFrame, *, similarity: float = SIMILARITY, radius: int = RADIUS, block_items: int = 20_000, block_chars: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, similarity, first_word, end_word for each item that a document holds."""
    spark = docs.sparkSession
    small_batches(spark)
    key, item_key = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    source = docs.select("doc_id", "text")
    schema = f"doc_id {key}, item_id {item_key}, similarity double, first_word int, end_word int"
    kind = pa.int64() if item_key == "bigint" else None

    def against(items: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Items(items, radius, similarity))

        def run(batches):
            index = shared.value
            for b in batches:
                rows = [(d, *f) for d, t in zip(range(b.num_rows), b.column("text")) for f in index.find(t.as_py())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int32()), pa.array([r[4] for r in rows], pa.int32())], ["doc_id", "item_id", "similarity", "first_word", "end_word"])

        return source.mapInArrow(run, schema)

    found = None
    for block in blocks_of(benchmark, block_items, block_chars):
        found = against(block) if found is None else found.unionByName(against(block))
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, similarity: float = SIMILARITY, radius: int = RADIUS, block_items: int = 20_000, block_chars: int = 8 << 20) -> DataFrame:
    """The rows whose text holds no benchmark item, with all their columns. No shuffle: each row is judged where it is."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = docs.schema

    def without(rows: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Items(items, radius, similarity))

        def run(batches):
            index = shared.value
            for b in batches:
                yield b.filter(pa.array([not index.find(t.as_py()) for t in b.column("text")], pa.bool_()))

        return rows.mapInArrow(run, schema)

    for block in blocks_of(benchmark, block_items, block_chars):
        docs = without(docs, block)
    return docs
