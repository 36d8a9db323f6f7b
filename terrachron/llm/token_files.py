"""Token ids in binary files (operator 8).

Ids are those of the tokenizers library, which sees each pre-token once while it
stays in a worker's bounded cache. A zstandard dictionary trained on serialized id arrays is shared by all
documents, and each document is a frame of its own. A file row ("shard") holds
the frames of neighbouring documents, the sha256 of the dictionary that they
need, and an offset index (document, place of its frame, place of its first id
within the shard's part), so a short document is read without its neighbours.
Documents stand in ascending doc_id order.

Only the training sample is bounded (``sample_docs``); every document is encoded,
written and read whole. The driver holds one total for each part of the files.

Defined results: null text counts as empty, which has the end id alone; equal
doc_ids follow in the order of their texts; a null doc_id comes first; an empty
table gives no rows; further columns have no effect.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PRETOKEN, chunks_of, normal
from .common import file_stamp, small_batches, tokenizer_path

SHARD_BYTES = 2 << 20
SHARD_DOCS = 2048
INDEX = np.dtype([("at", "<u8"), ("size", "<u8"), ("start", "<u8")])
CACHE_ENTRIES = 900_000  # of chunks and pre-tokens together; some 200 bytes each
TOLD_AT_ONCE = 1000  # pre-tokens for one call of the library, which is slower for long texts
#: PRETOKEN for ASCII, in the faster module; 0x1c-0x1f aren't white space to either.
ASCII_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\t-\r A-Za-z0-9]+")


class LibraryIds(dict):
    """Chunk between white space, normalized -> its ids as 32-bit little-endian bytes, by the tokenizers library.

    Chunks are independent, and so are the pre-tokens within one; each pre-token's last id is that of an end of word.
    Pre-tokens that no entry covers are sent to the library together, apart by spaces, and told from each other by
    those ends. Special strings are cut out of the text beforehand, as the library does before it normalizes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab(with_added_tokens=False)
        end = json.loads(self.library.to_str())["model"].get("end_of_word_suffix") or ""
        if not end:
            raise ValueError(f"{path} has no end of word")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[k for t, k in vocab.items() if t.endswith(end)]] = True
        self.special = {t.content: k.to_bytes(4, "little") for k, t in self.library.get_added_tokens_decoder().items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def learn(self, chunks: list[str]) -> None:
        """Keep the ids of chunks and of their pre-tokens, which are chunks too."""
        # letters of ASCII alone are one pre-token
        several = {c: (ASCII_PRETOKEN if c.isascii() else PRETOKEN).findall(c) for c in chunks if not (c.isascii() and c.isalpha())}
        new = {c for c in chunks if c not in several}
        new.update(w for ws in several.values() for w in ws if w not in self)
        new = list(new)
        for k in range(0, len(new), TOLD_AT_ONCE):
            some = new[k : k + TOLD_AT_ONCE]
            # the same ids as encode() gives, without offsets
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            if len(cuts) != len(some) + 1 or cuts[-1] != 4 * len(ids):
                raise ValueError("the library's ids do not part by ends of words")
            raw = ids.tobytes()
            self.update(zip(some, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
        of_chunk = self.__getitem__
        self.update([(c, b"".join(map(of_chunk, ws))) for c, ws in several.items() if len(ws) != 1 or ws[0] != c])

    def of_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts; null counts as empty. What is new in them is learned at once."""
        parts = [self.split.split(t or "") if self.split else [t or ""] for t in texts]
        chunked = [[part if k % 2 else chunks_of(normal(part)) for k, part in enumerate(p)] for p in parts]
        new = [c for c in set().union(*[chunks for p in chunked for chunks in p[::2]]) if c not in self]
        if new:
            self.learn(new)
        of_chunk = self.__getitem__
        out = [b"".join([self.special[x] if k % 2 else b"".join(map(of_chunk, x)) for k, x in enumerate(p)]) for p in chunked]
        if len(self) > CACHE_ENTRIES:
            self.clear()
        return out

    def of(self, text: str | None) -> bytes:
        """Ids of one whole text."""
        return self.of_all([text])[0]


_LOADED: dict[str, LibraryIds] = {}


def library_ids(path: str) -> LibraryIds:
    key = file_stamp(path)
    if key not in _LOADED:
        _LOADED[key] = LibraryIds(path)
    return _LOADED[key]


def train_dictionary(docs: DataFrame, path: str, *, sample_docs: int = 1000, dict_bytes: int = 64 << 10, end_id: int = 1) -> bytes:
    """Dictionary of the id arrays of `sample_docs` documents, drawn by the hash of their id; empty if there is too little to learn from."""
    drawn = docs.select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").limit(sample_docs)
    ids = [r[0] for r in drawn.collect()]
    texts = [r[0] for r in docs.filter(F.col("doc_id").isin([x for x in ids if x is not None])).select(F.coalesce("text", F.lit(""))).limit(2 * sample_docs).collect()] if ids else []
    end = end_id.to_bytes(4, "little")
    samples = [raw[k : k + 4096] for t in texts for raw in [library_ids(path).of(t) + end] for k in range(0, len(raw), 4096)]
    try:
        return zstandard.train_dictionary(dict_bytes, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_token_files(docs: DataFrame, out: str, *, path: str | None = None, end_id: int = 1, level: int = 3, sample_docs: int = 1000) -> None:
    """Write the ids of every document, each followed by end_id, below the folder `out`."""
    spark, path = docs.sparkSession, path or tokenizer_path("word_bpe_49k.json")
    small_batches(spark)
    learned = train_dictionary(docs, path, sample_docs=sample_docs, end_id=end_id)
    name, end = hashlib.sha256(learned).hexdigest(), end_id.to_bytes(4, "little")
    spark.createDataFrame([(name, bytearray(learned))], "dict_sha256 string, dictionary binary").coalesce(1).write.mode("overwrite").parquet(f"{out}/dictionary")
    shared = spark.sparkContext.broadcast(learned)
    key = docs.schema["doc_id"].dataType.simpleString()

    def shards(batches):
        part = TaskContext.get().partitionId()
        d = shared.value
        z = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(d), write_dict_id=False) if d else zstandard.ZstdCompressor(level=level)
        keys, frames, index, at, ids, shard, first = [], [], [], 0, 0, 0, 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([ids - first], pa.int64()), pa.array([name]), pa.array([keys], pa.list_(kind)), pa.array([np.array(index, INDEX).tobytes()], pa.binary()), pa.array([b"".join(frames)], pa.binary())], ["part", "shard", "first_id", "n_ids", "dict_sha256", "doc_ids", "index", "frames"])

        kind, ids_of = None, library_ids(path).of_all
        for b in batches:
            kind = b.column("doc_id").type
            for doc, raw in zip(b.column("doc_id").to_pylist(), ids_of(b.column("text").to_pylist())):
                raw += end
                frame = z.compress(raw)
                keys.append(doc)
                index.append((at, len(frame), ids - first))
                frames.append(frame)
                at += len(frame)
                ids += len(raw) // 4
                if at >= SHARD_BYTES or len(keys) >= SHARD_DOCS:
                    yield flush()
                    keys, frames, index, at, shard, first = [], [], [], 0, shard + 1, ids
        if keys:
            yield flush()

    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(shards, f"part int, shard int, first_id bigint, n_ids bigint, dict_sha256 string, doc_ids array<{key}>, index binary, frames binary").write.mode("overwrite").option("compression", "none").parquet(f"{out}/shards")


def dictionaries(spark: SparkSession, out: str) -> dict[str, bytes]:
    return {r[0]: bytes(r[1]) for r in spark.read.parquet(f"{out}/dictionary").collect()}


def read_token_files(spark: SparkSession, out: str, *, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files."""
    files = spark.read.parquet(f"{out}/shards")
    start, total = {}, 0
    for part, n in sorted(tuple(r) for r in files.groupBy("part").agg(F.sum("n_ids")).collect()):
        start[part], total = total, total + n
    known, begins = spark.sparkContext.broadcast(dictionaries(spark, out)), spark.sparkContext.broadcast(start)
    key = files.schema["doc_ids"].dataType.elementType.simpleString()

    def read(batches):
        for b in batches:
            for row in range(b.num_rows):
                part, first, name, keys, index, frames = (b.column(c)[row].as_py() for c in ("part", "first_id", "dict_sha256", "doc_ids", "index", "frames"))
                z, index = decompressor(known.value, name), np.frombuffer(index, INDEX)
                raws = [z.decompress(frames[i["at"] : i["at"] + i["size"]]) for i in index]
                columns = [b.column("doc_ids")[row].values, pa.array([begins.value[part] + first + int(i["start"]) for i in index], pa.int64()), pa.array([len(r) // 4 for r in raws], pa.int64()), pa.array([zlib.crc32(r) for r in raws], pa.int64())]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(r, "<u4").astype(np.int64) for r in raws], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return files.mapInArrow(read, f"doc_id {key}, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else ""))


def decompressor(known: dict[str, bytes], name: str) -> zstandard.ZstdDecompressor:
    if name not in known:
        raise ValueError(f"no dictionary {name}")
    d = known[name]
    if hashlib.sha256(d).hexdigest() != name:
        raise ValueError(f"dictionary {name} is damaged")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d)) if d else zstandard.ZstdDecompressor()


def lookup(spark: SparkSession, out: str, doc_id) -> list[list[int]]:
    """Ids of the documents with this doc_id, through the offset index: one frame each is decompressed."""
    known, found = dictionaries(spark, out), []
    for r in spark.read.parquet(f"{out}/shards").filter(F.array_contains("doc_ids", doc_id)).orderBy("part", "shard").collect():
        index, z = np.frombuffer(bytes(r["index"]), INDEX), decompressor(known, r["dict_sha256"])
        for k, doc in enumerate(r["doc_ids"]):
            if doc == doc_id:
                found.append(np.frombuffer(z.decompress(bytes(r["frames"][index[k]["at"] : index[k]["at"] + index[k]["size"]])), "<u4").tolist())
    return found
