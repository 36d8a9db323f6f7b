"""Language identification by compression (operator 1).

Method: each language has a raw-content zstandard dictionary made of sampled
training texts. A text is cut into chunks, each chunk is compressed with every
dictionary, and the language of the least total size wins. A narrow margin over
the second is marked as rejected.

Training uses text and lang of rows outside the held-out fold, at most
``sample_docs`` documents of each language (a documented bound of the model);
prediction covers every whole text.

Defined results: null texts and texts without a letter give `und`, score 0; so
do all rows if there is nothing to learn from. Equal sizes go to the language
first in the alphabet. Further columns and rows with null lang have no effect on
other rows; nor have rows without doc_id, which are not learned from. Repeated
rows of a doc_id and language are learned from once, by their least text. A letter is a
character of Unicode's letter categories, so a fraction sign is none. A dictionary holds the
beginnings of its sample's texts, `dict_bytes` in all.
"""

from __future__ import annotations

import math

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches

CHUNK = 4096


def train(docs: DataFrame, *, sample_docs: int = 64, dict_bytes: int = 96 << 10) -> dict[str, bytes]:
    """Language -> dictionary. The sample takes, of each language, the document with the least hash in each of sample_docs buckets."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out() & F.col("text").rlike("\\p{L}"))
    drawn = rows.select("lang", F.xxhash64("doc_id").alias("h")).groupBy("lang", F.pmod("h", F.lit(sample_docs)).alias("bucket")).agg(F.min("h").alias("h"))
    hashes = [r[0] for r in drawn.select("h").distinct().collect()]
    if not hashes:
        return {}
    texts: dict[str, list[tuple[int, bytes]]] = {}
    for h, lang, text in rows.filter(F.xxhash64("doc_id").isin(hashes)).groupBy(F.xxhash64("doc_id"), "lang").agg(F.min(F.substring("text", 1, dict_bytes))).collect():
        texts.setdefault(lang, []).append((h, text.lower().encode("utf-8", "surrogatepass")))
    out = {}
    for lang, found in sorted(texts.items()):
        found = sorted(set(found))
        each = max(512, dict_bytes // len(found))
        out[lang] = b"\n".join(t[:each] for _, t in found)[-dict_bytes:]
    return out


class Model:
    def __init__(self, learned: dict[str, bytes], level: int = 6):
        self.langs = sorted(learned)
        self.z = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(learned[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.z.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        raw = text.lower().encode("utf-8", "surrogatepass")
        chunks = [raw[k : k + CHUNK] for k in range(0, len(raw), CHUNK)]
        return [sum([len(z.compress(c)) for c in chunks]) for z in self.z]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, margin (how much larger the second is, as a share of the least)."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        sizes = self.sizes(text)
        best = min(sizes)
        k = sizes.index(best)
        margin = (sorted(sizes)[1] - best) / best if len(sizes) > 1 else 1.0
        weights = [math.exp(-50.0 * min(14.0, (s - best) / best)) for s in sizes]
        return self.langs[k], 1 / sum(weights), margin


def predict(docs: DataFrame, learned: dict[str, bytes], *, narrow: float = 0.01) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected (the margin is under `narrow`, or there was nothing to judge by)."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(learned)  # bounded: dict_bytes for each language
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = Model(model.value)
        for b in batches:
            got = [m.predict(t.as_py()) for t in b.column("text")]
            lang, score, margin = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array([x < narrow for x in margin], pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {key}, held_out boolean, lang_pred string, score double, margin double, rejected boolean")


def identify_language(docs: DataFrame, **options) -> DataFrame:
    return predict(docs, train(docs), **options)
