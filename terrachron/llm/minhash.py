"""Near-duplicate documents (operator 9).

Method: ProbMinHash. A document is a multiset of 5-word shingles. Every distinct
shingle sends arrivals of a Poisson process whose rate is its multiplicity, each
to one of ``SLOTS`` slots; a slot keeps the shingle that arrives first. A process
stops when its next arrival is later than the latest slot's, so long texts take
little more than one arrival a shingle. Two documents agree in a slot with the
probability Jaccard similarity of their multisets. Slots are banded, and pairs
from a band's bucket are verified by exact weighted Jaccard, 0.8 or more.

Classes are the connected components of the verified links. A bucket never has
all its pairs compared. Its members are held against its least document first.
In buckets that still have several components, shingles that only one document
has bound what it can share with any other; documents that cannot reach the
similarity with any size in the bucket leave it. The others are held against the
most central member of the largest component (the one with the least share of
shingles of its own), and at last those pairs are compared which lie in
different components and which neither that bound nor the triangle inequality of
the Jaccard distance, through the bucket's first centre, rules out, each in the
least bucket that both are open in. What is left
out is a pair within one class, or a pair that cannot be similar, so the classes
lose no link.

Defined results: rows of the same words are copies, of similarity 1; null texts
and texts without a word resemble nothing and are each a class of their own; the
id of a class is its least doc_id; rows that share a doc_id are one document; a
null doc_id has a null class; an empty table gives no rows; further columns have
no effect.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SIMILARITY, counted_jaccard, mixed, shingle_hashes, small_batches, word_hashes, written
from .components import components

BANDS, ROWS = 24, 5
SLOTS = BANDS * ROWS
STEP_A, STEP_B = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
STAR_ROUNDS = 3
STAR_GAIN = 0.1  # a round of stars that takes away less than this share of the pairs still apart is the last
FEW_PAIRS = 20_000
HOT_KEYS = 1024  # keys that are broadcast at most
SMALL_IDS = 100_000  # ids that are broadcast at most, 8 bytes each


def counted(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles, return_counts=True)


def signatures(docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Documents (distinct shingles, multiplicities) -> documents x SLOTS of shingles. Documents without shingles get zeros."""
    n = len(docs)
    sig = np.zeros(n * SLOTS, np.uint64)
    h = np.concatenate([d[0] for d in docs]) if docs else np.empty(0, np.uint64)
    if not len(h):
        return sig.reshape(n, SLOTS)
    rate = np.concatenate([d[1] for d in docs]).astype(np.float64)
    doc = np.repeat(np.arange(n), [len(d[0]) for d in docs])
    best = np.full(n * SLOTS, np.inf)
    time, k = np.zeros(len(h)), 0
    while len(h):
        step = np.array([k + 1], np.uint64)
        u = mixed(h + STEP_A * step)
        time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        at = doc * SLOTS + (mixed(h ^ (STEP_B * step)) % np.uint64(SLOTS)).astype(np.int64)
        better = time < best[at]
        np.minimum.at(best, at[better], time[better])
        won = better & (best[at] == time)
        sig[at[won]] = h[won]
        latest = best.reshape(n, SLOTS).max(axis=1)
        on = time < latest[doc]
        h, rate, doc, time, k = h[on], rate[on], doc[on], time[on], k + 1
    return sig.reshape(n, SLOTS)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """documents x BANDS of bucket names; bands have names of their own."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        out = mixed(out ^ parts[:, :, r]) + np.uint64(r)
    return out.view(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (hash of the words; null without a word), bands."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            words = [word_hashes(t.as_py()) for t in b.column("text")]
            keys = [np.frombuffer(xxhash.xxh3_128_digest(w.tobytes()), "<i8").tolist() if len(w) else (None, None) for w in words]
            # copies are neighbours often enough to sign them once
            first = {}
            for k, x in enumerate(keys):
                if x[0] is not None:
                    first.setdefault(tuple(x), k)
            rows = list(first.values())
            bands = band_hashes(signatures([counted(shingle_hashes(words[k])) for k in rows]))
            place = {k: i for i, k in enumerate(rows)}
            got = [bands[place[first[tuple(x)]]] if x[0] is not None else [] for x in keys]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in keys], pa.int64()), pa.array([x[1] for x in keys], pa.int64()), pa.array(got, pa.list_(pa.int64()))], ["doc_id", "k1", "k2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, k1 bigint, k2 bigint, bands array<bigint>")


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, grams: the sorted shingles of the listed documents, with repetitions."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([np.sort(shingle_hashes(word_hashes(t.as_py()))).tobytes() for t in b.column("text")], pa.binary())], ["node", "grams"])

    # the list grows with the documents, so it is never broadcast
    listed = nodes.select(F.col("node").alias("doc_id")).hint("merge")
    return docs.select("doc_id", "text").join(listed, "doc_id", "left_semi").mapInArrow(run, f"node {key}, grams binary")


def verify(pairs: DataFrame, sets: DataFrame, *, small: bool = False) -> DataFrame:
    """pairs(a, b) -> a, b, similarity. small: the pairs' ids are few enough to broadcast."""
    key = pairs.schema["a"].dataType.simpleString()

    def run(batches):
        last, left = None, None
        for b in batches:
            out = []
            for a, x, y in zip(b.column("a"), b.column("grams_a"), b.column("grams_b")):
                if a != last or left is None:
                    last, left = a, counted(np.frombuffer(x.as_py(), np.uint64))
                out.append(counted_jaccard(*left, *counted(np.frombuffer(y.as_py(), np.uint64))))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    if small:
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        sets = written(sets.join(F.broadcast(nodes), "node", "left_semi"), "minhash-few-sets")
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b")), "b")
    with_both = with_b.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a")), "a")
    return with_both.select("a", "b", "grams_a", "grams_b").mapInArrow(run, f"a {key}, b {key}, similarity double")


def own_shingles(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes(node, component) -> node, n (shingles), own (those that no listed document of another component has, with repetitions)."""
    key = sets.schema["node"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for node, component, g in zip(b.column("node"), b.column("component"), b.column("grams")):
                k, c = counted(np.frombuffer(g.as_py(), np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array([node.as_py()] * len(k), b.column("node").type), pa.array([component.as_py()] * len(k), b.column("node").type), pa.array(k.view(np.int64)), pa.array(c.astype(np.int32))], ["node", "component", "gram", "times"])

    grams = written(sets.join(nodes, "node").select("node", "component", "grams").mapInArrow(run, f"node {key}, component {key}, gram bigint, times int"), "minhash-grams")
    lone = written(grams.groupBy("gram").agg(F.count("*").alias("entries"), F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 = c1").select("gram", "entries"), "minhash-lone")
    own = joined(grams, lone, "gram").groupBy("node").agg(F.sum("times").alias("own"))
    sized = sets.select("node", (F.length("grams") / 8).cast("long").alias("n")).join(nodes, "node", "left_semi")
    return written(sized.join(own, "node", "left").select("node", "n", F.coalesce("own", F.lit(0)).alias("own")), "minhash-own")


def joined(rows: DataFrame, per_key: DataFrame, key: str) -> DataFrame:
    """rows with what per_key(key, entries, ...) tells of their key; rows of other keys go. `entries` is the number of rows of a key. Keys with a HOT_KEYS-th of all entries or more, so at most HOT_KEYS of them, are broadcast, as their rows would meet in one task; the others are never broadcast."""
    total = per_key.agg(F.sum("entries")).first()[0] or 0
    hot = F.col("entries") * HOT_KEYS >= total
    frequent = per_key.filter(hot)
    rest = rows.join(F.broadcast(frequent.select(key)), key, "left_anti").join(per_key.filter(~hot).hint("merge"), key)
    return rows.join(F.broadcast(frequent), key).unionByName(rest).drop("entries")


def by_node(entries: DataFrame) -> DataFrame:
    """node, places (bucket and similarity to its first centre), and the node's own columns: one row a node, at most BANDS places."""
    own = [c for c in entries.columns if c not in ("node", "bucket", "to_first")]
    return entries.groupBy("node").agg(F.collect_list(F.struct("bucket", "to_first")).alias("places"), *(F.min(c).alias(c) for c in own))


def by_place(nodes: DataFrame) -> DataFrame:
    """The entries again."""
    return nodes.select(*(c for c in nodes.columns if c != "places"), F.inline("places"))


def within_reach(open_: DataFrame, sets: DataFrame, similarity: float, rows: int) -> DataFrame:
    """Open entries, `rows` of them, with n and own, less those whose document can't be similar to one of another component in its bucket, whatever that one's size."""
    told = own_shingles(sets, open_.select("node", "component").distinct())
    sized = written(by_place(by_node(open_.drop("n", "own")).join(told, "node")), "minhash-sized", rows=rows)
    least = written(sized.groupBy("bucket").agg(F.count("*").alias("entries"), F.min("n").alias("least_n")), "minhash-least", rows=rows)
    most_shared = F.col("n") - F.col("own")
    able = most_shared * (1 + similarity) >= similarity * (F.col("n") + F.greatest("least_n", most_shared)) - 1e-6
    return written(joined(sized, least, "bucket").filter(able).drop("least_n"), "minhash-open", rows=rows)


def links(docs: DataFrame, entries: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame | None, DataFrame | None]:
    """entries(bucket, node) -> verified links (a, b), and (node, component) of the nodes that have one. None if no bucket has two documents."""
    entries = entries.filter("bucket is not null and node is not null")
    # buckets of two documents or more; `first` is the bucket's first centre
    shared = entries.groupBy("bucket").agg(F.count("*").alias("entries"), F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last").drop("last")
    full = written(joined(entries, written(shared, "minhash-shared"), "bucket"), "minhash-buckets")
    pairs = written(full.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "minhash-pairs")
    if pairs.isEmpty():
        return None, None
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = written(shingle_sets(docs, nodes), "minhash-sets")
    told = written(verify(pairs, sets), "minhash-verified")
    found = told.filter(F.col("similarity") >= similarity).select("a", "b")
    groups = components(found)
    to_first = told.select(F.col("a").alias("first"), F.col("b").alias("node"), F.col("similarity").alias("to_first"))
    open_ = still_open(full.join(to_first, ["first", "node"], "left").select("bucket", "node", F.when(F.col("node") == F.col("first"), 1.0).otherwise(F.col("to_first")).alias("to_first")), groups, full.count())
    n = open_.count()
    if not n:
        return found, groups

    open_, before = within_reach(open_, sets, similarity, n), float("inf")
    for round_ in range(STAR_ROUNDS + 1):
        open_ = still_open(open_.drop("component"), groups, n)
        n = open_.count()
        if not n:
            break
        central = F.struct(F.col("own") / F.col("n"), F.xxhash64("node")) if round_ % 2 == 0 else F.struct(F.lit(0.0), F.xxhash64("node", F.lit(round_)))
        sizes = open_.groupBy("bucket", "component").agg(F.count("*").alias("count"), F.min_by("node", central).alias("centre"))
        most = sizes.groupBy("bucket").agg(F.sum("count").alias("entries"), F.sum(F.col("count") * F.col("count")).alias("nn"), F.max_by(F.struct("component", "centre"), F.struct("count", "component")).alias("top"))
        most = written(most.select("bucket", "entries", "nn", F.col("top.component").alias("largest"), "top.centre"), "minhash-sizes", rows=n)
        apart = most.agg(F.sum((F.col("entries") * F.col("entries") - F.col("nn")) / 2)).first()[0]
        final = round_ == STAR_ROUNDS or apart <= FEW_PAIRS or apart > (1 - STAR_GAIN) * before
        before = apart
        if final:
            if apart > FEW_PAIRS:
                open_ = within_reach(open_, sets, similarity, n)
            # a pair is drawn in the least bucket that both are open in; where that one rules it out, no other need be asked
            at = written(by_place(by_node(open_).withColumn("buckets", F.col("places.bucket"))), "minhash-final", rows=n)
            left, right = (at.select("bucket", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "to_first", "component", "n", "own", "buckets"))) for s in "ab")
            once = F.array_min(F.array_intersect("buckets_a", "buckets_b")) == F.col("bucket")
            shared_at_most = F.least(F.col("n_a") - F.col("own_a"), F.col("n_b") - F.col("own_b"))
            near = (F.col("component_a") < F.col("component_b")) & (F.abs(F.col("to_first_a") - F.col("to_first_b")) <= 1 - similarity + 1e-9) & (shared_at_most * (1 + similarity) >= similarity * (F.col("n_a") + F.col("n_b")) - 1e-6)
            tried = left.join(right.withColumnRenamed("bucket", "bucket_b"), (F.col("bucket") == F.col("bucket_b")) & near & once).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
        else:
            tried = joined(open_, most.drop("nn"), "bucket").filter("component <> largest").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b"))
        tried = written(tried.distinct().join(told.select("a", "b"), ["a", "b"], "left_anti"), "minhash-pairs", rows=None if final else n)
        more = written(verify(tried, sets, small=2 * tried.count() <= SMALL_IDS), "minhash-verified")
        told = told.union(more)
        new = more.filter(F.col("similarity") >= similarity).select("a", "b")
        if not new.isEmpty():
            found = found.union(new)
            groups = components(found)
        if final:
            break
    return found, groups


def still_open(entries: DataFrame, groups: DataFrame, rows: int) -> DataFrame:
    """Entries, of `rows`, of the buckets that have more than one component, with their component."""
    at = by_node(entries).join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    at = written(by_place(at), "minhash-at", rows=rows)
    several = at.groupBy("bucket").agg(F.count("*").alias("entries"), F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 < c1").select("bucket", "entries")
    return written(joined(at, written(several, "minhash-several", rows=rows), "bucket"), "minhash-open", rows=rows)


def classes(docs: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, kept (it is the document of its class that stays) of every document."""
    small_batches(docs.sparkSession)
    source = docs.select("doc_id", "text")
    signed = written(sign(source), "minhash-signed")
    copies = signed.filter("k1 is not null and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    copies = written(copies, "minhash-copies")
    firsts = signed.join(copies.select("k1", "k2", F.col("rep").alias("doc_id")), ["k1", "k2", "doc_id"], "left_semi")
    firsts = written(firsts.select("doc_id", "bands"), "minhash-firsts")
    entries = firsts.select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket"))
    _, groups = links(source, entries, similarity)
    own = signed.select("doc_id", "k1", "k2").join(copies, ["k1", "k2"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    if groups is not None:
        own = own.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))
    else:
        own = own.select("doc_id", F.col("rep").alias("class_id"))
    return own.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def deduplicate(docs: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """The documents less those whose class has another that stays, with all their columns. Repeated rows of one doc_id leave one."""
    gone = classes(docs, similarity=similarity).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
