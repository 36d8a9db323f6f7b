"""The training-data operators against brute force, on real rows and on awkward ones."""

import hashlib
import os
import random
import struct
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrachron.llm import bpe, chat, common, decontam, gif, langid, minhash, substring, token_counts, token_files, toxicity

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
BPE = common.tokenizer_path("word_bpe_49k.json")
BYTES = common.tokenizer_path("byte_bpe_50k.json")
LONG = "abtinther" * 3000
ODD = [None, "", "   ", "!!! ...", "one", "Σίσυφος ΑΣ İstanbul", "a<|endoftext|>b <|startoftext|>", "x\x1cy z　w", LONG, LONG + " " + LONG, "The  cat's\n\n 12 dogs'll\t", "日本語テキスト é é"]


@pytest.fixture(scope="module")
def docs(spark):
    """Real documents, awkward ones, repeated rows, and columns whose names clash with the operators' own."""
    rows = duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet' order by doc_id limit 60").fetchall()
    rows += [(10_000 + k, t) for k, t in enumerate(ODD)] + rows[:2]
    return rows, spark.createDataFrame([(d, t, "en", "s", 0, "x", "y") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, bucket string").repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_bpe_equals_the_library(docs, empty):
    rows, df = docs
    lib = library(BPE)
    for size in (65_536, 300):
        got = sorted(tuple(r) for r in bpe.encode_documents(df, segment_chars=size).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
        want = []
        for d, t in rows:
            ids = lib.encode(t or "", add_special_tokens=False).ids
            want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert got == sorted(want)
    assert bpe.encode_documents(empty).count() == 0


def test_bpe_joins_are_exact():
    lib, rng = library(BPE), random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("abetinrhs") for _ in range(rng.randrange(1, 900)))
        assert bpe.encode(text, BPE) == lib.encode(text, add_special_tokens=False).ids


def test_token_counts_equal_the_library(docs, empty):
    rows, df = docs
    lib = library(BYTES)
    got = sorted(tuple(r) for r in token_counts.count_tokens(df).collect())
    assert got == sorted((d, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t in rows)
    assert token_counts.count_tokens(empty).count() == 0


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    rows, df = docs
    lib, start, want = library(BPE), 0, []
    for d, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    out = str(tmp_path / "files")
    token_files.write_token_files(df, out)
    assert sorted(tuple(r) for r in token_files.read_token_files(spark, out).collect()) == want
    assert token_files.lookup(spark, out, rows[5][0]) == [lib.encode(rows[5][1], add_special_tokens=False).ids + [1]]
    token_files.write_token_files(empty, out)
    assert token_files.read_token_files(spark, out).count() == 0


def test_chat_reads_back(spark):
    rows = [(1, 0, "user", "a [INST] <|end|>\n b"), (1, 1, "user", "<\\s> <\\/s> </s>"), (1, 2, "assistant", None), (1, 3, "assistant", "x<|next|>y"), (2, None, None, "n"), (2, 5, "assistant", ""), (2, 5, "assistant", ""), (None, 1, "system", "s")]
    rows += [(3, k, "user" if k % 3 else "assistant", f"t{k}") for k in range(40)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        want[c] = (len(own), hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for run in (256, 4):
        got = {r[0]: tuple(r)[1:5] for r in chat.digests(chat.format_conversations(df, run_turns=run)).collect()}
        assert got == want
    text = chat.format_conversations(df).filter("conv_id = 1").first()["formatted"]
    assert text.count("<|turn|>") == 2 and text.count("<|next|>") == 2
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_language_of_unseen_texts(spark, docs, empty):
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.train(source)
    rows = {r["doc_id"]: r for r in langid.predict(source, model).collect()}
    truth = dict(duckdb.sql(f"select doc_id, lang from '{DATA}/documents.parquet'").fetchall())
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(rows[d]["held_out"] == (d in set(held)) for d in truth)
    assert np.mean([rows[d]["lang_pred"] == truth[d] for d in held]) > 0.9
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs[1], model).collect()}
    assert [odd[10_000 + k] for k in range(4)] == ["und"] * 4 and odd[10_004] in model
    assert langid.train(empty) == {} and langid.predict(docs[1], {}).filter("lang_pred <> 'und'").count() == 0


def test_gif_round_trip(docs, empty):
    rows, df = docs
    got = {(r["doc_id"], r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in gif.payload_gifs(df).collect()}
    want = set()
    for d, t in rows:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        want.add((d, len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert got == want
    assert gif.payload_gifs(empty).count() == 0


def image(left, top, w, h, pixels, *, flags=0, control=b"", start=2):
    data = gif.lzw_encode(bytes(pixels), start)
    return control + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + bytes([start, len(data)]) + data + b"\0"


def test_gif_rules(spark):
    """Transparency, disposal to background and to what was before, interlacing, a local palette."""
    colours = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    control = lambda disposal, clear=None, delay=5: b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0) + b"\0"
    raw = b"GIF89a" + struct.pack("<HHBBB", 2, 8, 0x81, 0, 0) + colours
    raw += image(0, 0, 2, 8, [1] * 16, control=control(1))
    raw += image(0, 0, 2, 1, [2, 3], control=control(2, clear=3))
    raw += image(0, 1, 2, 1, [3, 3], control=control(3))
    raw += image(0, 0, 2, 8, [k // 2 % 4 for k in range(16)], flags=0x40, control=control(0)) + b"\x3b"
    w, h, frames = gif.decode_gif(raw)
    assert (w, h, [f.start_ms for f in frames], [f.delay_ms for f in frames]) == (2, 8, [0, 50, 100, 150], [50] * 4)
    assert frames[1].canvas[0].tolist() == [[0, 255, 0, 255], [255, 0, 0, 255]]
    assert frames[2].canvas[0].tolist() == [[0, 0, 0, 0]] * 2 and frames[2].canvas[1, 0].tolist() == [0, 0, 255, 255]
    assert [frames[3].indices[r, 0] for r in (0, 4, 2, 6, 1, 3, 5, 7)] == [0, 1, 2, 3, 0, 1, 2, 3]
    media = spark.createDataFrame([(1, bytearray(raw)), (2, bytearray(b"no")), (3, None)], "id long, gif binary")
    got = gif.frames_table(media, keep=("id",)).orderBy("id", "frame").collect()
    assert [r["id"] for r in got] == [1, 1, 1, 1, 2, 3] and [r["error"] is None for r in got] == [True] * 4 + [False] * 2
    assert sum(got[0]["histogram"]) == 16


def test_toxicity_is_exact_and_finds_labelled_words(spark, empty):
    rng, words = random.Random(3), ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(30)) + (" vile scum" if k % 5 == 0 else "")) for k in range(600)]
    df = spark.createDataFrame([*rows, (9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k, _ in rows] + [(0, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, labels)
    got = {r["doc_id"]: r for r in toxicity.score_documents(df, model).collect()}
    assert all(got[k]["predicted"] == (k % 5 == 0) for k, _ in rows)
    assert got[9000]["predicted"] == 0 and got[9000]["score"] == got[9001]["score"]
    assert {0, 1} == {int(r["held_out"]) for r in got.values()}
    assert toxicity.train(df, labels.limit(0)) is None
    assert toxicity.score_documents(empty, model).count() == 0 and toxicity.score_documents(df, None).filter("score > 0").count() == 0
    rand = np.random.default_rng(1)
    vectors = []
    for _ in range(500):
        t = np.sort(rand.choice(40, 5, replace=False))
        v = rand.random(5)
        vectors.append((t, v / np.linalg.norm(v)))
    index = toxicity.Index(vectors, 40)
    dense = np.zeros((500, 40))
    for k, (t, v) in enumerate(vectors):
        dense[k, t] = v
    for t, v in vectors[:50]:
        q = np.zeros(40)
        q[t] = v
        assert np.allclose(index.nearest(t, v, 15)[1], np.sort(dense @ q)[::-1][:15])


def brute_items(texts, items):
    """Best weighted Jaccard of any window of an item's size."""
    out = {}
    for d, t in texts:
        h = common.shingle_hashes(common.word_hashes(t))
        for i, s in items:
            g = common.shingle_hashes(common.word_hashes(s))
            n = min(len(g), len(h))
            if n and len(common.word_hashes(t)) >= 5:
                sim = max(common.weighted_jaccard(h[k : k + n], g) for k in range(len(h) - n + 1))
                if sim >= 0.8:
                    out[d, i] = sim
    return out


def test_decontamination_equals_brute_force(spark, empty):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(rng.randrange(12, 50)))) for k in range(12)]
    texts = []
    for k in range(60):
        w = [word() for _ in range(80)]
        if k % 3 == 0:
            own = items[k % 12][1].split()
            if k % 2:
                own[len(own) // 2] = "changed"
            if k % 5 == 0:
                own = own[: len(own) - 1]
            at = rng.randrange(80)
            w[at:at] = own
        texts.append((k, " ".join(w)))
    texts += [(100, None), (101, ""), (102, items[3][1].upper()), (103, "a b")]
    df = spark.createDataFrame([(*r, 1) for r in texts], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "...")], "item_id long, text string")
    want = brute_items(texts, items)
    for block in (20_000, 5):
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.find_items(df, bench, block_items=block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    left = {r["doc_id"] for r in decontam.decontaminate(df, bench).collect()}
    assert left == {d for d, _ in texts} - {d for d, _ in want}
    assert decontam.find_items(empty, bench).count() == 0 and decontam.find_items(df, bench.limit(0)).count() == 0


def near_copies(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, k = [], 0
    for _ in range(12):
        base = [word() for _ in range(120)]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 9, 14):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(120)] = word()
            rows.append((k, " ".join(own)))
            k += 1
    return rows


def test_classes_equal_brute_force(spark, empty):
    rows = [*near_copies(random.Random(4)), (900, None), (901, ""), (902, "..."), (903, "a b c"), (904, "A, b c!")]
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class_id string")).collect()}
    sets = {d: minhash.counted(common.shingle_hashes(common.word_hashes(t))) for d, t in rows}
    label = {d: d for d, _ in rows}
    changed = True
    while changed:
        changed = False
        for a, _ in rows:
            for b, _ in rows:
                if a < b and len(sets[a][0]) and len(sets[b][0]) and label[a] != label[b] and common.counted_jaccard(*sets[a], *sets[b]) >= 0.8:
                    low = min(label[a], label[b])
                    label = {d: low if v in (label[a], label[b]) else v for d, v in label.items()}
                    changed = True
    assert got == label
    assert minhash.classes(empty).count() == 0


def test_signature_estimates_probability_jaccard():
    a, b = np.arange(1, 400, dtype=np.uint64), np.arange(40, 440, dtype=np.uint64)
    a, b = common.mixed(a), common.mixed(b)
    sig = minhash.signatures([minhash.counted(a), minhash.counted(b)])
    assert abs((sig[0] == sig[1]).mean() - 359 / 440) < 0.12


def test_compact_windows_agree_with_sliding_minima():
    rng = np.random.default_rng(7)
    for n in (5, 21, 22, 200):
        for most in (10, 1 << 40):
            rank = rng.integers(0, most, n).astype(np.uint64)
            want = sorted({k + int(np.argmin(rank[k : k + 21])) for k in range(n - 20)})
            assert substring.window_minima(rank, 21).tolist() == want
            assert [c for _, c, _ in substring.compact_windows(rank, 21)] == want


def test_passages_equal_exact_repeats(spark, empty):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared = [[word() for _ in range(70)] for _ in range(4)]
    rows = []
    for k in range(60):
        w = [word() for _ in range(100)]
        if k % 2:
            own = list(shared[k % 4])
            if k % 3 == 0:
                own[35] = "changed"
            at = rng.randrange(100)
            w[at:at] = own
        elif k % 4 == 0:
            w[10:10] = shared[0][:40]  # too short to count
        rows.append((k, " ".join(w)))
    rows += [(200, rows[2][1]), (201, None), (202, ""), (203, "a b c")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string")
    found = substring.repeated_passages(df).collect()
    words = {d: (t or "").split() for d, t in rows}
    first = {1: 1, 3: 3}
    want = {k for k in range(60) if k % 2 and k not in (first[k % 4],)} | {200}
    assert {r["doc_id"] for r in found} == want
    assert all(r["end_word"] - r["first_word"] >= 50 and r["source_id"] < r["doc_id"] for r in found)
    left = {r["doc_id"]: r["text"] for r in substring.remove_passages(df).collect()}
    assert len(left) == len(rows) and left[201] is None and left[0] == rows[0][1] and left[1] == rows[1][1]
    assert all(len(left[k].split()) <= len(words[k]) - 60 for k in want if k < 60)
    assert substring.repeated_passages(empty).count() == 0


def test_components(spark):
    from terrachron.llm.components import components

    edges = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = dict((r[0], r[1]) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: 0 for k in range(21)} | {k: 100 for k in range(100, 140)}


def test_pipeline_runs_and_keeps_its_promises(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and out.columns[:2] == ["doc_id", "n_tokens"]


def test_queries_are_registered():
    import __spark_entry__ as entry

    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in entry.queries()) == 1
    assert "pipeline" in entry.queries()


def passage_words(seed):
    rng = random.Random(seed)
    return lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def passages_of(spark, texts):
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    return [tuple(r) for r in substring.repeated_passages(df).select("doc_id", "first_word", "end_word", "source_id").collect()]


def test_passages_are_told_at_each_place(spark):
    new = passage_words(8)
    p = new(80)
    found = passages_of(spark, [new(50) + p + new(50), new(100) + p + new(500) + p + new(10), p[:60] + new(300)])
    for at in (100, 680):
        assert any(d == 1 and a <= at + 3 and b >= at + 77 for d, a, b, _ in found)
    assert any(d == 2 and a <= 3 and b >= 57 for d, a, b, _ in found)


def test_passages_with_inserted_words(spark):
    new = passage_words(9)
    p, q = new(80), new(200)
    texts = [new(200) + p + new(200), new(150) + p[:40] + new(8) + p[40:] + new(150), new(100) + q[:160] + new(30) + q[160:] + new(100), new(100) + q + new(100)]
    found = passages_of(spark, texts)
    assert any(d == 1 and a <= 153 and b >= 235 for d, a, b, _ in found)
    assert any(d == 3 and a <= 103 and b >= 297 for d, a, b, _ in found)
    # what differs beside a passage isn't part of it
    assert all(a >= {1: 150, 3: 100}[d] and b <= {1: 238, 3: 300}[d] for d, a, b, _ in found)


def test_passages_are_held_against_all_holders(spark):
    new = passage_words(10)
    p = new(50)
    changed = lambda k: [*p[:k], *new(1), *p[k + 1 :]]
    for many in (0, 30):  # of documents that share no more than a line with the passage
        lines = [new(60) + p[12:48] + new(60) for _ in range(many)]
        middle = [new(30) + t + new(30) for t in (changed(10), changed(40), p, changed(25))]
        found = passages_of(spark, [*lines, *middle])
        assert {(d - many, s - many) for d, _, _, s in found if d == many + 2} and (3, 2) in {(d - many, s - many) for d, _, _, s in found}
        assert all(d >= many for d, *_ in found)


def test_bpe_cuts_within_unspaced_mixed_text(spark):
    a = "abtinther" * 8000
    texts = ["é" + a, "é" + a, "x's" + a, a + "é" + a, a + "'s" + a, a + "'LL" + a + "ñ's", a + "<|endoftext|>'s" + a, "1É" + a + "İ" + a, a + "!'re" + a, a, "日本" + a + " don't"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lib = library(BPE)
    want = [(d, hashlib.sha256(" ".join(map(str, lib.encode(t, add_special_tokens=False).ids)).encode()).hexdigest()) for d, t in enumerate(texts)]
    for size in (65_536, 500):
        got = bpe.encode_documents(df, segment_chars=size)
        assert sorted((r["doc_id"], r["ids_sha256"]) for r in got.collect()) == want


def test_rows_without_or_with_repeated_ids_are_judged_by_themselves(spark):
    item = " ".join(passage_words(5)(30))
    clean = " ".join(passage_words(6)(30))
    df = spark.createDataFrame([(None, item, 1), (None, clean, 2), (7, clean, 3), (7, "x " + item, 4), (8, None, 5)], "doc_id long, text string, keep int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r["keep"] for r in decontam.decontaminate(df, bench).collect()} == {2, 3, 5}
    rows = [(k, "good plain words here" + (" vile scum" if k % 4 == 0 else "") + f" n{k}") for k in range(400)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in rows], "doc_id long, toxic int"))
    asked = spark.createDataFrame([(None, "vile scum", 1), (None, "good words", 2), (9, "vile scum", 3), (9, "good words", 4), (None, None, 5)], "doc_id long, text string, keep int")
    assert {r["keep"] for r in toxicity.without_toxic(asked, model).collect()} == {2, 4, 5}
    assert toxicity.without_toxic(asked, None).count() == 5


def test_passages_are_cut_only_where_they_were_found(spark):
    word = passage_words(11)
    passage, short = word(80), word(30)
    rows = [(1, " ".join(word(20) + passage + word(20)), "a"), (2, " ".join(word(20) + passage + word(40)), "b"), (2, " ".join(short), "c"), (None, " ".join(passage), "d")]
    out = {r["_spans"]: r["text"] for r in substring.remove_passages(spark.createDataFrame(rows, "doc_id long, text string, _spans string")).collect()}
    assert out["a"] == rows[0][1] and out["c"] == rows[2][1] and out["d"] == rows[3][1]
    assert len(out["b"].split()) == 60


def test_gif_that_declares_too_much_gives_an_error(spark):
    raw = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b";"
    (row,) = gif.frames_table(spark.createDataFrame([(1, bytearray(raw))], "doc_id long, gif binary"), keep=("doc_id",)).collect()
    assert row["error"] and row["rgba"] is None


def test_language_needs_a_letter_and_learns_without_null_ids(spark):
    rows = [(k, ("der hund und die katze " if k % 2 else "the dog and the cat ") * 20, "de" if k % 2 else "en") for k in range(60)]
    rows += [(None, "???? zzz " * 30, "en")] * 50 + [(900, "½ ² ①", "en"), (901, "и", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify_language(df).collect() if r["doc_id"] is not None}
    assert got[900] == "und" and got[901] != "und" and all(got[k] == ("de" if k % 2 else "en") for k in range(60))
    assert not any(b"zzz" in d for d in langid.train(df).values())


def test_one_hot_bucket_gives_the_same_classes(spark, monkeypatch):
    rows = near_copies(random.Random(8))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r["doc_id"]: r["class_id"] for r in minhash.classes(df).collect()}
    monkeypatch.setattr(minhash, "HOT_KEYS", 0)  # nothing is frequent
    assert {r["doc_id"]: r["class_id"] for r in minhash.classes(df).collect()} == want
