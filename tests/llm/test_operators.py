"""Each corpus operator against brute force on sf0.001, on awkward rows, and on empty tables."""

import collections
import hashlib
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftgrid.llm import exact_dedup, language, near_dedup, packing, pivot_search, quality, repeats, sharding, toxicity, word_bpe
from driftgrid.llm.common import table

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = "lorem ipsum dolor sit amet consectetur " * 400
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, shard string, keep_id string"
ROWS = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, " ab\n"), (5, LONG), (6, LONG), (None, "Ünï İstanbul Ω <|endoftext|> 12"), (7, "!!! ---"), (8, "word " * 30)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en" if i != 7 else None, "s", 1, 1, "x", "y") for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 1, 1), (3, 0, 1), (5, None, None), (None, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


def test_exact_dedup(docs, odd, empty):
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups["".join(c for c in r["text"] if c not in exact_dedup.WHITE)].append((-len(r["text"]), r["doc_id"]))
    want = {d: (min(g)[1], len(g)) for g in groups.values() for _, d in g}
    got = exact_dedup.exact_dedup(docs).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == want and sum(r["kept"] for r in got) == len(groups)
    out = exact_dedup.exact_dedup(odd).collect()
    assert len(out) == len(ROWS) and sum(r["kept"] for r in out) == 6
    assert {r["keep_id"] for r in out if r["doc_id"] in (3, 4)} == {4}
    assert exact_dedup.without_copies(odd).columns == odd.columns and exact_dedup.exact_dedup(empty).count() == 0


def test_sharding(docs, odd, empty):
    out = sharding.shard(docs, 8).select("doc_id", "shard", "slot", sharding.size_of(F.col("text")).alias("size")).toPandas()
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"]) and len(out) == docs.count()
    share = out["size"].sum() / 8
    assert (abs(out.groupby("shard")["size"].sum() - share) <= out["size"].max()).all()
    assert sharding.shard(odd, 3).count() == len(ROWS) and sharding.shard(empty, 3).count() == 0
    small = sharding.shard(docs, 2, piece_bytes=50_000).select("shard", "slot").toPandas()
    assert all(sorted(g) == list(range(len(g))) for _, g in small.groupby("shard")["slot"])


def test_packing(docs, odd, empty):
    coder = Tokenizer.from_file(BYTES)
    for frame in (docs, odd):
        ids = [np.array([*coder.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4") for r in frame.collect()]
        out = packing.pack_documents(frame, BYTES).toPandas()
        want = collections.Counter((zlib.crc32(x[a:a + 2048].tobytes()), a, len(x)) for x in ids for a in range(0, len(x), 2048))
        assert collections.Counter(zip(out["ids_crc32"], out["start"], out["doc_tokens"])) == want
        for _, g in out.sort_values("offset").groupby("sequence_id"):
            assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 2048
    assert packing.pack_documents(empty, BYTES).count() == 0


def test_pack_patterns_use_every_length_once():
    histogram = {2048: 3, 1500: 7, 700: 5, 548: 2, 30: 100, 1: 9}
    used = collections.Counter()
    for n, lengths in packing.pack_patterns(histogram, 2048):
        assert sum(lengths) <= 2048
        for x in lengths:
            used[x] += n
    assert used == histogram


def test_word_bpe(docs, odd, empty):
    coder = Tokenizer.from_file(WORDS)
    for frame in (docs, odd):
        want = collections.Counter()
        for r in frame.collect():
            ids = coder.encode(r["text"] or "", add_special_tokens=False).ids
            want[len(ids), " ".join(map(str, ids)), coder.decode(ids, skip_special_tokens=False)] += 1
        got = collections.Counter((r["n_tokens"], r["ids"], r["decoded"]) for r in word_bpe.encode_decode(frame, WORDS).collect())
        assert got == want
    assert word_bpe.encode_decode(empty, WORDS).count() == 0


def test_word_bpe_of_a_word_of_a_million_letters(spark):
    letters = np.array(list("acgt"))[np.random.default_rng(4).integers(0, 4, 1_000_000)]
    word = "".join(letters)
    rows = [(1, word), (2, word[:1000]), (3, word[:1000] + "é")]
    coder = Tokenizer.from_file(WORDS)
    want = {d: (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) for d, ids in ((d, coder.encode(t, add_special_tokens=False).ids) for d, t in rows)}
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in word_bpe.encode_decode(frame, WORDS, digest=True).collect()} == want


def covered(texts, n):
    seen = collections.Counter(b[i:i + n] for b in texts for i in range(len(b) - n + 1))
    for b in texts:
        mark = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - n + 1):
            if seen[b[i:i + n]] > 1:
                mark[i:i + n] = True
        yield bytes(x for x, gone in zip(b, mark, strict=True) if not gone)


def test_repeats(docs, odd, empty):
    for frame in (docs, odd):
        rows = frame.collect()
        want = collections.Counter((r["doc_id"], hashlib.sha256(k).hexdigest()) for r, k in zip(rows, covered([(r["text"] or "").encode() for r in rows], 400), strict=True))
        assert collections.Counter((r["doc_id"], r["kept_sha256"]) for r in repeats.without_repeats(frame).collect()) == want
    out = repeats.without_repeats_text(odd)
    assert out.columns == odd.columns and out.count() == len(ROWS) and repeats.without_repeats(empty).count() == 0


def test_maximal_repeats_need_left_diversity():
    places = [(s[:8][::-1], s[8:]) for s in (b"xxabcdefGHIJKLmm", b"yyabcdefGHIJKLnn", b"zzzzcdefGHIJzzzz")]
    found = {(left, right): sorted(who.tolist()) for left, right, who in repeats.maximal_repeats(places, 8)}
    assert found == {(6, 6): [0, 1], (4, 4): [0, 1, 2]}


def similar_pairs(texts, least):
    """Pairs whose words match in order over words in either by `least` or more; all pairs, by the textbook table."""
    words = [t.lower().split() for t in texts]
    bags = [collections.Counter(w) for w in words]
    for i, a in enumerate(words):
        for j, b in enumerate(words[:i]):
            if min(len(a), len(b)) < least * max(len(a), len(b)):
                continue
            most = (bags[i] & bags[j]).total()
            if most and most >= least * (len(a) + len(b) - most):
                common = in_order_matches(a, b)
                if common >= least * (len(a) + len(b) - common):
                    yield i, j


def test_near_duplicates(docs, odd, empty):
    rows = docs.collect()
    cls = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    reach = {r["doc_id"]: r["doc_id"] for r in rows}     # components over all pairs from 0.8 on
    found = {least: [] for least in (0.8, 0.85)}
    for least, hits in found.items():
        for i, j in similar_pairs([r["text"] for r in rows], least):
            a, b = rows[i]["doc_id"], rows[j]["doc_id"]
            hits.append(cls[a] == cls[b])
            if least == 0.8 and reach[a] != reach[b]:
                low, high = sorted((reach[a], reach[b]))
                reach = {d: low if c == high else c for d, c in reach.items()}
    assert all(len(hits) > 5 and sum(hits) >= share * len(hits) for hits, share in zip(found.values(), (0.9, 0.95), strict=True))
    assert all(reach[d] == reach[c] for d, c in cls.items())
    out = near_dedup.near_duplicates(odd).collect()
    assert len(out) == len(ROWS) and {r["class_size"] for r in out if r["doc_id"] in (1, 2)} == {1} and sum(r["kept"] for r in out) == 8
    assert near_dedup.without_near_copies(odd).columns == odd.columns and near_dedup.near_duplicates(empty).count() == 0


def in_order_matches(a, b):
    """Longest common subsequence by the textbook table."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = row
        row = [0]
        for j, y in enumerate(b):
            row.append(left[j] + 1 if x == y else max(row[j], left[j + 1]))
    return row[-1]


def test_alignment_of_long_texts_holds_only_the_band(monkeypatch):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 60, 60_000).astype(np.uint64)
    b = a.copy()
    b[[0, *range(5, 60_000, 30), 59_999]] = 7            # both ends differ, so nothing is stripped; 7 is in b alone
    tracemalloc.start()
    try:
        found, peak = near_dedup.aligned(a, b), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    common = int((a == b).sum())
    assert found == common / (2 * len(a) - common) and peak < 40_000_000
    monkeypatch.setattr(near_dedup, "SLIDE", 3)          # many slides of the window on small texts
    for k in range(300):
        x = rng.integers(0, (3, 12, 1000)[k % 3], int(rng.integers(1, 60))).astype(np.uint64)
        y = np.insert(np.delete(x, rng.integers(0, len(x), k % 7)), 0, rng.integers(0, 12, k % 4).astype(np.uint64))
        if len(y):
            common = in_order_matches(x.tolist(), y.tolist())
            s = common / (len(x) + len(y) - common)
            assert near_dedup.aligned(x, y) == (s if s >= 0.8 else 0.0)


def near_classes(texts):
    """Class of each text by brute force: all pairs that share a draw are aligned."""
    words = [near_dedup.word_ids(t) for t in texts]
    draws = [set(near_dedup.order_minhash(near_dedup.shingles(w))) if len(w) else set() for w in words]
    same = [" ".join(t.lower().split()) for t in texts]
    cls = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            linked = same[i] == same[j] and same[i] or draws[i] & draws[j] and near_dedup.aligned(words[i], words[j])
            if linked and cls[i] != cls[j]:
                lo, hi = sorted((cls[i], cls[j]))
                cls = [lo if c == hi else c for c in cls]
    return cls


def test_near_duplicates_lose_no_link_of_a_large_family(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(300):                                 # 1 to 9 words changed, a third of them twice over
        words = list(base)
        for at in rng.integers(0, 120, 1 + k % 9):
            words[at] = f"x{k if k % 3 else k % 12}"
        texts.append(" ".join(words))
    texts += [" ".join([*base[:60], *(f"y{k}_{i}" for i in range(60))]) for k in range(40)]      # half in common: no link
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(frame).collect()}
    assert [got[i] for i in range(len(texts))] == near_classes(texts)


def test_pipeline_stages_against_brute_force(spark, docs, tmp_path):
    """Each stage on what its predecessor kept, then run() as a whole."""
    import corpus_pipeline

    spark.createDataFrame(docs.collect()[:120] + docs.collect()[:10], docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    rows, frame = {}, table(spark, str(tmp_path), "documents")
    start = frame.collect()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        rows[name] = frame.collect()
        assert name == "packing" or frame.columns == docs.columns
    told = {r["doc_id"]: r for r in language.predict_language(docs, language.fit_language(docs)).collect()}
    assert {r["doc_id"] for r in rows["language"]} <= {r["doc_id"] for r in start if told[r["doc_id"]]["lang_pred"] != "und"}
    assert len(rows["language"]) >= 0.95 * sum(told[r["doc_id"]]["lang_pred"] != "und" for r in start)

    best = {}
    for r in rows["language"]:
        k = "".join(c for c in r["text"] if c not in exact_dedup.WHITE)
        best[k] = min(best.get(k, (0, 0)), (-len(r["text"]), r["doc_id"])) if k in best else (-len(r["text"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in rows["exact_dedup"]) == sorted(d for _, d in best.values())

    left = sorted(rows["exact_dedup"], key=lambda r: r["doc_id"])
    assert sorted(r["doc_id"] for r in rows["near_dedup"]) == [left[i]["doc_id"] for i in sorted(set(near_classes([r["text"] for r in left])))]

    left = rows["near_dedup"]
    want = {r["doc_id"]: k.decode(errors="ignore") for r, k in zip(left, covered([r["text"].encode() for r in left], 400), strict=True)}
    assert {r["doc_id"]: r["text"] for r in rows["repeats"]} == want

    coder = Tokenizer.from_file(BYTES)
    want = {r["doc_id"]: [*coder.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in rows["repeats"]}
    pieces = sorted(rows["packing"], key=lambda r: (r["doc_id"], r["start"]))
    for d, ids in want.items():
        own = [r for r in pieces if r["doc_id"] == d]
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]] and sum(r["length"] for r in own) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"]:r["start"] + r["length"]], dtype="<u4").tobytes()) for r in own)
    whole = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()
    assert sorted(map(tuple, whole)) == sorted(tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")) for r in pieces)


def test_aligned_is_lcs_over_union():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = rng.integers(0, 1 << 40, 60, dtype=np.uint64)
        b = np.delete(a, rng.integers(0, 60, 3))
        b[rng.integers(0, len(b))] = 7
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        c = t[-1][-1]
        s = c / (len(a) + len(b) - c)
        assert near_dedup.aligned(a, b) == pytest.approx(s if s >= 0.8 else 0)


def test_pivot_search(spark, sf):
    vectors = table(spark, sf, "embeddings")
    rows = [(r["vec_id"], np.floor(256 * np.array(r["embedding"], dtype=float)).astype(int)) for r in vectors.collect()]
    want = {(q, rank + 1, v, s) for q, x in rows if q % 50 == 0 for rank, (s, v) in enumerate(sorted(((-int(x @ y), v) for v, y in rows if v != q))[:5]) for s in [-s]}
    assert {tuple(r) for r in pivot_search.search(vectors).collect()} == want
    bad = spark.createDataFrame([(0, [1.0, 2.0]), (50, [1.0]), (51, [float("nan")]), (52, [None, 1.0]), (53, None), (None, [1.0]), (54, [2.0, 0.0]), (54, [2.0, 0.0])], "vec_id long, embedding array<double>")
    out = pivot_search.search(bad).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == 0] == [(54, 131072), (54, 131072), (50, 65536)]
    assert pivot_search.search(bad.limit(0)).count() == 0


def test_language(docs, odd, empty):
    out = language.predict_language(docs, language.fit_language(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (out["lang_pred"] == out["lang"]).mean() > 0.97 and out["score"].between(0, 1).all()
    odd_out = {r["doc_id"]: r["lang_pred"] for r in language.predict_language(odd, language.fit_language(odd)).collect()}
    assert odd_out[1] == odd_out[2] == odd_out[7] == "und" and odd_out[5] == "en"
    assert language.predict_language(empty, language.fit_language(empty)).count() == 0 and language.in_known_language(odd).columns == odd.columns


def test_toxicity(docs, odd, empty, labels, spark, sf):
    known = table(spark, sf, "labels")
    out = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, known)).toPandas()
    assert len(out) == docs.count() and out["score"].between(0, 1).all() and ((out["score"] >= 0.3) == (out["predicted"] == 1)).all()
    assert toxicity.score_toxicity(odd, toxicity.fit_toxicity(odd, labels)).count() == len(ROWS)
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, labels.limit(0))).count() == 0


def test_quality(docs, odd, empty, labels, spark, sf):
    """Counts, weights and the cut again in plain Python; the noise is what the key has above the weight."""
    known = table(spark, sf, "labels")
    good = collections.defaultdict(set)
    for r in known.collect():
        if r["doc_id"] is not None and r["quality"] in (0, 1):
            good[r["doc_id"]].add(r["quality"])
    rows = docs.collect()
    raw, wanted = collections.Counter(), collections.Counter()
    for r in rows:
        raw.update(quality.bag(r["text"]).tolist())
        if good.get(r["doc_id"]) == {1}:
            wanted.update(quality.bag(r["text"]).tolist())
    ratio = [np.log((wanted[b] + 1) / (wanted.total() + quality.BUCKETS)) - np.log((raw[b] + 1) / (raw.total() + quality.BUCKETS)) for b in range(quality.BUCKETS)]
    want = {r["doc_id"]: sum(ratio[b] for b in quality.bag(r["text"])) for r in rows}
    out = quality.resample(docs, known, share=0.5).toPandas()
    assert {r.doc_id: r.log_weight for r in out.itertuples()} == pytest.approx(want)
    noise = out["gumbel_key"] - out["log_weight"]
    assert -3 < noise.min() < noise.max() < 14 and 0.2 < noise.mean() < 1 and 0.9 < noise.std() < 1.7
    best = set(out.sort_values("gumbel_key", ascending=False)["doc_id"][:100])
    assert set(out[out["kept"]]["doc_id"]) == best
    assert quality.resample(docs, known).filter("kept").count() == round(len(rows) * sum(g == {1} for g in good.values()) / len(good))
    assert quality.resample(odd, labels).count() == len(ROWS) and quality.resample(empty, labels.limit(0)).count() == 0
    assert quality.resample(odd, labels, share=0.0).filter("kept").count() == 0 and quality.resample(odd, labels, share=1.0).filter("kept").count() == len(ROWS)


def test_quality_keeps_ties_at_the_cut_whole(spark, labels):
    rows = [(None, "the same words")] * 60 + [(i, f"word{i} other{i * 7}") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for share in (0.01, 0.3, 0.5, 0.9):
        out = quality.resample(frame, labels, share=share).toPandas()
        cut = out["gumbel_key"].sort_values(ascending=False).iloc[round(100 * share) - 1]
        assert (out["kept"] == (out["gumbel_key"] >= cut)).all() and out["kept"].sum() >= 100 * share
    ranks = spark.createDataFrame([(-(1 << 63), 1), (-5, 2), (7, 3), ((1 << 63) - 1, 1)], "key long, weight long")
    assert [quality.cut_key(ranks, k) for k in range(1, 8)] == [-(1 << 63), -5, -5, 7, 7, 7, (1 << 63) - 1]
