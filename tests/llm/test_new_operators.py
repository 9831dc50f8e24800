"""Conversation repair, fill-in-middle and vector dedup against plain Python."""

import collections
import functools
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from driftgrid.llm import fill_middle, queries, repair, repeats, vector_dedup
from driftgrid.llm.common import table

TALK = "conv_id long, turn long, role string, text string, conv string, fault int"


def damaged_rows(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if d == 1:
            text = ""
        if d == 2:
            text = re.sub("[.!?]", "", text)
        if d == 4:
            role = "user"
        out += [(c, t, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def fixed(rows):
    """Counts and cheapest repair of one conversation's rows in order, by trying every edit at every row."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def best(i, last, inserts):
        ways = []
        if i == len(rows) and last in ("", "a"):
            ways.append((0, "", ()))
        other = "a" if last == "u" else "u"
        full = {"u": "user", "a": "assistant"}[other]
        if inserts < 3:
            c, e, out = best(i, other, inserts + 1)
            ways.append((c + 2, "I" + e, ((full, ""), *out)))
        if i < len(rows):
            role, text = rows[i][2:]
            c, e, out = best(i + 1, last, 0)
            ways.append((c + 3, "D" + e, out))
            if faults[i] in ("", "truncated"):
                late = faults[i] == "truncated"
                if role[:1] and role[:1] in follows[last]:
                    c, e, out = best(i + 1, role[0], 0)
                    ways.append((c + late, "K" + e, ((role, text), *out)))
                c, e, out = best(i + 1, other, 0)
                ways.append((c + 2 + late, "R" + e, ((full, text), *out)))
        return min(ways, key=lambda w: w[:2], default=(10 ** 9, "", ()))

    cost, audit, out = best(0, "", 0)
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    roles = [r[2][:1] for r in rows]
    n = collections.Counter(faults)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, n["blank"], n["duplicate"], n["truncated"], sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit, digest


def repaired(rows, ids):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    mark = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest())
    return {c: fixed(sorted(by[c], key=mark)) for c in ids}


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def outcome(df, key="conv"):
    got = df.collect()
    out = {r[key]: tuple(r[c] for c in COLUMNS) for r in got}
    assert len(out) == len(got)
    return out


def test_repair_of_all_conversations(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = repaired(damaged_rows(rows), {r[0] for r in rows})
    got = outcome(queries.op11_conversation_repair(spark, sf), "conv_id")
    assert got == want and len({w[6] for w in want.values()}) > 20


ODD = [(1, 0, "user", "hi."), (1, 0, "user", "hi."), (1, None, None, None), (1, 2, "", "x"), (1, 2, "tool", " y "), (None, 1, "assistant", "z!"), (None, None, "user", "q?"),
       (2, None, "system", "only."), (3, 5, "user", None), (4, 9, "USER", "a.\x0b"), (5, 1, "system", "s."), (5, 2, "system", "s."), (5, 3, "assistant", "é" * 70_000)]


def test_repair_of_odd_rows(spark):
    talks = spark.createDataFrame([(*r, "x", 1) for r in ODD], TALK)
    got = outcome(repair.repair(repair.damaged(talks), talks.select(F.col("conv_id").alias("conv"))))
    assert got == repaired(damaged_rows(ODD), {r[0] for r in ODD})
    none = talks.limit(0)
    assert repair.repair(repair.damaged(none), none.select(F.col("conv_id").alias("conv"))).count() == 0


@pytest.mark.parametrize("bits", [1, 3])
def test_long_conversations_are_solved_in_blocks(spark, bits, monkeypatch):
    rnd = np.random.default_rng(bits)
    rows = [(int(c), t, str(rnd.choice(["user", "assistant", "system", "tool", "user", "assistant"])), str(rnd.choice(["yes.", "", "no", "so!", f"t{t}.", f"u{t}", f"w{t}?"])))
            for c, n in enumerate([40, 1, 23, 0, 60, 7]) for t in range(n)]
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    frame = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    ids = spark.range(6).select(F.col("id").alias("conv"))
    want = repaired(rows, range(6))
    assert outcome(repair.repair(frame, ids)) == want
    turns = collections.defaultdict(list)
    for r in sorted(repair.repair(frame, ids, turns=True).collect(), key=lambda r: (r["conv"], r["place"])):
        turns[r["conv"]].append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(turns[c]).encode()).hexdigest() for c in want} == {c: w[-1] for c, w in want.items()}


def middle(doc, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc, n, "plain", None, None, text
    return (doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle(spark, sf, monkeypatch):
    texts = [None, "", "a", "é", "<", "ab<P>", "x<M", " 日本 go\U0001f600\U0001f600now", "12 ab\n\n3C<S", "Straße " * 3000, " \t", "<P><S><M>"]
    odd = spark.createDataFrame([(i if i % 5 else None, t, 1, "n") for i, t in enumerate(texts * 4)], "doc_id long, text string, n int, form string").coalesce(2)
    for frame, bound in ((table(spark, sf, "documents"), fill_middle.SLICE), (odd, 50)):
        monkeypatch.setattr(fill_middle, "SLICE", bound)
        out = fill_middle.fill_in_middle(frame)
        assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        got = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
        want = collections.Counter((*middle(r["doc_id"], r["text"]), r["text"] or "") for r in frame.collect())
        assert collections.Counter(map(tuple, got)) == want
    assert fill_middle.fill_in_middle(odd.limit(0)).count() == 0


def test_wavelet_matrix_ranks():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        codes = rnd.integers(0, 4, n).astype(np.uint8)
        m, at = fill_middle.WaveletMatrix(codes), np.arange(n + 1)
        for c in range(4):
            assert m.rank(c, at).tolist() == [0, *np.cumsum(codes == c).tolist()]


def linked(rows, least=0.93):
    """n_links, component_id, kept by row number, from all pairs in double precision."""
    def good(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    near = [[i != j and good(rows[i][1], rows[i][2]) and good(rows[j][1], rows[j][2]) and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1])
             and np.dot(rows[i][1], rows[j][1]) / (np.linalg.norm(rows[i][1]) * np.linalg.norm(rows[j][1])) >= least for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            k = todo.pop()
            for j in range(n):
                if near[k][j] and j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        top = min(ids, default=None)
        out.append((rows[i][0], sum(near[i]), top, top is not None and rows[i][0] == top))
    return collections.Counter(out)


def test_vector_dedup(spark, monkeypatch):
    rnd = np.random.default_rng(13)
    bases = rnd.normal(size=(8, 24))
    vs = [(b + rnd.normal(size=24) * rnd.choice([0.02, 0.2, 0.4])).astype(np.float32).tolist() for b in bases for _ in range(22)]
    rows = [(i, v, i % 3 if i % 7 else 1) for i, v in enumerate(vs)]
    rows += [(500 + i, vs[5], 1) for i in range(9)] + [(None, vs[5], 1), (600, vs[5], None), (601, None, 1), (602, [0.0] * 24, 1), (603, [1.0, None], 1), (604, [float("nan")] * 24, 1),
             (605, [float("inf")] * 24, 1), (606, [], 1), (607, vs[5][:5], 1), (608, vs[5][:5], 1), (7, vs[5], 1), (609, [1e-30] * 24, 1), (610, [1e30] * 24, 1)]
    frame = spark.createDataFrame([(*r, 3, "k") for r in rows], "vec_id long, embedding array<float>, label int, n_links int, kept string")
    monkeypatch.setattr(vector_dedup, "TILE", 16)
    monkeypatch.setattr(vector_dedup, "PAIRS", 10)
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows]
    for strip in (20, 4096):
        assert collections.Counter(map(tuple, vector_dedup.near_vectors(frame, strip=strip).collect())) == linked(single)
    assert vector_dedup.near_vectors(frame.limit(0)).count() == 0


def test_quantisation_bound_holds():
    rnd = np.random.default_rng(1)
    for d in (1, 3, 64, 2100):
        x = rnd.normal(size=(60, d)) * np.exp(rnd.normal(size=(60, d)) * 3)
        q, s, e = vector_dedup.quantised(x)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        assert (vector_dedup.products(q, q) == q.astype(np.int64) @ q.astype(np.int64).T).all()
        gap = np.abs(u @ u.T - s[:, None] * s * vector_dedup.products(q, q))
        assert (gap <= e[:, None] * (1 + e) + e + 1e-12).all()


def test_crowded_anchors_give_the_same_removals(spark):
    rnd = np.random.default_rng(6)
    letters = list("abcdefghij")
    middle = "".join(rnd.choice(letters, 396))
    texts = ["".join(rnd.choice(list("xyz"), 150)) + "".join(rnd.choice(list("pq"), 4)) + middle + "".join(rnd.choice(list("rs"), 4)) + "".join(rnd.choice(list("uvw"), 150)) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(table(spark, "/root/testdata/sf0.001", "documents").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    seen = collections.Counter(t[i:i + 400] for t in texts for i in range(len(t) - 399))
    want = {}
    for k, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[t[i:i + 400]] > 1:
                gone[i:i + 400] = True
        want[k] = int(gone.sum())
    outs = [{r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.without_repeats(frame, most=most).collect()} for most in (repeats.CROWD, 1)]
    assert outs[0] == outs[1] and {k: outs[0][k][0] for k in want} == want and 0 < sum(v > 0 for v in want.values())


def test_repeats_hold_one_anchor_in_python():
    """Places come as rows: an anchor that goes on over batches is settled once, and earlier ones before the rest is read."""
    rnd = np.random.default_rng(9)
    middle = bytes(rnd.integers(97, 107, 60))
    rows = [(a, a, 7, 100 + k, middle[:20] + bytes(rnd.integers(110, 120, 30)), middle[20:] + bytes(rnd.integers(110, 120, 30)))
            for a, n in ((1, 2), (2, 9), (3, 2), (4, 3)) for k in range(n)]
    whole = pd.DataFrame(rows, columns=["a", "d1", "d2", "pos", "left", "right"])
    read = []

    def batches(n):
        for k in range(0, len(whole), n):
            read.append(k)
            yield whole.iloc[k:k + n].reset_index(drop=True)

    run = repeats._groups(50)
    want = pd.concat(run(batches(len(whole))), ignore_index=True)
    assert len(want) == len(whole) and (want["stop"] - want["start"] >= 50).all()
    for n in (1, 2, 3, 5):
        assert pd.concat(run(batches(n)), ignore_index=True).equals(want)
    read.clear()
    next(run(batches(2)))
    assert read == [0, 2]


def test_repeats_hand_back_few_contexts_at_once():
    data = bytes(np.random.default_rng(10).integers(97, 107, 3 * repeats.HELD))
    places = [{"a": 1, "pos": k, "full": False} for k in range(2 * repeats.HELD + 5)]
    texts = pd.DataFrame({"d1": [1, 2], "d2": [1, 2], "blob": [zstandard.compress(data)] * 2, "places": [places, places[:3]], "grams": [[], []]})
    out = list(repeats._contexts(400, None)(iter([texts])))
    assert max(map(len, out)) <= repeats.HELD and pd.concat(out)["pos"].tolist() == [p["pos"] for p in places + places[:3]]
    assert all(r.right == data[r.pos:r.pos + 400] and r.left == data[max(0, r.pos - 336):r.pos][::-1] for f in out for r in f.itertuples())


def test_repeats_take_small_batches_and_give_the_same(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, frame = spark.conf.get(name), table(spark, "/root/testdata/sf0.001", "documents")
    outs = []
    try:
        for n in (10_000, 3):
            spark.conf.set(name, n)
            out = repeats.without_repeats(frame)
            assert int(spark.conf.get(name)) == min(n, 1000)
            outs.append(sorted((r["doc_id"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.collect()))
    finally:
        spark.conf.set(name, before)
    assert outs[0] == outs[1] and any(r[1] for r in outs[0])


def test_repeats_stage_takes_passages_of_fifty_words(spark):
    """Passages of 50 words and more in two rows go, below 400 bytes too; 49 words, or places within one row, stay."""
    import corpus_pipeline

    rnd = np.random.default_rng(8)
    word = lambda: "".join(rnd.choice(list("abcdefgé"), rnd.integers(1, 8)))
    some = lambda n: [word() for _ in range(n)]
    short, exact, under, wide, own = (some(n) for n in (58, 50, 49, 140, 60))
    tiny = ["a", "b"] * 40
    texts = [" ".join([*some(40), *p, *some(30)]) for p in (short, short, exact, exact, under, under, wide, wide[20:90], wide[60:], [*own, *some(5), *own], tiny, tiny[3:])]
    texts += ["\n\t ".join(short) + " ", " ".join(tiny), " ".join(tiny), " ".join(some(300)), "", None, " \n"]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    where = collections.defaultdict(set)
    for k, w in enumerate(words):
        for i in range(len(w) - 49):
            where[tuple(w[i:i + 50])].add(k)
    seen = collections.Counter((t or "").encode()[i:i + 400] for t in texts for i in range(len((t or "").encode()) - 399))
    want = {}
    for k, t in enumerate(texts):
        data = (t or "").encode()
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
        gone = np.zeros(len(data), bool)
        for i in range(len(at) - 49):
            if len(where[tuple(words[k][i:i + 50])]) > 1:
                gone[at[i][0]:at[i + 49][1]] = True
        for i in range(len(data) - 399):
            if seen[data[i:i + 400]] > 1:
                gone[i:i + 400] = True
        want[k] = None if t is None else bytes(np.frombuffer(data, np.uint8)[~gone]).decode(errors="ignore")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.no_repeats(spark, frame, "").collect()}
    assert got == want and got[4] == texts[4] and got[9] == texts[9] and len(" ".join(short).encode()) < 400
    assert [len((got[k] or "").split()) for k in (0, 1, 2, 12, 13)] == [70, 70, 70, 0, 0]
    assert corpus_pipeline.no_repeats(spark, frame.limit(0), "").count() == 0


def test_repeats_text_takes_one_python_step_between_exchanges(spark):
    again = "é" * 300
    frame = spark.createDataFrame([(1, "a" + again + "b"), (2, "\u00c3" + again[1:] + "c"), (3, None), (4, "")], "doc_id long, text string")
    out = repeats.without_repeats_text(frame, words=50)
    assert out._jdf.queryExecution().sparkPlan().toString().count("ArrowEvalPython") == 2       # texts packed before the exchange, cut after it
    bytes_ = {r["doc_id"]: r["kept"] for r in repeats.without_repeats(frame, words=50).collect()}
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {1: bytes_[1].decode(errors="ignore"), 2: bytes_[2].decode(errors="ignore"), 3: None, 4: ""}
    assert got[1].startswith("a") and got[1].endswith("b") and got[2].endswith("c") and len(got[1]) < 10 and len(got[2]) < 10
