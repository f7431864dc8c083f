"""SimHash components and exact top-k against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from storyspark.llm import simhash, top_k


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_golay_code_is_perfect():
    offsets = simhash._offsets()
    assert offsets[0].shape == (2048, 1) and (offsets[0] >= 0).all()
    r = np.random.default_rng(0).integers(0, 1 << 23, 1000)
    home = r ^ offsets[0][simhash.syndrome(r), 0]
    assert (simhash.syndrome(home) == 0).all() and (np.bitwise_count(home ^ r) <= 3).all()


def test_links_are_all_found(spark):
    r = random.Random(0)
    fps = []
    for _ in range(60):
        f = r.getrandbits(64)
        fps.append(f)
        for _ in range(6):
            g = f
            for b in r.sample(range(64), r.randint(1, 4)):
                g ^= 1 << b
            fps.append(g)
    fps = sorted(set(fps) | {0, 1, 3, 2**64 - 1})
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    got = {(x.a, x.b) for x in simhash.linked(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert got == want and len(want) > 100


def test_rows_at_all_anchors_are_not_broadcast(spark):
    """A step in Python hides that it makes 61 rows of one, so that Spark takes them for a small table."""
    fps = spark.range(1000).select(F.xxhash64("id").alias("fp"))
    plan = simhash.linked(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def docs(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(60):
        t = " ".join(r.choice(words) for _ in range(80))
        rows.append((i, t))
        if i % 4 == 0:
            rows.append((100 + i, t.upper() if i % 8 else t))
        if i % 5 == 0:
            rows.append((200 + i, t + " w1"))
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one"), (304, "ONE"), (305, "one two"), (306, "Été été x"), (7, rows[0][1]), (None, rows[0][1]), (None, "quite alone here now"), (308, "long " * 30_000)]
    return spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, fp string, component int"), rows


def test_components(spark):
    df, rows = docs(spark)
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = components(fps)
    least = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            least[c] = min(least.get(c, 1 << 60), i)
    want = sorted(((i, f, least.get(c)) for (i, _), f, c in zip(rows, fps, comp)), key=str)
    got = sorted(((x.doc_id, x.fp % 2**64, x.component_id) for x in simhash.simhash_components(df).collect()), key=str)
    assert got == want
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_one_document_of_each_group_stays(spark):
    df, rows = docs(spark)
    kept = simhash.keep_one_per_component(df, ["doc_id", "text"]).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    want = {r.component_id for r in simhash.simhash_components(df).collect()} - {None}
    assert sorted(ids) == sorted(want) and sum(r.doc_id is None for r in kept) == 2


def plain_top_k(rows, k=5):
    v = {}
    for i, x in rows:
        if i is not None and x and all(e is not None and np.isfinite(e) for e in x):
            y = [int(np.floor(256 * float(np.float32(e)))) for e in x]
            v[i] = min(v.get(i, y), y)
    out = []
    for q in v:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q and len(v[c]) == len(v[q]))[:k]
            out += [(q, n + 1, c, -x) for n, (x, c) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["unit", "spread", "ties"])
def test_top_k(spark, kind, monkeypatch):
    monkeypatch.setattr(top_k, "BLOCK", 64)
    monkeypatch.setattr(top_k, "QUERY_BLOCK", 4)
    monkeypatch.setattr(top_k, "PROBES", 32)
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 8))
    if kind == "unit":
        x /= np.linalg.norm(x, axis=1)[:, None]
    elif kind == "spread":
        x *= r.lognormal(0, 2, 600)[:, None]
    else:
        x = np.round(x / 4)
        x[:200] = x[0]
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(x)]
    rows += [(600, None), (601, []), (602, [None] * 8), (603, [float("nan")] * 8), (650, [1.0, 2.0]), (651, [3.0, 4.0]), (None, rows[0][1]), (50, rows[50][1]), (700, [float("inf")] * 8), (750, [-1.0] * 8), (800, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    got = sorted((a.query_id, a["rank"], a.id, a.score) for a in top_k.top_k(df, F.col("id") % 50 == 0).collect())
    assert got == plain_top_k(rows)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k.top_k(df, F.col("id") % 50 == 0).count() == 0


def test_products_beyond_doubles():
    q = np.array([[2.0**40, 3.0]])
    assert top_k.products(q, np.array([[2.0**20, 5.0]]))[0, 0] == 2**60 + 15


def test_an_id_that_leads_two_components_keeps_both(spark):
    texts = {1: ["one two three four five six seven eight", "quite another text with nothing in common at all"], 2: ["one two three four five six seven eight"], 3: ["a third text of its own that stands alone"]}
    rows = [(i, t, k) for i, ts in texts.items() for k, t in enumerate(ts)] + [(1, texts[1][1], 5)]
    kept = simhash.keep_one_per_component(spark.createDataFrame(rows, "doc_id long, text string, copies int"), ["doc_id", "text", "copies"]).collect()
    assert sorted(map(tuple, kept)) == sorted([(1, texts[1][0], 0), (1, texts[1][1], 1), (3, texts[3][0], 0)])


def test_all_vectors_of_a_repeated_id_are_found(spark):
    rows = [(0, [1.0, 1.0]), (1, [0.5, 0.5]), (1, [0.9, 0.9]), (1, [0.9, 0.9]), (2, [0.1, 0.1]), (50, [1.0, 0.0]), (50, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((a.query_id, a["rank"], a.id, a.score) for a in top_k.top_k(df, F.col("id") == 0, k=3).collect())
    assert got == [(0, 1, 50, 131072), (0, 2, 1, 117760), (0, 3, 1, 65536)]
    own = [(a["rank"], a.id, a.score) for a in top_k.top_k(df, F.col("id") == 50, k=1).collect()]
    assert sorted(own) == [(1, 0, 65536), (1, 0, 131072)]
