"""Vector pairs over all vectors, against brute force."""

import random

import numpy as np

from storyspark.operators import research as rs
from storyspark.plans.registry import registered


def test_pairs_across_labels_and_copies(spark, monkeypatch):
    monkeypatch.setattr(rs, "VECTOR_BLOCK", 7)  # several tiles
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)], i % 3) for i in range(60)]
    rows += [(100 + i, rows[i % 2][1], i % 3) for i in range(9)] + [(200, None, 0), (201, [0.0] * 6, 0), (202, [1.0, 2.0], 0), (203, [2.0, 4.0], 1), (None, rows[0][1], 0), (5, rows[3][1], 1), (204, [float("nan")] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")

    def plain(same_label):
        out = []
        usable = [(i, np.array(v), k) for i, v, k in rows if i is not None and v is not None and np.isfinite(v).all() and any(v)]
        for i, v, k in usable:
            for j, w, m in usable:
                if i < j and len(v) == len(w) and (k == m or not same_label) and (c := v @ w / np.linalg.norm(v) / np.linalg.norm(w)) >= 0.3:
                    out.append((i, j, round(float(c), 9)))
        return sorted(out)

    for block in ([], ["label"]):
        got = sorted((x.a, x.b, round(x.cosine, 9)) for x in rs.vector_pairs(df, 0.3, block).collect())
        assert got == plain(bool(block))
    assert rs.vector_pairs(df.limit(0), 0.3).count() == 0


def test_a_registered_query_finds_pairs_of_different_labels(spark):
    sf = "/root/testdata/sf0.001"
    label = {x.vec_id: x.label for x in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    pairs = registered()["vector_pairs_all"][0](spark, sf).collect()
    assert any(label[x.a] != label[x.b] for x in pairs)
