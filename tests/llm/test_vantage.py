"""Nearest neighbours against brute force: exact with factor one, recall of the query's own parameters, odd vectors and ids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlode.llm import queries, vantage

ROWS = "vec_id long, embedding array<float>, rank int, score string"


def brute(vectors, asked, k):
    """Per query id: (distance, id) of the k nearest other ids, each once, among vectors of the same length."""
    out = {}
    for q, v in asked:
        best = out.setdefault(q, {})
        for i, w in vectors:
            if i != q and len(w) == len(v):
                d = float(np.sqrt(((np.array(v, dtype=np.float64) - np.array(w, dtype=np.float64)) ** 2).sum()))
                best[i] = min(best.get(i, np.inf), d)
    return {q: sorted((d, i) for i, d in best.items())[:k] for q, best in out.items()}


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.score, r.vec_id))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], ROWS).repartition(3)


def clean(rows):
    f = [(i, None if v is None else [None if e is None else float(np.float32(e)) for e in v]) for i, v in rows]
    return [(i, v) for i, v in f if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]


@pytest.mark.parametrize("shard_bytes", [1 << 26, 1 << 13])
def test_factor_one_is_exact(spark, shard_bytes):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + rng.normal(size=8) * (0.01 if i % 3 else 1)).tolist()) for i in range(900)]
    rows += [(i, centres[0].tolist()) for i in range(900, 1300)]  # many copies of one vector: ties go to the smaller ids
    rows += [(i, rng.normal(size=3).tolist()) for i in range(1300, 1306)]
    rows += [(1400, None), (1401, []), (1402, [0.0] * 8), (1403, [float("nan")] + [1.0] * 7), (1404, [float("inf")] + [1.0] * 7), (1405, [None] + [1.0] * 7), (None, [1.0] * 8),
             (10, [9.0] * 8), (11, [9.0] * 8), (11, [9.0] * 8), (1406, [-0.0] * 7 + [1.0]), (1407, [0.0] * 7 + [1.0]), (1408, [1.0] * 70)]
    df = table(spark, rows)
    asked = df.filter("vec_id % 20 = 0 or vec_id in (11, 1300, 1406, 1408)")
    got = answers(vantage.search(df, asked, k=4, factor=1, fit_rows=300, shard_bytes=shard_bytes))
    good = clean(rows)
    want = brute(good, [(i, v) for i, v in good if i % 20 == 0 or i in (11, 1300, 1406, 1408)], 4)
    assert got == {q: w for q, w in want.items() if w}
    assert 1408 not in got and got[1406][0] == (0.0, 1407)


def test_edges(spark):
    none = table(spark, [])
    some = table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.5])])
    assert vantage.search(none, none).count() == 0 and vantage.search(some, none).count() == 0 and vantage.search(none, some).count() == 0
    assert answers(vantage.search(some, some, k=10)) == {1: [(0.5, 2)], 2: [(0.5, 1)]}
    double = some.withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert answers(vantage.search(double, double, k=10)) == {1: [(0.5, 2)], 2: [(0.5, 1)]}
    for bad in ({"factor": 0.5}, {"k": 0}):
        with pytest.raises(ValueError):
            vantage.search(some, some, **bad)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    folder = f"/root/testdata/{sf}"
    got = answers(queries.op11_nearest_neighbours(spark, folder))
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], dtype=np.float64), np.array([r.vec_id for r in rows])
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        true = np.lexsort((ids, d))[:10]
        own = got[int(ids[q])]
        assert len(own) == 10 and own == sorted(own) and all(s == pytest.approx(d[ids == i][0], abs=1e-12) for s, i in own)
        hits, total = hits + len({i for _, i in own} & set(ids[true].tolist())), total + 10
    assert hits / total >= 0.95
