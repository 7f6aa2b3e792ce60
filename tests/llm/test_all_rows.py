"""Trees learn from every labelled candidate, however many there are and wherever they lie."""

import random

import numpy as np

from textlode.llm import pii


def test_pii_counts_every_candidate(spark, monkeypatch):
    rng = random.Random(3)
    lot = lambda: "-".join(str(rng.randrange(10, 99)) for _ in range(5))
    rows = [(i, f"call +1 ({rng.randrange(200, 999)}) 555-{i:04d} or lot {lot()} end") for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [y for _, t in rows for _, y in pii.labelled(t)]
    assert labels.count(0) > 4000 and labels.count(1) > 4000
    seen, grow = [], pii.Trees.grow

    def watched(trees, sums):
        trees.rounds = 2
        return grow(trees, lambda own, level: seen.append(sums(own, level)) or seen[-1])

    monkeypatch.setattr(pii.Trees, "grow", watched)
    monkeypatch.setattr(pii, "PART", 64)
    models = [pii.train(docs.repartition(k)) for k in (1, 5)]
    learned = seen[0][0, 0, :, 2].sum()
    assert 0.75 * len(labels) < learned < 0.85 * len(labels)  # all but the fifth that sets the thresholds
    assert (models[0].trees.leaf == models[1].trees.leaf).all() and (models[0].trees.slot == models[1].trees.slot).all()
    assert models[0].thresholds == models[1].thresholds


def test_trees_of_counted_rows_are_those_of_the_rows():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (3000, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 3)).astype(np.int64)
    one = pii.Trees(rounds=6).fit(x, y)
    counted = pii.Trees(rounds=6).prepare(one.cuts, float(y.mean()))
    codes, n = np.unique(np.column_stack([counted.codes(x), y]), axis=0, return_counts=True)
    counted.grow(lambda trees, level: sum(trees.sums(c[:, :3], c[:, 3].astype(np.int64), k, level) for c, k in zip(np.array_split(codes, 3), np.array_split(n, 3), strict=True)))
    assert (one.score(x) == counted.score(x)).all() and ((one.score(x) > 0.5) == y).all()
