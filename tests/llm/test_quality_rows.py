"""The quality model learns from every labelled row, in one part or several."""

import random

from textlode.llm import quality


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda y: rng.choice(("stone", "river", "green")) if y else f"{rng.choice('#$%')}{rng.randrange(999)}!"
    rows = [(i, " ".join(word(i % 3) for _ in range(80)), min(i % 3, 1)) for i in range(3600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, label long").repartition(3)
    monkeypatch.setattr(quality, "PART", 1500)
    model = quality.train(table.select("doc_id", "text"), table.select("doc_id", "label"), rounds=6)
    assert model.samples == (3600, 7200)
    got = {r.doc_id: r.score for r in quality.score(table, model).collect()}
    assert sum((got[i] > 0.5) == y for i, _, y in rows) > 3500
    monkeypatch.setattr(quality, "BROADCAST", 10)
    again = quality.train(table.select("doc_id", "text"), table.select("doc_id", "label"), rounds=1)
    assert again.samples == (3600, 7200)
