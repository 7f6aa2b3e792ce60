"""Co-occurrence by classes, bands and blocks."""

from itertools import combinations

import pytest
from pyspark.sql import DataFrameWriter

from textlode.operators import ordering, vocabulary


def _docs():
    docs = {f"d{d}": {f"t{(d * 131 + i * 7) % 397}" for i in range(10 + 20 * d)} for d in range(12)}
    own = {f"own{i}" for i in range(300)}
    return docs | {"e1": docs["d9"] | own, "e2": docs["d11"] | own}


@pytest.mark.parametrize("block_rows", [1 << 22, 200])
def test_classes_and_blocks_give_every_pair(spark, block_rows):
    docs = _docs()
    at = {}
    for p, ts in docs.items():
        for t in ts:
            at.setdefault(t, set()).add(p)
    usable = {t: ps for t, ps in at.items() if 2 <= len(ps) <= len(docs) / 2}
    want = {(x, y): len(usable[x] & usable[y]) for x, y in combinations(sorted(usable), 2)
            if len(usable[x] & usable[y]) >= 2 and len(usable[x] & usable[y]) / len(usable[x] | usable[y]) >= 0.3}
    sets = spark.createDataFrame([(p, sorted(ts)) for p, ts in docs.items()] + [("empty", [])], "path string, terms array<string>").repartition(3)
    classes = vocabulary.term_classes(sets)
    assert classes.count() == len({frozenset(ps) for ps in usable.values()})
    pairs = vocabulary.class_pairs(classes, block_rows=block_rows)
    got = sum(len(r.a) * (len(r.a) - 1) // 2 if r.own else len(r.a) * len(r.b) for r in pairs.collect())
    assert got == len(want) > 300 * 299 / 2
    if block_rows > 200:
        assert {(r.t1, r.t2): r.joint for r in vocabulary.class_synonyms(classes).collect()} == want


def test_long_lists_are_added_up_in_parts():
    import numpy as np
    lists = [np.arange(i, 400, i + 1) for i in range(12)]
    order = sorted(range(12), key=lambda i: len(lists[i]))
    packed, df = [vocabulary._gaps(lists[i].astype(np.int64)) for i in order], np.array([len(lists[i]) for i in order])
    want = {}
    for x in range(12):
        for y in range(x, 12):
            both = len(set(lists[order[x]]) & set(lists[order[y]]))
            if both >= 2 and both / (df[x] + df[y] - both) >= 0.3:
                want[x, y] = both
    for most in (1, 30, 1 << 19):
        got = {(int(a), int(b)): int(n) for found in vocabulary._joint(packed, packed, df, df, True, 2, 0.3, most) for a, b, n in zip(*found, strict=True)}
        assert got == want
        cross = [(int(a), int(b)) for found in vocabulary._joint(packed[:6], packed[6:], df[:6], df[6:], False, 2, 0.3, most) for a, b in zip(*found[:2], strict=True)]
        assert sorted(cross) == sorted((x, y - 6) for x, y in want if x < 6 <= y)


def test_synonyms_of_a_query_are_those_of_the_table(spark):
    rows = [(f"src/f{i}.txt", " ".join(f"Word{k}" for k in range(30) if (i * 7 + k) % (k % 5 + 2) == 0), "txt", i) for i in range(20)]
    files = spark.createDataFrame([*rows, ("src/none.txt", None, "txt", 99)], "path string, content string, language string, ord int")
    table = {tuple(r) for r in vocabulary.class_synonyms(vocabulary.term_classes(vocabulary.term_sets(files))).collect()}
    assert {tuple(r) for r in vocabulary.synonyms(vocabulary.document_terms(vocabulary.weighted_terms(files))).collect()} == table
    asked = ["word3", "word4"]
    assert {tuple(r) for r in vocabulary.synonyms_of(files, asked).collect()} == {r for r in table if r[0] in asked or r[1] in asked} != set()


def test_blocks_are_not_shuffled_for_each_block_they_meet(spark, monkeypatch):
    docs = _docs()
    sets = spark.createDataFrame([(p, sorted(ts)) for p, ts in docs.items()], "path string, terms array<string>").repartition(3)
    classes = ordering.cut_lineage(vocabulary.term_classes(sets))
    plans, write = [], DataFrameWriter.parquet

    def seen(self, *a, **b):
        plans.append(self._df._jdf.queryExecution().optimizedPlan().toString())
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    pairs = vocabulary.class_pairs(classes, block_rows=200)
    plans.append(pairs._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not [p for p in plans if "Exchange" in p or "FlatMapGroups" in p]
    want = {(tuple(sorted([tuple(sorted(r.a)), tuple(sorted(r.b))])), r.own, r.joint) for r in vocabulary.class_pairs(classes).collect()}
    got = [(tuple(sorted([tuple(sorted(r.a)), tuple(sorted(r.b))])), r.own, r.joint) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_runs_of_rows_are_of_bounded_size():
    import numpy as np
    for sizes, most in (([1, 1, 1, 9, 1, 1], 3), ([5], 1), ([], 4), ([2] * 7, 100)):
        cuts = vocabulary._cuts(np.array(sizes, np.int64), most)
        assert [i for at, n in cuts for i in range(at, at + n)] == list(range(len(sizes)))
        assert all(sum(sizes[at:at + n]) < most + max(sizes[at:at + n]) for at, n in cuts)
