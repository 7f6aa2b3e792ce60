"""Fill-in-middle against a plain loop over the contract's own words, and the rank index against the offsets it was fitted to."""

import hashlib
import random
import re

import numpy as np
import pytest

from textlode.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\t ", "a", " a", "a ", "a<P>b c", "x <S>", "<M>", "<<P >", "é🎉 日本 x  y\n", "w " * 5000, "x" * 70000 + " y\t" + "z" * 70000 + "  ", "a b c d e f", "a b c d e f"]


def plain(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    units = TOKEN.findall(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_rows_as_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(None if i == 7 else i // 2, ODD[i % len(ODD)] if i % 3 else "".join(rng.choice("ab<P>é \n🎉") for _ in range(rng.choice([3, 40, 900]))), 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output int").repartition(3)
    made = fim.transform(docs)
    got = made.withColumn("again", fim.restored()).collect()
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    want = sorted((repr((i, *plain(i, t))), t or "") for i, t, _ in rows)
    assert sorted((repr(tuple(r)[:-1]), r.again) for r in got) == want
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert fim.transform(docs.limit(0)).count() == 0
    all_forms = fim.transform(docs, fim_percent=100, spm_percent=0).collect()
    assert {r.form for r in all_forms} == {"plain", "psm"}


@pytest.mark.parametrize("error", [1, 9, 127])
def test_index_gives_every_offset_back(error):
    rng = np.random.default_rng(error)
    texts = [np.cumsum(rng.integers(1, top, n)) for top, n in ((2, 9000), (3, 1), (900, 4000), (70000, 50), (5, 0))]
    offsets = np.concatenate([np.concatenate([[0], t]) for t in texts]).astype(np.int64)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    index = fim.RankIndex(offsets, first, error)
    for i, t in enumerate(texts):
        assert index.at(np.full(len(t) + 1, i), np.arange(len(t) + 1)).tolist() == [0, *t.tolist()]
    assert np.abs(index.residuals.astype(int)).max() <= error
    assert len(index.starts) < len(offsets) / 2
    with pytest.raises(ValueError):
        fim.RankIndex(offsets, first, 128)
