"""Collocations against counting every phrase of every text."""

import random
import re
from collections import Counter, defaultdict

import pytest

from textlode.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top, least):
    counts, n, out = defaultdict(Counter), Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    counts[lang][tuple(w[i:i + m])] += 1
    for lang, f in counts.items():
        often = [p for p, a in f.items() if len(p) > 1 and a >= least]
        inside = {p[i:i + m] for p in often for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * f[p] >= 100 * f[p[i:i + m]]}
        best = []
        for p in often:
            if p not in inside:
                score, k = min((1000 * f[p] * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


def mined(spark, rows, top, least):
    df = spark.createDataFrame([(t, lang, 1, "x") for t, lang in rows], "text string, lang string, n int, word string").repartition(3)
    return sorted(map(tuple, phrases.mine(df, top, least).collect()))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "日本", "<s>", "a-b", "THE", "\x00z", " "]
    fixed = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 9]))) for _ in range(12)]
    rows = []
    for i in range(400):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else vocabulary[min(int(rng.expovariate(0.15)), len(vocabulary) - 1)] for _ in range(rng.choice([0, 1, 5, 60]))]
        rows.append(("".join(p + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ","]) for p in parts), rng.choice(["en", "en", "fr", None, "und", ""])))
    return rows


@pytest.mark.parametrize("top,least", [(4, 5), (3000, 8)])
def test_mined_as_counted(spark, top, least):
    """A small ``top`` settles languages in several bands and leaves first words unexpanded; a large one needs them all."""
    rows = corpus(top) + [(None, "en"), (None, None), ("", "de"), ("...", "de"), ("x " * 70000, "xx"), ("a b", "fr"), ("a b", "fr")]
    assert mined(spark, rows, top, least) == brute(rows, top, least)


def test_edges(spark):
    assert mined(spark, [], 5, 2) == []
    assert mined(spark, [("one two", "en"), (None, None)], 5, 2) == []
    # "b c" always stands in "a b c d e f", of which five words are the most a phrase has
    rows = [("a b c d e f", "en")] * 4 + [("b x a", "en")] * 3
    assert mined(spark, rows, 10, 2) == brute(rows, 10, 2)
    # ties of score and count: by bytes of the phrase
    rows = [("p q", "en"), ("é q2", "en"), ("z q3", "en")] * 3
    got = mined(spark, rows, 2, 2)
    assert got == brute(rows, 2, 2) and [r[2] for r in got] == ["p q", "z q3"]


def test_descriptions_are_sent_by_range(spark):
    import numpy as np
    total = 400 * 9
    rows = [(" ".join(f"w{(i * 7 + k) % 300}" for k in range(9)), "en") for i in range(400)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    source = phrases._source(df, "lang", "text")
    all_ = spark.sparkContext.broadcast(np.full(1 << 22, 255, np.uint8))
    runs = phrases.write_runs(source, all_, phrases.shared.new_folder(spark, "runs"))
    kept = lambda run, m: run.whole(m)
    seen = phrases.describe(runs, kept, total)
    got = seen.collect()
    assert len(got) == len({r.h for r in got}) == 300 * 4
    assert all(len(r.words) == r.m and len(r.firsts) == len(r.rests) == r.m - 1 for r in got)
    by = {r.h: r for r in got}
    for r in got:
        if r.m > 2:
            assert by[r.firsts[-1]].words == r.words[:-1] and by[r.rests[0]].words == r.words[1:]
        assert r.firsts[0] == r.words[0] and r.rests[-1] == r.words[-1]
