"""Phrase collocations of each language by best-first branch-and-bound growth.

Method.  A phrase p cut into a first part and a rest scores 1000 f(p) n / (f(first) f(rest)); as f(p) is at most f(rest), no phrase that begins with the
word w scores more than 1000 n / f(w): the count of a prefix bounds whatever grows from it.  First words are therefore expanded in bands of falling bound.
A band's phrases grow word by word: an occurrence is counted at a length only if its prefix, and its last two words, occur often enough.  After a band each
language's ``top``-th surviving score so far is known; first words whose bound is below it are settled without being expanded, and growth ends when no
other word is left.  Scores equal to the last one are kept until ranks are given, so ties are settled too.

A phrase is dropped if a longer one occurs as often.  Then a phrase one word longer does, that is: all its occurrences have the same word before them, or
the same word behind; so each phrase keeps the least and greatest neighbour of its occurrences, and no longer phrase has to be looked up.

Texts are read twice: words are counted, then texts are written as runs of frequent words (word hashes, a dictionary for each chunk), in which phrases are
counted from then on.  Tasks add up what they count and rows (hash, count) are shuffled and added; nothing is gathered by document or by word.  Which words
or phrases are frequent is told to tasks as bitmaps of ``2**BITS`` bits, whatever their number: a false positive costs a count and changes nothing.
Counts are exact; words and phrases are compared by 64-bit hashes that include the language; scores are whole numbers of 38 digits.

Defined cases: a null text is empty; a null language is ``und``; repeated rows count again; an empty table gives an empty table; other columns are ignored.
"""

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import shared, words as W
from .jaccard import _planes, _unplanes
from .shared import BITS, bitmap, held

LONGEST = 5
#: Distinct keys that a task holds before it hands their counts on.
HELD = 1 << 22

_PIECE_ENDS = [(0x21, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F), (0x0A, 0x0D)]
WORD = W._byte_class((0x20, 0x20), (0x09, 0x09), *_PIECE_ENDS)
PIECE_END = ~W._byte_class(*_PIECE_ENDS)


def coded(texts, langs):
    """For chunks of texts: (code of each word, number of its piece, its first byte and the byte behind it, the chunk's bytes, its text).

    ``langs``: a 64-bit hash of each text's language, which is mixed into its words' codes.
    """
    for lo, hi in W.chunked([len(t) for t in texts]):
        data = W.LOWER[np.frombuffer(b"\n".join(texts[lo:hi]), dtype=np.uint8)]
        starts, ends, hashes = W.hash_words(data, WORD)
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts[lo:hi]]), starts, side="right")
        codes = W.mix(hashes ^ langs[lo:hi][text])
        codes[codes == 0] = 1
        piece = np.cumsum(PIECE_END[data], dtype=np.int64)[starts] if len(starts) else np.zeros(0, np.int64)
        yield codes, piece, starts, ends, data, lo + text


class Tally:
    """Counts of 64-bit keys; merged as they come, handed on as Arrow batches when there are many."""

    def __init__(self, names=("h", "n")):
        self.parts, self.size, self.names = [], 0, list(names)

    def add(self, keys):
        """Batches that have to be handed on, if any."""
        if len(keys):
            self.parts.append(np.unique(keys, return_counts=True))
            self.size += len(self.parts[-1][0])
        if self.size > HELD:
            self._merge()
            if self.size > HELD // 2:
                yield from self.rest()

    def _merge(self):
        keys, counts = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.parts, self.size = [(keys[head], np.add.reduceat(counts, head))], len(head)

    def rest(self):
        if self.parts:
            self._merge()
            keys, counts = self.parts[0]
            for at in range(0, len(keys), 1 << 20):
                part = slice(at, at + (1 << 20))
                yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(counts[part])], names=self.names)
        self.parts, self.size = [], 0


def _source(docs, lang_col, text_col):
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.xxhash64(lang).alias("salt"), F.col(text_col).cast("string").alias("text"))


def _texts(batch):
    return W.texts_of(batch.column(2)), batch.column(1).to_numpy().view(np.uint64)


def count_words(source: DataFrame) -> DataFrame:
    """(h, n, lang, word): occurrences of each word (codes differ by language), and with h null all words of each language."""

    names_out, types = ["h", "n", "lang", "word"], [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def rows(h, n, lang, word):
        return pa.RecordBatch.from_arrays([pa.array(x, t) if x is not None else pa.nulls(len(h), t) for x, t in zip((h, n, lang, word), types, strict=True)], names=names_out)

    def run(batches):
        tally, totals, named = Tally(), {}, np.zeros(0, np.uint64)
        for b in batches:
            texts, salts = _texts(b)
            langs = b.column(0).to_pylist()
            for codes, _, starts, ends, data, text in coded(texts, salts):
                own, many = np.unique(text, return_counts=True)
                for i, n in zip(own, many.tolist(), strict=True):
                    totals[langs[i]] = totals.get(langs[i], 0) + n
                fresh, first = np.unique(codes, return_index=True)
                new = ~np.isin(fresh, named)
                if new.any():  # a task names a word once, or again after very many others
                    at = first[new]
                    named = np.union1d(named, fresh[new]) if len(named) < HELD else fresh[new]
                    yield rows(fresh[new].view(np.int64), np.zeros(len(at), np.int64), [langs[t] for t in text[at]], [data[starts[i]:ends[i]].tobytes().decode() for i in at])
                for out in tally.add(codes):
                    yield rows(out.column(0), out.column(1), None, None)
        for out in tally.rest():
            yield rows(out.column(0), out.column(1), None, None)
        yield rows(pa.nulls(len(totals), pa.int64()), list(totals.values()), list(totals), None)

    counted = shared.in_batches(source, run, "h long, n long, lang string, word string")
    return (counted.groupBy("h", F.when(F.col("h").isNull(), F.col("lang")).alias("whole"))
            .agg(F.sum("n").alias("n"), F.max("lang").alias("lang"), F.max("word").alias("word")).drop("whole"))


def write_runs(source: DataFrame, frequent, folder: str) -> DataFrame:
    """Texts as runs of frequent words, as Parquet: (dictionary of codes, places in it); code 0 parts runs."""

    def run(batches):
        for b in batches:
            for codes, piece, *_ in coded(*_texts(b)):
                often = held(frequent.value, codes)
                # a word alone between two breaks is in no phrase
                broken = np.concatenate([[True], (piece[1:] != piece[:-1]) | ~often[1:] | ~often[:-1]])[:len(codes)]
                alone = broken & np.concatenate([broken[1:], [True]])[:len(codes)]
                own = np.flatnonzero(often & ~alone)
                if not len(own):
                    continue
                line = np.zeros(len(own) + int(broken[own].sum()), np.uint64)
                line[np.arange(len(own)) + np.cumsum(broken[own])] = codes[own]
                values, places = np.unique(line, return_inverse=True)
                small = places.astype(np.uint16 if len(values) <= 1 << 16 else np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary()), pa.array([small.tobytes()], pa.binary())], names=["codes", "places"])

    out = shared.in_batches(source, run, "codes binary, places binary")
    out.write.option("compression", "zstd").parquet(folder)
    return source.sparkSession.read.parquet(folder)


class Run:
    """Phrases of a line of codes: ``gram(m)`` are the hashes of all m consecutive codes, ``whole(m)`` tells which of them no break parts."""

    def __init__(self, line):
        self.line = line
        self.gram = functools.cache(lambda m: line if m == 1 else W.grams(line, m))
        self.whole = functools.cache(lambda m: line != 0 if m == 1 else self.whole(m - 1)[:-1] & (line[m - 1:] != 0) if len(line) >= m else np.zeros(0, bool))


def _runs(batches):
    for b in batches:
        for values, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            values = np.frombuffer(values, np.uint64)
            yield Run(values[np.frombuffer(places, np.uint16 if len(values) <= 1 << 16 else np.uint32)])


def count_phrases(runs: DataFrame, kept, least: int, total: int, bits=64) -> DataFrame:
    """(h, n) of the phrases that occur ``least`` times; ``kept(run)`` yields the hashes to count, ``total`` is the number of words.

    A task sends its counts as sorted steps, one row for each range of hashes.  With fewer than 64 ``bits`` only so many top bits of a hash are counted,
    as h; what falls together is counted together, which can only let more pass.
    """
    ranges = 1 << max(5, int(total >> 21).bit_length())
    cut = np.arange(1, ranges, dtype=np.uint64) * np.uint64((1 << bits) // ranges)

    def run(batches):
        tally = Tally()
        for line in _runs(batches):
            for keys in kept(line):
                yield from packs(tally.add(keys >> np.uint64(64 - bits)))
        yield from packs(tally.rest())

    def packs(outs):
        for out in outs:
            keys, counts = out.column(0).to_numpy().view(np.uint64), out.column(1).to_numpy()
            counts = counts.astype(np.uint32) if bits == 64 else np.minimum(counts, least).astype(np.uint32 if least > 255 else np.uint8)
            at = np.concatenate([[0], np.searchsorted(keys, cut), [len(keys)]])
            used = np.flatnonzero(np.diff(at))
            columns = [pa.array(used.astype(np.int32)), pa.array([_planes(keys[at[i]:at[i + 1]]) for i in used], pa.binary()),
                       pa.array([counts[at[i]:at[i + 1]].tobytes() for i in used], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "keys", "counts"])

    def add(table: pa.Table) -> pa.Table:
        keys = np.concatenate([_unplanes(k) for k in table.column("keys").to_pylist()])
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32 if bits == 64 or least > 255 else np.uint8).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.add.reduceat(counts, head)
        return pa.table({"h": keys[head][n >= least].view(np.int64), "n": n[n >= least]})

    packed = shared.in_batches(runs, run, "part int, keys binary, counts binary")
    return packed.groupBy("part").applyInArrow(add, "h long, n long")


def frequent_pairs(runs: DataFrame, least: int, total: int) -> DataFrame:
    """The top ``BITS`` bits (h) of the hashes that pairs of ``least`` occurrences have, and of some others.

    Pairs of frequent words are many and most of them rare, so a first count takes only as many bits of a hash as the number of words asks for: a pair is
    then about two bytes.
    """
    bits = min(48, max(30, int(total).bit_length() + 7))
    likely = count_phrases(runs, lambda r: [r.gram(2)[r.whole(2)]], least, total, bits)
    return likely.select(F.expr(f"shiftright(h, {bits - BITS})").alias("h")).distinct()


_SEEN = "h long, m int, words array<long>, firsts array<long>, rests array<long>, before_lo long, before_hi long, after_lo long, after_hi long"


def describe(runs: DataFrame, kept, total: int) -> DataFrame:
    """Phrases with their words, the hashes of their first parts and rests, and their occurrences' least and greatest neighbours (0: none).

    ``kept(run, m)`` tells which phrases of m words are wanted, ``total`` is the number of words.  A task sends its phrases as arrays, one row for each
    range of hashes and length; of neighbours it sends the one that all its occurrences have, else 0.  A range makes one row of each phrase.
    """
    ranges = 1 << max(5, int(total >> 21).bit_length())
    cut = np.arange(1, ranges, dtype=np.uint64) * np.uint64((1 << 64) // ranges)
    many = pa.list_(pa.int64())
    types = [pa.int64(), pa.int32(), many, many, many, *[pa.int64()] * 4]
    names = [c.split()[0] for c in _SEEN.split(", ")]
    fold = (np.minimum, np.maximum, np.minimum, np.maximum)

    def merged(parts):
        """One row for each phrase, by hash: (h, words, ends); ends are least and greatest neighbours."""
        h, words, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        one = order[head]
        return h[one], words[one], np.stack([f.reduceat(ends[order, i], head) for i, f in enumerate(fold)], axis=1)

    def packs(m, parts):
        h, words, ends = merged(parts)
        alike = np.stack([np.where(ends[:, i] == ends[:, i + 1], ends[:, i], 0) for i in (0, 2)], axis=1)
        at = np.concatenate([[0], np.searchsorted(h, cut), [len(h)]])
        used = np.flatnonzero(np.diff(at))
        binary = lambda x: pa.array([x[at[i]:at[i + 1]].tobytes() for i in used], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(np.full(len(used), m, np.int32)), binary(h), binary(words), binary(alike)],
                                         names=["part", "m", "keys", "words", "ends"])

    def run(batches):
        held_, size = {m: [] for m in range(2, LONGEST + 1)}, dict.fromkeys(range(2, LONGEST + 1), 0)
        for line in _runs(batches):
            padded = np.concatenate([np.zeros(1, np.uint64), line.line, np.zeros(1, np.uint64)]).view(np.int64)
            for m in held_:
                at = np.flatnonzero(kept(line, m))
                if not len(at):
                    continue
                before, after = padded[at], padded[at + m + 1]
                own = merged([(line.gram(m)[at], np.stack([line.line[at + k] for k in range(m)], axis=1), np.stack([before, before, after, after], axis=1))])
                held_[m].append(own)
                size[m] += len(own[0])
                if size[m] > HELD // 16:  # a task hands a phrase on once, or again after very many
                    held_[m] = [merged(held_[m])]
                    size[m] = len(held_[m][0][0])
                    if size[m] > HELD // 32:
                        yield from packs(m, held_[m])
                        held_[m], size[m] = [], 0
        for m, parts in held_.items():
            if parts:
                yield from packs(m, parts)

    def add(table: pa.Table) -> pa.Table:
        m = table.column("m")[0].as_py()
        read = lambda c, kind, width: np.frombuffer(b"".join(table.column(c).to_pylist()), kind).reshape(-1, width)
        h, words, ends = merged([(read("keys", np.uint64, 1)[:, 0], read("words", np.uint64, m), read("ends", np.int64, 2)[:, [0, 0, 1, 1]])])
        line, at = words.reshape(-1), np.arange(len(h)) * m
        gram = lambda k: line if k == 1 else W.grams(line, k)
        lists = [words, np.stack([gram(k)[at] for k in range(1, m)], axis=1), np.stack([gram(m - k)[at + k] for k in range(1, m)], axis=1)]
        columns = [h.view(np.int64), np.full(len(h), m, np.int32), *(np.ascontiguousarray(x).view(np.int64).tolist() for x in lists), *ends.T]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    packed = shared.in_batches(runs, run, "part int, m int, keys binary, words binary, ends binary")
    return packed.groupBy("part", "m").applyInArrow(add, _SEEN)


def survivors(seen: DataFrame, counts: DataFrame, known: DataFrame, strings: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, h, words, a, l, r, n, score) of the described phrases that no longer one replaces.

    ``counts``: (h, n) of phrases; ``known``: (h, n) of all parts, repeated rows allowed; ``strings`` has each word's language.
    """
    same = lambda side: (F.col(f"{side}_lo") == F.col(f"{side}_hi")) & (F.col(f"{side}_lo") != 0)
    left = seen.filter((F.col("m") == LONGEST) | ~(same("before") | same("after")))
    left = left.join(counts.select("h", F.col("n").alias("a")), "h").withColumn("own", F.get("words", F.lit(0)))
    left = left.join(strings.select("lang", F.col("h").alias("own")), "own").join(totals, "lang")
    cuts = left.select("lang", "h", "words", "a", "total", F.posexplode(F.arrays_zip("firsts", "rests")).alias("k", "cut"))
    cuts = (cuts.select("lang", "h", "words", "a", "total", "k", F.col("cut.firsts").alias("first"), F.col("cut.rests").alias("rest"))
            .join(known.select(F.col("h").alias("first"), F.col("n").alias("l")), "first").join(known.select(F.col("h").alias("rest"), F.col("n").alias("r")), "rest"))
    score = F.expr("(cast(1000 * a as decimal(18, 0)) * cast(total as decimal(19, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(19, 0)))")
    lowest = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("low")
    scored = cuts.withColumn("score", score).groupBy("lang", "h", "a", F.col("total").alias("n")).agg(F.any_value("words").alias("words"), lowest)
    return scored.select("lang", "h", "words", "a", "low.l", "low.r", "n", "low.score")


def _last_scores(found: DataFrame, top: int) -> DataFrame:
    """(lang, last): the ``top``-th score of each language that has as many."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score")))
    return found.select("lang", "score", place.alias("place")).filter(F.col("place") <= top).filter(F.col("place") == top).select("lang", F.col("score").alias("last"))


def _first_band(steps: DataFrame, top: int) -> DataFrame:
    """(lang, past, upto, covered): the rarest first words of each language, about four for each phrase that is asked for."""
    band = steps.filter(F.col("sum") - F.col("words") < 4 * top).groupBy("lang").agg(F.max("step").alias("upto"), F.max("sum").alias("covered"))
    return band.select("lang", F.lit(-1).alias("past"), "upto", "covered")


def _next_band(steps: DataFrame, band: DataFrame, last: DataFrame) -> DataFrame:
    """The band to expand next: all steps whose bound reaches the last score, or four times as many words where there are too few phrases yet."""
    open_ = steps.join(band, "lang").join(last, "lang", "left").filter("step > upto").filter("last is null or bound >= last")
    ends = [F.max(F.when(F.expr("last is not null or sum - words < 4 * covered"), F.col(c))) for c in ("step", "sum")]
    return open_.groupBy("lang").agg(F.min("upto").alias("past"), ends[0].alias("upto"), ends[1].alias("covered"))


def mine(docs: DataFrame, top=2000, least=100, lang_col="lang", text_col="text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to 5 words that occur at least ``least`` times."""
    spark = docs.sparkSession
    send = lambda keys: spark.sparkContext.broadcast(bitmap(keys))
    union = functools.partial(functools.reduce, DataFrame.unionAll)
    source = _source(docs, lang_col, text_col)
    counted = shared.cut(count_words(source).filter((F.col("n") >= least) | F.col("h").isNull()))
    totals = counted.filter("h is null").select("lang", F.col("n").alias("total"))
    frequent = counted.filter("h is not null").withColumn("step", F.floor(F.log2("n") * 4).cast("int"))
    strings, counted = frequent.select("h", "lang", "word"), frequent.select("h", "n")
    runs = write_runs(source, send(counted), shared.new_folder(spark, "runs"))
    # classes of counts, a few hundred for each language, with the bound of their rarest word
    steps = frequent.groupBy("lang", "step").agg(F.count("*").alias("words"), F.min("n").alias("rarest")).join(totals, "lang")
    steps = shared.cut(steps.withColumn("sum", F.sum("words").over(Window.partitionBy("lang").orderBy("step")))
                       .withColumn("bound", F.expr("cast(1000 * total as decimal(38, 0)) div cast(rarest as decimal(19, 0))")))
    size = totals.agg(F.sum("total")).first()[0] or 0
    likely = send(frequent_pairs(runs, least, size))
    pairs = shared.cut(count_phrases(runs, _likely_pairs(likely), least, size))
    common = send(pairs)
    known, found, band = [counted, pairs], None, shared.cut(_first_band(steps, top))
    while found is None or band.limit(1).count():
        begun = send(frequent.join(band, "lang").filter("step > past and step <= upto"))
        levels, grown = [pairs], [common]
        for m in range(3, LONGEST + 1):
            levels.append(shared.cut(count_phrases(runs, _growth(m, begun, grown[-1], common), least, size)))
            grown.append(send(levels[-1]))
        seen = shared.cut(describe(runs, _grown(begun, grown), size))
        known += levels[1:]
        # parts that begin with words of other bands are counted by name
        lacking = seen.select(F.explode("rests").alias("h")).distinct().join(union(known), "h", "left_anti")
        known.append(shared.cut(count_phrases(runs, _named(send(lacking)), least, size)))
        fresh = survivors(seen, union(levels), union(known), strings, totals)
        found = shared.cut(fresh if found is None else found.unionAll(fresh).dropDuplicates(["h"]))
        last = _last_scores(found, top)
        band = shared.cut(_next_band(steps, band, last))
    return _ranked(found, last, strings, top)


def _likely_pairs(likely):
    """Pairs whose hash's top bits are among those of frequent ones."""

    def kept(run):
        own = run.gram(2)[run.whole(2)]
        yield own[held(likely.value, own >> np.uint64(64 - BITS))]

    return kept


def _growth(m, begun, prefixes, pairs):
    """Phrases of m words to count: begun in the band, prefix frequent, last pair frequent."""

    def kept(run):
        n = len(run.line) - m + 1
        at = np.flatnonzero(run.whole(m)) if n > 0 else np.zeros(0, np.int64)
        for test, shift, bits in ((1, 0, begun), (2, m - 2, pairs), (m - 1, 0, prefixes)):
            at = at[held(bits.value, run.gram(test)[at + shift])]
        yield run.gram(m)[at]

    return kept


def _grown(begun, grown):
    """Phrases of m words to describe: begun in the band and frequent."""

    def kept(run, m):
        if len(run.line) < m:
            return np.zeros(0, bool)
        return run.whole(m) & held(begun.value, run.line[:len(run.line) - m + 1]) & held(grown[m - 2].value, run.gram(m))

    return kept


def _named(asked):
    """Phrases of 3 words or more whose hashes are asked for."""

    def kept(run):
        for m in range(3, min(LONGEST, len(run.line) + 1)):
            yield run.gram(m)[run.whole(m) & held(asked.value, run.gram(m))]

    return kept


def _ranked(found: DataFrame, last: DataFrame, strings: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language, with their words; only phrases that reach its last score get them."""
    best = found.join(last, "lang", "left").filter("last is null or score >= last")
    word = best.select("h", F.posexplode("words").alias("k", "w")).join(strings.select(F.col("h").alias("w"), "word"), "w")
    phrase = word.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("k", "word"))).alias("p"))  # up to five words
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    named = best.join(phrase, "h").withColumn("phrase", F.array_join("p.word", " "))
    ranked = named.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
