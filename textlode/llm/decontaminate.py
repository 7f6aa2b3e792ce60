"""Benchmark decontamination by winnowed word k-grams.

Method.  Of every ``window - k + 1`` consecutive k-gram hashes the minimum (the rightmost, if tied) is a fingerprint, in documents and in items.  A
span of ``window`` words that both have holds one full winnow window, so both keep the same minimum: no shared span of ``window`` words is missed.
Fingerprints that match are extended: each window of ``window`` words around a matching k-gram is looked up among the items' windows, and the words
of those that occur are hit.  The result is therefore exact, whatever fingerprints matched.  Items of fewer words are one window of their own length
m, winnowed with k = m and one k-gram a window.

Items come in blocks of at most ``block_words`` words (by hash of the item's text, long items cut into pieces that overlap by ``window - 1`` words),
each sent to the executors and held against all documents; so what is broadcast has a fixed bound whatever the benchmark's size.  Nothing is paired
within a group, documents are never shuffled, and a passage in a third of all rows costs each of them one lookup.

Defined cases: a null text has no words, as has an empty one; it is never contaminated.  A null item, or one without words, has no window.  Items that
share an id count once, repeated documents give repeated rows, an empty benchmark gives no hits; extra columns are ignored.  A null item id counts as "".
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shared, words as W

FIELDS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_words array<struct<start:int,end:int>>"


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the minimum, rightmost if tied, of every ``w`` consecutive hashes."""
    n = len(hashes) - w + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    best, low = np.arange(n), hashes[:n].copy()
    for j in range(1, w):
        other = hashes[j:n + j]
        better = other <= low
        low[better], best[better] = other[better], np.flatnonzero(better) + j
    return np.unique(best)


class Index:
    """Windows of one block of items: per window length, sorted fingerprints and sorted window hashes with their items."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int, k: int):
        self.window, self.k, self.parts = window, k, {}
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        lengths: dict[int, list] = {}
        for name, hashes in items:
            if len(hashes):
                lengths.setdefault(min(len(hashes), window), []).append((number[name], hashes))
        for m, own in lengths.items():
            gram = min(k, m) if m == window else m
            prints, spans, owners = [], [], []
            for i, hashes in own:
                g = W.grams(hashes, gram)
                prints.append(g[winnow(g, m - gram + 1)])
                s = np.unique(W.grams(hashes, m))
                spans.append(s)
                owners.append(np.full(len(s), i, dtype=np.int32))
            spans, owners = np.concatenate(spans), np.concatenate(owners)
            order = np.argsort(spans, kind="stable")
            self.parts[m] = gram, np.unique(np.concatenate(prints)), spans[order], owners[order]


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def hits(hashes: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(mask of hit words, numbers of the items with occurring windows) of one document."""
    hit, found = np.zeros(len(hashes) + 1, dtype=np.int64), []
    for m, (gram, prints, spans, owners) in index.parts.items():
        g = W.grams(hashes, gram)
        w = m - gram + 1
        chosen = winnow(g, w)
        seeds = chosen[_member(g[chosen], prints)] if len(chosen) else chosen
        if not len(seeds):
            continue
        # extension: all windows that contain a matching k-gram
        starts = np.unique(np.concatenate([seeds - j for j in range(w)]))
        starts = starts[(starts >= 0) & (starts <= len(hashes) - m)]
        own = W.grams(hashes, m)[starts]
        ok = _member(own, spans)
        starts, own = starts[ok], np.unique(own[ok])
        np.add.at(hit, starts, 1)
        np.add.at(hit, starts + m, -1)
        for lo, hi in zip(np.searchsorted(spans, own), np.searchsorted(spans, own, side="right"), strict=True):
            found.append(owners[lo:hi])
    return np.cumsum(hit[:-1]) > 0, np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int32)


def _runs(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).reshape(-1, 2)


def item_words(benchmark: DataFrame, id_col="item_id", text_col="text", window=10, piece=1 << 16) -> DataFrame:
    """(item, words, block key): word hashes of each item, long items in pieces that overlap by ``window - 1`` words."""

    def read(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for lo, hashes, cuts, *_ in W.words_by_text(b.column(1), W.ALNUM):
                for i in range(len(cuts) - 1):
                    own = hashes[cuts[i]:cuts[i + 1]]
                    for at in range(0, max(1, len(own) - window + 1), piece):
                        part = own[at:at + piece + window - 1]
                        if len(part):
                            rows.append((ids[lo + i] or "", part.view(np.int64).tolist(), len(part)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.int64())],
                names=["item", "words", "n"])

    return benchmark.select(F.col(id_col).cast("string"), text_col).transform(shared.in_batches, read, "item string, words array<long>, n long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", window=10, k=5,
                  block_words=1 << 22) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated and ``hit_words`` (word ranges, end exclusive).

    ``items_sha256`` is the digest of the comma-joined, sorted ids of the items that have an occurring window.  ``block_words`` bounds what is sent
    to the executors for one block; further blocks add their hits to the same rows, so rows with equal or null ids stay rows of their own.
    """
    sent = list(_indexes(benchmark, item_id, item_text, window, k, block_words))
    none = F.array().cast("array<struct<start:int,end:int>>")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), none.alias("hit_words"),
                       F.array().cast("array<string>").alias("items"))
    for index in sent:  # each block adds to the rows, whatever their ids
        rows = rows.transform(shared.in_batches, _against(index), rows.schema)
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["start"])
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return rows.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"),
                       (F.size("hit_words") > 0).alias("contaminated"), "hit_words")


def _indexes(benchmark, item_id, item_text, window, k, block_words):
    """The blocks of items as broadcast indexes."""
    if not 0 < k <= window:
        raise ValueError("k must be between 1 and window")
    items = item_words(benchmark, item_id, item_text, window)
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-2 * total // block_words))
    items = items.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks)))
    for block in range(blocks):
        own = [(r["item"], np.array(r["words"], dtype=np.int64).view(np.uint64)) for r in items.filter(F.col("block") == block).toLocalIterator()]
        yield benchmark.sparkSession.sparkContext.broadcast(Index(own, window, k))


def clean(docs: DataFrame, benchmark: DataFrame, text_col="text", item_id="item_id", item_text="text", window=10, k=5, block_words=1 << 22) -> DataFrame:
    """The rows of ``docs`` without any window of an item, with all their columns; one pass over them for all blocks."""
    at = docs.columns.index(text_col)
    for sent in _indexes(benchmark, item_id, item_text, window, k, block_words):
        docs = docs.transform(shared.in_batches, _without(sent, at), docs.schema)
    return docs


def _without(sent, at):
    def run(batches):
        for b in batches:
            kept = []
            for _, hashes, cuts, *_ in W.words_by_text(b.column(at), W.ALNUM):
                kept += [not len(hits(hashes[cuts[i]:cuts[i + 1]], sent.value)[1]) for i in range(len(cuts) - 1)]
            yield b.filter(pa.array(kept, pa.bool_()))
    return run


def _against(sent):
    """Adds one block's hits to rows of (id, text, n_words, hit_words, items)."""
    target = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        index = sent.value
        for b in batches:
            n_words, spans, names = [], [], []
            before, known, row = b.column(3).to_pylist(), b.column(4).to_pylist(), 0
            for _, hashes, cuts, *_ in W.words_by_text(b.column(1), W.ALNUM):
                for i in range(len(cuts) - 1):
                    mask, found = hits(hashes[cuts[i]:cuts[i + 1]], index)
                    for s in before[row]:
                        mask[s["start"]:s["end"]] = True
                    n_words.append(len(mask))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in _runs(mask)] if mask.any() else [])
                    names.append(sorted({*known[row], *(index.names[j] for j in found)}))
                    row += 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(spans, target), pa.array(names, pa.list_(pa.string()))],
                                             names=["id", "text", "n_words", "hit_words", "items"])

    return run
