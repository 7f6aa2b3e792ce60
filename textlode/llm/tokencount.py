"""Token counts of fields by offsets: a document is encoded once, as a whole, and its tokens are attributed to the fields they stand in.

Method.  The fields of a row are written one after another with a separator between them; this text is encoded whole, so tokens are those that a model
sees.  Tokens cover the text without gaps, so their lengths give their spans; field spans are the other side of the interval join, which a binary search in
the sorted field starts answers for all tokens of a document at once.  A token that crosses a border is allocated by an explicit rule: ``start``, to the
field of its first byte; ``end``, to that of its last; ``share``, to each field by its share of the token's bytes.  What falls on separators is
``layout``.  The counts of a document add up to its tokens, whatever the rule.

Documents are encoded where they stand: nothing is shuffled, and only the rank map (the size of its file) is sent to the executors.

Defined cases: a null field is an empty one and has no tokens; a row of empty fields has the separators' tokens only; repeated rows are counted alike; an
empty table gives an empty table; other columns are ignored.  An empty field between two others takes no token that starts where it stands.
"""

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from . import bpe, shared, words as W

RULES = ("start", "end", "share")


def attribute(lengths: np.ndarray, sizes: np.ndarray, rule="start") -> tuple[np.ndarray, int]:
    """(tokens of each part, tokens that cross a border): token lengths and part sizes in bytes, both in order and covering the same text."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    stops = np.cumsum(lengths)
    starts = stops - lengths
    borders = np.cumsum(sizes)
    # the part of a byte: the first one that ends behind it, so that empty parts take none
    first, last = np.searchsorted(borders, starts, side="right"), np.searchsorted(borders, stops - 1, side="right")
    crossing = first != last
    if rule != "share":
        return np.bincount(first if rule == "start" else last, minlength=len(sizes)).astype(float), int(crossing.sum())
    counts = np.bincount(first[~crossing], minlength=len(sizes)).astype(float)
    for i in np.flatnonzero(crossing):
        for part in range(first[i], last[i] + 1):
            inside = min(stops[i], borders[part]) - max(starts[i], borders[part] - sizes[part])
            counts[part] += max(0, inside) / lengths[i]
    return counts, int(crossing.sum())


def count(docs: DataFrame, ranks: dict[bytes, int], pattern: str, fields, id_col="doc_id", separator="\n", rule="start", kept=1 << 18) -> DataFrame:
    """Per row: id, n_tokens, n_crossing and ``fields``: (field, start, end, tokens) in code points of the joined text, the last one ``layout``."""
    names = list(fields)
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    item = pa.struct([("field", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("tokens", pa.float64())])

    def run(batches):
        ranks, cut = sent.value, regex.compile(pattern).findall
        size = np.zeros(max(ranks.values(), default=0) + 1, dtype=np.int64)
        for piece, i in ranks.items():
            size[i] = len(piece)
        known = bpe.known_words(ranks, kept)
        for b in batches:
            columns = [c.to_pylist() for c in b.columns[1:]]
            for lo, hi in W.chunked([sum(len(c[i] or "") for c in columns) for i in range(b.num_rows)], 4 << 20):
                rows = []
                for i in range(lo, hi):
                    parts = [separator if k % 2 else columns[k // 2][i] or "" for k in range(2 * len(columns) - 1)]
                    ids = np.frombuffer(b"".join(map(known.__getitem__, cut("".join(parts)))), dtype="<u4")
                    tokens, crossing = attribute(size[ids], np.array([len(p.encode()) for p in parts]), rule)
                    at = np.cumsum([0] + [len(p) for p in parts])
                    own = [{"field": n, "start": int(at[2 * k]), "end": int(at[2 * k + 1]), "tokens": float(tokens[2 * k])} for k, n in enumerate(names)]
                    own.append({"field": "layout", "start": None, "end": None, "tokens": float(tokens[1::2].sum())})
                    rows.append((len(ids), crossing, own))
                total, crossed, spans = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(total, pa.int64()), pa.array(crossed, pa.int64()),
                                                  pa.array(spans, pa.list_(item))], names=["id", "n_tokens", "n_crossing", "fields"])

    source = docs.select(F.col(id_col).alias("id"), *[F.col(n).cast("string").alias(f"f{k}") for k, n in enumerate(names)])
    return source.transform(shared.in_batches, run, f"id {kind}, n_tokens long, n_crossing long, "
                            "fields array<struct<field:string,start:bigint,end:bigint,tokens:double>>").withColumnRenamed("id", id_col)
