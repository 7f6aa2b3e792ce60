"""Document fingerprints: a digest of bucket quartiles.

Method.  Byte triplets from a sliding window of five bytes (six triplets a position) are hashed by table look-ups into ``BUCKETS`` counters; each
bucket is coded by two bits, the quartile of the counts it falls in, so that the code does not depend on the text's length.  The digest also holds a
one-byte checksum, the logarithm of the length and the ratios of the quartiles.  The difference of two digests adds the quartile steps of all buckets
(a step of three counts double), the cyclic steps of length and ratios, and the checksum; it is bounded, and likeness is 1 less its share of the
expected difference of unrelated digests, cut at 0.

Equal texts have equal digests, and a digest depends on nothing else.  Texts are read in chunks; counters are bounded; nothing is shuffled for
fingerprints themselves.

Neighbours.  ``over_neighbours`` gives each row the text of the next id.  Ids are cut into one range for each shuffle partition (approximate quantiles of
ids, bounded in number), Spark sorts the ranges, and a range is read as a stream; the first row of each range is sent along to the range before it.

Defined cases: null is the empty text; a text of fewer than five bytes has all counts zero and one digest per length and checksum; repeated ids
follow each other by text; the only row is its own next; an empty table gives an empty table; null ids come first; extra columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shared, words as W

BUCKETS = 256
_RNG = np.random.default_rng(20240613)
#: A fixed permutation of bytes, from a seed.
_T = _RNG.permutation(256).astype(np.uint8)
#: Which two later bytes of the window join its first one, and a salt for each triplet.
_TRIPLETS = ((1, 2, 2), (1, 3, 3), (2, 3, 5), (2, 4, 7), (1, 4, 11), (3, 4, 13))
PIECE = 1 << 20


def bucket_counts(data: np.ndarray) -> np.ndarray:
    """Counts of hashed byte triplets; texts of any length, in pieces."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, max(0, len(data) - 4), PIECE):
        part = data[at:at + PIECE + 4]
        n = len(part) - 4
        if n <= 0:
            break
        first = part[:n]
        for i, j, salt in _TRIPLETS:
            h = _T[_T[_T[first ^ _T[salt]] ^ part[i:n + i]] ^ part[j:n + j]]
            total += np.bincount(h, minlength=BUCKETS)
    return total


def fingerprint(data: bytes) -> str:
    """Hexadecimal digest: checksum, length, two quartile ratios, two bits for each bucket."""
    array = np.frombuffer(data, dtype=np.uint8)
    counts = bucket_counts(array)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    body = np.packbits(np.stack([code >> 1, code & 1], axis=1).reshape(-1))
    length = min(255, int(np.log(len(data) + 1) / np.log(1.1)))
    ratio = ((int(q1) * 100 // int(q3)) % 16 << 4 | (int(q2) * 100 // int(q3)) % 16) if q3 else 0
    check = 0
    for p in range(0, len(array), PIECE):
        check ^= int(np.bitwise_xor.reduce(_T[(array[p:p + PIECE].astype(np.int64) + np.arange(p, p + len(array[p:p + PIECE]))) & 255]))
    return bytes([check, length, ratio]).hex() + body.tobytes().hex()


def difference(a: str, b: str) -> int:
    """0 for equal digests; at most 6 for each bucket besides length, ratios and checksum."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    codes = [np.unpackbits(v[3:]).reshape(-1, 2).astype(np.int64) @ np.array([2, 1]) for v in (x, y)]
    steps = np.abs(codes[0] - codes[1])
    length = abs(int(x[1]) - int(y[1]))
    cyclic = sum(min(d, 16 - d) for d in (abs((int(x[2]) >> s & 15) - (int(y[2]) >> s & 15)) for s in (0, 4)))
    return int(steps.sum() + 3 * (steps == 3).sum()) + min(length, 16) + min(cyclic, 16) // 4 + int(x[0] != y[0])


#: Mean difference of independent uniform codes: 1.25 a bucket, and 3 more for each of the eighth that is three steps apart.
UNRELATED = BUCKETS * (1.25 + 3 / 8)


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 at or beyond the difference of unrelated codes."""
    return max(0.0, 1.0 - difference(a, b) / UNRELATED)


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row: id and ``fingerprint`` of the whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in W.texts_of(b.column(1))], pa.string())], names=["id", "fingerprint"])

    return docs.select(F.col(id_col).alias("id"), text_col).transform(shared.in_batches, run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def over_neighbours(docs: DataFrame, id_col: str, text_col: str, per_pair, schema: str) -> DataFrame:
    """``per_pair(text, next text)`` of each row and the row that follows it in ascending id (after the last: the first), whole texts as bytes.

    Ids are cut at approximate quantiles, one range for each shuffle partition; a range is sorted by Spark and read as a stream, so only one batch is
    in memory.  The first text of each range is the only one that goes to another range as well.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = F.array(*[F.lit(i / ranges) for i in range(1, ranges)]) if ranges > 1 else F.array(F.lit(0.5))
    cuts = sorted(set(rows.select(F.percentile_approx("id", at, 100 * ranges)).first()[0] or []))
    part = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("id"))), F.lit(0)) if cuts else F.lit(0)
    rows = rows.withColumn("part", part)
    lead = sorted((r["part"], r["id"]) for r in rows.groupBy("part").agg(F.min("id").alias("id")).collect() if r["id"] is not None)
    if rows.filter(F.col("id").isNull()).limit(1).count():
        lead = [(p, None if i == 0 else own) for i, (p, own) in enumerate(lead)] if lead and lead[0][0] == 0 else [(0, None), *lead]
    if not lead:
        lead = [(0, None)]
    # each range gets a copy of the first row of the range after it (the last one: of the first range), behind its own rows
    follows = F.create_map(*[F.lit(x) for i, (p, _) in enumerate(lead) for x in (p, lead[i - 1][0])])
    known = [own for _, own in lead if own is not None]
    is_lead = F.col("id").isin(known) if known else F.lit(False)
    if len(known) < len(lead):
        is_lead = is_lead | F.col("id").isNull()
    border = (rows.filter(is_lead).groupBy("part").agg(F.min(F.struct("id", "text")).alias("f"))
              .select(F.col("f.id").alias("id"), F.col("f.text").alias("text"), follows[F.col("part")].alias("part"), F.lit(1).alias("border")))
    both = rows.select("id", "text", "part", F.lit(0).alias("border")).unionByName(border)
    names = ["id"] + [c.split()[0] for c in schema.split(",")]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        held = None
        for b in batches:
            ids, rows, border = b.column(0), [], b.column(3).to_pylist()
            for i, text in enumerate(W.texts_of(b.column(1))):
                if held is not None:
                    rows.append((held[0], *per_pair(held[1], text)))
                held = None if border[i] else (ids[i].as_py(), text)
            if rows:
                out = pa.table([list(c) for c in zip(*rows, strict=True)], names=names)
                yield from out.cast(pa.schema([(names[0], ids.type), *[(n, out.schema.field(n).type) for n in names[1:]]])).to_batches()

    placed = both.repartition(ranges, "part").sortWithinPartitions("part", "border", "id", "text")
    return placed.transform(shared.in_batches, run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def edited(text: bytes, following: bytes) -> tuple[int, bytes]:
    """(code points, the text whose last quarter is replaced by as many first code points of the following text, or all it has)."""
    own = text.decode()
    n = len(own)
    k = n // 4
    return n, (own[:n - k] + following[:4 * k].decode(errors="ignore")[:k]).encode()


def edited_and_next(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; see ``edited`` and ``over_neighbours``."""

    def per_pair():
        last = [None, None]  # the following text is the next row's own

        def one(text, following):
            own = last[1] if last[0] is text else fingerprint(text)
            last[0], last[1] = following, fingerprint(following)
            n, changed = edited(text, following)
            other = fingerprint(changed)
            return n, W.sha256(changed), own, other, likeness(own, other), likeness(own, last[1])
        return one

    return over_neighbours(docs, id_col, text_col, per_pair(), "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                                              "near_edited double, near_next double")
