"""Exact Jaccard self-join of word n-gram sets, by groups of equal prefixes.

Method.  A text's set is its distinct word 5-grams, as hashes; equal sets form one class.  Document frequencies of all n-grams are counted; n-grams are
ordered by rising frequency, and a set of n needs only its first n - ceil(t n) + 1 in that order (its prefix) to share one with any set it links to.
N-grams of frequency one are first in that order and link to nothing, so only the others of a prefix are posted.  Classes with the same posted prefix
and size are one group.  Group pairs that share a posted n-gram are filtered by size and by the largest overlap that their shared n-grams allow, then
expanded to members and verified by the exact overlap.

Hot groups.  Near copies may be a third of all rows, so pairs are not listed: (1) every group is verified against one pivot, the set with the
fewest unique n-grams among its lists, and members against their group's first; (2) components of these links are formed; (3) each list that two groups
or a group of several members post is asked only for the pairs across components: the members outside the pivot's component against all, where the places of the shared n-gram and the overlaps with a
common pivot leave a link possible; members of a group that these tests cannot tell apart meet as one.  Every link between different components is so found, whatever the group's size; links inside a component change nothing.

Frequencies are counted on packed arrays: a task sorts the hashes of a block of classes and sends one row for each range of hashes, in which a class is its
place in the block; its digest is sent once, to where the block's shared n-grams are gathered, and to the ranges only if other rows have the same set (a
bitmap of such digests tells, a false hit costs eight bytes), so that copies count once.  A hash that more than ``heavy`` classes of a block have counts as
most frequent everywhere: its range is told so, and its owners stay with the block, so no range gathers a hot n-gram's classes.  Ranges and blocks both
grow with the root of very large inputs, so rows between them stay long.

Defined cases: null and empty texts have the empty set and are their own component; fewer than five words are one n-gram of all; ids that repeat are
rows of their own, linked if their sets are equal or similar, and a component is named by its smallest id; an empty table gives an empty table; extra
columns are ignored.  Sets are compared by 64-bit digests, their elements by 48 bits within a pair.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import shared, words as W
from .components import components

#: N-grams of a block, about: the least and the most (fewer than 2 ** 24, which bounds the number of its classes).
BLOCK = 1 << 21, 1 << 23
HEAVY = 256
#: N-grams of a range of hashes, about, at least.
RANGE = 1 << 19
_LOW = np.uint64((1 << 48) - 1)


def shingle_set(hashes: np.ndarray, k=5) -> np.ndarray:
    """Sorted distinct k-gram hashes; fewer words are one gram, none give the empty set."""
    return np.unique(W.grams(hashes, min(k, len(hashes)))) if len(hashes) else np.empty(0, dtype=np.uint64)


def _digest(own: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        return W.mix(np.array([W.mix(own + np.uint64(len(own))).sum(dtype=np.uint64)]))[0]


def _sets(column, k):
    for _, hashes, cuts, *_ in W.words_by_text(column, W.NONSPACE):
        for i in range(len(cuts) - 1):
            yield shingle_set(hashes[cuts[i]:cuts[i + 1]], k)


def summaries(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, n, c): size and digest of each row's set."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            n, c = [], []
            for own in _sets(b.column(1), k):
                n.append(len(own))
                c.append(int(_digest(own).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(c, pa.int64())], names=["id", "n", "c"])

    return docs.select(F.col(id_col).alias("id"), text_col).transform(shared.in_batches, run, f"id {kind}, n long, c long")


def with_digests(docs: DataFrame, text_col: str, k=5) -> DataFrame:
    """The rows of ``docs`` with ``set_digest``, the digest of their set."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            digests = pa.array([int(_digest(own).view(np.int64)) for own in _sets(b.column(at), k)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, digests], names=[*b.schema.names, "set_digest"])

    return docs.transform(shared.in_batches, run, StructType([*docs.schema.fields, StructField("set_digest", LongType())]))


_PACKED = "bucket int, block long, heavy long, classes binary, sizes binary, owners binary, hashes binary, counts binary"
#: The frequency, as it orders n-grams, of the most frequent ones.
MOST = 32767


def _planes(values: np.ndarray) -> bytes:
    """Sorted 48-bit values: the steps between them by byte planes, as few as they need (they compress well)."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(steps[1:].max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(steps[1:].view(np.uint8).reshape(-1, 8)[:, :width].T) if len(steps) > 1 else np.empty(0, np.uint8)
    return bytes([width]) + steps[:1].tobytes() + planes.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    width, first = data[0], np.frombuffer(data[1:9], "<u8")
    planes = np.frombuffer(data, np.uint8, offset=9).reshape(width, -1)
    steps = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    steps[:, :width] = planes.T
    return np.cumsum(np.concatenate([first, steps.reshape(-1).view("<u8")]), dtype=np.uint64)


def _three(values: np.ndarray) -> bytes:
    """Numbers below 2 ** 24 in three bytes each."""
    return (values & 255).astype(np.uint8).tobytes() + (values >> 8).astype(np.uint16).tobytes()


def _unthree(data: bytes) -> np.ndarray:
    k = len(data) // 3
    return np.frombuffer(data, np.uint8, k) | (np.frombuffer(data[k:], np.uint16).astype(np.uint32) << 8)


def packed(docs: DataFrame, text_col: str, k: int, bits: int, copied, heavy=HEAVY, block=BLOCK[0]) -> DataFrame:
    """Sorted hashes with their owners, one row for each block and range of hashes; under bucket -1 a block's classes and the owners of its heavy hashes.

    ``copied``: broadcast bitmap of the digests that more than one row has; such classes are named in the ranges (digests and their owners).
    """

    def flush(held):
        classes = np.fromiter(held, dtype=np.uint64, count=len(held))
        sizes = np.array([len(s) for s in held.values()], dtype=np.uint32)
        # named by what it holds, so that a task that runs again sends the same rows
        name = int(W.mix(W.grams(classes, len(classes)) + np.uint64(len(classes))).view(np.int64)[0])
        hashes = np.concatenate(list(held.values())) & _LOW
        owners = np.repeat(np.arange(len(classes), dtype=np.uint32), sizes)
        order = np.argsort(hashes, kind="stable")
        hashes, owners = hashes[order], owners[order]
        fresh = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])])  # a set's hashes may agree in their low bits
        hashes, owners = hashes[fresh], owners[fresh]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        counts = np.diff(np.append(first, len(hashes)))
        hot = counts > heavy
        again = shared.held(copied.value, classes)
        rows = [(int(h) >> (48 - bits), name, int(h), b"", b"", b"", b"", b"") for h in hashes[first[hot]]]
        own = np.repeat(hot, counts)
        rows.append((-1, name, None, classes.tobytes(), sizes.tobytes(), _three(owners[own]), _planes(hashes[own]) if own.any() else b"",
                     np.full(own.sum(), MOST, np.uint16).tobytes()))
        hashes, owners = hashes[~own], owners[~own]
        cuts = np.searchsorted(hashes, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(48 - bits))
        for b in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[b], cuts[b + 1])
            named = np.unique(owners[part][again[owners[part]]])
            rows.append((int(b), name, None, classes[named].tobytes(), _three(named), _three(owners[part]), _planes(hashes[part]), b""))
        return W.batches_of(rows, _PACKED, 64)

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            for own in _sets(batch.column(0), k):
                c = int(_digest(own))
                if len(own) and c not in held:
                    held[c] = own
                    size += len(own)
                    if size >= block:
                        yield from flush(held)
                        held, size = {}, 0
        if held:
            yield from flush(held)

    return docs.select(text_col).transform(shared.in_batches, run, _PACKED)


_SHARED = "block long, classes binary, sizes binary, owners binary, hashes binary, counts binary"


def shared_keys(rows: DataFrame) -> DataFrame:
    """The n-grams that two sets or more have, with their frequencies and owners, one row for each range and block; a block's own rows pass."""

    def count(table: pa.Table) -> pa.Table:
        shared.release()
        if table.column("bucket")[0].as_py() < 0:
            return table.select(_SHARED_NAMES).cast(W.schema_of(_SHARED))
        most, hashes, owners, blocks, idents = [], [], [], [], []
        for name, heavy, c, n, o, h in zip(*(table.column(x).to_pylist() for x in ("block", "heavy", "classes", "sizes", "owners", "hashes")), strict=True):
            if heavy is not None:
                most.append(heavy)
                continue
            own, named = _unthree(o), _unthree(n)
            ident = W.mix((own.astype(np.uint64) << np.uint64(40)) ^ W.mix(np.array([name]).view(np.uint64)))
            if len(named):
                at = np.minimum(np.searchsorted(named, own), len(named) - 1)
                ident = np.where(named[at] == own, np.frombuffer(c, np.uint64)[at], ident)
            hashes.append(_unplanes(h))
            owners.append(own)
            blocks.append(np.full(len(own), name, np.int64))
            idents.append(ident)
        h, o, b, ident = (np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((hashes, np.uint64), (owners, np.uint32), (blocks, np.int64), (idents, np.uint64)))
        order = np.lexsort((ident, h))
        h, o, b, ident = h[order], o[order], b[order], ident[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])[:len(h)]
        fresh = new | np.concatenate([[True], ident[1:] != ident[:-1]])[:len(h)]  # copies in several blocks count once
        df = np.bincount(np.cumsum(new)[fresh] - 1)[np.cumsum(new) - 1] if len(h) else np.empty(0, np.int64)
        df = np.where(np.isin(h, np.array(most, np.uint64)), MOST, np.minimum(df, MOST - 1)).astype(np.uint16)
        kept = df > 1
        h, o, b, df = h[kept], o[kept], b[kept], df[kept]
        order = np.argsort(b, kind="stable")  # by block, hashes rising
        h, o, b, df = h[order], o[order], b[order], df[order]
        cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else []
        rows = [(int(b[x]), b"", b"", _three(o[x:y]), _planes(h[x:y]), df[x:y].tobytes()) for x, y in zip(cuts, [*cuts[1:], len(b)], strict=False)]  # none if nothing is shared
        return pa.Table.from_batches(W.batches_of(rows, _SHARED), schema=W.schema_of(_SHARED))

    return rows.groupBy("bucket", F.when(F.col("bucket") < 0, F.col("block"))).applyInArrow(count, _SHARED)


_SHARED_NAMES = [c.split()[0] for c in _SHARED.split(", ")]
_CANDIDATE = "c long, n int, k int, p int, keys array<long>"


def candidates(rows: DataFrame, percent: int) -> DataFrame:
    """(c, n, k, p, keys): classes with a posted prefix; its ``p`` first of the ``k`` shared n-grams, in order of frequency."""

    def choose(table: pa.Table) -> pa.Table:
        shared.release()
        named = {name: [x for x in table.column(name).to_pylist() if x] for name in _SHARED_NAMES[1:]}
        # blocks of one name hold the same classes
        c, s = (np.frombuffer(named[name][0], kind) for name, kind in (("classes", np.uint64), ("sizes", np.uint32)))
        empty = np.empty(0, np.uint64)
        own = np.concatenate([empty, *map(_unthree, named["owners"])]).astype(np.int64)
        df = np.frombuffer(b"".join(named["counts"]), np.uint16).astype(np.uint64)
        keys = df << np.uint64(48) | np.concatenate([empty, *map(_unplanes, named["hashes"])])
        order = np.lexsort((keys, own))
        own, keys = own[order], keys[order]
        fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (keys[1:] != keys[:-1])])[:len(own)]
        own, keys = own[fresh], keys[fresh]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[:len(own)])
        k = np.diff(np.append(first, len(own)))
        n = s[own[first]].astype(np.int64)
        p = (n - -(-percent * n // 100) + 1) - (n - k)
        use = (p > 0) & (100 * k >= percent * n)  # and enough shared n-grams for the smallest possible partner
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(k[use])]).astype(np.int32)), pa.array(keys[np.repeat(use, k)].view(np.int64)))
        return pa.table([pa.array(c[own[first]][use].view(np.int64)), *(pa.array(x[use].astype(np.int32)) for x in (n, k, p)), lists], schema=W.schema_of(_CANDIDATE))

    return rows.groupBy("block").applyInArrow(choose, _CANDIDATE).dropDuplicates(["c"])


def _possible(a, b, percent):
    """Whether sizes and shared n-grams of two sets allow a link."""
    need = percent * (F.col(f"{a}n") + F.col(f"{b}n"))
    return (F.least(f"{a}k", f"{b}k") * (100 + percent) >= need) & (F.greatest(f"{a}n", f"{b}n") * percent <= 100 * F.least(f"{a}n", f"{b}n"))


def _needed(percent):
    """The overlap that links two sets of a_n and b_n n-grams."""
    return F.ceil(percent * (F.col("a_n") + F.col("b_n")) / (100 + percent))


def _overlaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, o, linked): the overlap of each pair, and whether it makes a link."""
    side = lambda x: sets.select(F.col("c").alias(x), F.col("n").alias(f"{x}_n"), F.col("keys").alias(f"{x}_keys"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("o", F.size(F.array_intersect("a_keys", "b_keys")))
    return both.select("a", "b", "o", (100 * F.col("o") >= percent * (F.col("a_n") + F.col("b_n") - F.col("o"))).alias("linked"))


def similar_components(docs: DataFrame, id_col="doc_id", text_col="text", k=5, percent=75, heavy=HEAVY) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id that links of Jaccard >= percent / 100 reach)."""
    return row_components(docs, id_col, text_col, k, percent, heavy).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def row_components(docs: DataFrame, id_col="doc_id", text_col="text", k=5, percent=75, heavy=HEAVY) -> DataFrame:
    """Per row: id, n, c (size and digest of its set), label (of its component; its own digest if it has no links) and component_id."""
    rows = shared.cut(summaries(docs, id_col, text_col, k))
    total = rows.agg(F.sum("n")).first()[0] or 0
    root = math.sqrt(total / 2 ** 34)  # over 1 from 17 billion n-grams on
    bits = min(22, math.ceil(math.log2(max(total / (RANGE * max(1, root)), 2))))
    copied = docs.sparkSession.sparkContext.broadcast(shared.bitmap(rows.filter("n > 0").groupBy(F.col("c").alias("h")).agg(F.count("*").alias("m")).filter("m > 1")))
    blocks = packed(docs, text_col, k, bits, copied, heavy, int(min(BLOCK[1], BLOCK[0] * max(1, root))))
    sets = shared.cut(candidates(shared_keys(blocks), percent))

    groups = (sets.withColumn("prefix", F.slice("keys", 1, F.col("p"))).withColumn("g", F.xxhash64("prefix", "n"))
              .groupBy("g", "n", "k").agg(F.min("c").alias("a"), F.min_by("prefix", "c").alias("prefix"), F.count("*").alias("m")))
    members = sets.select("c", "n", "k", F.xxhash64(F.slice("keys", 1, F.col("p")), "n").alias("g"))
    groups = shared.cut(groups)
    first = groups.select("g", "n", "k", "a")
    inside = members.join(first, ["g", "n", "k"]).filter("a <> c").select("a", F.col("c").alias("b"))
    posted = groups.select("a", "n", "k", "m", F.posexplode("prefix").alias("at", "key"))
    best = F.struct((F.col("k") / F.col("n")).alias("share"), F.col("a"), F.col("n"), F.col("k"))
    # a group's members share its whole prefix, so its first n-gram alone asks for the pairs inside it, also where no other group posts it
    lists = (posted.groupBy("key").agg(F.count("*").alias("size"), F.max(best).alias("top"), F.min("n").alias("least"),
                                       F.max((F.col("at") == 0) & (F.col("m") > 1)).alias("own")).filter("size > 1 or own"))
    lists = shared.cut(lists.select("key", F.col("top.a").alias("pivot"), F.col("top.n").alias("t_n"), F.col("top.k").alias("t_k"), F.col("top.share").alias("share"), "least"))
    star = (posted.withColumnsRenamed({"n": "a_n", "k": "a_k"}).join(lists, "key").filter("a <> pivot").filter(_possible("a_", "t_", percent))
            .groupBy("a").agg(F.max(F.struct("share", "pivot")).alias("m")).select("a", F.col("m.pivot").alias("b")))
    tried = shared.cut(_overlaps(inside.unionByName(star), sets, percent)
                       .join(star.withColumn("star", F.lit(True)), ["a", "b"], "left"))
    links = tried.filter("linked").select("a", "b")
    label = components(links)  # (v, label) of linked classes
    # a first with its list's pivot, a member with its group's first
    known = tried.select(F.when(F.col("star"), F.col("a")).otherwise(F.col("b")).alias("c"), F.when(F.col("star"), F.col("b")).otherwise(F.col("a")).alias("pivot_of"),
                         F.col("o").alias("with_pivot"))

    of = members.join(label.withColumnRenamed("v", "c"), "c", "left").select("c", "g", "n", "k", F.coalesce("label", "c").alias("label"))
    wide = (posted.select("key", "at", "a", "n", "k").join(first.select("a", "g"), "a").join(of.select("c", "g", "n", "k", "label"), ["g", "n", "k"])
            .join(lists.select("key", "pivot", "least"), "key")
            .filter(F.col("k") * (100 + percent) >= percent * (F.col("n") + F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100)))))
    home = wide.filter("c = pivot").select("key", F.col("label").alias("home"))
    wide = wide.join(home, "key", "left").join(known, "c", "left")
    fields = ("c", "g", "n", "k", "label", "at", "pivot_of", "with_pivot")
    wide = shared.cut(wide.select("key", "home", "c", "g", "n", "k", "label", "at", F.coalesce("pivot_of", "c").alias("pivot_of"),
                                  F.when(F.col("pivot_of").isNull(), F.col("k")).otherwise(F.col("with_pivot")).alias("with_pivot")))
    # members of a group that agree in component and overlap with the pivot pass the same tests: they meet as one, once for each pair, and are told apart after
    alike = ("g", "label", "pivot_of", "with_pivot")
    wide = wide.withColumn("u", F.xxhash64(*alike))
    member = wide.select("u", "c").distinct()
    fields = ("u", "g", "n", "k", "label", "at", "pivot_of", "with_pivot")
    wide = wide.select("key", "home", *fields).distinct()
    out = wide.filter(~F.col("label").eqNullSafe(F.col("home"))).select("key", *[F.col(x).alias(f"a_{x}") for x in fields])
    all_ = wide.select("key", *[F.col(x).alias(f"b_{x}") for x in fields])
    # two sets that overlap by ``need`` share an n-gram within the first k - need + 1 of each
    need = _needed(percent)
    early = (F.col("a_at") <= F.col("a_k") - need) & (F.col("b_at") <= F.col("b_k") - need)
    # they share what both share with a common pivot at most, and outside of it what either has there at most
    inner = F.least("a_with_pivot", "b_with_pivot") + F.least(F.col("a_k") - F.col("a_with_pivot"), F.col("b_k") - F.col("b_with_pivot"))
    near = (F.col("a_pivot_of") != F.col("b_pivot_of")) | (inner >= need)
    near &= (F.col("a_g") != F.col("b_g")) | (F.col("a_at") == 0)  # pairs of one group meet once
    across = (out.join(all_, "key").filter((F.col("a_label") != F.col("b_label")) & _possible("a_", "b_", percent) & early & near)
              .select("a_u", "b_u").distinct())
    side = lambda x: member.select(F.col("u").alias(f"{x}_u"), F.col("c").alias(f"{x}_c"))
    across = across.join(side("a"), "a_u").join(side("b"), "b_u").select(F.least("a_c", "b_c").alias("a"), F.greatest("a_c", "b_c").alias("b")).distinct()
    more = shared.cut(_overlaps(across, sets, percent)).filter("linked").select("a", "b")
    final = components(links.unionByName(more))

    classes = rows.filter("n > 0").groupBy("c").agg(F.min("id").alias("least"))
    # a component's name is read from one of 16 copies, so a large component does not meet in one task
    named = classes.join(final.withColumnRenamed("v", "c"), "c", "left").withColumn("copy", F.pmod(F.xxhash64("c"), F.lit(16)).cast("int"))
    name = named.filter("label is not null").groupBy("label").agg(F.min("least").alias("name")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(15))))
    by_class = named.join(name, ["label", "copy"], "left").select("c", F.coalesce("label", "c").alias("label"), F.coalesce("name", "least").alias("component_id"))
    return rows.join(by_class, "c", "left").select("id", "n", "c", "label", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
