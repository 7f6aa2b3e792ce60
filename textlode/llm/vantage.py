"""Approximate nearest neighbours: a vantage-point tree per shard, pruned by the triangle inequality relaxed by a tunable factor.

Method.  A bounded sample of the vectors gives the upper levels of a vantage-point tree; every vector is routed down them by comparing its distance to a
vantage point with that node's threshold, and where it arrives is its shard (a crowded place is split into several shards by a hash of the id, so copies,
however many, never meet in one task).  Each shard builds its own tree: a node keeps a vantage point and, for each half, the least and greatest distance of
its members to it.  For a query at distance d from the vantage point, no member of a half is nearer than ``max(0, d - greatest, least - d)``; a shard or
a bucket is passed over if ``factor`` times the greatest such bound on its path is over the query's k-th distance so far.  A factor of one keeps every
bound as it is and so gives exact answers; a greater one passes over more and may miss some.  Distances are computed on the original vectors in double
precision.

A query's first k-th distance comes from the sample, so it goes only to the shards that may hold something nearer; packed blocks of queries meet
packed shards in one shuffle, and a shard answers with at most k rows a query.  Only the routing tree and its sample (``fit_rows`` vectors) are sent to all tasks.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, take no part; vectors meet only those of
their own length; all rows of a query's id are its own; a candidate id on several rows, or a query id on several rows, counts once with the least distance;
ties go to the smaller id; a query with fewer candidates gets all of them; an empty table gives an empty table; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import shared

BUCKET = 64
#: Queries that are looked up together in a shard.
QUERY_BLOCK = 512
#: Bytes of vectors that a task holds before it hands them on by shard, and of those in one row that it hands on.
PACK_BYTES, ROW_BYTES = 32 << 20, 32 << 10
#: Largest share of the sum of two norms by which a distance from inner products can be off (true bound: about 1.3e-7 for 64 components).
SLACK = 1e-6


def squares(a, b):
    """Squared distances of all rows of ``a`` to all of ``b`` from inner products; never below zero, off by up to ``(SLACK * norms)**2``."""
    out = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.maximum(out, 0, out=out)


def _norms(a):
    return np.sqrt((a * a).sum(1))


def _vantage(x, rng):
    """The row, of a few drawn, from which a sample of the rows spreads most."""
    drawn = rng.choice(len(x), min(5, len(x)), replace=False)
    seen = x[rng.choice(len(x), min(256, len(x)), replace=False)]
    return drawn[np.sqrt(squares(x[drawn], seen)).std(axis=1).argmax()]


class Tree:
    """A vantage-point tree over the rows of ``x``: halves by rank, so copies cannot unbalance it; buckets of up to ``bucket`` rows."""

    def __init__(self, x, bucket=BUCKET, seed=7):
        rng = np.random.default_rng(seed)
        self.x, self.points, self.edges, self.leaves = x, [], [], []  # edges: (node, point, least, greatest, child or ~leaf)
        open_nodes = [(0, np.arange(len(x)))]
        nodes = 1
        if len(x) <= bucket:
            self.leaves, open_nodes = [np.arange(len(x))], []
        while open_nodes:
            node, own = open_nodes.pop()
            v = own[_vantage(x[own], rng)]
            d = np.sqrt(((x[own] - x[v]) ** 2).sum(1))
            order = np.argpartition(d, len(own) // 2)
            for half in (order[:len(own) // 2], order[len(own) // 2:]):
                if len(half) <= bucket:
                    child = ~len(self.leaves)
                    self.leaves.append(own[half])
                else:
                    child, nodes = nodes, nodes + 1
                    open_nodes.append((child, own[half]))
                self.edges.append((node, len(self.points), d[half].min(), d[half].max(), child))
            self.points.append(v)
        self.nodes = nodes

    def bounds(self, q):
        """For each query and leaf a distance that no member of the leaf is nearer than."""
        if not self.edges:
            return np.zeros((len(q), len(self.leaves)))
        points = self.x[self.points]
        off = SLACK * (_norms(q)[:, None] + _norms(points)[None])
        d = np.sqrt(squares(q, points))
        least, greatest = d - off, d + off
        inner, out = np.zeros((self.nodes, len(q))), np.zeros((len(self.leaves), len(q)))
        for node, point, low, high, child in self.edges:  # a node stands before its children
            bound = np.maximum(inner[node], np.maximum(least[:, point] - high, low - greatest[:, point]))
            if child < 0:
                out[~child] = bound
            else:
                inner[child] = bound
        return out.T

    def nearest(self, q, own, limit, ids, k, factor):
        """(query, row, squared distance) of the k nearest rows found for each query, ties to smaller ids; ``limit``: distances beyond are not asked for."""
        bound = self.bounds(q)
        order = np.argsort(bound, axis=1, kind="stable")
        ranked = np.take_along_axis(bound, order, axis=1) * factor
        limit = limit.copy()
        at, step = 0, 1
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        far = _norms(q)
        while at < len(self.leaves):
            who, what = np.nonzero(ranked[:, at:at + step] <= limit[:, None])
            if not len(who):
                break
            leaf = order[who, at + what]
            at, step = at + step, step * 2
            by = np.argsort(leaf, kind="stable")
            found = [best]
            for group in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
                rows, asked = self.leaves[leaf[group[0]]], who[group]
                x = self.x[rows]
                near = (limit[asked] + SLACK * (far[asked] + _norms(x).max()))[:, None]
                i, j = np.nonzero((squares(q[asked], x) <= near * near) & (ids[rows][None] != own[asked][:, None]))
                i, j = asked[i], rows[j]
                found.append((i, j, ((q[i] - self.x[j]) ** 2).sum(1)))
            i, j, d = (np.concatenate(c) for c in zip(*found, strict=True))
            keep = np.lexsort((ids[j], d, i))
            i, j, d = i[keep], j[keep], d[keep]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            best = i[place < k], j[place < k], d[place < k]
            full = place == k - 1
            limit[i[full]] = np.minimum(limit[i[full]], np.sqrt(d[full]))
        return best


class Router:
    """Upper levels of a vantage-point tree, fitted on a sample: where a vector's shard is, and which shards a query has to ask."""

    def __init__(self, sample, ids, leaves, seed=11):
        rng = np.random.default_rng(seed)
        self.sample, self.ids, self.nodes, self.count = sample, ids, [], 0  # nodes: (vantage point, threshold, inner child, outer child); ~leaf
        self.share = []
        self.root = self._grow(np.arange(len(sample)), int(np.ceil(np.log2(max(leaves, 1)))), rng)

    def _grow(self, own, levels, rng):
        if levels > 0 and len(own) > 1:
            v = self.sample[own[_vantage(self.sample[own], rng)]]
            d = np.sqrt(((self.sample[own] - v) ** 2).sum(1))
            cut = float(np.median(d))
            inner, outer = own[d <= cut], own[d > cut]
            if len(outer):
                at = len(self.nodes)
                self.nodes.append(None)
                self.nodes[at] = (v, cut, self._grow(inner, levels - 1, rng), self._grow(outer, levels - 1, rng))
                return at
        self.share.append(len(own) / max(len(self.sample), 1))
        self.count += 1
        return ~(self.count - 1)

    def route(self, x):
        """Leaf of each vector."""
        out = np.zeros(len(x), dtype=np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if node < 0:
                out[own] = ~node
            elif len(own):
                v, cut, inner, outer = self.nodes[node]
                near = np.sqrt(((x[own] - v) ** 2).sum(1)) <= cut
                todo += [(inner, own[near]), (outer, own[~near])]
        return out

    def bounds(self, q):
        """For each query and leaf a distance that no vector routed there is nearer than."""
        out, todo = np.zeros((len(q), self.count)), [(self.root, np.zeros(len(q)))]
        while todo:
            node, bound = todo.pop()
            if node < 0:
                out[:, ~node] = bound
            else:
                v, cut, inner, outer = self.nodes[node]
                d, off = np.sqrt(((q - v) ** 2).sum(1)), SLACK * cut
                todo += [(inner, np.maximum(bound, d - cut - off)), (outer, np.maximum(bound, cut - d - off))]
        return out

    def limits(self, q, own, k):
        """(distance within which each query has k candidates, (query, row, distance) of those) from the sample; infinite and none where it has fewer."""
        limit, found = np.full(len(q), np.inf), []
        if len(self.sample) > k:
            for at in range(0, len(q), QUERY_BLOCK):
                d = squares(q[at:at + QUERY_BLOCK], self.sample)
                d[self.ids[None] == own[at:at + QUERY_BLOCK, None]] = np.inf
                rows = np.argpartition(d, k - 1, axis=1)[:, :k]
                each = np.sqrt(((q[at:at + QUERY_BLOCK, None] - self.sample[rows]) ** 2).sum(2))
                limit[at:at + QUERY_BLOCK] = each.max(1)
                found.append((np.repeat(np.arange(at, at + len(d)), k), rows.ravel(), each.ravel()))
        return limit, tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _matrix(column, kind):
    """(rows of one length, their places, their matrix) of an Arrow list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths())
    flat, starts = np.asarray(column.flatten(), dtype=kind), np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield int(n), rows, flat[starts[rows][:, None] + np.arange(n)]


def valid(vectors: DataFrame, id_col="vec_id", vector_col="embedding", double=False) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col("v")
    single = vectors.schema[vector_col].dataType.elementType.simpleString() == "float" and not double
    out = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{'float' if single else 'double'}>").alias("v"))
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return out.filter(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda e: e != 0))


def fit(vectors: DataFrame, k: int, fit_rows: int, shard_bytes: int):
    """(routers by length, sub-shards by length and leaf, number of shards) from at most ``fit_rows`` rows of (id, v), those of the least hashes of their ids."""
    rows, cells = vectors.agg(F.count("*"), F.sum(F.size("v"))).first()
    sample = vectors.orderBy(F.xxhash64("id"), "id", F.xxhash64("v")).limit(fit_rows).toArrow()
    cells = (cells or 0) * 8
    # as many shards as each has vectors, by a constant, and more where they would pass shard_bytes
    shards = max(1, int(np.ceil(np.sqrt(rows / 64))), int(np.ceil(cells / shard_bytes)))
    routers, parts = {}, {}
    if sample.num_rows:
        ids = sample.column("id").to_numpy()
        for n, own, x in _matrix(sample.column("v"), np.float64):
            _, first = np.unique(ids[own], return_index=True)  # an id counts once
            routers[n] = Router(x[first], ids[own][first], max(1, round(shards * len(own) / len(ids))))
            parts[n] = [max(1, int(np.ceil(s * len(own) / len(ids) * rows / (2 * max(1, rows / shards))))) for s in routers[n].share]
    rare = max(1, int(np.ceil(shards / fit_rows)))  # of a length that the sample lacks
    return routers, parts, rare, sum(map(sum, parts.values())) + rare


_PACKED = "shard string, kind int, n int, ids binary, vectors binary, limits binary"
_FOUND = "query_id long, vec_id long, score double"


def _packs(spark, fitted, dtype, k, factor, queries):
    """A ``mapInArrow`` function that routes (id, v) and hands rows on packed by shard: vectors to their one shard, queries to all they have to ask."""
    sent = spark.sparkContext.broadcast(fitted[:3])
    names = [c.split()[0] for c in _PACKED.split(", ")]
    types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches):
        routers, parts, rare = sent.value
        held, size = [], 0

        def flush():
            for n in {h[0] for h in held}:
                ids, x = np.concatenate([h[1] for h in held if h[0] == n]), np.concatenate([h[2] for h in held if h[0] == n])
                router, split = routers.get(n), parts.get(n, [rare])
                salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                rows, most = [], max(1, ROW_BYTES // (x.itemsize * n))
                if queries:
                    wide = x.astype(np.float64)
                    limit = router.limits(wide, ids, k)[0] if router else np.full(len(x), np.inf)
                    bound = router.bounds(wide) if router else np.zeros((len(x), 1))
                    for leaf, subs in enumerate(split):
                        own = np.flatnonzero(bound[:, leaf] * factor <= limit)
                        for part in np.split(own, range(most, len(own), most)) if len(own) else []:
                            packed = (ids[part].tobytes(), x[part].tobytes(), limit[part].tobytes())
                            rows += [(f"{n}.{leaf}.{s}", 1, n, *packed) for s in range(subs)]
                else:
                    leaf = router.route(x.astype(np.float64)) if router else np.zeros(len(x), np.int64)
                    sub = salt.astype(np.int64) % np.array(split)[leaf]
                    by = np.lexsort((sub, leaf))
                    for own in np.split(by, np.flatnonzero((np.diff(leaf[by]) != 0) | (np.diff(sub[by]) != 0)) + 1):
                        name = f"{n}.{leaf[own[0]]}.{sub[own[0]]}"
                        rows += [(name, 0, n, ids[part].tobytes(), x[part].tobytes(), b"") for part in np.split(own, range(most, len(own), most))]
                for at in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at:at + 256], strict=True), types, strict=True)], names=names)
            held.clear()

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for n, own, x in _matrix(b.column(1), dtype):
                held.append((n, ids[own], x))
                size += x.nbytes
            if size > PACK_BYTES:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return run


def _first_copies(ids, x, k):
    """The rows that can be among k answers: of equal vectors the k + 1 smallest ids, each once."""
    key = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, group = np.unique(key, return_inverse=True)
    order = np.lexsort((ids, group))
    g, i = group[order], ids[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (i[1:] != i[:-1])])
    order, g = order[new], g[new]
    return order[np.arange(len(g)) - np.searchsorted(g, g) <= k]


def _seeds(spark, fitted, k):
    """A ``mapInArrow`` function that answers (id, v) from the sample alone, so that every query finds k rows if there are so many."""
    sent = spark.sparkContext.broadcast(fitted[0])

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for n, own, x in _matrix(b.column(1), np.float64):
                if router := sent.value.get(n):
                    q, row, d = router.limits(x, ids[own], k)[1]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[own][q]), pa.array(router.ids[row]), pa.array(d)], names=["query_id", "vec_id", "score"])

    return run


def _answers(dtype, k, factor):
    """A ``mapInArrow`` function over packs sorted by shard, vectors first: builds a shard's tree, then answers its queries block by block."""

    def joined(packs):
        return [np.concatenate(c) for c in zip(*packs, strict=True)]

    def run(batches):
        shard, vectors, asked, tree, own, each = None, [], [], None, None, k

        def answer():
            if tree is None or not asked:
                asked.clear()
                return
            ids, x, limit = joined(asked)
            asked.clear()
            q, row, d = tree.nearest(x.astype(np.float64), ids, limit, own, each, factor)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(own[row]), pa.array(np.sqrt(d))], names=["query_id", "vec_id", "score"])

        for b in batches:
            for r in range(b.num_rows):
                name, kind, n = (b.column(c)[r].as_py() for c in range(3))
                if name != shard:
                    yield from answer()
                    shard, vectors, tree = name, [], None
                ids = np.frombuffer(b.column(3)[r].as_py(), dtype=np.int64)
                x = np.frombuffer(b.column(4)[r].as_py(), dtype=dtype).reshape(len(ids), n)
                if not kind:
                    vectors.append((ids, x))
                    continue
                if vectors:
                    own, rows = joined(vectors)
                    rows = rows + dtype(0)  # -0 becomes 0
                    first = _first_copies(own, rows, k)
                    own, vectors = own[first], []
                    tree = Tree(rows[first].astype(np.float64))
                    each = k * int(np.unique(own, return_counts=True)[1].max())  # an id on several vectors may take several places
                asked.append((ids, x, np.frombuffer(b.column(5)[r].as_py(), dtype=np.float64)))
                if sum(len(a[0]) for a in asked) >= QUERY_BLOCK:
                    yield from answer()
        yield from answer()

    return run


def search(vectors: DataFrame, queries: DataFrame, k=10, factor=4.0, fit_rows=4096, shard_bytes=64 << 20, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the k nearest rows of ``vectors`` found, nearest first.

    ``factor``: 1 is exact.  The default is for vectors without clusters, where bounds are weak (64 random components: recall over 0.9, most buckets
    visited); the nearer the data are to clusters, the more it passes over at the same recall.  ``shard_bytes`` bounds a shard's vectors in double precision.
    """
    if factor < 1 or k < 1:
        raise ValueError("factor and k must be at least 1")
    double = any(t.schema[vector_col].dataType.elementType.simpleString() != "float" for t in (vectors, queries))
    dtype = np.float64 if double else np.float32
    data, asked = valid(vectors, id_col, vector_col, double), valid(queries, id_col, vector_col, double)
    fitted = fit(data, k, fit_rows, shard_bytes)
    spark = vectors.sparkSession
    packed = shared.in_batches(data, _packs(spark, fitted, dtype, k, factor, False), _PACKED).unionAll(
        shared.in_batches(asked, _packs(spark, fitted, dtype, k, factor, True), _PACKED))
    dealt = packed.repartition(fitted[3], "shard").sortWithinPartitions("shard", "kind")
    found = shared.in_batches(dealt, _answers(dtype, k, factor), _FOUND).unionAll(shared.in_batches(asked, _seeds(spark, fitted, k), _FOUND))
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
