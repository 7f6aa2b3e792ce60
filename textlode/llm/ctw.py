"""Language-model scores by context-tree weighting over bytes.

Method.  A byte is eight binary decisions, each a node (context, bits of the byte so far).  Contexts are the last 0 to ``DEPTH`` bytes.  Every node has
the counts of zeros and ones that follow it in the training texts and their Krichevsky-Trofimov block probability Pe; the weighted probability of a node
is Pw = 1/2 Pe + 1/2 (product of the Pw of the same node in the longer contexts), at full depth Pw = Pe.  The predictive probability of a bit mixes the
KT estimates of all depths with the posterior weights that these give, from the longest context up; a node that never occurred predicts 1/2.  A text ends
with byte 255, which UTF-8 never has, and starts after ``DEPTH`` of them, so the scores are log-probabilities over all texts.

Counts come from every training text: a task counts its strings of ``DEPTH`` + 1 bytes, and what it found is shuffled and added.  Strings of other texts
take part with count zero, so that all that is to be scored has a row.  Rows are dealt by the nearest ``TOP`` + 1 bytes of context; a task forms all nodes
of longer contexts from its own rows.  Only the sums that contexts of ``TOP`` bytes need of the longer ones are added up again, and the model of these
short contexts has a proven size (at most 65,793 rows of 255 nodes) whatever the corpus; it is sent to all tasks.  The table of log-probabilities by
string grows with the corpus and is held by no machine: texts look up the most frequent strings (at most ``frequent_codes``) in a broadcast table, all
others are joined.

Word counts, for the unigram base line, are exact and held by no machine: words are compared by 64-bit hashes; a task's counts are combined before the
shuffle; the most frequent words (at most ``frequent``) are looked up in a broadcast table, all others are joined.

Defined cases: null is the empty text, which has only its end; repeated rows count each; without training rows all counts are zero and every bit
costs one bit; an empty table gives an empty table; a null training flag is false; extra columns are ignored.
"""

from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import shared, words as W

END = 255
#: Bytes of the longest contexts, and of those whose nodes are kept by every task.
DEPTH = 5
TOP = 2
#: Strings of a task that forms nodes, about.
PART = 1 << 17
_WORD_END = -1  # the end token's key is kept apart by its kind


def _padded(texts, depth=TOP):
    """One byte array of texts, each after ``depth`` end bytes and before one, and the places of the bytes that are coded, with text cuts."""
    mark = bytes([END])
    data = np.frombuffer(b"".join(mark * depth + t + mark for t in texts), dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    places = np.arange(cuts[-1]) + depth * np.repeat(np.arange(1, len(texts) + 1), sizes)
    return data, places, cuts


def _codes(data, places, depth=TOP):
    """The byte of each place, below the ``depth`` before it, the nearest lowest."""
    if not len(places):
        return np.empty(0, np.int64)
    lo, hi = places[0] - depth, places[-1] + 1
    wide = data[lo:hi].astype(np.int64)
    code = wide[depth:].copy()
    for j in range(1, depth + 1):
        code |= wide[depth - j:len(wide) - j] << (8 * j)
    return code[places - lo - depth]


def _strings(texts, depth):
    """(first text, texts, codes, cuts of texts) over pieces of texts of bounded size."""
    for lo, hi in W.chunked([len(t) for t in texts], 4 << 20):
        data, places, cuts = _padded(texts[lo:hi], depth)
        for at in range(0, len(places), 4 << 20):
            codes = _codes(data, places[at:at + (4 << 20)], depth)
            yield lo, hi, codes, np.clip(cuts - at, 0, len(codes))


def _merged(parts):
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n[:0]


class _Tally:
    """Counts by key of one kind; what does not get smaller is handed on."""

    def __init__(self, kind, most):
        self.kind, self.most, self.held, self.size = kind, most, [], 0

    def add(self, keys, n):
        self.held.append((keys, n))
        self.size += len(keys)
        if self.size > self.most:
            self.held = [_merged(self.held)]
            self.size = len(self.held[0][0])
            if self.size > self.most // 2:
                yield from self.out()

    def out(self):
        keys, n = _merged(self.held) if self.held else (np.empty(0, np.int64), np.empty(0, np.int64))
        self.held, self.size = [], 0
        for at in range(0, len(keys), 1 << 18):
            k = keys[at:at + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), self.kind, np.int8)), pa.array(k.view(np.int64)),
                                              pa.array(n[at:at + (1 << 18)].astype(np.int64))], names=["kind", "key", "n"])


def gather(docs: DataFrame, text_col: str, training_col: str) -> DataFrame:
    """(kind, key, n) over the training rows of ``docs``: kind 0 strings by code, 1 words by hash, 2 texts; strings of other rows with n = 0 at least."""

    def count(batches):
        strings, words, seen = _Tally(0, 1 << 22), _Tally(1, 1 << 21), 0
        for b in batches:
            learn = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            texts = W.texts_of(b.column(0))
            own = [t for t, x in zip(texts, learn, strict=True) if x]
            seen += len(own)
            for part, weight in ((own, 1), ([t for t, x in zip(texts, learn, strict=True) if not x], 0)):
                for _, _, codes, _ in _strings(part, DEPTH):
                    keys, n = np.unique(codes, return_counts=True)
                    yield from strings.add(keys, n * weight)
            for _, hashes, *_ in W.words_by_text(own, W.NONSPACE):
                yield from words.add(*np.unique(hashes, return_counts=True))
        yield from strings.out()
        yield from words.out()
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int8()), pa.array([0], pa.int64()), pa.array([seen], pa.int64())], names=["kind", "key", "n"])

    found = docs.select(text_col, training_col).transform(shared.in_batches, count, "kind byte, key long, n long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"))


_LGAMMA_HALF = None


def _log_pe(zeros, ones):
    """Log of the KT block probability of counts."""
    global _LGAMMA_HALF
    if _LGAMMA_HALF is None:
        _LGAMMA_HALF = np.array([lgamma(i + 0.5) for i in range(4096)]), np.array([lgamma(i + 1.0) for i in range(8192)])

    def gamma(x, shift, table):
        small = x < len(table)
        z = np.where(small, 1e4, x + shift)  # Stirling's series for large counts
        series = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z ** 3)
        return np.where(small, table[np.minimum(x, len(table) - 1)], series)

    return gamma(zeros, 0.5, _LGAMMA_HALF[0]) + gamma(ones, 0.5, _LGAMMA_HALF[0]) - gamma(zeros + ones, 1.0, _LGAMMA_HALF[1]) - np.log(np.pi)


def _nodes(counts):
    """(zeros, ones) of the 255 nodes of each context, level by level, from counts by byte."""
    parts = [counts.reshape(len(counts), 1 << k, 2, -1).sum(-1) for k in range(8)]
    return np.concatenate([p[:, :, 0] for p in parts], axis=1), np.concatenate([p[:, :, 1] for p in parts], axis=1)


def _by_byte(p_one):
    """log10 probability of each byte from the 255 nodes' probabilities of a one."""
    out, at = np.zeros((len(p_one), 1)), 0
    for k in range(8):
        p = p_one[:, at:at + (1 << k)]
        out = np.stack([out + np.log10(1 - p), out + np.log10(p)], axis=2).reshape(len(p_one), -1)
        at += 1 << k
    return out


def _kt(z, o):
    return (o + 0.5) / (z + o + 1.0)


def _weights(pe, children):
    """The weight of the own estimate, and the log of Pw."""
    return 1 / (1 + np.exp(np.clip(children - pe, -700, 700))), np.logaddexp(pe, children) - np.log(2)


def longer(strings: DataFrame, parts: int) -> DataFrame:
    """From (key, n) of all strings: (key, p) with p the probabilities, from contexts longer than ``TOP``, of the last byte's eight bits, and rows without p:
    (context of ``TOP`` bytes and node, total), the sum of log Pw of that node in the contexts of one more byte."""
    schema = pa.schema([("key", pa.int64()), ("p", pa.binary()), ("total", pa.float64())])

    def form(batches):
        found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not found:
            return
        key, n = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        byte = key & 255
        levels = []  # per depth: (context, byte) pairs in order, their counts, each string's pair, each pair's first string
        for d in range(TOP + 1, DEPTH + 1):
            pairs, first, own = np.unique(((key >> 8) & ((1 << (8 * d)) - 1)) << 8 | byte, return_index=True, return_inverse=True)
            levels.append((pairs, np.bincount(own, n, len(pairs)).astype(np.int64), own, first))
        out = np.empty((len(key), 8), dtype=np.float32)
        for k in range(8):
            nodes = []
            for pairs, count, own, first in levels:
                head = np.flatnonzero(np.concatenate([[True], (pairs[1:] >> (8 - k)) != (pairs[:-1] >> (8 - k))]))
                of_pair = np.cumsum(np.bincount(head, minlength=len(pairs))) - 1
                bit = (pairs >> (7 - k)) & 1
                o, both = np.add.reduceat(count * bit, head), np.add.reduceat(count, head)
                nodes.append((both - o, o, of_pair[own], first[head]))
            bit = (byte >> (7 - k)) & 1
            p, pw, before = None, None, None
            for z, o, own, string in reversed(nodes):
                kt = _kt(np.where(bit, z[own], o[own]), np.where(bit, o[own], z[own]))
                pe = _log_pe(z, o)
                if p is None:
                    p, pw = kt, pe
                else:
                    w, pw = _weights(pe, np.bincount(own[before], pw, len(pe)))
                    p = w[own] * kt + (1 - w[own]) * p
                before = string
            out[:, k] = p
            node = (((key[before] >> 8) & ((1 << (8 * TOP)) - 1)) << 8) | ((1 << k) - 1 + (byte[before] >> (8 - k)))
            node, at = np.unique(node, return_inverse=True)
            total = np.bincount(at, pw)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.binary()), pa.array(total)], schema=schema)
        for lo in range(0, len(key), 1 << 16):
            part = out[lo:lo + (1 << 16)]
            flat = pa.Array.from_buffers(pa.binary(32), len(part), [None, pa.py_buffer(part.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(key[lo:lo + (1 << 16)]), flat, pa.nulls(len(part), pa.float64())], schema=schema)

    near = F.shiftright("key", 8).bitwiseAND(F.lit((1 << (8 * (TOP + 1))) - 1))
    return strings.repartition(parts, near).select("key", "n").transform(shared.in_batches, form, "key long, p binary, total double")


class Model:
    """Contexts of 0 to ``TOP`` bytes: a row of each two-byte context, and by row and node the mixed estimates of these and the weight left to longer ones.

    Without ``deeper`` (sums of log Pw by context and node) the contexts of two bytes are the longest, and rows are log10 probabilities of the next byte.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, deeper=None):
        context = codes >> 8
        seen, first = np.unique(context, return_index=True)
        ends = np.append(first[1:], len(codes))
        last = seen & 255  # the nearer byte
        children = np.zeros((256, 255))
        one = np.zeros((256, 256), dtype=np.int64)
        np.add.at(one, (context & 255, codes & 255), counts)
        blocks = [(lo, min(lo + 2048, len(seen))) for lo in range(0, len(seen), 2048)]

        def block(lo, hi):
            full = np.zeros((hi - lo, 256), dtype=np.int64)
            rows = np.repeat(np.arange(hi - lo), ends[lo:hi] - first[lo:hi])
            span = slice(first[lo], ends[hi - 1])
            full[rows, codes[span] & 255] = counts[span]
            return _nodes(full)

        def under(lo, hi, pe):
            """Weights and log Pw of a block's contexts."""
            if deeper is None:
                return np.ones_like(pe), pe
            span = slice(*np.searchsorted(deeper[0], [seen[lo] << 8, (seen[hi - 1] + 1) << 8]))
            at = np.minimum(np.searchsorted(seen[lo:hi], deeper[0][span] >> 8), hi - lo - 1)
            there = seen[lo:hi][at] == deeper[0][span] >> 8
            total = np.zeros_like(pe)
            total[at[there], (deeper[0][span] & 255)[there]] = deeper[1][span][there]
            return _weights(pe, total)

        for lo, hi in blocks:
            np.add.at(children, last[lo:hi], under(lo, hi, _log_pe(*block(lo, hi)))[1])
        kt = _kt
        z1, o1 = _nodes(one)
        pe1 = _log_pe(z1, o1)
        w1 = 1 / (1 + np.exp(np.clip(children - pe1, -700, 700)))
        pw1 = np.logaddexp(pe1, children) - np.log(2)
        z0, o0 = _nodes(one.sum(0, keepdims=True))
        w0 = 1 / (1 + np.exp(np.clip(pw1.sum(0, keepdims=True) - _log_pe(z0, o0), -700, 700)))

        def upward(p2, rows, zero=False):
            own, top = (kt(o1[rows], z1[rows]), kt(o0, z0)) if zero else (kt(z1[rows], o1[rows]), kt(z0, o0))
            return w0 * top + (1 - w0) * (w1[rows] * own + (1 - w1[rows]) * p2)

        # 256 rows for contexts that never occurred, by the nearer byte; then one row for each that did
        self.row = np.tile(np.arange(256, dtype=np.int32), 256)
        self.row[seen] = 256 + np.arange(len(seen), dtype=np.int32)
        if deeper is None:
            table = [_by_byte(upward(np.full((256, 255), 0.5), np.arange(256)))]
            for lo, hi in blocks:
                table.append(_by_byte(upward(kt(*block(lo, hi)), last[lo:hi])))
            self.table = np.concatenate(table).astype(np.float32)
            return
        one = [upward(np.full((256, 255), 0.5), np.arange(256)).astype(np.float32)]
        zero, left = [(1 - one[0]).astype(np.float32)], [np.zeros((256, 255), np.float32)]
        for lo, hi in blocks:
            z, o = block(lo, hi)
            w2 = under(lo, hi, _log_pe(z, o))[0]
            rest = (1 - w0) * (1 - w1[last[lo:hi]]) * (1 - w2)
            own = upward(w2 * kt(z, o), last[lo:hi])
            one.append(own.astype(np.float32))
            zero.append(upward(w2 * kt(o, z), last[lo:hi], True).astype(np.float32))
            left.append(rest.astype(np.float32))
        self.bits, self.left = np.stack([np.concatenate(zero), np.concatenate(one)]), np.concatenate(left)

    def log_p(self, codes: np.ndarray, p: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each string, from its bits' probabilities by the longer contexts."""
        rows, byte, out = self.row[(codes >> 8) & 65535], codes & 255, np.zeros(len(codes))
        for k in range(8):
            node, bit = (1 << k) - 1 + (byte >> (8 - k)), (byte >> (7 - k)) & 1
            out += np.log10(self.bits[bit, rows, node] + self.left[rows, node].astype(np.float64) * p[:, k])
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text."""
        out = np.zeros(len(texts))
        for lo, hi in W.chunked([len(t) for t in texts], 2 << 20):
            data, places, cuts = _padded(texts[lo:hi])
            total = np.zeros(hi - lo)
            for at in range(0, len(places), 4 << 20):
                codes = _codes(data, places[at:at + (4 << 20)])
                sums = np.concatenate([[0.0], np.cumsum(self.table[self.row[codes >> 8], codes & 255], dtype=np.float64)])
                own = np.clip(cuts - at, 0, len(codes))
                total += sums[own[1:]] - sums[own[:-1]]
            out[lo:hi] = total
        return out


def train(strings: DataFrame, count: int) -> DataFrame:
    """(key, n, value): log10 probability of the last byte of each of the ``count`` strings (key, n)."""
    spark = strings.sparkSession
    found = shared.cut(longer(strings, max(1, -(-count // PART))))

    def columns(df):  # short contexts only: at most 2 ** 24 rows
        table = df.toArrow().sort_by("key")
        return [c.to_numpy() for c in table.columns]

    codes, counts = columns(strings.filter("n > 0").groupBy(F.col("key").bitwiseAND(F.lit((1 << 24) - 1)).alias("key")).agg(F.sum("n").alias("n")))
    deeper = columns(found.filter("p is null").groupBy("key").agg(F.sum("total").alias("total")))
    sent = spark.sparkContext.broadcast(Model(codes, counts, deeper))

    def value(batches):
        for b in batches:
            p = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.float32).reshape(-1, 8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.log_p(b.column(0).to_numpy(), p))], names=["key", "value"])

    by_key = found.filter("p is not null").select("key", "p").transform(shared.in_batches, value, "key long, value double")
    return by_key.join(strings, "key").select("key", "n", "value")


class _Frequent:
    """Values of the most frequent strings, by a table of places that the most frequent get."""

    def __init__(self, keys, n, values):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        self.shift = np.uint64(64 - max(4, int(2 * len(keys)).bit_length()))
        self.place = np.full(1 << (64 - int(self.shift)), -1, dtype=np.int32)
        by_n = np.argsort(n[order], kind="stable")
        self.place[W.mix(self.keys[by_n].astype(np.uint64)) >> self.shift] = by_n

    def find(self, codes):
        """(values, found) of the strings; 0 where not found."""
        if not len(self.keys):
            return np.zeros(len(codes)), np.zeros(len(codes), bool)
        at = self.place[W.mix(codes.astype(np.uint64)) >> self.shift]
        hit = self.keys[at] == codes
        miss = np.flatnonzero(~hit)
        other = np.minimum(np.searchsorted(self.keys, codes[miss]), len(self.keys) - 1)
        at[miss], hit[miss] = other, self.keys[other] == codes[miss]
        return np.where(hit, self.values[at], 0.0).astype(np.float64), hit


def score(docs: DataFrame, training: Column, id_col="doc_id", text_col="text", frequent=1 << 18, frequent_codes=1 << 20) -> DataFrame:
    """Per row: id, n_bytes, score (log10 probability), bits_per_byte, n_tokens, n_known, train_tokens, base_score.

    ``training`` says which rows the model and the counts learn from; all rows are scored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    counts = shared.cut(gather(rows, "text", "training"))
    words = counts.filter("kind = 1").select("key", "n")
    totals = counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()
    by_kind = {r["kind"]: r for r in totals}
    texts = by_kind[2]["n"] if 2 in by_kind else 0
    n_all = texts + (by_kind[1]["n"] if 1 in by_kind else 0)
    n_kinds = (texts > 0) + (by_kind[1]["k"] if 1 in by_kind else 0)
    strings = shared.cut(train(counts.filter("kind = 0").select("key", "n"), by_kind[0]["k"] if 0 in by_kind else 0))
    often = shared.most_frequent(strings.filter("n > 0"), frequent_codes).toArrow()
    model = _Frequent(*(often.column(c).to_numpy() for c in ("key", "n", "value")))
    common = shared.most_frequent(words, frequent)
    known = common.toArrow()
    keys, n = known.column("key").to_numpy().astype(np.int64), known.column("n").to_numpy().astype(np.int64)
    order = np.argsort(keys)
    sent = spark.sparkContext.broadcast((model, keys[order], n[order]))
    kind = docs.schema[id_col].dataType.simpleString()
    part = pa.struct([("kind", pa.int8()), ("key", pa.int64()), ("k", pa.int32())])

    def listed(kind, keys, k):
        return pa.StructArray.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys), pa.array(k.astype(np.int32))], fields=list(part))

    def run(batches):
        model, keys, n = sent.value
        for b in batches:
            texts = W.texts_of(b.column(1))
            scores, left = np.zeros(len(texts)), [[] for _ in texts]
            for lo, hi, codes, cuts in _strings(texts, DEPTH):
                values, hit = model.find(codes)
                sums = np.concatenate([[0.0], np.cumsum(values)])
                scores[lo:hi] += sums[cuts[1:]] - sums[cuts[:-1]]
                miss = np.flatnonzero(~hit)
                owner = np.searchsorted(cuts, miss, side="right") - 1
                for i in np.unique(owner):
                    left[lo + i].append(listed(0, *np.unique(codes[miss[owner == i]], return_counts=True)))
            tokens, seen, logs, rest = [], [], [], []
            for _, hashes, cuts, *_ in W.words_by_text(texts, W.NONSPACE):
                hashes = hashes.view(np.int64)
                at = np.searchsorted(keys, hashes)
                at[at == len(keys)] = 0
                hit = keys[at] == hashes if len(keys) else np.zeros(len(hashes), dtype=bool)
                value = np.concatenate([[0.0], np.cumsum(np.where(hit, np.log10(n[at] + 1.0), 0.0))]) if len(keys) else np.zeros(len(hashes) + 1)
                number = np.concatenate([[0], np.cumsum(hit)])
                for i in range(len(cuts) - 1):
                    lo, hi = cuts[i], cuts[i + 1]
                    tokens.append(int(hi - lo) + 1)
                    seen.append(int(number[hi] - number[lo]))
                    logs.append(float(value[hi] - value[lo]))
                    own, k = np.unique(hashes[lo:hi][~hit[lo:hi]], return_counts=True)
                    rest.append(pa.concat_arrays([listed(1, own, k), *left[len(rest)]]))
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rest])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(rest) if rest else pa.array([], part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(scores), pa.array(tokens, pa.int64()), pa.array(seen, pa.int64()),
                 pa.array(logs, pa.float64()), lists], names=["id", "n_bytes", "score", "n_tokens", "seen", "logs", "rest"])

    scored = rows.select("id", "text").transform(shared.in_batches, 
        run, f"id {kind}, n_bytes long, score double, n_tokens long, seen long, logs double, rest array<struct<kind:tinyint,key:bigint,k:int>>")
    scored = shared.cut(scored.withColumn("row", F.monotonically_increasing_id()))
    value = (words.select(F.lit(1).cast("byte").alias("kind"), "key", F.log10(F.col("n") + 1.0).alias("value"))
             .unionByName(strings.select(F.lit(0).cast("byte").alias("kind"), "key", "value")))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    rest = (scored.select("row", F.explode("rest").alias("w")).select("row", "w.*").join(value, ["kind", "key"])
            .groupBy("row").agg(of(1, F.col("k")).alias("more_seen"), of(1, F.col("k") * F.col("value")).alias("more_logs"),
                                of(0, F.col("k") * F.col("value")).alias("more_score")))
    whole = scored.drop("rest").join(rest, "row", "left").withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    zero = F.lit(0)
    return whole.select(
        F.col("id").alias(id_col), "n_bytes", "score", (-F.col("score") / F.lit(float(np.log10(2))) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
        "n_tokens", (F.col("seen") + F.coalesce("more_seen", zero) + F.lit(int(texts > 0))).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + F.lit(float(np.log10(texts + 1.0)))
         - F.col("n_tokens") * F.lit(float(np.log10(n_all + n_kinds + 1.0)))).alias("base_score"))
