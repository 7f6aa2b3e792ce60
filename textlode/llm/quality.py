"""Quality classifier by gated attention over passages (multiple-instance learning).

Method.  A text is a bag of passages of ``PASSAGE`` words.  Each passage is encoded by surface rates (case, digits, punctuation, symbols, word lengths,
repeated words and neighbours, lines) and by hashed rates of characters' classes at word ends.  Gated attention gives each passage the weight
softmax(w . (tanh(V h) * sigmoid(U h))); the document is the weighted sum of its passages' codes h, scored by a logistic layer.  All weights are learned
from document labels alone, by Adam on all labelled rows; passages have no labels.  The same weights score every document.

Each document's codes are a matrix of a few numbers a passage, kept in parts of about ``PART`` passages.  In a round each part's task goes on from the common
weights over its own documents, and the parts' weights are averaged by their documents; weights are all that comes to the driver.  A caller may bound the rows
by ``sample_rows``, the labelled ids of least hash, or by ``most_passages``: whole documents in order of hash until they have as many passages or more.

Defined cases: a null or empty text is one passage without words and gets that passage's score; repeated rows get equal scores; rows without a label, or
whose label is null, are not learned from; labels of one value only, or none, give their mean (or 0.5) as every score; an empty table gives an empty
table; other columns, whatever their names, are never inputs.
"""

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import shared, words as W

PASSAGE = 64
_CODE = np.full(256, 5, dtype=np.int64)  # classes of bytes: 0 lower, 1 upper, 2 digit, 3 space, 4 full stop or comma, 5 other ASCII, 6 line end, 7 not ASCII
_CODE[97:123], _CODE[65:91], _CODE[48:58], _CODE[[32, 9, 13, 11, 12]], _CODE[[46, 44]], _CODE[10], _CODE[128:] = 0, 1, 2, 3, 4, 6, 7
FEATURES = 8 + 16 + 12


def passages(text: bytes) -> np.ndarray:
    """One row of ``FEATURES`` numbers for each run of ``PASSAGE`` words."""
    raw = np.frombuffer(text, dtype=np.uint8)
    data = W.LOWER[raw]
    starts, ends, hashes = W.hash_words(data, W.NONSPACE)
    n = len(starts)
    first = np.arange(0, max(n, 1), PASSAGE)
    k = len(first)
    out = np.zeros((k, FEATURES))
    if not n:
        return out
    words = np.diff(np.append(first, n)).astype(float)
    lo = starts[first]
    hi = np.append(lo[1:], len(raw))
    of_byte = np.repeat(np.arange(k), hi - lo)
    code = _CODE[raw[lo[0]:]]
    size = np.maximum(hi - lo, 1).astype(float)
    out[:, :8] = np.bincount(of_byte * 8 + code, minlength=8 * k).reshape(k, 8) / size[:, None]
    passage = np.arange(n) // PASSAGE
    last = _CODE[raw[ends - 1]]
    head = _CODE[raw[starts]]
    out[:, 8:16] = np.bincount(passage * 8 + last, minlength=8 * k).reshape(k, 8) / words[:, None]
    out[:, 16:24] = np.bincount(passage * 8 + head, minlength=8 * k).reshape(k, 8) / words[:, None]
    length = (ends - starts).astype(float)
    total = lambda x: np.bincount(passage, x, k) / words
    mean = total(length)
    # words that stood in the passage before, and words that repeat the one before, two or three before
    order = np.lexsort((np.arange(n), hashes, passage))
    again = np.zeros(n)
    again[order[1:]] = (hashes[order][1:] == hashes[order][:-1]) & (passage[order][1:] == passage[order][:-1])
    seen = np.zeros(n)
    by_hash = np.argsort(hashes, kind="stable")
    seen[by_hash[1:]] = hashes[by_hash][1:] == hashes[by_hash][:-1]
    pair = W.grams(hashes, 2)
    twice = np.zeros(n)
    if len(pair) > 1:
        by_pair = np.argsort(pair, kind="stable")
        twice[by_pair[1:]] = pair[by_pair][1:] == pair[by_pair][:-1]
    gap = [np.concatenate([np.zeros(min(d, n)), hashes[d:] == hashes[:-d]]) if n > d else np.zeros(n) for d in (1, 2, 3)]
    punct = np.concatenate([[0], np.cumsum(_CODE[raw] == 5)])
    marks = (punct[ends] - punct[starts]).astype(float)
    out[:, 24:36] = np.stack([mean / 10, np.sqrt(np.maximum(total(length ** 2) - mean ** 2, 0)) / 10, total(again), total(seen), total(twice), total(gap[0]),
                              total(gap[1]), total(gap[2]), total(marks > 0), total(marks > 1), total(length > 20), np.minimum(words / PASSAGE, 1)], axis=1)
    return out


class Model:
    """Weights; ``score`` of the passages of documents given as one matrix with cuts."""

    def __init__(self, weights=None, mean=0.0, scale=1.0, constant=0.5):
        self.w, self.mean, self.scale, self.constant = weights, mean, scale, constant
        self.samples = 0, 0  # documents and passages learned from

    def score(self, x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(cuts) - 1, self.constant)
        return _forward(self.w, np.clip((x - self.mean) / self.scale, -8, 8), cuts)[0]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _forward(w, x, cuts):
    h = np.tanh(x @ w["E"] + w["e"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    a = (t * g) @ w["w"]
    first = cuts[:-1]
    sizes = np.diff(cuts)
    top = np.repeat(np.maximum.reduceat(a, first), sizes)
    e = np.exp(a - top)
    p = e / np.repeat(np.add.reduceat(e, first), sizes)
    z = np.add.reduceat(h * p[:, None], first, axis=0)
    return _sigmoid(z @ w["c"] + w["b"]), (h, t, g, p, z, sizes)


def _start(n, hidden=24, gate=12, seed=7) -> dict:
    """Weights and Adam's two means of ``n`` features."""
    rng = np.random.default_rng(seed)
    w = {"E": rng.normal(0, n ** -0.5, (n, hidden)), "e": np.zeros(hidden), "V": rng.normal(0, hidden ** -0.5, (hidden, gate)),
         "U": rng.normal(0, hidden ** -0.5, (hidden, gate)), "w": rng.normal(0, gate ** -0.5, gate), "c": rng.normal(0, hidden ** -0.5, hidden), "b": np.zeros(1)}
    return {"w": w, "m": {k: np.zeros_like(a) for k, a in w.items()}, "v": {k: np.zeros_like(a) for k, a in w.items()}, "step": 0}


def _balance(share):
    """Weights of a document of label 0 and 1, at a share of label 1: both weigh alike."""
    return 0.5 / (1 - share), 0.5 / share


def _epochs(state, x, cuts, y, weight, rng, epochs, batch=128, rate=0.01, decay=1e-4) -> dict:
    """The state after some epochs of Adam on the logistic loss of documents; ``x`` is standardized, ``weight`` is by document."""
    w, m, v, step = state["w"].copy(), state["m"].copy(), state["v"].copy(), state["step"]
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            sizes = cuts[rows + 1] - cuts[rows]
            own = np.concatenate([np.arange(cuts[r], cuts[r + 1]) for r in rows])
            part = np.concatenate([[0], np.cumsum(sizes)])
            p, (h, t, g, a, z, _) = _forward(w, x[own], part)
            d = (p - y[rows]) * weight[rows] / len(rows)
            dz = np.repeat(d[:, None] * w["c"], sizes, axis=0)
            da = a * ((dz * h).sum(1) - np.repeat(np.add.reduceat((dz * h).sum(1) * a, part[:-1]), sizes))
            dt, dg = da[:, None] * w["w"] * g * (1 - t ** 2), da[:, None] * w["w"] * t * g * (1 - g)
            dh = (dz * a[:, None] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h ** 2)
            grad = {"E": x[own].T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ da, "c": z.T @ d, "b": np.array([d.sum()])}
            step += 1
            for k in w:
                q = grad[k] + decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.999 * v[k] + 0.001 * q * q
                w[k] = w[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return {"w": w, "m": m, "v": v, "step": step}


def _standard(x, mean, scale):
    return np.clip((x - mean) / scale, -8, 8)


def fit(x: np.ndarray, cuts: np.ndarray, y: np.ndarray, epochs=60, seed=7) -> Model:
    """A model of documents given as arrays."""
    if not len(y) or len(set(y.tolist())) < 2:
        return Model(constant=float(y.mean()) if len(y) else 0.5)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    weight = np.where(y == 1, *_balance((y == 1).mean())[::-1])
    state = _epochs(_start(x.shape[1], seed=seed), _standard(x, mean, scale), cuts, y, weight, np.random.default_rng(seed), epochs)
    return Model(state["w"], mean, scale)


#: Passages of a part, and labels (id, number) that are sent to all executors; more are joined by shuffle.
PART = 1 << 16
BROADCAST = 500_000


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="label", sample_rows=None, most_passages=None, rounds=20, epochs=3) -> Model:
    """A model from all labelled documents (id and label in ``labels``), each taken whole."""
    chosen = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("double").alias("y"))
              .withColumn("h", F.xxhash64(F.col(id_col).cast("string"))))
    chosen = chosen if sample_rows is None else chosen.orderBy("h", id_col).limit(sample_rows)
    chosen = shared.cut(chosen)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen) if chosen.count() <= BROADCAST else chosen, id_col).select(F.col(text_col).alias("text"), "y", "h")

    def codes(batches):
        for b in batches:
            for lo, hi in W.chunked(pc.fill_null(pc.binary_length(b.column(0)), 0).to_pylist(), 2 << 20):
                part = b.slice(lo, hi - lo)
                bags = [passages(t) for t in W.texts_of(part.column(0))]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([len(p) for p in bags], pa.int64()),
                                                  pa.array([p.astype(np.float32).tobytes() for p in bags], pa.binary())], names=["y", "h", "k", "x"])

    coded = shared.cut(rows.transform(shared.in_batches, codes, "y double, h long, k long, x binary"))
    if most_passages is not None:
        total, last = 0, None
        for r in sorted(coded.groupBy("h").agg(F.sum("k").alias("k")).collect()):
            if total >= most_passages:
                break
            total, last = total + r["k"], r["h"]
        coded = coded.limit(0) if last is None else coded.filter(F.col("h") <= last)
    n, found, ones = coded.agg(F.count("*"), F.sum("k"), F.sum((F.col("y") == 1).cast("long"))).first()
    if not n:
        return Model()
    if ones in (0, n):
        model = Model(constant=1.0 if ones else coded.agg(F.avg("y")).first()[0])
    else:
        parts = shared.cut(coded.repartition(max(1, -(-found // PART))).sortWithinPartitions("h", "y", "x"))
        model = _fit_parts(parts, n, found, _balance(ones / n), rounds, epochs)
    model.samples = n, found
    return model


def _fit_parts(parts: DataFrame, n, found, weights, rounds, epochs, seed=7) -> Model:
    """The weights after some rounds over all parts (y, h, k, x)."""

    def documents(batches):
        y, bags = [], []
        for b in batches:
            y.append(b.column(0).to_numpy())
            bags += [np.frombuffer(t, dtype=np.float32).reshape(-1, FEATURES) for t in b.column(3).to_pylist()]
        if bags:
            yield np.concatenate(y), np.concatenate(bags).astype(float), np.concatenate([[0], np.cumsum([len(x) for x in bags])])

    def moments(batches):
        for _, x, _ in documents(batches):
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([x.sum(0), (x * x).sum(0)]).tobytes()], pa.binary())], names=["sums"])

    sums = sum(np.frombuffer(r["sums"]) for r in parts.mapInArrow(moments, "sums binary").collect()) / found
    mean, scale = sums[:FEATURES], np.sqrt(np.maximum(sums[FEATURES:] - sums[:FEATURES] ** 2, 0)) + 1e-6
    state = _start(FEATURES, seed=seed)
    for done in range(rounds):

        def learn(batches):
            for y, x, cuts in documents(batches):
                own = _epochs(state, _standard(x, mean, scale), cuts, y, np.where(y == 1, *weights[::-1]), np.random.default_rng([seed, done]), epochs)
                yield pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int64()), pa.array([pickle.dumps(own)], pa.binary())], names=["n", "state"])

        got = [(r["n"] / n, pickle.loads(r["state"])) for r in parts.mapInArrow(learn, "n long, state binary").collect()]
        state = {s: {k: sum(share * own[s][k] for share, own in got) for k in state[s]} for s in "wmv"} | {"step": max(own["step"] for _, own in got)}
    return Model(state["w"], mean, scale)


def _scores(model: Model, texts: list[bytes]) -> np.ndarray:
    out = [np.empty(0)]
    for lo, hi in W.chunked([len(t) for t in texts], 2 << 20):
        bags = [passages(t) for t in texts[lo:hi]]
        out.append(model.score(np.concatenate(bags), np.concatenate([[0], np.cumsum([len(x) for x in bags])])))
    return np.concatenate(out)


def keep(docs: DataFrame, model: Model, least: float, text_col="text") -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with all their columns."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_scores(sent.value, W.texts_of(b.column(at))) >= least))

    return docs.transform(shared.in_batches, run, docs.schema)


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row: id and ``score`` (0 to 1) of the whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(sent.value, W.texts_of(b.column(1))))], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), text_col).transform(shared.in_batches, run, f"id {kind}, score double").withColumnRenamed("id", id_col)
