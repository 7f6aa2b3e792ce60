"""Personal data by candidate spans and gradient-boosted trees.

Method.  Generators of high recall propose overlapping spans of four kinds (email, ip, card, phone): the strict base patterns, and loose ones
(spelled-out addresses, long hexadecimal addresses, any long digit group).  Each span gets format features (lengths, digit groups, separators,
checksum, neighbours) and context features (cue words before it).  Boosted trees, trained on a bounded sample of the corpus's own candidates, score
them; per kind a threshold is calibrated on held-out candidates so that at most ``false_rate`` of the known negatives pass.  Base spans always stay;
of the others, those over the threshold are taken by falling score where nothing taken overlaps.

Labels are weak: base spans are positive, and so are base phones with the "+" hidden; loose spans whose digit count or grouping no phone or card has are
negative; the rest are left out of training.

Scoring reads each text once, in any order, and moves nothing but results.  All labelled candidates of all rows are learned from: a fifth of them, by hash,
sets the thresholds, the others the trees.

Defined cases: a null or empty text has no spans; repeated rows give repeated rows; an empty table, or one without candidates of both labels, trains
nothing and base spans alone remain; ties in score go to the earlier, then longer span; extra columns are ignored.
"""

import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shared, words as W
from .boost import Trees

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, with the same matches as the plain forms (runs are taken whole, so no text is scanned twice).
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = string.ascii_letters + string.digits + "._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Loose patterns of the generators.
_SPELLED = re.compile(r"(?<=[A-Za-z0-9])(?: at |\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}(?: dot |\[dot\]|\(dot\)) ?[A-Za-z]{2,24}")
_HEXES = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![\w:])")
_GROUPS = re.compile(r"(?<![\w+])\(?[0-9][0-9 ().-]{5,28}[0-9](?!\w)")
_NUMBER = re.compile(r"(?<![\w.])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?!\w)")
_CUES = re.compile(r"\b(?:tel|phone|call|mobile|fax|contact|mail|email|card|visa|account|ip|host|server|address)\b", re.I)
WINDOW = 32
N_FEATURES = 21


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: leftmost, non-overlapping within a kind; matches that fail their test are dropped."""
    out = []
    if "@" in text:
        last = before = 0
        for m in _AT.finditer(text):
            at = m.start()
            before = max(last, text.rfind("@", before, at) + 1)
            own = text[before:at]
            n = len(own) - len(own.rstrip(_LOCAL))
            before = at
            if n:
                out.append(("email", at - n, m.end()))
                last = m.end()
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = _digits(m[0]) if m.end() - m.start() < 64 else ""
            if 12 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    """Further candidates, which may overlap each other and the base spans."""
    out = []
    if "dot" in text:
        for m in _SPELLED.finditer(text):
            own = text[max(0, m.start() - 64):m.start()]
            out.append(("email", m.start() - len(own) + len(own.rstrip(_LOCAL)), m.end()))
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _HEXES.finditer(text)]
        for m in _GROUPS.finditer(text):
            out.append(("card" if 12 < len(_digits(m[0])) < 20 else "phone", m.start(), m.end()))
        out += [("card", m.start(), m.end()) for m in _NUMBER.finditer(text)]
    return out


def features(text: str, kind: str, start: int, end: int, hide_plus=False) -> list[float]:
    """Format and context of one span."""
    own, before, after = text[start:end], text[max(0, start - WINDOW):start], text[end:end + 1]
    if hide_plus:
        own = own.lstrip("+")
    d = _digits(own[:256])
    groups = [len(g) for g in re.findall(r"[0-9]+", own[:256])]
    n = max(1, len(own))
    cue = _CUES.search(before)
    return [KINDS.index(kind), len(own), len(d), len(d) / n, sum(c.isalpha() for c in own[:256]) / n, len(groups), max(groups, default=0),
            min(groups, default=0), groups[-1] if groups else 0, own.startswith("+"), "(" in own, own.count(" "), own.count("-"), own.count("."),
            own.count(":"), luhn(d) if d else 0, len(set(d)), before[-1:].isalnum(), after.isalnum(), cue is not None, "@" in own]


def _phone_like(own: str) -> bool:
    groups = [len(g) for g in re.findall(r"[0-9]+", own)]
    return 9 <= sum(groups) <= 13 and 3 <= len(groups) <= 5 and groups[-1] >= 3 and max(groups) <= 5 and own.count(".") < 3


def labelled(text: str):
    """(features, label) of the candidates whose label is known."""
    base = base_spans(text)
    for kind, s, e in base:
        yield features(text, kind, s, e), 1
        if kind == "phone":
            yield features(text, kind, s, e, hide_plus=True), 1
    for kind, s, e in loose_spans(text):
        if not any(x < e and s < y for _, x, y in base):
            own = text[s:e]
            d = _digits(own)
            if kind == "card" and not luhn(d) or kind == "phone" and not _phone_like(own):
                yield features(text, kind, s, e), 0


class Model:
    """Trees with a threshold per kind; without training nothing passes."""

    def __init__(self, trees=None, thresholds=None):
        self.trees, self.thresholds = trees, thresholds or {}

    def select(self, text: str) -> list[tuple[str, int, int, float, bool]]:
        """(kind, start, end, score, base), by start and kind."""
        taken = [(k, s, e, 1.0, True) for k, s, e in base_spans(text)]
        more = loose_spans(text) if self.trees else []
        if more:
            scores = self.trees.score(np.array([features(text, *c) for c in more], dtype=float))
            occupied = [(s, e) for _, s, e, _, _ in taken]
            for score, s, e, kind in sorted(((p, s, e, k) for p, (k, s, e) in zip(scores, more, strict=True) if p >= self.thresholds.get(k, 2.0)),
                                            key=lambda x: (-x[0], x[1], -x[2])):
                if not any(x < e and s < y for x, y in occupied):
                    occupied.append((s, e))
                    taken.append((kind, s, e, float(score), False))
        return sorted(taken, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


#: Distinct coded candidates that one task adds up.
PART = 1 << 14


def train(docs: DataFrame, id_col="doc_id", text_col="text", false_rate=0.01) -> Model:
    """Boosted trees on all labelled candidates but a fifth; thresholds from all negatives of that fifth.

    Candidates are coded by their features' bins, and equal ones are one row with a count; each level of a tree is one pass of all tasks over these rows,
    of which only sums by node, feature and bin come to the driver.
    """

    def gather(batches):
        for b in batches:
            rows = [(own, i, y, [float(v) for v in x]) for own, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                    for i, (x, y) in enumerate(labelled(text or ""))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()),
                 pa.array([r[3] for r in rows], pa.list_(pa.float64()))], names=["own", "i", "y", "x"])

    found = (docs.select(F.col(id_col).cast("string"), text_col).transform(shared.in_batches, gather, "own string, i int, y int, x array<double>")
             .select("y", "x", (F.pmod(F.xxhash64("own", "i"), F.lit(5)) == 0).alias("held")))
    found = shared.cut(found)
    n = {(r["y"], r["held"]): r["n"] for r in found.groupBy("y", "held").agg(F.count("*").alias("n")).collect()}
    if len({y for y, _ in n}) < 2:
        return Model()
    apart = len({y for y, held in n if not held}) == 2 and any(held for _, held in n)
    seen = found.filter(~F.col("held")) if apart else found
    of = [sum(k for (y, held), k in n.items() if y == label and not (apart and held)) for label in (0, 1)]
    # both labels weigh alike, and each has its own quantiles
    trees, total = Trees(), sum(of)
    cuts = [F.percentile(F.col("x")[j], F.array(*map(F.lit, trees.quantiles()))).alias(f"c{j}") for j in range(N_FEATURES)]
    cuts = seen.groupBy("y").agg(*cuts).collect()
    trees.prepare([np.concatenate([r[f"c{j}"] for r in cuts]) for j in range(N_FEATURES)], 0.5, tuple(total / (2 * k) for k in of))
    coded = _coded(found, trees)

    def sums(trees, level):
        def run(batches):
            out = 0
            for b in batches:
                code, y, held, n = _code_rows(b)
                own = ~held if apart else np.ones(len(y), dtype=bool)
                out = out + trees.sums(code[own], y[own], n[own], level)
            if not isinstance(out, int):
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

        shape = 1 << level, N_FEATURES, max(map(len, trees.cuts)) + 1, 3, 2
        return sum(np.frombuffer(r["sums"]).reshape(shape) for r in coded.mapInArrow(run, "sums binary").collect())

    trees.grow(sums)
    return Model(trees, _thresholds(coded, trees, apart, false_rate))


def _coded(found: DataFrame, trees: Trees) -> DataFrame:
    """(code, kind, y, held, n): the bins of the features, a byte each, and the number of candidates."""

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in trees.codes(x)], pa.binary()), pa.array(x[:, 0].astype(np.int32)), b.column(0), b.column(2)],
                                             names=["code", "kind", "y", "held"])

    coded = found.transform(shared.in_batches, run, "code binary, kind int, y int, held boolean")
    coded = shared.cut(coded.groupBy("code", "kind", "y", "held").agg(F.count("*").alias("n")))
    return shared.cut(coded.repartition(max(1, -(-coded.count() // PART))))


def _code_rows(b):
    code = np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=np.uint8).reshape(-1, N_FEATURES)
    return code, b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy()


def _thresholds(coded: DataFrame, trees: Trees, apart: bool, false_rate: float, least=0.9) -> dict:
    """Per kind the score that at most ``false_rate`` of its known negatives (held-out ones, if set apart) pass, and not under ``least``; without negatives, ``least``.

    Scores are counted in classes a ten-thousandth wide, which pass or fail as one.
    """

    def run(batches):
        for b in batches:
            code, y, held, n = _code_rows(b)
            own = np.flatnonzero((y == 0) & (held if apart else True))
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(own)), pa.array(trees.score_codes(code[own])), pa.array(n[own])], names=["kind", "score", "n"])

    counted = coded.mapInArrow(run, "kind int, score double, n long").groupBy("kind", F.floor(F.col("score") * 10000).alias("class"))
    rows = sorted(tuple(r) for r in counted.agg(F.sum("n"), F.max("score")).collect())
    out = {}
    for i, kind in enumerate(KINDS):
        own = [r for r in rows if r[0] == i]
        total = sum(r[2] for r in own)
        place, before, cut = min(total - 1, int(np.ceil(total * (1 - false_rate)))), 0, -1.0
        for _, _, k, top in own:
            if before <= place:
                cut = top
            before += k
        out[kind] = max(least, cut + 1e-9)
    return out


SPAN = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"


def find(docs: DataFrame, model: Model, id_col="doc_id", text_col="text", replacement="[{kind}]") -> DataFrame:
    """Per row: id, ``spans`` (code points, end exclusive, with score and whether base) and ``redacted``, the text with each span replaced.

    Overlapping spans are replaced as one, under the name of the first.  A null text stays null.
    """
    kind_of = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())])

    def run(batches):
        model = sent.value
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in W.chunked([len(t or "") for t in texts], 8 << 20):
                spans, redacted = [], []
                for text in texts[lo:hi]:
                    own = model.select(text or "")
                    spans.append([dict(zip(("kind", "start", "end", "score", "base"), s, strict=True)) for s in own])
                    redacted.append(redact(text, own, replacement))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(spans, pa.list_(item)), pa.array(redacted, pa.string())],
                                                 names=["id", "spans", "redacted"])

    return docs.select(F.col(id_col).alias("id"), text_col).transform(shared.in_batches, run, f"id {kind_of}, spans {SPAN}, redacted string").withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, model: Model, text_col="text", replacement="[{kind}]") -> DataFrame:
    """``docs`` with the selected spans of ``text_col`` replaced; all other columns stay."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        model = sent.value
        for b in batches:
            texts = [redact(t, model.select(t or ""), replacement) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(texts, b.column(at).type), *b.columns[at + 1:]], schema=b.schema)

    return docs.transform(shared.in_batches, run, docs.schema)


def redact(text, spans, replacement="[{kind}]"):
    if not text or not spans:
        return text
    out, at, name, stop = [], 0, None, -1
    for kind, s, e, *_ in spans:
        if s < stop:
            stop = max(stop, e)
            continue
        if name is not None:
            out.append(replacement.format(kind=name))
            at = stop
        out.append(text[at:s])
        name, stop = kind, e
    out += [replacement.format(kind=name), text[stop:]]
    return "".join(out)
