"""Fill-in-middle transformation by a piecewise-linear learned rank index over token boundaries.

Method.  A text of n tokens has the boundaries 0 .. n; boundary i stands at an offset that rises with i.  All boundary offsets of a chunk of texts are
fitted together: a segment is the line from its first boundary to its last, and a segment in which the line misses a boundary by more than ``error``
bytes is halved until none does (two neighbours always fit).  The index is the segments and, for each boundary, what the line misses it by, in one byte.
A cut after a given number of tokens is predicted by its segment's line and corrected by its stored residual, which gives the offset exactly.

Which cuts a text gets, and which form, follows from the SHA-256 of seed and id alone, so a rerun, a lost executor or another partitioning changes nothing.
Texts are transformed where they stand: nothing is shuffled or sent to all tasks, and memory follows a chunk of texts.

Defined cases: a null text is an empty one and stays plain; a text that contains a marker stays plain; a null id is the empty string behind the seed;
repeated rows are transformed alike; an empty table gives an empty table; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import shared, words as W

#: Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = "<P>|<S>|<M>"


class RankIndex:
    """Boundary offsets of many texts: ``offsets[first[t]:first[t + 1]]`` rise from 0; ``at(t, i)`` is the i-th of text t."""

    def __init__(self, offsets: np.ndarray, first: np.ndarray, error=127):
        if not 0 < error < 128:
            raise ValueError("residuals are stored in one byte: error must be from 1 to 127")
        starts, stops = first[:-1].astype(np.int64), first[1:].astype(np.int64) - 1
        self.first, self.residuals = first, np.zeros(len(offsets), dtype=np.int8)
        done = []
        while len(starts):
            size = stops - starts + 1
            head = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(starts)), size)
            place = np.arange(size.sum()) - head[owner]
            missed = offsets[starts[owner] + place] - _line(offsets[starts], offsets[stops], size - 1, owner, place)
            fits = np.maximum.reduceat(np.abs(missed), head) <= error
            of = fits[owner]
            self.residuals[(starts[owner] + place)[of]] = missed[of]
            done.append((starts[fits], stops[fits]))
            # halves share the boundary between them; the later one owns it
            lo, hi = starts[~fits], stops[~fits]
            mid = (lo + hi) // 2
            starts, stops = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        self.starts = np.concatenate([s for s, _ in done]) if done else np.zeros(0, np.int64)
        stops = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(self.starts, kind="stable")
        self.starts, stops = self.starts[order], stops[order]
        self.steps, self.low, self.high = stops - self.starts, offsets[self.starts], offsets[stops]
        # a boundary that two segments hold belongs to the later one, whose line meets it
        self.residuals[self.starts] = 0

    def at(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Exact offsets of the boundaries: predicted by the line, corrected by the residual."""
        place = self.first[text] + rank
        of = np.searchsorted(self.starts, place, side="right") - 1
        return _line(self.low, self.high, self.steps, of, place - self.starts[of]) + self.residuals[place]


def _line(low, high, steps, of, place):
    """Whole-number values of the lines ``of`` at ``place`` steps from their start; a segment of one boundary is flat."""
    return low[of] + (high[of] - low[of]) * place // np.maximum(steps[of], 1)


def boundaries(data: np.ndarray, offsets: np.ndarray):
    """(boundary offsets, first boundary of each text) of texts ``data[offsets[t]:offsets[t + 1] - 1]``, each followed by one white-space byte.

    A token is a run of other bytes with the white space before it, or the white space at the end of a text.
    """
    edges = np.diff(np.concatenate([[False], W.NONSPACE[data], [False]]).view(np.int8))
    ends = np.flatnonzero(edges == -1)
    at = np.searchsorted(ends, offsets[:-1], side="right"), np.searchsorted(ends, offsets[1:] - 1, side="right")
    size = offsets[1:] - 1 - offsets[:-1]
    words = at[1] - at[0]
    last = np.where(words > 0, ends[np.maximum(at[1] - 1, 0)] if len(ends) else 0, offsets[:-1])
    rest = (last < offsets[:-1] + size).astype(np.int64)
    first = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(1 + words + rest, out=first[1:])
    out = np.zeros(first[-1], dtype=np.int64)
    owner = np.repeat(np.arange(len(size)), words)
    place = np.arange(words.sum()) - (np.cumsum(words) - words)[owner]
    out[first[owner] + 1 + place] = ends[at[0][owner] + place] - offsets[owner]
    out[(first[1:] - 1)[rest > 0]] = size[rest > 0]
    return out, first


def transform(docs: DataFrame, seed="42", fim_percent=50, spm_percent=80, error=127, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row: id, n, form (plain, psm or spm), prefix_chars and middle_chars (code points; null if plain) and output."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = b.column(5)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for lo, hi in W.chunked(sizes):
                own = W.texts_of(texts.slice(lo, hi - lo))
                data = np.frombuffer(b" ".join(own) + b" ", dtype=np.uint8)
                offsets = np.zeros(hi - lo + 1, dtype=np.int64)
                np.cumsum([len(t) + 1 for t in own], out=offsets[1:])
                ends, first = boundaries(data, offsets)
                n = np.diff(first) - 1
                h = [np.array(b.column(i).slice(lo, hi - lo).to_pylist(), dtype=np.int64) for i in range(1, 5)]
                index, each = RankIndex(ends, first, error), np.arange(hi - lo)
                cuts = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
                a, z = index.at(each, cuts[0]), index.at(each, cuts[1])
                chars = np.zeros(len(data) + 1, dtype=np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
                at = offsets[:-1]
                before, inside = chars[at + a] - chars[at], chars[at + z] - chars[at + a]
                forms, outputs = [], []
                for i, t in enumerate(own):
                    if not t or b"<P>" in t or b"<S>" in t or b"<M>" in t or h[2][i] % 100 >= fim_percent:
                        forms.append("plain")
                        outputs.append(t)
                        continue
                    prefix, middle, suffix = t[:a[i]], t[a[i]:z[i]], t[z[i]:]
                    spm = h[3][i] % 100 < spm_percent
                    forms.append("spm" if spm else "psm")
                    outputs.append(b"".join((b"<S>", suffix, b"<P>", prefix, b"<M>", middle) if spm else (b"<P>", prefix, b"<S>", suffix, b"<M>", middle)))
                cut = np.array([f == "plain" for f in forms])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(forms, pa.string()), pa.array(before, pa.int64(), mask=cut),
                     pa.array(inside, pa.int64(), mask=cut), pa.array(outputs, pa.binary()).cast(pa.string())],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    groups = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    source = docs.select(F.col(id_col).alias("id"), *groups, F.col(text_col).cast("string").alias("text"))
    out = shared.in_batches(source, run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(form="form", output="output"):
    """The text as a column of a transformed row's form and output.

    Texts hold no marker and markers cannot overlap, so an output that is not plain splits into exactly three parts.
    """
    parts = F.split(F.col(output), MARKS, -1)
    part = lambda i: F.get(parts, F.lit(i))
    return (F.when(F.col(form) == "psm", F.concat(part(1), part(3), part(2))).when(F.col(form) == "spm", F.concat(part(2), part(3), part(1)))
            .otherwise(F.col(output)))
