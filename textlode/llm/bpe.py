"""Byte-level BPE encoding and decoding by ranked merges.

Method.  The split pattern cuts a text into words; the bytes of each distinct word are folded by ranked merges: of all neighbouring pieces whose joined
bytes are in the rank map, those of lowest rank, leftmost first, become one, until none is left.  A task folds a word once and keeps its ids (at most
``kept`` words at a time).  Decoding looks up the bytes of each id and joins the pieces.

The merges run in Arrow batches: the same fold as Spark higher-order functions over a literal rank map gave the same ids, but not within the limits (the
README has the figures).  Texts are never shuffled; the rank map is the only thing sent to the executors, and has the fixed size of the rank file.

A short word is folded by scanning; a long one (a run without white space) by a heap over a linked list, n log n steps, so long texts stay cheap.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded alike; an empty table gives an empty table; other
columns pass through, and one that has an output's name is replaced.  Ids are those of the rank file; special tokens do not exist.  Decoding an id that
the rank file lacks fails.
"""

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import shared, words as W

SHORT = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 bytes and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: lowest rank first, leftmost among equals."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > SHORT:
        return _fold_long(word, ranks)
    parts = [word[i:i + 1] for i in range(len(word))]
    near = [ranks.get(parts[i] + parts[i + 1], len(ranks)) for i in range(len(parts) - 1)]
    while near:
        lowest = min(near)
        if lowest == len(ranks):
            break
        i = near.index(lowest)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del near[i]
        if i < len(near):
            near[i] = ranks.get(parts[i] + parts[i + 1], len(ranks))
        if i:
            near[i - 1] = ranks.get(parts[i - 1] + parts[i], len(ranks))
    return [ranks[p] for p in parts]


def _fold_long(word: bytes, ranks) -> list[int]:
    n = len(word)
    end = list(range(1, n + 1))  # of the piece that starts here; 0 where none does any more
    before = list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue  # one of the two pieces has changed
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            r = ranks.get(word[i:end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if i:
            r = ranks.get(word[before[i]:stop])
            if r is not None:
                heapq.heappush(heap, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


def known_words(ranks: dict[bytes, int], kept=1 << 18) -> dict[str, bytes]:
    """Words to their packed ids, folded when first asked for; emptied when it holds ``kept`` words."""
    class Known(dict):
        def __missing__(self, word):
            if len(self) >= kept:
                self.clear()
            own = self[word] = np.array(fold(word.encode(), ranks), dtype="<u4").tobytes()
            return own
    return Known()


def _with(df: DataFrame, out: str, kind: str):
    """(columns kept, schema text of them and ``out``)."""
    rest = [c for c in df.columns if c != out]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out]
    return rest, ", ".join([*fields, f"`{out}` {kind}"])


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col="text", ids_col="ids", packed=False, kept=1 << 18) -> DataFrame:
    """``df`` with ``ids_col``: the token ids of each whole text, as array<int> or, if ``packed``, as little-endian unsigned 32-bit integers."""
    rest, schema = _with(df, ids_col, "binary" if packed else "array<int>")
    sent, at = df.sparkSession.sparkContext.broadcast(ranks), rest.index(text_col)

    def run(batches):
        ranks, cut = sent.value, regex.compile(pattern).findall
        known = known_words(ranks, kept)
        for b in batches:
            texts = b.column(at).to_pylist()
            for lo, hi in W.chunked([len(t or "") for t in texts], 4 << 20):
                ids = [b"".join(map(known.__getitem__, cut(t))) if t else b"" for t in texts[lo:hi]]
                if packed:
                    out = pa.array(ids, pa.binary())
                else:
                    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                    out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, out], names=[*rest, ids_col])

    return df.select(*rest).transform(shared.in_batches, run, schema)


def decode(df: DataFrame, ranks: dict[bytes, int], ids_col="ids", out_col="decoded") -> DataFrame:
    """``df`` with ``out_col`` (binary): the joined bytes of the ids in ``ids_col`` (array<int> or packed)."""
    rest, schema = _with(df, out_col, "binary")
    sent, at = df.sparkSession.sparkContext.broadcast(ranks), rest.index(ids_col)

    def run(batches):
        piece = {i: p for p, i in sent.value.items()}.__getitem__
        for b in batches:
            is_packed = not pa.types.is_list(b.column(at).type) and not pa.types.is_large_list(b.column(at).type)
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                ids = [np.frombuffer(x or b"", dtype="<u4").tolist() if is_packed else x or [] for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([b"".join(map(piece, x)) for x in ids], pa.binary())], names=[*rest, out_col])

    return df.select(*rest).transform(shared.in_batches, run, schema)
