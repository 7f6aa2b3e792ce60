"""Words of whole texts as 64-bit hashes, computed on arrays of bytes.

Texts are taken as UTF-8 bytes in chunks of about ``CHUNK`` bytes, so memory follows the chunk, not the table.  A word is a run of bytes of a
given class; A-Z is lower-cased, nothing else is.  Words are compared by a 64-bit polynomial hash (odd base, mixed at the end), never by place.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = _U(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _byte_class(*separators):
    table = np.ones(256, dtype=bool)
    for lo, hi in separators:
        table[lo:hi + 1] = False
    return table


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing: ASCII digits, letters and every non-ASCII character.
ALNUM = _byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: ``[^\x20\x09-\x0D]+``: whatever is not ASCII white space.
NONSPACE = _byte_class((0x20, 0x20), (0x09, 0x0D))

_powers = (np.ones(1, dtype=_U), np.ones(1, dtype=_U))


def _power_tables(n):
    """base**i and base**-i modulo 2**64 for i < n; grown by doubling and kept by the worker."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            _powers = tuple(np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, b, _U)]), dtype=_U) for b in (_BASE, _INVERSE))
    return _powers


def mix(x):
    """Finalizer that spreads every input bit over the word."""
    x = x.astype(_U, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def _hash_spans(data, starts, ends):
    forward, back = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum((data.astype(_U) + _U(1)) * forward[:len(data)], out=total[1:])
        h = (total[ends] - total[starts]) * back[starts]
        return mix(h + (ends - starts).astype(_U) * _GRAM)


def hash_words(data: np.ndarray, kind: np.ndarray):
    """(starts, ends, hashes) of the words in one lower-cased byte array; a run longer than a chunk stays whole."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], kind[data], [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if len(data) <= 2 * CHUNK or not len(starts):
        return starts, ends, _hash_spans(data, starts, ends)
    out, at = [], 0
    while at < len(starts):  # a very long text: hash it piece by piece
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, side="right")))
        base = starts[at]
        out.append(_hash_spans(data[base:ends[to - 1]], starts[at:to] - base, ends[at:to] - base))
        at = to
    return starts, ends, np.concatenate(out)


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def chunked(sizes, limit=CHUNK):
    """(from, to) index ranges whose sizes add up to about ``limit``; one large item stands alone."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n + 1
    if at < len(sizes):
        yield at, len(sizes)


def words_by_text(texts, kind: np.ndarray):
    """For chunks of texts: (first index, hashes, cuts, starts, ends, data); words of the chunk's text i are ``[cuts[i], cuts[i + 1])``.

    ``texts`` are bytes, or an Arrow string column, of which one chunk at a time becomes bytes; null is the empty text.
    """
    column = not isinstance(texts, list)
    for lo, hi in chunked(pc.fill_null(pc.binary_length(texts), 0).to_pylist() if column else [len(t) for t in texts]):
        own = texts_of(texts.slice(lo, hi - lo)) if column else texts[lo:hi]
        # a space between texts is a word byte of neither class
        data = LOWER[np.frombuffer(b" ".join(own), dtype=np.uint8)]
        offsets = np.zeros(hi - lo + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in own], out=offsets[1:])
        starts, ends, hashes = hash_words(data, kind)
        yield lo, hashes, np.searchsorted(starts, offsets), starts, ends, data


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words (empty if there are fewer)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=_U)
    with np.errstate(over="ignore"):
        acc = hashes[:n].copy()
        for j in range(1, k):
            acc *= _GRAM
            acc += hashes[j:n + j]
    return mix(acc)


_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
          "array<long>": pa.list_(pa.int64())}


def schema_of(ddl: str) -> pa.Schema:
    """The Arrow form of a flat schema."""
    return pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def batches_of(rows: list[tuple], ddl: str, size=256):
    """Record batches of row tuples."""
    target = schema_of(ddl)
    for at in range(0, len(rows), size):
        columns = zip(*rows[at:at + size], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
