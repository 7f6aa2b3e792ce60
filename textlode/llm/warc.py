"""WARC archives: a writer that turns repeats into revisits, and a reader that salvages damaged files.

Writing.  Payloads are digested in the scan; per digest the smallest id is found by an aggregate (combined before the shuffle).  Repeats refer to that
record by ``WARC-Refers-To``.  Spark writes the archives, one per task, in the shared folder; with ``compress`` each record is a gzip member of its own.
Between members stands an empty gzip member, between plain records the two line ends that the format asks for, so each archive is valid as it is.

Reading.  Each archive is parsed from its start.  A member that fails to inflate, or a record whose version line, headers, length or block digest is
wrong, is not believed: the reader searches for the next member magic or version line that opens a valid record, goes on there, and logs the bytes
between as a gap.  A search looks at each byte once.  An archive is read by one task in whole, so ``archive_mb`` bounds its size when writing.

Defined cases: null payload is an empty payload; payloads under ``least`` bytes are always responses; repeated ids with one payload: all but one
revisit, to the same id; a null id counts as the text "null"; an empty table writes no archive and reads back empty; extra columns are ignored.
"""

import gzip
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shared, words as W

VERSION = b"WARC/1.1\r\n"
#: Most repeated digests (80 bytes each) that are sent to all executors; more are joined by shuffle.
BROADCAST = 100_000
MAGIC = b"\x1f\x8b\x08"
#: An empty gzip member: header, empty deflate block, checksum and length of nothing.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
RECORD = ("path string, offset long, record_id string, record_type string, refers_to string, payload_digest string, payload_bytes long, "
                            "target string, payload binary, gap_from long, gap_to long, reason string")


def _record(kind, own, target, digest, size, refers_to, payload):
    block = b"sha256:" + hashlib.sha256(payload).hexdigest().encode()
    head = [b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:page:" + own + b">", b"WARC-Date: 1970-01-01T00:00:00Z",
            b"WARC-Target-URI: " + target, b"WARC-Payload-Digest: sha256:" + digest, b"WARC-Block-Digest: " + block,
            b"WARC-Payload-Length: " + str(size).encode(), b"Content-Type: text/html", b"Content-Length: " + str(len(payload)).encode()]
    if refers_to is not None:
        head[1:1] = [b"WARC-Refers-To: <urn:page:" + refers_to + b">", b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return VERSION + b"\r\n".join(head) + b"\r\n\r\n" + payload


def write(pages: DataFrame, folder: str, id_col="page_id", payload_col="html", url_col="url", least=100, compress=True, archive_mb=32) -> None:
    """Archives of all rows under ``folder`` (a new folder that all executors share)."""
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b"")).alias("payload"),
                        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]+", " ").alias("url"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload").cast("long"))
    # only digests that occur again are joined back: few rows, whatever repeats them
    repeated = (rows.filter(F.col("n") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("k")).filter("k > 1"))
    repeated = shared.cut(repeated.select("digest", "first"))
    if repeated.count() <= BROADCAST:
        repeated = F.broadcast(repeated)
    named = rows.join(repeated, "digest", "left")
    text = named.select(F.col("id").cast("string").alias("id"), "payload", "url", "digest", "n",
                        F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first").cast("string")).alias("refers_to"))

    def form(batches):
        for b in batches:
            out = []
            for own, payload, url, digest, n, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                record = _record(b"revisit" if refers_to is not None else b"response", (own if own is not None else "null").encode(), url.encode(),
                                 digest.encode(), n, None if refers_to is None else refers_to.encode(), b"" if refers_to is not None else payload)
                out.append(_member(record + b"\r\n\r\n") if compress else record)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    # bytes pass through the text writer unchanged; its line separator is what stands between two records
    separator = EMPTY_MEMBER.decode("latin-1") if compress else "\r\n\r\n"
    (text.transform(shared.in_batches, form, "value binary").select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", separator).option("encoding", "ISO-8859-1")
     .option("maxRecordsPerFile", max(1, archive_mb * 64)).text(folder))


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Damaged(ValueError):
    pass


def _headers(data: bytes, at: int):
    """(headers, payload start, payload end, record end) of the record at ``at``; raises Damaged."""
    if not data.startswith(b"WARC/", at):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("headers without end")
    lines = data[at:end].split(b"\r\n")
    if not (lines[0][5:].replace(b".", b"", 1).isdigit()):
        raise Damaged("bad version line")
    head = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        head[name.strip().lower()] = value.strip()
    size = head.get(b"content-length", b"")
    if not size.isdigit():
        raise Damaged("bad length")
    start = end + 4
    stop = start + int(size)
    if stop > len(data):
        raise Damaged("record cut short")
    block = head.get(b"warc-block-digest")
    if block and block.startswith(b"sha256:") and hashlib.sha256(data[start:stop]).hexdigest().encode() != block[7:]:
        raise Damaged("block digest differs")
    if data[stop:stop + 4] not in (b"\r\n\r\n", b"") and not (stop + 4 > len(data) and b"\r\n\r\n".startswith(data[stop:])):
        raise Damaged("no record end")
    return head, start, stop, min(len(data), stop + 4)


def _inflate(data: bytes, at: int):
    """(inflated bytes, end of the member, reason): all that a member gives before it ends or breaks; a broken one has a reason and no end."""
    z, view, out, step = zlib.decompressobj(31), memoryview(data), [], 65536
    while not z.eof:
        if at >= len(data):
            return b"".join(out), None, "member cut short"
        before = z.copy()
        try:
            out.append(z.decompress(view[at:at + step]))
            at += step
        except zlib.error as e:
            if step == 1:
                return b"".join(out), None, f"bad member: {e}"
            z, step = before, 256 if step > 256 else 1  # again in smaller steps, so that all before the bad byte is kept
    return b"".join(out), min(at, len(data)) - len(z.unused_data), None


def _plain(data: bytes):
    """Yields ("record", offset, headers, payload) and ("gap", from, to, reason) of bytes that hold no members."""
    at, bad, why = 0, None, ""
    while at < len(data):
        try:
            head, start, stop, end = _headers(data, at)
        except Damaged as e:
            if bad is None:
                bad, why = at, str(e)
            at = data.find(b"WARC/", at + 1)
            at = len(data) if at < 0 else at
            continue
        if bad is not None:
            yield "gap", bad, at, why
            bad = None
        yield "record", at, head, data[start:stop]
        at = end
    if bad is not None:
        yield "gap", bad, len(data), why


def salvage(data: bytes):
    """Yields ("record", offset, headers, payload) and ("gap", from, to, reason) over the whole archive, in order.

    Inside a member, and inside what a broken member gave before it broke, version lines are looked for as in plain bytes, so a bad record costs itself
    alone; a gap inside a member is told with the member's own place in the archive, and its length in the member's inflated bytes in its reason.
    """
    at, bad, why = 0, None, ""
    while at < len(data):
        found, broken = [], None
        if data.startswith(MAGIC, at):
            inflated, end, broken = _inflate(data, at)
            found = list(_plain(inflated))
            if broken:  # what was cut off is part of the gap behind it
                found = [x for x in found if x[0] == "record" or x[2] < len(inflated)]
                after = min((x for x in (data.find(MAGIC, at + 1), data.find(b"WARC/", at + 1)) if x >= 0), default=len(data))
                end = after
        else:
            try:
                head, start, stop, end = _headers(data, at)
                found = [("record", at, head, data[start:stop])]
            except Damaged as e:
                broken = str(e)
                end = min((x for x in (data.find(MAGIC, at + 1), data.find(b"WARC/", at + 1)) if x >= 0), default=len(data))
        if bad is not None and (found or not broken):
            yield "gap", bad, at, why
            bad = None
        for what, start, x, y in found:
            if what == "record":
                yield "record", at, x, y
            else:
                yield "gap", at, end, f"{y} (inflated bytes {start} to {x})"
        if broken and bad is None:
            bad, why = at, broken
        at = end
    if bad is not None:
        yield "gap", bad, len(data), why


def _page(value):
    return None if value is None else value.decode("utf-8", "replace").removeprefix("<urn:page:").removesuffix(">")


def read(spark, folder: str) -> DataFrame:
    """Records and gaps of all archives under ``folder``; gap rows have only path, gap_from, gap_to and reason."""

    def parse(batches):
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                path, data, rows, held = path.as_py(), content.as_py(), [], 0
                for what, at, x, y in salvage(data):
                    if what == "gap":
                        rows.append((path, None, None, None, None, None, None, None, None, at, x, y))
                    else:
                        digest = x.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha256:") or None
                        kind = x.get(b"warc-type", b"").decode("latin-1")
                        if kind == "response":
                            n, digest = len(y), hashlib.sha256(y).hexdigest()
                        else:
                            n = int(x.get(b"warc-payload-length", b"0") or 0)
                        rows.append((path, at, _page(x.get(b"warc-record-id")), kind, _page(x.get(b"warc-refers-to")), digest, n,
                                     x.get(b"warc-target-uri", b"").decode("utf-8", "replace"), y, None, None, None))
                        held += len(y)
                    if held > 8 << 20:
                        yield from W.batches_of(rows, RECORD)
                        rows, held = [], 0
                yield from W.batches_of(rows, RECORD)

    # one archive a batch would be best; Arrow batches are bounded by bytes, archives by the writer
    return spark.read.format("binaryFile").load(folder).select("path", "content").transform(shared.in_batches, parse, RECORD)

