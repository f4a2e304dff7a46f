"""WARC: write pages as records with revisits, and a salvage reader.

Writing: one record for each row, payload the HTML in UTF-8. Of records with equal payloads of
at least ``least`` bytes the one with the smallest id is a ``response`` and the others are
``revisit`` records that refer to it and carry no payload. Each task rolls archives of about
``roll_bytes``, every record its own gzip member (or plain), in the shared folder; a file is
written under a name of its own attempt and listed in a manifest, so what a lost or repeated
task left behind is never read.

Reading: an archive is read as a stream of members. A record counts only if its gzip check,
its length and its payload digest hold; otherwise the reader searches for the next gzip member
or ``WARC/`` version line that does, goes on from there, and logs the bytes passed over as a
quarantined gap (offset, length, reason). Memory is bounded by the largest record.

Edge cases: null HTML is an empty payload; rows with a null id revisit a row with an id where
one has the payload and are responses else; repeated ids are records of their own, and all
rows with the smallest id of a payload are responses; an empty table writes no archive; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh_path, partitions, stored, text_or_empty

VERSION = b"WARC/1.1\r\n"
MEMBER = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, uncompressed. A revisit has an empty block."""
    name = "" if page_id is None else str(page_id)
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Page-Length", str(size)),
    ]
    if revisit:
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        head.append(("WARC-Refers-To", f"<urn:page:{'' if refers_to is None else refers_to}>"))
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(0 if revisit else len(payload)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    return VERSION + lines + b"\r\n" + (b"" if revisit else payload) + b"\r\n\r\n"


def compress(record: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    payload: bytes


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


#: Bytes after which a record that does not end counts as damaged, for archives whose largest record is not known.
MOST = 1 << 28


class Damaged(Exception):
    pass


class _Short(Exception):
    """More bytes are needed to tell."""


def parse(data: bytes, at: int, ended: bool, most: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end of the plain record at ``at``; Damaged, or _Short while more may come, up to ``most`` bytes."""
    short = Damaged("cut off") if ended else _Short()
    head = data[at : at + len(VERSION)]
    if head != VERSION:
        raise short if VERSION.startswith(head) else Damaged("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise short if len(data) - at < most else Damaged("headers do not end")
    headers = {}
    for line in data[at + len(VERSION) : stop].split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        headers[key.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not length.isdigit() or len(length) > 15:
        raise Damaged("bad length")
    begin, end = stop + 4, stop + 4 + int(length)
    # A wrong length is told early if the digest is checked as soon as the bytes are there.
    if len(data) < end + 4:
        raise short
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("record does not end at its length")
    payload = data[begin:end]
    if headers.get("warc-type") == "response":
        digest = headers.get("warc-payload-digest", "")
        if digest.startswith("sha256:") and hashlib.sha256(payload).hexdigest() != digest[7:]:
            raise Damaged("payload digest differs")
    return headers, payload, end + 4


def _member(data: bytes, at: int, ended: bool, most: int, step: int = 1 << 16) -> tuple[bytes, int]:
    """Inflated gzip member at ``at`` and its end; fed in steps, so nothing behind its end is copied or inflated."""
    inflate, view, out, size = zlib.decompressobj(31), memoryview(data), [], 0
    for lo in range(at, len(data), step):
        fed = view[lo : lo + step]
        try:
            out.append(inflate.decompress(fed, most - size + 1))
        except zlib.error as e:
            raise Damaged("gzip check failed") from e
        size += len(out[-1])
        if inflate.eof:
            return b"".join(out), lo + len(fed) - len(inflate.unused_data)
        if size > most or inflate.unconsumed_tail:
            raise Damaged("record too long")
    raise Damaged("cut off") if ended else _Short()


def salvage(stream, chunk: int = 1 << 20, most: int = MOST) -> Iterator[Record | Gap]:
    """Records of an archive (a file object) in order, with the gaps between them.

    ``most``: bytes, packed or not, after which a record that does not end counts as damaged.
    """
    data, base, at, ended = b"", 0, 0, False
    bad: tuple[int, str] | None = None  # where the current gap began and why

    def found(data: bytes, at: int, ended: bool) -> tuple[dict[str, str], bytes, int]:
        if data[at : at + 3] == MEMBER:
            plain, end = _member(data, at, ended, most)
            headers, payload, stop = parse(plain, 0, True, most)
            if stop != len(plain):
                raise Damaged("bytes after the record")
            return headers, payload, end
        if not ended and len(data) - at < len(VERSION):
            raise _Short()
        return parse(data, at, ended, most)

    want = chunk
    while True:
        if not ended and len(data) - at < want:
            more = stream.read(max(chunk, want))
            ended = not more
            data, base, at = data[at:] + more, base + at, 0
            continue
        if at >= len(data):
            break
        try:
            headers, payload, end = found(data, at, ended)
        except _Short:
            if len(data) - at < most:
                want = 2 * max(len(data) - at, chunk)
                continue
            reason = "record too long"
        except Damaged as e:
            reason = str(e)
        else:
            if bad:
                yield Gap(bad[0], base + at - bad[0], bad[1])
                bad = None
            yield Record(base + at, end - at, headers, payload)
            at, want = end, chunk
            continue
        bad, want = bad or (base + at, reason), chunk
        # The next place where a record may begin.
        places = [p for p in (data.find(MEMBER, at + 1), data.find(VERSION, at + 1)) if p >= 0]
        at = min(places) if places else len(data) if ended else max(at + 1, len(data) - len(VERSION) + 1)
    if bad:
        yield Gap(bad[0], base + at - bad[0], bad[1])


def write(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least: int = 100,
    gzip: bool = True,
    roll_bytes: int = 32 << 20,
    folder: str | None = None,
) -> DataFrame:
    """Write archives; the manifest, stored: path, bytes, records, largest (bytes of the largest record, not packed)."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    payload = text_or_empty(html_col).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    # One small row for each payload that is met again; the rest of the pages meet none.
    firsts = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = stored(firsts.filter("n > 1").select("digest", "first"), "warc-firsts")
    joined = rows.join(firsts, "digest", "left")
    marked = joined.withColumn("revisit", F.coalesce(F.col("id") != F.col("first"), F.col("id").isNull() & F.col("first").isNotNull()))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        out = None
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    name, size, n, largest = f"{uuid.uuid4().hex}.warc" + ".gz" * gzip, 0, 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                record = encode_record(r["id"], r["url"], r["payload"], r["digest"], r["size"], r["first"], r["revisit"])
                largest = max(largest, len(record))
                record = compress(record) if gzip else record
                out.write(record)
                size, n = size + len(record), n + 1
                if size >= roll_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "bytes": size, "records": n, "largest": largest}])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "bytes": size, "records": n, "largest": largest}])

    slim = marked.select("id", "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "digest", "size", "first", "revisit")
    return stored(slim.mapInArrow(put, "path string, bytes long, records long, largest long"), "warc-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Every record and gap of the archives: path, offset, length, reason (of a gap), headers, payload.

    A manifest that names its largest record bounds what the reader holds before it gives a record up, with room
    for what packing may add; so no whole record of any size is a gap.
    """

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, largest in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                most = MOST if largest is None else largest + (largest >> 8) + (1 << 16)
                store, at = pafs.FileSystem.from_uri(path)
                out, size = [], 0
                with store.open_input_stream(at, compression=None) as f:
                    for x in salvage(f, most=most):
                        gap = isinstance(x, Gap)
                        out.append(
                            {
                                "path": path,
                                "offset": x.offset,
                                "length": x.length,
                                "reason": x.reason if gap else None,
                                "headers": None if gap else list(x.headers.items()),
                                "payload": None if gap else x.payload,
                            }
                        )
                        size += x.length if gap else len(x.payload) + 500
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema=kinds)
                            out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)

    text = pa.string()
    kinds = pa.schema(
        [("path", text), ("offset", pa.int64()), ("length", pa.int64()), ("reason", text), ("headers", pa.map_(text, text)), ("payload", pa.binary())]
    )
    # Dealt in turn, an archive to a task where there are tasks enough; a number that is given is not coalesced.
    tasks = 4 * max(partitions(manifest.sparkSession), manifest.sparkSession.sparkContext.defaultParallelism)
    largest = F.col("largest") if "largest" in manifest.columns else F.lit(None).cast("long")
    paths = manifest.select("path", largest).repartition(max(1, min(manifest.count(), tasks)))
    return paths.mapInArrow(get, "path string, offset long, length long, reason string, headers map<string,string>, payload binary")


def page_records(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One row per record read back: id, payload_bytes, payload_digest, record_type, refers_to.

    A quarantined gap is a row too: ``record_type`` is ``gap`` and ``payload_bytes`` the bytes passed
    over, so a damaged archive never looks like a whole one.
    """
    head = lambda k: F.col("headers")[k]
    number = lambda k: F.regexp_extract(head(k), r"<urn:page:(-?\d+)>", 1).try_cast("long")
    response = head("warc-type") == "response"
    gap = F.col("reason").isNotNull()
    return records.select(
        number("warc-record-id").alias(id_col),
        F.when(gap, F.col("length")).when(response, F.octet_length("payload").cast("long")).otherwise(head("warc-page-length").try_cast("long")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.substring(head("warc-payload-digest"), 8, 64)).alias("payload_digest"),
        F.when(gap, "gap").otherwise(head("warc-type")).alias("record_type"),
        F.when(response, F.lit(None).cast("long")).otherwise(number("warc-refers-to")).alias("refers_to"),
    )
