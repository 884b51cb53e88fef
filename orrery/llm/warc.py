"""WARC archives: a writer with revisit records, and a reader that salvages what follows damaged parts."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import cut, shared_dir, table

MEMBER, VERSION = b"\x1f\x8b\x08", b"WARC/1."
MANDATORY = ("warc-type", "warc-record-id", "warc-date")
STEP, HEAD_BYTES, FILE_BYTES = 1 << 20, 1 << 16, 1 << 28


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header, with the length of the payload that it leaves out."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Damaged(ValueError):
    pass


def _headers(raw: bytes) -> tuple[dict[str, str], int]:
    """Named fields of a record and the offset of its block."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(VERSION) or end < 0:
        raise Damaged("no version line" if not raw.startswith(VERSION) else "header without end")
    lines = raw[:end].decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines) if sep}
    if not fields.get("content-length", "").isdecimal():
        raise Damaged("no content length")
    if not all(fields.get(k) for k in MANDATORY):
        raise Damaged("a mandatory field is missing")
    if any(c < " " and c != "\t" for x in lines for c in x):
        raise Damaged("control characters in the header")
    return fields, end + 4


def _checked(fields: dict[str, str], block: bytes) -> dict:
    kind, value = (fields.get("warc-block-digest") or ":").split(":", 1)
    if kind == "sha1" and digest(block) != value:
        raise Damaged("block digest differs")
    http, sep, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    revisit = fields.get("warc-type") == "revisit"
    size, payload_digest = len(payload), fields.get("warc-payload-digest", "").rpartition(":")[2]
    if revisit:
        told = [v for k, s, v in (x.partition(b":") for x in http.lower().split(b"\r\n")) if k == b"content-length"]
        size = int(told[0]) if told else None
    elif payload_digest and digest(payload) != payload_digest:
        raise Damaged("payload digest differs")
    return {"type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "payload_bytes": size, "payload_digest": payload_digest or digest(payload), "payload": None if revisit else payload}


class SalvageReader:
    """Records of a WARC file, plain or with one gzip member each; damaged stretches are given as gaps.

    After a failed check (member checksum, version line, content length, record end, digest) the reader looks for the
    next member or version line from which a whole valid record can be read, and goes on there. Yields
    ("record", offset, end, fields) and ("gap", offset, end, reason).
    """

    def __init__(self, src, size: int | None = None):
        self.src = src
        self.size = size if size is not None else src.seek(0, 2)

    def _read(self, at: int, n: int) -> bytes:
        self.src.seek(at)
        return self.src.read(n)

    def _member(self, at: int) -> tuple[bytes, int]:
        z, out, pos = zlib.decompressobj(wbits=31), [], at
        while not z.eof:
            raw = self._read(pos, min(STEP, HEAD_BYTES if pos == at else STEP))
            if not raw:
                raise Damaged("member cut off")
            try:
                out.append(z.decompress(raw))
            except zlib.error as e:
                raise Damaged(f"member: {e}") from None
            pos += len(raw)
            if len(out) == 1 and out[0] and not out[0].startswith(VERSION[: len(out[0])]):
                raise Damaged("no version line")
        return b"".join(out), pos - len(z.unused_data)

    def record_at(self, at: int) -> tuple[dict, int]:
        if self._read(at, 3) == MEMBER:
            raw, end = self._member(at)
            fields, start = _headers(raw)
            n = int(fields["content-length"])
            if len(raw) != start + n + 4 or raw[start + n :] != b"\r\n\r\n":
                raise Damaged("content length differs")
            return _checked(fields, raw[start : start + n]), end
        raw = self._read(at, HEAD_BYTES)
        while raw.startswith(VERSION) and b"\r\n\r\n" not in raw and at + len(raw) < self.size:
            more = self._read(at + len(raw), len(raw))
            if not more:
                break
            raw += more
        fields, start = _headers(raw)
        n = int(fields["content-length"])
        if at + start + n + 4 > self.size:
            raise Damaged("record cut off")
        raw = self._read(at + start, n + 4)
        if raw[n:] != b"\r\n\r\n":
            raise Damaged("content length differs")
        return _checked(fields, raw[:n]), at + start + n + 4

    def _next(self, at: int) -> int:
        """The next offset after `at` where a member or a version line may begin (the size: none)."""
        while at < self.size:
            raw = self._read(at, STEP + len(VERSION) - 1)
            found = [i for i in (raw.find(MEMBER), raw.find(VERSION)) if i >= 0]
            if found:
                return at + min(found)
            at += STEP
        return self.size

    def __iter__(self) -> Iterator[tuple]:
        at = 0
        while at < self.size:
            try:
                rec, end = self.record_at(at)
            except Damaged as e:
                bad, reason = at, str(e)
                at = self._next(at + 1)
                while at < self.size:
                    try:
                        rec, end = self.record_at(at)
                        break
                    except Damaged:
                        at = self._next(at + 1)
                yield "gap", bad, at, reason
                continue
            yield "record", at, end, rec
            at = end


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) plus first: the page_id of the response that a row with an equal payload revisits."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("_d", F.sha2(F.col("html").cast("binary"), 256))
    big = own.filter(F.octet_length("html") >= least_bytes)
    groups = cut(big.groupBy("_d").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").drop("n"), "warc-groups")
    out = own.join(groups, "_d", "left").drop("_d")
    return out.withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))


def write_warc(pages: DataFrame, out: str, least_bytes: int = 0, level: int = 1, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row of pages to gzip WARC files in the folder `out` (a shared URI); gives (file, records).

    Of rows with equal payloads of at least least_bytes bytes that with the smallest page_id is a response, others
    revisit it; rows that repeat the smallest page_id are responses, a null page_id comes after all others. Null html
    is an empty payload; a null url is left out. Files are renamed into place when complete. No pages: no files.
    """

    def work(batches):
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        ctx = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(out)
        fs.create_dir(base, recursive=True)
        f = name = tmp = None
        n = size = part = 0
        for batch in batches:
            for page_id, url, html, first in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if f is None:
                    name = f"pages-{ctx.partitionId():06d}-{part:04d}.warc.gz"
                    tmp = f"{base}/.{name}.{ctx.taskAttemptId()}"
                    f, n, size, part = fs.open_output_stream(tmp, compression=None), 0, 0, part + 1
                z = zlib.compressobj(level, wbits=31)
                raw = z.compress(record(page_id, url, html.encode(), first, first is not None)) + z.flush()
                f.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= file_bytes:
                    f.close()
                    fs.move(tmp, f"{base}/{name}")
                    yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]})
                    f = None
        if f is not None:
            f.close()
            fs.move(tmp, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]})

    planned = plan_records(pages, least_bytes).select("page_id", "url", "html", "first")
    return cut(planned.mapInArrow(work, "file string, records long"), "warc-manifest")


RECORDS = "file string, offset long, end long, gap string, type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def read_warc(files: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Rows of RECORDS for every record in files(file) of a shared folder; damaged stretches are rows with `gap` set
    (the reason) and file, offset and end alone: the log of what is quarantined. Empty files give no rows."""
    spark = files.sparkSession
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), files.count()))
    names = [x.split()[0] for x in RECORDS.split(", ")]
    schema = pa.schema([(k, pa.int64() if t == "long" else pa.binary() if t == "binary" else pa.string()) for k, t in (x.split() for x in RECORDS.split(", "))])

    def work(batches):
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_file(f"{base}/{name}") as f:
                    for kind, at, end, what in SalvageReader(f, f.size()):
                        row = {"file": name, "offset": at, "end": end, "gap": what} if kind == "gap" else {"file": name, "offset": at, "end": end, **what}
                        if not payload:
                            row["payload"] = None
                        held += len(row.get("payload") or b"") + 200
                        rows.append([row.get(k) for k in names])
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.select("file").repartition(n, "file").mapInArrow(work, RECORDS)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "warc")
    manifest = write_warc(table(spark, sf_dir, "pages"), out, least_bytes=0)
    back = read_warc(manifest, out, payload=False)
    back = back.filter(F.assert_true(F.col("gap").isNull(), F.concat_ws(" ", F.lit("damage in"), "file", "offset", "gap")).isNull())
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) as bigint)")
    return back.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))
