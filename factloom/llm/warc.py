"""WARC archives: writing captures as records, reading archives, and assembling transactions.

A capture is three records of one file: a response (or a revisit without a body), the request and a metadata record; the latter two
name the former in WARC-Concurrent-To.  Spark's text writer stores them: a row is a record, and its line separator is the two
CRLF that end a WARC record, so files are committed and retried like any other Spark output and lie on any store.  Files are
gzip-compressed as a whole and hold at most PER_FILE captures and about FILE bytes: captures above BIG bytes are written apart, in files
of as many as the largest of them allows.  They are read as binary files, unpacked and parsed in pieces.

Payloads that are equal (by SHA-1 and length) and at least LEAST bytes long are stored once, with the greatest page_id; the
others become revisit records that refer to it.  Which payloads repeat is found from digests alone; payloads are shuffled only if the
repeated digests are too many to be broadcast.

Edge cases: a null html counts as empty, a null url as an empty target; a null page_id is written as an empty id and reads as
null; very long payloads lie in files of few captures, are parsed in pieces of the file and held one at a time; rows that tie for the greatest page_id of a payload are all
responses; repeated rows are captures each; an empty table gives an archive without records and an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import cut, small
from factloom.sources.shared import working_dir

LEAST = 1000
PER_FILE = 2000
#: Bytes of records in a file, before compression, and of a capture that is written apart.
FILE = 512 << 20
BIG = 256 << 10
CRLF = "\r\n"
PIECE = 1 << 20
#: Records that go into one batch, by bytes.
BATCH = 8 << 20
DATE = "2024-01-01T00:00:00Z"


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column | None]], body: Column) -> Column:
    """One record less its closing separator; a header whose value is null is left out."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), body)


def captures(pages: DataFrame) -> tuple[DataFrame, int]:
    """(page_id, url, payload, digest, bytes, first, size), and the greatest size.

    first is the page_id of the response that a revisit refers to, else null; size what the capture takes of a file, about.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    base = base.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload")})
    size = F.col("bytes").cast("long") + 10 * F.octet_length("url")  # the url stands in all three records
    keys = cut(base.select("page_id", "digest", "bytes", size.alias("size")))
    repeats = keys.where(F.col("bytes") >= LEAST).groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = base.withColumn("size", size).join(small(cut(repeats)), ["digest", "bytes"], "left")
    return found.withColumn("first", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))), keys.agg(F.max("size")).first()[0] or 0


def write(pages: DataFrame, path: str) -> None:
    """Writes three records a row of `pages` (page_id, url, html) to gzip-compressed WARC files under `path`."""
    rows, most = captures(pages)
    rows = rows.withColumn("unique", F.uuid())
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    clean = F.regexp_replace("url", r"[\r\n]", "%0A")

    def name(what: str) -> Column:
        return F.concat(F.lit("<urn:capture:"), page, F.lit(":"), F.col("unique"), F.lit(f":{what}>"))

    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    head = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}")
    http = F.lit("application/http; msgtype=response")
    target = ("WARC-Target-URI", clean)
    response = _record("response", name("main"), [target, ("WARC-Payload-Digest", digest), ("Content-Type", http)], F.concat(head, F.col("payload")))
    refers = F.concat(F.lit("<urn:payload:"), F.col("first").cast("string"), F.lit(":"), F.col("digest"), F.lit(">"))
    profile = F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    revisit = _record("revisit", name("main"), [target, ("WARC-Payload-Digest", digest), ("WARC-Profile", profile), ("WARC-Refers-To", refers), ("Content-Type", http)], head)
    ask = F.concat(F.lit("GET "), clean, F.lit(f" HTTP/1.1{CRLF}{CRLF}"))
    request = _record("request", name("request"), [target, ("WARC-Concurrent-To", name("main")), ("Content-Type", F.lit("application/http; msgtype=request"))], ask)
    notes = F.concat(F.lit("page_id: "), page, F.lit(CRLF))
    metadata = _record("metadata", name("metadata"), [target, ("WARC-Concurrent-To", name("main")), ("Content-Type", F.lit("application/warc-fields"))], notes)
    records = F.explode(F.array(F.when(F.col("first").isNull(), response).otherwise(revisit), request, metadata)).alias("value")
    for folder, some, each in (("some", F.col("size") <= BIG, min(PER_FILE, FILE // BIG)), ("big", F.col("size") > BIG, max(1, FILE // max(1, most)))):
        own = rows.where(some) if folder == "some" or most > BIG else rows.limit(0)
        own.select(records).write.mode("overwrite").option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", 3 * each).text(f"{path}/{folder}")


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, plain or gzip (also of several members), unpacked piece by piece."""
    data = bytearray()
    pieces = _unpacked(content)

    def fill(n: int) -> bool:
        while len(data) < n:
            more = next(pieces, None)
            if more is None:
                return False
            data.extend(more)
        return True

    while True:
        while fill(1) and data[0] in b"\r\n":
            del data[:1]
        if not data:
            return
        while (end := data.find(b"\r\n\r\n")) < 0:
            if not fill(len(data) + 1):
                raise ValueError("the archive ends within a header")
        lines = bytes(data[:end]).decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(headers["content-length"])
        if not fill(end + 4 + size):
            raise ValueError("the archive ends within a record")
        block = bytes(data[end + 4 : end + 4 + size])
        del data[: end + 4 + size]
        yield headers, block


def _unpacked(content: bytes) -> Iterator[bytes]:
    if content[:2] != b"\x1f\x8b":
        yield from (content[i : i + PIECE] for i in range(0, len(content), PIECE))
        return
    rest = content
    while rest:
        member = zlib.decompressobj(31)
        while rest and not member.eof:
            yield member.decompress(rest, PIECE)
            rest = member.unconsumed_tail or member.unused_data
        rest = rest.lstrip(b"\0")


RECORD = "record_type string, record_id string, concurrent_to string, target_uri string, refers_to string, header_digest string, payload_bytes long, payload_digest string, payload binary"


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record under `path`; payload is the block less the HTTP head, null unless `with_payload`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [*[pa.string()] * 6, pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for h, block in parse(content.as_buffer().to_pybytes() if content.is_valid else b""):
                    body = block.split(b"\r\n\r\n", 1)[-1] if h.get("content-type", "").startswith("application/http") else block
                    rows.append((h.get("warc-type"), h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, len(body), hashlib.sha1(body).hexdigest(), body if with_payload else None))
                    size += len(body) * with_payload + 500
                    if size >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (page_id, main, request, metadata), the last two joined through WARC-Concurrent-To.

    A capture without a request or metadata has null there; of several of one kind the smallest record id stays.
    """
    part = [c for c in records.columns if c != "concurrent_to"]
    main = records.where(F.col("record_type").isin("response", "revisit")).select(F.col("record_id").alias("_id"), F.struct(*part).alias("main"))

    def beside(kind: str) -> DataFrame:
        own = records.where((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull())
        return own.groupBy(F.col("concurrent_to").alias("_id")).agg(F.min_by(F.struct(*part), "record_id").alias(kind))

    out = main.join(beside("request"), "_id", "left").join(beside("metadata"), "_id", "left")
    page = F.regexp_extract("_id", "^<urn:capture:([0-9-]+):", 1)
    return out.select(F.when(page != "", page.cast("long")).alias("page_id"), "main", "request", "metadata")


def archived(spark: SparkSession, pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes `pages` as an archive, reads it back and returns (page_id, payload_bytes, payload_digest, record_type, refers_to, has_request, has_metadata).

    Length and digest of a revisit are those of the record it refers to.
    """
    path = path or working_dir(spark, "warc")
    write(pages, path)
    records = cut(read(spark, path, with_payload=False).drop("payload"))  # the archive is parsed once
    found = cut(assemble(records).withColumns({"has_request": F.col("request").isNotNull(), "has_metadata": F.col("metadata").isNotNull()}).select("page_id", "main.*", "has_request", "has_metadata"))
    first = F.regexp_extract("refers_to", "^<urn:payload:([0-9-]+):", 1)
    found = found.withColumn("refers_to", F.when(first != "", first.cast("long")))
    stored = found.where("record_type = 'response' AND header_digest = payload_digest").groupBy(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest")).agg(F.max("payload_bytes").alias("_bytes"))
    out = found.join(stored, (F.col("record_type") == "revisit") & (F.col("refers_to") == F.col("_page")) & (F.col("header_digest") == F.col("_digest")), "left")
    revisit = F.col("record_type") == "revisit"
    return out.select("page_id", F.when(revisit, F.col("_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(revisit, F.col("_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to", "has_request", "has_metadata")
