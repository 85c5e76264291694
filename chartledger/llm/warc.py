"""WARC archives: write pages as records, and read archives back, damaged ones too.

The writer makes plain WARC/1.1 files by Spark's text writer: a record's header and payload are a
row, and the two line ends that close a record are the row separator. Each task rolls over to a
new archive after a number of records, so archives stay near a target size.

The reader takes an archive per row and salvages. It reads records in order, plain or as gzip
members, and checks each: header syntax, length, the closing line ends, and the digest of the
payload. After a failed check it searches for the next place where a member or a version line
starts and a whole record passes its checks, goes on from there, and logs the bytes between as
quarantined.
"""

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartledger.llm.common import scratch_path, text_or_empty, written

# Payloads below this many bytes are always stored.
DEDUP_BYTES = 100
ARCHIVE_BYTES = 16_000_000

_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_CLOSE = b"\r\n\r\n"


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to.

    Of payloads that occur several times and have 100 bytes or more, the smallest page_id is the
    response that the others refer to. Only digests are grouped; a group of any size sends one
    row a task, and its members meet one row in a join that can be split.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        text_or_empty("html").alias("html"))
    told = rows.withColumns({
        "payload_bytes": F.octet_length("html").cast("long"),
        "payload_digest": F.sha2(F.col("html").cast("binary"), 256)})
    repeated = told.filter(F.col("payload_bytes") >= DEDUP_BYTES).groupBy("payload_digest").agg(
        F.min("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1")
    same = told.select("page_id", "payload_digest").join(
        repeated.drop("n"), "payload_digest").filter("page_id IS NULL OR page_id != original")
    refers = written(same.select(
        F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"),
        "original").distinct(), "revisits")
    on = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest"))
    return told.join(refers, on, "left").drop("_page", "_digest").withColumnRenamed(
        "original", "refers_to")


def records(pages: DataFrame) -> DataFrame:
    """One text per page: the WARC record without its closing line ends."""
    response = F.col("refers_to").isNull()
    length = F.when(response, F.col("payload_bytes")).otherwise(F.lit(0))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    # A line end in a url would end the header field.
    url = F.regexp_replace("url", r"[\r\n]+", " ")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(response, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), page, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes")),
        F.when(~response, F.concat(
            F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to"), F.lit(">"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    header = F.concat_ws("\r\n", *lines)
    payload = F.when(response, F.col("html")).otherwise(F.lit(""))
    return pages.select(F.concat(header, F.lit("\r\n\r\n"), payload).alias("record"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the pages to plain WARC files of about ``archive_bytes`` under ``path``."""
    rows = records(with_originals(pages))
    size = pages.agg(F.avg(F.octet_length(text_or_empty("html")))).first()[0] or 0
    per_file = max(1, int(archive_bytes / (size + 500)))
    rows.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(path)


def _record(data: bytes, at: int) -> tuple[int, dict, bytes] | str:
    """The plain record at a place (end, header, payload), or what is wrong with it."""
    if not _VERSION.match(data, at):
        return "no version line"
    close = data.find(_CLOSE, at)
    if close < 0:
        return "header without end"
    if _VERSION.search(data, at + 1, close):
        return "header broken off by another record"
    header = {}
    for line in data[at:close].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "header line without colon"
        header[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not header.get("content-length", "").isdigit():
        return "no content length"
    start = close + len(_CLOSE)
    end = start + int(header["content-length"])
    if data[end:end + len(_CLOSE)] != _CLOSE:
        return "length does not meet the record's end"
    payload = data[start:end]
    told = header.get("warc-payload-digest", "")
    if header.get("warc-type") != "revisit" and told.startswith("sha256:") \
            and hashlib.sha256(payload).hexdigest() != told[7:]:
        return "payload digest differs"
    return end + len(_CLOSE), header, payload


def _member(data: bytes, at: int) -> tuple[int, dict, bytes] | str:
    """The gzip member at a place, holding one record."""
    tool = zlib.decompressobj(31)
    try:
        inner = tool.decompress(memoryview(data)[at:])
    except zlib.error as e:
        return f"gzip: {e}"
    if not tool.eof:
        return "gzip member without end"
    found = _record(inner, 0)
    if isinstance(found, str):
        return found
    if found[0] != len(inner):
        return "member holds more than a record"
    return len(data) - len(tool.unused_data), found[1], found[2]


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, bytes, str]]:
    """Records and gaps of an archive: from, to, header (None: a gap), payload, what was wrong."""
    at, gap, reason = 0, -1, ""
    while at < len(data):
        found = _member(data, at) if data[at:at + 3] == _MEMBER else _record(data, at)
        if isinstance(found, str):
            if gap < 0:
                gap, reason = at, found
            member, line = data.find(_MEMBER, at + 1), _VERSION.search(data, at + 1)
            next_places = [p for p in (member, line.start() if line else -1) if p >= 0]
            at = min(next_places) if next_places else len(data)
            continue
        if gap >= 0:
            yield gap, at, None, b"", reason
            gap = -1
        yield at, found[0], found[1], found[2], ""
        at = found[0]
    if gap >= 0:
        yield gap, len(data), None, b"", reason


def _page(value: str | None) -> str | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return m[1] if m else None


SCHEMA = ("archive string, first long, last long, gap string, page_id long, url string, "
          "record_type string, refers_to long, payload_bytes long, payload_digest string, "
          "payload binary")


def _read_batches(keep: bool):
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for first, last, header, payload, wrong in salvage(bytes(content)):
                    if header is None:
                        rows.append((path, first, last, wrong, *[None] * 7))
                        continue
                    kind = header.get("warc-type")
                    if kind == "revisit":
                        size = header.get("x-payload-length")
                        digest = header.get("warc-payload-digest", "").removeprefix("sha256:")
                    else:
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    rows.append((path, first, last, None, _page(header.get("warc-record-id")),
                                 header.get("warc-target-uri"), kind,
                                 _page(header.get("warc-refers-to")), size, digest,
                                 payload if keep else None))
                    if len(rows) == 5_000:
                        yield _frame(rows, names)
                        rows = []
                yield _frame(rows, names)

    return run


def _frame(rows: list, names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    for c in ("first", "last", "page_id", "refers_to", "payload_bytes"):
        out[c] = pd.array([None if v is None else int(v) for v in out[c].astype(object).where(
            out[c].notna(), None)], dtype="Int64")
    return out


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record and per quarantined gap of all archives under ``path``.

    A gap has its byte range and reason, and nulls in all else. A task holds one archive; keep
    archives in the size that ``write_archives`` makes. Empty archives give no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.filter("length > 0").select("path", "content")
    return rows.mapInPandas(_read_batches(payloads), SCHEMA)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder and read their records back.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to. Null html is an empty
    payload, a null url an empty one, a null page_id stays null (and never is the smallest).
    Repeated rows are records each; of rows that share the smallest page_id too, all are
    responses. An empty table gives an empty result. Other columns are not read.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    found = read_archives(pages.sparkSession, path, payloads=False)
    lost = F.raise_error(F.concat(F.lit("quarantined bytes in "), F.col("archive")))
    return found.select(
        "page_id", "payload_bytes", "payload_digest",
        F.when(F.col("gap").isNull(), F.col("record_type")).otherwise(lost).alias("record_type"),
        "refers_to")
