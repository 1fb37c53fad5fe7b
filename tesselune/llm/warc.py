"""WARC records, and what a "not modified" revisit stands for.

``resolve_revisits`` is an as-of join by canonical URL, in DataFrame functions: each revisit of the profile
server-not-modified meets the latest earlier full response of its URL; the validators must agree, and the
headers that a 304 may change replace those stored (RFC 9110, section 15.4.5; RFC 9111, section 3.2).
``read_warc`` and ``write_warc`` stream records between WARC 1.1 files and DataFrames.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, stored, tune

#: Fixed value: the revisit profile that is resolved here.
NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
#: Headers that a 304 response carries to replace those stored.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: A URL with more captures than this is cut by time, each part a window of its own.
HOT_ROWS = 50_000

RECORDS = "record_id string, type string, url string, ts long, profile string, status int, headers map<string,string>, payload binary"


def canonical_url(url: Column) -> Column:
    """Host and path in which captures agree: no scheme, user, www., default port, fragment, utm_ parameters or end slash.

    The host is lower-cased, parameters are sorted; null stays null.
    """
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "(?i)^[a-z][a-z0-9+.-]*://(?:[^/?@]*@)?", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), r":(?:80|443)$", ""), r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    given = F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")
    query = F.array_join(F.array_sort(F.filter(given, lambda p: (p != "") & ~p.rlike("(?i)^utm_"))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _weak(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve_revisits(records: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(record_id, canonical, ts, outcome, target_id, headers), a row for each not-modified revisit.

    records has record_id, type, url, ts, profile, status and headers (lower-case names). The target is the
    latest full response (type response, status 200) of the same canonical URL before the revisit in order of
    (ts, record_id). outcome: ``no_response`` without one; else, if the revisit has an ETag, ``resolved`` or
    ``changed`` as it weakly equals the target's or not; else the same by Last-Modified; ``unverified``
    with neither. headers are the target's, if resolved with the permitted ones of the revisit over them, else null.
    A null URL has no target; null headers count as none; repeated rows give repeated results; an empty table
    gives no rows; other columns are ignored. A record without ts has no place in time: a revisit meets no response,
    and a response meets no revisit. A URL of more than ``hot_rows`` captures is cut into spans of
    time, and the last response before a span is carried in from the spans' own summaries; captures of one URL
    in one same instant stay together.
    """
    tune(records.sparkSession)
    header = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    full = (F.col("type") == "response") & (F.col("status") == 200) & F.col("ts").isNotNull()
    asked = (F.col("type") == "revisit") & (F.col("profile") == NOT_MODIFIED)
    events = records.select("record_id", "ts", canonical_url(F.col("url")).alias("canonical"), F.coalesce(full, F.lit(False)).alias("full"), header.alias("headers"), F.coalesce(asked, F.lit(False)).alias("asked"))
    events = events.where("full OR asked")
    hot = stored(events.where("canonical IS NOT NULL").groupBy("canonical").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).where(F.col("n") > hot_rows))
    events = events.join(small(hot, hot.count(), 300), "canonical", "left")
    part = F.floor((F.col("ts") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1) * F.ceil(F.col("n") / hot_rows))
    events = events.withColumn("part", F.coalesce(part, F.lit(0)).cast("long")).drop("n", "lo", "hi")
    # a null URL meets nothing, so such rows need not come together
    events = events.withColumn("part", F.when(F.col("canonical").isNull(), F.xxhash64("record_id")).otherwise(F.col("part")))
    found = F.when(F.col("full") & F.col("canonical").isNotNull(), F.struct("record_id", "headers"))
    own = Window.partitionBy("canonical", "part").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    events = events.withColumn("target", F.last(found, ignorenulls=True).over(own))
    parts = events.where("canonical IS NOT NULL").join(hot.select("canonical"), "canonical", "left_semi").groupBy("canonical", "part").agg(F.max_by(found, F.when(found.isNotNull(), F.struct("ts", "record_id"))).alias("end"))
    before = Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("canonical", "part", F.last("end", ignorenulls=True).over(before).alias("carried"))
    revisits = events.where("asked").join(parts, ["canonical", "part"], "left").withColumn("target", F.coalesce("target", "carried"))
    tag, kept_tag, since, kept_since = (F.col(c)[k] for k in ("etag", "last-modified") for c in ("headers", "target.headers"))
    agrees = F.when(tag.isNotNull(), F.coalesce(_weak(tag) == _weak(kept_tag), F.lit(False))).when(since.isNotNull(), F.coalesce(since == kept_since, F.lit(False)))
    outcome = F.when(F.col("target").isNull(), "no_response").when(agrees.isNull(), "unverified").when(agrees, "resolved").otherwise("changed")
    news = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    stays = F.map_filter("target.headers", lambda k, _: ~F.array_contains(F.map_keys(news), k))
    merged = F.when(F.col("outcome") == "resolved", F.map_concat(stays, news)).otherwise(F.col("target.headers"))
    return revisits.withColumn("outcome", outcome).select("record_id", "canonical", "ts", "outcome", F.col("target.record_id").alias("target_id"), merged.alias("headers"))


def header_text(headers: Column) -> Column:
    """Headers as lines ``name: value`` in order of name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def _members(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(WARC headers, block) of each record of a plain or gzipped file, one at a time."""
    start = stream.read(2)
    joined = io.BufferedReader(_Joined(start, stream), 1 << 20)
    lines = io.BufferedReader(gzip.GzipFile(fileobj=joined), 1 << 20) if start == b"\x1f\x8b" else joined
    while line := lines.readline():
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, str] = {}
        while (line := lines.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        length = head.get("content-length", "0")
        yield head, lines.read(int(length)) if length.isascii() and length.isdigit() else b""


class _Joined(io.RawIOBase):
    """Bytes already read, then the rest of a stream."""

    def __init__(self, first: bytes, rest: io.BufferedIOBase):
        self.first, self.rest = first, rest

    def readable(self) -> bool:
        return True

    def readinto(self, into: memoryview) -> int:
        data = self.first[: len(into)] or self.rest.read(len(into))
        self.first = self.first[len(data) :] if self.first else b""
        into[: len(data)] = data
        return len(data)


def _parsed(head: dict[str, str], block: bytes) -> tuple:
    status, headers, payload = None, {}, block
    if head.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        first, *lines = top.decode("utf-8", "replace").split("\r\n")
        words = first.split(" ")
        status = int(words[1]) if len(words) > 1 and words[1].isdigit() else None
        for line in lines:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
    from datetime import datetime

    try:
        ts = int(datetime.fromisoformat(head.get("warc-date", "").replace("Z", "+00:00")).timestamp())
    except (ValueError, OverflowError):
        ts = None
    return head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), ts, head.get("warc-profile"), status, list(headers.items()), payload


_ARROW = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("ts", pa.int64()), ("profile", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def read_warc(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The records of WARC files, plain or gzipped by record; a file is a task, read as a stream.

    Paths are what ``pyarrow.fs`` opens on the executors. Header names come lower-cased; a record without an
    HTTP block has null status and no headers. A date that is none gives a null ts; after a Content-Length that
    is no number the payload is empty, and reading goes on at the next line that begins a record. An empty list
    or file gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, at = pyarrow.fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with where.open_input_stream(at, compression=None) as stream:
                    for head, block in _members(stream):
                        rows.append(_parsed(head, block))
                        held += len(block)
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    tune(spark)
    names = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return names.mapInArrow(run, RECORDS)


def write_warc(records: DataFrame, folder: str, zipped: bool = True) -> DataFrame:
    """Writes each partition's records to one WARC file under folder; (path, records) of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from datetime import UTC, datetime

        where, root = pyarrow.fs.FileSystem.from_uri(folder)
        out, n = None, 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    where.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc" + ".gz" * zipped
                    out = where.open_output_stream(f"{root}/{name}", compression=None)
                lines = [f"HTTP/1.1 {r['status'] or 0} -", *(f"{k}: {v}" for k, v in r["headers"] or ())]
                block = "\r\n".join([*lines, "", ""]).encode() + (r["payload"] or b"")
                head = {"WARC-Type": r["type"], "WARC-Record-ID": r["record_id"], "WARC-Target-URI": r["url"], "WARC-Profile": r["profile"], "Content-Type": "application/http", "Content-Length": len(block)}
                if r["ts"] is not None:
                    head["WARC-Date"] = datetime.fromtimestamp(r["ts"], UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
                text = "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in head.items() if v is not None), "", ""]).encode() + block + b"\r\n\r\n"
                out.write(gzip.compress(text) if zipped else text)
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n]})

    tune(records.sparkSession)
    return stored(records.select(*_ARROW.names).mapInArrow(run, "path string, records long"), f"{folder}/manifest")


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures as a crawl of the pages would leave them, by rule: (record_id long, ...) without payloads.

    Each page is a full response at 100 * page_id, with a not-modified revisit 50 before and 50 after it.
    Revisits of page_id % 4: 0 the page's ETag, weak; 1 another ETag; 2 its Last-Modified alone; 3 no validator.
    """
    tag, since = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"')), F.concat(F.lit("day "), F.floor(F.col("page_id") / 7).cast("string"))
    k = F.pmod("page_id", F.lit(4))
    response = {"content-type": F.lit("text/html"), "content-length": F.length(F.coalesce("html", F.lit(""))).cast("string"), "etag": tag, "last-modified": since, "cache-control": F.lit("max-age=60")}
    revisit = {"date": F.concat(F.lit("at "), F.col("page_id").cast("string")), "content-length": F.lit("0"), "cache-control": F.lit("max-age=600"), "etag": F.when(k == 0, F.concat(F.lit("W/"), tag)).when(k == 1, F.lit('"other"')), "last-modified": F.when(k == 2, since)}

    def made(headers: dict[str, Column]) -> Column:
        return F.map_filter(F.create_map(*[x for n, v in headers.items() for x in (F.lit(n), v)]), lambda _, v: v.isNotNull())

    kinds = [(0, "response", None, 200, 0, response), (1, "revisit", NOT_MODIFIED, 304, -50, revisit), (2, "revisit", NOT_MODIFIED, 304, 50, revisit)]
    rows = [
        F.struct((F.col("page_id") * 3 + n).alias("record_id"), F.lit(t).alias("type"), F.col("url"), (F.col("page_id") * 100 + d).alias("ts"), F.lit(p).alias("profile"), F.lit(s).alias("status"), made(h).alias("headers"))
        for n, t, p, s, d, h in kinds
    ]
    return pages.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
