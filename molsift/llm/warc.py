"""Operator 7: WARC archives with a two-level capture index."""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from molsift.session import ensure_checkpoint_dir, hint_if_small, materialise

CRLF = "\r\n"
HTTP_HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
RECORD_SCHEMA = ("file string, offset long, length long, page_id string, uri string, record_type string, "
                 "payload_bytes long, payload_digest string, refers_to string")
FIELD = re.compile(rb"^([A-Za-z-]+): ?([^\r\n]*)", re.M)


def clean_url(url: Column) -> Column:
    """The URL as a header can hold it: controls and blanks percent-coded."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7F]", "%20")


def surt(url: str) -> str:
    """Sort key of a URL: host names reversed, then path and query."""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return ")" + url
    if not host:
        return ")" + url.partition("#")[0]
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")"
    return key + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", body: str = "html",
                   min_payload: int = 100, file_bytes: int = 16 << 20, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row into WARC files of about ``file_bytes`` each.

    Files hold so many records as the mean record size allows for.
    Of rows with equal payloads of at least ``min_payload`` bytes the one with
    the smallest key is a response, the others are revisits that name it; equal
    rows of the smallest key are all responses. Digests and keys alone are
    shuffled to find that; payloads move once, by key, into the files.
    """
    spark = pages.sparkSession
    p = pages.select(pages[key].alias("k"), clean_url(pages[url]).alias("u"), F.coalesce(pages[body], F.lit("")).alias("h"))
    p = p.withColumn("n", F.octet_length("h").cast("long")).withColumn("d", F.sha2("h", 256))
    facts = materialise(p.select("k", "n", "d"), "warc-facts")
    mean = facts.agg(F.avg(F.col("n") + 512)).first()[0] or 512
    first = (facts.filter(F.col("n") >= min_payload).groupBy("d").agg(F.min("k").alias("r"), F.count("*").alias("c"))
             .filter((F.col("c") > 1) & F.col("r").isNotNull()))
    again = (facts.join(first, "d").filter(~F.col("k").eqNullSafe(F.col("r")))
             .select(F.col("k").alias("rk"), F.col("d").alias("rd"), "r").distinct())
    again = hint_if_small(materialise(again, "warc-again"))
    p = p.join(again, p.k.eqNullSafe(again.rk) & (p.d == again.rd), "left")
    revisit = F.col("r").isNotNull()
    block = F.concat(F.lit(HTTP_HEAD), F.when(revisit, "").otherwise(F.col("h")))
    fields = [("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
              ("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("k").cast("string"), F.lit("")), F.lit(">"))),
              ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("u")),
              ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("d"))),
              ("X-Payload-Bytes", F.col("n").cast("string")), ("Content-Type", F.lit("application/http; msgtype=response")),
              ("Content-Length", F.octet_length(block).cast("string"))]
    head = F.concat(F.lit("WARC/1.1"), *[F.concat(F.lit(f"{CRLF}{name}: "), value) for name, value in fields])
    also = F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                                          f"{CRLF}WARC-Refers-To: <urn:page:"), F.col("r").cast("string"), F.lit(">"))).otherwise("")
    # The text writer ends each value by "\n": the last character of a record.
    record = F.concat(head, also, F.lit(CRLF + CRLF), block, F.lit(CRLF + "\r"))
    (p.select(record.alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", max(1, int(file_bytes // mean))).text(path))


def parse_record(data: bytes, start: int) -> tuple[dict, int, int, int] | None:
    """Header fields, and where the block starts, ends and the next record starts; None at the end."""
    if start >= len(data):
        return None
    head_end = data.index(b"\r\n\r\n", start)
    fields = {k.decode().lower(): v.decode() for k, v in FIELD.findall(data, start, head_end)}
    body = head_end + 4
    stop = body + int(fields["content-length"])
    return fields, body, stop, stop + 4


def record_row(data: bytes, file: str, base: int, start: int) -> tuple[tuple, int] | None:
    """A record as a row of RECORD_SCHEMA, its payload digest computed from its payload."""
    got = parse_record(data, start)
    if got is None:
        return None
    f, body, stop, after = got
    payload = data[data.index(b"\r\n\r\n", body, stop) + 4:stop]
    kind, digest, n = f["warc-type"], f["warc-payload-digest"].removeprefix("sha256:"), int(f["x-payload-bytes"])
    if kind == "response":
        digest, n = hashlib.sha256(payload).hexdigest(), len(payload)
    ids = [x[len("<urn:page:"):-1] if x else None for x in (f["warc-record-id"], f.get("warc-refers-to"))]
    return (file, base + start, after - start, ids[0] or None, f["warc-target-uri"], kind, n, digest, ids[1]), after


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


RECORD_NAMES = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
RECORD_KINDS = [pa.int64() if c.split()[1] == "long" else pa.string() for c in RECORD_SCHEMA.split(", ")]


def scan_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``, file after file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0), b.column(1)):
                data, at, rows = content.as_py(), 0, []
                while (got := record_row(data, file.as_py(), 0, at)) is not None:
                    rows.append(got[0])
                    at = got[1]
                yield _batch(rows, RECORD_NAMES, RECORD_KINDS)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD_SCHEMA)


def write_index(records: DataFrame, path: str, block_rows: int = 512) -> None:
    """Sort captures by URL key into compressed blocks, and keep a sparse directory.

    ``path``/blocks holds (block, first_key, data), data a compressed list of
    ``block_rows`` captures; ``path``/directory the first key of each block.
    """
    spark = records.sparkSession

    def keyed(batches):
        for b in batches:
            keys = [surt(u) for u in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *b.columns[1:]], names=["key", "page_id", "file", "offset", "length"])

    def packed(batches):
        part, seq, rows = None, 0, []

        def block():
            text = "\n".join("\t".join(r) for r in rows)
            return [(part, seq, rows[0][0], zlib.compress(text.encode(), 6))]

        names, kinds = ["part", "seq", "first_key", "data"], [pa.int32(), pa.int64(), pa.string(), pa.binary()]
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns]):
                part = r[5]
                rows.append((r[0], r[1] or "", r[2], str(r[3]), str(r[4])))
                if len(rows) == block_rows:
                    yield _batch(block(), names, kinds)
                    seq, rows = seq + 1, []
        if rows:
            yield _batch(block(), names, kinds)

    captures = materialise(records.select("uri", "page_id", "file", "offset", "length").mapInArrow(
        keyed, "key string, page_id string, file string, offset long, length long"), "warc-captures")
    order = ["key", "page_id", "file", "offset"]
    blocks = (captures.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
              .mapInArrow(packed, "part int, seq long, first_key string, data binary"))
    blocks = materialise(blocks, "warc-blocks")
    counts = blocks.groupBy("part").agg(F.count("*").alias("c"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("off"))
    numbered = blocks.join(offsets, "part").select((F.col("off") + F.col("seq")).alias("block"), "first_key", "data")
    numbered.write.parquet(f"{path}/blocks")
    spark.read.parquet(f"{path}/blocks").select("block", "first_key").write.parquet(f"{path}/directory")


def look_up(spark: SparkSession, index: str, wanted: DataFrame, segments: int = 4096) -> DataFrame:
    """Captures of ``wanted`` (uri, page_id): file, offset, length, once per capture.

    The directory is cut into at most ``segments`` segments, whose first keys
    (so many at most) are all that travels with the tasks. A binary search
    there names the segment, one in the segment the block, one in the unpacked
    block the captures. Segments and blocks meet their look-ups in one stream,
    sorted so that each comes before its look-ups; a task holds one of them.
    """
    directory = spark.read.parquet(f"{index}/directory")
    blocks = directory.count()
    if not blocks:
        return spark.createDataFrame([], "file string, offset long, length long")
    fan = -(-blocks // segments)
    heads = [r[0] for r in directory.filter(F.col("block") % fan == 0).orderBy("block").select("first_key").collect()]
    ask = wanted.select("uri", F.coalesce("page_id", F.lit("")).alias("page_id")).distinct()

    def spread(firsts: list[str], key: str) -> range:
        return range(max(0, bisect.bisect_left(firsts, key) - 1), max(1, bisect.bisect_right(firsts, key)))

    kinds = [pa.int64(), pa.string(), pa.string()]
    schema = "at long, key string, page_id string"

    def to_segment(batches):
        for b in batches:
            rows = [(s, k, p) for u, p in zip(*[c.to_pylist() for c in b.columns]) for k in [surt(u)] for s in spread(heads, k)]
            yield _batch(rows, ["at", "key", "page_id"], kinds)

    def to_block(batches):
        firsts, base = [], 0
        for b in batches:
            rows = []
            for _, k, p, f, start in zip(*[c.to_pylist() for c in b.columns]):
                if f is not None:
                    firsts, base = f, start
                else:
                    rows += [(base + i, k, p) for i in spread(firsts, k)]
            yield _batch(rows, ["at", "key", "page_id"], kinds)

    def to_capture(batches):
        keys, entries = [], []
        for b in batches:
            rows = []
            for _, k, p, data in zip(*[c.to_pylist() for c in b.columns]):
                if data is not None:
                    entries = [line.split("\t") for line in zlib.decompress(data).decode().split("\n")]
                    keys = [(e[0], e[1]) for e in entries]
                else:
                    for i in range(bisect.bisect_left(keys, (k, p)), bisect.bisect_right(keys, (k, p))):
                        rows.append((entries[i][2], int(entries[i][3]), int(entries[i][4])))
            yield _batch(rows, ["file", "offset", "length"], [pa.string(), pa.int64(), pa.int64()])

    listed = (directory.groupBy(F.expr(f"block div {fan}").alias("at")).agg(F.sort_array(F.collect_list(F.struct("block", "first_key"))).alias("l"))
              .select("at", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("page_id"),
                      F.col("l.first_key").alias("firsts"), (F.col("at") * fan).alias("base")))
    asked = ask.mapInArrow(to_segment, schema)
    asked = asked.select("*", F.lit(None).cast("array<string>").alias("firsts"), F.lit(None).cast("long").alias("base"))
    found = (listed.unionByName(asked).repartition("at").sortWithinPartitions("at", F.col("firsts").isNull(), "key")
             .mapInArrow(to_block, schema))
    packs = spark.read.parquet(f"{index}/blocks").select(F.col("block").alias("at"), F.lit(None).cast("string").alias("key"),
                                                         F.lit(None).cast("string").alias("page_id"), "data")
    found = found.select("*", F.lit(None).cast("binary").alias("data"))
    return (packs.unionByName(found).repartition("at").sortWithinPartitions("at", F.col("data").isNull(), "key")
            .mapInArrow(to_capture, "file string, offset long, length long"))


def read_ranges(spark: SparkSession, archives: str, ranges: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """Records at the given (file, offset, length), cut out of the archives by range.

    Ranges are gathered per file, whose size bounds them; each file wanted is
    opened once. The gathered ranges are broadcast only up to ``broadcast_rows``
    of them, and shuffled with the files beyond.
    """
    ranges = materialise(ranges, "warc-ranges")
    per_file = ranges.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("r"))
    if ranges.limit(broadcast_rows + 1).count() <= broadcast_rows:
        per_file = F.broadcast(per_file)
    files = spark.read.format("binaryFile").load(archives).select("path", "content")
    wanted = files.join(per_file, F.col("path") == F.col("file")).select("file", "content", "r")

    def run(batches):
        for b in batches:
            for file, content, r in zip(b.column(0), b.column(1), b.column(2)):
                data = memoryview(content.as_buffer())
                rows = [record_row(bytes(data[x["offset"]:x["offset"] + x["length"]]), file.as_py(), x["offset"], 0)[0] for x in r.as_py()]
                yield _batch(rows, RECORD_NAMES, RECORD_KINDS)

    return wanted.mapInArrow(run, RECORD_SCHEMA)


def archive_and_read(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", path: str | None = None,
                     block_rows: int = 512, file_bytes: int = 16 << 20) -> DataFrame:
    """Write pages to WARC files, index them, and read every page back through the index.

    Returns one row per input row: ``key``, payload_bytes, payload_digest,
    record_type and refers_to, as found in the records; a response's size and
    digest are computed anew from the payload read. Files go to ``path``, a
    folder of the shared folder unless given.

    A null page is an empty payload (always a response); a null URL has the
    empty key; a null key is a record without number, and a revisit of the
    smallest key if its payload equals one; repeated rows are records each; an
    empty table gives no rows. Other columns are not read.
    """
    spark = pages.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/molsift/warc-{uuid.uuid4().hex}"
    kind = dict(pages.dtypes)[key]
    write_archives(pages, f"{path}/archives", key, url, body, file_bytes=file_bytes)
    write_index(scan_archives(spark, f"{path}/archives"), f"{path}/index", block_rows)
    wanted = pages.select(clean_url(pages[url]).alias("uri"), pages[key].cast("string").alias("page_id"))
    records = read_ranges(spark, f"{path}/archives", look_up(spark, f"{path}/index", wanted))
    return records.select(F.col("page_id").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type",
                          F.col("refers_to").cast(kind).alias("refers_to"))
