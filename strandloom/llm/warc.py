"""WARC archives: a writer and a reader that assembles transactions.

Writing: each page gives a request, a response (or a revisit of the record with the same payload) and a
metadata record, bound by WARC-Concurrent-To. Records are rows of text, written by Spark's own text
writer (gzip, one member a file) with the record separator as line separator, so archives go wherever Spark can write.
Of equal payloads that are long enough, the row with the largest key is the response. Digests of payloads say which are equal: they are
pre-aggregated and joined in salts, and only rows that share a payload with others are joined with the pages.

Reading: archives are read as whole files, which are bounded, as pages of similar size go together and a file holds so many as make 64 MB, or one page.
Records are cut by their Content-Length, never by searching in payloads. They are parsed once and kept without payloads; request, response or revisit,
and metadata records are joined through the ids they name as concurrent, giving one nested row per capture.

Null payloads count as empty; a null url is written as urn:absent. Every row has a record and a capture of its own. Record ids are made of the
key, a hash of the row and the number of the copy, so keys may repeat, be null (then the metadata have no pageId), and rows may be
there many times: of equal rows the first copy alone can be the response. A payload that only rows without a key have is the response of one
of them. Payloads may hold any text, record headers included. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialised, shared_folder

END = "\r\n\r\n"
DATE = "2026-01-01T00:00:00Z"
#: Sizes of payloads from and below which pages are archived together, and so many of them to a file: 64 MB at most, or one page.
SIZES = ((0, 1 << 16, 1000), (1 << 16, 1 << 20, 64), (1 << 20, 1 << 24, 4), (1 << 24, 1 << 62, 1))
#: Tasks over which the rows of one digest are dealt, and copies of one row that are numbered in one go.
SALTS, COPIES = 32, 10_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_type string, record_id string, concurrent_to string, target_uri string, refers_to string, digest string, content_type string, block_bytes long, payload_bytes long, payload binary, fields string"


def base32(hexed):
    """Column: hexadecimal SHA-1 as upper-case base32, ten hex digits as eight letters."""
    digits = F.concat(*(F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _rows(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """id, uri, body, bytes and rk (hash of all of them) of every page; rows with one id and rk are copies of one row."""
    rows = pages.select(pages[key].cast("long").alias("id"), F.coalesce(pages[url], F.lit("urn:absent")).alias("uri"), F.coalesce(pages[payload], F.lit("")).alias("body"))
    return rows.withColumn("bytes", F.octet_length("body").cast("long")).withColumn("rk", F.xxhash64("id", "uri", "body"))


def _salted(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """rows left joined with table, which has one row for each key at most; the rows of one key (with rk) are dealt over SALTS tasks."""
    dealt = rows.withColumn("_s", F.pmod("rk", F.lit(SALTS)).cast("int"))
    return dealt.join(table.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "_s"], "left").drop("_s")


def digests(rows: DataFrame) -> DataFrame:
    """(id, rk, bytes, sha, copies) of rows as _rows gives them: what is needed to find equal payloads without moving them."""
    narrow = rows.select("id", "rk", "bytes", F.sha1(F.encode("body", "utf-8")).alias("sha"))
    return narrow.groupBy("id", "rk", "bytes", "sha").agg(F.count("*").alias("copies"))


def shared(one: DataFrame, least: int = 0) -> DataFrame:
    """(id, rk, bytes, copies, best_id, best_rk) of rows that are there more than once or whose payload others have too; best is the row
    that is the response for the payload: the largest id, a null one last."""
    best = one.where(F.col("bytes") >= least).groupBy("sha").agg(F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "rk")).alias("best"), F.sum("copies").alias("n")).where("n > 1").drop("n")
    both = _salted(one, best, ["sha"]).where("best is not null or copies > 1")
    return both.select("id", "rk", "bytes", "copies", F.col("best.id").alias("best_id"), F.col("best.rk").alias("best_rk"))


def records(rows: DataFrame, marks: DataFrame, least: int = 0) -> DataFrame:
    """A row with column value, a WARC record without its separator, for each record of rows (as _rows gives them; marks as shared does)."""
    m = marks.select(F.col("id").alias("i"), F.col("rk").alias("r"), "copies", "best_id", "best_rk")
    joined = rows.join(m, F.col("id").eqNullSafe(F.col("i")) & (F.col("rk") == F.col("r")), "left").drop("i", "r").withColumn("sha", F.sha1(F.encode("body", "utf-8")))
    if marks.where("copies > 1").limit(1).count():  # copies of one row: once with the payload, then numbered
        many = joined.where("copies > 1").groupBy("id", "rk").agg(F.first(F.struct("uri", "body", "bytes", "sha", "copies", "best_id", "best_rk")).alias("x")).select("id", "rk", "x.*")
        part = many.withColumn("p", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})"))).withColumn("body", F.when((F.col("p") == 0) | (F.col("bytes") < least), F.col("body")))
        part = part.repartition(F.col("id"), F.col("rk"), F.col("p"))
        numbered = part.withColumn("copy", F.explode(F.expr(f"sequence(p * {COPIES}, least(copies, (p + 1) * {COPIES}) - 1)")))
        joined = joined.where("copies is null or copies = 1").withColumn("copy", F.lit(0).cast("long")).unionByName(numbered.select(*joined.columns, "copy"))
    else:
        joined = joined.withColumn("copy", F.lit(0).cast("long"))
    is_best = F.col("id").eqNullSafe(F.col("best_id")) & (F.col("rk") == F.col("best_rk")) & (F.col("copy") == 0)
    revisit = F.col("best_rk").isNotNull() & ~is_best
    named = lambda kind, i, r, k: F.concat(F.lit(f"<urn:page:{kind}:"), F.coalesce(i.cast("string"), F.lit("none")), F.lit(":"), F.hex(r), F.lit(":"), k, F.lit(">"))
    urn = lambda kind: named(kind, F.col("id"), F.col("rk"), F.col("copy").cast("string"))
    uri = F.regexp_replace("uri", r"[\r\n]", "%0A")

    def record(kind, fields: dict, block):
        head = {"WARC-Type": kind, "WARC-Date": F.lit(DATE), **fields, "Content-Length": F.octet_length(block).cast("string")}
        parts = [F.lit("WARC/1.1\r\n")]
        for name, value in head.items():
            parts.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
        return F.concat(*parts, F.lit("\r\n"), block)

    digest = F.concat(F.lit("sha1:"), base32(F.col("sha")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    main = record(
        F.when(revisit, "revisit").otherwise("response"),
        {
            "WARC-Record-ID": urn("capture"), "WARC-Target-URI": uri, "WARC-Payload-Digest": digest,
            "WARC-Profile": F.when(revisit, REVISIT), "WARC-Refers-To": F.when(revisit, named("capture", F.col("best_id"), F.col("best_rk"), F.lit("0"))), "Content-Type": F.lit("application/http;msgtype=response"),
        },
        F.concat(http, F.when(revisit, "").otherwise(F.col("body"))),
    )
    concurrent = {"WARC-Concurrent-To": urn("capture"), "WARC-Target-URI": uri}
    request = record(F.lit("request"), {"WARC-Record-ID": urn("request"), **concurrent, "Content-Type": F.lit("application/http;msgtype=request")}, F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1" + END)))
    about = record(F.lit("metadata"), {"WARC-Record-ID": urn("metadata"), **concurrent, "Content-Type": F.lit("application/warc-fields")}, F.concat(F.coalesce(F.concat(F.lit("pageId: "), F.col("id").cast("string"), F.lit("\r\n")), F.lit("")), F.lit("payloadBytes: "), F.col("bytes").cast("string"), F.lit("\r\n")))
    return joined.select(F.explode(F.array(request, main, about)).alias("value"))


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> None:
    """Archives of all pages below path, in a folder for each class of payload sizes, so that a file's bytes are bounded."""
    rows = _rows(pages, key, url, payload)
    one = materialised(digests(rows))
    marks = materialised(shared(one, least))
    longest = one.agg(F.max("bytes")).first()[0] or 0
    sizes = [x for x in SIZES if longest >= x[0]]
    for low, high, each in sizes:
        inside = F.lit(True) if len(sizes) == 1 else (F.col("bytes") >= low) & (F.col("bytes") < high)
        out = records(rows.where(inside), marks.where(inside), least)
        out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 3 * each).text(f"{path}/from_{low}")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], int, int]]:
    """(headers, start and end of the block) of each record of an archive."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        head = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            head[name.decode().strip().lower()] = value.decode().strip()
        start = end + 4
        at = start + int(head["content-length"])
        yield head, start, at


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    names = [x.split()[0] for x in RECORD.split(", ")]
    for batch in batches:
        for content in batch.column(0):
            data = content.as_py()
            if data[:2] == b"\x1f\x8b":
                out, rest = [], data
                while rest:  # members, of which there may be several
                    stream = zlib.decompressobj(31)
                    out.append(stream.decompress(rest))
                    rest = stream.unused_data
                data = b"".join(out)
            held: list[tuple] = []
            size = 0
            for head, start, end in parse(data):
                kind = head.get("warc-type")
                payload = digest = fields = None
                if kind in ("response", "revisit"):
                    body = data.index(b"\r\n\r\n", start, end) + 4
                    if kind == "response":
                        payload = data[body:end]
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    else:
                        digest = head["warc-payload-digest"].partition(":")[2]
                elif kind == "metadata":
                    fields = data[start:end].decode()
                held.append((kind, head["warc-record-id"], head.get("warc-concurrent-to"), head.get("warc-target-uri"), head.get("warc-refers-to"), digest, head.get("content-type"), end - start, None if payload is None else len(payload), payload, fields))
                size += end - start
                if size > 1 << 23:
                    yield _batch(held, names)
                    held, size = [], 0
            if held:
                yield _batch(held, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string()] * 7 + [pa.int64(), pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below path."""
    return map_batches(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content"), _read, RECORD)


def captures(rows: DataFrame, payloads: DataFrame | None = None) -> DataFrame:
    """One nested row per capture: target_uri, main (response or revisit), request, metadata, and of a revisit original (record_id,
    payload_bytes). rows are read twice or more; payloads (record_id, payload) are added to main if given."""
    head = ["record_type", "record_id", "digest", "refers_to", "content_type", "payload_bytes"]
    part = lambda kind, *more: F.max(F.when(F.col("record_type") == kind, F.struct("record_id", "content_type", "block_bytes", *more)))
    side = rows.where(F.col("record_type").isin("request", "metadata")).groupBy(F.col("concurrent_to").alias("record_id")).agg(part("request").alias("request"), part("metadata", "fields").alias("metadata"))
    each = rows.where(F.col("record_type").isin("response", "revisit")).select("target_uri", *head).join(side, "record_id", "left")
    # a response that many refer to: its revisits are dealt
    wanted = rows.where("record_type = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct()
    first = rows.where("record_type = 'response'").select("record_id", "payload_bytes").join(wanted, "record_id", "left_semi")
    first = first.select(F.col("record_id").alias("refers_to"), F.struct("record_id", "payload_bytes").alias("original"))
    revisits = _salted(each.where("record_type = 'revisit'").withColumn("rk", F.xxhash64("record_id")), first, ["refers_to"])
    responses = each.where("record_type = 'response'")
    if payloads is None:
        responses, revisits = responses.withColumn("payload", F.lit(None).cast("binary")), revisits.withColumn("payload", F.lit(None).cast("binary"))
    else:
        responses, revisits = responses.join(payloads, "record_id", "left"), revisits.withColumn("payload", F.lit(None).cast("binary"))
        head = [*head, "payload"]
    out = responses.withColumn("original", F.lit(None).cast(first.schema["original"].dataType)).unionByName(revisits.drop("rk"))
    return out.select("target_uri", F.struct(*head).alias("main"), "request", "metadata", "original")


def archived(pages: DataFrame, with_payload: bool = True, **options) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back as captures."""
    spark = pages.sparkSession
    path = shared_folder(spark)
    write(pages, path, **options)
    rows = materialised(read_records(spark, path).drop("payload"))
    payloads = read_records(spark, path).where("record_type = 'response'").select("record_id", "payload") if with_payload else None
    return captures(rows, payloads)
