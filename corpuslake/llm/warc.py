"""A content-addressed WARC archive.

``write_archive`` keeps two Parquet tables: ``payloads`` has the bytes of each payload once,
under the SHA-256 that was taken of them, and ``records`` has all that stands before the
payload of each record, exactly: the WARC header and the HTTP head.  ``read_archive`` joins
the two to the original records, byte by byte, and takes all it tells from these bytes.
``warc_files`` writes the records as WARC files.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, spool

CRLF = "\r\n"
#: Payloads from this size on are written once, and later records revisit them.
MIN_REVISIT_BYTES = 100
#: Records carry the date and status of the crawl, which the table doesn't have: fixed ones.
DATE, STATUS = "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What a record id begins with, for pages with an id and for those without.
PAGE, NO_PAGE = "tag:corpuslake,2024:page/", "tag:corpuslake,2024:no-page/"
#: Small payloads may belong to any number of responses; when read, each is dealt to so many tasks.
SALTS = 32


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def plan_records(pages: DataFrame, *, min_bytes: int = MIN_REVISIT_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, digest, payload_bytes, record_type, header): one row a page, no payloads.

    Of equal payloads of at least ``min_bytes`` bytes the one with the smallest id is a
    response, the others revisit it.  Digests, not payloads, are shuffled; the smallest id of
    a digest is found with a partial minimum in each task first.

    An id names a page, so rows that repeat one share its record id.  Pages without an id are
    named by their url and payload, and are a response only if no page with an id has their
    payload; where none has, all of them are.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    # an uri stays on one line of the header
    uri = F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\r\n]", "%0A")
    light = pages.select(F.col(id_col).alias("page_id"), uri.alias("uri"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    first = light.where((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first_id")).withColumnRenamed("digest", "first_digest")
    joined = light.join(first, F.col("digest") == F.col("first_digest"), "left")
    revisit = F.col("first_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    page = lambda c: F.concat(F.lit("<" + PAGE), F.url_encode(F.col(c).cast("string")), F.lit(">"))
    nameless = F.concat(F.lit("<" + NO_PAGE), F.md5(F.concat("digest", "uri")), F.lit(">"))
    http = F.concat(F.lit(STATUS + CRLF), _line("Content-Type", F.lit("text/html; charset=utf-8")), _line("Content-Length", F.col("payload_bytes").cast("string")), F.lit(CRLF))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", F.coalesce(page("page_id"), nameless)),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.col("uri")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", page("first_id")))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", length.cast("string")),
        F.lit(CRLF),
        http,
    )
    return joined.select("page_id", "digest", "payload_bytes", kind.alias("record_type"), header.alias("header"))


def write_archive(pages: DataFrame, path: str, **columns) -> None:
    """Write ``path/records`` (header, digest, record_type) and ``path/payloads`` (digest, size, packed).

    A null html is an empty payload; rows that repeat an id with an equal payload are all
    responses of that id, and the payload is still stored once.  An empty table writes two
    empty tables.  Only the three columns named are read, so no others can clash.
    """
    html_col, id_col = columns.get("html_col", "html"), columns.get("id_col", "page_id")
    small_batches(pages)
    plan_records(pages, **columns).write.parquet(f"{path}/records", compression="zstd")
    records = pages.sparkSession.read.parquet(f"{path}/records")
    # which page gives a digest its bytes.  Payloads are shuffled once, packed, dealt by digest and
    # page, so that a payload which many pages share doesn't land in one task
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    givers = records.groupBy("digest").agg(F.min("page_id").alias("giver")).select(F.col("digest").alias("giver_digest"), key("giver").alias("giver_key"))
    whole = pages.select(key(id_col).alias("page_key"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data = [t.encode("utf-8", "surrogatepass") for t in batch.column("payload").to_pylist()]
            columns = [batch.column("page_key"), pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string()), pa.array(map(len, data), pa.int64()), pa.array(map(packer.compress, data), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["page_key", "digest", "size", "packed"])

    packed = whole.mapInArrow(pack, "page_key string, digest string, size long, packed binary")
    given = packed.join(givers, (F.col("digest") == F.col("giver_digest")) & (F.col("page_key") == F.col("giver_key")))
    # a repeated row gives its bytes once
    nth = F.row_number().over(Window.partitionBy("digest", "page_key").orderBy("digest"))
    given.withColumn("nth", nth).where("nth = 1").select("digest", "size", "packed").write.parquet(f"{path}/payloads", compression="none")


@dataclass
class Record:
    """What the bytes of a record say."""

    kind: str
    record_id: str
    refers_to: str | None
    named: str  # the digest that the header names
    whole: bool  # the block is as long as the header says
    payload: bytes


def parse_record(record: bytes) -> Record:
    """Read the bytes of one record; what a header lacks is empty."""
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split(CRLF)
    fields = {k: v for k, _, v in (x.partition(": ") for x in lines[1:])}
    payload = block.partition(b"\r\n\r\n")[2]
    bare = lambda name: fields.get(name, "")[1:-1]
    whole = lines[0] == "WARC/1.1" and fields.get("Content-Length") == str(len(block))
    return Record(fields.get("WARC-Type", ""), bare("WARC-Record-ID"), bare("WARC-Refers-To") or None, fields.get("WARC-Payload-Digest", "").removeprefix("sha256:"), whole, payload)


def page_of(record_id: str | None) -> str | None:
    """The id of the page that a record id names; null for pages without one."""
    return unquote(record_id.removeprefix(PAGE).replace("+", " ")) if record_id and record_id.startswith(PAGE) else None


def records_whole(spark: SparkSession, path: str, *, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(record): the original records through the join: what stands before the payload, and of responses the payload.

    A response whose payload isn't there comes back without it.  Payloads under ``min_bytes``
    can be those of many responses; they are dealt to SALTS tasks.
    """
    records, payloads = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/payloads")
    salt = F.when(F.col("payload_bytes") < min_bytes, F.pmod(F.xxhash64("header"), F.lit(SALTS))).otherwise(0).cast("int")
    wanted = F.when(F.col("record_type") == "response", F.col("digest"))
    # revisits want none; they are dealt by their own header and find nothing
    asked = records.select("header", F.coalesce(wanted, F.md5("header")).alias("wanted"), F.when(wanted.isNull(), 0).otherwise(salt).alias("salt"))
    salts = F.when(F.col("size") < min_bytes, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    held = payloads.select(F.col("digest").alias("wanted"), "packed", F.explode(salts).alias("salt"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            made = [h.encode("utf-8", "surrogatepass") + (unpacker.decompress(p) if p is not None else b"") for h, p in zip(batch.column("header").to_pylist(), batch.column("packed").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    small_batches(records)
    return asked.join(held, ["wanted", "salt"], "left").select("header", "packed").mapInArrow(rebuild, "record binary")


def read_archive(spark: SparkSession, path: str, *, id_type: str = "long", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, record_type, refers_to, digest, payload_bytes, verified) of each record.

    All is read from the rebuilt bytes: ids and digests from the header, size and digest of
    the payload from the block.  A revisit has the size and digest of the response that it
    refers to.  ``verified``: the block has the length, and the payload the digest, that the
    header names; of a revisit, its response is there, is verified and has that digest.
    """
    shape = "page_id string, record_type string, refers_to string, named string, digest string, payload_bytes long, whole boolean"
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_record(r.as_py()) for r in batch.column("record")]
            rows = [(page_of(r.record_id), r.kind, page_of(r.refers_to), r.named, hashlib.sha256(r.payload).hexdigest(), len(r.payload), r.whole) for r in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in shape.split(", ")])

    parsed = spool(records_whole(spark, path, min_bytes=min_bytes).mapInArrow(read, shape), "warc-read")
    own = F.col("whole") & (F.col("digest") == F.col("named"))
    revisited = parsed.where("record_type = 'response' AND page_id IS NOT NULL").groupBy(F.col("page_id").alias("their_id"), F.col("digest").alias("their_digest")).agg(F.max("payload_bytes").alias("their_bytes"), F.max(own).alias("theirs"))
    both = parsed.join(revisited, (F.col("refers_to") == F.col("their_id")) & (F.col("named") == F.col("their_digest")), "left")
    again = F.col("record_type") == "revisit"
    return both.select(
        F.col("page_id").cast(id_type).alias("page_id"), "record_type", F.col("refers_to").cast(id_type).alias("refers_to"),
        F.when(again, F.col("their_digest")).otherwise(F.col("digest")).alias("digest"), F.when(again, F.col("their_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.col("whole") & F.coalesce("theirs", F.lit(False))).otherwise(own).alias("verified"))


def warc_files(spark: SparkSession, path: str, out: str, *, compression: str = "gzip") -> None:
    """Write the archive's records as WARC files; each record ends with two line ends."""
    records_whole(spark, path).select(F.col("record").cast("string")).write.option("lineSep", CRLF * 2).option("compression", compression).text(out)


def archive_round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write an archive into the shared folder and read it back."""
    path = f"{shared_dir(pages.sparkSession)}/corpuslake/warc-{uuid.uuid4().hex}"
    write_archive(pages, path, **columns)
    id_type = pages.schema[columns.get("id_col", "page_id")].dataType.simpleString()
    return read_archive(pages.sparkSession, path, id_type=id_type, min_bytes=columns.get("min_bytes", MIN_REVISIT_BYTES))
