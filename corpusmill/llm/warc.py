"""WARC archives with a two-level capture index.

Archives hold one gzip member per record, so a record is read by its offset
and length. The index sorts captures by reversed-host key into compressed
blocks; a sparse directory has the first and last key of each block, and the
ranges of the index parts stand above it. A lookup searches both levels in
turn and unpacks the blocks that may hold a key, then reads byte ranges of
the archives.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.shared import new_path, written
from corpusmill.llm.url_rules import url_host

#: Payloads this long are stored once; bytes of an archive, about; captures of an index block.
LEAST_SHARED, ARCHIVE_BYTES, BLOCK_LINES = 1000, 8 << 20, 1000

RECORD = "page_id long, url string, payload binary, refers_to long, payload_digest string"
CAPTURE = (
    "url string, page_id long, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, archive string, offset long, length long"
)


def surt(url: Column) -> Column:
    """Sort key of a URL: host labels reversed, then path and query; null gives an empty key."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    host = F.array_join(F.reverse(F.split(url_host(url), r"\.")), ",")
    return F.when(F.coalesce(url, F.lit("")).contains("://"), F.concat(host, F.lit(")"), rest)).otherwise(
        F.coalesce(url, F.lit(""))
    )


def records_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Records to write. ``refers_to`` is set for those that revisit another record's payload.

    Of records with equal payloads of LEAST_SHARED bytes or more, the one with
    the largest id holds the payload. Digests decide, so payloads stay with
    their rows; only ids and digests are grouped.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("same", F.sha2("payload", 256))
    long_rows = rows.where(F.octet_length("payload") >= LEAST_SHARED).select("page_id", "same")
    holders = (
        long_rows.groupBy("same")
        .agg(F.max("page_id").alias("holder"), F.count("*").alias("n"))
        .where("n > 1 AND holder IS NOT NULL")
    )
    revisits = written(
        long_rows.join(holders, "same").where("NOT page_id <=> holder").select("page_id", "same", "holder").distinct(),
        "revisits",
    )
    return rows.alias("r").join(
        revisits.alias("v"), F.expr("r.page_id <=> v.page_id AND r.same = v.same"), "left"
    ).select("r.page_id", "r.url", "r.payload", F.col("v.holder").alias("refers_to"), F.sha1("r.payload").alias("payload_digest"))


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    body = b"" if refers_to is not None else payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    lines.append(f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>")
    lines.append("WARC-Date: 1970-01-01T00:00:00Z")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        lines.append(f"X-Payload-Length: {len(payload)}")
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes records as gzip members, an archive per ``archive_bytes``, in any folder Spark can write.

    Spark's writer commits whole files, so a lost task leaves no half archive.
    It ends each file with one zero byte, which gzip readers take for padding.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, size = [], 0
        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for i in range(len(batch)):
                member = _member(_record(*(c[i].as_py() for c in columns)))
                if size and size + len(member) > archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["archive"])
                    members, size = [], 0
                members.append(member)
                size += len(member)
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["archive"])

    packed = records.select("page_id", "url", "payload", "refers_to", "payload_digest").mapInArrow(pack, "archive binary")
    (
        packed.select(F.col("archive").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1).option("lineSep", "\u0000").text(path)
    )


def _parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _page(urn: str | None) -> int | None:
    name = (urn or "none>").rpartition(":")[2].rstrip(">")
    return None if name == "none" else int(name)


def _capture(fields: dict[str, str], body: bytes) -> tuple:
    url, kind = fields.get("WARC-Target-URI"), fields["WARC-Type"]
    if kind == "response":
        size, digest = len(body), hashlib.sha1(body).hexdigest()
        if fields["WARC-Payload-Digest"] != f"sha1:{digest}":
            raise ValueError(f"{fields['WARC-Record-ID']}: payload and digest differ")
    else:
        size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    refers = _page(fields.get("WARC-Refers-To")) if kind == "revisit" else None
    return url, _page(fields["WARC-Record-ID"]), kind, refers, size, digest


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


_CAPTURE_ARROW = pa.schema([
    ("url", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("archive", pa.string()),
    ("offset", pa.int64()), ("length", pa.int64()),
])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A capture per record, found by reading each archive from end to end; digests are verified."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                data, offset, rows = memoryview(content.as_buffer()), 0, []
                while offset < len(data) and data[offset] != 0:
                    unpacker = zlib.decompressobj(31)
                    raw, at = [], offset
                    while not unpacker.eof:
                        raw.append(unpacker.decompress(data[at : at + 65536]))
                        at += 65536
                    length = min(at, len(data)) - len(unpacker.unused_data) - offset
                    rows.append((*_capture(*_parsed(b"".join(raw))), name.as_py(), offset, length))
                    offset += length
                yield _batch(rows, _CAPTURE_ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(parse, CAPTURE)


def build_index(captures: DataFrame, path: str, lines: int = BLOCK_LINES) -> None:
    """Writes sorted, compressed blocks to ``path``, one part of the index per partition.

    Captures are sorted by key, then archive and offset, so captures of one
    hot key spread over as many blocks and parts as they fill.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number, n = 0, 0

        def flushed() -> pa.RecordBatch:
            nonlocal number
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            keys = table.column("key")
            number += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([table.column("part")[0].as_py()], pa.int32()), pa.array([number], pa.int32()),
                    pa.array([keys[0].as_py()]), pa.array([keys[-1].as_py()]), pa.array([len(table)], pa.int64()),
                    pa.array([zlib.compress(sink.getvalue().to_pybytes(), 6)], pa.binary()),
                ],
                ["part", "block", "first_key", "last_key", "captures", "data"],
            )

        for batch in batches:
            while len(batch):
                take = min(lines - n, len(batch))
                held.append(batch.slice(0, take))
                batch, n = batch.slice(take), n + take
                if n == lines:
                    yield flushed()
                    held, n = [], 0
        if held:
            yield flushed()

    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = captures.select(
        surt(F.col("url")).alias("key"), "archive", "offset", "length"
    ).repartitionByRange(parts, "key", "archive", "offset").sortWithinPartitions("key", "archive", "offset")
    keyed.select(F.spark_partition_id().alias("part"), "*").mapInArrow(
        pack, "part int, block int, first_key string, last_key string, captures long, data binary"
    ).write.parquet(path)


def lookup(index: DataFrame, keys: DataFrame) -> DataFrame:
    """``(key, archive, offset, length)`` of every capture of the keys (column ``key``, repeated ones count once).

    The ranges of the index parts, as many as shuffle partitions, go to the
    tasks; a key is searched among them, then in the directory of its part,
    then in the blocks that may hold it.
    """
    directory = index.select("part", "block", "first_key", "last_key")
    ranges = directory.groupBy("part").agg(
        F.min("first_key").alias("first"), F.max("last_key").alias("last")
    ).orderBy("part").collect()
    parts = [row["part"] for row in ranges]
    firsts, lasts = ([row[k].encode() for row in ranges] for k in ("first", "last"))

    def to_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (key, parts[i])
                for key in batch.column("key").to_pylist()
                for i in range(bisect_left(lasts, key.encode()), bisect_right(firsts, key.encode()))
            ]
            yield _batch(found, pa.schema([("key", pa.string()), ("part", pa.int32())]))

    def to_blocks(wanted: pa.Table, blocks: pa.Table) -> pa.Table:
        blocks = blocks.sort_by("block")
        first, last = ([k.encode() for k in blocks.column(c).to_pylist()] for c in ("first_key", "last_key"))
        numbers, part = blocks.column("block").to_pylist(), (wanted.column("part").to_pylist() or [None])[0]
        found = [
            (key, part, numbers[i])
            for key in wanted.column("key").to_pylist()
            for i in range(bisect_left(last, key.encode()), bisect_right(first, key.encode()))
        ]
        return pa.Table.from_batches([_batch(found, pa.schema(
            [("key", pa.string()), ("part", pa.int32()), ("block", pa.int32())]
        ))])

    def to_captures(wanted: pa.Table, block: pa.Table) -> pa.Table:
        empty = pa.schema([("key", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        if not len(wanted) or not len(block):
            return empty.empty_table()
        lines = pa.ipc.open_stream(zlib.decompress(block.column("data")[0].as_py())).read_all()
        return lines.select(empty.names).filter(
            pc.is_in(lines.column("key"), value_set=wanted.column("key").combine_chunks())
        )

    named = keys.select("key").distinct().mapInArrow(to_parts, "key string, part int")
    blocks = named.groupBy("part").cogroup(directory.groupBy("part")).applyInArrow(
        to_blocks, "key string, part int, block int"
    )
    data = index.select("part", "block", "data")
    return blocks.groupBy("part", "block").cogroup(data.groupBy("part", "block")).applyInArrow(
        to_captures, "key string, archive string, offset long, length long"
    )


def read_ranges(captures: DataFrame) -> DataFrame:
    """The records at (archive, offset, length), read as byte ranges; archives stand in a store that Arrow opens."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if archive != name:
                    store, inner = fs.FileSystem.from_uri(archive)
                    name, stream = archive, store.open_input_file(inner)
                raw = zlib.decompress(stream.read_at(length, offset), 31)
                rows.append((*_capture(*_parsed(raw)), archive, offset, length))
            yield _batch(rows, _CAPTURE_ARROW)

    near = captures.select("archive", "offset", "length").sortWithinPartitions("archive", "offset")
    return near.mapInArrow(read, CAPTURE)


def archived(pages: DataFrame, **columns: str) -> DataFrame:
    """Writes, indexes and looks up every page; a row per row of ``pages`` as read back.

    Columns: url, page_id, record_type, refers_to, payload_bytes,
    payload_digest, archive, offset, length. Null html is an empty payload;
    a null URL has no target and an empty key; line ends in a URL come back
    percent-encoded, as a header cannot hold them. A null id is never the holder
    of a payload that a row with an id has. Rows that repeat id and html hold
    their payload each; rows that repeat a URL are captures of one key.
    """
    spark = pages.sparkSession
    path, index_path = new_path(spark, "warc"), new_path(spark, "warc-index")
    write_archives(records_of(pages, **columns), path)
    captures = written(read_archives(spark, path), "captures")
    build_index(captures, index_path)
    index = spark.read.parquet(index_path)
    found = lookup(index, captures.select(surt(F.col("url")).alias("key")))
    return read_ranges(found)
