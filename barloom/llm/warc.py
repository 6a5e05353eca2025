"""WARC archives on shared storage, with an index that comes first.

The index holds page, archive, offset, length, URL, digest and type of every
record, and is computed and written before any archive: the header of a record
and so its length follow from the page's URL, digest and length alone. The
archives are then written by Spark's text writer with the record end as line
separator, one file for each archive, in the order of the index. Reading takes
an index, or a selection of it, and turns neighbouring records into one sorted
byte-range read each.

Cases: a null html is empty, a null URL is left out of the header; pages with
the same id are records of their own, ordered by (page_id, digest, url), and the
first of equal payloads is the response; fully equal rows are numbered; a null
page_id comes before the others; an empty table gives an empty index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window, functions as F

from barloom.llm.common import NO_ID, Stored, arrow, id_key, partitions

END = "\r\n\r\n"  # after each record
MIN_REVISIT = 100  # bytes; smaller payloads are always stored
ARCHIVE_BYTES = 32 << 20  # payload in an archive, about
GAP = 64 << 10  # bytes between two records that are still read in one go
READ = 8 << 20  # bytes in one read, but for a longer record
SAMPLE = 500  # pages whose beginnings make the dictionary that payloads are shuffled with
SAMPLE_CHARS = 8192
DICTIONARY = 64 << 10
DATE = "2024-01-01T00:00:00Z"  # fixed, so that a record's bytes are repeatable


def _record_id(name: str, page: str, nth):
    """A record is known by its page, its payload and its number among equal ones."""
    return F.concat(F.lit(f"{name}: <urn:page:"), F.col(page).cast("string"), F.lit(":"), "payload_digest", F.lit(":"), nth, F.lit(">"))


def _with_header(rows: DataFrame) -> DataFrame:
    """Add ``_header``, with the blank line that ends it, and ``length``, the bytes of the record without its end."""
    revisit = F.col("record_type") == "revisit"
    size = F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        _record_id("WARC-Record-ID", "_id", F.col("_nth").cast("string")),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), "payload_digest"),
        F.when(revisit, _record_id("WARC-Refers-To", "_ref", F.lit("1"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), size.cast("string")),
    ]
    with_text = rows.withColumn("_header", F.concat(F.concat_ws("\r\n", *lines), F.lit(END)))
    return with_text.withColumn("length", F.octet_length("_header") + size)


def _payloads(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        id_key("page_id").alias("_id"), F.col("url").cast("string").alias("url"), F.sha2(F.encode(html, "utf-8"), 256).alias("payload_digest"),
        F.octet_length(html).cast("bigint").alias("payload_bytes"), html.alias("_html"),
    )


def _archive(n: int):
    return F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int")


def build_index(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """The index of the archives that ``write_archives`` makes of these pages."""
    light = _payloads(pages).drop("_html")
    total = light.agg(F.sum("payload_bytes")).first()[0] or 0
    archives = max(1, -(-total // archive_bytes))
    # The smallest page of each payload, aggregated before it meets its copies.
    first = light.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest").agg(F.min("_id").alias("_ref"))
    same = Window.partitionBy("_archive", "_id").orderBy("payload_digest", F.col("url").asc_nulls_first())
    own = Window.partitionBy("_archive", "_id", "payload_digest").orderBy(F.col("url").asc_nulls_first())
    rows = light.join(first, "payload_digest", "left").withColumn("_archive", _archive(archives))
    rows = rows.withColumn("_nth", F.row_number().over(own)).withColumn("_at", F.row_number().over(same))
    stored = F.col("_ref").isNull() | (F.col("_id") == F.col("_ref")) & (F.col("_nth") == 1)
    rows = rows.withColumn("record_type", F.when(stored, "response").otherwise("revisit"))
    rows = rows.withColumn("_ref", F.when(~stored, F.col("_ref")))
    rows = _with_header(rows)
    order = Window.partitionBy("_archive").orderBy("_id", "_at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("length") + len(END)).over(before), F.lit(0))
    return rows.select(
        "_archive", "_id", "_at", offset.cast("bigint").alias("offset"), F.col("length").cast("bigint").alias("length"),
        "url", "payload_digest", "payload_bytes", "record_type", "_ref", "_header",
    )


def _dictionary(pages: DataFrame) -> bytes:
    """What pages have in common, learnt from a few. Only the size of the shuffle depends on it."""
    some = pages.where("html <> ''").select(F.substring("html", 1, SAMPLE_CHARS).alias("html")).limit(SAMPLE).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY, [r["html"].encode() for r in some]).as_bytes() if some else b""
    except zstandard.ZstdError:  # too little to learn from
        return b""


def _shared(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def _compressed(bodies: DataFrame, dictionary: bytes) -> DataFrame:
    """The rows with ``_body`` compressed, each on its own."""
    ddl = ", ".join(f"{c} {t}" for c, t in bodies.dtypes)
    out = arrow(ddl)
    at = bodies.columns.index("_body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, **_shared(dictionary))
        for batch in batches:
            made = pa.array([pack.compress(b.as_buffer()) for b in batch.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], made.cast(out.field(at).type), *batch.columns[at + 1 :]], schema=out)

    return bodies.mapInArrow(run, ddl)


def write_archives(pages: DataFrame, index: DataFrame, path: str) -> None:
    """Write the archives an index describes; each is one file below ``path/_archive=n``.

    A page and its index row meet by going to the same archive: one shuffle
    of the pages, in which the order within an archive is made as well. Payloads
    go through it compressed.
    """
    top = index.agg(F.max("_archive")).first()[0]
    if top is None:
        return
    n = top + 1
    url = F.coalesce("url", F.lit("")).alias("_url")
    heads = index.select("_archive", "_id", "payload_digest", url, F.col("_at").cast("bigint").alias("_at"), "record_type", F.encode("_header", "utf-8").alias("_body"))
    bodies = _payloads(pages).withColumn("_archive", _archive(n)).select(
        "_archive", "_id", "payload_digest", url, F.lit(None).cast("bigint").alias("_at"), F.lit("").alias("record_type"), F.encode("_html", "utf-8").alias("_body")
    )
    dictionary = _dictionary(pages)
    met = heads.unionByName(_compressed(bodies, dictionary)).repartition(n, "_archive").sortWithinPartitions(
        "_archive", "_id", "payload_digest", "_url", F.col("_at").asc_nulls_last()
    )
    ddl = "_archive int, record string"
    out = arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(**_shared(dictionary))
        waiting: list[tuple[str, bytes]] = []  # headers of the page, in order; then as many equal bodies come
        for batch in batches:
            made = []
            for a, _, _, _, at, kind, body in zip(*(c.to_pylist() for c in batch.columns)):
                if at is not None:
                    waiting.append((kind, body))
                else:
                    kind, header = waiting.pop(0)
                    made.append((a, (header + (unpack.decompress(body) if kind == "response" else b"")).decode()))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)

    met.mapInArrow(run, ddl).write.partitionBy("_archive").option("lineSep", END).text(path)


RECORD_DDL = "_archive int, _id bigint, offset bigint, header string, payload binary"


def read_records(index: DataFrame, path: str, gap: int = GAP, most: int = READ) -> DataFrame:
    """Header and payload of the records an index, or part of one, names.

    Neighbouring records make one read; reads are dealt over the tasks. The
    storage is read by byte range where pyarrow knows it, else whole archives come
    through Spark.
    """
    spark = index.sparkSession
    files = _files(spark, path)
    names = F.broadcast(spark.createDataFrame(files, "_archive int, _file string"))
    wanted = index.select("_archive", "_id", "offset", "length")
    order = Window.partitionBy("_archive").orderBy("offset")
    end = F.lag(F.col("offset") + F.col("length")).over(order)
    far = end.isNull() | (F.col("offset") - end > gap)
    runs = wanted.withColumn("_new", far.cast("int")).withColumn("_run", F.sum("_new").over(order))
    # Within a run, reads of bounded size: the block in which a record starts.
    reads = runs.groupBy("_archive", "_run", F.floor(F.col("offset") / most).alias("_block")).agg(
        F.min("offset").alias("_from"), F.max(F.col("offset") + F.col("length")).alias("_to"),
        F.sort_array(F.collect_list(F.struct("offset", "length", "_id"))).alias("_records"),
    )
    reads = reads.join(names, "_archive").select("_archive", "_file", "_from", "_to", "_records")
    reads = reads.repartition(partitions(spark), "_archive", "_from").sortWithinPartitions("_archive", "_from")
    ranged = _reachable(files)
    if not ranged:
        whole = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("_name"), "content")
        reads = reads.withColumn("_name", F.element_at(F.split("_file", "/"), -1)).join(whole, "_name").drop("_name")
    out = arrow(RECORD_DDL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, object] = ("", None)
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: c[row].as_py() for n, c in zip(batch.schema.names, batch.columns)}
                if ranged:
                    if opened[0] != one["_file"]:
                        system, inner = fs.FileSystem.from_uri(one["_file"])
                        opened = (one["_file"], system.open_input_file(inner))
                    data = opened[1].read_at(one["_to"] - one["_from"], one["_from"])
                else:
                    data = one["content"][one["_from"] : one["_to"]]
                parts = [parse(data[r["offset"] - one["_from"] :][: r["length"]]) for r in one["_records"]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([one["_archive"]] * len(parts), pa.int32()),
                    pa.array([r["_id"] for r in one["_records"]], pa.int64()),
                    pa.array([r["offset"] for r in one["_records"]], pa.int64()),
                    pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.binary()),
                ], schema=out)

    return reads.mapInArrow(run, RECORD_DDL)


def parse(record: bytes) -> tuple[str, bytes]:
    """Header and payload; raises if the bytes are not one whole record."""
    header, mark, payload = record.partition(END.encode())
    text = header.decode()
    if not mark or not text.startswith("WARC/1.1") or int(field(text, "Content-Length")) != len(payload):
        raise ValueError("not a WARC record")
    return text, payload


def field(header: str, name: str) -> str | None:
    """The value of one header field."""
    return next((v for k, _, v in (x.partition(": ") for x in header.split("\r\n")) if k == name), None)


def _files(spark, path: str) -> list[tuple[int, str]]:
    """The file of each archive: a listing of the folder, no data."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(at):
        return []
    found = []
    for folder in system.listStatus(at):
        name = folder.getPath().getName()
        if name.startswith("_archive="):
            found += [
                (int(name.partition("=")[2]), f.getPath().toString()) for f in system.listStatus(folder.getPath())
                if f.getPath().getName().startswith("part-")
            ]
    return found


def _reachable(files: list[tuple[int, str]]) -> bool:
    try:
        return not files or fs.FileSystem.from_uri(files[0][1])[0].get_file_info(
            fs.FileSystem.from_uri(files[0][1])[1]).type == fs.FileType.File
    except (pa.ArrowException, OSError, ValueError):
        return False


def archive_round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write index and archives below the checkpoint folder, read every record back and resolve the revisits.

    Lengths and digests of responses are measured on the payload read; those of
    revisits are the ones of the response they name.
    """
    store = Stored(pages.sparkSession)
    index = store.keep(build_index(pages, archive_bytes))
    path = store.folder()
    write_archives(pages, index, path)
    ddl = "_archive int, _id bigint, payload_bytes bigint, payload_digest string, named_digest string, record_type string, refers_to bigint"
    out = arrow(ddl)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, i, _, header, payload in zip(*(c.to_pylist() for c in batch.columns)):
                ref = field(header, "WARC-Refers-To")
                named = field(header, "WARC-Payload-Digest").partition(":")[2]
                kind, made = field(header, "WARC-Type"), hashlib.sha256(payload).hexdigest()
                if kind == "response" and made != named:
                    raise ValueError(f"payload of page {i} does not match its digest")
                rows.append((a, i, len(payload), made, named, kind, int(ref.split(":")[2]) if ref else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    got = read_records(index, path).mapInArrow(digest, ddl)
    got = store.keep(got)
    stored = got.where("record_type = 'response'").groupBy(F.col("_id").alias("refers_to"), F.col("payload_digest").alias("named_digest")).agg(
        F.max("payload_bytes").alias("_full"))
    back = got.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(stored, ["refers_to", "named_digest"])
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias("page_id" if c == "_id" else c)
    cols = ["payload_bytes", "payload_digest", "record_type"]
    return got.where("record_type = 'response'").select(shown("_id"), *cols, F.lit(None).cast("bigint").alias("refers_to")).unionByName(
        back.select(shown("_id"), F.col("_full").alias("payload_bytes"), F.col("named_digest").alias("payload_digest"), "record_type", shown("refers_to")))
