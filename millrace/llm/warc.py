"""WARC archives: a deterministic sharded writer, and the reader for its files.

Records are dealt into shards by ranges of (page id, payload digest, url), each of about
the same bytes; the bounds follow from the rows alone, not from files, partitions or
cluster.  Within a shard records are sorted, each is its own gzip member, and a file is
closed when it has reached its compressed size.  Headers, ids and digests are made anew
from the content; nothing in a file depends on time or machine.  A task writes under a
temporary name and renames; the manifest, renamed into the folder last, lists the files
that count, and a folder without one is no archive.

Repeated payloads are found on digests alone.  What that decides travels to the
records as narrow rows of the same sort order, so payloads are shuffled once.  A row
that is repeated beyond a shard's bytes travels once, with its count, and its records
are made in runs that have shards of their own.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, fresh_path, materialize, ship, table

#: Payloads of fewer bytes are always written out.
LEAST_REVISIT = 1000
ROLL_BYTES = 256 << 20
#: Bytes of a shard; beyond the most shards, whose bounds are broadcast, they grow instead.
SHARD_BYTES, MOST_SHARDS = 16 << 20, 100_000
#: Bytes that a record is taken to have beside its payload.
RECORD = 512
#: Records of a repeated row that are made at once.
RUN = 65_536
MANIFEST = "manifest.parquet"
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(uri: str):
    """The file system and path behind a folder's URI, as every executor sees it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "/", 1))


def record_id(page: object, digest: str, url: str | None, repeat: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page}:{digest}:{repeat}:{url}')}>"


def _b32(hexdigest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexdigest)).decode()


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    raw = b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _uri(url: str | None, page: object) -> str:
    return urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page}"


def response(page, url: str | None, payload: bytes, digest: str, repeat: int = 0) -> bytes:
    block = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        + f"Content-Length: {len(payload)}\r\n\r\n".encode()
        + payload
    )
    fields = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id(page, digest, url, repeat)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url, page)),
        ("WARC-Block-Digest", _b32(hashlib.sha1(block).hexdigest())),
        ("WARC-Payload-Digest", _b32(digest)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return _member(fields + ([("X-Page-Id", str(page))] if page is not None else []), block)


def revisit(page, url: str | None, size: int, digest: str, repeat: int, target, target_url: str | None) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    fields = [
        ("WARC-Type", "revisit"),
        ("WARC-Record-ID", record_id(page, digest, url, repeat)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url, page)),
        ("WARC-Profile", PROFILE),
        ("WARC-Refers-To", record_id(target, digest, target_url, 0)),
        ("WARC-Block-Digest", _b32(hashlib.sha1(block).hexdigest())),
        ("WARC-Payload-Digest", _b32(digest)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("X-Payload-Length", str(size)),
    ]
    if page is not None:
        fields.append(("X-Page-Id", str(page)))
    if target is not None:
        fields.append(("X-Refers-To-Page-Id", str(target)))
    return _member(fields, block)


class _Files:
    """The files of one task: opened by shard, rolled by size, renamed when whole."""

    def __init__(self, folder: str, roll: int):
        self.fs, self.top = file_system(folder)
        self.roll, self.out, self.shard, self.part, self.done = roll, None, None, 0, []

    def add(self, shard: int, member: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.part = shard, 0
        elif self.out is not None and self.size + len(member) > self.roll:
            self.close()
            self.part += 1
        if self.out is None:
            self.name = f"pages-{shard:05d}-{self.part:04d}.warc.gz"
            self.temp = posixpath.join(self.top, "_temporary", f"{self.name}.{uuid.uuid4().hex}")
            self.fs.create_dir(posixpath.dirname(self.temp), recursive=True)
            self.out, self.size, self.count, self.hash = self.fs.open_output_stream(self.temp), 0, 0, hashlib.sha256()
            info = b"software: millrace\r\nformat: WARC file version 1.1\r\n"
            self._put(
                _member(
                    [
                        ("WARC-Type", "warcinfo"),
                        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE, self.name)}>"),
                        ("WARC-Date", DATE),
                        ("WARC-Filename", self.name),
                        ("Content-Type", "application/warc-fields"),
                        ("Content-Length", str(len(info))),
                    ],
                    info,
                )
            )
        self._put(member)
        self.count += 1

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.hash.update(member)
        self.size += len(member)

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        target = posixpath.join(self.top, self.name)
        if self.fs.get_file_info(target).is_file:  # of a lost attempt, with the same bytes
            self.fs.delete_file(target)
        self.fs.move(self.temp, target)
        self.done.append((self.name, self.count, self.size, self.hash.hexdigest()))
        self.out = None


def _bounds(narrow: DataFrame, per: int) -> DataFrame:
    """One row, ``bounds``: the first key of each shard of ``per`` bytes but the first.

    Keys are ranked exactly: running sums within sorted parts, and the sums of the parts
    before.  The order is total, so how it is cut into parts makes no difference.
    """
    parts = int(narrow.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = materialize(
        narrow.select(*KEY, (F.col("size") + RECORD).alias("bytes"))
        .repartitionByRange(parts, *KEY)
        .withColumn("part", F.spark_partition_id()),
        "warc-order",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each part.
    starts = ordered.groupBy("part").agg(F.sum("bytes").alias("bytes"))
    starts = starts.select(F.col("part").alias("of"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ordered.withColumn("in_", F.coalesce(F.sum("bytes").over(inside), F.lit(0))).join(
        F.broadcast(starts), F.col("part") == F.col("of")
    )
    firsts = ranked.groupBy(((F.col("start") + F.col("in_")) / per).cast("bigint").alias("shard")).agg(
        F.min(F.struct(*KEY)).alias("key")
    )
    return firsts.where("shard > 0").agg(F.array_sort(F.collect_list("key")).alias("bounds"))


#: What a record is sorted and named by; ``uh`` is a hash of the url.
KEY = ["page_id", "strong", "uh"]
_STEP = (
    "if(s.lo < s.hi, if(get(bounds, cast((s.lo + s.hi) div 2 as int)) <= key_, "
    "named_struct('lo', (s.lo + s.hi) div 2 + 1, 'hi', s.hi), "
    "named_struct('lo', s.lo, 'hi', (s.lo + s.hi) div 2)), s)"
)


def _dealt(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """``rows`` with ``shard``, how many bounds their key is not below; ``bounds`` is one row."""
    steps = f"array_repeat(0, {MOST_SHARDS.bit_length() + 1})"
    place = f"aggregate({steps}, named_struct('lo', 0L, 'hi', cast(size(bounds) as bigint)), (s, i) -> {_STEP}, s -> s.lo)"
    return (
        rows.join(F.broadcast(bounds))
        .withColumn("key_", F.struct(*KEY))
        .withColumn("shard", F.expr(place).cast("int"))
        .drop("key_", "bounds")
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    roll_bytes: int = ROLL_BYTES,
    shard_bytes: int = SHARD_BYTES,
    least_revisit: int = LEAST_REVISIT,
) -> DataFrame:
    """Write a record for each row and return the manifest: ``file, records, bytes, sha256``.

    Ids are integers.  A null html is an empty payload; payloads are equal when their
    SHA-256 and length are.  Of rows with equal payloads of ``least_revisit`` bytes or more
    the one with the largest id, and then url, is the response; among repeats of that row
    the first is.  A null id or url is the least.  A payload of any length is one record,
    which its task holds whole.  Other columns are ignored; an empty table gives an empty
    manifest.
    """
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    ).select("*", F.sha2("payload", 256).alias("strong"), F.xxhash64("url").alias("uh"))
    size = F.octet_length("payload").cast("bigint")
    narrow = materialize(rows.select(*KEY, "url", size.alias("size")), "warc-digests")
    total = narrow.agg(F.coalesce(F.sum(F.col("size") + RECORD), F.lit(0))).first()[0]
    shards = max(1, min(-(-total // shard_bytes), MOST_SHARDS))
    per = -(-total // shards) or 1

    same = ["strong", "size"]
    repeated = materialize(
        narrow.where(F.col("size") >= least_revisit)
        .groupBy(*same)
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "url")).alias("winner"))
        .where("n > 1")
        .select(*same, "winner"),
        "warc-repeated",
    )
    # Rows repeated as they are beyond a shard's bytes: fewer than there are shards.
    whole = [*KEY, "url", "size"]
    hot = materialize(
        narrow.groupBy(*whole).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * (F.col("size") + RECORD) > per)
        .where("n > 1").join(repeated, same, "left")
        .select(*[F.col(k).alias(f"hot_{k}") for k in (*KEY, "url", "n", "winner")]),
        "warc-hot",
    )
    runs = hot.agg(F.coalesce(F.sum(F.expr(f"(hot_n - 1) div {RUN} + 1")), F.lit(0))).first()[0]
    of_hot = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"hot_{k}")) for k in (*KEY, "url")])
    cold, cold_narrow = rows, narrow
    if runs:
        cold = rows.join(F.broadcast(hot), of_hot, "left_anti")
        cold_narrow = narrow.join(F.broadcast(hot), of_hot, "left_anti")
    bounds = materialize(_bounds(cold_narrow, per), "warc-bounds")

    notes = cold_narrow.join(repeated, same).select(*KEY, "url", "winner").distinct()
    no = {
        "kind": F.lit(1), "winner": F.lit(None).cast(repeated.schema["winner"].dataType), "digest": F.lit(None).cast("string"),
        "size": F.lit(0).cast("bigint"), "payload": F.lit(None).cast("binary"), "first": F.lit(-1).cast("bigint"),
        "copies": F.lit(1).cast("bigint"),
    }

    def record(df: DataFrame, **given) -> DataFrame:
        return df.select(*KEY, "url", *[given.get(k, v).alias(k) for k, v in no.items()], *(["shard"] if "shard" in df.columns else []))

    sha1 = F.sha1("payload")
    dealt = _dealt(
        record(cold, digest=sha1, size=size, payload=F.col("payload")).unionByName(
            record(notes, kind=F.lit(0), winner=F.col("winner"))
        ),
        bounds,
    )
    if runs:
        once = (
            rows.join(F.broadcast(hot), of_hot)
            .groupBy(*KEY, "url")
            .agg(F.first("payload").alias("payload"), F.first("hot_n").alias("n"), F.first("hot_winner").alias("winner"))
        )
        run = once.withColumn("run", F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN})")))
        run = run.withColumn("shard", (F.lit(len_(bounds)) + F.pmod(F.xxhash64(*KEY, "run"), F.lit(min(runs, MOST_SHARDS)))).cast("int"))
        dealt = dealt.unionByName(
            record(run, digest=sha1, size=size, winner=F.col("winner"),
                   payload=F.when((F.col("run") == 0) | F.col("winner").isNull(), F.col("payload")),
                   first=F.col("run") * RUN, copies=F.least(F.lit(RUN), F.col("n") - F.col("run") * RUN))
        )
    tasks = len_(bounds) + min(runs, MOST_SHARDS)
    dealt = dealt.repartitionById(tasks, F.col("shard")).sortWithinPartitions("shard", *KEY, "url", "first", "kind")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, last, note, repeat = _Files(folder, roll_bytes), None, None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                page, strong, _, url, kind, winner, digest, size, payload, first, copies, shard = (c[i].as_py() for c in batch.columns)
                if (page, strong, url) != last:
                    last, note, repeat = (page, strong, url), None, 0
                if winner is not None:
                    note = (winner["page_id"], winner["url"])
                if kind == 0:
                    continue
                for number in range(repeat, repeat + 1) if first < 0 else range(first, first + copies):
                    if note is None or (note == (page, url) and number == 0):
                        member = response(page, url, payload, digest, number)
                    else:
                        member = revisit(page, url, size, digest, number, *note)
                    files.add(shard, member)
                repeat += 1
        files.close()
        names = ["file", "records", "bytes", "sha256"]
        cols = list(zip(*files.done, strict=True)) or [[], [], [], []]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    manifest = materialize(
        dealt.mapInArrow(write, "file string, records bigint, bytes bigint, sha256 string"), "warc-manifest"
    )
    _commit(manifest, folder)
    for done in (narrow, repeated, hot, bounds):
        forget(done)
    return manifest


def len_(bounds: DataFrame) -> int:
    """Shards that ``bounds`` part."""
    return 1 + bounds.select(F.size("bounds")).first()[0]


def _commit(manifest: DataFrame, folder: str) -> None:
    """Rename the manifest, a file of one row for each archive, into the folder; then clear up."""
    spark = manifest.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    temporary = f"{folder}/_temporary"
    manifest.orderBy("file").coalesce(1).write.parquet(f"{temporary}/manifest")
    fs = path(temporary).getFileSystem(conf)
    part = next(x.getPath() for x in fs.listStatus(path(f"{temporary}/manifest")) if x.getPath().getName().startswith("part-"))
    if not fs.rename(part, path(f"{folder}/{MANIFEST}")):
        raise OSError(f"{folder}: the manifest could not be put in place")
    fs.delete(path(temporary), True)


def members(stream) -> Iterator[bytes]:
    """The gzip members of a file, inflated, one at a time."""
    raw, opened = b"", None
    while True:
        if not raw:
            raw = stream.read(1 << 20)
            if not raw:
                if opened is not None:
                    raise ValueError("the archive ends within a record")
                return
        if opened is None:
            opened, parts = zlib.decompressobj(31), []
        parts.append(opened.decompress(raw))
        raw = opened.unused_data
        if opened.eof:
            yield b"".join(parts)
            opened = None


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of one record, its block digest checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    told = fields.get("WARC-Block-Digest")
    if told and told != _b32(hashlib.sha1(block).hexdigest()):
        raise ValueError(f"{fields['WARC-Record-ID']}: the block digest differs")
    return fields, block


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record.

    Reads the files that the folder's manifest lists; a folder without one is an error.
    Digests of blocks and payloads are checked; a difference is an error.
    """
    manifest = spark.read.parquet(f"{folder}/{MANIFEST}")
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = file_system(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with files.open_input_stream(posixpath.join(top, name), compression=None) as stream:
                    for record in members(stream):
                        fields, block = parse(record)
                        kind = fields["WARC-Type"]
                        if kind not in ("response", "revisit"):
                            continue
                        digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                        payload = block.partition(b"\r\n\r\n")[2]
                        size = int(fields.get("X-Payload-Length", len(payload)))
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: the payload digest differs")
                        page, target = (fields.get(k) for k in ("X-Page-Id", "X-Refers-To-Page-Id"))
                        rows.append((page and int(page), size, digest, kind, target and int(target)))
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    files = max(1, manifest.count())
    return (
        manifest.select("file")
        .repartition(min(files, 10_000), "file")
        .mapInArrow(
            read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
        )
    )


def op7_warc(spark, sf_dir):
    folder = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder)


OP7_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
w AS (
  SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM w
"""
