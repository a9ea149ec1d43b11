"""A deterministic sharded WARC writer, and the reader that goes with it.

Records are dealt into shards by ranges of their id, cut from a table of bytes per
id range so that shards hold about equal bytes; the same rows give the same shards on
any cluster. Each shard is written in id order by one task, one gzip member per
record, and rolls to a next file once the compressed size passes a limit. A file is
written under a temporary name that carries the attempt and renamed when complete;
as its bytes depend on the rows alone, a repeated attempt puts the same file there
again. The manifest (one row per file: size, records, SHA-256) is written last, by
Spark's own commit, and only files it names belong to the archive.

Files go through pyarrow's file systems, by the URI of the output folder, so any
shared store that pyarrow knows will do.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import materialize, utf8

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.NAMESPACE_URL
EMPTY_DATE = "1970-01-01T00:00:00Z"

#: Id ranges whose bytes are summed at first, at least (8 for each shard if that is more).
RANGES = 4096


# ------------------------------------------------------------------ files

def _store(uri: str):
    """(pyarrow file system, path in it) of a folder's URI or plain path."""
    from pyarrow.fs import FileSystem
    return FileSystem.from_uri(uri if ":" in uri.split("/")[0] else "file://" + uri)


def record_id(page_id, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {digest} {url}')}>"


def _sha1_32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header_value(text: str) -> str:
    """A URL as a header value: control and blank characters percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def warc_record(page_id, url: str, payload: bytes, digest: str, refers_to, refers_url: str, date: str) -> bytes:
    """One record with fresh headers and digests: a response with its payload, or a revisit without (its
    stored HTTP headers keep the payload's length)."""
    url, refers_url = _header_value(url), _header_value(refers_url)
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http + payload if refers_to is None else http
    head = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(page_id, url, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}",
            f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
            f"WARC-Block-Digest: {_sha1_32(block)}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, refers_url, digest)}",
                 f"WARC-Refers-To-Target-URI: {refers_url}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _RollingFile:
    """The files of one shard, each renamed into place when full."""

    def __init__(self, fs, folder: str, shard: int, attempt: str, limit: int) -> None:
        self.fs, self.folder, self.shard, self.attempt, self.limit = fs, folder, shard, attempt, limit
        self.part, self.out, self.done = 0, None, []

    def add(self, record: bytes) -> None:
        data = gzip.compress(record, 6, mtime=0)
        if self.out is not None and self.size + len(data) > self.limit:
            self.close()
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.temp = posixpath.join(self.folder, f".{self.name}.{self.attempt}.tmp")
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temp), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.sha.update(data)
        self.size, self.records = self.size + len(data), self.records + 1

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.fs.move(self.temp, posixpath.join(self.folder, self.name))
        self.done.append((self.name, self.shard, self.part, self.records, self.size, self.sha.hexdigest()))
        self.out, self.part = None, self.part + 1


MANIFEST_COLUMNS = ["file", "shard", "part", "records", "bytes", "sha256"]
MANIFEST = "file string, shard int, part int, records long, bytes long, sha256 string"


# ------------------------------------------------------------------ writer

#: Shards at most: a larger table gets larger shards, so that the driver's sums stay bounded.
SHARDS = 16_384

#: Bits of the payload's digest, and of a hash of the URL, that follow the id in a row's place.
DIGEST_BITS, URL_BITS = 24, 24


def _place(low: int):
    """Where a row stands: its id (null: the least) before its digest before its URL, as one number below 2^112."""
    digest = F.conv(F.substring("digest", 1, DIGEST_BITS // 4), 16, 10).cast("decimal(38,0)")
    url = F.pmod(F.xxhash64("url"), F.lit(1 << URL_BITS)).cast("decimal(38,0)")
    whole = F.coalesce("page_id", F.lit(low)).cast("decimal(20,0)") * F.lit(1 << (DIGEST_BITS + URL_BITS)).cast("decimal(17,0)")
    return whole.cast("decimal(38,0)") + digest * F.lit(1 << URL_BITS) + url


def _in_ranges(df: DataFrame, level: dict[int, tuple[int, int]]) -> DataFrame:
    """Add ``_r``: the number of the range of the row's ``_node`` that holds its ``_place`` (null for rows
    without a node). The only node of the first level is a pair of literals."""
    inside = "cast((_place - _base) div _width as long)"
    if list(level) == [0]:
        base, width = level[0]
        return df.withColumn("_r", F.expr(inside.replace("_base", f"cast('{base}' as decimal(38,0))")
                                          .replace("_width", f"cast('{width}' as decimal(38,0))")))
    nodes = df.sparkSession.createDataFrame([(k, str(b), str(w)) for k, (b, w) in level.items()],
                                            "_node int, _base string, _width string")
    nodes = nodes.select("_node", F.col("_base").cast("decimal(38,0)"), F.col("_width").cast("decimal(38,0)"))
    return df.join(_small(nodes, len(level)), "_node", "left").withColumn("_r", F.expr(inside)).drop("_base", "_width")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= 200_000 else df


def _dealer(sizes: DataFrame, shard_bytes: int):
    """(function that adds ``_shard`` to rows with a page_id, digest and url, number of shards): rows that follow one
    another by id, digest and URL, of about ``shard_bytes`` (null ids with the first).

    ``sizes`` (page_id, digest, url, n) gives the bytes. Places are cut into ranges of equal width whose bytes are
    summed; a range that holds too much is cut again, down to single places, so uneven, repeated and missing ids make
    shards as even as others; only rows that agree in id, payload and URL stay together. The sums, at most
    RANGES + 64 for each of at most SHARDS shards, come to the driver, which numbers the shards in order.
    """
    spark = sizes.sparkSession
    low, high, total = sizes.agg(F.min("page_id"), F.max("page_id"), F.sum("n")).first()
    if total is None:
        return lambda pages: pages.withColumn("_shard", F.lit(0)), 1
    low, high = low or 0, high or 0
    shard_bytes = max(shard_bytes, -(-int(total) // SHARDS))
    first = max(RANGES, 8 * int(total // shard_bytes))
    unit = 1 << (DIGEST_BITS + URL_BITS)
    level, number, levels, sums = {0: (low * unit, -(-(high - low + 1) * unit // first))}, 1, [], {}
    left = sizes.select(_place(low).alias("_place"), "n", F.lit(0).alias("_node"))
    while level:
        left = _in_ranges(left, level)
        rows = left.groupBy("_node", "_r").agg(F.sum("n").alias("n")).collect()
        below = {}
        for node, r, n in sorted(rows):
            base, width = level[node]
            child = None
            if n > shard_bytes and width > 1:
                child, number = number, number + 1
                below[child] = (base + r * width, -(-width // 64))
            sums[node, r] = (n, child)
        levels.append((level, [(k, r, sums[k, r][1]) for k, r, _ in rows]))
        if below:
            cut = spark.createDataFrame([(k, r, c) for k, r, c in levels[-1][1] if c is not None], "_node int, _r long, _child int")
            left = left.join(_small(cut, len(below)), ["_node", "_r"]).drop("_node", "_r").withColumnRenamed("_child", "_node")
        level = below

    shard_of, before = {}, 0
    children: dict[int, list[int]] = {}
    for node, r in sorted(sums):
        children.setdefault(node, []).append(r)
    todo = [(0, r) for r in reversed(children[0])]
    while todo:  # ranges in the order of places
        node, r = todo.pop()
        n, child = sums[node, r]
        if child is None:
            shard_of[node, r] = before // shard_bytes
            before += n
        else:
            todo += [(child, x) for x in reversed(children[child])]

    def deal(pages: DataFrame) -> DataFrame:
        pages = pages.withColumns({"_place": _place(low), "_shard": F.lit(None).cast("int")})
        for k, (level, rows) in enumerate(levels):
            on = ["_node", "_r"] if k else ["_r"]  # the first level has one node
            table = spark.createDataFrame([(n, r, shard_of.get((n, r)), c) for n, r, c in rows],
                                          "_node int, _r long, _own int, _child int").select(*on, "_own", "_child")
            pages = _in_ranges(pages, level).join(_small(table, len(rows)), on, "left")
            pages = pages.withColumn("_shard", F.coalesce("_shard", "_own")).drop(*on, "_own").withColumnRenamed("_child", "_node")
        return pages.drop("_node", "_place")

    return deal, 1 + max(shard_of.values())


def _writer(folder: str, file_bytes: int, date: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        task = TaskContext.get()
        attempt = f"{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        fs, base = _store(folder)
        fs.create_dir(base, recursive=True)
        out, revisit = None, (None, None, None, None)
        for b in batches:
            for shard, page, digest, is_page, url, payload, to, to_url in zip(
                    b["_shard"], b["page"], b["digest"], b["is_page"], b["url"], b["payload"], b["refers_to"],
                    b["refers_url"]):
                page = None if pd.isna(page) else int(page)  # ids travel as text: pandas would round nullable longs
                if not is_page:
                    revisit = (page, digest, int(to), to_url)
                    continue
                if out is None or out.shard != shard:
                    if out is not None:
                        out.close()
                        yield pd.DataFrame(out.done, columns=MANIFEST_COLUMNS)
                    out = _RollingFile(fs, base, int(shard), attempt, file_bytes)
                to, to_url = revisit[2:] if revisit[:2] == (page, digest) else (None, "")
                out.add(warc_record(page, url, bytes(payload), digest, to, to_url, date))
        if out is not None:
            out.close()
            yield pd.DataFrame(out.done, columns=MANIFEST_COLUMNS)

    return run


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = 32 << 20, file_bytes: int = 16 << 20,
               smallest_revisit: int = 1000, date: str = EMPTY_DATE, id_col: str = "page_id", url_col: str = "url",
               payload_col: str = "html") -> DataFrame:
    """Write one record per row of ``pages`` below ``folder``; returns the manifest as written.

    Of rows with equal payloads (SHA-1 and length) of ``smallest_revisit`` bytes or more, the
    one with the largest id is a response and the others are revisits of it; rows that
    repeat that id and payload are all responses. Rows go to shards in the order of id, digest and URL, so ids
    that are missing, or repeated by any share of the rows, fill as many shards as their bytes ask for. Null payloads count as empty, null URLs
    as an empty URI; a row with a null id is written without one, and is a revisit where an
    id has its payload. Payloads of any length are kept whole. An empty table gives an
    archive without files. Columns other than the three named are not read.
    """
    payload = utf8(F.col(payload_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
                        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("digest"),
                        payload.alias("payload"))
    slim = materialize(rows.select("page_id", "url", "payload_bytes", "digest"), "warc-rows")
    deal, shards = _dealer(slim.select("page_id", "digest", "url", (F.col("payload_bytes") + 400).alias("n")), shard_bytes)
    rows, slim = deal(rows), deal(slim)
    kept = (slim.where(F.col("payload_bytes") >= smallest_revisit).groupBy("digest", "payload_bytes")
            .agg(F.max(F.struct("page_id", "url")).alias("_kept"), F.count(F.lit(1)).alias("_n"))
            .where("_n > 1 and _kept.page_id is not null"))
    revisits = (slim.join(kept, ["digest", "payload_bytes"])
                .where(~F.col("page_id").eqNullSafe(F.col("_kept.page_id")))
                .select("_shard", "page_id", "digest", F.lit(False).alias("is_page"), F.lit("").alias("url"),
                        F.lit(b"").alias("payload"), F.col("_kept.page_id").cast("string").alias("refers_to"),
                        F.col("_kept.url").alias("refers_url")).distinct())
    # a revisit's note sorts right before its page: one shuffle of the payloads does for both
    noted = rows.select("_shard", "page_id", "digest", F.lit(True).alias("is_page"), "url", "payload",
                        F.lit(None).cast("string").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"))
    noted = noted.unionByName(revisits).repartitionById(shards, "_shard").sortWithinPartitions(
        "_shard", "page_id", "digest", "is_page", "url").withColumn("page", F.col("page_id").cast("string"))
    manifest = f"{folder.rstrip('/')}/manifest"
    noted.mapInPandas(_writer(f"{folder.rstrip('/')}/data", file_bytes, date), MANIFEST).write.parquet(manifest)
    return pages.sparkSession.read.parquet(manifest)


# ------------------------------------------------------------------ reader

RECORD = ("page_id long, url string, record_type string, payload_digest string, payload_bytes long, "
          "refers_to long, payload binary")


def _members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed gzip members of a stream, one at a time."""
    member, got, data = zlib.decompressobj(31), [], stream.read(chunk)
    while data:
        got.append(member.decompress(data))
        if member.eof:
            yield b"".join(got)
            data, member, got = member.unused_data or stream.read(chunk), zlib.decompressobj(31), []
        else:
            data = stream.read(chunk)
    if any(got):
        raise ValueError("the archive ends inside a record")


def _headers(lines: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in lines.decode().split("\r\n")[1:])


def parse_record(data: bytes) -> tuple:
    """A row of ``RECORD``; raises where a length or a digest doesn't hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    h = _headers(head)
    block = rest[:int(h["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n" or _sha1_32(block) != h["WARC-Block-Digest"]:
        raise ValueError(f"record {h['WARC-Record-ID']} is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest, n = h["WARC-Type"], h["WARC-Payload-Digest"], int(_headers(http)["Content-Length"])
    if kind == "response" and (len(payload) != n or _sha1_32(payload) != digest):
        raise ValueError(f"payload of {h['WARC-Record-ID']} is damaged")
    number = lambda k: int(h[k]) if k in h else None
    return (number("X-Page-ID"), h["WARC-Target-URI"], kind, base64.b32decode(digest[5:]).hex(), n,
            number("X-Refers-To-Page-ID"), payload if kind == "response" else None)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the files that the manifest names, digests checked; a revisit has a null payload."""
    data = f"{folder.rstrip('/')}/data"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
        number = ("page_id", "payload_bytes", "refers_to")

        def frame(rows: list[tuple]) -> pd.DataFrame:  # whole numbers, also beside nulls
            return pd.DataFrame({n: pd.array(list(c), dtype="Int64" if n in number else object)
                                 for n, c in zip(names, zip(*rows))})

        fs, base = _store(data)
        for b in batches:
            for name in b["file"]:
                with fs.open_input_stream(posixpath.join(base, name), compression=None) as stream:
                    rows, size = [], 0
                    for member in _members(stream):
                        rows.append(parse_record(member))
                        size += len(member)
                        if size > 8 << 20:
                            yield frame(rows)
                            rows, size = [], 0
                    if rows:
                        yield frame(rows)

    manifest = spark.read.parquet(f"{folder.rstrip('/')}/manifest").select("file")
    tasks = max(1, min(manifest.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return manifest.repartition(tasks, "file").mapInPandas(run, RECORD)
