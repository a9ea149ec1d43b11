"""Binary token shards with a minimal perfect hash index from document keys to shard offsets.

An archive is a folder of

* ``shards/``: raw little-endian token ids, nothing else: 16-bit where the vocabulary allows, else 32-bit;
  documents in ascending id order, each shard one range of that order;
* ``docs/``: a table with one row per document: id, number among the rows of its id, shard, place;
* ``manifest/``: a table with one row per shard: documents, ids, ids before it, CRC-32 of its bytes;
* ``index/``: for each bucket of keys a minimal perfect hash, followed by one entry (fingerprint, shard,
  length, offset) per slot; ``index_manifest/`` names the parts;
* ``layout/``: one row: width of an id, end id, number of index buckets.

The hash is built in levels: every key sets a bit of a bit field, keys that meet in one bit go on to
the next field, and a key's slot is the number of set bits before its own. A look-up takes the
key's digest, one bucket file, the few levels of its hash and one entry; a key that was never stored
is told by its 64-bit fingerprint. Documents, buckets and shards are dealt by Spark; a task holds one
bucket's keys or one document's ids. Files are written under a name that carries the attempt and renamed
when complete, and tables by Spark's commit, so lost executors leave no half file under a final name.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.llm.common import materialize
from riskframe.llm.packing import byte_bpe

#: Bytes of text per shard, keys per index bucket, both on average; bits of a level per key left; levels at most.
SHARD_BYTES, BUCKET_KEYS, SPARE, LEVELS = 32 << 20, 1 << 16, 2, 48
#: Token ids that readers hand on at a time, about.
STEP = 1 << 22
#: Start of an index part.
MAGIC = b"RFMPH001"
ENTRY = np.dtype([("mark", "<u8"), ("shard", "<u4"), ("length", "<u4"), ("offset", "<u8")])


# ------------------------------------------------------------------ minimal perfect hash

def digests(keys) -> np.ndarray:
    """(n, 2) unsigned 64-bit halves of the keys' MD5."""
    data = b"".join(hashlib.md5(k.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for k in keys)
    return np.frombuffer(data, "<u8").reshape(-1, 2)


def _mix(d: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit number per digest, another one for each seed."""
    with np.errstate(over="ignore"):
        x = d[:, 0] + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ d[:, 1]) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(d: np.ndarray) -> np.ndarray:
    return _mix(d, 1 << 20)


class MinimalHash:
    """A bijection from n different digests onto 0 .. n - 1."""

    def __init__(self, fields: list[np.ndarray], rest: np.ndarray) -> None:
        self.fields, self.rest = fields, rest  # bit fields as bytes of 0 and 1; digests that no level took
        ones = [int(f.sum()) for f in fields]
        self.base = np.concatenate([[0], np.cumsum(ones)]).astype(np.int64)
        self.before = [np.cumsum(f, dtype=np.int64) - f for f in fields]

    @classmethod
    def build(cls, d: np.ndarray) -> MinimalHash:
        if len(np.unique(d, axis=0)) != len(d):
            raise ValueError("keys repeat")
        fields, left = [], d
        while len(left) and len(fields) < LEVELS:
            size = 64 * -(-SPARE * len(left) // 64)
            at = (_mix(left, len(fields)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            fields.append(alone.astype(np.uint8))
            left = left[~alone[at]]
        return cls(fields, left)

    def slots(self, d: np.ndarray) -> np.ndarray:
        """Slot of each digest; -1 for some of those that were not stored (others share a slot of one that was)."""
        out, open_ = np.full(len(d), -1, np.int64), np.arange(len(d))
        for k, field in enumerate(self.fields):
            at = (_mix(d[open_], k) % np.uint64(len(field))).astype(np.int64)
            hit = field[at] == 1
            out[open_[hit]] = self.base[k] + self.before[k][at[hit]]
            open_ = open_[~hit]
        for k, r in enumerate(self.rest):
            out[open_[(d[open_] == r).all(axis=1)]] = self.base[-1] + k
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<II", len(self.fields), len(self.rest)) + b"".join(struct.pack("<Q", len(f)) for f in self.fields)
        return head + b"".join(np.packbits(f, bitorder="little").tobytes() for f in self.fields) + self.rest.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[MinimalHash, int]:
        levels, rest = struct.unpack_from("<II", data, at)
        sizes = struct.unpack_from(f"<{levels}Q", data, at + 8)
        at += 8 + 8 * levels
        fields = []
        for n in sizes:
            fields.append(np.unpackbits(np.frombuffer(data, np.uint8, n // 8, at), bitorder="little"))
            at += n // 8
        return cls(fields, np.frombuffer(data, "<u8", 2 * rest, at).reshape(-1, 2)), at + 16 * rest


class IndexPart:
    """One bucket's hash and entries."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a whole index part")
        self.hash, at = MinimalHash.from_bytes(data, 8)
        self.entries = np.frombuffer(data, ENTRY, (len(data) - 4 - at) // ENTRY.itemsize, at)

    @staticmethod
    def encode(d: np.ndarray, shard, length, offset) -> bytes:
        own = MinimalHash.build(d)
        entries = np.zeros(len(d), ENTRY)
        at = own.slots(d)
        entries["mark"][at], entries["shard"][at] = fingerprints(d), shard
        entries["length"][at], entries["offset"][at] = length, offset
        data = MAGIC + own.to_bytes() + entries.tobytes()
        return data + struct.pack("<I", zlib.crc32(data))

    def find(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, whether stored) of the digests."""
        at = self.hash.slots(d)
        if not len(self.entries):
            return np.zeros(len(d), ENTRY), np.zeros(len(d), bool)
        got = self.entries[np.maximum(at, 0)]
        return got, (at >= 0) & (got["mark"] == fingerprints(d))


# ------------------------------------------------------------------ files

def shared_uri(spark: SparkSession, folder: str) -> str:
    """The folder's full address, a plain path being one of Spark's default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _open(uri: str):
    from pyarrow.fs import FileSystem
    return FileSystem.from_uri(uri)


class _Writer:
    """A file that gets its final name when it is complete."""

    def __init__(self, fs, folder: str, name: str) -> None:
        self.fs, self.final = fs, posixpath.join(folder, name)
        self.temp = posixpath.join(folder, f".{name}.{TaskContext.get().taskAttemptId()}.tmp")
        fs.create_dir(folder, recursive=True)
        self.out, self.size, self.crc = fs.open_output_stream(self.temp), 0, 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size, self.crc = self.size + len(data), zlib.crc32(data, self.crc)

    def close(self) -> None:
        from pyarrow.fs import FileType
        self.out.close()
        try:
            self.fs.move(self.temp, self.final)
        except OSError:  # stores that don't replace: an earlier attempt has put the same bytes there
            there = self.fs.get_file_info(self.final)
            if there.type != FileType.File or there.size != self.size:
                raise
            self.fs.delete_file(self.temp)


def shard_name(shard: int) -> str:
    return f"shard-{shard:07d}.bin"


def part_name(bucket: int) -> str:
    return f"part-{bucket:07d}.mph"


def document_key(doc_id, nth: int) -> str:
    """The key under which the ``nth`` row (from 0) of an id is found; a null id has keys of its own."""
    return f"{chr(0) if doc_id is None else doc_id}{chr(0)}{nth}"


def _key_column(doc_id: str, nth: str):
    return F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("\0")), F.lit("\0"), F.col(nth).cast("string"))


def _bucket_column(key, buckets: int):
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % F.lit(buckets)).cast("int")


def key_bucket(key: str, buckets: int) -> int:
    return int(hashlib.md5(key.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()[:8], 16) % buckets


# ------------------------------------------------------------------ writer

def _encode(uri: str, tokenizer_path: str, end_id: int, width: int):
    kind, end = f"<u{width}", np.array([end_id], f"<u{width}").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, out, at, last, nth = byte_bpe(tokenizer_path), None, 0, (), 0
        shard = TaskContext.get().partitionId()
        for b in batches:
            rows = []
            for i, text in zip(b["id"], b["text"]):
                if out is None:
                    fs, folder = _open(uri)
                    out = _Writer(fs, posixpath.join(folder, "shards"), shard_name(shard))
                i = None if pd.isna(i) else i
                nth = nth + 1 if last == (i,) else 0
                last = (i,)
                data = bpe.encode_to_numpy(text or "", allowed_special="all").astype(kind).tobytes() + end
                out.write(data)
                rows.append((i, nth, shard, at, len(data) // width))
                at += len(data) // width
            yield pd.DataFrame(rows, columns=["id", "nth", "shard", "at", "length"])
        if out is not None:
            out.close()

    return run


def _index(uri: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = _open(uri)
        held: list[pd.DataFrame] = []

        def solve() -> pd.DataFrame:
            p = pd.concat(held, ignore_index=True)
            bucket, p = int(p["bucket"].iloc[0]), p[p["key"].notna()]
            out = _Writer(fs, posixpath.join(folder, "index"), part_name(bucket))
            out.write(IndexPart.encode(digests(p["key"]), p["shard"], p["length"], p["at"]))
            out.close()
            return pd.DataFrame({"bucket": [bucket], "keys": [len(p)], "bytes": [out.size]})

        for b in batches:
            for bucket, g in b.groupby("bucket", sort=False):
                if held and bucket != held[0]["bucket"].iloc[0]:
                    yield solve()
                    held.clear()
                held.append(g)
        if held:
            yield solve()

    return run


def running_total(df: DataFrame, order: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows with a smaller ``order`` (a number from 0, rows different), in
    two steps, so that no window holds more than ``block`` rows or one row per block."""
    df = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    before = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = df.groupBy("_block").agg(F.sum(value).alias(value))
    blocks = blocks.select("_block", before(Window.orderBy("_block")).alias("_shift"))
    return (df.withColumn("_in", before(Window.partitionBy("_block").orderBy(order))).join(blocks, "_block")
            .withColumn(out, F.col("_in") + F.col("_shift")).drop("_block", "_in", "_shift"))


def write_archive(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, shard_bytes: int = SHARD_BYTES,
                  bucket_keys: int = BUCKET_KEYS, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode all rows of ``docs``, each closed by ``end_id``, into a new archive; returns its full address.

    Documents are ordered by id, null ids last, rows that repeat an id by a hash of their text; equal rows are
    interchangeable. The ``nth`` row of an id has a key of its own. A null text counts as empty and holds the end id
    alone. An empty table gives an archive without shards. Other columns are not read.
    """
    spark = docs.sparkSession
    uri = shared_uri(spark, folder)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bpe = byte_bpe(tokenizer_path)
    width = 2 if max(bpe.max_token_value, end_id) < 1 << 16 else 4
    order = ["last", "id", "tie", "row"]
    dealt = rows.select(F.col("id").isNull().alias("last"), "id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    dealt = dealt.repartitionByRange(max(1, -(-size // shard_bytes)), *order).sortWithinPartitions(*order)
    kind = rows.schema["id"].dataType.simpleString()
    placed = materialize(dealt.select("id", "text").mapInPandas(
        _encode(uri, tokenizer_path, end_id, width), f"id {kind}, nth long, shard int, at long, length long"), "placed")
    shards = placed.groupBy("shard").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("length").alias("ids"), F.min_by("id", "at").alias("first_id"),
        F.max_by("id", "at").alias("last_id"), (F.max_by("nth", "at") + 1).alias("of_last"))
    running_total(shards, "shard", "ids", "ids_before").write.parquet(uri + "/manifest")
    shards = spark.read.parquet(uri + "/manifest")
    # an id's rows may go on in later shards: what earlier shards end with counts for the first id of a shard
    ends = shards.select(F.col("last_id").alias("id"), "shard", F.col("of_last").alias("n"), F.lit(False).alias("begins"))
    begins = shards.select(F.col("first_id").alias("id"), "shard", F.lit(0).cast("long").alias("n"), F.lit(True).alias("begins"))
    earlier = Window.partitionBy("id").orderBy("shard").rangeBetween(Window.unboundedPreceding, -1)
    begun = (ends.unionByName(begins).withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where("begins")
             .select("shard", F.col("id").alias("begun_id"), "earlier"))
    numbered = placed.join(begun, "shard").withColumn("nth", F.col("nth") + F.when(F.col("id").eqNullSafe(F.col("begun_id")), F.col("earlier")).otherwise(0))
    numbered.select("id", "nth", "shard", "at", "length").write.parquet(uri + "/docs")
    table = spark.read.parquet(uri + "/docs")
    buckets = max(1, -(-table.count() // bucket_keys))
    spark.createDataFrame([(width, end_id, buckets)], "width int, end_id int, buckets int").coalesce(1).write.parquet(uri + "/layout")
    keyed = table.select(_key_column("id", "nth").alias("key"), "shard", "at", "length")
    keyed = keyed.withColumn("bucket", _bucket_column(F.col("key"), buckets))
    every = spark.range(buckets).select(F.lit(None).cast("string").alias("key"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("at"),
                                        F.lit(0).cast("long").alias("length"), F.col("id").cast("int").alias("bucket"))
    keyed = keyed.unionByName(every)  # a bucket without keys has a part as well, so a missing file is an error
    keyed = keyed.repartition("bucket").sortWithinPartitions("bucket")
    keyed.mapInPandas(_index(uri), "bucket int, keys long, bytes long").write.parquet(uri + "/index_manifest")
    return uri


# ------------------------------------------------------------------ readers

class TokenArchive:
    """Keyed access to an archive: a constant number of reads for each document."""

    def __init__(self, uri: str, width: int, buckets: int) -> None:
        self.fs, self.folder = _open(uri)
        self.width, self.buckets = width, buckets

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> TokenArchive:
        uri = shared_uri(spark, folder)
        row = spark.read.parquet(uri + "/layout").first()
        return cls(uri, row["width"], row["buckets"])

    def part(self, bucket: int) -> IndexPart:
        with self.fs.open_input_stream(posixpath.join(self.folder, "index", part_name(bucket))) as f:
            return IndexPart(f.read())

    def shard(self, shard: int):
        return self.fs.open_input_file(posixpath.join(self.folder, "shards", shard_name(shard)))

    def ids(self, file, offset: int, length: int) -> np.ndarray:
        """``length`` ids from place ``offset`` of an open shard, as unsigned 32-bit numbers."""
        data = file.read_at(length * self.width, offset * self.width)
        if len(data) != length * self.width:
            raise ValueError("the shard ends early")
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def get(self, doc_id, nth: int = 0) -> np.ndarray | None:
        """The ids of one document; None if the archive has no such key."""
        key = document_key(doc_id, nth)
        entry, known = self.part(key_bucket(key, self.buckets)).find(digests([key]))
        if not known[0]:
            return None
        with self.shard(int(entry["shard"][0])) as f:
            return self.ids(f, int(entry["offset"][0]), int(entry["length"][0]))


def _look_up(uri: str, width: int, buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive, at, part = TokenArchive(uri, width, buckets), None, None
        for b in batches:
            for bucket, g in b.groupby("bucket", sort=False):
                if bucket != at:
                    at, part = bucket, archive.part(int(bucket))
                entries, known = part.find(digests(g["key"]))
                out = pd.DataFrame({"id": g["id"].array, "nth": g["nth"].array, "shard": entries["shard"].astype(np.int32),
                                    "at": entries["offset"].astype(np.int64), "length": entries["length"].astype(np.int64)})
                yield out[known]
    return run


def _read(uri: str, width: int, buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive, at, file = TokenArchive(uri, width, buckets), None, None
        for b in batches:
            for _, g in b.groupby(b["length"].cumsum() // STEP, sort=False):  # long documents leave in small batches
                ids = []
                for shard, offset, length in zip(g["shard"], g["at"], g["length"]):
                    if shard != at:
                        if file is not None:
                            file.close()
                        at, file = shard, archive.shard(int(shard))
                    ids.append(archive.ids(file, int(offset), int(length)).tobytes())
                yield g.assign(ids=ids)
        if file is not None:
            file.close()
    return run


def read_documents(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """(id, nth, start, n_tokens, ids) of the documents that the archive holds of ``keys`` (id, nth): found by the
    index, read from the shards. ``start`` is the number of ids before the document in the whole archive, ``ids``
    the document's ids as little-endian unsigned 32-bit numbers. Keys that were not stored give no row."""
    uri = shared_uri(spark, folder)
    layout = spark.read.parquet(uri + "/layout").first()
    args = uri, layout["width"], layout["buckets"]
    kind = keys.schema["id"].dataType.simpleString()
    asked = keys.select("id", F.col("nth").cast("long").alias("nth"), _key_column("id", "nth").alias("key"))
    asked = asked.withColumn("bucket", _bucket_column(F.col("key"), layout["buckets"]))
    found = asked.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(
        _look_up(*args), f"id {kind}, nth long, shard int, at long, length long")
    firsts = spark.read.parquet(uri + "/manifest").select("shard", "ids_before")
    found = found.join(firsts, "shard").repartition("shard").sortWithinPartitions("shard", "at")
    found = found.select("id", "nth", "shard", "at", "length", "ids_before")
    read = found.mapInPandas(_read(*args), f"id {kind}, nth long, shard int, at long, length long, ids_before long, ids binary")
    return read.select("id", "nth", (F.col("ids_before") + F.col("at")).alias("start"), F.col("length").alias("n_tokens"), "ids")
