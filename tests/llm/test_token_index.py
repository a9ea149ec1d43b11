import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import plain
from riskframe.llm import token_index as ti
from riskframe.llm.queries import _tokenizer_file




def test_minimal_hash_is_a_bijection():
    keys = [f"doc-{k}" for k in range(5000)]
    d = ti.digests(keys)
    own = ti.MinimalHash.build(d)
    assert sorted(own.slots(d)) == list(range(5000))
    again, _ = ti.MinimalHash.from_bytes(own.to_bytes())
    assert (again.slots(d) == own.slots(d)).all()
    assert len(own.to_bytes()) * 8 / 5000 < 4.5  # bits for a key
    with pytest.raises(ValueError):
        ti.MinimalHash.build(ti.digests(["a", "b", "a"]))


def test_levels_that_run_out(monkeypatch):
    monkeypatch.setattr(ti, "LEVELS", 1)
    d = ti.digests([str(k) for k in range(300)])
    own, _ = ti.MinimalHash.from_bytes(ti.MinimalHash.build(d).to_bytes())
    assert len(own.rest) and sorted(own.slots(d)) == list(range(300))


def test_part_tells_foreign_keys():
    d = ti.digests([str(k) for k in range(1000)])
    part = ti.IndexPart(ti.IndexPart.encode(d, np.arange(1000), np.arange(1000) + 1, np.arange(1000) * 7))
    got, known = part.find(d)
    assert known.all() and (got["offset"] == np.arange(1000) * 7).all() and (got["length"] == np.arange(1000) + 1).all()
    assert not part.find(ti.digests([f"x{k}" for k in range(20_000)]))[1].any()
    data = bytearray(ti.IndexPart.encode(d, 0, 0, 0))
    data[40] ^= 1
    with pytest.raises(ValueError):
        ti.IndexPart(bytes(data))


ROWS = ([(k, f"text number {k} " + "lorem ipsum " * (k % 7)) for k in range(60, 0, -1)]
        + [(None, f"no id {k % 5}") for k in range(40)] + [(7, "again seven"), (7, "again seven"), (8, None), (9, ""), (-3, "minus <|endoftext|> x"),
           (1 << 60, "é 漢字 \U0001f600 " * 50), (500, "long " * 20_000)])


def _read(spark, folder):
    keys = spark.read.parquet(folder + "/docs").select("id", "nth")
    return ti.read_documents(spark, folder, keys).collect()


def test_round_trip(spark, tmp_path):
    path = _tokenizer_file()
    docs = spark.createDataFrame(plain.doc_rows(ROWS), plain.DOC_SCHEMA).repartition(4)
    docs = docs.withColumnRenamed("lang", "shard").withColumnRenamed("source", "row")  # clashing names
    folder = ti.write_archive(docs, str(tmp_path / "a"), path, end_id=2, shard_bytes=1500, bucket_keys=16)
    got = sorted(_read(spark, folder), key=lambda r: r["start"])
    own = Tokenizer.from_file(path)
    expected = {}
    for i, t in ROWS:
        expected.setdefault(i, []).append(own.encode(t or "", add_special_tokens=False).ids + [2])
    assert [r["id"] for r in got] == sorted((i for i, _ in ROWS if i is not None)) + [None] * 40
    at, seen = 0, {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == at and r["n_tokens"] == len(ids) and ids in expected[r["id"]]
        expected[r["id"]].remove(ids)
        assert r["nth"] == seen.get(r["id"], 0)
        seen[r["id"]] = r["nth"] + 1
        at += len(ids)
    assert not any(expected.values())
    assert spark.read.parquet(folder + "/manifest").count() > 5
    archive = ti.TokenArchive.open(spark, folder)
    assert archive.get(500).tolist() == own.encode("long " * 20_000, add_special_tokens=False).ids + [2]
    assert archive.get(8, 1) is not None and archive.get(None, 39) is not None
    assert archive.get(8, 2) is None and archive.get(10_000) is None and archive.get(None, 40) is None
    # the same rows dealt otherwise give the same shards
    other = ti.write_archive(docs.repartition(2), str(tmp_path / "b"), path, end_id=2, shard_bytes=1 << 30)
    total = lambda f: zlib.crc32(b"".join((tmp_path / f / "shards" / p).read_bytes() for p in sorted(x.name for x in (tmp_path / f / "shards").glob("shard*"))))
    assert total("a") == total("b") and other != folder


def test_no_rows(spark, tmp_path):
    folder = ti.write_archive(spark.createDataFrame([], plain.DOC_SCHEMA), str(tmp_path / "e"), _tokenizer_file())
    assert _read(spark, folder) == []
    assert ti.TokenArchive.open(spark, folder).get(1) is None
