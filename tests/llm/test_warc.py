import os
import tempfile

import plain
import pytest
from riskframe.llm import warc


def _pages(spark):
    big = "<p>é</p>" * 300
    rows = [(i, f"http://h/{i % 7}?q=a b", "<html>" + "x" * (i * 37)) for i in range(60)]
    rows += [(100, "u", big), (7000000000000000001, "v", big), (102, None, big), (103, "w", "short"), (104, "w", "short"), (105, "w", None),
             (106, "w", ""), (None, "n", big), (107, "z", "a\r\n\r\nb\r\n" * 400), (100, "u", big), (108, "l", "y" * 3_000_000)]
    schema = "page_id long, url string, html string, digest string, _shard int"
    return rows, spark.createDataFrame([(*x, "d", 1) for x in rows], schema)


def _expected(rows):
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = len(data) >= 1000 and (h or "") in last and i != last[h or ""]
        out.append((i, len(data), plain.sha1(data), "revisit" if revisit else "response", last[h or ""] if revisit else None,
                    None if revisit else data))
    return sorted(out, key=str)


def test_round_trip_rolls_files_and_is_repeatable(spark):
    rows, df = _pages(spark)
    kept = []
    for parts in (1, 5):
        folder = os.path.join(tempfile.mkdtemp(prefix="warc-"), "a")
        manifest = warc.write_warc(df.repartition(parts), folder, shard_bytes=20_000, file_bytes=1500).collect()
        got = [(x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"],
                None if x["payload"] is None else bytes(x["payload"])) for x in warc.read_warc(spark, folder).collect()]
        assert sorted(got, key=str) == _expected(rows)
        assert len({m["shard"] for m in manifest}) > 3 and any(m["part"] for m in manifest)
        names = sorted(os.listdir(os.path.join(folder, "data")))
        assert names == sorted(m["file"] for m in manifest)  # no temporary names are left
        kept.append({m["file"]: (m["sha256"], m["records"], m["bytes"]) for m in manifest})
    assert kept[0] == kept[1]


@pytest.mark.parametrize("id_", [None, 5])
def test_one_id_fills_many_shards(spark, id_):
    rows = [(i, f"http://h/{i}", f"page {i} " + "x" * 900) for i in range(200)]
    rows += [(id_, f"http://n/{i}", f"other {i} " + "y" * 900) for i in range(100)]
    rows += [(id_, f"http://m/{i}", "same " * 200) for i in range(100)]  # one payload, many URLs
    folder = os.path.join(tempfile.mkdtemp(prefix="warc-"), "a")
    manifest = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), folder,
                               shard_bytes=20_000, file_bytes=1 << 20).collect()
    assert max(m["records"] for m in manifest) < 40 and sum(m["records"] for m in manifest) == 400
    got = [(x["page_id"], x["url"], bytes(x["payload"] or b"").decode()) for x in warc.read_warc(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)


def test_only_missing_ids(spark):
    folder = os.path.join(tempfile.mkdtemp(prefix="warc-"), "a")
    warc.write_warc(spark.createDataFrame([(None, "u", "a" * 2000)] * 3, "page_id long, url string, html string"), folder)
    assert [x["record_type"] for x in warc.read_warc(spark, folder).collect()] == ["response"] * 3


def test_empty_table_and_damage(spark):
    _, df = _pages(spark)
    folder = os.path.join(tempfile.mkdtemp(prefix="warc-"), "e")
    assert warc.write_warc(df.where("false"), folder).count() == 0 and warc.read_warc(spark, folder).count() == 0
    record = warc.warc_record(1, "u", b"payload", plain.sha1(b"payload"), None, "", warc.EMPTY_DATE)
    assert warc.parse_record(record)[0] == 1
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"payload", b"paylaod"))
