import numpy as np
import pandas as pd
import plain
from riskframe.llm import suffix_dedup


def _texts():
    r = np.random.default_rng(13)
    say = lambda n: "".join(chr(97 + c) for c in r.integers(0, 26, n))
    passage, other = say(90), say(64)
    out = [say(int(n)) for n in r.integers(0, 400, 30)]
    out += [say(50) + passage + say(70), passage, say(10) + passage[:-1], passage[5:75] + say(5), other + say(9), say(3) + other,
            "ab" * 120, "z" * 300, "zz" + "z" * 100 + "y", say(20) + "é" * 60, "é" * 45 + "x", None, "", say(59), passage + say(4) + passage]
    out += [out[3]] * 4 + [say(8) + other[:63]] + [f"{say(6)}{passage[10:80]}{say(6)}" for _ in range(12)]
    return out


def test_removed_bytes_equal_brute_force_also_without_collections(spark, monkeypatch):
    texts = _texts()
    rows = [(i if i != 7 else None, t, 1, "h") for i, t in enumerate(texts)] + [(2, texts[2], 1, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, place int, ranges string")
    want = plain.repeated_bytes([t for _, t, *_ in rows], 60)
    for limit in (8192, 2):  # the second resolves most collections by hashes of strings
        monkeypatch.setattr(suffix_dedup, "GROUP", limit)
        got = sorted(((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"]))
                      for x in suffix_dedup.dedup_substrings(df, 60, 20).collect()), key=str)
        assert got == sorted(((i, *w) for (i, *_), w in zip(rows, want)), key=str)
    assert suffix_dedup.dedup_substrings(df.where("false"), 60, 20).count() == 0


def test_runs_cover_every_string_once_and_long_texts_are_cut(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    data = [t.encode() for t in _texts() if t] + ["".join(_texts()[:20]).encode() * 3]
    frame = pd.DataFrame({"k1": range(len(data)), "k2": 0, "data": data})
    seen = set()
    for out in suffix_dedup._find_runs(60, 20)([frame]):
        for k, h, place in zip(out["k1"], out["h"], out["place"]):
            start, n, anchor = place >> 20, (place >> 10) & 1023, place & 1023
            d = data[k]
            assert suffix_dedup.gram_hashes(np.frombuffer(d, np.uint8), 20).view(np.int64)[start + anchor] == h
            for s in range(start, start + n):
                assert (k, s) not in seen and s <= start + anchor <= s + 40
                seen.add((k, s))
    assert seen == {(k, s) for k, d in enumerate(data) for s in range(len(d) - 59)}


def test_columns_sort_like_suffixes():
    r = np.random.default_rng(14)
    base = bytes(r.integers(97, 99, 40, dtype=np.uint8))
    ctx = [bytes(r.integers(97, 99, 40, dtype=np.uint8)) for _ in range(30)] + [base[:30] + b"x" * 10, base, b"y" * 10 + base[10:]]
    group = np.array([0] * 20 + [1] * 13)
    flags = suffix_dedup.repeated_strings(group, ctx, np.full(33, 29), np.full(33, 30), 11)
    for i in range(33):
        for s in range(30):
            same = any(group[j] == group[i] and j != i and ctx[j][s:s + 11] == ctx[i][s:s + 11] for j in range(33))
            assert flags[i, s] == same


def test_hot_keys_are_cut_without_losing_a_pair(spark, monkeypatch):
    from pyspark.sql import functions as F
    from riskframe.llm import common
    monkeypatch.setattr(common, "TASK_ROWS", 20)
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500).alias("h"))
    keys = common.materialize(rows.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "keys")
    out = common.join_counted(rows, keys, ["h"], "m", ["id"])
    assert sorted(map(tuple, out.select("id", "h", "m").collect())) == sorted(map(tuple, rows.join(keys, "h").select("id", "h", "m").collect()))
    cut = rows.join(keys.where("m > 1000"), "h").count()
    assert cut > 1000 and common.join_counted(rows.where("false"), keys.where("false"), ["h"], "m", ["id"]).count() == 0


def test_hot_anchor_equals_brute_force(spark, monkeypatch):
    from riskframe.llm import common
    monkeypatch.setattr(common, "TASK_ROWS", 5)
    texts = [f"{i:03d}" + "common passage " * 6 + f"tail {i % 4}" * 9 for i in range(80)] + _texts()
    want = plain.repeated_bytes(texts, 60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"]))
                 for x in suffix_dedup.dedup_substrings(df, 60, 20).collect())
    assert got == [(i, *w) for i, w in enumerate(want)]
