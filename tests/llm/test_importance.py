import hashlib
import math
import zlib
from collections import Counter

import plain
from riskframe.llm import importance as imp




def expected(rows, items, longest=1, buckets=10_000, percent=10, least_words=20):
    def features(t):
        w = [x.encode() for x in plain.words(t)]
        return [zlib.crc32(b" ".join(w[k:k + n])) % buckets for n in range(1, longest + 1) for k in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(features(x))
    for x in items:
        t.update(features(x))
    n_s, n_t, out = sum(s.values()), sum(t.values()), []
    for i, x in rows:
        f = features(x)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in f]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(plain.words(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[5] = k + 1
    return out


def _key(r):
    return tuple((x is None, x or 0) for x in r)


def drawn(spark, rows, items, **args):
    docs = spark.createDataFrame(plain.doc_rows(rows), plain.DOC_SCHEMA).repartition(3)
    docs = docs.withColumnRenamed("lang", "rank").withColumnRenamed("source", "weight")  # clashing names
    target = spark.createDataFrame([(k, x) for k, x in enumerate(items)], "item_id long, text string")
    out = imp.importance_sample(docs, target, carry=["rank"], **args).collect()
    assert all(r["carried"]["rank"] == "en" for r in out)
    return [list(r[:6]) for r in out]


def _texts():
    words = ["alpha", "Beta", "gamma-ray", "délta", "x1", "7", "Ωmega", "the", "the", "the"]
    return [(k, " ".join(words[(k * j + j) % 10] for j in range(k % 45)) + "  ,. !") for k in range(150)]


def test_against_plain_version(spark):
    rows = _texts() + [(None, "the alpha " * 15), (3, "again " * 30), (3, "again " * 30), (200, None), (201, ""), (202, ". , !"),
                       (203, "long x1 " * 30_000)]
    items = ["alpha gamma ray the quick", "délta délta", "", None]
    for longest in (1, 2, 3):
        got = drawn(spark, rows, items, longest=longest, percent=30)
        assert sorted(got, key=_key) == sorted(expected(rows, items, longest=longest, percent=30), key=_key)


def test_tail_and_head_agree(monkeypatch):
    words = imp.word_list("One two three two one TWO zwölf 12 " * 3)
    whole = imp.Head([b"one", b"two"], [(b"two", b"three"), (b"one", b"two")])
    for longest in (1, 2, 3):
        assert whole.features(words, longest) == imp.Head().features(words, longest)


def test_summaries_are_bounded():
    kept = imp._lower(Counter({str(k): 1 + 1000 * (k == 5) for k in range(100)}), 50)
    assert kept["5"] == 1000 and len(kept) <= 50


def test_no_rows_and_no_target(spark):
    assert drawn(spark, [], ["a b"]) == []
    rows = _texts()
    got = drawn(spark, rows, [])
    assert sorted(got, key=_key) == sorted(expected(rows, []), key=_key)
