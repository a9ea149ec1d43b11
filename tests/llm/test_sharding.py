import zlib

import numpy as np
import plain
from riskframe.llm import sharding


def naive_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [k for k, r in enumerate(bins) if r >= s]
        k = min(fits, key=lambda k: (bins[k], k)) if fits else len(bins)
        if not fits:
            bins.append(max(capacity, s))
        bins[k] -= s
    return sorted(bins)


def test_classes_pack_like_item_by_item_best_fit():
    r = np.random.default_rng(1)
    for _ in range(60):
        sizes = r.integers(1, 60, r.integers(1, 200)).tolist()
        runs = sharding.pack_classes(sorted(((s, sizes.count(s)) for s in set(sizes)), reverse=True), 100)
        room = {}
        for s, a, b, k in runs:
            room[k] = room.get(k, 100) - s * (b - a)
        assert sorted(room.values()) == naive_best_fit(sizes, 100)
        assert sum(b - a for _, a, b, _ in runs) == len(sizes)


def test_tree_finds_the_tightest_bin():
    r, tree, held = np.random.default_rng(2), sharding.CapacityTree(), []
    for k in range(3000):
        if held and r.random() < 0.4:
            size = int(r.integers(0, 1000))
            want = min((x for x in held if x[0] >= size), default=None)
            assert tree.take_tightest(size) == want
            if want:
                held.remove(want)
        else:
            held.append((int(r.integers(0, 1000)), k))
            tree.add(*held[-1])


def test_documents(spark):
    r = np.random.default_rng(3)
    texts = ["é" * int(n) for n in r.integers(0, 300, 400)] + ["x" * 70_000] + ["same"] * 500 + [None, None, "", ""]
    rows = [(i if i % 50 else None, t, i, "b") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + [rows[3]], "doc_id long, text string, shard int, _group string")
    out = sharding.shard_documents(df, 8).collect()
    assert len(out) == len(rows) + 1
    loads, where = np.zeros(8, int), {}
    for s in range(8):
        assert sorted(x["slot"] for x in out if x["shard"] == s) == list(range(sum(x["shard"] == s for x in out)))
    for x in out:
        loads[x["shard"]] += x["size"]
    by_id = {x["doc_id"]: x for x in out if x["doc_id"] is not None}
    for i, t, *_ in rows:
        if i is not None:
            x = by_id[i]
            assert x["size"] == len((t or "").encode()) + 1 and x["text_crc32"] == (None if t is None else zlib.crc32(t.encode()))
            assert where.setdefault(t, x["shard"]) == x["shard"]
    loads = sorted(loads)  # the long text fills a shard alone, the others are even
    assert loads[7] == 70_001 and loads[6] - loads[0] <= 20
    assert sharding.shard_documents(df.where("false"), 8).count() == 0


def test_fixed_capacity(spark):
    df = spark.createDataFrame([(k, 1 + k % 9) for k in range(300)] * 2, "k long, n long")
    got = {x["k"]: x["shard"] for x in sharding.shard_groups(df, "k", "n", capacity=50).collect()}
    loads = {}
    for k, s in got.items():
        loads[s] = loads.get(s, 0) + 2 * (1 + k % 9)
    assert len(got) == 300 and max(loads.values()) <= 50
    assert len(loads) == len(naive_best_fit([2 * (1 + k % 9) for k in range(300)], 50))


def _loads(classes, shards):
    loads, seen = [0] * shards, {}
    for size, a, b, k in sharding.balance_classes(classes, shards):
        loads[k] += size * (b - a)
        assert a == seen.get(size, 0) and b > a
        seen[size] = b
    assert seen == dict(classes)
    return loads


def test_few_large_equal_groups_leave_no_shard_empty():
    assert sorted(_loads([(1000, 17)], 8)) == [2000] * 7 + [3000]
    assert sorted(_loads([(1000, 12)], 8)) == [1000] * 4 + [2000] * 4
    assert sorted(_loads([(5000, 20), (10, 50)], 8))[0] >= 10_000
    assert sorted(_loads([(7, 3)], 8)) == [0] * 5 + [7] * 3 and _loads([], 8) == [0] * 8
    assert sorted(_loads([(1 << 40, 1), (3, 70)], 8)) == [30] * 7 + [1 << 40]
    r = np.random.default_rng(5)
    for _ in range(40):
        sizes = r.integers(1, 5000, 60).tolist()
        loads = _loads(sorted(((s, sizes.count(s)) for s in set(sizes)), reverse=True), 8)
        assert max(loads) - min(loads) <= max(sizes) and min(loads) > 0


def test_large_equal_groups_through_the_operator(spark):
    rows = [(k, chr(97 + k % 17) * 999) for k in range(17)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    assert sorted(sum(x["size"] for x in out if x["shard"] == s) for s in range(8)) == [2000] * 7 + [3000]
