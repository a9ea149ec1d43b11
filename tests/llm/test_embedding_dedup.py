import numpy as np
from riskframe.llm import embedding_dedup


def _expected(rows, least):
    n = len(rows)
    ok = [i for i, (k, v, lab) in enumerate(rows) if k is not None and lab is not None and v and
          all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                    links[a] += 1
                    links[b] += 1
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    low = {}
    for i in range(n):
        k = rows[i][0]
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return [(rows[i][0], links[i], low.get(find(i)), rows[i][0] is not None and rows[i][0] == low.get(find(i))) for i in range(n)]


def test_against_all_pairs(spark, monkeypatch):
    r = np.random.default_rng(11)
    rows, k = [], 1000
    for c in range(40):
        centre = r.normal(size=32)
        for _ in range(int(r.integers(1, 8))):
            rows.append((k, (centre + r.normal(size=32) * 0.08).astype(np.float32).tolist(), int(c % 3)))
            k -= 1
    rows += [(5000 + i, rows[0][1], rows[0][2]) for i in range(30)]  # copies
    rows += [(6000, None, 0), (6001, [0.0] * 32, 0), (6002, [float("nan")] + [1.0] * 31, 0), (6003, [None] + [1.0] * 31, 0),
             (6004, rows[0][1], None), (None, rows[0][1], rows[0][2]), (6005, [float("inf")] + [1.0] * 31, 0), (6006, [], 0),
             (6007, [1.0, 2.0], 0), (6008, [2.0, 4.0], 0), (6009, rows[0][1], 7)]
    df = spark.createDataFrame([(a, b, c, 1, "x") for a, b, c in rows],
                               "vec_id long, embedding array<float>, label int, node int, k1 string")
    want = sorted(_expected(rows, 0.93), key=str)
    assert sum(x[1] for x in want) > 500
    for limit in (8_000, 20):  # also with lists cut into slices
        monkeypatch.setattr(embedding_dedup, "LIST", limit)
        got = sorted((tuple(x) for x in embedding_dedup.embedding_components(df, 0.93).collect()), key=str)
        found, exist = sum(x[1] for x in got), sum(x[1] for x in want)
        assert found / exist >= 0.99 and len(got) == len(rows)
        over = {x[0]: x[1] for x in got}
        assert all(over[x[0]] <= x[1] for x in want if x[0] is not None)
        if found == exist:
            assert got == want
    assert embedding_dedup.embedding_components(df.where("false"), 0.93).count() == 0


def test_lowest_shared_bit():
    both = np.array([[0, 0], [8, 0], [0, 1], [1 << 63, 5]], np.uint64)
    assert embedding_dedup._lowest_shared(both).tolist() == [-1, 3, 64, 63]


def test_near_copies_of_a_third_of_all_rows(spark):
    r = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    n, centre = 1500, unit(r.normal(size=(1, 64)))
    off = r.normal(size=(n // 3, 64))
    off = unit(off - off @ centre.T * centre)
    x = np.vstack([0.97 * centre + np.sqrt(1 - 0.97**2) * off, unit(r.normal(size=(n - n // 3, 64)))])
    cosine = unit(x) @ unit(x).T
    exist = int((cosine >= 0.93).sum()) - n
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.embedding_components(df, 0.93).collect()
    assert exist > 100_000 and 0.99 <= sum(g["n_links"] for g in got) / exist <= 1


def test_pivots_keep_apart():
    r = np.random.default_rng(3)
    x = embedding_dedup._unit(np.vstack([r.normal(size=(1, 16)) + r.normal(size=(300, 16)) * 0.01, r.normal(size=(300, 16))]))
    p = embedding_dedup.spread_pivots(x, 20)
    assert len(p) == 20 and (np.triu(p @ p.T, 1) < 0.65).all()
    assert len(embedding_dedup.spread_pivots(x[:300], 20)) == 1
