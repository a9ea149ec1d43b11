import numpy as np
import plain
from riskframe.llm import simhash


def test_fingerprints_equal_the_definition():
    texts = [None, "", " \t\n", "one", "One TWO", "a b c", "a b c d É É a b c" * 9, "x\x0by\x0cz w", "ÄÖ ß x y z"]
    assert [simhash.fingerprint(t) for t in texts] == [plain.simhash(t) for t in texts]


def _fps(seed, n, near):
    r = np.random.default_rng(seed)
    base = r.integers(0, 1 << 63, n, dtype=np.uint64)
    out = list(base)
    for x in base[:near]:
        for _ in range(12):
            y = x
            for b in r.integers(0, 64, r.integers(1, 5)):
                y ^= np.uint64(1) << np.uint64(b)
            out.append(y)
    return np.unique(np.array(out, np.uint64))


def test_links_equal_brute_force_also_in_slices(spark, monkeypatch):
    f = _fps(7, 300, 25)
    want = plain.components([int(x) for x in f], lambda a, b: (a ^ b).bit_count() <= 3)
    order = np.argsort(np.bitwise_count(f), kind="stable")
    root = simhash.link_forest(f[order], 3)
    assert [tuple(sorted(g)) for g in _groups(order, root)] == [tuple(sorted(g)) for g in _groups(np.arange(len(f)), want)]
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
    from riskframe.operators.components import component_labels
    hot = np.unique(np.concatenate([f, np.array([1 << i for i in range(48)], np.uint64)]))
    hot_df = spark.createDataFrame([(int(x),) for x in hot.view(np.int64)], "fp long")
    for frame, keys, limit, blocks in ((df, f, 20_000, None), (df, f, 20_000, 6), (hot_df, hot, 8, None)):
        monkeypatch.setattr(simhash, "GROUP", limit)
        labels = {r["id"]: r["label"] for r in component_labels(simhash.near_links(frame, 3, blocks), "a", "b").collect()}
        names = [int(x) for x in keys.view(np.int64)]
        got = [labels.get(x, x) for x in names]
        exp = plain.components([int(x) for x in keys], lambda a, b: (a ^ b).bit_count() <= 3)
        assert len({(a, b) for a, b in zip(got, exp)}) == len(set(got)) == len(set(exp))


def _groups(ids, roots):
    by = {}
    for i, r in zip(ids, roots):
        by.setdefault(int(r), []).append(int(i))
    return sorted(by.values(), key=min)


def test_documents(spark):
    r = np.random.default_rng(9)
    texts = [" ".join(f"w{i}" for i in r.integers(0, 500, 120)) for _ in range(20)]
    rows = [(40 - i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, t + " w1") for i, t in enumerate(texts[:8])] + [(200, ""), (201, None), (202, "  "), (None, texts[3])]
    rows += [rows[0]]
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got = [(x["doc_id"], x["fingerprint"], x["component_id"]) for x in simhash.simhash_components(df).collect()]
    fps = [plain.simhash(t) for _, t in rows]
    root = plain.components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    low = {}
    for (i, _), g in zip(rows, root):
        low[g] = min([x for x in (low.get(g), i) if x is not None], default=None)
    assert sorted(got, key=str) == sorted([(i, f"{f:016x}", low[g]) for (i, _), f, g in zip(rows, fps, root)], key=str)
    assert simhash.simhash_components(df.where("false")).count() == 0
