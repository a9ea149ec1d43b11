import numpy as np
import plain
from riskframe.llm import decontaminate


def test_against_a_plain_version(spark):
    r = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(30)] + ["Über", "ß1", "日本"]
    say = lambda n: [vocab[i] for i in r.integers(0, len(vocab), n)]
    items = [(1, " ".join(say(25))), (2, "-".join(say(10))), (3, "W1 w2, w3!"), (4, "w5"), (5, ""), (6, None), (7, "..."),
             (None, " ".join(say(12))), (10, " ".join(say(14)))]
    items.append((11, items[0][1]))
    long_words = [w for _, t in items for w in plain.words(t)]
    docs = [(i, " ".join(say(int(r.integers(0, 60))))) for i in range(40)]
    docs += [(100 + k, " ".join(say(5) + plain.words(items[0][1])[a:a + n] + say(5)))
             for k, (a, n) in enumerate([(0, 10), (3, 9), (15, 10), (2, 20), (0, 25)])]
    docs += [(200, None), (201, ""), (202, "!!"), (None, " ".join(plain.words(items[1][1]))),
             (203, " ".join(say(3000) + long_words)), (204, items[-1][1].upper())]
    schema = "doc_id long, text string, w string, hits string"
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs + docs[40:42]], schema)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, len int")
    for used in (items, [x for x in items if len(plain.words(x[1])) >= 10]):
        some = bench.where("size(split(trim(text), '[ -]')) >= 10") if used is not items else bench
        got = decontaminate.contamination(df, some)
        rows = sorted(((x["doc_id"] is None, x["doc_id"], x["n_words"], x["n_hit"], x["item_ids"]) for x in got.collect()), key=str)
        want = plain.contamination(docs + docs[40:42], used)
        assert rows == sorted(((i is None, i, *rest) for i, *rest in want), key=str)
        assert "PythonUDF" not in got._jdf.queryExecution().toString() and "Pandas" not in got._jdf.queryExecution().toString()
    assert decontaminate.contamination(df.where("false"), bench).count() == 0
    none = decontaminate.contamination(df, bench.where("false")).collect()
    assert len(none) == len(docs) + 2 and all(x["n_hit"] == 0 and x["item_ids"] == [] for x in none)


def test_a_long_text_that_is_hit_throughout(spark):
    # the work has to grow with the text, not with its square
    r = np.random.default_rng(8)
    text = " ".join(f"w{k}" for k in r.integers(0, 50_000, 60_000))
    docs = spark.createDataFrame([(1, text), (1, text), (2, "w1 w2")], "doc_id long, text string")
    items = spark.createDataFrame([(7, text), (8, "w1 w2")], "item_id long, text string")
    out = decontaminate.contamination(docs, items).collect()
    got = sorted((x["doc_id"], x["n_words"], x["n_hit"], x["item_ids"][0]) for x in out)
    assert got[:2] == [(1, 60_000, 60_000, "7")] * 2 and got[2] == (2, 2, 2, "8")
