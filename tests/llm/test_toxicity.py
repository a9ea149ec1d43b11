import zlib

import numpy as np
from riskframe.llm import toxicity


def _corpus(n=600):
    r = np.random.default_rng(17)
    rows, labels = [], []
    for i in range(n):
        ws = [f"w{k}" for k in r.integers(0, 300, int(r.integers(5, 60)))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                ws.insert(int(r.integers(0, len(ws))), str(r.choice(["dolt", "oafish", "cretinous"])))
        rows.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    return rows, labels


def test_scores(spark):
    rows, labels = _corpus()
    odd = [(None, "you oafish dolt"), (9001, None), (9002, ""), (9003, " \n "), (9004, "w1 " * 40_000 + "dolt"), rows[5]]
    df = spark.createDataFrame([(i, t, "f", 0.5, None) for i, t in rows + odd],
                               "doc_id long, text string, features string, score double, label int")
    lab = spark.createDataFrame([(*x, 1) for x in labels] + [(None, 1, 0), (3, None, 0), (4, 1, 0)], "doc_id long, toxic int, quality int")
    out = toxicity.toxicity_scores(df, lab).collect()
    assert len(out) == len(rows) + len(odd)
    truth = dict(labels)
    for x in out:
        assert 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7)
        assert x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1)
    held = [x for x in out if x["held_out"] and x["doc_id"] in truth]
    assert np.mean([x["predicted"] == truth[x["doc_id"]] for x in held]) > 0.97
    by = {x["doc_id"]: x["score"] for x in out}
    assert by[9001] == by[9002] == by[9003] < 0.5 and by[None] > 0.7
    kept = toxicity.score_documents(df, lab, out="toxic")
    assert kept.columns == [*df.columns, "toxic"] and kept.where("features = 'f' and score = 0.5").count() == len(out)
    # labels of held-out rows are never learned from: turning them round changes nothing
    turned = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y, 1) for i, y in labels]
                                   + [(None, 1, 0), (3, None, 0), (4, 1, 0)], lab.schema)
    again = {x["doc_id"]: x["score"] for x in toxicity.toxicity_scores(df, turned).collect()}
    assert again == by
    assert toxicity.toxicity_scores(df.where("false"), lab).count() == 0
    none = toxicity.toxicity_scores(df, lab.where("false")).collect()
    assert len(none) == len(out) and {x["score"] for x in none} == {0.0}


def test_features_see_through_obfuscation():
    lex = toxicity.Lexicon({"cretin": 5.0, "blub*": 3.0})
    assert toxicity.text_features("blubber blub", lex)[4] == 3.0 and toxicity.text_features("blub", lex)[4] == 0.0
    f = lambda t: dict(zip(toxicity.FEATURES, toxicity.text_features(t, lex)))
    assert f("such a CRETIN, you")["hits"] > 0 and f("such a cretin, you")["near_you"] == 1
    for t in ("a cr3tin here", "a c.r.e.t.i.n here", "a creeetin here", "c r e t i n there"):
        assert f(t)["hidden_density"] > 0, t
    assert f("a certain thing")["hidden_density"] == 0 and f(None) == f("") == dict.fromkeys(toxicity.FEATURES, 0.0)
