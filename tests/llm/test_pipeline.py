import corpus_pipeline
import numpy as np
import plain
from conftest import SF01
from riskframe.llm import toxicity
from riskframe.sources.tables import read_table


def test_each_stage_equals_a_plain_version(spark):
    docs = read_table(spark, SF01, "documents")
    bench = [(x["item_id"], x["text"]) for x in read_table(spark, SF01, "benchmark").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup",
                                                      "benchmark decontamination", "packing"]
    rows = docs.collect()
    extra = [(None, None, None, None, None), (90_001, "", "en", None, 0), (90_002, None, "en", "s", None), tuple(rows[7]),
             (90_003, " ".join(plain.words(bench[0][1])), "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    held = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(x["doc_id"], x["text"]) for x in held.collect()]
        held = corpus_pipeline.materialize(stage(spark, held, SF01), "t")
        after = held.collect()
        if k < 4:
            assert held.columns == docs.columns and {type(f.dataType) for f in held.schema} == {type(f.dataType) for f in docs.schema}
            pairs = sorted(((x["doc_id"], x["text"]) for x in after), key=str)
        if name == "toxicity":
            scores = toxicity.toxicity_scores(docs, read_table(spark, SF01, "labels")).where("predicted = 1").collect()
            bad = {x["doc_id"] for x in scores}
            assert bad and pairs == sorted((d for d in before if d[0] not in bad), key=str)
        elif name == "line dedup":
            want = plain.dedup_lines(list(dict.fromkeys(before)))
            assert pairs == sorted(((i, want[i, t][0]) for i, t in before), key=str)
            assert all(x["n_chars"] == (None if x["text"] is None else len(x["text"])) for x in after)
        elif name == "simhash near-dedup":
            root = plain.components([plain.simhash(t) for _, t in before], lambda a, b: (a ^ b).bit_count() <= 3)
            stay = {}
            for d, g in zip(before, root):
                stay[g] = min(stay.get(g, d), d, key=lambda x: (x[0] is None, x[0]))
            assert pairs == sorted(stay.values(), key=str)
        elif name == "benchmark decontamination":
            hit = [n for _, _, n, _ in plain.contamination(before, bench)]
            assert any(hit) and pairs == sorted((d for d, n in zip(before, hit) if not n), key=str)
        else:
            assert sum(x["length"] for x in after) == sum({x["doc_id"]: x["doc_tokens"] for x in after}.values())
            assert {x["doc_id"] for x in after} == {i for i, _ in before}
            used = np.bincount([x["sequence_id"] for x in after], [x["length"] for x in after])
            assert used.max() <= 1024 and len(used) == len({x["sequence_id"] for x in after})


def test_stages_keep_columns_whatever_their_names(spark):
    from pyspark.sql import functions as F
    names = ["_toxicity", "score", "line_dedup", "_row", "row", "row_key", "w", "component_id", "c0"]
    docs = read_table(spark, SF01, "documents").limit(60)
    docs = corpus_pipeline.materialize(docs.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names]), "extra")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF01)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(x[n] == f"{n}{x['doc_id']}" for x in rows for n in names)
        assert stage(spark, docs.where("false"), SF01).count() == 0
