import plain
from riskframe.llm import line_dedup


def test_against_a_plain_version_with_odd_rows(spark):
    block = "alpha\nbeta\ngamma\ndelta"
    rows = [(5, block), (2, "head\n" + block + "\ntail"), (None, block), (7, "a\na\na\na\na"), (8, ""), (9, None),
            (10, "one\ntwo"), (11, "\n\n \n\n"), (12, "x\n\n \n\n" + block), (13, "\n".join(f"l{i % 40}" for i in range(3000))),
            (14, "beta\ngamma\ndelta\nnew\nlines\nhere"), (15, "new\nlines\nhere")]
    df = spark.createDataFrame([(i, t, t, 1, "z") for i, t in rows + [rows[0]]],
                               "doc_id long, text string, row_key string, pos int, line_dedup string")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "row_key", "pos", "line_dedup"]
    want = plain.dedup_lines(rows)
    got = out.collect()
    assert len(got) == len(rows) + 1
    for x in got:  # the untouched extra column holds the text as it was
        assert (x["text"], x["line_dedup"]["n_lines"], x["line_dedup"]["n_removed"]) == want[x["doc_id"], x["row_key"]], x
    assert line_dedup.dedup_lines(df.where("false")).count() == 0
