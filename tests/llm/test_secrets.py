import dataclasses
import os
import tempfile

import plain
from riskframe.llm import secrets

KEY = "AKIA" + "Q7" * 8
TEXTS = ["nothing here", "", None, f"password = 'abcdef123456' and {KEY} é😀 token: x", "deadbeef" * 4 + " cafe " + "0123456789abcdef",
         "token=token: abcdefghijklmnop", "API_KEY\"=\"Zz0+/_.=-123456\" apikey:short ſecret=abcdefghijklmnop toKen = abcdefghijklm",
         "AKIA" + "AKIA" * 4 + " AKIAshort", "😀" * 50 + "secret:" + "x" * 30, f"{KEY}\n" * 300 + "f" * 5000, "token=abc secret=secret=abcdefghijklmn"]


def _rows(out):
    return sorted(((x["path"], [tuple(s) for s in x["found"]]) for x in out.collect()), key=str)


def test_findings_and_ledger(spark):
    rows = [(i, t, "v") for i, t in enumerate(TEXTS)] + [(99, TEXTS[3], "v"), (3, TEXTS[3], "v"), (None, TEXTS[4], "v")]
    df = spark.createDataFrame(rows, "path long, content string, blob string")
    ledger = os.path.join(tempfile.mkdtemp(prefix="ledger-"), "l")
    want = sorted(((i, plain.secrets(t)) for i, t, _ in rows), key=str)
    assert _rows(secrets.scan_versions(df, ledger)) == want
    blobs = len({t or "" for t in TEXTS})
    assert secrets.read_ledger(spark, ledger).count() == 3 * blobs
    # the same again scans nothing; one new text is one blob
    assert _rows(secrets.scan_versions(df, ledger)) == want and secrets.read_ledger(spark, ledger).count() == 3 * blobs
    more = spark.createDataFrame([(500, "secret: abcdefabcdefabcdef", "v"), (501, TEXTS[3], "v")], df.schema)
    assert _rows(secrets.scan_versions(more, ledger)) == sorted(
        [(500, plain.secrets("secret: abcdefabcdefabcdef")), (501, plain.secrets(TEXTS[3]))], key=str)
    assert secrets.read_ledger(spark, ledger).count() == 3 * (blobs + 1)
    # a new version of one rule is scanned for that rule alone
    newer = (secrets.RULES[0], dataclasses.replace(secrets.RULES[1], version=2, least=40), secrets.RULES[2])
    got = _rows(secrets.scan_versions(df, ledger, newer))
    assert got == sorted(((i, [s for s in f if s[2] != "access"]) for i, f in want), key=str)
    assert secrets.read_ledger(spark, ledger).count() == 3 * (blobs + 1) + blobs
    assert secrets.scan_versions(df.where("false"), ledger + "-none").count() == 0


def test_two_writers_at_once_count_once(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "path long, content string")
    ledger = os.path.join(tempfile.mkdtemp(prefix="ledger-"), "l")
    first = _rows(secrets.scan_versions(df, ledger))
    secrets.read_ledger(spark, ledger).write.mode("append").parquet(ledger + "-other")
    spark.read.parquet(ledger + "-other").write.mode("append").parquet(ledger)  # what a scan at the same time would add
    assert _rows(secrets.scan_versions(df, ledger)) == first
