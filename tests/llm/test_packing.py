import itertools
import zlib

import numpy as np
import pytest
from riskframe.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def test_subset_sums_equal_brute_force():
    r = np.random.default_rng(4)
    for _ in range(150):
        counts = {int(n): int(r.integers(1, 4)) for n in r.integers(1, 25, 5)}
        target = int(r.integers(0, 60))
        got = packing.fill_window(counts, target)
        best = max(s for k in itertools.product(*[range(c + 1) for c in counts.values()])
                   if (s := sum(a * n for a, n in zip(k, counts))) <= target)
        assert sum(n * k for n, k in got.items()) == best and all(k <= counts[n] for n, k in got.items())


def test_patterns_use_every_length_once():
    r = np.random.default_rng(5)
    counts = {n: int(r.integers(0, 50)) for n in range(1, 1024)}
    patterns = packing.minimum_slack(dict(counts), 1024)
    used = {}
    for times, chosen in patterns:
        assert sum(n * k for n, k in chosen.items()) <= 1024
        for n, k in chosen.items():
            used[n] = used.get(n, 0) + times * k
    assert used == {n: c for n, c in counts.items() if c}
    assert sum(t for t, _ in patterns) * 1024 <= 1.02 * sum(n * c for n, c in counts.items())


def test_the_encoding_equals_the_tokenizer():
    from tokenizers import Tokenizer
    t, bpe, r = Tokenizer.from_file(PATH), packing.byte_bpe(PATH), np.random.default_rng(6)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "1", "é", "!", " ?", "<|endoftext|>", " ", "\r\n", "'", "ll", "٣", "²",
             "\x1c", "\x85", "😀", "Don't", "\x00"]
    for _ in range(2000):
        x = "".join(parts[i] for i in r.integers(0, len(parts), r.integers(0, 14)))
        assert t.encode(x, add_special_tokens=False).ids == bpe.encode_to_numpy(x, allowed_special="all").tolist(), repr(x)


def test_round_trip_through_sequences(spark):
    from tokenizers import Tokenizer
    t, r = Tokenizer.from_file(PATH), np.random.default_rng(7)
    texts = [" ".join(f"word{i}" for i in r.integers(0, 99, int(n))) for n in r.integers(0, 700, 40)] + [None, "", "zq " * 9000]
    rows = [(i if i != 5 else None, x, "s", 1) for i, x in enumerate(texts)] + [(0, texts[0], "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, length int")
    out = packing.pack_documents(df, PATH, 256, 0).collect()
    by_doc, by_seq = {}, {}
    for x in out:
        assert x["length"] * 4 == len(x["ids"]) and zlib.crc32(bytes(x["ids"])) == x["ids_crc32"]
        by_doc.setdefault(x["doc_id"], []).append(x)
        by_seq.setdefault(x["sequence_id"], []).append(x)
    for i, x, *_ in rows[1:-1]:
        got = sorted(by_doc[i], key=lambda p: p["start"])
        ids = np.frombuffer(b"".join(bytes(p["ids"]) for p in got), "<u4").tolist()
        assert ids == t.encode(x or "", add_special_tokens=False).ids + [0]
        assert [p["start"] for p in got] == list(range(0, len(ids), 256)) and {p["doc_tokens"] for p in got} == {len(ids)}
    assert len(by_doc[0]) == 2 * len({p["start"] for p in by_doc[0]})  # the repeated row
    assert sorted(by_seq) == list(range(len(by_seq)))
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 256
    assert len(by_seq) * 256 <= 1.05 * sum(x["length"] for x in out) + 256
    assert packing.pack_documents(df.where("false"), PATH).count() == 0
