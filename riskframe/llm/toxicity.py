"""Toxicity scores: gradient-boosted trees over dense text features, with isotonic calibration.

Features of a whole text are densities of a lexicon, second-person words near its hits,
capitals, punctuation, and obfuscation (lexicon words that show only after leet
letters, inner symbols, repeats or spacing are undone). The lexicon itself is learned:
words, and beginnings of longer words, that stand almost only in texts labelled toxic, near
copies counted once. Lexicon, trees and calibration are
fitted on at most ``FIT_ROWS`` labelled rows, those with the smallest hashes of their
ids; every text is scored.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import materialize

#: Documented bound of the sample that is fitted; words in the lexicon at most.
FIT_ROWS, LEXICON_WORDS = 20_000, 300
#: Least number of toxic texts that hold an entry of the lexicon, least share of toxic ones among the texts
#: that hold it, least log-likelihood ratio; lengths of the beginnings.
LEAST_TEXTS, LEAST_PRECISION, LEAST_EVIDENCE, STEMS = 3, 0.85, 12.0, (4, 5, 6)
TREES, DEPTH, STEP = 30, 3, 0.2

#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen ihr euch euer "
    "tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros".split())
#: Letters written as digits or symbols.
LEET = str.maketrans("0134578@$!|+", "oieastbasiit")
NEAR = 5

_PUNCT = string.punctuation + "…“”„‘’«»¡¿–—"
_REPEAT = re.compile(r"(.)\1+")
_LONG_RUN = re.compile(r"([^\W\d_])\1{2,}")
_UPPER, _DIGIT, _MARKS = (x.encode() for x in (string.ascii_uppercase, string.digits, string.punctuation))

FEATURES = ("log_words", "hits", "hit_density", "weight_density", "top_weight", "hidden_density", "near_you",
            "you_density", "capitals", "shouted", "exclaimed", "marks", "digits_inside", "symbols_inside", "long_runs")


def tokens(text: str) -> list[str]:
    """Lower-case words without the marks around them."""
    return [w.strip(_PUNCT) for w in text.lower().split()]


def _plain(word: str) -> str:
    """A word with leet letters read, symbols dropped and repeats collapsed."""
    return _REPEAT.sub(r"\1", "".join(c for c in word.translate(LEET) if c.isalpha()))


@dataclass(frozen=True)
class Lexicon:
    """Weights of words, and of beginnings of longer words (``abcd*``)."""

    weights: dict[str, float]

    def __post_init__(self) -> None:
        stems = {w[:-1]: x for w, x in self.weights.items() if w.endswith("*")}
        words = {w: x for w, x in self.weights.items() if not w.endswith("*")}
        hidden = {_plain(w): x for w, x in words.items() if len(_plain(w)) >= 4}
        for name, value in (("words", words), ("stems", stems), ("heads", {w[:STEMS[0]] for w in stems}), ("hidden", hidden)):
            object.__setattr__(self, name, value)

    def stem_weight(self, word: str) -> float:
        return max((self.stems.get(word[:k], 0.0) for k in STEMS if len(word) > k), default=0.0)


def text_features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The values of ``FEATURES`` for a text; a null or blank text gives zeros."""
    text = text or ""
    raw = text.split()
    if not raw:
        return [0.0] * len(FEATURES)
    words, n = tokens(text), len(raw)
    known, heads, hidden, head = lexicon.words, lexicon.heads, lexicon.hidden, STEMS[0]
    weight = {i: x for i, w in enumerate(words)
              if (x := known.get(w, 0.0) or (w[:head] in heads and lexicon.stem_weight(w)))}
    masked, digits, symbols, single = [], 0, 0, []
    for i, w in enumerate(words):
        if len(w) < 2:
            if w:
                single.append(i)
        elif not w.isalpha():
            inner = any(c.isdigit() for c in w) and any(c.isalpha() for c in w)
            digits += inner
            symbols += not w.isalnum()
            if i not in weight and _plain(w) in hidden:
                masked.append(i)
        elif i not in weight and _LONG_RUN.search(w) and _plain(w) in hidden:
            masked.append(i)
    run: list[int] = []
    for i in [*single, -9]:  # letters written apart
        if run and i != run[-1] + 1:
            spelled = _plain("".join(words[j] for j in run))
            if len(run) >= 4 and any(h in spelled for h in hidden):
                masked.append(run[0])
            run = []
        run.append(i)
    you = {i for i, w in enumerate(words) if w in SECOND_PERSON}
    found = [*weight, *masked]
    near = sum(1 for i in found if not you.isdisjoint(range(i - NEAR, i + NEAR + 1)))
    data = text.encode(errors="replace")
    rate = lambda some: (len(data) - len(data.translate(None, some))) / len(data)
    return [math.log1p(n), math.log1p(len(weight)), 100 * len(weight) / n, 100 * sum(weight.values()) / n,
            max(weight.values(), default=0.0), 100 * len(masked) / n,
            near / len(found) if found else 0.0, 100 * len(you) / n, rate(_UPPER),
            sum(1 for w in raw if len(w) > 1 and w.isupper()) / n, rate(b"!"), rate(_MARKS), digits / n, symbols / n,
            len(_LONG_RUN.findall(text)) / n]


def features(lexicon: Lexicon):
    """A column function: the array of ``FEATURES`` of a text column."""
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([text_features(t, lexicon) for t in texts])
    return run


def copy_mark(text: str | None) -> int:
    """The smallest hash of a text's three-word shingles: near copies mostly share it."""
    from xxhash import xxh64_intdigest
    words = tokens(text or "")
    return min(xxh64_intdigest(" ".join(words[i:i + 3])) for i in range(max(1, len(words) - 2))) >> 1


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words, and beginnings of longer words, of (text, label) rows that mark label 1, weighted by
    log odds; at most ``LEXICON_WORDS``. Texts with one ``copy_mark`` and label count once."""

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                rows = []
                for t, y in zip(b["text"].iloc[at:at + 500], b["label"].iloc[at:at + 500]):
                    said = {w for w in tokens(t or "") if len(w) > 2 and not w.endswith("*")}
                    said |= {w[:k] + "*" for w in said for k in STEMS if len(w) > k}
                    rows += [(w, y) for w in said]
                yield pd.DataFrame(rows, columns=["word", "label"])

    @F.pandas_udf("long")
    def mark(texts: pd.Series) -> pd.Series:
        return pd.Series([copy_mark(t) for t in texts])

    once = materialize(sample.select("text", F.col("label").cast("int").alias("label")).withColumn("_mark", mark("text"))
                       .dropDuplicates(["_mark", "label"]), "toxic-once")
    ones, total = once.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    zeros = total - ones
    if not ones or not zeros:
        return Lexicon({})
    counts = (once.select("text", "label").mapInPandas(distinct, "word string, label int")
              .groupBy("word").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")))
    a, b = F.col("a"), F.col("b")
    odds = F.log((a + 0.5) / (ones - a + 0.5)) - F.log((b + 0.5) / (zeros - b + 0.5))
    expected = (a + b) * (ones / total)
    evidence = 2 * (a * F.log(a / expected) + F.when(b > 0, b * F.log(b / (a + b - expected))).otherwise(0.0))
    top = (counts.where((a >= LEAST_TEXTS) & (a / (a + b) >= LEAST_PRECISION)).select("word", odds.alias("odds"), evidence.alias("g"))
           .where(F.col("g") >= LEAST_EVIDENCE).orderBy(F.desc("g"), "word").limit(LEXICON_WORDS).collect())
    return Lexicon({r["word"]: float(r["odds"]) for r in top})


@dataclass
class ToxicityModel:
    """A fitted scorer; without both labels in the sample, the share of label 1 is every score."""

    lexicon: Lexicon
    trees: object | None
    calibration: object | None
    prior: float

    def score(self, docs: DataFrame, text_col: str = "text", out: str = "score") -> DataFrame:
        """``docs`` with the column ``out`` (0 to 1) for every row, from ``text_col`` alone; a column of that
        name is replaced, all others stay as they are."""
        from pyspark.ml.functions import array_to_vector, vector_to_array
        names = docs.columns
        x = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no clash with the columns that the models add
        text = F.col(f"c{names.index(text_col)}")
        if self.trees is None:
            x = x.withColumn("_score", F.lit(self.prior))
        else:
            x = self.trees.transform(x.withColumn("features", array_to_vector(features(self.lexicon)(text))))
            x = x.withColumn("_score", vector_to_array("probability")[1])
            if self.calibration is not None:
                x = self.calibration.transform(x).withColumn("_score", F.col("_calibrated"))
        return x.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n != out],
                        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_score"))).alias(out))


def held_out(id_col):
    """True for rows that must not be learned from: crc32 of the id's text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Fit on the labelled rows of ``docs`` (doc_id, text) that aren't held out.

    ``labels`` has (doc_id, toxic); null labels and ids are left out, a doc_id labelled twice counts
    with its larger label. Three quarters of the sample grow the trees, one quarter calibrates.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    mark = F.xxhash64("doc_id", F.lit("fit"))
    chosen = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label")).orderBy(mark, "doc_id").limit(fit_rows))
    chosen = materialize(chosen, "toxic-labels")
    # at most fit_rows rows of 16 bytes; texts of repeated rows count once
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"])
    sample = materialize(sample.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4))), "toxic-sample")
    lexicon = learn_lexicon(sample.where("part != 0"))  # the quarter that calibrates has to be new to all that is fitted
    ones, total = sample.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count(F.lit(1))).first()
    prior = float(ones / total) if total else 0.0
    x = sample.select("label", "part", features(lexicon)("text").alias("features"))
    x = materialize(x.orderBy("part", "features", "label"), "toxic-features")
    x = x.withColumn("features", array_to_vector("features"))
    grow = x.where("part != 0").coalesce(2)
    if grow.select("label").distinct().count() < 2:
        return ToxicityModel(lexicon, None, None, prior)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7, minInstancesPerNode=5).fit(grow)
    rest = trees.transform(x.where("part = 0")).select("label", vector_to_array("probability")[1].alias("_score"))
    rest = materialize(rest, "toxic-calibration")
    if rest.select("label").distinct().count() < 2:
        return ToxicityModel(lexicon, trees, None, prior)
    iso = IsotonicRegression(featuresCol="_score", labelCol="label", predictionCol="_calibrated").fit(rest)
    return ToxicityModel(lexicon, trees, iso, prior)


def score_documents(docs: DataFrame, labels: DataFrame, out: str = "score", id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``docs`` with a toxicity score in ``out``, by a model fitted on its labelled rows that aren't held out.

    Null and empty texts are scored as texts without words; repeated rows each get the same
    score; a row with a null id is scored, never learned from and not held out. Only the text enters a
    score. Without labels of both kinds every score is the share of label 1 (0 without labels). An empty
    table gives an empty result; all columns stay, one called ``out`` is replaced.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return fit_toxicity(plain, labels.select("doc_id", "toxic")).score(docs, text_col, out)


def toxicity_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.7, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; see ``score_documents``."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return score_documents(plain, labels).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
