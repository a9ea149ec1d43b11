"""Corpus preparation as a chain of stages over ``documents``.

Each stage calls one operator of ``riskframe.llm`` with production parameters, works on
all rows that its predecessor kept, and returns the columns of ``documents`` (``n_chars``
follows the text), but for the last, which returns packed token pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import decontaminate, line_dedup, packing, simhash, toxicity
from riskframe.llm.common import materialize, row_identity
from riskframe.sources.tables import read_table


class _Plain:
    """``docs`` under positional names, so that no column of theirs meets a name that an operator uses."""

    def __init__(self, docs: DataFrame) -> None:
        self.names = docs.columns
        self.docs = docs.toDF(*[f"c{i}" for i in range(len(self.names))])
        self.id, self.text = self.of("doc_id"), self.of("text")

    def of(self, name: str) -> str:
        return f"c{self.names.index(name)}"

    def back(self, docs: DataFrame) -> DataFrame:
        """The columns of ``docs`` under their own names, in their order."""
        return docs.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(self.names)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator scores at 0.7 or more go.

    Null and empty texts are scored as texts without words, repeated rows alike; a row with a null id is
    judged by its text. An empty table stays empty; other columns stay as they are, whatever their names."""
    own = _Plain(docs)
    scored = toxicity.score_documents(own.docs, read_table(spark, sf_dir, "labels"), out="score", id_col=own.id, text_col=own.text)
    return own.back(scored.where(F.col("score") < 0.7))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the later occurrences of three-line windows; ``n_chars`` follows the text.

    Every row stays: a null text stays null, an empty one empty, and a text all of whose lines repeat earlier ones
    becomes empty. Rows that agree in id and text are one document; ties go by id (nulls last), then a hash of
    the text. An empty table stays empty; other columns stay as they are, whatever their names."""
    own = _Plain(docs)
    out = line_dedup.dedup_lines(own.docs, window=3, id_col=own.id, text_col=own.text)
    if "n_chars" in own.names:
        out = out.withColumn(own.of("n_chars"), F.length(own.text).cast("long"))
    return own.back(out)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by SimHash (three words, three bits) the row with the smallest
    doc_id stays (nulls last; of repeated rows any one).

    Null and empty texts have the fingerprint zero and are linked like any other. An empty table stays
    empty; other columns stay as they are, whatever their names."""
    own = _Plain(docs)
    numbered = materialize(own.docs.withColumn("row", F.monotonically_increasing_id()), "numbered")  # numbers as written
    linked = simhash.simhash_components(numbered, shingle=3, radius=3, id_col="row", text_col=own.text)
    order = F.struct(F.col(f"own.{own.id}").isNull(), F.col(f"own.{own.id}"), F.col("own.row"))
    stay = (linked.alias("l").join(numbered.select(own.id, "row").alias("own"), F.col("l.doc_id") == F.col("own.row"))
            .groupBy("component_id").agg(F.min_by("own.row", order).alias("row")))
    return own.back(numbered.join(stay.select("row"), "row", "left_semi"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of the benchmark go.

    Null and empty texts hold none and stay; repeated rows go or stay together, a row with a null id by its
    text. An empty table stays empty; other columns stay as they are, whatever their names."""
    own = _Plain(docs)
    found = decontaminate.contamination(own.docs, read_table(spark, sf_dir, "benchmark"), span=10, id_col=own.id, text_col=own.text)
    rejected = found.where("n_hit > 0").select("row_key").distinct()
    keyed = own.docs.withColumn("row_key", row_identity(own.id, own.text))
    return own.back(keyed.join(rejected, "row_key", "left_anti"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of 1024.

    A null text counts as empty and gives the one piece of its end id; repeated rows give repeated pieces, a null
    id stays null. An empty table gives no pieces; other columns are not read."""
    import public_tokenizers
    return packing.pack_documents(docs, str(public_tokenizers.path("byte_bpe_50k.json")), 1024, 0, keep_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: Scores, fingerprints and packing have no SQL form; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each on what the one before it wrote."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
