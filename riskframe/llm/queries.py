"""The corpus operators as queries over the given tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import decontaminate, embedding_dedup, hard_negatives, importance, line_dedup, packing, secrets, sharding, simhash, suffix_dedup, token_index, toxicity, warc
from riskframe.llm.common import scratch_path
from riskframe.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_best_fit_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 8 shards of nearly equal bytes, equal texts together."""
    out = sharding.shard_documents(read_table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def _tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


@_query
def op6_minimum_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of 1024."""
    out = packing.pack_documents(read_table(spark, sf_dir, "documents"), _tokenizer_file(), 1024, 0, keep_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@_query
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, linked at three differing bits or fewer."""
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"), shingle=3, radius=3)


@_query
def op10_sharded_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records, then read back from the archive."""
    folder = scratch_path(spark, "warc")
    warc.write_warc(read_table(spark, sf_dir, "pages"), folder)
    return warc.read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op10_sharded_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM q"""


@_query
def op7_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, each a path with one version, by a ledger that starts empty."""
    docs = read_table(spark, sf_dir, "documents")
    found = secrets.scan_versions(docs, scratch_path(spark, "ledger"), path_col="doc_id", content_col="text")
    count = lambda kind: F.size(F.filter("found", lambda x: x["rule"] == kind)).cast("long")
    listed = F.concat_ws(",", F.transform("found", lambda x: F.concat_ws(":", x["rule"], x["start"], x["end"])))
    return found.select(F.col("path").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


@_query
def op3_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-word windows of the benchmark in all documents."""
    out = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


ORACLE["op3_winnowing_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
b1 AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
b2 AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b1),
item AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM b2),
size AS (SELECT DISTINCT n FROM item),
d1 AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, size WHERE len(w) >= n),
seen AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM d1),
hit AS (SELECT doc_id, i, n, item_id FROM seen JOIN item USING (n, win)),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit),
cover AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN ids USING (doc_id)"""


@_query
def op2_line_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the later occurrences of three-line windows."""
    out = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "line_dedup.n_lines", "line_dedup.n_removed")


ORACLE["op2_line_window_dedup"] = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l WHERE len(ls) >= 3),
w AS (SELECT doc_id, i, array_to_string(list_slice(ls, i, i + 2), chr(10)) AS win FROM p
      WHERE trim(array_to_string(list_slice(ls, i, i + 2), ''), ' ') <> ''),
o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM w),
gone AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM o WHERE nth > 1),
g AS (SELECT doc_id, list(i) AS at, count(*) AS n FROM gone GROUP BY doc_id)
SELECT l.doc_id,
       CASE WHEN g.n IS NULL THEN text
            ELSE array_to_string([ls[k] FOR k IN range(1, len(ls) + 1) IF NOT list_contains(g.at, k)], chr(10)) END AS text,
       coalesce(len(ls), 0) AS n_lines, coalesce(g.n, 0) AS n_removed
FROM l LEFT JOIN g USING (doc_id)"""


@_query
def op4_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels that aren't held out."""
    return toxicity.toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@_query
def op8_pivot_permutation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of equal labels linked at a cosine of 0.93 or more."""
    return embedding_dedup.embedding_components(read_table(spark, sf_dir, "embeddings"), least=0.93)


@_query
def op9_columnwise_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without strings of 200 bytes that also start elsewhere."""
    out = suffix_dedup.dedup_substrings(read_table(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op11_gnat_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, against all vectors."""
    vectors = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLE["op11_gnat_hard_negatives"] = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS z
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.z, b.z)::BIGINT AS score
      FROM r a, r b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""


@_query
def op12_head_tail_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the benchmark's words."""
    out = importance.importance_sample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


# The CRC-32 of each distinct word is worked out from its bytes; the table of 256 remainders from the polynomial.
ORACLE["op12_head_tail_importance"] = r"""
WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
                 lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS rem),
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
dw AS MATERIALIZED (SELECT doc_id, unnest(w) AS word FROM d),
bw AS MATERIALIZED (SELECT unnest(w) AS word FROM b),
v AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
hexed AS (SELECT word, hex(encode(word)) AS x FROM v),
bytes AS (SELECT word, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS bs FROM hexed),
crc AS MATERIALIZED (SELECT word, xor(list_reduce(list_concat([4294967295], bs), lambda c, y: xor(c >> 8, rem[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket
        FROM bytes, tab),
sums AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS s_all, (SELECT count(*) FROM bw)::DOUBLE AS t_all),
sc AS (SELECT bucket, count(*) AS s FROM dw JOIN crc USING (word) GROUP BY 1),
tc AS (SELECT bucket, count(*) AS t FROM bw JOIN crc USING (word) GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000) / ((s::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS g
         FROM sc LEFT JOIN tc USING (bucket), sums),
per AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS total FROM dw JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY 1),
w AS (SELECT doc_id, len(w) AS n_features, coalesce((total - (((total % n) + n) % n)) // n, 0)::BIGINT AS weight,
             ('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT AS h
      FROM d LEFT JOIN per USING (doc_id)),
sco AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM sco WHERE n_features >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score,
       CASE WHEN k <= 10 * (SELECT count(*) FROM r) // 100 THEN k END AS rank
FROM sco LEFT JOIN r USING (doc_id)"""


@_query
def op13_minimal_hash_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids written as binary shards, then read back by key."""
    folder = token_index.write_archive(read_table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"), _tokenizer_file(), end_id=2)
    keys = spark.read.parquet(folder + "/docs").select("id", "nth")
    out = token_index.read_documents(spark, folder, keys)
    return out.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
