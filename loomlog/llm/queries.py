"""The registered queries of the operators: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import html_extract, media, mixing, packing, passages, quality, simhash, token_count, token_store, vector_search
from loomlog.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in as few sequences as the configuration program finds."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), separator=0, capacity=2048)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles and the components of links at two bits or fewer."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junk and toxicity scores of every document, and whether it is kept."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), sample_rows=12_000)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids to segments and reads them back."""
    return token_store.read(token_store.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page by its host's wrapper."""
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text by the compiled transducer."""
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a grey image in archives, read back and described."""
    return media.round_trip(table(spark, sf_dir, "documents"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of fifty words and more that a document shares with an earlier one."""
    return passages.passages(table(spark, sf_dir, "documents"), min_words=50, min_identity=0.8)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents, sorted by training position."""
    return mixing.digest(table(spark, sf_dir, "documents"))


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every 50th vector with all others."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    return vector_search.top_k(vectors, vectors.where(F.col("id") % 50 == 0), k=5, scale=256.0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    found = [
        op1_best_fit_packing, op2_simhash, op3_quality, op4_token_store, op5_html_extraction, op6_token_count, op7_media, op8_passages, op9_mixing, op10_vector_search, pipeline,
    ]
    return {f.__name__: f for f in found}


#: The same results in DuckDB's SQL.
OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h, md5(coalesce(text, '')) AS h2
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv,
             row_number() OVER (ORDER BY cap / weight, source IS NULL, source) AS rn FROM w),
lvl AS (SELECT arg_min(lv, rn) AS v FROM l WHERE cap / weight >= lv),
t AS (SELECT source, source_size, coalesce(least(cap, v * weight), cap) AS target FROM l LEFT JOIN lvl ON true),
p AS (SELECT d.*, t.source_size, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, h2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2.0 AS middle
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CASE WHEN source_size = 0 OR target - middle <= 0 THEN 0 ELSE least(ceil((target - middle) / source_size), 3) END AS whole FROM p),
g AS (SELECT *, first_value(target) OVER (PARTITION BY source) - sum(size * whole) OVER (PARTITION BY source) AS gap FROM c),
f AS (SELECT *, (size * 4 <= abs(gap) AND CASE WHEN gap > 0 THEN whole < 3 ELSE whole > 0 END) AS small FROM g),
x AS (SELECT *, coalesce(sum(CASE WHEN small THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h, doc_id, h2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled FROM f)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN small AND filled + size / 2.0 <= abs(gap) THEN sign(gap) ELSE 0 END) AS BIGINT) AS taken
FROM x
"""

OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_mixing": OP9_SQL, "op10_vector_search": OP10_SQL}
