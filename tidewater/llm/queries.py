"""The queries over whole tables, one for each operator, and the SQL that judges them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.cover_tree import near_duplicate_vectors
from tidewater.llm.gumbel_pieces import sample_segmentations
from tidewater.llm.labelled import fold
from tidewater.llm.packing import pack_documents
from tidewater.llm.pii import replace_personal_data
from tidewater.llm.quality_classifier import classify_quality
from tidewater.llm.quality_rules import quality_rules
from tidewater.llm.shared import table
from tidewater.llm.simhash import simhash_groups
from tidewater.llm.token_orc import token_digest
from tidewater.llm.toxicity import classify_toxicity
from tidewater.llm.unigram import token_counts


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op8_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the text with surrogates, for every row of documents."""
    return replace_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 5) == 0)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 3) == 1)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_simhash, op3_pii, op4_token_orc, op5_cover_tree, op6_toxicity, op7_packing, op8_gumbel_pieces, op9_quality_rules, op10_quality_classifier)}
#: The other operators hash with XXH64, tokenize or learn, which DuckDB can't; the tests hold them against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op5_cover_tree": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v AS x JOIN v AS y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a),
        least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM v JOIN least ON least.a = vec_id LEFT JOIN counts ON counts.a = vec_id
    """,
}
