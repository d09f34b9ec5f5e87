"""Query plans of the training-data operators (pN_ = problem N) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesieve.llm import cutoff, history, lookalike, neardup, packing, personal, tokens
from lakesieve.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of requests whose normalized results are at least 0.85 similar."""
    pairs = neardup.similar_pairs(table(spark, d, "score_results"), "request_id", "normalized", 0.85, 8)
    return pairs.select(F.col("id_a").alias("request_a"), F.col("id_b").alias("request_b"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per result: its class of equal word sets and its number of near-duplicates."""
    return neardup.link_counts(table(spark, d, "score_results"), "request_id", "normalized", 0.85, 8).withColumnRenamed("id", "request_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Results that repeat something their tenant had accepted before."""
    return history.replay(table(spark, d, "score_results"), table(spark, d, "spam_opts"), 0.85, 0.5, 8)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of requests that look the same and are stored differently."""
    return lookalike.same_look_pairs(table(spark, d, "score_requests"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per request: its class of equal looks and how many of them are stored differently."""
    return lookalike.look_classes(table(spark, d, "score_requests"))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """The one form, case folded, of every text and field value: (request_id, place, form)."""
    requests = table(spark, d, "score_requests")
    texts = requests.where("text is not null").select("request_id", F.lit("text").alias("place"), F.col("text").alias("value"))
    fields = requests.where("fields is not null").select("request_id", F.explode("fields").alias("place", "value"))
    return texts.unionByName(fields).select("request_id", "place", lookalike.plain(F.col("value"), more=lookalike.confusables(spark)).alias("form"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Places with personal information, by kind."""
    return personal.found_places(table(spark, d, "score_requests"), table(spark, d, "score_results"), table(spark, d, "person_names"))


def p5_masked(spark: SparkSession, d: str) -> DataFrame:
    """Field values and normalized texts with placeholders for personal information."""
    return personal.masked(table(spark, d, "score_requests"), table(spark, d, "score_results"), table(spark, d, "person_names"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document's text by byte_bpe_50k."""
    return tokens.encoded(table(spark, d, "documents"))


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Whether decoding a document's ids gives its text back, byte for byte: (doc_id, same)."""
    docs = table(spark, d, "documents")
    back = tokens.decoded(tokens.encoded(docs)).withColumnRenamed("text", "back")
    return docs.join(back, "doc_id").select("doc_id", (F.col("back") == F.coalesce("text", F.lit(""))).alias("same"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Containers of every capacity of pack_specs, filled with all documents."""
    sizes = tokens.token_counts(table(spark, d, "documents")).withColumnRenamed("doc_id", "item_id")
    return packing.containers(sizes, table(spark, d, "pack_specs")).withColumnRenamed("item_id", "doc_id")


def p7_usage(spark: SparkSession, d: str) -> DataFrame:
    """How much of the containers is used, by capacity."""
    return packing.usage(p7_containers(spark, d), table(spark, d, "pack_specs"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text was cut."""
    return cutoff.cut_documents(table(spark, d, "documents"))


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts its texts."""
    return cutoff.cut_shares(table(spark, d, "documents"))


def p8_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How many cut documents each kind of evidence decided."""
    return cutoff.cut_evidence(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_classes": p1_classes, "p2_found": p2_found, "p4_found": p4_found, "p4_classes": p4_classes, "p4_forms": p4_forms, "p5_found": p5_found, "p5_masked": p5_masked, "p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip, "p7_containers": p7_containers, "p7_usage": p7_usage, "p8_found": p8_found, "p8_sources": p8_sources, "p8_evidence": p8_evidence}


def oracle_sql() -> dict[str, str]:
    pairs = """WITH w AS (SELECT request_id, list_distinct(regexp_extract_all(lower(any_value(normalized)), '[a-z0-9_]+')) AS ws FROM score_results WHERE normalized IS NOT NULL GROUP BY 1),
      s AS (SELECT request_id, ws, len(ws) AS n FROM w WHERE len(ws) >= 8),
      p AS (SELECT a.request_id AS request_a, b.request_id AS request_b, len(list_intersect(a.ws, b.ws)) AS shared, a.n + b.n AS total FROM s a JOIN s b ON a.request_id < b.request_id AND least(a.n, b.n) >= 0.85 * greatest(a.n, b.n)),
      f AS (SELECT request_a, request_b, shared = total - shared AS equal FROM p WHERE shared >= 0.85 * (total - shared) - 1e-9)"""
    return {
        "p1_found": f"{pairs} SELECT request_a, request_b FROM f",
        "p1_classes": f"""{pairs}, u AS (SELECT request_a AS x, request_b AS y, equal FROM f UNION ALL SELECT request_b, request_a, equal FROM f)
          SELECT request_id, least(request_id, min(y) FILTER (WHERE equal)) AS class_id, count(y) AS links FROM s LEFT JOIN u ON x = request_id GROUP BY request_id""",
        "p6_roundtrip": "SELECT doc_id, true AS same FROM documents",
    }
