"""Plans of problem 3 (messages delivered more than once)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakesieve.operators.redelivery import repeated_deliveries
from lakesieve.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every delivery except the one to keep."""
    return repeated_deliveries(table(spark, d, "check_requests"))


QUERIES = {"p3_found": p3_found}
ORACLES = {
    "p3_found": r"""
    WITH k AS (
      SELECT delivery_id, received_at, coalesce(tenant, '') AS tenant, fingerprint, sent_at,
             regexp_replace(regexp_replace(event_id, '^[\s\x{0B}\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+', ''), '[\s\x{0B}\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+$', '') AS ident
      FROM check_requests),
    m AS (SELECT delivery_id, received_at, tenant, nullif(ident, '') AS ident,
                 CASE WHEN nullif(ident, '') IS NULL THEN fingerprint END AS fp, CASE WHEN nullif(ident, '') IS NULL THEN sent_at END AS sent FROM k)
    SELECT delivery_id FROM (
      SELECT delivery_id, row_number() OVER (PARTITION BY tenant, ident, fp, sent ORDER BY received_at, delivery_id) AS rn FROM m) WHERE rn > 1
    """,
}
