"""Usage counts, quotas and rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesieve.functions.text import blocklist


def daily_usage(calls: DataFrame, tenant: str, ts: str) -> DataFrame:
    """(tenant, day, calls) by UTC day. A null tenant is counted as one of its own, null times are left out."""
    return calls.where(F.col(ts).isNotNull()).groupBy(F.col(tenant).alias("tenant"), F.to_date(ts).alias("day")).agg(F.count("*").alias("calls"))


def usage_history(usage: DataFrame, days: int = 7) -> DataFrame:
    """(day, calls) of the last ``days`` days up to the latest one, over all tenants, days without calls as 0."""
    per_day = usage.groupBy("day").agg(F.sum("calls").alias("calls"))
    span = per_day.agg(F.max("day").alias("last")).where("last is not null").select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    return span.join(per_day, "day", "left").select("day", F.coalesce("calls", F.lit(0)).cast("long").alias("calls"))


def within_quota(calls: DataFrame, tenant: str, ts: str, order: str, limit: Column) -> DataFrame:
    """``calls`` with ``admitted``: the first ``limit`` calls of a tenant's day, by time and ``order``; no limit where null."""
    w = Window.partitionBy(tenant, F.to_date(ts)).orderBy(ts, order)
    return calls.withColumn("_n", F.row_number().over(w)).withColumn("admitted", F.coalesce(F.col("_n") <= limit, F.lit(True))).drop("_n")


def within_rate(calls: DataFrame, tenant: str, ts: str, order: str, limit: int = 60, seconds: int = 60) -> DataFrame:
    """``calls`` with ``admitted``: the first ``limit`` calls of a tenant's fixed window."""
    slot = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds)
    w = Window.partitionBy(tenant, slot).orderBy(ts, order)
    return calls.withColumn("admitted", F.row_number().over(w) <= limit)


def newest(calls: DataFrame, tenant: str, ts: str, order: str, most: int = 100) -> DataFrame:
    """The newest ``most`` calls of every tenant. Spark cuts each task's rows to ``most`` a tenant before the shuffle."""
    w = Window.partitionBy(tenant).orderBy(F.col(ts).desc(), F.col(order).desc())
    return calls.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def effective_plan(plan: Column, status: Column) -> Column:
    """The plan counts only while its subscription is active or on trial, else guest."""
    return F.when(status.isin("active", "trialing"), plan).otherwise("guest")


def put_blocklists(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """(tenant, phrases) after updates of the same form, which replace a tenant's list; an empty tenant is the global one.

    Phrases are trimmed, blank and overlong ones dropped. Of several updates of a tenant the longest list counts.
    """
    fresh = updates.select(F.coalesce("tenant", F.lit("")).alias("tenant"), blocklist(F.col("phrases")).alias("phrases"))
    fresh = fresh.groupBy("tenant").agg(F.max_by("phrases", F.struct(F.size("phrases"), F.array_join("phrases", "\n"))).alias("phrases"))
    return stored.select("tenant", "phrases").join(fresh, "tenant", "left_anti").unionByName(fresh)


def with_blocklists(requests: DataFrame, stored: DataFrame, own: str = "blocklist") -> DataFrame:
    """``requests`` with ``phrases``: their own list, then the stored one of their tenant, else the global one."""
    lists = stored.where("tenant <> ''").select("tenant", F.col("phrases").alias("_t"))
    shared = stored.where("tenant = ''").select(F.col("phrases").alias("_g")).limit(1)
    each = requests.join(lists, "tenant", "left").join(F.broadcast(shared), F.lit(True), "left")  # one row at most
    none = F.array().cast("array<string>")
    return each.withColumn("phrases", F.concat(F.coalesce(own, none), F.coalesce("_t", "_g", none))).drop("_t", "_g")
