"""The audit log: projection, lookups, retention; and the daily rotation."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.audit import actor, api_name, query_names


def audit_project(calls: DataFrame, service: str = "service") -> DataFrame:
    """Log rows of outbound calls.

    calls: started_at, url, method, status_code, duration_ms, has_context, authenticated, client_id, azp, user_id, email, name, client_ip, user_agent,
    trace_id, error_type. Error texts may hold secrets and are replaced; parameter values are never kept.
    """
    who = actor(*[F.col(c) for c in ("authenticated", "client_id", "azp", "user_id", "email", "name", "has_context")], service=service)
    cut = lambda c, n: F.substring(c, 1, n)
    path = F.coalesce(F.try_parse_url(F.col("url"), F.lit("PATH")), F.lit("unknown"))
    return calls.withColumn("__who", who).select(
        "started_at", api_name(F.col("url")).alias("api_name"), F.lit("outbound").alias("direction"), "method",
            cut(F.when(path == "", "/").otherwise(path), 512).alias("route"), F.coalesce("status_code", F.lit(500)).alias("status_code"), "duration_ms",
        F.col("__who.actor_type").alias("actor_type"), cut(F.col("__who.actor_id"), 255).alias("actor_id"), cut(query_names(F.col("url")), 512).alias(
            "query_parameter_names"), "client_ip", cut(F.col("user_agent"), 512).alias("user_agent"), "trace_id",
        "error_type", F.when(F.col("error_type").isNotNull(), "Outbound request failed.").alias("error_message"),
    )


def audit_lookup(logs: DataFrame, start: datetime | None = None, end: datetime | None = None, api: str | None = None, actor_id: str | None = None,
    trace: str | None = None) -> DataFrame:
    """Log rows of a time range [start, end), an API, an actor or a trace. On a log partitioned by `day` the range also prunes partitions."""
    out = logs
    for column, value, op in (("started_at", start, "ge"), ("started_at", end, "lt"), ("api_name", api, "eq"), ("actor_id", actor_id, "eq"),
        ("trace_id", trace, "eq")):
        if value is not None:
            c, v = F.col(column), F.lit(value)
            out = out.where({"ge": c >= v, "lt": c < v, "eq": c == v}[op])
            if column == "started_at" and "day" in logs.columns:
                out = out.where(F.col("day") >= F.lit(value.date()) if op == "ge" else F.col("day") <= F.lit(value.date()))
    return out


def expire(df: DataFrame, ts: str, as_of: Column, days: int = 90) -> DataFrame:
    """Rows that are not older than so many days."""
    return df.where(F.col(ts) >= as_of - F.make_interval(days=F.lit(days)))


def rotation(dates: DataFrame, items: DataFrame, epoch: date = date(2024, 1, 1)) -> DataFrame:
    """The item of each date: whole days since the epoch, modulo the number of items (column idx, from 0). Items are a list for people to read; they are counted in Spark."""
    n = items.agg(F.count("*")).scalar()
    numbered = dates.withColumn("idx", F.pmod(F.datediff("date", F.lit(epoch)), n).cast("int"))
    return numbered.join(items, "idx").drop("idx")
