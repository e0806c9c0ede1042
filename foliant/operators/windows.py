"""First occurrences, positions, latest versions, folds and fixed windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import is_blank


def keep_first(df: DataFrame, keys: list, order: list) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): the first row of each key in an order, and the later ones. The order must be total for reruns to agree."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__n = 1").drop("__n"), ranked.where("__n > 1").drop("__n")


def compact_positions(df: DataFrame, group: list[str], order: list, position: str = "position") -> DataFrame:
    """Numbers the rows of each group 1 to n."""
    return df.withColumn(position, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def latest_published(batches: DataFrame) -> DataFrame:
    """The published batch of each slug (without case) that was published last."""
    row = F.struct(*[F.col(c) for c in batches.columns])
    best = batches.where("status = 'Published'").groupBy(F.lower("genre_slug").alias("__slug")).agg(
        F.max_by(row, F.struct("published_at", "batch_id")).alias("r"))
    return best.select("r.*")


def fold_entries(requests: DataFrame, entry: list[str], order: list, status: str = "status") -> DataFrame:
    """Final state of each entry after its requests in order, where all requests of an entry keep its keys (otherwise see shelves.upsert_entries).

    start_date: the first request with Reading; end_date: the last turn into Read; there percent is 100 and pages the page count. Else pages and percent are
    the last ones given.
    """
    seq = Window.partitionBy(*entry).orderBy(*order)
    into_read = (F.col(status) == "Read") & ~F.coalesce(F.lag(status).over(seq) == "Read", F.lit(False))
    rows = requests.withColumn("__into", into_read)
    rows = rows.withColumns({
        "__percent": F.when(F.col("__into"), F.lit(100)).otherwise(F.col("percent_completed")),
        "__pages": F.when(F.col("__into") & (F.col("page_count") > 0), F.col("page_count")).otherwise(F.col("pages_completed")),
    })
    rows = rows.withColumn("__n", F.row_number().over(seq))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__n")))
    return rows.groupBy(*entry).agg(
        F.max_by(status, "__n").alias("status"), F.max_by("page_count", "__n").alias("page_count"), F.coalesce(last("__pages"), F.lit(0)).alias(
            "pages_completed"), F.coalesce(last("__percent"), F.lit(0)).alias("percent_completed"),
        F.min(F.when(F.col(status) == "Reading", F.col("ts"))).alias("start_date"), F.max(F.when(F.col("__into"), F.col("ts"))).alias("end_date"),
            F.min("ts").alias("created_date"), F.max("ts").alias("updated_date"),
    )


def recently_viewed(views: DataFrame, book: str, n: int = 12, user: str = "user_id", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Each user's n books viewed last, newest first, with `position`; a book counts once, at its last view."""
    row = F.struct(*[F.col(c) for c in views.columns if c not in (user, book)])
    latest = views.groupBy(user, book).agg(F.max_by(row, F.struct(*order)).alias("__r")).select(user, book, "__r.*")
    seq = Window.partitionBy(user).orderBy(*[F.desc(c) for c in order])
    return latest.withColumn("position", F.row_number().over(seq)).where(F.col("position") <= n)


def fresh_snapshots(df: DataFrame, as_of: Column, ttl: Column, key: str = "key", payload: str = "payload") -> DataFrame:
    """The latest non-blank payload of each key that is not older than ttl (an interval) at as_of."""
    fresh = df.where(~is_blank(F.col(payload)) & (F.col("retrieved_at") <= as_of) & (as_of < F.col("retrieved_at") + ttl))
    return fresh.groupBy(key).agg(F.max_by(payload, F.struct("retrieved_at", payload)).alias(payload), F.max("retrieved_at").alias("retrieved_at"))


def rate_limit(df: DataFrame, key: str, limit: int = 10, window: str = "1 minute", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Adds window_start, request_number and rejected (beyond the limit in its fixed window of its key)."""
    start = F.window(F.col("ts").cast("timestamp"), window)["start"]
    rows = df.withColumn("window_start", start)
    number = F.row_number().over(Window.partitionBy(key, "window_start").orderBy(*order))
    return rows.withColumn("request_number", number).withColumn("rejected", F.col("request_number") > limit)


def ranked(df: DataFrame, group: list[str], order: list[str | Column], pos: str, bucket: int = 10_000, name: str = "rank") -> DataFrame:
    """Adds the row's number in its group by the columns of order (named, or with an alias) and then by pos, a whole number.

    No group is sorted in one task: rows are numbered within each stretch of `bucket` positions, behind the counts of the stretches before it.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = df.withColumns({f"__o{i}": c for i, c in enumerate(keys)}).withColumn("__stretch", F.floor(F.col(pos) / bucket))
    stretch = [*group, *[f"__o{i}" for i in range(len(keys))], "__stretch"]
    sums = rows.groupBy(*stretch).agg(F.count("*").alias("__n"))
    before = sums.withColumn("__before", F.sum("__n").over(Window.partitionBy(*group).orderBy(*stretch[len(group) :])) - F.col("__n")).drop("__n")
    inner = rows.withColumn("__inner", F.row_number().over(Window.partitionBy(*stretch).orderBy(pos)))
    same = [inner[c].eqNullSafe(before[c]) for c in stretch]
    joined = inner.join(before, reduce(lambda a, b: a & b, same))
    return joined.select(*[inner[c] for c in df.columns], (F.col("__inner") + F.col("__before")).cast("int").alias(name))
