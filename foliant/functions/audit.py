"""Names, actors and boundaries of the API audit log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identifiers import is_blank

# Hosts with a name of their own.
API_NAMES = {"api.nytimes.com": "NYT API", "openlibrary.org": "OpenLibrary API", "www.googleapis.com": "Google Books API", "en.wikipedia.org": "Wikipedia API"}


def api_name(url: Column) -> Column:
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    known = F.element_at(F.create_map(*[F.lit(x) for kv in API_NAMES.items() for x in kv]), host)
    return F.when(F.coalesce(host, F.lit("")) == "", F.lit("Unknown External API")).otherwise(F.coalesce(known, host))


def query_names(url: Column) -> Column:
    """Decoded names of the query's parameters, distinct and in order without case, first spelling kept; null without a query. Values are never read."""
    query = F.try_parse_url(url, F.lit("QUERY"))
    parts = F.filter(F.split(query, "&"), lambda x: x != "")
    names = F.transform(parts, lambda x: F.coalesce(F.try_url_decode(F.replace(F.split(x, "=", 2)[0], F.lit("+"), F.lit("%2B"))), F.split(x, "=", 2)[0]))
    keyed = F.transform(names, lambda x: F.struct(F.upper(x).alias("k"), x.alias("name")))
    first = F.filter(F.transform(keyed, lambda x, i: F.struct(x["k"].alias("k"), x["name"].alias("name"),
        (F.array_position(F.transform(keyed, lambda y: y["k"]), x["k"]) == i + 1).alias("first"))), lambda x: x["first"])
    return F.when(F.coalesce(query, F.lit("")) != "", F.array_join(F.transform(F.sort_array(first), lambda x: x["name"]), ","))


def actor(authenticated: Column, client_id: Column, azp: Column, user_id: Column, email: Column, name: Column, has_context: Column,
    service: str = "service") -> Column:
    """struct(actor_type, actor_id); without a request context the service itself acts."""
    pair = lambda kind, who: F.struct(F.lit(kind).alias("actor_type"), who.alias("actor_id"))
    client = F.coalesce(client_id, azp)
    return (
        F.when(~F.coalesce(has_context, F.lit(False)), pair("system", F.lit(service)))
        .when(~F.coalesce(authenticated, F.lit(False)), pair("anonymous", F.lit("anonymous")))
        .when(~is_blank(client), pair("system", client))
        .otherwise(pair("user", F.coalesce(user_id, email, name, F.lit("unknown"))))
    )


def next_weekly_refresh(ts: Column, day: str = "THU", hour: int = 5) -> Column:
    """The next such weekday and hour strictly after ts (UTC session)."""
    this = F.next_day(F.date_sub(F.to_date(ts), 1), day).cast("timestamp") + F.make_interval(hours=F.lit(hour))
    return F.when(this > ts, this).otherwise(this + F.make_interval(days=F.lit(7)))
