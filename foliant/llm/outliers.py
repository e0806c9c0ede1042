"""Quality rules: robust multivariate outliers by minimum covariance determinant, with DataFrame operations only.

Each document gets base statistics, and five transformed ones. For each language and source the location and scatter of the SHARE of its documents with the
least determinant are sought: from STARTS starts (medians with median absolute deviations, and seeded quarters of the documents) two concentration steps
each, then on from the start with the least determinant until the subset stays, or subsets go round: then that of the round with the least determinant counts.
Groups that have settled take no part in later steps. A step keeps the SHARE of documents that lie nearest and takes
mean and covariance anew; it is two aggregations over a table of five whole numbers a document; both combine on the map side, so a source with a third
of all rows is no larger than others after it. Statistics are whole thousandths and sums are exact, so reruns agree. A document is rejected if its squared
Mahalanobis distance to its group, by Cholesky factors written out as column expressions, is above CUTOFF.

Groups under LEAST documents are pooled by language, and languages whose pool is still smaller are pooled together.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
NAMES = ("x_words", "x_length", "x_symbols", "x_lines", "x_repeats")
#: Standard deviations below these count as these: a statistic that is 0 for nearly all documents has none, and would reject all others.
#: Where a group has no repeated lines, two thirds of them reject alone (4.21 / 0.65 squared is CUTOFF); repeated words are rejected alone by the base rule.
FLOORS = (0.3, 0.1, 0.5, 0.65, 1.0)
#: chi-square of 5 degrees of freedom: 1 - 1e-7. CORRECTION makes the scatter of the nearest 75 % that of all.
CUTOFF, SHARE, CORRECTION, LEAST, SCALE = 42.0, 0.75, 1.41, 60, 1000
#: Of concentration steps, so many from each start.
STARTS, FIRST_STEPS = 5, 2
#: Groups up to so many are broadcast with their estimates (about 200 bytes each); more are joined by shuffle.
MAX_BROADCAST = 100_000


def statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the transformed statistics, in one pass without a shuffle."""
    long = lambda c: c.cast("long")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(*keep, body.alias("__body"), F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("__words"), F.filter(F.split(body, "\n"),
        lambda x: x.rlike(WORD)).alias("__lines"))
    n = F.size("__words")
    word = lambda i: F.get("__words", i)
    grams = F.when(n >= 5, F.transform(F.sequence(F.lit(0), F.greatest(n - 5, F.lit(0))),
        lambda i: F.xxhash64(*[word(i + j) for j in range(5)]))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        *keep, long(n).alias("n_words"), long(F.length(F.translate("__body", " \t\n\x0b\x0c\r", ""))).alias("word_chars"),
        long(F.length("__body") - F.length(F.translate("__body", SYMBOLS, ""))).alias("n_symbols"), F.size("__lines").alias("__n_lines"),
        long(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"), grams.alias("__grams"),
    )
    rows = rows.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("__grams")) < F.size("__grams"),
        long(_covered(F.col("__grams")))).otherwise(F.lit(0).cast("long"))).drop("__grams")
    rows = rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    some = F.greatest(F.col("n_words"), F.lit(1))
    x = (
        F.log1p("n_words"), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / some), F.log1p(100 * F.col("n_symbols") / some),
        F.log1p(100 * F.col("n_dup_lines") / F.greatest(F.col("__n_lines"), F.lit(1))), F.log1p(100 * F.col("n_repeat_words") / some),
    )
    return rows.withColumns({name: F.round(v * SCALE).cast("int") for name, v in zip(NAMES, x, strict=True)}).drop("__n_lines")


def _covered(grams: Column) -> Column:
    """Words under 5-word windows whose hash occurs twice or more: windows sorted by hash, those with an equal neighbour, their positions in order."""
    same = lambda s, k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
    repeated = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: same(s, k - 1, x) | same(s, k + 1, x)), lambda x: x["i"]))
    once = F.array(F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    positions = F.element_at(F.transform(once, repeated), 1)
    start = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
    return F.aggregate(positions, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).cast("int").alias("n"),
        i.cast("int").alias("last")), lambda a: a["n"])


def _with(rows: DataFrame, groups: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows with what their group has: a broadcast behind a check of the number of groups, else a join that adaptive execution splits where a group is large."""
    return rows.join(F.broadcast(groups) if groups.count() <= MAX_BROADCAST else groups, key, "left")


def _grouped(rows: DataFrame, least: int) -> DataFrame:
    """Adds `__group`, the estimate that a row belongs to: its language and source, else its language's pool, else the pool of all."""
    name = lambda *c: F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), F.col(x).cast("string")), F.lit("null")) for x in c]))
    own, lang = name("__lang", "__source"), name("__lang")
    sizes = rows.where(~F.col("base_failed")).groupBy(own.alias("__own"), lang.alias("__pool")).agg(F.count("*").alias("n"))
    pools = sizes.where(F.col("n") < least).groupBy("__pool").agg(F.sum("n").alias("m"))
    best = sizes.join(pools, "__pool", "left").select("__own", F.when(F.col("n") >= least, F.col("__own")).when(F.col("m") >= least,
        F.col("__pool")).otherwise(F.lit("all")).alias("__group"))
    best = table(best, "groups")
    return _with(rows.withColumn("__own", own), best, "__own").withColumn("__group", F.coalesce("__group", F.lit("all"))).drop("__own")


def _factor_columns(moments: DataFrame) -> DataFrame:
    """From sums by group, and start if there is one: mean m_i, Cholesky factor l_i_j of the corrected covariance, and the logarithm of its determinant, one column after another.

    A variance below its floor is raised to it; so is what is left of one, to a third of the floor, where statistics go together.
    """
    p = len(NAMES)
    n = F.col("n").cast("double")
    mean = lambda i: F.col(f"s_{i}").cast("double") / n / SCALE

    def scatter(i: int, j: int) -> Column:
        c = (F.col(f"s_{i}_{j}").cast("double") / n / SCALE / SCALE - mean(i) * mean(j)) * CORRECTION
        return F.greatest(c, F.lit(FLOORS[i] ** 2)) if i == j else c

    key = [c for c in ("__group", "start") if c in moments.columns]
    out = moments.select(*key, *[mean(i).alias(f"m_{i}") for i in range(p)], *[scatter(i, j).alias(f"c_{i}_{j}") for i in range(p)
        for j in range(i + 1)])
    for i in range(p):
        for j in range(i + 1):
            s = F.col(f"c_{i}_{j}")
            for k in range(j):
                s = s - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(s, F.lit(FLOORS[i] ** 2 / 9))) if i == j else s / F.col(f"l_{j}_{j}"))
    size = sum((F.log(f"l_{i}_{i}") for i in range(1, p)), F.log("l_0_0"))
    return out.select(*key, *[f"m_{i}" for i in range(p)], *[f"l_{i}_{j}" for i in range(p) for j in range(i + 1)],
        F.round(2 * size, 9).alias("determinant"))


def _by_factor() -> Column:
    """The squared distance of a row that has m_i and l_i_j."""
    y: list[Column] = []
    for i, name in enumerate(NAMES):
        r = F.col(name) / SCALE - F.col(f"m_{i}")
        for k in range(i):
            r = r - F.col(f"l_{i}_{k}") * y[k]
        y.append(r / F.col(f"l_{i}_{i}"))
    total = y[0] * y[0]
    for v in y[1:]:
        total = total + v * v
    return total


def _moments(rows: DataFrame, key: list[str]) -> DataFrame:
    """Number, sums and sums of products of the statistics by key, exact."""
    p = len(NAMES)
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    return rows.groupBy(*key).agg(F.count("*").alias("n"), *[exact(F.col(a)).alias(f"s_{i}") for i, a in enumerate(NAMES)],
        *[exact(F.col(NAMES[i]).cast("long") * F.col(NAMES[j])).alias(f"s_{i}_{j}") for i in range(p) for j in range(i + 1)])


def _starts(rows: DataFrame) -> DataFrame:
    """Estimates to start from: start 0 from medians, the others from the rows that a hash picks."""
    p = len(NAMES)
    middle = table(rows.groupBy("__group").agg(*[F.percentile(name, 0.5).alias(f"m_{i}") for i, name in enumerate(NAMES)]), "medians")
    spread = _with(rows, middle, "__group").groupBy("__group").agg(*[F.first(f"m_{i}").alias(f"m_{i}") for i in range(p)],
        *[F.percentile(F.abs(F.col(name) - F.col(f"m_{i}")), 0.5).alias(f"d_{i}") for i, name in enumerate(NAMES)])
    factor = {f"l_{i}_{j}": (F.greatest(1.4826 * F.col(f"d_{i}") / SCALE, F.lit(FLOORS[i])) if i == j else F.lit(0.0)) for i in range(p) for j in range(i + 1)}
    first = spread.select("__group", F.lit(0).alias("start"), *[(F.col(f"m_{i}") / SCALE).alias(f"m_{i}") for i in range(p)],
        *[c.alias(k) for k, c in factor.items()], F.lit(0.0).alias("determinant"))
    picked = rows.withColumn("start", F.explode(F.array(*[F.lit(k) for k in range(1, STARTS)]))).where(F.pmod(F.xxhash64("start", *NAMES), F.lit(4)) == 0)
    return table(first.unionByName(_factor_columns(_moments(picked, ["__group", "start"]))), "starts")


def _step(rows: DataFrame, now: DataFrame, key: list[str], few: bool) -> DataFrame:
    """Estimates anew, from the SHARE of rows (of the same key) that lie nearest to theirs. few: whether the estimates may be broadcast."""
    small = F.broadcast if few else lambda df: df
    # distances as whole steps of their logarithm, so that the quantile's counts stay few
    near = rows.join(small(now), key).withColumn("q", F.floor(F.log1p(_by_factor()) * SCALE).cast("int")).select(*key, "q", *NAMES)
    limit = near.groupBy(*key).agg(F.percentile("q", SHARE).alias("limit"))
    return _factor_columns(_moments(near.join(small(limit), key).where("q <= limit"), key))


def estimates(rows: DataFrame) -> DataFrame:
    """Location and scatter of each `__group` of rows (whole-number statistics): columns m_i and l_i_j, and the logarithm of the determinant.

    There are finitely many subsets and a step depends on the estimate alone, so each group comes to an estimate that it has had before.
    """
    now = _starts(rows)
    few = now.count() <= MAX_BROADCAST
    all_ = rows.withColumn("start", F.explode(F.array(*[F.lit(k) for k in range(STARTS)])))
    for _ in range(FIRST_STEPS):
        now = table(_step(all_, now, ["__group", "start"], few), "steps")
    found = F.struct("determinant", *[c for c in now.columns if c not in ("__group", "start", "determinant")])
    going = table(now.groupBy("__group").agg(F.array(F.min_by(found, F.struct("determinant", "start"))).alias("past")), "best")
    settled = []
    while not settled or not going.isEmpty():
        now = going.select("__group", F.inline(F.slice("past", -1, 1)))
        step = _step(rows, now, ["__group"], few).select("__group", found.alias("now"))
        step = table(step.join(F.broadcast(going) if few else going, "__group").withColumn("at", F.array_position("past", F.col("now"))), "steps")
        # past from that place on is the round that it goes, mostly the last one alone
        settled.append(step.where("at > 0").select("__group", F.inline(F.array(F.array_min(F.slice("past", F.col("at"), F.size("past")))))))
        going = step.where("at = 0").select("__group", F.concat("past", F.array("now")).alias("past"))
    return table(functools.reduce(DataFrame.unionByName, settled), "estimates")


def judged(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST,
    cutoff: float = CUTOFF) -> DataFrame:
    """`keep`, the base statistics, base_failed, distance (null where there is no estimate) and kept for each row.

    A null text counts as empty: no words, base_failed. Null languages and sources are values of their own. Repeated rows are judged alike (each counts in
    the estimates). A group whose documents all fail has no estimate and keeps none. An empty table gives an empty one. Texts of any length are read whole: a
    text's words are an array in memory, and repeats in it are found by sorting its windows.
    """
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"), F.col(lang).alias("__lang"), F.col(source).alias("__source"))
    light = table(statistics(rows, [*keep, "__lang", "__source"], "__text"), "statistics")
    light = _grouped(light, least)
    good = light.where(~F.col("base_failed")).select("__group", *NAMES)
    out = _with(light, estimates(good).drop("determinant"), "__group").withColumn("distance", _by_factor())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(False))
    return out.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
