"""Dashboard statistics, trends, errors, alerts and ratings over logs and tickets. Moments relative to now take `as_of`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.stats import mean0, period_key, share

UNSET, UNASSIGNED = "(unset)", "(unassigned)"


def daily_trend(df: DataFrame, ts: str, value: str) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def group_aggregate(df: DataFrame, key: str, agg: Column) -> DataFrame:
    """Group with any aggregate expression; a grouped-agg pandas UDF serves for what has none."""
    return df.groupBy(key).agg(agg.alias("value"))


def moving_average(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, rows: int) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(-(rows - 1), 0)
    return df.withColumn("moving_avg", F.avg(value).over(w))


def counts_by_dimension(df: DataFrame, dims: dict[str, str | None]) -> DataFrame:
    """Long form (dimension, key, n) for several columns in one pass; null keys are named, or dropped if their name is None."""
    each = F.array(*[F.struct(F.lit(d).alias("dimension"), (F.coalesce(F.col(d).cast("string"), F.lit(n)) if n else F.col(d).cast("string")).alias("key")) for d, n in dims.items()])
    return df.select(F.explode(each).alias("e")).select("e.*").filter("key IS NOT NULL").groupBy("dimension", "key").agg(F.count(F.lit(1)).alias("n"))


def ticket_trends(tickets: DataFrame, period: str, created: str, completed: str, status: str, buckets: dict[str, Sequence[str]]) -> DataFrame:
    """Per period: tickets created there by status bucket, and tickets completed there whenever they were created."""
    made = tickets.select(period_key(F.col(created), period).alias("period"), F.lit(1).alias("total"), *[F.col(status).isin(*v).cast("int").alias(b) for b, v in buckets.items()], F.lit(0).alias("completed"))
    done = tickets.filter(F.col(completed).isNotNull()).select(period_key(F.col(completed), period).alias("period"), F.lit(0).alias("total"), *[F.lit(0).alias(b) for b in buckets], F.lit(1).alias("completed"))
    return made.union(done).groupBy("period").agg(*[F.sum(c).alias(c) for c in ("total", *buckets, "completed")])


def filter_options(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in cols])


def top_counts(df: DataFrame, key: str, n: int, label: int | None = None) -> DataFrame:
    x = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(n)
    return x.withColumn("label", F.when(F.length(F.col(key).cast("string")) > label, F.concat(F.substring(F.col(key).cast("string"), 1, label), F.lit("..."))).otherwise(F.col(key).cast("string"))) if label else x


def rate_by_bucket(df: DataFrame, ts: str, bad: Column, as_of: str, step: str, buckets: int) -> DataFrame:
    """Rows and error rate for the last `buckets` steps before as_of; empty buckets stay, with rate 0."""
    spark = df.sparkSession
    end = F.lit(as_of).cast("timestamp_ntz")
    spine = spark.range(buckets).select((end - F.expr(f"INTERVAL '1' {step}") * (F.lit(buckets) - F.col("id")).cast("int")).alias("bucket"))
    x = df.select(F.date_trunc(step, ts).cast("timestamp_ntz").alias("bucket"), bad.cast("int").alias("bad"))
    got = x.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("n_bad"))
    n, n_bad = F.coalesce("n", F.lit(0)), F.coalesce("n_bad", F.lit(0))
    return spine.join(got, "bucket", "left").select(F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("bucket"), n.alias("n"), F.coalesce(F.try_divide(100.0 * n_bad, n), F.lit(0.0)).alias("rate"))


def normalise_message(c: Column) -> Column:
    """UUIDs, timestamps and numbers become placeholders, in this order."""
    x = F.regexp_replace(c, "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "[UUID]")
    x = F.regexp_replace(x, "[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}", "[TIMESTAMP]")
    return F.regexp_replace(x, "[0-9]+", "[NUMBER]")


def firsts(df: DataFrame, by: str, order: Sequence[Column], value: str, n: int, name: str) -> DataFrame:
    """by, name: the first n values of each group in the order. The limit is applied in every task before rows are shuffled."""
    ranked = df.withColumn("rn", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("rn") <= n)
    got = ranked.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rn", value))).alias("r"))
    return got.select(by, F.transform("r", lambda e: e[value]).alias(name))


def error_patterns(df: DataFrame, message: str, ts: str, key: str, top: int = 10, examples: int = 3) -> DataFrame:
    x = df.select(normalise_message(F.col(message)).alias("pattern"), ts, key)
    counts = x.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen")).orderBy(F.desc("n"), "pattern").limit(top)
    few = firsts(x.join(F.broadcast(counts.select("pattern")), "pattern", "left_semi"), "pattern", [F.col(ts), F.col(key)], key, examples, "examples")  # `top` rows
    return counts.join(few.withColumn("examples", F.array_sort("examples")), "pattern")


def alerts(df: DataFrame, ts: str, value: str, bad: Column, as_of: str, slow: float, max_error: float) -> DataFrame:
    """Alerts of the hour before as_of: mean over `slow` (critical over twice that), longest over twice `slow`, error share over max_error percent."""
    end = F.lit(as_of).cast("timestamp_ntz")
    recent = df.filter((F.col(ts) > end - F.expr("INTERVAL '1' HOUR")) & (F.col(ts) <= end))
    a = recent.agg(mean0(value).alias("avg"), F.coalesce(F.max(value), F.lit(0.0)).alias("max"), share(bad).alias("err"))
    row = lambda kind, v, limit, cond, critical: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.when(critical, "critical").otherwise("warning").alias("severity"), v.alias("value"), F.lit(float(limit)).alias("threshold")))
    avg, top, err = F.col("avg"), F.col("max"), F.col("err")
    rows = F.array_compact(F.array(row("mean", avg, slow, avg > slow, avg > 2 * slow), row("max", top, 2 * slow, top > 2 * slow, F.lit(False)), row("errors", err, max_error, err > max_error, err > 2 * max_error)))
    return a.select(F.explode(rows).alias("a")).select("a.*")


def session_metrics(df: DataFrame, session: str, ts: str, bad: Column) -> DataFrame:
    s = df.groupBy(session).agg((F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))).alias("us"), F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"))
    return s.agg(F.count(F.lit(1)).alias("sessions"), (F.coalesce(F.avg("us"), F.lit(0.0)) / 1e6).alias("mean_seconds"), share(F.col("n") > 1).alias("repeat_share"), F.coalesce(F.try_divide(100.0 * F.sum("bad"), F.sum("n")), F.lit(0.0)).alias("error_rate"))


def classify(text: Column, rules: dict[str, Sequence[str]], other: str) -> Column:
    """The first rule with a keyword in the text."""
    out = F.lit(other)
    for name, words in reversed(rules.items()):
        out = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), F.lit(name)).otherwise(out)
    return out


def multi_label(text: Column, rules: dict[str, Sequence[str]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.exists(F.array(*map(F.lit, v)), lambda w: F.contains(text, w)), F.lit(k)) for k, v in rules.items()]))


def latest(df: DataFrame, by: str, *order: str) -> DataFrame:
    """The last row of each group: max_by over one struct, no sort."""
    rest = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(by, "r.*")


def rating_stats(df: DataFrame, rating: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), mean0(rating).alias("mean"), *[F.count_if(F.col(rating) == i).alias(f"r{i}") for i in range(1, 6)])


def kpis(df: DataFrame, ts: str, user: str, as_of: str) -> DataFrame:
    """Counts of today, yesterday, this week (from Sunday) and this month, and distinct users in all and in the last hour."""
    end = F.lit(as_of).cast("timestamp_ntz")
    today = F.to_date(end)
    day, t = F.to_date(ts), F.col(ts)
    week = F.date_sub(today, F.dayofweek(today) - 1)
    return df.filter(t <= end).agg(F.count_if(day == today).alias("today"), F.count_if(day == F.date_sub(today, 1)).alias("yesterday"), F.count_if(day >= week).alias("week"), F.count_if(day >= F.trunc(today, "month")).alias("month"), F.countDistinct(user).alias("users"), F.countDistinct(F.when(t > end - F.expr("INTERVAL '1' HOUR"), F.col(user))).alias("users_hour"))


#: Groups whose rows of statistics may be broadcast.
GROUPS = 1_000_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(GROUPS + 1).count() <= GROUPS else df


def at_ranks(df: DataFrame, by: str, value: str, ranks: DataFrame, cells: int = 4096) -> DataFrame:
    """(by, rank) -> (by, rank, value): the value at a place (from 0) in the order of a group's values, exactly, without sorting the group: a
    histogram of equal cells says which cell holds the place, and only that cell's values are counted and put in order."""
    v = df.filter(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("v"))
    span = _small(v.groupBy(by).agg(F.min("v").alias("low"), F.max("v").alias("high")))
    width = (F.col("high") - F.col("low")) / F.lit(float(cells))
    cell = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("low")) / width), F.lit(cells - 1))).otherwise(F.lit(0)).cast("int")
    x = v.join(span, by).select(by, "v", cell.alias("cell"))
    below = lambda *keys: F.sum("n").over(W.partitionBy(*keys).orderBy("cell" if len(keys) == 1 else "v")) - F.col("n")
    counts = x.groupBy(by, "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("before", below(by))
    target = _small(ranks.join(counts, by).filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))).select(by, "cell", "rank", "before"))
    inside = x.join(target.select(by, "cell").distinct(), [by, "cell"], "left_semi").groupBy(by, "cell", "v").agg(F.count(F.lit(1)).alias("n"))
    inside = inside.withColumn("below", below(by, "cell"))
    found = inside.join(target, [by, "cell"]).withColumn("at", F.col("rank") - F.col("before"))
    return found.filter((F.col("at") >= F.col("below")) & (F.col("at") < F.col("below") + F.col("n"))).select(by, "rank", F.col("v").alias(value))


def _ranked(df: DataFrame, by: str, value: str, places: dict[str, Column]) -> DataFrame:
    """by, and the value at each of the places, which are expressions over n, the group's number of values."""
    n = df.filter(F.col(value).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    wanted = n.select(by, F.inline(F.array(*[F.struct(F.lit(name).alias("name"), at.cast("bigint").alias("rank")) for name, at in places.items()])))
    got = at_ranks(df, by, value, wanted.select(by, "rank").distinct())
    each = wanted.join(got, [by, "rank"])
    return each.groupBy(by).agg(*[F.max(F.when(F.col("name") == name, F.col(value))).alias(name) for name in places]).join(n, by)


def quantiles(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """by and, for each name, the percentile (0 to 100) with linear interpolation between neighbours."""
    for p in shares.values():
        if not 0 <= p <= 100:
            raise ValueError("a percentile lies between 0 and 100")
    at = {name: F.lit(p / 100) * (F.col("n") - 1) for name, p in shares.items()}
    x = _ranked(df, by, value, {f"{name}_{side}": f(place) for name, place in at.items() for side, f in (("low", F.floor), ("high", F.ceil))})
    between = lambda name: F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (at[name] - F.floor(at[name]))
    return x.select(by, *[between(name).alias(name) for name in shares])


def nearest_ranks(df: DataFrame, by: str, value: str, percents: dict[str, int]) -> DataFrame:
    """by and, for each name, the value at place min(floor(n * percent / 100), n - 1)."""
    places = {name: F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1) for name, p in percents.items()}
    return _ranked(df, by, value, places).drop("n")
