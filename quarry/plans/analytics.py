"""Queries on statistics, trends and dashboards."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.stats import mean0, period_key, period_start, share, week_of_month
from quarry.operators import analytics as A

from .registry import query, table

AS_OF = "2024-01-31 00:00:00"


def _bad():  # noqa: ANN202
    return F.col("event_type") == "error"


def events(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "events")


def tickets(spark, d):  # noqa: ANN001, ANN201
    """Orders as tickets: completed when the last line ships, if all of it is shipped (status F)."""
    done = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    x = table(spark, d, "orders").join(done, "o_orderkey", "left")
    return x.withColumn("completed", F.when(F.col("o_orderstatus") == "F", F.col("shipped"))).drop("shipped")


TICKETS = "tickets AS (SELECT o.*, CASE WHEN o_orderstatus = 'F' THEN shipped END AS completed FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"


@query("agg_1_daily_trend", "SELECT CAST(ts AS DATE) AS day, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1")
def agg_1(s, d):
    return A.daily_trend(events(s, d), "ts", "value").withColumn("mean", F.round("mean", 6))


@query("agg_2_distribution", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def agg_2(s, d):
    return A.distribution(table(s, d, "orders"), "o_orderpriority")


@query("agg_3_mean", "SELECT round(coalesce(avg(value), 0), 6) AS mean, coalesce(avg(CASE WHEN event_type = 'none' THEN value END), 0) AS mean_of_none FROM events")
def agg_3(s, d):
    return events(s, d).agg(F.round(mean0("value"), 6).alias("mean"), mean0(F.when(F.col("event_type") == "none", F.col("value"))).alias("mean_of_none"))


@query("agg_4_median", "SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY 1")
def agg_4(s, d):
    return A.quantiles(events(s, d), "event_type", "value", {"median": 50}).withColumn("median", F.round("median", 6))


@query("agg_5_sum", "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def agg_5(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("agg_6_percentile", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def agg_6(s, d):
    return A.quantiles(events(s, d), "event_type", "value", {"p50": 50, "p95": 95}).select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("agg_7_std", "SELECT event_type, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def agg_7(s, d):
    return events(s, d).groupBy("event_type").agg(F.round(F.stddev_pop("value"), 6).alias("std"))


@query("agg_8_group_aggregate", "SELECT user_id, round(max(value) - min(value), 6) AS value FROM events GROUP BY 1")
def agg_8(s, d):
    return A.group_aggregate(events(s, d), "user_id", F.round(F.max("value") - F.min("value"), 6))


_MOVING = "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {} PRECEDING AND CURRENT ROW), 6) AS moving_avg FROM events"


@query("agg_9_moving_average", _MOVING.format(6))
def agg_9(s, d):
    return A.moving_average(events(s, d), ["user_id"], ["ts", "event_id"], "value", 7).select("event_id", F.round("moving_avg", 6).alias("moving_avg"))


@query("win_3_moving_average", _MOVING.format(2))
def win_3(s, d):
    return A.moving_average(events(s, d), ["user_id"], ["ts", "event_id"], "value", 3).select("event_id", F.round("moving_avg", 6).alias("moving_avg"))


@query("agg_10_ticket_stats", """SELECT 'o_orderstatus' AS dimension, coalesce(o_orderstatus, '(unset)') AS key, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderpriority', coalesce(o_orderpriority, '(unset)'), count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR), count(*) FROM orders WHERE o_custkey IS NOT NULL GROUP BY 2""")
def agg_10(s, d):
    return A.counts_by_dimension(table(s, d, "orders"), {"o_orderstatus": A.UNSET, "o_orderpriority": A.UNSET, "o_custkey": None})


@query("agg_11_ticket_trends", f"""WITH {TICKETS},
p AS (SELECT strftime(o_orderdate, '%Y-%m') || '-W' || CAST(ceil(day(o_orderdate) / 7) AS INT) AS period, 1 AS total, (o_orderstatus = 'O')::INT AS todo, (o_orderstatus = 'P')::INT AS doing, (o_orderstatus = 'F')::INT AS done, 0 AS completed FROM tickets
UNION ALL SELECT strftime(completed, '%Y-%m') || '-W' || CAST(ceil(day(completed) / 7) AS INT), 0, 0, 0, 0, 1 FROM tickets WHERE completed IS NOT NULL)
SELECT period, sum(total)::BIGINT AS total, sum(todo)::BIGINT AS todo, sum(doing)::BIGINT AS doing, sum(done)::BIGINT AS done, sum(completed)::BIGINT AS completed FROM p GROUP BY 1""")
def agg_11(s, d):
    return A.ticket_trends(tickets(s, d), "week", "o_orderdate", "completed", "o_orderstatus", {"todo": ["O"], "doing": ["P"], "done": ["F"]})


@query("agg_12_filter_options", "SELECT list_sort(list(DISTINCT o_orderstatus)) AS o_orderstatus, list_sort(list(DISTINCT o_orderpriority)) AS o_orderpriority FROM orders")
def agg_12(s, d):
    return A.filter_options(table(s, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("agg_13_top_assignees", "SELECT c_name, n, CASE WHEN length(c_name) > 15 THEN substr(c_name, 1, 15) || '...' ELSE c_name END AS label FROM (SELECT c_name, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 ORDER BY n DESC, c_name LIMIT 10)")
def agg_13(s, d):
    x = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return A.top_counts(x, "c_name", 10, 15)


@query("agg_14_errors_by_category", """WITH e AS (SELECT user_id % 4 AS category, event_id, ts FROM events WHERE event_type = 'error'), c AS (SELECT unnest(range(5)) AS category),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ts DESC, event_id DESC) AS rn FROM e),
span AS (SELECT greatest(1, date_diff('day', min(ts)::DATE, max(ts)::DATE)) AS days FROM events)
SELECT c.category, count(r.event_id) AS n, round(100.0 * count(r.event_id) / (SELECT count(*) FROM e), 6) AS percent, round(count(r.event_id) / (SELECT days FROM span), 6) AS per_day, coalesce(list(r.event_id ORDER BY rn) FILTER (rn <= 5), []) AS recent
FROM c LEFT JOIN r ON r.category = c.category GROUP BY 1""")
def agg_14(s, d):
    ev = events(s, d)
    e = ev.filter(_bad()).select((F.col("user_id") % 4).alias("category"), "event_id", "ts")
    newest = A.firsts(e, "category", [F.desc("ts"), F.desc("event_id")], "event_id", 5, "recent")
    got = e.groupBy("category").agg(F.count(F.lit(1)).alias("n")).join(newest, "category")
    span = ev.agg(F.greatest(F.lit(1), F.datediff(F.max("ts"), F.min("ts"))).alias("days"), F.count_if(_bad()).alias("all"))
    x = s.range(5).select(F.col("id").alias("category")).join(got, "category", "left").crossJoin(F.broadcast(span))  # one row
    n = F.coalesce("n", F.lit(0))
    return x.select("category", n.alias("n"), F.round(100.0 * n / F.col("all"), 6).alias("percent"), F.round(n / F.col("days"), 6).alias("per_day"), F.coalesce("recent", F.array().cast("array<bigint>")).alias("recent"))


@query("agg_15_errors_by_level", "SELECT CASE WHEN value > 60 THEN 'high' WHEN value > 20 THEN 'medium' ELSE 'low' END AS level, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS resolved, count(*) FILTER (event_id % 3 <> 0) AS unresolved, count(*) FILTER (event_id % 3 = 1) AS investigating FROM events WHERE event_type = 'error' GROUP BY 1")
def agg_15(s, d):
    level = F.when(F.col("value") > 60, "high").when(F.col("value") > 20, "medium").otherwise("low")
    m = F.col("event_id") % 3
    return events(s, d).filter(_bad()).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.count_if(m == 0).alias("resolved"), F.count_if(m != 0).alias("unresolved"), F.count_if(m == 1).alias("investigating"))


def _rate(step: str, n: int) -> str:
    return f"""WITH b AS (SELECT TIMESTAMP '{AS_OF}' - INTERVAL 1 {step} * ({n} - i) AS bucket FROM range({n}) t(i)), e AS (SELECT date_trunc('{step}', ts) AS bucket, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY 1)
SELECT strftime(b.bucket, '%Y-%m-%d %H:%M') AS bucket, coalesce(n, 0) AS n, round(coalesce(100.0 * bad / n, 0), 6) AS rate FROM b LEFT JOIN e ON b.bucket = e.bucket"""


@query("agg_16_error_rate_by_hour", _rate("HOUR", 24))
def agg_16(s, d):
    return A.rate_by_bucket(events(s, d), "ts", _bad(), AS_OF, "HOUR", 24).withColumn("rate", F.round("rate", 6))


@query("agg_16_error_rate_by_day", _rate("DAY", 7))
def agg_16b(s, d):
    return A.rate_by_bucket(events(s, d), "ts", _bad(), AS_OF, "DAY", 7).withColumn("rate", F.round("rate", 6))


@query("agg_17_error_patterns", """WITH p AS (SELECT regexp_replace('code ' || event_id % 7 || ' for user ' || chr(CAST(65 + user_id % 3 AS INT)), '[0-9]+', '[NUMBER]', 'g') AS pattern, ts, event_id FROM events WHERE event_type = 'error'), r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY ts, event_id) AS rn FROM p)
SELECT pattern, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, list_sort(list(event_id) FILTER (rn <= 3)) AS examples FROM r GROUP BY 1 ORDER BY n DESC, pattern LIMIT 10""")
def agg_17(s, d):
    m = F.concat(F.lit("code "), (F.col("event_id") % 7).cast("string"), F.lit(" for user "), F.chr((65 + F.col("user_id") % 3).cast("bigint")))
    x = A.error_patterns(events(s, d).filter(_bad()).withColumn("message", m), "message", "ts", "event_id")
    return x.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_seen", "last_seen")})


@query("agg_18_alerts", """WITH a AS (SELECT coalesce(avg(value), 0) AS m, coalesce(max(value), 0) AS x, coalesce(100.0 * count(*) FILTER (event_type = 'error') / nullif(count(*), 0), 0) AS e FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1 HOUR AND ts <= TIMESTAMP '2024-01-20 00:00:00')
SELECT * FROM (SELECT 'mean' AS kind, CASE WHEN m > 20 THEN 'critical' ELSE 'warning' END AS severity, round(m, 6) AS value, 10.0::DOUBLE AS threshold FROM a WHERE m > 10 UNION ALL SELECT 'max', 'warning', round(x, 6), 20.0 FROM a WHERE x > 20 UNION ALL SELECT 'errors', CASE WHEN e > 10 THEN 'critical' ELSE 'warning' END, round(e, 6), 5.0 FROM a WHERE e > 5)""")
def agg_18(s, d):
    return A.alerts(events(s, d), "ts", "value", _bad(), "2024-01-20 00:00:00", 10.0, 5.0).withColumn("value", F.round("value", 6))


@query("agg_19_frequent_questions", "SELECT lower(props) AS question, count(*) AS n, round(avg(value), 6) AS mean_time, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY 1 ORDER BY n DESC, question LIMIT 20")
def agg_19(s, d):
    x = events(s, d).groupBy(F.lower("props").alias("question")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_time"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last"))
    return x.orderBy(F.desc("n"), "question").limit(20)


@query("agg_20_quality_metrics", "SELECT CAST(ts AS DATE) AS day, count(*) FILTER (q > 0.8) AS high, count(*) FILTER (q > 0.5 AND q <= 0.8) AS medium, count(*) FILTER (q <= 0.5) AS low, round(avg(q), 6) AS mean FROM (SELECT ts, 1 / (1 + value / 10) AS q FROM events) GROUP BY 1")
def agg_20(s, d):
    q = F.col("q")
    return events(s, d).select("ts", (1 / (1 + F.col("value") / 10)).alias("q")).groupBy(F.to_date("ts").alias("day")).agg(F.count_if(q > 0.8).alias("high"), F.count_if((q > 0.5) & (q <= 0.8)).alias("medium"), F.count_if(q <= 0.5).alias("low"), F.round(F.avg(q), 6).alias("mean"))


@query("agg_21_sessions", "WITH s AS (SELECT user_id, date_diff('microsecond', min(ts), max(ts)) AS us, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY 1) SELECT count(*) AS sessions, round(avg(us) / 1e6, 3) AS mean_seconds, round(100.0 * count(*) FILTER (n > 1) / count(*), 6) AS repeat_share, round(100.0 * sum(bad) / sum(n), 6) AS error_rate FROM s")
def agg_21(s, d):
    x = A.session_metrics(events(s, d), "user_id", "ts", _bad())
    return x.withColumns({"mean_seconds": F.round("mean_seconds", 3), "repeat_share": F.round("repeat_share", 6), "error_rate": F.round("error_rate", 6)})


RULES = {"how": ["en", "die"], "what": ["on", "la"], "why": ["ti", "de"]}


@query("agg_22_question_types", "WITH t AS (SELECT lower(text) AS q FROM documents) SELECT CASE WHEN contains(q, 'en') OR contains(q, 'die') THEN 'how' WHEN contains(q, 'on') OR contains(q, 'la') THEN 'what' WHEN contains(q, 'ti') OR contains(q, 'de') THEN 'why' ELSE 'other' END AS kind, count(*) AS n FROM t GROUP BY 1")
def agg_22(s, d):
    q = table(s, d, "documents").select(F.lower("text").alias("q"))
    return q.groupBy(A.classify(F.col("q"), RULES, "other").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_22_question_patterns", "WITH t AS (SELECT lower(text) AS q FROM documents), p AS (SELECT 'how' AS kind FROM t WHERE contains(q, 'en') OR contains(q, 'die') UNION ALL SELECT 'what' FROM t WHERE contains(q, 'on') OR contains(q, 'la') UNION ALL SELECT 'why' FROM t WHERE contains(q, 'ti') OR contains(q, 'de')) SELECT kind, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, kind LIMIT 15")
def agg_22b(s, d):
    q = table(s, d, "documents").select(F.lower("text").alias("q"))
    x = q.select(F.explode(A.multi_label(F.col("q"), RULES)).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return x.orderBy(F.desc("n"), "kind").limit(15)


@query("agg_23_ratings", "SELECT count(*) AS n, round(avg(r), 6) AS mean, count(*) FILTER (r = 1) AS r1, count(*) FILTER (r = 2) AS r2, count(*) FILTER (r = 3) AS r3, count(*) FILTER (r = 4) AS r4, count(*) FILTER (r = 5) AS r5 FROM (SELECT 1 + event_id % 5 AS r FROM events)")
def agg_23(s, d):
    return A.rating_stats(events(s, d).withColumn("r", 1 + F.col("event_id") % 5), "r").withColumn("mean", F.round("mean", 6))


@query("agg_23_low_ratings", "SELECT event_id, user_id FROM events WHERE 1 + event_id % 5 <= 2 ORDER BY ts DESC, event_id DESC LIMIT 50")
def agg_23b(s, d):
    return events(s, d).filter(1 + F.col("event_id") % 5 <= 2).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id")


@query("agg_24_recent_performance", "SELECT round(avg(value), 6) AS mean, round(100.0 * count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100)")
def agg_24(s, d):
    x = events(s, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    return x.agg(F.round(mean0("value"), 6).alias("mean"), F.round(share(_bad()), 6).alias("error_rate"))


@query("agg_25_label_stats", "SELECT quality, toxic, count(*) AS n, grouping(quality, toxic)::BIGINT AS level FROM labels GROUP BY GROUPING SETS ((), (quality), (toxic))")
def agg_25(s, d):
    x = table(s, d, "labels")
    return x.groupingSets([[], [x.quality], [x.toxic]], x.quality, x.toxic).agg(F.count(F.lit(1)).alias("n"), F.grouping_id("quality", "toxic").cast("bigint").alias("level"))


@query("agg_27_kpis", f"SELECT count(*) FILTER (ts::DATE = DATE '2024-01-20') AS today, count(*) FILTER (ts::DATE = DATE '2024-01-19') AS yesterday, count(*) FILTER (ts::DATE >= DATE '2024-01-14') AS week, count(*) FILTER (ts::DATE >= DATE '2024-01-01') AS month, count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN ts > TIMESTAMP '2024-01-20 11:00:00' THEN user_id END) AS users_hour FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:00:00'")
def agg_27(s, d):
    return A.kpis(events(s, d), "ts", "user_id", "2024-01-20 12:00:00")


@query("agg_28_two_hour_buckets", "WITH b AS (SELECT i FROM range(12) t(i)), e AS (SELECT hour(ts) // 2 AS i, value, event_type FROM events WHERE ts::DATE = DATE '2024-01-20') SELECT CAST(b.i AS BIGINT) AS bucket, count(e.value) AS n, round(coalesce(avg(e.value), 0), 6) AS mean, round(coalesce(100.0 * count(*) FILTER (event_type = 'error') / nullif(count(e.value), 0), 0), 6) AS error_rate FROM b LEFT JOIN e ON e.i = b.i GROUP BY 1")
def agg_28(s, d):
    e = events(s, d).filter(F.to_date("ts") == "2024-01-20").select(F.floor(F.hour("ts") / 2).cast("bigint").alias("bucket"), "value", "event_type")
    x = s.range(12).select(F.col("id").alias("bucket")).join(e, "bucket", "left").groupBy("bucket")
    n = F.count("value")
    return x.agg(n.alias("n"), F.round(mean0("value"), 6).alias("mean"), F.round(F.coalesce(F.try_divide(100.0 * F.count_if(_bad()), n), F.lit(0.0)), 6).alias("error_rate"))


@query("agg_29_class_performance", "SELECT CASE WHEN event_type IN ('click', 'view') THEN 'browse' WHEN event_type = 'purchase' THEN 'buy' WHEN event_type = 'error' THEN 'fail' ELSE 'other' END AS class, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def agg_29(s, d):
    k = F.when(F.col("event_type").isin("click", "view"), "browse").when(F.col("event_type") == "purchase", "buy").when(_bad(), "fail").otherwise("other")
    return events(s, d).groupBy(k.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("agg_30_user_performance", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def agg_30(s, d):
    return events(s, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")).orderBy(F.desc("n"), "user_id").limit(10)


@query("agg_31_completed_recently", f"WITH {TICKETS}, m AS (SELECT max(completed)::DATE AS today FROM tickets) SELECT count(*) FILTER (completed::DATE = today) AS today, count(*) FILTER (completed::DATE > today - 7) AS week, count(*) FILTER (date_trunc('month', completed) = date_trunc('month', today)) AS month FROM tickets, m")
def agg_31(s, d):
    t = tickets(s, d)
    x = t.crossJoin(F.broadcast(t.agg(F.to_date(F.max("completed")).alias("now"))))  # one row
    c = F.to_date("completed")
    return x.agg(F.count_if(c == F.col("now")).alias("today"), F.count_if(c > F.date_sub("now", 7)).alias("week"), F.count_if(F.trunc(c, "month") == F.trunc("now", "month")).alias("month"))


@query("agg_32_content_lengths", "SELECT source, count(*) AS n, sum(length(text))::BIGINT AS total, round(avg(length(text)), 6) AS mean, max(length(text)) AS longest, min(length(text)) AS shortest FROM documents GROUP BY 1")
def agg_32(s, d):
    n = F.length("text").cast("bigint")
    return table(s, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("total"), F.round(F.avg(n), 6).alias("mean"), F.max(n).alias("longest"), F.min(n).alias("shortest"))


@query("win_5_latest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def win_5(s, d):
    return A.latest(events(s, d), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("win_2_top_per_group", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 3")
def win_2(s, d):
    w = W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(s, d, "documents").withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("source", "doc_id")


@query("win_4_rank_dependent_cut", "SELECT source, doc_id, substr(text, 1, CASE rn WHEN 1 THEN 1400 WHEN 2 THEN 1260 WHEN 3 THEN 1120 ELSE 800 END) AS cut FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 10")
def win_4(s, d):
    w = W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    n = F.when(F.col("rn") == 1, 1400).when(F.col("rn") == 2, 1260).when(F.col("rn") == 3, 1120).otherwise(800)
    return table(s, d, "documents").withColumn("rn", F.row_number().over(w)).filter("rn <= 10").select("source", "doc_id", F.substr("text", F.lit(1), n).alias("cut"))


@query("dat_1_period_keys", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m') || '-W' || CAST(ceil(day(ts) / 7) AS INT) AS week, strftime(ts, '%Y-%m') AS month, CAST(ceil(day(ts) / 7) AS INT) AS nth FROM events")
def dat_1(s, d):
    t = F.col("ts")
    return events(s, d).select("event_id", *[period_key(t, p).alias(p) for p in ("day", "week", "month")], week_of_month(t).alias("nth"))


@query("dat_2_period_starts", "SELECT event_id, ts::DATE AS day, CAST(ts::DATE - CAST(dayofweek(ts) AS INT) AS DATE) AS week, CAST(date_trunc('month', ts) AS DATE) AS month FROM events")
def dat_2(s, d):
    return events(s, d).select("event_id", *[period_start(F.col("ts"), p).alias(p) for p in ("day", "week", "month")])


@query("msc_1_error_logs", "SELECT event_id FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) WHERE event_type = 'error'")
def msc_1(s, d):
    return events(s, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(100).filter(_bad()).select("event_id")


@query("msc_2_feedback_list", "SELECT event_id, value FROM events WHERE user_id = 3 ORDER BY ts DESC, event_id DESC LIMIT 100")
def msc_2(s, d):
    return events(s, d).filter("user_id = 3").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "value")


@query("msc_3_rating_history", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 20")
def msc_3(s, d):
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events(s, d).withColumn("rn", F.row_number().over(w)).filter("rn <= 20").select("user_id", "event_id")


@query("msc_4_conversation", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS thread FROM conversations GROUP BY 1")
def msc_4(s, d):
    line = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.concat(t["role"], F.lit(": "), t["text"]))
    return table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(line, "\n").alias("thread"))


@query("msc_5_point_lookup", "SELECT o.o_orderkey, o_orderstatus, count(l_linenumber) AS n_lines FROM orders o LEFT JOIN lineitem ON l_orderkey = o.o_orderkey WHERE o.o_orderkey = 7 GROUP BY ALL")
def msc_5(s, d):
    o = table(s, d, "orders").filter("o_orderkey = 7")
    return o.join(table(s, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey", "o_orderstatus").agg(F.count("l_linenumber").alias("n_lines"))


@query("msc_6_fallback_answer", "SELECT source, 'See also: ' || string_agg(t, ', ' ORDER BY rn) AS answer FROM (SELECT source, split_part(text, chr(10), 1) AS t, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 3 GROUP BY 1")
def msc_6(s, d):
    w = W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    x = table(s, d, "documents").select("source", F.split_part("text", F.lit("\n"), F.lit(1)).alias("t"), F.row_number().over(w).alias("rn")).filter("rn <= 3")
    titles = F.transform(F.array_sort(F.collect_list(F.struct("rn", "t"))), lambda r: r["t"])
    return x.groupBy("source").agg(F.concat(F.lit("See also: "), F.array_join(titles, ", ")).alias("answer"))


@query("msc_7_page_slice", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def msc_7(s, d):
    return table(s, d, "orders").filter("o_orderstatus = 'O'").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey")
