"""Relational, temporal and note-keeping queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orewright.operators import relational as R
from orewright.session import table


def _t(name):
    return lambda s, d: table(s, d, name)


lineitem, orders, customer, supplier, nation, region, part, events = (_t(n) for n in "lineitem orders customer supplier nation region part events".split())


def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def _r(df, *cols, n=2):
    for c in cols:
        df = df.withColumn(c, F.round(c, n))
    return df


def pricing_summary(s, d):
    li = lineitem(s, d).where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    out = li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"), F.sum(revenue()).alias("revenue"), F.avg("l_discount").alias("disc"), F.count("*").alias("n"))
    return _r(out, "qty", "price", "revenue", n=1).withColumn("disc", F.round("disc", 6))


def nation_revenue(s, d):
    j = lineitem(s, d).select("l_orderkey", "l_suppkey", revenue().alias("rev")).join(orders(s, d).select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    j = j.join(customer(s, d).select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(supplier(s, d).select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    j = j.where("c_nationkey = s_nationkey").join(nation(s, d).select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey"), "s_nationkey").join(region(s, d).select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    return _r(j.groupBy("r_name", "n_name").agg(F.sum("rev").alias("revenue"), F.count("*").alias("n")), "revenue", n=1)


def rank_orders(s, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return orders(s, d).select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr")).where("rn <= 3")


def order_gaps(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = orders(s, d)
    return o.select("o_orderkey", F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).alias("since_last"), F.datediff(F.lead("o_orderdate").over(w), "o_orderdate").alias("to_next"))


def moving_value(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 3)
    return _r(events(s, d).select("event_id", F.avg("value").over(w).alias("mean7"), F.count("*").over(w).alias("n")), "mean7", n=5)


def _as_of(s, d):
    e = events(s, d).select("event_id", "user_id", "ts")
    r = events(s, d).where("value > 50").select("user_id", F.col("ts").alias("seen"), "value", F.col("event_id").alias("ref"))
    return R.as_of(e, r, "user_id", "ts", "seen", ["value", "ref"])


def _range(s, d):
    bands = part(s, d).where("p_size <= 5").select("p_partkey", (F.col("p_retailprice") - 1).alias("lo"), (F.col("p_retailprice") + 1).alias("hi"))
    return R.range_join(part(s, d).select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("x")), bands, F.col("x"), F.col("lo"), F.col("hi"), 8.0).groupBy("p_partkey").agg(F.count("*").alias("near"))


def _notes(s, d):
    return table(s, d, "poler_notes").distinct()


def _epoch(c):
    """Seconds of an epoch that may come in milliseconds."""
    return F.when(F.col(c) > 100_000_000_000, F.floor(F.col(c) / 1000)).otherwise(F.col(c))


def _boxes_that_meet(s, d):
    """Files of like size that lived at the same time, as boxes of days and bytes."""
    day = lambda c: F.unix_micros(c.cast("timestamp")) / 86_400_000_000.0
    f = table(s, d, "source_files")
    end = F.coalesce("deleted_at", F.col("indexed_at") + F.expr("INTERVAL 30 DAY"))
    b = f.select(F.col("path").alias("id"), day(F.col("indexed_at")).alias("x0"), F.col("bytes").cast("double").alias("y0"), day(end).alias("x1"), (F.col("bytes") * F.lit(1.2)).alias("y1"))
    return R.bbox_join(b, b, 60.0, 4000.0).where("l < r")


QUERIES = {
    "rel_pricing_summary": pricing_summary,
    "rel_nation_revenue": nation_revenue,
    "rel_semi": lambda s, d: customer(s, d).join(orders(s, d).where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"),
    "rel_bbox_join": lambda s, d: _boxes_that_meet(s, d),
    "rel_anti_urgent": lambda s, d: customer(s, d).join(orders(s, d).where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"),
    "rel_except_large": lambda s, d: part(s, d).select(F.col("p_partkey").alias("k")).subtract(lineitem(s, d).where("l_quantity > 48").select(F.col("l_partkey").alias("k"))),
    "rel_anti": lambda s, d: customer(s, d).join(orders(s, d), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"),
    "rel_full_outer": lambda s, d: customer(s, d).groupBy("c_nationkey").agg(F.count("*").alias("customers")).join(supplier(s, d).groupBy("s_nationkey").agg(F.count("*").alias("suppliers")), F.col("c_nationkey") == F.col("s_nationkey"), "full_outer").select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers")),
    "rel_broadcast": lambda s, d: customer(s, d).join(nation(s, d), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("bal")),
    "rel_rollup": lambda s, d: _r(orders(s, d).rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.grouping_id().alias("g")), "total", n=1),
    "rel_cube": lambda s, d: customer(s, d).cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.grouping_id().alias("g")),
    "rel_distinct": lambda s, d: lineitem(s, d).groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey", "l_linenumber").alias("pairs")),
    "rel_approx_distinct": lambda s, d: lineitem(s, d).groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts")),
    "rel_quantiles": lambda s, d: lineitem(s, d).groupBy("l_returnflag").agg(F.round(F.percentile("l_extendedprice", F.lit(0.5)), 4).alias("p50"), F.round(F.percentile("l_extendedprice", F.lit(0.9)), 4).alias("p90")),
    "rel_rank": rank_orders,
    "rel_lag_lead": order_gaps,
    "rel_frame": moving_value,
    "rel_ntile": lambda s, d: part(s, d).select("p_partkey", F.ntile(10).over(Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")).alias("decile")),
    "rel_union": lambda s, d: customer(s, d).select(F.col("c_nationkey").alias("k")).unionByName(supplier(s, d).select(F.col("s_nationkey").alias("k"))).groupBy("k").agg(F.count("*").alias("n")),
    "rel_intersect": lambda s, d: customer(s, d).select(F.col("c_nationkey").alias("k")).intersect(supplier(s, d).select(F.col("s_nationkey").alias("k"))),
    "rel_except": lambda s, d: part(s, d).select(F.col("p_partkey").alias("k")).subtract(lineitem(s, d).select(F.col("l_partkey").alias("k"))),
    "rel_pivot": lambda s, d: orders(s, d).groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]).agg(F.count(F.lit(1))).select("o_orderstatus", *[F.coalesce(F.col(f"`{p}`"), F.lit(0)).alias(f"p{p[0]}") for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]),
    "rel_json": lambda s, d: events(s, d).select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")),
    "rel_json_stats": lambda s, d: events(s, d).select("event_type", F.from_json("props", "k bigint").alias("j")).groupBy("event_type").agg(F.sum("j.k").alias("total"), F.count("j.k").alias("n")),
    "rel_dates": lambda s, d: orders(s, d).groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.dayofweek("o_orderdate").alias("dow")).agg(F.count("*").alias("n")),
    "rel_as_of": _as_of,
    "rel_range_join": _range,
    "rel_salted_join": lambda s, d: _r(R.salted_join(table(s, d, "lineitem").select("l_suppkey", "l_quantity"), supplier(s, d).select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey", 8).groupBy("s_nationkey").agg(F.sum("l_quantity").alias("qty")), "qty"),
    "rel_salted_sum": lambda s, d: _r(R.salted_sum(lineitem(s, d), "l_returnflag", F.col("l_quantity")), "total"),
    "rel_exists": lambda s, d: (lineitem(s, d).createOrReplaceTempView("ore_lineitem"), orders(s, d).createOrReplaceTempView("ore_orders"), s.sql("SELECT o_orderpriority, count(*) AS n FROM ore_orders o WHERE EXISTS (SELECT 1 FROM ore_lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45) GROUP BY o_orderpriority"))[-1],
    "rel_scalar_subquery": lambda s, d: (part(s, d).createOrReplaceTempView("ore_part"), s.sql("WITH b AS (SELECT p_brand, avg(p_retailprice) AS m FROM ore_part GROUP BY p_brand) SELECT p_brand, round(m, 4) AS mean FROM b WHERE m > (SELECT avg(p_retailprice) FROM ore_part)"))[-1],
    "time_tumbling": lambda s, d: _r(R.windows(events(s, d), "ts", "1 hour", None, F.count("*").alias("n"), F.sum("value").alias("total"), by=["event_type"]), "total", n=3),
    "time_sliding": lambda s, d: R.windows(events(s, d), "ts", "2 hours", "1 hour", F.count("*").alias("n")),
    "time_sessions": lambda s, d: R.sessions(events(s, d), "user_id", "ts", "30 minutes"),
    "time_first_last": lambda s, d: events(s, d).groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event")),
    "notes_latest": lambda s, d: R.latest(_notes(s, d).where("notebook_id is not null"), "notebook_id", F.desc(_epoch("updated_at")), F.desc("id")).select("notebook_id", "id"),
    "notes_newest": lambda s, d: _notes(s, d).select("id", _epoch("created_at").alias("created")).orderBy(F.desc("created"), F.desc("id")).limit(20),
    "notes_kinds": lambda s, d: _notes(s, d).select(F.when(F.col("source").isNull(), "unknown").when(F.rlike("source", F.lit("^https?://")), "web").when(F.rlike("source", F.lit(r"\.(md|pdf|txt)$")), "file").otherwise(F.lower(F.trim("source"))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n")),
    "corpus_json": lambda s, d: table(s, d, "documents").select("doc_id", F.to_json(F.struct("doc_id", F.length("text").alias("chars"))).alias("j")),
}

SQL = {
    "rel_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 1) AS qty, round(sum(l_extendedprice), 1) AS price, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue, round(avg(l_discount), 6) AS disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "rel_nation_revenue": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "rel_semi": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "rel_bbox_join": """WITH b AS (SELECT path AS id, epoch(indexed_at) / 86400 AS x0, epoch(coalesce(deleted_at, indexed_at + INTERVAL 30 DAY)) / 86400 AS x1, bytes::DOUBLE AS y0, bytes * 1.2 AS y1 FROM source_files)
SELECT p.id AS l, q.id AS r FROM b p JOIN b q ON p.x0 <= q.x1 AND q.x0 <= p.x1 AND p.y0 <= q.y1 AND q.y0 <= p.y1 WHERE p.id < q.id AND p.x0 <= p.x1 AND q.x0 <= q.x1""",
    "rel_anti_urgent": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "rel_except_large": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48",
    "rel_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "rel_full_outer": "SELECT coalesce(c_nationkey, s_nationkey) AS nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY ALL) FULL JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY ALL) ON c_nationkey = s_nationkey",
    "rel_broadcast": "SELECT n_name, count(*) AS n, round(avg(c_acctbal), 4) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
    "rel_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 1) AS total, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "rel_cube": "SELECT c_mktsegment, c_nationkey, count(*) AS n, grouping_id(c_mktsegment, c_nationkey)::BIGINT AS g FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)",
    "rel_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT (l_suppkey, l_linenumber)) AS pairs FROM lineitem GROUP BY ALL",
    "rel_quantiles": "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY ALL",
    "rel_rank": "SELECT o_custkey, o_orderkey, row_number() OVER w::INT AS rn, rank() OVER w::INT AS rk, dense_rank() OVER w::INT AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) QUALIFY rn <= 3",
    "rel_lag_lead": "SELECT o_orderkey, date_diff('day', lag(o_orderdate) OVER w, o_orderdate)::INT AS since_last, date_diff('day', o_orderdate, lead(o_orderdate) OVER w)::INT AS to_next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "rel_frame": "SELECT event_id, round(avg(value) OVER w, 5) AS mean7, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)",
    "rel_ntile": "SELECT p_partkey, ntile(10) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)::INT AS decile FROM part",
    "rel_union": "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k",
    "rel_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "rel_except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem",
    "rel_pivot": "SELECT o_orderstatus, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS p{p[0]}" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders GROUP BY o_orderstatus",
    "rel_json": "SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events",
    "rel_json_stats": "SELECT event_type, sum((props::JSON->>'k')::BIGINT)::BIGINT AS total, count((props::JSON->>'k')::BIGINT) AS n FROM events GROUP BY event_type",
    "rel_dates": "SELECT year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, (dayofweek(o_orderdate) + 1)::INT AS dow, count(*) AS n FROM orders GROUP BY ALL",
    "rel_as_of": """WITH r AS (SELECT user_id, ts AS seen, value, event_id AS ref FROM events WHERE value > 50), j AS (SELECT e.event_id, e.user_id, e.ts, r.value, r.ref, row_number() OVER (PARTITION BY e.event_id ORDER BY r.seen DESC, r.value DESC, r.ref DESC) AS rn FROM events e LEFT JOIN r ON r.user_id = e.user_id AND r.seen <= e.ts)
SELECT event_id, user_id, ts, value, ref FROM j WHERE rn = 1""",
    "rel_range_join": "SELECT b.p_partkey, count(*) AS near FROM part b JOIN part a ON a.p_retailprice BETWEEN b.p_retailprice - 1 AND b.p_retailprice + 1 WHERE b.p_size <= 5 GROUP BY b.p_partkey",
    "rel_salted_join": "SELECT s_nationkey, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey",
    "rel_salted_sum": "SELECT l_returnflag, round(sum(l_quantity), 2) AS total, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "rel_exists": "SELECT o_orderpriority, count(*) AS n FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45) GROUP BY o_orderpriority",
    "rel_scalar_subquery": "WITH b AS (SELECT p_brand, avg(p_retailprice) AS m FROM part GROUP BY p_brand) SELECT p_brand, round(m, 4) AS mean FROM b WHERE m > (SELECT avg(p_retailprice) FROM part)",
    "time_tumbling": "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL",
    "time_sliding": "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 hour, ts), time_bucket(INTERVAL 1 hour, ts) - INTERVAL 1 hour]) AS start FROM events) GROUP BY start",
    "time_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minutes THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 minutes AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
    "time_first_last": "SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY user_id",
    "notes_latest": "SELECT notebook_id, id FROM (SELECT DISTINCT * FROM poler_notes WHERE notebook_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY notebook_id ORDER BY CASE WHEN updated_at > 100000000000 THEN updated_at // 1000 ELSE updated_at END DESC, id DESC) = 1",
    "notes_newest": "SELECT id, CASE WHEN created_at > 100000000000 THEN created_at // 1000 ELSE created_at END AS created FROM (SELECT DISTINCT * FROM poler_notes) ORDER BY created DESC NULLS LAST, id DESC LIMIT 20",
    "notes_kinds": r"SELECT CASE WHEN source IS NULL THEN 'unknown' WHEN regexp_matches(source, '^https?://') THEN 'web' WHEN regexp_matches(source, '\.(md|pdf|txt)$') THEN 'file' ELSE lower(trim(source)) END AS kind, count(*) AS n FROM (SELECT DISTINCT * FROM poler_notes) GROUP BY kind",
    "corpus_json": """SELECT doc_id, '{"doc_id":' || doc_id || CASE WHEN text IS NULL THEN '' ELSE ',"chars":' || length(text) END || '}' AS j FROM documents""",
}
