"""Plain relational, string, JSON and windowing coverage of the engine on the driver's tables (completeness, not parity)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.operators.tracks import table
from trackloom.plans.registry import query


def t(spark, sf_dir, *names):
    return [table(spark, sf_dir, n) for n in names]


@query("SELECT n_name, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def join_inner(spark, sf_dir):
    o, c, n = t(spark, sf_dir, "orders", "customer", "nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def join_left(spark, sf_dir):
    o, c = t(spark, sf_dir, "orders", "customer")
    n = o.groupBy("o_custkey").agg(F.count("*").alias("orders"))
    return c.join(n, c.c_custkey == n.o_custkey, "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def join_semi(spark, sf_dir):
    o, c = t(spark, sf_dir, "orders", "customer")
    return c.join(o.where("o_totalprice > 100000"), c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def join_anti(spark, sf_dir):
    o, c = t(spark, sf_dir, "orders", "customer")
    return c.join(o.where("o_totalprice > 450000"), c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


_PREV = "prev AS (SELECT p_brand AS seq, count(*) AS old_n FROM part WHERE p_size <= 20 GROUP BY 1), next AS (SELECT p_brand AS seq, count(*) AS new_n FROM part WHERE p_size >= 45 GROUP BY 1)"


@query(f"WITH {_PREV} SELECT coalesce(n.seq, p.seq) AS seq, coalesce(new_n, old_n) AS n FROM prev p FULL JOIN next n ON p.seq = n.seq")
def results_upsert(spark, sf_dir):
    """New results by sequence replace those of a previous file: a full outer join."""
    (p,) = t(spark, sf_dir, "part")
    old = p.where("p_size <= 20").groupBy(F.col("p_brand").alias("seq")).agg(F.count("*").alias("old_n"))
    new = p.where("p_size >= 45").groupBy(F.col("p_brand").alias("seq")).agg(F.count("*").alias("new_n"))
    return old.join(new, "seq", "full").select("seq", F.coalesce("new_n", "old_n").alias("n"))


@query("SELECT user_id, event_id, (SELECT arg_max(p.value, (p.ts, p.event_id)) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts) AS last_purchase FROM events e WHERE event_type = 'click'")
def join_asof(spark, sf_dir):
    """The last purchase at or before each click, by a union and one window instead of a range join."""
    (e,) = t(spark, sf_dir, "events")
    e = e.where("event_type in ('click', 'purchase')")
    upto = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id", "value"))).over(upto)
    return e.select("user_id", "event_id", "event_type", last["value"].alias("last_purchase")).where("event_type = 'click'").drop("event_type")


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def cube(spark, sf_dir):
    (o,) = t(spark, sf_dir, "orders")
    return o.cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets(spark, sf_dir):
    (li,) = t(spark, sf_dir, "lineitem")
    return li.groupingSets([[F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_returnflag")], []], "l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"))


@query("SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def join_strategies(spark, sf_dir):
    """The same join by broadcast, sort-merge and shuffled hash; the results are one."""
    s, n = t(spark, sf_dir, "supplier", "nation")
    ways = [s.join(n.hint(h), s.s_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("suppliers")) for h in ("broadcast", "merge", "shuffle_hash")]
    return ways[0].intersect(ways[1]).intersect(ways[2])


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS \"O\", count(*) FILTER (l_linestatus = 'F') AS \"F\" FROM lineitem GROUP BY l_returnflag")
def pivot(spark, sf_dir):
    (li,) = t(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).count().na.fill(0)


@query()
def approx_distinct(spark, sf_dir):
    (e,) = t(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"))


@query("SELECT p_partkey, 'k' || (p_size % 3) AS k, p_size * 2 AS twice FROM part")
def map_values(spark, sf_dir):
    (p,) = t(spark, sf_dir, "part")
    m = F.map_from_arrays(F.array(F.concat(F.lit("k"), (F.col("p_size") % 3).cast("string"))), F.array(F.col("p_size") * 2))
    return p.select("p_partkey", F.explode(m).alias("k", "twice"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def count_distinct(spark, sf_dir):
    (e,) = t(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)::BIGINT AS r, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)::BIGINT AS q, round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS pr FROM supplier")
def ranking(spark, sf_dir):
    (s,) = t(spark, sf_dir, "supplier")
    w = Window.partitionBy("s_nationkey")
    return s.select("s_suppkey", F.rank().over(w.orderBy(F.desc("s_acctbal"), "s_suppkey")).cast("bigint").alias("r"), F.ntile(4).over(w.orderBy("s_acctbal", "s_suppkey")).cast("bigint").alias("q"), F.round(F.percent_rank().over(w.orderBy("s_acctbal")), 6).alias("pr"))


@query("SELECT p_partkey, round(sum(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING), 2) AS s FROM part")
def range_frame(spark, sf_dir):
    (p,) = t(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(F.sum("p_retailprice").over(Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-5, 5)), 2).alias("s"))


@query("SELECT p_brand FROM part WHERE p_size < 3 INTERSECT SELECT p_brand FROM part WHERE p_size > 48")
def set_intersect(spark, sf_dir):
    (p,) = t(spark, sf_dir, "part")
    return p.where("p_size < 3").select("p_brand").intersect(p.where("p_size > 48").select("p_brand"))


@query("SELECT p_brand, p_size FROM part WHERE p_size < 10 EXCEPT ALL SELECT p_brand, p_size FROM part WHERE p_type LIKE '%A%'")
def set_except(spark, sf_dir):
    (p,) = t(spark, sf_dir, "part")
    return p.where("p_size < 10").select("p_brand", "p_size").exceptAll(p.where("p_type like '%A%'").select("p_brand", "p_size"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, sf_dir):
    c, s = t(spark, sf_dir, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("k")).union(s.select("s_nationkey")).distinct()


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, length(props)::BIGINT AS size FROM events")
def json_field(spark, sf_dir):
    (e,) = t(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").cast("bigint").alias("size"))


@query("SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, count(*) AS n, year(max(o_orderdate))::BIGINT AS y FROM orders GROUP BY 1")
def date_buckets(spark, sf_dir):
    (o,) = t(spark, sf_dir, "orders")
    return o.groupBy(F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd").alias("month")).agg(F.count("*").alias("n"), F.year(F.max("o_orderdate")).cast("bigint").alias("y"))


@query("SELECT split_part(p_type, ' ', 1) AS head, count(*) AS n, sum((p_name LIKE 'a%')::INT)::BIGINT AS a FROM part GROUP BY 1")
def string_parts(spark, sf_dir):
    (p,) = t(spark, sf_dir, "part")
    return p.groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("head")).agg(F.count("*").alias("n"), F.sum(F.startswith("p_name", F.lit("a")).cast("int")).cast("bigint").alias("a"))


@query("SELECT user_id, epoch(time_bucket(INTERVAL 1 hour, ts))::BIGINT AS start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling_window(spark, sf_dir):
    (e,) = t(spark, sf_dir, "events")
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select("user_id", F.unix_timestamp("w.start").alias("start"), "n", "total")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 hour THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(spark, sf_dir):
    (e,) = t(spark, sf_dir, "events")
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.unix_timestamp("w.start").alias("start"), "n")


@query("SELECT event_type, list_sort(list(DISTINCT user_id % 5))::VARCHAR AS users, count(*) AS n FROM events GROUP BY event_type")
def array_values(spark, sf_dir):
    (e,) = t(spark, sf_dir, "events")
    g = e.groupBy("event_type").agg(F.array_sort(F.collect_set(F.col("user_id") % 5)).alias("users"), F.count("*").alias("n"))
    return g.select("event_type", F.concat(F.lit("["), F.array_join("users", ", "), F.lit("]")).alias("users"), "n")


@query("SELECT p_brand, max(p_size) AS most, min(p_size) AS least, arg_max(p_partkey, (p_retailprice, p_partkey)) AS dearest FROM part GROUP BY p_brand")
def sql_text(spark, sf_dir):
    """The same engine through SQL text over temporary views."""
    table(spark, sf_dir, "part").createOrReplaceTempView("_part")
    return spark.sql("SELECT p_brand, max(p_size) AS most, min(p_size) AS least, max_by(p_partkey, struct(p_retailprice, p_partkey)) AS dearest FROM _part GROUP BY p_brand")
