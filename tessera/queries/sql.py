"""What the ad-hoc console reaches: the engine's SQL over registered views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import joins
from tessera.queries.base import ORACLE_SQL, QUERIES, query, table
from tessera.sources.console import Console

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def console(name: str, sql: str, oracle: str | None = None) -> None:
    """Registers a statement that runs on the console."""

    def run(spark, sf):
        c = Console(spark)
        for t in TABLES:
            table(spark, sf, t).createOrReplaceTempView(t)
        return c.sql(sql)

    run.__name__ = name
    QUERIES[name], ORACLE_SQL[name] = run, oracle or sql


console("sql_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
console("sql_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
console("sql_grouping_sets", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
console("sql_filter_clause", "SELECT event_type, count(*) FILTER (WHERE value > 10) AS large, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
console("sql_set_operations", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
console("sql_window_functions", "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, CAST(rank() OVER w AS BIGINT) AS place, CAST(dense_rank() OVER w AS BIGINT) AS dense, first_value(o_orderkey) OVER w AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
console("sql_range_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '30' DAY PRECEDING AND CURRENT ROW) AS n FROM orders")
console("sql_correlated", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P') AND c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
console("sql_recursive", "WITH RECURSIVE t(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM t WHERE n < 20) SELECT n, total FROM t")
console(
    "sql_listagg",
    "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
)
console("sql_join_kinds", "SELECT s_suppkey, c_custkey, n_name FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey LEFT JOIN nation ON n_nationkey = coalesce(s_nationkey, c_nationkey) AND n_regionkey = 2")
console(
    "sql_quantile_idiom",
    "SELECT o_orderstatus, quantile_cont(o_totalprice, 0.5) AS middle FROM orders GROUP BY o_orderstatus",
)


@query("""SELECT p.event_id, v.event_id AS seen, p.ts::DATE AS day FROM (SELECT * FROM events WHERE event_type = 'purchase') p
          ASOF LEFT JOIN (SELECT user_id, max(event_id) AS event_id, ts FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def as_of_join(spark, sf):
    """Each purchase with the view that came last before it."""
    events = table(spark, sf, "events")
    views = events.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("seen"))
    out = joins.as_of(events.filter("event_type = 'purchase'").select("user_id", "ts", "event_id"), views, ["user_id"], "ts", ["seen"])
    return out.select("event_id", "seen", F.to_date("ts").alias("day"))


@query("""WITH s AS (SELECT event_id, user_id, ts AS a, ts + INTERVAL 2 HOUR AS b FROM events WHERE event_type = 'signup'), e AS (SELECT event_id AS other, user_id, ts AS c, ts + INTERVAL 1 HOUR AS d FROM events WHERE event_type = 'error')
          SELECT event_id, other FROM s JOIN e ON s.user_id = e.user_id AND a <= d AND c <= b""")
def interval_join(spark, sf):
    """Signups and errors of a user whose hours overlap."""
    events = table(spark, sf, "events")
    s = events.filter("event_type = 'signup'").select("event_id", "user_id", F.col("ts").alias("a"), F.expr("ts + interval 2 hours").alias("b"))
    e = events.filter("event_type = 'error'").select(F.col("event_id").alias("other"), "user_id", F.col("ts").alias("c"), F.expr("ts + interval 1 hour").alias("d"))
    return joins.overlapping(s, e, ["user_id"], "1", ("a", "b"), ("c", "d")).select("event_id", "other")
