"""The open SQL surface, one query for each kind of operator, over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.sources.mail import table

#: name: (tables, Spark SQL, DuckDB SQL or None where the same text does).
STATEMENTS: dict[str, tuple[str, str, str | None]] = {
    "join_inner": ("customer orders", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment", None),
    "join_left": ("customer orders", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", None),
    "join_full": ("customer supplier", "SELECT coalesce(c_nationkey, s_nationkey) AS k, count(c_custkey) AS c, count(s_suppkey) AS s FROM (SELECT * FROM customer WHERE c_nationkey < 15) c FULL JOIN (SELECT * FROM supplier WHERE s_nationkey > 5) s ON c_nationkey = s_nationkey GROUP BY 1", None),
    "join_semi": ("customer orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", None),
    "join_anti": ("customer orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", None),
    "join_theta": ("nation region", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey", None),
    "agg_having": ("lineitem", "SELECT l_suppkey, count(*) AS n, round(avg(l_quantity), 6) AS avg_qty FROM lineitem GROUP BY l_suppkey HAVING count(*) > 50", None),
    "agg_distinct": ("lineitem", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY l_returnflag", None),
    "pricing_summary": ("lineitem", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus", None),
    "cube_agg": ("lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    "rollup_agg": ("lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", None),
    "grouping_sets": ("orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", None),
    "window_rank": ("orders", "SELECT o_orderkey, r, d FROM (SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS d FROM orders) t WHERE r <= 3", None),
    "window_lag": ("orders", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after FROM orders", None),
    "window_frame": ("orders", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving FROM orders", None),
    "window_ntile": ("part", "SELECT p_partkey, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS q FROM part", None),
    "setop_union": ("customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "setop_intersect": ("customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", None),
    "setop_except": ("orders lineitem", "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity > 10", None),
    "recursive_cte": ("customer", "WITH RECURSIVE up(k, above, depth, worth) AS (SELECT c_custkey, c_custkey, 0, c_acctbal FROM customer UNION ALL SELECT k, floor(above / 2), depth + 1, c_acctbal FROM up JOIN customer ON c_custkey = floor(above / 2) WHERE above > 1) SELECT k, max(depth) AS depth, round(sum(worth), 2) AS worth FROM up GROUP BY k", "WITH RECURSIVE up(k, above, depth, worth) AS (SELECT c_custkey, c_custkey, 0, c_acctbal FROM customer UNION ALL SELECT k, above // 2, depth + 1, c_acctbal FROM up JOIN customer ON c_custkey = above // 2 WHERE above > 1) SELECT k, max(depth) AS depth, round(sum(worth), 2) AS worth FROM up GROUP BY k"),
    "scalar_subquery": ("orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)", None),
    "pivot_counts": ("orders", "SELECT * FROM (SELECT o_orderstatus, o_orderpriority FROM orders) PIVOT (count(*) AS n FOR o_orderstatus IN ('O' AS open, 'F' AS finished))", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished FROM orders GROUP BY 1"),
    "percentile_exact": ("lineitem", "SELECT l_returnflag, percentile(l_quantity, 0.5) AS med FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS med FROM lineitem GROUP BY l_returnflag"),
    "join_right": ("nation supplier", "SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name", None),
    "setop_intersect_all": ("customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", None),
    "setop_except_all": ("customer supplier", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", None),
    "window_percent": ("part", "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice), 6) AS pr, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_retailprice), 6) AS cd FROM part", None),
    "lateral_top": ("nation region", "SELECT r_name, t.n_name FROM region, LATERAL (SELECT max(n_name) AS n_name FROM nation WHERE n_regionkey = r_regionkey) t", None),
    "in_subquery": ("customer nation", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", None),
    "unpivot_amounts": ("orders", "SELECT o_orderkey, name, amount FROM (SELECT o_orderkey, o_totalprice AS total, o_totalprice * 2 AS twice FROM orders) UNPIVOT (amount FOR name IN (total, twice))", None),
    "win_tumbling": ("events", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", None),
    "filter_agg": ("events", "SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) AS n FROM events GROUP BY user_id", None),
    "string_agg": ("nation", "SELECT n_regionkey, array_join(array_sort(collect_set(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
}


def _runner(tables: str, sql: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        for t in tables.split():
            table(spark, sf, t).createOrReplaceTempView(t)
        if "RECURSIVE" in sql:  # read when the query runs, so it stays set; a chain's length is bounded by its own condition
            spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
        return spark.sql(sql)

    return run


QUERIES = {name: _runner(tables, sql) for name, (tables, sql, _) in STATEMENTS.items()}
ORACLE_SQL = {name: duck or sql for name, (_, sql, duck) in STATEMENTS.items()}
