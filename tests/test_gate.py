"""What a guest's SQL may do, and what it may not."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from threadloom.operators import gate


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


@pytest.fixture(scope="module")
def mail(spark):
    own = spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("user_id"), F.concat(F.lit("s"), "id").alias("subject"), F.expr("cast('xy' AS binary)").alias("raw"), F.col("id").alias("set"))
    return {"m": own}


REFUSED = [
    (None, "no query"), ("  ", "no query"), ("SELECT " + "1, " * 3000 + "1", "characters"), ("DELETE FROM m", "only queries"), ("DROP TABLE m", "only queries"), ("INSERT INTO m SELECT * FROM m", "only queries"), ("SET a = 1", "only queries"),
    ("SHOW TABLES", "only queries"), ("EXPLAIN SELECT 1", "only queries"), ("SELECT 1; SELECT 2", "PARSE"), ("SELECT * FROM text.`/etc/passwd`", "no table"), ("SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`", "no table"),
    ("SELECT (SELECT max(value) FROM text.`/etc/passwd`)", "no table"), ("SELECT 1 WHERE EXISTS (SELECT 1 FROM csv.`/etc/passwd`)", "no table"), ("WITH t AS (SELECT * FROM json.`/etc/passwd`) SELECT * FROM t", "no table"),
    ("SELECT * FROM hidden", "TABLE_OR_VIEW_NOT_FOUND"), ("SELECT * FROM global_temp.hidden_global", "no table"), ("WITH hidden AS (SELECT * FROM hidden) SELECT * FROM hidden", "TABLE_OR_VIEW_NOT_FOUND"), ("SELECT * FROM stored", "no table of yours"),
    ("SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "not offered"), ("SELECT java_method('java.lang.System', 'exit', 1)", "not offered"), ("SELECT try_reflect('java.lang.System', 'getenv', 'HOME')", "not offered"),
    ("SELECT input_file_name() FROM m", "not offered"), ("SELECT mine(id) FROM m", "not offered"), ("SELECT count(*) FROM range(1000000)", "not offered"), ("SELECT TRANSFORM(id) USING 'cat' FROM m", "only queries"), ("SELECT * FROM IDENTIFIER('m')", "only queries"),
    ("SELECT id FROM m WHERE subject LIKE '%x%'", "searched by its words"), ("SELECT id FROM (SELECT * FROM m WHERE m.subject NOT LIKE 'x%')", "searched by its words"), ("SELECT broken FROM m", "UNRESOLVED_COLUMN"), ("SELECT * FROM m LIMIT -1", "LIMIT"),
]


def test_refused(spark, mail, tmp_path):
    spark.range(3).createOrReplaceTempView("hidden")
    spark.range(3).createOrReplaceGlobalTempView("hidden_global")
    spark.udf.register("mine", lambda x: x)
    spark.sql(f"CREATE TABLE IF NOT EXISTS stored USING parquet LOCATION '{tmp_path}/stored' AS SELECT 1 AS x")
    try:
        for sql, why in REFUSED:
            got = gate.answer(spark, sql, mail, user="a")
            assert got.error and why in got.error and got.rows == [], (sql, got)
    finally:
        spark.sql("DROP TABLE stored")


def test_answered(spark, mail):
    ask = lambda sql, **more: gate.answer(spark, sql, mail, user="a", **more)
    assert ask("SELECT count(*) AS n FROM m").rows == [(1000,)] and ask("SELECT count(DISTINCT user_id) FROM m;").rows == [(1,)]
    assert ask("SELECT replace('DROP TABLE x', 'x', 'y') AS set -- delete\n").rows == [("DROP TABLE y",)]
    assert ask("SELECT max(`set`), max(set) FROM m").rows == [(1998, 1998)]
    assert ask("WITH t AS (SELECT id FROM m WHERE subject = 's4'), u AS (SELECT * FROM t) SELECT u.id, (SELECT count(*) FROM m) FROM u JOIN m USING (id) WHERE id IN (SELECT id FROM t)").rows == [(4, 1000)]
    assert ask("SELECT user_id, count(*), sum(count(*)) OVER () FROM m GROUP BY user_id").rows == [("a", 1000, 1000)]
    assert ask("SELECT x FROM m LATERAL VIEW explode(array(1, 2)) t AS x WHERE id = 2 UNION ALL SELECT 3 ORDER BY x").rows == [(1,), (2,), (3,)]
    assert ask("SELECT raw FROM m LIMIT 1").rows == [("<blob 2 bytes>",)]
    many = ask("SELECT * FROM m")
    assert len(many.rows) == 500 and many.truncated and not ask("SELECT * FROM m LIMIT 500").truncated
    long = ask("SELECT repeat('x', 9000) AS x").rows[0][0]
    assert long.startswith("x" * (gate.CELL - 32) + "… [truncated: original 9000") and len(long) < 8010
    assert gate.answers(spark, ["SELECT 1"] * 101, {})[0].error == "at most 100 queries"
    assert [a.error is None for a in gate.answers(spark, ["SELECT 1 AS x", "SELEC", "SELECT 2 AS x"], {})] == [True, False, True]


def test_tenants_and_owners(spark, mail):
    assert "no owner" in gate.answer(spark, "SELECT 1", {"p": spark.range(2)}, user="a").error
    assert gate.answer(spark, "SELECT count(*) FROM p", {"p": spark.range(2)}, user="a", shared=frozenset({"p"})).rows == [(2,)]
    assert gate.documented(mail, {"m": {"id", "gone"}}) == ["m.gone", "m.raw", "m.set", "m.subject", "m.user_id"]
    gate.answer(spark, "SELECT 1", mail, user="a")
    assert "m" not in {t.name for t in spark.catalog.listTables()}


def test_costs_and_time(spark, mail):
    assert "estimated" in gate.answer(spark, "SELECT * FROM m", mail, user="a", most_bytes=1).error
    assert "estimated" in gate.answer(spark, "SELECT count(*) FROM m a JOIN m b ON a.id < b.id", mail, most_bytes=1 << 27).error
    assert gate.answer(spark, "SELECT count(*) FROM m a JOIN m b ON a.id = b.id", mail, most_bytes=1 << 27).rows == [(2000,)]
    began = time.time()
    slow = {"m": mail["m"].repartition(4).select("id", "user_id")}
    got = gate.answer(spark, "SELECT sum(hash(a.id, b.id, c.id)) FROM m a, m b, m c", slow, user="a", seconds=2, most_bytes=1 << 100)
    assert got.error == "stopped after 2 seconds" and time.time() - began < 30
