"""What only larger or odder tables show: counts instead of pairs, many rows of a recursion, words and files at their limits."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tests.test_oracle import rows
from threadloom.catalogue import ORACLE_SQL, QUERIES
from threadloom.operators import gate, joins
from threadloom.plans import upkeep_queries
from threadloom.sources.mail import table
from threadloom.sources.word_index import WordIndex


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def agree(spark, folder, name, **tables):
    """The query's rows over ``tables``, which are those of its SQL."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    want = con.execute(ORACLE_SQL[name])
    found = rows(got.columns, got.collect())
    assert found == rows([d[0] for d in want.description], want.fetchall())
    return found


def test_range_counts(spark):
    values = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, 1.0, 1.0, 2.5, 9.99, 10.0, 10.0, 30.0]
    ends = [(0.0, 10.0), (1.0, 1.0), (1.0, 1.0), (3.0, 9.0), (10.0, 0.0), (None, 5.0), (-1.0, float("inf")), (float("-inf"), float("nan")), (10.0, 30.0)]
    points, ranges = spark.createDataFrame([(v,) for v in values], "p double"), spark.createDataFrame([(k, *e) for k, e in enumerate(ends)], "k long, low double, high double")
    want = {r["k"]: r["n"] for r in points.join(ranges, F.col("p").between(F.col("low"), F.col("high"))).groupBy("k").agg(F.count("p").alias("n")).collect()}
    assert {r["k"]: r["n"] for r in joins.range_counts(points, ranges, "p", "low", "high", 5.0).collect()} == want
    assert want[7] == 12 and 3 not in want


def test_range_join_builds_no_pairs(spark, tmp_path):
    """20,000 ranges around 20,000 points are 400 million pairs."""
    part = spark.range(20_000).select(F.col("id").alias("p_partkey"), F.lit(900.0).alias("p_retailprice"))
    orders = spark.range(20_000).select((45_000 + F.col("id") % 7).cast("double").alias("o_totalprice"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    df = QUERIES["range_join"](spark, str(tmp_path))
    assert df.where("n = 20000").count() == 20_000
    assert "explode" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_recursion_of_more_than_a_million_rows(spark, tmp_path):
    spark.range(1, 80_001).select(F.col("id").alias("c_custkey"), F.lit(1.0).alias("c_acctbal")).write.parquet(f"{tmp_path}/customer.parquet")
    r = QUERIES["recursive_cte"](spark, str(tmp_path)).agg(F.count("k").alias("n"), F.max("depth").alias("deepest"), F.sum(F.col("depth") + 1 - F.col("worth")).alias("rest")).first()
    assert (r["n"], r["deepest"], r["rest"]) == (80_000, 16, 0.0)


def test_words_in_capitals_at_the_end_of_longer_ones(spark, tmp_path):
    """A word of five letters may be the end of a longer one; its passage is where that is, far into the text too."""
    texts = ["lorem " * 100 + f"AMD{k}HKU6VBLCCCCE dolor" for k in range(6)] + ["xyzabCCCCE ABCCCCE ipsum"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert ("0 1 2", 7, 0, "cccce") in [tuple(r[k] for k in (1, 0, 2, 3)) for r in agree(spark, tmp_path, "caps_vocabulary_gated", documents=docs)]


def test_citations_in_the_text_itself(spark, tmp_path):
    """Texts that hold ids of their own: words of the letters a to f, numbers, marks, repeats, and neighbours that are letters."""
    texts = ["so decadebe and 12345678, decadebe", "édecadebe decadebeé x_decadebe ½decadebe", "[ref:abc] [ref:q w] [ref:cafe]", "12345678 87654321 deadbeef", None, ""]
    talks = spark.createDataFrame([(k, 0, None if k == 5 else "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    found = agree(spark, tmp_path, "citations_checked", conversations=talks)
    assert (0, False, "decadebe", 0) in found and (1, False, "decadebe", 0) not in found and (2, True, "abc", 0) in found and not {4, 5} & {r[0] for r in found}


def test_long_texts_in_archives(spark, tmp_path):
    """A text of an archive is kept up to the same length as one alone."""
    docs = spark.createDataFrame([(k, "so " * n) for k, n in ((6, 20_000), (2, 20_000), (13, 16_666), (20, 5))], "doc_id long, text string")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("https://a.example/").alias("url"), F.lit("<p>x</p>").alias("html"))
    assert len(agree(spark, tmp_path, "files_extracted", documents=docs, pages=pages)) == 4


def test_followed_files_begin_as_they_did(spark, tmp_path):
    """Each write of a followed file begins with the bytes of the one before, with any number of rows."""
    talks = spark.range(20_000).select((F.col("id") % 5_000).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("é "), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int"))).alias("text"))
    assert len(agree(spark, tmp_path, "json_lines_tailed", conversations=talks.repartition(5))) == 20_000
    assert agree(spark, tmp_path, "lines_carried", conversations=talks.repartition(5))[0][1:] == (5_000, 20_000)


def test_sketches_hold_a_groups_values_once(spark, tmp_path):
    """One exact percentile of counted values for each group, rows without a flag among them."""
    lines = spark.range(3_000).select(F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("l_returnflag"), (F.col("id") % 40).alias("l_partkey"), (F.col("id") * 7 % 900 / 4).alias("l_extendedprice"))
    assert len(agree(spark, tmp_path, "sketches", lineitem=lines)) == 3
    assert QUERIES["sketches"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count(" percentile(") == 1


def test_aliases_are_counted_in_one_pass(spark, tmp_path):
    """A run reads its messages once: abbreviations, terms and both come out of one table of counts."""
    texts = [f"NASA ABC the lorem{k % 3} ipsum of{' nasa lorem' * (k % 4)} AB CD x dolor" for k in range(24)] + ["", "of", "lorem ipsum dolor", "THE a the b", None, "lorem  ipsum-dolor\nlorem ipsum"] * 6
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name, runs in (("aliases_discovered", 1), ("aliases_from_runs", 3)):
        assert len(agree(spark, tmp_path, name, documents=docs)) > 8
        assert QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("Relation [doc_id") == runs


def test_index_deals_postings_not_words(spark, tmp_path):
    """Each document's terms and length come out of one reading of it; empty and null texts have a length too."""
    docs = spark.createDataFrame([(1, "b a b c a b"), (2, None), (3, ""), (4, "c")], "id long, t string")
    index = WordIndex(spark, str(tmp_path / "i"), ["t"], buckets=4)
    index.add(docs, "id")
    assert {(r["id"], r["dl"]) for r in index._lengths(0).collect()} == {(1, 6), (2, 0), (3, 0), (4, 1)}
    assert {(r["id"], r["term"], r["tf"], r["dl"], *r["positions"]) for r in index.postings(["a", "b", "c"]).collect()} == {(1, "a", 2, 6, 1, 4), (1, "b", 3, 6, 0, 2, 5), (1, "c", 1, 6, 3), (4, "c", 1, 1, 0)}


def test_subjects_move_no_bodies(spark):
    """A message's subject is made before the joins of its view."""
    plan = table(spark, "/root/testdata/sf0.001", "messages").select("id", "subject")._jdf.queryExecution().optimizedPlan().toString()
    assert "split" not in plan.split("Join")[0] and "split" in plan


def test_batches_of_more_files(spark, tmp_path, monkeypatch):
    """Batches stay seven whatever the table's size; their files grow in number."""
    monkeypatch.setattr(upkeep_queries, "MESSAGES_PER_FILE", 10)
    homes = []
    monkeypatch.setattr(upkeep_queries, "new_folder", lambda s, n: homes.append(str(tmp_path / n)) or homes[-1])
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.concat(F.lit("lorem w"), F.col("id") % 7).alias("text"))
    assert len(agree(spark, tmp_path, "counts_in_runs", documents=docs)) == 8
    assert len(list((tmp_path / "runs" / "in").glob("*.parquet"))) > 7 and len(list((tmp_path / "runs" / "checkpoint" / "offsets").glob("[0-9]*"))) <= 7


def joined(df):
    """Columns that come out of any join of the plan, those of scalar subqueries too."""
    found = set()
    gate._walk(df._jdf.queryExecution().optimizedPlan(), lambda p: found.update(a.name() for a in gate._seq(p.output())) if gate._name(p) == "Join" else None, lambda e: None)
    return found


def test_guests_move_no_bodies(spark, tmp_path):
    """Messages are joined once for all tenants; what a tenant's query joins are ids, dates and sizes."""
    docs = spark.range(120).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("a Ba"), F.col("id"), F.lit(". "), F.repeat(F.lit("lorem "), (F.col("id") * 7 % 50).cast("int")))).alias("text"), F.lit("s").alias("source"))
    events = spark.range(10, 130).select(F.col("id").alias("event_id"), F.expr("timestamp_seconds(id DIV 4 % 2 * id * 60)").alias("ts"), F.when(F.col("id") % 13 > 0, F.floor(F.col("id") / 2) % 4).alias("user_id"), F.lit("view").alias("event_type"))
    pages = spark.range(35).select(F.col("id").alias("page_id"), F.lit("https://a.example/").alias("url"), F.when(F.col("id") % 5 > 0, F.repeat(F.lit("é"), F.col("id").cast("int"))).alias("html"))
    labels = spark.range(0, 120, 2).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    found = agree(spark, tmp_path, "guest_sql", documents=docs, events=events, pages=pages, labels=labels)
    assert {r[-1] for r in found} == {"u0", "u1", "u2"}
    columns = joined(QUERIES["guest_sql"](spark, str(tmp_path)))
    assert {"id", "thread_id", "size_bytes"} <= columns and not columns & {"text", "html", "body_text", "extracted_text"}


def test_sizes_move_no_pages(spark):
    """An attachment's size is made before the joins of its view."""
    assert "html" not in joined(table(spark, "/root/testdata/sf0.001", "attachments").select("id", "size_bytes"))


def test_tables_by_owner(spark, tmp_path):
    """Every row of every owner comes back as it was, also of those without one and with an empty name, and a tenant sees its own."""
    df = spark.createDataFrame([(k, u, "x" * k, [u or "-"]) for k, u in enumerate(["b", None, "", "a", "1", "01", "b"])], "id long, user_id string, t string, l array<string>")
    back = gate.by_owner(df.repartition(3), str(tmp_path / "m"))
    assert back.dtypes == df.dtypes and sorted(back.collect(), key=lambda r: r["id"]) == sorted(df.collect(), key=lambda r: r["id"])
    assert [[r[0] for r in gate.answer(spark, "SELECT id FROM m ORDER BY id", {"m": back}, user=u).rows] for u in ("b", "", "1", "c")] == [[0, 6], [2], [4], []]
