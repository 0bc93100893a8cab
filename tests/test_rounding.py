"""Values that were rounded before, and end on a half of the next rounding, against the SQL twins' round()."""
import duckdb

from soundgrid.queries.registry import expand, rnd


def test_halves_of_a_second_rounding(spark):
    values = [k / 10**9 for k in range(-40_000_000_500, 40_000_000_000, 7_919_000)] + [-16.1275785, -8.0663235, 0.0, -1e-9, 0.0009765625, 1e12 + 0.5]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", rnd("v").alias("six"), rnd("v", 9).alias("nine"))
    con = duckdb.connect()
    con.execute("create table t (i int, v double)")
    con.executemany("insert into t values (?, ?)", [(i, v) for i, v in enumerate(values)])
    want = con.execute(expand("select i, R6(v), R9(v) from t order by i")).fetchall()
    assert [tuple(r) for r in got.orderBy("i").collect()] == want
