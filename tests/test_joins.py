import pytest

from spanforge.operators import joins
from spanforge.operators.joins import lookup


@pytest.mark.parametrize("hot_rows", [100, 500_000])
def test_lookup_is_a_plain_join(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(joins, "HOT_ROWS", hot_rows)
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i}", i % 2) for i in range(3000)] + [(9000, None, 1), (9001, "none", 0)], "i int, k string, j int")
    table = spark.createDataFrame([("hot", 1, 1000)] + [(f"k{i}", i, 1) for i in range(0, 3000, 2)], "k string, v int, n long")
    for how in ("inner", "left"):
        got = lookup(rows, table, ["k"], "n", how).select("i", "k", "j", "v")
        want = rows.join(table, ["k"], how).select("i", "k", "j", "v")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert lookup(rows, table.limit(0), ["k"], "n").count() == 0 and lookup(rows.limit(0), table, ["k"], "n", "left").count() == 0


def test_cuts_are_measured_and_dropped(spark):
    from pyspark.sql import functions as F

    from spanforge.session import cut, drop_cuts, secret

    rows, seen = cut(spark.range(10), F.sum("id").alias("s"))
    assert seen == {"s": 45} and rows.count() == 10
    drop_cuts(spark)
    assert secret(spark, "a") != secret(spark, "b")
    spark.conf.set("spanforge.secret", "known")
    assert secret(spark, "a") == "a|known"
    spark.conf.unset("spanforge.secret")
