from datetime import datetime

from pyspark.sql import functions as F

from volmesh.functions import clock
from volmesh.plans import forwards
from volmesh.plans import studies as plan
from volmesh.sources import store
from volmesh.streaming import slots

SF = "/root/testdata/sf0.001"


def test_views_of_prints_are_hashed_not_sorted(spark, monkeypatch):
    """A task's memory is that of its contracts and windows, not of its prints."""
    plans = []

    def explained(session, stream, name):
        query = stream.writeStream.format("noop").option("checkpointLocation", store.fresh(session, name)).trigger(availableNow=True).start()
        query.awaitTermination()
        plans.append(query._jsq.explainInternal(False))
        return session.createDataFrame([], stream.schema)

    monkeypatch.setattr(slots, "run_available", explained)
    source = spark.readStream.schema(forwards.tape(spark, SF).schema).parquet(store.stored_tape(spark, SF, lambda: forwards._prints(spark, SF)))
    slots.view_prints(forwards.session(source), plan.LAG, plan.LOOKBACK, plan.WINDOW, plan.GRID)
    assert len(plans) == 2 and all("HashAggregate" in p and "SortAggregate" not in p and "Sort [" not in p for p in plans)


def test_order_is_that_of_time_and_event(spark):
    least, most = -(1 << 63), (1 << 63) - 1
    at = [datetime(1969, 12, 31, 23, 59, 59, 999999), datetime(1970, 1, 1), datetime(2024, 1, 8, 15, 0, 0, 1), datetime(2024, 1, 8, 15, 0, 0, 2), datetime(9999, 12, 31)]
    rows = [(a, e) for a in at for e in (None, least, -1, 0, 7, most)]
    df = spark.createDataFrame(rows, "at timestamp_ntz, event long").withColumn("at", F.col("at").cast("timestamp"))
    got = [(x.at, x.event) for x in df.withColumn("o", slots._order(F.col("at"), F.col("event"))).orderBy("o").collect()]
    assert got == [(x.at, x.event) for x in df.orderBy("at", F.col("event").asc_nulls_first()).collect()]
    assert df.select(slots._order(F.col("at"), F.col("event")).alias("o")).distinct().count() == len(rows)


def test_conditions_that_are_no_numbers_are_not_cast(spark):
    texts = [None, "", " ", "x7", "7x", "209", " 209 ", "-5", "+5", "0", "-", "1e2", "2147483648", "\t12\n", "12\n", "1 2", "٣", "é1", "1.5", ".5", "5.", "0x1", "\x0012"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    before = F.coalesce(F.nullif(F.col("c"), F.lit("")).try_cast("int"), F.lit(0))
    assert [x for x in df.select("c", clock.condition_code(F.col("c")), before).collect() if x[1] != x[2]] == []
    assert "CASE WHEN RLIKE" in df.select(clock.condition_code(F.col("c")))._jdf.queryExecution().optimizedPlan().toString()


def test_session_bounds(spark):
    ts = [datetime(2024, 3, d, h, m, s, us) for d in (8, 11) for h, m, s, us in ((13, 30, 0, 0), (13, 30, 0, 1), (14, 30, 0, 0), (14, 30, 0, 1), (20, 0, 0, 0), (20, 0, 0, 1), (21, 0, 0, 0), (21, 0, 0, 1), (3, 0, 0, 0), (18, 0, 0, 0))]
    df = spark.createDataFrame([(t,) for t in ts] + [(None,)], "ts timestamp_ntz").withColumn("day", clock.eastern_day(F.col("ts")))
    wide = (F.col("ts") > clock.at(F.col("day"), 570)) & (F.col("ts") <= clock.at(F.col("day"), 960))
    rows = df.select("ts", clock.within(F.col("ts"), F.col("day"), 570, 960).alias("got"), wide.alias("want")).collect()
    assert all(x.got == x.want for x in rows) and {x.want for x in rows} == {True, False, None}
