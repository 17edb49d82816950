import random
from datetime import date, datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from volmesh.functions import clock
from volmesh.operators import forwards, surface, views
from volmesh.plans import forwards as tape_plan
from volmesh.plans import views as plan
from volmesh.sources import adapters as a
from volmesh.sources.adapters import derived

SF = "/root/testdata/sf0.01"


def test_running_medians_across_arrow_batches(spark):
    r = random.Random(4)
    start = datetime(2024, 1, 8, 15)
    rows = [(date(2024, 1, 8 + i % 3), i % 2, start + timedelta(seconds=r.randint(0, 900)), bool(r.randint(0, 1)), i, 600 + r.gauss(0, 6), 595.0 + 5 * r.randint(0, 4)) for i in range(900)]
    df = spark.createDataFrame(rows, "day date, span int, ts timestamp_ntz, call boolean, event_id long, fwd double, strike double")
    keys, least = ["day", "span"], F.when(F.col("span") > 0, 3).otherwise(5)
    w = Window.partitionBy(*keys).orderBy("ts", "call", "event_id")
    want = df.withColumn("_rough", surface.rolling_median("fwd", w, 20, 1)).where(F.abs(F.col("strike") / F.col("_rough") - 1) <= 0.02)
    want = {x.event_id: x.m for x in want.select("event_id", surface.rolling_median("fwd", w, 20, least).alias("m")).where("m is not null").collect()}
    for size in ("1", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            plain = forwards.medians(df, keys, least)
            assert "percentile" not in plain._jdf.queryExecution().toString()
            assert {x.event_id: x.fnear for x in plain.collect()} == want and len(want) > 500
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_clock_is_the_same_in_any_session_zone(spark):
    days = [date(2024, 1, 1) + timedelta(i) for i in range(366)]
    df = spark.createDataFrame([(d, datetime(d.year, d.month, d.day, h)) for d in days for h in (3, 6, 7, 15)], "day date, ts timestamp_ntz")
    see = lambda: df.select("ts", clock.eastern(F.col("ts")).cast("string"), clock.at(F.col("day"), 150).cast("string"), clock.at(F.col("day"), F.hour("ts") * 60).cast("string")).collect()
    plain = see()
    assert "convert_timezone" not in df.select(clock.eastern(F.col("ts")))._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert see() == plain
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_decisions_and_log_without_fills(spark):
    tape = tape_plan.tape(spark, SF).where("day between date'2024-01-08' and date'2024-01-10'")
    ex = derived(spark, SF, a.EX_DAYS)
    built = lambda fills: views.build(tape, tape_plan.session(tape), plan.CONTRACT, plan.GRID, tape_plan.RATE, tape_plan.WITHIN, ex, plan.LAG, plan.WINDOW, plan.LOOKBACK, plan.NEED, plan.FEW, plan.LOW_DTE, plan.HIGH_DTE, plan.REACH, plan.AFTER, fills)
    (one, log), (whole, whole_log) = built(False), built(True)
    see = lambda c: sorted(str(x) for x in c.where("view = 'decide'").select("day", "slot", "expiry", "strike", "call", F.round("iv", 9), F.round("mid", 9)).collect())
    assert see(one) == see(whole) and one.where("view = 'fill'").isEmpty() and not whole.where("view = 'fill'").isEmpty()
    assert sorted(log.collect()) == sorted(whole_log.collect())
