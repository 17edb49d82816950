"""Small cases of the library's operators: nulls, ties, repeated and empty rows, order of arrival, pruning."""

import datetime as dt
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from volmesh.functions import clock, pricing
from volmesh.operators import catalogue, chains, filters, forwards, life, matching, scorecards
from volmesh.operators.quantiles import quantiles
from volmesh.sources import store
from volmesh.streaming import slots

T = lambda s: dt.datetime.fromisoformat(f"2024-01-10 {s}")


def test_quantiles(spark):
    r = np.random.default_rng(3)
    rows = [("a", float(x)) for x in r.integers(0, 40, 3000)] + [("b", float(x)) for x in r.normal(size=501)] + [("c", 7.0)] * 50 + [("d", None), ("e", None), ("e", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {x.k: x[1:] for x in quantiles(df, ["k"], "v", [0.0, 0.05, 0.5, 0.9, 1.0]).collect()}
    for k in "abce":
        assert got[k] == pytest.approx(np.quantile([v for q, v in rows if q == k and v is not None], [0, 0.05, 0.5, 0.9, 1]))
    assert "d" not in got and quantiles(df.limit(0), ["k"], "v", [0.5]).count() == 0


def test_clock(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 10, 3, 0), dt.date(2024, 1, 12)), (dt.datetime(2024, 7, 10, 3, 0), dt.date(2024, 7, 12)), (None, None)], "ts timestamp_ntz, expiry date")
    got = rows.select(clock.eastern(F.col("ts")), clock.eastern_day(F.col("ts")), clock.at(F.col("expiry"), 600), clock.years(F.col("ts"), F.col("expiry")) * 365).collect()
    assert [tuple(x)[:3] for x in got] == [(dt.datetime(2024, 1, 9, 22), dt.date(2024, 1, 9), dt.datetime(2024, 1, 12, 15)), (dt.datetime(2024, 7, 9, 23), dt.date(2024, 7, 9), dt.datetime(2024, 7, 12, 14)), (None, None, None)]
    assert [x[3] for x in got] == [pytest.approx(2.75), pytest.approx(2 + 17 / 24), None]
    codes = spark.createDataFrame([("209",), ("",), (None,), ("x7",)], "c string").select(clock.condition_code(F.col("c"))).collect()
    assert [x[0] for x in codes] == [209, 0, 0, 0]


def test_implied_guards(spark):
    rows = [(5.0, 600.0, 600.0, 0.1, True), (None, 600.0, 600.0, 0.1, True), (0.0, 600.0, 600.0, 0.1, True), (5.0, 600.0, 600.0, 0.0, True), (700.0, 600.0, 600.0, 0.1, False), (5.0, 600.0, 600.0, 0.1, None)]
    df = spark.createDataFrame(rows, "p double, f double, k double, t double, c boolean")
    got = [x[0] for x in df.select(pricing.implied("p", "f", "k", "t", F.lit(0.0), "c")).collect()]
    back = pricing.valued(spark.createDataFrame([(600.0, 600.0, 0.1, got[0], True)], "f double, k double, t double, s double, c boolean"), F.col("f"), F.col("k"), F.col("t"), 0.0, F.col("s"), F.col("c")).first()
    assert back.price == pytest.approx(5.0, abs=1e-9) and got[1:5] == [None] * 4


def test_pairs_both_ways(spark):
    day, e = dt.date(2024, 1, 10), dt.date(2024, 1, 19)
    rows = [(1, "15:00:00", True, 5.0), (2, "15:00:00", False, 4.0), (3, "15:00:03", False, 4.5), (4, "15:00:20", True, 6.0), (5, "15:00:21", True, 6.5), (6, "15:00:22", False, 3.0)]
    tape = spark.createDataFrame([(day, e, 600.0, i, T(s), c, p) for i, s, c, p in rows], "day date, expiry date, strike double, event_id long, ts timestamp_ntz, call boolean, price double")
    got = {r.event_id: round(r.fwd, 6) for r in forwards.pairs(tape, ["day"], 0.0, 5).collect()}
    assert got == {1: 601.0, 2: 601.0, 3: 600.5, 6: 603.5}  # equal instants meet; 4 and 5 find no put within 5 s
    other_day = tape.withColumn("day", F.when(F.col("call"), F.date_add("day", 1)).otherwise(F.col("day")))
    assert forwards.pairs(other_day, ["day"], 0.0, 5).count() == 0 and forwards.pairs(tape.limit(0), ["day"], 0.0, 5).count() == 0


def test_near_forward_drops_strikes_off_the_median(spark):
    day = dt.date(2024, 1, 10)
    rows = [(day, dt.date(2024, 1, 12), 600.0 + (200.0 if i == 9 else i % 3), T(f"15:00:{i:02d}"), True, i, 600.0 + i % 2) for i in range(12)]
    rows += [(day, dt.date(2024, 1, 5), 600.0, T(f"15:01:{i:02d}"), True, 50 + i, 1.0) for i in range(20)]  # an expiry that has passed
    df = spark.createDataFrame(rows, "day date, expiry date, strike double, ts timestamp_ntz, call boolean, event_id long, fwd double")
    got = forwards.near_forward(df, ["day"], 10).orderBy("ts").collect()
    assert [r.event_id for r in got] == [4, 5, 6, 7, 8, 10, 11] and all(600 <= r.fnear <= 601 and r.near == dt.date(2024, 1, 12) for r in got)
    assert forwards.near_forward(df, ["day"], 13).count() == 0


def test_stream_pairs_by_state(spark, tmp_path):
    rows = [("k", T("10:00:00"), 1, True, 5.0), ("k", T("10:00:00"), 2, False, 4.0), ("k", T("10:30:00"), 3, False, 4.5), ("k", T("12:00:00"), 4, True, 6.0), ("q", T("10:00:00"), 5, True, 1.0)]
    schema = "k string, ts timestamp_ntz, event_id long, call boolean, price double"
    for part, some in enumerate((rows[:3], rows[3:])):  # two batches of one stream
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{part}")
    (tmp_path / "all").mkdir()
    for part in range(2):
        for f in (tmp_path / f"in{part}").glob("*.parquet"):
            to = tmp_path / "all" / f"{part}-{f.name}"
            shutil.copy(f, to)
            os.utime(to, (1_700_000_000 + 60 * part,) * 2)  # files come in order of their time
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
    got = slots.run_available(spark, slots.paired_prints(source, ["k"], 3600.0, "2 hours"), "pairs").collect()
    assert sorted((r.event_id, r.other_id, r.gap) for r in got) == [(1, 2, 1.0), (2, 1, 1.0), (3, 1, 0.5)]


def test_tape_scan_prunes(spark, tmp_path):
    rows = spark.range(0, 90).select((F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(F.col("id").cast("int"))).cast("timestamp_ntz").alias("ts"), F.col("id").alias("event_id"), F.lit(1.0).alias("price"))
    store.save_tape(rows, f"{tmp_path}/tape")
    one = store.scan_day(spark, f"{tmp_path}/tape", "2024-02-01 00:00:00", "2024-02-02 00:00:00", ["ts", "event_id"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert [r.event_id for r in one.collect()] == [31] and "PartitionFilters: [isnotnull(month" in plan and "GreaterThanOrEqual(ts" in plan and "price" not in plan


def test_snapshots_are_replaced_by_slot(spark, tmp_path):
    day = dt.date(2024, 1, 10)
    make = lambda x: spark.createDataFrame(x, "day date, hhmm int, v int")
    store.save_snapshots(make([(day, 1000, 1), (day, 1030, 2)]), f"{tmp_path}/s")
    store.save_snapshots(make([(day, 1030, 3)]), f"{tmp_path}/s")
    table = spark.read.parquet(f"{tmp_path}/s")
    assert sorted((r.hhmm, r.v) for r in table.collect()) == [(1000, 1), (1030, 3)]
    asked = spark.createDataFrame([(T("10:15:00"),), (T("10:30:00"),), (T("09:00:00"),)], "ts timestamp_ntz")
    assert {str(r.ts)[11:16]: r.hhmm for r in store.as_of(asked, table, "ts").collect()} == {"10:15": 1000, "10:30": 1030, "09:00": 1030}


def test_life_of_a_short(spark):
    rules, e = life.Rules(fee=1.0, least_fee=1.0), dt.date(2024, 1, 19)
    d = lambda n: dt.date(2024, 1, n)
    days = life.signal_days(spark.createDataFrame([(d(n), "short") for n in range(8, 20)], "day date, signal string"), 2)
    first = spark.createDataFrame([(d(8), e, 600.0, True, 1, 10.0, 0.5, 600.0)], "day0 date, expiry date, strike double, call boolean, entry long, mid0 double, delta0 double, fwd0 double")
    trades = life.opened(first, days, rules)
    marks = [(9, 600.0, 9.0, 0.5, True), (10, 602.0, None, None, True), (11, 601.0, 21.0, 0.6, False), (12, 603.0, 22.0, 0.6, True), (15, 600.0, 1.0, 0.4, True)]
    table = spark.createDataFrame([(n, T("12:00:00").replace(day=n), d(n), e, 600.0, True, f, m, x, ok, m or 5.0) for n, f, m, x, ok in marks], "event_id long, ts timestamp_ntz, day date, expiry date, strike double, call boolean, fwd double, mark double, delta double, fillable boolean, mid double")
    rows = life.judged(life.paths(trades, life.day_marks(table)), days, rules).orderBy("day").collect()
    assert [r.value for r in rows] == [9.0, 9.0, 21.0, 22.0, 1.0]  # no mark on the 10th: the higher of the last mark (9) and intrinsic value (2)
    assert [round(r.hedge_pnl, 6) for r in rows] == [0.0, 100.0, 50.0, 170.0, -10.0]
    assert [(r.reason, r.open) for r in rows] == [(None, True), (None, True), ("stop", True), ("stop", True), ("profit", False)]
    judged = life.judged(life.paths(trades, life.day_marks(table)), days, rules)
    assert sorted((r.day.day, r.event) for r in life.gap_events(judged).collect()) == [(10, "no_delta"), (10, "no_mark"), (11, "no_fill")]
    end = life.closed(trades, judged, life.expiry_spots(table), rules).collect()
    assert [(r.reason, r.exit_day, r.price, round(r.pnl, 6), round(r.pnl_net, 6)) for r in end] == [("stop", d(12), 22.22, -1052.0, -1054.0)]
    none = life.closed(trades, judged.limit(0), life.expiry_spots(table.withColumn("day", F.lit(e))), rules).collect()
    assert [(r.reason, r.price, r.commission) for r in none] == [("expired", 0.0, 0.0)]


def test_allotment(spark):
    rows = spark.createDataFrame([("b", 1, 10.4, 0.0, 5.0), ("b", 2, -3.2, 0.0, 5.0), ("c", 3, 7.6, 2.0, 0.0)], "book string, entry long, target double, held double, orphans double")
    got = {r.entry: (round(r.part, 6), round(r.split, 6)) for r in life.allotted(rows, ["book"]).collect()}
    assert got == {1: (10.2, round(5 * 10.4 / 13.6, 6)), 2: (-3.2, round(5 * 3.2 / 13.6, 6)), 3: (6.0, 0.0)}


def test_pins_and_filters(spark):
    trips = spark.createDataFrame([("x", 1)], "book string, trade long")
    with pytest.raises(ValueError):
        scorecards.variants(trips, {"stop": 1.0, "start": 0.0}, {"late": {"start": 1.0}}, [1.0], ("start",))
    assert scorecards.variants(trips, {"stop": 1.0}, {"a": {}, "b": {"stop": 2.0}}, [1.0, 2.0], ("start",)).count() == 4
    listed = spark.createDataFrame([(dt.date(2024, 1, 8), dt.date(2024, 1, n), k) for n in (12, 13, 19) for k in (600.0, 600.0, 900.0)], "day date, expiry date, strike double")
    spot = spark.createDataFrame([(dt.date(2024, 1, 8), 605.0)], "day date, spot double")
    assert sorted((r.expiry.day, r.right) for r in filters.live_universe(listed, spot, 1, 10, 0.05, True).collect()) == [(12, "C"), (12, "P")]
    assert filters.on_weekdays(listed, "expiry", [4]).count() == 6 and filters.on_weekdays(listed, "expiry", []).count() == 9


def test_books_inside_and_empty(spark):
    schema = "book string, entry date, exit date"
    d = lambda n: dt.date(2024, 1, n)
    trips = spark.createDataFrame([("a", d(1), d(10)), ("a", d(1), d(3)), ("a", d(5), d(6)), ("a", d(5), d(7)), ("a", d(10), d(12)), ("b", d(2), d(4))], schema)
    assert sorted(map(tuple, matching.inside_others(trips).collect())) == [("a", 5, 2), ("b", 1, 0)]
    assert matching.inside_others(trips.limit(0)).count() == 0


def test_registry_numbers(spark, tmp_path):
    runs = spark.createDataFrame([("card/one", "a/b/7", 1.0, 3.14159), ("card/two", "a/b/8", 2.0, None)], "name string, run string, multiple double, pnl double")
    bare = spark.createDataFrame([("card", "9"), ("other", "10")], "card string, run string")
    catalogue.export(runs, bare, f"{tmp_path}/r")
    got = sorted(map(tuple, catalogue.load_registry(spark, f"{tmp_path}/r").collect()), key=str)
    assert got == [("card", "one", "7", 1.0, 3.1416), ("card", "two", "8", 2.0, None), ("other", None, "10", None, None)]


def test_iv_between_deltas(spark):
    rows = [(1, False, -0.2, 0.3), (1, False, -0.4, 0.2), (1, True, 0.25, 9.0), (2, False, -0.25, 0.5), (3, False, None, 0.5)]
    got = {r.k: r.iv_25 for r in chains.iv_at_delta(spark.createDataFrame(rows, "k int, call boolean, delta double, iv double"), ["k"], [0.25]).collect()}
    assert got == {1: pytest.approx(0.275), 2: 0.5}


def test_least_squares(spark):
    """Five regressors against numpy; a group whose regressor never moves has no coefficients; rows with nulls don't count."""
    import numpy as np

    from volmesh.operators import forecasts

    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5)) * [1, 10, 0.1, 1, 3] + [5, 0, 0, -2, 1]
    x[:, 3] += 0.9 * x[:, 0]
    y = 2 + x @ [1.0, -0.5, 3.0, 0.2, 0.0] + rng.normal(size=200)
    names = [f"x{i}" for i in range(5)]
    rows = [("a", *map(float, r), float(v)) for r, v in zip(x, y)] + [("a", *[None] * 5, 1.0)] + [("b", *[1.0] * 5, float(i)) for i in range(4)]
    got = {r["k"]: r for r in forecasts.ols(spark.createDataFrame(rows, "k string, " + ", ".join(f"{n} double" for n in names) + ", y double"), ["k"], "y", names).collect()}
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    assert got["a"]["n"] == 200 and np.allclose([got["a"]["intercept"], *[got["a"][f"b_{n}"] for n in names]], want, atol=1e-9)
    assert got["b"]["n"] == 4 and got["b"]["b_x0"] is None


def test_periods(spark):
    """Open and half-open ends, a day on a bound, overlaps, no date; verdicts with too few events, none at all, and an unknown metric; tails of a single day; months without rows; windows with entries alone."""
    from datetime import date as d

    from pyspark.sql import functions as F

    from volmesh.operators import periods, scorecards

    rows = spark.createDataFrame([(1, d(2020, 1, 1)), (2, d(2020, 6, 1)), (3, None)], "k int, day date")
    got = periods.in_periods(rows, [("all", None, None), ("a", None, "2020-06-01"), ("b", "2020-06-01", None)], "day")
    assert sorted((r["k"], r["period"]) for r in got.collect()) == [(1, "a"), (1, "all"), (2, "all"), (2, "b")]

    table = spark.createDataFrame([("ref", "a", 1.0), ("x", "a", 2.0), ("y", "a", None), ("z", "a", 0.5), ("x", "b", 9.0)], "book string, period string, pnl double").withColumn("one", F.lit(1))
    checks = periods.period_checks(table, ["one"], "book", "ref", [("pnl", "higher", 0.0, "a"), ("pnl", "above", 0.0, "b")], scorecards.RULES)
    assert {(r["book"], r["period"], r["ok"]) for r in checks.collect()} == {("x", "a", True), ("y", "a", False), ("z", "a", False)}
    events = spark.createDataFrame([("x", 5), ("y", 5)], "book string, n long")
    assert {(r["book"], r["n"], r["verdict"]) for r in periods.verdicts(checks, ["book"], events, 5).collect()} == {("x", 5, "passed"), ("y", 5, "failed"), ("z", 0, "inconclusive")}

    trips = spark.createDataFrame([("p", d(2020, 1, 6), d(2020, 1, 8), -5.0, 1.0), ("p", d(2020, 1, 7), d(2020, 1, 8), 2.0, 1.0), ("q", d(2020, 1, 6), d(2020, 3, 2), 4.0, 2.0)], "book string, entry date, exit date, pnl double, commission double")
    tails = {r["book"]: r for r in periods.tails(trips, F.col("commission")).collect()}
    assert (tails["p"]["trough"], tails["p"]["q5"], tails["p"]["shortfall"], tails["q"]["most"], tails["q"]["trough"]) == (d(2020, 1, 8), -5.0, -5.0, 2.0, d(2020, 3, 2))
    sums = {r["book"]: r for r in periods.window_sums(trips, [("jan", "2020-01-01", "2020-02-01")], F.col("commission")).collect()}
    assert (sums["q"]["entries"], sums["q"]["net"], sums["q"]["daily"]) == (1, 2.0, 0.0) and (sums["p"]["entries"], sums["p"]["daily"]) == (2, -5.0)
    months = periods.missing_months(trips, ["book"], "exit").collect()
    assert sorted((r["book"], r["month"]) for r in months) == [("p", d(2020, 2, 1)), ("p", d(2020, 3, 1)), ("q", d(2020, 1, 1)), ("q", d(2020, 2, 1))]
    assert periods.missing_months(trips.where("false"), ["book"], "exit").count() == 0 and periods.tails(trips.where("false"), F.col("commission")).count() == 0


def test_choices(spark):
    """Ties of scores go to the first name and unknown labels count 0; a calendar needs both ends at its strike; JSON keeps nulls and has its columns without rows."""
    import tempfile
    from datetime import date as d

    from volmesh.operators import periods
    from volmesh.sources import store

    c = spark.createDataFrame([(d(2020, 1, 1), 2, 10, 5.0), (d(2020, 1, 1), 1, 10, None), (d(2020, 1, 1), 3, 4, 9.0)], "day date, name int, score int, label double")
    assert {(r["book"], r["mean"], r["n"]) for r in periods.pick_books(c, "day", "score", "name", 5.0).collect()} == {("picked", 0.0, 1), ("fixed", 9.0, 1), ("hindsight", 9.0, 1)}

    chain = spark.createDataFrame([(1, 7, 600.0, True, 3.0, 1), (1, 7, 600.0, True, 4.0, 2), (1, 49, 600.0, True, 9.0, 3), (1, 49, 605.0, True, 8.0, 4), (2, 7, 600.0, True, 3.0, 5), (1, 49, 600.0, True, None, 6)], "day int, dte int, strike double, call boolean, mid double, event_id int")
    (one,) = periods.calendar_prices(chain, ["day"]).collect()
    assert (one["strike"], one["near"], one["far"], one["net"], one["closing"]) == (600.0, 7, 49, -5.0, 5.0)

    rows = spark.createDataFrame([(1, float("nan"), d(2020, 1, 1)), (2, 0.123456, None)], "k int, v double, day date")
    got = store.publish(rows, ["k", "v", "day", "absent"], tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/j").orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, None, "2020-01-01"), (2, 0.1235, None)]
    assert store.publish(rows.where("false"), ["k", "v"], tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/j").columns == ["k", "v"]


def test_closes_without_keys(spark):
    """Closes by key first; those without one go by position to the opens left; repeated keys by position; nothing left is null."""
    from datetime import date as d

    from volmesh.operators import matching

    opens = spark.createDataFrame([("p", d(2020, 1, 3), 1), ("p", d(2020, 1, 3), 2), ("p", d(2020, 1, 2), 3), ("q", d(2020, 1, 2), 4), ("p", d(2020, 1, 5), 5), (None, None, 6)], "book string, entry date, trade int")
    closes = spark.createDataFrame([("p", d(2020, 1, 3), 21, d(2020, 1, 9)), ("p", None, 23, d(2020, 1, 8)), ("p", None, 22, d(2020, 1, 7))], "book string, entry date, trade int, exit date")
    got = matching.match_with_old(opens, closes, ["book", "entry"], ["book"], "entry", "exit", "trade")
    assert {(r["trade"], r["close"]) for r in got.collect()} == {(1, 21), (3, 22), (2, 23), (5, None), (4, None), (6, None)}
    assert {r["close"] for r in matching.match_with_old(opens, closes.where("false"), ["book", "entry"], ["book"], "entry", "exit", "trade").collect()} == {None}
