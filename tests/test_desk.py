"""Operators of the desk against plain loops and searches: limits of a book, blocks of entries, sizes, fits, the day-grid build, its stream, logs."""

import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from volmesh.operators import catalogue, chains, desk, life, models, paths, scorecards, views
from volmesh.plans import forwards, trades
from volmesh.plans import desk as plan_desk
from volmesh.plans import views as plan
from volmesh.sources import adapters as a
from volmesh.sources.adapters import derived
from volmesh.streaming import slots

SF = "/root/testdata/sf0.01"
DAY = date(2024, 1, 1)


def days(n):
    return DAY + timedelta(n)


@pytest.mark.parametrize("places, sided", [(1, False), (2, False), (4, False), (1, True), (4, True)])
def test_taken_is_a_plain_loop(spark, places, sided):
    r = random.Random(places)
    rows = [(b, k, days(s), days(s + r.choice([0, 1, 2, 3, 9])), r.choice(["long", "short"])) for b in "xy" for k in range(200) for s in [r.randint(0, 300)]]
    rows = [(b, i, s, e, side) for i, (b, _, s, e, side) in enumerate(rows)] + [("z", 900 + i, days(5), days(6), "long") for i in range(50)]
    got = {x.entry: x.taken for x in paths.taken(spark.createDataFrame(rows, "book string, entry long, day0 date, exit_day date, side string"), ["book"], "entry", places, side="side" if sided else None).collect()}
    want = {}
    for book in "xyz":
        held = []
        for _, i, s, e, side in sorted((x for x in rows if x[0] == book), key=lambda x: (x[2], x[1])):
            held = [h for h in held if h[0] >= s]
            want[i] = len(held) < places and (not sided or all(h[1] == side for h in held))
            held += [(e, side)] if want[i] else []
    assert got == want and 0 < sum(want.values()) < len(want)


def test_a_busy_period_is_short_whatever_the_candidates(spark):
    rows = [("x", i, days(i % 40), days(i % 40 + (0 if i % 40 % 5 == 4 else 1))) for i in range(4000)]
    busy = paths.busy_periods(spark.createDataFrame(rows, "book string, entry long, day0 date, exit_day date"), ["book"], "entry", "day0", "exit_day", 2)
    assert busy.groupBy("period").count().agg(F.max("count")).first()[0] <= 2 * 5 and busy.count() == 80


def flags(spark, entries, stops, signals):
    trades = spark.createDataFrame([(i, s, days(d)) for i, s, d in entries], "entry long, side string, day0 date")
    ends = spark.createDataFrame([(i, s, "stop", days(d)) for i, s, d in stops], "entry long, side string, reason string, exit_day date")
    rows = spark.createDataFrame([(days(d), s, False) for d, s in signals], "day date, signal string, flat_run boolean")
    return {x.entry: (x.cooling, x.waiting) for x in life.stop_flags(trades, ends, rows, life.Rules(cool_days=3)).collect()}


def test_the_last_stop_is_of_either_side(spark):
    short = [(7, "short"), (8, "short"), (9, "short"), (10, "short")]
    assert flags(spark, [(1, "short", 10)], [(5, "short", 8), (6, "long", 9)], short) == {1: (False, False)}
    assert flags(spark, [(1, "short", 9)], [(5, "short", 8)], short) == {1: (True, True)}
    # another signal on the stop's own day resets it
    assert flags(spark, [(1, "short", 10)], [(5, "short", 8)], [(8, "long"), (9, "short"), (10, "short")]) == {1: (True, False)}
    # a stop on the entry's own day comes after it; another signal before the stop resets nothing
    assert flags(spark, [(1, "short", 8)], [(5, "short", 8)], short) == {1: (False, False)}
    assert flags(spark, [(1, "short", 20)], [(5, "short", 8)], [(7, "flat"), (8, "short"), (20, "short")]) == {1: (False, True)}


def test_reasons_come_in_order(spark):
    trades = spark.createDataFrame([(i, "short" if i != 5 else "long", days(i)) for i in range(1, 8)], "entry long, side string, day0 date")
    marks = spark.createDataFrame([(i, i == 1, i in (1, 2)) for i in range(1, 8)], "entry long, cooling boolean, waiting boolean")
    ratios = spark.createDataFrame([(days(i), 1.2 if i in (1, 2, 4) else 0.9) for i in range(8)], "day date, ratio double")
    picks = spark.createDataFrame([(days(i), None if i in (3, 5, 6) else 0.2) for i in range(1, 8)], "day date, pick double")
    off = days(4).weekday()
    got = {x.entry: x.why for x in life.entry_decisions(trades, marks, ratios, picks, 1.0, [off]).collect()}
    assert got == {1: "cooloff", 2: "reset_wait", 3: "gate", 4: "weekday", 5: None, 6: "pick_skip", 7: None}


def test_crash_sizes_are_those_of_a_loop(spark):
    r = random.Random(4)
    rows = [(i, r.choice([-5.0, 0.0, r.uniform(0.5, 900)]), r.uniform(0, 1), r.choice([0.0, r.uniform(0, 0.2)]), r.uniform(1, 200)) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, net double, delta double, gamma double, move double")
    for budget, least, k in ((9e3, 25.0, 40.0), (5e3, 0.25, 2.0), (2e4, 1e12, 0.0), (1e3, 60.0, 0.0)):
        got = {x.i: x.n for x in chains.stress_quantity(df, "n", budget, least, k).collect()}
        for i, net, delta, gamma, move in rows:
            n = int(budget // net) if net > 0 else 0
            assert n <= 20_000
            while n and n * net + min(max(least, k * math.sqrt(n * gamma * 100)), n * delta * 100) * move > budget:
                n -= 1
            assert got[i] == n


def test_least_absolute_deviations(spark):
    r = random.Random(5)
    rows = [(g, x, 1.5 + 0.4 * x * (g + 1) + r.gauss(0, 0.2) + (40 if r.random() < 0.1 else 0)) for g in range(3) for x in [r.uniform(0, 10) for _ in range(41)]]
    got = {x.g: (x.a, x.b) for x in desk.least_absolute(spark.createDataFrame(rows, "g int, x double, y double"), ["g"], "y", "x", most=400, near=1e-10, least=1e-9, block=40).collect()}
    for g in range(3):
        mine = [(x, y) for k, x, y in rows if k == g]
        loss = lambda p: sum(abs(y - p[0] - p[1] * x) for x, y in mine)
        lines = [((y1 * x2 - y2 * x1) / (x2 - x1), (y2 - y1) / (x2 - x1)) for i, (x1, y1) in enumerate(mine) for x2, y2 in mine[:i]]  # the best one goes through two points
        best = min(lines, key=loss)
        assert loss(got[g]) <= loss(best) * (1 + 1e-6) and got[g] == pytest.approx(best, abs=1e-3)


def test_least_absolute_broadcasts_lines_only(spark, monkeypatch):
    plans = []
    settle = desk.store.settle
    monkeypatch.setattr(desk.store, "settle", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), settle(df))[1])
    rows = spark.range(200).selectExpr("cast(id % 2 as int) as g", "cast(id as double) as x", "cast(id * 2 + id % 7 as double) as y")
    desk.least_absolute(rows, ["g"], "y", "x", most=9, block=4)
    assert len(plans) == 2
    for plan in plans:  # a join a pass, each with the lines marked for broadcast
        joins = [line for line in plan.splitlines() if "Join Inner" in line]
        assert len(joins) == 4 and all("rightHint=(strategy=broadcast)" in j for j in joins)


def likelihood(omega, alpha, beta, x, v):
    h, total = v, 0.0
    for r in x:
        total -= 0.5 * (math.log(h) + r * r / h)
        h = omega + alpha * r * r + beta * h
    return total


def test_garch_reaches_the_optimum(spark):
    r = np.random.default_rng(6)
    series = []
    for k in range(6):
        omega, alpha, beta, h, x = 2e-6, 0.1, 0.85, 4e-5, []
        for _ in range(900):
            x.append(math.sqrt(h) * r.standard_normal())
            h = omega + alpha * x[-1] ** 2 + beta * h
        series.append((f"s{k}", DAY, [float(z) for z in x], float(np.mean(np.square(x)))))
    got = models.garch_fit(spark.createDataFrame([*series, ("zero", DAY, [0.0] * 900, 0.0)], "symbol string, date date, _x array<double>, _v double"), 22).collect()
    assert [x.alpha for x in got if x.symbol == "zero"] == [None] or math.isnan(next(x.alpha for x in got if x.symbol == "zero"))
    for (name, _, x, v), f in zip(series, sorted((g for g in got if g.symbol != "zero"), key=lambda g: g.symbol)):
        at = likelihood(f.omega, f.alpha, f.beta, x, v)
        assert f.likelihood == pytest.approx(at, abs=1e-6)
        assert all(at >= likelihood(v * (1 - p - q), p, q, x, v) for p, q in models.GRID)
        step = (1e-3 * f.omega, 1e-3, 1e-3)  # no neighbour is better
        for i in range(3):
            for s in (-1, 1):
                p = [f.omega, f.alpha, f.beta]
                p[i] += s * step[i]
                assert p[1] < 0 or p[1] + p[2] >= 1 or likelihood(*p, x, v) <= at + 1e-7
        assert abs(f.alpha - 0.1) < 0.1 and abs(f.beta - 0.85) < 0.2 and f.vol > 0


def test_exposure_counts_each_weekday_once(spark):
    r = random.Random(7)
    trips = [(b, days(s), days(s + r.choice([-3, 0, 1, 5, 90]))) for b in "xy" for s in [r.randint(0, 700) for _ in range(12)]]
    got = {(x.book, x.year): (x.held, x.days) for x in scorecards.exposure(spark.createDataFrame(trips, "book string, entry date, exit date")).collect()}
    first, last = min(t[1] for t in trips), max(t[2] for t in trips)
    every = [first + timedelta(i) for i in range((last - first).days + 1) if (first + timedelta(i)).weekday() < 5]
    for book in "xy":
        for year in {d.year for d in every}:
            held = sum(any(b == book and s <= d <= e for b, s, e in trips) for d in every if d.year == year)
            assert got.get((book, year), (0, sum(d.year == year for d in every))) == (held, sum(d.year == year for d in every))


def test_work_logs(spark):
    rows = [("ann", "x", "## 2024-01-02\ntext\n## 2024-03-04 more\n ## 2025-01-01"), ("ann", "x", " \n"), ("bob", "notes", "no head"), ("bob", "log March 7", "done"), ("bob", "December-20", "done"), ("eve", "February-31", "x"), (None, "x", None)]
    got = {x.owner: (x.entries, x["last"]) for x in catalogue.work_logs(spark.createDataFrame(rows, "owner string, stem string, text string"), "2024-06-15").collect()}
    assert got == {"ann": (2, "2024-03-04"), "bob": (3, "2024-03-07"), "eve": (1, None)}


def build(spark, tape):
    ex = derived(spark, SF, a.EX_DAYS)
    return views.build(tape, forwards.session(tape), plan.CONTRACT, plan.GRID, forwards.RATE, forwards.WITHIN, ex, plan.LAG, plan.WINDOW, plan.LOOKBACK, plan.NEED, plan.FEW, plan.LOW_DTE, plan.HIGH_DTE, plan.REACH, plan.AFTER)


def test_every_slot_is_built_or_logged_and_no_decision_sees_later_prints(spark):
    tape = forwards.tape(spark, SF).where("day between date'2024-01-08' and date'2024-01-12'")
    chain, log = build(spark, tape)
    built = [(x.day, x.slot) for x in chain.where("view = 'decide'").select("day", "slot").distinct().collect()]
    logged = [(x.day, x.slot) for x in log.collect()]
    assert sorted(built + logged) == sorted({(date(2024, 1, 8) + timedelta(i), g) for i in range(5 + plan.AFTER) for g in plan.GRID}) and built and logged
    assert {x.why for x in log.collect()} >= {"no_trades", "no parity forward"}
    assert chain.where("view = 'fill' and src is null").where("mid is not null or iv is not null").isEmpty()
    # prints after 13:00 on the 10th are poisoned: decisions up to then stay, fills after it don't
    late = (F.col("day") == F.to_date(F.lit("2024-01-10"))) & (F.col("ts") > F.lit("2024-01-10 18:00:00").cast("timestamp_ntz"))
    poisoned, _ = build(spark, tape.withColumn("price", F.when(late, F.col("price") * 3 + 50).otherwise(F.col("price"))))
    part = lambda c, view, last: sorted(str(x) for x in c.where((F.col("view") == view) & ((F.col("day") < F.to_date(F.lit("2024-01-10"))) | (F.col("day") == F.to_date(F.lit("2024-01-10"))) & (F.col("slot") <= last))).select("day", "slot", "expiry", "strike", "call", "src", F.round("mid", 9), F.round("iv", 9), F.round("delta", 9)).collect())
    assert part(chain, "decide", 13 * 60 + plan.LAG) == part(poisoned, "decide", 13 * 60 + plan.LAG)
    assert part(chain, "fill", 13 * 60 - plan.WINDOW) == part(poisoned, "fill", 13 * 60 - plan.WINDOW)
    assert part(chain, "fill", 16 * 60) != part(poisoned, "fill", 16 * 60)


def test_view_stream_takes_files_out_of_order(spark, tmp_path):
    r = random.Random(8)
    start = datetime(2024, 1, 8, 14, 31)
    rows = [(i, start + timedelta(minutes=r.randint(0, 380), seconds=i % 60), date(2024, 1, 8), date(2024, 1, 19), 600.0 + i % 2, bool(i % 3), float(r.randint(1, 90)), r.randint(1, 9)) for i in range(300)]
    schema = "event_id long, ts timestamp_ntz, day date, expiry date, strike double, call boolean, price double, size int"
    rows += [(1000, start + timedelta(days=1), date(2024, 1, 9), date(2024, 1, 19), 600.0, True, 1.0, 1)]  # moves the watermark past the day
    r.shuffle(rows)
    for k, part in enumerate((rows[:150], rows[150:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(x.slot, x.view, x.strike, x.call): (x.n, x["size"], x["last"]) for x in slots.view_prints(stream, 15, 240, 60, plan.GRID, "2 days").where("day = date'2024-01-08'").collect()}
    assert got == {}  # two days late: nothing is closed yet
    got = {(x.slot, x.view, x.strike, x.call): (x.n, x["size"], x["last"]) for x in slots.view_prints(stream, 15, 240, 60, plan.GRID, "12 hours").where("day = date'2024-01-08'").collect()}
    want = {}
    for i, ts, day, _, strike, call, price, size in rows:
        m = (ts - datetime(2024, 1, 8, 5)).total_seconds() / 60  # New York
        for g in plan.GRID:
            for view, fits in (("decide", g - 255 < m <= g - 15), ("fill", g < m <= g + 60)):
                if fits and day == date(2024, 1, 8):
                    want.setdefault((g, view, strike, call), []).append((ts, i, price, size))
    assert got == {k: (len(v), sum(x[3] for x in v), max(v)[2]) for k, v in want.items()}


def test_trips_after_stops(spark):
    from volmesh.operators import trips

    r = random.Random(9)
    rows = [(i, b, r.choice(["long", "short"]), days(s), days(s + r.randint(0, 6)), r.choice(["stop", "time", "profit"]), 1.0) for b in "xy" for i, s in [(1000 * (b == "y") + k, r.randint(0, 60)) for k in range(40)]]
    df = spark.createDataFrame(rows, "entry long, book string, side string, day0 date, exit_day date, reason string, pnl_net double")
    got = {x.entry: (x.reentry, x.after_stop) for x in trips.after_stops(df, ["book"], 3).collect()}
    weekdays = lambda s, e: sum((s + timedelta(i)).weekday() < 5 for i in range((e - s).days))
    for b in "xy":
        mine = sorted((x for x in rows if x[1] == b), key=lambda x: (x[4], x[0]))
        stops = [x[4] for x in mine if x[5] == "stop"]
        for before, x in zip([None, *mine], mine):
            assert got[x[0]] == (bool(before) and before[5] == "stop" and before[2] == x[2], any(s <= x[3] and weekdays(s, x[3]) <= 3 for s in stops))
    log = spark.createDataFrame([("x", days(1), "cooloff"), ("x", days(1), "reset_wait"), ("x", days(2), "gate")], "book string, day date, why string")
    assert {x.book: x.blocked_days for x in trips.stop_stats(df, log, ["book"], 3).collect()} == {"x": 1, "y": 0}


def test_windows_and_models_are_checked(spark, tmp_path):
    bounds = ("2014-06-01", "2024-12-31", "2023-01-01")
    desk.check_window("2015-01-01", "2022-12-31", *bounds)
    desk.check_window("2015-01-01", "2024-12-31", *bounds, final=True)
    for start, end in (("2014-05-31", "2020-01-01"), ("2015-01-01", "2025-01-01"), ("2015-01-01", "2023-01-01"), ("2020-01-02", "2020-01-01")):
        with pytest.raises(ValueError, match="refused"):
            desk.check_window(start, end, *bounds)
    fit = spark.createDataFrame([(0, 1, 0.1, 0.2)], "tier int, bucket int, a double, b double")
    models.save_model(fit, {"floor": 0.02, "method": "x"}, str(tmp_path / "m"))
    rows, meta = models.load_model(spark, str(tmp_path / "m"))
    assert rows.collect() == fit.collect() and meta == {"floor": "0.02", "method": "x"}
    models.save_model(fit.limit(0), {"floor": 1}, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        models.load_model(spark, str(tmp_path / "none"))


def test_a_scope_removes_what_it_wrote(spark, tmp_path):
    import os

    from volmesh.sources import store

    outer = store.shared(spark)
    before = set(os.listdir(outer))
    with store.scope(spark):
        rows = store.settle(spark.range(5))
        folder = store.fresh(spark, "log")
        rows.write.parquet(folder)
        assert os.path.isdir(folder) and rows.count() == 5
    assert set(os.listdir(outer)) == before and store.settle(spark.range(3)).count() == 3


@pytest.fixture(scope="module")
def walked_paths(spark):
    """By entry: (right, sign, first mid, day, all later marks in order), by plain loops over all marks."""
    marks = sorted(derived(spark, SF, a.MARKS).collect(), key=lambda m: (m.ts, m.event_id))
    first, of = {}, {}
    for m in marks:
        of.setdefault((m.expiry, m.strike, m.call), []).append(m)
        if m.ts.hour < 12 and m.day <= m.expiry:
            first.setdefault((m.day, m.expiry, m.strike, m.call), m)
    late = lambda e: [m for m in of[e.expiry, e.strike, e.call] if m.ts > e.ts and m.day <= e.expiry and (m.day - e.day).days <= 5]
    return {e.event_id: (e.call, 1 if e.event_id % 3 == 0 else -1, e.mid, e.day, late(e)) for e in first.values() if late(e)}


def exit_of(call, sign, mid, day, marks):
    for m in marks:
        pnl = sign * (m.mid - mid) * 100
        why = "time" if (m.day - day).days >= 5 else "stop" if pnl <= -0.5 * mid * 100 else "profit" if pnl >= 0.3 * mid * 100 else None
        if why or m is marks[-1]:
            return why or "end", m, pnl


def crowded(paths):
    """Whether some path has two marks in one half hour, which a path over slots would drop."""
    return any(len({(m.day, m.ts.hour, m.ts.minute // 30) for m in p[4]}) < len(p[4]) for p in paths.values())


def test_trade_exits_see_all_marks(spark, walked_paths):
    got = {x.entry: (x.reason, x.exit_id, x.pnl) for x in trades.trade_exits(spark, SF).collect()}
    want = {e: (why, m.event_id, pytest.approx(pnl, abs=1e-3)) for e, p in walked_paths.items() for why, m, pnl in [exit_of(*p)]}
    assert crowded(walked_paths) and got == want

def test_hedge_paths_see_all_marks(spark, walked_paths):
    got, want = {x.entry: (x.moves, x.shares, x.hedge_pnl) for x in trades.hedge_paths(spark, SF).collect()}, {}
    for e, (_, sign, _, _, marks) in walked_paths.items():
        moves, shares, spot, gain = 0, 0.0, marks[0].fwd, 0.0
        for m in marks:
            gain, spot = gain + shares * (m.fwd - spot), m.fwd
            goal = round(-sign * 100 * m.delta)
            if abs(goal - shares) >= 10:
                moves, shares = moves + 1, goal
        want[e] = moves, shares, pytest.approx(gain, abs=1e-3)
    assert got == want


def test_book_days_see_all_marks(spark, walked_paths):
    realized, still = {}, {}
    for p in walked_paths.values():
        _, end, pnl = exit_of(*p)
        realized[p[0], end.day] = realized.get((p[0], end.day), 0.0) + pnl
        for day, mid in {m.day: m.mid for m in p[4] if m.day < end.day}.items():
            still[p[0], day] = still.get((p[0], day), 0.0) + p[1] * (mid - p[2]) * 100
    total, want = {}, {}
    for k in sorted({*realized, *still}):
        total[k[0]] = total.get(k[0], 0.0) + realized.get(k, 0.0)
        want[k] = pytest.approx((total[k[0]], still.get(k, 0.0), total[k[0]] + still.get(k, 0.0)), abs=1e-2)
    got = {(x.call, x.day): (x.realized, x.open, x.total) for x in trades.book_days(spark, SF).collect()}
    assert got == want


def test_delta_profit_sees_all_marks(spark, walked_paths):
    got = {x.entry: (x.marks, x.delta_pnl) for x in plan_desk.delta_profit(spark, SF).collect()}
    gain = lambda sign, ms: sum(sign * 100 * m.delta * (n.fwd - m.fwd) for m, n in zip(ms, ms[1:]))
    assert got == {e: (len(p[4]), pytest.approx(gain(p[1], p[4]), abs=1e-3)) for e, p in walked_paths.items()}


def test_live_book_sees_all_marks(spark, walked_paths):
    """Its last total is the profit of all exits."""
    last = {call: sum(exit_of(*p)[2] for p in walked_paths.values() if p[0] == call) for call in (True, False)}
    assert {x.call: x.last for x in plan_desk.live_book(spark, SF).collect()} == pytest.approx(last, abs=1e-2)
