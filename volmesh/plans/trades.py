"""Queries over trade paths and matched books, and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching, paths, reports, scorecards
from ..sources import adapters as a
from ..sources import store
from ..sources.adapters import derived

HOLD, STOP, TAKE, BAND, SLOT = 5, 0.5, 0.3, 10.0, 30
KEYS = ["book", "side", "entry"]
STOPS = [0.1, 0.25, 0.5, 1.0, 2.0]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths over all marks."""
    marks = derived(spark, sf_dir, a.MARKS)
    return paths.path(paths.entries(marks, 12), marks, HOLD)


def _slot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths over the last mark of each slot."""
    marks = derived(spark, sf_dir, a.MARKS)
    return paths.path(paths.entries(marks, 12), paths.slot_marks(marks, SLOT), HOLD)


def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.exits(_rows(spark, sf_dir), HOLD, STOP, TAKE)


def _slot_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.exits(_slot_rows(spark, sf_dir), HOLD, STOP, TAKE)


def trade_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _closed(spark, sf_dir).select("entry", "reason", "exit_id", *[F.round(c, 4).alias(c) for c in ("pnl", "downside", "score")])


def stop_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By right, the stop (as a multiple of the premium) with the highest sum of profit over trades that exit by it, and whether it lies inside the range tried."""
    rows = store.settle(_slot_rows(spark, sf_dir))
    sums = None
    for stop in STOPS:
        one = paths.exits(rows, HOLD, stop, TAKE).groupBy("call").agg(F.round(F.sum("pnl"), 4).alias("pnl")).withColumn("stop", F.lit(stop))
        sums = one if sums is None else sums.unionByName(one)
    return scorecards.curve(sums, ["call"], "stop", "pnl")


def hedge_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.hedged(_rows(spark, sf_dir), BAND).withColumn("hedge_pnl", F.round("hedge_pnl", 4))


def taken_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which trades a book would take: one at a time by contract, and with 1, 2 or 4 places by right (with 4, of one side at a time)."""
    ends = store.settle(_slot_closed(spark, sf_dir).select("entry", *paths.CONTRACT, F.when(F.col("sign") > 0, "long").otherwise("short").alias("side"), "day0", "exit_day"))
    flags = {"alone": (paths.CONTRACT, 1, None), "one": (["call"], 1, None), "two": (["call"], 2, None), "four": (["call"], 4, "side")}
    out = ends.select("entry")
    for name, (book, places, side) in flags.items():
        out = out.join(paths.taken(ends, book, "entry", places, side=side).select("entry", F.col("taken").alias(name)), "entry")
    return out


def book_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.book_days(_rows(spark, sf_dir), _closed(spark, sf_dir)).select("call", "day", *[F.round(c, 3).alias(c) for c in ("realized", "open", "total")])


def matched_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = derived(spark, sf_dir, a.TRIPS)
    closes = derived(spark, sf_dir, a.CLOSES).where("exit is not null").select(*KEYS, "trade", F.col("trade").alias("close"), "exit")
    return matching.match_orders(trips.select(*KEYS, "trade"), closes, KEYS, "trade").select("trade", "close", F.datediff("exit", "entry").alias("days"))


def matched_with_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and closes of which every ninth lacks its time of entry, as old logs do."""
    trips = derived(spark, sf_dir, a.TRIPS)
    closes = trips.select("book", "side", F.when(F.col("trade") % 9 > 0, F.col("entry")).alias("entry"), "trade", "exit")
    out = matching.match_with_old(trips.select(*KEYS, "trade"), closes, KEYS, ["book"], "entry", "exit", "trade")
    return out.select("trade", "close", F.datediff("exit", "entry").alias("days"))


def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.repeated_keys(derived(spark, sf_dir, a.TRIPS), KEYS)


def compared_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.compare_books(derived(spark, sf_dir, a.TRIPS), "1-URGENT", "2-HIGH")
    return rows.select("side", "entry", "n", "status", F.round(F.coalesce("pnl_a", F.lit(0.0)) - F.coalesce("pnl_b", F.lit(0.0)), 4).alias("gap"))


def overlapping_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.inside_others(derived(spark, sf_dir, a.TRIPS))


def marginal_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.marginal(reports.daily(derived(spark, sf_dir, a.TRIPS)), "1-URGENT", "5-LOW").withColumn("marginal", F.round("marginal", 4))


def position_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips open at the start of 1996 against a broker's record."""
    held = derived(spark, sf_dir, a.RECORDED).where("entry <= date'1996-01-01' and exit > date'1996-01-01'")
    return matching.differences(held, held.where("recorded"), ["book", "side", "reason"])


QUERIES = {f.__name__: f for f in (trade_exits, stop_curve, hedge_paths, taken_trades, book_days, matched_orders, matched_with_old, repeated_keys, compared_books, overlapping_entries, marginal_daily, position_differences)}

_PATH = f"""m as ({a.MARKS}), e as (select event_id as entry, expiry, strike, call, day as day0, ts as ts0, mid as mid0, case when event_id % 3 = 0 then 1 else -1 end as sign from m where hour(ts) < 12 and day <= expiry qualify row_number() over (partition by day, expiry, strike, call order by ts, event_id) = 1),
p as (select e.*, m.event_id, m.ts, m.day, m.fwd, m.delta, sign * (m.mid - mid0) * 100 as pnl from e join m using (expiry, strike, call) where m.ts > ts0 and m.day <= e.expiry and m.day - day0 <= {HOLD})"""
_SLOT_PATH = f"""m as ({a.MARKS}), e as (select event_id as entry, expiry, strike, call, day as day0, ts as ts0, mid as mid0, case when event_id % 3 = 0 then 1 else -1 end as sign from m where hour(ts) < 12 and day <= expiry qualify row_number() over (partition by day, expiry, strike, call order by ts, event_id) = 1),
ms as (select * from m qualify row_number() over (partition by day, expiry, strike, call, (hour(ts) * 60 + minute(ts)) // {SLOT} order by ts desc, event_id desc) = 1),
p as (select e.*, m.event_id, m.ts, m.day, m.fwd, m.delta, sign * (m.mid - mid0) * 100 as pnl from e join ms m using (expiry, strike, call) where m.ts > ts0 and m.day <= e.expiry and m.day - day0 <= {HOLD})"""
_EXITS = f"""w as (select *, case when day - day0 >= {HOLD} then 'time' when pnl <= -{STOP} * mid0 * 100 then 'stop' when pnl >= {TAKE} * mid0 * 100 then 'profit' end as why, least(pnl - lag(pnl, 1, 0) over (partition by entry order by ts), 0) as fall from p),
f as (select entry, min(ts) as at from w where why is not null group by 1), u as (select w.* from w left join f using (entry) where f.at is null or w.ts <= f.at),
x as (select entry, any_value(call) as call, any_value(expiry) as expiry, any_value(strike) as strike, any_value(day0) as day0, coalesce(arg_max(coalesce(why, 'end'), ts), 'end') as reason, arg_max(event_id, ts) as exit_id, arg_max(day, ts) as exit_day, arg_max(pnl, ts) as pnl, sqrt(sum(fall * fall)) as downside from u group by 1)"""
EXITS, SLOT_EXITS = f"{_PATH}, {_EXITS}", f"{_SLOT_PATH}, {_EXITS}"
_TRIPS = f"t as ({a.TRIPS})"

_CURVE = " union all ".join(f"(with {SLOT_EXITS.replace(f'-{STOP} * mid0', f'-{s} * mid0')} select call, {s}::double as stop, round(sum(pnl), 4) as pnl from x group by 1)" for s in STOPS)

ORACLES = {
    "stop_curve": f"with r as (select *, row_number() over (partition by call order by pnl desc, stop) as i from ({_CURVE}) c) select call, stop as best, stop > {STOPS[0]} and stop < {STOPS[-1]} as interior from r where i = 1",
    "trade_exits": f"with {EXITS} select entry, reason, exit_id, round(pnl, 4) as pnl, round(downside, 4) as downside, round(case when downside > 0 then pnl / downside end, 4) as score from x",
    "hedge_paths": f"""with recursive {_PATH}, q as materialized (select entry, row_number() over (partition by entry order by ts) as i, round_even(-sign * 100 * delta, 0) as goal, fwd from p),
s as (select entry, i, (abs(goal) >= {BAND})::int as moves, case when abs(goal) >= {BAND} then goal else 0 end::double as shares, fwd, 0::double as gain from q where i = 1
 union all select q.entry, q.i, s.moves + (abs(q.goal - s.shares) >= {BAND})::int, case when abs(q.goal - s.shares) >= {BAND} then q.goal else s.shares end, q.fwd, s.gain + s.shares * (q.fwd - s.fwd) from s join q on q.entry = s.entry and q.i = s.i + 1)
select entry, arg_max(moves, i) as moves, arg_max(shares, i) as shares, round(arg_max(gain, i), 4) as hedge_pnl from s group by 1""",
    "taken_trades": f"""with recursive {SLOT_EXITS}, xs as (select x.entry, x.call, x.expiry, x.strike, x.day0, exit_day, side from x join (select distinct entry, case when sign > 0 then 'long' else 'short' end as side from e) using (entry)),
kb(kind, places, sided) as (values ('alone', 1, false), ('one', 1, false), ('two', 2, false), ('four', 4, true)),
nb as materialized (select kind, places, sided, case when kind = 'alone' then concat(call, expiry, strike) else call::varchar end as book, entry, day0, exit_day, side, row_number() over (partition by kind, case when kind = 'alone' then concat(call, expiry, strike) else call::varchar end order by day0, entry) as i from xs, kb),
bs as (select kind, book, i, entry, places, true as ok, [exit_day] as open, side as held from nb where i = 1
 union all select n.kind, n.book, n.i, n.entry, n.places, fits, case when fits then list_append(live, n.exit_day) else live end, case when fits then n.side else held end
 from (select n.*, s.held, list_filter(s.open, lambda q: q >= n.day0) as live, len(list_filter(s.open, lambda q: q >= n.day0)) < n.places and (not n.sided or len(list_filter(s.open, lambda q: q >= n.day0)) = 0 or s.held = n.side) as fits from bs s join nb n on n.kind = s.kind and n.book = s.book and n.i = s.i + 1) n)
select entry, bool_or(ok) filter (where kind = 'alone') as alone, bool_or(ok) filter (where kind = 'one') as one, bool_or(ok) filter (where kind = 'two') as two, bool_or(ok) filter (where kind = 'four') as four from bs group by 1""",
    "book_days": f"""with {EXITS}, o as (select p.call, p.day, p.entry, arg_max(p.pnl, p.ts) as o from p join x using (entry) where p.day < x.exit_day group by 1, 2, 3), h as (select call, day, sum(o) as open from o group by 1, 2), r as (select call, exit_day as day, sum(pnl) as r from x group by 1, 2),
b as (select call, day, coalesce(open, 0) as open, sum(coalesce(r, 0)) over (partition by call order by day) as realized from h full join r using (call, day)) select call, day, round(realized, 3) as realized, round(open, 3) as open, round(realized + open, 3) as total from b""",
    "matched_orders": f"""with {_TRIPS}, o as (select *, row_number() over (partition by book, side, entry order by trade) as n from t), c as (select *, row_number() over (partition by book, side, entry order by trade) as n from ({a.CLOSES}) t where exit is not null)
select o.trade, c.trade as close, (c.exit - o.entry)::int as days from o left join c using (book, side, entry, n)""",
    "matched_with_old": f"""with {_TRIPS}, o as (select *, row_number() over (partition by book, side, entry order by trade) as n from t), c as (select *, row_number() over (partition by book, side, entry order by trade) as n from t where trade % 9 > 0),
k as (select o.trade, o.book, o.entry, c.trade as close, c.exit as e from o left join c on c.book = o.book and c.side = o.side and c.entry = o.entry and c.n = o.n), u as (select *, row_number() over (partition by book order by entry, trade) as i from k where close is null), z as (select *, row_number() over (partition by book order by exit, trade) as i from t where trade % 9 = 0)
select trade, close, (e - entry)::int as days from k where close is not null union all select u.trade, z.trade, (z.exit - u.entry)::int from u left join z on z.book = u.book and z.i = u.i""",
    "repeated_keys": f"with {_TRIPS} select book, side, entry, count(*) as n from t group by all having count(*) > 1",
    "compared_books": f"""with {_TRIPS}, n as (select *, row_number() over (partition by book, side, entry order by trade)::int as n from t), x as (select * from n where book = '1-URGENT'), y as (select * from n where book = '2-HIGH')
select side, entry, n, case when y.trade is null then 'first' when x.trade is null then 'second' when x.exit = y.exit and x.reason = y.reason then 'same' else 'changed' end as status, round(coalesce(x.pnl, 0) - coalesce(y.pnl, 0), 4) as gap from x full join y using (side, entry, n)""",
    "overlapping_entries": f"with {_TRIPS} select book, count(*) as trips, count(*) filter (where exists (select 1 from t o where o.book = t.book and o.entry < t.entry and o.exit > t.entry)) as inside from t group by 1",
    "marginal_daily": f"""with {_TRIPS}, d as (select book, exit as date, sum(pnl - commission) as pnl from t group by all)
select date, round(coalesce(x.pnl - y.pnl, 0), 4) as marginal from (select * from d where book = '1-URGENT') x full join (select * from d where book = '5-LOW') y using (date)""",
    "position_differences": f"""with {_TRIPS} select book, side, reason, count(*) as held, count(*) filter (where trade % 5 > 0) as recorded from t where entry <= date '1996-01-01' and exit > date '1996-01-01' group by all having count(*) filter (where trade % 5 = 0) > 0""",
}
