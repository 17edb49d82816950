"""Domain tables derived from the star-schema tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Daily bars of five symbols, from orders.
BARS = """
select symbol, date, close * (1 + ((k % 13) - 6) / 2000.0) as open, close * (1 + ((n % 7) + 1) / 1000.0) as high,
       close * (1 - ((n % 5) + 1) / 1000.0) * (case when k % 97 = 0 then 0.45 else 1.0 end) as low, close
from (select symbol, date, n, k, 400 * exp(sum((k - 200) / 10000.0) over (partition by symbol order by date rows unbounded preceding)) as close
      from (select o_orderpriority as symbol, cast(o_orderdate as date) as date, count(*) as n, sum(o_orderkey % 101) % 401 as k
            from orders group by o_orderpriority, cast(o_orderdate as date)) a) b
"""
#: Volatility indices by date, from lineitem.
INDICES = """
select cast(l_shipdate as date) as date, round(10 + 200 * avg(l_discount), 6) as vix, round(12 + 180 * avg(l_tax), 6) as vix9d, round(14 + 120 * avg(l_tax), 6) as vix3m, round(avg(l_discount) / 2, 8) as irx
from lineitem group by cast(l_shipdate as date)
"""
#: Option prints, from events: calls and puts on a few strikes and expiries.
TAPE = """
select event_id, ts, case when event_id % 2 = 0 then 'C' else 'P' end as right_, cast(595 + event_id % 3 * 5 as double) as strike,
       cast(user_id % 4 as int) as expiry_no, value as price, case when event_type = 'purchase' then 209 else 0 end as condition
from events where value is not null
"""
#: Quotes with a half-spread that grows with the price, from part.
QUOTES = """
select p_partkey as quote, p_size as dte, (p_partkey % 91) / 100.0 as delta, p_retailprice / 100 as mid,
       0.01 + 0.02 * p_retailprice / 100 + (p_partkey % 11 - 5) / 1000.0 as half
from part
"""
#: Round trips of books, from orders and their lines: a book for each priority.
TRIPS = """
select o_orderpriority as book, o_orderkey as trade, cast(o_orderdate as date) as entry, cast(max(l_shipdate) as date) as exit,
       case when o_orderkey % 3 = 0 then 'long' else 'short' end as side, case o_orderkey % 4 when 0 then 'stop' when 1 then 'profit' when 2 then 'time' else 'flat' end as reason,
       sum(l_extendedprice * (l_discount - 0.05)) as pnl, sum(l_quantity) * 0.65 as commission
from orders join lineitem on l_orderkey = o_orderkey group by o_orderpriority, o_orderkey, cast(o_orderdate as date)
"""


#: Lines that one task of a join of orders to their lines gets, about.
TASK_LINES = 1_000_000


def by_order(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """orders and lineitem in as many partitions of order keys as the lines ask for, so that a task's sort and groups stay the same size however many lines there are; as they are where the session's shuffle partitions do. The count reads footers."""
    parts = tables["lineitem"].count() // TASK_LINES + 1
    if parts <= int(tables["lineitem"].sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return tables
    return tables | {t: tables[t].repartition(parts, key) for t, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"))}


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the texts above; its tables are read from sf_dir."""
    names = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem", "events", "part", "documents", "region", "customer") if f" {t} " in sql.replace("\n", " ") + " "}
    if "join lineitem " in sql:
        names = by_order(names)
    for t in names:
        sql = sql.replace(f"from {t} ", f"from {{{t}}} ").replace(f"from {t}\n", f"from {{{t}}}\n").replace(f"join {t} ", f"join {{{t}}} ")
    return spark.sql(sql, **names)
#: Option prints on a moving forward with a parabolic smile (iv0), observed with a small error and a few outliers (iv).
OPTIONS = """
select *, 0.2 - 0.1 * k + 0.8 * k * k as iv0, 0.2 - 0.1 * k + 0.8 * k * k + (event_id % 7 - 3) / 1e3 + case when event_id % 53 = 0 then 5e-2 else 0e0 end as iv
from (select event_id, ts, day, fwd, strike, dte, call, size, condition, ln(strike / fwd) as k, (dte + 5e-1) / 3.65e2 as years
      from (select event_id, ts, cast(ts as date) as day, 600 + 8 * sin(event_id / 7e2) as fwd, cast(round(600 + 8 * sin(event_id / 7e2)) + (event_id * 7) % 41 - 20 as double) as strike,
                   cast(7 + user_id % 4 * 14 as int) as dte, event_id % 2 = 0 as call, cast(user_id % 9 + 1 as int) as size, case event_type when 'purchase' then 209 when 'view' then 219 else 0 end as condition
            from events e) a) b
"""
#: Candidates of a day with a score and a later label, from orders.
CANDIDATES = """
select cast(o_orderdate as date) as day, o_orderkey as name, cast(o_custkey * 7919 % 1009 as int) as score, o_totalprice as label from orders
"""
#: Hourly snapshots of quotes on the option prints: some without a bid, a delta or an implied volatility, some crossed.
CHAIN = f"""
select event_id, day, hour(ts) as hour, dte, strike, call, fwd, k, years, size, mid as last, case when event_id % 31 = 0 then null when call then 1 / (1 + exp(12 * k)) else 1 / (1 + exp(12 * k)) - 1 end as delta,
       case when event_id % 5 = 0 or hour(ts) % 6 = 5 and event_id % 3 > 0 then null else iv0 end as iv, case when event_id % 17 = 0 then 0e0 when event_id % 23 = 0 then null else mid * 9.9e-1 - 2e-2 end as bid,
       case when event_id % 29 = 0 then mid * 9.8e-1 - 3e-2 else mid * 1.01e0 + 2e-2 end as ask
from (select *, greatest(case when call then fwd - strike else strike - fwd end, 0) + 4e-1 * fwd * iv0 * sqrt(years) * exp(-8 * k * k) as mid from ({OPTIONS}) o) p
"""
#: Quarterly dividends, from lineitem.
DIVIDENDS = """
select cast(date_trunc('quarter', l_shipdate) as date) as ex_date, round(avg(l_discount) * 20, 4) as amount from lineitem group by cast(date_trunc('quarter', l_shipdate) as date)
"""
#: Marks of contracts with one of four expiries.
MARKS = f"""
select event_id, ts, day, cast('2024-01-12' as date) + cast((dte - 7) / 2 as int) as expiry, strike, call, fwd, case when call then 1 / (1 + exp(12 * k)) else 1 / (1 + exp(12 * k)) - 1 end as delta,
       greatest(case when call then fwd - strike else strike - fwd end, 0) + 4e-1 * fwd * iv0 * sqrt(years) * exp(-8 * k * k) as mid
from ({OPTIONS}) o
"""
#: Trial runs with a configuration each, from orders.
RUNS = """
select o_orderkey as run, concat(o_orderpriority, '/', o_orderstatus) as name, cast(o_orderdate as date) as ran, cast(o_custkey % 7 as int) as config, cast(1 + o_orderkey % 2 as int) as multiple, o_totalprice as pnl from orders
"""
#: Cards as markdown text, from documents.
CARDS = """
select doc_id, concat('# ', source, ' study', chr(10), '| Owner | ', lang, ' |', chr(10), '| Status | ', case when doc_id % 3 = 0 then 'Done: kept' when doc_id % 3 = 1 then 'Open' else 'Done: dropped, see notes' end, ' |', chr(10),
       '| Started | 2024-0', cast(1 + doc_id % 9 as int), '-11 |', chr(10), case when doc_id % 4 = 0 then '' else '## Verdict' end, chr(10)) as card
from documents
"""
#: The option tape in UTC, New York market hours only: prints with conditions as text, on four fixed expiries (the first a Saturday; also after they have passed) and strikes five apart, priced on parity with a small error.
PRINTS = """
select event_id, ts, cast('2024-01-12' as date) + cast(7 * no + case when no = 0 then 1 else 0 end as int) as expiry, strike, call, size, conditions,
       exp(-5e-2 * t) * (greatest(case when call then spot * exp(5e-2 * t) - strike else strike - spot * exp(5e-2 * t) end, 0) + 4e-1 * spot * sqrt(t) * (2e-1 - 1e-1 * k + 8e-1 * k * k) * exp(-8 * k * k)) + (event_id % 7 - 3) / 1e2 as price
from (select *, ln(strike / spot) as k, greatest(12 + 7 * no - day(ts) + 5e-1, 2e-1) / 3.65e2 as t
      from (select event_id, ts - interval '1' second * secs + interval '1' second * cast(floor(52200 + secs * 2.7e-1) as int) as ts, user_id % 4 as no, spot, cast(floor(spot / 5) * 5 + (event_id * 7 % 9 - 4) * 5 as double) as strike,
                   event_id % 2 = 0 as call, cast(user_id % 9 + 1 as int) as size, case event_type when 'purchase' then '209' when 'view' then '219' when 'click' then '' when 'error' then 'x7' end as conditions
            from (select *, hour(ts) * 3600 + minute(ts) * 60 + cast(floor(second(ts)) as int) as secs, 600 + 8 * sin(event_id / 7e2) as spot from events e) a) b) c
"""
#: Ex-dividend days within the tape, from region.
EX_DAYS = "select cast('2024-01-08' as date) + cast(7 * r_regionkey as int) as ex_date, 1e-1 + 5e-2 * r_regionkey as amount from region g"
#: The range of each day's underlying, for the days of the tape.
DAY_RANGE = """
select cast(ts as date) as day, 600 + 8 * sin(min(event_id) / 7e2) as open, min(600 + 8 * sin(event_id / 7e2)) - 1 as low, max(600 + 8 * sin(event_id / 7e2)) - 5e-1 as high from events e group by cast(ts as date)
"""
#: A signal a day, from events.
SIGNALS = "select cast(ts as date) as day, case cast(sum(user_id) % 5 as int) when 0 then 'flat' when 1 then 'long' when 2 then 'long' else 'short' end as signal from events e group by cast(ts as date)"
#: Index levels with days that lack one or end early, as sources have them.
INDEX_GAPS = f"select date, case when year(date) < 1998 and day(date) % 3 > 0 then vix end as vix, case when day(date) % 4 > 0 then irx end as irx from ({INDICES}) i"
#: Labels of candidates, some still unknown; deltas picked for days, some without one.
LABELS = f"select day, name, case when name % 41 > 0 then label end as label from ({CANDIDATES}) c"
PICKS = f"select day, case when day(day) % 3 > 0 then day(day) % 4 * 1e-1 end as pick from ({SIGNALS}) s"
#: Candidates of a day with features, profit and the day on which it is known (some never are), and a skip for each day; from orders.
PANEL = """
select cast(o_orderdate as date) as day, o_orderkey as name, 0 as skip, cast(o_custkey * 37 % 101 as double) as x1, cast(o_orderkey * 13 % 89 as double) as x2, cast(substr(o_orderpriority, 1, 1) as double) as x3, cast(month(o_orderdate) as double) as x4,
       case when o_orderkey % 41 > 0 then (o_custkey * 37 % 101 - 50) * 2e1 + case when o_orderpriority like '1%' then (o_orderkey * 13 % 89 - 44) * 3e1 else 0e0 end + (o_totalprice - 2.5e5) / 4e2 end as pnl,
       cast(o_orderdate as date) + cast(o_orderkey % 30 as int) as close
from orders o
union all select distinct cast(o_orderdate as date), cast(0 as bigint), 1, -1e0, -1e0, -1e0, cast(month(o_orderdate) as double), 0e0, cast(o_orderdate as date) from orders p
"""
#: Closes of trips, some never reported (without a day), and trips with whether a broker's record has them.
CLOSES = f"select book, side, entry, trade, case when trade % 23 > 0 then exit end as exit from ({TRIPS}) t"
RECORDED = f"select *, trade % 5 > 0 as recorded from ({TRIPS}) t"
#: Log files of people, from documents: some blank, some without dated headings but with a month and a day in their name.
LOGS = """
select lang as owner, case doc_id % 3 when 0 then concat('log March ', cast(1 + doc_id % 28 as int)) when 1 then concat('December-', cast(1 + doc_id % 31 as int)) else 'notes' end as stem,
       case doc_id % 5 when 0 then chr(10) when 1 then concat('done', chr(10), '### 2024-01-01', chr(10)) else concat('## 2023-0', cast(1 + doc_id % 9 as int), '-11', chr(10), 'text ## 2025-01-01', chr(10), case when doc_id % 2 = 0 then concat('## 2024-01-', cast(10 + doc_id % 20 as int), ' more') else '' end) end as text
from documents
"""
#: Bars as a vendor sends them: its names, instants for days, rows without a price.
RAW_BARS = f"""
select symbol, cast(date as timestamp) + interval '5' hour as Stamp, open as P_Open, case when day(date) % 29 > 0 then high end as P_High, low as P_Low, case when day(date) % 31 > 0 then close end as P_Close, cast(floor(close * 10) as int) as P_Volume from ({BARS}) v
"""
