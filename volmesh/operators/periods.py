"""Tables by named period: windows of time, checks and verdicts, tails, crash windows, fees, forecasts, picks, activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles
from .reports import daily, net

Period = tuple[str, str | None, str | None]


def in_periods(rows: DataFrame, periods: list[Period], date: str) -> DataFrame:
    """A copy of each row for each period (name, from, to) that holds its date, as column `period`: from is inside, to is not, None is an open end.

    Periods are a few literals, so a row grows into a bounded number of rows without a join; a row without a date is in none, and periods may overlap."""

    def name(n: str, lo: str | None, hi: str | None) -> Column:
        inside = F.col(date).isNotNull()
        inside = inside & (F.col(date) >= F.to_date(F.lit(lo))) if lo else inside
        inside = inside & (F.col(date) < F.to_date(F.lit(hi))) if hi else inside
        return F.when(inside, F.lit(n))

    return rows.withColumn("period", F.explode(F.filter(F.array(*[name(*p) for p in periods]), lambda n: n.isNotNull())))


def period_checks(table: DataFrame, keys: list[str], book: str, reference: str, bars: list[tuple[str, str, float, str]], rules: dict) -> DataFrame:
    """keys, book, period, metric, rule, ok of every book but the reference: bars are (metric, rule, bound, period). A metric that is unknown fails; a period that the reference lacks has no rows."""
    metrics = sorted({m for m, *_ in bars})
    ref = table.where(F.col(book) == reference).select(*keys, "period", F.struct(*metrics).alias("_ref"))
    rows = table.where(F.col(book) != reference).join(ref, [*keys, "period"])
    one = lambda m, r, x, p: F.when(F.col("period") == p, F.struct(F.lit(m).alias("metric"), F.lit(r).alias("rule"), F.coalesce(rules[r](F.col(m), F.col(f"_ref.{m}"), F.lit(x)), F.lit(False)).alias("ok")))
    each = F.explode(F.filter(F.array(*[one(*b) for b in bars]), lambda e: e.isNotNull()))
    return rows.select(*keys, book, "period", each.alias("_e")).select(*keys, book, "period", "_e.*")


def verdicts(checks: DataFrame, keys: list[str], events: DataFrame, least: int) -> DataFrame:
    """keys, n, verdict: inconclusive where events (keys, n) counts fewer than `least` or nothing, else passed if all checks are ok, else failed."""
    n = F.coalesce(F.col("n"), F.lit(0).cast("long"))
    said = F.when(n < least, "inconclusive").when(F.col("_ok"), "passed").otherwise("failed")
    return checks.groupBy(*keys).agg(F.bool_and("ok").alias("_ok")).join(events, keys, "left").select(*keys, n.alias("n"), said.alias("verdict"))


def tails(trips: DataFrame, units: Column) -> DataFrame:
    """book, q5, shortfall, trough, most: the lower quantile of daily profit, the mean of the days at or below it, the day on which the summed profit lies farthest below its peak of at least 0 (the first of equals), and the most units of one trip."""
    days = daily(trips)  # a row a book and day
    w = Window.partitionBy("book").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    down = days.withColumn("_sum", F.sum("pnl").over(w)).withColumn("_down", F.greatest(F.max("_sum").over(w), F.lit(0.0)) - F.col("_sum"))
    cut = quantiles(days, ["book"], "pnl", [0.05])
    out = down.join(cut, "book").groupBy("book").agg(F.first("q0").alias("q5"), F.avg(F.when(F.col("pnl") <= F.col("q0"), F.col("pnl"))).alias("shortfall"), F.min_by("date", F.struct(-F.col("_down"), F.col("date"))).alias("trough"))
    return out.join(trips.groupBy("book").agg(F.max(units).alias("most")), "book")


def window_sums(trips: DataFrame, windows: list[Period], units: Column) -> DataFrame:
    """book, period, entries, units, most, net of the trips that enter in a window, and `daily`, the profit booked on its days; 0 where there is none of either kind."""
    opened = in_periods(trips.withColumn("_u", units), windows, "entry").groupBy("book", "period").agg(F.count(F.lit(1)).alias("entries"), F.sum("_u").alias("units"), F.max("_u").alias("most"), F.sum(net()).alias("net"))
    booked = in_periods(daily(trips), windows, "date").groupBy("book", "period").agg(F.sum("pnl").alias("daily"))
    both = opened.join(booked, ["book", "period"], "full_outer")
    return both.na.fill(0, ["entries"]).na.fill(0.0, ["units", "most", "net", "daily"])


def fees_by_period(orders: DataFrame, periods: list[Period], date: str, units: str, plans: dict[str, Column], small: float) -> DataFrame:
    """book, period, orders, under, a column for each plan: orders, the share of them under `small` units, and what they would have cost by each plan, in hundredths of a cent and summed as decimals, so that the order of orders doesn't matter."""
    costs = [F.sum(F.round(c, 4).cast("decimal(20,4)")).cast("double").alias(n) for n, c in plans.items()]
    return in_periods(orders, periods, date).groupBy("book", "period").agg(F.count(F.lit(1)).alias("orders"), F.avg((F.abs(units) < small).cast("double")).alias("under"), *costs)


def forecast_scores(scored: DataFrame, calm: Column) -> DataFrame:
    """name, period, days, calm_days, loss, bias, calm_bias of rows (name, period, loss, bias): mean loss, and median bias of all days and of calm ones."""
    keys = ["name", "period"]
    sums = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("days"), F.count(F.when(calm, 1)).alias("calm_days"), F.avg("loss").alias("loss"))
    middle = lambda rows, n: quantiles(rows, keys, "bias", [0.5]).withColumnRenamed("q0", n)
    return sums.join(middle(scored, "bias"), keys).join(middle(scored.where(calm), "calm_bias"), keys, "left")


def pick_books(candidates: DataFrame, day: str, score: str, name: str, fixed: float) -> DataFrame:
    """book, year, mean, n: the labels of each day's best score (of equals the first by name), of the candidate whose score is nearest to a fixed one, and the best in hindsight. One aggregation a day finds all three; a day whose choice has no label counts 0."""
    first = F.max_by("label", F.struct(F.col(score), -F.col(name)))
    near = F.min_by("label", F.struct(F.abs(F.col(score) - fixed), F.col(name)))
    days = candidates.groupBy(day).agg(first.alias("picked"), near.alias("fixed"), F.max("label").alias("hindsight"))
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("book"), F.coalesce(F.col(b), F.lit(0.0)).alias("_v")) for b in ("picked", "fixed", "hindsight")])).alias("_e")
    return days.select(F.year(day).alias("year"), each).select("year", "_e.*").groupBy("book", "year").agg(F.avg("_v").alias("mean"), F.count(F.lit(1)).alias("n"))


def missing_months(rows: DataFrame, keys: list[str], day: str) -> DataFrame:
    """keys, month: months (their first days) between the first and the last of the whole table in which a key has no row. The table's months are one row."""
    have = rows.where(F.col(day).isNotNull()).select(*keys, F.trunc(day, "month").alias("month")).distinct()
    span = have.agg(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month")).alias("_all"))
    seen = have.groupBy(*keys).agg(F.collect_set("month").alias("_seen"))  # at most one entry a month
    return seen.join(F.broadcast(span)).select(*keys, F.explode(F.array_except("_all", "_seen")).alias("month"))


def calendar_prices(chain: DataFrame, keys: list[str]) -> DataFrame:
    """keys, strike, call, near, far, net, closing of a reverse calendar: the nearest expiry bought and the farthest sold at one strike that both have, at their mids (of several prints the last); `closing` is the same legs with turned signs."""
    ends = chain.groupBy(*keys).agg(F.min("dte").alias("near"), F.max("dte").alias("far")).where("near < far")
    rows = chain.where("mid is not null").join(ends, keys).where("dte = near or dte = far")
    price = lambda e: F.max_by("mid", F.when(F.col("dte") == F.col(e), F.col("event_id")))
    legs = rows.groupBy(*keys, "near", "far", "strike", "call").agg(price("near").alias("_n"), price("far").alias("_f"), F.count_distinct("dte").alias("_k")).where("_k = 2")
    return legs.select(*keys, "strike", "call", "near", "far", (F.col("_n") - F.col("_f")).alias("net"), (F.col("_f") - F.col("_n")).alias("closing"))


def at_entry(trades: DataFrame, chain: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """trades with columns of the last row of their contract in the snapshot of their entry; null without one. The chain keeps one row a key on the map side before it is joined."""
    last = chain.groupBy(*keys).agg(F.max_by(F.struct(*columns), "event_id").alias("_c"))
    return trades.join(last, keys, "left").select(*trades.columns, *[F.col(f"_c.{c}").alias(c) for c in columns])


def in_session(rows: DataFrame, wall: Column, first: int, last: int) -> DataFrame:
    """Rows whose wall clock lies between two minutes of a day, both inside."""
    return rows.where((F.hour(wall) * 60 + F.minute(wall)).between(first, last))


def activity(table: DataFrame, kind: str, day: str, end: str, days: int = 7) -> DataFrame:
    """kind, n: a row that counts a table's rows in the `days` days up to an end date, which is inside."""
    last = F.to_date(F.lit(end))
    return table.where((F.col(day) > F.date_sub(last, days)) & (F.col(day) <= last)).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).cast("double").alias("n"))
