"""Queries over learned trees: a ranker walked forward with a gate, a pointwise model, a forest; and the same rows in SQL, which grows the same trees from the same whole-number sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, reports, trees
from ..operators.quantiles import quantiles
from ..operators.trees import SCALE, Growth
from ..sources import adapters as a
from ..sources.adapters import derived
from . import research, trades

XS = ["x1", "x2", "x3", "x4", "flag"]
YEARS = [1997, 1998, 1999, 2000]
CUTS = [0.1, 0.4, 0.6, 0.9]
RANK, ROUNDS = Growth(depth=2, least=30, damping=1.0, rate=0.3, bins=12), 6
POINT, POINT_ROUNDS = Growth(depth=2, least=20, damping=1.0, rate=0.3, bins=12), 6
WOOD, TREES = Growth(depth=3, least=20, bins=12), 30
TRADE_XS, DAY_XS = ["strike", "right", "sign", "mid0"], ["rv_d", "rv_w", "rv_m", "vix", "term"]


def bounds(year: int) -> tuple[str, str, str, str]:
    """A window's days: training ends, early stopping ends (and the gate's days begin), test begins, test ends."""
    return f"{year - 1}-04-01", f"{year - 1}-07-01", f"{year}-01-01", f"{year + 1}-01-01"


def _roles(day: Column, close: Column) -> Column:
    """For each window what a day is to it, as an array of (e, role): days of training, stopping and the gate must have closed before their span ends."""
    out = []
    for y in YEARS:
        stop, cal, lo, hi = (F.to_date(F.lit(d)) for d in bounds(y))
        role = F.when((day < stop) & (close < stop), "train").when((day >= stop) & (day < cal) & (close < cal), "early").when((day >= cal) & (day < lo) & (close < lo), "gate").when((day >= lo) & (day < hi), "test")
        out.append(F.when(role.isNotNull(), F.struct(F.lit(y).alias("e"), role.alias("role"))))
    return F.array_compact(F.array(*out))


def walked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[trees.Node], dict[int, int]]:
    """(rows of gate and test days with pred, the model, rounds by window): one ranker a window, learned from days that have closed before it."""
    rows = derived(spark, sf_dir, a.PANEL).withColumns({"flag": F.col("skip").cast("double"), "score": F.col("pnl") / 100})
    shut = rows.where("score is not null").groupBy("day").agg(F.max("close").alias("_close"), F.min("skip").alias("_any")).where("_any = 0")
    rows = rows.join(shut, "day", "left").withColumn("_w", F.explode(_roles(F.col("day"), F.col("_close")))).select("_w.*", "day", "name", "skip", *XS, "score", "pnl")
    rows = rows.where("role = 'test' or score is not null").persist()
    theta = quantiles(rows.where("role = 'train' and skip = 0"), ["e"], "score", CUTS)
    learn = rows.where("role in ('train', 'early')").join(theta, "e").withColumn("grade", sum(((F.col(f"q{i}") < F.col("score")).cast("int") for i in range(4)), F.lit(0)))
    nodes, rounds, _ = trees.rank_fit(learn.withColumn("early", F.col("role") == "early"), XS, ROUNDS, ROUNDS + 1, RANK)
    pred = trees.walk(nodes, XS, "e")
    return rows.where("role in ('gate', 'test')").withColumn("pred", pred), nodes, rounds


def _days(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranked days of gate and test, and the gates."""
    days = trees.ranked(rows, ["e", "role", "day"]).persist()
    return days, trees.confidence_gate(days.where("role = 'gate'"), ["e"])


def rank_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks of each test day: behind the gate, without it, and the best that is no skip (name 0)."""
    days, gates = _days(walked(spark, sf_dir)[0])
    rows = days.where("role = 'test'").join(gates.select("e", "tau"), "e")
    return rows.select("e", "day", F.when((F.col("top_skip") == 0) & (F.col("gap") >= F.col("tau")), F.col("top")).otherwise(0).alias("ltr"), F.col("top").alias("ltr_nogate"), F.coalesce("best", F.lit(0)).alias("ltr_noskip"), F.round("gap", 6).alias("gap"))


def rank_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By window: rounds of the best model, the gate, its days and those it trades."""
    rows, _, rounds = walked(spark, sf_dir)
    best = spark.createDataFrame(sorted(rounds.items()), "e int, rounds int")
    return _days(rows)[1].join(best, "e").select("e", "rounds", F.round("tau", 6).alias("tau"), "days", "traded", F.round("ratio", 6).alias("ratio"))


def gain_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the features in the gain of the rankers, mean over windows."""
    shares = trees.gains(walked(spark, sf_dir)[1], XS)
    return spark.createDataFrame([(x, round(v, 6)) for x, v in shares.items()], "feature string, share double")


def pick_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By year: the gate over picks by score; every fourth candidate is a skip, and profit is the label less a fixed level."""
    c = derived(spark, sf_dir, a.CANDIDATES)
    rows = c.select(F.year("day").alias("year"), "day", "name", (F.col("name") % 4 == 0).cast("int").alias("skip"), F.col("score").cast("double").alias("pred"), (F.col("label") - 2.4e5).alias("pnl"))
    gates = trees.confidence_gate(trees.ranked(rows, ["year", "day"]), ["year"])
    return gates.select("year", F.round("tau", 4).alias("tau"), "days", "traded", F.round("ratio", 6).alias("ratio"))


def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.round(F.coalesce("score", F.lit(0.0)), 4)
    return trades._slot_closed(spark, sf_dir).select("entry", "day0", "strike", F.col("call").cast("double").alias("right"), F.col("sign").cast("double").alias("sign"), F.round("mid0", 6).alias("mid0"), score.alias("score"))


def boosted_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each closed trade's score by pointwise boosted trees that learned from the first half of the days."""
    rows = _closed(spark, sf_dir)
    nodes, _ = trees.regress(rows, TRADE_XS, "score", F.col("day0") < F.to_date(F.lit("2024-01-10")), POINT_ROUNDS, POINT)
    return rows.select("entry", "day0", "score", F.round(trees.walk(nodes, TRADE_XS), 6).alias("predicted"))


def forest_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts by a forest that learned before 1997."""
    rows = research._features(spark, sf_dir).join(features.forward_target(derived(spark, sf_dir, a.BARS), 22), ["symbol", "date"]).where(" and ".join(f"{x} is not null" for x in DAY_XS))
    key = F.datediff("date", F.lit("1990-01-01")) * 5 + F.substring("symbol", 1, 1).cast("int")
    nodes, _ = trees.forest(rows, DAY_XS, "target", F.col("date") < F.to_date(F.lit("1996-12-01")), key, TREES, WOOD)
    return rows.select("symbol", "date", "target", F.round(trees.forest_mean(nodes, DAY_XS, TREES), 6).alias("predicted"))


QUERIES = {f.__name__: f for f in (rank_picks, rank_windows, gain_shares, pick_gate, boosted_ranks, forest_forecast)}


def _bins(source: str, known: str, xs: list[str], bins: int) -> tuple[str, str]:
    """CTE of the bounds of each feature, and the expression of a row's bins from it."""
    shares = ", ".join(repr(k / bins) for k in range(1, bins))
    return f"bd as materialized (select {', '.join(f'quantile_cont({x}, [{shares}]) as q_{x}' for x in xs)} from {source} where {known})", "[" + ", ".join(f"list_sum(list_transform(q_{x}, lambda t: coalesce(({x} > t)::int, 0)))::int" for x in xs) + "]"


def _round(r: int, growth: Growth, width: int, learn: str, scored: str) -> str:
    """CTEs that grow round r on the rows of CTE `scored` (e, id, bins, g, h, s, ss), learning from those with `learn`, and CTE s{r + 1} with its score added."""
    damping = growth.damping * SCALE
    parts, at, leaves = [], scored, []
    value = lambda g, h: f"{growth.rate} * ({g})::double / (({h})::double + {damping})"
    half = lambda g, h: f"({g})::double * ({g})::double / (({h})::double + {damping})"
    parts.append(f"n{r}_0 as (select *, 1 as n from {scored})")
    for k in range(growth.depth):
        parts.append(f"h{r}_{k} as (select e, n, f, b, sum(g) as g, sum(h) as h, count(*) as k from (select e, n, g, h, unnest(range({width})) as f, unnest(bins) as b from n{r}_{k} where ({learn}) and n >= {1 << k}) q group by all)")
        w = "(partition by e, n, f order by b)"
        parts.append(f"c{r}_{k} as materialized (select *, sum(g) over {w} as lg, sum(h) over {w} as lh, sum(k) over {w} as lk, sum(g) over (partition by e, n, f) as tg, sum(h) over (partition by e, n, f) as th, sum(k) over (partition by e, n, f) as tk from h{r}_{k})")
        gain = f"{half('lg', 'lh')} + {half('tg - lg', 'th - lh')} - {half('tg', 'th')}"
        parts.append(f"p{r}_{k} as materialized (select * from (select *, {gain} as gain from c{r}_{k} where lk >= {growth.least} and tk - lk >= {growth.least}) q where gain > 0 qualify row_number() over (partition by e, n order by gain desc, f, b) = 1)")
        parts.append(f"n{r}_{k + 1} as materialized (select x.* replace (case when p.n is null then x.n else 2 * x.n + (x.bins[p.f + 1] > p.b)::int end as n) from n{r}_{k} x left join p{r}_{k} p on p.e = x.e and p.n = x.n)")
        leaves += [f"select e, 2 * n as n, {value('lg', 'lh')} as v from p{r}_{k}", f"select e, 2 * n + 1, {value('tg - lg', 'th - lh')} from p{r}_{k}"]
    parts.append(f"v{r} as (select distinct e, n, {value('tg', 'th')} as v from c{r}_0 where f = 0 union all {' union all '.join(leaves)})")
    parts.append(f"s{r + 1} as materialized (select x.* exclude (g, h, n, s, ss), x.s + coalesce(v.v, 0) as s, list_append(x.ss, x.s + coalesce(v.v, 0)) as ss from n{r}_{growth.depth} x left join v{r} v on v.e = x.e and v.n = x.n)")
    return ",\n".join(parts)


def _lambdas(r: int) -> str:
    """CTE g{r} of gradients of the ranker on s{r}."""
    w, d = "(partition by e, day order by s desc, skip, name)", "(partition by e, day)"
    up = "grade > tgr"
    return f"""t{r} as (select *, row_number() over {w} = 1 as first, first_value(s) over {w} as ts, first_value(grade) over {w} as tgr, max(pow(2.0, grade) - 1) over {d} as ideal, pow(2.0, grade) - 1 as gain from s{r}),
u{r} as (select *, 1 / (1 + exp(case when {up} then s - ts else ts - s end)) as p, case when first or grade = tgr then 0 else abs(gain - (pow(2.0, tgr) - 1)) / ideal end as w from t{r}),
w{r} as (select *, (case when {up} then 1 else -1 end * floor(p * w * {SCALE} + 0.5))::bigint as g0, floor(p * (1 - p) * w * {SCALE} + 0.5)::bigint as h0 from u{r}),
g{r} as materialized (select * exclude (ts, tgr, p, w, g0, h0, first, gain, ideal), case when first then -sum(g0) over {d} else g0 end as g, case when first then sum(h0) over {d} else h0 end as h from w{r}),
j{r} as materialized (select e, {r} as r, sum(case when ideal > 0 then floor(gain / ideal * {SCALE} + 0.5)::bigint else {SCALE} end) as judged from t{r} where role = 'early' and first group by e)"""


def _gate(keys: str, days: str) -> str:
    """CTEs gq, gg, gs, gt: grid, days by threshold, sums, and the best threshold of each key."""
    deciles = ", ".join(str(k / 10) for k in range(1, 10))
    return f"""gq as (select {keys}, list_concat([0.0::double], quantile_cont(gap, [{deciles}])) as grid from {days} group by {keys}),
gg as (select {keys}, unnest(range(1, 11)) as i, unnest(grid) as tau from gq),
gs as (select {keys}, i, any_value(tau) as tau, count(*) as days, count(*) filter (where top_skip = 0 and gap >= tau) as traded, sum(case when top_skip = 0 and gap >= tau then coalesce(top_pnl, 0) else 0 end) as x, sum(case when top_skip = 0 and gap >= tau then pow(least(coalesce(top_pnl, 0), 0), 2) else 0 end) as d from {days} join gg using ({keys}) group by {keys}, i),
gu as (select *, (x / days) / (sqrt(d / days) + 1e-8) as q from gs), gv as (select *, case when abs(q) < 1000 then round(q, 9) else round(q, 0) end as ratio from gu),
gt as (select {keys}, tau, days, traded, ratio from gv qualify row_number() over (partition by {keys} order by ratio desc, tau) = 1)"""


def _ranked(keys: str, rows: str) -> str:
    """CTE rd: each day's first candidate, its lead and the best that is no skip."""
    w = f"(partition by {keys} order by pred desc, skip, name)"
    return f"""ro as (select *, row_number() over {w} as r, lead(pred) over {w} as next, first_value(case when skip = 0 then name end ignore nulls) over (partition by {keys} order by pred desc, skip, name rows between unbounded preceding and unbounded following) as best from {rows}),
rd as materialized (select {keys}, name as top, skip as top_skip, pnl as top_pnl, pred - coalesce(next, pred) as gap, best from ro where r = 1)"""


def _walked() -> str:
    spans = ", ".join("({}, date '{}', date '{}', date '{}', date '{}')".format(y, *bounds(y)) for y in YEARS)
    cte, bins = _bins("lr", "role = 'train'", XS, RANK.bins)
    rounds = ",\n".join(f"{_lambdas(r)},\n{_round(r, RANK, len(XS), chr(114) + 'ole = ' + repr('train'), f'g{r}')}" for r in range(ROUNDS))
    judged = " union all ".join(f"select * from j{r}" for r in range(1, ROUNDS + 1))
    return f"""pn as materialized (select *, skip::double as flag, pnl / 100 as score from ({a.PANEL}) z), sh as (select day, max(close) as shut from pn where score is not null group by 1 having min(skip) = 0),
wn(e, st, cal, lo, hi) as (values {spans}),
rl as (select wn.e, case when day < st and shut < st then 'train' when day >= st and day < cal and shut < cal then 'early' when day >= cal and day < lo and shut < lo then 'gate' when day >= lo and day < hi then 'test' end as role, pn.* from pn left join sh using (day) cross join wn),
lr as materialized (select * from rl where role = 'test' or role is not null and score is not null),
th as (select e, quantile_cont(score, {CUTS}) as th from lr where role = 'train' and skip = 0 group by 1), {cte},
s0 as materialized (select lr.e, role, day, name, skip, pnl, case when role in ('train', 'early') then list_sum(list_transform(th, lambda t: (t < score)::int))::int else 0 end as grade, {bins} as bins, 0.0::double as s, []::double[] as ss from lr join th using (e), bd),
{rounds},
{_lambdas(ROUNDS)},
bt as (select e, r as rounds from ({judged}) q qualify row_number() over (partition by e order by judged desc, r) = 1),
pr as (select s{ROUNDS}.*, ss[rounds] as pred from s{ROUNDS} join bt using (e) where role in ('gate', 'test')),
{_ranked('e, role, day', 'pr')}, gd as (select * from rd where role = 'gate'), {_gate('e', 'gd')}"""


def _gains() -> str:
    every = " union all ".join(f"select e, {r} as tree, n, f, gain from p{r}_{k}" for r in range(ROUNDS) for k in range(RANK.depth))
    return f"""with {_walked()}, gn as (select q.*, sum(gain) over (partition by e) as total from ({every}) q join bt using (e) where tree < rounds),
gf as (select e, f, sum(gain) / any_value(total) as share from gn group by 1, 2), ne as (select count(distinct e) as n from gf)
select x as feature, round(coalesce(sum(share), 0) / any_value(n), 6) as share from (select unnest({XS}) as x, unnest(range({len(XS)})) as i) v left join gf on gf.f = v.i, ne group by x"""


def oracles(exits: str, daily: str, target: str) -> dict[str, str]:
    """SQL of the queries above, on the CTEs of trade exits and the SQL of daily features and forward targets."""
    point_bins, point_row = _bins("kn", "day0 < date '2024-01-10'", TRADE_XS, POINT.bins)
    point = ",\n".join(f"g{r} as (select *, floor((y - s) * {SCALE} + 0.5)::bigint as g, {SCALE} as h from s{r}),\n{_round(r, POINT, len(TRADE_XS), 'learn', f'g{r}')}" for r in range(POINT_ROUNDS))
    wood_bins, wood_row = _bins("kn", "date < date '1996-12-01' and target is not null", DAY_XS, WOOD.bins)
    masked = f"list_transform(range({len(DAY_XS)}), lambda i: case when (i + t.t) % 3 = 2 then 0 else b[i + 1] end)"
    return {
        "rank_picks": f"with {_walked()} select rd.e, day, case when top_skip = 0 and gap >= tau then top else 0 end as ltr, top as ltr_nogate, coalesce(best, 0) as ltr_noskip, round(gap, 6) as gap from rd join gt using (e) where role = 'test'",
        "rank_windows": f"with {_walked()} select gt.e, rounds, round(tau, 6) as tau, days, traded, round(ratio, 6) as ratio from gt join bt using (e)",
        "gain_shares": _gains(),
        "pick_gate": f"""with pr as (select year(day)::int as year, day, name, (name % 4 = 0)::int as skip, score::double as pred, label - 2.4e5 as pnl from ({a.CANDIDATES}) c), {_ranked('year, day', 'pr')}, {_gate('year', 'rd')}
select year, round(tau, 4) as tau, days, traded, round(ratio, 6) as ratio from gt""",
        "boosted_ranks": f"""with {exits}, kn as (select entry, day0, strike, call::double as right_, call::double as "right", sign::double as sign, round(mid0, 6) as mid0, round(coalesce(case when downside > 0 then x.pnl / downside end, 0), 4) as score from x join (select distinct entry as e0, sign, mid0 from e) e on e.e0 = x.entry), {point_bins.replace('quantile_cont(right,', 'quantile_cont(right_,')},
s0 as materialized (select 0 as e, entry, day0, score as y, day0 < date '2024-01-10' as learn, {point_row.replace('(right > t)', '(right_ > t)')} as bins, 0.0::double as s, []::double[] as ss from kn, bd),
{point} select entry, day0, y as score, round(s, 6) as predicted from s{POINT_ROUNDS}""",
        "forest_forecast": f"""with f as ({daily}), fg as ({target}), kn as (select f.*, fg.target from f join fg using (symbol, date) where {' and '.join(f'{x} is not null' for x in DAY_XS)}), {wood_bins},
bb as (select symbol, date, target, {wood_row} as b, (date - date '1990-01-01') * 5 + substr(symbol, 1, 1)::int as key from kn, bd),
s0 as materialized (select t.t as e, symbol, date, target, coalesce(date < date '1996-12-01' and target is not null and (key * 7919 + t.t * 104729) % 1000 < 632, false) as learn, {masked} as bins, 0.0::double as s, []::double[] as ss from bb, range({TREES}) t(t)),
g0 as (select *, floor(coalesce(target, 0) * {SCALE} + 0.5)::bigint as g, {SCALE} as h from s0),
{_round(0, WOOD, len(DAY_XS), 'learn', 'g0')} select symbol, date, any_value(target) as target, round(sum(s) / {TREES}, 6) as predicted from s1 group by 1, 2""",
    }
