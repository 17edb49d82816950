"""What a day or a slot says must not change when later rows are corrupted."""

from pyspark.sql import functions as F

from volmesh.operators import features, models, paths
from volmesh.sources import adapters as a
from volmesh.sources.adapters import derived

SF = "/root/testdata/sf0.001"


def same(x, y):
    assert x.count() > 0 and x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def test_daily_features(spark):
    bars, indices = derived(spark, SF, a.BARS), derived(spark, SF, a.INDICES)
    late = F.col("date") > F.to_date(F.lit("1997-01-01"))
    bad = bars.withColumns({c: F.when(late, F.col(c) * 7).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})
    before = lambda b: features.daily_features(b, indices.where("date <= '1997-01-01'")).where(~late)
    same(before(bars), before(bad))


def test_walk_forward(spark):
    rows = derived(spark, SF, a.BARS).select("symbol", "date", (F.col("close") % 7).alias("y"), (F.col("open") % 5).alias("a"), (F.col("high") % 3).alias("b"))
    bad = rows.withColumn("y", F.when(F.col("date") >= F.to_date(F.lit("1997-01-01")), F.lit(1e6)).otherwise(F.col("y")))
    fit = lambda r: models.walk_forward(r, ["symbol"], "y", "a", "b", 36, 2).where(f"month <= {1997 * 12 + 2}").select("symbol", "month", "n", *[F.round(c, 9) for c in ("intercept", "ba", "bb")])
    same(fit(rows), fit(bad))


def test_exits(spark):
    marks = derived(spark, SF, a.MARKS)
    late = F.col("day") > F.to_date(F.lit("2024-01-15"))
    bad = marks.withColumn("mid", F.when(late, F.col("mid") * 50).otherwise(F.col("mid")))
    done = lambda m: paths.exits(paths.path(paths.entries(m, 12), m, 5), 5, 0.5, 0.3).where("day0 <= '2024-01-10'").select("entry", "reason", "exit_id", F.round("pnl", 6), F.round("downside", 6))
    same(done(marks), done(bad))
