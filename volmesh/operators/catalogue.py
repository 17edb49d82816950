"""Research cards and trial runs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def card_fields(cards: DataFrame, text: str) -> DataFrame:
    """cards with title, owner, status, detail, started and stage, from markdown; what is missing is null."""
    cell = lambda name: F.nullif(F.regexp_extract(text, rf"(?m)^\|\s*{name}\s*\|\s*([^|]*?)\s*\|", 1), F.lit(""))
    state = cell("Status")
    rows = cards.withColumns({"title": F.nullif(F.regexp_extract(text, r"(?m)^# (.+)$", 1), F.lit("")), "owner": cell("Owner"), "status": F.split(state, ":")[0], "detail": F.nullif(F.trim(F.regexp_extract(state, ":(.*)$", 1)), F.lit("")), "started": F.to_date(cell("Started"))})
    judged = F.col(text).contains("## Verdict")
    return rows.withColumn("stage", F.when((F.col("status") == "Done") & judged, "judged").when(F.col("status") == "Done", "run").otherwise("planned"))


def team(fields: DataFrame) -> DataFrame:
    """owner, cards, judged, last: how many cards an owner has, how many have a verdict, and the latest start."""
    return fields.groupBy("owner").agg(F.count(F.lit(1)).alias("cards"), F.count(F.when(F.col("stage") == "judged", 1)).alias("judged"), F.max("started").alias("last"))


def work_logs(files: DataFrame, today: str) -> DataFrame:
    """owner, entries, last of log files (owner, stem, text): each heading `## yyyy-mm-dd` is an entry, a file without any is one, dated by its name (a month and a day: the latest such day up to `today`) if that tells; blank files are none."""
    heads = F.regexp_extract_all("text", F.lit(r"(?m)^## (\d{4}-\d{2}-\d{2})"), F.lit(1))
    year, month, day = int(today[:4]), F.regexp_extract("stem", r"([A-Z][a-z]+)[ _-](\d{1,2})", 1), F.regexp_extract("stem", r"([A-Z][a-z]+)[ _-](\d{1,2})", 2)
    named = lambda y: F.expr("try_to_timestamp(_d, 'yyyy MMMM d')") if y is None else F.concat_ws(" ", F.lit(str(y)), month, day)
    rows = files.where(F.regexp_replace("text", r"\s", "") != "").withColumn("_heads", heads)
    for i, y in enumerate((year, year - 1)):
        rows = rows.withColumn("_d", named(y)).withColumn(f"_n{i}", F.to_date(named(None)))
    name = F.when(F.col("_n0") <= F.to_date(F.lit(today)), F.col("_n0")).when(F.col("_n0").isNotNull(), F.col("_n1"))
    last = F.coalesce(F.array_max("_heads"), name.cast("string"))
    return rows.groupBy("owner").agg(F.sum(F.greatest(F.size("_heads"), F.lit(1))).cast("long").alias("entries"), F.max(last).alias("last"))


def split_names(runs: DataFrame) -> DataFrame:
    return runs.withColumns({"card": F.split("name", "/")[0], "variant": F.element_at(F.split("name", "/"), -1)})


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest run of each name and multiple, kept as one row a key on the map side."""
    rest = F.struct("run", "ran", "config", "pnl")
    return runs.groupBy("name", "multiple").agg(F.max_by(rest, F.struct("ran", "run")).alias("_r")).select("name", "multiple", "_r.*")


def equal_baseline(runs: DataFrame, base: str) -> DataFrame:
    """name, multiple, baseline: of each latest run the first run of the base card's with the same configuration and multiple; null without one."""
    first = runs.where(F.col("name").startswith(base)).groupBy("config", "multiple").agg(F.min_by("run", F.struct("ran", "run")).alias("baseline"))
    return latest_runs(runs).join(first, ["config", "multiple"], "left").select("name", "multiple", "run", "baseline")


def trial_counts(runs: DataFrame, until: str) -> DataFrame:
    """card, variants, trials, late: trials by card, and how many came after a date."""
    rows = split_names(runs)
    return rows.groupBy("card").agg(F.countDistinct("variant").alias("variants"), F.count(F.lit(1)).alias("trials"), F.count(F.when(F.col("ran") > F.to_date(F.lit(until)), 1)).alias("late"))


def holdout_used(runs: DataFrame, start: str) -> DataFrame:
    """card, runs, first, used: runs of each card on the hold-out (from `start` on), the first of them, and whether there is any."""
    late = F.col("ran") >= F.to_date(F.lit(start))
    return split_names(runs).groupBy("card").agg(F.count(F.when(late, 1)).alias("runs"), F.min(F.when(late, F.col("ran"))).alias("first"), F.bool_or(late).alias("used"))


def last_week(runs: DataFrame) -> DataFrame:
    """Runs, winners and the change of summed profit by card in the seven days up to its last run."""
    rows = split_names(runs)
    return rows.join(rows.groupBy("card").agg(F.max("ran").alias("_end")), "card").where("datediff(_end, ran) < 7").groupBy("card").agg(F.count(F.lit(1)).alias("runs"), F.sum("pnl").alias("change"))


def export(runs: DataFrame, bare: DataFrame, folder: str) -> None:
    """The trial registry as CSV: runs (name 'card/variant', run a path, multiple, pnl) and bare folders (card, run) of cards that have none, sorted and rounded to 4."""
    rows = runs.select(F.split_part("name", F.lit("/"), F.lit(1)).alias("card"), F.split_part("name", F.lit("/"), F.lit(2)).alias("variant"), F.element_at(F.split("run", "/"), -1).alias("run"), "multiple", F.round("pnl", 4).alias("pnl"))
    more = bare.join(rows.select("card").distinct(), "card", "left_anti").select("card", F.lit("").alias("variant"), "run")
    rows.unionByName(more, allowMissingColumns=True).orderBy("card", "variant", "run", "multiple").write.option("header", True).mode("overwrite").csv(folder)


def load_registry(spark: SparkSession, folder: str) -> DataFrame:
    """The registry with numbers as numbers; an empty text is null."""
    rows = spark.read.option("header", True).schema("card string, variant string, run string, multiple string, pnl string").csv(folder)
    return rows.withColumns({c: F.nullif(F.col(c), F.lit("")).try_cast("double") for c in ("multiple", "pnl")})


def totals(cards: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: cards, judged and planned ones, trials and variants."""
    stage = lambda s: F.count(F.when(F.col("stage") == s, 1))
    one = cards.agg(F.count(F.lit(1)).alias("cards"), stage("judged").alias("judged"), stage("planned").alias("planned"))
    return one.join(F.broadcast(runs.agg(F.count(F.lit(1)).alias("trials"), F.count_distinct("name").alias("variants"))))  # one row each
