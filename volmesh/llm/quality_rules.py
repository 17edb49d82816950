"""Quality rules, with DataFrame functions only: counts of each text, and a log-likelihood ratio of its hashed n-grams.

Single words and word pairs are hashed into a fixed number of buckets. Two multinomials over the buckets are counted: one over the
trusted target (texts labelled good), one over the whole raw corpus. A text's score is the mean logarithm of their ratio over its
n-grams, and every text is kept or rejected by one fixed threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, text_hash, whole

BUCKETS = 8192
#: Mean log ratio below which a text is rejected.
THRESHOLD = -0.12
SPACE = " \t\n\x0b\f\r"
#: Positions are packed under hashes with so many bits; texts of more words take a slower sort.
POSITION_BITS = 24


def words(text: Column) -> Column:
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(F.length(inner) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def _with_repeated(rows: DataFrame) -> DataFrame:
    """rows with _at: sorted positions of the hashes in _triples that occur twice or more. Each step is a column, as a lambda must not hold the step before it."""
    low = (1 << POSITION_BITS) - 1
    high = lambda x: F.shiftright(x, POSITION_BITS)
    near = lambda k, x: F.coalesce(high(F.get("_packed", k)) == high(x), F.lit(False))
    same = lambda k, x: F.coalesce(F.get("_exact", k)["h"] == x["h"], F.lit(False))
    any_ = F.size(F.array_distinct("_triples")) < F.size("_triples")
    rows = rows.withColumn("_packed", F.when(any_, F.sort_array(F.transform("_triples", lambda h, i: F.shiftleft(high(h), POSITION_BITS).bitwiseOR(i.cast("long"))))))
    maybe = F.transform(F.filter("_packed", lambda x, i: near(i - 1, x) | near(i + 1, x)), lambda x: x.bitwiseAND(F.lit(low)).cast("int"))
    rows = rows.withColumn("_maybe", F.when(F.size("_triples") <= low, maybe).when(F.col("_packed").isNotNull(), F.sequence(F.lit(0), F.size("_triples") - 1)))
    rows = rows.withColumn("_exact", F.sort_array(F.transform("_maybe", lambda p: F.struct(F.get("_triples", p).alias("h"), p.alias("p")))))
    at = F.sort_array(F.transform(F.filter("_exact", lambda x, i: same(i - 1, x) | same(i + 1, x)), lambda x: x["p"]))
    return rows.withColumn("_at", F.coalesce(at, F.array().cast("array<int>"))).drop("_packed", "_maybe", "_exact")


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and _row, a number of the row.

    Filters on these columns stop at the row number: pushed further, each would bring the folds over words with it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("_words", words(F.col(text_col)))
    lines = F.transform(F.filter(F.split(text, "\n"), lambda s: F.length(F.trim(s, F.lit(SPACE))) > 0), lambda s: F.xxhash64(s))
    out = out.withColumn("_lines", lines).withColumn("n_words", F.size("_words").cast("long"))
    triples = F.transform(F.col("_words"), lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    out = out.withColumn("_triples", F.when(F.col("n_words") >= 3, F.slice(triples, 1, F.greatest(F.size("_words") - 2, F.lit(1)))).otherwise(F.array().cast("array<bigint>")))
    out = _with_repeated(out)
    covered = F.aggregate(F.sequence(F.lit(1), F.size("_at") - 1), F.lit(3).cast("long"), lambda a, j: a + F.least(F.lit(3), F.get("_at", j) - F.get("_at", j - 1)))
    out = (
        out.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.when(F.size("_at") > 1, covered).otherwise(F.lit(0)).cast("long"))
    )
    return out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")).drop("_lines", "_triples", "_at").withColumn("_row", F.monotonically_increasing_id())


def _pairs(rows: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each word, with the buckets of the word (_one) and of it and the next (_two, null after the last); one row of nulls for a text without words."""
    zipped = F.arrays_zip(F.col("_words").alias("a"), F.slice("_words", 2, F.greatest(F.size("_words"), F.lit(1))).alias("b"))
    each = rows.select(*keep, F.explode_outer(zipped).alias("_p"))
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    one = F.when(F.col("_p.a").isNotNull(), bucket(F.xxhash64("_p.a")))
    two = F.when(F.col("_p.b").isNotNull(), bucket(F.xxhash64("_p.a", "_p.b", F.lit(2))))
    return each.select(*keep, one.alias("_one"), two.alias("_two"))


def ratios(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """log(target / raw) of every bucket, as an array constant. Raw counts are over all texts, target counts over all trusted ones; without any trusted text all ratios are 0."""
    ids = trusted_ids.select(F.col(id_col).cast("long").alias("_id")).where("_id is not null").distinct().withColumn("_t", F.lit(1))
    # a merge join at every size: neither the ids nor their number decide how it runs
    known = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(ids.hint("merge"), "_id", "left").select("_t", words(F.col("_text")).alias("_words"))
    grams = _pairs(known, ["_t"]).select("_t", F.explode(F.array("_one", "_two")).alias("b")).where("b is not null")
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("_t").alias("target"))
    every = docs.sparkSession.range(0, BUCKETS, 1, 1).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").select("b", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("raw", "target")])
    one = every.groupBy().agg(F.sum("raw").alias("R"), F.sum("target").alias("T"), F.sort_array(F.collect_list(F.struct("b", "raw", "target"))).alias("all"))
    value = F.transform("all", lambda x: F.when(F.col("T") == 0, F.lit(0.0)).otherwise(F.log((x["target"] + 1) / (F.col("T") + BUCKETS)) - F.log((x["raw"] + 1) / (F.col("R") + BUCKETS))))
    # one row of BUCKETS numbers
    return F.from_json(F.lit(one.select(F.to_json(value)).first()[0]), "array<double>")


def quality_rules(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """For each row of docs: the id, th (hash of the text), the counts of base_counts, log_ratio (mean over the text's n-grams; 0 without words) and kept.

    kept is false where base_failed, else log_ratio >= threshold. Null texts have no words. Repeated rows and rows that share an id each get
    their own row; a null id is a row like others. An empty table gives an empty table. Texts may be of any length; those of 2**24 words or more take a slower sort.
    Other columns of docs are not read. trusted_ids: a column named as id_col; more columns, repeated ids and ids without text don't matter.
    """
    ratio = ratios(docs, trusted_ids, id_col, text_col)
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    slim = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"), th.alias("th"))
    keep = ["_row", "_doc", "th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    grams = _pairs(base_counts(slim, "_text"), keep).select(*keep, "_one", "_two").withColumn("_r", ratio)
    total = F.sum(F.coalesce(F.get("_r", F.col("_one")), F.lit(0.0)) + F.coalesce(F.get("_r", F.col("_two")), F.lit(0.0)))
    scored = grams.groupBy(*keep).agg(total.alias("_sum"), (F.count("_one") + F.count("_two")).alias("_n"))
    mean = F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n")).otherwise(0.0)
    return scored.withColumn("log_ratio", mean).select(F.col("_doc").alias(id_col), "th", *keep[3:], "log_ratio", (~F.col("base_failed") & (F.col("log_ratio") >= threshold)).alias("kept"))


def keep_good(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that quality_rules keeps, as they are, whatever their columns' names; repeated rows stay or go together. Null and empty texts go (too few words)."""
    good = quality_rules(docs, trusted_ids, id_col, text_col, threshold).where("kept").select(F.col(id_col).alias("id"), "th").distinct()
    rows = docs.select(F.col(id_col).alias("own_id"), text_hash(F.col(text_col)).alias("own_th"), whole(docs).alias("row"))
    return rows.join(good, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_th") == F.col("th")), "left_semi").select("row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")).drop("th")
