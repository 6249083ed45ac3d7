"""Gates, rates and histories: grouped aggregates over issues, conversions and charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEVERITIES = ("BLOCKER", "ERROR", "WARNING", "INFO")


def gate(issues: DataFrame, *keys: str) -> DataFrame:
    """For each object the number of issues of each severity, its status, and whether it can be published."""
    counts = [F.count_if(F.upper("severity") == s).alias(s.lower()) for s in SEVERITIES]
    status = F.when(F.col("blocker") > 0, "blocked").when(F.col("error") > 0, "needs_review").when(F.col("warning") > 0, "publicavel_com_avisos").otherwise("aprovado")
    return issues.groupBy(*keys).agg(*counts).withColumn("status", status).withColumn("publish", (F.col("blocker") == 0) & (F.col("error") == 0))


def conflicts(rows: DataFrame, key: str, latex: str, speech: str) -> DataFrame:
    """Keys whose occurrences differ: in LaTeX a blocker, in speech alone an error."""
    found = rows.groupBy(key).agg(F.count_distinct(latex).alias("latex_forms"), F.count_distinct(speech).alias("speech_forms"), F.count(F.lit(1)).alias("n"))
    return found.where("latex_forms > 1 OR speech_forms > 1").withColumn("severity", F.when(F.col("latex_forms") > 1, "BLOCKER").otherwise("ERROR"))


def statistics(history: DataFrame) -> DataFrame:
    """total, done, failed, mean_seconds of those done (one decimal)."""
    done = F.col("status") == "done"
    return history.agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("done"), F.count_if(F.col("status") == "error").alias("failed"), F.round(F.coalesce(F.avg(F.when(done, F.col("seconds"))), F.lit(0.0)), 1).alias("mean_seconds"))


def latest(history: DataFrame, limit: int = 10) -> DataFrame:
    """The newest conversions; `limit` is what is asked for."""
    return history.orderBy(F.desc("created_at"), "task_id").limit(limit)


def without_orphans(history: DataFrame, now, hours: int = 1) -> DataFrame:
    """Conversions in work for longer than `hours` before `now` become errors."""
    stale = (F.col("status") == "processing") & (F.col("created_at") < now - F.expr(f"INTERVAL {hours} HOURS"))
    return history.withColumn("error", F.when(stale, "Stale: process interrupted").otherwise(F.col("error"))).withColumn("status", F.when(stale, "error").otherwise(F.col("status")))


def expansion(rows: DataFrame, origin: str, output: str, *keys: str) -> DataFrame:
    """Words of the output by words of the origin, two decimals, 0 without origin; suspect above four."""
    words = lambda c: F.sum(F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")))
    sums = rows.groupBy(*keys).agg(words(F.col(origin)).alias("origin_words"), words(F.col(output)).alias("output_words"))
    ratio = F.when(F.col("origin_words") > 0, F.round(F.col("output_words") / F.col("origin_words"), 2)).otherwise(0.0)
    return sums.withColumn("ratio", ratio).withColumn("suspect", F.col("ratio") > 4)


def lost_words(origin: DataFrame, output: DataFrame) -> DataFrame:
    """origin, output: key, text. Share of the origin's distinct words that the output lacks; below 5 % ok, over 20 % an error."""
    words = lambda df: df.select("key", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("word")).distinct()
    had, has = words(origin), words(output).withColumn("has", F.lit(1))
    share = had.join(has, ["key", "word"], "left").groupBy("key").agg(F.count(F.lit(1)).alias("words"), F.count_if(F.col("has").isNull()).alias("lost"))
    loss = F.col("lost") / F.col("words")
    return share.withColumn("severity", F.when(loss > 0.20, "ERROR").when(loss >= 0.05, "WARNING").otherwise("OK"))


def extremes(points: DataFrame, *keys: str, order: str, label: str, value: str) -> DataFrame:
    """A chart's facts: highest and lowest points (the first of equals), rises and falls in order, trend, how many near the top."""
    w = W.partitionBy(*keys).orderBy(order)
    step = points.withColumn("before", F.lag(value).over(w)).withColumn("top", F.max(value).over(W.partitionBy(*keys)))
    up, down = F.count_if(F.col(value) > F.col("before")), F.count_if(F.col(value) < F.col("before"))
    facts = step.groupBy(*keys).agg(
        F.max_by(label, F.struct(F.col(value), -F.col(order))).alias("highest"), F.max(value).alias("high"), F.min_by(label, F.struct(F.col(value), F.col(order))).alias("lowest"), F.min(value).alias("low"),
        up.alias("rises"), down.alias("falls"), (F.count_if((F.col("top") > 0) & ((F.col("top") - F.col(value)) / F.col("top") <= 0.15)) - 1).alias("near_top"), F.count(F.lit(1)).alias("n"),
    )
    trend = F.when(F.col("n") < 2, "none").when(F.col("falls") == 0, "rises").when(F.col("rises") == 0, "falls").otherwise("varies")
    return facts.withColumn("trend", trend)


def positions(queue: DataFrame, order: str) -> DataFrame:
    """A task's place among those that wait, from 1: counts by arrival bucket, then within, so no partition holds all."""
    by_bucket = queue.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # one row a bucket
    before = by_bucket.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(W.partitionBy("bucket").orderBy(order))
    return queue.withColumn("own", own).join(before, "bucket").withColumn("position", F.col("own") + F.col("before")).drop("own", "before")
