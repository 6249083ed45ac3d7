"""History, page texts and cache as append-only tables; what holds now is a view on the latest entry of a key.

Appending never rewrites a file, so writers needn't wait for each other; compaction is an overwrite with the view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "conversions": "task_id string, file string, extension string, size_bytes bigint, mode string, pipeline string, status string, seconds double, error string, summary string, created_at timestamp, finished_at timestamp",
    "ocr_raw": "task_id string, page_number int, text string, origin string, created_at timestamp",
    "ocr_revised": "task_id string, page_number int, text string, model string, created_at timestamp",
    "ocr_translated": "task_id string, page_number int, text string, model string, created_at timestamp",
    "cache": "key string, payload string, stored_at timestamp",
    "removed": "task_id string, removed_at timestamp",
}


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def append(self, name: str, rows: DataFrame) -> None:
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        filled = rows.withColumns({c: F.lit(None) for c in columns if c not in rows.columns})
        schema = self.spark.createDataFrame([], TABLES[name]).schema
        filled.select(*(F.col(f.name).cast(f.dataType) for f in schema)).write.mode("append").parquet(f"{self.folder}/{name}")

    def read(self, name: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}")

    def conversions(self) -> DataFrame:
        """A row a task: its first entry, with the outcome of its last finished one."""
        finished = F.col("finished_at").isNotNull()
        outcome = F.max_by(F.struct("pipeline", "status", "seconds", "error", "summary", "finished_at"), F.when(finished, F.col("finished_at")))
        begun = F.min_by(F.struct("file", "extension", "size_bytes", "mode", "created_at"), F.when(~finished, F.col("created_at")))
        now = self.read("conversions").groupBy("task_id").agg(begun.alias("b"), outcome.alias("o"))
        return now.select("task_id", "b.*", "o.pipeline", F.coalesce("o.status", F.lit("processing")).alias("status"), "o.seconds", "o.error", "o.summary", "o.finished_at")

    def pages(self, name: str) -> DataFrame:
        """Page texts of tasks that weren't removed since, in order of pages within tasks when written or shown."""
        gone = self.read("removed").groupBy("task_id").agg(F.max("removed_at").alias("removed_at"))
        rows = self.read(name).join(gone, "task_id", "left")
        return rows.where(F.col("removed_at").isNull() | (F.col("created_at") > F.col("removed_at"))).drop("removed_at")

    def cached(self, keys: DataFrame, seconds: int, now) -> DataFrame:
        """keys: key. Each key's latest payload if it is younger than `seconds`."""
        latest = self.read("cache").groupBy("key").agg(F.max_by("payload", "stored_at").alias("payload"), F.max("stored_at").alias("stored_at"))
        return keys.join(latest.where(F.col("stored_at") > now - F.expr(f"INTERVAL {seconds} SECONDS")), "key")
