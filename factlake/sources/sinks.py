"""Sinks: ledgers, manifests and traces as partitioned files, written once however often a batch comes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import remove, saved


def write_ledger(rows: DataFrame, path: str, by: str = "entity", form: str = "parquet", tasks: int = 8) -> None:
    """Appends rows under a folder for each value of `by`; those of one value are dealt over so many tasks, and files, at most."""
    named = rows.withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit("unknown")))
    salt = F.pmod(_hash(named), F.lit(tasks))
    named.repartition(by, salt).write.mode("append").partitionBy(by).format(form).save(path)


def _hash(rows: DataFrame):
    """A hash of a whole row, maps included."""
    return F.xxhash64(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}))


def _mark(rows: DataFrame) -> tuple[int, str]:
    """(rows, checksum), whatever the order of the rows."""
    whole = _hash(rows)
    found = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(whole.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum")).first()
    return found["n"], found["sum"]


def batches(spark, path: str, form: str = "parquet") -> DataFrame:
    """(batch, n, checksum, form) of the batches that a sink has finished."""
    schema = "n long, checksum string, form string, batch long"
    try:
        return spark.read.schema(schema).parquet(f"{path}/batches")
    except Exception as error:  # noqa: BLE001 - the first batch finds no folder
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def write_batch(rows: DataFrame, batch: int, path: str, by: str = "entity", form: str = "parquet", tasks: int = 8) -> bool:
    """Writes a batch under path/rows/batch=<batch>/<by>=<value>; False where it had been finished with the same rows.

    Rows replace what the batch has written before, partition by partition (dynamic overwrite), and
    what an earlier try of the batch left in other partitions is not listed by read_batches(),
    which takes only rows of the finished try. A row of the batch ledger is written last, so a try
    that dies in between is repeated in full.
    """
    spark = rows.sparkSession
    held = saved(rows)  # a batch is computed once, for its checksum and its rows
    n, checksum = _mark(held)
    done = batches(spark, path).where(F.col("batch") == batch).first()
    if done is not None and (done["n"], done["checksum"]) == (n, checksum):
        remove(held)
        return False
    named = held.withColumns({"batch": F.lit(batch).cast("long"), by: F.coalesce(F.col(by).cast("string"), F.lit("unknown")), "batch_checksum": F.lit(checksum)})
    salt = F.pmod(_hash(held), F.lit(tasks))
    named.repartition(by, salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", by).format(form).save(f"{path}/rows")
    ledger = spark.createDataFrame([(n, checksum, form, batch)], "n long, checksum string, form string, batch long")
    ledger.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/batches")
    remove(held)
    return True


def batch_sink(path: str, by: str = "entity", form: str = "parquet") -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: each batch once, also when a restarted stream brings it again."""

    def write(rows: DataFrame, batch: int) -> None:
        write_batch(rows, batch, path, by, form)

    return write


def read_batches(spark, path: str, schema: str, by: str = "entity", form: str = "parquet") -> DataFrame:
    """(*, batch): the rows of finished batches. schema: that of the rows, `by` a string."""
    rows = spark.read.schema(f"{schema}, batch_checksum string, batch long").format(form).load(f"{path}/rows")
    done = batches(spark, path).select(F.col("batch").alias("done"), "checksum")
    return rows.join(done, (F.col("batch") == F.col("done")) & (F.col("batch_checksum") == F.col("checksum"))).drop("done", "checksum", "batch_checksum")


def write_manifest(ledger: DataFrame, run: int, path: str) -> bool:
    """A JSON line for each entity of a validation ledger (entity, sheet, status, detail boolean), once for each run.

    status ok, closed, mismatch, withheld or missing; detail rows don't block. production_ready:
    no headline row fails; fully_reconciled: no row fails. Sheets with failing details are listed.
    """
    fails = ~F.coalesce(F.col("status").isin("ok", "closed"), F.lit(False))
    rows = ledger.groupBy("entity").agg(
        F.count("*").alias("rows"), F.count(F.when(fails & ~F.col("detail"), 1)).alias("validation_failures"), F.count(F.when(fails & F.col("detail"), 1)).alias("detail_incomplete"),
        F.count(F.when(F.col("status") == "withheld", 1)).alias("withheld"), F.sort_array(F.collect_set(F.when(fails & F.col("detail"), F.col("sheet")))).alias("detail_incomplete_sheets"),
    )
    rows = rows.withColumns({"production_ready": F.col("validation_failures") == 0, "fully_reconciled": (F.col("validation_failures") + F.col("detail_incomplete")) == 0})
    return write_batch(rows, run, path, "entity", "json")


def write_traces(traces: DataFrame, run: int, path: str, folders: int = 64) -> bool:
    """Traces (trace_id, *) as JSON lines, once for each run, in a bounded number of folders by a hash of the id."""
    return write_batch(traces.withColumn("folder", F.pmod(F.xxhash64("trace_id"), F.lit(folders))), run, path, "folder", "json")
