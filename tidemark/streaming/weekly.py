"""Running weekly catch as report files land."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Report weeks run Monday to Sunday; the epoch began on a Thursday (fixed value).
WEEK_START = "4 days"


def stream_files(spark: SparkSession, folder: str, schema, fmt: str = "parquet", glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def weekly_totals(df: DataFrame, ts: Column, zone: Column, catch: Column, late: str | None = None) -> DataFrame:
    """Catch by week and zone.

    On a stream every correction is merged in, however late: the state is one
    row per week and zone. `late` bounds that state, at the price of dropping
    corrections older than it.
    """
    rows = df.select(ts.cast("timestamp").alias("ts"), zone.alias("zone"), catch.alias("catch"))
    if df.isStreaming and late is not None:
        rows = rows.withWatermark("ts", late)
    week = F.window("ts", "7 days", startTime=WEEK_START)
    out = rows.groupBy(week.alias("w"), "zone").agg(F.sum("catch").alias("catch"), F.count(F.lit(1)).alias("reports"))
    return out.select(F.col("w.start").cast("date").alias("week_start"), "zone", "catch", "reports")


# Layout of a merged table: one folder per micro-batch, folds of all batches up to
# one, and an empty marker per finished fold, which makes that fold valid.
BATCH, FOLD, MARK = "batches/batch=", "folds/upto=", "manifest/upto="


def _numbers(spark: SparkSession, target: str, kind: str) -> list[int]:
    """Numbers of the batches, folds or markers that exist, in order."""
    folder, prefix = kind.split("/")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{target}/{folder}")
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))


def _drop(spark: SparkSession, target: str, kind: str, numbers: list[int]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for n in numbers:
        at = jvm.org.apache.hadoop.fs.Path(f"{target}/{kind}{n}")
        at.getFileSystem(conf).delete(at, True)


def _newest(spark: SparkSession, target: str, below: int | None = None) -> DataFrame | None:
    """Newest value of every week and zone from the last fold and the batches after it."""
    folded = [n for n in _numbers(spark, target, MARK) if below is None or n < below]
    upto = folded[-1] if folded else -1
    later = [n for n in _numbers(spark, target, BATCH) if n > upto and (below is None or n < below)]
    paths = [f"{target}/{FOLD}{upto}"] * bool(folded) + [f"{target}/{BATCH}{n}" for n in later]
    if not paths:
        return None
    return (
        spark.read.parquet(*paths)
        .groupBy("week_start", "zone")
        .agg(F.max_by(F.struct("catch", "reports", "number"), "number").alias("r"))
        .select("week_start", "zone", "r.*")
    )


def fold(spark: SparkSession, target: str, below: int) -> None:
    """Fold all batches below a number into one table, then drop what the fold before held.

    Only for batches that cannot run again. The fold counts once its marker exists; one
    that failed before is written over. The fold before it and the batches after that one
    stay until the next fold, so a reader that listed them can finish.
    """
    marked = _numbers(spark, target, MARK)
    if marked and marked[-1] >= below - 1:
        return
    newest = _newest(spark, target, below)
    if newest is None:
        return
    newest.write.mode("overwrite").parquet(f"{target}/{FOLD}{below - 1}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    mark = jvm.org.apache.hadoop.fs.Path(f"{target}/{MARK}{below - 1}")
    mark.getFileSystem(conf).create(mark, True).close()
    if marked:
        _drop(spark, target, BATCH, [n for n in _numbers(spark, target, BATCH) if n <= marked[-1]])
        _drop(spark, target, MARK, marked[:-1])
        _drop(spark, target, FOLD, [n for n in _numbers(spark, target, FOLD) if n < marked[-1]])


def merge_batch(batch: DataFrame, batch_id: int, target: str, fold_every: int = 20) -> None:
    """Write the changed weeks of one micro-batch; every `fold_every` batches fold those before it.

    A batch overwrites its own folder, so a batch that runs again after a failure leaves
    one copy. When a batch runs, all earlier ones are finished, so folds hold only those.
    """
    batch.withColumn("number", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{target}/{BATCH}{batch_id}")
    if batch_id and batch_id % fold_every == 0:
        fold(batch.sparkSession, target, batch_id)


def run_to_table(stream: DataFrame, target: str, checkpoint: str, fold_every: int = 20) -> None:
    """Process all files present, merging changed weeks per micro-batch."""
    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(lambda batch, batch_id: merge_batch(batch, batch_id, target, fold_every))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The newest value of every week and zone.

    Reads the last fold and at most twice `fold_every` batches, however many were written.
    """
    df = _newest(spark, target)
    if df is None:
        raise ValueError(f"no batch has been written to {target}")
    return df.drop("number")
