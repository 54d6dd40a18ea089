"""15-minute bars from an event stream, keyed upserts and once-per-key writes."""
from pyspark.sql import functions as F

from barloom.operators.upserts import keep_last
from barloom.sources.bindings import order_key


def event_stream(spark, directory, glob, schema, files_per_batch=None):
    """Parquet files of a folder as a stream of (symbol, ts, price, event_id)."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(directory).select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") + 1).alias("price"), "event_id")


def fold_events(events, width="15 minutes"):
    """Open, high, low, close and count per symbol and time slot."""
    keyed = events.withColumn("seq", order_key("unix_micros(ts)", "event_id", 18))
    return keyed.groupBy(F.window("ts", width).alias("slot"), "symbol").agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"), F.count("*").cast("double").alias("volume"))


def stream_bars(events, sink, checkpoint, late="10 minutes", width="15 minutes"):
    """Write the bars of all slots the watermark has closed; returns when the input is used up."""
    bars = fold_events(events.withWatermark("ts", late), width).select(
        "symbol", F.col("slot.start").alias("ts"), "open", "high", "low", "close", "volume")
    query = (bars.writeStream.outputMode("append").format("parquet").option("path", sink)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def upsert_stream(rows, keys, sink, checkpoint, order="event_id"):
    """Keep the row of the largest ``order`` of every key in a table that each micro-batch replaces.

    A late row of a smaller order does not replace a stored one; of equal orders the later batch wins. A batch writes version ``batch id + 1`` from the version before it, so a batch
    that runs again after a failure writes the same version again.
    """
    def apply(batch, batch_id):
        spark = batch.sparkSession
        cols = [c for c in batch.columns if c not in keys]
        fresh = batch.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(*keys, "_r.*")
        if batch_id > 0:
            stored = spark.read.parquet(f"{sink}/version={batch_id}")
            both = stored.withColumn("_prio", F.lit(0)).unionByName(fresh.withColumn("_prio", F.lit(1)))
            fresh = keep_last(both, keys, [order, "_prio"])
        fresh.write.mode("overwrite").parquet(f"{sink}/version={batch_id + 1}")
        last.append(batch_id + 1)

    last = []
    query = rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{sink}/version={last[-1]}" if last else None


def _written(spark, path):
    """Numbers of the finished batch folders under a path."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def write_dates_once(rows, date, sink, checkpoint, late_days=None):
    """Store the rows of each date once and whole; dates that are already stored are left alone.

    Micro-batches only collect rows, under ``_held``, so a date may be split over any number of
    files and batches. When the input is used up the closed dates are written together: with
    ``late_days`` those more than that many days before the newest date seen, the others wait for
    a later run; without it the end of the input closes every date. Rows without a date count as one date. Every batch owns one folder
    and overwrites it, so running a batch again does not store its rows twice.
    """
    spark, held = rows.sparkSession, f"{sink}/_held"

    def stored():
        n = _written(spark, sink)
        return spark.read.parquet(*[f"{sink}/batch={i}" for i in n]).select(date).distinct() if n else None

    def unstored(df):
        known = stored()
        return df if known is None else df.join(known.withColumnRenamed(date, "_d"), F.col(date).eqNullSafe(F.col("_d")), "left_anti")

    def apply(batch, batch_id):
        unstored(batch).write.mode("overwrite").parquet(f"{held}/batch={batch_id}")

    query = rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    n = _written(spark, held)
    if n:
        every = spark.read.parquet(*[f"{held}/batch={i}" for i in n])
        ready = unstored(every)
        if late_days is not None:
            newest = every.agg(F.max(date)).first()[0]
            ready = ready.where(F.col(date) < F.date_sub(F.lit(newest), late_days))
        if not ready.isEmpty():
            ready.write.mode("overwrite").parquet(f"{sink}/batch={max(_written(spark, sink), default=-1) + 1}")
    return query
