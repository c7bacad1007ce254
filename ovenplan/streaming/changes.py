"""Change capture on a stream of row versions.

Each micro-batch is compared within itself by the batch operator, which spreads a hot key over its time chunks. What crosses
micro-batches is one last version per key: it is kept as a table in the shared folder and joined to the batch's first versions.
So no task ever holds all versions of a key. Log and state of an epoch go to folders named by it; a replayed epoch overwrites
its own folders, which makes the output exactly-once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ovenplan.operators.history import change_rows, changes_from_feed


def stream_changes(
    stream: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    watched: Sequence[str],
    folder: str,
    chunk: str = "hour",
) -> DataStreamWriter:
    """A writer that logs the changes of ``stream`` below ``folder``; start it with the trigger of choice.

    Versions are ordered within a micro-batch, whatever their order of arrival in it. A version that arrives after a micro-batch
    with a later one of its key can't be logged any more: it goes to ``late`` below ``folder`` (see ``read_late``) and changes
    neither log nor state.
    """

    def log_epoch(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        version, place = F.struct(*order, *watched), F.struct(*order)
        rows = batch.select(*keys, *order, *watched)
        if epoch > 0:
            state = spark.read.parquet(_state(folder, epoch - 1))
            known = state.select(*keys, F.struct(*[F.col(f"version.{c}") for c in order]).alias("_seen"))
            rows = rows.join(known, list(keys), "left").withColumn("_late", F.coalesce(place <= F.col("_seen"), F.lit(False)))
            rows = rows.persist()
            rows.filter("_late").select(*keys, *order, *watched).write.mode("overwrite").parquet(f"{folder}/late/epoch={epoch}")
            fresh = rows.filter("NOT _late").select(*keys, *order, *watched)
        else:
            fresh = rows = rows.persist()
        ends = fresh.groupBy(*keys).agg(F.min_by(version, place).alias("first"), F.max_by(version, place).alias("last"))
        log = changes_from_feed(fresh, keys, order, watched, chunk)
        if epoch > 0:
            across = ends.join(state.withColumnRenamed("version", "_old"), list(keys)).select(
                *keys, *[F.col(f"first.{c}").alias(c) for c in order], "_old", F.col("first").alias("_new")
            )
            log = log.unionByName(change_rows(across, keys, order, watched))
            kept = state.withColumnRenamed("version", "kept").join(ends, list(keys), "full")
            state = kept.select(*keys, F.coalesce("last", "kept").alias("version"))
        else:
            state = ends.select(*keys, F.col("last").alias("version"))
        log.write.mode("overwrite").parquet(f"{folder}/log/epoch={epoch}")
        state.write.mode("overwrite").parquet(_state(folder, epoch))
        rows.unpersist()

    return stream.writeStream.foreachBatch(log_epoch).option("checkpointLocation", f"{folder}/offsets")


def _state(folder: str, epoch: int) -> str:
    """Two folders in turn: an epoch reads the one and writes the other."""
    return f"{folder}/state/{'even' if epoch % 2 == 0 else 'odd'}"


def read_log(stream_folder: str, like: DataFrame) -> DataFrame:
    """The change log written below a stream's folder."""
    return like.sparkSession.read.parquet(f"{stream_folder}/log").drop("epoch")


def read_late(stream_folder: str, like: DataFrame) -> DataFrame:
    """The versions that came too late for the log. Call it after the second micro-batch; before, none can be late."""
    return like.sparkSession.read.parquet(f"{stream_folder}/late").drop("epoch")
