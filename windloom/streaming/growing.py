"""Growing a dataset step by step (G-17): new candidates arrive as files; used keys are left out, parents keep their split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windloom.operators.split import inherit_split, subsample


def expand(candidates: DataFrame, existing: DataFrame, key: str, parent: str, n: int, seed: int = 0) -> DataFrame:
    """`existing` and at most n new rows: not used before, chosen by hash, in the split of their parent."""
    new = candidates.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
    chosen = inherit_split(subsample(new, key, n, seed + 1), existing, parent, seed=seed)
    return existing.unionByName(chosen, allowMissingColumns=True)


#: Keeps the seen keys on disk beside each task, with changes and snapshots in the checkpoint.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_new(source: DataFrame, path: str, checkpoint: str, key: str, existing: DataFrame | None = None):
    """Append each key of a streaming source once to a Parquet table.

    The keys seen so far are keyed state, dealt by hash, so a batch asks for its own keys alone and
    what was landed is never read again: its cost does not grow with the history. State and file sink
    commit by the checkpoint, so a batch that is tried again adds nothing twice. `existing` is a fixed
    table whose keys never come in. Of repeated keys in a batch one row stays, any of them. The state
    store holds a key for each distinct one, for good; rows without a key count as one key.
    """
    spark = source.sparkSession
    fresh = source if existing is None else source.join(existing.select(key).distinct().hint("merge"), key, "left_anti")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        writer = fresh.dropDuplicates([key]).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return writer.outputMode("append").trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
