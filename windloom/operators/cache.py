"""A content-addressed store of computed rows: compute only what is missing, append once (L-09, J-23).

Rows lie in Parquet by the bucket of their key's hash and the batch that wrote them. A blocked Bloom filter of all
landed keys stands beside them: a key sets HASHES bits in the one block of 32,768 that its hash names,
so asking for a key is one equi-join on the block. Keys that the filter does not have are new without a
look at the store; only the others are held against it exactly, and only in their buckets. A batch that is written again
replaces itself, so a task or a whole job that is tried again adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

BUCKETS, BLOCKS, HASHES, BLOCK_BITS = 64, 4096, 4, 1 << 15


def bits_of(key: Column) -> list[Column]:
    """The positions of a key in its block."""
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BLOCK_BITS)) for i in range(HASHES)]


class Store:
    """Computed rows at `path`, one for each key. Keys are never null; rows with a null key are neither looked up nor kept.

    `blocks` of 4 KB each are the filter's size, 3,000 keys a block for a hundredth of false yeses; it
    is fixed when the store is begun. A full filter costs time, never a result.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, blocks: int = BLOCKS):
        self.spark, self.path, self.key, self.blocks = spark, path.rstrip("/"), key, blocks

    def _placed(self, df: DataFrame) -> DataFrame:
        h = F.xxhash64(F.col(self.key))
        return df.withColumns({"__bucket": F.pmod(h, F.lit(BUCKETS)).cast("int"), "__block": F.pmod(F.shiftright(h, 8), F.lit(self.blocks)).cast("int")})

    def _read(self, part: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{part}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def rows(self) -> DataFrame | None:
        found = self._read("rows")
        return None if found is None else found.drop("__bucket", "__batch")

    def filter(self) -> DataFrame | None:
        """(block, bits): the filters of all batches, joined."""
        found = self._read("filter")
        return None if found is None else found.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))

    def lookup(self, df: DataFrame) -> DataFrame:
        """(key, maybe, hit) of the distinct keys: whether the filter has it, and whether the store does."""
        keys = self._placed(df.select(self.key).where(F.col(self.key).isNotNull()).distinct())
        blocks, stored = self.filter(), self._read("rows")
        if blocks is None or stored is None:
            return keys.select(self.key, F.lit(False).alias("maybe"), F.lit(False).alias("hit"))
        met = keys.join(blocks.hint("merge"), keys["__block"] == blocks["block"], "left")
        maybe = F.col("bits").isNotNull()
        for at in bits_of(F.col(self.key)):
            byte = F.conv(F.hex(F.substring(F.col("bits"), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            maybe = maybe & (F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1)
        asked = met.select(self.key, "__bucket", F.coalesce(maybe, F.lit(False)).alias("maybe"))
        buckets = [r[0] for r in asked.where("maybe").select("__bucket").distinct().collect()]  # BUCKETS at most
        there = stored.where(F.col("__bucket").isin(buckets)).select(F.col(self.key).alias("__k"), F.lit(True).alias("__hit"))
        exact = asked.where("maybe").join(there.hint("merge"), F.col(self.key) == F.col("__k"), "left").select(self.key, "maybe", F.coalesce("__hit", F.lit(False)).alias("hit"))
        return exact.unionByName(asked.where("not maybe").select(self.key, "maybe", F.lit(False).alias("hit")))

    def missing(self, df: DataFrame) -> DataFrame:
        """One row of each key that the store does not have."""
        new = self.lookup(df).where("not hit").select(self.key)
        return df.dropDuplicates([self.key]).join(new.hint("merge"), self.key, "left_semi")

    def append(self, made: DataFrame, batch: str) -> None:
        """Write a batch's rows and its filter; the same batch again replaces them."""
        rows = self._placed(made.where(F.col(self.key).isNotNull()).dropDuplicates([self.key])).withColumn("__batch", F.lit(batch))
        rows.drop("__block").repartition("__bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__batch", "__bucket").parquet(f"{self.path}/rows")
        landed = self.spark.read.parquet(f"{self.path}/rows").where(F.col("__batch") == batch)
        bits = self._placed(landed.select(self.key)).select("__block", F.explode(F.array(*bits_of(F.col(self.key)))).alias("at"))
        blocks = bits.groupBy(F.col("__block").alias("block")).agg(F.bitmap_construct_agg("at").alias("bits")).withColumn("batch", F.lit(batch))
        blocks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/filter")

    def ensure(self, df: DataFrame, compute: Callable[[DataFrame], DataFrame], batch: str) -> DataFrame:
        """All rows of the asked keys: what is missing is computed, one row a key, and appended first."""
        self.append(compute(self.missing(df)), batch)
        asked = df.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        return self.rows().join(asked.hint("merge"), self.key, "left_semi")

    def hit_rate(self, df: DataFrame) -> DataFrame:
        """J-23: (n_keys, n_maybe, n_hits, rate) of the distinct keys."""
        return self.lookup(df).agg(F.count(F.lit(1)).alias("n_keys"), F.count_if("maybe").alias("n_maybe"), F.count_if("hit").alias("n_hits"), F.avg(F.col("hit").cast("double")).alias("rate"))
