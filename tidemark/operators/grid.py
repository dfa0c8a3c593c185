"""The evaluation grid: start, start + step, ... up to end, in milliseconds."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOOKBACK = 300_000


@dataclass(frozen=True)
class Grid:
    start: int
    end: int
    step: int
    instant: bool = False
    lookback: int = LOOKBACK

    @property
    def last(self) -> int:
        return (self.end - self.start) // self.step

    def frame(self, spark: SparkSession) -> DataFrame:
        """Rows (ts) of the grid."""
        return spark.range(0, self.last + 1).select((F.lit(self.start) + F.col("id") * self.step).alias("ts"))

    def at(self, t: int) -> Grid:
        return replace(self, start=t, end=t, step=1, instant=True)

    def spread(self, rows: DataFrame, before: int, offset: int = 0) -> DataFrame:
        """Copies each row with a time ``t`` to every grid time ``ts`` with t in
        [ts - offset - before, ts - offset]. One row makes at most before / step + 1 copies; no join."""
        step, t = F.lit(self.step), F.col("t") + offset - self.start
        first = F.greatest(F.lit(0), F.expr("0") + F.ceil(t / step).cast("long")) if self.last else F.lit(0).cast("long")
        final = F.least(F.lit(self.last), F.floor((t + before) / step).cast("long")) if self.last else F.lit(0).cast("long")
        inside = rows.where(F.col("t").between(self.start - offset - before, self.end - offset))
        if not self.last:
            return inside.withColumn("ts", F.lit(self.start).cast("long"))
        picked = inside.withColumn("_a", first).withColumn("_b", final).where("_a <= _b")
        return picked.withColumn("_k", F.explode(F.sequence("_a", "_b"))).withColumn("ts", F.lit(self.start) + F.col("_k") * step).drop("_a", "_b", "_k")

    def repeated(self, rows: DataFrame) -> DataFrame:
        """Rows of one time, for every time of the grid."""
        if not self.last:
            return rows.withColumn("ts", F.lit(self.start).cast("long"))
        return rows.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.last).cast("long")))).withColumn("ts", F.lit(self.start) + F.col("_k") * self.step).drop("_k")


def seconds(ms: Column) -> Column:
    return ms.cast("double") / 1000.0
