"""Streams of updates: a contraction is linear in each input, so D += (L + dL) * R is D plus dL * R.

A stream of rows of L is summed into a stored result: each micro-batch is contracted with the static R, and its product
is written as one more version of D's parts, named by the batch's number, so that a batch that is run again replaces
itself. Reading D sums the parts; compact() replaces them by their sum.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tensorweft.operators.algebra import contract
from tensorweft.operators.tensor import Tensor, c, summed
from tensorweft.plans import pattern as P


class Accumulator:
    """D under a folder; parts/batch=<n> holds what batch n added."""

    def __init__(self, spark: SparkSession, folder: str, pattern: str, static: Tensor, adapt: Callable[[DataFrame], Tensor], kind: str = "R8"):
        self.spark, self.folder, self.pattern, self.static, self.adapt, self.kind = spark, folder.rstrip("/"), P.check_pair(P.parse(pattern)), static, adapt, kind

    def update(self, batch: DataFrame, number: int) -> None:
        added = contract(self.pattern, self.adapt(batch), self.static)
        added.df.write.mode("overwrite").parquet(f"{self.folder}/parts/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        """Only new rows of the stream are read by each batch."""
        writer = stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def result(self) -> Tensor:
        dims = self.pattern.dest.labels
        fields = ", ".join([f"`{d}` bigint" for d in dims] + (["re double", "im double"] if self.kind[0] == "C" else ["v double"]))
        parts = self.spark.read.schema(fields).parquet(f"{self.folder}/parts")
        names = ("re", "im") if self.kind[0] == "C" else ("v",)
        return Tensor(summed([parts.select(*map(c, dims), *names)], dims, self.kind), dims, (None,) * len(dims), self.kind, self.pattern.dest.name)

    def compact(self, into: str) -> None:
        """Write the sum of all parts as part 0 of another folder, for a new accumulator to go on from."""
        self.result().df.withColumn("batch", F.lit(-1)).write.partitionBy("batch").parquet(f"{into.rstrip('/')}/parts")
