"""Watches as Structured Streaming queries over a change log (one row per change: the written columns only)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.operators.storage import shared_folder
from skein.plans.lang import Group
from skein.plans.predicates import View, compile_any


class Watch:
    """pull() gives the matching changes since the last pull, each once; with a callback they are handed over batch by batch instead. The checkpoint lies in the shared folder, so a restarted driver goes on where it stopped."""

    def __init__(self, spark: SparkSession, log: str, schema: StructType, groups: list[Group], callback: Callable[[DataFrame], None] | None = None, checkpoint: str | None = None):
        self.spark, self.callback = spark, callback
        self.place = checkpoint or f"{shared_folder(spark)}/watch-{uuid.uuid4().hex}"
        changes = spark.readStream.schema(schema).parquet(log)
        self.matching = changes.filter(F.coalesce(compile_any(groups, View(changes)), F.lit(False))) if groups else changes
        self.schema, self.pulls, self.query = schema, 0, None
        if callback:
            self.query = self.matching.writeStream.option("checkpointLocation", f"{self.place}/state").foreachBatch(lambda df, _: callback(df)).start()

    def pull(self) -> DataFrame:
        self.pulls += 1
        box = f"{self.place}/inbox/{self.pulls}"

        def put(df: DataFrame, batch: int) -> None:
            df.write.mode("overwrite").parquet(f"{box}/{batch}")

        self.matching.writeStream.option("checkpointLocation", f"{self.place}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
        try:
            return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(box)
        except Exception:
            return self.spark.createDataFrame([], self.schema)

    def stop(self) -> None:
        if self.query:
            self.query.stop()
