"""Appends that happen once, whatever is tried again.

A batch's rows go to a folder of its own, `batch=<n>`, and the batch counts only when its line stands in the ledger, a small file
that is put in place by one rename. A batch that was written but not entered is written over when it comes again; one that is entered
is left alone. Readers take the folders that the ledger names, so they never see a half-written batch or one twice.

The table grows by a folder a batch, as the stream's own log does.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.steps import file_system


class Ledger:
    """A table at `path` of an application; names must differ between streams that write to one table."""

    def __init__(self, spark: SparkSession, path: str, stream: str = "main"):
        self.spark, self.path, self.stream = spark, path.rstrip("/"), stream

    def _entry(self, batch: int) -> str:
        return f"{self.path}/_ledger/{self.stream}-{batch}.json"

    def entered(self, batch: int) -> bool:
        place, system = file_system(self.spark, self._entry(batch))
        return system.exists(place)

    def folder(self, batch: int) -> str:
        return f"{self.path}/data/{self.stream}-{batch}"

    def enter(self, batch: int) -> None:
        """One rename makes the batch count. A second writer of the same batch fails here or finds the same entry."""
        place, system = file_system(self.spark, self._entry(batch))
        draft, _ = file_system(self.spark, f"{self._entry(batch)}.draft")
        out = system.create(draft, True)
        out.write(bytearray(json.dumps({"stream": self.stream, "batch": batch, "folder": self.folder(batch)}).encode()))
        out.close()
        if not system.rename(draft, place) and not system.exists(place):
            raise OSError(f"{place} could not be made")

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Appends a batch with the server's time, unless it is entered; whether it was appended now."""
        if self.entered(batch):
            return False
        rows.withColumn("date", F.current_timestamp()).write.mode("overwrite").parquet(self.folder(batch))
        self.enter(batch)
        return True

    def entries(self) -> list[dict]:
        """All lines of all streams' ledgers, by stream and batch."""
        place, system = file_system(self.spark, f"{self.path}/_ledger")
        if not system.exists(place):
            return []
        # the reader leaves drafts out
        lines = self.spark.read.option("pathGlobFilter", "*.json").text(f"{self.path}/_ledger").collect()
        return sorted((json.loads(r.value) for r in lines), key=lambda e: (e["stream"], e["batch"]))

    def read(self, schema) -> DataFrame:
        """The rows of the entered batches; schema has date as its last column."""
        folders = [e["folder"] for e in self.entries()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

def append_once(stream: DataFrame, path: str, checkpoint: str, name: str = "main") -> StreamingQuery:
    """Takes all that is there and stops; each micro-batch is appended once, also if the query dies between writing a batch and its own
    commit, or if the batch comes again."""
    ledger = Ledger(stream.sparkSession, path, name)
    return stream.writeStream.foreachBatch(lambda rows, batch: ledger.append(rows, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
