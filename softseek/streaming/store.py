"""The state of a cache over a stream: versioned folders, compaction, one current control row.

``entries/epoch=E/batches/batch_id=N/cluster_id=C`` holds what batch N stored in the epoch that it ended
in, ``entries/epoch=E/compact/upto=N/cluster_id=C`` all of that up to batch N in few files, and
``flushed/batch_id=N`` what a batch stored in epochs that it also ended. ``control/batch_id=N`` has one
row: the epoch, the threshold, the last ``seq``, and the batch up to which entries are compacted. It is
written last, so a batch counts once it is complete; a repeated batch overwrites its own folders.

A batch opens the control rows of the last few batches and the entries of one epoch, of the searched
clusters alone: neither grows with the batches or the epochs before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

CONTROL = "epoch long, theta double, last_seq long, compacted long"
#: Control rows that stay, so that a batch can be repeated.
KEPT_CONTROLS = 3
#: Batches after which entries are compacted; clusters beyond which a scan is not pruned by name.
COMPACT_EVERY, NAMED_CLUSTERS = 16, 1000


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, folder: str) -> bool:
        return self._files.exists(self._path(f"{self.root}/{folder}"))

    def _numbers(self, folder: str, key: str) -> list[int]:
        """The numbers in the names ``key=N`` inside a folder."""
        if not self.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(f"{self.root}/{folder}"))]
        return sorted(int(n.removeprefix(f"{key}=")) for n in names if n.startswith(f"{key}="))

    def _drop(self, folder: str) -> None:
        self._files.delete(self._path(f"{self.root}/{folder}"), True)

    def control(self, before: int | None = None) -> Row | None:
        """The control row of the last batch, or of the last one before a batch."""
        done = [n for n in self._numbers("control", "batch_id") if before is None or n < before]
        return self.spark.read.schema(CONTROL).parquet(f"{self.root}/control/batch_id={done[-1]}").first() if done else None

    def entries(self, schema: str, control: Row, before: int | None = None, clusters: list[int] | None = None) -> DataFrame:
        """Entries of the control row's epoch, all or those of some clusters; ``before``: by earlier batches only."""
        own = f"entries/epoch={control['epoch']}"
        found = self.spark.createDataFrame([], f"{schema}, cluster_id int")
        if control["compacted"] is not None:
            found = found.unionByName(self.spark.read.schema(found.schema).parquet(f"{self.root}/{own}/compact/upto={control['compacted']}"))
        if self.exists(f"{own}/batches"):
            batches = self.spark.read.schema(f"{schema}, batch_id long, cluster_id int").parquet(f"{self.root}/{own}/batches")
            after = F.col("batch_id") > (-1 if control["compacted"] is None else control["compacted"])
            batches = batches.where(after if before is None else after & (F.col("batch_id") < before))
            found = found.unionByName(batches.drop("batch_id"))
        if clusters is not None and len(clusters) <= NAMED_CLUSTERS:
            found = found.where(F.col("cluster_id").isin(clusters))
        return found.withColumn("epoch", F.lit(control["epoch"]).cast("long"))

    def append(self, stored: DataFrame, epoch: int, batch_id: int) -> None:
        """What a batch stored: ``epoch`` is the one in force after it, all others were flushed inside it."""
        current = stored.where(F.col("epoch") == epoch).drop("epoch")
        current.write.mode("overwrite").partitionBy("cluster_id").parquet(f"{self.root}/entries/epoch={epoch}/batches/batch_id={batch_id}")
        stored.where(F.col("epoch") != epoch).write.mode("overwrite").parquet(f"{self.root}/flushed/batch_id={batch_id}")

    def write(self, rows: DataFrame, table: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{table}/batch_id={batch_id}")

    def commit(self, before: Row | None, control: Row, batch_id: int, schema: str, compact_every: int = COMPACT_EVERY) -> None:
        """Compacts the epoch's entries if they lie in many batches, and writes the control row."""
        epoch = control["epoch"]
        compacted = before["compacted"] if before is not None and before["epoch"] == epoch else None
        own = f"entries/epoch={epoch}"
        row = Row(epoch=epoch, theta=control["theta"], last_seq=control["last_seq"], compacted=compacted)
        loose = [n for n in self._numbers(f"{own}/batches", "batch_id") if n <= batch_id and (compacted is None or n > compacted)]
        if len(loose) >= compact_every:
            whole = self.entries(schema, row, before=batch_id + 1).drop("epoch")
            whole.repartition("cluster_id").write.mode("overwrite").partitionBy("cluster_id").parquet(f"{self.root}/{own}/compact/upto={batch_id}")
            row = Row(epoch=epoch, theta=control["theta"], last_seq=control["last_seq"], compacted=batch_id)
        self.spark.createDataFrame([tuple(row)], CONTROL).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/control/batch_id={batch_id}")
        for n in self._numbers("control", "batch_id"):
            if n <= batch_id - KEPT_CONTROLS:
                self._drop(f"control/batch_id={n}")
        # What the oldest control row that stays no longer reads.
        oldest = self.control(before=batch_id - KEPT_CONTROLS + 2)
        if oldest is not None and oldest["epoch"] == epoch and oldest["compacted"] is not None:
            for n in self._numbers(f"{own}/batches", "batch_id"):
                if n <= oldest["compacted"]:
                    self._drop(f"{own}/batches/batch_id={n}")
            for n in self._numbers(f"{own}/compact", "upto"):
                if n < oldest["compacted"]:
                    self._drop(f"{own}/compact/upto={n}")
