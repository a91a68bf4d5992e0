"""Tables that update-mode streams merge into: versions by batch id in the shared folder."""

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class VersionedTable:
    """The last version of every key, kept as one folder per batch and, now and then, a base that holds all batches before it.

    A batch that runs again overwrites its own folder, and one that a base already holds is left out, so a replay changes
    nothing.  A base is read only once its success marker stands.
    """

    def __init__(self, path: str, keys: list[str], schema: str, every: int = 50):
        self.path, self.keys, self.schema, self.every = path, keys, schema, every

    def _versions(self, kind: str) -> list[int]:
        system, root = fs.FileSystem.from_uri(self.path) if ":/" in self.path else (fs.LocalFileSystem(), self.path)
        folders = system.get_file_info(fs.FileSelector(f"{root}/{kind}", allow_not_found=True))
        done = [f for f in folders if f.type == fs.FileType.Directory and system.get_file_info(f"{f.path}/_SUCCESS").type == fs.FileType.File]
        return sorted(int(f.base_name) for f in done)

    def merge(self, rows: DataFrame, batch: int) -> None:
        """Take in the rows of a batch: for ``foreachBatch``."""
        bases = self._versions("base")
        if bases and batch <= bases[-1]:
            return
        rows.write.mode("overwrite").parquet(f"{self.path}/batch/{batch}")
        if batch % self.every == self.every - 1:
            self.read(rows.sparkSession, keep_batch=True).write.mode("overwrite").parquet(f"{self.path}/base/{batch}")

    def read(self, spark: SparkSession, keep_batch: bool = False) -> DataFrame:
        """Every key with the values of its last batch; one shuffle by key."""
        bases = self._versions("base")
        base = bases[-1] if bases else -1
        rows = spark.createDataFrame([], self.schema + ", _batch bigint") if base < 0 else spark.read.schema(self.schema + ", _batch bigint").parquet(f"{self.path}/base/{base}")
        for batch in (b for b in self._versions("batch") if b > base):
            rows = rows.unionByName(spark.read.schema(self.schema).parquet(f"{self.path}/batch/{batch}").withColumn("_batch", F.lit(batch).cast("bigint")))
        newest = Window.partitionBy(*self.keys).orderBy(F.desc("_batch"))
        last = rows.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")
        return last if keep_batch else last.drop("_batch")
