"""Tables that micro-batches add to, in folders that can be rewritten one by one.

A table has a folder for each value of its first column (a day, a bucket of users), and in it a folder for each delta:

    day=2024-03-01/delta=12-12-0    what micro-batch 12 added
    day=2024-03-01/delta=0-11-1     what batches 0 to 11 added, rewritten once

A delta that another one covers (the same batches and more, or rewritten later) isn't read any more. So a rewrite is written aside and comes into force by one
rename: before it nothing has changed, after it what it covers is only waste, whatever fails in between. A batch that runs again overwrites its own deltas.
No list of files is kept, so folders may be dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Delta = tuple[int, int, int]


class DeltaTable:
    """Rows of `schema` under a folder, apart by the column `by` (a date or a number, which isn't null; not among the columns of the schema)."""

    def __init__(self, spark: SparkSession, folder: str, by: str, schema: T.StructType):
        self.spark, self.folder, self.by = spark, folder.rstrip("/"), by
        self.schema = T.StructType([f for f in schema.fields if f.name != by])
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _listed(self, path: str) -> list[str]:
        at = self._path(path)
        return [f.getPath().getName() for f in self._store.listStatus(at) if f.isDirectory()] if self._store.exists(at) else []

    def parts(self) -> list[str]:
        """The values of the first column, as text."""
        return sorted(n.split("=", 1)[1] for n in self._listed(self.folder) if n.startswith(f"{self.by}="))

    def deltas(self, part: str) -> list[Delta]:
        return sorted(tuple(int(x) for x in n.split("=", 1)[1].split("_")) for n in self._listed(f"{self.folder}/{self.by}={part}") if n.startswith("delta="))

    def live(self, part: str) -> list[Delta]:
        """Deltas that no other one covers."""
        return _uncovered(self.deltas(part))

    def _at(self, part: str, delta: Delta) -> str:
        return f"{self.folder}/{self.by}={part}/delta={'_'.join(map(str, delta))}"

    def add(self, rows: DataFrame, batch: int) -> None:
        """What a micro-batch adds. If it runs again, it takes the place of what it wrote before."""
        out = rows.withColumn("delta", F.lit(f"{batch}_{batch}_0"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.by, "delta").parquet(self.folder)

    def read(self, parts: Iterable[str] | None = None, before: int | None = None) -> DataFrame:
        """Rows of some parts (or all), with the column `by`, and `batch`: the last batch of the row's delta. before: of earlier batches only."""
        paths = []
        for part in self.parts() if parts is None else parts:
            paths += [self._at(part, d) for d in _uncovered([d for d in self.deltas(part) if before is None or d[1] < before])]
        kind = T.StructType([*self.schema.fields, T.StructField(self.by, T.DateType() if self.by == "day" else T.LongType()), T.StructField("delta", T.StringType())])
        rows = self.spark.read.schema(kind).option("basePath", self.folder).parquet(*paths) if paths else self.spark.createDataFrame([], kind)
        return rows.withColumn("batch", F.split("delta", "_")[1].cast("long")).drop("delta")

    def rewrite(self, part: str, change: Callable[[DataFrame], DataFrame], before: int | None = None, options: dict[str, str] | None = None) -> None:
        """Puts what `change` makes of a part's rows (of batches before one) in their place, written with options of Parquet. Batches that come meanwhile stay as they are."""
        live = _uncovered([d for d in self.deltas(part) if before is None or d[1] < before])
        if not live:
            return
        first, last = min(d[0] for d in live), max(d[1] for d in live)
        turn = 1 + max(d[2] for d in self.deltas(part) if d[:2] == (first, last)) if any(d[:2] == (first, last) for d in live) else 0
        aside = f"{self.folder}/_{uuid.uuid4().hex}"
        change(self.read([part], before)).select(*self.schema.names).write.options(**options or {}).parquet(aside)
        self._commit(aside, self._at(part, (first, last, turn)))
        self.clean(part)

    def _commit(self, aside: str, path: str) -> None:
        if not self._store.rename(self._path(aside), self._path(path)):
            raise OSError(f"{aside} couldn't be renamed to {path}")

    def clean(self, part: str) -> None:
        """Deletes the deltas of a part that others cover."""
        live = self.live(part)
        for d in self.deltas(part):
            if d not in live:
                self._delete(self._at(part, d))

    def drop(self, part: str) -> None:
        self._delete(f"{self.folder}/{self.by}={part}")

    def _delete(self, path: str) -> None:
        self._store.delete(self._path(path), True)


def _uncovered(deltas: list[Delta]) -> list[Delta]:
    covers = lambda x, d: x != d and x[0] <= d[0] and x[1] >= d[1] and (x[:2] != d[:2] or x[2] > d[2])
    return [d for d in deltas if not any(covers(x, d) for x in deltas)]
