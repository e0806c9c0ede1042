"""Small helpers around a session: shared tables, shipping this package, mapping texts with Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shipping
from ..shared import drop_saved, saved, work_dir

#: Texts are handled in slices of about this many bytes, so that a task's memory doesn't follow the batch size.
SLICE_BYTES = 1_000_000


#: A new folder under the shared one, a table in it, and its end: cutting the lineage there also survives lost executors.
new_path, table, drop_table = work_dir, saved, drop_saved


#: Texts may be long: batches of fewer rows than Spark's usual 10,000 keep the buffers of JVM and Python small.
BATCH_ROWS = 4_000


def ship(spark: SparkSession) -> None:
    """Makes the package importable on executors, and batches small unless the session has a size of its own."""
    shipping.ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def ddl(fields: str) -> T.StructType:
    return T._parse_datatype_string(fields)


def map_texts(df: DataFrame, text: str, keep: list[str], out: str, fn: Callable[[pa.Array], dict], slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The columns `keep` of df, then the columns `out` (DDL) that fn gives for a slice of texts: a dict of arrays, with "__take" for the rows that stay (indices; absent: all).

    A kept column whose name (without case) is that of a new one is left out.
    """
    ship(df.sparkSession)
    new = ddl(out)
    keep = [c for c in keep if c.lower() not in {f.lower() for f in new.names}]
    among = text in keep and dict(df.dtypes)[text] == "string"
    src = df.select(*keep) if among else df.select(*keep, F.col(text).cast("string").alias("__text"))
    n_keep, text_at = len(keep), keep.index(text) if among else len(keep)
    schema = T.StructType([*src.schema.fields[:n_keep], *new.fields])
    names, arrow = schema.names, [_arrow_type(f.dataType) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_at, slice_bytes):
                got = fn(part.column(text_at))
                cols = [part.column(i) for i in range(n_keep)]
                if (take := got.get("__take")) is not None:
                    idx = pa.array(take, pa.int64())
                    cols = [c.take(idx) for c in cols]
                cols += [_array(got[f.name], t) for f, t in zip(new.fields, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, kind)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def slices(batch: pa.RecordBatch, text_at: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts have about `most` bytes; a longer text is a part of its own."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def member_map(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap over the first `bits` bits of a column of 64-bit hashes. It is put together from rows of 4 KB, at most 2 ** (bits - 15) of them."""
    at = F.shiftrightunsigned(column, 64 - bits)
    maps = keys.groupBy(F.floor(at / 32768).alias("row")).agg(F.bitmap_construct_agg(at % 32768).alias("map")).collect()
    out = np.zeros(1 << bits >> 3, np.uint8)
    for r in maps:
        out[r["row"] * 4096 : (r["row"] + 1) * 4096] = np.frombuffer(bytes(r["map"]), np.uint8)
    return out


def map_bits(count: int, most: int = 27) -> int:
    """Bits of a bitmap for so many hashes: 64 places or more for each, up to 2 ** most places (16 MB), as a set bit only means that a row is worth a join."""
    return min(most, max(18, (64 * max(1, count) - 1).bit_length()))


def on_map(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which 64-bit hashes (unsigned) have their bit set."""
    at = (hashes >> np.uint64(64 - (len(marks) << 3).bit_length() + 1)).astype(np.int64)
    return (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def divided(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is surely not among the hashes `k1` of keys, rows whose key may be): a bitmap as a small table tells them apart without a shuffle. A null key is surely not."""
    bits = map_bits(keys.count())
    marks = member_map(keys, "k1", bits)
    size = 4096
    parts = [(i, bytearray(part.tobytes())) for i in range(len(marks) // size) if (part := marks[i * size : (i + 1) * size]).any()]
    columns = rows.columns
    bitmap = F.broadcast(rows.sparkSession.createDataFrame(parts, "__row long, __map binary"))  # of a size that map_bits bounds
    marked = rows.withColumn("__at", F.shiftrightunsigned(key, 64 - bits)).withColumn("__row", F.floor(F.col("__at") / 32768)).join(bitmap, "__row", "left")
    byte = F.conv(F.hex(F.substring("__map", (F.floor((F.col("__at") % 32768) / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    marked = marked.withColumn("__maybe", F.coalesce(F.floor(byte / F.pow(F.lit(2), F.col("__at") % 8)) % 2 == 1, F.lit(False)))
    return marked.where(~F.col("__maybe")).select(*columns), marked.where("__maybe").select(*columns)
