"""Hard negatives by the method of the Four Russians: exact inner products by lookups of subset sums.

Vectors become whole numbers, stored as bit planes in two's complement: plane b of a row has bit b of each component, eight components to a byte. An anchor's
components are cut into groups of eight, and for each group all 256 sums of subsets are tabulated. The bytes of a row's plane index these tables, the sums
found add up to the anchor's product with that plane, and the planes are added with shifts (the highest counts negative): the full product, exact.

Anchors (a stated set of rows) meet all rows in tiles: rows and anchors are dealt into blocks by their number, each pair of blocks is a group of
bounded size, and only the best of each anchor leave it. Two passes: the best rows of the anchor's label, then for each of these the best others in its range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import ship, table

#: Rows and anchors in a tile, about; rows scored at once.
TILE_ROWS, TILE_ANCHORS, CHUNK = 1 << 14, 1 << 10, 1 << 11


def to_planes(values: np.ndarray, bits: int) -> np.ndarray:
    """Whole numbers (rows, components) as bytes (rows, bits, groups of eight components); components are filled up with zeros."""
    rows, width = values.shape
    room = np.zeros((rows, -(-width // 8) * 8), np.int64)
    room[:, :width] = values
    return np.stack([np.packbits((room >> b & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(bits)], axis=1)


def from_planes(planes: np.ndarray) -> np.ndarray:
    bits = planes.shape[1]
    values = np.zeros((len(planes), planes.shape[2] * 8), np.int64)
    for b in range(bits):
        values += np.unpackbits(planes[:, b], axis=1, bitorder="little").astype(np.int64) * (-(1 << b) if b == bits - 1 else 1 << b)
    return values


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """Tables (groups, 256, anchors) of whole numbers (anchors, components): entry m has the sum of the components whose bits are set in m."""
    groups = anchors.T.reshape(-1, 8, len(anchors))
    out = np.zeros((len(groups), 256, len(anchors)), anchors.dtype)
    for j in range(8):
        out[:, 1 << j : 2 << j] = out[:, : 1 << j] + groups[:, j : j + 1]
    return out


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Inner products (rows, anchors) by lookups and shifted adds, from the highest plane down."""
    out = np.zeros((len(planes), tables.shape[2]), tables.dtype)
    for b in range(planes.shape[1] - 1, -1, -1):
        out <<= 1
        for g in range(len(tables)):
            found = tables[g][planes[:, b, g]]
            if b == planes.shape[1] - 1:
                out -= found
            else:
                out += found
    return out


def prepared(vectors: DataFrame, id: Column, vector: Column, label: Column, scale: int) -> tuple[DataFrame, int, bool]:
    """(a table of id, label as a string, planes, row (a number of its own); bits of a component; whether products fit 32 bits) of the rows that take part."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(id.cast("long").alias("id"), label.cast("string").alias("label"), vector.cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(odd, F.lit(True)))
    most, width = rows.select(F.transform("vector", lambda x: F.abs(x)).alias("v"), F.size("vector").alias("n")).agg(F.max(F.array_max("v")), F.max("n")).first()
    limit, width = float(most or 0.0) * scale + 1, width or 0
    if limit * limit * max(1, width) >= 2.0**62:
        raise ValueError("products of these vectors don't fit 64 bits")
    bits = int(limit).bit_length() + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, column = batch.columns
            n = np.diff(np.asarray(column.offsets))
            values = np.zeros((len(n), max(1, width)), np.int64)
            at = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            values[at] = np.floor(scale * np.asarray(column.flatten(), np.float64)).astype(np.int64)
            planes = to_planes(values, bits)
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array([p.tobytes() for p in planes], pa.binary())], names=["id", "label", "planes"])

    packed = rows.mapInArrow(pack, "id long, label string, planes binary").distinct()
    return table(packed.withColumn("row", F.monotonically_increasing_id()), "bit-planes"), bits, limit * limit * max(1, width) < 2.0**31


def _planes(column: pa.ChunkedArray, bits: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint8).reshape(len(column), bits, -1)


def _tiles(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, columns: list[str]):
    """Groups of a block of rows and a block of anchors; each row is there once for each block of anchors, and the other way round."""
    down, across = n_rows // TILE_ROWS + 1, n_anchors // TILE_ANCHORS + 1
    left = rows.select("id", "label", "planes", F.pmod(F.hash("row"), F.lit(down)).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("a"))
    right = anchors.select("id", "label", "planes", "row", *columns, F.pmod(F.hash("row"), F.lit(across)).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("r"))
    return left.groupBy("r", "a").cogroup(right.groupBy("r", "a"))


class _Tile:
    """The two sides of a tile: rows by ascending id (null last), so that a stable sort by falling score breaks ties."""

    def __init__(self, rows: pa.Table, anchors: pa.Table, bits: int, small: bool):
        column = rows.column("id").combine_chunks()
        ids, nulls = pc.fill_null(column, 0).to_numpy(zero_copy_only=False), pc.is_null(column).to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, nulls))
        self.ids, self.nulls, planes = ids[order], nulls[order], _planes(rows.column("planes"), bits)[order]
        both = pa.chunked_array([*rows.column("label").chunks, *anchors.column("label").chunks], pa.string()).combine_chunks().dictionary_encode().indices.to_numpy()
        self.labels, self.own = both[: len(ids)][order], both[len(ids) :]
        tables = subset_sums(from_planes(_planes(anchors.column("planes"), bits)).astype(np.int32 if small else np.int64))
        self.scores = np.empty((tables.shape[2], len(ids)), tables.dtype)
        for i in range(0, len(ids), CHUNK):
            self.scores[:, i : i + CHUNK] = scores(planes[i : i + CHUNK], tables).T

    def id(self, at: int) -> int | None:
        return None if self.nulls[at] else int(self.ids[at])


def _best(values: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k places of `at` with the highest values, equal ones in the order of `at`."""
    if len(at) > 4 * k:
        least = np.partition(values[at], len(at) - k)[len(at) - k]
        at = at[values[at] >= least]
    return at[np.argsort(-values[at], kind="stable")[:k]]


def hard_negatives(vectors: DataFrame, anchors: Column, id: str = "vec_id", vector: str = "embedding", label: Column | str = "label", positives: int = 5,
                   negatives: int = 5, least: int = 80, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x), a row's score is its inner product with the anchor, ties go by ascending id (null last). An anchor's positives are its
    best `positives` rows of the same label and another id. For each, the best `negatives` rows of other labels with `least` % of its score or more, and not
    above it, are returned; a positive without any gives no row. `anchors` is a condition on the column id.

    Rows with a null label or vector, or a component that is null or not finite, take no part. Shorter vectors count as filled up with zeros. Rows that agree in
    id, label and numbers count once; an id with several vectors stands for several rows, each an anchor of its own. An empty table gives an empty result. Products
    beyond 62 bits are an error. Other columns aren't read.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows, bits, small = prepared(vectors, F.col(id), F.col(vector), label, scale)
    chosen = table(rows.withColumnRenamed("id", id).where(anchors).withColumnRenamed(id, "id"), "anchors")
    n_rows, n_anchors = rows.count(), chosen.count()

    def first(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            tile = _Tile(left, right, bits, small)
            for i, (own, row) in enumerate(zip(right.column("id").to_pylist(), right.column("row").to_pylist(), strict=True)):
                same = np.flatnonzero((tile.labels == tile.own[i]) & ((tile.ids != own) | tile.nulls) if own is not None else (tile.labels == tile.own[i]) & ~tile.nulls)
                out += [(row, tile.id(j), int(tile.scores[i, j])) for j in _best(tile.scores[i], same, positives)]
        return _table(out, ("row", "id", "score"), (pa.int64(),) * 3)

    found = _tiles(rows, chosen, n_rows, n_anchors, []).applyInArrow(first, "row long, id long, score long")
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives)
    found = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("positives"))  # a few of each anchor
    asked = table(chosen.join(found, "row"), "positives")

    def second(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            tile = _Tile(left, right, bits, small)
            for i, (row, wanted) in enumerate(zip(right.column("row").to_pylist(), right.column("positives").to_pylist(), strict=True)):
                wanted = [p for p in wanted if p["score"] >= 0]  # below 0, nothing is both at least 80 % and not above it
                if not wanted:
                    continue
                have, low, high = tile.scores[i], min(-(-least * p["score"] // 100) for p in wanted), max(p["score"] for p in wanted)
                near = np.flatnonzero((tile.labels != tile.own[i]) & (have >= low) & (have <= high))
                for p in wanted:
                    at = near[(have[near] <= p["score"]) & (have[near] >= -(-least * p["score"] // 100))]
                    out += [(row, p["n"], tile.id(j), int(have[j])) for j in _best(have, at, negatives)]
        return _table(out, ("row", "n", "negative_id", "negative_score"), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))

    got = _tiles(rows, asked, n_rows, n_anchors, ["positives"]).applyInArrow(second, "row long, n int, negative_id long, negative_score long")
    best = Window.partitionBy("row", "n").orderBy(F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last())
    got = got.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    of = asked.select("row", F.col("id").alias("anchor_id"), F.explode("positives").alias("p")).select("row", "anchor_id", F.col("p.n").alias("n"), F.col("p.id").alias("positive_id"),
        F.col("p.score").alias("positive_score"))
    return got.join(of, ["row", "n"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _table(rows: list[tuple], names: tuple, kinds: tuple) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})
