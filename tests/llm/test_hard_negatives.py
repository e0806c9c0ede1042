"""Hard negatives against all products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import hard_negatives as hn


@pytest.mark.parametrize(("width", "bits", "kind"), [(64, 9, np.int32), (13, 4, np.int32), (1, 2, np.int64), (24, 30, np.int64)])
def test_lookups_give_products(width, bits, kind):
    rng = np.random.default_rng(width)
    values = rng.integers(-(1 << bits - 1), 1 << bits - 1, (50, width))
    values[0], values[1] = -(1 << bits - 1), (1 << bits - 1) - 1
    planes = hn.to_planes(values, bits)
    assert (hn.from_planes(planes)[:, :width] == values).all()
    assert planes.shape == (50, bits, -(-width // 8))
    tables = hn.subset_sums(hn.from_planes(planes[:7]).astype(kind))
    assert (hn.scores(planes, tables) == values @ values[:7].T).all()


def brute(rows, is_anchor, k=5):
    """rows: (id, vector, label)."""
    rows = {(i, label, tuple(math.floor(256 * x) for x in v)) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    last = lambda i: (i is None, i or 0)
    out = []
    for a, label, v in rows:
        if a is None or not is_anchor(a):
            continue
        got = [(-sum(x * y for x, y in zip(v, w)), last(i), i, m == label) for i, m, w in rows]  # noqa: B905
        got.sort(key=lambda r: r[:2])
        for s, _, p, _ in [r for r in got if r[3] and r[2] != a][:k]:
            fits = [r for r in got if not r[3] and -80 * s <= -100 * r[0] <= -100 * s][:k]
            out += [(a, p, n, r[2], -s, -r[0]) for n, r in enumerate(fits, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("tiles", [(1 << 14, 1 << 10), (37, 5)])
def test_all_pairs(spark, monkeypatch, tiles):
    monkeypatch.setattr(hn, "TILE_ROWS", tiles[0])
    monkeypatch.setattr(hn, "TILE_ANCHORS", tiles[1])
    rng = random.Random(5)
    near = [[rng.gauss(0, 0.3) for _ in range(10)] for _ in range(4)]
    rows = []
    for i in range(400):
        v = [round(x + rng.gauss(0, 0.05), 3) for x in rng.choice(near)]
        rows.append((i, v, rng.randrange(3)))
    rows += [(None, near[0], 1), (None, near[1], 2), (500, None, 1), (510, [0.5, None], 1), (520, [0.5, float("nan")], 2), (530, [float("inf")], 2), (540, near[0], None), (550, [], 1), (560, near[1][:3], 2)]
    rows += [(600 + i, near[2], i % 3) for i in range(60)] + [rows[0], rows[0], (10, near[3], 1)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, row int, planes string").repartition(4)
    got = hn.hard_negatives(frame, F.col("vec_id") % 10 == 0).collect()
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert len(got) > 300
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == brute(rows, lambda i: i % 10 == 0)


def test_empty_and_too_large(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hn.hard_negatives(frame, F.col("vec_id") % 10 == 0).count() == 0
    frame = spark.createDataFrame([(1, [1e30], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="64 bits"):
        hn.hard_negatives(frame, F.col("vec_id") % 10 == 0)
