"""Books that are taken out of drafts."""

import random

from foliant.operators import catalog


def test_a_draft_is_read_once_to_take_books_out(spark, tmp_path):
    rng = random.Random(4)
    rows = [(b, s, p, f"{b}-{s[0]}-{p}") for b in range(40) for s in ("popular", "upcoming") for p in range(1, rng.randrange(2, 9))]
    gone = [(b, i) for b, s, p, i in rows if rng.random() < 0.2 and b % 3] + [(b, i) for b, s, p, i in rows if b == 7] + [(1, "nowhere"), (None, "x")]
    spark.createDataFrame(rows + [(99, "popular", 3, None), (99, "popular", 5, "k")], "batch_id long, section string, position int, isbn13 string").write.parquet(f"{tmp_path}/draft")
    spark.createDataFrame(gone + gone, "batch_id long, isbn13 string").write.parquet(f"{tmp_path}/gone")
    out = catalog.remove_books(spark.read.parquet(f"{tmp_path}/draft"), spark.read.parquet(f"{tmp_path}/gone"))
    left, want = set(gone), [(99, "popular", 3, None), (99, "popular", 5, "k")]
    for key in {(b, s) for b, s, _, _ in rows}:
        mine = sorted((r for r in rows if r[:2] == key), key=lambda r: r[2])
        kept = [r for r in mine if (r[0], r[3]) not in left]
        want += kept if len(kept) == len(mine) else [(*key, n, r[3]) for n, r in enumerate(kept, 1)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 2
