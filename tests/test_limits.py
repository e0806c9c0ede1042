"""The window limit as a stream, with many keys in a window."""

import random
from datetime import datetime, timedelta

from foliant.plans.stream_queries import ROCKS, finished
from foliant.streaming import streams

START = datetime(2024, 3, 1)


def test_keys_of_a_window_share_their_state(spark, tmp_path):
    """Groups are parts of the keys, not keys: there are few timers, and the first requests of each key are kept over batches."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = "key long, ts timestamp, id long"
    source, out, point = (str(tmp_path / x) for x in ("in", "out", "point"))
    rng, rows, keys = random.Random(5), [], 1_500
    for n in range(3):
        new = [(k if k else None, START + timedelta(seconds=rng.randrange(60), microseconds=rng.randrange(3)), n * 10_000 + k * 3 + i) for k in range(keys) for i in range(rng.choice([0, 1, 1, 3]) if n else 1)]
        new += [(2**62 + 1, START + timedelta(seconds=rng.randrange(60)), n * 10_000 + 9_000 + i) for i in range(200)]
        rng.shuffle(new)
        rows += new
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(source)
        q = streams.stream_rate_limit(spark.readStream.schema(schema).parquet(source), out, "key", point, 2, "1 minute", "5 minutes", "id")
        finished(q)
    found = streams.rejected(spark, out, "key", "long").collect()
    seen, want = {}, []
    for k, ts, i in sorted(rows, key=lambda r: (r[1], r[2])):
        seen[k] = seen.get(k, 0) + 1
        if seen[k] > 2:
            want.append((k, ts, i))
    assert sorted(((r["key"], r["ts"], r["request_id"]) for r in found), key=str) == sorted(want, key=str)
    assert {r["window_end"] for r in found} == {START + timedelta(minutes=1)}
    kept = sum(min(2, n) for n in seen.values())
    state = q.lastProgress["stateOperators"][0] if isinstance(q.lastProgress, dict) else q.lastProgress.stateOperators[0]
    total = state["numRowsTotal"] if isinstance(state, dict) else state.numRowsTotal
    assert total <= kept + 2 * 16, "requests that are kept and a timer for each part"
