"""The stateful bookmark stream equals the replay of all operations, after restarts and with late events."""
import datetime as dt
import random

from statuta.operators import store
from statuta.streaming import bookmarks as B
from statuta.streaming import ingest


def test_stream_equals_replay(spark, scratch):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(f"c{rng.randrange(7)}", rng.choice(["set", "set", "clear"]), f"u{i}", start + dt.timedelta(microseconds=i // 3), i)
            for i in range(200)]
    rng.shuffle(rows)
    parts = [rows[:70], rows[70:75], rows[75:]]
    for k, part in enumerate(parts):
        ingest.land(spark.createDataFrame(part, B.EVENTS), f"{scratch}/landing")
        B.run_bookmarks(spark, f"{scratch}/landing", f"{scratch}/log", f"{scratch}/cp")
        seen = spark.createDataFrame([r for p in parts[:k + 1] for r in p], B.EVENTS)
        want = store.apply_bookmark_ops(seen, ["crawler"], "op", "link", ["at", "seq"])
        assert sorted(map(tuple, B.bookmarks(spark, f"{scratch}/log").collect())) == sorted(map(tuple, want.collect()))
    # a late batch changes nothing, and nothing is logged
    n = spark.read.parquet(f"{scratch}/log").count()
    old = [(f"c{i}", "set", "late", start - dt.timedelta(days=1), 0) for i in range(7)]
    ingest.land(spark.createDataFrame(old, B.EVENTS), f"{scratch}/landing")
    B.run_bookmarks(spark, f"{scratch}/landing", f"{scratch}/log", f"{scratch}/cp")
    assert spark.read.schema(B.CHANGES).parquet(f"{scratch}/log").count() == n
