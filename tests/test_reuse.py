import random

from pyspark.sql import functions as F

from entitle.operators import reuse as U


def test_repeats_equal_brute_force(spark):
    rng = random.Random(4)
    events = [("hot", rng.randrange(4000)) for _ in range(300)] + [(f"k{rng.randrange(5)}", rng.randrange(4000)) for _ in range(40)]
    events += [("edge", t) for t in (0, 99, 199, 299, 300, 300)]
    frame = spark.createDataFrame(events, "key string, at long").select("key", F.timestamp_seconds("at").alias("ts"))
    want = {}
    for key in {k for k, _ in events}:
        times = sorted(t for k, t in events if k == key)
        want[key] = (len(times), sum(b - a < 100 for a, b in zip(times, times[1:])))
    found = U.reuse_by_key(frame, ["key"], 100)
    assert {r.key: (r.requests, r.repeats) for r in found.collect()} == want
    assert want["edge"] == (6, 3)
    summary = U.reuse_summary(found).first()
    assert (summary.keys, summary.requests, summary.repeats) == (len(want), len(events), sum(r for _, r in want.values()))
