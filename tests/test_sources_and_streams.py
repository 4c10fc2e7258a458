import json
import random
import time
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from entitle.operators import eligibility as E
from entitle.operators import oplogs as L
from entitle.operators.suppress import suppressed
from entitle.sources import catalogue_io as IO
from entitle.streaming import jobs
from tests.helpers import profiles, rows, rules, scheme

CRITERIA = {"age": "All", "income": "All", "category": "All", "occupation": "All"}


def record(name, **more):
    return {"id": name, "name": name, "description": "d", "eligibility": CRITERIA, "documents": ["x", " x "],
            "state": "Goa", "category": "health", "keywords": "k", **more}


def test_json_catalogue(spark, tmp_path):
    path = tmp_path / "schemes.json"
    path.write_text(json.dumps({"schemes": [record("a"), record("b", category="bad"), record("c")]}, indent=1))
    valid, rejected = IO.load_catalogue(spark, str(path))
    assert rows(valid.orderBy("pos"), "id", "pos") == [("a", 0), ("c", 2)]
    assert rows(rejected, "id") == [("b",)] and rejected.first().errors[0].field == "category"
    IO.write_catalogue(valid, str(tmp_path / "lines"))
    again, none = IO.load_catalogue(spark, str(tmp_path / "lines"), lines=True)
    assert sorted(rows(again, "id", "pos")) == [("a", 0), ("c", 2)] and none.count() == 0
    report = IO.verify_written(again, valid).first()
    assert (report.source_rows, report.written_rows, report.matches) == (2, 2, True)
    (tmp_path / "empty.json").write_text('{"schemes": []}')
    with pytest.raises(ValueError):
        IO.load_catalogue(spark, str(tmp_path / "empty.json"))


def test_several_files_load_as_one(spark, tmp_path):
    made = [record(name, eligibility={**CRITERIA, "age": age}) for name, age in (("a", "18-25"), ("b", "60+"), ("c", "All"), ("d", "All"))]
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    (tmp_path / "one" / "x.json").write_text(json.dumps({"schemes": made}))
    (tmp_path / "two" / "x.json").write_text(json.dumps({"schemes": made[:1]}))
    (tmp_path / "two" / "y.json").write_text(json.dumps({"schemes": []}))
    (tmp_path / "two" / "z.json").write_text(json.dumps({"schemes": made[1:]}))
    p = profiles(spark, (20, 1000.0, "OBC", "student", "Goa"))
    found = []
    for folder in ("one", "two"):
        valid, _ = IO.load_catalogue(spark, str(tmp_path / folder))
        assert dict(valid.dtypes)["pos"] == "bigint"
        assert sorted(rows(valid, "pos", "id")) == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
        best = E.recommend(p, IO_rules(valid))
        found.append(sorted(rows(best, "scheme_id", "match_score", "rank")))
    assert found[0] == found[1] and len(found[0]) == 4


def IO_rules(catalogue):
    from entitle.operators.rules import compile_rules
    return compile_rules(catalogue, "strict")


def test_managed_table(spark, tmp_path):
    name = "t_" + uuid.uuid4().hex[:8]
    frame = spark.range(3)
    assert IO.table_or(spark, name, frame.limit(1)).count() == 1
    options = frame.write.mode("overwrite").format("parquet").option("path", str(tmp_path / name))
    options.saveAsTable(name)
    assert IO.table_or(spark, name, frame.limit(1)).count() == 3
    spark.sql(f"DROP TABLE {name}")
    assert json.loads(IO.as_json(frame, "id").orderBy("id").first().json) == {"id": 0}


def stream(spark, tmp_path, frame, order, files=4):
    """The rows as several files in event order, read one file per batch."""
    folder = str(tmp_path / uuid.uuid4().hex)
    data = frame.orderBy(order).collect()
    step = -(-len(data) // files)
    for n in range(files):
        spark.createDataFrame(data[n * step:(n + 1) * step], frame.schema).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def run(frame, tmp_path, mode="append"):
    name = "s_" + uuid.uuid4().hex[:8]
    query = (frame.writeStream.format("memory").queryName(name).outputMode(mode)
             .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
    query.awaitTermination(120)
    return frame.sparkSession.table(name)


def log(spark):
    base = spark.range(400).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 97).alias("ts"),
        (F.col("id") % 3).alias("user_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("operation"),
        (F.col("id") * 7 % 1900).cast("double").alias("duration_ms"))
    return spark.createDataFrame(base.collect(), base.schema)


def closed(frame, last):
    return sorted(map(str, frame.where(F.col("window_start") < last).collect()))


def test_windowed_streams_equal_batch(spark, tmp_path):
    events = log(spark)
    last = events.agg(F.max("ts") - F.expr("INTERVAL 3 HOURS")).first()[0]
    slow = run(jobs.slow_operations(stream(spark, tmp_path, events, "ts")), tmp_path)
    assert closed(slow, last) == closed(L.slow_per_window(events), last)
    rate = run(jobs.rate_limit(stream(spark, tmp_path, events, "ts"), 11, "1 hour", "1 minute"), tmp_path)
    want = closed(L.rate_violations(events, 11, "1 hour"), last)
    assert want and closed(rate, last) == want


def test_late_rows_are_dropped(spark, tmp_path):
    events = log(spark)
    late = events.where("event_id = 0").withColumn("operation", F.lit("late"))
    folder = str(tmp_path / "late")
    for n, part in enumerate((events.where("event_id < 200"), events.where("event_id >= 200"), late)):
        spark.createDataFrame(part.collect(), events.schema).coalesce(1).write.parquet(f"{folder}/{n}")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    assert run(jobs.slow_operations(source), tmp_path).where("operation = 'late'").count() == 0


def test_repeats_are_suppressed(spark, tmp_path):
    events = log(spark).withColumn("fingerprint", F.col("user_id").cast("string"))
    found = run(jobs.suppress_repeats(stream(spark, tmp_path, events, "ts"), ["fingerprint"], "100 hours"), tmp_path)
    assert found.count() == 3


def fold(events, ttl):
    """Keys and times that pass, one by one."""
    last, out = {}, []
    for key, ts, n in sorted(events, key=lambda e: (e[1], e[2])):
        if key not in last or (ts - last[key]).total_seconds() >= ttl:
            last[key] = ts
            out.append((key, ts, n))
    return sorted(out, key=str)


def test_suppression_in_order_of_time(spark, tmp_path):
    draw, start = random.Random(3), datetime(2024, 1, 1)
    events = [(draw.choice(["a", "b", None]), start + timedelta(seconds=draw.choice([i * 10, i * 10 + draw.randrange(20)])), i) for i in range(120)]
    events += [("c", start, 200), ("c", start + timedelta(seconds=60), 201), ("c", start + timedelta(seconds=119, microseconds=999_999), 202),
               ("c", start + timedelta(seconds=120), 203), ("c", start + timedelta(seconds=120), 204)]
    want = fold(events, 60)
    schema = "name string, ts timestamp, n int"
    batch = suppressed(spark.createDataFrame(events, schema).repartition(3), ["name"], 60)
    assert sorted(map(tuple, batch.collect()), key=str) == want and [w[2] for w in want if w[0] == "c"] == [200, 201, 203]
    source = str(tmp_path / "events")
    late = sorted(events, key=lambda e: e[1] + timedelta(seconds=draw.randrange(90)))
    for i in range(0, len(late), 25):
        spark.createDataFrame(late[i:i + 25], schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.05)
    spark.createDataFrame([("end", start + timedelta(days=9), 999)], schema).coalesce(1).write.mode("append").parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows_in = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        found = run(jobs.suppress_within(rows_in, ["name"], 60, "100 seconds"), tmp_path)
        assert sorted((tuple(r) for r in found.collect() if r.name != "end"), key=str) == want
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_redaction_stream(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"mail u{i}@x.org") for i in range(8)], "id int, text string")
    assert {r.text for r in run(jobs.redacted(stream(spark, tmp_path, frame, "id")), tmp_path).collect()} == {"mail ***EMAIL_REDACTED***"}


def test_eligibility_streams_equal_batch(spark, tmp_path):
    people = profiles(spark, *[(age, 200000.0, "OBC", "student", "Goa") for age in (5, 20, 40, 70)])
    compiled = rules(spark, "strict", scheme(0, "18-25"), scheme(1, "60+", occupation="student"), scheme(2, income="BPL"))
    asked = spark.createDataFrame(people.collect(), people.schema).withColumn("scheme_id", F.lit("s-0"))
    single = run(jobs.requested_assessments(stream(spark, tmp_path, asked, "user_id"), compiled), tmp_path)
    batch = E.assess_pairs(asked.select("user_id", "scheme_id"), people, compiled)
    assert sorted(rows(single, "user_id", "match_score", "reason")) == sorted(rows(batch, "user_id", "match_score", "reason"))
    out = str(tmp_path / "ranked")
    query = (jobs.eligibility_batches(stream(spark, tmp_path, people, "user_id"), compiled,
                                      lambda frame, n: frame.write.mode("overwrite").parquet(f"{out}/batch={n}"))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(180)
    columns = ("user_id", "section", "rank", "scheme_id", "match_score")
    assert sorted(rows(spark.read.parquet(out), *columns)) == sorted(rows(E.eligible_and_recommended(people, compiled), *columns))
