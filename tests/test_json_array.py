"""JSON documents that are read in several tasks, at every size of split."""

import json
import random

import pytest

from entitle.sources import catalogue_io as IO
from entitle.sources.json_array import _segments, array_elements
from tests.helpers import rows

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def small_splits(spark):
    kept = {name: spark.conf.get(name, None) for name in (SPLIT, "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda size: spark.conf.set(SPLIT, str(size))
    for name, value in kept.items():
        spark.conf.set(name, value) if value else spark.conf.unset(name)


def odd_value(draw, depth=0):
    kind = draw.randrange(8 if depth < 3 else 5)
    if kind < 3:
        return draw.choice(['}', '{"', '\\', '"}]', 'é你🙂', '', '\\"}', '],[', 'a' * 40, 'schemes', '}schemes', '\n}'])
    if kind < 5:
        return draw.choice([1, 2.5, None, True, -3e8])
    if kind < 7:
        return {draw.choice(['a', 'b}', 'c"{', 'schemes']) + str(i): odd_value(draw, depth + 1) for i in range(draw.randrange(4))}
    return [odd_value(draw, depth + 1) for _ in range(draw.randrange(4))]


def document(draw, n):
    made = {}
    if draw.random() < 0.7:
        made["about}schemes"] = odd_value(draw)
        made["first"] = [{"x": odd_value(draw)} for _ in range(draw.randrange(4))]
    made["schemes"] = [{"id": i, "v": odd_value(draw), "w": {"x}": odd_value(draw)}} for i in range(n)]
    if draw.random() < 0.7:
        made["last"] = {"schemes": [{"no": 1}], "y": odd_value(draw)}
    return made


@pytest.mark.parametrize("size", [17, 64, 300])
def test_elements_at_every_split(spark, small_splits, tmp_path, size):
    draw = random.Random(size)
    documents = [document(draw, n) for n in (0, 1, 12)]
    for i, d in enumerate(documents):
        text = json.dumps(d, ensure_ascii=i == 1, indent=draw.choice([None, 1]))
        (tmp_path / f"{i}.json").write_text(text + draw.choice(["", "\n", "  \n\n"]))
    small_splits(size)
    assert _segments(spark, str(tmp_path)).rdd.getNumPartitions() > 4
    got = sorted(rows(array_elements(spark, str(tmp_path), "schemes"), "pos", "json"))
    assert [p for p, _ in got] == list(range(13))
    assert [json.loads(t) for _, t in got] == [e for d in documents for e in d["schemes"]]


def test_other_forms_have_no_elements(spark, tmp_path):
    for i, text in enumerate(['', '{}', '{"schemes": {"a": {"b": 1}}}', '{"other": [{"a": 1}]}', '{"schemes": [1, "x}", null, [{"a": 1}]]}', '[{"schemes": 1}]']):
        (tmp_path / f"{i}.json").write_text(text)
    assert array_elements(spark, str(tmp_path), "schemes").collect() == []


def test_split_catalogue_equals_the_whole_one(spark, small_splits, tmp_path):
    criteria = {"age": "All", "income": "All", "category": "All", "occupation": "All"}
    made = [{"id": f"s{i}", "name": f"n}} {i}", "description": "d \"{", "eligibility": criteria, "documents": ["x"], "state": "Goa",
             "category": "bad" if i % 7 == 3 else "health", "keywords": "k"} for i in range(60)]
    path = tmp_path / "one.json"
    path.write_text(json.dumps({"version": {"n": [1, {}]}, "schemes": made}))
    want = [sorted(rows(f, "pos", "id", "name", "eligibility")) for f in IO.load_catalogue(spark, str(path))]
    small_splits(1000)
    valid, rejected = IO.load_catalogue(spark, str(path), split=True)
    assert [sorted(rows(f, "pos", "id", "name", "eligibility")) for f in (valid, rejected)] == want
    assert len(want[0]) + len(want[1]) == 60 and want[1]
    (tmp_path / "empty.json").write_text('{"schemes": []}')
    with pytest.raises(ValueError):
        IO.load_catalogue(spark, str(tmp_path / "empty.json"), split=True)
