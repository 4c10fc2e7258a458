"""Bounded search against plain sums over all pairs."""

import random

import pytest

from entitle.operators import bounds as B


def vectors(draw, n, terms=30, copies=0):
    """Sparse unit vectors, some repeated."""
    out = []
    for i in range(n):
        if copies and out and draw.random() < copies:
            out.append((i, draw.choice(out)[1]))
            continue
        raw = {f"t{int(terms * draw.random() ** 2)}": draw.choice([1, 1, 2, 5]) * draw.random() for _ in range(draw.randrange(1, 9))}
        norm = sum(w * w for w in raw.values()) ** .5
        out.append((i, {t: w / norm for t, w in raw.items()}))
    return out


def frame(spark, rows, key):
    return spark.createDataFrame([(i, t, w) for i, v in rows for t, w in v.items()], f"{key} long, term string, weight double")


def plain(queries, items):
    out = {}
    for q, a in queries:
        for i, b in items:
            s = round(min(sum(w * b[t] for t, w in a.items() if t in b), 1.0), 4)
            if s > 0:
                out[q, i] = s
    return out


@pytest.fixture(scope="module")
def world(spark):
    draw = random.Random(8)
    queries, items = vectors(draw, 25), vectors(draw, 300, copies=.3)
    tables = B.build_impacts(frame(spark, items, "pos"), "pos", champions=4)
    return frame(spark, queries, "query_id"), tables, queries, items


def test_equal_vectors_are_one(world):
    _, tables, _, items = world
    first = {}
    for i, v in items:
        first.setdefault(tuple(sorted(v.items())), i)
    assert {r.item: r.vec for r in tables.members.collect()} == {i: first[tuple(sorted(v.items()))] for i, v in items}


@pytest.mark.parametrize("floor", [-1.0, 0.0, 0.3, 0.7, 0.95, 1.0])
def test_above_finds_all_pairs_over_the_floor(spark, world, floor):
    queries, tables, q, items = world
    floors = spark.createDataFrame([(i, floor + (i % 3) / 50) for i, _ in q], "query_id long, floor double")
    found = B.above(queries, floors, tables).join(tables.members, "vec").collect()
    want = {k: s for k, s in plain(q, items).items() if s >= floor + (k[0] % 3) / 50 - B.SLACK}
    got = {(r.query_id, r.item): r.similarity for r in found}
    assert {k for k, s in want.items() if s >= floor + (k[0] % 3) / 50} <= set(got) <= set(want)
    assert all(abs(got[k] - want[k]) < 2e-4 for k in got)


@pytest.mark.parametrize("k, threshold", [(1, 0.0), (5, 0.3), (40, 0.1)])
def test_best_equals_all_pairs_ranked(world, k, threshold):
    queries, tables, q, items = world
    want, pairs = set(), plain(q, items)
    for i, _ in q:
        mine = sorted((-s, item, s) for (j, item), s in pairs.items() if j == i and s >= threshold)[:k]
        want |= {(i, item, s, r + 1) for r, (_, item, s) in enumerate(mine)}
    assert {(r.query_id, r.item, r.similarity, r.rank) for r in B.best(queries, tables, k, threshold).collect()} == want


def test_similar_pairs_equal_all_pairs_over_the_threshold(spark, world):
    queries, _, q, items = world
    found = B.similar_pairs(queries, frame(spark, items, "pos"), 0.5, "pos").collect()
    assert {(r.query_id, r.item): r.similarity for r in found} == {k: s for k, s in plain(q, items).items() if s >= 0.5}
    with pytest.raises(ValueError):
        B.similar_pairs(queries, queries, 0.0)


def test_restricted_and_stored_tables(spark, world, tmp_path):
    queries, tables, q, items = world
    some = spark.createDataFrame([(i,) for i, _ in items if i % 4 == 1], "item long")
    found = B.best(queries, B.restricted(tables, some), 3, 0.2).collect()
    assert found and all(r.item % 4 == 1 for r in found)
    B.write_impacts(tables, str(tmp_path))
    again = B.read_impacts(spark, str(tmp_path))
    assert sorted(B.best(queries, again, 3, 0.2).collect()) == sorted(B.best(queries, tables, 3, 0.2).collect())
    nothing = B.build_impacts(frame(spark, [], "pos"), "pos")
    assert B.best(queries, nothing, 3, 0.2).count() == 0
