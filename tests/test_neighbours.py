"""The inverted file against all pairs, on clustered vectors and on noise."""

import numpy as np
import pytest

from entitle.operators import neighbours as N


def frame(spark, vectors, key="item_id"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], f"{key} long, vector array<double>")


def plain(queries, items, k, threshold, exclude_same):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    out = []
    for q, a in enumerate(queries):
        if len(a) != 8 or not np.any(a):  # the commonest width alone is in the file
            continue
        near = []
        for i, b in enumerate(items):
            if len(b) != 8 or not np.any(b) or (exclude_same and i == q):
                continue
            near.append((-round(float(unit(a) @ unit(b)), 4), i))
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(x for x in near if -x[0] >= threshold)[:k])]
    return out


@pytest.fixture(scope="module")
def clustered():
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(12, 8)) * 4
    points = [list(map(float, centres[i % 12] + draw.normal(size=8))) for i in range(300)]
    return points + [points[0], points[0], [0.0] * 8, [1.0, 2.0], []]


@pytest.fixture(scope="module")
def index(spark, clustered):
    return N.build_inverted_file(frame(spark, clustered))


@pytest.mark.parametrize("k, threshold, same, blocks", [(3, 0.4, True, 2000), (10, 0.9, False, 40), (1, 0.999, True, 7)])
def test_exact_search_equals_all_pairs(spark, clustered, index, k, threshold, same, blocks):
    found = N.search(frame(spark, clustered, "query_id"), index, k, threshold, exclude_same=same, block_rows=blocks)
    assert sorted(map(tuple, found.collect())) == sorted(plain(clustered, clustered, k, threshold, same))


def test_few_probes_reach_the_recall_asked_for(spark, clustered, index):
    queries = frame(spark, clustered, "query_id")
    exact = N.search(queries, index, 5, 0.4, exclude_same=True)
    probes = N.probes_for(index, 5, 0.4, 0.95, exclude_same=True)
    found = N.search(queries, index, 5, 0.4, exact=False, probes=probes, exclude_same=True)
    assert probes < index.cells.count() and N.recall(found, exact) >= 0.9
    assert N.recall(exact.limit(0), exact.limit(0)) == 1.0


def test_stored_file_and_empty_tables(spark, clustered, index, tmp_path):
    N.write_inverted_file(index, str(tmp_path))
    again = N.read_inverted_file(spark, str(tmp_path))
    queries = frame(spark, clustered[:40], "query_id")
    assert sorted(N.search(queries, again, 3, 0.5).collect()) == sorted(N.search(queries, index, 3, 0.5).collect())
    assert N.search(queries.limit(0), index, 3, 0.5).count() == 0
    nothing = N.build_inverted_file(frame(spark, [[0.0, 0.0], []]))
    assert N.search(queries, nothing, 3, 0.5).count() == 0
    with pytest.raises(ValueError):
        N.search(queries, index, 3, 0.0)
