"""Quality rules and source mixing against plain versions."""

from collections import Counter, defaultdict

import pytest
from llm_helpers import SCHEMA, WORD, awkward, rows

from entitle.llm.mixing import PRIMES, mix_sources, mixed_blocks, mixed_documents, permuted, source_targets
from entitle.llm.quality_rules import quality, quality_filter


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(2), SCHEMA).repartition(3)


def plain_quality(texts, sources, line_docs, share, left):
    lines = [[tuple(WORD.findall(x)) for x in (t or "").split("\n")] for t in texts]
    hosts = defaultdict(set)
    for t, s in zip(texts, sources):
        hosts[s].add(t or "")
    having = Counter((s, line) for s, found in hosts.items() for t in found
                     for line in {tuple(WORD.findall(x)) for x in t.split("\n")} if line)
    for t, s, ls in zip(texts, sources, lines):
        words = WORD.findall(t or "")
        grams = Counter(zip(words, words[1:], words[2:]))
        hit = {i + k for i in range(len(words) - 2) for k in range(3) if grams[tuple(words[i:i + 3])] > 1}
        raw = [x for x in (t or "").split("\n") if WORD.search(x)]
        common = sum(len(x) for x in ls if x and having[s, x] > line_docs and having[s, x] > len(hosts[s]) * share)
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        yield (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(raw) - len(set(raw)), len(hit), failed,
               common, not failed and len(words) - common >= len(words) * left)


def test_quality(spark, docs):
    found = docs.collect()
    got = quality(docs, line_docs=2, line_share=0.05, left_share=0.6).drop("id", "text_key").collect()
    want = plain_quality([r.text for r in found], [r.source for r in found], 2, 0.05, 0.6)
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr((r.doc_id, *w)) for r, w in zip(found, want))
    assert any(r.n_common_words for r in got) and any(r.n_dup_lines for r in got)


def test_depleted_documents_go_and_copies_count_once(spark):
    own = [" ".join(f"u{i}x{k}" for k in range(60)) for i in range(40)]
    shared = " ".join(f"menu{k}" for k in range(70))
    texts = [f"{o}\n{shared}" for o in own] + [own[0]] * 50
    kept = quality(spark.createDataFrame(rows(texts, sources=["s"] * 90), SCHEMA)).where("kept").count()
    assert kept == 50  # the copies of one text stay, those with more menu than text go


def test_lines_that_agree_modulo_a_power_of_two(spark):
    odd = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = "".join("ab"[x] for x in odd), "".join("ba"[x] for x in odd)
    got = quality(spark.createDataFrame(rows([f"{one}\n{two}", f"{one}\n{two}\n{one}"]), SCHEMA)).collect()
    assert {r.doc_id: r.n_dup_lines for r in got} == {0: 0, 1: 1}


def test_quality_filter_keeps_rows_whole(spark, docs):
    got = quality_filter(docs)
    assert got.columns == docs.columns and got.count() == quality(docs).where("kept").count()


def test_quality_filter_removes_common_lines(spark):
    own = [[" ".join(f"u{i}x{k}é{part}" for k in range(40)) for part in "ab"] for i in range(30)]
    texts = [f"{a}\n \nthe  menu of all\r\n{b}\nthe menu\tof all" for a, b in own]
    texts += ["\n".join(own[0]) + "\nthe menu of all\n", "\n".join(own[1])]
    sources = ["s"] * 30 + ["t", "s"]
    got = {r.doc_id: r for r in quality_filter(spark.createDataFrame(rows(texts, sources=sources), SCHEMA)).collect()}
    assert all(got[i].text == f"{a}\n \n{b}" for i, (a, b) in enumerate(own))
    assert got[30].text == texts[30] and got[31].text == texts[31]  # not common in its source; without the line
    assert all(r.n_chars == len(r.text) and (r.id, r._bit) == ("x", 2) for r in got.values())


def plain_targets(sizes):
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    target, total, free = {}, 1.5 * sum(sizes.values()), set(sizes)
    while free:
        level = (total - sum(target.values())) / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in over} if over else {s: level * weights[s] for s in free}
        free -= over or free
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "ä": 9000, None: 40, "Z": 700}, {"a": 10}, {"a": 0, "b": 7}, {None: 3, "b": 3, "c": 3}])
def test_source_targets(spark, sizes):
    got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = plain_targets(sizes)
    assert {r.source for r in got} == set(sizes)
    assert all(abs(r.target - want[r.source]) < 1e-6 for r in got)


@pytest.mark.parametrize("count", [1, 2, 97, 1000, PRIMES[0]])
def test_permutation(spark, count):
    from pyspark.sql import functions as F
    n = min(count, 5000)
    got = spark.range(n).select(permuted(F.col("id"), F.lit(count), F.lit("k")).alias("p")).distinct()
    assert got.count() == n and got.where(f"p < 0 OR p >= {count}").isEmpty()


def test_mix_sources(spark, docs):
    got = mix_sources(docs, block_words=8).drop("text_key").collect()
    found = docs.collect()
    size = Counter()
    for r in found:
        size[r.source] += len(WORD.findall(r.text or ""))
    want = plain_targets(dict(size))
    assert sorted((repr(r.doc_id), r.size) for r in got) == sorted((repr(r.doc_id), len(WORD.findall(r.text or ""))) for r in found)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    by_target = Counter()
    for r in got:
        by_target[r.target] += r.taken
    assert all(abs(taken - target) <= 16 for target, taken in by_target.items())
    assert {round(r.target, 6) for r in got} == {round(t, 6) for t in want.values()}
    again = mix_sources(docs.repartition(2), block_words=8).drop("text_key").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_sources_without_words(spark):
    docs = spark.createDataFrame(rows(["a b c", "", None, "d"], sources=["x", "empty", None, None]), SCHEMA)
    got = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in mix_sources(docs, block_words=1).collect()}
    # the words share 6: "empty" can take none, x and the null source by 1 to 3
    assert got[1] == (0, 0, 0.0, 0) and got[2][0] == 0 and got[2][3] == 0
    assert {got[i][2] for i in (0, 2, 3)} == {4.0, 2.0} and got[0][3] == 4 and got[3][3] == 2
    assert mixed_documents(docs, 1).count() == 4


def test_shards_hold_their_blocks(spark, docs):
    _, targets, mix = mixed_blocks(docs, 4, 32)
    sizes = [r["count"] for r in mix.groupBy("shard").count().collect()]
    assert all(s == 32 for s in sorted(sizes)[1:]) and mix.select("shard", "slot").distinct().count() == mix.count()
    kinds = mix.groupBy("shard").agg({"source": "approx_count_distinct"}).collect()
    assert max(k[1] for k in kinds) == targets.where("slots > 0 AND source IS NOT NULL").count()


def test_mixed_documents(spark, docs):
    got = mixed_documents(docs, 8)
    assert got.columns == docs.columns
    taken = {}
    for r in mix_sources(docs, 8).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    words = Counter()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, set()).update(WORD.findall(r.text or ""))
    for r in got.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert set(WORD.findall(r.text)) <= texts[r.doc_id] and r.n_chars == len(r.text)
    assert dict(words) == {d: n for d, n in taken.items() if n}


@pytest.mark.parametrize("operator", [quality, quality_filter, mix_sources, mixed_documents])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0
