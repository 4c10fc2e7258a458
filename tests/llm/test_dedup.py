"""Exact, near, substring and suffix-array dedup against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from llm_helpers import SCHEMA, WORD, awkward, removed_windows, rows

from entitle.llm import near_dedup as near
from entitle.llm.exact_dedup import exact_dedup, exact_groups
from entitle.llm.kernels import BASES, BYTE, PRIME, Rolling, mix, text_slices, winnowed
from entitle.llm.near_dedup import components, near_groups
from entitle.llm.substring_dedup import substring_dedup
from entitle.llm.suffix_dedup import repeats_in, suffix_array, suffix_dedup

STRIP = str.maketrans("", "", " \t\n\x0b\x0c\r")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


def test_windows_have_one_segment_and_equal_windows_equal_anchors():
    draw = np.random.default_rng(3)
    units = draw.integers(0, 4, 400).astype(np.uint64)
    bounds = np.array([0, 100, 100, 130, 400])
    s = winnowed(units, bounds, 12, 5)
    found = {}
    for row, first, last, lead, anchor in zip(s.row, s.first, s.last, s.lead, s.anchor):
        for start in range(first, last + 1):
            assert bounds[row] <= start and start + 12 <= bounds[row + 1]
            assert found.setdefault(start, None) is None
            found[start] = (anchor, first + lead - start)
    assert len(found) == 89 + 19 + 259
    of = {}
    for start, at in found.items():
        assert of.setdefault(tuple(units[start:start + 12]), at) == at


def thue_morse(n=1024):
    """Two words of a and b that agree under every polynomial modulo a power of two."""
    odd = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in odd), "".join("ba"[x] for x in odd)


def test_rolling_hashes_equal_a_plain_sum():
    draw = np.random.default_rng(1)
    values = draw.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    p, base = int(PRIME), BASES[1]
    rolling = Rolling(values, base)
    got = rolling.all_of(37)
    for i in range(0, 263, 7):
        part = [int(x) for x in values[i:i + 37]]
        low = sum((x & p) * pow(base % p, k, p) for k, x in enumerate(part)) % p
        high = sum((x >> 33) * pow((base >> 31) % p, k, p) for k, x in enumerate(part)) % p
        assert got[i] == mix(np.array([low | high << 31], np.uint64))[0] == rolling.spans(np.array([i]), np.array([i + 37]))[0]


@pytest.mark.parametrize("base", BASES)
def test_rolling_hashes_tell_words_apart(base):
    one, two = (BYTE[np.frombuffer(w.encode(), np.uint8)] for w in thue_morse())
    found = Rolling(np.concatenate([one, two, one]), base).all_of(1024)
    assert found[0] != found[1024] and found[0] == found[2048]


def test_words_that_agree_modulo_a_power_of_two(spark):
    one, two = thue_morse()
    common = " ".join(f"w{i}" for i in range(59))
    got = substring_dedup(spark.createDataFrame(rows([f"{one} {common}", f"{two} {common}"]), SCHEMA)).collect()
    assert {r.doc_id: r.n_removed for r in got} == {0: 0, 1: 59}
    groups = near_groups(spark.createDataFrame(rows([one, two, one]), SCHEMA), 2).collect()
    assert {r.doc_id: r.component_id for r in groups} == {0: 0, 1: 1, 2: 0}


def test_slices_cut_between_rows():
    import pyarrow as pa
    texts = ["aé", None, "", "x" * 50, "b"]
    got = [(i, j, bytes(data), offsets.tolist()) for i, j, data, offsets in text_slices(pa.array(texts), 10)]
    assert [g[:2] for g in got] == [(0, 3), (3, 4), (4, 5)]
    assert got[0][2] == "aé".encode() and got[0][3] == [0, 3, 3, 3]


def test_exact_groups(spark, docs):
    got = exact_groups(docs).collect()
    assert len(got) == docs.count()
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    for r in got:
        same = [t for t in texts if hashlib.sha256(t[1].translate(STRIP).encode()).hexdigest() == r.text_sha256]
        best = min(same, key=lambda t: (-len(t[1]), t[0] is None, t[0] or 0))
        assert (r.keep_id, r.group_size) == (best[0], len(same))
    for sha in {r.text_sha256 for r in got}:
        assert sum(r.kept for r in got if r.text_sha256 == sha) == 1


def test_exact_dedup_keeps_rows_whole(spark, docs):
    got = exact_dedup(docs)
    assert got.columns == docs.columns
    assert got.count() == len({(r.text or "").translate(STRIP) for r in docs.collect()})


def test_heavy_digests_go_without_shuffle(spark):
    many = spark.createDataFrame(rows(["same text"] * 700 + [f"t{i}" for i in range(300)]), SCHEMA)
    got = exact_groups(many).groupBy("group_size").count().collect()
    assert {(r["group_size"], r["count"]) for r in got} == {(700, 700), (1, 300)}


@pytest.mark.parametrize("length,seed_words", [(12, 4), (20, 7)])
def test_substring_dedup(spark, docs, length, seed_words):
    got = substring_dedup(docs, length, seed_words).collect()
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    want = removed_windows(WORD.findall, pairs, length, False)
    wanted = sorted((repr(d), len(w := WORD.findall(t or "")), sum(g := want[(-1 if d is None else d, t or "")]),
                     " ".join(x for x, gone in zip(w, g) if not gone)) for d, t in pairs)
    assert sorted((repr(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got) == wanted
    assert all(sum(s.high - s.low for s in r.spans) == r.n_removed for r in got)


@pytest.mark.parametrize("hot", [512, 1])
def test_suffix_dedup(spark, docs, hot, monkeypatch):
    monkeypatch.setattr("entitle.llm.suffix_dedup.HOT_CLASSES", hot)
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    # two texts with one id are ordered by a hash, which the plain version does not know
    pairs = [p for p in pairs if p[0] != 15]
    got = suffix_dedup(docs.where("doc_id IS NULL OR doc_id <> 15"), 40, 9).collect()
    want = removed_windows(lambda t: t.encode(), pairs, 40, True)
    wanted = []
    for d, t in pairs:
        gone, data = want[(-1 if d is None else d, t or "")], (t or "").encode()
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        wanted.append((repr(d), len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone) if not g)))
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(wanted)


def test_suffix_array_in_two_stages():
    draw = random.Random(5)
    for _ in range(200):
        text = np.array([1 + draw.randrange(draw.choice([1, 2, 256])) for _ in range(draw.randrange(1, 150))] + [0], np.uint16)
        assert suffix_array(text, 200).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert suffix_array(np.zeros(0, np.uint16), 10).tolist() == []


@pytest.mark.parametrize("length", [3, 7, 12])
def test_repeats_in_pieces(length):
    draw = random.Random(length)
    for _ in range(60):
        base = bytes(draw.randrange(97, 100) for _ in range(60))
        pieces = [base[(o := draw.randrange(40)):o + draw.randrange(length, 20)] + b"ab" for _ in range(6)]
        windows = np.array([len(p) - length + 1 for p in pieces])
        seen, want = set(), set()
        for k, p in enumerate(pieces):
            for i in range(windows[k]):
                if p[i:i + length] in seen:
                    want.add((k, i))
                seen.add(p[i:i + length])
        piece, start = repeats_in(pieces, windows, length)
        assert set(zip(piece.tolist(), start.tolist())) == want


def plain_components(texts, size, percent):
    sets = []
    for t in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def chains(seed, families, members):
    """Families of texts that change step by step, so that the ends of a chain are far from each other."""
    draw, texts = random.Random(seed), []
    for f in range(families):
        words = [f"{draw.randrange(10 ** 6)}" for _ in range(draw.choice([6, 30, 120]))]
        for _ in range(members):
            texts.append(" ".join(words))
            if draw.random() < 0.8:
                words[draw.randrange(len(words))] = f"N{draw.randrange(10 ** 6)}"
    texts += [None, "", "one", "One", "one two", "ONE two", "a b c"]
    draw.shuffle(texts)
    return texts


@pytest.mark.parametrize("size", [2, 5])
def test_near_groups(spark, size):
    texts = chains(size, 12, 15)
    got = {r.doc_id: r for r in near_groups(spark.createDataFrame(rows(texts), SCHEMA), size).collect()}
    want, sizes = plain_components(texts, size, 80)
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_large_buckets_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(near, "PART_ROWS", 16)
    monkeypatch.setattr(near, "PIVOTS", 4)
    texts = chains(9, 2, 120)
    got = {r.doc_id: r.component_id for r in near_groups(spark.createDataFrame(rows(texts), SCHEMA), 2).collect()}
    assert [got[i] for i in range(len(texts))] == plain_components(texts, 2, 80)[0]


def test_pairs_within_a_template_meet_across_parts(spark, monkeypatch):
    """Texts of one template are under the threshold, but for pairs that share a few more words."""
    monkeypatch.setattr(near, "PART_ROWS", 2)
    monkeypatch.setattr(near, "PIVOTS", 1)
    template, texts = [f"t{i}" for i in range(86)], []
    for i in range(240):
        pair = [f"p{i // 2}x{k}" for k in range(3)] if i < 120 else [f"q{i}x{k}" for k in range(3)]
        texts.append(" ".join(template + pair + [f"o{i}x{k}" for k in range(11)]))
    got = {r.doc_id: r.component_id for r in near_groups(spark.createDataFrame(rows(texts), SCHEMA), 2).collect()}
    want = plain_components(texts, 2, 80)[0]
    assert len(set(want)) == 180 and [got[i] for i in range(len(texts))] == want


def test_linked_sets_share_a_rare_shingle():
    draw = np.random.default_rng(8)
    often = draw.integers(0, 5, 64)
    for _ in range(500):
        base = np.unique(draw.integers(0, 1 << 60, draw.integers(4, 60), dtype=np.uint64))
        sets = [np.unique(np.append(base[draw.random(len(base)) < 0.95], draw.integers(0, 1 << 60, draw.integers(0, 4), dtype=np.uint64)))
                for _ in range(2)]
        small, large = sorted(sets, key=len)
        both = len(np.intersect1d(small, large))
        if len(small) and 100 * both >= 80 * (len(small) + len(large) - both):
            assert len(np.intersect1d(near.rare_prefixes(small, often, 80)[0], near.rare_prefixes(large, often, 80)[1]))


def test_near_groups_of_awkward_rows(spark, docs):
    got = near_groups(docs).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[1000].component_id == 1000 and by_id[1000].n_shingles == 0 and by_id[1001].kept
    assert by_id[1003].component_id == by_id[1004].component_id < 1000 and None in by_id
    kept = near.near_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len({(r.id, r.text_key) for r in got if r.kept})


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)]
    got = dict(components(spark.createDataFrame(links, "u long, v long")).collect())
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 150)} == {100}


@pytest.mark.parametrize("operator", [exact_groups, exact_dedup, near_groups, near.near_dedup, substring_dedup, suffix_dedup])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact_dedup_takes_the_least_of_all_ids(spark):
    least = -(1 << 63)
    frame = spark.createDataFrame(rows(["same text", "same  text", "same text", "other"], [5, least, None, least + 1]), SCHEMA)
    found = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(frame).collect()}
    assert found == {(5, least, 3, False), (least, least, 3, True), (None, least, 3, False), (least + 1, least + 1, 1, True)}
