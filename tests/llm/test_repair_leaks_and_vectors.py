"""Conversation repair, benchmark decontamination and whitening against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from llm_helpers import SCHEMA, awkward, rows

from entitle.llm.conversation_repair import (
    BLANK, CUT, DUPLICATE, SOUND, Viterbi, damaged, op11, repair, repaired_conversations,
)
from entitle.llm.decontamination import contamination, decontaminated, op12
from entitle.llm.whitening import on_grid, op13, whiten

CONVERSATION = "conv_id long, turn long, role string, text string, conv string, at long, sha string, edit string, _kind int"


# --- operator 11 ----------------------------------------------------------------------------

def cheapest(steps):
    """(cost, initials, emitted) of the best repair: all paths, whole strings, one per state."""
    far = (10 ** 9, "", ())
    paths = {"": (0, "", ()), "s": far, "u": far, "a": far}

    def inserted(paths):
        more = lambda p, role: (p[0] + 5, p[1] + "I", (*p[2], ("I", role)))
        u = min(paths["u"], *(more(paths[x], "user") for x in ("", "s", "a")))
        return {**paths, "u": u, "a": min(paths["a"], more(u, "assistant"))}

    before = {"s": [""], "u": ["", "s", "a"], "a": ["u"]}
    for i, (initial, fault) in enumerate(steps):
        paths = inserted(paths)
        new = {x: [(p[0] + 2, p[1] + "D", p[2])] for x, p in paths.items()}
        if fault in (SOUND, CUT):
            extra = 5 if fault == CUT else 0
            for x in before.get(initial, []):
                p = paths[x]
                new[initial].append((p[0] + extra, p[1] + "K", (*p[2], ("K", i))))
            for role in ("user", "assistant"):
                for x in before[role[0]]:
                    p = paths[x]
                    new[role[0]].append((p[0] + extra + 1, p[1] + "R", (*p[2], ("R", role, i))))
        paths = {x: min(c) for x, c in new.items()}
    paths = inserted(paths)
    return min(paths[""], paths["a"])


def every_repair(steps):
    """(cost, initials) of the best repair, from all of them with one insert at most in a row, and two at the end or start."""
    best = (10 ** 9, "")
    stack = [(0, 0, "", "")]
    while stack:
        i, cost, said, roles = stack.pop()
        if cost > best[0]:
            continue
        if i == len(steps) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best, (cost, said))
        if not said.endswith("II"):
            for r in "ua":
                if re.fullmatch("s?(ua)*u?", roles + r):
                    stack.append((i, cost + 5, said + "I", roles + r))
        if i < len(steps):
            initial, fault = steps[i]
            stack.append((i + 1, cost + 2, said + "D", roles))
            if fault in (SOUND, CUT):
                extra = 5 if fault == CUT else 0
                for letter, r, more in (("K", initial, 0), ("R", "u", 1), ("R", "a", 1)):
                    if re.fullmatch("s?(ua)*u?", roles + r):
                        stack.append((i + 1, cost + extra + more, said + letter, roles + r))
    return best


def walked(steps):
    work, out = Viterbi(), []
    for initial, fault in steps:
        out += work.step(initial, fault)
    rest, cost = work.end()
    return cost, "".join(n.letter for n in [*out, *rest])


def some_steps(draw, n, faults=(SOUND, SOUND, SOUND, BLANK, DUPLICATE, CUT)):
    return [(draw.choice("suuaax"), draw.choice(faults)) for _ in range(n)]


def test_viterbi_finds_the_cheapest_and_least():
    draw = random.Random(3)
    for _ in range(300):
        steps = some_steps(draw, draw.randrange(5))
        assert walked(steps) == cheapest(steps)[:2] == every_repair(steps)
    for _ in range(1500):
        steps = some_steps(draw, draw.randrange(5, 40), draw.choice([(SOUND,), (SOUND, CUT), (SOUND, SOUND, BLANK, DUPLICATE, CUT)]))
        assert walked(steps) == cheapest(steps)[:2]
    for steps in ([("u", SOUND)] * 30, [("a", SOUND)] * 31, [("s", SOUND)] * 9, [("u", CUT)] * 20, [("x", BLANK)] * 12):
        assert walked(steps) == cheapest(steps)[:2]


def test_survivors_meet_and_memory_stays_bounded():
    work, open_edits = Viterbi(), 0
    for i in range(20000):
        step = ("u", CUT) if i % 97 == 5 else ("ua"[i % 2], SOUND if i % 31 else DUPLICATE)
        open_edits += 1 - len(work.step(*step))
        assert open_edits < 400
    assert len(work.end()[0]) == open_edits


def plain_op11(table):
    """The contract, conversation by conversation."""
    out = {}
    for conv in {r[0] for r in table}:
        held = []
        for c, turn, role, text in [r[:4] for r in table if r[0] == conv]:
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            held += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in held:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append(BLANK if not body else DUPLICATE if (role, text) in seen else SOUND if body[-1] in ".!?" else CUT)
            seen.add((role, text))
        cost, audit, kept = cheapest([(r[1][:1], f) for r, f in zip(held, faults)])
        lines = [f"{e[1]}:" if e[0] == "I" else f"{held[e[1]][1]}:{held[e[1]][2]}" if e[0] == "K" else f"{e[1]}:{held[e[2]][2]}" for e in kept]
        turns = [r[0] for r in held if r[0] is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(held, held[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(BLANK), faults.count(DUPLICATE),
                     faults.count(CUT), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def awkward_conversations(seed=5, conversations=60):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \n", None, "Why?\n", "é 🙂.", "a:b\nc.", "done. " * 50]
    out = []
    for conv in range(conversations):
        for turn in range(draw.randrange(9)):
            out.append((conv, draw.choice([turn, turn, turn, None, turn + 3]),
                        draw.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "USER"]),
                        draw.choice(texts) if draw.random() < .4 else f"turn {draw.random()}."))
    out += out[10:20] + out[12:14] + [(None, 1, "user", "Hello."), (None, None, None, None), (None, 2, "assistant", "Hi there.")]
    out += [(1000, 2 * t, "user", f"only users {t}.") for t in range(41)]
    out += [(1001, t, "user" if t % 2 == 0 else "assistant", f"long talk {t}!") for t in range(3000)]
    return [(*r, "x", 7, "y", "z", 1) for r in out]


def repair_columns(row):
    return (row.gaps, row.blank, row.duplicate, row.truncated, row.illegal, row.cost, row.audit, row.repaired_sha256)


def test_op11_equals_plain_version(spark, tmp_path):
    table = awkward_conversations()
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame(table, CONVERSATION).repartition(5).write.parquet(path)
    found = op11(spark, str(tmp_path)).collect()
    want = plain_op11(table)
    assert len(found) == len(want)
    assert {r.conv_id: repair_columns(r) for r in found} == want
    assert {x for r in found for x in r.audit} == {"K", "R", "D"}  # an insert is never cheaper than the deletion beside it


def test_repair_gives_the_repaired_rows(spark):
    table = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "assistant", "Hello."),
             (1, 4, "user", "Bye."), (1, 5, "tool", "See you."), (2, 0, "user", "Half a sent"), (None, 0, "user", "So?")]
    df = spark.createDataFrame([(*r, "x", 7, "y", "z", 1) for r in table], CONVERSATION)
    got = sorted(tuple(r) for r in repaired_conversations(df).collect() if r.conv_id == "1")
    assert [r[2:] for r in got] == [("system", "Be kind."), ("user", "Hi."), ("assistant", "Hello."), ("user", "Bye."), ("assistant", "See you.")]
    ends = {r.conv: r.stats for r in repair(df).where("edit = ''").collect()}
    assert ends["=1"].cost == 3 and ends["=1"].duplicate == 1 and ends["=2"].truncated == 1 and ends["=2"].cost == 2 and ends[""].cost == 2


def test_conversations_without_rows(spark, tmp_path):
    empty = spark.createDataFrame([], CONVERSATION)
    assert repair(empty).count() == 0 and damaged(empty).count() == 0
    empty.write.parquet(f"{tmp_path}/conversations.parquet")
    assert op11(spark, str(tmp_path)).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(dropped, 0, "user", "Gone.", "x", 7, "y", "z", 1)], CONVERSATION).write.mode("overwrite").parquet(
        f"{tmp_path}/conversations.parquet")
    assert [repair_columns(r) for r in op11(spark, str(tmp_path)).collect()] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# --- operator 12 ----------------------------------------------------------------------------

ITEMS = "item_id long, text string, item string, seed long, high long, id long"
SMALL_LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(SMALL_LETTERS))


def plain_hits(text, items, window):
    words = item_words(text)
    covered, found = set(), set()
    for item_id, other in items:
        theirs = item_words(other)
        n = min(window, len(theirs))
        if not n:
            continue
        windows = {tuple(theirs[i:i + n]) for i in range(len(theirs) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i:i + n]) in windows:
                covered |= set(range(i, i + n))
                found.add(item_id)
    low = sorted(i for i in covered if i - 1 not in covered)
    high = sorted(i + 1 for i in covered if i + 1 not in covered)
    return len(words), len(covered), list(zip(low, high)), sorted(str(i) for i in found if i is not None)


def leaky(seed=2):
    """Documents and items with shared passages, some behind a common template, short items, and awkward rows."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["ä", "日本", "É", "Big", "x" * 70]
    some = lambda n: [draw.choice(words) for _ in range(n)]
    template = some(12)
    items = [(i, " ".join((template if i % 3 == 0 else []) + some(draw.randrange(8, 40)))) for i in range(60)]
    items += [(60, "one"), (61, "Two, words!"), (62, "w1 w2 w3 w4"), (63, "?!"), (64, None), (None, " ".join(some(20))), (5, " ".join(some(15))),
              (-7, items[4][1]), items[9]]
    texts = []
    for i in range(120):
        parts = [some(draw.randrange(20))]
        for _ in range(draw.randrange(3)):
            source = item_words(draw.choice(items)[1]) or ["q"]
            start = draw.randrange(len(source))
            parts += [source[start:start + draw.randrange(1, 25)], some(draw.randrange(6))]
        if i % 4 == 0:
            parts.append(template)
        texts.append(draw.choice([" ", ", ", "\n", " - "]).join(x.upper() if draw.random() < .2 else x for p in parts for x in p))
    texts += [None, "", "!?", "one", "two words", texts[3], texts[3], " ".join(x for _, t in items for x in item_words(t))]
    return texts, items


@pytest.mark.parametrize("window, seed", [(10, 5), (7, 7), (4, 1)])
def test_contamination_equals_brute_force(spark, window, seed):
    texts, items = leaky()
    ids = [*range(len(texts) - 4), 400, 401, 401, None]
    docs = spark.createDataFrame(rows(texts, ids), SCHEMA).repartition(4)
    found = contamination(docs, spark.createDataFrame([(*i, "x", 1, 2, 3) for i in items], ITEMS).repartition(3), window, seed)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, [tuple(s) for s in r.spans], list(r["items"])) for r in found.collect())
    want = sorted((-1 if i is None else i, *plain_hits(t, items, window)) for i, t in zip(ids, texts))
    assert got == want
    assert sum(r[2] > 0 for r in want) > 40


def test_decontaminated_drops_what_is_hit(spark):
    texts, items = leaky(4)
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    clean = decontaminated(docs, spark.createDataFrame([(*i, "x", 1, 2, 3) for i in items], ITEMS))
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, t in enumerate(texts) if not plain_hits(t, items, 10)[1]]


def test_contamination_of_empty_tables(spark, tmp_path):
    docs, items = spark.createDataFrame(rows(["a b c", None]), SCHEMA), spark.createDataFrame([], ITEMS)
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.spans, r["items"]) for r in contamination(docs, items).collect()) == [
        (0, 3, 0, [], []), (1, 0, 0, [], [])]
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert op12(spark, str(tmp_path)).count() == 0
    with pytest.raises(ValueError):
        contamination(docs, items, 3, 4)


# --- operator 13 ----------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, x long, w long, i int"


def plain_whitened(vectors, k, weights):
    x = [[math.floor(64 * float(c)) + 1000000 for c in v] for v in vectors]
    count = {}
    for v in x:
        count[tuple(v)] = count.get(tuple(v), 0) + 1
    u = np.array(list(count), dtype=object)
    w = np.array([1 if weights == "one" else c for c in count.values()], dtype=object)
    n, s = int(w.sum()), (u * w[:, None]).sum(axis=0)
    y = np.array([[float(c * n - t) / n for c, t in zip(v, s)] for v in u])
    cov = (y * w.astype(float)[:, None]).T @ y / n
    e, q = np.linalg.eigh(cov)
    order = np.argsort(-e)[:k]
    centred = np.array([[float(c * n - t) / n for c, t in zip(v, s)] for v in x])
    return (n, [int(sum((n * c - t) ** 2 for c, t in zip(v, s))) for v in x],
            centred @ q[:, order] / np.sqrt(e[order]), e[order] / np.trace(cov))


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_equals_plain_version(spark, weights):
    draw = np.random.default_rng(4)
    base = (draw.normal(size=(90, 6)) * [5, 3, 2, 1, .5, 900]).astype(np.float32)
    vectors = [*base.tolist(), *[base[7].tolist()] * 60, *base[:5].tolist()]
    bad = [None, [], [1.0, None, 2.0, 3.0, 4.0, 5.0], [math.nan] * 6, [1.0, 2.0, math.inf, 0.0, 0.0, 0.0], [1.0, 2.0]]
    table = [(i, v, 0, 1, 2, 3) for i, v in enumerate([*vectors, *bad])] + [(None, vectors[0], 0, 1, 2, 3)]
    out = whiten(spark.createDataFrame(table, VECTORS).repartition(7), components=4, weights=weights).collect()
    n, deviation, z, explained = plain_whitened([*vectors, vectors[0]], 4, weights)
    assert len(out) == len(vectors) + 1
    got = {r.vec_id: r for r in out}
    sign = np.sign([g * v for g, v in zip(got[0].whitened, z[0])])
    for i, want, far in zip([*range(len(vectors)), None], z, deviation):
        assert np.allclose(np.array(got[i].whitened), want * sign, rtol=1e-9, atol=1e-9)
        assert (got[i].n, got[i].deviation) == (n, far)
    assert np.allclose(out[0].explained, explained, rtol=1e-9) and out[0].identity_error < 1e-9


def test_whitening_of_awkward_tables(spark, tmp_path):
    frame = lambda vectors: spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in enumerate(vectors)], VECTORS)
    assert whiten(frame([])).count() == 0 and whiten(frame([None, [], [math.nan]])).count() == 0
    one = whiten(frame([[1.0, 2.0]] * 3)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, [None, None], [None, None], None)] * 3
    flat = whiten(frame([[1.0, 5.0], [2.0, 5.0], [3.0, 5.0]])).collect()
    assert all(r.whitened[1] is None and abs(r.whitened[0]) < 2 for r in flat) and flat[0].identity_error < 1e-12
    far = whiten(frame([[3e38, 0.0], [-3e38, 1.0], [0.0, 2.0]])).collect()
    assert [r.deviation is None for r in sorted(far)] == [True, True, False] and all(abs(r.whitened[0]) < 2 for r in far)
    assert frame([[0.5, -0.5, -0.01]]).select(on_grid("embedding")).first()[0] == [1000032, 999968, 999999]
    frame([[1.0, 2.0], [0.0, 1.0], [4.0, -2.0]]).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = op13(spark, str(tmp_path))
    assert found.count() == 6 and sorted({r.component for r in found.collect()}) == [1, 2]
    with pytest.raises(ValueError):
        whiten(frame([]), weights="some")
