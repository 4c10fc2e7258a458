"""Conversation structure repair by survivor-coalescence Viterbi (operator 11)."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entitle.llm.shared import keep, small_batches, split_join, table

# What edits cost, and what a truncated row costs that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Faults of a row.
SOUND, BLANK, DUPLICATE, CUT = range(4)
#: What the repaired rows so far are: nothing, a system row, ending with a user row, ending with an assistant row.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: States from which a row of a role may follow, and the state it leads to.
FOLLOWS = {"s": ((EMPTY,), SYSTEM), "u": ((EMPTY, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
#: MIMIC[x][y]: a path in state x can end like any path in state y for so much more. A survivor dearer than
#: another by more than that is never part of the cheapest repair.
MIMIC = ((0, 0, INSERT, 0), (2 * INSERT, 0, INSERT, 2 * INSERT), (INSERT + DELETE, INSERT, 0, INSERT), (DELETE, 0, INSERT, 0))
LEGAL = {"su", "ua", "au"}
SOLID_END = " \t\n\x0b\x0c\r"
LONG = (1 << 63) - 1
#: Stands for "comes first" in the order of two paths; smaller numbers are the inserts by which one is longer.
BEFORE = 1 << 40
OUT_ROWS = 5000

STATS = "struct<gaps:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint>"
EDITS = f"conv string, turn long, role string, sha binary, at long, edit string, new_role string, stats {STATS}"
ROWS = f"conv string, at long, edit string, turn long, role string, text string, stats {STATS}"
KINDS = pa.struct([(k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")])


class Node:
    """An edit in the tree of backpointers; ``refs`` counts its children and the survivors that end here."""

    __slots__ = ("parent", "letter", "new_role", "kids", "refs")

    def __init__(self, parent: Node | None, letter: str, new_role: str | None):
        self.parent, self.letter, self.new_role, self.kids, self.refs = parent, letter, new_role, [], 0
        if parent is not None:
            parent.kids.append(self)
            parent.refs += 1


def _release(node: Node) -> None:
    node.refs -= 1
    while not node.refs and node.parent is not None:
        parent = node.parent
        parent.kids.remove(node)
        parent.refs -= 1
        node = parent


class Step(NamedTuple):
    """A way to go on from a survivor: to a state, by an edit (none: "") that costs so much."""

    source: int
    target: int
    letter: str
    new_role: str | None
    cost: int


def _row_steps(initial: str, fault: int) -> list[Step]:
    steps = [Step(x, x, "D", None, DELETE) for x in range(4)]
    if fault in (SOUND, CUT):
        more = TRUNCATED if fault == CUT else 0
        if initial in FOLLOWS:
            steps += [Step(x, FOLLOWS[initial][1], "K", None, more) for x in FOLLOWS[initial][0]]
        for role in ("user", "assistant"):
            steps += [Step(x, FOLLOWS[role[0]][1], "R", role, REROLE + more) for x in FOLLOWS[role[0]][0]]
    return steps


STAY = [Step(x, x, "", None, 0) for x in range(4)]
#: A user row may be inserted, and then an assistant row.
INSERTS = [[*STAY, *(Step(x, USER, "I", "user", INSERT) for x in (EMPTY, SYSTEM, ASSISTANT))],
           [*STAY, Step(USER, ASSISTANT, "I", "assistant", INSERT)]]
ROW_STEPS = {(initial, fault): _row_steps(initial, fault) for initial in ("s", "u", "a", "") for fault in range(4)}


class Viterbi:
    """The cheapest edits of one conversation, row by row; of equals, those whose initials come first in ASCII.

    A state has one survivor, its cheapest path. Equally dear paths are told apart by their whole unresolved
    suffixes: ``_order`` has, for two survivors, which of them comes first, or by how many inserts one continues the
    other (both have one letter per row besides, so nothing else can follow a common beginning). It is carried
    along from step to step, so that a comparison takes no walk through the tree.

    ``step`` returns the edits that all survivors share, which leave the tree: memory holds what is
    unresolved, whatever the length of the conversation.
    """

    def __init__(self) -> None:
        self._root = Node(None, "", None)
        self._root.refs = 1
        self._nodes: list[Node | None] = [self._root, None, None, None]
        self._costs = [0, 0, 0, 0]
        self._order = [[0] * 4 for _ in range(4)]

    def _compared(self, x: int, first: str, y: int, second: str) -> int:
        """How (path of x) + first stands to (path of y) + second: -BEFORE, BEFORE, or by how many inserts the second is longer."""
        k = self._order[x][y]
        if k in (BEFORE, -BEFORE):
            return k
        a, b = "I" * -k + first, "I" * k + second
        if b.startswith(a):
            return len(b) - len(a)
        if a.startswith(b):
            return len(b) - len(a)
        return -BEFORE if a < b else BEFORE

    def _advance(self, steps: list[Step]) -> None:
        best: list[Step | None] = [None] * 4
        costs = [0] * 4
        for step in steps:
            if self._nodes[step.source] is None:
                continue
            cost, held = self._costs[step.source] + step.cost, best[step.target]
            if held is None or cost < costs[step.target] or (
                    cost == costs[step.target] and self._comes_first(step, held)):
                best[step.target], costs[step.target] = step, cost
        order = [[0] * 4 for _ in range(4)]
        for x in range(4):
            for y in range(x):
                if best[x] and best[y]:
                    k = self._compared(best[x].source, best[x].letter, best[y].source, best[y].letter)
                    order[x][y], order[y][x] = k, -k
        before = self._nodes
        self._nodes = [None if s is None else before[s.source] if not s.letter else Node(before[s.source], s.letter, s.new_role)
                       for s in best]
        for node in self._nodes:
            if node is not None:
                node.refs += 1
        for node in before:
            if node is not None:
                _release(node)
        self._costs, self._order = costs, order

    def _comes_first(self, step: Step, held: Step) -> bool:
        k = self._compared(step.source, step.letter, held.source, held.letter)
        return k == -BEFORE or 0 < k < BEFORE

    def _drop(self, state: int) -> None:
        _release(self._nodes[state])
        self._nodes[state] = None

    def _resolved(self) -> list[Node]:
        out = []
        while self._root.refs == 1 and self._root.kids:
            self._root = self._root.kids[0]
            self._root.parent = None
            out.append(self._root)
        return out

    def step(self, initial: str, fault: int) -> list[Node]:
        for steps in INSERTS:
            self._advance(steps)
        self._advance(ROW_STEPS[initial if initial in FOLLOWS else "", fault])
        costs, alive = self._costs, [x for x in range(4) if self._nodes[x] is not None]
        for y in [y for y in alive if any(costs[y] > costs[x] + MIMIC[x][y] for x in alive)]:
            self._drop(y)
        return self._resolved()

    def end(self) -> tuple[list[Node], int]:
        """The edits still unresolved, and the cost of all."""
        for steps in INSERTS:
            self._advance(steps)
        last = [x for x in (EMPTY, ASSISTANT) if self._nodes[x] is not None]
        best = min(self._costs[x] for x in last)
        last = [x for x in last if self._costs[x] == best]
        if len(last) == 2 and self._comes_first(Step(ASSISTANT, 0, "", None, 0), Step(EMPTY, 0, "", None, 0)):
            last.reverse()
        for x in range(4):
            if x != last[0] and self._nodes[x] is not None:
                self._drop(x)
        return self._resolved(), best


class _Conversation:
    """One conversation in the course of its repair: counts, and the keys of rows whose edits are unresolved."""

    def __init__(self) -> None:
        self.viterbi, self.keys, self.key = Viterbi(), deque(), (None, "", b"")
        self.at, self.faults, self.illegal, self.initial = 0, [0] * 4, 0, None
        self.least = self.turn = None
        self.turns = 0

    def add(self, turn: int | None, role: str, sha: bytes, fault: int, copies: int) -> list[tuple]:
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.turn = turn
        out, initial, self.key = [], role[:1], (turn, role, sha)
        for _ in range(copies):
            self.faults[fault] += 1
            self.illegal += self.initial is not None and self.initial + initial not in LEGAL
            self.initial = initial
            self.keys.append(self.key)
            out += self.out(self.viterbi.step(initial, fault))
            if fault != BLANK:
                fault = DUPLICATE
        return out

    def out(self, nodes: list[Node]) -> list[tuple]:
        out = []
        for node in nodes:
            # an insert stands beside the row it comes before, or the last
            if node.letter == "I":
                key = self.keys[0] if self.keys else self.key
            else:
                key = self.keys.popleft()
            out.append((*key, self.at, node.letter, node.new_role, None))
            self.at += 1
        return out

    def end(self) -> list[tuple]:
        nodes, cost = self.viterbi.end()
        gaps = 0 if self.turn is None else min(self.turn - self.least + 1 - self.turns, LONG)
        stats = {"gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE],
                 "truncated": self.faults[CUT], "illegal": self.illegal, "cost": cost}
        return [*self.out(nodes), (*self.key, self.at, "", None, stats)]


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of conversations that come one after another, each in order of its rows, and a row that ends each."""
    kinds = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), KINDS]
    names = ["conv", "turn", "role", "sha", "at", "edit", "new_role", "stats"]
    out: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        columns = zip(*out) if out else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    conv, work = None, _Conversation()
    for batch in batches:
        for name, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if name != conv:
                if conv is not None:
                    out += [(conv, *x) for x in work.end()]
                conv, work = name, _Conversation()
            out += [(conv, *x) for x in work.add(*row)]
            if len(out) >= OUT_ROWS:
                yield flushed()
                out.clear()
    if conv is not None:
        out += [(conv, *x) for x in work.end()]
    yield flushed()


def _with_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits with the texts they keep. A key's texts (``at`` null) come before its edits; they are equal, so one is held."""
    key, text = None, None
    names = ["conv", "at", "edit", "turn", "role", "text", "stats"]
    for batch in batches:
        out: list[tuple] = []
        for conv, turn, role, sha, at, edit, new_role, stats, own in zip(*(c.to_pylist() for c in batch.columns)):
            if at is None:
                key, text = (conv, turn, role, sha), own
                continue
            kept = edit in ("K", "R")
            if kept and key != (conv, turn, role, sha):
                raise RuntimeError("an edit without its row")
            now = role if edit == "K" else new_role
            out.append((conv, at, edit, None if edit in ("I", "") else turn, now, text if kept else "" if edit == "I" else None, stats))
        columns = zip(*out) if out else [[]] * len(names)
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), KINDS]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation its initials of edits and the hash of its repaired rows, taken in row by row."""
    audit, sha, lines = bytearray(), hashlib.sha256(), 0
    for batch in batches:
        out: list[tuple] = []
        for conv, edit, role, text, stats in zip(*(c.to_pylist() for c in batch.columns)):
            if not edit:
                out.append((conv, audit.decode(), sha.hexdigest(), stats))
                audit, sha, lines = bytearray(), hashlib.sha256(), 0
                continue
            audit += edit.encode()
            if edit != "D":
                sha.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
        columns = zip(*out) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, [pa.string(), pa.string(), pa.string(), KINDS])],
                                         ["conv", "audit", "repaired_sha256", "stats"])


def conversation_key(column: str = "conv_id") -> Column:
    """A conversation's id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("")).alias("conv")


def repair(conversations: DataFrame) -> DataFrame:
    """One row per edit of the cheapest repair, and one row (``edit`` empty) at the end of each conversation:
    conv, at, edit, turn, role, text, stats.

    Rows of a conversation count in the order of (turn, role, SHA-256 of the text), nulls first. Their first fault
    counts: blank (no other character than ``[\\x20\\x09-\\x0D]``), duplicate (role and text seen earlier), truncated
    (the last such character is not one of ``.!?``). Edits: K keeps a row (0), R gives it the role user or
    assistant (1), D deletes it (2; blank and duplicate rows must go), I inserts an empty row of user or assistant
    (5); a truncated row that stays costs 5 more. The initials of the roles that stay read ``(s?(ua)+)?``. The cheapest
    edits are taken, of equals those whose initials in order come first in ASCII.

    ``at`` numbers the edits, ``role`` and ``text`` are what stands in the repaired conversation (null where deleted),
    ``stats`` (in the last row) has gaps, blank, duplicate, truncated, illegal (neighbours whose initials are
    not su, ua or au) and cost. Rows come partitioned by conversation, sorted by ``at``.

    Equal rows become one with a count, duplicates are found by a join on the text's hash that splits hot
    keys, and the Viterbi pass reads short rows without texts, in sorted order: it holds one row and the
    unresolved edits at a time. Texts meet the edits by a sort in a second pass that holds one text. So a conversation
    of any length takes bounded memory but for what is unresolved, yet its passes are sequential: the
    repair of a row depends on all before it, as does the hash.

    Nulls in text and role count as one space, a null conv_id is a conversation (``conv`` is empty; else "=" and the
    id), null turns come first and have no gaps. Rows repeated with the same turn follow each other. An empty table
    gives no rows; other columns are not read.
    """
    space = F.lit(" ")
    rows = small_batches(conversations).select(
        conversation_key(), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    end = F.rtrim("text", F.lit(SOLID_END))
    fault = F.when(end == "", BLANK).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(SOUND)
    groups = keep(rows.groupBy("conv", "turn", "role", "sha", fault.alias("fault")).agg(F.count(F.lit(1)).alias("copies")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    same = ["conv", "role", "sha"]
    first = groups.where(F.col("fault") != BLANK).groupBy(*same).agg(F.min(place).alias("first"))
    groups = split_join(groups, first, same, "left").withColumn(
        "fault", F.when((F.col("fault") != BLANK) & (F.col("first") < place), DUPLICATE).otherwise(F.col("fault")))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("sha")]
    edits = keep(groups.select("conv", "turn", "role", "sha", "fault", "copies").repartition("conv").sortWithinPartitions(*order)
                 .mapInArrow(_edits, EDITS))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in
            (("at", "long"), ("edit", "string"), ("new_role", "string"), ("stats", STATS))]
    both = edits.withColumn("text", F.lit(None).cast("string")).unionByName(rows.select("conv", "turn", "role", "sha", *none, "text"))
    return (both.repartition("conv").sortWithinPartitions(*order, F.col("at").asc_nulls_first())
            .select("conv", "turn", "role", "sha", "at", "edit", "new_role", "stats", "text").mapInArrow(_with_texts, ROWS))


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id as text, place, role and text of the repaired rows; same cases as ``repair``."""
    return repair(conversations).where("edit IN ('K', 'R', 'I')").select(
        F.when(F.col("conv") != "", F.substring("conv", 2, LONG >> 32)).alias("conv_id"), F.col("at").alias("place"), "role", "text")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the faults that the check sum of ``conv_id:turn`` says, nulls as one space."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind, text = F.col("_kind"), F.coalesce("text", space)
    return conversations.select("conv_id", "turn", "role", "text", (F.crc32(name) % 20).alias("_kind")).select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = small_batches(table(spark, sf_dir, "conversations"))
    names = conversations.select(conversation_key(), "conv_id").distinct()
    digests = repair(damaged(conversations)).select("conv", "edit", "role", "text", "stats").mapInArrow(
        _digests, f"conv string, audit string, repaired_sha256 string, stats {STATS}")
    numbers = [F.coalesce(F.col(f"stats.{k}"), F.lit(0).cast("long")).alias(k)
               for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return names.join(digests, "conv", "left").select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


CHECK_SUM = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(name, ''), lambda x: [ord(x), 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""
# a path is a struct: cost, initials, repaired rows with a newline after each; the cost of one that cannot be is FAR
OP11_SQL = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
k AS (SELECT *, {CHECK_SUM} % 20 AS kind FROM c),
g AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, left(role, 1) AS initial FROM g),
f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated'
  ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM n),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (prior || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS last FROM f GROUP BY conv_id),
v AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'e': '', 'r': ''}} AS e,
  {{'c': CAST(1000000 AS BIGINT), 'e': '', 'r': ''}} AS s, {{'c': CAST(1000000 AS BIGINT), 'e': '', 'r': ''}} AS u,
  {{'c': CAST(1000000 AS BIGINT), 'e': '', 'r': ''}} AS a FROM c
UNION ALL SELECT conv_id, i,
  {{'c': e.c + 2, 'e': e.e || 'D', 'r': e.r}},
  least({{'c': s.c + 2, 'e': s.e || 'D', 'r': s.r}}, {{'c': e.c + keep + CASE initial WHEN 's' THEN 0 ELSE 1000000 END, 'e': e.e || 'K', 'r': e.r || line}}),
  least({{'c': u.c + 2, 'e': u.e || 'D', 'r': u.r}}, {{'c': p.c + keep + CASE initial WHEN 'u' THEN 0 ELSE 1000000 END, 'e': p.e || 'K', 'r': p.r || line}},
    {{'c': p.c + keep + 1, 'e': p.e || 'R', 'r': p.r || 'user:' || text || chr(10)}}),
  least({{'c': a.c + 2, 'e': a.e || 'D', 'r': a.r}}, {{'c': u.c + keep + CASE initial WHEN 'a' THEN 0 ELSE 1000000 END, 'e': u.e || 'K', 'r': u.r || line}},
    {{'c': u.c + keep + 1, 'e': u.e || 'R', 'r': u.r || 'assistant:' || text || chr(10)}})
  FROM (SELECT *, least(e, s, a) AS p FROM (
    SELECT * EXCLUDE (a), least(a, {{'c': u.c + 5, 'e': u.e || 'I', 'r': u.r || 'assistant:' || chr(10)}}) AS a FROM (
      SELECT v.conv_id, f.i, v.e, v.s, v.a, f.initial, f.text, f.role || ':' || f.text || chr(10) AS line,
        CASE f.fault WHEN 'truncated' THEN 5 WHEN '' THEN 0 ELSE 1000000 END AS keep,
        least(v.u, {{'c': least(v.e, v.s, v.a).c + 5, 'e': least(v.e, v.s, v.a).e || 'I', 'r': least(v.e, v.s, v.a).r || 'user:' || chr(10)}}) AS u
      FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i + 1)))),
z AS (SELECT v.conv_id, t.* EXCLUDE (conv_id), least(e, a, {{'c': u.c + 5, 'e': u.e || 'I', 'r': u.r || 'assistant:' || chr(10)}}) AS best
  FROM v LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM v.conv_id WHERE v.i = coalesce(t.last, 0))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.c AS cost, best.e AS audit, sha256(best.r[:-2]) AS repaired_sha256 FROM z
"""
