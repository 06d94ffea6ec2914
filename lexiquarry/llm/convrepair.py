"""Least-cost repair of conversations to a grammar of roles, by layers of cost over bitsets of grammar states.

The grammar is an optional system turn and then user and assistant in turn, or nothing: four states (nothing yet, after system, after user, after assistant). For each row, from the
last to the first, there is a bitset of states for every cost: those from which the rest can be repaired at that cost. The layer of cost c comes from layers of the
row after it: c less an edit's cost, through the states that the edit leads from; and from itself, three below, by an insertion. Layers below the first with a state and
above the first with all four carry nothing, so a row keeps a handful of them. The first layer that holds the state "nothing yet" at the first row is the cost of the conversation. A
bit that is set says which edits lead on at least cost, and of these the first in order is the audit's next letter.

Rows pass through both ways as sorted streams: backward, a row's layers decide its edit for each of the four states that it may be met in; forward, these are followed, and
counted and written out. So a conversation takes the memory of its audit, however many rows or long texts it has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiquarry.llm.common import table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3  # costs; keeping a row costs nothing
SPACES = " \t\n\v\f\r"
NONE, BLANK, DUPLICATE, CUT = range(4)  # faults of a row, the first that it has
START, SYSTEM, USER, ASSISTANT = range(4)
FORCED = (USER, USER, ASSISTANT, USER)  # the state that an inserted or reroled turn leads to
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}  # where a kept row leads, by its role's initial
LEGAL = ("su", "ua", "au")
ALL = 0b1111


def _before(step: dict[int, int]) -> list[int]:
    """For every bitset of states, the bitset of those that ``step`` leads into it from."""
    return [sum(1 << s for s, t in step.items() if to >> t & 1) for to in range(16)]


_BEFORE_FORCED = _before(dict(enumerate(FORCED)))
_BEFORE_KEPT = {i: _before(step) for i, step in KEPT.items()} | {"": [0] * 16}


def _layers(of) -> tuple[int, ...]:
    """Layers of rising cost by ``of(cost, so far)`` up to the first that holds every state; a state in one is in all above."""
    out: list[int] = []
    while not out or out[-1] != ALL:
        c = len(out)
        x = of(c) | (out[-1] if out else 0)
        out.append(x | (_BEFORE_FORCED[out[c - INSERT]] if c >= INSERT else 0))
    return tuple(out)


END = _layers(lambda c: 1 << START | 1 << ASSISTANT)  # after the last row: done, or insertions to come


def _at(layers: tuple[int, ...], c: int) -> int:
    return layers[min(c, len(layers) - 1)] if c >= 0 else 0


def _cost(layers: tuple[int, ...], state: int) -> int:
    return next(c for c, x in enumerate(layers) if x >> state & 1)


@lru_cache(maxsize=4096)
def back(after: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], int, int]:
    """``(layers, base, code)`` of a row from the layers after it; ``base`` is what the layers' costs all have in common, taken off. ``initial`` is ``s``, ``u``, ``a`` or empty for any other.

    ``code`` holds, for each state, 8 bits: how many insertions come before the row, its own edit (D, K, R: 0 to 2), and the state after it.
    """
    stays, extra = fault not in (BLANK, DUPLICATE), TRUNCATED if fault == CUT else 0

    def of(c: int) -> int:
        x = _at(after, c - DELETE)
        if stays:
            x |= _BEFORE_KEPT[initial][_at(after, c - extra)] | _BEFORE_FORCED[_at(after, c - REROLE - extra)]
        return x

    layers = _layers(of)
    code = 0
    for state in range(4):
        now, c, inserted = state, _cost(layers, state), 0
        while True:  # the letters in order: D, I, K, R
            if _at(after, c - DELETE) >> now & 1:
                edit = 0
            elif c >= INSERT and _at(layers, c - INSERT) >> FORCED[now] & 1:
                now, c, inserted = FORCED[now], c - INSERT, inserted + 1
                continue
            elif (kept := KEPT.get(initial, {}).get(now)) is not None and _at(after, c - extra) >> kept & 1:
                edit, now = 1, kept
            else:
                edit, now = 2, FORCED[now]
            break
        code |= (inserted << 4 | edit << 2 | now) << 8 * state
    base = next(c for c, x in enumerate(layers) if x)
    return layers[base:], base, code


def _signed(code: int) -> int:
    return code - (1 << 32) if code >> 31 else code


def initial_of(role: str) -> str:
    return role[:1] if role[:1] in KEPT else ""


def decide(rows: Iterator[tuple]) -> Iterator[tuple[int, int]]:
    """``(code, cost from here on if nothing came before)`` for rows ``(conversation, gone, role, fault)`` of sorted conversations, each from its last row to its first."""
    own, begun, layers, total = None, False, END, 0
    for conv, gone, role, fault in rows:
        if not begun or conv != own:
            own, begun, layers, total = conv, True, END, 0
        code = 0
        if not gone:
            layers, base, code = back(layers, initial_of(role), fault)
            total += base
        yield _signed(code), total + _cost(layers, START)


@dataclass
class Conversation:
    """What is known of one conversation while its rows pass in order."""

    conv: object
    state: int = START
    cost: int = 0
    audit: list = field(default_factory=list)
    counts: list = field(default_factory=lambda: [0, 0, 0, 0])
    illegal: int = 0
    last: str | None = None
    low: int | None = None
    high: int | None = None
    distinct: int = 0
    place: int = 0
    digest: object = field(default_factory=hashlib.sha256)

    def _write(self, role: str, text: str, edit: str, turn):
        self.digest.update(f"{chr(10) if self.place else ''}{role}:{text}".encode())
        self.place += 1
        return self.conv, self.place, turn, role, text, edit

    def _insert(self):
        self.audit.append("I")
        self.state = FORCED[self.state]
        return self._write(ROLE[self.state], "", "I", None)

    def take(self, turn, role: str, text: str, fault: int, code: int, cost: int) -> Iterator[tuple]:
        """The repaired rows that this row brings about."""
        if self.last is None:
            self.cost = cost
        elif self.last + role[:1] not in LEGAL:
            self.illegal += 1
        self.last = role[:1]
        self.counts[fault] += 1
        if turn is not None:
            self.distinct += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        todo = (code & 0xFFFFFFFF) >> 8 * self.state & 0xFF
        for _ in range(todo >> 4):
            yield self._insert()
        edit = "DKR"[todo >> 2 & 3]
        self.audit.append(edit)
        self.state = todo & 3
        if edit != "D":
            yield self._write(role if edit == "K" else ROLE[self.state], text, edit, turn)

    def close(self) -> Iterator[tuple]:
        while self.state not in (START, ASSISTANT):
            yield self._insert()

    def report(self) -> tuple:
        gaps = min(self.high - self.low + 1 - self.distinct, (1 << 63) - 1) if self.distinct else 0
        return self.conv, gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[CUT], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def _decided(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Every row with its fault and its edits' code, in order within the partition that holds its whole conversation; ``gone`` rows only stand for their conversation."""
    have = lambda c: F.coalesce(F.col(c), F.lit(" "))
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    base = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), have(role).alias("role"), have(text).alias("text"), gone.alias("gone")).repartition("conv")
    seen = F.row_number().over(Window.partitionBy("conv", "gone", "role", "text").orderBy(F.asc_nulls_first("turn")))
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    faulty = base.withColumn("nth", seen).withColumn("fault", F.when(F.col("gone"), NONE).when(bare == "", BLANK).when(F.col("nth") > 1, DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(NONE))
    backward = faulty.sortWithinPartitions(F.desc_nulls_last("conv"), F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc("nth"))
    names = backward.columns

    def run(source):
        def rows():
            for batch in source:
                held.append(batch)
                yield from zip(*(batch.column(names.index(c)).to_pylist() for c in ("conv", "gone", "role", "fault")))

        held: list = []
        given = decide(rows())
        for first in given:
            batch = held.pop()
            codes = [first, *(next(given) for _ in range(batch.num_rows - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c for c, _ in codes], pa.int32()), pa.array([t for _, t in codes], pa.int64())], [*names, "code", "cost"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in backward.schema)
    return backward.mapInArrow(run, f"{kinds}, code int, cost long").sortWithinPartitions(F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text", "nth")


def _followed(source, names: list[str], rows: bool):
    """Repaired rows, or the reports, of the conversations of a sorted partition."""
    now, out = None, []
    for batch in source:
        for conv, turn, role, text, gone, fault, code, cost in zip(*(batch.column(names.index(c)).to_pylist() for c in ("conv", "turn", "role", "text", "gone", "fault", "code", "cost"))):
            if now is None or now.conv != conv:
                if now:
                    tail = list(now.close())
                    out += tail if rows else [now.report()]
                now = Conversation(conv)
            if not gone:
                made = list(now.take(turn, role, text, fault, code, cost))
                if rows:
                    out += made
        yield out
        out = []
    if now:
        tail = list(now.close())
        yield tail if rows else [now.report()]


def _results(decided: DataFrame, rows: bool, id_col: str, ddl: str) -> DataFrame:
    names, kind = decided.columns, decided.schema["conv"].dataType.simpleString()
    spark = decided.sparkSession
    ddl = f"`{id_col}` {kind}, {ddl}"
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark.createDataFrame([], ddl).schema)

    def run(source):
        for some in _followed(source, names, rows):
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)

    return decided.mapInArrow(run, ddl)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conversation, place, turn, role, text, edit)``: the rows of the repaired conversations in order; edit is K, R or I, and inserted rows have no turn and an empty text.

    See :func:`audit` for what counts as a fault and how the cases are read.
    """
    return _results(_decided(rows, conv, turn, role, text), True, conv, "place long, turn long, role string, text string, edit string")


def audit(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows are taken by turn, null turns first; rows of one turn by role, then text. A null role or text is one space; rows with a null conversation are
    one conversation. A repeated row is a duplicate of the first. A conversation whose rows are all ``gone`` (a column that may mark rows as not there) has zeros, an empty audit and the hash of
    nothing. Texts of any length stream by. No rows give none; other columns are ignored. Gaps beyond 64 bits are given as the greatest such number.

    One shuffle, by conversation. The rows of one are met in one task, since the hash of its repaired text is made in their order; they are sorted with spilling and stream
    through, so that memory does not grow with them but for the audit, a letter for each edit.
    """
    ddl = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _results(_decided(rows, conv, turn, role, text), False, conv, ddl)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by the checksum of ``conv_id:turn``; a dropped row stays as a mark (``gone``), without its text."""
    have = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat_ws(":", have("conv_id"), have("turn")).cast("binary")) % 20
    each = rows.select("conv_id", "turn", have("role").alias("role"), have("text").alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return each.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(damaged(table(spark, sf_dir, "conversations")))


def _oracle() -> str:
    nxt = 2, 2, 3, 2  # states in order: start, system, user, assistant
    name = {2: "user", 3: "assistant"}
    line = lambda role, text, rest: f"chr(10) || {role} || ':' || {text} || {rest}"
    kept = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    own = []
    for s in range(4):
        keep = "CASE i " + " ".join(f"WHEN '{i}' THEN struct_pack(c := extra + b[{t[s] + 1}].c, a := 'K' || b[{t[s] + 1}].a, t := {line('role', 'text', f'b[{t[s] + 1}].t')})" for i, t in kept.items() if s in t) + " END"
        n = nxt[s]
        own.append(f"""list_min([struct_pack(c := 4 + b[{s + 1}].c, a := 'D' || b[{s + 1}].a, t := b[{s + 1}].t)] || CASE WHEN stays THEN list_filter([{keep},
  struct_pack(c := 3 + extra + b[{n + 1}].c, a := 'R' || b[{n + 1}].a, t := {line(f"'{name[n]}'", 'text', f'b[{n + 1}].t')})], lambda x: x IS NOT NULL) ELSE [] END)""")
    full = []
    for s in range(4):
        ways, at, head = [f"n[{s + 1}]"], s, ""
        for i in range(1, 4):
            at = nxt[at]
            head += f"chr(10) || '{name[at]}:' || "
            ways.append(f"struct_pack(c := {3 * i} + n[{at + 1}].c, a := '{'I' * i}' || n[{at + 1}].a, t := {head}n[{at + 1}].t)")
        full.append(f"list_min([{', '.join(ways)}])")
    end = "[" + ", ".join(f"struct_pack(c := {c}::BIGINT, a := '{a}', t := {t})" for c, a, t in ((0, "", "''"), (6, "II", "chr(10) || 'user:' || chr(10) || 'assistant:'"), (3, "I", "chr(10) || 'assistant:'"), (0, "", "''"))) + "]"
    crc = "list_reduce([4294967295::BIGINT] || list_transform(string_split(key, ''), lambda x: ord(x)::BIGINT), lambda h, o: list_reduce([xor(h, o)] || range(8), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1))))"
    return f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT *, xor({crc}, 4294967295::BIGINT) % 20 AS h FROM k),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) AS nth, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM d)),
f AS MATERIALIZED (SELECT conv_id, turn, role, text, p, left(role, 1) AS i, CASE WHEN bare = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM o),
r(conv_id, p, b) AS (SELECT conv_id, max(p) + 1, {end} FROM f GROUP BY conv_id
  UNION ALL SELECT conv_id, p, [{", ".join(full)}] FROM (SELECT conv_id, p, [{", ".join(own)}] AS n FROM (
    SELECT f.*, r.b, fault NOT IN (1, 2) AS stays, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS extra FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.p = r.p - 1))),
e AS (SELECT conv_id, b[1] AS best FROM r WHERE p = 1),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY p) || i AS pair FROM f) GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
  coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


QUERIES = {"op12_conversation_repair": query}
ORACLES = {"op12_conversation_repair": _oracle()}
