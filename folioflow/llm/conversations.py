"""Conversation structure repair: A* on the edit lattice of each conversation's rows.

A node of the lattice is (rows consumed, role state): nothing yet, after the system row, after a user row, after
an assistant row. Edits lead on: Keep a row, Rerole it, Delete it, Insert one. The heuristic is the suffix
sum of charges that no repair escapes: a deletion for each blank or duplicate row left, one for each truncated
row left (deleting it costs more). It never exceeds the cost to go and never falls faster than an
edit costs, so nodes leave the queue, keyed (cost plus heuristic, audit so far), with their least cost and
the ASCII-least audit of that cost.

Rows are sorted by ranges of (conversation, turn, ...), so a conversation of any size is spread over tasks. Those that lie
in one task are repaired there, PIECE rows of lattice at a time. Those that a range's end cuts are
repaired by parts: each task solves its part from every role state to every other, the parts of a conversation are
chained by a table of 16 costs and audits each, and each part then gets the edits of the one path.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Role states: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row. What may follow, and which may end.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
LAST = (0, 3)
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: Rows of lattice that are searched at once.
PIECE = 256
SPACES = "\x20\t\n\x0b\x0c\r"

OK, TRUNC, DUP, BLANK = range(4)


def fault(text: str, seen: bool) -> int:
    held = text.strip(SPACES)
    return BLANK if not held else DUP if seen else TRUNC if held[-1] not in ".!?" else OK


def search(initials: list[str], faults: list[int], start: int, goals: tuple[int, ...], every: bool) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) from role state `start` before the first row to states after the last: the best of `goals`, or each if `every`."""
    n = len(initials)
    least = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + (DELETE if faults[i] >= DUP else TRUNCATED if faults[i] == TRUNC else 0)
    queue, done, found = [(least[0], "", 0, start)], set(), {}
    while queue:
        f, audit, i, q = heapq.heappop(queue)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == n and q in goals:
            found[q] = (f, audit)
            if not every:
                break
        cost, after = f - least[i], NEXT[q]
        for role, to in after.items():
            if role in ROLE and (i, to) not in done:
                heapq.heappush(queue, (f + INSERT, audit + "I", i, to))
        if i < n:
            charge = cost + least[i + 1]
            heapq.heappush(queue, (charge + DELETE, audit + "D", i + 1, q))
            if faults[i] < DUP:
                charge += TRUNCATED * (faults[i] == TRUNC)
                if initials[i] in after:
                    heapq.heappush(queue, (charge + KEEP, audit + "K", i + 1, after[initials[i]]))
                for role, to in after.items():
                    if role in ROLE:
                        heapq.heappush(queue, (charge + REROLE, audit + "R", i + 1, to))
    return found


class Path:
    """An audit as a chain of parts, so that paths share what they have in common."""

    __slots__ = ("before", "part", "cost", "state", "depth")

    def __init__(self, before: Path | None, part: str, cost: int, state: int):
        self.before, self.part, self.cost, self.state = before, part, cost, state
        self.depth = before.depth + 1 if before else 0

    def parts(self, stop: Path | None = None) -> list[str]:
        out, at = [], self
        while at is not stop:
            out.append(at.part)
            at = at.before
        return out[::-1]

    def less(self, other: Path) -> bool:
        """By cost, then by audit, compared from where the two chains (of equal depth) part."""
        if self.cost != other.cost:
            return self.cost < other.cost
        a, b = self, other
        while a is not b:
            a, b = a.before, b.before
        return "".join(self.parts(a)) < "".join(other.parts(a))


def chained(fronts: dict[int, Path], table: dict[tuple[int, int], tuple[int, str]]) -> dict[int, Path]:
    """The best path to each state after one more part, given that part's table by (from, to)."""
    out: dict[int, Path] = {}
    for (a, b), (cost, audit) in table.items():
        if a in fronts:
            path = Path(fronts[a], audit, fronts[a].cost + cost, b)
            if b not in out or path.less(out[b]):
                out[b] = path
    return out


def best_paths(initials: list[str], faults: list[int], starts: tuple[int, ...], whole: bool) -> dict[tuple[int, int], tuple[int, str]]:
    """Least (cost, audit) by (from, to) over any number of rows; for a whole conversation only that of the best end."""
    out, n = {}, len(initials)
    cuts = list(range(0, n, PIECE)) or [0]
    if whole and len(cuts) == 1:
        return {(s, q): x for s in starts for q, x in search(initials, faults, s, LAST, False).items()}
    tables = [{(s, q): x for s in range(4) for q, x in search(initials[c : c + PIECE], faults[c : c + PIECE], s, (0, 1, 2, 3), True).items()} for c in cuts]
    for s in starts:
        fronts = {s: Path(None, "", 0, s)}
        for table in tables:
            fronts = chained(fronts, table)
        ends = fronts
        if whole:
            ends = {}
            for q in LAST:
                if q in fronts and (not ends or fronts[q].less(next(iter(ends.values())))):
                    ends = {q: fronts[q]}
        out |= {(s, q): (p.cost, "".join(p.parts())) for q, p in ends.items()}
    return out


def edited(audit: str, state: int, rows):
    """The repaired (role, text) of rows [(role, text)], from a role state on; yields (edit, role, text), deleted rows with None."""
    rows = iter(rows)
    for edit in audit:
        role, text = (None, "") if edit == "I" else next(rows)
        if edit == "D":
            yield edit, None, None
            continue
        if edit != "K":
            role = next(ROLE[x] for x in NEXT[state] if x in ROLE)
        state = NEXT[state][role[:1]]
        yield edit, role, text


def spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """rows with `draw`, crc32 of `conv_id:turn` mod 20, and the damage done where it is not 0 (which drops the row).

    Nulls of role and text are one space, as they are in `conv_id:turn`. 1 empties the text, 2 takes out its [.!?], 3 repeats the
    row, 4 makes its role user.
    """
    draw = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    base = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), draw.alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("draw") == 3, 2).otherwise(1)))
    return base.select("conv_id", "turn", role.alias("role"), text.alias("text"), "draw", copies.alias("_copy")).drop("_copy")


def batch_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


FOUND = "conv_id bigint, part bigint, at bigint, role string, text string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string, edits array<string>, roles array<string>, texts array<string>"


def stretches(batches, most: int = 1000):
    """(is it the first run, is it the last, rows) of each run of equal first columns; the first and the last come in stretches."""
    first, held, now, begun = True, [], None, False
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if begun and row[0] != now:
                yield first, False, held
                first, held = False, []
            elif first and len(held) >= most:
                yield True, False, held
                held = []
            now, begun = row[0], True
            held.append(row)
    if held:
        yield first, True, held


def solver(with_rows: bool):
    """A mapInArrow function over sorted (conv_id, role, text), giving FOUND.

    A conversation between the first and the last of the partition is solved. An end of the range may cut those two: their rows are
    passed on, with `part` and `at` for their order.
    """

    def run(batches):
        part, out, at = TaskContext.get().partitionId(), [], 0
        for first, last, rows in stretches(batches):
            if first or last:
                for i in range(0, len(rows), 1000):
                    some = rows[i : i + 1000]
                    yield batch_of(FOUND, [(c, part, at + k, r, t, *[None] * 10) for k, (c, r, t) in enumerate(some)])
                    at += len(some)
                continue
            seen, faults = set(), []
            for _, role, text in rows:
                faults.append(fault(text, (role, text) in seen))
                seen.add((role, text))
            initials = [r[1][:1] for r in rows]
            (((_, _), (cost, audit)),) = best_paths(initials, faults, (0,), True).items()
            done = list(edited(audit, 0, (r[1:] for r in rows)))
            said = "\n".join(f"{r}:{t}" for e, r, t in done if e != "D")
            counts = [faults.count(BLANK), faults.count(DUP), faults.count(TRUNC), illegal_pairs(initials), cost]
            lists = zip(*done, strict=True) if with_rows and done else [None] * 3
            out.append((rows[0][0], part, None, None, None, *counts, audit, hashlib.sha256(said.encode()).hexdigest(), *lists))
            if len(out) >= 1000:
                yield batch_of(FOUND, out)
                out = []
        if out:
            yield batch_of(FOUND, out)

    return run


TABLE = "conv_id bigint, part bigint, first bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, froms array<bigint>, tos array<bigint>, costs array<bigint>, audits array<string>"
CHOSEN = "conv_id bigint, part bigint, first bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
EDITS = "part bigint, at bigint, edits string"
REDONE = "conv_id bigint, place bigint, edit string, role string, text string, repaired_sha256 string"


def solved_part(rows: pa.Table) -> pa.Table:
    """applyInArrow over (conv_id, part, at, initial, fault), a conversation's rows in one range: its least costs and audits from state to state."""
    rows = rows.sort_by("at").to_pydict()
    initials, faults = rows["initial"], rows["fault"]
    table = best_paths(initials, faults, (0, 1, 2, 3), False)
    cells = [a for a, _ in table], [b for _, b in table], [c for c, _ in table.values()], [x for _, x in table.values()]
    counts = [faults.count(x) for x in (BLANK, DUP, TRUNC)]
    return pa.Table.from_batches([batch_of(TABLE, [(rows["conv_id"][0], rows["part"][0], rows["at"][0], *counts, illegal_pairs(initials), initials[0], initials[-1], *cells)])])


def chosen(parts: pa.Table) -> pa.Table:
    """applyInArrow over TABLE, the parts of a conversation: each part's edits on the one best path."""
    parts = sorted(parts.to_pylist(), key=lambda p: p["part"])
    fronts = {0: Path(None, "", 0, 0)}
    for p in parts:
        fronts = chained(fronts, {(a, b): (c, x) for a, b, c, x in zip(p["froms"], p["tos"], p["costs"], p["audits"], strict=True)})
    ends = [fronts[q] for q in LAST if q in fronts]
    path = ends[1] if len(ends) > 1 and ends[1].less(ends[0]) else ends[0]
    out = []
    for k, p in reversed(list(enumerate(parts))):
        joint = int(k > 0 and parts[k - 1]["tail"] + p["head"] not in LEGAL)
        cost = path.cost - path.before.cost
        out.append((p["conv_id"], p["part"], p["first"], p["blank"], p["duplicate"], p["truncated"], p["illegal"] + joint, cost, path.part))
        path = path.before
    return pa.Table.from_batches([batch_of(CHOSEN, out)])


def edits_by_row(batches):
    """mapInArrow over CHOSEN: each row's edit after the insertions before it; insertions at a part's end go to its last row."""
    for batch in batches:
        for p in batch.to_pylist():
            by_row = re.findall("I*[DKR]", p["audit"])
            by_row[-1] += p["audit"][sum(map(len, by_row)) :]
            for i in range(0, len(by_row), 10_000):
                yield batch_of(EDITS, [(p["part"], p["first"] + k, e) for k, e in enumerate(by_row[i : i + 10_000], i)])


def redone(with_rows: bool):
    """A mapInArrow function over (conv_id, role, text, edits) in each conversation's order, giving REDONE: its digest as a row without an edit, and its rows if asked for."""

    def run(batches):
        now, begun, state, sha, at = None, False, 0, None, 0
        for batch in batches:
            out = []
            for conv, role, text, edits in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not begun or conv != now:
                    if begun:
                        out.append((now, None, None, None, None, sha.hexdigest()))
                    now, begun, state, sha, at = conv, True, 0, hashlib.sha256(), 0
                    parted = b""
                for edit, r, t in edited(edits, state, [(role, text)]):
                    if edit != "D":
                        sha.update(parted + f"{r}:{t}".encode())
                        state, parted = NEXT[state][r[:1]], b"\n"
                    if with_rows:
                        out.append((now, at, edit, r, t, None))
                    at += 1
            if out:
                yield batch_of(REDONE, out)
        if begun:
            yield batch_of(REDONE, [(now, None, None, None, None, sha.hexdigest())])

    return run


def repair(rows: DataFrame, scratch: Scratch, with_rows: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(conversations, repaired rows) of rows (conv_id, turn, role, text), none of role and text null.

    conversations: conv_id, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Repaired rows, if asked for: conv_id,
    place (from 0, in the order of the audit), edit, role, text; deleted rows have neither role nor text. Rows are taken by turn, nulls
    first, ties by role, then by the text's MD5. Null conv_ids are one conversation. A role is judged by its first character; an
    empty one is never legal.
    """
    ordered = ["conv_id", "turn", "role", "_md5", "_id"]
    keyed = rows.select("conv_id", "turn", "role", "text", F.md5(F.col("text").cast("binary")).alias("_md5"), F.monotonically_increasing_id().alias("_id"))
    sorted_rows = keyed.repartitionByRange(*ordered).sortWithinPartitions(*ordered).select("conv_id", "role", "text")
    found = scratch.save(sorted_rows.mapInArrow(solver(with_rows), FOUND), "found", keep=True)
    totals = ["blank", "duplicate", "truncated", "illegal", "cost"]
    whole = found.filter("audit IS NOT NULL")
    raw = found.filter("audit IS NULL").select("conv_id", "part", "at", "role", "text")
    # what an end of a range cuts
    firsts = raw.groupBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256).alias("_text")).agg(F.min(F.struct("part", "at")).alias("f")).select(F.col("f.part").alias("_p"), F.col("f.at").alias("_a"))
    held = F.btrim(F.col("text"), F.lit(SPACES))
    bad = F.when(held == "", BLANK).when(F.col("_p").isNull(), DUP).when(~F.substring(held, -1, 1).isin(".", "!", "?"), TRUNC).otherwise(OK)
    marked = raw.join(firsts, (F.col("part") == F.col("_p")) & (F.col("at") == F.col("_a")), "left")
    marked = marked.select("conv_id", "part", "at", F.substring("role", 1, 1).alias("initial"), bad.alias("fault"))
    parts = marked.groupBy("conv_id", "part").applyInArrow(solved_part, TABLE)
    path = scratch.save(parts.groupBy("conv_id").applyInArrow(chosen, CHOSEN), "path", keep=True)
    edits = path.mapInArrow(edits_by_row, EDITS)
    again = raw.join(edits, ["part", "at"]).select("conv_id", "part", "at", "role", "text", "edits")
    again = again.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at").select("conv_id", "role", "text", "edits").mapInArrow(redone(with_rows), REDONE)
    if with_rows:
        again = scratch.save(again, "redone", keep=True)
    audits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda p: p["audit"]), "").alias("audit")
    cut = path.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in totals], audits)
    digests = again.filter("edit IS NULL").select(F.col("conv_id").alias("_c"), "repaired_sha256")
    cut = cut.join(digests, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    out = whole.select("conv_id", *totals, "audit", "repaired_sha256").unionByName(cut)
    if not with_rows:
        return out, None
    listed = whole.select("conv_id", F.posexplode(F.arrays_zip("edits", "roles", "texts")).alias("place", "e")).select("conv_id", F.col("place").cast("bigint").alias("place"), F.col("e.edits").alias("edit"), F.col("e.roles").alias("role"), F.col("e.texts").alias("text"))
    return out, listed.unionByName(again.filter("edit IS NOT NULL").select("conv_id", "place", "edit", "role", "text"))


def structure(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """Damaged conversations repaired: a row for every conv_id of the table, null too; one without rows left has zeros and an empty audit.

    gaps counts the turns missing between the least and the largest; other columns are not read, an empty table gives no rows.
    """
    rows = damage(conversations)
    turn = F.when(F.col("draw") != 0, F.col("turn"))
    ids = rows.groupBy("conv_id").agg((F.max(turn) - F.min(turn) + 1 - F.countDistinct(turn)).alias("gaps"))
    repaired, _ = repair(rows.filter("draw != 0"), scratch)
    nothing = hashlib.sha256(b"").hexdigest()
    joined = ids.join(repaired.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def step_sql(state: str, edit: str, cost: int, role: str = "", text: str = "''") -> str:
    """SQL of a path {c, a, t} (cost, audit, repaired text) after one more edit; deletions add no text."""
    added = f"{state}.t" if edit == "D" else f"{state}.t || CASE WHEN {state}.t = '' THEN '' ELSE chr(10) END || {role} || ':' || {text}"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}{'' if edit in 'DI' else ' + (r.fault = 1)::INT'}, 'a': {state}.a || '{edit}', 't': {added}}} END"


def states_sql() -> str:
    """The four paths after row r and any insertions, from the four before it: plain dynamic programming."""
    kept = lambda x, to: f"CASE WHEN r.fault < 2 AND r.role[1] = '{to}' THEN {step_sql(f'p.{x}', 'K', KEEP, 'r.role', 'r.text')} END"
    changed = lambda x, to: f"CASE WHEN r.fault < 2 THEN {step_sql(f'p.{x}', 'R', REROLE, repr(to), 'r.text')} END"
    ways = {
        "e": [step_sql("p.e", "D", DELETE)],
        "s": [step_sql("p.s", "D", DELETE), kept("e", "s")],
        "u": [step_sql("p.u", "D", DELETE), *[f(x, to) for x in "esa" for f, to in ((kept, "u"), (changed, "user"))]],
        "a": [step_sql("p.a", "D", DELETE), kept("u", "a"), changed("u", "assistant")],
    }
    return ", ".join(f"list_min([{', '.join(w)}]) AS {x}" for x, w in ways.items())


#: With the rows in order, one conversation a recursive row; DuckDB has no crc32, so it is spelled out bit by bit.
OP13_SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
drawn AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(k) + 1), lambda i: list_transform(range(0, 8), lambda b: (ord(k[i]) >> b) & 1)))),
    lambda c, b: xor(c >> 1, CASE WHEN xor(c & 1, b) = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 20 AS draw FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
    CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM drawn, range(CASE draw WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM damaged),
rows_ AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 3
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') THEN 1 ELSE 0 END AS fault,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM placed),
paths AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': ''}} AS e, NULL::STRUCT(c INT, a VARCHAR, t VARCHAR) AS s,
    {{'c': 2, 'a': 'I', 't': 'user:'}} AS u, {{'c': 4, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}} AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, e, s, u, list_min([a, {step_sql('u', 'I', INSERT, "'assistant'")}]) AS a FROM (
    SELECT conv_id, i, e, s, list_min([u, {step_sql('e', 'I', INSERT, "'user'")}, {step_sql('s', 'I', INSERT, "'user'")}, {step_sql('a', 'I', INSERT, "'user'")}]) AS u, a FROM (
      SELECT p.conv_id, r.i, {states_sql()}
      FROM paths p JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1))),
ends AS (SELECT conv_id, list_min([e, a]) AS best FROM paths QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 3) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id)
SELECT ends.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.c::BIGINT AS cost, best.a AS audit, sha256(best.t) AS repaired_sha256
FROM ends LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ends.conv_id"""


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "conversations") as scratch:
        return structure(spark.read.parquet(f"{sf_dir}/conversations.parquet"), scratch)
