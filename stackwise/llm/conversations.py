"""Operator 13: repair of conversation structure by Hirschberg's divide and conquer.

The turns of a conversation must read ``(s?(ua)+)?`` by the initials of their roles. An automaton of four states
(start, after system, after user, after assistant) reads them; every row is kept (0), given the role user or
assistant (3), or deleted (4; a must for blank and repeated rows), empty turns are inserted (3), and a truncated
row that stays costs 3. The cheapest edits are wanted, and of those the ASCII-least string of their initials (the audit).

*One row, one block, one task alike* are a step: from each of four states to each of four, the least cost, and
the order of the least audits to the four ends. Steps compose, so a run of rows is a step again. Inserts belong to
the row after them, hence audits up to the same row are never prefixes of each other and their order decides
every longer comparison. A forward vector (cost and order) and a backward vector (cost) of four states meet in the middle of a
run; of the crossings of least total cost the one of the least audit is taken, then both halves
recurse. Only the two vectors and the chosen states are held.

*Any length of conversation.* Rows are range-partitioned by conversation and turn, so a long conversation
spreads over tasks, and are cut into blocks of bounded rows and bytes. A conversation that lies inside one task and one block is
repaired there. The others (the first and last run of a task, and long ones) are written as blocks: repeated rows are
found by a grouped minimum, block steps are composed per task and per conversation, crossings go back from
conversations to tasks to blocks, and every block recurses on its own. No task holds a conversation.

Defined cases: a null role or text is one space (blank), null turns come first, null ids are one
conversation; rows of the same turn go by role and text; an empty role has no legal initial; repeated
rows count each; texts of any length are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackwise.llm.shared import ship, written

BLOCK_ROWS = 1024
BLOCK_BYTES = 1 << 22
INF = 1 << 60
STATES = range(4)  # start, after system, after user, after assistant
ROLES = {"u": "user", "a": "assistant"}
MUST_GO = 0        # kind of a blank or repeated row; others: 1 + 2 * initial + truncated
INITIALS = "sua"   # any other initial: 3
_READ = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def _inserts(p: int) -> list[tuple[int, str]]:
    """States that at most two inserts reach from ``p`` (more never pay), with their audit."""
    out = [(p, "")]
    for _ in range(2):
        q = next((_READ[out[-1][0], c] for c in "ua" if (out[-1][0], c) in _READ), None)
        if q is None or q in (s for s, _ in out):
            break
        out.append((q, out[-1][1] + "I"))
    return out


def _row_edges(kind: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(from, to) -> cheapest (cost, audit) of one row with the inserts before it."""
    initial, late = (INITIALS + "?")[(kind - 1) // 2] if kind else "?", 3 * ((kind - 1) % 2) if kind else 0
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for p in STATES:
        for q, ins in _inserts(p):
            edits = [(q, 4, "D")]
            if kind:
                edits += [(_READ[q, initial], late, "K")] if (q, initial) in _READ else []
                edits += [(_READ[q, c], 3 + late, "R") for c in "ua" if (q, c) in _READ]
            for end, cost, letter in edits:
                new = (3 * len(ins) + cost, ins + letter)
                best[p, end] = min(best.get((p, end), new), new)
    return best


EDGES = [_row_edges(kind) for kind in range(9)]
END = {0: "", 1: "II", 2: "I", 3: ""}  # inserts after the last row

# A step: ((cost, order) of each end) for each start; order ranks the least audits of one start.
Step = tuple


def _ranked(found: dict) -> tuple:
    """``found``: end -> (cost, sortable audit); (cost, rank) of the four ends."""
    order = {q: i for i, q in enumerate(sorted(found, key=lambda q: found[q][1]))}
    return tuple((found[q][0], order[q]) if q in found else (INF, 0) for q in STATES)


def _row_step(kind: int) -> Step:
    return tuple(_ranked({q: e for (p0, q), e in EDGES[kind].items() if p0 == p}) for p in STATES)


ROW_STEPS = [_row_step(kind) for kind in range(9)]
END_STEP = tuple(((3 * len(END[p]), 0), *[(INF, 0)] * 3) for p in STATES)  # all end in state 0


def _start(p: int) -> tuple:
    return tuple((0 if q == p else INF, 0) for q in STATES)


@lru_cache(maxsize=1 << 14)
def _advance(vector: tuple, step: Step) -> tuple:
    found = {}
    for q in STATES:
        options = [(c + step[p][q][0], (r, step[p][q][1])) for p, (c, r) in enumerate(vector) if c < INF and step[p][q][0] < INF]
        if options:
            found[q] = min(options)
    return _ranked(found)


@lru_cache(maxsize=1 << 14)
def _retreat(costs: tuple, step: Step) -> tuple:
    return tuple(min(min(step[p][q][0] + costs[q] for q in STATES), INF) for p in STATES)


def _forward(vector: tuple, steps: list[Step]) -> tuple:
    """Costs are kept relative to the least one while they are carried, so that equal situations repeat."""
    base = 0
    for step in steps:
        vector = _advance(vector, step)
        low = min(c for c, _ in vector)
        if 0 < low < INF:
            base += low
            vector = tuple((c - low if c < INF else INF, r) for c, r in vector)
    return tuple((c + base if c < INF else INF, r) for c, r in vector)


def _backward(costs: tuple, steps: list[Step]) -> tuple:
    base = 0
    for step in reversed(steps):
        costs = _retreat(costs, step)
        low = min(costs)
        if 0 < low < INF:
            base += low
            costs = tuple(c - low if c < INF else INF for c in costs)
    return tuple(c + base if c < INF else INF for c in costs)


def compose(steps: list[Step]) -> Step:
    """The step of a whole run."""
    return tuple(_forward(_start(p), steps) for p in STATES)


def crossings(steps: list[Step], first: int, last: int) -> list[int]:
    """States before, between and after ``steps`` on the cheapest way of the least audit from ``first`` to ``last``."""
    states = [first] + [0] * (len(steps) - 1) + [last] if steps else [first]
    todo = [(0, len(steps))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        ahead = _forward(_start(states[lo]), steps[lo:mid])
        behind = _backward(tuple(0 if q == states[hi] else INF for q in STATES), steps[mid:hi])
        states[mid] = min(STATES, key=lambda q: (min(ahead[q][0] + behind[q], INF), ahead[q][1]))
        todo += [(lo, mid), (mid, hi)]
    return states


def audit(kinds: list[int], states: list[int]) -> list[str]:
    """Audit piece of each row (inserts, then its own letter)."""
    return [EDGES[k][p, q][1] for k, p, q in zip(kinds, states, states[1:])]


def apply_edits(rows: list[tuple[str, str]], pieces: list[str], state: int) -> tuple[list[tuple[str, str]], int]:
    """Rows (role, text) after the edits that start in ``state``, and the state reached; pieces beyond the rows are inserts."""
    out = []
    for i, piece in enumerate(pieces):
        for letter in piece:
            if letter == "D":
                continue
            if letter == "K":
                role, text = rows[i]
                initial = role[0]
            else:
                initial = next(c for c in "ua" if (state, c) in _READ)
                role, text = ROLES[initial], rows[i][1] if letter == "R" else ""
            state = _READ[state, initial]
            out.append((role, text))
    return out, state


def kind_of(role: str, gone: bool, truncated: bool) -> int:
    i = INITIALS.find(role[:1]) if role else -1
    return MUST_GO if gone else 1 + 2 * (i if i >= 0 else 3) + truncated


def illegal_pairs(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that ``crc32(conv_id:turn) % 20`` names; nulls (but ids and turns) are one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text = F.coalesce(F.col("text").cast("string"), space)
    d = F.col("damage")
    return (rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("damage"))
            .filter("damage <> 0")
            .select("conv_id", "turn", F.when(d == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                    F.when(d == 1, F.lit("")).when(d == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                    F.when(d == 3, F.lit(2)).otherwise(F.lit(1)).alias("times"))
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "copy"))


_BLANKS = " \t\n\x0b\x0c\r"


def _faults() -> tuple[Column, Column]:
    """(blank, last character is no end of a sentence) of a text; blank texts are not truncated."""
    body = F.rtrim(F.col("text"), F.lit(_BLANKS))
    return body == "", (body != "") & ~F.substring(body, -1, 1).isin(".", "!", "?")


SUMMARY = "rows long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, first_turn {t}, last_turn {t}, turns long"


def _summary(rows: list, gone: list[bool]) -> dict:
    """Counts of a run of rows (turn, role, text, blank, truncated) in order; ``gone`` marks repeated ones."""
    turns = [r[0] for r in rows if r[0] is not None]
    return {"rows": len(rows), "blank": sum(r[3] for r in rows), "duplicate": sum(g and not r[3] for r, g in zip(rows, gone)),
            "truncated": sum(r[4] and not g for r, g in zip(rows, gone)), "illegal": illegal_pairs([r[1] for r in rows]),
            "first_role": rows[0][1][:1], "last_role": rows[-1][1][:1], "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
            "turns": sum(i == 0 or t != turns[i - 1] for i, t in enumerate(turns))}


def merged_summary(parts: list[dict]) -> dict:
    """Summary of neighbouring runs."""
    out = dict(parts[0])
    for p in parts[1:]:
        for name in ("rows", "blank", "duplicate", "truncated"):
            out[name] += p[name]
        out["illegal"] += p["illegal"] + illegal_pairs([out["last_role"], p["first_role"]])
        if p["first_turn"] is not None:
            out["turns"] += p["turns"] - (out["last_turn"] == p["first_turn"])
            out["first_turn"] = p["first_turn"] if out["first_turn"] is None else out["first_turn"]
            out["last_turn"] = p["last_turn"]
        out["last_role"] = p["last_role"]
    return out


def _kinds(rows: list, gone: list[bool]) -> list[int]:
    return [kind_of(r[1], r[3] or g, r[4]) for r, g in zip(rows, gone)]


def _repeats(rows: list) -> list[bool]:
    seen: set = set()
    out = []
    for r in rows:
        out.append((r[1], r[2]) in seen)
        seen.add((r[1], r[2]))
    return out


def _whole(rows: list, turns_wanted: bool) -> dict:
    gone = _repeats(rows)
    kinds = _kinds(rows, gone)
    states = crossings([ROW_STEPS[k] for k in kinds] + [END_STEP], 0, 0)
    pieces = [*audit(kinds, states[:-1]), END[states[-2]]]
    fixed, _ = apply_edits([(r[1], r[2]) for r in rows], pieces, 0)
    cost = sum(EDGES[k][p, q][0] for k, p, q in zip(kinds, states, states[1:])) + 3 * len(pieces[-1])
    sha = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in fixed).encode()).hexdigest()
    return {**_summary(rows, gone), "cost": cost, "audit": "".join(pieces), "repaired_sha256": sha,
            "repaired": [{"role": a, "text": b} for a, b in fixed] if turns_wanted else None, "raw": None}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], type=f.type) for f in schema], schema=schema)


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _cut(rows: DataFrame, block_rows: int, block_bytes: int, turns_wanted: bool) -> DataFrame:
    """Range-partitioned rows as results of whole conversations and blocks (column ``raw``) of the others."""
    conv, turn = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    blank, truncated = _faults()
    src = (rows.select("conv_id", "turn", "role", "text", blank.alias("is_blank"), truncated.alias("is_truncated"))
           .repartitionByRange(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 32))
           .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"))
    ddl = (f"conv_id {conv}, part int, block long, {SUMMARY.format(t=turn)}, cost long, audit string, repaired_sha256 string, "
           f"repaired array<struct<role: string, text: string>>, raw array<struct<turn: {turn}, role: string, text: string, blank: boolean, truncated: boolean>>")
    schema = _arrow_schema(rows.sparkSession, ddl)

    def run(batches):
        part = TaskContext.get().partitionId()
        out: list[dict] = []
        held, size, blocks, open_run, conv_id, started = [], 0, 0, True, None, False

        def raw_block():
            nonlocal held, size, blocks
            out.append({"conv_id": conv_id, "part": part, "block": blocks, "raw": [dict(zip(("turn", "role", "text", "blank", "truncated"), r)) for r in held]})
            held, size, blocks = [], 0, blocks + 1

        for batch in batches:
            for c, *row in zip(*(col.to_pylist() for col in batch.columns)):
                if started and c != conv_id:
                    if open_run:  # the first run of the task, or one of several blocks
                        raw_block()
                    else:
                        out.append({"conv_id": conv_id, "part": part, "block": 0, **_whole(held, turns_wanted)})
                    held, size, blocks, open_run = [], 0, 0, False
                elif held and (len(held) >= block_rows or size >= block_bytes):
                    open_run = True
                    raw_block()
                started, conv_id = True, c
                held.append(tuple(row))
                size += len(row[2])
            if len(out) >= 512:
                yield _batch(out, schema)
                out.clear()
        if started:
            raw_block()
        if out:
            yield _batch(out, schema)

    return written(src.mapInArrow(run, ddl), "conversations")


def _flat(step: Step) -> list[int]:
    return [x for ends in step for pair in ends for x in pair]


def _step(flat: list[int]) -> Step:
    return tuple(tuple((flat[8 * p + 2 * q], flat[8 * p + 2 * q + 1]) for q in STATES) for p in STATES)


def _matched(left: DataFrame, right: DataFrame, names: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Join on ``names``, where null equals null; the names appear once."""
    other = right.withColumnsRenamed({n: f"right_{n}" for n in names})
    return left.join(other, [F.col(n).eqNullSafe(F.col(f"right_{n}")) for n in names], how).drop(*(f"right_{n}" for n in names))


def _stitch(cut: DataFrame) -> DataFrame:
    """Blocks of open conversations, each with its audit piece, repaired turns and, in the last one, the summary of all."""
    turn = cut.schema["first_turn"].dataType.simpleString()
    conv = cut.schema["conv_id"].dataType.simpleString()
    place = ("conv_id", "part", "block")
    raw = cut.filter("raw IS NOT NULL").select(*place, "raw")

    keys = raw.select(*place, F.posexplode("raw").alias("at", "row")).select(*place, "at", F.struct("row.role", F.md5("row.text").alias("mark")).alias("key"))
    first = keys.groupBy("conv_id", "key").agg(F.min(F.struct("part", "block", "at")).alias("first"), F.count("*").alias("times")).filter("times > 1")
    again = _matched(keys, first, ("conv_id", "key")).filter(F.struct("part", "block", "at") != F.col("first")).groupBy(*place).agg(F.collect_list("at").alias("again"))
    known = _matched(raw, again, place, "left").select(*place, "raw", "again")
    schema_b = f"conv_id {conv}, part int, block long, step array<bigint>, {SUMMARY.format(t=turn)}, raw array<struct<turn: {turn}, role: string, text: string, blank: boolean, truncated: boolean>>, gone array<boolean>"
    arrow_b = _arrow_schema(cut.sparkSession, schema_b)

    def as_rows(raw_rows):
        return [(r["turn"], r["role"], r["text"], r["blank"], r["truncated"]) for r in raw_rows]

    def block_steps(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                rows, dup = as_rows(r["raw"]), set(r["again"] or ())
                gone = [i in dup for i in range(len(rows))]
                out.append({**{c: r[c] for c in place}, "step": _flat(compose([ROW_STEPS[k] for k in _kinds(rows, gone)])), **_summary(rows, gone), "raw": r["raw"], "gone": gone})
            yield _batch(out, arrow_b)

    blocks = written(known.mapInArrow(block_steps, schema_b), "conversation-blocks")
    names = [f.split()[0] for f in SUMMARY.split(", ")]

    def folded(table: DataFrame, keys: tuple[str, ...], by: str) -> DataFrame:
        """Runs of ``table`` in the order of ``by``, as lists; a list holds the blocks of a task, or the tasks of a conversation."""
        return table.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(by, "step", *names))).alias("runs"))

    schema_p = f"conv_id {conv}, part int, step array<bigint>, {SUMMARY.format(t=turn)}"
    arrow_p = _arrow_schema(cut.sparkSession, schema_p)

    def part_steps(batches):
        for batch in batches:
            yield _batch([{"conv_id": r["conv_id"], "part": r["part"], "step": _flat(compose([_step(x["step"]) for x in r["runs"]])),
                           **merged_summary([{n: x[n] for n in names} for x in r["runs"]])} for r in batch.to_pylist()], arrow_p)

    parts = folded(blocks, ("conv_id", "part"), "block").mapInArrow(part_steps, schema_p)
    schema_c = f"conv_id {conv}, part int, enter int, leave int, last boolean, cost long, {SUMMARY.format(t=turn)}"
    arrow_c = _arrow_schema(cut.sparkSession, schema_c)

    def conversation_crossings(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                steps = [_step(x["step"]) for x in r["runs"]] + [END_STEP]
                states = crossings(steps, 0, 0)
                cost = _forward(_start(0), steps)[0][0]
                total = merged_summary([{n: x[n] for n in names} for x in r["runs"]])
                out += [{"conv_id": r["conv_id"], "part": x["part"], "enter": states[i], "leave": states[i + 1], "last": i == len(r["runs"]) - 1, "cost": cost, **total}
                        for i, x in enumerate(r["runs"])]
            yield _batch(out, arrow_c)

    of_parts = folded(parts, ("conv_id",), "part").mapInArrow(conversation_crossings, schema_c)
    schema_x = f"conv_id {conv}, part int, block long, enter int, leave int, last boolean, cost long, {SUMMARY.format(t=turn)}"
    arrow_x = _arrow_schema(cut.sparkSession, schema_x)

    def block_crossings(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                states = crossings([_step(x["step"]) for x in r["runs"]], r["enter"], r["leave"])
                for i, x in enumerate(r["runs"]):
                    last = r["last"] and i == len(r["runs"]) - 1
                    out.append({"conv_id": r["conv_id"], "part": r["part"], "block": x["block"], "enter": states[i], "leave": states[i + 1], "last": last,
                                "cost": r["cost"], **{n: r[n] for n in names}})
            yield _batch(out, arrow_x)

    lists = blocks.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("block", "step"))).alias("runs"))
    crossed = _matched(lists, of_parts, ("conv_id", "part")).select("conv_id", "part", "runs", "enter", "leave", "last", "cost", *names)
    of_blocks = crossed.mapInArrow(block_crossings, schema_x)
    schema_o = f"conv_id {conv}, part int, block long, last boolean, cost long, audit string, repaired array<struct<role: string, text: string>>, {SUMMARY.format(t=turn)}"
    arrow_o = _arrow_schema(cut.sparkSession, schema_o)

    def edits(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                rows = as_rows(r["raw"])
                kinds = _kinds(rows, r["gone"])
                states = crossings([ROW_STEPS[k] for k in kinds], r["enter"], r["leave"])
                pieces = audit(kinds, states) + ([END[r["leave"]]] if r["last"] else [])
                fixed, _ = apply_edits([(x[1], x[2]) for x in rows], pieces, r["enter"])
                out.append({**{c: r[c] for c in (*place, "last", "cost", *names)}, "audit": "".join(pieces), "repaired": [{"role": a, "text": b} for a, b in fixed]})
            yield _batch(out, arrow_o)

    joined = _matched(blocks.select(*place, "raw", "gone"), of_blocks, place).select(*place, "raw", "gone", "enter", "leave", "last", "cost", *names)
    return joined.mapInArrow(edits, schema_o)


def _digests(stitched: DataFrame) -> DataFrame:
    """One row per open conversation: its blocks pass in order through one hash, block by block."""
    turn = stitched.schema["first_turn"].dataType.simpleString()
    conv = stitched.schema["conv_id"].dataType.simpleString()
    names = [f.split()[0] for f in SUMMARY.split(", ")]
    ddl = f"conv_id {conv}, {SUMMARY.format(t=turn)}, cost long, audit string, repaired_sha256 string"
    schema = _arrow_schema(stitched.sparkSession, ddl)

    def run(batches):
        sha, letters, any_turn = hashlib.sha256(), [], False
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                letters.append(r["audit"])
                for t in r["repaired"]:
                    sha.update((("\n" if any_turn else "") + f"{t['role']}:{t['text']}").encode())
                    any_turn = True
                if r["last"]:
                    out.append({"conv_id": r["conv_id"], "cost": r["cost"], **{n: r[n] for n in names}, "audit": "".join(letters), "repaired_sha256": sha.hexdigest()})
                    sha, letters, any_turn = hashlib.sha256(), [], False
            if out:
                yield _batch(out, schema)

    ordered = stitched.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "block")
    return ordered.mapInArrow(run, ddl)


def repaired_blocks(rows: DataFrame, *, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """conv_id, part, block, audit, repaired (list of role and text): the repaired conversations, whole or block by block in order."""
    ship(rows)
    cut = _cut(rows, block_rows, block_bytes, True)
    columns = ("conv_id", "part", "block", "audit", "repaired")
    return cut.filter("raw IS NULL").select(*columns).union(_stitch(cut).select(*columns))


def repair_report(rows: DataFrame, *, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text; no null role or text): gaps, faults, cost, audit and the hash of the repair."""
    ship(rows)
    cut = _cut(rows, block_rows, block_bytes, False)
    columns = ("conv_id", "blank", "duplicate", "truncated", "illegal", "first_turn", "last_turn", "turns", "cost", "audit", "repaired_sha256")
    both = cut.filter("raw IS NULL").select(*columns).union(_digests(_stitch(cut)).select(*columns))
    gaps = F.when(F.col("first_turn").isNull(), F.lit(0)).otherwise(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"))
    return both.select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired_conversations(rows: DataFrame, **blocks) -> DataFrame:
    """The report for every conversation of ``rows`` after the damage; one that lost all rows has zeros and an empty audit."""
    report = repair_report(damaged(rows), **blocks)
    every = _matched(rows.select("conv_id").distinct(), report, ("conv_id",), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
