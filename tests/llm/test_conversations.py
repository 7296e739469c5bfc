import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from stackwise.llm import conversations as C

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
ROW = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        if d:
            out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = ROW.findall(text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def repair(rows):
    """(cost, audit, repaired) by a table of least (cost, audit) per state, with whole audits kept."""
    best = {0: (0, "", ())}

    def with_inserts(best):
        best = dict(best)
        for _ in range(3):
            for q, (cost, letters, done) in list(best.items()):
                for c, role in (("u", "user"), ("a", "assistant")):
                    if (q, c) in NEXT:
                        new = (cost + 3, letters + "I", done + ((role, ""),))
                        best[NEXT[q, c]] = min(best.get(NEXT[q, c], new), new)
        return best

    for (_, role, text), fault in zip(rows, faults(rows)):
        new = {}
        for q, (cost, letters, done) in with_inserts(best).items():
            ends = [(q, cost + 4, letters + "D", done)]
            if fault not in ("blank", "duplicate"):
                late = 3 * (fault == "truncated")
                if (q, role[:1]) in NEXT:
                    ends.append((NEXT[q, role[:1]], cost + late, letters + "K", done + ((role, text),)))
                ends += [(NEXT[q, c], cost + 3 + late, letters + "R", done + ((full, text),)) for c, full in (("u", "user"), ("a", "assistant")) if (q, c) in NEXT]
            for end, *rest in ends:
                new[end] = min(new.get(end, tuple(rest)), tuple(rest))
        best = new
    return min(v for q, v in with_inserts(best).items() if q in (0, 3))


def report(rows):
    """{conv_id: tuple of the result's columns}"""
    out = {}
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in after if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in mine if r[0] is not None]
        f = faults(mine)
        cost, letters, fixed = repair(mine)
        pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in fixed)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f.count("blank"), f.count("duplicate"), f.count("truncated"), pairs, cost, letters,
                     hashlib.sha256(text.encode()).hexdigest())
    return out


def conversations(seed, n, longest):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "it ends here", "", " \t", "Yes. ", "ö?", None, "a\nb."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    return [(conv if conv else None, r.choice([t, t, t, None, t // 2]), r.choice(roles[:r.choice([4, 5, 9])]), r.choice(texts[:r.choice([4, 10])]) if r.random() < .5 else f"text {r.randint(0, 99)}.")
            for conv in range(n) for t in range(r.randint(1, longest))]


def got(df):
    rows = df.collect()
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("block_rows,parts", [(C.BLOCK_ROWS, 1), (4, 5), (1, 3)])
def test_report_equals_the_table_of_whole_audits(spark, block_rows, parts):
    rows = conversations(block_rows, 80, 12) + conversations(9, 2, 120)[-150:]
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).selectExpr("*", "1 as part", "2 as block", "'x' as audit", "3 as copy", "4 as damage", "5 as times")
    assert got(C.repaired_conversations(df, block_rows=block_rows)) == report(rows)


def test_small_blocks_by_bytes_and_repeated_rows(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "word " * 50 + str(t % 7) + ".") for t in range(60)] * 2 + [(2, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(C.repaired_conversations(df, block_bytes=300)) == report(rows)
    assert C.repaired_conversations(df.limit(0)).count() == 0 and C.repaired_blocks(df.limit(0)).count() == 0


def test_conversation_without_rows(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "a."), (gone, 0, "assistant", "b.")], SCHEMA)
    assert got(C.repaired_conversations(df)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


@pytest.mark.parametrize("block_rows", [1000, 3])
def test_repaired_turns(spark, block_rows):
    rows = conversations(4, 40, 14)
    blocks = C.repaired_blocks(C.damaged(spark.createDataFrame(rows, SCHEMA)), block_rows=block_rows).collect()
    want = report(rows)
    for conv in {b.conv_id for b in blocks}:
        mine = sorted((b for b in blocks if b.conv_id == conv), key=lambda b: (b.part, b.block))
        turns = [(t.role, t.text) for b in mine for t in b.repaired]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in turns))
        assert "".join(b.audit for b in mine) == want[conv][6]
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest() == want[conv][7]


def test_divide_and_conquer_on_any_run():
    r = random.Random(3)
    for _ in range(400):
        kinds = [r.randrange(9) for _ in range(r.randint(0, 14))]
        steps = [C.ROW_STEPS[k] for k in kinds]
        cut = sorted(r.randrange(len(kinds) + 1) for _ in range(2))
        runs = [steps[:cut[0]], steps[cut[0]:cut[1]], steps[cut[1]:]]
        ends = C.crossings([C.compose(x) for x in runs] + [C.END_STEP], 0, 0)
        pieces = []
        for run, at, p, q in zip(runs, (0, *cut), ends, ends[1:]):
            pieces += C.audit(kinds[at:at + len(run)], C.crossings(run, p, q))
        rows = [(None, (C.INITIALS + "x")[(k - 1) // 2] if k else "u", f"{i} " + ("x" if k and (k - 1) % 2 else "." if k else "")) if k else (None, "u", "") for i, k in enumerate(kinds)]
        cost, letters, _ = repair(rows)
        assert "".join(pieces) + C.END[ends[-2]] == letters
        assert C.crossings(steps + [C.END_STEP], 0, 0)[:-1] == C.crossings(steps, 0, ends[-2])
