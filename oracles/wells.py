"""SQL of the 41-column well table: cells from ``orders``, preparation by the roles."""

from __future__ import annotations

import re

from oracles.build import Chain, r4, r6
from oracles.sql import ORACLES
from stackwise import roles
from stackwise.plans.wells import PHRASES


def _number(j: int) -> str:
    """Numeric cell of column j, NULL where it is missing."""
    return (f"CASE WHEN (o_orderkey + {j}) % 13 <> 0 THEN ((o_orderkey * {j + 3} + o_custkey * {j + 7}) % 997) / 10e0 "
            f"+ o_totalprice / 100000e0 END")


def _one_hot(j: int, name: str) -> list[str]:
    """Slot values of a category column; the cell after the last value is blank."""
    values = roles.ONE_HOT[name]
    at = f"((o_orderkey * 3 + o_custkey * 7 + {j}) % {len(values) + 1})"
    return [f"CASE WHEN {at} = {len(values)} THEN {roles.MISSING_FILL[name]}e0 WHEN {at} = {k} THEN 1e0 ELSE 0e0 END" for k in range(len(values))]


def _diagnosis() -> str:
    """The twelve digits (twice the slot value) of every phrase, by its place in the list."""
    digits = []
    for phrase in PHRASES:
        if not phrase:
            digits.append(str(int(2 * roles.MISSING_FILL["泵况分析结果"])) * roles.DIAGNOSIS_WIDTH)
            continue
        bits = roles.DIAGNOSIS_PHRASES.get(re.sub(roles.DIAGNOSIS_DEPTH_SUFFIX, "", phrase), [])
        digits.append("".join("2" if k in bits else "0" for k in range(roles.DIAGNOSIS_WIDTH)))
    cases = " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(digits))
    return f"CASE (o_orderkey * 5 + o_custkey) % {len(PHRASES)} {cases} END"


def _scaled(ch: Chain, names: list[str]) -> str:
    """orders with the named columns imputed and scaled to [0, 1] (columns n<j>)."""
    js = [roles.COLUMNS.index(c) for c in names]
    raw = ch.add("SELECT *, " + ", ".join(f"{_number(j)} AS v{j}" for j in js) + " FROM orders")
    stats = ch.add("SELECT " + ", ".join(f"AVG(v{j}) AS a{j}, MIN(v{j}) AS l{j}, MAX(v{j}) AS h{j}" for j in js) + f" FROM {raw}")
    return ch.add("SELECT r.*, " + ", ".join(f"CASE WHEN h{j} = l{j} THEN 0.5e0 ELSE (COALESCE(v{j}, a{j}) - l{j}) / (h{j} - l{j}) END AS n{j}" for j in js)
                  + f" FROM {raw} r, {stats} s")


def well_samples(ch: Chain) -> tuple[str, str]:
    """Long rows (r, i, v) of the example features and target."""
    base = _scaled(ch, roles.EXAMPLE_FEATURES)
    x = ch.add(" UNION ALL ".join(f"SELECT o_orderkey AS r, {i} AS i, n{roles.COLUMNS.index(c)} AS v FROM {base}" for i, c in enumerate(roles.EXAMPLE_FEATURES)))
    target = _one_hot(roles.COLUMNS.index(roles.EXAMPLE_TARGET), roles.EXAMPLE_TARGET)
    y = ch.add(" UNION ALL ".join(f"SELECT o_orderkey AS r, {k} AS i, {v} AS v FROM orders" for k, v in enumerate(target)))
    return x, y


def well_features(ch: Chain) -> tuple[str, str, int]:
    """Long rows (r, i, v) of every column but the name and the target, codes as their slots; the target; the width."""
    names = [c for c in roles.COLUMNS if c not in ("井号", roles.EXAMPLE_TARGET)]
    base = _scaled(ch, [c for c in names if c not in roles.TEXT_COLUMNS])
    base = ch.add(f"SELECT *, {_diagnosis()} AS digits FROM {base}")
    parts, width = [], 0
    for c in names:
        j = roles.COLUMNS.index(c)
        if c == "泵况分析结果":
            values = [f"CAST(substr(digits, {k + 1}, 1) AS DOUBLE) / 2" for k in range(roles.DIAGNOSIS_WIDTH)]
        else:
            values = _one_hot(j, c) if c in roles.ONE_HOT else [f"n{j}"]
        parts += [f"SELECT o_orderkey AS r, {width + k} AS i, {v} AS v FROM {base}" for k, v in enumerate(values)]
        width += len(values)
    target = _one_hot(roles.COLUMNS.index(roles.EXAMPLE_TARGET), roles.EXAMPLE_TARGET)
    x = ch.add(" UNION ALL ".join(parts))
    y = ch.add(" UNION ALL ".join(f"SELECT o_orderkey AS r, {k} AS i, {v} AS v FROM orders" for k, v in enumerate(target)))
    return x, y, width


def _sparse_features() -> str:
    ch = Chain()
    x, _, width = well_features(ch)
    first = "string_agg(CASE WHEN i < 4 AND v > 0 THEN CAST(i AS VARCHAR) || ':' || CAST(CAST(2 * v AS INTEGER) AS VARCHAR) END, ',' ORDER BY i)"
    return ch.render(f"SELECT r AS row_id, CAST({width} AS INTEGER) AS width, coalesce({first}, '') AS first_code, {r4('SUM(v * (i + 1))')} AS checksum FROM {x} GROUP BY r")


def _wide_table() -> str:
    ch = Chain()
    numeric = [c for c in roles.COLUMNS if c not in roles.TEXT_COLUMNS]
    base = _scaled(ch, numeric)
    cells = []
    for j, c in enumerate(roles.COLUMNS):
        if c == "泵况分析结果":
            cells.append(f"{_diagnosis()} AS c{j}")
        elif c in roles.ONE_HOT:
            cells.append(" || ".join(f"CAST(CAST(2 * ({v}) AS INTEGER) AS VARCHAR)" for v in _one_hot(j, c)) + f" AS c{j}")
        elif c in numeric:
            cells.append(f"{r6(f'n{j}')} AS c{j}")
    return ch.render(f"SELECT o_orderkey AS row_id, {', '.join(cells)} FROM {base}")


ORACLES["prepare_wide_table"] = _wide_table()
ORACLES["sparse_features"] = _sparse_features()
