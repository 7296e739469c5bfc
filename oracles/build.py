"""Long-form SQL building blocks for the independent DuckDB checks.

Vectors are rows ``(r, i, v)`` (row id, 0-based unit, value); weight matrices are literal
tables ``(j, i, w)``; a layer is a join on the input unit and a SUM per (row, output
unit). Every intermediate is a materialised CTE so row numbers stay stable.
"""

from __future__ import annotations

import numpy as np

from oracles.formulas import fl, normal_sql, sql_act, sql_act_grad, uniform_sql

ONE = "CAST(1 AS DOUBLE)"
ZERO = "CAST(0 AS DOUBLE)"


def r6(x: str) -> str:
    return f"(round(({x}) + 1.0e-9, 6) + {ZERO})"


def r4(x: str) -> str:
    return f"(round(({x}) + 1.0e-9, 4) + {ZERO})"


class Chain:
    def __init__(self):
        self.parts: list[tuple[str, str]] = []
        self.k = 0

    def add(self, sql: str, name: str | None = None) -> str:
        if name is None:
            name = f"t{self.k}"
            self.k += 1
        self.parts.append((name, sql))
        return name

    def render(self, final: str) -> str:
        if not self.parts:
            return final
        return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({s})" for n, s in self.parts) + "\n" + final

    # ------------------------------------------------------------------ literals
    def mat(self, M, name: str | None = None) -> str:
        M = np.asarray(M, dtype=float)
        vals = ", ".join(f"({j}, {i}, {fl(M[j, i])})" for j in range(M.shape[0]) for i in range(M.shape[1]))
        return self.add(f"SELECT * FROM (VALUES {vals}) AS m(j, i, w)", name)

    def vec(self, v, name: str | None = None) -> str:
        v = np.asarray(v, dtype=float).reshape(-1)
        vals = ", ".join(f"({i}, {fl(x)})" for i, x in enumerate(v))
        return self.add(f"SELECT * FROM (VALUES {vals}) AS m(i, w)", name)

    # ------------------------------------------------------------------ layers
    def dense(self, x: str, W: str, c: str | None, act: str) -> str:
        """rows (r, i, v): act(sum_i x * W[j, i] + c[j]) for every output unit j."""
        if c is None:
            return self.add(f"SELECT x.r, w.j AS i, {sql_act(act, 'SUM(x.v * w.w)')} AS v FROM {x} x JOIN {W} w ON x.i = w.i "
                            f"GROUP BY x.r, w.j")
        return self.add(f"SELECT x.r, w.j AS i, {sql_act(act, 'SUM(x.v * w.w) + c.w')} AS v FROM {x} x JOIN {W} w ON x.i = w.i "
                        f"JOIN {c} c ON w.j = c.i GROUP BY x.r, w.j, c.w")

    def back(self, h: str, W: str) -> str:
        """rows (r, i, z) = sum_j h[r, j] * W[j, i] (propagation through W^T)."""
        return self.add(f"SELECT h.r, w.i, SUM(h.v * w.w) AS z FROM {h} h JOIN {W} w ON h.i = w.j GROUP BY h.r, w.i")

    def transpose(self, W: str) -> str:
        return self.add(f"SELECT i AS j, j AS i, w FROM {W}")

    def bernoulli(self, p: str, seed: int) -> str:
        u = uniform_sql("r", "i", seed)
        return self.add(f"SELECT r, i, CASE WHEN v > {u} THEN {ONE} ELSE {ZERO} END AS v FROM {p}")

    def scale(self, x: str, s: str, op: str = "/") -> str:
        return self.add(f"SELECT x.r, x.i, x.v {op} s.w AS v FROM {x} x JOIN {s} s ON x.i = s.i")

    def outer(self, a: str, b: str) -> str:
        """(j, i, s) = sum over rows of a[r, j] * b[r, i]."""
        return self.add(f"SELECT a.i AS j, b.i AS i, SUM(a.v * b.v) AS s FROM {a} a JOIN {b} b ON a.r = b.r GROUP BY a.i, b.i")

    def colsum(self, a: str, b: str | None = None, expr: str = "a.v") -> str:
        """(i, s) = sum over rows of expr (a joined with b on (r, i) when b is given)."""
        if b is None:
            return self.add(f"SELECT a.i, SUM({expr}) AS s FROM {a} a GROUP BY a.i")
        return self.add(f"SELECT a.i, SUM({expr}) AS s FROM {a} a JOIN {b} b ON a.r = b.r AND a.i = b.i GROUP BY a.i")

    def count(self, x: str) -> str:
        return self.add(f"SELECT CAST(COUNT(DISTINCT r) AS DOUBLE) AS n FROM {x}")

    def add_bias_rows(self, x: str) -> str:
        return self.add(f"SELECT DISTINCT r, 0 AS i, {ONE} AS v FROM {x} UNION ALL SELECT r, i + 1 AS i, v FROM {x}")


def uniform(r: str, i: str, seed: int) -> str:
    return uniform_sql(r, i, seed)


def normal(r: str, i: str, seed: int) -> str:
    return normal_sql(r, i, seed)


def params_rows(items) -> str:
    """UNION ALL of (param, out, in, value) selects; items: (name, sql_from, kind) with
    kind 'mat' -> table (j, i, w), 'vec' -> (i, w), 'scalar' -> one column ``w``."""
    sel = []
    for name, src, kind in items:
        if kind == "mat":
            sel.append(f"SELECT '{name}' AS param, CAST(j AS INTEGER) AS out, CAST(i AS INTEGER) AS \"in\", {r6('w')} AS value FROM {src}")
        elif kind == "vec":
            sel.append(f"SELECT '{name}' AS param, CAST(i AS INTEGER) AS out, CAST(0 AS INTEGER) AS \"in\", {r6('w')} AS value FROM {src}")
        else:
            sel.append(f"SELECT '{name}' AS param, CAST(0 AS INTEGER) AS out, CAST(0 AS INTEGER) AS \"in\", {r6('w')} AS value FROM {src}")
    return "\nUNION ALL\n".join(sel)


def act_grad(name: str, a: str) -> str:
    return sql_act_grad(name, a)
