"""SQL for D5 (pca_project): explained variance of the top components and the projected rows' second moments.

Explained variance is eigenvalue / sum of eigenvalues of the feature covariance. The 4 x 4
covariance is diagonalised by cyclic Jacobi rotations unrolled as CTEs (8 sweeps of the 6
pairs; quadratic convergence reaches machine precision long before that), then the diagonal
is sorted.
"""

from __future__ import annotations

from oracles.build import Chain, r6
from oracles.sql import ORACLES, li_inputs

SWEEPS = 8


def _rotate(ch: Chain, A: str, V: str, p: int, q: int, n: int) -> tuple[str, str]:
    """One rotation of the matrix A, collected in V."""
    # angle that zeroes A[p, q]: theta = atan2(2 A_pq, A_qq - A_pp) / 2
    ang = ch.add(f"SELECT 0.5e0 * atan2(2.0e0 * (SELECT w FROM {A} WHERE j = {p} AND i = {q}), "
                 f"(SELECT w FROM {A} WHERE j = {q} AND i = {q}) - (SELECT w FROM {A} WHERE j = {p} AND i = {p})) AS t")
    rows = []
    for a in range(n):
        for b in range(n):
            if (a, b) in ((p, p), (q, q)):
                e = "cos(t)"
            elif (a, b) == (p, q):
                e = "sin(t)"
            elif (a, b) == (q, p):
                e = "-sin(t)"
            else:
                e = "1.0e0" if a == b else "0.0e0"
            rows.append(f"SELECT {a} AS j, {b} AS i, {e} AS w FROM {ang}")
    J = ch.add(" UNION ALL ".join(rows))
    AJ = ch.add(f"SELECT a.j, b.i, SUM(a.w * b.w) AS w FROM {A} a JOIN {J} b ON a.i = b.j GROUP BY a.j, b.i")
    turned = ch.add(f"SELECT b.i AS j, c.i AS i, SUM(b.w * c.w) AS w FROM {J} b JOIN {AJ} c ON b.j = c.j GROUP BY b.i, c.i")
    return turned, ch.add(f"SELECT a.j, b.i, SUM(a.w * b.w) AS w FROM {V} a JOIN {J} b ON a.i = b.j GROUP BY a.j, b.i")


def pca_explained_variance_sql(k: int = 3, n: int = 4) -> str:
    ch = Chain()
    _, x, _ = li_inputs(ch)
    mean = ch.add(f"SELECT i, AVG(v) AS mu FROM {x} GROUP BY i")
    xc = ch.add(f"SELECT x.r, x.i, x.v - m.mu AS v FROM {x} x JOIN {mean} m ON x.i = m.i")
    A = ch.add(f"SELECT a.i AS j, b.i AS i, SUM(a.v * b.v) / (COUNT(*) - 1) AS w FROM {xc} a JOIN {xc} b ON a.r = b.r "
               f"GROUP BY a.i, b.i")
    V = ch.mat([[float(a == b) for b in range(n)] for a in range(n)])
    for _ in range(SWEEPS):
        for p in range(n):
            for q in range(p + 1, n):
                A, V = _rotate(ch, A, V, p, q, n)
    eig = ch.add(f"SELECT j, w AS lam, row_number() OVER (ORDER BY w DESC) - 1 AS c FROM {A} WHERE j = i")
    # projected rows are the uncentred rows times the components; their second moments know no sign of a component
    M = ch.add(f"SELECT a.i AS j, b.i AS i, SUM(a.v * b.v) / (SELECT COUNT(DISTINCT r) FROM {x}) AS w FROM {x} a JOIN {x} b ON a.r = b.r GROUP BY a.i, b.i")
    part = ch.add(f"SELECT e.c, m.i, SUM(v.w * m.w) AS w FROM {eig} e JOIN {V} v ON v.i = e.j JOIN {M} m ON m.j = v.j WHERE e.c < {k} GROUP BY e.c, m.i")
    moments = ch.add(f"SELECT p.c AS a, e.c AS b, ABS(SUM(p.w * v.w)) AS w FROM {part} p JOIN {V} v ON v.j = p.i JOIN {eig} e ON v.i = e.j "
                     f"WHERE e.c < {k} AND e.c >= p.c GROUP BY p.c, e.c")
    return ch.render(f"SELECT CAST(c AS INTEGER) AS component, CAST(-1 AS INTEGER) AS other, {r6('lam / (SELECT SUM(lam) FROM ' + eig + ')')} AS value "
                     f"FROM {eig} WHERE c < {k} UNION ALL SELECT CAST(a AS INTEGER), CAST(b AS INTEGER), {r6('w')} FROM {moments}")


ORACLES["pca_project"] = ORACLES["pca_project_wide"] = pca_explained_variance_sql()
