"""Independent DuckDB SQL for the registered queries.

Written as plain long-form SQL over the driver's views (lineitem, orders, events,
embeddings, part); training steps are unrolled as chains of materialised CTEs. Formulas are
in ``oracles.formulas``; only literal weights, seeds and stream numbers are shared with the library.
"""

from __future__ import annotations

from oracles.build import ONE, ZERO, Chain, act_grad, r4, r6, uniform
from oracles.formulas import fl, sql_act
from oracles.formulas import stream as derive_seed
from stackwise.operators import sampling as S
from stackwise.plans import catalog as C
from stackwise.plans import fixtures as FX

SEED = C.SEED
ORACLES: dict[str, str] = {}


def oracle(name):
    def deco(fn):
        ORACLES[name] = fn()
        return fn
    return deco


# ============================================================================ inputs

LI_BASE = ("SELECT row_number() OVER () AS r, l_returnflag, l_linestatus, l_quantity / 50 AS f0, l_discount * 10 AS f1, "
           "l_tax * 10 AS f2, l_extendedprice / 105000 AS f3 FROM lineitem")


def li_inputs(ch: Chain) -> tuple[str, str, str]:
    base = ch.add(LI_BASE, "li")
    x = ch.add(" UNION ALL ".join(f"SELECT r, {i} AS i, f{i} AS v FROM {base}" for i in range(4)), "li_x")
    y = ch.add(" UNION ALL ".join(
        f"SELECT r, {k} AS i, CASE WHEN l_returnflag = '{f}' THEN {ONE} ELSE {ZERO} END AS v FROM {base}"
        for k, f in enumerate(["A", "N", "R"])), "li_y")
    return base, x, y


def numbered_inputs(ch: Chain) -> tuple[str, str]:
    """lineitem by the row's position in its file, from 0."""
    base = ch.add(LI_BASE.replace("row_number() OVER () AS r", "row_number() OVER () - 1 AS r"), "li")
    x = ch.add(" UNION ALL ".join(f"SELECT r, {i} AS i, f{i} AS v FROM {base}" for i in range(4)), "li_x")
    y = ch.add(" UNION ALL ".join(
        f"SELECT r, {k} AS i, CASE WHEN l_returnflag = '{f}' THEN {ONE} ELSE {ZERO} END AS v FROM {base}"
        for k, f in enumerate(["A", "N", "R"])), "li_y")
    return x, y


def em_inputs(ch: Chain, binary: bool = False) -> tuple[str, str, str]:
    base = ch.add("SELECT vec_id AS r, label, embedding AS emb FROM embeddings", "em")
    val = "CAST(emb[i + 1] AS DOUBLE)"
    if binary:
        val = f"CASE WHEN CAST(emb[i + 1] AS DOUBLE) > 0 THEN {ONE} ELSE {ZERO} END"
    x = ch.add(f"SELECT r, i, {val} AS v FROM (SELECT r, emb, unnest(generate_series(0, len(emb) - 1)) AS i FROM {base})", "em_x")
    y = ch.add(f"SELECT r, k AS i, CASE WHEN label = k THEN {ONE} ELSE {ZERO} END AS v "
               f"FROM (SELECT r, label, unnest(generate_series(0, 9)) AS k FROM {base})", "em_y")
    return base, x, y


EV_BASE = ("SELECT event_id AS r, event_type, value / 1000 AS x0, "
           "CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100 AS x1, (user_id % 100) / 100 AS x2 FROM events")


def ev_inputs(ch: Chain) -> tuple[str, str]:
    base = ch.add(EV_BASE, "ev")
    x = ch.add(" UNION ALL ".join(f"SELECT r, {i} AS i, x{i} AS v FROM {base}" for i in range(3)), "ev_x")
    return base, x


def unit_means(x: str, name: str | None = None, rnd=r6, agg: str = "AVG") -> str:
    nm = f"'{name}' AS name, " if name is not None else ""
    return f"SELECT {nm}CAST(i AS INTEGER) AS unit, {rnd(f'{agg}(v)')} AS value FROM {x} GROUP BY i"


def slots(x: str, name: str, units, extra: str = "") -> str:
    """Keyed rows of long rows (r, i, v): one rounded column per unit."""
    cols = ", ".join(f"{r6(f'MAX(CASE WHEN i = {i} THEN v END)')} AS {name}{i}" for i in units)
    return f"SELECT r AS row_id, {extra}{cols} FROM {x} GROUP BY r"


def vector_slots(parts) -> str:
    """Keyed rows of several long tables (r, i, v); parts: (table, name, width)."""
    rows = " UNION ALL ".join(f"SELECT {t} AS t, r, i, v FROM {x}" for t, (x, _, _) in enumerate(parts))
    cols = ", ".join(f"{r6(f'MAX(CASE WHEN t = {t} AND i = {i} THEN v END)')} AS {name}{i}" for t, (_, name, width) in enumerate(parts) for i in range(width))
    return f"SELECT r AS row_id, {cols} FROM ({rows}) GROUP BY r"


# ============================================================================ A: sources

@oracle("parse_numeric_rows")
def _():
    return ("SELECT o_orderkey, o_totalprice AS p0, CAST(o_custkey AS DOUBLE) AS p1, CAST(o_orderkey AS DOUBLE) AS p2, "
            "CAST(3 AS INTEGER) AS width FROM orders")


@oracle("read_raw_table")
def _():
    return "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


@oracle("read_quoted_table")
def _():
    note = "'key \"' || o_orderkey || '\",' || chr(10) || repeat('line' || chr(10), CAST(o_orderkey % 4 AS BIGINT)) || o_orderpriority"
    return f"SELECT o_orderkey, {note} AS note, o_orderstatus FROM orders"


@oracle("read_clean_table")
def _():
    ch = Chain()
    x, y = numbered_inputs(ch)
    return ch.render(vector_slots([(y, "label", 3), (x, "features", 4)]))


@oracle("write_clean_table")
def _():
    slots = ", ".join(f"CASE WHEN (r + {i}) % 5 <> 0 THEN CAST(x{i} AS DOUBLE) END AS x{i}" for i in range(3))
    return f"SELECT r AS row_id, CAST(3 AS INTEGER) AS width, {slots} FROM ({EV_BASE})"


@oracle("preview_rows")
def _():
    return ("SELECT o_orderkey, o_custkey, NULLIF(o_orderstatus, 'P') AS o_orderstatus, o_totalprice, o_orderpriority "
            "FROM orders ORDER BY o_orderkey LIMIT 11")


@oracle("concat_datasets")
def _():
    return ("SELECT o_orderstatus, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(o_orderkey) AS BIGINT) AS key_sum FROM "
            "(SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT o_orderkey, o_orderstatus FROM orders "
            "WHERE o_orderstatus = 'F') GROUP BY o_orderstatus")


# ============================================================================ B: preparation

@oracle("blank_to_null")
def _():
    return ("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus, "
            "CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS o_orderpriority FROM orders")


@oracle("one_hot_encode")
def _():
    cols = ", ".join(f"CASE WHEN o_orderpriority = '{v}' THEN {ONE} ELSE {ZERO} END AS v{k}" for k, v in enumerate(["1-URGENT", "2-HIGH", "3-MEDIUM"]))
    return f"SELECT o_orderkey, {cols} FROM orders"


@oracle("multi_hot_encode")
def _():
    kw = C.part_keywords()
    parts = []
    for bit in range(16):
        in_dict = " ".join(f"WHEN p_name = '{p}' THEN {ONE if bit in bs else ZERO}" for p, bs in C.PART_PHRASES.items())
        rule = " OR ".join(f"strpos(p_name, '{k}') > 0" for k, bs in kw.items() if bit in bs) or "FALSE"
        expr = f"CASE {in_dict} WHEN {rule} THEN {ONE} ELSE {ZERO} END"
        parts.append(f"SELECT CAST({bit} AS INTEGER) AS unit, {r4(f'SUM({expr})')} AS value FROM part")
    return " UNION ALL ".join(parts)


@oracle("encode_passthrough")
def _():
    return ("SELECT o_orderpriority, CAST(COUNT(*) AS BIGINT) AS n FROM orders "
            "WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY o_orderpriority")


@oracle("profile_columns")
def _():
    cols = [("l_quantity", "numeric", "l_quantity IS NULL"), ("l_discount", "numeric", "l_discount = 0"),
            ("l_returnflag", "category", "l_returnflag = 'A'"), ("l_linestatus", "category", "l_linestatus IS NULL")]
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{r}' AS role, CAST(COUNT(*) FILTER (WHERE {w}) AS BIGINT) AS n_missing "
                              f"FROM lineitem" for c, r, w in cols)


@oracle("select_features")
def _():
    flags = ", ".join(f"CASE WHEN l_returnflag = '{f}' THEN {ONE} ELSE {ZERO} END AS label{k}" for k, f in enumerate(["A", "N", "R"]))
    cells = ", ".join(f"{r6(f'CAST({c} AS DOUBLE)')} AS features{i}" for i, c in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
    return f"SELECT row_number() OVER () - 1 AS row_id, {flags}, {cells} FROM lineitem"


@oracle("assemble_samples")
def _():
    cols = ", ".join(f"CASE WHEN o_orderstatus = '{s}' THEN {ONE} ELSE {ZERO} END AS l{k}" for k, s in enumerate(["F", "O", "P"]))
    return (f"SELECT o_orderkey AS row_id, CAST(3 AS INTEGER) AS label_width, {cols}, o_totalprice / 500000 AS f0, "
            f"(o_custkey % 1000) / 1000 AS f1 FROM orders")


LI_NUM_SQL = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_discount": "NULLIF(l_discount, 0)", "l_tax": "l_tax"}


@oracle("column_stats")
def _():
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {r6(f'MIN({e})')} AS min, {r6(f'MAX({e})')} AS max, {r6(f'AVG({e})')} AS mean FROM lineitem"
        for c, e in LI_NUM_SQL.items())


ORDER_NUMBERS = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, CAST(o_custkey AS DOUBLE) AS cust FROM orders"


@oracle("impute_mean")
def _():
    return (f"WITH o AS MATERIALIZED ({ORDER_NUMBERS}), m AS MATERIALIZED (SELECT AVG(price) AS p FROM o) "
            f"SELECT o_orderkey, {r4('COALESCE(price, p)')} AS price, {r4('cust')} AS cust FROM o, m")


@oracle("min_max_scale")
def _():
    scaled = ", ".join(f"{r6(f'({c} - lo_{c}) / (hi_{c} - lo_{c})')} AS {c}" for c in ("price", "cust"))
    ends = ", ".join(f"MIN({c}) AS lo_{c}, MAX({c}) AS hi_{c}" for c in ("price", "cust"))
    return f"WITH o AS MATERIALIZED ({ORDER_NUMBERS}), e AS MATERIALIZED (SELECT {ends} FROM o) SELECT o_orderkey, {scaled} FROM o, e"


@oracle("impute_category_default")
def _():
    half = "CAST(0.5 AS DOUBLE)"
    return " UNION ALL ".join(
        f"SELECT CAST({k} AS INTEGER) AS unit, "
        f"{r4(f'SUM(CASE WHEN o_orderstatus = {chr(39)}P{chr(39)} THEN {half} WHEN o_orderstatus = {chr(39)}{s}{chr(39)} THEN {ONE} ELSE {ZERO} END)')} AS value FROM orders"
        for k, s in enumerate(["F", "O"]))


@oracle("prepare_table")
def _():
    half = "CAST(0.5 AS DOUBLE)"
    flags = [f"CASE WHEN l_returnflag = 'A' THEN {half} WHEN l_returnflag = '{s}' THEN {ONE} ELSE {ZERO} END AS l_returnflag{k}" for k, s in enumerate(["N", "R"])]
    status = [f"CASE WHEN l_linestatus = '{s}' THEN {ONE} ELSE {ZERO} END AS l_linestatus{k}" for k, s in enumerate(["F", "O"])]
    ends = ", ".join(f"MIN({e}) AS lo{k}, MAX({e}) AS hi{k}, AVG({e}) AS av{k}" for k, e in enumerate(LI_NUM_SQL.values()))
    scaled = [f"{r6(f'(COALESCE({e}, av{k}) - lo{k}) / (hi{k} - lo{k})')} AS {c}" for k, (c, e) in enumerate(LI_NUM_SQL.items())]
    return (f"WITH li AS MATERIALIZED (SELECT row_number() OVER () - 1 AS row_id, * FROM lineitem), e AS MATERIALIZED (SELECT {ends} FROM li) "
            f"SELECT row_id, {', '.join(flags + status + scaled)} FROM li, e")


TEXT_ORDERS = ("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS status, "
               "CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, CAST(o_custkey AS DOUBLE) AS cust FROM orders")


@oracle("prepare_text_table")
def _():
    scaled = ", ".join(f"{r6(f'(COALESCE({c}, av_{c}) - lo_{c}) / (hi_{c} - lo_{c})')} AS {c}" for c in ("price", "cust"))
    ends = ", ".join(f"MIN({c}) AS lo_{c}, MAX({c}) AS hi_{c}, AVG({c}) AS av_{c}" for c in ("price", "cust"))
    slots = ", ".join(f"CASE WHEN status IS NULL THEN {fl(0.5)} WHEN status = '{v}' THEN {ONE} ELSE {ZERO} END AS s{k}" for k, v in enumerate(["F", "O", "P"]))
    return f"WITH o AS MATERIALIZED ({TEXT_ORDERS}), e AS MATERIALIZED (SELECT {ends} FROM o) SELECT o_orderkey, {scaled}, {slots} FROM o, e"


@oracle("write_observed")
def _():
    one = "SELECT '{0}' AS \"column\", {1} AS min, {2} AS max, {3} AS mean, CAST(COUNT(*) - COUNT({0}) AS BIGINT) AS n_missing FROM o"
    return f"WITH o AS MATERIALIZED ({TEXT_ORDERS}) " + " UNION ALL ".join(one.format(c, r6(f"MIN({c})"), r6(f"MAX({c})"), r6(f"AVG({c})")) for c in ("price", "cust"))


# ============================================================================ C: sampling

@oracle("number_rows")
def _():
    return "SELECT row_number() OVER () - 1 AS row_id, l_orderkey, l_linenumber, l_extendedprice FROM lineitem"


@oracle("split_unkeyed")
def _():
    side, batch = uniform("r", "0", derive_seed(SEED, S.SPLIT)), uniform("r", "0", derive_seed(SEED, S.BATCH, 0))
    return (f"SELECT r AS row_id, CASE WHEN {side} < {fl(0.2)} THEN 'validation' ELSE 'train' END AS side, "
            f"CAST(LEAST(FLOOR({batch} * {fl(10.0)}), 9) AS BIGINT) AS batch_id FROM (SELECT row_number() OVER () - 1 AS r FROM lineitem)")


@oracle("draws_unkeyed")
def _():
    ch = Chain()
    x, _ = numbered_inputs(ch)
    drawn = {"noise": f"CASE WHEN {uniform('r', 'i', derive_seed(SEED, S.NOISE))} >= {fl(0.3)} THEN v ELSE {ZERO} END",
             "mask": f"CASE WHEN {uniform('r', 'i', derive_seed(SEED, S.DROPOUT))} > {fl(0.4)} THEN {ONE} ELSE {ZERO} END",
             "state": f"CASE WHEN v > {uniform('r', 'i', derive_seed(SEED, S.STATES))} THEN {ONE} ELSE {ZERO} END",
             "sigm": f"CASE WHEN {sql_act('sigm', 'v')} > {uniform('r', 'i', derive_seed(SEED, S.STATES))} THEN {ONE} ELSE {ZERO} END"}
    y = ch.add("SELECT r, i, " + ", ".join(f"{r6(sql)} AS {name}" for name, sql in drawn.items()) + f" FROM {x}")
    cols = ", ".join(f"MAX(CASE WHEN i = {i} THEN {name} END) AS {name}{i}" for name in drawn for i in range(4))
    return ch.render(f"SELECT r AS row_id, {cols} FROM {y} GROUP BY r")


@oracle("train_validation_split")
def _():
    u = uniform("event_id", "0", derive_seed(SEED, S.SPLIT))
    return (f"SELECT CASE WHEN {u} < {fl(0.2)} THEN 'validation' ELSE 'train' END AS side, CAST(COUNT(*) AS BIGINT) AS n, "
            f"CAST(SUM(event_id) AS BIGINT) AS key_sum FROM events GROUP BY 1")


@oracle("mini_batches")
def _():
    u = uniform("event_id", "0", derive_seed(SEED, S.BATCH, 0))
    return (f"SELECT CAST(LEAST(FLOOR({u} * {fl(10.0)}), 9) AS BIGINT) AS batch_id, CAST(COUNT(*) AS BIGINT) AS n, "
            f"CAST(SUM(event_id) AS BIGINT) AS key_sum FROM events GROUP BY 1")


def _ev_slots(**slots) -> str:
    """Keyed rows: one column per vector and slot; slots: name -> SQL of the slot value over (r, i, v)."""
    ch = Chain()
    _, x = ev_inputs(ch)
    y = ch.add("SELECT r, i, " + ", ".join(f"{r6(sql)} AS {name}" for name, sql in slots.items()) + f" FROM {x}")
    cols = ", ".join(f"MAX(CASE WHEN i = {i} THEN {name} END) AS {name}{i}" for name in slots for i in range(3))
    return ch.render(f"SELECT r AS row_id, {cols} FROM {y} GROUP BY r")


@oracle("mask_noise")
def _():
    s = derive_seed(SEED, S.NOISE)
    return _ev_slots(x=f"CASE WHEN {uniform('r', 'i', s)} >= {fl(0.3)} THEN v ELSE {ZERO} END")


@oracle("dropout_mask")
def _():
    s = derive_seed(SEED, S.DROPOUT)
    mask = f"CASE WHEN {uniform('r', 'i', s)} > {fl(0.4)} THEN {ONE} ELSE {ZERO} END"
    return _ev_slots(mask=mask, train=f"v * {mask}", test=f"v * {fl(1.0 - 0.4)}")


@oracle("sample_states")
def _():
    s = derive_seed(SEED, S.STATES)
    return _ev_slots(x=f"CASE WHEN v > {uniform('r', 'i', s)} THEN {ONE} ELSE {ZERO} END")


@oracle("sigmoid_sample")
def _():
    s = derive_seed(SEED, S.STATES)
    p = sql_act("sigm", f"v * {fl(4.0)} - {fl(2.0)}")
    return _ev_slots(x=f"CASE WHEN {p} > {uniform('r', 'i', s)} THEN {ONE} ELSE {ZERO} END")


@oracle("sigmoid_additive_noise")
def _():
    s = derive_seed(SEED, S.RECON)
    return _ev_slots(x=f"{sql_act('sigm', 'v')} + {uniform('r', 'i', s)}")


# ============================================================================ D, E: vectors and aggregates

@oracle("activate")
def _():
    ch = Chain()
    x, _ = numbered_inputs(ch)
    return ch.render(vector_slots([(ch.add(f"SELECT r, i, {sql_act(fn, 'v')} AS v FROM {x}"), fn, 4) for fn in ("sigm", "tanh_opt", "linear")]))


@oracle("activation_gradient")
def _():
    ch = Chain()
    x, _ = numbered_inputs(ch)
    parts = []
    for fn in ("sigm", "tanh_opt", "linear"):
        a = ch.add(f"SELECT r, i, {sql_act(fn, 'v')} AS v FROM {x}")
        parts.append((ch.add(f"SELECT r, i, {act_grad(fn, 'v')} AS v FROM {a}"), fn, 4))
    return ch.render(vector_slots(parts))


@oracle("dense_layer")
def _():
    W, c = FX.order_layer()
    ch = Chain()
    x = ch.add("SELECT o_orderkey AS r, 0 AS i, o_totalprice / 500000 AS v FROM orders UNION ALL "
               "SELECT o_orderkey AS r, 1 AS i, (o_custkey % 1000) / 1000 AS v FROM orders")
    return ch.render(slots(ch.dense(x, ch.mat(W), ch.vec(c), "sigm"), "h", range(3)))


@oracle("dense_layer_blocked")
@oracle("dense_layer_wide")
def _():
    W, c = FX.em_wide()
    ch = Chain()
    _, x, _ = em_inputs(ch)
    h = ch.dense(x, ch.mat(W), ch.vec(c), "sigm")
    return ch.render(f"SELECT r AS row_id, {r6('SUM(v)')} AS total, {r6('MAX(CASE WHEN i = 0 THEN v END)')} AS h0, "
                     f"{r6('MAX(CASE WHEN i = 79 THEN v END)')} AS h79 FROM {h} GROUP BY r")


@oracle("add_bias")
def _():
    ch = Chain()
    x, _ = numbered_inputs(ch)
    xb = ch.add_bias_rows(x)
    return ch.render(vector_slots([(xb, "with_bias", 5), (ch.add(f"SELECT r, i - 1 AS i, v FROM {xb} WHERE i > 0"), "without_bias", 4)]))


@oracle("count_samples")
def _():
    return "SELECT CAST(COUNT(*) AS BIGINT) AS n FROM lineitem"


@oracle("vector_mean")
def _():
    ch = Chain()
    _, x, _ = li_inputs(ch)
    return ch.render(unit_means(x))


@oracle("outer_product_mean")
def _():
    ch = Chain()
    _, x, y = li_inputs(ch)
    o = ch.outer(y, x)
    n = ch.count(x)
    return ch.render(f"SELECT CAST(j AS INTEGER) AS out, CAST(i AS INTEGER) AS \"in\", {r6('s / (SELECT n FROM ' + n + ')')} AS value FROM {o}")


@oracle("reconstruction_error")
def _():
    W, c, b = FX.li_layer()
    ch = Chain()
    _, x, _ = li_inputs(ch)
    Wt = ch.mat(W)
    h = ch.dense(x, Wt, ch.vec(c), "sigm")
    rec = ch.dense(h, ch.transpose(Wt), ch.vec(b), "sigm")
    e = ch.add(f"SELECT x.r, SUM((x.v - y.v) * (x.v - y.v)) AS e FROM {x} x JOIN {rec} y ON x.r = y.r AND x.i = y.i GROUP BY x.r")
    return ch.render(f"SELECT {r6('AVG(e)')} AS error FROM {e}")


@oracle("half_mse")
def _():
    W, c, _ = FX.li_layer()
    ch = Chain()
    _, x, y = li_inputs(ch)
    h = ch.dense(x, ch.mat(W), ch.vec(c), "sigm")
    e = ch.add(f"SELECT y.r, SUM((y.v - h.v) * (y.v - h.v)) AS e FROM {y} y JOIN {h} h ON y.r = h.r AND y.i = h.i GROUP BY y.r")
    return ch.render(f"SELECT {r6('0.5 * AVG(e)')} AS loss FROM {e}")


@oracle("tuple_sum")
def _():
    lab = ", ".join(f"{r4(f'SUM(CASE WHEN l_returnflag = {chr(39)}{f}{chr(39)} THEN {ONE} ELSE {ZERO} END)')} AS label{k}"
                    for k, f in enumerate(["A", "N", "R"]))
    feats = ["l_quantity / 50", "l_discount * 10", "l_tax * 10", "l_extendedprice / 105000"]
    fs = ", ".join(f"{r4(f'SUM({e})')} AS feature{i}" for i, e in enumerate(feats))
    return f"SELECT CAST(COUNT(*) AS BIGINT) AS n, {lab}, {fs} FROM lineitem"


@oracle("mean_activation")
def _():
    W, c, _ = FX.li_layer()
    ch = Chain()
    _, x, _ = li_inputs(ch)
    h = ch.dense(x, ch.mat(W), ch.vec(c), "sigm")
    return ch.render(f"SELECT CAST(i AS INTEGER) AS unit, {r6(f'0.01 * AVG(v) + {fl(0.99 * 0.05)}')} AS value FROM {h} GROUP BY i")


# training steps register themselves into ORACLES
from oracles import training  # noqa: E402,F401
from oracles import end_to_end  # noqa: E402,F401
from oracles import pca  # noqa: E402,F401
