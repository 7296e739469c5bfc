"""Cleaning, encoding and scaling.

Everything is a column expression in one ``select``; the only actions are the statistics (min, max, mean of every
numeric column, in one aggregation or observed while the typed table is written) and, on
request, the label-width check. Dictionaries become literal maps/arrays (no join).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackwise.functions import sparse as SP
from stackwise.functions import vectors as V


def _c(col) -> Column:
    """A column by its plain name, which may hold dots and other signs."""
    return F.col("`" + col.replace("`", "``") + "`") if isinstance(col, str) else col


# ----------------------------------------------------------------------------- B1

def blank_expr(col) -> Column:
    c = _c(col)
    return F.when(F.trim(c) == F.lit(""), F.lit(None).cast("string")).otherwise(c)


def blank_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """B1: empty (or all-space) text cells become NULL, in one projection."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    todo = set(cols) if cols is not None else text
    return df.select(*[blank_expr(c).alias(c) if c in todo else _c(c) for c in df.columns])


# ----------------------------------------------------------------------------- B2, B4, B11

ONE_HOT_UNROLL = 64  # dictionaries up to this size become one CASE per slot (code-generated)


def _unknown(col: Column, on_unknown: str, zero: Column, ddl: str) -> Column:
    if on_unknown == "zero":
        return zero
    if on_unknown == "null":
        return F.lit(None).cast(ddl)
    if on_unknown == "error":
        return F.raise_error(F.concat(F.lit("unknown category: "), col.cast("string"))).cast(ddl)
    raise ValueError("on_unknown must be zero, null or error")


def _no_repeats(values: Sequence[str]) -> None:
    repeated = sorted(str(v) for v, n in Counter(values).items() if n > 1)
    if repeated:
        raise ValueError(f"repeated dictionary value(s): {repeated}")


def one_hot(col, values: Sequence[str], *, on_unknown: str = "zero", missing_fill: float | None = None, sparse: bool = False) -> Column:
    """B2 (+B11): category -> fixed 0/1 vector of len(values).

    on_unknown: 'zero' (all-zero vector), 'null', or 'error' (raise at run time).
    missing_fill: value of every slot for a NULL cell (0.5 or 0 in the well table); NULL if None.
    sparse: (size, indices, values) with one number per known category, see :mod:`stackwise.functions.sparse`.
    A dictionary that repeats a value raises, whatever its size.
    """
    _no_repeats(values)
    c = _c(col)
    if sparse:
        slot = F.try_element_at(F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(i))]), c)
        unknown = _unknown(c, on_unknown, SP.filled(len(values), 0), SP.SPARSE_DDL)
        return F.when(c.isNull(), SP.filled(len(values), missing_fill)).when(slot.isNotNull(), SP.sparse_vector(len(values), F.array(slot), F.array(F.lit(1.0)))).otherwise(unknown)
    if len(values) <= ONE_HOT_UNROLL:
        code = V.one_hot_lit(c, values)
        known = c.isin(list(values))
    else:
        # large dictionary: one literal value -> slot map lookup, then the vector from the slot
        slot = F.try_element_at(F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(i))]), c)
        code = F.transform(F.sequence(F.lit(0), F.lit(len(values) - 1)),
                           lambda i: F.when(i == slot, F.lit(1.0)).otherwise(F.lit(0.0)))
        known = slot.isNotNull()
    unknown = _unknown(c, on_unknown, F.array_repeat(F.lit(0.0), len(values)), "array<double>")
    missing = F.lit(None).cast("array<double>") if missing_fill is None else F.array_repeat(F.lit(float(missing_fill)), len(values))
    return F.when(c.isNull(), missing).when(known, code).otherwise(unknown)


def one_hot_encode(df: DataFrame, col: str, values: Sequence[str], out: str | None = None, **kw) -> DataFrame:
    """B2: per column (not over every cell, Q10)."""
    return df.withColumn(out or col, one_hot(col, values, **kw))


def unmatched_values(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    """Values that no dictionary entry matches, with their counts (they stay unchanged)."""
    c = F.col(col)
    return df.filter(c.isNotNull() & ~c.isin(list(values))).groupBy(col).agg(F.count(F.lit(1)).cast("long").alias("n"))


def impute_category_default(col, width: int, fill: float = 0.5) -> Column:
    """A missing category vector becomes ``fill`` in every slot."""
    return F.coalesce(_c(col), F.array_repeat(F.lit(float(fill)), int(width)))


# ----------------------------------------------------------------------------- B3

def multi_hot(col, width: int, phrases: Mapping[str, Sequence[int]] | None = None,
              keywords: Mapping[str, Sequence[int]] | None = None, strip_pattern: str | None = None,
              missing_fill: float | None = None, sparse: bool = False) -> Column:
    """Phrase -> ``width``-bit multi-hot vector (``sparse``: of its bits alone).

    1. exact phrase dictionary (literal map, after removing ``strip_pattern`` if given);
    2. for phrases not in the dictionary, keyword rules: each keyword found sets its bits;
    3. nothing matched -> all zero.
    """
    c = _c(col)
    key = F.regexp_replace(c, strip_pattern, "") if strip_pattern else c
    bits_from_rules = F.array().cast("array<int>")
    if keywords:
        parts = [F.when(F.instr(key, k) > 0, F.array(*[F.lit(int(b)) for b in bs])).otherwise(F.array().cast("array<int>"))
                 for k, bs in keywords.items()]
        bits_from_rules = F.flatten(F.array(*parts))
    if phrases:
        entries = []
        for p, bs in phrases.items():
            entries += [F.lit(p), F.array(*[F.lit(int(b)) for b in bs]).cast("array<int>")]
        dict_bits = F.try_element_at(F.create_map(*entries), key)
        bits = F.coalesce(dict_bits, bits_from_rules)
    else:
        bits = bits_from_rules
    if sparse:
        return F.when(c.isNull(), SP.filled(int(width), missing_fill)).otherwise(SP.ones(int(width), bits))
    vec = F.transform(F.sequence(F.lit(0), F.lit(int(width) - 1)),
                      lambda i: F.when(F.array_contains(bits, i), F.lit(1.0)).otherwise(F.lit(0.0)))
    missing = F.lit(None).cast("array<double>") if missing_fill is None else F.array_repeat(F.lit(float(missing_fill)), int(width))
    return F.when(c.isNull(), missing).otherwise(vec)


def multi_hot_encode(df: DataFrame, col: str, width: int, out: str | None = None, **kw) -> DataFrame:
    return df.withColumn(out or col, multi_hot(col, width, **kw))


# ----------------------------------------------------------------------------- B5

def profile_columns(df: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """(column, role, n_missing) for every column, from one aggregation."""
    cols = list(roles)
    agg = df.agg(*[F.count_if(_c(c).isNull()).cast("long").alias(f"m{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', '{roles[c]}', m{i}" for i, c in enumerate(cols))
    return agg.selectExpr(f"stack({len(cols)}, {stack}) AS (column, role, n_missing)")


# ----------------------------------------------------------------------------- B6, B7

def select_features(df: DataFrame, target: str, features: Sequence[str], *, row_id: str | None = None) -> DataFrame:
    """Pick the target and features by name, keep the given order; unknown name fails now.

    Features are dense vectors unless one of the columns is sparse; then all are joined to one sparse vector.
    """
    missing = [c for c in [target, *features] if c not in df.columns]
    if missing:
        raise KeyError(f"unknown column(s): {missing}")
    sparse = any(SP.is_sparse(df.schema[c].dataType) for c in features)
    parts = []
    for c in features:
        dt = df.schema[c].dataType
        if sparse:
            parts.append(_c(c) if SP.is_sparse(dt) else SP.from_dense(_c(c).cast("array<double>")) if isinstance(dt, T.ArrayType)
                         else SP.sparse_vector(1, F.array(F.lit(0)), F.array(_c(c).cast("double"))))
            continue
        parts.append(_c(c).cast("array<double>") if isinstance(dt, T.ArrayType) else F.array(_c(c).cast("double")))
    tdt = df.schema[target].dataType
    label = _c(target).cast("array<double>") if isinstance(tdt, T.ArrayType) else F.array(_c(target).cast("double"))
    sel = [_c(row_id).cast("long").alias("row_id")] if row_id else []
    return df.select(*sel, label.alias("label"), (SP.concatenated(parts) if sparse else F.concat(*parts)).alias("features"))


def assemble_samples(df: DataFrame, row_id: str, label: Column, features: Sequence, *, check_width: bool = False) -> DataFrame:
    """(row_id, label, features). ``check_width`` runs one small job: all labels equal width."""
    feats = F.array(*[(_c(f)).cast("double") for f in features])
    out = df.select(_c(row_id).cast("long").alias("row_id"), label.cast("array<double>").alias("label"), feats.alias("features"))
    if check_width:
        lo, hi = out.agg(F.min(F.size("label")), F.max(F.size("label"))).first()
        if lo != hi:
            raise ValueError(f"label width differs between rows ({lo} .. {hi})")
    return out


# ----------------------------------------------------------------------------- B8-B10

def column_stats_row(df: DataFrame, cols: Sequence[str], *, zero_fill: bool = False) -> dict:
    """One pass: min, max, mean of every column -> {col: (min, max, mean)} on the driver.

    ``zero_fill`` counts missing cells as 0 as the reference does (Q8).
    """
    exprs = []
    for i, c in enumerate(cols):
        x = F.coalesce(_c(c).cast("double"), F.lit(0.0)) if zero_fill else _c(c).cast("double")
        exprs += [F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"), F.avg(x).alias(f"av{i}")]
    r = df.agg(*exprs).first()
    return {c: (r[f"mn{i}"], r[f"mx{i}"], r[f"av{i}"]) for i, c in enumerate(cols)}


def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, min, max, mean) for all columns from a single aggregation."""
    exprs = []
    for i, c in enumerate(cols):
        x = _c(c).cast("double")
        exprs += [F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"), F.avg(x).alias(f"av{i}")]
    stack = ", ".join(f"'{c}', mn{i}, mx{i}, av{i}" for i, c in enumerate(cols))
    return df.agg(*exprs).selectExpr(f"stack({len(cols)}, {stack}) AS (column, min, max, mean)")


def typed_cells(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """B1 and the casts: blank text becomes NULL, numeric columns doubles."""
    clean = blank_to_null(df)
    return clean.select(*[_c(c).cast("double").alias(c) if c in set(numeric) else _c(c) for c in clean.columns])


def write_observed(df: DataFrame, path: str, numeric: Sequence[str], *, zero_fill: bool = False) -> dict:
    """B8 while writing (A4): the typed table goes to Parquet and min, max, mean and the number of missing cells of every
    numeric column are observed on the way -> {col: (min, max, mean, missing)}.

    One job, one read of the input. Metrics are observed in the tasks that write, with no shuffle between, so a
    retried task counts once. ``zero_fill`` counts missing cells as 0 (Q8).
    """
    typed = typed_cells(df, numeric)
    exprs = []
    for i, c in enumerate(numeric):
        x = F.coalesce(_c(c), F.lit(0.0)) if zero_fill else _c(c)
        exprs += [F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"), F.avg(x).alias(f"av{i}"), F.count_if(_c(c).isNull()).alias(f"no{i}")]
    if not exprs:
        typed.write.parquet(path)
        return {}
    seen = Observation()
    typed.observe(seen, *exprs).write.parquet(path)
    m = seen.get
    return {c: (m.get(f"mn{i}"), m.get(f"mx{i}"), m.get(f"av{i}"), m.get(f"no{i}", 0)) for i, c in enumerate(numeric)}


def observed_stats(spark: SparkSession, stats: Mapping[str, tuple]) -> DataFrame:
    """(column, min, max, mean, n_missing) of what :func:`write_observed` returned, one row per column."""
    return spark.createDataFrame([(c, *stats[c]) for c in stats], "column string, min double, max double, mean double, n_missing long")


def impute_mean_expr(col, mean: float | None) -> Column:
    return F.coalesce(_c(col).cast("double"), F.lit(mean).cast("double"))


def scale_expr(x: Column, mn: float | None, mx: float | None) -> Column:
    """(x - min) / (max - min); a constant column gives 0.5 (Q11)."""
    if mn is None or mx is None:
        return F.lit(None).cast("double")
    if mx == mn:
        return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.lit(0.5))
    return (x - F.lit(float(mn))) / F.lit(float(mx) - float(mn))


def impute_mean(df: DataFrame, cols: Sequence[str], stats: Mapping | None = None, *, zero_fill_stats: bool = False) -> DataFrame:
    """Missing numeric cell <- column mean (stats from one pass unless given)."""
    stats = stats or column_stats_row(df, cols, zero_fill=zero_fill_stats)
    return df.select(*[impute_mean_expr(c, stats[c][2]).alias(c) if c in cols else _c(c) for c in df.columns])


def min_max_scale(df: DataFrame, cols: Sequence[str], stats: Mapping | None = None) -> DataFrame:
    """(x - min) / (max - min) per column, like ``ml.feature.MinMaxScaler``."""
    stats = stats or column_stats_row(df, cols)
    return df.select(*[scale_expr(_c(c).cast("double"), stats[c][0], stats[c][1]).alias(c) if c in cols else _c(c)
                       for c in df.columns])


def prepare_table(df: DataFrame, numeric: Sequence[str], *, one_hot_cols: Mapping[str, Sequence[str]] | None = None,
                  multi_hot_cols: Mapping[str, dict] | None = None, missing_fill: Mapping[str, float] | None = None,
                  zero_fill_stats: bool = False, double_scale: bool = False, written_to: str | None = None,
                  sparse: Sequence[str] = ()) -> tuple[DataFrame, dict]:
    """Blank -> NULL, encode categories, impute means, scale to [0, 1].

    With ``written_to`` the input is read once: one job writes the typed columns there and observes the statistics, and
    the result is a projection of what was written (only the columns that are asked for). This is the form for text
    tables and for inputs that are costly to make. Without it, the statistics are one aggregation and the result
    a projection of the input, which is then read twice.
    ``zero_fill_stats`` / ``double_scale`` reproduce the reference's imputation (Q8). Category columns named in
    ``sparse`` become sparse vectors.
    """
    one_hot_cols = one_hot_cols or {}
    multi_hot_cols = multi_hot_cols or {}
    missing_fill = missing_fill or {}
    if written_to is None:
        clean = blank_to_null(df)
        stats = column_stats_row(clean, list(numeric), zero_fill=zero_fill_stats)
    else:
        stats = write_observed(df, written_to, list(numeric), zero_fill=zero_fill_stats)
        clean = df.sparkSession.read.schema(typed_cells(df, numeric).schema).parquet(written_to)
    out = []
    for c in clean.columns:
        if c in numeric:
            mn, mx, av = stats[c][:3]
            x = _c(c).cast("double")
            if double_scale:
                filled = F.coalesce(x, scale_expr(F.lit(av), mn, mx))
            else:
                filled = impute_mean_expr(x, av)
            out.append(scale_expr(filled, mn, mx).alias(c))
        elif c in one_hot_cols:
            out.append(one_hot(c, one_hot_cols[c], missing_fill=missing_fill.get(c), sparse=c in sparse).alias(c))
        elif c in multi_hot_cols:
            spec = dict(multi_hot_cols[c])
            out.append(multi_hot(c, missing_fill=missing_fill.get(c), sparse=c in sparse, **spec).alias(c))
        else:
            out.append(_c(c))
    return clean.select(*out), stats
