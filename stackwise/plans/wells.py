"""The 41-column well table, derived from ``orders`` (one well record per order).

Every cell is arithmetic on the order's columns: categories and phrases walk their dictionaries, with a blank
cell after the last value; numeric cells are missing in every 13th row, at another row for each column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwise import roles
from stackwise.operators import prepare as P
from stackwise.plans import inputs as I
from stackwise.session import scratch_path

PHRASES = [*roles.DIAGNOSIS_PHRASES, "抽油杆断脱,位置距井口m:812.5", "无此结论", ""]


def _pick(values: list[str], index: Column) -> Column:
    """The index-th value, round and round."""
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def well_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id and the 41 columns, as a cleaned file would hold them."""
    o = I.table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    cells = []
    for j, name in enumerate(roles.COLUMNS):
        if name == "井号":
            cell = F.concat(F.lit("W"), key.cast("string"))
        elif name == "泵况分析结果":
            cell = _pick(PHRASES, key * 5 + cust)
        elif name in roles.ONE_HOT:
            cell = _pick([*roles.ONE_HOT[name], ""], key * 3 + cust * 7 + j)
        else:
            value = ((key * (j + 3) + cust * (j + 7)) % 997) / 10 + F.col("o_totalprice") / 100000
            cell = F.when((key + j) % 13 != 0, value)
        cells.append(cell.alias(name))
    return o.select(key.cast("long").alias("row_id"), *cells)


def prepared_wells(spark: SparkSession, sf_dir: str, columns: Sequence[str] = roles.COLUMNS, sparse: Sequence[str] = ()) -> DataFrame:
    """``columns`` of the table through ``prepare_table`` with the roles, dictionaries, phrases and fills of :mod:`stackwise.roles`.

    The records are made once: typed columns are written to the scratch folder with their statistics observed.
    """
    spec = {c: role for c, role in roles.role_spec().items() if c in columns}
    diagnosis = {c: {"width": roles.DIAGNOSIS_WIDTH, "phrases": roles.DIAGNOSIS_PHRASES, "strip_pattern": roles.DIAGNOSIS_DEPTH_SUFFIX}
                 for c, role in spec.items() if role == "multi_hot"}
    wells = well_records(spark, sf_dir).select("row_id", *(f"`{c}`" for c in columns))
    out, _ = P.prepare_table(wells, [c for c, role in spec.items() if role == "numeric"], one_hot_cols=roles.ONE_HOT,
                             multi_hot_cols=diagnosis, missing_fill=roles.MISSING_FILL, written_to=scratch_path(spark, "typed-wells"), sparse=sparse)
    return out


FEATURES = [c for c in roles.COLUMNS if c not in ("井号", roles.EXAMPLE_TARGET)]  # every column but the name and the target


def wide_samples(spark: SparkSession, sf_dir: str, *, sparse: bool = True) -> DataFrame:
    """(row_id, label, features) of all columns of the prepared table, categories as sparse (or dense) vectors."""
    codes = [c for c in FEATURES if c in roles.TEXT_COLUMNS] if sparse else ()
    return P.select_features(prepared_wells(spark, sf_dir, [roles.EXAMPLE_TARGET, *FEATURES], codes), roles.EXAMPLE_TARGET, FEATURES, row_id="row_id")
