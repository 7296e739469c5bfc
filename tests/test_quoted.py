"""Quoted cells with line breaks: files of several byte ranges against the reader that takes a file as one task."""

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from stackwise.sources import quoted as Q
from stackwise.sources import tables as T


@contextmanager
def split_size(spark, n):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, str(n))
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def stock(spark, path, columns):
    return (spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", True).option("mode", "FAILFAST").csv(path))


def cell(r):
    kind = r.random()
    if kind < 0.2:
        return "plain" + str(r.randint(0, 99))
    text = "".join(r.choice(['a', 'é', ',', '\n', '""', ' ', 'x' * 20]) for _ in range(r.choice([0, 1, 3, 8, 60])))
    return f'"{text}"'


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    base = tmp_path_factory.mktemp("quoted")
    for k in range(4):
        r = random.Random(k)
        head = '"a","b ""q"" x","c"\n' if k % 2 else '"a","b\nnewline","c"\n'
        rows = [",".join(cell(r) for _ in range(3)) for _ in range([200, 60, 1, 0][k])]
        (base / f"part{k}.csv").write_text(head + "\n".join(rows) + ("\n" if k != 1 else ""))
    return str(base)


@pytest.mark.parametrize("size", [40, 97, 1000, 1 << 20])
def test_split_files_equal_whole_files(spark, files, size):
    columns = ["a", "b", "c"]
    want = sorted(map(tuple, stock(spark, files, columns).collect()), key=str)
    assert len(want) == 261 and any("\n" in (x or "") for r in want for x in r)
    with split_size(spark, size):
        got = T.read_raw_table(spark, files, columns, multi_line=True)
        assert got.columns == columns
        assert sorted(map(tuple, got.collect()), key=str) == want
        if size < 1000:
            assert len(Q.quoted_blocks(Q._lines(spark, files))) > 20


def test_cell_over_many_blocks(spark, tmp_path):
    long = "\n".join(f"line {i}" for i in range(500))
    (tmp_path / "t.csv").write_text(f'h,i\n1,"{long}"\n2,"x"\n\n3,""\n')
    with split_size(spark, 64):
        rows = {r.h: r.i for r in T.read_raw_table(spark, str(tmp_path / "t.csv"), multi_line=True).collect()}
    assert rows == {r.h: r.i for r in stock(spark, str(tmp_path / "t.csv"), ["h", "i"]).collect()}
    assert rows["1"] == long and rows["2"] == "x" and set(rows) == {"1", "2", "3"}


def test_wrong_records_raise_and_line_ends_with_returns(spark, tmp_path):
    (tmp_path / "bad.csv").write_text('a,b\n1,"x\ny"\n1,2,3\n')
    with pytest.raises(Exception, match="MALFORMED"):
        T.read_raw_table(spark, str(tmp_path / "bad.csv"), ["a", "b"], multi_line=True).collect()
    (tmp_path / "crlf.csv").write_bytes(b'a,b\r\n1,"x\ny"\r\n2,z\r\n')
    assert sorted(map(tuple, T.read_raw_table(spark, str(tmp_path / "crlf.csv"), ["a", "b"], multi_line=True).collect())) == [("1", "x\ny"), ("2", "z")]


def test_changed_split_size_is_an_error_not_a_wrong_result(spark, files):
    with split_size(spark, 50):
        table = T.read_raw_table(spark, files, ["a", "b", "c"], multi_line=True)
    with split_size(spark, 77), pytest.raises(Exception, match="split size"):
        table.collect()


def test_what_is_written_is_read_back(spark, tmp_path):
    df = spark.range(300).select(F.col("id").cast("string").alias("k"), F.concat(F.lit('say "'), F.col("id"), F.lit('",\n\n'), F.repeat(F.lit("z\n"), (F.col("id") % 5).cast("int"))).alias("note"))
    T.write_raw_table(df, str(tmp_path / "t"))
    with split_size(spark, 200):
        back = T.read_raw_table(spark, str(tmp_path / "t"), df.columns, multi_line=True)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
