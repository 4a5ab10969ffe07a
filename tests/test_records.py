"""Delimited text read in parallel, against Python's csv module, under many sizes of ranges."""

import csv
import itertools
import random

import pytest
from pyspark.sql import functions as F

from veilframe.sources import records as R
from veilframe.sources import tables as S


@pytest.fixture
def ranges_of(spark):
    """Sets the size of the ranges that files are cut into."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(n) for n in names]

    def to(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], 0)

    yield to
    for n, v in zip(names, old):
        spark.conf.set(n, v)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Files with quotes, delimiters and line breaks in cells, of several line ends; their rows in the order of the files."""
    path, rng, rows = tmp_path_factory.mktemp("text files"), random.Random(1), []
    for f, end in enumerate(["\n", "\r\n", "\n", "\n"]):
        own = [[f"{f}-{i}", *["".join(rng.choices(["a", "b", '"', "\n", ",", " ", "\r\n", "é", "x" * 30], k=rng.randrange(0, 12))) for _ in range(2)]] for i in range(200)]
        own = own if f != 3 else []  # a file with a header only
        with open(path / f"part {f}.csv", "w", newline="") as out:
            made = csv.writer(out, lineterminator=end)
            made.writerow(["k", "u", "v"])
            for row in own:
                made.writerow(row)
                out.write(end * rng.randrange(2))  # blank lines
        rows += own
    return str(path), rows


@pytest.mark.parametrize("size", [64, 700, 5000, 1 << 20])
def test_cells_with_line_breaks_under_any_ranges(spark, folder, ranges_of, size):
    path, rows = folder
    ranges_of(size)
    df = S.read_delimited(spark, path, ",", position="at", reject="bad")
    got = sorted(df.collect(), key=lambda r: r["at"])
    assert [r["at"] for r in got] == list(range(len(rows)))
    assert [[r["k"], r["u"] or "", r["v"] or ""] for r in got] == rows and not any(r["bad"] for r in got)
    if size == 64:
        assert R.ranges(spark, path, ",").where("is_open").count() > 20


def test_long_cells_over_many_ranges(spark, tmp_path, ranges_of):
    rows = [["1", "line\n" * 500], ["2", '"\n' * 300], ["3", ""], ["4", "\n"]]
    with open(tmp_path / "a.csv", "w", newline="") as out:
        csv.writer(out, lineterminator="\n").writerows([["k", "v"], *rows])
    ranges_of(100)
    got = S.read_delimited(spark, str(tmp_path), ",").orderBy("k").collect()
    assert [[r["k"], r["v"] or ""] for r in got] == rows
    assert R.records(spark, str(tmp_path), ",").count() == 5


def test_ragged_records_are_kept_whole(spark, tmp_path, ranges_of):
    text = 'a;b\n1;2\n1\n"x\n;y";2;"3\n;4"\n\n  \n5;5" stays\n'
    (tmp_path / "r.csv").write_text(text)
    for size in (4, 1000):
        ranges_of(size)
        got = S.read_delimited(spark, str(tmp_path / "r.csv"), ";", reject="bad", position="n").orderBy("n").collect()
        assert [tuple(r) for r in got] == [
            ("1", "2", None, 0), ("1", None, "1", 1), ("x\n;y", "2", '"x\n;y";2;"3\n;4"', 2), ("5", '5" stays', None, 3),
        ]
        issues = S.structure_issues(spark, str(tmp_path / "r.csv"), ["a", "b"], ";").collect()
        assert sorted((r["check"], r["found"]) for r in issues) == [("column_count", 1), ("column_count", 3), ("extra_columns", 3), ("missing_columns", 1)]


def test_an_open_cell_reaches_to_the_end_of_its_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"never closed\n2,x\n')
    (tmp_path / "b.csv").write_text("k,v\n3,y\n")
    assert R.records(spark, str(tmp_path), ",").where("nr > 0").count() == 2
    assert {r["record"] for r in R.records(spark, str(tmp_path), ",").where("nr > 0").collect()} == {'1,"never closed\n2,x', "3,y"}


def test_state_of_a_line_by_brute_force():
    """Against a walk through the characters."""

    def walk(line, is_open):
        at, begin = 0, not is_open
        while at < len(line):
            c = line[at]
            if is_open:
                if c == '"' and line[at + 1 : at + 2] == '"':
                    at += 1
                elif c == '"':
                    is_open = False
            elif c == '"' and begin:
                is_open = True
                begin = False
                at += 1
                continue
            begin = c == "," and not is_open
            at += 1
        return is_open

    for n in range(7):
        for line in map("".join, itertools.product('a",', repeat=n)):
            for is_open in (False, True):
                assert R.ends_open(line, ",", is_open) == walk(line, is_open), (line, is_open)


def test_other_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,x\n2,"y"\n')
    assert [tuple(r) for r in S.read_delimited(spark, str(tmp_path / "a.csv"), ",", line_breaks=False).collect()] == [("1", "x"), ("2", "y")]
    with pytest.raises(ValueError):
        S.read_delimited(spark, str(tmp_path / "a.csv"), ",", line_breaks=False, position="n")
    plan = S.read_delimited(spark, str(tmp_path / "a.csv"), ",")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert S.read_delimited(spark, str(tmp_path / "a.csv"), ",", max_rows=1).agg(F.count("*")).first()[0] == 1
