"""Raw CSV folders: ragged rows, line breaks in cells, many blocks per file."""

import csv
import random

import pytest

from gridwash.sources import records, tables


@pytest.fixture
def small_blocks(spark):
    """Files are read in blocks of a few lines."""
    names = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def cell(rnd):
    return rnd.choice(
        ["", "x", "12", "a b", 'say "hi"', "two\nlines", "\n", "a,b", '"', 'end"', "é", "three\n\nlines, and\n\"quotes\"", "plain" * 9]
    )


def write(path, rows):
    with open(path, "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows(rows)


def test_folder_equals_python_reader(spark, tmp_path, small_blocks):
    rnd = random.Random(5)
    want = {}
    for k in range(4):
        rows = [[cell(rnd) for _ in range(rnd.choice([1, 3, 3, 5, 7]))] for _ in range(rnd.choice([0, 1, 60, 200]))]
        rows = [r for r in rows if any(x.strip() for x in r)]
        write(tmp_path / f"f{k}.csv", rows)
        want[f"f{k}.csv"] = rows
    got = tables.read_raw_folder(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 4
    widest = max(max((i + 1 for i, x in enumerate(r) if x), default=0) for rows in want.values() for r in rows)
    assert got.columns == ["file", "row_id", *[f"c{i}" for i in range(widest)]]
    found = {}
    for r in got.orderBy("row_id").collect():
        found.setdefault(r["file"].rsplit("/", 1)[1], []).append([x or "" for x in r[2:]])
    for name, rows in want.items():
        assert found.get(name, []) == [(r + [""] * widest)[:widest] for r in rows], name
    ids = got.select("file", "row_id").collect()
    assert len(set(ids)) == len(ids)


def test_cells_that_were_cut(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,"x\ny",c\n1,2,3,4\n\n5" pipe,6,7\n"a""b",",",""\n')
    got = tables.read_raw_folder(spark, str(tmp_path), 3).orderBy("row_id").drop("file", "row_id").collect()
    assert [tuple(r) for r in got] == [
        ("a", "x\ny", "c", None), ("1", "2", "3", "4"), ('5" pipe', "6", "7", None), ('a"b', ",", None, None)
    ]
    assert tables.read_raw_folder(spark, str(tmp_path), 9).columns[-1] == "c8"


def test_cell_over_many_blocks_and_never_closed(spark, tmp_path, small_blocks):
    long = "line\n" * 200
    (tmp_path / "a.csv").write_text(f'1,"{long}",2\nx,y\n7,"never\nclosed\n' + "z\n" * 100)
    got = tables.read_raw_folder(spark, str(tmp_path)).orderBy("row_id").collect()
    assert got[0].c1 == long and got[0].c2 == "2" and (got[1].c0, got[1].c1) == ("x", "y")
    assert len(got) == 3 and got[2].c0 == "7"


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_state_of_lines_equals_python_reader(sep):
    rnd = random.Random(sep)
    for _ in range(300):
        row = [cell(rnd) for _ in range(rnd.randint(1, 5))]
        import io

        out = io.StringIO()
        csv.writer(out, lineterminator="\n", delimiter=sep).writerow(row)
        state = records._State(False, sep)
        lines = out.getvalue()[:-1].split("\n")
        for i, line in enumerate(lines):
            state.read(line)
            assert state.inside == (i < len(lines) - 1)
        assert state.last == max((i + 1 for i, x in enumerate(row) if x), default=0)
