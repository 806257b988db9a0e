"""Records with line ends in quoted cells, read split by split."""

import random

import duckdb
import pytest

from foldwise.sources.csv import read_table, records


def _cell(rng, k):
    plain = ["x", "längeres wort", "5\" pipe", "", "日本語", "a'b"]
    broken = ["two\nlines", "a \"\"word\"\", then\nmore, still\n\nend", "q" * 90 + "\n" + "r" * 400, "\"\"", "\n"]
    return f'"{rng.choice(broken)}"' if rng.random() < k else rng.choice(plain)


def _write(path, n, share, end="\n", encoding="utf-8", seed=1, last=True):
    rng = random.Random(seed)
    rows = [f"{i},{_cell(rng, share)},{_cell(rng, share)},z{i}" for i in range(n)]
    text = "id,a, b ,c" + end + end.join(rows) + (end if last else "")
    path.write_bytes(text.encode(encoding, "replace"))


def _rows(df):
    return sorted(tuple(v or None for v in r) for r in df.collect())


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("share,last", [(0.3, True), (0.9, False), (0.02, True)])
def test_records_over_many_splits(spark, tmp_path, small_splits, share, last):
    path = tmp_path / "t.csv"
    _write(path, 300, share, last=last)
    assert path.stat().st_size > 1500 * 5
    got = read_table(spark, str(path))
    assert got.columns == ["id", "a", "b", "c"]
    want = duckdb.sql(f"SELECT * FROM read_csv('{path}', header=true, all_varchar=true, delim=',', quote='\"', "
                      "escape='\"', strict_mode=false, max_line_size=100000)").fetchall()
    assert len(want) == 300 and _rows(got) == sorted(tuple(v or None for v in r) for r in want)


def test_one_cell_over_several_splits(spark, tmp_path, small_splits):
    path = tmp_path / "t.csv"
    long = "\n".join(f"line {i}" for i in range(2000))
    path.write_text(f'id,a\n1,"{long}"\n2,y\n3,"{long}"\n')
    got = {r.id: r.a for r in read_table(spark, str(path)).collect()}
    assert got == {"1": long, "2": "y", "3": long}
    assert records(spark, str(path)).count() == 4


def test_line_ends_folders_and_encoding(spark, tmp_path, small_splits):
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(3):
        _write(folder / f"p{k}.csv", 60, 0.4, end="\r\n", encoding="cp932", seed=k)
    got = read_table(spark, str(folder))
    assert got.count() == 180 and {r.c for r in got.select("c").collect()} == {f"z{i}" for i in range(60)}
    head = tmp_path / "h.csv"
    head.write_text('id,"two\nlines"\n1,"a\nb"\n')
    df = read_table(spark, str(head))
    assert df.columns == ["id", "two\nlines"] and [tuple(r) for r in df.collect()] == [("1", "a\nb")]
