"""A CSV file scored and written beside its input."""

import os

from foldwise.plans.fitted import FittedPlan
from foldwise.plans.train import predict_file
from foldwise.session import shared_path
from foldwise.sources.csv import read_table


def test_predict_file(spark, tmp_path):
    path = tmp_path / "new rows.csv"
    path.write_bytes('﻿id,x,note\n1,2.5,"a ""b"""\n2,4,"two\nlines"\n3,,plain\n'.encode())
    plan = FittedPlan(target="y", features=["x"], raw_columns=["x", "y"], numeric_text=["x"], medians={"x": 1.0},
                      model={"type": "linear", "intercept": 1.0, "weights": {"x": 2.0}})
    out = predict_file(plan, spark, str(path))
    assert out == str(tmp_path / "new rows_predicted.csv")
    parts = [p for p in os.listdir(out) if p.endswith(".csv")]
    assert parts and all(open(os.path.join(out, p), "rb").read(3) == b"\xef\xbb\xbf" for p in parts)
    back = read_table(spark, out)
    assert back.columns == ["id", "x", "note", "y"]
    assert sorted((r.id, r.note, float(r.y)) for r in back.collect()) == [
        ("1", 'a "b"', 6.0), ("2", "two\nlines", 9.0), ("3", "plain", 3.0)]


def test_shared_paths_differ(spark):
    a, b = shared_path(spark, "t"), shared_path(spark, "t")
    assert a != b and not os.path.exists(a)
