"""Passes of the quantile search: columns sent, counts merged; products after
the shuffle of the folds."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from foldwise.catalog import fitting
from foldwise.operators import quantiles as Q


def test_a_pass_gets_only_columns_that_want_a_rank(spark, monkeypatch):
    sent, real = [], Q._count

    def count(cuts, exact):
        sent.append([c is not None for c in cuts])
        return real(cuts, exact)

    monkeypatch.setattr(Q, "_count", count)
    df = spark.range(0, 3000, 1, 2).select(F.lit(4.0).alias("same"), F.sin("id").alias("wide"))
    found = Q.quantiles_of(df, ["same", "wide"], [0.25, 0.5], buckets=8, last_rows=0)[Q.ALL]
    want = np.quantile(np.sin(np.arange(3000)), [0.25, 0.5])
    assert found["same"] == [4.0, 4.0] and np.allclose(found["wide"], want, rtol=0, atol=1e-12)
    assert len(sent) > 2 and sent[0] == [True, True] and all(s == [True] for s in sent[1:])


def test_counts_are_merged_as_they_grow(monkeypatch):
    monkeypatch.setattr(Q, "HELD", 20)
    rng = np.random.default_rng(5)
    for few in (64, 1):                                    # group by group, and by two columns
        monkeypatch.setattr(Q, "FEW_GROUPS", few)
        g, v = rng.integers(0, 3, 4000), rng.normal(size=4000)
        keys = Q.to_keys(v)
        cut = Q._Cut([(int(keys.min()), int(keys.max()))], False, 64)
        batches = [pa.RecordBatch.from_arrays([pa.array(g[i:i + 100]), pa.array(v[i:i + 100])], ["g", "v"])
                   for i in range(0, 4000, 100)]
        got = pa.Table.from_batches(Q._count([cut], False)(iter(batches))).to_pylist()
        cell = cut.cells(keys)[1]
        assert len(got) == len({(a, b) for a, b in zip(g.tolist(), cell.tolist())})
        for r in got:
            own = keys[(g == r["grp"]) & (cell == r["cell"])]
            assert (r["n"], r["lo"], r["hi"]) == (len(own), own.min(), own.max())


def test_products_are_not_in_the_shuffle_of_the_folds(spark, monkeypatch):
    n = 400
    rows = [(str(k), float(k % 50), float(k % 37) + 1, (k % 10) / 100, (k % 8) / 100) for k in range(n)]
    table = spark.createDataFrame(rows, "key string, l_quantity double, l_extendedprice double, "
                                        "l_discount double, l_tax double")
    table = table.withColumn("y", F.expr("l_extendedprice * (1 - l_discount) * (1 + l_tax)"))
    seen, real = [], fitting.assign_folds
    monkeypatch.setattr(fitting, "net_charge", lambda *_: table)
    monkeypatch.setattr(fitting, "assign_folds", lambda df, *a, **k: (seen.append(df.columns), real(df, *a, **k))[1])
    got = fitting.poly_ridge_oof(spark, "").collect()[0]
    assert got["n_rows"] == n and got["r2"] > 0.99
    assert len(seen) == 1 and len(seen[0]) == 6
