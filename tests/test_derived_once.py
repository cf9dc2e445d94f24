"""What several writings read is derived once."""

from __future__ import annotations

from datetime import datetime

import pytest

from catalog import audit as queries
from hushframe.plans import store


@pytest.fixture
def tables(spark, tmp_path):
    day = datetime(2024, 1, 2)
    orders = [(i, 7, "PFO"[i % 3], 10.5, day, "1-URGENT") for i in (1, 2, 150, 151)]
    lines = [(i, float(k), "AN"[k % 2], "F") for i in (1, 2, 150) for k in range(3)]
    turns = [(i, t, "user", "The Thing [WORD_1] _n") for i in (1, 150) for t in range(2)]
    rows = {
        "orders": (orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": (lines, "l_orderkey bigint, l_quantity double, l_returnflag string, l_linestatus string"),
        "conversations": (turns, "conv_id bigint, turn bigint, role string, text string"),
    }
    for name, (data, ddl) in rows.items():
        spark.createDataFrame(data, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.fixture
def derived(spark, monkeypatch, capsys):
    """Which checkpoints and which writings read the lines of the orders."""
    seen = {"checkpoint": 0, "write": 0}

    def reads_lines(df):
        capsys.readouterr()
        df.explain(True)
        return "l_quantity" in capsys.readouterr().out

    frame = type(spark.range(1))
    checkpoint, write = frame.checkpoint, store.write_rows

    def kept(df, *args, **more):
        seen["checkpoint"] += reads_lines(df)
        return checkpoint(df, *args, **more)

    def written(df, *args, **more):
        seen["write"] += reads_lines(df)
        return write(df, *args, **more)

    monkeypatch.setattr(frame, "checkpoint", kept)
    monkeypatch.setattr(store, "write_rows", written)
    return seen


def test_appended_records_are_derived_once(spark, tables, derived):
    rows = {r.kind_of: r for r in queries.append_interactions(spark, tables).collect()}
    assert rows["interaction"].n == 4 and rows["interaction"].total == 9 and rows["text"].n == 8
    assert derived == {"checkpoint": 1, "write": 0}


def test_searched_tables_are_derived_once(spark, tables, derived):
    found = {(r.q, r.id) for r in queries.search_kept_texts(spark, tables).collect()}
    assert ("[word_1] _n", 1) in found and ("[word_1] _n", 150) in found
    assert derived["write"] == 0
