"""Vaults that grow: two imports equal one, old placeholders stay, retries and crashes add nothing twice."""

import pytest

from hushframe.operators.vault import build_vault, extend_vault
from hushframe.plans import vaults
from hushframe.plans.vaults import grow_vault, read_vault

SCHEMA = "scope string, label string, value string, at bigint"
FIRST = [("a", "N", "Ada", 1), ("a", "N", "Bob", 2), ("a", "M", "x@y", 3), (None, "N", "Ada", 4), ("a", "N", "Ada", 5)]
SECOND = [("a", "N", "Cid", 6), ("a", "N", "Bob", 7), ("b", "N", "Bob", 8), (None, "N", "Dee", 9), (None, None, None, 10), ("a", "N", "Abe", 11), ("a", None, "Ada", 12)]


def rows_of(vault):
    return sorted((tuple(r) for r in vault.select("scope", "label", "value", "n", "placeholder", "uses").collect()), key=repr)


def test_two_imports_are_one(spark):
    one, two = (spark.createDataFrame(r, SCHEMA) for r in (FIRST, SECOND))
    grown = extend_vault(build_vault(one, ["at"]), two, ["at"])
    assert rows_of(grown) == rows_of(build_vault(one.unionByName(two), ["at"]))
    assert rows_of(extend_vault(build_vault(one.limit(0), ["at"]), one, ["at"])) == rows_of(build_vault(one, ["at"]))
    assert rows_of(extend_vault(build_vault(one, ["at"]), two.limit(0), ["at"])) == rows_of(build_vault(one, ["at"]))


def test_kept_vault(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "vault")
    one, two = (spark.createDataFrame(r, SCHEMA) for r in (FIRST, SECOND))
    assert rows_of(read_vault(spark, path)) == []
    grow_vault(one, path, "b1", ["at"])
    before = rows_of(read_vault(spark, path))
    real = vaults.write_rows

    def failing(df, where, table, batch, order):
        if table == "uses":
            raise RuntimeError("lost")
        return real(df, where, table, batch, order)

    monkeypatch.setattr(vaults, "write_rows", failing)
    with pytest.raises(RuntimeError, match="lost"):
        grow_vault(two, path, "b2", ["at"])
    assert rows_of(read_vault(spark, path)) == before == rows_of(build_vault(one, ["at"]))
    monkeypatch.setattr(vaults, "write_rows", real)
    for batch in ("b2", "b1", "b2"):  # what is there is not added again
        grow_vault(two if batch == "b2" else one, path, batch, ["at"])
    whole = rows_of(read_vault(spark, path))
    assert whole == rows_of(build_vault(one.unionByName(two), ["at"]))
    assert {r[:5] for r in before} <= {r[:5] for r in whole} and rows_of(read_vault(spark, path, 0)) == before


def test_hot_scope_of_many_values(spark):
    one = spark.range(0, 5000).selectExpr("'s' AS scope", "'N' AS label", "concat('v', id % 3000) AS value", "id AS at")
    two = spark.range(5000, 9000).selectExpr("'s' AS scope", "'N' AS label", "concat('v', id % 4000) AS value", "id AS at")
    grown = extend_vault(build_vault(one, ["at"]), two, ["at"])
    assert rows_of(grown) == rows_of(build_vault(one.unionByName(two), ["at"]))
