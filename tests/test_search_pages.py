"""Search by signatures equals the scan and opens fewer files; pages by key and by number equal the sorted list."""

import random

import pytest
from pyspark.sql import functions as F

from hushframe.plans import store
from hushframe.plans.audit import SORT_COLUMNS, Audit, filter_interactions, page_after, page_at
from hushframe.plans.search import audit_for, required, search_audit

SIGNS = ["alpha", "Beta", "γάμμα", "x%y", "a_b", "DELTA delta", "", "no", "é\U0001f600z", "back\\slash"]


def kept(spark, path, unsigned=False):
    rng = random.Random(3)
    for batch in range(4):
        rows = [(batch * 100 + i, [("user", f"b{batch} {rng.choice(SIGNS)} {rng.choice(SIGNS)}", rng.choice(SIGNS)) for _ in range(2)]) for i in range(20)]
        df = spark.createDataFrame(rows, "id bigint, texts array<struct<category:string,original:string,anonymized:string>>")
        df = df.select("*", F.lit("s").alias("source"), F.lit("w").alias("wire_format"), F.lit("m").alias("model"), F.create_map(F.lit("A"), F.lit(1)).alias("entity_counts"))
        store.append_audit(store.to_audit(df), path, f"b{batch}", searchable=not (unsigned and batch == 2))
    return path


def test_required():
    assert required("ab") == [] and required("a%bc_d") == [] and required("AbCd%xyz_") == ["abc", "bcd", "xyz"] and required("") == []


@pytest.mark.parametrize("unsigned", [False, True])
def test_search_equals_scan(spark, tmp_path, unsigned):
    path = kept(spark, str(tmp_path / "a"), unsigned)
    for q in ["alpha", "BETA", "γάμ", "x%y", "%y al", "a_b", "_b2%", "b3 ", "no", "zzz", "back\\sl", "é\U0001f600z", "%", "b1 %elta d%"]:
        want = {r.id for r in filter_interactions(store.read_audit(spark, path), q=q).select("id").collect()}
        assert {r.id for r in search_audit(spark, path, q).select("id").collect()} == want, q
    assert search_audit(spark, path, "alpha", sources=["other"]).count() == 0


def test_search_opens_fewer_files(spark, tmp_path):
    path = kept(spark, str(tmp_path / "a"))
    every = len(store.read_audit(spark, path).text.inputFiles())
    assert 0 < len(audit_for(spark, path, "b3 alpha").text.inputFiles()) < every
    assert len(audit_for(spark, path, "b3").text.inputFiles()) == every
    assert audit_for(spark, path, "nowhere").text.inputFiles() == [] and search_audit(spark, path, "nowhere").count() == 0
    store.delete_interaction(spark, path, 305)
    after = audit_for(spark, path, "b3 alpha").text
    assert 0 < len(after.inputFiles()) < every and after.filter("interaction_id = 305").count() == 0
    assert search_audit(spark, str(tmp_path / "none"), "alpha").count() == 0


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(i, rng.choice([None, "a", "b", "c"]), rng.choice([None, 1, 2])) for i in range(257)]
    return spark.createDataFrame(data, "id bigint, language string, entity_total bigint").repartition(5)


@pytest.mark.parametrize("sort,order", [("language", "asc"), ("language", "desc"), ("entity_total", "desc"), ("id", "asc"), ("id", "desc")])
def test_pages(rows, sort, order):
    way = F.col(sort).asc() if order == "asc" else F.col(sort).desc()
    want = [r.id for r in rows.orderBy(way, "id").collect()]
    got, after = [], None
    while True:
        page = page_after(rows, after, sort, order, 50).collect()
        if not page:
            break
        got += [r.id for r in page]
        after = (page[-1][sort], page[-1].id)
    assert got == want
    for page in (1, 2, 5, 6, 7, 900):
        assert [r.id for r in page_at(rows, sort, order, page, 50).collect()] == want[(page - 1) * 50 : page * 50]


def test_pages_of_nothing_and_unknown_columns(spark, rows):
    empty = spark.createDataFrame([], store.INTERACTION)
    assert page_at(empty).count() == 0 and page_after(empty).count() == 0 and page_after(empty, (None, 3)).count() == 0
    with pytest.raises(ValueError):
        page_at(rows, "id", size=0)
    assert "nothing" not in SORT_COLUMNS and page_at(empty, "nothing").count() == 0
    assert Audit(empty, empty, empty).interaction is empty
