"""Kept figures equal those of a scan: random batches, retries, deletes, folders without parts, other time zones."""

import random
from datetime import datetime, timedelta

from hushframe.plans import audit as q
from hushframe.plans import rollups as ru
from hushframe.plans import store
from hushframe.plans.versions import read_version, vacuum

RECORD = "id bigint, source string, wire_format string, kind string, model string, language string, input_tokens bigint, output_tokens bigint, entity_counts map<string,bigint>, created_at timestamp, conversation_id string"


def batch(spark, rng, ids):
    def row(i):
        at = datetime(2024, 5, 1) + timedelta(minutes=rng.randint(0, 5000), microseconds=rng.randint(0, 999_999))
        maybe = lambda v: v if rng.random() < 0.8 else None
        counts = {k: rng.randint(0, 4) for k in rng.sample("ABCD", rng.randint(0, 3))}
        return i, maybe(rng.choice("st")), "w", rng.choice(["main", "side"]), maybe(rng.choice("mno")), maybe("en"), maybe(i), maybe(2 * i), counts, at, maybe(rng.choice(["hot", "hot", "c1", "c2", ""]))

    return store.to_audit(spark.createDataFrame([row(i) for i in ids], RECORD))


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def same_as_scan(spark, path):
    r, a = ru.read_rollups(spark, path), store.read_audit(spark, path)
    for name in ("summary", "daily_series", "group_counts", "token_totals", "ranked_totals", "distinct_values"):
        assert rows(getattr(ru, name)(r)) == rows(getattr(q, name)(a)), name
    assert rows(ru.summarize_conversations(r)) == rows(q.list_conversations(a, page=None))
    for sort, order, page in (("last_seen", "desc", 1), ("entity_total", "asc", 2)):
        assert ru.list_conversations(r, page, 2, sort, order).collect() == q.list_conversations(a, page, 2, sort, order).select(*ru.list_conversations(r).columns).collect()


def test_rollups_equal_a_scan(spark, tmp_path):
    path, rng = str(tmp_path / "audit"), random.Random(4)
    for name, ids, rolled in (("b1", range(40), True), ("b2", range(40, 70), True), ("old", range(70, 85), False), ("b2", range(40, 66), True)):
        store.append_audit(batch(spark, rng, ids), path, name, rolled=rolled)
    same_as_scan(spark, path)
    before = read_version(spark, path).batches
    assert store.delete_interaction(spark, path, 5) and store.delete_interaction(spark, path, 72)
    after = read_version(spark, path).batches
    assert after["b2"] == before["b2"] and set(after["b1"]["rolled_slot"]) == set(after["b1"]["interaction"]) and "rolled_slot" not in after["old"]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kathmandu")
    try:
        same_as_scan(spark, path)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert vacuum(spark, path, keep=1, older_than=-1) > 0
    same_as_scan(spark, path)


def test_only_parts_are_read(spark, tmp_path):
    path = str(tmp_path / "audit")
    store.append_audit(batch(spark, random.Random(1), range(9)), path, "b1", rolled=True)
    r = ru.read_rollups(spark, path)
    assert all("/rolled_" in f for df in (r.slot, r.type, r.conversation, r.count) for f in df.inputFiles())
    none = ru.read_rollups(spark, str(tmp_path / "nothing"))
    assert ru.summary(none).first()[:] == (0, 0) and ru.summarize_conversations(none).count() == 0
