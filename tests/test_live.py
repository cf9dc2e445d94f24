"""Live audit, null keys and ends of streams on small frames."""

import random

from pyspark.sql import functions as F

from catalog.conversations import LIVE_POLICY, request_log
from catalog.inputs import word_spans
from hushframe.functions.spans import find_spans, span, splice
from hushframe.operators.ordered import lookup
from hushframe.operators.policy import policy
from hushframe.plans.live import exchange_states
from hushframe.plans import language
from hushframe.plans.language import detect_language, fit_profiles
from hushframe.plans.store import read_audit
from hushframe.streaming import audit as sa


def test_live_rows_have_their_language(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    profiles = fit_profiles(docs)
    rows = request_log(spark, sf).limit(12)
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    sa.start_request_audit(source, word_spans, policy(LIVE_POLICY), str(tmp_path / "audit"), str(tmp_path / "ckpt"), profiles=profiles).awaitTermination()
    found = read_audit(spark, str(tmp_path / "audit")).interaction
    assert found.count() == 12 and found.where("language IS NOT NULL").count() > 0


def test_language_ties_and_short_texts(spark):
    profiles = spark.createDataFrame([("en", "abc", 5), ("es", "abc", 5), ("de", "xyz", 9)], "lang string, gram string, weight bigint")
    rows = spark.createDataFrame([(1, "abc" + "-" * 9), (2, "abc"), (3, None), (4, "." * 3000 + "xyz")], "id bigint, text string")
    got = {r.id: r.language for r in detect_language(rows, profiles, ["id"]).collect()}
    assert got == {1: "en", 2: None, 3: None, 4: "de"}


def test_language_in_the_row_equals_the_join(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").withColumn("extra", F.lit(1))
    odd = [(-1, None, None), (-2, "en", ""), (-3, None, "\U0001d4d0\U0001d4d1 \u00c0 " * 9), (-4, "de", "stra\u00dfe " * 70000)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id bigint, lang string, text string").withColumn("extra", F.lit(2)))
    profiles = fit_profiles(docs)
    plain = docs.select("lang", F.explode(language.trigrams(language.readable(F.col("text")))).alias("gram")).groupBy("lang", "gram").count()
    share = plain.withColumn("total", F.expr("sum(count) OVER (PARTITION BY lang)")).select("lang", "gram", F.expr(f"count * {language.UNIT} div total"))
    assert share.exceptAll(profiles).isEmpty() and profiles.exceptAll(share).isEmpty()
    row = detect_language(docs, profiles, ["doc_id"])
    assert "Exchange" not in row._jdf.queryExecution().executedPlan().toString()
    in_row = {r.doc_id: r.language for r in row.collect()}
    monkeypatch.setattr(language, "BROADCAST_ROWS", 10)
    joined = {r.doc_id: r.language for r in detect_language(docs, profiles, ["doc_id"]).collect()}
    assert in_row == joined and in_row[-1] is None and in_row[-2] is None and in_row[-4] == "de"


def test_language_of_nothing(spark):
    none = spark.createDataFrame([], "id bigint, lang string, text string")
    assert fit_profiles(none).count() == 0 and detect_language(none, fit_profiles(none), ["id"]).count() == 0
    rows = spark.createDataFrame([(1, "a" * 20)], "id bigint, text string")
    assert [r.language for r in detect_language(rows, fit_profiles(none), ["id"]).collect()] == [None]


def test_lookup_null_and_hot_keys(spark):
    table = spark.createDataFrame([(None, "x", 900), ("a", "y", 3), ("b", "z", 1)], "k string, v string, uses bigint")
    left = spark.createDataFrame([(1, None), (2, "a"), (3, "b"), (4, "c")], "id bigint, k string")
    got = {r.id: r.v for r in lookup(left, table, ["k"], "v").collect()}
    assert got == {1: "x", 2: "y", 3: "z", 4: None}


def test_splice_never_loses_text(spark):
    row = spark.createDataFrame([("met Ada here",)], "text string")
    spans = F.array(span(F.lit(4), F.lit(7), "NAME"))
    out = row.select(splice(F.col("text"), spans, lambda s, i: F.lit(None).cast("string")).alias("x")).first().x
    assert out == "met [NAME] here"


def test_long_text_with_many_matches(spark):
    row = spark.range(1).select(F.repeat(F.lit("The "), 20000).alias("text"))
    found = row.select(find_spans(F.col("text"), "The", "X").alias("s")).first().s
    assert len(found) == 20000 and (found[-1].start, found[-1].end) == (79996, 79999)


def test_exchange_states_equal_a_walk(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", "c"]) if i % 3 else "hot", rng.randint(0, 40), rng.choice(["set", "clear", "flip", None, None])) for i in range(900)]
    df = spark.createDataFrame(rows, "id bigint, conversation_id string, at int, step string").repartition(5)
    state, want = {}, {}
    for i, c, _, step in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = now = state.get(c, False)
        state[c] = {"set": True, "clear": False, "flip": not now, None: now}[step]
    assert {r.id: r.open for r in exchange_states(df).collect()} == want
