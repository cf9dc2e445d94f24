"""Vault, policy, redaction, telemetry, alignment."""

import json
import random

from pyspark.sql import functions as F

from hushframe.functions.align import align, values_by_type
from hushframe.functions.spans import choose_spans
from hushframe.functions.text import truncate_title
from hushframe.operators.detectors import explode_spans, literal_detector, with_spans
from hushframe.operators.ordered import number_rows, running_sum
from hushframe.operators.policy import action_of, apply_policy, block_tally, hook_verdict, policy, resolve_actions, verdicts
from hushframe.operators.redact import redact_frame, redact_json, redact_text, redactor
from hushframe.operators.row_vault import pseudonymize_row, restore_row, value_map
from hushframe.operators.telemetry import scrub_payloads, split_valid, telemetry_interactions
from hushframe.operators.vault import build_vault, counts_map, export_vault, pseudonymize, restore, type_counts

PEOPLE = {n: "PERSON_NAME" for n in ("John", "Ada", "Linus", "Grace")}


def _row(spark, text, literals):
    df = with_spans(spark.createDataFrame([(1, text)], "id int, text string"), literal_detector(literals))
    return df.withColumn("chosen", choose_spans(F.col("spans")))


def test_row_pseudonyms(spark):
    for text, want in [
        ("John met John; tell John.", "[PERSON_NAME_1] met [PERSON_NAME_1]; tell [PERSON_NAME_1]."),
        ("Ada and Linus and Grace.", "[PERSON_NAME_1] and [PERSON_NAME_2] and [PERSON_NAME_3]."),
        ("nobody", "nobody"),
    ]:
        df = _row(spark, text, PEOPLE).withColumn("d", pseudonymize_row(F.col("text"), F.col("chosen")))
        r = df.select("d.text", restore_row(F.col("d.text"), value_map(F.col("d.vault"))).alias("back")).first()
        assert r.text == want and r.back == text


def test_overlap_takes_earliest(spark):
    df = _row(spark, "Dr John Smith", {"Dr John Smith": "PERSON_ROLE_OR_TITLE", "John Smith": "PERSON_NAME"})
    assert df.select(pseudonymize_row(F.col("text"), F.col("chosen"))["text"].alias("t")).first().t == "[PERSON_ROLE_OR_TITLE_1]"


def test_restore_is_one_pass_and_exact(spark):
    vault = {f"[PERSON_NAME_{i + 1}]": f"name{i}" for i in range(11)}
    vault["[X_1]"] = "[PERSON_NAME_1]"  # a value that looks like a placeholder stays
    df = spark.createDataFrame(
        [("[PERSON_NAME_1] and [PERSON_NAME_10] and [PERSON_NAME_11] [X_1] [NO_9] [",)], "t string"
    ).withColumn("m", F.create_map(*[F.lit(x) for kv in vault.items() for x in kv]))
    got = df.select(restore_row(F.col("t"), F.col("m")).alias("r")).first().r
    assert got == "name0 and name9 and name10 [PERSON_NAME_1] [NO_9] ["


def _corpus(spark, n=300):
    rng = random.Random(3)
    names = [f"P{i:03d}x" for i in range(40)]
    rows = []
    for i in range(n):
        scope = "hot" if i % 3 else f"s{i % 5}"
        words = [rng.choice(names) if rng.random() < 0.3 else "word" for _ in range(12)]
        if scope == "hot":
            words.insert(rng.randint(0, 5), "P000x")  # a value in most rows
        rows.append((i, scope, " ".join(words)))
    return rows, {v: ("PERSON_NAME" if int(v[1:4]) % 2 else "ORG") for v in names}


def test_table_vault_equals_brute_force(spark):
    rows, literals = _corpus(spark)
    df = spark.createDataFrame(rows, "doc_id int, scope string, text string")
    df = with_spans(df, literal_detector(literals)).withColumn("spans", choose_spans(F.col("spans"))).cache()
    spans = explode_spans(df)
    vault = build_vault(spans, ["doc_id", "start"])

    numbers, counters, texts = {}, {}, {}
    for doc_id, scope, text in rows:
        out = []
        for w in text.split(" "):
            if w in literals:
                key = (scope, literals[w], w)
                if key not in numbers:
                    counters[key[:2]] = counters.get(key[:2], 0) + 1
                    numbers[key] = counters[key[:2]]
                w = f"[{key[1]}_{numbers[key]}]"
            out.append(w)
        texts[doc_id] = " ".join(out)
    assert {(r.scope, r.label, r.value): r.n for r in vault.collect()} == numbers

    masked = pseudonymize(df, vault, ["doc_id"])
    back = restore(masked, vault, ["doc_id"])
    got = back.select("doc_id", "text", "anonymized", "restored").collect()
    assert {r.doc_id: r.anonymized for r in got} == texts
    assert all(r.restored == r.text for r in got)
    counts = counts_map(type_counts(spans, ["scope"]), ["scope"]).collect()
    assert {(r.scope, k): v for r in counts for k, v in r.entity_counts.items()} == counters
    assert export_vault(vault, ["hot"]).count() == sum(1 for k in numbers if k[0] == "hot")


def test_running_sum_crosses_partitions(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, rng.randint(0, 4)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(7)
    got = {(r.k, r.o): r.s for r in running_sum(df, ["k"], ["o"], F.col("v"), "s").collect()}
    total, want = {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        total[k] = total.get(k, 0) + v
        want[k, o] = total[k]
    assert got == want
    n = number_rows(df.withColumn("k", F.when(F.col("k") != "k1", F.col("k"))), ["k"], ["o"]).filter("k is null")
    assert sorted(r.n for r in n.collect()) == list(range(1, n.count() + 1))  # null is a key like any other


RULES = {"SECRET_*": "block", "SECRET_JWT": "redact", "SECRET_AWS_*": "pseudonymize"}


def test_policy_resolution(spark):
    want = {"SECRET_JWT": "redact", "SECRET_AWS_ACCESS_KEY": "pseudonymize", "SECRET_X": "block", "PERSON_NAME": "keep"}
    df = spark.createDataFrame([(k,) for k in want], "label string")
    got = {r.label: r.a for r in df.select("label", action_of(F.col("label"), RULES, "keep").alias("a")).collect()}
    assert got == want
    table = spark.createDataFrame(list(RULES.items()), "pattern string, action string")
    assert {r.label: r.action for r in resolve_actions(df, table, "keep").collect()} == want


def test_apply_policy(spark):
    rules = {"EMAIL": "keep", "SECRET_KEY": "block", "CARD": "redact"}
    df = _row(spark, "Ada john@x.com AKIA123 4111", {"Ada": "PERSON_NAME", "john@x.com": "EMAIL", "AKIA123": "SECRET_KEY", "4111": "CARD"})
    r = df.select(apply_policy(F.col("text"), F.col("chosen"), policy(rules)).alias("p")).first().p
    assert r.text == "[PERSON_NAME_1] john@x.com AKIA123 [REDACTED]"
    assert r.blocked == {"SECRET_KEY": 1} and len(r.vault) == 1
    spans = explode_spans(df, spans="chosen", keep=["id"])
    assert [(x.label, x.blocked) for x in block_tally(spans, policy(rules), ["id"]).collect()] == [("SECRET_KEY", 1)]
    v = verdicts(spans, policy(rules), ["id"]).first()
    assert v.blocked and v.policy == "block"


def test_hook_verdict(spark):
    df = spark.createDataFrame(
        [("beforeSubmitPrompt", {"SECRET_X": 1}), ("beforeReadFile", {"PERSON": 1}), ("afterAgentResponse", {"SECRET_X": 1}), ("beforeSubmitPrompt", {})],
        "e string, c map<string,bigint>",
    )
    action = policy({"SECRET_*": "block"})
    assert [r.v for r in df.select(hook_verdict(F.col("e"), F.col("c"), action).alias("v")).collect()] == ["deny", "allow", "allow", "allow"]
    assert [r.v for r in df.select(hook_verdict(F.col("e"), F.col("c"), action, True).alias("v")).collect()] == ["deny", "deny", "allow", "allow"]


def test_redact_expands_to_words(spark):
    df = _row(spark, "Email jan@x.pl. Drugi: ola@y.pl!", {"jan@": "E", "y.pl": "E"})
    assert df.select(redact_text(F.col("text"), F.col("spans")).alias("r")).first().r == "Email [REDACTED]. Drugi: [REDACTED]!"
    df = _row(spark, 'Kontakt: "jan@x.pl", potem (ola@y.pl)!', {"jan@": "E", "y.pl": "E"})
    assert df.select(redact_text(F.col("text"), F.col("spans")).alias("r")).first().r == 'Kontakt: "[REDACTED]", potem ([REDACTED])!'
    df = _row(spark, "a ... b Jan Kowalski c", {"...": "P", "Jan": "N", "Kowalski": "N"})
    assert df.select(redact_text(F.col("text"), F.col("spans"), "#").alias("r")).first().r == "a ... b # # c"
    assert df.select(redact_text(F.col("text"), F.col("spans"), "#", expand=False).alias("r")).first().r == "a # b # # c"


NESTED = "id int, messages array<struct<role:string,content:string>>, extra map<string,string>, usage struct<total_tokens:int>, note string"


def _nested(spark):
    return spark.createDataFrame(
        [(1, [("user", "I am John"), ("assistant", "hi John")], {"a": "John", "b": "x John"}, (123,), "John here")], NESTED
    )


def test_nested_redaction(spark):
    detect = literal_detector({"John": "PERSON_NAME"})
    r = redact_frame(_nested(spark), detect).first()
    assert [m.content for m in r.messages] == ["I am [REDACTED]", "hi [REDACTED]"]
    assert r.extra == {"a": "[REDACTED]", "b": "x [REDACTED]"} and r.usage.total_tokens == 123 and r.note == "[REDACTED] here"

    r = redact_frame(_nested(spark), detect, include_paths=["messages.*.content"], exclude_paths=["messages.1"]).first()
    assert [m.content for m in r.messages] == ["I am [REDACTED]", "hi John"] and r.note == "John here" and r.extra["a"] == "John"

    r = redact_frame(_nested(spark), detect, include_paths=["extra.a", "note"], exclude_paths=["note"]).first()
    assert r.extra == {"a": "[REDACTED]", "b": "x John"} and r.note == "John here"

    r = redact_frame(_nested(spark), detect, max_depth=2, columns=["messages"]).first()
    assert r.messages[0] == ("[REDACTED]", "[REDACTED]") or [tuple(m) for m in r.messages] == [("[REDACTED]", "[REDACTED]")] * 2
    r = redact_frame(_nested(spark), detect, include_labels=["OTHER"]).first()
    assert r.note == "John here"


def test_redact_json(spark):
    body = {"John": "John", "n": 1, "deep": [{"k": 'say "John"\né'}, None, True]}
    df = spark.createDataFrame([(json.dumps(body),)], "b string")
    got = json.loads(df.select(redact_json(F.col("b"), redactor(literal_detector({"John": "P"}))).alias("r")).first().r)
    assert got == {"John": "[REDACTED]", "n": 1, "deep": [{"k": 'say "[REDACTED]"\né'}, None, True]}


def _otlp(*values):
    return json.dumps(
        {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"body": {"stringValue": v}, "attributes": [{"key": "stringValue", "value": {"intValue": "1"}}]} for v in values]}]}]}
    )


def test_telemetry(spark):
    detect = literal_detector({"John Smith": "PERSON_NAME", "j@x.com": "EMAIL_ADDRESS"})
    rows = [
        ("a", "logs", _otlp('John Smith "q"', "again John Smith j@x.com")),
        ("b", "traces", _otlp("John Smith")),
        ("c", "logs", _otlp("clean")),
        ("d", "logs", "[1]"),
        ("e", "logs", "not json"),
        ("f", "logs", _otlp('{"stringValue":"John Smith"}')),
    ]
    good, bad = split_valid(spark.createDataFrame(rows, "payload_id string, signal string, body string"))
    assert sorted(r.payload_id for r in bad.collect()) == ["d", "e"]
    done = scrub_payloads(good, detect)
    got = {r.payload_id: r for r in done.collect()}
    texts = [x["body"]["stringValue"] for x in json.loads(got["a"].body)["resourceLogs"][0]["scopeLogs"][0]["logRecords"]]
    assert texts == ['[PERSON_NAME_1] "q"', "again [PERSON_NAME_1] [EMAIL_ADDRESS_1]"]
    assert got["a"].counts == {"PERSON_NAME": 1, "EMAIL_ADDRESS": 1} and got["c"].body == rows[2][2]
    inner = json.loads(got["f"].body)["resourceLogs"][0]["scopeLogs"][0]["logRecords"][0]["body"]["stringValue"]
    assert inner == '{"stringValue":"[PERSON_NAME_1]"}'
    audit = telemetry_interactions(done).collect()
    assert sorted((r.payload_id, r.wire_format, r.model, r.source) for r in audit) == [("a", "otel", "logs", "otel"), ("f", "otel", "logs", "otel")]


ALIGN = [
    ("Hi John, bye", "Hi [PERSON_NAME_1], bye", ["John"], True),
    ("John", "[PERSON_NAME_1]", ["John"], True),
    ("a John b Ada c", "a [P_1] b [P_2] c", ["John", "Ada"], True),
    ("JohnAda", "[P_1][P_2]", [None, "JohnAda"], False),
    ("other text", "a [P_1] b", [None], False),
    ("x John", "x [P_1] y [P_2]", ["John", None], False),
    (None, "x [P_1]", [None], False),
    ("plain", "plain", [], True),
    ("x [A] John", "x [A] [P_1]", ["John"], True),
]


def test_align(spark):
    df = spark.createDataFrame([(i, o, a) for i, (o, a, _, _) in enumerate(ALIGN)], "i int, o string, a string")
    df = df.withColumn("aligned", align(F.col("o"), F.col("a")))
    for r in df.collect():
        assert ([x.value for x in r.aligned["items"]], r.aligned.ok) == ALIGN[r.i][2:], ALIGN[r.i]
    got = values_by_type(df.filter("i = 2").withColumn("k", F.lit(1)), ["k"], ["i"]).orderBy("n").collect()
    assert [(x.type, x.n, x.value) for x in got] == [("P", 1, "John"), ("P", 2, "Ada")]


def test_titles(spark):
    cases = {"short prompt": "short prompt", "  first line \n second": "first line", "  \n\t ": None, "x" * 500: "x" * 119 + "…"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.x for r in df.select("t", truncate_title(F.col("t")).alias("x")).collect()} == cases
