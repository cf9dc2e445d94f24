"""Rewritten bodies: identity byte for byte, signed blocks as they are, everything else through the rules."""

import json

import pytest
from pyspark.sql import functions as F

from hushframe.functions.spans import find_spans
from hushframe.operators.policy import policy
from hushframe.plans.live import rewrite_exchanges
from hushframe.sources.bodies import VERBATIM_OPENINGS, request_places, respliced, response_places, scan, with_tokens

# texts hold "Ada"; odd spacing, escapes, key order and unknown members must come back as they are
MESSAGES = (
    '{ "unknown" : {"nested":["kept Ada",1,null, 1.50e+1]},"model":"m",\n "messages":[{"content":[{"text":"Ada \\u00e9 \\/ x","type":"text","cache":{"type":"e"}}],"role":"user"},'
    '{"role":"assistant","content":[{"type":"thinking","thinking":"Ada","signature":"Ada","text":"Ada"},{"type":"redacted_thinking","data":"Ada"},{"type":"text","text":"Hi Ada"},'
    '{"type":"tool_use","id":"Ada","name":"Ada","input":{"path":"/home/Ada","deep":{"list":["Ada",{"type":"Ada"}]}}}]},'
    '{"role":"user","content":[{"type":"tool_result","tool_use_id":"Ada","content":[{"type":"text","text":"Ada!"},{"type":"thinking","text":"Ada"}]},{"type":"tool_result","content":"Ada?"},{"type":"image","data":"Ada"}]},'
    '{"role":"user","content":"<ide_selection>Ada</ide_selection>"}],"system":[{"type":"text","text":"OPENING Ada"},{"type":"text","text":"for Ada"}]}'
).replace("OPENING", VERBATIM_OPENINGS[0])
CHAT = (
    '{"messages":[{"role":"system","content":"for Ada"},{"role":"user","content":"Ada","name":"Ada"},{"role":"assistant","content":null,"tool_calls":[{"id":"Ada","function":{"name":"Ada","arguments":"{\\"p\\": \\"Ada\\"}"}}]},'
    '{"role":"tool","tool_call_id":"Ada","content":"Ada"}],"user":"Ada","prompt_cache_key":"Ada"}'
)
ITEMS = (
    '{"instructions":"for Ada","input":[{"role":"user","content":"Ada"},{"type":"reasoning","summary":[{"type":"summary_text","text":"Ada"}],"encrypted_content":"Ada"},'
    '{"type":"function_call","name":"Ada","arguments":"Ada"},{"type":"function_call_output","output":"Ada"},{"role":"user","content":[{"type":"input_text","text":"Ada"}]}],"metadata":{"k":"Ada"}}'
)
PLAIN = '{"input":"Ada","tools":[{"description":"Ada"}]}'
BODIES = [("anthropic", MESSAGES), ("openai_chat", CHAT), ("openai_responses", ITEMS), ("openai_responses", PLAIN)]


def test_scan_gives_places_and_paths():
    body = '{"a/b":["x",{"type":"t","role":"r","*":"y\\n\\"","n":-1}],"c":"","type":"top"}'
    assert [(body[a:b], *rest) for a, b, *rest in scan(body)] == [
        ('"x"', "a~1b/*", 0, ["top"], [""], "x"),
        ('"t"', "a~1b/*/type", 1, ["top", "t"], ["", "r"], "t"),
        ('"r"', "a~1b/*/role", 1, ["top", "t"], ["", "r"], "r"),
        ('"y\\n\\""', "a~1b/*/~2", 1, ["top", "t"], ["", "r"], 'y\n"'),
        ('""', "c", -1, ["top"], [""], ""),
        ('"top"', "type", -1, ["top"], [""], "top"),
    ]
    assert scan("") == [] and scan('"\\ud800"')[0][-1] == "?" and scan('"😀é"')[0][:2] == (0, 4)


@pytest.fixture(scope="module")
def bodies(spark):
    df = spark.createDataFrame([(str(i), w, b, b) for i, (w, b) in enumerate(BODIES)], "request_id string, wire_format string, body string, response string")
    return with_tokens(df, F.col("body"), "tokens")


def test_identity_is_byte_equal(bodies):
    places = request_places(F.col("wire_format"), F.col("tokens"))
    same = bodies.select("body", respliced(F.col("body"), places, F.transform(places, lambda p: p["text"])).alias("new"))
    assert all(r.body == r.new for r in same.collect())


def test_every_text_and_nothing_else_is_rewritten(bodies):
    places = request_places(F.col("wire_format"), F.col("tokens"))
    new = respliced(F.col("body"), places, F.transform(places, lambda p: F.concat(F.lit("«"), p["text"], F.lit("»"))))
    messages, chat, items, plain = [r.new for r in bodies.orderBy("request_id").select(new.alias("new")).collect()]
    a = json.loads(messages)
    assert a["system"][0]["text"] == VERBATIM_OPENINGS[0] + "« Ada»" and a["system"][1]["text"] == "«for Ada»"
    said = a["messages"][1]["content"]
    assert said[:2] == json.loads(MESSAGES)["messages"][1]["content"][:2] and said[2]["text"] == "«Hi Ada»"
    assert said[3] == {"type": "tool_use", "id": "Ada", "name": "Ada", "input": {"path": "«/home/Ada»", "deep": {"list": ["«Ada»", {"type": "«Ada»"}]}}}
    results = a["messages"][2]["content"]
    assert [b["text"] for b in results[0]["content"]] == ["«Ada!»", "Ada"] and results[1]["content"] == "«Ada?»" and results[2]["data"] == "Ada"
    assert a["messages"][3]["content"] == "«<ide_selection>Ada</ide_selection>»" and a["unknown"]["nested"][0] == "kept Ada"
    b = json.loads(chat)["messages"]
    assert [m["content"] for m in b] == ["«for Ada»", "«Ada»", None, "«Ada»"] and b[1]["name"] == "Ada"
    assert b[2]["tool_calls"] == [{"id": "Ada", "function": {"name": "Ada", "arguments": '«{"p": "Ada"}»'}}]
    c, old = json.loads(items), json.loads(ITEMS)
    assert c["input"][1] == old["input"][1] and c["metadata"] == old["metadata"]
    assert [c["instructions"], c["input"][0]["content"], c["input"][2]["arguments"], c["input"][3]["output"]] == ["«for Ada»", "«Ada»", "«Ada»", "«Ada»"]
    assert json.loads(plain) == {"input": "«Ada»", "tools": [{"description": "Ada"}]}


def test_authors_and_novelty(bodies):
    rows = bodies.orderBy("request_id").select(request_places(F.col("wire_format"), F.col("tokens")).alias("p")).collect()
    got = [[(p.author, p.novel) for p in r.p] for r in rows]
    old, new = False, True
    assert got[0] == [("machine", old)] * 2 + [("user", old), ("machine", old), ("machine", old), ("machine", old), ("machine", old), ("tool", new), ("tool", new), ("machine", new)]
    assert got[1] == [("machine", old), ("user", old), ("machine", old), ("tool", new)]
    assert got[2] == [("machine", old), ("user", old), ("machine", old), ("tool", new), ("user", new)]
    assert got[3] == [("user", new)]


def test_responses_restore_readable_texts_only(spark):
    rows = [
        ("anthropic", '{"content":[{"type":"thinking","text":"[N_1]"},{"type":"text","text":"[N_1] \\u0041"},{"type":"tool_use","input":{"text":"[N_1]"}}]}'),
        ("openai_chat", '{"choices":[{"message":{"content":"[N_1]","tool_calls":[{"function":{"arguments":"[N_1]"}}]}},{"message":null}]}'),
        ("openai_responses", '{"output":[{"content":[{"type":"output_text","text":"[N_1]"}]},{"content":null}],"output_text":"[N_1]","x":"[N_1]"}'),
        ("openai_responses", '{"output":null}'),
    ]
    df = with_tokens(spark.createDataFrame(rows, "wire_format string, response string"), F.col("response"), "tokens")
    places = response_places(F.col("wire_format"), F.col("tokens"))
    out = df.select(respliced(F.col("response"), places, F.transform(places, lambda p: F.replace(p["text"], F.lit("[N_1]"), F.lit('A"b')))).alias("new")).collect()
    assert [r.new for r in out] == [
        '{"content":[{"type":"thinking","text":"[N_1]"},{"type":"text","text":"A\\"b A"},{"type":"tool_use","input":{"text":"[N_1]"}}]}',
        '{"choices":[{"message":{"content":"A\\"b","tool_calls":[{"function":{"arguments":"[N_1]"}}]}},{"message":null}]}',
        '{"output":[{"content":[{"type":"output_text","text":"A\\"b"}]},{"content":null}],"output_text":"A\\"b","x":"[N_1]"}',
        '{"output":null}',
    ]


def test_exchange_round_trip_and_refusal(spark):
    ask = '{"messages":[{"role":"user","content":"Ada met Bob and Ada"}]}'
    say = '{"choices":[{"message":{"content":"[NAME_2] and [NAME_1] and [NAME_9]"}}]}'
    rows = [("1", "openai_chat", ask, say), ("2", "openai_chat", ask.replace("Bob", "Eve"), say), ("3", "openai_chat", "no json", say), ("4", "openai_chat", ask, "no json"), ("5", "openai_chat", ask, None)]
    df = spark.createDataFrame(rows, "request_id string, wire_format string, body string, response string")

    def names(text):
        label = lambda s: F.when(F.substring(text, s["start"] + 1, F.lit(3)) == "Eve", "SECRET").otherwise("NAME")
        return F.transform(find_spans(text, "Ada|Bob|Eve", ""), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), label(s).alias("label"), s["score"].alias("score")))

    got = {r.request_id: r for r in rewrite_exchanges(df, names, policy({"SECRET": "block"})).collect()}
    assert set(got) == {"1", "2", "4", "5"} and got["2"].refused and got["2"].body is None and got["2"].response is None
    assert json.loads(got["1"].body)["messages"][0]["content"] == "[NAME_1] met [NAME_2] and [NAME_1]"
    assert json.loads(got["1"].response)["choices"][0]["message"]["content"] == "Bob and Ada and [NAME_9]"
    assert got["4"].response == "no json" and got["5"].response is None
