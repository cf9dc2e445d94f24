"""Queries over requests, hook events, transcripts and imports derived from the text tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalog.audit import _scratch
from catalog.inputs import LABEL_SQL, WORD, counts_text, found_sql, iso, iso_sql, pieces_sql, rendered_sql, vault_sql, word_spans
from catalog.registry import query, table
from hushframe.operators.policy import policy
from hushframe.operators.redact import json_escape
from hushframe.plans import imports as im
from hushframe.plans.language import detect_language, fit_profiles
from hushframe.plans.audit import Audit
from hushframe.plans.live import judge_hooks, judge_requests, rewrite_exchanges
from hushframe.session import materialize
from hushframe.sources import requests as rq
from hushframe.sources import transcripts as tr

# --- requests ----------------------------------------------------------------
#
# One request per document, its lines as messages: user, assistant, tool result
# in turn. The three wire formats say the same in their own way, so one SQL
# gives the segments of all.


def _s(text: Column) -> Column:
    return F.concat(F.lit('"'), json_escape(text), F.lit('"'))


def _obj(*pairs: tuple[str, Column | str]) -> Column:
    parts: list[Column] = []
    for i, (k, v) in enumerate(pairs):
        parts += [F.lit(("{" if i == 0 else ",") + f'"{k}":'), F.lit(v) if isinstance(v, str) else v]
    return F.concat(*parts, F.lit("}"))


def _arr(*items: Column) -> Column:
    parts: list[Column] = []
    for i, x in enumerate(items):
        parts += [F.lit("[" if i == 0 else ","), x]
    return F.concat(*parts, F.lit("]"))


def _opening(d: Column, line: Column) -> Column:
    return (
        F.when(d % 5 == 0, F.concat(F.lit("User: "), line))
        .when(d % 5 == 1, F.concat(F.lit("<session>"), line, F.lit("</session>")))
        .when(d % 5 == 2, F.concat(F.lit("<ide_selection>"), line, F.lit("</ide_selection> more")))
        .when(d % 5 == 3, F.concat(F.lit("[SUGGESTION MODE: "), line))
        .otherwise(line)
    )


def _system(d: Column) -> Column:
    kind = F.when(d % 7 == 0, "You are a command-safety judge").when(d % 7 == 1, "Write a Concise Title").otherwise("Help")
    return F.concat(F.lit("Act: "), kind)


def request_log(spark, sf):
    """request_log rows from documents."""
    d = F.col("doc_id")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i == 0, _opening(d, x)).otherwise(x))
    docs = docs.withColumn("lines", lines).withColumn("wire", F.get(F.array(*[F.lit(w) for w in rq.DEFAULT_SOURCE]), (d % 3).cast("int")))

    def messages(user, assistant, tool) -> Column:
        each = F.transform("lines", lambda x, i: F.when(i % 3 == 0, user(x)).when(i % 3 == 1, assistant(x)).otherwise(tool(x)))
        return F.array_join(each, ",")

    call = lambda x: _obj(("type", '"function_call"'), ("arguments", _s(x)))
    text = lambda kind, x: _arr(_obj(("type", f'"{kind}"'), ("text", _s(x))))
    a = messages(
        lambda x: _obj(("role", '"user"'), ("content", _s(x))),
        lambda x: _obj(
            ("role", '"assistant"'),
            ("content", _arr(
                _obj(("type", '"thinking"'), ("thinking", _s(x)), ("text", '"never"')),
                _obj(("type", '"text"'), ("text", _s(x))),
                _obj(("type", '"tool_use"'), ("input", _obj(("n", "1"), ("cmd", _arr(_s(x)))))),
            )),
        ),
        lambda x: _obj(("role", '"user"'), ("content", _arr(_obj(("type", '"tool_result"'), ("content", text("text", x)))))),
    )
    c = messages(
        lambda x: _obj(("role", '"user"'), ("content", text("text", x))),
        lambda x: _obj(("role", '"assistant"'), ("content", _s(x)), ("tool_calls", _arr(_obj(("function", _obj(("arguments", _s(x)))))))),
        lambda x: _obj(("role", '"tool"'), ("content", _s(x))),
    )
    r = messages(
        lambda x: _obj(("role", '"user"'), ("content", text("input_text", x))),
        lambda x: F.concat(_obj(("role", '"assistant"'), ("content", text("output_text", x))), F.lit(","), call(x)),
        lambda x: _obj(("type", '"function_call_output"'), ("output", _s(x))),
    )
    sys, model = _s(_system(d)), F.concat(F.lit('"m'), (d % 4).cast("string"), F.lit('"'))
    wrap = lambda rows: F.concat(F.lit("["), rows, F.lit("]"))
    key = F.when(d % 2 == 0, F.concat(F.lit(',"prompt_cache_key":"k'), d.cast("string"), F.lit('"}'))).otherwise("}")
    body = (
        F.when(d % 3 == 0, _obj(("model", model), ("system", sys), ("messages", wrap(a))))
        .when(d % 3 == 1, _obj(("model", model), ("messages", wrap(F.concat(_obj(("role", '"system"'), ("content", sys)), F.lit(","), c)))))
        .otherwise(F.concat(F.lit('{"model":'), model, F.lit(',"instructions":'), sys, F.lit(',"input":'), wrap(r), key))
    )
    said = '"ok [LA_WORD_1] [DE_WORD_1] [ZZ_9]"'
    n, m = F.length("text").cast("string"), (d % 50).cast("string")
    use = lambda i, o: _obj((i, n), (o, m))
    reply = (
        F.when(d % 3 == 0, _obj(("content", _arr(_obj(("type", '"thinking"'), ("text", '"no"')), _obj(("type", '"text"'), ("text", said)))), ("usage", use("input_tokens", "output_tokens"))))
        .when(d % 3 == 1, _obj(("choices", _arr(_obj(("message", _obj(("content", said)))))), ("usage", use("prompt_tokens", "completion_tokens"))))
        .otherwise(_obj(("output", _arr(_obj(("content", _arr(_obj(("type", '"output_text"'), ("text", said))))))), ("usage", use("input_tokens", "output_tokens"))))
    )
    return docs.select(
        d.cast("string").alias("request_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + d).alias("ts"),
        F.col("wire").alias("wire_format"),
        F.when(d % 10 == 0, "my-tool").alias("source_header"),
        body.alias("body"),
        reply.alias("response"),
    )


LINES_SQL = """ln AS (SELECT doc_id, i - 1 AS i, n, CASE WHEN i > 1 THEN l ELSE CASE doc_id % 5 WHEN 0 THEN 'User: ' || l WHEN 1 THEN '<session>' || l || '</session>'
  WHEN 2 THEN '<ide_selection>' || l || '</ide_selection> more' WHEN 3 THEN '[SUGGESTION MODE: ' || l ELSE l END END AS l
  FROM (SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i, len(ls) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
la AS (SELECT doc_id, coalesce(max(i) FILTER (i % 3 = 1), -1) AS last FROM ln GROUP BY 1),
sys AS (SELECT doc_id, 'Act: ' || CASE doc_id % 7 WHEN 0 THEN 'You are a command-safety judge' WHEN 1 THEN 'Write a Concise Title' ELSE 'Help' END AS l FROM documents),
sg AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS pos, author, novel, l AS text FROM (
  SELECT doc_id, -1 AS o, 'machine' AS author, false AS novel, l FROM sys
  UNION ALL SELECT doc_id, 2 * i, CASE WHEN i % 3 = 0 AND i = 0 AND doc_id % 5 < 4 THEN 'machine' WHEN i % 3 = 0 THEN 'user' WHEN i % 3 = 1 THEN 'machine' ELSE 'tool' END, i % 3 <> 1 AND i > last, l FROM ln JOIN la USING (doc_id)
  UNION ALL SELECT doc_id, 2 * i + 1, 'machine', false, l FROM ln WHERE i % 3 = 1))"""


@query(
    "segment_requests",
    "CNV-01 CNV-02 CNV-03 SRC-06",
    f"WITH {LINES_SQL} SELECT doc_id::VARCHAR AS request_id, pos::BIGINT AS pos, author, novel, md5(text) AS text FROM sg",
)
def segment_requests(spark, sf):
    return rq.segments(request_log(spark, sf)).withColumn("text", F.md5("text"))


@query(
    "count_novel_segments",
    "CNV-02",
    f"WITH {LINES_SQL} SELECT doc_id::VARCHAR AS request_id, count(*) FILTER (novel) AS fresh, count(*) AS every FROM sg GROUP BY 1",
)
def count_novel_segments(spark, sf):
    return rq.segments(request_log(spark, sf)).groupBy("request_id").agg(F.count_if("novel").alias("fresh"), F.count(F.lit(1)).alias("every"))


_KIND = """CASE WHEN doc_id % 7 = 0 THEN 'safety' WHEN doc_id % 7 = 1 THEN 'helper'
 WHEN doc_id % 5 = 1 AND CASE WHEN doc_id % 3 = 0 THEN n = 1 OR (n = 2) ELSE n <= 3 END THEN 'helper' ELSE 'main' END"""
_KEY = "CASE WHEN doc_id % 3 = 2 AND doc_id % 2 = 0 THEN 'k' || doc_id ELSE left(sha256(l), 16) END"


@query(
    "classify_requests",
    "CNV-05 CNV-06 CNV-07 CNV-10",
    f"""WITH {LINES_SQL} SELECT ln.doc_id::VARCHAR AS request_id, {_KIND} AS kind, {_KEY} AS conversation_id, 'm' || (doc_id % 4) AS model,
    CASE WHEN doc_id % 10 = 0 THEN 'my-tool' ELSE ['claude-code', 'openai-chat', 'codex'][doc_id % 3 + 1] END AS source,
    length(d.text)::BIGINT AS input_tokens, doc_id % 50 AS output_tokens FROM ln JOIN documents d USING (doc_id) WHERE i = 0""",
)
def classify_requests(spark, sf):
    rows = rq.with_facts(request_log(spark, sf))
    return rows.select("request_id", "kind", "conversation_id", "model", "source", "usage.input_tokens", "usage.output_tokens")


LIVE_POLICY = {"TH_*": "keep", "DE_WORD": "redact", "ES_*": "block"}
_SEG_SRC = f"(WITH {LINES_SQL} SELECT doc_id * 100000 + pos AS k, text FROM sg)"
_SEG_WORDS = f"SELECT *, {LABEL_SQL} AS label, key // 100000 AS doc_id FROM ({found_sql(_SEG_SRC, 'k', 'text', WORD)})"
_LIVE = f"""WITH {LINES_SQL}, w AS (SELECT s.*, sg.novel AND sg.author IN ('user', 'tool') AS fresh FROM ({_SEG_WORDS}) s JOIN sg ON sg.doc_id = s.doc_id AND sg.pos = s.key % 100000),
fv AS ({vault_sql("SELECT * FROM w WHERE label = 'LA_WORD'", "doc_id", "key, begin_at")}),
cv AS ({vault_sql("SELECT * FROM w WHERE fresh", "doc_id", "key, begin_at")}),
cc AS (SELECT scope, string_agg(label || ':' || n, ',' ORDER BY label) AS counts FROM (SELECT scope, label, count(*) AS n FROM cv GROUP BY ALL) GROUP BY 1),
bl AS (SELECT DISTINCT doc_id FROM w WHERE label = 'ES_WORD'),
tx AS (SELECT doc_id, count(DISTINCT key) AS n FROM w WHERE fresh GROUP BY 1),
base AS (SELECT d.doc_id, bl.doc_id IS NOT NULL AS refused, coalesce(counts, '') AS counts, coalesce(tx.n, 0) AS n FROM documents d LEFT JOIN bl USING (doc_id) LEFT JOIN cc ON cc.scope = d.doc_id LEFT JOIN tx ON tx.doc_id = d.doc_id)"""


@query(
    "judge_requests",
    "VLT-08 POL-03 CNV-09 STR-07",
    f"""{_LIVE} SELECT doc_id::VARCHAR AS request_id, refused, CASE WHEN refused THEN 'block' ELSE 'pseudonymize' END AS policy, counts AS entity_counts,
    (n + CASE WHEN NOT refused AND counts <> '' THEN 1 ELSE 0 END)::BIGINT AS n_texts FROM base""",
)
def judged(spark, sf):
    rows = judge_requests(request_log(spark, sf), word_spans, policy(LIVE_POLICY))
    return rows.select("request_id", "refused", "policy", counts_text(F.col("entity_counts")).alias("entity_counts"), F.size("texts").alias("n_texts"))


@query(
    "forward_requests",
    "POL-02 VLT-08",
    f"""{_LIVE}, r AS ({rendered_sql(pieces_sql(_SEG_SRC, "k", "text", WORD),
      "SELECT w.key, w.value, CASE w.label WHEN 'DE_WORD' THEN '[REDACTED]' WHEN 'LA_WORD' THEN fv.placeholder ELSE w.value END AS name FROM (SELECT DISTINCT key, doc_id, value, label FROM w) w LEFT JOIN fv ON fv.scope = w.doc_id AND fv.value = w.value")})
    SELECT doc_id::VARCHAR AS request_id, md5(string_agg(rendered, '|' ORDER BY key)) AS forwarded FROM r JOIN base ON base.doc_id = r.key // 100000 WHERE NOT refused GROUP BY 1""",
)
def forwarded(spark, sf):
    rows = judge_requests(request_log(spark, sf), word_spans, policy(LIVE_POLICY)).filter("not refused")
    return rows.select("request_id", F.md5(F.array_join("forwarded", "|")).alias("forwarded"))


@query(
    "rehydrate_responses",
    "CNV-08",
    f"""{_LIVE} SELECT doc_id::VARCHAR AS request_id, 'ok ' || coalesce(fv.value, '[LA_WORD_1]') || ' [DE_WORD_1] [ZZ_9]' AS original
    FROM base LEFT JOIN fv ON fv.scope = doc_id AND fv.n = 1 WHERE NOT refused AND counts <> ''""",
)
def rehydrated(spark, sf):
    rows = materialize(judge_requests(request_log(spark, sf), word_spans, policy(LIVE_POLICY)).select("request_id", "texts"))
    return rows.select("request_id", F.explode("texts").alias("t")).filter("t.category = 'assistant'").select("request_id", "t.original")


_RENDERED = f"""r AS ({rendered_sql(pieces_sql(_SEG_SRC, "k", "text", WORD),
      "SELECT w.key, w.value, CASE w.label WHEN 'DE_WORD' THEN '[REDACTED]' WHEN 'LA_WORD' THEN fv.placeholder ELSE w.value END AS name FROM (SELECT DISTINCT key, doc_id, value, label FROM w) w LEFT JOIN fv ON fv.scope = w.doc_id AND fv.value = w.value")})"""
# line i of a document stands in segment 1 + i + (i + 1) // 3, its tool call in the next one
_BODIES = """x AS (SELECT doc_id, i, doc_id % 3 AS f, to_json(l)::VARCHAR AS raw, to_json(a.rendered)::VARCHAR AS t, to_json(b.rendered)::VARCHAR AS u
  FROM ln JOIN r a ON a.key = doc_id * 100000 + 1 + i + (i + 1) // 3 LEFT JOIN r b ON b.key = doc_id * 100000 + 2 + i + (i + 1) // 3),
m AS (SELECT doc_id, string_agg(CASE
  WHEN f = 0 AND i % 3 = 0 THEN '{"role":"user","content":' || t || '}'
  WHEN f = 0 AND i % 3 = 1 THEN '{"role":"assistant","content":[{"type":"thinking","thinking":' || raw || ',"text":"never"},{"type":"text","text":' || t || '},{"type":"tool_use","input":{"n":1,"cmd":[' || u || ']}}]}'
  WHEN f = 0 THEN '{"role":"user","content":[{"type":"tool_result","content":[{"type":"text","text":' || t || '}]}]}'
  WHEN f = 1 AND i % 3 = 0 THEN '{"role":"user","content":[{"type":"text","text":' || t || '}]}'
  WHEN f = 1 AND i % 3 = 1 THEN '{"role":"assistant","content":' || t || ',"tool_calls":[{"function":{"arguments":' || u || '}}]}'
  WHEN f = 1 THEN '{"role":"tool","content":' || t || '}'
  WHEN i % 3 = 0 THEN '{"role":"user","content":[{"type":"input_text","text":' || t || '}]}'
  WHEN i % 3 = 1 THEN '{"role":"assistant","content":[{"type":"output_text","text":' || t || '}]},{"type":"function_call","arguments":' || u || '}'
  ELSE '{"type":"function_call_output","output":' || t || '}' END, ',' ORDER BY i) AS msgs FROM x GROUP BY 1)"""


@query(
    "rewrite_requests",
    "CNV-08 VLT-08 POL-02",
    f"""{_LIVE}, {_RENDERED}, {_BODIES}
    SELECT m.doc_id::VARCHAR AS request_id, refused, CASE WHEN NOT refused THEN md5('{{"model":"m' || (m.doc_id % 4) || CASE m.doc_id % 3
      WHEN 0 THEN '","system":' || to_json(s.l)::VARCHAR || ',"messages":[' || msgs || ']}}'
      WHEN 1 THEN '","messages":[{{"role":"system","content":' || to_json(s.l)::VARCHAR || '}},' || msgs || ']}}'
      ELSE '","instructions":' || to_json(s.l)::VARCHAR || ',"input":[' || msgs || ']' || CASE WHEN m.doc_id % 2 = 0 THEN ',"prompt_cache_key":"k' || m.doc_id || '"}}' ELSE '}}' END END) END AS body
    FROM m JOIN base ON base.doc_id = m.doc_id JOIN sys s ON s.doc_id = m.doc_id""",
)
def rewritten_requests(spark, sf):
    rows = rewrite_exchanges(request_log(spark, sf), word_spans, policy(LIVE_POLICY))
    return rows.select("request_id", "refused", F.md5("body").alias("body"))


@query(
    "rewrite_responses",
    "CNV-08",
    f"""{_LIVE}, y AS (SELECT base.doc_id, length(d.text)::VARCHAR AS n, (base.doc_id % 50)::VARCHAR AS m, to_json('ok ' || coalesce(fv.value, '[LA_WORD_1]') || ' [DE_WORD_1] [ZZ_9]')::VARCHAR AS t
      FROM base JOIN documents d ON d.doc_id = base.doc_id LEFT JOIN fv ON fv.scope = base.doc_id AND fv.n = 1 WHERE NOT refused)
    SELECT doc_id::VARCHAR AS request_id, md5(CASE doc_id % 3
      WHEN 0 THEN '{{"content":[{{"type":"thinking","text":"no"}},{{"type":"text","text":' || t || '}}],"usage":{{"input_tokens":' || n || ',"output_tokens":' || m || '}}}}'
      WHEN 1 THEN '{{"choices":[{{"message":{{"content":' || t || '}}}}],"usage":{{"prompt_tokens":' || n || ',"completion_tokens":' || m || '}}}}'
      ELSE '{{"output":[{{"content":[{{"type":"output_text","text":' || t || '}}]}}],"usage":{{"input_tokens":' || n || ',"output_tokens":' || m || '}}}}' END) AS response FROM y""",
)
def rewritten_responses(spark, sf):
    rows = rewrite_exchanges(request_log(spark, sf), word_spans, policy(LIVE_POLICY)).filter("not refused")
    return rows.select("request_id", F.md5("response").alias("response"))


# --- hook events ------------------------------------------------------------


def hook_log(spark, sf):
    c = table(spark, sf, "conversations")
    turn, t = F.col("turn"), _s(F.col("text"))
    conv = F.concat(F.lit('"c'), F.col("conv_id").cast("string"), F.lit('"'))
    body = (
        F.when(turn % 3 == 0, _obj(("hook_event_name", '"beforeSubmitPrompt"'), ("conversation_id", conv), ("prompt", t)))
        .when(turn % 3 == 1, _obj(("hook_event_name", '"afterAgentResponse"'), ("conversation_id", conv), ("model", '"m"'), ("text", t)))
        .otherwise(_obj(("hook_event_name", '"beforeReadFile"'), ("content", t)))
    )
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("event_id"), body.alias("body"))


_CW = f"SELECT *, {LABEL_SQL} AS label FROM ({found_sql('(SELECT conv_id * 1000 + turn AS k, text FROM conversations)', 'k', 'text', WORD)})"


@query(
    "judge_hook_events",
    "CNV-23 POL-04",
    f"""WITH c AS (SELECT key, string_agg(label || ':' || n, ',' ORDER BY label) AS counts FROM (SELECT key, label, count(DISTINCT value) AS n FROM ({_CW}) GROUP BY 1, 2) GROUP BY 1)
    SELECT conv_id || '-' || turn AS event_id, 'cursor:' || ['beforeSubmitPrompt', 'afterAgentResponse', 'beforeReadFile'][turn % 3 + 1] AS wire_format,
    CASE WHEN turn % 3 = 1 THEN 'm' ELSE 'unknown' END AS model, CASE WHEN turn % 3 <> 2 THEN 'c' || conv_id END AS conversation_id, coalesce(counts, '') AS entity_counts,
    CASE WHEN turn % 3 <> 1 AND contains(coalesce(counts, ''), 'ES_WORD') THEN 'deny' ELSE 'allow' END AS verdict,
    CASE WHEN turn % 3 <> 1 AND counts IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS n_texts
    FROM conversations LEFT JOIN c ON key = conv_id * 1000 + turn WHERE length(text) > 0""",
)
def judged_hooks(spark, sf):
    rows = judge_hooks(hook_log(spark, sf), word_spans, policy(LIVE_POLICY))
    return rows.select(
        "event_id", "wire_format", "model", "conversation_id", counts_text(F.col("entity_counts")).alias("entity_counts"), "verdict", F.size("texts").alias("n_texts")
    )


# Turns 0 and 1 are history; so is a row with findings between turns 4 and 5 of some conversations, and one after all turns.
_HOOK_ROWS = f"""found AS (SELECT key, count(*) AS n FROM ({_CW}) GROUP BY 1),
ev AS (SELECT conv_id, turn, turn * 10 AS tm, coalesce(n, 0) > 0 AS hit, turn % 3 AS k FROM conversations LEFT JOIN found ON key = conv_id * 1000 + turn WHERE length(text) > 0),
hist AS (SELECT conv_id, tm, CASE WHEN k = 1 AND conv_id % 3 = 0 THEN 'clear' WHEN hit THEN 'set' END AS step FROM ev WHERE turn < 2
  UNION ALL SELECT DISTINCT conv_id, 45, 'set' FROM ev WHERE conv_id % 4 = 0 UNION ALL SELECT DISTINCT conv_id, 1000, 'set' FROM ev),
steps AS (SELECT conv_id, tm, step, NULL::BIGINT AS turn FROM hist
  UNION ALL SELECT conv_id, tm, CASE WHEN k = 1 THEN CASE WHEN hit THEN 'flip' ELSE 'clear' END WHEN hit THEN 'set' END, turn FROM ev WHERE turn >= 2 AND k < 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY tm) AS r FROM steps),
walk AS (SELECT conv_id, 0::BIGINT AS r, NULL::BIGINT AS turn, false AS before, false AS after FROM (SELECT DISTINCT conv_id FROM steps)
  UNION ALL SELECT s.conv_id, s.r, s.turn, w.after, CASE s.step WHEN 'set' THEN true WHEN 'clear' THEN false WHEN 'flip' THEN NOT w.after ELSE w.after END
  FROM walk w JOIN ranked s ON s.conv_id = w.conv_id AND s.r = w.r + 1)"""


@query(
    "judge_hooks_with_history",
    "CNV-23 AUD-14",
    f"""WITH RECURSIVE {_HOOK_ROWS} SELECT e.conv_id || '-' || e.turn AS event_id, CASE WHEN k = 1 THEN w.before ELSE hit END::BIGINT AS n_texts
    FROM ev e LEFT JOIN walk w ON w.conv_id = e.conv_id AND w.turn = e.turn WHERE e.turn >= 2""",
)
def judged_hooks_with_history(spark, sf):
    """A reply is kept by what its conversation had up to it: stored rows before it and between, events of the same batch, none of later."""
    c = table(spark, sf, "conversations")
    at = lambda t: F.timestamp_seconds(F.lit(1_700_000_000) + t)
    events = hook_log(spark, sf).join(c.select(F.concat_ws("-", "conv_id", "turn").alias("event_id"), "turn"), "event_id")
    old = c.filter("turn < 2 AND length(text) > 0")
    n = F.size(word_spans(F.col("text"))).cast("bigint")
    cid = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    rows = old.select((F.col("conv_id") * 10 + F.col("turn")).alias("id"), cid.alias("conversation_id"), at(F.col("turn") * 10).alias("created_at"), n.alias("entity_total"))
    ids = c.filter("length(text) > 0").select("conv_id").distinct()
    late = lambda df, k, t: df.select((F.col("conv_id") * 10 + k).alias("id"), cid.alias("conversation_id"), at(F.lit(t)).alias("created_at"), F.lit(1).cast("bigint").alias("entity_total"))
    rows = rows.unionByName(late(ids.filter("conv_id % 4 = 0"), 8, 45)).unionByName(late(ids, 9, 1000)).withColumn("source", F.lit("cursor"))
    said = old.filter("turn = 1 AND conv_id % 3 = 0").select((F.col("conv_id") * 10 + 1).alias("interaction_id"), F.lit("assistant").alias("category"))
    events = events.filter("turn >= 2").withColumn("ts", at(F.col("turn") * 10)).drop("turn")
    judged = judge_hooks(events, word_spans, policy(LIVE_POLICY), history=Audit(rows, rows.limit(0), said))
    return judged.select("event_id", F.size("texts").alias("n_texts"))


# --- language ---------------------------------------------------------------

_SAMPLE = "CASE WHEN length(trim(text, chr(10) || chr(9) || ' ')) >= 10 THEN lower(trim(text, chr(10) || chr(9) || ' ')) END"


@query(
    "detect_languages",
    "CNV-11",
    f"""WITH s AS (SELECT doc_id, lang, {_SAMPLE} AS t FROM documents), g AS (SELECT doc_id, lang, substr(t, k, 3) AS gram FROM s, LATERAL (SELECT unnest(range(1, length(t) - 1)) AS k)),
    c AS (SELECT lang, gram, count(*) AS n FROM g GROUP BY 1, 2), p AS (SELECT lang, gram, (n * 1000000000) // sum(n) OVER (PARTITION BY lang) AS weight FROM c),
    x AS (SELECT g.doc_id, p.lang, sum(weight) AS score FROM g JOIN p USING (gram) GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS r FROM x)
    SELECT d.doc_id, b.lang AS language FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND r = 1""",
)
def languages(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return detect_language(docs, fit_profiles(docs), ["doc_id"])


# --- transcripts ------------------------------------------------------------
#
# A session per conversation, a line (or a few) per turn.


def _stamp(c) -> Column:
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 1000 + F.col("turn"))
    return F.concat(F.lit('"'), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"'))


def lines_a(spark, sf):
    c = table(spark, sf, "conversations")
    turn, t = F.col("turn"), _s(F.col("text"))
    said = lambda content, *more: _obj(("type", '"user"'), ("timestamp", _stamp(c)), *more, ("message", _obj(("role", '"user"'), ("content", content))))
    model = F.when(turn % 7 == 6, '"<synthetic>"').otherwise(F.concat(F.lit('"model-'), (turn % 2).cast("string"), F.lit('"')))
    answer = _obj(
        ("type", '"assistant"'),
        ("timestamp", _stamp(c)),
        ("message", _obj(
            ("id", F.concat(F.lit('"m'), F.floor(turn / 2).cast("string"), F.lit('"'))),
            ("model", model),
            ("usage", _obj(("input_tokens", F.length("text").cast("string")), ("output_tokens", turn.cast("string")))),
            ("content", _arr(_obj(("type", '"thinking"'), ("thinking", '"x"')), _obj(("type", '"text"'), ("text", t)))),
        )),
    )
    value = (
        F.when(F.col("role") == "system", said(t, ("isMeta", "true")))
        .when(F.col("role") == "assistant", answer)
        .when(turn % 5 == 4, said(_arr(_obj(("type", '"tool_result"'), ("content", t)))))
        .otherwise(said(t))
    )
    return c.select(
        F.concat(F.lit("/r/p"), (F.col("conv_id") % 5).cast("string"), F.lit("/s"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id")).alias("modified_at"),
        F.lit(0).cast("bigint").alias("block"),
        F.col("turn").cast("bigint").alias("line"),
        value.alias("value"),
    )


def lines_b(spark, sf):
    c = table(spark, sf, "conversations")
    turn, t, conv = F.col("turn"), _s(F.col("text")), F.col("conv_id").cast("string")
    line = lambda kind, payload: _obj(("timestamp", _stamp(c)), ("type", f'"{kind}"'), ("payload", payload))
    meta = line("session_meta", _obj(("id", F.concat(F.lit('"u-'), conv, F.lit('"'))), ("cwd", F.concat(F.lit('"/w/'), conv, F.lit('"')))))
    context = line("turn_context", _obj(("model", F.concat(F.lit('"g'), F.floor(turn / 3).cast("string"), F.lit('"')))))
    user = line("event_msg", _obj(("type", '"user_message"'), ("message", t)))
    answer = line("response_item", _obj(("type", '"message"'), ("role", '"assistant"'), ("content", _arr(_obj(("type", '"output_text"'), ("text", t))))))
    tool = line("response_item", _obj(("type", '"function_call_output"'), ("output", t)))
    usage = line("event_msg", _obj(("type", '"token_count"'), ("info", _obj(("last_token_usage", _obj(("input_tokens", F.length("text").cast("string")), ("output_tokens", turn.cast("string"))))))))
    rows = F.when(F.col("role") == "user", F.array(context, F.when(turn % 5 == 4, tool).otherwise(user))).when(
        F.col("role") == "assistant", F.array(answer, usage)
    ).otherwise(F.array(F.lit("not json")))
    rows = F.when((turn == 0) & (F.col("conv_id") % 9 != 0), F.concat(F.array(meta), rows)).otherwise(rows)
    return c.select(
        F.concat(F.lit("/r/2026/rollout-2026-01-01T00-00-00-u-"), conv, F.lit(".jsonl")).alias("path"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id")).alias("modified_at"),
        F.lit(0).cast("bigint").alias("block"),
        turn.alias("__turn"),
        F.posexplode(rows).alias("j", "value"),
    ).select("path", "modified_at", "block", (F.col("__turn") * 10 + F.col("j")).cast("bigint").alias("line"), "value")


_A = f"""ev AS (SELECT conv_id, turn, role, text, role = 'user' AND turn % 5 <> 4 AS opens, CASE WHEN role = 'assistant' THEN 'assistant' WHEN turn % 5 = 4 THEN 'tool' ELSE 'user' END AS category,
  role = 'assistant' AND turn % 7 = 6 AS synthetic FROM conversations WHERE role <> 'system'),
nu AS (SELECT *, sum(opens::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS turn_no FROM ev),
us AS (SELECT conv_id, arg_min(turn_no, turn) AS turn_no, arg_min(length(text), turn) AS ti, arg_min(turn, turn) AS t_out FROM nu WHERE role = 'assistant' AND NOT synthetic GROUP BY conv_id, turn // 2),
ut AS (SELECT conv_id, turn_no, max(ti)::BIGINT AS input_tokens, sum(t_out)::BIGINT AS output_tokens FROM us GROUP BY 1, 2),
tn AS (SELECT conv_id, turn_no, min({iso_sql("to_timestamp(1700000000 + conv_id * 1000 + turn)")}) AS ts, arg_max('model-' || (turn % 2), turn) FILTER (role = 'assistant' AND NOT synthetic) AS model,
  count(*) FILTER (NOT synthetic) AS n FROM nu GROUP BY 1, 2 HAVING count(*) FILTER (NOT synthetic) > 0)"""


@query(
    "parse_transcript_turns",
    "CNV-12 CNV-13",
    f"WITH {_A} SELECT 's' || conv_id AS session_id, turn_no, ts, model, input_tokens, output_tokens FROM tn LEFT JOIN ut USING (conv_id, turn_no)",
)
def parse_transcript_turns(spark, sf):
    turns, _ = tr.turns(lines_a(spark, sf), "a")
    return turns.select("session_id", "turn_no", iso("ts").alias("ts"), "model", "input_tokens", "output_tokens")


@query(
    "parse_transcript_segments",
    "CNV-12",
    f"WITH {_A} SELECT 's' || conv_id AS session_id, turn_no, turn AS line, category, md5(text) AS text FROM nu WHERE NOT synthetic",
)
def parse_transcript_segments(spark, sf):
    _, segs = tr.turns(lines_a(spark, sf), "a")
    return segs.select("session_id", "turn_no", "line", "category", F.md5("text").alias("text"))


_B = f"""ev AS (SELECT conv_id, turn, role, text, role = 'user' AND turn % 5 <> 4 AS opens, CASE WHEN role = 'assistant' THEN 'assistant' WHEN turn % 5 = 4 THEN 'tool' ELSE 'user' END AS category FROM conversations WHERE role <> 'system'),
nu AS (SELECT *, sum(opens::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS turn_no FROM ev),
ok AS (SELECT DISTINCT conv_id FROM conversations WHERE turn = 0 AND conv_id % 9 <> 0),
md AS (SELECT conv_id, arg_max('g' || (turn // 3), turn) AS model FROM ev WHERE role = 'user' GROUP BY 1),
tn AS (SELECT conv_id, turn_no, min({iso_sql("to_timestamp(1700000000 + conv_id * 1000 + turn)")}) AS ts, max(length(text)) FILTER (role = 'assistant')::BIGINT AS input_tokens, sum(turn) FILTER (role = 'assistant')::BIGINT AS output_tokens FROM nu GROUP BY 1, 2)"""


@query(
    "parse_rollout_turns",
    "CNV-14",
    f"WITH {_B} SELECT 'u-' || conv_id AS session_id, turn_no, ts, model, input_tokens, output_tokens FROM tn JOIN ok USING (conv_id) LEFT JOIN md USING (conv_id)",
)
def parse_rollout_turns(spark, sf):
    turns, _ = tr.turns(lines_b(spark, sf), "b")
    return turns.select("session_id", "turn_no", iso("ts").alias("ts"), "model", "input_tokens", "output_tokens")


# Imports of the sessions above; some ids are known already, one is deselected.


def _sessions(lines):
    files = lines.select("path", "modified_at").distinct()
    return files.select(
        F.lit("claude-code").alias("source"), "path", "modified_at", tr.session_hint("a", F.col("path")).alias("session_hint"), tr.parent_folder(F.col("path")).alias("project")
    )


def _known(spark, sf):
    return table(spark, sf, "conversations").filter("conv_id % 7 = 3").select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("conversation_id"))


EXCLUDED = ["s1", "s2"]
_NEW = "conv_id % 7 <> 3 AND conv_id NOT IN (1, 2)"
_IMP_SRC = f"(WITH {_A} SELECT conv_id * 1000 + turn AS k, text FROM nu WHERE NOT synthetic AND {_NEW})"
_IMP = f"""WITH {_A}, w AS (SELECT s.*, s.key // 1000 AS conv, nu.turn_no FROM (SELECT *, {LABEL_SQL} AS label FROM ({found_sql(_IMP_SRC, 'k', 'text', WORD)})) s JOIN nu ON nu.conv_id = s.key // 1000 AND nu.turn = s.key % 1000),
v AS ({vault_sql("SELECT * FROM w", "conv", "key, begin_at")}),
c AS (SELECT conv, turn_no, string_agg(label || ':' || n, ',' ORDER BY label) AS counts, sum(n)::BIGINT AS total FROM (SELECT conv, turn_no, label, count(DISTINCT value) AS n FROM w GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


def _import(spark, sf, **kwargs):
    lines = lines_a(spark, sf)
    turns, segs = tr.turns(lines, "a")
    return im.import_sessions(_sessions(lines), turns, segs, _known(spark, sf), word_spans, exclude=EXCLUDED, **kwargs)


@query(
    "import_interactions",
    "CNV-16 VLT-07",
    f"""{_IMP} SELECT 's' || conv_id AS conversation_id, ts AS created_at, coalesce(model, 'unknown') AS model, 'imported' AS policy, input_tokens, output_tokens, coalesce(counts, '') AS entity_counts, coalesce(total, 0)::BIGINT AS entity_total
    FROM tn LEFT JOIN ut USING (conv_id, turn_no) LEFT JOIN c ON c.conv = conv_id AND c.turn_no = tn.turn_no WHERE {_NEW}""",
)
def import_interactions(spark, sf):
    rows = _import(spark, sf).audit.interaction
    return rows.select(
        "conversation_id", iso("created_at").alias("created_at"), "model", "policy", "input_tokens", "output_tokens", counts_text(F.col("entity_counts")).alias("entity_counts"), "entity_total"
    )


@query(
    "import_texts",
    "CNV-15 CNV-16 VLT-03",
    f"""{_IMP}, r AS ({rendered_sql(pieces_sql(_IMP_SRC, "k", "text", WORD), f"SELECT k AS key, value, placeholder AS name FROM v JOIN {_IMP_SRC} x ON x.k // 1000 = v.scope")})
    SELECT (row_number() OVER (PARTITION BY conv_id, turn_no ORDER BY turn) - 1)::BIGINT AS seq, category, md5(text) AS original, md5(rendered) AS anonymized
    FROM r JOIN nu ON nu.conv_id = r.key // 1000 AND nu.turn = r.key % 1000 WHERE rendered <> text""",
)
def import_texts(spark, sf):
    return _import(spark, sf).audit.text.select("seq", "category", F.md5("original").alias("original"), F.md5("anonymized").alias("anonymized"))


@query(
    "import_counters",
    "CNV-18",
    f"""{_IMP}, s AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (1, 2)), i AS (SELECT DISTINCT conv_id FROM tn WHERE {_NEW}),
    f AS (SELECT conv_id FROM s WHERE {_NEW} AND conv_id NOT IN (SELECT conv_id FROM tn))
    SELECT (SELECT count(*) FROM s) AS found, (SELECT count(*) FROM s) - (SELECT count(*) FROM i) - (SELECT count(*) FROM f) AS skipped, (SELECT count(*) FROM f) AS failed, (SELECT count(*) FROM i) AS imported,
    (SELECT count(*) FROM tn WHERE {_NEW}) AS turns, (SELECT coalesce(sum(total), 0)::BIGINT FROM c) AS entities""",
)
def import_counters(spark, sf):
    return _import(spark, sf).counters


@query(
    "import_dry_run",
    "CNV-18",
    f"""WITH {_A}, s AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (1, 2)), i AS (SELECT DISTINCT conv_id FROM tn WHERE {_NEW}),
    f AS (SELECT conv_id FROM s WHERE {_NEW} AND conv_id NOT IN (SELECT conv_id FROM tn))
    SELECT (SELECT count(*) FROM s) AS found, (SELECT count(*) FROM s) - (SELECT count(*) FROM i) - (SELECT count(*) FROM f) AS skipped, (SELECT count(*) FROM f) AS failed, (SELECT count(*) FROM i) AS imported,
    (SELECT count(*) FROM tn WHERE {_NEW}) AS turns, 0::BIGINT AS entities""",
)
def import_dry_run(spark, sf):
    return _import(spark, sf, dry_run=True).counters


@query(
    "preview_import_sources",
    "CNV-19",
    "SELECT 'claude-code' AS source, count(DISTINCT conv_id) AS found, count(DISTINCT conv_id) FILTER (conv_id % 7 <> 3) AS new, count(DISTINCT conv_id) FILTER (conv_id % 7 = 3) AS imported FROM conversations",
)
def preview_import_sources(spark, sf):
    return im.preview_sources(_sessions(lines_a(spark, sf)), _known(spark, sf))


_TITLE = """WITH f AS (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' AND turn % 5 <> 4 GROUP BY 1),
l AS (SELECT conv_id, trim(string_split(trim(t, chr(10) || chr(9) || ' '), chr(10))[1]) AS t FROM f)"""


@query(
    "preview_import_sessions",
    "CNV-20",
    f"""{_TITLE} SELECT 'claude-code' AS source, 's' || c.conv_id AS id, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(left(t, 119)) || '…' END AS title, 'p' || (c.conv_id % 5) AS project,
    {iso_sql("to_timestamp(1700000000 + c.conv_id)")} AS modified_at, c.conv_id % 7 = 3 AS imported FROM (SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id DESC LIMIT 60) c LEFT JOIN l ON l.conv_id = c.conv_id""",
)
def preview_import_sessions(spark, sf):
    lines = lines_a(spark, sf)
    rows = im.preview_sessions(_sessions(lines), _known(spark, sf), tr.titles(lines, "a"), 60)
    return rows.withColumn("modified_at", iso("modified_at"))


@query(
    "preview_rollout_titles",
    "CNV-20",
    f"""{_TITLE} SELECT l.conv_id::VARCHAR AS session, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(left(t, 119)) || '…' END AS title, CASE WHEN o.conv_id IS NOT NULL THEN '/w/' || l.conv_id END AS cwd
    FROM l LEFT JOIN (SELECT conv_id FROM conversations WHERE turn = 0 AND conv_id % 9 <> 0) o USING (conv_id)""",
)
def preview_rollout_titles(spark, sf):
    rows = tr.titles(lines_b(spark, sf), "b").filter("title is not null")
    return rows.select(F.regexp_extract("path", r"u-(\d+)\.jsonl$", 1).alias("session"), "title", "cwd")


# --- files ------------------------------------------------------------------


@query(
    "read_transcript_files",
    "SRC-01 SRC-05",
    "SELECT 'project=p' || (conv_id % 5) AS project, count(*) AS lines, count(*) FILTER (role <> 'system') AS spoken FROM conversations WHERE conv_id % 5 IN (1, 3) GROUP BY 1",
)
def read_transcript_files(spark, sf):
    """Session lines written as files under project folders and read back with the project filter."""
    root = _scratch(spark, "sessions")
    lines = lines_a(spark, sf)
    bad = lines.select("path", F.lit("no json").alias("value"))
    rows = lines.select("path", "value").unionByName(bad)
    rows.select(tr.parent_folder(F.col("path")).alias("project"), "value").write.partitionBy("project").text(root)
    read = [tr.objects(tr.read_lines(spark, root, "a", project=p, files="*.txt")) for p in ("p1", "p3")]
    both = read[0].unionByName(read[1])
    meta = F.coalesce(F.try_variant_get("entry", "$.isMeta", "boolean"), F.lit(False))
    return both.groupBy(tr.parent_folder(F.col("path")).alias("project")).agg(F.count(F.lit(1)).alias("lines"), F.count_if(~meta).alias("spoken"))


@query(
    "read_rollout_files",
    "SRC-02 SRC-04",
    "SELECT count(*) FILTER (role = 'user' AND turn % 5 <> 4) AS prompts, count(*) FILTER (turn = 0 AND conv_id % 9 <> 0) AS sessions, 0::BIGINT AS too_new FROM conversations",
)
def read_rollout_files(spark, sf):
    root = _scratch(spark, "rollouts")
    lines_b(spark, sf).select(F.lit("07").alias("month"), F.lit("02").alias("day"), "value").write.partitionBy("month", "day").text(root)
    since = datetime(2020, 1, 1, tzinfo=timezone.utc)
    events = tr.events_b(tr.read_lines(spark, root, "b", since=since, files="part-*.txt"))
    late = tr.list_sessions(spark, root, "b", since=datetime(2200, 1, 1, tzinfo=timezone.utc), files="part-*.txt")
    late = late.agg(F.count(F.lit(1)).alias("too_new"))
    seen = events.agg(F.count_if("opens").alias("prompts"), F.count("meta_id").alias("sessions"))
    both = seen.unionByName(late, allowMissingColumns=True)
    return both.agg(*[F.sum(c).alias(c) for c in ("prompts", "sessions", "too_new")])


@query(
    "session_ids_from_paths",
    "SRC-03",
    "SELECT doc_id, 'S' || doc_id AS a, left(md5(doc_id::VARCHAR), 8) || '-1-2-3-' || doc_id AS b, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'a-b-c-d-e' END AS c FROM documents",
)
def session_ids_from_paths(spark, sf):
    d = F.col("doc_id").cast("string")
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit("file:/x/proj/S"), d, F.lit(".jsonl")).alias("pa"),
        F.concat(F.lit("/x/2026/rollout-2026-07-02T16-43-38-"), F.left(F.md5(d), F.lit(8)), F.lit("-1-2-3-"), d, F.lit(".jsonl")).alias("pb"),
        F.when(F.col("doc_id") % 2 == 0, "/x/short-name.jsonl").otherwise("/x/a-b-c-d-e.jsonl").alias("pc"),
    )
    return docs.select(
        "doc_id", tr.session_hint("a", F.col("pa")).alias("a"), tr.session_hint("b", F.col("pb")).alias("b"), tr.session_hint("b", F.col("pc")).alias("c")
    )


@query(
    "pick_files_by_time",
    "SRC-04",
    "SELECT event_id FROM events WHERE ts >= (SELECT ts FROM events WHERE event_id = 100) AND ts < TIMESTAMP '2024-01-10 00:00:00'",
)
def pick_files_by_time(spark, sf):
    events = table(spark, sf, "events")
    files = events.select("event_id", F.lit("/r/p/x.jsonl").alias("path"), F.col("ts").cast("timestamp").alias("modified_at"))
    since = events.filter("event_id = 100").select(F.col("ts").cast("timestamp")).first()[0].replace(tzinfo=timezone.utc)
    return tr.pick_files(files, "a", since, tr.parse_until("2024-01-09"), None).select("event_id")


@query(
    "segment_nested_results",
    "CNV-01",
    """SELECT doc_id AS request_id, 0::BIGINT AS pos, 'tool' AS author, md5('top') AS text FROM documents
    UNION ALL SELECT doc_id, 1, 'tool', md5(text) FROM documents UNION ALL SELECT doc_id, 2, 'tool', md5('deep') FROM documents""",
)
def segment_nested_results(spark, sf):
    """Tool results inside tool results, three deep."""
    text = lambda t: _obj(("type", '"text"'), ("text", t))
    result = lambda content: _obj(("type", '"tool_result"'), ("content", content))
    inner = result(_arr(text(_s(F.col("text"))), result('"deep"')))
    content = _arr(result(_arr(text('"top"'), inner)))
    body = _obj(("messages", _arr(_obj(("role", '"user"'), ("content", content)))))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("request_id"), F.lit("anthropic").alias("wire_format"), body.alias("body"))
    return rq.segments(rows).select("request_id", F.col("pos").cast("bigint").alias("pos"), "author", F.md5("text").alias("text"))
