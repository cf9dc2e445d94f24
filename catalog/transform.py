"""Tagger, redaction, vault, policy and alignment queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog.inputs import WORD, counts_text, pieces_sql, rendered_sql, vault_sql, word_spans, words_sql
from catalog.registry import query, table
from hushframe.functions.align import align, values_by_type
from hushframe.functions.spans import choose_spans
from hushframe.operators import tagger as t
from hushframe.operators.detectors import explode_spans, with_spans
from hushframe.operators.policy import action_of, apply_policy, block_tally, policy, resolve_actions, verdicts
from hushframe.operators.redact import redact_frame, redact_json, redact_text, redactor
from hushframe.operators.telemetry import scrub_payloads, telemetry_interactions
from hushframe.operators.vault import build_vault, counts_map, export_vault, extend_vault, pseudonymize, restore, type_counts
from hushframe.session import materialize


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", "text")


def _marked(spark, sf):
    return with_spans(_docs(spark, sf), word_spans)


# --- tagger -----------------------------------------------------------------
#
# Tokens are the white-space words of documents; labels and scores come from
# arithmetic on (document, token, window).

_TOK = r"[^\s\p{Z}]+"
TOKENS_SQL = f"SELECT doc_id, tok, (i - 1)::BIGINT AS token FROM (SELECT doc_id, unnest(l) AS tok, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_TOK}') AS l FROM documents))"


# Bytes of text a task gets before the text is cut into tokens; its rows of tokens take some forty times as much.
DEALT_BYTES = 4 << 20


def _dealt(docs, to_deal=None):
    """``to_deal`` (or ``docs``) dealt by doc_id before it becomes rows of tokens.

    The tokens of a document then lie in one task, so grouping them by (doc_id, token) moves none of them: the texts are
    shuffled, once, and in parts small enough to be sorted in memory.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, size // DEALT_BYTES + 1)
    return (docs if to_deal is None else to_deal).repartition(parts, "doc_id")


def _tokens(spark, sf):
    return _dealt(_docs(spark, sf).select("doc_id", "text")).select("doc_id", F.posexplode(t.tokens_of(F.col("text"))).alias("token", "tok"))


@query(
    "plan_token_windows",
    "NER-01",
    """SELECT doc_id, k * 382 AS window_start FROM documents, LATERAL (SELECT unnest(range(0, greatest(ceil((n_chars - 510) / 382.0), 0)::BIGINT + 1)) AS k) WHERE n_chars > 0""",
)
def plan_token_windows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("n_tokens"))
    return t.plan_windows(docs, 512, 128).select("doc_id", "window_start")


_LOGIT = "[(id * 2) % 5, (id * 3) % 5, (id * 4) % 5]"


@query(
    "infer_token_windows",
    "NER-02",
    f"""WITH tk AS ({TOKENS_SQL}), n AS (SELECT doc_id, count(*) AS n FROM tk GROUP BY 1),
    w AS (SELECT doc_id, n, unnest(range(0, greatest(ceil((n - 62) / 46.0), 0)::BIGINT + 1)) * 46 AS ws FROM n),
    x AS (SELECT tk.doc_id, ws, token, length(tok) + 3 AS id FROM tk JOIN w ON tk.doc_id = w.doc_id AND token >= ws AND token < ws + 62),
    y AS (SELECT doc_id, ws, list_position({_LOGIT}, list_max({_LOGIT})) AS best, exp(list_max({_LOGIT})) / list_sum([exp(v) for v in {_LOGIT}]) AS score FROM x)
    SELECT doc_id, ['O', 'B-NAME', 'I-NAME'][best] AS label, count(*) AS n, sum(round(score * 100000)::BIGINT)::BIGINT AS score FROM y GROUP BY 1, 2""",
)
def infer_token_windows(spark, sf):
    def length_model():
        """A stand-in model: logits are a fixed function of the token id."""
        return lambda ids, mask: np.stack([(ids * (k + 2)) % 5 for k in range(3)], axis=-1).astype(np.float64)

    ids = _docs(spark, sf).select("doc_id", F.transform(t.tokens_of(F.col("text")), lambda w: F.length(w) + 3).alias("ids"))
    preds = t.infer_windows(t.window_tokens(ids, 64, 16), length_model, ["O", "B-NAME", "I-NAME"], ["doc_id"])
    return preds.groupBy("doc_id", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("score") * 100000).cast("bigint")).alias("score")
    )


_PRED = "((doc_id * 7 + token * 13 + ws * 5) % 97)"


@query(
    "merge_window_predictions",
    "NER-03",
    f"""WITH tk AS ({TOKENS_SQL}), n AS (SELECT doc_id, count(*) AS n FROM tk GROUP BY 1),
    w AS (SELECT doc_id, unnest(range(0, greatest(ceil((n - 38) / 18.0), 0)::BIGINT + 1)) * 18 AS ws FROM n),
    x AS (SELECT tk.doc_id, ws, token, {_PRED.replace('doc_id', 'tk.doc_id')} AS score FROM tk JOIN w ON tk.doc_id = w.doc_id AND token >= ws AND token < ws + 38),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, token ORDER BY score DESC, ws) AS r FROM x)
    SELECT doc_id, token, 'L' || (score % 3) AS label, score FROM b WHERE r = 1""",
)
def merge_window_predictions(spark, sf):
    ids = _dealt(_docs(spark, sf).select("doc_id", "text")).select("doc_id", t.tokens_of(F.col("text")).alias("ids"))
    windows = t.window_tokens(ids, 40, 20)
    x = windows.select("doc_id", "window_start", F.posexplode("ids").alias("i", "tok")).withColumn("token", F.col("i") + F.col("window_start"))
    score = (F.col("doc_id") * 7 + F.col("token") * 13 + F.col("window_start") * 5) % 97
    preds = x.select("doc_id", "window_start", "token", F.concat(F.lit("L"), (score % 3).cast("string")).alias("label"), score.alias("score"))
    return t.best_token(preds, ["doc_id"])


# Each word is cut into pieces of three characters; some pieces carry a label.
_SUB_SQL = f"""tk AS ({TOKENS_SQL}),
sub AS (SELECT doc_id, token AS word_id, j, token * 100 + 3 * j AS s, token * 100 + least(3 * j + 3, length(tok)) AS e,
  (doc_id * 3 + token * 5 + j * 7) % 11 AS h, ((doc_id + token * 7 + j * 3) % 89) AS score
  FROM tk, LATERAL (SELECT unnest(range(0, (length(tok) + 2) // 3)) AS j)),
lab AS (SELECT *, CASE WHEN h < 5 THEN 'O' WHEN h < 8 THEN 'B-NAME' ELSE 'I-CITY' END AS label FROM sub)"""


def _subtokens(spark, sf):
    x = _tokens(spark, sf).withColumn("j", F.explode(F.sequence(F.lit(0), F.floor((F.length("tok") + 2) / 3).cast("int") - 1)))
    h = (F.col("doc_id") * 3 + F.col("token") * 5 + F.col("j") * 7) % 11
    return x.select(
        "doc_id",
        F.col("token").alias("word_id"),
        (F.col("token") * 1000 + F.col("j")).alias("token"),
        (F.col("token") * 100 + 3 * F.col("j")).alias("start"),
        (F.col("token") * 100 + F.least(3 * F.col("j") + 3, F.length("tok"))).alias("end"),
        F.when(h < 5, "O").when(h < 8, "B-NAME").otherwise("I-CITY").alias("label"),
        ((F.col("doc_id") + F.col("token") * 7 + F.col("j") * 3) % 89).cast("double").alias("score"),
    )


_WORDS_SQL = f"""{_SUB_SQL}, best AS (SELECT doc_id, word_id, arg_max(label[3:], (score, -j)) FILTER (label <> 'O') AS label,
  coalesce(max(score) FILTER (label <> 'O'), 0) AS score, min(s) AS s, max(e) AS e FROM lab GROUP BY 1, 2)"""


@query(
    "join_subtokens",
    "NER-04",
    f"WITH {_WORDS_SQL} SELECT doc_id, word_id, s AS begin_at, e AS end_at, label, score::DOUBLE AS score FROM best",
)
def join_subtokens(spark, sf):
    words = t.words(_subtokens(spark, sf), ["doc_id"])
    return words.select("doc_id", "word_id", F.col("start").alias("begin_at"), F.col("end").alias("end_at"), "label", "score")


@query(
    "join_word_runs",
    "NER-05",
    f"""WITH {_WORDS_SQL}, f AS (SELECT *, CASE WHEN label IS NOT DISTINCT FROM lag(label) OVER (PARTITION BY doc_id ORDER BY s) THEN 0 ELSE 1 END AS new FROM best),
    g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM f)
    SELECT doc_id, min(s) AS begin_at, max(e) AS end_at, label, round(avg(score) * 1000)::BIGINT AS score FROM g WHERE label IS NOT NULL GROUP BY doc_id, run, label""",
)
def join_word_runs(spark, sf):
    spans = t.word_runs(t.words(_subtokens(spark, sf), ["doc_id"]), ["doc_id"])
    return spans.select("doc_id", F.explode("spans").alias("s")).select(
        "doc_id", F.col("s.start").alias("begin_at"), F.col("s.end").alias("end_at"), F.col("s.label").alias("label"),
        F.round(F.col("s.score") * 1000).cast("bigint").alias("score"),
    )


@query(
    "chunk_words",
    "NER-06",
    f"""WITH RECURSIVE tk AS ({TOKENS_SQL}),
    c AS (SELECT doc_id, token, (1 + length(tok) // 4)::BIGINT AS cost, sum(1 + length(tok) // 4) OVER (PARTITION BY doc_id ORDER BY token) AS upto, count(*) OVER (PARTITION BY doc_id) AS n FROM tk),
    nxt AS (SELECT a.doc_id, a.token AS a, a.n, least(greatest(coalesce(b.token, -1) + 1, a.token + 1), a.n) AS b FROM c a ASOF LEFT JOIN c b ON a.doc_id = b.doc_id AND a.upto - a.cost + 60 >= b.upto),
    walk AS (SELECT doc_id, 0::BIGINT AS chunk_no, a, b, n FROM nxt WHERE a = 0
      UNION ALL SELECT x.doc_id, w.chunk_no + 1, x.a, x.b, x.n FROM walk w JOIN nxt x ON x.doc_id = w.doc_id AND w.b < w.n AND x.a = greatest(w.a + 1, w.b - 8))
    SELECT doc_id, chunk_no, a AS chunk_start, b AS chunk_end FROM walk""",
)
def chunk_words(spark, sf):
    counts = F.transform(t.tokens_of(F.col("text")), lambda w: (1 + F.floor(F.length(w) / 4)).cast("int"))
    docs = _docs(spark, sf).select("doc_id", counts.alias("counts"))
    return t.chunk_words(docs, 60, 8).select("doc_id", "chunk_no", "chunk_start", "chunk_end")


@query(
    "merge_word_chunks",
    "NER-07",
    f"""WITH tk AS ({TOKENS_SQL}), n AS (SELECT doc_id, count(*) AS n FROM tk GROUP BY 1),
    ch AS (SELECT doc_id, k AS chunk_no, k * 12 AS a, least(k * 12 + 20, n) AS b FROM n, LATERAL (SELECT unnest(range(0, (n + 11) // 12)) AS k)),
    x AS (SELECT tk.doc_id, token, chunk_no, abs(token - a - (b - a) / 2.0) AS d FROM tk JOIN ch ON tk.doc_id = ch.doc_id AND token >= a AND token < b),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, token ORDER BY d, chunk_no) AS r FROM x)
    SELECT doc_id, token, 'T' || ((chunk_no + token) % 4) AS tag FROM r WHERE r = 1""",
)
def merge_word_chunks(spark, sf):
    texts = _docs(spark, sf)
    docs = _dealt(texts, texts.select("doc_id", F.size(t.tokens_of(F.col("text"))).alias("n"))).filter("n > 0")
    k = F.col("chunk_no")
    ch = docs.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") + 11) / 12).cast("int") - 1)))
    ch = ch.select("doc_id", "chunk_no", (k * 12).alias("chunk_start"), F.least(k * 12 + 20, F.col("n")).alias("chunk_end"))
    x = ch.withColumn("token", F.explode(F.sequence("chunk_start", F.col("chunk_end") - 1)))
    tags = x.withColumn("tag", F.concat(F.lit("T"), ((k + F.col("token")) % 4).cast("string")))
    return t.merge_chunks(tags, ["doc_id"])


# Tags by arithmetic: B, matching and foreign I, and O.
_TAG = "CASE (doc_id + token * 3 + token // 5) % 7 WHEN 0 THEN 'B-AA' WHEN 1 THEN 'I-AA' WHEN 4 THEN 'I-AA' WHEN 2 THEN 'B-BB' WHEN 5 THEN 'I-BB' ELSE 'O' END"
_EDGE = r"[.,;:!?\"\x27()\[\]{}]"
_ENT_SQL = f"""tk AS (SELECT *, {_TAG} AS tag FROM ({TOKENS_SQL})),
g AS (SELECT *, sum(CASE WHEN starts_with(tag, 'I-') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY token) AS grp FROM tk),
h AS (SELECT *, first_value(tag) OVER w AS head, first_value(token) OVER w AS head_at FROM g WINDOW w AS (PARTITION BY doc_id, grp ORDER BY token)),
k AS (SELECT *, max(CASE WHEN token > head_at AND tag <> 'I-' || head[3:] THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, grp ORDER BY token) AS broken FROM h WHERE starts_with(head, 'B-')),
e0 AS (SELECT doc_id, head[3:] AS label, head_at AS a, max(token) + 1 AS b, list(tok ORDER BY token) AS ws FROM k WHERE broken = 0 GROUP BY doc_id, grp, head, head_at),
e1 AS (SELECT *, ws[1] AS w1, regexp_replace(ws[1], '^{_EDGE}+', '') AS bare FROM e0),
e2 AS (SELECT *, CASE WHEN length(bare) > 0 THEN left(w1, length(w1) - length(bare)) ELSE '' END AS prefix, CASE WHEN length(bare) > 0 THEN bare ELSE w1 END AS first FROM e1),
e3 AS (SELECT *, CASE WHEN len(ws) = 1 THEN first ELSE ws[-1] END AS lastw FROM e2),
e4 AS (SELECT *, regexp_replace(lastw, '{_EDGE}+$', '') AS cut FROM e3),
ent AS (SELECT doc_id, label, a, b, prefix, CASE WHEN length(cut) > 0 THEN substr(lastw, length(cut) + 1) ELSE '' END AS suffix,
  CASE WHEN len(ws) = 1 THEN CASE WHEN length(cut) > 0 THEN cut ELSE lastw END
    ELSE array_to_string(list_concat([first], ws[2:len(ws)-1], [CASE WHEN length(cut) > 0 THEN cut ELSE lastw END]), ' ') END AS text,
  row_number() OVER (PARTITION BY doc_id, label ORDER BY a) AS n FROM e4)"""


def _entities(spark, sf):
    docs = _docs(spark, sf).select("doc_id", t.tokens_of(F.col("text")).alias("tokens"))
    h = lambda i: (F.col("doc_id") + i * 3 + F.floor(i / 5)) % 7
    names = F.array(*[F.lit(x) for x in ("B-AA", "I-AA", "B-BB", "O", "I-AA", "I-BB", "O")])
    tag = lambda i: F.coalesce(F.get(names, h(i).cast("int")), F.lit("O"))
    tagged = docs.withColumn("tags", F.transform("tokens", lambda w, i: tag(i)))
    return tagged.withColumn("entities", t.bio_entities(F.col("tokens"), F.col("tags")))


@query("decode_bio_tags", "NER-08", f"WITH {_ENT_SQL} SELECT doc_id, text, label, a AS start_token, b AS end_token, prefix, suffix FROM ent")
def decode_bio_tags(spark, sf):
    return _entities(spark, sf).select("doc_id", F.inline("entities"))


@query("entity_map", "NER-09", f"WITH {_ENT_SQL} SELECT doc_id, text, arg_max(label, a) AS label FROM ent GROUP BY 1, 2")
def entity_map(spark, sf):
    return t.entity_map(_entities(spark, sf), ["doc_id"])


def _mask_sql(name: str) -> str:
    return f"""WITH {_ENT_SQL}, shown AS (
      SELECT doc_id, a AS at0, prefix || '[' || {name} || ']' || suffix AS tok FROM ent
      UNION ALL SELECT tk.doc_id, token, tok FROM tk WHERE NOT EXISTS (SELECT 1 FROM ent WHERE ent.doc_id = tk.doc_id AND token >= a AND token < b))
    SELECT doc_id, md5(string_agg(tok, ' ' ORDER BY at0)) AS masked FROM shown GROUP BY 1"""


def _with_words(df):
    """Texts with a token; a test of the masked text instead would be moved below the masking and mask every text again."""
    return df.filter(F.size("tokens") > 0)


@query("mask_labels", "RED-09", _mask_sql("label"))
def mask_labels(spark, sf):
    return _with_words(_entities(spark, sf)).select("doc_id", F.md5(t.mask_labels(F.col("tokens"), F.col("entities"))).alias("masked"))


@query("mask_ids", "RED-10", _mask_sql("label || ':' || n"))
def mask_ids(spark, sf):
    df = _with_words(_entities(spark, sf)).withColumn("m", t.mask_ids(F.col("tokens"), F.col("entities")))
    return df.select("doc_id", F.md5("m.anonymized_text").alias("masked"))


# --- redaction --------------------------------------------------------------


@query(
    "redact_exact",
    "RED-01",
    f"SELECT doc_id, md5(regexp_replace(text, '{WORD}', '[REDACTED]', 'g')) AS redacted FROM documents",
)
def redact_exact(spark, sf):
    return _marked(spark, sf).select("doc_id", F.md5(redact_text(F.col("text"), F.col("spans"), expand=False)).alias("redacted"))


_PUNCT = r".,;:!?\"\x27()\[\]{}"


@query(
    "redact_words",
    "RED-02 RED-03",
    f"SELECT doc_id, md5(regexp_replace(text, '([{_PUNCT}]*)\\S*{WORD}(?:\\S*[^\\s{_PUNCT}])?', '\\1[REDACTED]', 'g')) AS redacted FROM documents",
)
def redact_words(spark, sf):
    return _marked(spark, sf).select("doc_id", F.md5(redact_text(F.col("text"), F.col("spans"))).alias("redacted"))


def _nested(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(
        "conv_id",
        "turn",
        F.struct("role", F.struct("text", F.length("text").alias("n")).alias("body")).alias("message"),
        F.array(F.col("text"), F.col("role")).alias("parts"),
        F.create_map(F.lit("a"), F.col("text"), F.lit("b"), F.md5("text")).alias("extra"),
    )


def _flat(df):
    md5 = lambda c: F.md5(c)
    return df.select(
        "conv_id", "turn", F.col("message.role").alias("role"), md5(F.col("message.body.text")).alias("body"), F.col("message.body.n").alias("n"),
        md5(F.col("parts")[0]).alias("part0"), F.col("parts")[1].alias("part1"), md5(F.col("extra")["a"]).alias("extra_a"), md5(F.col("extra")["b"]).alias("extra_b"),
    )


_R = f"md5(regexp_replace(text, '{WORD}', '[REDACTED]', 'g'))"
_FLAT_SQL = "SELECT conv_id, turn, role, {body} AS body, length(text)::BIGINT AS n, {part0} AS part0, role AS part1, {a} AS extra_a, md5(md5(text)) AS extra_b FROM conversations"


@query("redact_nested", "RED-04", _FLAT_SQL.format(body=_R, part0=_R, a=_R))
def redact_nested(spark, sf):
    return _flat(redact_frame(_nested(spark, sf), word_spans, expand=False))


@query("redact_paths", "RED-05", _FLAT_SQL.format(body=_R, part0="md5(text)", a="md5(text)"))
def redact_paths(spark, sf):
    df = redact_frame(
        _nested(spark, sf), word_spans, include_paths=["message.*.text", "parts.1", "extra"], exclude_paths=["extra.a"], expand=False
    )
    return _flat(df)


@query(
    "redact_depth",
    "RED-06",
    f"SELECT conv_id, turn, role, '[REDACTED]' AS body_text, {_R} AS part0, {_R} AS extra_a FROM conversations",
)
def redact_depth(spark, sf):
    df = redact_frame(_nested(spark, sf), word_spans, max_depth=2, expand=False)
    return df.select("conv_id", "turn", F.col("message.role").alias("role"), F.col("message.body.text").alias("body_text"), F.md5(F.col("parts")[0]).alias("part0"), F.md5(F.col("extra")["a"]).alias("extra_a"))


@query(
    "redact_json_text",
    "RED-04",
    f"SELECT conv_id, turn, role, {_R} AS body FROM conversations",
)
def redact_json_text(spark, sf):
    body = F.to_json(F.struct("role", "turn", F.array(F.struct("text")).alias("items")))
    df = table(spark, sf, "conversations").select("conv_id", "turn", redact_json(body, redactor(word_spans, expand=False)).alias("j"))
    return df.select(
        "conv_id", "turn", F.get_json_object("j", "$.role").alias("role"), F.md5(F.get_json_object("j", "$.items[0].text")).alias("body")
    )


# --- telemetry --------------------------------------------------------------
#
# One payload per document: its first line in one record, the whole text in another.


def payloads(spark, sf):
    docs = _docs(spark, sf)
    leaf = lambda v: F.struct(F.struct(v.alias("stringValue")).alias("body"), F.lit("1700000000").alias("timeUnixNano"))
    first = F.substring_index("text", "\n", 1)
    body = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(leaf(first), leaf(F.col("text"))).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs")))
    signal = F.when(F.col("doc_id") % 3 == 0, "logs").when(F.col("doc_id") % 3 == 1, "traces").otherwise("metrics")
    return docs.select(F.col("doc_id").cast("string").alias("payload_id"), signal.alias("signal"), body.alias("body"))


# The first line comes first, but what it holds is also the start of the whole
# text, so the numbering equals that of the whole text.
_TEL_V = vault_sql(words_sql(), "key", "begin_at")
_TEL_COUNTS = f"(SELECT scope, string_agg(label || ':' || n, ',' ORDER BY label) AS counts FROM (SELECT scope, label, count(*) AS n FROM ({_TEL_V}) GROUP BY ALL) GROUP BY 1)"


@query(
    "scrub_telemetry",
    "RED-07 SRC-07",
    f"""WITH v AS ({_TEL_V}), r AS ({rendered_sql(pieces_sql("documents", "doc_id", "text", WORD), "SELECT scope AS key, value, placeholder AS name FROM v")})
    SELECT key::VARCHAR AS payload_id, md5(rendered) AS body, md5(string_split(rendered, chr(10))[1]) AS first, coalesce(counts, '') AS counts
    FROM r LEFT JOIN {_TEL_COUNTS} c ON r.key = c.scope""",
)
def scrub_telemetry(spark, sf):
    done = scrub_payloads(payloads(spark, sf), word_spans)
    at = lambda i: F.get_json_object("body", f"$.resourceLogs[0].scopeLogs[0].logRecords[{i}].body.stringValue")
    return done.select("payload_id", F.md5(at(1)).alias("body"), F.md5(at(0)).alias("first"), counts_text(F.col("counts")).alias("counts"))


@query(
    "audit_telemetry",
    "RED-08",
    f"SELECT scope::VARCHAR AS payload_id, 'otel' AS source, 'otel' AS wire_format, 'logs' AS model, counts AS entity_counts FROM {_TEL_COUNTS} WHERE scope % 3 = 0",
)
def audit_telemetry(spark, sf):
    rows = telemetry_interactions(scrub_payloads(payloads(spark, sf), word_spans))
    return rows.select("payload_id", "source", "wire_format", "model", counts_text(F.col("entity_counts")).alias("entity_counts"))


# --- vault ------------------------------------------------------------------

_SRC_SPANS = f"SELECT s.*, d.source FROM ({words_sql()}) s JOIN documents d ON d.doc_id = s.key"
_SRC_VAULT = vault_sql(_SRC_SPANS, "source", "key, begin_at")
_ALL_VAULT = vault_sql(words_sql(), "'all'", "key, begin_at")


@query("build_vault_per_source", "VLT-01", f"SELECT scope, label, value, n, placeholder FROM ({_SRC_VAULT})")
def build_vault_per_source(spark, sf):
    spans = explode_spans(_marked(spark, sf), keep=["doc_id", "source"])
    return build_vault(spans, ["doc_id", "start"], "source").drop("uses")


@query("build_vault_corpus", "VLT-01", f"SELECT scope, label, value, n, placeholder, uses FROM ({_ALL_VAULT})")
def build_vault_corpus(spark, sf):
    spans = explode_spans(_marked(spark, sf), keep=["doc_id"]).withColumn("scope", F.lit("all"))
    return build_vault(spans, ["doc_id", "start"])


@query("extend_vault", "VLT-01 VLT-03", f"SELECT scope, label, value, n, placeholder, uses FROM ({_SRC_VAULT})")
def extended_vault(spark, sf):
    """Three imports, one after the other, are one vault; the last two grow what is there."""
    spans = materialize(explode_spans(_marked(spark, sf), keep=["doc_id", "source"]))
    cut = spans.agg(F.max("doc_id").alias("last")).first().last or 0
    parts = [spans.filter(F.col("doc_id") <= cut // 3), spans.filter((F.col("doc_id") > cut // 3) & (F.col("doc_id") <= cut // 2)), spans.filter(F.col("doc_id") > cut // 2)]
    vault = build_vault(parts[0], ["doc_id", "start"], "source")
    for part in parts[1:]:
        vault = extend_vault(vault, part, ["doc_id", "start"], "source")
    return vault


_SRC_RENDERED = rendered_sql(
    pieces_sql("documents", "doc_id", "text", WORD),
    f"SELECT d.doc_id AS key, value, placeholder AS name FROM ({_SRC_VAULT}) v JOIN documents d ON d.source = v.scope",
)


def _pseudonymized(spark, sf):
    docs = materialize(_marked(spark, sf))  # detected once: the vault, the look-up and the splice read it
    spans = explode_spans(docs, keep=["doc_id", "source"])
    vault = build_vault(spans, ["doc_id", "start"], "source")
    return pseudonymize(docs, vault, ["doc_id"], "source"), vault


@query("pseudonymize_documents", "VLT-02", f"SELECT key AS doc_id, md5(rendered) AS anonymized FROM ({_SRC_RENDERED})")
def pseudonymize_documents(spark, sf):
    out, _ = _pseudonymized(spark, sf)
    return out.select("doc_id", F.md5("anonymized").alias("anonymized"))


@query("restore_documents", "VLT-04", "SELECT doc_id, md5(text) AS restored FROM documents")
def restore_documents(spark, sf):
    out, vault = _pseudonymized(spark, sf)
    return restore(out.drop("text", "spans"), vault, ["doc_id"], "source").select("doc_id", F.md5("restored").alias("restored"))


_CONV = "(SELECT conv_id * 1000 + turn AS k, conv_id, turn, text FROM conversations)"
_CONV_SPANS = f"SELECT s.*, key // 1000 AS conv, key % 1000 AS turn FROM ({words_sql(_CONV, 'k')}) s"
_CONV_VAULT = vault_sql(_CONV_SPANS, "conv", "turn, begin_at")


def _conv(spark, sf):
    return with_spans(table(spark, sf, "conversations"), word_spans)


@query(
    "pseudonymize_conversations",
    "VLT-03",
    f"""SELECT key // 1000 AS conv_id, key % 1000 AS turn, md5(rendered) AS anonymized FROM ({rendered_sql(pieces_sql(_CONV, 'k', 'text', WORD),
    f"SELECT k AS key, value, placeholder AS name FROM ({_CONV_VAULT}) v JOIN {_CONV} c ON c.conv_id = v.scope")})""",
)
def pseudonymize_conversations(spark, sf):
    turns = _conv(spark, sf)
    vault = build_vault(explode_spans(turns, keep=["conv_id", "turn"]), ["turn", "start"], "conv_id")
    return pseudonymize(turns, vault, ["conv_id", "turn"], "conv_id").select("conv_id", "turn", F.md5("anonymized").alias("anonymized"))


@query("export_vault", "VLT-05", f"SELECT scope, placeholder, value FROM ({_CONV_VAULT})")
def vault_export(spark, sf):
    return export_vault(build_vault(explode_spans(_conv(spark, sf), keep=["conv_id", "turn"]), ["turn", "start"], "conv_id"))


@query("count_types_per_source", "VLT-06", f"SELECT source, label, count(DISTINCT value) AS n FROM ({_SRC_SPANS}) GROUP BY 1, 2")
def count_types_per_source(spark, sf):
    return type_counts(explode_spans(_marked(spark, sf), keep=["doc_id", "source"]), ["source"])


@query(
    "count_types_per_turn",
    "VLT-07",
    f"SELECT conv AS conv_id, turn, string_agg(label || ':' || n, ',' ORDER BY label) AS counts FROM (SELECT conv, turn, label, count(DISTINCT value) AS n FROM ({_CONV_SPANS}) GROUP BY 1, 2, 3) GROUP BY 1, 2",
)
def count_types_per_turn(spark, sf):
    counts = type_counts(explode_spans(_conv(spark, sf), keep=["conv_id", "turn"]), ["conv_id", "turn"])
    folded = counts_map(counts, ["conv_id", "turn"])
    return folded.select("conv_id", "turn", counts_text(F.col("entity_counts")).alias("counts"))


# --- policy -----------------------------------------------------------------

_POLICY = {"PROMO_*": "block", "PROMO_BRUSHED": "keep", "STANDARD_*": "redact", "STANDARD_P*": "pseudonymize", "ECONOMY": "keep"}
_LABEL = "upper(replace(p_type, ' ', '_'))"
_CASE = f"""CASE WHEN l = 'PROMO_BRUSHED' OR l = 'ECONOMY' THEN 'keep' WHEN starts_with(l, 'STANDARD_P') THEN 'pseudonymize'
 WHEN starts_with(l, 'STANDARD_') THEN 'redact' WHEN starts_with(l, 'PROMO_') THEN 'block' ELSE 'pseudonymize' END"""


@query("resolve_policy", "POL-01", f"SELECT p_partkey, l AS label, {_CASE} AS action FROM (SELECT p_partkey, {_LABEL} AS l FROM part)")
def resolve_policy(spark, sf):
    label = F.upper(F.replace(F.col("p_type"), F.lit(" "), F.lit("_")))
    return table(spark, sf, "part").select("p_partkey", label.alias("label"), action_of(label, _POLICY, "pseudonymize").alias("action"))


@query("resolve_policy_table", "POL-01", f"SELECT DISTINCT l AS label, {_CASE} AS action FROM (SELECT {_LABEL} AS l FROM part)")
def resolve_policy_table(spark, sf):
    labels = table(spark, sf, "part").select(F.upper(F.replace(F.col("p_type"), F.lit(" "), F.lit("_"))).alias("label"))
    rules = spark.createDataFrame(list(_POLICY.items()), "pattern string, action string")
    return resolve_actions(labels, rules, "pseudonymize")


WORD_POLICY = {"TH_*": "keep", "DE_WORD": "redact", "ES_*": "block"}


@query(
    "apply_policy",
    "POL-02",
    f"""WITH v AS ({vault_sql(f"SELECT * FROM ({words_sql()}) WHERE label = 'LA_WORD'", "key", "begin_at")}),
    r AS ({rendered_sql(pieces_sql("documents", "doc_id", "text", WORD),
      f"SELECT w.key, w.value, CASE w.label WHEN 'DE_WORD' THEN '[REDACTED]' WHEN 'LA_WORD' THEN v.placeholder ELSE w.value END AS name FROM (SELECT DISTINCT key, value, label FROM ({words_sql()})) w LEFT JOIN v ON v.scope = w.key AND v.value = w.value")}),
    b AS (SELECT key, count(*) AS n FROM ({words_sql()}) WHERE label = 'ES_WORD' GROUP BY 1)
    SELECT r.key AS doc_id, md5(rendered) AS text, coalesce(b.n, 0)::BIGINT AS blocked FROM r LEFT JOIN b ON b.key = r.key""",
)
def policy_texts(spark, sf):
    df = _marked(spark, sf).withColumn("chosen", choose_spans(F.col("spans")))
    df = df.withColumn("p", apply_policy(F.col("text"), F.col("chosen"), policy(WORD_POLICY)))
    return df.select("doc_id", F.md5("p.text").alias("text"), F.coalesce(F.try_element_at(F.col("p.blocked"), F.lit("ES_WORD")), F.lit(0)).alias("blocked"))


@query(
    "block_verdicts",
    "POL-03",
    f"""SELECT key AS doc_id, bool_or(label = 'ES_WORD') AS blocked, CASE WHEN bool_or(label = 'ES_WORD') THEN 'block' ELSE 'pseudonymize' END AS policy
    FROM ({words_sql()}) GROUP BY 1""",
)
def block_verdicts(spark, sf):
    return verdicts(explode_spans(_marked(spark, sf), keep=["doc_id"]), policy(WORD_POLICY), ["doc_id"])


@query("block_tally", "POL-03", f"SELECT source, label, count(*) AS blocked FROM ({_SRC_SPANS}) WHERE label = 'ES_WORD' GROUP BY 1, 2")
def tally(spark, sf):
    return block_tally(explode_spans(_marked(spark, sf), keep=["doc_id", "source"]), policy(WORD_POLICY), ["source"])


# --- alignment --------------------------------------------------------------


def _aligned(spark, sf):
    turns = _conv(spark, sf)
    vault = build_vault(explode_spans(turns, keep=["conv_id", "turn"]), ["turn", "start"], "conv_id")
    out = pseudonymize(turns, vault, ["conv_id", "turn"], "conv_id")
    return out.withColumn("aligned", align(F.col("text"), F.col("anonymized")))


@query(
    "align_texts",
    "ALN-01",
    f"""SELECT key // 1000 AS conv_id, key % 1000 AS turn, (row_number() OVER (PARTITION BY key ORDER BY begin_at) - 1)::BIGINT AS pos, s.label AS type, s.value, v.placeholder, true AS ok
    FROM ({_CONV_SPANS}) s JOIN ({_CONV_VAULT}) v ON v.scope = s.conv AND v.label = s.label AND v.value = s.value""",
)
def align_texts(spark, sf):
    rows = _aligned(spark, sf).select("conv_id", "turn", "aligned.ok", F.posexplode("aligned.items").alias("pos", "x"))
    return rows.select("conv_id", "turn", "pos", "ok", "x.type", "x.value", "x.placeholder")


@query("values_by_type", "ALN-02", f"SELECT scope AS conv_id, label AS type, placeholder, n, value FROM ({_CONV_VAULT})")
def recovered_values(spark, sf):
    return values_by_type(_aligned(spark, sf), ["conv_id"], ["turn"])




@query("pseudonymize_null_scope", "VLT-02 VLT-04", "SELECT doc_id, md5(text) AS text, true AS masked FROM documents")
def pseudonymize_null_scope(spark, sf):
    """A null scope is a scope like any other: its placeholders are found both ways and no text is lost."""
    docs = with_spans(table(spark, sf, "documents").select("doc_id", "text"), word_spans).withColumn("scope", F.lit(None).cast("string"))
    docs = materialize(docs.withColumn("spans", choose_spans(F.col("spans"))))
    vault = materialize(build_vault(explode_spans(docs, keep=["doc_id", "scope"]), ["doc_id", "start"]))
    masked = pseudonymize(docs, vault, ["doc_id"])
    back = restore(masked, vault, ["doc_id"])
    return back.select("doc_id", F.md5("restored").alias("text"), ((F.size("spans") == 0) | (F.col("anonymized") != F.col("text"))).alias("masked"))
