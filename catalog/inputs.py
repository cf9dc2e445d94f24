"""Frames derived from the driver tables, and the same derivations as SQL.

The tables hold no requests, transcripts or telemetry; these are built from
``documents`` and ``conversations`` row by row, so they grow with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import table
from hushframe.functions.spans import find_spans
from hushframe.plans.audit import Audit

# --- a dense detector with a plain pattern ----------------------------------
#
# Capitalised words of four beginnings. The label is the beginning, so there are
# four labels, and a match cannot overlap another. The pattern means the same to
# Java, Python and RE2.

WORD = "(?:Th|De|La|Es)[a-z]+"


def word_label(value: Column) -> Column:
    return F.concat(F.upper(F.left(value, F.lit(2))), F.lit("_WORD"))


def word_spans(text: Column) -> Column:
    """Spans of WORD with one label per beginning."""
    found = find_spans(text, WORD, "")
    return F.transform(
        found,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            word_label(F.substring(text, s["start"] + 1, F.lit(2))).alias("label"),
            s["score"].alias("score"),
        ),
    )


# --- the same in SQL --------------------------------------------------------

_OPEN, _CLOSE, _PAD = "chr(57344)", "chr(57345)", "chr(57347)"


def pieces_sql(source: str, key: str, text: str, pattern: str, lead: str = "", trail: str = "", pad: str | None = None) -> str:
    """Rows (key, i, p, cut, bgn): a text cut at its matches, with the offset of each piece.

    RE2 has no look-around: ``lead`` and ``trail`` are consumed instead, and
    ``pad`` puts a filler after each character of a class so that one match's
    trail does not eat the next one's lead.
    """
    body = f"regexp_replace({text}, '([{pad}])', '\\1' || {_PAD}, 'g')" if pad else text
    pre, n = ("(" + lead + ")", 2) if lead else ("", 1)
    post = f"({trail})" if trail else ""
    repl = ("'\\1' || " if lead else "") + f"{_OPEN} || '\\{n}' || {_CLOSE}" + (f" || '\\{n + 1}'" if trail else "")
    marked = f"replace(regexp_replace({body}, '{pre}({pattern}){post}', {repl}, 'g'), {_PAD}, '')"
    return (
        f"SELECT key, i, p, cut, coalesce(sum(length(p) - CASE WHEN cut > 0 THEN 1 ELSE 0 END) OVER "
        f"(PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bgn FROM ("
        f"SELECT key, i, p, instr(p, {_CLOSE})::BIGINT AS cut FROM ("
        f"SELECT key, unnest(l) AS p, unnest(range(1, len(l) + 1)) AS i FROM ("
        f"SELECT {key} AS key, string_split({marked}, {_OPEN}) AS l FROM {source})))"
    )


def found_sql(*args, **kwargs) -> str:
    """Rows (key, begin_at, end_at, value) of all matches."""
    return (
        f"SELECT key, bgn AS begin_at, bgn + cut - 1 AS end_at, left(p, cut - 1) AS value "
        f"FROM ({pieces_sql(*args, **kwargs)}) WHERE cut > 1"
    )


LABEL_SQL = "upper(left(value, 2)) || '_WORD'"


def words_sql(source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"SELECT *, {LABEL_SQL} AS label FROM ({found_sql(source, key, text, WORD)})"


def rendered_sql(pieces: str, names: str) -> str:
    """(key, rendered): pieces put together with ``names`` (key, value, name) for the matches."""
    return (
        f"SELECT q.key, string_agg(CASE WHEN cut > 0 THEN name || substr(p, cut + 1) ELSE p END, '' ORDER BY i) AS rendered "
        f"FROM ({pieces}) q LEFT JOIN ({names}) n ON q.key = n.key AND left(q.p, q.cut - 1) = n.value GROUP BY q.key"
    )


def vault_sql(spans: str, scope: str, position: str) -> str:
    """(scope, label, value, n, placeholder) from a span query with the columns scope and position need."""
    return (
        f"SELECT *, '[' || label || '_' || n || ']' AS placeholder FROM ("
        f"SELECT scope, label, value, uses, row_number() OVER (PARTITION BY scope, label ORDER BY pos) AS n FROM ("
        f"SELECT {scope} AS scope, label, value, min(({position})) AS pos, count(*) AS uses FROM ({spans}) GROUP BY ALL))"
    )


# --- audit tables -----------------------------------------------------------


def audit(spark: SparkSession, sf_dir: str) -> Audit:
    """``orders`` as interactions, ``lineitem`` as detections, ``conversations`` as texts."""
    lines = table(spark, sf_dir, "lineitem")
    detection = (
        lines.groupBy(
            F.col("l_orderkey").alias("interaction_id"), F.concat_ws("_", "l_returnflag", "l_linestatus").alias("entity_type")
        )
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("count"))
        .select((F.col("interaction_id") * 10 + F.length("entity_type")).alias("id"), "interaction_id", "entity_type", "count")
    )
    o = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    source = F.when(F.col("o_orderstatus") == "P", "codex").when(F.col("o_orderstatus") == "F", "claude-code").otherwise("claude-code-import")
    counts = detection.groupBy(F.col("interaction_id").alias("id")).agg(
        F.sum("count").alias("entity_total"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "count")))).alias("entity_counts"),
    )
    base = orders.select(
        o.alias("id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        source.alias("source"),
        F.when(F.col("o_orderstatus") == "P", "openai_responses").otherwise("anthropic").alias("wire_format"),
        F.when(o % 5 == 0, "safety").when(o % 5 == 1, "helper").otherwise("main").alias("kind"),
        F.col("o_orderpriority").alias("model"),
        F.when(o % 2 == 0, "monitor").otherwise("pseudonymize").alias("policy"),
        F.when(o % 7 != 0, F.get(F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")]), (o % 4).cast("int"))).alias("language"),
        F.when(o % 11 != 0, F.floor("o_totalprice").cast("bigint")).alias("input_tokens"),
        F.when(o % 11 != 0, o % 100).alias("output_tokens"),
        F.when(o % 13 != 0, F.col("o_custkey").cast("string")).alias("conversation_id"),
    )
    interaction = base.join(counts, "id", "left").select(
        "id", "created_at", "source", "wire_format", "kind", "model", "policy", "language", "input_tokens", "output_tokens",
        F.coalesce("entity_total", F.lit(0)).alias("entity_total"),
        F.coalesce("entity_counts", F.create_map().cast("map<string,bigint>")).alias("entity_counts"),
        "conversation_id",
    )
    c = table(spark, sf_dir, "conversations")
    text = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("conv_id").alias("interaction_id"),
        F.col("turn").cast("int").alias("seq"),
        F.when(F.col("role") == "system", "tool").otherwise(F.col("role")).alias("category"),
        F.col("text").alias("original"),
        F.regexp_replace("text", WORD, "[WORD_1]").alias("anonymized"),
    )
    return Audit(interaction, detection, text)


def counts_text(counts: Column) -> Column:
    """A counts map as ``A:1,B:2``."""
    return F.array_join(
        F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ","
    )


AUDIT_SQL = f"""
det AS (SELECT l_orderkey AS interaction_id, l_returnflag || '_' || l_linestatus AS entity_type,
  sum(CAST(l_quantity AS BIGINT))::BIGINT AS count FROM lineitem GROUP BY ALL),
tot AS (SELECT interaction_id, sum(count)::BIGINT AS entity_total,
  string_agg(entity_type || ':' || count, ',' ORDER BY entity_type) AS entity_counts FROM det GROUP BY 1),
inter AS (SELECT o_orderkey AS id, o_orderdate AS created_at,
  CASE o_orderstatus WHEN 'P' THEN 'codex' WHEN 'F' THEN 'claude-code' ELSE 'claude-code-import' END AS source,
  CASE o_orderstatus WHEN 'P' THEN 'openai_responses' ELSE 'anthropic' END AS wire_format,
  CASE o_orderkey % 5 WHEN 0 THEN 'safety' WHEN 1 THEN 'helper' ELSE 'main' END AS kind,
  o_orderpriority AS model, CASE o_orderkey % 2 WHEN 0 THEN 'monitor' ELSE 'pseudonymize' END AS policy,
  CASE WHEN o_orderkey % 7 <> 0 THEN ['en','de','fr','es'][o_orderkey % 4 + 1] END AS language,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS input_tokens,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 100 END AS output_tokens,
  coalesce(entity_total, 0)::BIGINT AS entity_total, coalesce(entity_counts, '') AS entity_counts,
  CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS conversation_id
  FROM orders LEFT JOIN tot ON o_orderkey = interaction_id),
txt AS (SELECT conv_id * 1000 + turn AS id, conv_id AS interaction_id, turn AS seq,
  CASE role WHEN 'system' THEN 'tool' ELSE role END AS category, text AS original,
  regexp_replace(text, '{WORD}', '[WORD_1]', 'g') AS anonymized FROM conversations)
"""


def iso(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def iso_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


# --- spans made by arithmetic ------------------------------------------------
#
# Twelve spans per document, dense enough to overlap, touch and tie.

N_SPANS = 12


def made_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")

    def one(j: Column) -> Column:
        a = (d * 7 + j * 29) % 60
        w = (d * 3 + j * 5) % 9
        label = F.when((d + j) % 5 == 0, "SECRET_A").when((d + j) % 5 == 1, "B").when((d + j) % 5 == 2, "C").otherwise("D")
        score = ((d * 13 + j * 11) % 10) / F.lit(10.0)
        return F.struct(
            a.cast("int").alias("start"), (a + w).cast("int").alias("end"), label.alias("label"), score.cast("double").alias("score")
        )

    spans = F.transform(F.sequence(F.lit(0), F.lit(N_SPANS - 1)), one)
    return table(spark, sf_dir, "documents").select("doc_id", "text", spans.alias("spans"))


MADE_SQL = f"""
made AS (SELECT doc_id, j, a AS s, a + w AS e, label, score FROM (
  SELECT doc_id, j, (doc_id * 7 + j * 29) % 60 AS a, (doc_id * 3 + j * 5) % 9 AS w,
    CASE (doc_id + j) % 5 WHEN 0 THEN 'SECRET_A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS label,
    ((doc_id * 13 + j * 11) % 10) / 10.0 AS score
  FROM documents, range({N_SPANS}) r(j)))
"""


def span_rows(df: DataFrame, spans: Column, key: str = "doc_id") -> DataFrame:
    return df.select(key, F.explode(spans).alias("s")).select(
        key, F.col("s.start").alias("begin_at"), F.col("s.end").alias("end_at"), F.col("s.label").alias("label")
    )


def greedy_sql(order: str, clash: str) -> str:
    """Rows of ``made`` kept one after another by ``order`` unless ``clash`` (k: kept, m: new) holds."""
    return f"""
WITH RECURSIVE {MADE_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS r FROM made WHERE {{where}}),
walk AS (
  SELECT doc_id, 0::BIGINT AS r, []::STRUCT(s BIGINT, e BIGINT)[] AS kept, false AS took FROM (SELECT DISTINCT doc_id FROM ranked)
  UNION ALL
  SELECT m.doc_id, m.r, CASE WHEN ok THEN list_append(kept, {{{{'s': m.s, 'e': m.e}}}}) ELSE kept END, ok FROM (
    SELECT m.*, w.kept, len([k for k in w.kept if {clash}]) = 0 AS ok FROM walk w JOIN ranked m ON m.doc_id = w.doc_id AND m.r = w.r + 1) m)
SELECT k.doc_id, k.s AS begin_at, k.e AS end_at, k.label FROM walk w JOIN ranked k ON k.doc_id = w.doc_id AND k.r = w.r WHERE w.took
"""
