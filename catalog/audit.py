"""Audit table queries."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import functions as F

from catalog.inputs import AUDIT_SQL, audit, counts_text, iso, iso_sql
from catalog.registry import query, table
from hushframe.plans import audit as q
from hushframe.plans import exchanges as x
from hushframe.plans import rollups as ru
from hushframe.plans import store as st
from hushframe.plans.audit import Audit
from hushframe.plans.live import keep_texts
from hushframe.plans.search import search_audit
from hushframe.session import checkpoint_dir, materialize
from hushframe.sources.requests import source_of


def sql(select: str) -> str:
    return f"WITH {AUDIT_SQL} {select}"


FLAT = ["id", "source", "wire_format", "kind", "model", "policy", "language", "input_tokens", "output_tokens", "entity_total", "conversation_id"]
FLAT_SQL = f"id, {iso_sql('created_at')} AS created_at, source, wire_format, kind, model, policy, language, input_tokens, output_tokens, entity_total, conversation_id, entity_counts"


def flat(df):
    return df.select(iso("created_at").alias("created_at"), *FLAT, counts_text(F.col("entity_counts")).alias("entity_counts"))


# --- writing ----------------------------------------------------------------


def _scratch(spark, name: str) -> str:
    import uuid

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _records(spark, sf):
    """Captured records: orders with counts from their lines and the texts of three fields."""
    a = audit(spark, sf)
    text = F.array(
        F.struct(F.lit("user").alias("category"), F.col("model").alias("original"), F.lit("[M_1]").alias("anonymized")),
        F.struct(F.lit(None).cast("string").alias("category"), F.col("source").alias("original"), F.col("source").alias("anonymized")),
    )
    counts = F.map_concat(F.col("entity_counts"), F.create_map(F.lit("ZERO"), F.lit(0).cast("bigint")))
    return a.interaction.drop("entity_total").withColumn("entity_counts", counts).withColumn("texts", text)


@query(
    "append_interactions",
    "SNK-01 SNK-02",
    sql(f"""SELECT 'interaction' AS kind_of, count(*) AS n, sum(entity_total)::BIGINT AS total, count(DISTINCT id) AS ids, max({iso_sql('created_at')}) AS last FROM inter
    UNION ALL SELECT 'detection', count(*), sum(count)::BIGINT, count(DISTINCT interaction_id), NULL FROM det JOIN inter ON id = interaction_id
    UNION ALL SELECT 'text', 2 * count(*), count(*)::BIGINT, count(*), 'user' FROM inter"""),
)
def append_interactions(spark, sf):
    path = _scratch(spark, "audit")
    records = materialize(_records(spark, sf))  # both writings read it
    st.append_audit(st.to_audit(records), path, batch="b1")
    st.append_audit(st.to_audit(records), path, batch="b1")  # a retried batch leaves one copy
    a = st.read_audit(spark, path)
    n = F.count(F.lit(1)).alias("n")
    i = a.interaction.agg(n, F.sum("entity_total").alias("total"), F.countDistinct("id").alias("ids"), F.max(iso("created_at")).alias("last"))
    d = a.detection.agg(n, F.sum("count").alias("total"), F.countDistinct("interaction_id").alias("ids"), F.lit(None).cast("string").alias("last"))
    t = a.text.agg(n, F.sum("seq").alias("total"), F.countDistinct("interaction_id").alias("ids"), F.max("category").alias("last"))
    named = [df.select(F.lit(k).alias("kind_of"), "*") for k, df in (("interaction", i), ("detection", d), ("text", t))]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query(
    "export_csv_rows",
    "SNK-03",
    sql("""SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at, source, wire_format, kind, model, policy, coalesce(language, '') AS language,
    coalesce(input_tokens::VARCHAR, '') AS input_tokens, coalesce(output_tokens::VARCHAR, '') AS output_tokens, entity_total,
    '{' || coalesce((SELECT string_agg('"' || entity_type || '":' || count, ',' ORDER BY entity_type) FROM det WHERE interaction_id = id), '') || '}' AS entity_counts FROM inter"""),
)
def export_csv_rows(spark, sf):
    """Written as CSV and read back, so that the file form is what is checked."""
    path = _scratch(spark, "csv")
    st.export_csv(audit(spark, sf), path)
    back = spark.read.option("header", "true").option("escape", "\\").csv(path)
    text = ["source", "wire_format", "kind", "model", "policy", "language", "input_tokens", "output_tokens"]
    return back.select(
        F.col("id").cast("bigint").alias("id"), "created_at", *[F.coalesce(c, F.lit("")).alias(c) for c in text],
        F.col("entity_total").cast("bigint").alias("entity_total"), "entity_counts",
    )


@query(
    "export_json_rows",
    "SNK-04",
    sql("""SELECT id, model, coalesce((SELECT string_agg(entity_type || ':' || count, ',' ORDER BY count DESC, entity_type) FROM det WHERE interaction_id = id), '') AS detections,
    (SELECT count(*) FROM txt WHERE interaction_id = inter.id) AS n_texts, coalesce((SELECT md5(string_agg(anonymized, '|' ORDER BY seq)) FROM txt WHERE interaction_id = inter.id), md5('')) AS texts FROM inter"""),
)
def export_json_rows(spark, sf):
    path = _scratch(spark, "json")
    st.export_json(audit(spark, sf), path, include_texts=True)
    schema = (
        "id bigint, model string, part int, detections array<struct<id:bigint,entity_type:string,count:bigint>>, "
        "texts array<struct<seq:int,category:string,original:string,anonymized:string>>"
    )
    back = spark.read.schema(schema).json(path)
    none = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return back.select(
        "id",
        "model",
        F.array_join(none(F.transform("detections", lambda d: F.concat_ws(":", d["entity_type"], d["count"].cast("string")))), ",").alias("detections"),
        F.coalesce(F.size("texts"), F.lit(0)).cast("bigint").alias("n"),
        F.md5(F.array_join(none(F.transform("texts", lambda t: t["anonymized"])), "|")).alias("texts"),
    ).select("id", "model", "detections", F.greatest("n", F.lit(0)).alias("n_texts"), "texts")


@query(
    "evolve_old_tables",
    "SNK-05",
    "SELECT o_orderkey AS id, 'main' AS kind, NULL::VARCHAR AS conversation_id, o_orderpriority AS model FROM orders",
)
def evolve_old_tables(spark, sf):
    old = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("model"))
    return st.evolve(old, st.INTERACTION).select(F.col("id").cast("bigint").alias("id"), "kind", "conversation_id", "model")


@query(
    "delete_interaction",
    "SNK-06",
    sql("""SELECT (SELECT count(*) FROM inter WHERE id <> 7) AS interactions, (SELECT count(*) FROM det WHERE interaction_id <> 7) AS detections,
    (SELECT count(*) FROM txt WHERE interaction_id <> 7) AS texts, EXISTS (SELECT 1 FROM inter WHERE id = 7) AS deleted"""),
)
def delete_interaction(spark, sf):
    path = _scratch(spark, "delete")
    whole = audit(spark, sf)
    low, child = F.col("id") < 100, F.col("interaction_id") < 100
    st.append_audit(Audit(whole.interaction.filter(low), whole.detection.filter(child), whole.text.filter(child)), path, batch="b1")
    st.append_audit(Audit(whole.interaction.filter(~low), whole.detection.filter(~child), whole.text.filter(~child)), path, batch="b2")
    existed = st.delete_interaction(spark, path, 7)
    a = st.read_audit(spark, path)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("v")).select(F.lit(name).alias("k"), "v")
    rows = n(a.interaction, "i").unionByName(n(a.detection, "d")).unionByName(n(a.text, "t"))
    rows = rows.unionByName(spark.range(1).select(F.lit("x").alias("k"), F.lit(int(existed)).cast("bigint").alias("v")))
    pick = lambda k: F.sum(F.when(F.col("k") == k, F.col("v")))
    return rows.agg(
        pick("i").alias("interactions"), pick("d").alias("detections"), pick("t").alias("texts"), (pick("x") > 0).alias("deleted")
    )


@query("clear_audit", "SNK-07", "SELECT (SELECT count(*) FROM orders) AS removed, 0::BIGINT AS left_over")
def clear_audit(spark, sf):
    path = _scratch(spark, "clear")
    st.append_audit(audit(spark, sf), path, batch="b1")
    removed = st.clear_all(spark, path, confirm=True)
    return st.read_audit(spark, path).interaction.agg(F.lit(removed).cast("bigint").alias("removed"), F.count(F.lit(1)).alias("left_over"))


# --- lists ------------------------------------------------------------------


@query("audit_summary", "AUD-01", sql("SELECT (SELECT count(*) FROM inter) AS interactions, (SELECT sum(count) FROM det)::BIGINT AS entities_total"))
def audit_summary(spark, sf):
    return q.summary(audit(spark, sf))


@query("recent_interactions", "AUD-02", sql(f"SELECT {FLAT_SQL} FROM inter ORDER BY created_at DESC, id LIMIT 50"))
def recent_interactions(spark, sf):
    return flat(q.recent(audit(spark, sf), 50))


@query(
    "filter_interactions",
    "AUD-03",
    sql(f"""SELECT {FLAT_SQL} FROM inter WHERE wire_format IN ('anthropic') AND kind IN ('main', 'safety') AND model IN ('1-URGENT', '3-MEDIUM', '5-LOW')
    AND policy = 'monitor' AND language IN ('de', 'en', 'fr') AND entity_total >= 50 AND created_at >= '1996-01-01' AND created_at <= '1999-12-31'"""),
)
def filter_interactions(spark, sf):
    rows = q.filter_interactions(
        audit(spark, sf), wire_formats=["anthropic"], kinds=["main", "safety"], models=["1-URGENT", "3-MEDIUM", "5-LOW"], policies=["monitor"],
        languages=["de", "en", "fr"], min_entities=50, date_from=datetime(1996, 1, 1), date_to=datetime(1999, 12, 31),
    )
    return flat(rows)


@query("filter_by_source", "AUD-04", sql(f"SELECT {FLAT_SQL} FROM inter WHERE source IN ('claude-code', 'claude-code-import')"))
def filter_by_source(spark, sf):
    return flat(q.filter_interactions(audit(spark, sf), sources=["claude-code"]))


@query("filter_by_entity", "AUD-05", sql(f"SELECT {FLAT_SQL} FROM inter WHERE EXISTS (SELECT 1 FROM det WHERE interaction_id = id AND entity_type = 'A_F')"))
def filter_by_entity(spark, sf):
    return flat(q.filter_interactions(audit(spark, sf), entity_type="A_F"))


@query(
    "search_texts",
    "AUD-06",
    sql(f"SELECT {FLAT_SQL} FROM inter WHERE EXISTS (SELECT 1 FROM txt WHERE interaction_id = inter.id AND (translate(original, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%[word_1] _n%' OR translate(anonymized, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%[word_1] _n%'))"),
)
def search_texts(spark, sf):
    return flat(q.filter_interactions(audit(spark, sf), q="[word_1] _n"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '{}'"
_SOUGHT = ("%[word_1] _n%", "%ther%tion%", "%zq%", "%no such text at all%", "%th_re%")


def _sought_sql(pattern: str) -> str:
    hit = " OR ".join(_LOWER.format(c, pattern) for c in ("original", "anonymized"))
    return f"SELECT '{pattern.strip('%')}' AS q, id FROM inter WHERE EXISTS (SELECT 1 FROM txt WHERE interaction_id = inter.id AND ({hit}))"


@query("search_kept_texts", "AUD-06 SNK-01", sql(" UNION ALL ".join(_sought_sql(p) for p in _SOUGHT)))
def search_kept_texts(spark, sf):
    """Several searches over written tables, one interaction deleted and written again between; files are left out by signatures."""
    path = _scratch(spark, "search")
    whole = audit(spark, sf)
    whole = Audit(*map(materialize, (whole.interaction, whole.detection, whole.text)))  # three writings read it, and range partitions sample it first
    low, child = F.col("id") < 100, F.col("interaction_id") < 100
    st.append_audit(Audit(whole.interaction.filter(low), whole.detection.filter(child), whole.text.filter(child)), path, "low", searchable=True)
    st.append_audit(Audit(whole.interaction.filter(~low), whole.detection.filter(~child), whole.text.filter(~child)), path, "high", searchable=True)
    st.delete_interaction(spark, path, 1)
    one, own = F.col("id") == 1, F.col("interaction_id") == 1
    st.append_audit(Audit(whole.interaction.filter(one), whole.detection.filter(own), whole.text.filter(own)), path, "again")
    rows = [search_audit(spark, path, p.strip("%")).select(F.lit(p.strip("%")).alias("q"), F.col("id").cast("bigint").alias("id")) for p in _SOUGHT]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query("list_page_after", "AUD-07", sql(f"SELECT {FLAT_SQL} FROM inter ORDER BY language DESC NULLS LAST, id LIMIT 900"))
def list_page_after(spark, sf):
    """Three pages of 300, each going on from the last row of the one before."""
    rows, after, pages = audit(spark, sf).interaction, None, []
    for _ in range(3):
        page = q.page_after(rows, after, "language", "desc", 300)
        pages.append(page)
        last = page.orderBy(F.col("language").desc(), "id").select("language", "id").tail(1)  # the row a reader has in hand
        after = tuple(last[0]) if last else after
    return flat(reduce(lambda a, b: a.unionByName(b), pages))


@query("list_page_deep", "AUD-07", sql(f"SELECT {FLAT_SQL} FROM inter ORDER BY entity_total DESC NULLS LAST, id LIMIT 7 OFFSET (SELECT greatest(0, (count(*) // 7 - 2)) * 7 FROM inter)"))
def list_page_deep(spark, sf):
    """A page near the end, found by counts."""
    rows = audit(spark, sf).interaction
    return flat(q.page_at(rows, "entity_total", "desc", max(1, rows.count() // 7 - 1), 7))


@query(
    "list_page",
    "AUD-07",
    sql(f"SELECT {FLAT_SQL} FROM inter WHERE kind = 'main' ORDER BY entity_total DESC NULLS LAST, id LIMIT 40 OFFSET 80"),
)
def list_page(spark, sf):
    rows = q.filter_interactions(audit(spark, sf), kinds=["main"])
    return flat(q.page_of(rows, "entity_total", "desc", page=3, size=40))


@query("list_page_by_language", "AUD-07", sql(f"SELECT {FLAT_SQL} FROM inter ORDER BY language ASC NULLS FIRST, id LIMIT 500 OFFSET 500"))
def list_page_by_language(spark, sf):
    return flat(q.page_of(audit(spark, sf).interaction, "language", "asc", page=2, size=500))


@query("list_totals", "AUD-07 AUD-08", sql("SELECT count(*) AS total, 40::BIGINT AS page_size, ceil(count(*) / 40.0)::BIGINT AS total_pages FROM inter WHERE kind = 'main'"))
def list_totals(spark, sf):
    return q.page_totals(q.filter_interactions(audit(spark, sf), kinds=["main"]), 40)


@query(
    "enrich_page",
    "AUD-08",
    sql("""SELECT id, (SELECT count(*) FROM txt WHERE interaction_id = p.id) AS text_count,
    coalesce((SELECT string_agg(entity_type, ',' ORDER BY entity_type) FROM det WHERE interaction_id = p.id), '') AS detection_types
    FROM (SELECT id FROM inter ORDER BY id LIMIT 200) p"""),
)
def enrich_page(spark, sf):
    a = audit(spark, sf)
    rows = q.enrich_page(a, q.page_of(a.interaction, "id", "asc", 1, 200))
    return rows.select("id", "text_count", F.array_join("detection_types", ",").alias("detection_types"))


@query("scan_all", "AUD-09", sql(f"SELECT {FLAT_SQL} FROM inter WHERE source IN ('codex', 'codex-import') AND entity_total >= 100"))
def scan_all(spark, sf):
    return flat(q.all_interactions(audit(spark, sf), sources=["codex"], min_entities=100))


@query(
    "interaction_details",
    "AUD-10",
    sql("""SELECT id, model, coalesce((SELECT string_agg(entity_type || ':' || count, ',' ORDER BY count DESC, entity_type) FROM det WHERE interaction_id = inter.id), '') AS detections FROM inter"""),
)
def interaction_details(spark, sf):
    a = audit(spark, sf)
    rows = q.with_detections(a, a.interaction)
    text = F.array_join(F.transform("detections", lambda d: F.concat_ws(":", d["entity_type"], d["count"].cast("string"))), ",")
    return rows.select("id", "model", F.coalesce(text, F.lit("")).alias("detections"))


@query(
    "interaction_texts",
    "AUD-10 AUD-21",
    sql("SELECT id, seq, category, NULL::VARCHAR AS original, md5(anonymized) AS anonymized FROM txt WHERE interaction_id = 3"),
)
def interaction_texts(spark, sf):
    _, _, texts = q.interaction_detail(audit(spark, sf), 3)
    return texts.select("id", "seq", "category", "original", F.md5("anonymized").alias("anonymized"))


# --- conversations ----------------------------------------------------------

CONV_SQL = f"""SELECT conversation_id, {iso_sql('min(created_at)')} AS first_seen, {iso_sql('max(created_at)')} AS last_seen, count(*) AS turn_count, sum(entity_total)::BIGINT AS entity_total,
 string_agg(DISTINCT source, ',' ORDER BY source) AS sources, string_agg(DISTINCT model, ',' ORDER BY model) AS models, count(*) FILTER (kind <> 'main') AS background_count,
 coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens,
 coalesce((SELECT string_agg(entity_type || ':' || n, ',' ORDER BY entity_type) FROM (SELECT entity_type, sum(count)::BIGINT AS n FROM det JOIN inter i2 ON i2.id = det.interaction_id WHERE i2.conversation_id = i.conversation_id GROUP BY 1)), '') AS entity_counts
 FROM inter i WHERE {{where}} GROUP BY conversation_id"""


def _conv(df):
    return df.select(
        "conversation_id", iso("first_seen").alias("first_seen"), iso("last_seen").alias("last_seen"), "turn_count", "entity_total",
        F.array_join("sources", ",").alias("sources"), F.array_join("models", ",").alias("models"), "background_count", "input_tokens", "output_tokens",
        counts_text(F.col("entity_counts")).alias("entity_counts"),
    )


@query(
    "list_conversations",
    "AUD-11",
    f"""WITH {AUDIT_SQL}, k AS (SELECT conversation_id, sum(entity_total) AS r FROM inter WHERE conversation_id IS NOT NULL AND kind = 'main' AND policy = 'monitor'
    GROUP BY 1 ORDER BY r DESC, conversation_id LIMIT 50 OFFSET 50) {CONV_SQL.format(where="conversation_id IN (SELECT conversation_id FROM k)")}""",
)
def list_conversations(spark, sf):
    return _conv(q.list_conversations(audit(spark, sf), 2, 50, "entity_total", "desc", kinds=["main"], policies=["monitor"]))


@query(
    "list_conversations_total",
    "AUD-11",
    sql("SELECT count(DISTINCT conversation_id) AS total, 50::BIGINT AS page_size, ceil(count(DISTINCT conversation_id) / 50.0)::BIGINT AS total_pages FROM inter WHERE conversation_id IS NOT NULL AND kind = 'main' AND policy = 'monitor'"),
)
def list_conversations_total(spark, sf):
    return q.conversation_totals(audit(spark, sf), 50, kinds=["main"], policies=["monitor"])


@query(
    "list_conversations_after",
    "AUD-11",
    f"""WITH {AUDIT_SQL}, k AS (SELECT conversation_id, sum(entity_total) AS r FROM inter WHERE conversation_id IS NOT NULL AND kind = 'main' AND policy = 'monitor'
    GROUP BY 1 ORDER BY r DESC, conversation_id LIMIT 60 OFFSET 60) {CONV_SQL.format(where="conversation_id IN (SELECT conversation_id FROM k)")}""",
)
def list_conversations_after(spark, sf):
    """The second page of 60, from the last conversation of the first one on."""
    a, wanted = audit(spark, sf), {"kinds": ["main"], "policies": ["monitor"]}
    last = q.conversations_after(a, None, 60, "entity_total", **wanted).select("sort_key", "conversation_id").tail(1)
    return _conv(q.conversations_after(a, tuple(last[0]) if last else None, 60, "entity_total", **wanted))


@query("summarize_conversations", "AUD-12", sql(CONV_SQL.format(where="conversation_id IS NOT NULL")))
def summarize_conversations(spark, sf):
    return _conv(q.list_conversations(audit(spark, sf), page=None))


@query(
    "conversation_turns",
    "AUD-13",
    sql(f"""SELECT id, {iso_sql('created_at')} AS created_at, coalesce((SELECT string_agg(entity_type || ':' || count, ',' ORDER BY count DESC, entity_type) FROM det WHERE interaction_id = inter.id), '') AS detections
    FROM inter WHERE conversation_id = '10'"""),
)
def conversation_turns(spark, sf):
    turns, _ = q.conversation_detail(audit(spark, sf), "10")
    text = F.array_join(F.transform("detections", lambda d: F.concat_ws(":", d["entity_type"], d["count"].cast("string"))), ",")
    return turns.select("id", iso("created_at").alias("created_at"), F.coalesce(text, F.lit("")).alias("detections"))


@query(
    "conversation_texts",
    "AUD-13 AUD-21",
    sql("SELECT t.interaction_id, t.seq, md5(t.original) AS original, false AS redacted FROM txt t JOIN inter i ON i.id = t.interaction_id WHERE conversation_id = (SELECT max(conversation_id) FROM inter WHERE id = 5)"),
)
def conversation_texts(spark, sf):
    a = audit(spark, sf)
    wanted = a.interaction.filter("id = 5").agg(F.max("conversation_id")).first()[0]
    _, texts = q.conversation_detail(a, wanted or "", plaintext=True)
    return texts.select("interaction_id", "seq", F.md5("original").alias("original"), "redacted")


# Conversations of the text table itself: ten interactions each, editor source.


def _editor(spark, sf):
    c = table(spark, sf, "conversations")
    interaction = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("created_at"),
        F.when(F.col("conv_id") % 4 == 0, "codex").otherwise("cursor").alias("source"),
        F.when(F.col("turn") % 3 == 2, "helper").otherwise("main").alias("kind"),
        F.when(F.length("text") % 3 == 0, F.length("text") % 7).otherwise(0).cast("bigint").alias("entity_total"),
        F.floor(F.col("conv_id") / 3).cast("string").alias("conversation_id"),
    )
    text = c.filter("role <> 'system'").select(
        F.col("conv_id").alias("id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("interaction_id"), F.col("turn").alias("seq"), F.col("role").alias("category"),
        F.col("text").alias("original"), F.col("text").alias("anonymized"),
    )
    return q.Audit(interaction, interaction.select("id").limit(0), text)


_EDITOR = """WITH i AS (SELECT conv_id * 1000 + turn AS id, conv_id, role, CASE conv_id % 4 WHEN 0 THEN 'codex' ELSE 'cursor' END AS source,
 CASE WHEN turn % 3 = 2 THEN 'helper' ELSE 'main' END AS kind, CASE WHEN length(text) % 3 = 0 THEN length(text) % 7 ELSE 0 END AS ents, (conv_id // 3)::VARCHAR AS cid FROM conversations)"""


@query(
    "current_exchange_findings",
    "AUD-14",
    f"""{_EDITOR}, b AS (SELECT *, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY cid ORDER BY id DESC) AS behind FROM i WHERE source = 'cursor')
    SELECT cid AS conversation_id, coalesce(bool_or(ents > 0) FILTER (behind = 0), false) AS had_pii FROM b GROUP BY 1""",
)
def current_exchange_findings(spark, sf):
    return q.current_exchange_pii(_editor(spark, sf))


_EXCHANGES = f"""{_EDITOR}, t AS (SELECT id, cid, kind, ents, CASE WHEN role = 'system' THEN 0 ELSE 1 END AS n, (role = 'user')::INT AS nu, (role = 'assistant')::INT AS na FROM i),
e AS (SELECT *, sum(CASE WHEN kind = 'main' AND nu > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY cid ORDER BY id)::BIGINT AS exchange FROM t)"""


@query("split_exchanges", "CNV-21", f"{_EXCHANGES} SELECT cid AS conversation_id, id, exchange FROM e")
def split_exchanges(spark, sf):
    return x.split_exchanges(_editor(spark, sf)).select("conversation_id", "id", "exchange")


@query(
    "summarize_exchanges",
    "CNV-22",
    f"""{_EXCHANGES}, f AS (SELECT cid, exchange, min(id) AS first, coalesce(max(id) FILTER (kind = 'main'), max(id) FILTER (na > 0)) AS final FROM e GROUP BY 1, 2),
    g AS (SELECT e.*, f.first, f.final, max(CASE WHEN id = f.first THEN nu END) OVER (PARTITION BY e.cid, e.exchange) > 0 AS has_user FROM e JOIN f USING (cid, exchange)),
    h AS (SELECT *, CASE WHEN (id = first AND has_user) OR id IS NOT DISTINCT FROM final THEN n - CASE WHEN id = first AND has_user THEN nu ELSE 0 END - CASE WHEN id IS NOT DISTINCT FROM final THEN na ELSE 0 END > 0 ELSE true END AS stays FROM g)
    SELECT cid AS conversation_id, exchange, count(*) AS turns, count(*) FILTER (stays AND kind = 'main') AS agent_steps, count(*) FILTER (stays AND kind <> 'main') AS background_calls,
    coalesce(sum(ents) FILTER (stays), 0)::BIGINT AS folded_entities, max(final) AS final_turn FROM h GROUP BY 1, 2""",
)
def summarize_exchanges(spark, sf):
    return x.summarize_exchanges(x.split_exchanges(_editor(spark, sf)))


# --- dashboards -------------------------------------------------------------


@query(
    "filter_values",
    "AUD-15",
    sql(
        " UNION ".join(
            [f"SELECT '{k}' AS field, {v} AS value FROM inter WHERE length({v}) > 0" for k, v in q.FACETS.items()]
            + ["SELECT 'entity_types', entity_type FROM det WHERE length(entity_type) > 0"]
        )
    ),
)
def filter_values(spark, sf):
    return q.distinct_values(audit(spark, sf))


@query(
    "group_counts",
    "AUD-16",
    sql(" UNION ALL ".join(f"SELECT '{c}' AS facet, {c} AS value, count(*) AS n FROM inter WHERE {c} IS NOT NULL GROUP BY 2" for c in ("source", "wire_format", "policy", "model"))),
)
def group_counts(spark, sf):
    return q.group_counts(audit(spark, sf))


@query("token_totals", "AUD-17", sql("SELECT coalesce(sum(input_tokens), 0)::BIGINT AS input, coalesce(sum(output_tokens), 0)::BIGINT AS output FROM inter"))
def token_totals(spark, sf):
    return q.token_totals(audit(spark, sf))


@query(
    "daily_series",
    "AUD-18",
    sql("SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS interactions, coalesce(sum(entity_total), 0)::BIGINT AS entities FROM inter GROUP BY 1"),
)
def daily_series(spark, sf):
    return q.daily_series(audit(spark, sf))


@query("ranked_entity_types", "AUD-19", sql("SELECT entity_type, sum(count)::BIGINT AS total FROM det GROUP BY 1"))
def ranked_entity_types(spark, sf):
    return q.ranked_totals(audit(spark, sf))


@query(
    "browse_texts",
    "AUD-20",
    sql(f"""SELECT t.interaction_id, {iso_sql('created_at')} AS "when", source, model, seq, category, NULL::VARCHAR AS original, md5(anonymized) AS anonymized
    FROM (SELECT * FROM inter WHERE kind = 'main' ORDER BY created_at DESC, id LIMIT 500) i JOIN txt t ON t.interaction_id = i.id WHERE category = 'user'"""),
)
def browse_texts(spark, sf):
    rows = q.browse_texts(audit(spark, sf), 500, "user", kinds=["main"])
    return rows.select("interaction_id", iso("when").alias("when"), "source", "model", "seq", "category", "original", F.md5("anonymized").alias("anonymized"))


@query(
    "expose_texts",
    "AUD-21",
    sql("SELECT id, CASE WHEN true THEN NULL::VARCHAR ELSE original END AS original, md5(anonymized) AS anonymized, true AS redacted FROM txt"),
)
def expose_texts(spark, sf):
    return q.expose(audit(spark, sf).text, False).select("id", "original", F.md5("anonymized").alias("anonymized"), "redacted")


def _rolled(spark, sf):
    """Three batches, one of them without parts and one written twice, and a deleted row."""
    path = _scratch(spark, "rolled")
    whole = audit(spark, sf)
    for batch in (0, 1, 1, 2):
        own, child = F.col("id") % 3 == batch, F.col("interaction_id") % 3 == batch
        some = Audit(whole.interaction.filter(own), whole.detection.filter(child), whole.text.filter(child))
        st.append_audit(some, path, batch=f"b{batch}", rolled=batch < 2)
    st.delete_interaction(spark, path, 7)
    return ru.read_rollups(spark, path)


_KEPT = f"WITH {AUDIT_SQL}, kept AS (SELECT * FROM inter WHERE id <> 7), found AS (SELECT * FROM det WHERE interaction_id <> 7)"


@query("rolled_conversations", "AUD-12 SNK-06", f"{_KEPT} {CONV_SQL.replace('inter i', 'kept i').format(where='conversation_id IS NOT NULL')}")
def rolled_conversations(spark, sf):
    return _conv(ru.summarize_conversations(_rolled(spark, sf)))


@query(
    "rolled_dashboard",
    "AUD-01 AUD-15 AUD-16 AUD-17 AUD-18 AUD-19",
    f"""{_KEPT} SELECT 'summary' AS figure, '' AS field, '' AS value, (SELECT count(*) FROM kept) AS n, (SELECT sum(count) FROM found)::BIGINT AS total
    UNION ALL SELECT 'day', '', strftime(created_at, '%Y-%m-%d'), count(*), coalesce(sum(entity_total), 0)::BIGINT FROM kept GROUP BY ALL
    UNION ALL SELECT 'tokens', '', '', coalesce(sum(input_tokens), 0)::BIGINT, coalesce(sum(output_tokens), 0)::BIGINT FROM kept
    UNION ALL SELECT 'type', '', entity_type, sum(count)::BIGINT, 0 FROM found GROUP BY ALL
    """
    + " ".join(f"UNION ALL SELECT 'group', '{c}', {c}, count(*), 0 FROM kept WHERE {c} IS NOT NULL GROUP BY ALL" for c in ("source", "wire_format", "policy", "model"))
    + " ".join(f" UNION ALL SELECT DISTINCT 'value', '{k}', {c}, 0, 0 FROM kept WHERE length({c}) > 0" for k, c in q.FACETS.items())
    + " UNION ALL SELECT DISTINCT 'value', 'entity_types', entity_type, 0, 0 FROM found WHERE length(entity_type) > 0",
)
def rolled_dashboard(spark, sf):
    r = _rolled(spark, sf)
    none, zero = F.lit(""), F.lit(0).cast("bigint")
    figures = [
        ru.summary(r).select(F.lit("summary"), none, none, "interactions", "entities_total"),
        ru.daily_series(r).select(F.lit("day"), none, "date", "interactions", "entities"),
        ru.token_totals(r).select(F.lit("tokens"), none, none, "input", "output"),
        ru.ranked_totals(r).select(F.lit("type"), none, "entity_type", "total", zero),
        ru.group_counts(r).select(F.lit("group"), "facet", "value", "n", zero),
        ru.distinct_values(r).select(F.lit("value"), "field", "value", zero, zero),
    ]
    return reduce(lambda x, y: x.union(y), figures).toDF("figure", "field", "value", "n", "total")


# --- rules over captured rows -----------------------------------------------


@query(
    "keep_texts",
    "CNV-09",
    sql("SELECT id, category FROM txt WHERE length(original) > 0 AND (category = 'assistant' OR original <> anonymized)"),
)
def kept_texts(spark, sf):
    rows = audit(spark, sf).text.withColumn("t", F.array(F.struct("category", "original", "anonymized")))
    return rows.select("id", F.explode(keep_texts(F.col("t"), "anonymized")).alias("k")).select("id", "k.category")


@query(
    "label_sources",
    "CNV-10",
    """SELECT o_orderkey AS id, coalesce(nullif(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END, ''), CASE WHEN o_orderkey % 5 = 0 THEN 'legacy' END,
    ['claude-code', 'openai-chat', 'codex'][o_orderkey % 3 + 1]) AS source FROM orders""",
)
def label_sources(spark, sf):
    o = F.col("o_orderkey")
    wire = F.get(F.array(F.lit("anthropic"), F.lit("openai_chat"), F.lit("openai_responses")), (o % 3).cast("int"))
    declared = F.when(o % 3 == 0, F.col("o_orderpriority")).otherwise("")
    legacy = F.when(o % 5 == 0, "legacy")
    return table(spark, sf, "orders").select(o.alias("id"), source_of(wire, declared, legacy).alias("source"))


@query(
    "known_conversations",
    "CNV-17",
    sql("SELECT c_custkey::VARCHAR AS session_hint FROM customer WHERE c_custkey::VARCHAR IN (SELECT conversation_id FROM inter WHERE conversation_id IS NOT NULL)"),
)
def known_conversations(spark, sf):
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("session_hint"))
    return q.known_ids(audit(spark, sf), wanted)
