"""Detection queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalog.inputs import WORD, found_sql, greedy_sql, made_spans, rendered_sql, pieces_sql, span_rows, vault_sql, word_spans, words_sql, MADE_SQL
from catalog.registry import query, table
from hushframe.functions.spans import choose_spans, dedupe_spans, find_spans, merge_spans, resolve_spans, trim_spans, with_labels
from hushframe.operators import checksum as c
from hushframe.operators.detectors import deterministic, explode_spans, preview, scan_report, with_spans
from hushframe.operators.secrets import RULES, rule_spans


def _docs(spark, sf, text: Column | None = None):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs if text is None else docs.withColumn("text", text)


def _rows(df, detect):
    found = explode_spans(with_spans(df, detect), keep=["doc_id"])
    return found.select("doc_id", "label", F.col("start").alias("begin_at"), F.col("end").alias("end_at"), "value")


def _sql(rows: str, where: str = "true", label: str = "label") -> str:
    return f"SELECT key AS doc_id, {label} AS label, begin_at, end_at, value FROM ({rows}) WHERE {where}"


# A Unicode word character, for what RE2 cannot say with \b or \w.
_W = r"\p{L}\p{N}_"
LUHN_SQL = (
    "list_sum([CASE WHEN i % 2 = 0 THEN CASE WHEN 2 * x > 9 THEN 2 * x - 9 ELSE 2 * x END ELSE x END "
    "for x, i in [substr(reverse(regexp_replace(value, '[ -]', '', 'g')), k, 1)::INT for k in range(1, length(regexp_replace(value, '[ -]', '', 'g')) + 1)]]) % 10 = 0"
)
# every separator is followed by the filler, so the pattern allows for it
CARD_SQL = found_sql(
    "documents", "doc_id", "text", r"(?:[0-9](?:[ \-]\x{E003})?){12,18}[0-9]", r"^|[^0-9.]", r"$|[^0-9.]", r"^0-9."
)
PHONE_SQL = found_sql(
    "documents", "doc_id", "text", r"\+[1-9][0-9]{0,2}(?:[ \-]?\(?[0-9]{1,4}\)?){2,6}", rf"^|[^{_W}+]", r"$|[^0-9]", r"^0-9 +()\-"
)
PHONE_OK = "length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 8 AND 15"

# Texts with a made-up number at the end, for rules the documents have no hit for.
def iban_text() -> Column:
    d = F.col("doc_id")
    check, last = F.lpad((d % 100).cast("string"), 2, "0"), (F.floor(d / 100) % 10).cast("string")
    return F.concat("text", F.lit(" iban DE"), check, F.lit("37040044053201300"), last, F.lit(" end"))


IBAN_SRC = "(SELECT doc_id, text || ' iban DE' || lpad((doc_id % 100)::VARCHAR, 2, '0') || '37040044053201300' || (doc_id // 100 % 10) || ' end' AS text FROM documents)"
IBAN_SQL = found_sql(IBAN_SRC, "doc_id", "text", r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{2,4}){3,8}", rf"^|[^{_W}]", rf"$|[^{_W}]", rf"^{_W} ")
IBAN_OK = (
    "length(replace(value, ' ', '')) BETWEEN 15 AND 34 AND list_reduce([0] || [instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "substr(replace(value, ' ', '')[5:] || replace(value, ' ', '')[:4], k, 1)) - 1 for k in range(1, length(replace(value, ' ', '')) + 1)], "
    "lambda acc, x: (acc * CASE WHEN x >= 10 THEN 100 ELSE 10 END + x) % 97) = 1"
)


def ssn_text() -> Column:
    d = F.col("doc_id")
    part = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat("text", F.lit(" ssn "), part(d % 1000, 3), F.lit("-"), part(d % 50, 2), F.lit("-"), part(d * 7 % 10000, 4))


SSN_SRC = (
    "(SELECT doc_id, text || ' ssn ' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || '-' || lpad((doc_id % 50)::VARCHAR, 2, '0') || '-' "
    "|| lpad((doc_id * 7 % 10000)::VARCHAR, 4, '0') AS text FROM documents)"
)
SSN_SQL = found_sql(SSN_SRC, "doc_id", "text", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", rf"^|[^{_W}]", rf"$|[^{_W}]", rf"^{_W}\-")
SSN_OK = "value[:3] NOT IN ('000', '666') AND value[1] <> '9' AND value[5:6] <> '00' AND value[8:] <> '0000'"


@query("find_pattern_spans", "DET-01", _sql(words_sql()))
def find_pattern_spans(spark, sf):
    return _rows(_docs(spark, sf), word_spans)


@query("detect_payment_cards", "DET-02", _sql(CARD_SQL, LUHN_SQL, "'PAYMENT_CARD'"))
def detect_payment_cards(spark, sf):
    return _rows(_docs(spark, sf), c.card_spans)


@query("detect_ibans", "DET-03", _sql(IBAN_SQL, IBAN_OK, "'BANK_ACCOUNT_IDENTIFIER'"))
def detect_ibans(spark, sf):
    return _rows(_docs(spark, sf, iban_text()), c.iban_spans)


@query("detect_phones", "DET-04", _sql(PHONE_SQL, PHONE_OK, "'PHONE_NUMBER'"))
def detect_phones(spark, sf):
    return _rows(_docs(spark, sf), c.phone_spans)


@query("detect_ssns", "DET-05", _sql(SSN_SQL, SSN_OK, "'PERSON_IDENTIFIER'"))
def detect_ssns(spark, sf):
    return _rows(_docs(spark, sf, ssn_text()), c.ssn_spans)


# --- credentials ------------------------------------------------------------
#
# Each document gets one token at its end, its kind by doc_id, made from md5.

_HEX = "md5(doc_id::VARCHAR)"
_TOKENS = {  # kind: (prefix, repetitions of the hash, characters kept, upper case)
    0: ("AKIA", 1, 16, True), 1: ("AIza", 2, 35, False), 2: ("ghp_", 2, 36, False), 3: ("glpat-", 1, 20, False),
    4: ("sk-ant-", 1, 24, False), 5: ("sk-proj-", 1, 24, False), 6: ("hf_", 2, 34, False), 7: ("xoxb-", 1, 20, False),
    8: ("sk_live_", 1, 24, False), 9: ("npm_", 2, 36, False), 10: ("pypi-", 2, 50, False), 11: ("eyJ", 1, 30, False),
}


def _token_col() -> Column:
    h = F.md5(F.col("doc_id").cast("string"))
    out = None
    for kind, (prefix, times, n, up) in _TOKENS.items():
        body = F.left(F.repeat(h, times), F.lit(n))
        token = F.concat(F.lit(prefix), F.upper(body) if up else body)
        test = F.col("doc_id") % 12 == kind
        out = F.when(test, token) if out is None else out.when(test, token)
    return F.concat("text", F.lit(" key "), out, F.lit(" end"))


def _token_sql() -> str:
    arms = " ".join(
        f"WHEN {k} THEN '{p}' || {'upper' if up else ''}(left(repeat({_HEX}, {t}), {n}))" for k, (p, t, n, up) in _TOKENS.items()
    )
    return f"(SELECT doc_id, text || ' key ' || CASE doc_id % 12 {arms} END || ' end' AS text FROM documents)"


# The provider rules written once more for RE2, whose matches consume their edges.
_RE2 = {
    "SECRET_AWS_ACCESS_KEY": "(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}",
    "SECRET_GCP_API_KEY": r"AIza[A-Za-z0-9_\-]{35}",
    "SECRET_GITHUB_TOKEN": "gh[pousr]_[A-Za-z0-9]{36,}",
    "SECRET_GITLAB_TOKEN": r"glpat-[A-Za-z0-9_\-]{20,}",
    "SECRET_ANTHROPIC_KEY": r"sk-ant-[A-Za-z0-9_\-]{20,}",
    "SECRET_OPENAI_KEY": r"sk-proj-[A-Za-z0-9_\-]{20,}",
    "SECRET_HUGGINGFACE_TOKEN": "hf_[A-Za-z0-9]{34,}",
    "SECRET_SLACK_TOKEN": r"xox[abposr]-[A-Za-z0-9\-]{10,}",
    "SECRET_STRIPE_KEY": "[rs]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "SECRET_NPM_TOKEN": "npm_[A-Za-z0-9]{36}",
    "SECRET_PYPI_TOKEN": r"pypi-[A-Za-z0-9_\-]{50,}",
}
_TOKEN_PAD = r"^A-Za-z0-9_\-"
_PROVIDER_SQL = " UNION ALL ".join(
    f"SELECT *, '{label}' AS label FROM ({found_sql(_token_sql(), 'doc_id', 'text', pat, '^|[^A-Za-z0-9_]', '$|[^A-Za-z0-9_]', _TOKEN_PAD)})"
    for label, pat in _RE2.items()
)


@query("detect_provider_tokens", "DET-06", _sql(_PROVIDER_SQL))
def detect_provider_tokens(spark, sf):
    rules = [r for r in RULES if r.label not in ("SECRET_GENERIC", "SECRET_URL_CREDENTIAL", "SECRET_AUTH_HEADER")]
    return _rows(_docs(spark, sf, _token_col()), lambda t: rule_spans(t, rules))


_URL_SRC = f"(SELECT doc_id, text || ' db://app:' || {_HEX} || '@host/x' AS text FROM documents)"


@query(
    "detect_url_passwords",
    "DET-07",
    _sql(found_sql(_URL_SRC, "doc_id", "text", r"[^\s/@]+", r"[A-Za-z][A-Za-z0-9+.\-]*://[^\s:/@]*:", "@"), label="'SECRET_URL_CREDENTIAL'"),
)
def detect_url_passwords(spark, sf):
    text = F.concat("text", F.lit(" db://app:"), F.md5(F.col("doc_id").cast("string")), F.lit("@host/x"))
    rules = [r for r in RULES if r.label == "SECRET_URL_CREDENTIAL"]
    return _rows(_docs(spark, sf, text), lambda t: rule_spans(t, rules))


_AUTH_SRC = f"(SELECT doc_id, text || ' Authorization: Bearer ' || {_HEX} || ' x' AS text FROM documents)"


@query(
    "detect_auth_headers",
    "DET-08",
    _sql(
        found_sql(_AUTH_SRC, "doc_id", "text", r"[A-Za-z0-9_\-.~+/]{8,}=*", r"(?i:authorization)[\x22\x27]?\s*[:=]\s*[\x22\x27]?(?i:(?:bearer|basic|token)\s+)?"),
        label="'SECRET_AUTH_HEADER'",
    ),
)
def detect_auth_headers(spark, sf):
    text = F.concat("text", F.lit(" Authorization: Bearer "), F.md5(F.col("doc_id").cast("string")), F.lit(" x"))
    rules = [r for r in RULES if r.label == "SECRET_AUTH_HEADER"]
    return _rows(_docs(spark, sf, text), lambda t: rule_spans(t, rules))


_GENERIC = found_sql(
    "documents", "doc_id", "text", r"[A-Za-z0-9_\-.+/]{10,}={0,2}",
    r"(?i:api[_\-]?key|secret|token|passw(?:or)?d|credential|access[_\-]?key)[A-Za-z0-9_\-]*[\x22\x27]?\s*(?:=>|:=|=|:)\s*[\x22\x27]?",
)
_ENTROPY = (
    "list_sum([-(n / length(value)) * log2(n / length(value)) for n in [(length(value) - length(replace(value, ch, '')))::DOUBLE "
    "for ch in list_distinct(string_split(value, ''))]]) >= 3.5"
)


@query("detect_generic_secrets", "DET-09", _sql(_GENERIC, _ENTROPY, "'SECRET_GENERIC'"))
def detect_generic_secrets(spark, sf):
    rules = [r for r in RULES if r.label == "SECRET_GENERIC"]
    return _rows(_docs(spark, sf), lambda t: rule_spans(t, rules))


@query(
    "order_checksum_spans",
    "DET-10",
    f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY begin_at, begin_at - end_at, rule) - 1)::BIGINT AS pos, label, begin_at, end_at FROM (
    SELECT *, 1 AS rule FROM ({_sql(CARD_SQL, LUHN_SQL, "'PAYMENT_CARD'")})
    UNION ALL SELECT *, 3 FROM ({_sql(PHONE_SQL, PHONE_OK, "'PHONE_NUMBER'")}))""",
)
def order_checksum_spans(spark, sf):
    df = with_spans(_docs(spark, sf), c.checksum_spans)
    return df.select("doc_id", F.posexplode("spans").alias("pos", "s")).select(
        "doc_id", "pos", F.col("s.label").alias("label"), F.col("s.start").alias("begin_at"), F.col("s.end").alias("end_at")
    )


@query(
    "resolve_overlaps",
    "DET-11",
    greedy_sql("starts_with(label, 'SECRET_') DESC, e - s DESC, score DESC, j", "m.s < k.e AND k.s < m.e").format(where="true"),
)
def resolve_overlaps(spark, sf):
    df = made_spans(spark, sf)
    return span_rows(df, resolve_spans(F.col("spans")))


@query("detect_deterministic", "DET-11 DET-06 DET-10")
def detect_deterministic(spark, sf):
    return _rows(_docs(spark, sf), deterministic)


_CAPS = r"[A-Z]\S*"


@query(
    "trim_span_ends",
    "DET-13",
    f"""SELECT key AS doc_id, begin_at, begin_at + length(kept) AS end_at, kept AS value FROM (
    SELECT *, regexp_replace(value, '[^\\p{{L}}\\p{{N}}]+$', '') AS kept FROM ({found_sql("documents", "doc_id", "text", _CAPS)})) WHERE length(kept) > 0""",
)
def trim_span_ends(spark, sf):
    df = _docs(spark, sf).withColumn("spans", find_spans(F.col("text"), _CAPS, "CAPS"))
    df = df.withColumn("spans", trim_spans(F.col("text"), F.col("spans")))
    return explode_spans(df, keep=["doc_id"]).select("doc_id", F.col("start").alias("begin_at"), F.col("end").alias("end_at"), "value")


# Over a text of letters only, trimming changes nothing and the kept ends can be told by arithmetic.
@query("dedupe_tagger_spans", "DET-14", greedy_sql("s, s - e, j", "m.s < k.e AND k.s <= m.s").format(where="score >= 0.5 AND e > s"))
def dedupe_tagger_spans(spark, sf):
    df = made_spans(spark, sf).withColumn("text", F.repeat(F.lit("x"), 80))
    return span_rows(df, dedupe_spans(F.col("text"), F.col("spans"), 0.5))


@query("choose_vault_spans", "VLT-02", greedy_sql("s, e, j", "m.s < k.e").format(where="e > s"))
def choose_vault_spans(spark, sf):
    df = made_spans(spark, sf)
    return span_rows(df, choose_spans(F.col("spans")))


@query(
    "merge_touching_spans",
    "RED-03",
    f"""WITH {MADE_SQL}, o AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM made),
    g AS (SELECT *, sum(CASE WHEN prev IS NULL OR s > prev THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e, j) AS island FROM o)
    SELECT doc_id, min(s) AS begin_at, max(e) AS end_at, arg_min(label, (s, e, j)) AS label, round(min(score) * 10)::BIGINT AS score FROM g GROUP BY doc_id, island""",
)
def merge_touching_spans(spark, sf):
    df = made_spans(spark, sf).select("doc_id", F.explode(merge_spans(F.col("spans"))).alias("s"))
    return df.select(
        "doc_id", F.col("s.start").alias("begin_at"), F.col("s.end").alias("end_at"), F.col("s.label").alias("label"),
        F.round(F.col("s.score") * 10).cast("bigint").alias("score"),
    )


@query("filter_labels", "DET-15", f"WITH {MADE_SQL} SELECT doc_id, s AS begin_at, e AS end_at, label FROM made WHERE label IN ('B', 'SECRET_A') AND label <> 'SECRET_A'")
def filter_labels(spark, sf):
    df = made_spans(spark, sf)
    return span_rows(df, with_labels(F.col("spans"), ["B", "SECRET_A"], ["SECRET_A"]))


_BREAK = r"[.]\n[A-Z]"


@query(
    "scan_report",
    "DET-16",
    f"SELECT key AS doc_id, begin_at, end_at, 'BREAK' AS label, 100::BIGINT AS score, replace(value, chr(10), ' ') AS snippet FROM ({found_sql('documents', 'doc_id', 'text', _BREAK)})",
)
def scan(spark, sf):
    rows = scan_report(_docs(spark, sf), lambda t: find_spans(t, _BREAK, "BREAK"), ["doc_id"])
    return rows.select(
        "doc_id", F.col("start").alias("begin_at"), F.col("end").alias("end_at"), "label", F.round(F.col("score") * 100).cast("bigint").alias("score"), "snippet"
    )


ROW_VAULT_SQL = vault_sql(words_sql(), "key", "begin_at")


@query(
    "preview_rows",
    "DET-17",
    f"""WITH v AS ({ROW_VAULT_SQL}), r AS ({rendered_sql(pieces_sql("documents", "doc_id", "text", WORD), "SELECT scope AS key, value, placeholder AS name FROM v")}),
    c AS (SELECT scope, string_agg(label || ':' || n, ',' ORDER BY label) AS counts FROM (SELECT scope, label, count(*) AS n FROM v GROUP BY ALL) GROUP BY 1),
    s AS (SELECT key, count(*) AS n FROM ({words_sql()}) GROUP BY 1)
    SELECT r.key AS doc_id, md5(rendered) AS anonymized, coalesce(counts, '') AS counts, coalesce(s.n, 0)::BIGINT AS n_spans FROM r LEFT JOIN c ON r.key = c.scope LEFT JOIN s ON s.key = r.key""",
)
def preview_rows(spark, sf):
    from catalog.inputs import counts_text

    rows = preview(_docs(spark, sf), word_spans)
    return rows.select("doc_id", F.md5("anonymized").alias("anonymized"), counts_text(F.col("counts")).alias("counts"), F.size("spans").alias("n_spans"))


@query(
    "detect_long_secrets",
    "DET-06 DET-09",
    """SELECT doc_id, 8::BIGINT AS begin_at, 328::BIGINT AS end_at, 'SECRET_GENERIC' AS label FROM documents
    UNION ALL SELECT doc_id, 329::BIGINT, 653::BIGINT, 'SECRET_GITHUB_TOKEN' FROM documents""",
)
def detect_long_secrets(spark, sf):
    """Values of 320 characters are found whole."""
    value = F.repeat(F.sha2("text", 256), F.lit(5))
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("api_key="), value, F.lit(" ghp_"), value).alias("text"))
    found = docs.select("doc_id", F.explode(rule_spans(F.col("text"))).alias("s"))
    return found.select("doc_id", F.col("s.start").cast("bigint").alias("begin_at"), F.col("s.end").cast("bigint").alias("end_at"), "s.label")
