"""Audit of request logs: every request is judged, rendered and counted inside its own row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.spans import choose_spans
from hushframe.functions.text import is_blank, let, once
from hushframe.operators.detectors import Detector
from hushframe.operators.ordered import lookup, running_sum
from hushframe.operators.policy import blocked_counts, hook_verdict
from hushframe.operators.row_vault import pseudonymize_row, pseudonymize_segments, restore_row, value_map
from hushframe.plans.audit import Audit
from hushframe.plans.language import detect_language
from hushframe.plans.store import ID, record_id
from hushframe.session import materialize
from hushframe.sources.bodies import request_places, respliced, response_places, with_tokens
from hushframe.sources.requests import hook_events, parsed, restore_texts, with_facts

SAVED = "array<struct<category:string,original:string,anonymized:string>>"


def keep_texts(texts: Column, mode: str) -> Column:
    """Which captured texts are saved: none empty; assistant always; with ``anonymized`` only changed ones."""

    def keep(t: Column) -> Column:
        rule = (t["category"] == "assistant") | F.lit(mode == "all") | (t["original"] != t["anonymized"])
        return (F.length(t["original"]) > 0) & rule

    return F.filter(texts, keep)


def judge_requests(
    requests: DataFrame,
    detect: Detector,
    action: Callable[[Column], Column],
    mode: str = "pseudonymize",
    save: str = "anonymized",
) -> DataFrame:
    """Records for the audit tables, with the forwarded texts and the block tally beside them.

    Two numberings per request: ``forwarded`` over all history it carries, and
    the saved texts and counts over its new user and tool segments only. A
    request with a blocked finding is refused: no reply, no usage, policy
    ``block``. One projection, no shuffle.
    """
    df = with_facts(requests)
    df = df.withColumn(
        "segments",
        once(
            F.transform(
                "segments",
                lambda g: F.struct(
                    g["author"].alias("author"), g["novel"].alias("novel"), g["text"].alias("text"), choose_spans(detect(g["text"])).alias("spans")
                ),
            )
        ),
    )
    fresh = F.filter("segments", lambda g: g["novel"] & g["author"].isin("user", "tool"))
    df = df.withColumn("fresh", fresh)
    df = df.withColumn("forward", once(pseudonymize_segments(F.col("segments"), action)))
    df = df.withColumn("saved", once(pseudonymize_segments(F.col("fresh"))))
    every = F.flatten(F.transform("segments", lambda g: g["spans"]))
    df = df.withColumn("blocked", blocked_counts(every, action))
    refused = F.size("blocked") > 0
    df = df.withColumn("answer", once(restore_texts(F.col("reply"), value_map(F.col("forward.vault")))))

    captured = let(
        F.col("saved.texts"),
        lambda done: F.transform(
            "fresh",
            lambda g, i: F.struct(g["author"].alias("category"), g["text"].alias("original"), F.get(done, i).alias("anonymized")),
        ),
    ).cast(SAVED)
    answer = F.array(
        F.struct(
            F.lit("assistant").alias("category"),
            F.array_join(F.transform("answer", lambda t: t["original"]), "").alias("original"),
            F.array_join(F.transform("answer", lambda t: t["anonymized"]), "").alias("anonymized"),
        )
    ).cast(SAVED)
    wanted = ~refused & (F.lit(save == "all") | (F.size("saved.counts") > 0))
    answer = F.filter(answer, lambda t: wanted & ~is_blank(t["original"]))
    texts = keep_texts(F.concat(captured, answer), save)
    return df.select(
        record_id(F.col("request_id")).alias("id"),
        "request_id",
        F.col("ts").alias("created_at"),
        "source",
        "wire_format",
        "kind",
        "model",
        F.when(refused, "block").otherwise(mode).alias("policy"),
        F.when(~refused, F.col("usage.input_tokens")).alias("input_tokens"),
        F.when(~refused, F.col("usage.output_tokens")).alias("output_tokens"),
        F.col("saved.counts").alias("entity_counts"),
        "conversation_id",
        once(texts).alias("texts"),
        refused.alias("refused"),
        "blocked",
        F.when(~refused, F.col("forward.texts")).alias("forwarded"),
        F.array_join(F.transform(F.filter("fresh", lambda g: F.length(g["text"]) > 0), lambda g: g["text"]), " ").alias("human_text"),
    )


def rewrite_exchanges(requests: DataFrame, detect: Detector, action: Callable[[Column], Column]) -> DataFrame:
    """request_id, refused, and the bodies as they travel: ``body`` with pseudonyms, ``response`` with the values put back.

    Both are the original text but for the strings that change. A request with a blocked finding is refused and has
    neither; a body that is no JSON object gives no row, a response that is none stays as it is. One projection, no shuffle.
    """
    df = with_tokens(parsed(requests), F.col("body"), "__tokens")
    readable = F.schema_of_variant(F.try_parse_json(F.col("response"))).startswith("OBJECT")
    df = with_tokens(df, F.when(readable, F.col("response")), "__reply")
    wire = F.col("wire_format")
    spans = lambda g: choose_spans(detect(g["text"]))
    places = F.transform(request_places(wire, F.col("__tokens")), lambda g: F.struct(g["start"], g["end"], g["label"], g["kept"], g["text"], spans(g).alias("spans")))
    df = df.withColumn("__places", once(places)).withColumn("__forward", once(pseudonymize_segments(F.col("__places"), action)))
    every = F.flatten(F.transform("__places", lambda g: g["spans"]))
    refused = F.size(blocked_counts(every, action)) > 0
    back = let(
        value_map(F.col("__forward.vault")),
        lambda m: let(response_places(wire, F.col("__reply")), lambda ps: respliced(F.col("response"), ps, F.transform(ps, lambda p: restore_row(p["text"], m)))),
    )
    return df.select(
        "request_id",
        refused.alias("refused"),
        F.when(~refused, respliced(F.col("body"), F.col("__places"), F.col("__forward.texts"))).alias("body"),
        F.when(~refused, back).alias("response"),
    )


def with_language(records: DataFrame, profiles: DataFrame) -> DataFrame:
    """``records`` of ``judge_requests`` plus the language of their human texts, so that filters and facets find it."""
    records = materialize(records)
    return records.join(detect_language(records.select("id", "human_text"), profiles, ["id"], "human_text"), "id", "left")


def exchange_states(rows: DataFrame) -> DataFrame:
    """(id, open): had the current exchange of the row's conversation findings just before the row?

    ``rows``: id, conversation_id, at, step. Rows are taken by (at, id), and ``step`` says what each does to the state:
    ``set``, ``clear``, ``flip``, or null for nothing; it starts as not open. The state before a row is what the last
    ``set`` or ``clear`` left, turned once for each ``flip`` since, so two running sums give it for conversations of any length.
    """
    fixed, flips = F.col("step").isin("set", "clear"), F.col("step") == "flip"
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    known = running_sum(rows.withColumn("__fixed", one(fixed)).withColumn("__flip", one(flips)), ["conversation_id"], ["at", "id"], F.col("__fixed"), "__n")
    known = materialize(running_sum(known, ["conversation_id"], ["at", "id"], F.col("__flip"), "__f"))
    before = known.select("*", (F.col("__n") - F.col("__fixed")).alias("__after"), (F.col("__f") - F.col("__flip")).alias("__flips"))
    uses = before.groupBy("conversation_id", "__after").agg(F.count(F.lit(1)).alias("uses"))
    marks = known.filter("__fixed = 1").select("conversation_id", F.col("__n").alias("__after"), F.struct((F.col("step") == "set").cast("int").alias("open"), F.col("__f").alias("flips")).alias("mark"))
    met = lookup(before, marks.join(uses, ["conversation_id", "__after"]), ["conversation_id", "__after"], "mark")
    turned = F.coalesce(F.col("mark.open"), F.lit(0)) + F.col("__flips") - F.coalesce(F.col("mark.flips"), F.lit(0))
    return met.select("id", (turned % 2 == 1).alias("open"))


def _open_exchanges(df: DataFrame, history: Audit, save: str) -> DataFrame:
    """(id, open) for the events of ``df``, by what its conversations had up to each event, in ``history`` and in ``df``."""
    # only the conversations at hand are looked up
    asked = df.select("conversation_id").distinct()
    part = history.interaction.filter(F.col("source") == "cursor").join(asked, "conversation_id", "left_semi")
    answered = history.text.filter(F.col("category") == "assistant").select(F.col("interaction_id").alias("id")).distinct()
    past = part.join(answered.withColumn("answered", F.lit(True)), "id", "left")
    step = F.when(F.col("answered"), "clear").when(F.col("entity_total") > 0, "set")
    past = past.select(F.col("id").cast(ID).alias("id"), "conversation_id", F.col("created_at").alias("at"), step.alias("step"), F.lit(False).alias("own"))
    found = F.size("done.counts") > 0
    # a reply is kept if the exchange had findings, and then ends it; one that is not kept counts by its own findings
    reply = F.when(is_blank(F.col("text")), None).when(F.lit(save == "all") | ~found, "clear").otherwise("flip")
    step = F.when(F.col("event") == "afterAgentResponse", reply).when(found, "set")
    now = df.filter(F.col("conversation_id").isNotNull()).select(F.col("id").cast(ID).alias("id"), "conversation_id", F.col("at"), step.alias("step"), F.lit(True).alias("own"))
    every = materialize(past.unionByName(now))
    return exchange_states(every.drop("own")).join(every.filter("own").select("id"), "id", "left_semi")


def judge_hooks(
    events: DataFrame,
    detect: Detector,
    action: Callable[[Column], Column],
    history: Audit | None = None,
    mode: str = "pseudonymize",
    save: str = "anonymized",
    block_all: bool = False,
) -> DataFrame:
    """Records of editor hook events, each with its allow/deny verdict.

    A reply is saved when everything is, or when the current exchange of its
    conversation had findings: in ``history`` and in the events themselves, up to
    the reply. Events have their time in ``ts``; without it all are of now. An
    event that ``history`` holds already must not be given again.
    """
    df = hook_events(events)
    df = df.withColumn("spans", once(choose_spans(detect(F.col("text"))))).withColumn(
        "done", once(pseudonymize_row(F.col("text"), F.col("spans")))
    )
    if history is not None:
        at = F.col("ts") if "ts" in events.columns else F.current_timestamp()
        df = materialize(df.withColumn("id", record_id(F.col("event_id"))).withColumn("at", at))
        df = df.join(_open_exchanges(df, history, save).withColumnRenamed("open", "had_pii"), "id", "left")
    else:
        df = df.withColumn("had_pii", F.lit(False))
    reply = F.col("event") == "afterAgentResponse"
    changed = F.col("text") != F.col("done.text")
    stored = F.when(
        reply, ~is_blank(F.col("text")) & (F.lit(save == "all") | F.coalesce("had_pii", F.lit(False)))
    ).otherwise(F.lit(save == "all") | changed)
    text = F.struct("category", F.col("text").alias("original"), F.col("done.text").alias("anonymized"))
    return df.select(
        record_id(F.col("event_id")).alias("id"),
        "event_id",
        F.lit("cursor").alias("source"),
        F.concat(F.lit("cursor:"), "event").alias("wire_format"),
        "model",
        F.lit(mode).alias("policy"),
        F.col("done.counts").alias("entity_counts"),
        "conversation_id",
        F.filter(F.array(text).cast(SAVED), lambda t: stored).alias("texts"),
        hook_verdict(F.col("event"), F.col("done.counts"), action, block_all).alias("verdict"),
    )
