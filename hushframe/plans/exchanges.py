"""A conversation as exchanges: a new user text, the steps after it, the final answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.operators.ordered import running_sum
from hushframe.plans.audit import Audit


def turn_facts(a: Audit) -> DataFrame:
    """Interactions in conversations with counts of their user, assistant and all texts."""
    n = a.text.groupBy(F.col("interaction_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.count_if(F.col("category") == "user").alias("n_user"),
        F.count_if(F.col("category") == "assistant").alias("n_assistant"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        a.interaction.filter(F.col("conversation_id").isNotNull())
        .select("conversation_id", "created_at", "id", "kind", "entity_total")
        .join(n, "id", "left")
        .select("conversation_id", "created_at", "id", "kind", "entity_total", zero("n_texts"), zero("n_user"), zero("n_assistant"))
    )


def split_exchanges(a: Audit) -> DataFrame:
    """Turn facts plus the exchange number; 0 is a leading group without a user text."""
    opens = (F.col("kind") == "main") & (F.col("n_user") > 0)
    return running_sum(turn_facts(a), ["conversation_id"], ["created_at", "id"], opens.cast("int"), "exchange")


def summarize_exchanges(turns: DataFrame) -> DataFrame:
    """Per exchange: turns, agent steps, background calls, entities of the folded part, final turn.

    The final turn is the last main one, else the last with an assistant text.
    Shown apart, and so not folded, are the first turn's user texts and the final
    turn's assistant texts; only these two rows need a look, so one aggregation
    is enough.
    """
    at = F.struct("created_at", "id")
    row = F.struct("id", "kind", "entity_total", "n_texts", "n_user", "n_assistant")
    main = F.col("kind") == "main"
    g = turns.groupBy("conversation_id", "exchange").agg(
        F.count(F.lit(1)).alias("turns"),
        F.count_if(main).alias("mains"),
        F.sum("entity_total").alias("all_entities"),
        F.min_by(row, at).alias("first"),
        F.max_by(row, F.when(main, at)).alias("last_main"),
        F.max_by(row, F.when(F.col("n_assistant") > 0, at)).alias("last_answer"),
    )
    g = g.withColumn("final", F.coalesce("last_main", "last_answer"))
    first, final = F.col("first"), F.col("final")
    same = F.coalesce(first["id"] == final["id"], F.lit(False))
    has_user = first["n_user"] > 0

    def emptied(turn: Column, user: Column, answer: Column) -> Column:
        """Does hiding these texts leave the turn with none?"""
        hidden = F.when(user, turn["n_user"]).otherwise(0) + F.when(answer, turn["n_assistant"]).otherwise(0)
        return F.coalesce((user | answer) & (turn["n_texts"] - hidden <= 0), F.lit(False))

    drop_first = emptied(first, has_user, same)
    drop_final = F.coalesce(final["id"].isNotNull() & ~same, F.lit(False)) & emptied(final, F.lit(False), F.lit(True))

    def dropped(turn: Column, drop: Column, what: Column) -> Column:
        return F.when(drop, what).otherwise(0)

    is_main = lambda t: F.when(t["kind"] == "main", 1).otherwise(0)
    gone_main = dropped(first, drop_first, is_main(first)) + dropped(final, drop_final, is_main(final))
    gone = dropped(first, drop_first, F.lit(1)) + dropped(final, drop_final, F.lit(1))
    gone_entities = dropped(first, drop_first, first["entity_total"]) + dropped(final, drop_final, final["entity_total"])
    return g.select(
        "conversation_id",
        "exchange",
        "turns",
        (F.col("mains") - gone_main).alias("agent_steps"),
        (F.col("turns") - F.col("mains") - (gone - gone_main)).alias("background_calls"),
        (F.col("all_entities") - gone_entities).alias("folded_entities"),
        final["id"].alias("final_turn"),
    )
