"""A token tagger as a Spark job: windows, inference, merging, entities.

The model itself is the caller's: a function that takes padded token ids and a
mask and gives logits. Everything around it is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions.spans import span
from hushframe.functions.text import WHITESPACE, islands, let, pick, running_counts

Model = Callable[[np.ndarray, np.ndarray], np.ndarray]


# --- sub-token windows ------------------------------------------------------


def plan_windows(df: DataFrame, max_tokens: int = 512, stride: int = 128, count: str = "n_tokens") -> DataFrame:
    """One row per window: start positions so that windows overlap by ``stride`` and cover all tokens."""
    if stride >= max_tokens - 2:
        raise ValueError("stride must be smaller than max_tokens - 2")
    window = max_tokens - 2
    step = max(window - stride, 1)
    extra = F.greatest(F.ceil((F.col(count) - window) / F.lit(float(step))), F.lit(0)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), extra), lambda k: k * step)
    return df.filter(F.col(count) > 0).withColumn("window_start", F.explode(starts))


def window_tokens(df: DataFrame, max_tokens: int = 512, stride: int = 128, ids: str = "ids") -> DataFrame:
    """The token ids of each planned window."""
    planned = plan_windows(df.withColumn("n_tokens", F.size(ids)), max_tokens, stride)
    return planned.withColumn(ids, F.slice(ids, F.col("window_start") + 1, max_tokens - 2))


def infer_windows(
    windows: DataFrame,
    model_factory: Callable[[], Model],
    labels: list[str],
    key: list[str],
    cls_id: int = 0,
    sep_id: int = 1,
    pad_id: int = 2,
    batch: int = 8,
) -> DataFrame:
    """Run a model over windows: one row (key, window_start, token, label, score) per token.

    Windows go through the model ``batch`` at a time, padded to the longest; the
    factory is called once per task, so weights load there and are not shipped
    per row.
    """
    schema = T.StructType(
        [f for f in windows.schema.fields if f.name in key]
        + [
            T.StructField("window_start", T.IntegerType()),
            T.StructField("label_ids", T.ArrayType(T.IntegerType())),
            T.StructField("scores", T.ArrayType(T.DoubleType())),
        ]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for frame in frames:
            all_ids, all_scores = [], []
            for lo in range(0, len(frame), batch):
                chunk = [list(x) for x in frame["ids"].iloc[lo : lo + batch]]
                size = max(len(c) for c in chunk) + 2
                tokens = np.full((len(chunk), size), pad_id, dtype=np.int64)
                mask = np.zeros((len(chunk), size), dtype=np.int64)
                for r, c in enumerate(chunk):
                    tokens[r, : len(c) + 2] = [cls_id, *c, sep_id]
                    mask[r, : len(c) + 2] = 1
                logits = model(tokens, mask)
                exp = np.exp(logits - logits.max(axis=-1, keepdims=True))
                probs = exp / exp.sum(axis=-1, keepdims=True)
                for r, c in enumerate(chunk):
                    inner = probs[r, 1 : len(c) + 1]
                    all_ids.append(inner.argmax(axis=-1).astype(np.int32))
                    all_scores.append(inner.max(axis=-1).astype(np.float64))
            yield frame[[*key, "window_start"]].assign(label_ids=all_ids, scores=all_scores)

    raw = windows.select(*key, "window_start", "ids").mapInPandas(run, schema)
    names = F.array(*[F.lit(x) for x in labels])
    return raw.select(
        *key,
        "window_start",
        F.posexplode(F.arrays_zip("label_ids", "scores")).alias("i", "p"),
    ).select(
        *key,
        "window_start",
        (F.col("window_start") + F.col("i")).alias("token"),
        F.get(names, F.col("p.label_ids")).alias("label"),
        F.col("p.scores").alias("score"),
    )


def best_token(preds: DataFrame, key: list[str]) -> DataFrame:
    """The most confident prediction of each token; the earlier window on a tie."""
    best = F.max_by(
        F.struct("label", "score"), F.struct("score", (-F.col("window_start")).alias("w"))
    )
    return preds.groupBy(*key, "token").agg(best.alias("b")).select(*key, "token", "b.label", "b.score")


def tag_type(tag: Column) -> Column:
    """``B-NAME`` -> ``NAME``."""
    return F.when(F.instr(tag, "-") > 0, F.substring(tag, F.instr(tag, "-") + 1, F.length(tag))).otherwise("")


def words(tokens: DataFrame, key: list[str]) -> DataFrame:
    """Whole words from sub-tokens: extent, and the label of the best sub-token that has one."""
    usable = tokens.filter(F.col("word_id").isNotNull() & (F.col("start") < F.col("end")))
    rank = F.when(F.col("label") != "O", F.struct("score", (-F.col("token")).alias("t")))
    return usable.groupBy(*key, "word_id").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.max_by(tag_type(F.col("label")), rank).alias("label"),
        F.coalesce(F.max_by(F.col("score"), rank), F.lit(0.0)).alias("score"),
    )


def word_runs(word_rows: DataFrame, key: list[str]) -> DataFrame:
    """Spans per text: neighbours of one label join; the score is the mean of the words'.

    The words of one text come together in one row, as the spans they become do;
    their number is bounded by that text.
    """

    def runs(ws: Column) -> Column:
        def new(w: Column, i: Column) -> Column:
            return (i == 0) | ~w["label"].eqNullSafe(F.get(ws, i - 1)["label"])

        def one(r: Column) -> Column:
            mine = pick(ws, r)
            total = F.aggregate(mine, F.lit(0.0), lambda acc, w: acc + w["score"])
            first, last = F.get(ws, r["a"]), F.get(ws, r["b"] - 1)
            return span(first["start"], last["end"], first["label"], total / (r["b"] - r["a"]))

        tagged = F.filter(islands(ws, new), lambda r: F.get(ws, r["a"])["label"].isNotNull())
        return F.transform(tagged, one)

    ordered = F.array_sort(F.collect_list(F.struct("start", "end", "label", "score")))
    return word_rows.groupBy(*key).agg(ordered.alias("__w")).select(*key, let(F.col("__w"), runs).alias("spans"))


# --- whole-word chunks and BIO tags -----------------------------------------


def tokens_of(text: Column) -> Column:
    """White-space tokens of a text."""
    blanked = F.translate(text, WHITESPACE, " " * len(WHITESPACE))
    return F.filter(F.split(blanked, " "), lambda t: t != "")


def chunk_words(df: DataFrame, budget: int, overlap: int = 30, counts: str = "counts") -> DataFrame:
    """Chunks of words within a sub-token budget; the next one starts ``overlap`` words back.

    ``counts`` is the array of sub-tokens per word. Adds chunk_no, chunk_start,
    chunk_end rows. The plan of one text is a short scan over its own array, so it
    runs as an Arrow UDF; all else stays in columns.
    """

    @F.pandas_udf("array<struct<chunk_start:int,chunk_end:int>>")
    def plan(col: pd.Series) -> pd.Series:
        def one(c) -> list[tuple[int, int]]:
            total = np.concatenate([[0], np.cumsum(np.asarray(c, dtype=np.int64))])
            n, out, start = len(c), [], 0
            while start < n:
                end = int(np.searchsorted(total, total[start] + budget, side="right")) - 1
                end = min(max(end, start + 1), n)
                out.append((start, end))
                if end >= n:
                    break
                start = max(start + 1, end - overlap)
            return [{"chunk_start": a, "chunk_end": b} for a, b in out]

        return col.map(one)

    return df.select("*", F.posexplode(plan(counts)).alias("chunk_no", "__c")).select(
        *df.columns, "chunk_no", F.col("__c.chunk_start").alias("chunk_start"), F.col("__c.chunk_end").alias("chunk_end")
    )


def merge_chunks(tags: DataFrame, key: list[str]) -> DataFrame:
    """One tag per word: from the chunk whose middle is nearest, the first on a tie.

    Input columns: chunk_no, chunk_start, chunk_end, token, tag.
    """
    half = (F.col("chunk_end") - F.col("chunk_start")) / 2
    distance = F.abs(F.col("token") - F.col("chunk_start") - half)
    return tags.groupBy(*key, "token").agg(
        F.min_by("tag", F.struct(distance.alias("d"), "chunk_no")).alias("tag")
    )


# Punctuation moved out of an entity at its edges.
ENTITY_PUNCTUATION = ".,;:!?\"'()[]{}"
ENTITY = "struct<text:string,label:string,start_token:int,end_token:int,prefix:string,suffix:string>"


def bio_entities(tokens: Column, tags: Column, punctuation: str = ENTITY_PUNCTUATION) -> Column:
    """Entities of a tagged token array: ``B-x`` opens, only ``I-x`` right after extends.

    A token continues the one before when it is ``I-x`` after ``B-x`` or ``I-x``;
    runs of continuing tokens whose head is a ``B-`` are the entities.
    """
    punct = F.lit(punctuation)

    def entity(label: Column, r: Column, ws: Column) -> Column:
        n = F.size(ws)

        def trim_head(bare: Column) -> Column:
            first = F.get(ws, F.lit(0))
            solid = F.length(bare) > 0
            head = F.when(solid, bare).otherwise(first)
            prefix = F.when(solid, F.left(first, F.length(first) - F.length(bare))).otherwise("")

            def trim_tail(last: Column) -> Column:
                cut = F.rtrim(last, punct)
                tail = F.when(F.length(cut) > 0, cut).otherwise(last)
                inner = F.when(n == 1, F.array(tail)).otherwise(
                    F.concat(F.array(head), F.slice(ws, F.lit(2), F.greatest(n - 2, F.lit(0))), F.array(tail))
                )
                return F.struct(
                    F.array_join(inner, " ").alias("text"),
                    label.alias("label"),
                    r["a"].alias("start_token"),
                    r["b"].alias("end_token"),
                    prefix.alias("prefix"),
                    F.substring(last, F.length(tail) + 1, F.length(last)).alias("suffix"),
                ).cast(ENTITY)

            return let(F.when(n == 1, head).otherwise(F.element_at(ws, -1)), trim_tail)

        return let(F.ltrim(F.get(ws, F.lit(0)), punct), trim_head)

    def over(ts: Column, words: Column) -> Column:
        def new(tag: Column, i: Column) -> Column:
            previous = F.get(ts, i - 1)
            inside = previous.startswith("I-") | previous.startswith("B-")
            continues = tag.startswith("I-") & inside & (_kind(tag) == _kind(previous))
            return (i == 0) | ~F.coalesce(continues, F.lit(False))

        opened = F.filter(islands(ts, new), lambda r: F.get(ts, r["a"]).startswith("B-"))
        return F.transform(opened, lambda r: let(F.slice(words, r["a"] + 1, r["b"] - r["a"]), lambda ws: entity(_kind(F.get(ts, r["a"])), r, ws)))

    return let(tags, lambda ts: let(tokens, lambda words: over(ts, words)))


def _kind(tag: Column) -> Column:
    return F.substring(tag, F.lit(3), F.length(tag))


def entity_map(df: DataFrame, key: list[str], entities: str = "entities") -> DataFrame:
    """(key, text, label) rows: an entity text with its last label."""
    return (
        df.select(*key, F.posexplode(entities).alias("i", "e"))
        .groupBy(*key, F.col("e.text").alias("text"))
        .agg(F.max_by("e.label", "i").alias("label"))
    )


def _mask(tokens: Column, entities: Column, names: Column) -> Column:
    """Tokens joined by a space, each entity shown once by its name (``names`` runs beside ``entities``).

    ``cover`` tells for every token which entity starts there (its index), or -1
    for none and -2 for the inside of one, so the text is walked once.
    """

    def build(es: Column, labels: Column) -> Column:
        def reach(e: Column, j: Column) -> Column:
            begin = F.when(j == 0, F.lit(0)).otherwise(F.get(es, j - 1)["end_token"])
            return F.concat(
                F.array_repeat(F.lit(-1), e["start_token"] - begin),
                F.array(j),
                F.array_repeat(F.lit(-2), e["end_token"] - e["start_token"] - 1),
            )

        shown = F.transform(
            es, lambda e, j: F.concat(e["prefix"], F.lit("["), F.get(labels, j), F.lit("]"), e["suffix"])
        )

        def walk(cover: Column, texts: Column) -> Column:
            def word(w: Column, i: Column) -> Column:
                at = F.coalesce(F.get(cover, i), F.lit(-1))
                return F.when(at == -1, w).when(at >= 0, F.get(texts, at))

            return F.array_join(F.transform(tokens, word), " ")

        return let(F.flatten(F.transform(es, reach)), lambda cover: let(shown, lambda texts: walk(cover, texts)))

    return let(entities, lambda es: let(names, lambda labels: build(es, labels)))


def mask_labels(tokens: Column, entities: Column) -> Column:
    """Entities become ``[LABEL]``; tokens are joined by one space."""
    return _mask(tokens, entities, F.transform(entities, lambda e: e["label"]))


def indexed_names(entities: Column) -> Column:
    """``LABEL:n`` per entity, n counting occurrences of the label in the text."""

    def build(labels: Column) -> Column:
        return F.zip_with(labels, running_counts(labels), lambda x, n: F.concat(x, F.lit(":"), n.cast("string")))

    return let(F.transform(entities, lambda e: e["label"]), build)


def mask_ids(tokens: Column, entities: Column) -> Column:
    """struct<anonymized_text, entities map> with indexed names."""
    return let(
        indexed_names(entities),
        lambda names: F.struct(
            _mask(tokens, entities, names).alias("anonymized_text"),
            F.map_from_arrays(names, F.transform(entities, lambda e: e["text"])).alias("entities"),
        ),
    )
