"""Language of a text by character trigrams against profiles learnt from labelled text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions.text import let, strip
from hushframe.session import materialize

MIN_CHARS = 10
#: Shares are whole numbers of this unit, so that sums do not depend on their order.
UNIT = 1_000_000_000
#: Profiles of at most so many rows are broadcast; larger ones meet the texts by a shuffle.
BROADCAST_ROWS = 500_000
#: Characters that a task works on at a time; longer texts are read in windows that overlap by two characters.
WINDOW = 1 << 18


def readable(text: Column) -> Column:
    """The whole trimmed text in lower case, or null when it is too short to tell."""
    return let(strip(text), lambda s: F.when(F.length(s) >= MIN_CHARS, F.lower(s)))


def trigrams(text: Column) -> Column:
    def cut(chars: Column) -> Column:
        return F.transform(
            F.slice(chars, F.lit(1), F.size(chars) - 2),
            lambda c, i: F.concat(c, F.get(chars, i + 1), F.get(chars, i + 2)),
        )

    return let(F.split(text, ""), cut)


# --- trigrams as numbers, in tasks --------------------------------------------


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)


def _packed(points: np.ndarray) -> np.ndarray:
    """Every trigram as one number: three code points of 21 bits, so no two trigrams share one."""
    return points[:-2] << 42 | points[1:-1] << 21 | points[2:]


def _windows(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, trigrams) of at most about ``WINDOW`` characters at a time, rows ascending; null texts have none."""
    rows, grams, held = [], [], 0
    for row, value in enumerate(texts):
        text = value.as_py()
        for at in range(0, len(text or "") - 2, WINDOW):
            part = _packed(_points(text[at : at + WINDOW + 2]))
            rows.append(np.full(len(part), row))
            grams.append(part)
            held += len(part)
            if held >= WINDOW:
                yield np.concatenate(rows), np.concatenate(grams)
                rows, grams, held = [], [], 0
    if held:
        yield np.concatenate(rows), np.concatenate(grams)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of each window of (lang, text), to be summed."""
    for batch in batches:
        langs = pc.dictionary_encode(batch.column(0).cast(pa.string()), null_encoding="encode")
        code = langs.indices.to_numpy(zero_copy_only=False)
        for rows, grams in _windows(batch.column(1)):
            of = code[rows]
            order = np.lexsort((grams, of))
            of, grams = of[order], grams[order]
            first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (grams[1:] != grams[:-1])])
            n = np.diff(np.r_[first, len(grams)])
            points = (grams[first, None] >> np.array([42, 21, 0])) & 0x1FFFFF
            text = points.astype("<u4").tobytes().decode("utf-32-le")
            cut = [text[i : i + 3] for i in range(0, len(text), 3)]
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(of[first])), pa.array(cut, pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"])


@dataclass(frozen=True)
class _Profiles:
    """Profiles as sorted trigrams and a weight for each language, languages by name; at most ``BROADCAST_ROWS`` weights are set."""

    langs: list[str]
    starts: np.ndarray
    grams: np.ndarray
    lang: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> _Profiles:
        rows = rows.filter(pc.and_(pc.is_valid(rows["lang"]), pc.equal(pc.utf8_length(rows["gram"]), 3)))
        langs = sorted(set(rows["lang"].to_pylist()))
        gram = _points("".join(rows["gram"].to_pylist())).reshape(-1, 3)
        packed = gram[:, 0] << 42 | gram[:, 1] << 21 | gram[:, 2]
        at = {name: i for i, name in enumerate(langs)}
        lang = np.array([at[name] for name in rows["lang"].to_pylist()], np.int64)
        weight = rows["weight"].to_numpy().astype(np.int64)
        order = np.argsort(packed, kind="stable")
        grams, starts = np.unique(packed[order], return_index=True)
        return cls(langs, np.r_[starts, len(order)].astype(np.int64), grams, lang[order], weight[order])

    def languages(self, texts: pa.Array) -> list[str | None]:
        """The language of each text: the largest sum of weights, the first by name of equal ones, null without a known trigram."""
        width, n = len(self.langs), len(texts)
        if not width:
            return [None] * n
        score, met = np.zeros(n * width, np.int64), np.zeros(n * width, bool)
        for rows, grams in _windows(texts):
            place = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
            known = self.grams[place] == grams
            # a text holds few different trigrams: counted first, only these meet the weights
            keys, times = np.unique(rows[known] * len(self.grams) + place[known], return_counts=True)
            row, place = np.divmod(keys, len(self.grams))
            many = self.starts[place + 1] - self.starts[place]
            entry = np.repeat(self.starts[place] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            slot = np.repeat(row, many) * width + self.lang[entry]
            np.add.at(score, slot, np.repeat(times, many) * self.weight[entry])
            met[slot] = True
        score = np.where(met, score, np.iinfo(np.int64).min).reshape(n, width)
        best = score.argmax(axis=1)
        some = met.reshape(n, width).any(axis=1)
        return [self.langs[b] if s else None for b, s in zip(best, some)]


def _scorer(profiles) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(profiles.value.languages(batch.column(batch.num_columns - 1)), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*batch.schema.names[:-1], "language"])

    return score


# --- profiles and languages ---------------------------------------------------


def fit_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", least_share: float = 0.0) -> DataFrame:
    """(lang, gram, weight): each trigram's share of its language, over whole texts.

    Tasks count the trigrams of about a million bytes of text at a time, so what is
    shuffled are different trigrams and not their occurrences; totals are one row per
    language, so no language meets in one task. ``least_share`` leaves out rarer
    trigrams, which bounds a profile; by default all are kept.
    """
    grams = labelled.select(F.col(lang).cast("string").alias("lang"), F.make_valid_utf8(readable(F.col(text))).alias("text"))
    parts = grams.mapInArrow(_counted, "lang string, gram string, n bigint")
    counts = materialize(parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = counts.groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("total"))
    share = counts.join(totals, F.col("lang").eqNullSafe(F.col("of")))
    return share.where(F.col("n") >= F.col("total") * least_share).select("lang", "gram", F.expr(f"n * {UNIT} div total").alias("weight"))


def detect_language(df: DataFrame, profiles: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, language); null when the text is too short or shares no trigram with any profile.

    ``key`` names a row. Ties go to the first language by name. Profiles of at most
    ``BROADCAST_ROWS`` rows go to every task as sorted trigrams, and a text is scored
    where it is, without a shuffle; larger ones meet the counted trigrams by a join.
    """
    rows = profiles.select("lang", "gram", F.col("weight").cast("bigint").alias("weight")).limit(BROADCAST_ROWS + 1).toArrow()
    if rows.num_rows > BROADCAST_ROWS:
        return _by_join(df, profiles, key, text)
    kept = df.select(*key, F.make_valid_utf8(readable(F.col(text))).alias("__text"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("language", T.StringType())])
    return kept.mapInArrow(_scorer(df.sparkSession.sparkContext.broadcast(_Profiles.of(rows))), schema)


def _by_join(df: DataFrame, profiles: DataFrame, key: list[str], text: str) -> DataFrame:
    """``detect_language`` for profiles of any size: a text's trigrams are counted before they meet the profiles."""
    counts = df.select(*key, F.explode_outer(trigrams(readable(F.col(text)))).alias("gram")).groupBy(*key, "gram").agg(F.count(F.lit(1)).alias("n"))
    scores = counts.join(materialize(profiles), "gram", "left").groupBy(*key, "lang").agg(F.sum(F.col("n") * F.col("weight")).alias("score"))
    best = F.min(F.when(F.col("lang").isNotNull(), F.struct((-F.col("score")).alias("s"), "lang")))
    return scores.groupBy(*key).agg(best["lang"].alias("language"))
