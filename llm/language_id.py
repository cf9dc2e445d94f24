"""Language ID by language-bitmask n-gram filters.

Training counts byte 4-grams per language on the executors and keeps those that make up at least ``LEAST_RATE`` of a
language's grams, so a language has at most ``1 / LEAST_RATE`` of them. They go into one bit-sliced Bloom filter: slot ``s``
holds a bitmask of the languages that set bit ``s``, so one look-up (the AND of ``HASHES`` slots) returns all languages that
contain a gram. A text's grams are looked up over its whole length; each language's popcount is corrected for the false
positives that its own filling predicts, and the largest corrected count decides.

Defined results: null texts and texts without a letter are ``und`` with score 0.0; a text with letters but without a known
gram gets the language with most training grams, score 0.0; ties go to the language with more training grams, then by name;
null ids are predicted but neither learned from nor held out; null languages are not learned from; with nothing to learn
from, every row is ``und``; repeated rows count as often as they come; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.session import materialize
from llm.arrays import Texts, mix, pieces

GRAM = 4
LEAST_RATE = 5e-5
HASHES = 3
SLOTS_PER_GRAM = 16
UNKNOWN = "und"

#: ASCII letters in lower case, all other ASCII as a space, bytes of other characters as they are.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


@dataclass(frozen=True)
class Filters:
    """``slots[word, s]`` has the languages of slot s as bits; ``filled`` is each language's share of set slots."""

    names: list[str]
    slots: np.ndarray
    filled: np.ndarray


def grams(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the 4-byte windows inside each text, folded, none of spaces alone or of two spaces, and their text numbers."""
    b = _FOLD[t.data].astype(np.uint32)
    n = max(0, len(b) - GRAM + 1)
    code = np.zeros(n, np.uint32)
    for i in range(GRAM):
        code = (code << np.uint32(8)) | b[i : i + n]
    gap = t.data == 10
    gap[:] = False
    gap[t.end] = True  # the line feed that closes a text
    ends = np.append(0, np.cumsum(gap))
    inside = ends[GRAM - 1 : GRAM - 1 + n] == ends[:n]  # the closing line feed may be a text's last space
    space = b == 32
    double = np.append(0, np.cumsum(space[1:] & space[:-1]))
    inside &= double[GRAM - 1 : GRAM - 1 + n] == double[:n]
    at = np.flatnonzero(inside)
    return code[at], t.of(at)


def _slots(code: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(code.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    mask = np.uint64((1 << bits) - 1)
    return [((h >> np.uint64(21 * i)) & mask).astype(np.int64) for i in range(HASHES)]


def learnable(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 4 != 2


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Filters:
    """Filters from all rows with a language whose id may be learned from."""
    rows = docs.where(learnable(docs[doc_id]) & docs[lang].isNotNull()).select(docs[lang].cast("string").alias("lang"), docs[text].alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                code, of = grams(Texts(part.column(1)))
                names = part.column(0).dictionary_encode()
                # language number above the code, so that one sort counts all
                key, k = np.unique((names.indices.to_numpy().astype(np.uint64)[of] << np.uint64(32)) | code, return_counts=True)
                which = pa.array((key >> np.uint64(32)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([names.dictionary.take(which), pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(k)], ["lang", "gram", "k"])

    counts = rows.mapInArrow(count, "lang string, gram bigint, k bigint").groupBy("lang", "gram").agg(F.sum("k").alias("k"))
    counts = materialize(counts)
    totals = {r.lang: r.total for r in counts.groupBy("lang").agg(F.sum("k").alias("total")).collect()}
    if not totals:
        return Filters([], np.zeros((0, 1), np.uint64), np.zeros(0))
    names = sorted(totals, key=lambda x: (-totals[x], x))
    total = counts.sparkSession.createDataFrame([(x, int(totals[x])) for x in names], "lang string, total bigint")
    known = counts.join(F.broadcast(total), "lang").where((F.col("k") >= 2) & (F.col("k") >= F.col("total") * LEAST_RATE)).select("lang", "gram")
    table = known.toArrow()  # at most 1 / LEAST_RATE rows a language
    most = max(1, np.unique(table["lang"].combine_chunks().dictionary_encode().indices.to_numpy(), return_counts=True)[1].max(initial=1))
    bits = min(21, int(most * SLOTS_PER_GRAM - 1).bit_length())
    slots = np.zeros((-(-len(names) // 64), 1 << bits), np.uint64)
    langs, codes = np.array(table["lang"].to_pylist(), dtype=object), table["gram"].to_numpy()
    filled = np.zeros(len(names))
    for i, name in enumerate(names):
        mine = codes[langs == name]
        for s in _slots(mine, bits):
            slots[i // 64, s] |= np.uint64(1) << np.uint64(i % 64)
        filled[i] = np.mean((slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1))
    return Filters(names, slots, filled)


def predict(texts: pa.Array, model: Filters) -> tuple[list[str], np.ndarray]:
    t = Texts(texts)
    if not model.names:
        return [UNKNOWN] * t.n, np.zeros(t.n)
    code, of = grams(t)
    at = _slots(code, int(model.slots.shape[1]).bit_length() - 1)
    held = model.slots[:, at[0]]
    for s in at[1:]:
        held &= model.slots[:, s]
    cut = np.searchsorted(of, np.arange(t.n + 1))
    n = np.diff(cut)
    wrong = model.filled**HASHES
    counts = np.zeros((len(model.names), t.n))
    for i in range(len(model.names)):
        hits = np.append(0, np.cumsum((held[i // 64] >> np.uint64(i % 64)) & np.uint64(1), dtype=np.int64))
        counts[i] = (hits[cut[1:]] - hits[cut[:-1]] - n * wrong[i]) / max(1e-9, 1 - wrong[i])
    best = counts.argmax(0)  # the first of equals; names are in order of training grams
    top = np.maximum(counts.max(0), 0)
    rest = np.maximum(np.partition(counts, -2, 0)[-2], 0) if len(counts) > 1 else np.zeros(t.n)
    score = np.where(top > 0, top / np.maximum(top + rest, 1e-9), 0.0)
    ascii_letter = t.sums((_FOLD[t.data] >= 97) & (_FOLD[t.data] <= 122)) > 0
    names = []
    for i, ok in enumerate(ascii_letter.tolist()):
        ok = ok or any(c.isalpha() for c in t.data[t.start[i] : t.end[i]].tobytes().decode())
        names.append(model.names[best[i]] if ok else UNKNOWN)
    return names, np.where(np.array([x != UNKNOWN for x in names], bool), score, 0.0)


def identify(docs: DataFrame, model: Filters, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**21 slots of 8 bytes for 64 languages
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                names, score = predict(part.column(1), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(work, "doc_id bigint, lang_pred string, score double")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return identify(docs, fit(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
SQL: dict[str, str] = {}
