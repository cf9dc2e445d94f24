"""Toxicity by multiple-instance learning: sentences are the instances, documents carry the labels.

A sentence's score is a logistic function of its words and of their first bytes (so that compounds of one stem count); a document's score is the noisy-or of its sentences,
``1 - prod(1 - p)``. A sentence enters it with what its words add to the weight every sentence starts from: one without known
words, or whose words speak for a clean text, adds nothing, however many there are. Training sees document labels only and back-propagates through the noisy-or, so the blame settles on
the sentences that explain the label; ``locate`` returns them. Scoring is one pass over whole texts without a shuffle.

The model is fitted on a bounded sample: at most ``toxic_docs`` and ``clean_docs`` labelled documents, chosen by a hash of
the id. Scores use every word of every text.

Defined results: null, empty and wordless texts score 0.0; a null id is never learned from and never held out; several
labels of one document count as the largest; without labels (or with one class only) every score is 0.0; ties in the
sample's order are broken by id; other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.session import materialize
from llm.arrays import Texts, byte_values, lower_ascii, pieces, slices
from llm.sampling import bounded

TOXIC_DOCS, CLEAN_DOCS = 4_000, 8_000
MIN_DOCS = 4
#: Words whose document counts differ between the classes by less than so many standard errors carry no weight.
LEAST_Z = 5.0
VOCABULARY = 20_000
#: Every sentence starts at this or less; only what its words add to that counts, so that length alone never makes a text toxic.
LEAST_BIAS = -9.0
ROUNDS = 150
SENTENCE_ENDS = b".!?\n"
#: Lengths in bytes of the word beginnings that are features beside the words.
STEMS = (4, 5, 6, 7, 8)

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ENDS = np.zeros(256, bool)
_ENDS[list(SENTENCE_ENDS)] = True


@dataclass(frozen=True)
class Model:
    """Sorted 64-bit word hashes with their weights, and the weight every sentence starts from."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes))
        if not len(self.words):
            return out
        gate = np.zeros(1 << 20, bool)
        gate[self.words & np.uint64((1 << 20) - 1)] = True
        maybe = np.flatnonzero(gate[hashes & np.uint64((1 << 20) - 1)])
        at = np.minimum(np.searchsorted(self.words, hashes[maybe]), len(self.words) - 1)
        hit = self.words[at] == hashes[maybe]
        out[maybe[hit]] = self.weights[at[hit]]
        return out


EMPTY = Model(np.zeros(0, np.uint64), np.zeros(0), -40.0)


def sentences(texts: pa.Array) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts; hashes of words and stems, and their sentence numbers; of each sentence with a word: its text number and
    its last byte."""
    t = Texts(texts)
    solid = _IN_WORD[t.data]
    edge = np.diff(solid.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    values = slices(byte_values(lower_ascii(t.data)))
    stops = np.flatnonzero(_ENDS[t.data])  # each text ends with a line feed, so every sentence has its stop
    stop_of_word = np.searchsorted(stops, starts)
    used, number = np.unique(stop_of_word, return_inverse=True)
    last = stops[used]
    hashes, numbers = [values(starts, ends)], [number]
    for n in STEMS:
        longer = ends - starts > n
        hashes.append(values(starts[longer], starts[longer] + n) ^ np.uint64(0x5851F42D4C957F2D))
        numbers.append(number[longer])
    return t, np.concatenate(hashes), np.concatenate(numbers), t.of(last), last


def _evidence(z: np.ndarray, bias: float) -> np.ndarray:
    """The log of ``1 - p`` negated, less that of a sentence without known words, and 0 at least."""
    return np.maximum(np.logaddexp(0.0, z) - np.logaddexp(0.0, bias), 0.0)


def train(word: np.ndarray, sentence: np.ndarray, document: np.ndarray, label: np.ndarray, words: int, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights by Adam on the noisy-or likelihood, both classes weighted alike.

    ``word[i]`` is a word number in sentence ``sentence[i]``; ``document[s]`` is the document of sentence ``s``.
    """
    docs = len(label)
    share = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum())) * docs
    w, b = np.zeros(words), LEAST_BIAS
    m, v = np.zeros(words + 1), np.zeros(words + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(sentence, weights=w[word], minlength=len(document)) + b
        total = np.maximum(np.bincount(document, weights=_evidence(z, b), minlength=docs), 1e-9)
        slope = np.where(label == 1, -1.0 / np.expm1(np.minimum(total, 50.0)), 1.0) * share
        slope = np.maximum(slope, -20.0)[document] * (z >= b)
        dz = slope / (1.0 + np.exp(-z))
        db = dz - slope / (1.0 + np.exp(-b))
        grad = np.append(np.bincount(word, weights=dz[sentence], minlength=words) + 0.02 * w, db.sum()) / docs
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], min(b - move[-1], LEAST_BIAS)
    return w, float(b)


def learnable(doc_id) -> F.Column:
    """The rows whose labels may be learned from."""
    return F.crc32(doc_id.cast("string")) % 5 != 0


def _distinct(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (hash, group) once, in order of hash."""
    order = np.lexsort((of, hashes))
    h, g = hashes[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    return h[new], g[new]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    toxic: str = "toxic",
    toxic_docs: int = TOXIC_DOCS,
    clean_docs: int = CLEAN_DOCS,
    vocabulary: int = VOCABULARY,
) -> Model:
    """Fit on at most ``toxic_docs`` + ``clean_docs`` labelled documents and ``vocabulary`` words and stems.

    The words are counted and screened on the executors; the driver gets the vocabulary and, per sampled document, its
    number of sentences and where vocabulary words stand.
    """
    known = labels.select(labels[doc_id].cast("bigint").alias("id"), labels[toxic].cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("id").agg(F.max("y").alias("y")).where(learnable(F.col("id")))
    known = materialize(known)
    picked = [bounded(known.where(F.col("y") == y), ["id"], n) for y, n in ((1, toxic_docs), (0, clean_docs))]
    sample = picked[0].unionByName(picked[1])
    # at most toxic_docs + clean_docs rows of 12 bytes
    rows = docs.select(docs[doc_id].cast("bigint").alias("id"), docs[text].alias("text")).join(F.broadcast(sample), "id").select("id", "y", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                y = part.column(1).to_numpy()
                _, hashes, number, of, _ = sentences(part.column(2))
                h, g = _distinct(hashes, of[number] if len(number) else number)
                u, at = np.unique(h, return_inverse=True)
                bad = np.bincount(at, weights=y[g], minlength=len(u)).astype(np.int64)
                columns = [np.append(u, np.uint64(0)).view(np.int64), np.append(bad, y.sum()), np.append(np.bincount(at, minlength=len(u)), len(y))]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["h", "bad", "total"])

    # hash 0 carries the numbers of documents
    counts = rows.mapInArrow(count, "h bigint, bad bigint, total bigint").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("total").alias("total"))
    counts = counts.where(F.col("total") >= MIN_DOCS)
    counts = materialize(counts)
    size = counts.where("h = 0").collect()
    if not size or not 0 < size[0].bad < size[0].total:
        return EMPTY
    n, n_bad = size[0].total, size[0].bad
    rate = F.col("total") / n
    z = (F.col("bad") / n_bad - (F.col("total") - F.col("bad")) / (n - n_bad)) / F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-12)) * (1 / n_bad + 1 / (n - n_bad)))
    chosen = counts.where("h <> 0").withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "h").limit(vocabulary)
    words = np.sort(chosen.select("h").toArrow()["h"].to_numpy().view(np.uint64))
    if not len(words):
        return EMPTY
    lexicon = docs.sparkSession.sparkContext.broadcast(Model(words, np.arange(1, len(words) + 1, dtype=np.float64), 0.0))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                _, hashes, number, of, _ = sentences(part.column(2))
                at = lexicon.value.of(hashes).astype(np.int64)
                hit = np.flatnonzero(at)
                pair = np.unique(number[hit] * (len(words) + 1) + at[hit])
                sentence, word = pair // (len(words) + 1), pair % (len(words) + 1) - 1
                cut = np.searchsorted(of[sentence], np.arange(part.num_rows + 1))
                of_doc = np.searchsorted(of, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(np.diff(of_doc), pa.int64()),
                        pa.array([(sentence[a:b] - of_doc[i]).tolist() for i, (a, b) in enumerate(zip(cut, cut[1:]))], pa.list_(pa.int64())),
                        pa.array([word[a:b].tolist() for a, b in zip(cut, cut[1:])], pa.list_(pa.int64())),
                    ],
                    ["id", "y", "n", "sentences", "words"],
                )

    found = rows.mapInArrow(find, "id bigint, y int, n bigint, sentences array<bigint>, words array<bigint>").toArrow().sort_by("id").combine_chunks()
    sizes = found["n"].to_numpy()
    lengths = pc.list_value_length(found["words"]).to_numpy()
    sentence = pc.list_flatten(found["sentences"]).to_numpy() + np.repeat(np.cumsum(sizes) - sizes, lengths)
    weights, bias = train(pc.list_flatten(found["words"]).to_numpy(), sentence, np.repeat(np.arange(len(sizes)), sizes), found["y"].to_numpy(), len(words))
    return Model(words, weights, bias)


def sentence_scores(texts: pa.Array, model: Model) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
    """The texts and, a value per sentence with a word: its evidence, its text number, its last byte."""
    t, hashes, number, of, last = sentences(texts)
    weight = model.of(hashes)
    hit = np.flatnonzero(weight)
    _, first = np.unique(np.stack([number[hit].astype(np.uint64), hashes[hit]]), axis=1, return_index=True) if len(hit) else (0, hit)
    hit = hit[first]
    z = np.bincount(number[hit], weights=weight[hit], minlength=len(last)) + model.bias
    return t, _evidence(z, model.bias), of, last


def text_scores(texts: pa.Array, model: Model) -> np.ndarray:
    t, parts, of, _ = sentence_scores(texts, model)
    return -np.expm1(-np.bincount(of, weights=parts, minlength=t.n))


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                p = text_scores(part.column(1), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(work, "doc_id bigint, score double, predicted int")


def locate(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", least: float = 0.5) -> DataFrame:
    """The offending sentences: doc_id, the sentence's number, its text and its own score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                t, parts, of, last = sentence_scores(part.column(1), shared.value)
                p = -np.expm1(-parts)
                first = np.searchsorted(of, np.arange(t.n))
                bad = np.flatnonzero(p >= least)
                begin = [int(last[i - 1]) + 1 if i > first[of[i]] else int(t.start[of[i]]) for i in bad]
                body = [t.data[a : last[i] + (last[i] < t.end[of[i]])].tobytes().decode().strip() for a, i in zip(begin, bad)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(of[bad])), pa.array(bad - first[of[bad]], pa.int64()), pa.array(body, pa.string()), pa.array(p[bad], pa.float64())],
                    ["doc_id", "sentence", "text", "score"],
                )

    return rows.mapInArrow(work, "doc_id bigint, sentence bigint, text string, score double")


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [str(i) for i in range(batch.num_columns)]
            for part in pieces(pa.RecordBatch.from_arrays(batch.columns, names), names[at]):
                kept = part.filter(pa.array(text_scores(part.column(at), shared.value) < 0.5))
                yield pa.RecordBatch.from_arrays(kept.columns, schema=batch.schema)

    return docs.mapInArrow(work, docs.schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score(docs, fit(docs, labels)).select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {"op9_toxicity": op9_toxicity}
SQL: dict[str, str] = {}
