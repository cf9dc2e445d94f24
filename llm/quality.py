"""Quality rules by repetition coverage: rolling hashes of n-grams of several lengths and of lines, in numpy.

Each text is judged alone, so the work is one pass without a shuffle. Every word becomes a 64-bit hash of its bytes and
every window of n words a rolling hash of those. Windows and lines found twice or more in a text are marked, and the
characters (code points) of the words they hold are counted once each.

Defined results: null and empty texts have no words and fail the base rule; null ids and repeated rows are rows like any
other; whole texts are read however long they are; other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from llm.arrays import Texts, byte_hashes, pieces, window_hashes

#: Largest share (per cent of the characters in words) that repeated n-grams may cover, by n; the first find counts too.
NGRAM_LIMITS = {5: 50, 6: 48, 7: 46, 8: 44, 9: 42, 10: 40}
#: Largest share (per cent of the characters in words) in lines that repeat an earlier line.
LINE_LIMIT = 30
MIN_WORDS = 20
BASE_WINDOW, BASE_LIMIT = 8, 30
SYMBOLS = b"#*$%&|<>"

FIELDS = (
    ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"] + [f"dup_chars_{n}" for n in NGRAM_LIMITS]
)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Marks the keys found twice or more."""
    order = np.argsort(keys)
    s = keys[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.zeros(len(s), bool)
    out[order] = same[1:] | same[:-1]
    return out


def _covered(marked: np.ndarray, at: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words inside a marked window of n words; ``at`` holds the windows' first words."""
    edge = np.zeros(words + 1, np.int64)
    starts = at[marked]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """All counts of a batch of texts, a value per text."""
    t = Texts(texts)
    lead = (t.data & 0xC0) != 0x80
    starts, ends, of = t.words()
    chars_before = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(lead, out=chars_before[1:])
    chars = chars_before[ends] - chars_before[starts]
    per_text = lambda values: np.bincount(of, weights=values, minlength=t.n).astype(np.int64)
    out = {"n_words": np.bincount(of, minlength=t.n).astype(np.int64), "word_chars": per_text(chars)}
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    out["n_symbols"] = t.sums(is_symbol[t.data])

    # lines: the first find of a line is the one that sorts first, since the sort is stable
    feeds = np.flatnonzero(t.data == 10)
    line_starts = np.append(0, feeds[:-1] + 1)
    word_sum = np.append(0, np.cumsum(chars))
    in_line = word_sum[np.searchsorted(starts, feeds)] - word_sum[np.searchsorted(starts, line_starts)]
    solid = in_line > 0
    line_starts, feeds, in_line = line_starts[solid], feeds[solid], in_line[solid]
    line_of = t.of(line_starts)
    salt = np.arange(t.n, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)
    keys = byte_hashes(t.data, line_starts, feeds) ^ salt[line_of]
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    out["n_dup_lines"] = np.bincount(line_of[again], minlength=t.n).astype(np.int64)
    out["dup_line_chars"] = np.bincount(line_of[again], weights=in_line[again], minlength=t.n).astype(np.int64)

    word_hash = byte_hashes(t.data, starts, ends)
    last = np.cumsum(out["n_words"])[of]  # one past the last word of the text
    at = np.arange(len(starts))
    for n in range(min(NGRAM_LIMITS), max(NGRAM_LIMITS) + 1):
        at = at[at + n <= last[at]]
        marked = repeated(window_hashes(word_hash, at, at + n) ^ salt[of[at]])
        covered = _covered(marked, at, n, len(starts))
        if n in NGRAM_LIMITS:
            out[f"dup_chars_{n}"] = per_text(chars * covered)
        if n == BASE_WINDOW:
            out["n_repeat_words"] = per_text(covered)
        # a longer window can repeat only where the shorter ones at both its ends do
        at = at[marked]
        follows = np.isin(at + 1, at, assume_unique=True) if len(at) else np.zeros(0, bool)
        at = at[follows]
    return out


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``base_failed`` and ``kept`` from the counts; whole numbers only, so there is no rounding."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > BASE_LIMIT * m["n_words"])
    kept = ~failed & (100 * m["dup_line_chars"] <= LINE_LIMIT * m["word_chars"])
    for n, limit in NGRAM_LIMITS.items():
        kept &= 100 * m[f"dup_chars_{n}"] <= limit * m["word_chars"]
    return failed, kept


def measure(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row per row of ``docs``: its id, the counts, ``base_failed`` and ``kept``."""
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                m = measures(part.column(1))
                failed, kept = verdict(m)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(m[f]) for f in FIELDS], pa.array(failed), pa.array(kept)], ["doc_id", *FIELDS, "base_failed", "kept"]
                )

    return rows.mapInArrow(work, "doc_id bigint, " + ", ".join(f"{f} bigint" for f in FIELDS) + ", base_failed boolean, kept boolean")


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text passes, with their columns as they are."""
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [str(i) for i in range(batch.num_columns)]
            for part in pieces(pa.RecordBatch.from_arrays(batch.columns, names), names[at]):
                kept = part.filter(pa.array(verdict(measures(part.column(at)))[1]))
                yield pa.RecordBatch.from_arrays(kept.columns, schema=batch.schema)

    return docs.mapInArrow(work, docs.schema)


def _sql() -> str:
    """The same counts in SQL: words and windows as rows, coverage by window functions."""
    grams = ", ".join(f"CASE WHEN pos + {n} <= n THEN hash(list_slice(ws, pos + 1, pos + {n})) END AS g{n}" for n in NGRAM_LIMITS)
    found = ", ".join(f"CASE WHEN g{n} IS NOT NULL AND count(*) OVER (PARTITION BY rid, g{n}) > 1 THEN 1 ELSE 0 END AS r{n}" for n in NGRAM_LIMITS)
    cover = ", ".join(f"max(r{n}) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in NGRAM_LIMITS)
    sums = ", ".join(f"sum(c{n} * length(w))::BIGINT AS dup_chars_{n}" for n in NGRAM_LIMITS)
    names = ", ".join(f"coalesce(dup_chars_{n}, 0) AS dup_chars_{n}" for n in NGRAM_LIMITS)
    limits = " AND ".join(f"100 * dup_chars_{n} <= {limit} * word_chars" for n, limit in NGRAM_LIMITS.items())
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
tokens AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs),
words AS (SELECT rid, ws, len(ws) AS n, unnest(range(len(ws))) AS pos FROM tokens),
grams AS (SELECT rid, pos, ws[pos + 1] AS w, {grams} FROM words),
found AS (SELECT rid, pos, w, {found} FROM grams),
cover AS (SELECT rid, w, {cover} FROM found),
covered AS (SELECT rid, sum(c{BASE_WINDOW})::BIGINT AS n_repeat_words, {sums} FROM cover GROUP BY rid),
split AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs),
lines AS (SELECT rid, line, count(*) AS k FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line),
dups AS (SELECT rid, sum(k - 1)::BIGINT AS n_dup_lines,
  sum((k - 1) * length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')))::BIGINT AS dup_line_chars FROM lines GROUP BY rid),
counts AS (SELECT t.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, {names}
  FROM tokens t LEFT JOIN covered USING (rid) LEFT JOIN dups USING (rid)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_LIMIT} * n_words AS base_failed FROM counts)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= {LINE_LIMIT} * word_chars AND {limits} AS kept FROM judged"""


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return measure(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_quality_rules": op1_quality_rules}
SQL = {"op1_quality_rules": _sql()}
