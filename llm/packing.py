"""Best-fit packing of token pieces into fixed-size sequences, bulk-synchronously.

1. One pass tokenizes whole texts and cuts only documents that are longer than a sequence.
2. Pieces are range-sorted by length and numbered inside each length (``ordered.number_rows``; a length that holds a third
   of all pieces spreads over many tasks). Gaps are kept sorted by size as runs of sequences that have the same gap.
3. A superstep takes the pieces of one length, longest first. They sweep to the successor of their length among the gaps
   (the smallest that fits). Where pieces and gaps of a size contend, ranks decide: the r-th piece gets the r-th gap of
   the run. The matched gaps shrink and go back to their place; pieces left over sweep on to the next gap, or open new
   sequences when none fits. So all pieces of a length move together, and the outcome is best-fit decreasing.
4. Equal lengths and equal gaps are interchangeable, so a sweep needs counts only: at most ``capacity`` lengths come to the
   driver, however large the corpus. What it yields are runs (length, first rank, last rank, first sequence, offset), which
   every numbered piece looks up by its length and rank on the executors.

Defined results: null and empty texts are the closing id alone; null ids, ties and repeated rows are pieces of their own;
an empty table gives no pieces; other columns play no part, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.operators.ordered import number_rows
from hushframe.session import materialize
from llm.arrays import Texts, lower_ascii, pieces

CAPACITY = 2048
CLOSING_ID = 0
VOCABULARY = "word_bpe_49k.json"
#: Units whose ids a worker remembers; the memory is emptied when it is full.
REMEMBERED = 500_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not _LETTER[c]]] = True


class Encoder:
    """The ids of many texts, each distinct unit of them encoded once.

    A unit ends at white space or where an ASCII letter or digit is followed by an ASCII sign: places where the
    tokenizer's own splitting always begins anew, so the ids are those of the whole text. Upper case is folded first, as
    the tokenizer does; texts that hold ``<|`` (a special token's beginning) go to the tokenizer whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, np.ndarray] = {}

    def _unit(self, unit: bytes) -> np.ndarray:
        """One word or one run of signs in plain ASCII needs no splitting; all else takes the tokenizer's whole way."""
        if unit.isascii() and (unit.isalpha() or not any(_LETTER[c] or c < 33 or c > 126 for c in unit)):
            return np.array([t.id for t in self.tokenizer.model.tokenize(unit.decode())], np.uint32)
        return np.array(self.tokenizer.encode(unit.decode(), add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text closed by ``CLOSING_ID``, and the number of ids of each text."""
        t = Texts(texts)
        data = t.data
        if ((data[:-1] == 60) & (data[1:] == 124)).any():
            lists = [self.tokenizer.encode(x or "", add_special_tokens=False).ids + [CLOSING_ID] for x in texts.to_pylist()]
            return np.concatenate([np.array(x, np.uint32) for x in lists]), np.array([len(x) for x in lists])
        data = lower_ascii(data)
        solid = ~t.space()
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | (_LETTER[data[:-1]] & _SIGN[data[1:]])
        starts = np.flatnonzero(begins)
        # a unit's bytes are the solid bytes up to the next unit's first
        offsets = np.append(np.cumsum(solid) - solid, solid.sum())[np.append(starts, len(data))]
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[solid])]).dictionary_encode()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        found = []
        for unit in units.dictionary.to_pylist():
            ids = self.known.get(unit)
            if ids is None:
                ids = self.known[unit] = self._unit(unit)
            found.append(ids)
        index = units.indices.to_numpy()
        lengths = np.array([len(x) for x in found], np.int64)
        flat = np.concatenate(found) if found else np.zeros(0, np.uint32)
        of = t.of(starts)
        size = lengths[index]
        counts = np.bincount(of, weights=size, minlength=t.n).astype(np.int64) + 1
        out = np.full(counts.sum(), CLOSING_ID, np.uint32)
        # where each unit's ids go: after all ids before it and one closing id for each text before it
        to = np.cumsum(size) - size + of
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(to, size) + step] = flat[np.repeat((np.cumsum(lengths) - lengths)[index], size) + step]
        return out, counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(public_tokenizers.path(vocabulary))
        for batch in batches:
            for part in pieces(batch, "text"):
                ids, counts = tokens.encode(part.column(1))
                parts = -(-counts // capacity)
                of = np.repeat(np.arange(len(counts)), parts)
                number = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = number * capacity
                length = np.minimum(counts[of] - start, capacity)
                begin = np.repeat(np.cumsum(counts) - counts, parts) + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist())]
                columns = [part.column(0).take(pa.array(of)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[a : a + n].astype(np.int32).tolist() for a, n in zip(begin.tolist(), length.tolist())], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(work, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, offset) that place ``counts[length]`` pieces of each length.

    Runs of sequences with one gap size are stacks; ``sizes`` holds the gap sizes that have any, ascending.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    opened = 0

    def put(gap: int, first: int, count: int) -> None:
        if gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, count))

    for length in sorted(counts, reverse=True):
        rank, count = 0, counts[length]
        while rank < count:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                runs.append((length, rank, count, opened, 0))
                put(capacity - length, opened, count - rank)
                opened += count - rank
                break
            gap = sizes[at]
            first, free = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], sizes[at]
            taken = min(free, count - rank)
            runs.append((length, rank, rank + taken, first, capacity - gap))
            put(gap - length, first, taken)
            if taken < free:
                put(gap, first + taken, free - taken)
            rank += taken
    return runs


def place(cuts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cuts`` (with doc_id, piece, length) plus sequence_id and offset."""
    spark = cuts.sparkSession
    cuts = materialize(cuts)
    counts = {r.length: r.k for r in cuts.groupBy("length").agg(F.count(F.lit(1)).alias("k")).collect()}  # at most ``capacity`` rows
    runs = np.array(sweep(counts, capacity), np.int64).reshape(-1, 5)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    shared = spark.sparkContext.broadcast(runs)  # grows with the capacity only
    order = ["doc_id", "piece", "ids_crc32"]
    ranked = number_rows(cuts, ["length"], order, "__rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cuts.schema.fields)
    names = cuts.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        base = int(table[:, 1:3].max()) + 1 if len(table) else 1
        keys = table[:, 0] * base + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "__rank"))
            at = np.searchsorted(keys, length * base + rank - 1, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), pa.array(table[at, 3] + rank - 1 - table[at, 1]), pa.array(table[at, 4])], [*names, "sequence_id", "offset"]
            )

    return ranked.mapInArrow(work, schema + ", sequence_id bigint, offset bigint")


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    return place(cut(docs, text, doc_id, capacity, vocabulary), capacity)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
SQL: dict[str, str] = {}
