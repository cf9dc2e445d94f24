"""Byte-level BPE: encoding by corpus-level merge replay, and decoding.

1. Whole texts are split by the vocabulary's pattern, in numpy over a batch. Words are counted over the corpus.
2. Corpus level: the words that hold more than 1 / ``SHARED`` of all occurrences (fewer than ``SHARED`` words of at most
   ``SHARED_BYTES`` bytes, whatever the corpus) are replayed once and sent to every task.
3. Replay: the words lie end to end as linked symbols. An inverted index leads from the token that a pair of neighbours
   makes to the pair's positions in all words. Ranks are taken in ascending order; each is applied to all its positions at
   once (leftmost first where they overlap), and only the pairs to the left and right of a merge are looked up anew and
   entered into the index.
4. Words of the tail are replayed the same way in the task that meets them, ``BLOCK_BYTES`` of text at a time, one index
   for all of them. Sending them through the shared index would take a shuffle of twice the text to bring them back.

A word that is a token itself is that token. Where a merge makes a pair of lower rank than its own, the replay's bulk step
could differ from a word by itself; such words are done over one merge at a time. Ids are the ones of the tiktoken library.

Defined results: null and empty texts have no ids and decode to nothing; null ids, ties and repeated rows are texts of their
own; an empty table gives no rows; other columns play no part, whatever their names; a text of any length is split whole
(about 60 bytes of memory per byte of the longest text).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.session import materialize
from llm.arrays import PIECE_BYTES, pieces

VOCABULARY = "byte_bpe_50k.tiktoken"
#: A word is shared when it holds more than one part in so many of all occurrences, so there are fewer shared words than this.
SHARED = 1 << 17
#: Longer words are never shared.
SHARED_BYTES = 32
#: Bytes of text whose unknown words are replayed together.
BLOCK_BYTES = 12 << 20
#: Bytes of words in one inverted index; a longer word is alone in its own.
INDEX_BYTES = 1 << 20
#: Words and bytes of words a task remembers or counts before it starts anew.
REMEMBERED, REMEMBERED_BYTES = 250_000, 8 << 20

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


def _classes() -> np.ndarray:
    """Per code point: other, letter, number or white space."""
    import regex

    points = "".join(map(chr, range(0x110000)))
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for found in regex.finditer(pattern, points):
            table[found.start() : found.end()] = kind
    return table


_TABLE: list[np.ndarray] = []


def split(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where words begin, by ``public_tokenizers.PATTERN``, in texts laid end to end as UTF-8 that begin at ``begins``."""
    if not len(data):
        return np.zeros(0, np.int64)
    if not _TABLE:
        _TABLE.append(_classes())
    if data.max() < 128:
        char, lead = data, None
    else:
        char = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        begins = np.searchsorted(lead, begins)
    m = len(char)
    kind = _TABLE[0][char]
    first = np.zeros(m + 1, bool)
    first[begins] = True
    first[m] = True
    start = first.copy()
    start[1:m] |= kind[1:] != kind[:-1]
    # white space before something else: its last character is a word of its own, or joins what follows if it is a blank
    tail = np.flatnonzero((kind == _SPACE) & start[1:] & ~first[1:])
    start[tail] = True
    start[tail[char[tail] == 32] + 1] = False
    # 's 't 'm 'd 're 've 'll at the beginning of a word
    quote = np.flatnonzero((char == 39) & start[:m])
    quote = quote[quote + 1 < m]
    quote = quote[~first[quote + 1]]
    one = char[quote + 1]
    two = np.where((quote + 2 < m) & ~first[np.minimum(quote + 2, m)], char[np.minimum(quote + 2, m - 1)], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    start[quote[short | long] + 1] = False
    start[quote[short] + 2] = True
    start[quote[long] + 3] = True
    at = np.flatnonzero(start[:m])
    return at if lead is None else lead[at]


class Vocabulary:
    """A rank file as arrays: each token's bytes, each byte's token, and the token that a pair of tokens makes."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.length = np.array([len(t) for t in self.tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.none = size
        self.base = size + 1
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = rank
        self.pair = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[p] for p in self.pair.tolist()], np.int32)

    def make(self, left: np.ndarray | int, right: np.ndarray | int) -> np.ndarray:
        """The token of each pair of neighbours, -1 for none."""
        key = np.asarray(left, np.int64) * self.base + right
        if not len(self.pair):
            return np.full(len(key), -1, np.int32)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.made[at], np.int32(-1))

    def alone(self, word: bytes) -> list[int]:
        """One word, one merge at a time: the leftmost of the lowest rank first."""
        ids = [int(self.byte[b]) for b in word]
        while len(ids) > 1:
            made = self.make(np.array(ids[:-1]), np.array(ids[1:]))
            if not (made >= 0).any():
                break
            at = int(np.argmin(np.where(made < 0, self.none, made)))
            ids[at : at + 2] = [int(made[at])]
        return ids

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each word has."""
        whole = [self.ranks.get(word, -1) for word in words]
        length = np.ones(len(words), np.int64)
        rest = [i for i, rank in enumerate(whole) if rank < 0]
        found, at = [], 0
        while at < len(rest):
            size, end = 0, at
            while end < len(rest) and (end == at or size + len(words[rest[end]]) <= INDEX_BYTES):
                size += len(words[rest[end]])
                end += 1
            ids, counts = self._replay([words[i] for i in rest[at:end]])
            found.append(ids)
            length[rest[at:end]] = counts
            at = end
        out = np.empty(int(length.sum()), np.int32)
        token = np.array(whole, np.int32) >= 0
        of = np.repeat(token, length)
        out[of] = np.array(whole, np.int32)[token]
        if found:
            out[~of] = np.concatenate(found)
        return out, length

    def _replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(size + 1) - size - 1
        n = int(size.sum()) + len(words)
        # a separator after each word and one spare place at the end; a separator makes no pair
        symbol = np.full(n + 1, self.none, np.int32)
        symbol[np.arange(size.sum()) + np.repeat(np.arange(len(words)), size)] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        after = np.arange(1, n + 2, dtype=np.int32)
        after[n] = n
        before = np.arange(-1, n, dtype=np.int32)
        before[0] = n
        gone = np.zeros(n + 1, bool)
        made = np.full(n + 1, -1, np.int32)
        made[:n] = self.make(symbol[:n], symbol[1:])
        # the inverted index: token that a pair makes -> positions of the pair
        known = np.flatnonzero(made >= 0)
        known = known[np.argsort(made[known], kind="stable")].astype(np.int32)
        ranks, cut = np.unique(made[known], return_index=True)
        bulk = dict(zip(ranks.tolist(), np.split(known, cut[1:])))
        index: dict[int, list[int]] = {}
        queue = ranks.tolist()
        heapify(queue)
        redo: set[int] = set()
        while queue:
            rank = heappop(queue)
            at = np.array(index.pop(rank, ()), np.int32)
            if rank in bulk:
                at = np.concatenate([bulk.pop(rank), at])
            at = at[made[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                at = np.unique(at)
                touch = after[at[:-1]] == at[1:]
                if touch.any():
                    i = np.arange(len(at))
                    at = at[(i - np.maximum.accumulate(np.where(np.append(False, touch), 0, i))) % 2 == 0]
            other = after[at]
            right = after[other]
            beside = right[:-1] == at[1:]
            if beside.any():  # alone, the left one of two merges side by side comes first and may make a pair that goes before the other
                between = self.make(rank, symbol[right[:-1][beside]])
                early = at[:-1][beside][(between >= 0) & (between < rank)]
                redo.update(np.searchsorted(first, early, side="right").tolist())
            symbol[at] = rank
            gone[other] = True
            made[other] = -1
            after[at] = right
            before[right] = at
            left = before[at]
            made[at] = self.make(rank, symbol[right])
            made[left] = self.make(symbol[left], rank)
            places = np.concatenate([left, at])
            fresh = made[places]
            places, fresh = places[fresh >= 0], fresh[fresh >= 0]
            if (fresh < rank).any():
                redo.update(np.searchsorted(first, places[fresh < rank], side="right").tolist())
            for r, p in zip(fresh.tolist(), places.tolist()):
                positions = index.get(r)
                if positions is None:
                    index[r] = [p]
                    if r not in bulk:
                        heappush(queue, r)
                else:
                    positions.append(p)
        stays = ~gone & (symbol != self.none)
        total = np.append(0, np.cumsum(stays))
        ids, length = symbol[stays], total[first + size] - total[first]
        if redo:
            lists = np.split(ids, np.cumsum(length)[:-1])
            for word in redo:
                lists[word - 1] = np.array(self.alone(words[word - 1]), np.int32)
            ids, length = np.concatenate(lists), np.array([len(x) for x in lists], np.int64)
        return ids, length

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids end to end, and how many of them each id gives."""
        size = self.length[ids]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.flat[np.repeat(self.start[ids], size) + step], size


_KNOWN: dict[str, Vocabulary] = {}


def vocabulary_of(name: str) -> Vocabulary:
    """One per worker and file; ``name`` is a public tokenizer's file or a path."""
    if name not in _KNOWN:
        _KNOWN[name] = Vocabulary(public_tokenizers.path(name))
    return _KNOWN[name]


def _words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of some texts, the number of each word in turn, and how many words each text has."""
    flat = pc.fill_null(texts.cast(pa.large_binary()), b"")
    size = pc.binary_length(flat).to_numpy(zero_copy_only=False)
    data = np.frombuffer(b"".join(flat.to_pylist()), np.uint8)
    ends = np.cumsum(size)
    begins = (ends - size)[size > 0]
    starts = split(data, begins)
    offsets = np.append(starts, len(data)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    counts = np.diff(np.searchsorted(starts, np.append(0, ends)))
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), counts


Shared = tuple[list[bytes], np.ndarray, np.ndarray]


def shared_words(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, shared: int = SHARED) -> Shared:
    """The words, their ids in a row and how many each has, for words that hold more than 1 / ``shared`` of all occurrences of words of ``SHARED_BYTES`` or fewer."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = [*seen.items(), (b"", sum(seen.values()))]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([k for _, k in rows], pa.int64())], ["word", "n"])

        for batch in batches:
            for part in pieces(batch, "text"):
                words, index, _ = _words(part.column(0))
                for word, k in zip(words, np.bincount(index, minlength=len(words)).tolist()):
                    if len(word) <= SHARED_BYTES:
                        old = seen.get(word)
                        seen[word] = k + (old or 0)
                        size += len(word) if old is None else 0
                if len(seen) > REMEMBERED or size > REMEMBERED_BYTES:
                    yield flush()
                    seen.clear()
                    size = 0
        yield flush()

    # the empty word stands for all occurrences
    counted = materialize(docs.select(docs[text].alias("text")).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    total = counted.where(F.octet_length("word") == 0).agg(F.sum("n")).first()[0] or 0
    chosen = counted.where((F.octet_length("word") > 0) & (F.col("n") * F.lit(shared) > F.lit(total))).select("word")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = vocabulary_of(vocabulary)
        words = [w for batch in batches for w in batch.column(0).to_pylist()]  # fewer than ``shared`` of ``SHARED_BYTES``
        ids, length = merges.replay(words)
        ends = np.cumsum(length)
        rows = [ids[a:b].tobytes() for a, b in zip((ends - length).tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(rows, pa.binary())], ["word", "ids"])

    rows = chosen.mapInArrow(replay, "word binary, ids binary").toArrow()
    ids = rows["ids"].to_pylist()
    return rows["word"].to_pylist(), np.frombuffer(b"".join(ids), np.int32), np.array([len(x) // 4 for x in ids], np.int64)


class Encoder:
    """The ids of texts, block by block; words it has met are not replayed again until its memory is full."""

    def __init__(self, merges: Vocabulary, shared: Shared):
        self.merges, self.shared = merges, shared
        self._reset()

    def _reset(self) -> None:
        words, self.ids, self.length = self.shared
        self.slot = {word: i for i, word in enumerate(words)}
        self.size = 0

    def block(self, parts: list[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each array of texts: all ids in a row, and the number of ids of each text."""
        if len(self.slot) - len(self.shared[0]) > REMEMBERED or self.size > REMEMBERED_BYTES:
            self._reset()
        read, new = [], []
        slot = self.slot
        for texts in parts:
            words, index, counts = _words(texts)
            slots = np.empty(len(words), np.int32)
            for i, word in enumerate(words):
                at = slot.get(word)
                if at is None:
                    at = slot[word] = len(slot)
                    new.append(word)
                slots[i] = at
            read.append((slots[index], counts))
        ids, length = self.merges.replay(new)
        self.ids, self.length = np.concatenate([self.ids, ids]), np.concatenate([self.length, length])
        self.size += sum(map(len, new))
        begin = np.cumsum(self.length) - self.length
        for slots, counts in read:
            size = self.length[slots]
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            ids = self.ids[np.repeat(begin[slots], size) + step]
            upto = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts))]
            yield ids, np.diff(upto)


Batches = Iterator[pa.RecordBatch]


def _encoding(docs: DataFrame, text: str, doc_id: str, vocabulary: str, shared: int) -> tuple[DataFrame, Callable[[Batches], Batches]]:
    """The rows to encode and what a task does with them: (doc_id, text) batches to (doc_id, ids) batches."""
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(shared_words(rows, "text", vocabulary, shared))  # fewer than ``shared`` short words

    def work(batches: Batches) -> Batches:
        encoder = Encoder(vocabulary_of(vocabulary), common.value)
        waiting: list[pa.RecordBatch] = []
        size = 0

        def done() -> Batches:
            for part, (ids, counts) in zip(waiting, encoder.block([p.column(1) for p in waiting])):
                offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["doc_id", "ids"])

        for batch in batches:
            for part in pieces(batch, "text"):
                waiting.append(part)
                size += part.column(1).nbytes
                if size >= BLOCK_BYTES:
                    yield from done()
                    waiting, size = [], 0
        if waiting:
            yield from done()

    return rows, work


def encode(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY, shared: int = SHARED) -> DataFrame:
    """doc_id and ids (array of int) of every row."""
    rows, work = _encoding(docs, text, doc_id, vocabulary, shared)
    return rows.mapInArrow(work, "doc_id bigint, ids array<int>")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of an array column in a row, and where each row's end; null rows are empty."""
    column = pc.fill_null(column, pa.scalar([], column.type)) if column.null_count else column
    return column.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64))


def _decoding(at: int, name: str, vocabulary: str) -> Callable[[Batches], Batches]:
    """What a task does to add the bytes of the ids in column ``at``, some rows at a time."""

    def work(batches: Batches) -> Batches:
        merges = vocabulary_of(vocabulary)
        for batch in batches:
            for part in _rows_of(batch, at):
                flat, ends = _lists(part.column(at))
                data, size = merges.decode(flat)
                cut = np.append(0, np.cumsum(size))[np.append(0, ends)]
                column = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.RecordBatch.from_arrays([*part.columns, column.cast(pa.binary())], [*part.schema.names, name])

    return work


def _rows_of(batch: pa.RecordBatch, at: int) -> Batches:
    """Slices of a batch with about as many ids as a piece of text has; one row at least."""
    if not batch.num_rows:
        return
    upto = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.unique([0, *np.searchsorted(upto, np.arange(0, upto[-1], PIECE_BYTES // 2)), batch.num_rows]).tolist()
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def decode(coded: DataFrame, ids: str = "ids", vocabulary: str = VOCABULARY, name: str = "decoded") -> DataFrame:
    """``coded`` plus the bytes of its ids; a null row of ids gives no bytes."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields] + [f"`{name}` binary"])
    return coded.mapInArrow(_decoding(coded.columns.index(ids), name, vocabulary), schema)


def _digests(batches: Batches) -> Batches:
    """(doc_id, ids, decoded) batches to doc_id, n_tokens and the digests of the decimal ids and of the decoded bytes."""
    decimal: list[str] = []
    for batch in batches:
        flat, ends = _lists(batch.column(1))
        decimal += map(str, range(len(decimal), int(flat.max(initial=-1)) + 1))
        counts, ids = np.diff(np.append(0, ends)), []
        for a, b in zip((ends - counts).tolist(), ends.tolist()):
            ids.append(hashlib.sha256(" ".join([decimal[i] for i in flat[a:b].tolist()]).encode()).hexdigest())
        back = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        )


def round_trip(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY, shared: int = SHARED) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, decoded again and digested in one worker."""
    rows, encoding = _encoding(docs, text, doc_id, vocabulary, shared)
    decoding = _decoding(1, "decoded", vocabulary)

    def work(batches: Batches) -> Batches:
        return _digests(decoding(encoding(batches)))

    return rows.mapInArrow(work, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op11_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_byte_bpe": op11_byte_bpe}
SQL: dict[str, str] = {}
