"""SentencePiece encoding and decoding by best-scoring segmentation, with a max-plus scan over giant documents.

The vocabulary file gives pieces and scores; the ids of a text are those of the segmentation with the largest sum of
scores. A character that is no piece costs less than any piece and is written as its bytes. (The given file was made for
merging; its scores rank the merges, so the best-scoring segmentation is a valid encoding but not always the merged one.)

Most texts are segmented at once: no piece crosses the start of a word, so a text's best segmentation is that of its units.
The new units of a slice of text are segmented together, position by position, and a worker remembers short units up to a
number of bytes. A text of more than ``CHUNK`` characters is cut into chunks anywhere, also inside words. Of a
path through the text only its last node at or before a boundary matters, one of as many states as the longest piece has
characters. Each chunk yields the matrix of best scores from every entering to every leaving state; matrices combine
associatively by max-plus products, which gives each boundary the best score of each state. From these a chunk tells, for
each state it may be left in, the state in which the one path that ties allow enters it; looked up from the end, these tables
give each boundary its state, and each chunk is backtraced on its own between its two states. Chunks, matrices, tables and
backtraces are rows and tasks of their own. The ids are those of one pass whatever the chunks, as long as scores are whole
numbers (sums of others may round differently).

Defined results: null and empty texts have no pieces and decode to an empty text; ties go to the longer last piece; null
ids and repeated rows are rows of their own; U+2581 in a text reads as a space, so such texts do not decode to themselves;
an empty table gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.arrays import pieces

VOCABULARY = "piece_bpe_32k.model"
CHUNK = 1 << 16
#: Units of at most so many characters are segmented together and remembered, up to about so many bytes a worker.
SHORT = 24
REMEMBERED_BYTES = 48 << 20
BLOCK = 8192
#: A row of ids is decoded so many at a time; rows are dealt on after as many.
IDS = 1 << 18
SPACE = "▁"
#: A unit begins at a space after something else, and around line feeds, which no piece holds.
_UNIT = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
_NONE = float("-inf")
_BASE, _LEAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(44)


class Pieces:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.texts = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [i for i in range(len(self.texts)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {self.texts[i]: float(model.get_score(i)) for i in plain}
        self.id = {self.texts[i]: i for i in plain}
        self.bytes = {int(self.texts[i][3:-1], 16): i for i in range(len(self.texts)) if model.is_byte(i)}
        byte_of = {i: b for b, i in self.bytes.items()}
        self.raw = [bytes([byte_of[i]]) if i in byte_of else t.encode() for i, t in enumerate(self.texts)]
        self.unknown_id = model.unk_id()
        self.longest = max(len(t) for t in self.score)
        self.unknown = min(self.score.values()) - 10.0
        self.known: dict[str, bytes] = {}
        self.held = 0
        self._index()

    def _index(self) -> None:
        """Pieces by length: ascending hashes, ids and scores; and which leading bits any of the hashes has."""
        self.characters = {t for t in self.score if len(t) == 1}
        self.by_length = []
        self.leads = np.zeros(1 << 20, bool)
        for k in range(1, self.longest + 1):
            texts = [t for t in self.score if len(t) == k]
            codes = _codes("".join(texts)).reshape(len(texts), k)
            h = np.zeros(len(texts), np.uint64)
            for column in codes.T:
                h = h * _BASE + column
            order = np.argsort(h)
            h = h[order]
            if (h[1:] == h[:-1]).any():
                raise ValueError("two pieces of one hash")
            self.leads[h >> _LEAD] = True
            self.by_length.append((h, codes[order], np.array([self.id[texts[i]] for i in order], np.uint32), np.array([self.score[texts[i]] for i in order])))

    def ids_of(self, piece: str) -> list[int]:
        if piece in self.id:
            return [self.id[piece]]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown_id]

    def arc(self, text: str, a: int, b: int) -> float:
        """The score of ``text[a:b]`` as one step."""
        s = self.score.get(text[a:b])
        return (self.unknown if b - a == 1 else _NONE) if s is None else s

    def forward(self, text: str, start: int = 0) -> tuple[list[float], list[int]]:
        """Best scores from ``start`` to each later position, and the last step's beginning."""
        best, back = [_NONE] * (len(text) + 1), [-1] * (len(text) + 1)
        best[start] = 0.0
        get, longest, unknown = self.score.get, self.longest, self.unknown
        for end in range(start + 1, len(text) + 1):
            for a in range(max(start, end - longest), end):
                if best[a] == _NONE:
                    continue
                s = get(text[a:end])
                if s is None:
                    if end - a > 1:
                        continue
                    s = unknown
                if best[a] + s > best[end]:
                    best[end], back[end] = best[a] + s, a
        return best, back

    def path(self, text: str, back: list[int], end: int, start: int = 0) -> array:
        steps = []
        while end > start:
            steps.append(text[back[end] : end])
            end = back[end]
        out = array("I")
        for step in reversed(steps):
            out.extend(self.ids_of(step))
        return out

    def together(self, units: list[str]) -> None:
        """Remembers the ids of units, each of 1 to ``SHORT`` characters that are all pieces, by one recurrence over positions."""
        units = sorted(units, key=len, reverse=True)
        codes = _codes("".join(units))
        size = np.array([len(u) for u in units])
        start = np.cumsum(size) - size
        end = np.repeat(start + size, size)
        live = np.arange(len(codes))  # where a substring of k characters begins
        h = np.zeros(len(codes), np.uint64)
        depth = min(self.longest, int(size[0]))
        score, piece = np.full((depth, len(codes)), _NONE), np.zeros((depth, len(codes)), np.uint32)
        for k, (hashes, texts, ids, values) in enumerate(self.by_length[:depth], 1):
            fits = live + k <= end[live]
            live, h = live[fits], h[fits] * _BASE
            h += codes[live + (k - 1)]
            maybe = np.flatnonzero(self.leads[h >> _LEAD])
            if len(hashes) and len(maybe):
                found = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
                same = hashes[found] == h[maybe]
                at, found = live[maybe[same]], found[same]
                same = (codes[at[:, None] + np.arange(k)] == texts[found]).all(1)
                score[k - 1, at[same]], piece[k - 1, at[same]] = values[found[same]], ids[found[same]]
        first = start + np.arange(len(units))  # a unit has one node more than characters
        best, back = np.zeros(len(codes) + len(units)), np.zeros(len(codes) + len(units), np.int64)
        longest = int(size[0])
        for e in range(1, longest + 1):
            n = int(np.searchsorted(-size, -e, side="right"))
            b, c = first[:n], start[:n]
            top, step = np.full(n, _NONE), np.zeros(n, np.int64)
            for k in range(min(e, self.longest), 0, -1):
                value = best[b + (e - k)] + score[k - 1, c + (e - k)]
                step = np.where(value > top, k, step)
                top = np.maximum(top, value)
            best[b + e], back[b + e] = top, step
        out, place, left = np.zeros((len(units), longest), np.uint32), np.full(len(units), longest), size.copy()
        while (open_ := np.flatnonzero(left)).size:
            step = back[first[open_] + left[open_]]
            left[open_] -= step
            place[open_] -= 1
            out[open_, place[open_]] = piece[step - 1, start[open_] + left[open_]]
        found = {u: row[a:].tobytes() for u, row, a in zip(units, out, place.tolist())}
        self.known.update(found)
        self.held += sum(map(len, found.values())) + sum(map(len, units)) * 2 + 250 * len(units)

    def unit(self, text: str) -> bytes:
        _, back = self.forward(text)
        return self.path(text, back, len(text)).tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids (native unsigned 32-bit) of prepared texts that are segmented at once."""
        if self.held > REMEMBERED_BYTES:
            self.known.clear()
            self.held = 0
        cut = [_UNIT.findall(t) for t in texts]
        known = self.known
        new = {u for units in cut for u in units if u not in known}
        together = [u for u in new if len(u) <= SHORT and self.characters.issuperset(u)]
        for i in range(0, len(together), BLOCK):
            self.together(together[i : i + BLOCK])
        rest = {u: self.unit(u) for u in new.difference(together)}
        return [b"".join([known[u] if u in known else rest[u] for u in units]) for units in cut]

    def encode(self, text: str) -> array:
        """The ids of one prepared text."""
        return array("I", self.encode_all([text])[0])

    def decode(self, ids: np.ndarray | array | list[int]) -> str:
        ids = np.asarray(ids, np.int64)
        raw = b"".join([b"".join([self.raw[i] for i in ids[a : a + IDS].tolist()]) for a in range(0, len(ids), IDS)])
        return raw.decode("utf-8", "replace").replace(SPACE, " ")[1:]

    # -- chunks: ``text`` begins ``left`` characters before the chunk; state i is a node i characters before a boundary

    def matrix(self, text: str, left: int) -> np.ndarray:
        """Best scores from each entering to each leaving state, less what all paths share."""
        size, end = self.longest, len(text)
        out = np.full((size, size), _NONE)
        cuts = self._cuts(text, left, end)
        if cuts:
            # every path passes the forced nodes, so the matrix is a sum of a column and a row
            head = self._crossings(text[: cuts[0]], left)[-1]
            tail, _ = self.forward(text[cuts[-1] :])
            return head[:, None] + np.array([tail[end - cuts[-1] - j] if end - j >= cuts[-1] else _NONE for j in range(size)])[None, :]
        best = self._crossings(text, left)
        for j in range(min(size, end - left)):
            out[:, j] = best[end - j - left]
        return out

    def entries(self, text: str, left: int, ahead: np.ndarray) -> list[int]:
        """For each leaving state, the state that the path to it enters in, given the best scores of the entering states.

        A step taken is the longest of the best ones, as in ``forward``.
        """
        size = self.longest
        cuts = self._cuts(text, left, len(text))
        body = text[: cuts[0]] if cuts else text
        best = (self._crossings(body, left) + ahead[None, :]).max(1)
        nodes = [len(body)] * size if cuts else [len(body) - j for j in range(size)]
        found: dict[int, int] = {}
        for node in nodes:
            at = node
            while at > left and at not in found:
                for a in range(max(0, at - size), at):
                    base = ahead[left - a] if a <= left and left - a < size else best[a - left] if a > left else _NONE
                    if base > _NONE and base + self.arc(body, a, at) == best[at - left]:
                        at = a
                        break
                else:
                    break  # no path leaves in this state
            found[node] = found[at] if at in found else max(0, left - at) if at <= left else 0
        return [found[node] for node in nodes]

    def _cuts(self, text: str, left: int, end: int) -> list[int]:
        return [m.start() for m in _UNIT.finditer(text) if left < m.start() < end and self._forced(text, m.start())]

    @staticmethod
    def _forced(text: str, at: int) -> bool:
        return text[at] == "\n" or text[at - 1] == "\n" or (text[at] == SPACE and text[at - 1] != SPACE)

    def _crossings(self, text: str, left: int) -> np.ndarray:
        """Best scores from each entering state (columns) to each position after ``left`` (rows)."""
        size, get = self.longest, self.score.get
        best = np.full((len(text) + 1 - left, size), _NONE)
        for end in range(left + 1, len(text) + 1):
            row = best[end - left]
            for a in range(max(0, end - size), end):
                s = get(text[a:end])
                if s is None:
                    if end - a > 1:
                        continue
                    s = self.unknown
                if a > left:
                    np.maximum(row, best[a - left] + s, out=row)
                elif left - a < size:
                    row[left - a] = max(row[left - a], s)
        return best

    def _crossing(self, text: str, left: int, i: int) -> tuple[list[float], list[int]]:
        """``forward`` from the node ``i`` characters before the chunk, whose first step crosses into it."""
        start = left - i
        best, back = [_NONE] * (len(text) + 1), [-1] * (len(text) + 1)
        for end in range(left + 1, len(text) + 1):
            for a in ([start] if end - start <= self.longest else []) + list(range(max(left + 1, end - self.longest), end)):
                base = 0.0 if a == start else best[a]
                s = self.arc(text, a, end)
                if base + s > best[end]:
                    best[end], back[end] = base + s, a
        return best, back

    def backtrace(self, text: str, left: int, enter: int, leave: int) -> array:
        """The ids of the best path from one state to the other."""
        start, end = left - enter, len(text) - leave
        cuts = self._cuts(text, left, end)
        if not cuts:
            _, back = self._crossing(text, left, enter)
            return self.path(text, back, end, start)
        _, back = self._crossing(text[: cuts[0]], left, enter)
        out = self.path(text, back, cuts[0], start)
        out += self.encode(text[cuts[0] : cuts[-1]])
        _, back = self.forward(text[cuts[-1] : end])
        return out + self.path(text[cuts[-1] : end], back, end - cuts[-1])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Products of all prefixes, by pairs: an associative scan whose depth is the logarithm of the length."""
    if len(matrices) < 2:
        return matrices
    pairs = scan([product(a, b) for a, b in zip(matrices[::2], matrices[1::2])])
    return [matrices[0], *(pairs[i // 2] if i % 2 else product(pairs[i // 2 - 1], matrices[i]) for i in range(1, len(matrices)))]


def entering(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """The best score of each state before each chunk."""
    start = np.full(len(matrices[0]), _NONE)
    start[0] = 0.0
    return [start, *(m[0] for m in scan(matrices)[:-1])]


def boundary_states(tables: list[list[int]]) -> list[int]:
    """The state at each boundary, the start and the end included, from what ``Pieces.entries`` tells of each chunk."""
    states = [0]
    for table in reversed(tables):
        states.append(int(table[states[-1]]))
    return states[::-1]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


_MODELS: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """One model per worker and vocabulary."""
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def prepare(text: str | None) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def encode(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY, chunk: int = CHUNK) -> DataFrame:
    """doc_id, ids (array of int), text for every row."""
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    short = rows.where(F.col("text").isNull() | (F.length("text") < chunk))
    giant = rows.where(F.length("text") >= chunk)

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(public_tokenizers.path(vocabulary))
        for batch in batches:
            for part in pieces(batch, "text"):
                ids = m.encode_all([prepare(t) for t in part.column(1).to_pylist()])
                offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), part.column(1)], ["doc_id", "ids", "text"])

    done = short.mapInArrow(at_once, "doc_id bigint, ids array<int>, text string")

    # giant documents: rows of their own, dealt evenly; equal rows keep apart by their number
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = model(public_tokenizers.path(vocabulary)).longest - 1
        for batch in batches:
            for i, t in enumerate(batch.column(1).to_pylist()):
                body = prepare(t)
                begins = range(0, len(body), chunk)
                parts = [body[max(0, a - left) : a + chunk] for a in begins]
                if len(body) - begins[-1] < left + 1 and len(parts) > 1:  # a last chunk is longer than any piece
                    parts[-2:] = [body[max(0, begins[-2] - left) :]]
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hash_key(t)] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([min(left, a) for a in begins][:n], pa.int64()), pa.array(parts, pa.string())],
                    ["key", "no", "left", "chunk"],
                )

    giants = giant.select("doc_id", "text").dropDuplicates(["text"])
    chunks = giants.mapInArrow(split, "key bigint, no bigint, left bigint, chunk string").repartition("key", "no")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(public_tokenizers.path(vocabulary))
        for batch in batches:
            found = [m.matrix(t, n).tobytes() for n, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["key", "no", "matrix"])

    def combine(group: pa.Table) -> pa.Table:
        group = group.sort_by("no")
        matrices = [np.frombuffer(x, np.float64) for x in group["matrix"].to_pylist()]
        size = int(len(matrices[0]) ** 0.5)
        ahead = entering([x.reshape(size, size) for x in matrices])
        return pa.table({"key": group["key"], "no": group["no"], "ahead": pa.array([x.tobytes() for x in ahead], pa.binary())})

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(public_tokenizers.path(vocabulary))
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            found = [m.entries(text, left, np.frombuffer(ahead, np.float64)) for _, _, left, text, ahead in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["key", "no", "entries"])

    def choose(group: pa.Table) -> pa.Table:
        group = group.sort_by("no")
        states = boundary_states(group["entries"].to_pylist())
        return pa.table({"key": group["key"], "no": group["no"], "enter": pa.array(states[:-1], pa.int64()), "leave": pa.array(states[1:], pa.int64())})

    ahead = chunks.mapInArrow(measure, "key bigint, no bigint, matrix binary").groupBy("key").applyInArrow(combine, "key bigint, no bigint, ahead binary")
    told = chunks.join(ahead, ["key", "no"]).select("key", "no", "left", "chunk", "ahead").mapInArrow(tell, "key bigint, no bigint, entries array<int>")
    states = told.groupBy("key").applyInArrow(choose, "key bigint, no bigint, enter bigint, leave bigint")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(public_tokenizers.path(vocabulary))
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            ids = [m.backtrace(text, left, enter, leave).tobytes() for _, _, left, text, enter, leave in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["key", "no", "ids"])

    def assemble(group: pa.Table) -> pa.Table:
        raw = b"".join(group.sort_by("no")["ids"].to_pylist())
        ids = np.frombuffer(raw, np.uint32).astype(np.int32)
        return pa.table({"key": group["key"].slice(0, 1), "ids": pa.array([ids], pa.list_(pa.int32()))})

    traced = chunks.join(states, ["key", "no"]).select("key", "no", "left", "chunk", "enter", "leave").mapInArrow(trace, "key bigint, no bigint, ids binary")
    whole = traced.groupBy("key").applyInArrow(assemble, "key bigint, ids array<int>")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([hash_key(t) for t in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "text", "key"])

    back = giant.mapInArrow(named, "doc_id bigint, text string, key bigint").join(whole, "key").select("doc_id", "ids", "text")
    return done.unionByName(back)


def hash_key(text: str) -> int:
    from hashlib import blake2b

    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column laid end to end and where each row's begin; a null is empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.append(0, sizes))


def _dealt(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch by rows so that each part has about ``IDS`` values in its list column ``at``, one row at least."""
    _, offsets = _lists(batch.column(at))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + IDS, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``encoded`` (doc_id, ids and any other columns) plus ``decoded``."""
    schema = encoded.schema.simpleString()[len("struct<") : -1]
    at = encoded.columns.index("ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(public_tokenizers.path(vocabulary))
        for batch in batches:
            for part in _dealt(batch, at):
                ids, offsets = _lists(part.column(at))
                texts = [m.decode(ids[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(work, f"{schema}, decoded string")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    both = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _dealt(batch, 1):
                ids, offsets = _lists(part.column(1))
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                same = pc.equal(pc.fill_null(part.column(2), ""), part.column(3))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(crc, pa.int64()), same], ["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return both.mapInArrow(digest, "doc_id bigint, n_pieces bigint, ids_crc32 bigint, round_trip boolean")


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
SQL: dict[str, str] = {}
