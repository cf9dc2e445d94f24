"""Suffix-array dedup: bytes covered by a 50-byte string that an earlier document also holds.

1. Anchors. The 26 windows of 25 bytes in any 50-byte string have a least hash; equal strings have it at the same place.
   ``meeting.meet`` tells each text which of its anchors other texts hold; only the surroundings of those can repeat.
2. Shards. Each piece of texts sends, per anchor, its suffixes around it, in order of hashes and not of symbols: all 50-byte strings through the anchor lie
   in 25 bytes on either side of it. Equal surroundings of one anchor in a shard travel once, under the smallest document; the shard settles its other ones.
   Suffixes go to the bucket of their anchor, so equal strings meet and no bucket needs the whole corpus.
3. Merge. A bucket orders the suffixes of all shards by iterative interleave refinement, one symbol a round from the anchor on: round h takes the next symbol of every suffix in the present interleave and moves it stably inside its
   block. Blocks are never joined again, so the round in which a boundary appears is the common prefix there. The same
   rounds run to the left. No shard builds a Burrows-Wheeler transform or sorts by symbols, so this is one radix sort of a
   bucket's suffixes and no merge of sorted shards.
4. Repeated intervals. For each of the 26 starts, suffixes that share enough symbols on both sides form an interval; where
   it holds a smaller document, the start is a repeat. Starts become spans, spans of a text are united on its row.

Equal texts are settled first: of each set only the one with the smallest id goes through steps 2 to 4, the others repeat it
whole. Strings are judged on the input, never across texts.

Defined results: null and empty texts have 0 bytes and the digest of nothing; texts under 50 bytes are never cut; rows with
equal ids are one document and do not remove each other; a null id counts as larger than every other; repeated rows give
repeated results; an empty table gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.arrays import Texts, byte_values, few, pieces, rolling_hashes, window_hashes
from llm.meeting import KEY_BITS, bits_for, meet, text_bytes, unpack

LENGTH = 50
GRAM = 25
STARTS = LENGTH - GRAM + 1
AROUND = 2 * LENGTH - GRAM
SIDES = AROUND - GRAM
#: Bytes per anchor, about: (STARTS + 1) / 2.
BYTES_PER_ANCHOR = 13.5
#: Bits of an anchor's hash by which texts learn what others may hold; buckets compare all 64.
MEETING_BITS = 40
#: About so many anchors meet in one bucket's group.
MEETING_PER_BUCKET = 1_000_000
#: Anchors in one bucket's group of the merge, were all of them shared. Each comes with its surroundings, so they are fewer.
MERGED_PER_BUCKET = 500_000
#: Texts whose anchors meet in one packet a bucket, and shared anchors that a shard gathers before it sends: with more buckets packets stay large.
MEETING_BYTES = 4 << 20
ANCHORS_PER_SHARD = 300_000
#: Surroundings hashed at once.
HASHED_AT_ONCE = 1 << 14

_U = np.uint64
_LAST = np.iinfo(np.int64).max
_CODEC = "zstd"


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every window of ``width``, by doubling."""
    done = 1
    while 2 * done <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    return pick(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def anchors(texts: pa.Array) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
    """The texts; hash, place and text number of every anchor, ascending by place."""
    t = Texts(texts)
    n = len(t.data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return t, none.astype(_U), none, none
    h = rolling_hashes(t.data, GRAM)
    h[h == ~_U(0)] -= _U(1)
    # no window may leave its text: what spans a closing line feed counts as larger than all and is no anchor
    closed = np.zeros(n + 1, np.int32)
    closed[t.end + 1] = 1
    closed = np.cumsum(closed, dtype=np.int32)
    h[closed[GRAM:] != closed[:-GRAM]] = ~_U(0)
    least = _slide(h, STARTS, np.minimum)
    inside = closed[LENGTH : LENGTH + len(least)] == closed[: len(least)]
    least[~inside] = 0
    padded = np.concatenate([np.zeros(STARTS - 1, _U), least, np.zeros(STARTS - 1, _U)])
    place = np.flatnonzero((_slide(padded, STARTS, np.maximum) == h) & (h != ~_U(0)))
    return t, h[place], place, t.of(place)


def _keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, h, _, of = anchors(texts)
    return (h >> _U(64 - MEETING_BITS)) << _U(64 - MEETING_BITS), of


def _planes(x: np.ndarray) -> np.ndarray:
    """Integers as byte planes, which squeeze better."""
    return np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T)


def _squeeze(*arrays: np.ndarray) -> bytes:
    raw = b"".join(a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec(_CODEC, 3).compress(raw, asbytes=True)


def _shared(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of a piece of texts (key, doc, keys, text), the anchors that others hold: hash, document, key, reach to the left and to the right, symbols around, position."""
    t, h, place, of = anchors(part.column(3))
    # the anchors that meet() found elsewhere too
    lists = [unpack(k) if k else np.zeros(0, np.uint64) for k in part.column(2).to_pylist()]
    shared = np.zeros(len(h), bool)
    cut = np.searchsorted(of, np.arange(t.n + 1))
    for i, known in enumerate(lists):
        if len(known):
            a, b = cut[i], cut[i + 1]
            known = known >> _U(KEY_BITS - MEETING_BITS)
            mine = h[a:b] >> _U(64 - MEETING_BITS)
            spot = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            shared[a:b] = known[spot] == mine
    h, place, of = h[shared], place[shared], of[shared]
    doc, key = part.column(1).to_numpy()[of], part.column(0).to_numpy()[of]
    left = STARTS - 1
    lo = np.maximum(0, left - (place - t.start[of])).astype(np.uint8)
    hi = np.minimum(AROUND, t.end[of] - place + left).astype(np.uint8)
    # the symbols left and right of the anchor; its own are its hash
    column = np.append(np.arange(left), np.arange(left + GRAM, AROUND))
    around = t.data[np.clip(place[:, None] + (column - left), 0, len(t.data) - 1)]
    around[(column < lo[:, None]) | (column >= hi[:, None])] = 0
    return h, doc, key, lo, hi, around, place - t.start[of]


def _together(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*found))


def _row_hashes(wide: np.ndarray) -> np.ndarray:
    out = [np.zeros(0, _U)]
    for at in range(0, len(wide), HASHED_AT_ONCE):
        part = wide[at : at + HASHED_AT_ONCE]
        begin = np.arange(len(part)) * part.shape[1]
        out.append(window_hashes(byte_values(part.ravel()), begin, begin + part.shape[1]))
    return np.concatenate(out)


def _united_by(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans of each key united."""
    if not len(key):
        return key, a, b
    order = np.lexsort((a, key))
    key, a, b = key[order], a[order], b[order]
    far = np.cumsum(np.append(0, key[1:] != key[:-1])) * (int(b.max()) + 2)
    reach = np.maximum.accumulate(b + far)
    first = np.flatnonzero(np.append(True, (a + far)[1:] > reach[:-1]))
    last = np.append(first[1:], len(a)) - 1
    return key[first], a[first], reach[last] - far[last]


def _shard(part: pa.RecordBatch, bits: int) -> pa.RecordBatch:
    """What a piece of texts (key, doc, keys, text) sends to each bucket."""
    return _packed(_shared(part), bits)


def _packed(found: tuple[np.ndarray, ...], bits: int) -> pa.RecordBatch:
    """What a shard sends: to each bucket its anchors; the spans it has settled, united, under a number below 0."""
    h, doc, key, lo, hi, around, position = found
    left = STARTS - 1
    # equal surroundings once, under the smallest document
    same = _row_hashes(np.concatenate([around, lo[:, None], hi[:, None]], 1))
    order = np.lexsort((doc, same, h))
    new = np.ones(len(h), bool)
    # equal surroundings of another anchor are another string
    new[1:] = (same[order[1:]] != same[order[:-1]]) | (h[order[1:]] != h[order[:-1]])
    entry = np.cumsum(new) - 1
    first = order[new]
    head = doc[first]
    stays = doc[order] == head[entry] if len(h) else new
    settled = order[~stays]
    settled = settled[hi[settled].astype(int) - lo[settled] >= LENGTH]
    begin = position[settled] - left
    whole = _united_by(key[settled], begin + lo[settled], begin + hi[settled])
    order, entry = order[stays], entry[stays]
    bucket = (h[order] >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(order), np.int64)
    ends = np.searchsorted(bucket, np.arange((1 << bits) + 1))
    names, bodies = [], []
    for b in np.flatnonzero(np.diff(ends)):
        sent, number = order[ends[b] : ends[b + 1]], entry[ends[b] : ends[b + 1]]
        opens = np.append(True, number[1:] != number[:-1])
        f = sent[opens]
        sizes = np.array([len(f), len(sent)], np.int64)
        bodies.append(_squeeze(sizes, _planes(h[f]), _planes(doc[f]), lo[f], hi[f], around[f], opens, _planes(key[sent]), _planes(position[sent])))
        names.append(int(b))
    if len(whole[0]):
        names.append(-1 - int(whole[0][0] % (1 << bits)))
        bodies.append(_squeeze(np.array([-1, len(whole[0])], np.int64), *(_planes(x) for x in whole)))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(bodies, pa.binary())], ["bucket", "body"])


def _read(body: bytes) -> list[np.ndarray]:
    """Hash, document, reaches and symbols of the entries; entry, key and position of the anchors. Of settled spans: key, begin, end."""
    raw = pa.Codec(_CODEC, 1).decompress(body[8:], decompressed_size=int.from_bytes(body[:8], "little"), asbytes=True)
    n, m = np.frombuffer(raw, np.int64, 2)
    at = 16

    def take(size: int, width: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(raw, np.uint8, size * width, at)
        at += size * width
        return x

    def numbers(size: int) -> np.ndarray:
        return np.ascontiguousarray(take(size, 8).reshape(8, size).T).view(np.int64).ravel()

    if n < 0:
        return [numbers(m) for _ in range(3)]
    head = [numbers(n).view(np.uint64), numbers(n), take(n, 1), take(n, 1), take(n, SIDES).reshape(n, SIDES)]
    return [*head, np.cumsum(take(m, 1), dtype=np.int64) - 1, numbers(m), numbers(m)]


def interleave(block: np.ndarray, symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Merge by refinement: the interleave of all suffixes and, at each place, the symbols shared with the place before.

    ``block`` numbers the blocks of the first interleave, ascending; ``symbols[h]`` is the column that round h reads. A
    boundary made in round h stands for h common symbols; -1 stands between blocks of the start.
    """
    z = np.arange(len(block))
    common = np.full(len(block), len(symbols))
    edge = np.ones(len(block), bool)
    edge[1:] = block[1:] != block[:-1]
    common[edge] = -1
    alive = np.arange(len(block))
    for h, column in enumerate(symbols):
        # places in blocks of one suffix are settled
        lone = edge.copy()
        lone[:-1] &= edge[1:]
        alive = alive[~lone[alive]]
        if not len(alive):
            break
        number = np.cumsum(edge)[alive]
        key = number * 256 + column[z[alive]]
        order = np.argsort(key, kind="stable")
        z[alive] = z[alive][order]
        key = key[order]
        split = alive[1:][(key[1:] != key[:-1]) & ~edge[alive[1:]]]
        edge[split] = True
        common[split] = h
    return z, common


def repeats(h: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Per suffix group (one column of ``around`` each, ascending by anchor ``h``), a bit per start that a smaller document shares."""
    found = np.zeros(len(h), np.int64)
    block = np.cumsum(np.append(0, h[1:] != h[:-1])) if len(h) else h.astype(np.int64)
    left = STARTS - 1
    zr, right_common = interleave(block, [around[c] for c in range(left, SIDES)])
    zl, left_common = interleave(block, [around[c] for c in range(left - 1, -1, -1)])
    right, other = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
    for start in range(STARTS):
        # the 50 bytes from ``start``: the anchor, ``start`` symbols right of it and the rest left of it
        right[zr] = np.cumsum(right_common < start)
        other[zl] = np.cumsum(left_common < left - start)
        rows = np.flatnonzero((lo <= start) & (hi >= start + LENGTH))
        if len(rows) < 2:
            continue
        pair = right[rows] * (len(h) + 1) + other[rows]
        order = np.argsort(pair, kind="stable")
        s = pair[order]
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        least = np.minimum.reduceat(doc[rows][order], first)
        smaller = np.repeat(least, np.diff(np.append(first, len(s)))) < doc[rows][order]
        found[rows[order][smaller]] |= 1 << start
    return found


def _merge(group: pa.Table) -> pa.Table:
    """Spans (key, a, b) that a bucket's shards repeat, or have settled."""
    shards = [_read(x) for x in group["body"].to_pylist()]
    if len(shards[0]) == 3:
        return pa.table(dict(zip(("key", "a", "b"), _together(shards))))
    sizes = np.array([len(s[0]) for s in shards])
    h, doc, lo, hi = (np.concatenate([s[i] for s in shards]) for i in range(4))
    around = np.concatenate([s[4] for s in shards])
    base = np.cumsum(sizes) - sizes
    entry = np.concatenate([s[5] + b for s, b in zip(shards, base)])
    key, position = (np.concatenate([s[i] for s in shards]) for i in (6, 7))
    del shards
    # the first interleave: shards one after the other inside each anchor; anchors of one document only drop out
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1])) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(h)))
    apart = np.repeat(np.minimum.reduceat(doc[order], first) != np.maximum.reduceat(doc[order], first), count) if len(h) else np.zeros(0, bool)
    order = order[apart]
    bits = np.zeros(len(h), np.int64)
    bits[order] = repeats(h[order], doc[order], lo[order], hi[order], np.ascontiguousarray(around[order].T))
    bits = bits[entry]
    keys, begins, ends = [], [], []
    left = STARTS - 1
    for start in range(STARTS):
        # runs of set bits: a run begins where the bit before is not set
        here = (bits >> start) & 1 == 1
        if start:
            here &= (bits >> (start - 1)) & 1 == 0
        rows = np.flatnonzero(here)
        run = np.zeros(len(rows), np.int64)
        rest = bits[rows] >> start
        while (rest & 1).any():
            run += rest & 1
            rest = np.where(rest & 1 == 1, rest >> 1, 0)
        keys.append(key[rows])
        begins.append(position[rows] - left + start)
        ends.append(position[rows] - left + start + run - 1 + LENGTH)
    return pa.table({"key": np.concatenate(keys), "a": np.concatenate(begins), "b": np.concatenate(ends)})


def _united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.append(True, a[1:] > b[:-1])
    first = np.flatnonzero(new)
    return a[first], b[np.append(first[1:], len(a)) - 1]


def cuts(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs`` as (key, row); keys that repeat a whole text; (key, spans), arrays of a << 32 | b to remove that may overlap.

    The rows are shuffled by key once, with their texts squeezed: all joins read that exchange. ``_plain`` gives the texts.
    """
    key = F.xxhash64(doc_id, text)
    body = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    at = docs.columns.index(text)
    squeezed = T.StructType([T.StructField(f.name, T.BinaryType() if i == at else f.dataType) for i, f in enumerate(docs.schema.fields)])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            row = batch.column(1)
            fields = [row.field(i) for i in range(row.type.num_fields)]
            fields[at] = pa.array([None if x is None else _squeezed(x) for x in fields[at].cast(pa.binary()).to_pylist()], pa.binary())
            names = [row.type.field(i).name for i in range(row.type.num_fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.StructArray.from_arrays(fields, names=names)], ["key", "row"])

    # nullable columns would get a filter in some joins, and the exchange of their own
    body = body.mapInArrow(squeeze, T.StructType([T.StructField("key", T.LongType(), False), T.StructField("row", squeezed, False)]))
    ids = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_LAST))
    named = docs.select(key.alias("key"), F.xxhash64(text, F.octet_length(text)).alias("same"), ids.alias("doc"))
    # the smallest document of each text; distinct keys only, so equal rows count once
    least = named.groupBy("same").agg(F.min("doc").alias("least"))
    named = named.distinct().join(least, "same").select("key", (F.col("doc") > F.col("least")).alias("whole"))
    whole = named.where("whole")
    total = text_bytes(docs, text)
    bits = bits_for(total, BYTES_PER_ANCHOR, MERGED_PER_BUCKET)
    # meet() names rows by their place, so a task that is run again must see them in the same order
    firsts = body.join(named.where("NOT whole").select("key"), "key").select("key", "row").sortWithinPartitions("key")
    met = meet(firsts, _keys, bits_for(total, BYTES_PER_ANCHOR, MEETING_PER_BUCKET), once=False, texts=lambda row: _plain(row.field(at)), piece_bytes=MEETING_BYTES, counted=False)
    shared = met.where("shared > 0").select(F.col("id").alias("key"), "keys").dropDuplicates(["key"])
    sending = body.join(shared, "key").select("key", "row", "keys")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for batch in few(batches):
            row = batch.column(1)
            doc = pc.fill_null(row.field(doc_id).cast(pa.int64()), _LAST)
            flat = pa.RecordBatch.from_arrays([batch.column(0), doc, batch.column(2), _plain(row.field(at))], ["key", "doc", "keys", "text"])
            for part in pieces(flat, "text"):
                found.append(_shared(part))
                n += len(found[-1][0])
                if n >= ANCHORS_PER_SHARD:
                    yield _packed(_together(found), bits)
                    found, n = [], 0
        if n:
            yield _packed(_together(found), bits)

    merged = sending.mapInArrow(send, "bucket bigint, body binary").groupBy("bucket").applyInArrow(_merge, "key bigint, a bigint, b bigint")
    # one number a span, dealt out before it is collected: a list of one takes more
    one = merged.select("key", F.shiftleft("a", 32).bitwiseOR(F.col("b")).alias("span")).repartition("key")
    return body, whole, one.groupBy("key").agg(F.collect_list("span").alias("spans"))


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + pa.Codec(_CODEC, 1).compress(data, asbytes=True)


def _plain(squeezed: pa.Array) -> pa.Array:
    """The texts that ``cuts`` has squeezed."""
    codec = pa.Codec(_CODEC, 1)
    texts = [None if x is None else codec.decompress(x[4:], decompressed_size=int.from_bytes(x[:4], "little"), asbytes=True) for x in squeezed.to_pylist()]
    return pa.array(texts, pa.binary()).cast(pa.string(), safe=False)


def _spans(length: int, spans, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    if whole and length >= LENGTH:
        return np.array([0]), np.array([length])
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.array(spans, np.int64)
    return _united(both >> 32, both & 0xFFFFFFFF)


def _kept(data: bytes, a: np.ndarray, b: np.ndarray) -> bytes:
    begin = [0, *b.tolist()]
    return b"".join(data[x:y] for x, y in zip(begin, [*a.tolist(), len(data)]))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    body, whole, spans = cuts(docs.select(doc_id, text), text, doc_id)
    full = body.join(whole, "key", "left").join(spans, "key", "left").select("row", "whole", "spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            row = batch.column(0)
            out = []
            for t, w, s in zip(_plain(row.field(text)), batch.column(1), batch.column(2)):
                data = (t.as_py() or "").encode()
                a, b = _spans(len(data), s.as_py(), bool(w.as_py()))
                out.append((len(data), int((b - a).sum()), len(a), hashlib.sha256(_kept(data, a, b)).hexdigest()))
            columns = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [row.field(doc_id).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return full.mapInArrow(work, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text; all rows and columns stay (a text may become empty).

    A cut may fall inside a character; what is left of it goes too, so the text stays valid UTF-8. A column ``n_chars``
    is set to the text's new length in characters.
    """
    body, whole, spans = cuts(docs, text, doc_id)
    full = body.join(whole, "key", "left").join(spans, "key", "left").select("row", "whole", "spans")
    at, names = docs.columns.index(text), docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            row = batch.column(0)
            columns, types = [row.field(i) for i in range(len(names))], [row.type.field(i).type for i in range(len(names))]
            columns[at], types[at] = _plain(columns[at]), pa.string()
            texts = []
            for t, w, s in zip(columns[at], batch.column(1), batch.column(2)):
                data = t.as_py()
                if data is not None:
                    raw = data.encode()
                    a, b = _spans(len(raw), s.as_py(), bool(w.as_py()))
                    data = _kept(raw, a, b).decode("utf-8", "ignore") if len(a) else data
                texts.append(data)
            columns[at] = pa.array(texts, types[at])
            if "n_chars" in names:
                n = names.index("n_chars")
                columns[n] = pa.array([None if t is None else len(t) for t in texts], types[n])
            yield pa.RecordBatch.from_arrays(columns, names)

    return full.mapInArrow(work, docs.schema)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
SQL: dict[str, str] = {}
