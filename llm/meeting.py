"""Find the keys that several texts share, without a row per key.

A task packs the keys of a piece of texts into sorted byte planes, one packet per bucket of the key space. A bucket's
packets meet in one group, which counts each key's texts and answers every packet with the keys that more than one text
holds. The answers return to their piece, which gives each text its shared keys with their counts. Two shuffles, both of
packed bytes; buckets grow in number with the corpus, pieces are bounded, and repeated texts of a piece travel once.

Keys are 48 bits of a hash; a text's number inside its piece has 16 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.arrays import PIECE_BYTES, few, mix, pieces

KEY_BITS = 48
ROW_BITS = 16
ROWS_PER_PIECE = 1 << ROW_BITS
#: About so many keys are in one bucket's group at once.
KEYS_PER_BUCKET = 4_000_000
LEAST_BUCKETS = 256

_U = np.uint64
_CODEC = "zstd"


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values as byte planes, squeezed; sorted values have nearly constant upper planes."""
    planes = np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.Codec(_CODEC, 1).compress(planes.tobytes(), asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = pa.Codec(_CODEC, 1).decompress(data[8:], decompressed_size=8 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(">u8").astype(np.uint64).ravel()


def text_bytes(rows: DataFrame, text: str) -> int:
    """The size of all texts."""
    return rows.agg(F.sum(F.octet_length(text))).first()[0] or 0


def bits_for(total: int, bytes_per_key: float, keys_per_bucket: int = KEYS_PER_BUCKET) -> int:
    """Bits of the key that name its bucket, for texts of ``total`` bytes."""
    return (max(LEAST_BUCKETS, int(total / bytes_per_key / keys_per_bucket)) - 1).bit_length()


def bucket_bits(rows: DataFrame, text: str, bytes_per_key: float) -> int:
    """Bits of the key that name its bucket, from the size of all texts."""
    return bits_for(text_bytes(rows, text), bytes_per_key)


Keys = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def meet(rows: DataFrame, keys: Keys, bits: int, once: bool, texts: Callable[[pa.Array], pa.Array] | None = None, piece_bytes: int = PIECE_BYTES, counted: bool = True) -> DataFrame:
    """Give each text of ``rows`` (id bigint, text string) its shared keys.

    With ``texts``, that function makes the texts of the second column. Pieces of more than ``PIECE_BYTES`` still get
    their keys piece by piece, and send larger packets. Without ``counted`` no counts travel, and ``counts`` are zeros.

    ``keys`` maps texts to (hash, text number) pairs in any order, repeats allowed. With ``once``, only the first of the
    texts of a piece that have the same set of keys takes part; the others come back with null ``keys``.
    Returns id, n (distinct keys), sig (hash of the set), keys and counts (packed, aligned, ascending by key).
    The rows must come in the same order whenever a task is run again, as they do from files.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in few(batches) if texts else batches:
            plain = batch.column(1) if texts is None else texts(batch.column(1))
            for lump in pieces(pa.RecordBatch.from_arrays([batch.column(0), plain], ["id", "text"]), "text", piece_bytes):
                for at in range(0, lump.num_rows, ROWS_PER_PIECE):
                    part = lump.slice(at, ROWS_PER_PIECE)
                    name = f"{TaskContext.get().partitionId()}:{number}"
                    number += 1
                    yield _packets(part, keys, bits, once, name)

    sent = rows.mapInArrow(send, "bucket bigint, piece string, body binary")

    def answer(group: pa.Table) -> pa.Table:
        if group["bucket"][0].as_py() < 0:
            return group.select(["piece", "body"])
        packets = [unpack(x) for x in group["body"].to_pylist()]
        sizes = np.array([len(p) for p in packets])
        every = np.concatenate(packets)
        del packets
        key = every >> _U(ROW_BITS)
        order = np.argsort(key)
        s = key[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        first = np.flatnonzero(new)
        count = np.empty(len(s), np.int64)
        count[order] = np.repeat(np.diff(np.append(first, len(s))), np.diff(np.append(first, len(s))))
        cut = np.append(0, np.cumsum(sizes))
        names, bodies = [], []
        for name, a, b in zip(group["piece"].to_pylist(), cut, cut[1:]):
            shared = count[a:b] > 1
            if shared.any():
                names.append(name)
                found = pack(every[a:b][shared])
                bodies.append(b"K" + len(found).to_bytes(8, "little") + found + (pack(count[a:b][shared].astype(np.uint64)) if counted else b""))
        return pa.table({"piece": pa.array(names, pa.string()), "body": pa.array(bodies, pa.binary())})

    answered = sent.groupBy("bucket").applyInArrow(answer, "piece string, body binary")

    def gather(group: pa.Table) -> pa.Table:
        found, counts, rows_of = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], None
        for body in group["body"].to_pylist():
            if body[:1] == b"M":
                rows_of = np.frombuffer(body[1:], np.int64).reshape(5, -1)
            else:
                size = int.from_bytes(body[1:9], "little")
                found.append(unpack(body[9 : 9 + size]))
                counts.append(unpack(body[9 + size :]) if counted else np.zeros(len(found[-1]), np.uint64))
        every, count = np.concatenate(found), np.concatenate(counts)
        known, ids, n, sig, takes_part = rows_of
        row = (every & _U(ROWS_PER_PIECE - 1)).astype(np.int64)
        order = np.lexsort((every, row))
        key, count = (every >> _U(ROW_BITS))[order], count[order]
        cut = np.searchsorted(row[order], np.arange(len(ids) + 1))
        live = takes_part == 1
        return pa.table(
            {
                "id": pa.array(ids, mask=known == 0),
                "n": pa.array(n),
                "sig": pa.array(sig),
                "shared": pa.array(np.diff(cut)),
                "keys": pa.array([pack(key[a:b]) if ok else None for ok, a, b in zip(live, cut, cut[1:])], pa.binary()),
                "counts": pa.array([pack(count[a:b]) if ok else None for ok, a, b in zip(live, cut, cut[1:])], pa.binary()),
            }
        )

    return answered.groupBy("piece").applyInArrow(gather, "id bigint, n bigint, sig bigint, shared bigint, keys binary, counts binary")


def _packets(part: pa.RecordBatch, keys: Keys, bits: int, once: bool, name: str) -> pa.RecordBatch:
    hashes, of, at = [np.zeros(0, _U)], [np.zeros(0, np.int64)], 0
    for small in pieces(part, "text", PIECE_BYTES):
        found, rows = keys(small.column(1))
        hashes.append(found), of.append(rows + at)
        at += small.num_rows
    hashes, of = np.concatenate(hashes), np.concatenate(of)
    packed = np.sort(((hashes >> _U(64 - KEY_BITS)) << _U(ROW_BITS)) | of.astype(_U))
    new = np.ones(len(packed), bool)
    new[1:] = packed[1:] != packed[:-1]
    packed = packed[new]
    row = (packed & _U(ROWS_PER_PIECE - 1)).astype(np.int64)
    n = np.bincount(row, minlength=part.num_rows)
    order = np.argsort(row, kind="stable")
    total = np.append(_U(0), np.cumsum(mix(packed[order] >> _U(ROW_BITS))))
    ends = np.cumsum(n)
    sig = mix((total[ends] - total[ends - n]) + n.astype(_U)).view(np.int64)
    live = np.ones(part.num_rows, np.int64)
    if once:
        live[:] = 0
        live[np.unique(sig, return_index=True)[1]] = 1
        packed = packed[live[row] == 1]
    ids = part.column(0)
    about = np.stack([np.asarray(ids.is_valid(), np.int64), ids.fill_null(0).to_numpy(), n, sig, live])
    cut = np.searchsorted((packed >> _U(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
    used = np.flatnonzero(np.diff(cut))
    own = -1 - (hash_text(name) % (1 << bits))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.append(used, own), pa.int64()),
            pa.array([name] * (len(used) + 1), pa.string()),
            pa.array([*(pack(packed[cut[b] : cut[b + 1]]) for b in used), b"M" + about.tobytes()], pa.binary()),
        ],
        ["bucket", "piece", "body"],
    )


def hash_text(name: str) -> int:
    return int(mix(np.array([sum((i + 1) * c for i, c in enumerate(name.encode()))], np.uint64))[0])
