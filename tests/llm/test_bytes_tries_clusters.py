"""Byte-level BPE, the conversation trie and centroid clustering against libraries and brute force, with awkward rows."""

from __future__ import annotations

import hashlib
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from compare import compare, connect  # noqa: E402
from llm import byte_bpe, centroids, prefix_trie, registry  # noqa: E402


@pytest.fixture(scope="module", autouse=True)
def _checkpoints(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))


def digest(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# ---- 11


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.vocabulary_of(byte_bpe.VOCABULARY).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def mixed(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    signs = list("ab '\n\t strevlmdD'  .,!1é　\xa0\U0001f600٣ß   \r\x1c\x85{}|<")
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def texts() -> list[str | None]:
    whole = [None, "", "don't we'll've'", "'s", "'", "'r", " '", "a'", "x" * 70_000, "ab" * 3000, " " * 100 + "q", "\n" * 5, "<|endoftext|>", "word"]
    return whole + mixed(1, 400) + ["word", "the the the"] * 20


def test_bpe_ids_are_the_librarys(library):
    merges = byte_bpe.vocabulary_of(byte_bpe.VOCABULARY)
    rows = texts() + mixed(2, 5000)
    encoder = byte_bpe.Encoder(merges, ([], np.zeros(0, np.int32), np.zeros(0, np.int64)))
    parts = [pa.array(rows[i : i + 700], pa.string()) for i in range(0, len(rows), 700)]
    got = []
    for ids, counts in encoder.block(parts):
        ends = np.cumsum(counts)
        got += [ids[a:b].tolist() for a, b in zip(ends - counts, ends)]
    assert got == [library.encode_ordinary(t or "") for t in rows]


def test_bpe_query_columns(spark, library):
    rows = [(i if i % 7 else None, t, 1, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int, word string").repartition(5)
    want = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), digest(" ".join(map(str, ids))), digest(t or "")))
    for shared in (1 << 17, 20, 1):  # all words shared, some, none
        got = byte_bpe.round_trip(docs, shared=shared).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert byte_bpe.round_trip(docs.limit(0)).count() == 0
    back = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    assert sorted((r.doc_id, r.ids, bytes(r.decoded)) for r in back if r.doc_id) == sorted((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows if i)


def test_bpe_small_memory_and_index(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 10)
    monkeypatch.setattr(byte_bpe, "INDEX_BYTES", 50)
    encoder = byte_bpe.Encoder(byte_bpe.vocabulary_of(byte_bpe.VOCABULARY), ([b" the"], np.array(library.encode_ordinary(" the"), np.int32), np.ones(1, np.int64)))
    for rows in (mixed(3, 50), mixed(4, 50)):
        ((ids, _),) = encoder.block([pa.array(rows)])
        assert ids.tolist() == [i for t in rows for i in library.encode_ordinary(t)]


def test_bpe_merge_of_lower_rank_inside_a_word(tmp_path):
    """After x+y (rank 257) comes xy+x (rank 256): each word must do that before its second x+y."""
    import base64

    import tiktoken

    ranks = {bytes([b]): b for b in range(256)} | {b"xyx": 256, b"xy": 257, b"yxy": 258, b"aa": 259, b"aaa": 260}
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    own = tiktoken.Encoding("own2", pat_str=r"[^ ]+| +", mergeable_ranks=ranks, special_tokens={})
    merges = byte_bpe.Vocabulary(str(path))
    words = [b"xyxyxyxyx", b"xyxy", b"yxyxyx", b"a" * 11, b"aaxyxyaa"]
    ids, length = merges.replay(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(length)[:-1])] == [own.encode_ordinary(w.decode()) for w in words]


# ---- 12


def slow_trie(rows):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        family = c - int(np.fmod(c, 100))
        made[c] = tuple(own.get(family, [])[:h] + turns[h:])
    members, ends = {}, {}
    for c, s in sorted(made.items()):
        ends.setdefault(s, []).append(c)
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children = {}
    for s in members:
        if s:
            children.setdefault(s[:-1], []).append(s)
    out = []
    for s, m in members.items():
        below = [x for x in members if x[: len(s)] == s]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        leaves = sum(x not in children for x in below)
        out.append((m[0], len(s), members[s[:-1]][0] if s else None, len(m), len(children.get(s, [])), leaves, saved, digest(",".join(map(str, ends.get(s, []))))))
    return sorted(out, key=repr)


def talks():
    rng = random.Random(5)
    rows = [(0, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(7)]
    for c in range(1, 150):
        n = rng.randint(1, 8)
        rows += [(c, i, "user", rng.choice(["same", "other", "é\U0001f600", ""])) for i in range(n)]
    rows += [(c, i, "user", f"copy {i}") for c in range(300, 400) for i in range(3)]  # a group of equal conversations
    rows += [(500, None, None, None), (500, None, "a", "b"), (500, 3, None, "x"), (500, 3, None, "x"), (500, 3, "a", None)]
    rows += [(None, 1, "user", "lost"), (712, 0, "user", "no family, few turns"), (-5, 0, "user", "below"), (-5, 1, "user", "zero"), (-105, 2, "user", "below")]
    rows += [(800, 0, "user", "z" * 100_000), (801, 0, "user", "z" * 100_000)]
    return rows


def trie_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(names).collect()), key=repr)


def test_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = talks()
    table = spark.createDataFrame([(*r, "n", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, node string, depth int").repartition(6)
    assert trie_rows(prefix_trie.trie(table)) == slow_trie(rows)


def test_trie_of_nothing_and_of_one_long_conversation(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([], schema)).count() == 0
    rows = [(900, i, "user", f"t{i % 3}") for i in range(3000)] + [(901, 0, "user", "t0")]
    got = {(r[0], r[1]): r for r in trie_rows(prefix_trie.trie(spark.createDataFrame(rows, schema).repartition(4)))}
    assert len(got) == len({k[1] for k in got}) == 3001 and got[900, 3000][3:6] == (1, 0, 1)


def test_trie_equals_sql(spark, sf):
    diff, n = compare(spark, connect(sf), sf, "op12_prefix_trie", registry.queries()["op12_prefix_trie"], registry.oracle_sql()["op12_prefix_trie"])
    assert diff is None and n > 1, diff


# ---- 13


def slow_clusters(rows):
    import math

    good = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(good, key=lambda r: (digest(f"1:{'' if r[0] is None else r[0]}"), r[1]))[:16]
    centers = [list(v) for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers))

    for _ in range(3):
        of = [near(v)[1] for _, v in good]
        for n in range(len(centers)):
            own = [v for (_, v), o in zip(good, of) if o == n]
            if own:
                centers[n] = [sum(x) // len(own) for x in zip(*own)]
    last = [(i, *near(v)) for i, v in good]
    inertia = [sum(d for _, d, k in last if k == n) for n in range(len(centers))]
    return sorted(((i, n, d, inertia[n], sum(inertia), digest(",".join(map(str, centers[n])))) for i, d, n in last), key=repr)


def cluster_rows(table):
    return sorted((tuple(r) for r in centroids.report(*centroids.cluster(table)).collect()), key=repr)


VECTORS = "vec_id bigint, embedding array<float>, cluster int, distance int, vector string"


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_clusters(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in (rng.integers(0, 4) - 2) * np.ones(64) + rng.normal(0, 0.3, 64).astype(np.float32)]) for i in range(n)]
    rows += [(i, rows[0][1]) for i in range(n, n + n // 3)]  # a group of equal vectors
    rows += [(900, None), (901, [1.0]), (902, [None] + [1.0] * 63), (903, [float("nan")] * 64), (904, [float("inf")] * 64), (905, [])]
    if n:
        rows += [(None, [0.0] * 64), (None, [0.5] * 64), (1, [0.25] * 64), (1, [0.25] * 64), (907, [1e4] * 64)]
    table = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], VECTORS).repartition(3)
    assert cluster_rows(table) == slow_clusters(rows)


def test_pivots_of_one_line_and_of_equal_points():
    flat = np.arange(16)[:, None] * np.ones((1, 64), np.int64)
    for points in (flat.astype(np.int64), np.zeros((16, 64), np.int64)):
        simplex = centroids.Simplex(points)
        apexes = simplex.apexes(simplex.measure(points))
        number, distance, _ = centroids.nearest(points, apexes, points, simplex)
        assert distance.tolist() == [0] * 16 and number.tolist() == (list(range(16)) if points.any() else [0] * 16)


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(9)
    points = rng.normal(0, 40, (2000, 64)).round().astype(np.int64) + (rng.integers(0, 16, 2000) * 60)[:, None] * (rng.random((1, 64)) < 0.5)
    centers = points[:16]
    simplex = centroids.Simplex(centers)
    number, distance, compared = centroids.nearest(points, simplex.apexes(simplex.measure(points)), centers, simplex)
    full = ((points[:, None] - centers[None]) ** 2).sum(2)
    assert (distance == full.min(1)).all() and (number == full.argmin(1)).all()
    assert compared < full.size / 2


def test_component_out_of_range_raises(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64, 1, 2, "x")], VECTORS))


def test_clusters_equal_sql(spark, sf):
    diff, n = compare(spark, connect(sf), sf, "op13", registry.queries()["op13_centroid_clustering"], registry.oracle_sql()["op13_centroid_clustering"])
    assert diff is None and n > 1, diff
