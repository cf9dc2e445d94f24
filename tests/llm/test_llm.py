"""Operators of the subpackage against brute force, round trips and held-out accuracy, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import corpus_pipeline  # noqa: E402
from compare import compare, connect  # noqa: E402
from llm import dom, extract, jaccard, language_id, nearest, packing, quality, registry, sharding, substrings, toxicity  # noqa: E402

from llm.meeting import pack as jaccard_pack  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, bucket int, spans string, size int"


@pytest.fixture(scope="module", autouse=True)
def _checkpoints(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))


def words(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 8))) for _ in range(n))


def awkward() -> list[tuple[int | None, str | None]]:
    long = words(1, 4000)
    base = words(2, 200)
    near = base.split()
    near[100] = "changed"
    passage = words(3, 40)
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (5, "One  TWO"), (6, base), (7, base), (8, " ".join(near)), (9, long), (10, long + " end"),
        (11, words(4, 60) + " " + passage + " " + words(5, 60)), (12, words(6, 50) + "\n" + passage + "\n" + words(7, 50)), (13, "é" * 300 + " ß"), (14, "é" * 300 + " ß"),
        (15, "a" * 500), (16, "b" + "a" * 400), (None, base), (None, None), (7, base), (17, "same line here\n" * 30), (18, words(8, 30) + "." * 80),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t), True, 1, "x", 2) for i, t in awkward()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_row(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- 1


def slow_quality(text):
    import re

    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(ws) - 7):
        seen.setdefault(tuple(ws[i : i + 8]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, docs, empty):
    got = by_row(quality.measure(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    assert got == sorted(((i, *slow_quality(t)) for i, t in awkward()), key=repr)
    verdict = {(r.doc_id, r.n_words): r for r in quality.measure(docs).collect()}
    assert verdict[1, 0].base_failed and not verdict[1, 0].kept
    assert verdict[6, 200].kept and not verdict[17, 90].kept
    assert quality.measure(empty).count() == 0 and quality.keep(empty).count() == 0
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {6, 7, 8, 9, 10, 11}


# ---- 4


def slow_classes(rows):
    import re

    sets = []
    for _, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[k] and rows[j][0] is not None]
        out.append((i, len(sets[k]), (min(ids) if ids else None) if sets[k] else i))
    return sorted(out, key=repr)


def test_jaccard_classes(docs, empty):
    assert by_row(jaccard.classes(docs)) == slow_classes(awkward())
    assert jaccard.classes(empty).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id > 3 AND doc_id < 11").collect()) == [4, 6, 9]


def test_jaccard_group_of_near_copies(spark):
    """A chain of near copies, none equal, and a common passage that links nothing."""
    base, common = words(10, 120).split(), words(11, 60)
    rows = []
    for i in range(60):
        mine = list(base)
        for k in range(i // 3, i // 3 + 4):
            mine[k] = f"w{i}x{k}"
        rows.append((100 + i, " ".join(mine)))
    rows += [(300 + i, common + " " + words(500 + i, 40)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert by_row(jaccard.classes(df)) == slow_classes(rows)


def test_keep_one_with_a_repeated_id(spark):
    """Of two rows with one id, only the near copy of a smaller id goes."""
    base, other = words(12, 100), words(13, 100)
    rows = [(1, base), (2, base + " end"), (2, other), (2, other), (None, base)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert by_row(kept) == sorted([(1, base), (2, other), (None, base)], key=repr)


# ---- 5


def slow_dedup(rows):
    order = lambda i: 1 << 62 if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - 49):
            first[b[j : j + 50]] = min(order(i), first.get(b[j : j + 50], 1 << 63))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < order(i):
                gone[j : j + 50] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def templates(seed: int) -> list[tuple[int, str]]:
    """Families of texts with one left and right side and many middles that are anchors themselves, some twice in one text."""
    rng = np.random.default_rng(seed)
    draw = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    rows = []
    for _ in range(3):
        left, right = draw(26), draw(26)
        middles = []
        while len(middles) < 40:
            some = draw(25)
            if 26 in substrings.anchors(pa.array([left + some + right]))[2]:
                middles.append(some)
        rows += [left + m + right + end for m in middles for end in ("", "!")]
        rows += [left + a + right + draw(9) + left + b + right for a, b in zip(middles[::2], middles[1::2])]
    return [(int(i), rows[j]) for i, j in enumerate(rng.permutation(len(rows)))]


@pytest.mark.parametrize("piece_bytes", [1 << 20, 4000])
def test_suffix_dedup_of_templates(spark, monkeypatch, piece_bytes):
    monkeypatch.setattr(substrings.pieces, "__defaults__", (piece_bytes,))
    rows = templates(3)
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert by_row(substrings.dedup(table)) == slow_dedup(rows)


def test_shard_keeps_anchors_apart():
    """Equal surroundings, different anchors: every start that the shard settles or the merge finds is a real repeat."""
    rows = sorted(templates(4))
    t, h, place, of = substrings.anchors(pa.array([x for _, x in rows]))
    keys = [jaccard_pack(np.unique(h[of == i] >> np.uint64(64 - 48))) for i in range(len(rows))]
    part = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array([i for i, _ in rows]), pa.array(keys, pa.binary()), pa.array([x for _, x in rows])], ["key", "doc", "keys", "text"])
    for bits in (0, 4, 9):
        sent = substrings._shard(part, bits)
        spans = [substrings._merge(pa.table({"body": pa.array([b])})).to_pylist() for b in sent.column(1).to_pylist()]
        covered = {}
        for s in sum(spans, []):
            covered.setdefault(s["key"], set()).update(range(s["a"], s["b"]))
        removed = {i: n for i, _, n, *_ in slow_dedup(rows)}
        assert {i: len(covered.get(i, ())) for i in range(len(rows))} == removed


def test_suffix_dedup(docs, empty):
    assert by_row(substrings.dedup(docs)) == slow_dedup(awkward())
    assert substrings.dedup(empty).count() == 0
    kept = substrings.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert {r.doc_id: r.n_chars for r in kept.collect()}[8] < 1300


def test_shard_unites_what_it_settles():
    """A passage of many anchors that a shard settles leaves it as one span a text, not one an anchor."""
    rng = np.random.default_rng(7)
    draw = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    passage = draw(4000)
    texts = [draw(300) + passage + draw(300) for _ in range(3)]
    keys = [jaccard_pack(np.unique(substrings.anchors(pa.array([x]))[1] >> np.uint64(64 - 48))) for x in texts]
    part = pa.RecordBatch.from_arrays([pa.array([11, 12, 13]), pa.array([1, 2, 3]), pa.array(keys, pa.binary()), pa.array(texts)], ["key", "doc", "keys", "text"])
    for bits in (0, 5):
        sent = substrings._shard(part, bits)
        spans = sum((substrings._merge(pa.table({"body": pa.array([b])})).to_pylist() for b in sent.column(1).to_pylist()), [])
        covered = {k: set() for k in (12, 13)}
        for s in spans:
            covered[s["key"]].update(range(s["a"], s["b"]))
        assert all(c == set(range(300, 4300)) for c in covered.values())
        assert len(spans) < 20


def test_suffix_dedup_of_many_shards(spark, monkeypatch):
    """Several packets a task, and merges that stay bounded as texts grow."""
    rows = templates(5)
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(substrings, "ANCHORS_PER_SHARD", 7)
    monkeypatch.setattr(substrings, "MEETING_BYTES", 900)
    monkeypatch.setattr(substrings.pieces, "__defaults__", (300,))
    assert by_row(substrings.dedup(table)) == slow_dedup(rows)
    for total in (1e9, 1e10, 1e11):
        assert total / substrings.BYTES_PER_ANCHOR / 2 ** substrings.bits_for(total, substrings.BYTES_PER_ANCHOR, substrings.MERGED_PER_BUCKET) <= 500_000


def test_interleave_orders_and_measures():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, (200, 12)).astype(np.uint8)
    z, common = substrings.interleave(np.zeros(200, np.int64), [x[:, c] for c in range(12)])
    rows = [bytes(x[i]) for i in z]
    assert rows == sorted(rows)
    for i in range(1, 200):
        same = next((k for k in range(12) if rows[i][k] != rows[i - 1][k]), 12)
        assert common[i] == same


# ---- 6


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    import public_tokenizers

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack(docs).collect()
    want = []
    for i, t in awkward():
        ids = tk.encode(t or "", add_special_tokens=False).ids + [0]
        for p in range(0, len(ids), 2048):
            a = np.array(ids[p : p + 2048], "<u4")
            want.append((i, p // 2048, p, len(a), zlib.crc32(a.tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(empty).count() == 0


def test_encoder_equals_tokenizer():
    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["It's DON'T we'LL x<|endoftext|>y <|EndOfText|>", "A1b2 ...!? é Éà   x y 　", "İSTANBUL ΣΑΣ ß ŒUVRE ﬁ", "日本語 テスト 123,456.78$$$", "'s's 't a's-b'd"]
    texts += [t for t in (w for _, w in awkward()) if t]
    ids, counts = packing.encoder(path).encode(pa.array(texts))
    cut = np.append(0, np.cumsum(counts))
    tk = Tokenizer.from_file(path)
    for t, a, b in zip(texts, cut, cut[1:]):
        assert ids[a:b].tolist() == tk.encode(t, add_special_tokens=False).ids + [0], t


def test_sweep_is_best_fit():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 500)
    counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    used: dict[int, int] = {}
    for length, a, b, first, offset in packing.sweep(counts, 100):
        for k in range(a, b):
            assert used.get(first + k - a, 0) == offset
            used[first + k - a] = offset + length
    assert max(used.values()) <= 100 and sum(used.values()) == lengths.sum()
    bins: list[int] = []
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [i for i, u in enumerate(bins) if u + n <= 100]
        best = max(fits, key=lambda i: bins[i], default=None)
        if best is None:
            bins.append(n)
        else:
            bins[best] += n
    assert len(used) <= len(bins)


# ---- 7, 9


def test_language(spark, docs, empty, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = language_id.op7_language_id(spark, sf).where("held_out").join(table.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 20 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    model = language_id.fit(table)
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify(docs, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "und")} <= got and all(0 <= r.score <= 1 for r in language_id.identify(docs, model).collect())
    assert {r.lang_pred for r in language_id.identify(docs, language_id.fit(empty)).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(3)
    texts, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        said = [words(int(rng.integers(1 << 30)), 12) for _ in range(8)]
        if bad:
            said[int(rng.integers(8))] += " vile scumbag"
        texts.append((i, ". ".join(said)))
        labels.append((i, 1, int(bad)))
    table = spark.createDataFrame(texts, "doc_id bigint, text string")
    known = spark.createDataFrame([*labels, (5, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(table, known)
    got = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    held = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.97
    found = toxicity.locate(table, model).collect()
    assert {r.doc_id for r in found} == {i for i, r in got.items() if r.predicted} and all("vile scumbag" in r.text for r in found)
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(empty, model).count() == 0 and toxicity.keep(docs, model).columns == docs.columns
    nothing = toxicity.fit(table, known.limit(0))
    assert {r.score for r in toxicity.score(table, nothing).collect()} == {0.0} or max(r.score for r in toxicity.score(table, nothing).collect()) < 1e-6


def test_length_alone_is_not_toxic(spark):
    """100,000 lines without known words, or with words of clean texts, are clean; one bad line among them is found."""
    rng = np.random.default_rng(4)
    texts = [(i, ". ".join([*(words(int(rng.integers(1 << 30)), 8) for _ in range(6)), "what a vile scumbag" if i % 4 == 0 else "thanks kindly friend"])) for i in range(400)]
    table = spark.createDataFrame(texts, "doc_id bigint, text string")
    model = toxicity.fit(table, spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in texts], "doc_id bigint, toxic int"))
    lines = ["\n".join(f"{i} {said}" for i in range(100_000)) for said in ("qqzzx", "thanks kindly friend")]
    rows = [(1, lines[0]), (2, lines[1]), (3, lines[0] + "\nwhat a vile scumbag"), (4, "what a vile scumbag")]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    assert got[1].score == got[2].score == 0 and got[1].predicted == got[2].predicted == 0
    assert got[3].predicted == got[4].predicted == 1 and got[3].score == pytest.approx(got[4].score)


# ---- 8


def test_min_cost_flow():
    flow = sharding.min_cost_flow([5, 7], [4, 4, 4], [[0, 1, 1], [1, 0, 1]])
    assert [sum(r) for r in flow] == [5, 7] and [sum(c) for c in zip(*flow)] == [4, 4, 4]
    assert flow[0][0] == 4 and flow[1][1] == 4


def test_sharding(spark, docs, empty, tmp_path):
    rows = sharding.assign(docs).collect()
    want = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in awkward()]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    assert len(rows) == len(awkward())
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    big = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', 20 + cast(id % 97 AS int)) AS text")
    sizes = sharding.assign(big).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(sizes) == 24 and max(r.n for r in sizes) - min(r.n for r in sizes) <= 200
    assert sharding.assign(empty).count() == 0
    changed = sharding.rewrite(big, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == changed.agg(F.sum("rows")).first()[0] and {"doc_id", "text", "shard"} == set(back.columns)


@pytest.mark.parametrize("name", ["hot", "hot and small rows", "no home", "giant row"])
def test_sharding_moves_the_fewest_bytes(spark, name):
    """Bytes that leave an old shard beyond its capacity, and no others but for row boundaries."""
    rng = np.random.default_rng(5)
    layouts = {
        "hot": (3, [(0, 5000)] * 16 + [(1, 1000)] * 10),
        "hot and small rows": (4, [(0, int(n)) for n in rng.integers(10, 9000, 300)] + [(1, 7)] * 4000 + [(2, 500)] * 90),
        "no home": (4, [(7, int(n)) for n in rng.integers(10, 900, 200)] + [(1, 400)] * 150 + [(0, 100)] * 60),
        "giant row": (3, [(0, 90_000)] + [(0, 100)] * 30 + [(1, 100)] * 30 + [(2, 100)] * 30),
    }
    shards, rows = layouts[name]
    table = spark.createDataFrame([(o, n, k) for k, (o, n) in enumerate(rows)], "old int, size bigint, key bigint")
    got = sharding.reshard(table, shards).collect()
    assert sorted((r.old, r.size, r.key) for r in got) == sorted((o, n, k) for k, (o, n) in enumerate(rows))
    total, held, largest = sum(n for _, n in rows), {}, max(n for _, n in rows)
    for o, n in rows:
        held[o] = held.get(o, 0) + n
    least = sum(n - min(n, -(-total // shards) if o < shards else 0) for o, n in held.items())
    moved = sum(r.size for r in got if r.old != r.shard)
    if name in ("hot", "giant row"):
        assert moved == {"hot": 50_000, "giant row": 3_000}[name]
    assert moved <= least + largest
    filled = [sum(r.size for r in got if r.shard == j) for j in range(shards)]
    assert max(filled) <= -(-total // shards) + largest and (name != "hot" or filled == [30_000] * 3)


# ---- 3


def test_extract(spark):
    page = (
        "<html><head><title>x</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav>"
        '<div class="ad">Buy now.</div><article><h1>Title &amp; more</h1><p>First   para,\nwith <b>bold</b>.<p>Second <a href="/x">link</a> para goes on for a while.</article>'
        '<div class="comments"><p>Great post, thanks.</p></div><footer>&copy; me</footer></body></html>'
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<<<>&broken <p"), (4, "u", page[:-60])]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, n_chars int")
    got = {r.page_id: r for r in extract.extract(pages, extract.fit(pages)).collect()}
    assert got[1].text == "Title & more\nFirst para, with bold.\nSecond link para goes on for a while." and got[1].n_chars == len(got[1].text)
    assert got[2].text == "" and got[3].n_chars == 0 and got[4].text.startswith("Title & more\nFirst")
    assert extract.extract(pages.limit(0), extract.train([])).count() == 0


def test_formulas_and_objects_are_text():
    runs = lambda page: [t for _, t in dom.parse(page)[1]]
    assert runs("<p>One <svg viewBox='0 0 1 1'/> two</p><p>three</p>") == ["One two", "three"]
    assert runs("<p>One <math/>two</p><p>three</p>") == ["One two", "three"]
    assert runs("<p>a <svg><text>no</text></svg>b</p>") == ["a b"] and runs("<p>a <svg class=x/><text>no</text></svg>b</p>") == ["a b"]
    assert runs("<p>a</p><svg><p>b</p>") == ["a", "b"]
    assert runs("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>") == ["So x=2 holds."]
    assert runs("<p>See <object data=a>the map</object> or <canvas>the chart</canvas>.</p>") == ["See the map or the chart."]


def test_decode_keeps_no_child_of_a_dropped_node():
    rng = np.random.default_rng(0)
    nodes = [extract.Node("page", -1, 0)]
    for i in range(1, 300):
        up = int(rng.integers(0, i))
        nodes.append(extract.Node("div", up, 1))
        nodes[up].kids.append(i)
    kept = extract.decode(nodes, rng.normal(size=300))
    assert all(kept[n.parent] for i, n in enumerate(nodes) if i and kept[i]) and 0 < kept.sum() < 300


# ---- 10


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 8)).astype(np.float32)
    x[200:700] = x[3]  # a third of the rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5100, [0.0] * 8), (5200, [1.0, None] * 4), (5300, [float("nan")] * 8), (5400, [1.0]), (None, [1.0] * 8), rows[9]]
    table = spark.createDataFrame([(*r, 7) for r in rows], "vec_id bigint, embedding array<float>, leaf int")
    got: dict[int, list] = {}
    for r in nearest.search(table, lambda i: i % 100 == 0, trials=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        hits += len(set(best) & {i for i, _ in found})
        assert [s for _, s in found] == sorted(s for _, s in found) and all(abs(d[i] - s) < 1e-12 for i, s in found)
    assert hits >= 0.9 * 10 * len(got)
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0])], "vec_id bigint, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest.search(few, lambda i: i % 100 == 0).collect()] == [(0, 1, 1, 1.0)]
    assert nearest.search(few.limit(0), lambda i: i % 100 == 0).count() == 0


def test_every_query_gets_all_its_rows(spark):
    """Leaves with few vectors, and an id with many: still ten rows for each query, each of another id."""
    x = np.random.default_rng(6).normal(size=(200, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, (x[0] + 1e-3 * n).tolist()) for n in range(1, 30)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = nearest.search(table, lambda i: i % 5 == 0, recall=0.01).collect()
    for q in [*range(0, 200, 5), 300]:
        found = {r.vec_id: r for r in got if r.query_id == q}
        assert len(found) == 10 and {r.rank for r in found.values()} == set(range(1, 11)), q
    near = next(r for r in got if r.query_id == 0 and r.vec_id == 300)
    assert near.rank == 1 and near.score == pytest.approx(1e-3 * 8**0.5)


# ---- all


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - {"op1_quality_rules"}))
def test_query_equals_sql(spark, sf, name):
    diff, _ = compare(spark, connect(sf), sf, name, registry.queries()[name], registry.oracle_sql()[name])
    assert diff is None, diff


def test_pipeline(spark, sf):
    """Stage by stage: each drops what its operator says, and nothing else."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = corpus_pipeline.toxic_out(spark, docs, sf)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    good = corpus_pipeline.poor_out(spark, clean, sf)
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.measure(clean).where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in good.collect()]
    one = corpus_pipeline.one_of_each(spark, good, sf).collect()
    assert sorted(r.doc_id for r in one) == sorted(i for i, _, c in slow_classes(rows) if i == c)
    left = spark.createDataFrame(one, docs.schema)
    cut = {r.doc_id: r for r in corpus_pipeline.passages_out(spark, left, sf).collect()}
    for i, _, gone, _, digest in slow_dedup([(r.doc_id, r.text) for r in one]):
        if not gone:
            assert hashlib.sha256(cut[i].text.encode()).hexdigest() == digest
        assert len(cut[i].text) == cut[i].n_chars
    out = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in out.collect()} == set(cut)


# ---- 2


def test_pieces_equal_the_library_as_unigram(tmp_path):
    """The same pieces and scores as a unigram model of the library give the same ids."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    from llm import pieces_scan

    path = public_tokenizers.path(pieces_scan.VOCABULARY)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(Path(path).read_bytes())
    proto.trainer_spec.model_type = 1
    keep = [p for p in proto.pieces if not (p.type == 1 and p.score < -1e8)]  # such scores drown all others in single precision
    del proto.pieces[:]
    proto.pieces.extend(keep)
    (tmp_path / "m.model").write_bytes(proto.SerializeToString())
    library = SentencePieceProcessor(model_file=str(tmp_path / "m.model"))
    mine = pieces_scan.Pieces(str(tmp_path / "m.model"))
    for text in ("Hello world", "naïve façade, über 123.45!", "日本語のテキスト and ゼ", words(5, 30), "a\nb\n\nc", "***$$$ x"):
        assert list(mine.encode(pieces_scan.prepare(text))) == library.encode(text), text
        assert mine.decode(library.encode(text)) == text


def test_chunked_scan_equals_one_pass():
    import public_tokenizers

    from llm import pieces_scan

    m = pieces_scan.Pieces(public_tokenizers.path(pieces_scan.VOCABULARY))
    texts = [words(1, 200), "x" * 300 + words(2, 40).replace(" ", ""), "日本" * 150, "a  b   c " * 60, "line\n" * 70]
    for text in texts:
        body = pieces_scan.prepare(text)
        for size in (33, 64, 101):
            left = m.longest - 1
            begins = list(range(0, len(body) - left - 1, size))
            parts = [body[max(0, a - left) : (a + size if a != begins[-1] else len(body))] for a in begins]
            lefts = [min(left, a) for a in begins]
            ahead = pieces_scan.entering([m.matrix(t, n) for t, n in zip(parts, lefts)])
            states = pieces_scan.boundary_states([m.entries(t, n, x) for t, n, x in zip(parts, lefts, ahead)])
            ids = [i for t, n, a, b in zip(parts, lefts, states, states[1:]) for i in m.backtrace(t, n, a, b)]
            _, back = m.forward(body)
            assert ids == list(m.path(body, back, len(body))) and m.decode(ids) == text
        plain = [pieces_scan._UNIT.findall(body), []]
        for unit in plain[0]:
            _, back = m.forward(unit)
            plain[1].extend(m.path(unit, back, len(unit)))
        assert list(m.encode(body)) == plain[1]
    rng = np.random.default_rng(0)
    many = [rng.integers(-9, 0, (4, 4)).astype(float) for _ in range(13)]
    want = many[0]
    for got, x in zip(pieces_scan.scan(many)[1:], many[1:]):
        want = pieces_scan.product(want, x)
        assert (got == want).all()


def test_sentencepiece_round_trip(spark, docs, empty):
    from llm import pieces_scan

    want = {(i, t or "") for i, t in awkward()}
    for chunk in (300, pieces_scan.CHUNK):
        both = pieces_scan.decode(pieces_scan.encode(docs, chunk=chunk))
        got = [(r.doc_id, r.decoded) for r in both.collect()]
        assert set(got) == want and len(got) == len(awkward())
    assert pieces_scan.encode(empty).count() == 0
