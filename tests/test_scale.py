"""Plans and shapes that keep time, disk and memory in line with the input."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from catalog import load, streams
from catalog.registry import QUERIES
from hushframe.functions.text import once, running_counts
from hushframe.streaming import deltas as sd

load()


@pytest.fixture
def texts(spark, tmp_path):
    rows = [(i, f"s{i % 2}", "en", "The Denver team, Lara. " * (i % 5) + "\n x") for i in range(40)] + [(41, "s", "en", ""), (42, "s", "en", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string").withColumn("n_chars", F.length("text").cast("bigint"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def plan_of(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("name", ["mask_labels", "mask_ids"])
def test_masking_is_done_once(spark, texts, capsys, name):
    df = QUERIES[name](spark, texts)
    plan = plan_of(df, capsys)
    assert not [line for line in plan.splitlines() if "Filter" in line and "md5" in line]
    assert {r.doc_id for r in df.collect()} == set(range(40))


def test_once_holds_a_column(spark, capsys):
    df = spark.range(3).select(once(F.sha2(F.col("id").cast("string"), 256)).alias("x")).filter("x <> ''").select(F.length("x").alias("n"), F.upper("x").alias("u"))
    assert plan_of(df, capsys).count("sha2(") == 1
    assert [r.n for r in df.collect()] == [64] * 3


@pytest.mark.parametrize("name", ["forward_requests", "rewrite_responses"])
def test_bodies_are_built_once(spark, texts, capsys, name):
    plan = plan_of(QUERIES[name](spark, texts), capsys)
    assert not [line for line in plan.splitlines() if "Filter" in line and "parseJson(CASE" in line]


@pytest.mark.parametrize("n", [1, 6])
def test_arriving_rows_use_every_split(spark, tmp_path, n):
    half = streams._arrive(spark.range(0, 600, 1, n), f"{tmp_path}/in")
    back = spark.read.parquet(f"{tmp_path}/in")
    assert back.count() == 600 and half == (max(n, 4) + 1) // 2
    assert len(back.inputFiles()) == max(n, 4)


@pytest.mark.parametrize("name, part", [("join_subtokens", "word_id"), ("join_word_runs", "word_id"), ("merge_window_predictions", "token"), ("merge_word_chunks", "token")])
def test_rows_of_tokens_are_not_shuffled(spark, texts, capsys, name, part):
    plan = plan_of(QUERIES[name](spark, texts), capsys)
    assert "Exchange hashpartitioning(doc_id" in plan
    assert not [line for line in plan.splitlines() if "Exchange" in line and part in line]


def test_running_counts(spark):
    one = spark.range(1).select(
        running_counts(F.array(*[F.lit(x) for x in ("b", "a", None, "b", "a", "b")])).alias("some"),
        running_counts(F.array().cast("array<string>")).alias("none"),
        running_counts(F.lit(None).cast("array<string>")).alias("null"),
    ).first()
    assert (one.some, one.none, one.null) == ([1, 1, None, 2, 2, 3], [], None)


def let_go(pieces):
    """What one stream lets go, piece by piece, and at its end."""
    held, out, last = "", [], None
    for seq, text, terminal in pieces:
        last = seq
        if terminal:
            if held:
                out.append((seq, 0, held))
            held = ""
            continue
        cut = re.search(r"\[[A-Z0-9_]*\Z", held + text)
        safe = held + text if cut is None else (held + text)[: cut.start()]
        held = "" if cut is None else cut.group()
        out.append((seq, 1, safe))
    return out + ([(last, 2, held)] if held else [])


def test_pieces_of_a_stream_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK", 3)
    monkeypatch.setattr(sd, "PIECES_AT_ONCE", 4)
    rng = random.Random(7)
    streams = {}
    for s in range(60):
        texts = [rng.choice(["[", "[AB", "A", "_1", "_1] ", "x", "", "A [T"]) for _ in range(rng.randint(1, 24))]
        streams[f"s{s}"] = [(i, t, rng.random() < 0.1) for i, t in enumerate(texts)]
    rows = [(s, i, None if end else t, end) for s, ps in streams.items() for i, t, end in ps]
    deltas = spark.createDataFrame(rows, "stream_id string, seq bigint, delta string, terminal boolean").repartition(5)
    got = {s: [] for s in streams}
    for r in sd.safe_deltas(deltas).collect():
        got[r.stream_id].append((r.seq, r.part, r.safe))
    assert {s: sorted(v) for s, v in got.items()} == {s: sorted(let_go(ps)) for s, ps in streams.items()}


def test_pieces_are_not_joined(spark, texts, capsys):
    """Placeholders meet a block's pieces in one row: no join or window has a row for each piece."""
    deltas = spark.createDataFrame([("1", 0, "a [A", False), ("1", 1, "_1]", False)], "stream_id string, seq bigint, delta string, terminal boolean")
    vault = spark.createDataFrame([("1", "[A_1]", "Ada", 1)], "scope string, placeholder string, value string, uses bigint")
    df = sd.restore_deltas(deltas, vault)
    assert not [line for line in plan_of(df, capsys).splitlines() if "Exchange hashpartitioning" in line and "seq" in line]
    assert sorted((r.seq, r.restored) for r in df.collect()) == [(0, "a "), (1, "Ada")]
