"""Components of links, and how many rounds they take."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from llm import links


@pytest.fixture(scope="module", autouse=True)
def _checkpoints(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))


def least_reachable(pairs):
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def frame(spark, pairs, parts):
    return spark.createDataFrame(pairs, "a bigint, b bigint").repartition(parts)


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    """What a task holds is joined before the rounds; without that this path takes ten rounds."""
    ids = random.Random(3).sample(range(-(10**9), 10**9), 2000)
    pairs = list(zip(ids, ids[1:]))
    written = []
    keep = links.materialize
    monkeypatch.setattr(links, "materialize", lambda df: written.append(1) or keep(df))
    got = {r.node: r.comp for r in links.components(frame(spark, pairs, 1)).collect()}
    assert got == least_reachable(pairs)
    assert len(written) <= 4


@pytest.mark.parametrize("parts,at_once", [(1, 1 << 20), (3, 1 << 20), (7, 5)])
def test_components(spark, monkeypatch, parts, at_once):
    monkeypatch.setattr(links, "LINKS_AT_ONCE", at_once)
    rng = random.Random(parts)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(500, 500), (2**62, 2**62 - 1), (-5, 7), (-5, 7)]
    rows = frame(spark, pairs + [(None, 1), (2, None), (None, None)], parts)
    got = {r.node: r.comp for r in links.components(rows).collect()}
    assert got == {k: v for k, v in least_reachable([p for p in pairs if p[0] != p[1]]).items()}
    short = links.shorten(rows.where("a <> b"))
    assert short.where(F.col("a") <= F.col("b")).isEmpty()
    assert short.count() <= len(pairs)


def test_rounds_shuffle_labels_only(spark, monkeypatch, capsys):
    """Links and labels that are dealt by node join where they lie: a round takes four shuffles, and links none."""
    plans = []
    keep = links.materialize

    def spy(df):
        capsys.readouterr()
        df.explain()
        plans.append(capsys.readouterr().out)
        return keep(df)

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    monkeypatch.setattr(links, "materialize", spy)
    pairs = [(i, i + 1) for i in range(0, 300, 3)] + [(i, i + 3) for i in range(0, 150, 3)]
    got = {r.node: r.comp for r in links.components(frame(spark, pairs, 7)).collect()}
    assert got == least_reachable(pairs)
    assert len(plans) >= 3
    assert "Exchange" not in plans[1]
    shuffles = [sum("Exchange hashpartitioning" in x and "Reused" not in x for x in p.splitlines()) for p in plans[2:]]
    assert max(shuffles) <= 4
    assert spark.conf.get("spark.sql.adaptive.enabled") == adaptive


def test_a_written_frame_is_not_written_again(spark):
    once = links.materialize(spark.range(5))
    assert links.materialize(once) is once
    assert links.materialize(once.where("id > 2")) is not once
