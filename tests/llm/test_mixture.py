"""Source mixing: targets by a plain loop, multipliers by bisection, copies by their own rules."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner.llm import mixture
from gleaner.llm.queries import op13_entropy_mix
from gleaner.llm.session import Tables, prepare


def brute_targets(rows, weights=(1, 2, 3), cap=3):
    size = collections.Counter()
    for _, source, text in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, closed = sum(size.values()), set()
    while True:
        rest = total - sum(cap * size[s] for s in closed)
        base = sum(weight[s] for s in names if s not in closed)
        over = {s for s in names if s not in closed and base and rest * weight[s] / base > cap * size[s]}
        if not over:
            return size, {s: float(cap * size[s]) if s in closed else rest * weight[s] / base if base else 0.0 for s in names}
        closed |= over


def check(spark, rows, frame=None, slack=lambda sizes, goal: max(min(sizes), 0.01 * goal)):
    frame = frame if frame is not None else spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(5)
    size, goal = brute_targets(rows)
    got = mixture.mix_sources(frame).join(frame.select("doc_id", "source").distinct(), "doc_id").collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[2] for r in rows}
    taken, own = collections.Counter(), collections.defaultdict(list)
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""))
        assert r.source_size == size[r.source] and math.isclose(r.target, goal[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        if r.size:
            own[r.source].append(r.size)
    for s, sizes in own.items():
        assert abs(taken[s] - goal[s]) <= slack(sizes, goal[s]), (s, taken[s], goal[s])
    return got


def test_mix_of_documents(spark, documents):
    rows = [(r.doc_id, r.source, r.text) for r in documents.collect()]
    got = check(spark, rows, documents)
    again = mixture.mix_sources(documents.repartition(9, "text")).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert op13_entropy_mix(spark, "/root/testdata/sf0.001").columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_caps_reshare_until_none_is_above(spark):
    r = random.Random(2)
    sources = ["a", "b", "c", "d", "e", None, "é", "z"]
    rows = [(i, r.choice(sources[: 1 + i % 8]), " ".join(["w"] * r.choice([0, 1, 2, 5, 40, 300]))) for i in range(3000)]
    rows += [(10_000, "tiny", "one two"), (10_001, "empty", ""), (10_002, "empty", None)]
    check(spark, rows)
    size, goal = brute_targets(rows)
    assert goal["tiny"] == 6 and goal["empty"] == 0
    assert math.isclose(sum(goal.values()), sum(size.values()))


def test_multipliers_equal_bisection(spark, documents):
    prepare(spark)
    tables = Tables(spark)
    cells = tables.written(mixture.sizes(documents).groupBy("source", "size").agg(F.count("*").alias("n")))
    goals = mixture.targets(cells, tables)
    rates = {r.source: r for r in mixture.solve(cells, goals, tables).collect()}
    by_source = collections.defaultdict(list)
    for r in cells.collect():
        by_source[r.source].append((r.size, r.n))
    for g in goals.collect():
        if not 0 < g.target < 3 * g.source_size:
            assert g.source not in rates
            continue
        low, high = -100.0, 100.0
        for _ in range(200):
            m = (low + high) / 2
            words = sum(s * n * min(3, math.exp(min(50, m * s / rates[g.source].mean))) for s, n in by_source[g.source])
            low, high = (m, high) if words < g.target else (low, m)
        assert math.isclose(rates[g.source].m, m, rel_tol=1e-4, abs_tol=1e-5)
    tables.drop()


def test_a_large_cell_is_cut_by_hash(spark, monkeypatch):
    monkeypatch.setattr(mixture, "PART", 50)
    rows = [(i, "hot", "same size here") for i in range(4000)] + [(i + 5000, s, "x y") for i, s in enumerate("abcde" * 30)]
    got = check(spark, rows, slack=lambda sizes, goal: 2 * min(sizes))
    hot = [r.copies for r in got if r.source == "hot"]
    assert max(hot) - min(hot) <= 1


@pytest.mark.parametrize("weights", [(1,), (0.5, 7)])
def test_other_weights(spark, documents, weights):
    goal = brute_targets([(r.doc_id, r.source, r.text) for r in documents.collect()], weights)[1]
    for r in mixture.mix_sources(documents, weights).join(documents.select("doc_id", "source"), "doc_id").collect():
        assert math.isclose(r.target, goal[r.source], rel_tol=1e-9)


def test_edges(spark, edge_documents):
    rows = mixture.mix_sources(edge_documents).collect()
    assert len(rows) == 8 and all(r.taken <= 3 * r.size for r in rows)
    assert mixture.mix_sources(edge_documents.limit(0)).count() == 0
