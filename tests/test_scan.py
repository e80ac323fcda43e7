"""Prefix sums, chains of maps and packing along ordered groups, against plain loops."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gleaner.operators import batching, scan
from gleaner.plans.scratch import Scratch


def packed(sizes, most):
    out, used, batch, position = [], 0, 0, 0
    for c in sizes:
        if position and used + c + 1 > most:
            batch, position, used = batch + 1, 0, 0
        out.append((batch, position))
        used, position = used + c + 1, position + 1
    return out


def packed_pairs(plans, most):
    """plans: (claim_chars, {fact: chars}) in order."""
    out, used, batch, facts, i = [], 0, 0, {}, 0
    for o, (claim, own) in enumerate(plans):
        size = claim + len(own) + sum(c for f, c in own.items() if f not in facts)
        if i and used + size > most:
            used, batch, facts, i = 0, batch + 1, {}, 0
            size = claim + len(own) + sum(own.values())
        for f in sorted(own):
            facts.setdefault(f, len(facts))
            out.append((o, f, batch, i, facts[f]))
        used, i = used + size, i + 1
    return out


def test_running_sums(spark):
    r = random.Random(1)
    rows = [(g, i, r.randrange(9)) for g, n in (("a", 900), ("b", 1), ("c", 40)) for i in range(n)]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, o bigint, v bigint").repartition(7)
    got = {(x.g, x.o): x.before for x in scan.running(frame, ["g"], ["o"], Scratch(spark).put, before="v").collect()}
    sums = {}
    for g, o, v in sorted(rows):
        assert got[g, o] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + v


@pytest.mark.parametrize("fan", [2, 5, 64])
def test_follow_equals_walking(spark, monkeypatch, fan):
    monkeypatch.setattr(scan, "FAN", fan)
    r = random.Random(fan)
    rows, expected = [], set()
    for g, nodes in (("a", 41), ("b", 1), ("c", 7)):
        state, total = 3, 0
        for node in range(nodes):
            live = {e: (-1 if g == "c" and node == 4 else r.randrange(6), r.randrange(5)) for e in range(6)}
            rows += [(g, node, e, *x) for e, x in live.items()]
            if state >= 0:
                expected.add((g, node, state, total))
                state, total = live[state][0], total + live[state][1]
    maps = spark.createDataFrame(rows, "g string, node bigint, entry bigint, exit bigint, count bigint")
    starts = spark.createDataFrame([(g, 3) for g in "abc"], "g string, entry bigint")
    got = scan.follow(maps, starts, ["g"], Scratch(spark).put)
    assert {(x.g, x.node, x.entry, x["count"]) for x in got.collect()} == expected


@pytest.mark.parametrize("node, fan", [(1, 2), (16, 64)])
def test_pack_equals_greedy_loop(spark, monkeypatch, node, fan):
    monkeypatch.setattr(batching, "NODE", node)
    monkeypatch.setattr(scan, "FAN", fan)
    r = random.Random(node)
    sizes = {g: [r.choice([0, 0, 3, 10, 99]) for _ in range(n)] for g, n in (("big", 2500), ("one", 1), ("few", 12))}
    rows = [(g, i * 3, c) for g, own in sizes.items() for i, c in enumerate(own)]
    items = spark.createDataFrame(rows, "g string, o bigint, c bigint").repartition(6)
    got = {(x.g, x.o): (x.batch_no, x.position) for x in batching.pack(items, ["g"], "o", "c", fixed_chars=4, budget=26).collect()}
    assert got == {(g, i * 3): place for g, own in sizes.items() for i, place in enumerate(packed(own, 100))}


@pytest.mark.parametrize("node, fan", [(1, 2), (16, 64)])
def test_pack_pairs_equals_greedy_loop(spark, monkeypatch, node, fan):
    monkeypatch.setattr(batching, "NODE", node)
    monkeypatch.setattr(scan, "FAN", fan)
    r = random.Random(node + 7)
    chars = [r.randrange(30) for _ in range(60)]
    plans = {g: [(r.randrange(9), {f: chars[f] for f in r.sample(range(60), r.randrange(1, 5))}) for _ in range(n)] for g, n in (("big", 700), ("one", 1))}
    rows = [(g, o, claim, f, c) for g, own in plans.items() for o, (claim, facts) in enumerate(own) for f, c in facts.items()]
    rows += rows[:5]  # a pair that is there twice counts once
    frame = spark.createDataFrame(rows, "project string, ord bigint, claim_chars bigint, fact_id bigint, fact_chars bigint").repartition(5)
    got = {(x.project, x.ord, x.fact_id, x.batch_no, x.i, x.j) for x in batching.pack_pairs(frame, budget=40).collect()}
    assert got == {(g, *x) for g, own in plans.items() for x in packed_pairs(own, 160)}


def test_a_long_group_is_cut_over_many_tasks(spark):
    """Half a million items of one group: no node has more than its budgets hold."""
    items = spark.range(500_000).select(F.lit("p").alias("g"), F.col("id").alias("o"), (F.col("id") % 97).alias("c"))
    got = batching.pack(items, ["g"], "o", "c", budget=1000).groupBy("batch_no").agg(F.count("*").alias("n"), F.sum(F.col("c") + 1).alias("used"))
    row = got.agg(F.sum("n").alias("n"), F.max("used").alias("most"), F.count("*").alias("batches"), F.max("batch_no").alias("last")).first()
    assert row.n == 500_000 and row.most <= 4000 and row.last == row.batches - 1 == packed([i % 97 for i in range(500_000)], 4000)[-1][0]


def test_an_item_over_the_budget(spark):
    items = spark.createDataFrame([("g", 1, 50)], "g string, o bigint, c bigint")
    with pytest.raises(PySparkException):
        batching.pack(items, ["g"], "o", "c", budget=10).collect()
    assert batching.pack(items.limit(0), ["g"], "o", "c", budget=10).isEmpty()
