"""The kept search index against scoring of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import retrieval, search_index
from gleaner.plans.scratch import Scratch

WORDS = [f"{a}{b}" for a in ("river", "stone", "cloud", "Été", "ox") for b in ("", "s", "ing", "9", "ed")]


def made(seed, n):
    """Claims of words with a steep distribution, so that a few terms have long lists."""
    r = random.Random(seed)
    word = lambda: WORDS[int(len(WORDS) * r.random() ** 3)] if r.random() < 0.8 else f"rare{r.randrange(400)}"
    return [" ".join(word() for _ in range(r.choice([1, 3, 8, 30]))) for _ in range(n)]


@pytest.fixture(scope="module")
def inputs(spark):
    facts = spark.createDataFrame([(i, c) for i, c in enumerate([*made(1, 3000), "", "..."])], "fact_id bigint, claim string")
    asked = [*made(2, 40), "", "zzz unknown", "stone", "rare7 rare7 river", "the ox"]
    return facts, spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "query_id int, query string")


def ranked(frame):
    return sorted((r.query_id, r["rank"], r.fact_id, round(r.score, 6)) for r in frame.collect())


@pytest.mark.parametrize("k", [1, 10])
def test_topk_equals_scoring_all_pairs(spark, inputs, k, monkeypatch):
    monkeypatch.setattr(search_index, "BLOCK", 16)
    facts, asked = inputs
    put = Scratch(spark).put
    index = search_index.build(facts, put)
    assert ranked(search_index.topk(asked, index, k, put)) == ranked(retrieval.bm25_topk(asked, facts, k))


def test_few_pairs_are_scored(spark, inputs, monkeypatch):
    monkeypatch.setattr(search_index, "BLOCK", 16)
    facts, asked = inputs
    put = Scratch(spark).put
    index = search_index.build(facts, put)
    assert index.postings.agg(F.max("n")).first()[0] < 80
    scored = search_index.candidates(asked, index, 10, put)[0].count()
    assert scored < 0.2 * retrieval.bm25_scores(asked, facts).count()


def test_index_keeps_in_step(spark, inputs):
    """Facts leave, come back, and are added; the index gives what a new one would."""
    facts, asked = inputs
    put = Scratch(spark).put
    state = lambda keep: facts.withColumns({"project": F.lit("p"), "indexed": keep})
    asked = asked.withColumn("project", F.lit("p"))
    empty = [spark.createDataFrame([], s) for s in search_index.SCHEMAS.values()]
    index = search_index.Index(*empty)
    for number, keep in enumerate((F.col("fact_id") % 3 == 0, F.col("fact_id") % 2 == 0, F.col("fact_id") < 2500, F.lit(True)), 1):
        now = state(keep)
        more = {n: put(f) for n, f in search_index.changes(index, now, number).items()}
        assert more["index_docs"].count() < 3002
        index = search_index.Index(
            index.postings.unionByName(more["postings"]), index.docs.unionByName(more["index_docs"]), index.gone.unionByName(more["index_gone"])
        )
        assert ranked(search_index.topk(asked, index, 5, put)) == ranked(retrieval.bm25_topk(asked, now.where("indexed"), 5))
    assert search_index.changes(index, state(F.lit(True)), 9)["index_docs"].isEmpty()


def test_projects_do_not_mix(spark, inputs):
    facts, asked = inputs
    both = facts.withColumn("project", F.when(F.col("fact_id") % 2 == 0, "even").otherwise("odd"))
    index = search_index.build(both)
    for name in ("even", "odd"):
        got = search_index.topk(asked.withColumn("project", F.lit(name)), index, 4)
        assert ranked(got) == ranked(retrieval.bm25_topk(asked, both.where(F.col("project") == name), 4))


def test_empty_index(spark, inputs):
    facts, asked = inputs
    index = search_index.build(facts.limit(0))
    assert search_index.topk(asked, index).isEmpty()


def test_compact_keeps_projects_apart(spark, tmp_path):
    """A folder of several projects gives up the rows of one that is replaced later."""
    from gleaner.plans.store import Store

    store = Store(spark, str(tmp_path))
    marker = lambda project, at: spark.createDataFrame([(project, at)], "project string, enabled_at string")
    rows = lambda version=None: sorted((r.project, r.enabled_at) for r in store.table("markers", version).collect())
    for project in ("a", "b"):
        store.publish(replace={"markers": marker(project, "old")}, project=project)
    store.publish(append={"markers": marker("a", "more")}, project="a")
    before = store.compact("markers")
    assert rows() == [("a", "more"), ("a", "old"), ("b", "old")] and len(store._folders("markers", before)) == 1
    store.publish(replace={"markers": marker("a", "new")}, project="a")
    assert rows() == [("a", "new"), ("b", "old")] and rows(before) == [("a", "more"), ("a", "old"), ("b", "old")]
    store.compact("markers")
    assert rows() == [("a", "new"), ("b", "old")]
    assert store.vacuum() == 5 and store.vacuum() == 0
    assert rows() == [("a", "new"), ("b", "old")]


def test_engine_keeps_its_index(spark, tmp_path):
    from gleaner.plans.engine import Engine
    from gleaner.plans.store import FACTS

    engine = Engine(spark, str(tmp_path), "p")
    fact = dict.fromkeys([c.split()[0] for c in FACTS.split(", ")])
    fact |= {"project": "p", "significance": 1.0, "confidence": 0.5, "support_count": 1, "ask_seen_count": 0}
    rows = [fact | {"fact_id": i, "claim": c, "status": s, "indexed": True} for i, (c, s) in enumerate([("red apples", "active"), ("green apples", "ask"), ("plum jam", "active")], 1)]
    links = spark.createDataFrame([("p", 2, 1, "contradicts", 1)], "project string, fact_id bigint, related_id bigint, relation string, seq bigint")
    engine.store.publish(append={"facts": spark.createDataFrame(rows, FACTS), "links": links}, project="p")
    assert [r.fact_id for r in engine.search("apples").collect()] == [1]  # indexed on the spot
    engine.resolve(2, "keep_new", "now")
    assert [r.fact_id for r in engine.search("apples").collect()] == [2]
    assert {r.fact_id for r in engine._index().live().collect()} == {2, 3}
    engine.compact()
    assert [r.fact_id for r in engine.search("apples").collect()] == [2] and engine.store.table("index_gone").isEmpty()


def test_a_small_index_is_scored_without_blocks(spark, inputs, monkeypatch):
    """Nothing can be skipped among few facts; facts that have left do not count."""
    facts, asked = inputs
    put = Scratch(spark).put
    few = facts.where("fact_id < 300")
    index = search_index.build(few, put)
    index.gone = index.docs.where("fact_id % 7 = 0").select("project", "segment", "fact_id")
    monkeypatch.setattr(search_index, "candidates", lambda *a: pytest.fail("blocks were read"))
    got = search_index.topk(asked, index, 10, put)
    assert ranked(got) == ranked(retrieval.bm25_topk(asked, few.where("fact_id % 7 != 0"), 10))


def test_pairs_of_few_facts_are_not_shuffled(spark, inputs):
    """Queries are dealt once; their pairs are summed and ranked in the same place."""
    facts, asked = inputs
    top = retrieval.bm25_topk(asked, facts.where("fact_id < 300").limit(300), 10)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and not any("fact_id" in line.split("hashpartitioning(query_id")[1].split(")")[0] for line in plan.splitlines() if "hashpartitioning(query_id" in line)
