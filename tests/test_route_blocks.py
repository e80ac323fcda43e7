"""Routing by blocks: facts of the run are scored inside tasks, and a block's size changes no result."""

import math
import random
import re

from pyspark.sql import functions as F

from gleaner.operators import retrieval
from gleaner.plans import distill


def plain(rows):
    """(ord, route, partners) one candidate after the other; rows: (ord, claim, significance), norms all distinct."""
    added, out = [], []
    for ord_, claim, significance in rows:
        words = re.findall("[a-z0-9]+", claim)
        scores = {}
        mean = sum(len(w) for _, w in added) / max(1, len(added))
        for term in words:
            df = sum(term in w for _, w in added)
            for at, w in added:
                if tf := w.count(term):
                    idf = max(math.log((len(added) - df + 0.5) / (df + 0.5)), 1e-6)
                    scores[at] = scores.get(at, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        if significance < 2 or not scores:
            added.append((ord_, words))
            out.append((ord_, "add", []))
            continue
        top = sorted(scores, key=lambda at: (-round(scores[at], 9), -at))[:10]
        said = dict(added)
        ratio = lambda at: len(set(words) & set(said[at])) / len(set(words) | set(said[at]))
        out.append((ord_, "pair", [-1 - at for at in sorted(top, key=lambda at: (-ratio(at), -at))[:5]]))
    return out


def test_blocks_of_any_size_route_alike(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, " ".join(r.choices([f"w{k}" for k in range(30)], k=r.randint(3, 9))) + f" own{i}", r.choice([1.2, 2.5])) for i in range(1, 61)]
    expected = plain(rows)
    kept = spark.createDataFrame([("p", o, c, c, s) for o, c, s in rows], "project string, ord long, norm string, claim string, significance double")
    for size in (7, 2048):
        monkeypatch.setattr(distill, "LEAST", size)
        found = distill.route(kept, spark.createDataFrame([], distill.FACTS))
        assert sorted((x.ord, x.route, x.partners) for x in found.collect()) == expected


def test_pairs_are_not_rows(spark):
    docs = spark.range(1, 401).select(F.lit("p").alias("project"), F.col("id").alias("at"), F.array(F.lit("the"), F.concat(F.lit("w"), F.col("id") % 7)).alias("terms"))
    asks = docs.select("project", F.col("at").alias("ord"), F.lit(2.0).alias("mean"), "terms", F.array(F.lit(0.1), F.lit(1.0)).alias("weights"))
    found = retrieval.best_before(asks, docs, 100).collect()
    # at most ten a query and block of facts before it, of 79,800 pairs that share a term
    assert len(found) <= sum(10 * (o // 100 + 1) for o in range(1, 401))
    best = sorted((x for x in found if x.ord == 400), key=lambda x: (-round(x.score, 9), x.fact_id))[:10]
    assert [-1 - x.fact_id for x in best] == [400 - 7 * k for k in range(1, 11)]
