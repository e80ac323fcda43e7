"""A kept inverted index of facts, and a ranked top k that skips what cannot reach it.

The index is three tables by project.  ``postings`` has blocks of a term's facts: facts of
one class of impact (term frequency and length) share a block of ``BLOCK`` or so, split by
hash, with the largest frequency and the least length among them, from which a bound of
their BM25 part follows whatever the corpus statistics have become.  ``index_docs`` has each
fact's own terms.  ``index_gone`` names facts that have left.  Adding facts writes a new
segment, removing them a row each; nothing else is rewritten.

A query's top k takes three steps (MaxScore on blocks):

1. the facts in the best blocks of each of its terms are scored exactly; the k-th best of
   these is a bar that the k-th score reaches at least;
2. terms whose bounds together stay below a part of the bar bring no fact alone, so only the
   other terms' blocks are read, and of these only the ones whose bound with all other terms'
   bounds reaches the bar;
3. facts from there that may still reach the bar are scored exactly from their own terms.

A fact of the top k is in no skipped block, so the result is that of scoring all pairs.
An index of at most ``SMALL`` facts has nothing to skip: all pairs are scored at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import claim_tokens
from gleaner.operators.retrieval import K1, RETRIEVE, B, index_terms

BLOCK = 128
#: Blocks of a term, at most, that the bar is found from.
FIRST = 8
#: Part of the bar that terms which are not read may make up.  Less reads more and scores less.
SILENT = 0.4
#: Facts of an index that a query is scored against without looking for a bar.
SMALL = 1000
#: Scores closer than this count as equal when something is left out.
SLACK = 1e-6

POSTINGS = (
    "project string, segment bigint, term string, block bigint, n bigint, max_tf bigint, min_dl bigint, "
    "entries array<struct<fact_id:bigint,tf:bigint,dl:bigint>>"
)
DOCS = "project string, segment bigint, fact_id bigint, dl bigint, terms map<string,bigint>"
GONE = "project string, segment bigint, fact_id bigint"
SCHEMAS = {"postings": POSTINGS, "index_docs": DOCS, "index_gone": GONE}


@dataclass
class Index:
    """The three tables, of one project or several."""

    postings: DataFrame
    docs: DataFrame
    gone: DataFrame

    def live(self) -> DataFrame:
        """``docs`` of facts that have not left."""
        return self.docs.join(self.gone, ["project", "segment", "fact_id"], "left_anti")


def _with_project(df: DataFrame) -> DataFrame:
    return df if "project" in df.columns else df.withColumn("project", F.lit(""))


def segment(facts: DataFrame, number: int = 0) -> tuple[DataFrame, DataFrame]:
    """(postings, docs) of facts (fact_id, claim and, if there are several, project)."""
    rows = _with_project(facts).select("project", "fact_id", index_terms(F.col("claim")).alias("all"))
    rows = rows.withColumn("dl", F.size("all").cast("bigint"))
    # a claim's terms are few: counted inside its row
    counted = F.map_from_entries(
        F.transform(F.array_distinct("all"), lambda t: F.struct(t, F.size(F.filter("all", lambda x: x == t)).cast("bigint")))
    )
    docs = rows.select("project", F.lit(number).cast("bigint").alias("segment"), "fact_id", "dl", counted.alias("terms"))
    parts = docs.select("project", "segment", "fact_id", "dl", F.explode("terms").alias("term", "tf"))
    # facts of like impact share a block, so that a block's bound is close to what its facts have
    grade = F.least("tf", F.lit(15)) * 64 + F.floor(F.log2(F.greatest("dl", F.lit(1))))
    parts = parts.withColumn("grade", grade.cast("bigint"))
    sizes = parts.groupBy("project", "term", "grade").agg(F.ceil(F.count("*") / BLOCK).cast("bigint").alias("splits"))
    split = F.shiftleft(F.col("grade"), 40) + F.pmod(F.xxhash64("fact_id"), F.col("splits"))
    parts = parts.join(sizes, ["project", "term", "grade"]).withColumn("block", split)
    postings = parts.groupBy("project", "segment", "term", "block").agg(
        F.count("*").alias("n"),
        F.max("tf").alias("max_tf"),
        F.min("dl").alias("min_dl"),
        F.collect_list(F.struct("fact_id", "tf", "dl")).alias("entries"),
    )
    return postings, docs


def build(facts: DataFrame, put=lambda df: df) -> Index:
    """An index of one segment."""
    postings, docs = segment(facts)
    gone = facts.sparkSession.createDataFrame([], GONE)
    return Index(put(postings), put(docs), gone)


def changes(index: Index, facts: DataFrame, number: int) -> dict[str, DataFrame]:
    """What to append to each table so that the index holds the facts with ``indexed``.

    Facts that came to be indexed (new ones, or ones made active again) form the new segment;
    facts of the index that are not indexed any more are named as gone.
    """
    wanted = facts.where("indexed")
    live = index.live().select("project", "segment", "fact_id")
    postings, docs = segment(wanted.join(live, ["project", "fact_id"], "left_anti"), number)
    gone = live.join(wanted.select("project", "fact_id"), ["project", "fact_id"], "left_anti")
    return {"postings": postings, "index_docs": docs, "index_gone": gone.select("project", "segment", "fact_id")}


def _impact(tf: Column, dl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))


def _weights(queries: DataFrame, index: Index) -> DataFrame:
    """project, query_id, term, weight (query frequency times idf) and avgdl of asked terms that the index has."""
    asked = queries.select("project", "query_id", F.explode(claim_tokens(F.col("query"))).alias("term"))
    asked = asked.groupBy("project", "query_id", "term").agg(F.count("*").alias("qf"))
    wanted = asked.select("project", "term").distinct()
    there = index.postings.select("project", "term", "n").join(wanted, ["project", "term"]).groupBy("project", "term").agg(F.sum("n").alias("n"))
    left = index.docs.join(index.gone, ["project", "segment", "fact_id"], "left_semi").select("project", F.explode(F.map_keys("terms")).alias("term"))
    left = left.groupBy("project", "term").agg(F.count("*").alias("out"))
    df = there.join(left, ["project", "term"], "left").select("project", "term", (F.col("n") - F.coalesce("out", F.lit(0))).alias("df")).where("df > 0")
    stats = index.live().groupBy("project").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    return asked.join(df, ["project", "term"]).join(stats, "project").select("project", "query_id", "term", (F.col("qf") * idf).alias("weight"), "avgdl")


def _entries(blocks: DataFrame, index: Index) -> DataFrame:
    """Facts of blocks (project, query_id, term, segment, block, weight, avgdl) that have not left, with their part."""
    rows = blocks.join(index.postings.select("project", "segment", "term", "block", "entries"), ["project", "segment", "term", "block"])
    rows = rows.select("project", "query_id", "segment", "weight", "avgdl", F.inline("entries"))
    rows = rows.join(index.gone, ["project", "segment", "fact_id"], "left_anti")
    return rows.select("project", "query_id", "segment", "fact_id", (F.col("weight") * _impact(F.col("tf"), F.col("dl"))).alias("part"))


def candidates(queries: DataFrame, index: Index, k: int = RETRIEVE, put=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(project, query_id, segment, fact_id) of facts that may be among the k best, and the queries' weights."""
    weights = put(_weights(_with_project(queries), index))
    heads = index.postings.select("project", "segment", "term", "block", "n", "max_tf", "min_dl")
    bound = F.col("weight") * _impact(F.col("max_tf"), F.col("min_dl"))
    blocks = put(weights.join(heads, ["project", "term"]).withColumn("bound", bound).drop("max_tf", "min_dl"))
    by_term = ["project", "query_id", "term"]
    tops = put(blocks.groupBy(*by_term).agg(F.max("bound").alias("top")))

    # 1. the bar: the k-th best of the facts that the best blocks have
    falling = Window.partitionBy(*by_term).orderBy(F.desc("bound"), "segment", "block")
    before = F.coalesce(F.sum("n").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    best = blocks.withColumn("r", F.row_number().over(falling)).where(F.col("r") <= FIRST).withColumn("before", before).where(F.col("before") < 2 * k)
    first = _entries(best, index).select("project", "query_id", "segment", "fact_id").distinct()
    order = Window.partitionBy("project", "query_id").orderBy(F.desc("score"))
    bar = _exact(first, weights, index).withColumn("r", F.row_number().over(order)).where(F.col("r") == k)
    bar = bar.select("project", "query_id", (F.col("score") - SLACK).alias("bar"))

    # 2. terms that can bring a fact, and their blocks that can
    own = Window.partitionBy("project", "query_id")
    rising = own.orderBy("top", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = tops.select(*by_term, "top").join(bar, ["project", "query_id"], "left")
    held = held.withColumns({"sum": F.sum("top").over(rising), "all": F.sum("top").over(own)})
    brings = F.col("bar").isNull() | (F.col("sum") >= F.col("bar") * SILENT)
    held = held.withColumn("silent", F.coalesce(F.max(F.when(~brings, F.col("sum"))).over(own), F.lit(0.0))).where(brings)
    chosen = blocks.join(held.select(*by_term, "top", "all", "bar", "silent"), by_term)
    chosen = chosen.where(F.col("bar").isNull() | (F.col("bound") + F.col("all") - F.col("top") >= F.col("bar")))
    found = _entries(chosen.select(*by_term, "segment", "block", "weight", "avgdl"), index)
    found = found.groupBy("project", "query_id", "segment", "fact_id").agg(F.sum("part").alias("part"))
    limits = held.select("project", "query_id", "bar", "silent").distinct()
    found = found.join(limits, ["project", "query_id"]).where(F.col("bar").isNull() | (F.col("part") + F.col("silent") >= F.col("bar")))
    return found.select("project", "query_id", "segment", "fact_id"), weights


def _exact(found: DataFrame, weights: DataFrame, index: Index) -> DataFrame:
    """project, query_id, fact_id and score of pairs, from the terms of either side."""
    asked = weights.groupBy("project", "query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("asked"), F.first("avgdl").alias("avgdl"))
    rows = found.join(index.docs, ["project", "segment", "fact_id"]).join(asked, ["project", "query_id"])
    shared = F.array_intersect(F.map_keys("terms"), F.map_keys("asked"))
    one = lambda t: F.element_at("asked", t) * _impact(F.element_at("terms", t), F.col("dl"))
    score = F.aggregate(F.array_sort(shared), F.lit(0.0), lambda a, t: a + one(t))
    return rows.select("project", "query_id", "fact_id", score.alias("score"))


def _scored(queries: DataFrame, index: Index, put) -> DataFrame:
    """project, query_id, fact_id and score of all pairs that share a term.

    Queries are dealt once; where Spark broadcasts the gains, pairs are not shuffled.
    """
    live = index.live()
    terms = live.select("project", "fact_id", "dl", F.explode("terms").alias("term", "tf"))
    df = terms.groupBy("project", "term").agg(F.count("*").alias("df"))
    stats = live.groupBy("project").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.when(idf <= 0, 1e-6).otherwise(idf) * _impact(F.col("tf"), F.col("dl"))
    gains = put(terms.join(df, ["project", "term"]).join(stats, "project").select("project", "term", "fact_id", gain.alias("gain")))
    asked = queries.repartition("query_id").select("project", "query_id", F.explode(claim_tokens(F.col("query"))).alias("term"))
    asked = asked.groupBy("project", "query_id", "term").agg(F.count("*").alias("qf"))
    return asked.join(gains, ["project", "term"]).groupBy("project", "query_id", "fact_id").agg(F.sum(F.col("qf") * F.col("gain")).alias("score"))


def topk(queries: DataFrame, index: Index, k: int = RETRIEVE, put=lambda df: df) -> DataFrame:
    """project, query_id, fact_id, score and rank of the k best facts of each query, ties to the lowest id.

    queries: query_id, query and, if the index has several, project.
    """
    if index.docs.limit(SMALL + 1).count() <= SMALL:
        exact = _scored(_with_project(queries), index, put)
    else:
        # 3. exact scores of what is left
        exact = _exact(*candidates(queries, index, k, put), index)
    order = Window.partitionBy("project", "query_id").orderBy(F.desc(F.round("score", 9)), "fact_id")
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
