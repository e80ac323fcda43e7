"""Exact and lexical retrieval of facts: equality joins, BM25 postings, Jaccard top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import claim_norm, claim_tokens, jaccard

K1, B = 1.2, 0.75
RETRIEVE, KEEP = 10, 5

#: Letters and what they are without diacritics, for the index side.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def oldest_equal(claims: DataFrame, facts: DataFrame, claim: str, keys: list[str]) -> DataFrame:
    """Lowest fact id whose normalised claim equals the claim's; empty never matches.

    Rows that have ``_norm`` already (the normalised text, or on both sides its digest) are taken by that.
    """
    normed = lambda rows, c: rows if "_norm" in rows.columns else rows.withColumn("_norm", claim_norm(F.col(c)))
    known = normed(facts, "claim").where("_norm != ''")
    oldest = known.groupBy(*keys, "_norm").agg(F.min("fact_id").alias("fact_id"))
    return normed(claims, claim).join(oldest, [*keys, "_norm"]).drop("_norm")


def index_terms(text: Column) -> Column:
    """Unicode words of the index side, lower-cased and without diacritics."""
    plain = F.translate(F.lower(text), ACCENTED, PLAIN)
    return F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def bm25_scores(queries: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, fact_id, score) of all facts that share a term.

    queries: query_id, query; facts: fact_id, claim.  Query terms count as often as
    they occur.  The postings join is on the term; the corpus statistics are three
    numbers and join by a cross of one row, which is a broadcast of fixed size.
    Queries are dealt by query_id first: where Spark broadcasts the postings of few facts, a
    query's pairs are summed and ranked where they are, and are not shuffled.
    """
    terms = facts.select("fact_id", index_terms(F.col("claim")).alias("terms"))
    stats = terms.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("avgdl"))
    # a posting carries its document's length, and its term's document frequency from the asked terms only
    postings = terms.select("fact_id", F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy("term", "fact_id", "dl").agg(F.count("*").alias("tf"))
    asked = queries.repartition("query_id").select("query_id", F.explode(claim_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    asked = asked.join(df, "term")
    rows = asked.join(postings, "term").join(F.broadcast(stats))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    part = F.col("qf") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("query_id", "fact_id").agg(F.sum(part).alias("score"))


def bm25_topk(queries: DataFrame, facts: DataFrame, k: int = RETRIEVE) -> DataFrame:
    """The k best facts of each query, ties to the lowest id."""
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "fact_id")
    return bm25_scores(queries, facts).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def retrieve_similar(queries: DataFrame, facts: DataFrame, k: int = RETRIEVE, keep: int = KEEP, top: DataFrame | None = None) -> DataFrame:
    """BM25 top k over indexed facts, then active ones by Jaccard, at most ``keep``.

    ``top`` is that top k if a kept index gave it (see search_index).
    """
    top = (bm25_topk(queries, facts.where("indexed"), k) if top is None else top).select("query_id", "fact_id")
    # each text is cut into tokens once, not once a pair
    known = facts.where("status = 'active'").select("fact_id", claim_tokens(F.col("claim")).alias("_known"))
    said = queries.select("query_id", claim_tokens(F.col("query")).alias("_said"))
    scored = top.join(known, "fact_id").join(said, "query_id").withColumn("jaccard", jaccard(F.col("_said"), F.col("_known")))
    best = Window.partitionBy("query_id").orderBy(F.desc("jaccard"), "fact_id")
    ranked = scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= keep)
    return ranked.select("query_id", "fact_id", "place", "jaccard")


def _flat(table: pa.Table, column: str) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists end to end, and the length of each list."""
    lists = table.column(column).combine_chunks()
    return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def _best_of_block(asks: pa.Table, docs: pa.Table) -> pa.Table:
    """(project, ord, fact_id, score): the RETRIEVE best of a block's facts for each of a block of queries.

    asks: project, ord, mean, terms, weights; docs: project, at, terms.  A query sees the facts
    before it (at < ord), whose id is -1 - at; of equals (to nine places) the later ones count.
    """
    found = []
    if asks.num_rows and docs.num_rows:
        docs = docs.sort_by("at")
        at, m = docs.column("at").to_numpy(), docs.num_rows
        (own, dl), (told, sizes) = _flat(docs, "terms"), _flat(asks, "terms")
        words = pa.chunked_array([own, told]).combine_chunks().dictionary_encode()
        codes = words.indices.to_numpy().astype(np.int64)
        # postings, by term and then by fact
        posting, tf = np.unique(codes[: len(own)] * m + np.repeat(np.arange(m), dl), return_counts=True)
        row, first = posting % m, np.searchsorted(posting // m, np.arange(len(words.dictionary) + 1))
        asked, weights = codes[len(own) :], _flat(asks, "weights")[0].to_numpy()
        ends = np.cumsum(sizes)
        for ord_, mean, a, b in zip(asks.column("ord").to_pylist(), asks.column("mean").to_pylist(), ends - sizes, ends):
            lo, n = first[asked[a:b]], first[asked[a:b] + 1] - first[asked[a:b]]
            i = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
            weight, facts = np.repeat(weights[a:b], n), row[i]
            if at[-1] >= ord_:
                early = facts < np.searchsorted(at, ord_)
                i, weight, facts = i[early], weight[early], facts[early]
            if not len(i):
                continue
            score = np.bincount(facts, weight * tf[i] * (K1 + 1) / (tf[i] + K1 * (1 - B + B * dl[facts] / mean)))
            seen = np.flatnonzero(score)
            rounded = np.round(score[seen], 9)
            if len(seen) > RETRIEVE:
                near = rounded >= np.partition(rounded, -RETRIEVE)[-RETRIEVE]
                seen, rounded = seen[near], rounded[near]
            best = seen[np.lexsort((-seen, -rounded))[:RETRIEVE]]
            found.append((np.full(len(best), ord_), -1 - at[best], score[best]))
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.array([], t) for t in (np.int64, np.int64, np.float64)]
    project = pa.array([asks.column("project")[0].as_py()] * len(columns[0]) if found else [], pa.string())
    return pa.table([project, *map(pa.array, columns)], ["project", "ord", "fact_id", "score"])


def best_before(asks: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(project, ord, fact_id, score): facts that may be among the RETRIEVE best of those before each query.

    asks: project, ord, mean, terms, weights (of each term); docs: project, at, terms (with repeats).  All pairs that
    share a term are scored, but inside tasks, each of a block of ``size`` places of queries against
    one of facts: the best of each are rows, pairs are not.  Both are sent to the blocks they
    meet, so what is shuffled grows with the number of blocks of a project.
    """
    block = lambda c: F.floor(F.col(c) / size)
    blocked = asks.withColumn("qb", block("ord"))
    wanted = F.broadcast(blocked.select(F.col("project").alias("_project"), F.col("qb").alias("_qb")).distinct())
    left = blocked.withColumn("db", F.explode(F.sequence(F.lit(0).cast("bigint"), "qb")))
    right = docs.select(F.col("project").alias("_p"), F.col("at").alias("at"), F.col("terms").alias("terms"), block("at").alias("_db")).join(wanted, F.col("_p") == F.col("_project")).where("_db <= _qb")
    both = left.groupBy("project", "qb", "db").cogroup(right.groupBy("_project", "_qb", "_db"))
    return both.applyInArrow(_best_of_block, "project string, ord bigint, fact_id bigint, score double")
