"""Lifecycle of facts, links and runs as functions from one snapshot to the next.

Facts and links belong to a project: a fact is named by (project, fact_id) wherever both
sides of a join have a project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import CATEGORIES

ASK_RUNS = 3
STATUSES = ("active", "superseded", "retired", "ask")
RESOLVE_CHOICES = ("keep_new", "keep_old")


def _key(*frames: DataFrame) -> list[str]:
    return [c for c in ("project", "fact_id") if all(c in f.columns for f in frames)]


def add_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """Edges (project, fact_id, related_id, relation), each once; new ones come after the old ones."""
    edge = [*_key(links, new), "related_id", "relation"]
    fresh = new.select(*edge).distinct().join(links, edge, "left_anti")
    if "seq" in links.columns:
        by = [c for c in edge if c == "project"]
        last = links.groupBy(*by).agg(F.max("seq").alias("_last"))
        fresh = fresh.join(last, by, "left") if by else fresh.crossJoin(F.broadcast(last))
        order = Window.partitionBy(*by).orderBy("fact_id", "related_id", "relation")
        fresh = fresh.withColumn("seq", F.coalesce("_last", F.lit(0)) + F.row_number().over(order)).drop("_last")
    return links.unionByName(fresh)


def new_sources(facts: DataFrame, sources: DataFrame, support: DataFrame) -> DataFrame:
    """Edges (project, fact_id, event_id) of ``support`` that ``sources`` lacks, each once; facts that are not there gain none.

    The join with the known edges is by fact and event, so a fact with many sources is many
    small keys.
    """
    key = _key(facts, support, sources)
    edge = [*key, "event_id"]
    fresh = support.select(*edge).distinct().join(sources.select(*edge), edge, "left_anti")
    return fresh.join(facts.select(*key), key, "left_semi")


def bump_support(facts: DataFrame, gained: DataFrame, now: str) -> DataFrame:
    """Count the new source edges (see new_sources) of each fact."""
    key = _key(facts, gained)
    counted = gained.groupBy(*key).agg(F.count("*").alias("_more"))
    joined = facts.join(counted, key, "left")
    gains = F.col("_more").isNotNull()
    return joined.withColumns(
        {
            "support_count": (F.col("support_count") + F.coalesce("_more", F.lit(0))).cast("int"),
            "last_supported_at": F.when(gains, F.lit(now)).otherwise(F.col("last_supported_at")),
            "updated_at": F.when(gains, F.lit(now)).otherwise(F.col("updated_at")),
        }
    ).drop("_more")


def set_status(facts: DataFrame, ids: DataFrame, status: str, now: str) -> DataFrame:
    """Change the status of facts; only active and asked ones stay indexed."""
    hit = F.col("_hit").isNotNull()
    key = _key(facts, ids)
    joined = facts.join(ids.select(*key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    changes = {
        "status": F.when(hit, F.lit(status)).otherwise(F.col("status")),
        "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at")),
        "indexed": F.when(hit, F.lit(status in ("active", "ask"))).otherwise(F.col("indexed")),
    }
    if status in ("active", "ask"):
        changes["ask_seen_count"] = F.when(hit, F.lit(0)).otherwise(F.col("ask_seen_count"))
    return joined.withColumns(changes).drop("_hit")


def supersede(facts: DataFrame, links: DataFrame, pairs: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """pairs: fact_id is superseded by by_id; returns new (facts, links)."""
    project = [c for c in pairs.columns if c == "project"]
    edges = pairs.select(*project, F.col("by_id").alias("fact_id"), F.col("fact_id").alias("related_id"), F.lit("supersedes").alias("relation"))
    return set_status(facts, pairs.select(*project, "fact_id"), "superseded", now), add_links(links, edges)


def retire(facts: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """Out of the index; the row stays."""
    return set_status(facts, ids, "retired", now)


def mark_ask(facts: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """Hold facts for a decision; they stay indexed and count runs from zero."""
    return set_status(facts, ids, "ask", now)


def reactivate(facts: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    return set_status(facts, ids, "active", now)


def mark_verified(facts: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """The audit mark of older stores; nothing here sets it by itself."""
    key = _key(facts, ids)
    joined = facts.join(ids.select(*key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    changed = {c: F.when(F.col("_hit"), F.lit(now)).otherwise(F.col(c)) for c in ("verified_at", "updated_at")}
    return joined.withColumns(changed).drop("_hit")


def bump_and_expire_asks(facts: DataFrame, now: str, runs: int = ASK_RUNS) -> DataFrame:
    """Count a run for every ask; at ``runs`` it is retired."""
    ask = F.col("status") == "ask"
    seen = F.when(ask, F.col("ask_seen_count") + 1).otherwise(F.col("ask_seen_count"))
    over = ask & (seen >= runs)
    return facts.withColumns(
        {
            "expired": over,
            "ask_seen_count": seen,
            "status": F.when(over, "retired").otherwise(F.col("status")),
            "indexed": F.col("indexed") & ~over,
            "updated_at": F.when(ask, F.lit(now)).otherwise(F.col("updated_at")),
        }
    )


def resolve(facts: DataFrame, links: DataFrame, fact_id: int, choice: str, now: str, project: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Settle an ask: keep_new supersedes all its partners, keep_old retires it.

    ``project`` may be left out only where one project has a fact of that id.
    """
    here = F.col("fact_id") == fact_id
    if project is not None:
        here &= F.col("project") == project
    found = facts.where(here).select("status").limit(2).collect()
    if len(found) > 1:
        raise ValueError(f"several projects have a fact {fact_id}")
    if not found or found[0]["status"] != "ask":
        raise ValueError(f"fact {fact_id} is not an open ask")
    if choice not in RESOLVE_CHOICES:
        raise ValueError("choice is keep_new or keep_old")
    key = _key(facts, links)
    own = facts.where(here).select(*key)
    edges = links.where("relation = 'contradicts'").join(own, key, "left_semi")
    partners = edges.select(*key[:-1], F.col("related_id").alias("fact_id"), F.lit(fact_id).cast("bigint").alias("by_id"))
    if partners.isEmpty():
        raise ValueError(f"ask {fact_id} has no partners")
    if choice == "keep_old":
        return retire(facts, own, now), links
    facts, links = supersede(facts, links, partners, now)
    return reactivate(facts, own, now), links


def contradicts_partners(facts: DataFrame, links: DataFrame) -> DataFrame:
    """(project, fact_id, partner_id, partner_claim, seq): partners of conflict edges, by seq the oldest first."""
    edges = links.where("relation = 'contradicts'").select("project", "fact_id", F.col("related_id").alias("partner_id"), "seq")
    claims = facts.select("project", F.col("fact_id").alias("partner_id"), F.col("claim").alias("partner_claim"))
    return edges.join(claims, ["project", "partner_id"])


def open_asks(facts: DataFrame, links: DataFrame) -> DataFrame:
    """Open asks with their first partner."""
    first = contradicts_partners(facts, links).groupBy("project", "fact_id").agg(
        F.min_by(F.struct("partner_id", "partner_claim"), "seq").alias("p")
    )
    asks = facts.where("status = 'ask'").select("project", "fact_id", "claim", "confidence")
    return asks.join(first, ["project", "fact_id"], "left").select("project", "fact_id", "claim", "confidence", "p.partner_id", "p.partner_claim")


def sessions_by_fact(facts: DataFrame, sources: DataFrame, events: DataFrame) -> DataFrame:
    """Distinct sessions behind each fact, one at least.

    sources: project, fact_id, event_id.  A fact and session are paired once before they are
    counted, so no task holds the sources of a fact.
    """
    key = _key(facts, sources)
    by = [c for c in ("project", "id") if c in sources.columns or c == "id"]
    edges = sources.withColumnRenamed("event_id", "id")
    pairs = edges.join(events.select(*by, "session_id"), by).select(*key, "session_id").where("session_id IS NOT NULL").distinct()
    counts = pairs.groupBy(*key).agg(F.count("*").alias("_n"))
    return facts.select(*key).join(counts, key, "left").select(*key, F.coalesce("_n", F.lit(1)).alias("sessions"))


def category_place(category: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CATEGORIES)), category)


def memory_order(facts: DataFrame) -> DataFrame:
    """Facts as the memory file lists them; unknown categories last, none left out."""
    place = category_place(F.col("category"))
    rows = facts.where("status = 'active' AND category != 'none'").withColumn("_p", F.when(place == 0, 99).otherwise(place))
    return rows.orderBy("_p", "category", F.desc("significance"), F.desc("confidence"), "fact_id").drop("_p")


def memory_places(facts: DataFrame) -> DataFrame:
    """``facts`` of the memory file with ``place``, its line number there from 1.

    Facts are counted by category and significance in steps of a thousandth, which are a
    bounded number of rows; sums over these give each step's first place, and only facts
    of one step are put in order together.
    """
    at = category_place(F.col("category"))
    rows = facts.where("status = 'active' AND category != 'none'").withColumns(
        {
            "_p": F.when(at == 0, 99).otherwise(at),
            # unknown categories go by name first
            "_s": F.when(at == 0, 0).otherwise(-F.floor(F.greatest(F.lit(0.0), F.least(F.lit(3.0), F.col("significance"))) * 1000)),
        }
    )
    step = ["_p", "_s"]
    before = Window.orderBy(*step).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*step).agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*step).orderBy("category", F.desc("significance"), F.desc("confidence"), "fact_id")
    return rows.withColumn("_r", F.row_number().over(inside)).join(starts, step).withColumn("place", F.col("_first") + F.col("_r")).drop(*step, "_r", "_first")


def recall_topk(facts: DataFrame, limit: int = 12) -> DataFrame:
    return facts.where("status = 'active'").orderBy(F.desc("confidence"), "fact_id").limit(limit)


def status_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("project").agg(F.count("*").alias("events"), F.count_if(F.col("graded_at").isNull()).alias("pending"))


def fact_status_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("project", "status").agg(F.count("*").alias("n"))


def last_run(runs: DataFrame, by: list[str]) -> DataFrame:
    rest = [c for c in runs.columns if c not in (*by, "id")]
    return runs.groupBy(*by).agg(F.max("id").alias("id"), F.max_by(F.struct(*rest), "id").alias("_r")).select(*by, "id", "_r.*")
