"""Distill: pending events to graded facts, as one plan from snapshot to snapshot.

All of it is relational.  Routing is sequential by nature (a fact added for one candidate
is seen by the next), and is settled in rounds of joins over all candidates of a run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import claim_norm, claim_tokens, fact_confidence, jaccard
from gleaner.operators import batching, gates, judges, lifecycle, questions, scan
from gleaner.operators import events as ev
from gleaner.operators.retrieval import K1, KEEP, RETRIEVE, B, best_before, index_terms
from gleaner.plans.scratch import Scratch
from gleaner.plans.store import FACTS, LINKS, SOURCES

__all__ = ["FACTS", "LINKS", "SOURCES", "Outcome", "distill", "plan_run", "route"]

_TFS = "map<string,bigint>"
_NONE_NEAR = (
    f"project string, ord bigint, fact_id bigint, dl bigint, active boolean, ratio double, tfs {_TFS}, lo double, hi double",
    "project string, ord bigint, term string, df bigint",
    "project string, n bigint, total bigint",
)


def _near(kept: DataFrame, facts: DataFrame, k: int = RETRIEVE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What routing has to know of the facts that the project has indexed.

    (project, ord, fact_id, dl, active, ratio, tfs, lo, hi): the facts that may be among the
    ``k`` best of a candidate by BM25, whatever the run has added before it.  Facts of the run
    raise N and a term's frequency by at most its number of candidates and move the mean
    length at most to that of their shortest or longest; these give each score the bounds lo
    and hi, and a fact whose upper bound is below the k-th best lower bound is out.
    (project, ord, term, df): document frequencies of asked terms.  (project, n, total): number
    of facts and of their terms.
    """
    indexed = facts.where("indexed")
    terms = indexed.select("project", "fact_id", index_terms(F.col("claim")).alias("terms"))
    stats = terms.groupBy("project").agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("total"))
    size = F.size(index_terms(F.col("claim")))
    runs = kept.groupBy("project").agg(F.count("*").alias("m"), F.min(size).alias("least"), F.max(size).alias("most"))
    asked = _asked_terms(kept.where(F.col("significance") >= gates.PAIRING))
    wanted = asked.select("project", "term").distinct()
    postings = (
        terms.select("project", "fact_id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
        .join(wanted, ["project", "term"])
        .groupBy("project", "term", "fact_id", "dl")
        .agg(F.count("*").alias("tf"))
    )
    frequency = postings.groupBy("project", "term").agg(F.count("*").alias("df"))
    weighed = asked.join(frequency, ["project", "term"]).join(stats, "project").join(runs, "project")
    idf = lambda n, df: F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    # the number of facts without the term can only grow, as can the number with it
    weighed = weighed.withColumns(
        {
            "high": idf(F.col("n") + F.col("m"), F.col("df")),
            "low": F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + F.col("m") + 0.5)), F.lit(1e-6)),
            "short": F.least(F.col("total") / F.col("n"), F.col("least").cast("double")),
            "long": F.greatest(F.col("total") / F.col("n"), F.col("most").cast("double")),
        }
    )
    part = lambda weight, mean: F.col("qf") * weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.greatest(mean, F.lit(1e-9))))
    scored = (
        weighed.join(postings, ["project", "term"])
        .groupBy("project", "ord", "fact_id", "dl")
        .agg(
            F.sum(part(F.col("low"), F.col("short"))).alias("lo"),
            F.sum(part(F.col("high"), F.col("long"))).alias("hi"),
            F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("tfs"),
        )
    )
    best = Window.partitionBy("project", "ord").orderBy(F.desc("lo"))
    bar = scored.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == k).select("project", "ord", F.col("lo").alias("bar"))
    near = scored.join(bar, ["project", "ord"], "left").where(F.col("bar").isNull() | (F.col("hi") >= F.col("bar") - 1e-6))
    claims = indexed.select("project", "fact_id", F.col("claim").alias("known"), (F.col("status") == "active").alias("active"))
    ratio = jaccard(claim_tokens(F.col("claim")), claim_tokens(F.col("known")))
    near = near.join(claims, ["project", "fact_id"]).join(kept.select("project", "ord", "claim"), ["project", "ord"])
    near = near.select("project", "ord", "fact_id", F.col("dl").cast("bigint").alias("dl"), "active", ratio.alias("ratio"), F.col("tfs").cast(_TFS).alias("tfs"), "lo", "hi")
    return near, asked.join(frequency, ["project", "term"]).select("project", "ord", "term", "df"), stats


def _asked_terms(kept: DataFrame) -> DataFrame:
    rows = kept.select("project", "ord", F.explode(claim_tokens(F.col("claim"))).alias("term"))
    return rows.groupBy("project", "ord", "term").agg(F.count("*").alias("qf"))


#: Blocks that a project's candidates are cut into, and the least and the most places of one.
BLOCKS, LEAST, MOST = 16, 2048, 65536


def _added_with(asked: DataFrame, postings: DataFrame, size: int) -> DataFrame:
    """(project, ord, term, more): how many facts before each asked term's candidate have the term.

    asked: project, ord, term; postings: project, at, term, each once.  Counted inside blocks of
    ``size`` places, and by blocks, so that no task sees all that have a common term.
    """
    rows = asked.select("project", "term", "ord", F.lit(0).cast("bigint").alias("one")).unionByName(
        postings.select("project", "term", F.col("at").alias("ord"), F.lit(1).cast("bigint").alias("one"))
    )
    key = ["project", "term", "block"]
    rows = rows.withColumn("block", F.floor(F.col("ord") / size))
    inside = Window.partitionBy(*key).orderBy("ord").rangeBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("project", "term").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*key).agg(F.sum("one").alias("ones"), F.min("one").alias("least"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("ones").over(earlier), F.lit(0))).where("least = 0").select(*key, "before")
    own = rows.withColumn("own", F.coalesce(F.sum("one").over(inside), F.lit(0))).where("one = 0")
    return own.join(blocks, key).select("project", "ord", "term", (F.col("own") + F.col("before")).alias("more"))


def _partners(asking: DataFrame, added: DataFrame, near: tuple[DataFrame, DataFrame, DataFrame], put) -> DataFrame:
    """(project, ord, partners) of candidates that have any: at most KEEP active facts of the RETRIEVE best.

    asking: project, ord, claim, and what had been added before it (more_n, more_total).  added:
    project, at (its ord), claim; only those before a candidate count for it.
    """
    old, frequency, stats = near
    key = ["project", "ord"]
    terms = added.select("project", "at", index_terms(F.col("claim")).alias("terms"))
    postings = terms.select("project", "at", F.explode(F.array_distinct("terms")).alias("term"))
    size = min(MOST, max(LEAST, (asking.agg(F.max("ord")).first()[0] or 0) // BLOCKS + 1))
    asked = _asked_terms(asking)
    own = F.coalesce("df", F.lit(0)) + F.coalesce("more", F.lit(0))
    n = F.coalesce("n", F.lit(0)) + F.col("more_n")
    weights = (
        asked.join(frequency, [*key, "term"], "left")
        .join(_added_with(asked, postings, size), [*key, "term"], "left")
        .join(asking.select(*key, "more_n", "more_total"), key)
        .join(stats, "project", "left")
        .withColumns({"own": own, "all": n, "mean": (F.coalesce("total", F.lit(0)) + F.col("more_total")) / F.greatest(n, F.lit(1))})
        .where("own > 0 AND mean > 0")
        .select(*key, "term", "mean", (F.col("qf") * F.greatest(F.log((F.col("all") - F.col("own") + 0.5) / (F.col("own") + 0.5)), F.lit(1e-6))).alias("weight"))
    )
    listed = F.array_sort(F.collect_list(F.struct("term", "weight")))
    asks = put(weights.groupBy(*key).agg(F.first("mean").alias("mean"), listed.alias("l")).select(*key, "mean", F.col("l.term").alias("terms"), F.col("l.weight").alias("weights")))
    known = old.join(asking.select(*key), key, "left_semi").select(*key, "fact_id", "dl", F.explode("tfs").alias("term", "tf"))
    rows = known.join(asks.select(*key, "mean", F.explode(F.arrays_zip("terms", "weights")).alias("w")).select(*key, "mean", F.col("w.terms").alias("term"), F.col("w.weights").alias("weight")), [*key, "term"])
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    scores = rows.groupBy(*key, "fact_id").agg(F.sum(part).alias("score")).unionByName(best_before(asks, terms, size))
    best = Window.partitionBy(*key).orderBy(F.desc(F.round("score", 9)), "fact_id")
    top = put(scores.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= RETRIEVE).select(*key, "fact_id"))
    # facts of the run are active; their ratios are taken for the few that came so far, each claim cut into tokens once
    claims = added.select("project", (-1 - F.col("at")).alias("fact_id"), claim_tokens(F.col("claim")).alias("_known"))
    said = asking.select(*key, claim_tokens(F.col("claim")).alias("_said"))
    fresh = top.where("fact_id < 0").join(claims, ["project", "fact_id"]).join(said, key)
    fresh = fresh.select(*key, "fact_id", jaccard(F.col("_said"), F.col("_known")).alias("ratio"))
    stored = top.where("fact_id >= 0").join(old.where("active").select(*key, "fact_id", "ratio"), [*key, "fact_id"])
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("ratio"), "fact_id"))
    chosen = fresh.unionByName(stored.select(*fresh.columns)).withColumn("_p", place).where(F.col("_p") <= KEEP)
    listed = F.array_sort(F.collect_list(F.struct("_p", "fact_id")))
    return chosen.groupBy(*key).agg(F.transform(listed, lambda x: x["fact_id"]).alias("partners"))


def _before(rows: DataFrame, put) -> DataFrame:
    """``rows`` (project, ord, claim, is_added) with the number and the length of facts added before each."""
    length = F.size(index_terms(F.col("claim")))
    counted = rows.withColumns({"_one": F.col("is_added").cast("bigint"), "_len": F.when(F.col("is_added"), length).otherwise(0).cast("bigint")})
    return scan.running(counted, ["project"], ["ord"], put, more_n="_one", more_total="_len").drop("_one", "_len")


def route(kept: DataFrame, facts: DataFrame, put=None) -> DataFrame:
    """What to do with each kept candidate: duplicate, add, or pair with partners.

    kept: project, ord, norm, claim, significance; facts: as in FACTS.  Facts that this
    run adds have negative ids, -1 - ord, until they are numbered.

    A candidate depends on those before it that are added: whether one has its norm, whether one
    shares a term, and, where ten asks may fill its top, on scores.  All candidates are decided
    at once from a guess of what is added, and again from what comes out, until nothing changes.
    As the first r candidates are right after r rounds, that ends with the result of one
    after the other; as a rule it takes a few rounds.  Partners are found when all is decided.
    """
    put = put or Scratch(kept.sparkSession).put
    key = ["project", "ord"]
    kept = put(kept.select("project", F.col("ord").cast("bigint").alias("ord"), "norm", "claim", "significance"))
    active = facts.where("status = 'active'").select("project", claim_norm(F.col("claim")).alias("norm"), "fact_id")
    equal = active.join(kept.select("project", "norm").distinct(), ["project", "norm"]).groupBy("project", "norm").agg(F.min("fact_id").alias("equal"))
    # a run without a candidate that looks for partners has nothing to search for
    searches = not kept.where(F.col("significance") >= gates.PAIRING).isEmpty()
    near = tuple(put(f) for f in _near(kept, facts)) if searches else tuple(kept.sparkSession.createDataFrame([], s) for s in _NONE_NEAR)

    # what the old facts alone settle: see the bounds of _near
    nearest = near[0].groupBy(*key).agg(F.max(F.when(F.col("active"), F.col("lo"))).alias("la"))
    above = near[0].where("NOT active").join(nearest, key).groupBy(*key).agg(F.count("*").alias("asks"), F.count_if(F.col("hi") >= F.col("la") - 1e-6).alias("over"))
    rows = kept.join(equal, ["project", "norm"], "left").join(nearest, key, "left").join(above, key, "left").fillna(0, ["asks", "over"])
    looks = F.col("significance") >= gates.PAIRING
    sure = F.col("equal").isNotNull() | (looks & F.col("la").isNotNull() & (F.col("over") < RETRIEVE))
    fixed = put(
        rows.select(
            *key, "norm", "claim", "equal", sure.alias("sure"), looks.alias("looks"), (looks & ~sure & (F.col("asks") >= RETRIEVE)).alias("waits"),
        )
    )
    words = put(fixed.where("looks AND NOT sure AND NOT waits").select(*key, F.explode(F.array_distinct(claim_tokens(F.col("claim")))).alias("term")))
    scored = not fixed.where("waits").isEmpty()
    state = put(fixed.withColumn("is_added", ~F.col("sure")))
    while True:
        added = state.where("is_added")
        by_norm = added.groupBy("project", "norm").agg(F.min("ord").alias("norm_added"))
        by_term = added.select("project", "ord", F.explode(F.array_distinct(index_terms(F.col("claim")))).alias("term"))
        by_term = by_term.groupBy("project", "term").agg(F.min("ord").alias("a"))
        seen = words.join(by_term, ["project", "term"]).groupBy(*key).agg(F.min("a").alias("term_added"))
        asked = state.join(seen, key, "left").join(by_norm, ["project", "norm"], "left").withColumn("some", F.lit(None).cast("boolean"))
        if scored:
            asking = _before(state, put).where("waits").select(*key, "claim", "more_n", "more_total")
            found = _partners(asking, added.select("project", F.col("ord").alias("at"), "claim"), near, put)
            asked = asked.drop("some").join(found.select(*key, F.lit(True).alias("some")), key, "left")
        earlier = lambda c: F.coalesce(F.col(c) < F.col("ord"), F.lit(False))
        out = F.when(F.col("sure") | earlier("norm_added"), False).when(~F.col("looks"), True)
        out = out.when(F.col("waits"), F.col("some").isNull()).otherwise(~earlier("term_added"))
        after = put(asked.select(*fixed.columns, out.alias("is_added"), (out != F.col("is_added")).alias("changed")))
        state, changed = after.drop("changed"), not after.where("changed").isEmpty()
        if not changed:
            break

    adds = state.where("is_added").select("project", "norm", F.col("ord").alias("at"), "claim")
    same = adds.select("project", "norm", "at")
    final = state.join(same, ["project", "norm"], "left")
    twin = F.coalesce("equal", F.when(~F.col("is_added") & (F.col("at") < F.col("ord")), -1 - F.col("at")))
    final = put(final.withColumn("duplicate_of", twin))
    if not searches:
        way = F.when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("add")
        return final.select(*key, way.alias("route"), "duplicate_of", F.array().cast("array<bigint>").alias("partners"))
    final = put(_before(final, put))
    asking = final.where("NOT is_added AND duplicate_of IS NULL").select(*key, "claim", "more_n", "more_total")
    found = _partners(asking, adds.drop("norm"), near, put)
    way = F.when(F.col("duplicate_of").isNotNull(), "duplicate").when(F.col("is_added"), "add").otherwise("pair")
    none = F.array().cast("array<bigint>")
    return final.join(found, key, "left").select(*key, way.alias("route"), "duplicate_of", F.coalesce("partners", none).alias("partners"))


@dataclass
class Outcome:
    """Frames of one run: the next snapshot and what it did."""

    facts: DataFrame
    links: DataFrame
    queue: DataFrame  # project, seq, id, selected
    verdicts: DataFrame  # a row for each graded group
    done: DataFrame  # a row for each kept group: outcome, target, new_id
    candidate_answers: DataFrame
    pair_answers: DataFrame
    expired: DataFrame
    sources: DataFrame  # edges from facts to events that the run adds


def _asked(frame: DataFrame, phase, ask, judge: judges.Judge, states: DataFrame) -> DataFrame:
    return questions.checked(judge.ask(ask(frame), states), phase)


def pending_work(statements: DataFrame, put, cap: int = 50) -> tuple[DataFrame, DataFrame]:
    """(candidates of pending events, queue) of statements (project, session_id, seq, role, text, graded_at)."""
    safe = ev.with_event_ids(statements)
    closed = ev.session_closure(safe)
    pending = closed.where("graded_at IS NULL").select("project", "seq", "id")
    found = put(ev.candidates(closed.drop("id", "graded_at")).join(pending.select("project", "seq"), ["project", "seq"], "left_semi"))
    return found, put(ev.queue_selection(pending, found, cap))


def plan_run(work: tuple[DataFrame, DataFrame], facts: DataFrame, links: DataFrame, judge: judges.Judge, now: str, put, budget: int = batching.BUDGET, context: str = "{}", sources: DataFrame | None = None) -> Outcome:
    """One run over pending_work() and the facts, links and source edges (none if not given) of its projects.

    ``put`` writes and rereads a step that several others need (see Scratch).  ``context``
    is the JSON object that every request tells of the project; it counts in every batch.
    """
    found, queue = work
    chosen = queue.where("selected")
    taken = found.join(chosen.select("project", "seq"), ["project", "seq"], "left_semi")
    groups = ev.candidate_groups(taken)
    order = Window.partitionBy("project").orderBy("first_seq", "first_ordinal")
    groups = groups.withColumn("ord", F.row_number().over(order).cast("bigint"))

    # phase A: batches of candidates, three questions each
    size = batching.entry_chars(id=F.col("event_id"), role=F.col("role"), text=F.col("text"), context=F.col("context"))
    sized = groups.withColumn("chars", size + questions.question_chars(questions.PHASE_A))
    packed = put(batching.pack(put(sized), ["project"], "ord", "chars", len(context), budget, put))
    entry = F.to_json(F.struct("event_id", "role", "text", "context")).alias("entry")
    subjects = packed.select("project", "batch_no", "position", "ord", "chars", "text", F.col("event_id").alias("subject_id"), F.col("event_id").alias("subject"), entry)
    states = questions.candidate_states(packed, ["project", "batch_no"], context)
    candidate_answers = put(_asked(subjects, questions.PHASE_A, questions.candidate_questions, judge, states))
    answers = questions.by_subject(candidate_answers, ["project", "batch_no", "position"], questions.PHASE_A)
    graded = packed.join(answers, ["project", "batch_no", "position"])
    verdicts = put(gates.phase_a(graded))
    kept = verdicts.where("kept").withColumnRenamed("text", "claim")

    expired = put(lifecycle.bump_and_expire_asks(facts, now))
    facts = expired.drop("expired")
    routed = put(route(kept, facts, put))

    # phase B: pairs share one array of facts in a batch
    pairs = routed.where("route = 'pair'").select("project", "ord", F.explode("partners").alias("fact_id"))
    claims = facts.select("project", "fact_id", F.col("claim").alias("known")).unionByName(
        kept.select("project", (-1 - F.col("ord")).alias("fact_id"), F.col("claim").alias("known"))
    )
    pairs = pairs.join(claims, ["project", "fact_id"]).join(kept.select("project", "ord", "claim", "event_id"), ["project", "ord"])
    pairs = pairs.withColumns(
        {
            "claim_chars": batching.entry_chars(id=F.col("event_id"), text=F.col("claim")),
            "fact_chars": batching.entry_chars(id=F.col("fact_id").cast("string"), text=F.col("known")) + questions.question_chars(questions.PHASE_B),
        }
    )
    pairs = put(pairs)
    sizes = pairs.select("project", "ord", "claim_chars", "fact_id", "fact_chars")
    none = sizes.sparkSession.createDataFrame([], "project string, ord bigint, fact_id bigint, batch_no int, i int, j int")
    placed = none if pairs.isEmpty() else batching.pack_pairs(sizes, budget, put, len(context))
    pairs = put(pairs.join(placed, ["project", "ord", "fact_id"]))
    name = F.concat_ws(":", "project", F.col("ord").cast("string"), F.col("fact_id").cast("string"))
    subjects = pairs.select("project", "batch_no", "i", "j", "ord", "fact_id", "event_id", F.col("fact_chars").alias("chars"), F.col("claim").alias("text"), name.alias("subject"), F.to_json(F.struct("event_id", "claim", "known")).alias("entry"))
    states = questions.pair_states(pairs, ["project", "batch_no"], context)
    pair_answers = put(_asked(subjects, questions.PHASE_B, questions.pair_questions, judge, states))
    answers = questions.by_subject(pair_answers, ["project", "batch_no", "i", "j"], questions.PHASE_B)
    judged = pairs.select("project", "batch_no", "i", "j", "ord", "fact_id").join(answers, ["project", "batch_no", "i", "j"])
    action = gates.pair_action(F.col("same_claim"), F.col("contradicts"), F.col("verdict"), F.col("verdict_confidence"))
    judged = put(judged.withColumn("action", action))
    best = gates.best_pairs(judged, ["project", "ord"])
    done = kept.join(routed, ["project", "ord"]).join(best.withColumnRenamed("duplicate_of", "paired_with"), ["project", "ord"], "left")
    outcome = F.when(F.col("route") == "pair", F.col("action")).otherwise(F.col("route"))
    done = put(done.withColumn("outcome", outcome).withColumn("target", F.coalesce("duplicate_of", "paired_with")))

    # new facts are numbered after the old ones, in order
    base = facts.groupBy("project").agg(F.max("fact_id").alias("base"))
    new = done.where("outcome != 'duplicate'").join(base, "project", "left")
    number = F.coalesce("base", F.lit(0)) + F.row_number().over(Window.partitionBy("project").orderBy("ord"))
    new = put(new.withColumn("fact_id", number.cast("bigint")))
    ids = new.select("project", (-1 - F.col("ord")).alias("draft"), F.col("fact_id").alias("final"))

    def numbered(df: DataFrame, column: str) -> DataFrame:
        joined = df.join(ids.withColumnRenamed("draft", column), ["project", column], "left")
        return joined.withColumn(column, F.coalesce("final", column)).drop("final")

    status = F.when(F.col("outcome") == "ask", "ask").otherwise("active")
    rows = new.select(
        "project", "fact_id", "claim", "category", F.nullif("context", F.lit("")).alias("context"), "significance",
        fact_confidence(F.col("durable")).alias("confidence"), status.alias("status"),
        F.col("support").cast("int").alias("support_count"), F.lit(0).alias("ask_seen_count"), F.lit(now).alias("created_at"),
        F.lit(now).alias("updated_at"), F.lit(now).alias("last_supported_at"), F.lit(None).cast("string").alias("verified_at"),
        F.lit(True).alias("indexed"),
    )
    facts = facts.unionByName(rows)
    edges_of = lambda owned: ev.candidate_sources(taken).join(owned, ["project", "norm", "role"]).select("project", "fact_id", "event_id")
    own = edges_of(new.select("project", "norm", "role", "fact_id"))
    twins = numbered(done.where("outcome = 'duplicate'").select("project", "norm", "role", F.col("target").alias("fact_id")), "fact_id")
    known = own if sources is None else sources.select("project", "fact_id", "event_id").unionByName(own)
    gained = put(lifecycle.new_sources(facts, known, edges_of(twins)))
    facts = lifecycle.bump_support(facts, gained, now)
    replaced = numbered(new.where("outcome = 'supersede'").select("project", F.col("supersedes").alias("target"), "fact_id"), "target")
    replaced = replaced.select("project", F.col("target").alias("fact_id"), F.col("fact_id").alias("by_id"))
    edges = numbered(gates.conflict_edges(judged, best, ["project", "ord"]), "related_id")
    edges = edges.join(new.select("project", "ord", "fact_id"), ["project", "ord"])
    facts, links = lifecycle.supersede(facts, links, replaced, now)
    links = lifecycle.add_links(links, edges.select("project", "fact_id", "related_id", "relation"))
    done = done.join(new.select("project", "ord", F.col("fact_id").alias("new_id")), ["project", "ord"], "left")
    pair_answers = numbered(pair_answers, "fact_id").withColumn("subject_id", F.concat_ws(":", "event_id", F.col("fact_id").cast("string")))
    done = numbered(numbered(done, "target"), "supersedes")
    return Outcome(facts, links, queue, verdicts, done, candidate_answers, pair_answers, expired.where("expired").select("project", "fact_id"), own.unionByName(gained))


def distill(statements: DataFrame, facts: DataFrame, links: DataFrame, answers, pair_answers, now: str, cap: int = 50):
    """(facts, links, selected events, verdicts) after one run with a judge made of Column expressions.

    ``answers(text)`` and ``pair_answers(pair name)`` give the judge's columns.
    """
    put = Scratch(statements.sparkSession).put
    run = plan_run(pending_work(statements, put, cap), facts, links, judges.ColumnJudge(answers, pair_answers), now, put)
    return run.facts, run.links, run.queue.where("selected"), run.done


def run_stats(run: Outcome) -> DataFrame:
    """One row of a run's counts; lists of facts are bounded by the run's candidates."""
    spent = lambda answers: batching.spend(answers, ["project", "batch_no"], "chars")
    calls = spent(run.candidate_answers).unionByName(spent(run.pair_answers)).agg(F.sum("api_calls").alias("api_calls"), F.sum("usage").alias("usage"))
    graded = run.verdicts.agg(
        F.count("*").alias("candidates_graded"),
        F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"),
        F.count_if(F.col("drop_reason") == "low_durable").alias("dropped_low_durable"),
        F.count_if("near_miss").alias("near_misses"),
        F.count_if(F.col("drop_reason") == "low_significance").alias("dropped_low_significance"),
    )
    listed = lambda condition, c: F.array_sort(F.collect_list(F.when(condition, F.col(c))))
    outcome = F.col("outcome")
    kept = run.done.agg(
        F.count_if((F.col("route") == "add") & (F.col("significance") < gates.PAIRING)).alias("pair_skipped_low_significance"),
        listed(outcome != "duplicate", "new_id").alias("facts_added"),
        F.count_if(F.col("route") == "duplicate").alias("duplicates_code"),
        F.count_if((F.col("route") == "pair") & (outcome == "duplicate")).alias("duplicates_jev"),
        F.array_sort(F.array_distinct(F.collect_list(F.when(outcome == "supersede", F.col("supersedes"))))).alias("superseded"),
        listed(outcome == "ask", "new_id").alias("asks"),
    )
    events = run.queue.agg(F.count_if("selected").alias("events_graded"), F.count_if(~F.col("selected")).alias("events_deferred"))
    expired = run.expired.agg(F.array_sort(F.collect_list("fact_id")).alias("asks_expired"))
    return calls.crossJoin(events).crossJoin(graded).crossJoin(kept).crossJoin(expired)
