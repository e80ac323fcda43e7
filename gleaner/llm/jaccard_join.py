"""Near duplicates: an exact n-gram Jaccard join by T-occurrence search (DivideSkip).

A document is its set of distinct word shingles, kept as sorted 64-bit hashes.  Two
documents link when ``100 * |A and B| >= percent * |A or B|``; the result gives each
document its set size and the smallest doc_id it reaches by links.

Inverted lists are divided into short and long ones.  A shingle that recurs often
enough is *long*; which are long is kept in a bitmap of fixed size (a bit may stand
for several shingles: it only moves them to the long side, for all documents alike).
A linked pair shares ``T >= ceil(percent * n / 100)`` shingles, so it shares one of the
``n - T + 1`` shingles that come first when short lists precede long ones.  Only these are
indexed, and a long list only where a text has too few short ones.

Steps, each a Spark job over partitioned data:

1. ``survey``: doc_id, set size, class key (a hash of the set: copies collapse into
   one class), a histogram of the set with about a cell for each shingle, the set's
   first shingles, and what recurs.
2. ``lists``: (shingle, class) rows of lists with two classes or more.  Short lists
   travel packed in arrays by hash bucket, and lists of one, by far the most, end in
   the reducer; long lists stay rows, so none is ever gathered into one task.
3. Round one pairs each list's smallest class with its other members.  A list
   whose classes are all connected by then needs nothing more, which keeps a large
   group of near copies linear.  Round two takes from the other lists every pair of
   similar size that is still in different components, from short ones by a join, from
   long ones by blocks of histograms: no link is lost.  A linked pair shares several
   indexed shingles (``shared_least``), so a pair that has one in common by chance is dropped
   by its count, before any histogram is moved.
4. Pairs are tested cheaply first (sizes, histogram distance: both are safe bounds),
   then exactly: cells of one query class and at most ``CELL`` others are searched by
   DivideSkip, merging short lists and binary-probing long ones.
5. Components by contraction level by level, in written tables.

Defined edge cases: null and empty texts have an empty set and link with nothing;
a text with fewer words than a shingle is one shingle; a null doc_id is passed over
when a component has others; repeated rows are copies; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.kernels import frugal, give_back, mix, slices, text_bytes, word_hashes
from gleaner.llm.session import Tables, prepare, shuffle_partitions, written
from gleaner.llm.sketch import hash_bitmap, in_bitmap, split_by_map

WORDS, PERCENT = 5, 80
#: Recurrences within parts of about PART shingles, summed over all, that make a list long.
LONG, PART = 3, 1_000_000
#: Lists of up to so many classes are compared pair by pair, longer ones by blocks.
PAIRED = 256
#: Classes in a block, and nearest classes of each that are tried before all.
BLOCK, NEAREST = 2048, 8
#: Classes searched against one query at a time.
CELL = 128
#: Histogram cells, least and most: as many as shingles, rounded up to a power of two.
LEAST_CELLS, MOST_CELLS = 64, 4096
#: Edges of a partition that are made stars at a time.
EDGES = 200_000
#: Bytes of packed postings for one reducer.
BUCKET_BYTES = 16 << 20

_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def shingle_sets(column: pa.Array, size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = text_bytes(column)
    out: list[np.ndarray] = []
    for a, b in slices(offsets):
        h, first = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        shingles = np.zeros(0, np.uint64)
        if len(h) >= size:
            shingles = h[: len(h) - size + 1].copy()
            for j in range(1, size):
                shingles = shingles * np.uint64(_STEP) + h[j : len(h) - size + 1 + j]
            shingles = mix(shingles)
        for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
            if j - i >= size:
                out.append(np.unique(shingles[i : j - size + 1]))
            elif j > i:
                value = j - i
                for w in h[i:j].tolist():
                    value = (value * _STEP + w) & _MASK
                out.append(mix(np.array([value], np.uint64)))
            else:
                out.append(shingles[:0])
    return out


def class_key(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    total = np.array([np.add.reduce(mix(shingles ^ np.uint64(_STEP))) + np.uint64(len(shingles))], np.uint64)
    return int(mix(total).view(np.int64)[0])


def histogram(shingles: np.ndarray) -> bytes | None:
    """Counts of the set by hash cell, a byte each; None if one doesn't fit a byte."""
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (len(shingles) - 1).bit_length()))
    counts = np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (cells - 1), minlength=cells)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def histogram_distance(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Sums of differences of pairs of histograms, the finer folded to the coarser.

    Never more than the symmetric difference of the two sets.
    """
    sizes = np.array([[len(x) for x in left], [len(x) for x in right]], np.int64)
    out = np.zeros(len(left), np.int64)
    for a, b in np.unique(sizes.T, axis=0).tolist():
        rows = np.flatnonzero((sizes[0] == a) & (sizes[1] == b))
        low = min(a, b)
        for part in np.array_split(rows, 1 + (len(rows) * max(a, b) >> 22)):
            x, y = (
                np.frombuffer(b"".join([side[i] for i in part]), np.uint8).reshape(len(part), n // low, low).sum(axis=1, dtype=np.int32)
                for side, n in ((left, a), (right, b))
            )
            out[part] = np.abs(x - y).sum(axis=1)
    return out


def least_overlap(n, percent: int = PERCENT):
    """Shingles that a set of n shares with any linked set, at least."""
    return -(-percent * n // 100)


def shared_least(n, m, percent: int = PERCENT):
    """Indexed shingles that linked sets of n and m have in common, at least (columns).

    They share ``T >= percent * (n + m) / (100 + percent)``.  Of the two, the one whose indexed
    shingles end first has at most ``n - T`` that the other lacks, and the rest of its ``n - need + 1``
    come before the other's end too.
    """
    both = F.ceil(percent * (n + m) / F.lit(100 + percent))
    return both - F.ceil(percent * F.greatest(n, m) / F.lit(100)) + 1


def _marks(docs: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1), size)
            columns = [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([class_key(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([histogram(s) if len(s) else None for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "key", "cells"])

    return docs.mapInArrow(frugal(run), "doc_id bigint, n bigint, key bigint, cells binary")


def _distinct_sets(column: pa.Array, size: int) -> dict[int, np.ndarray]:
    return {class_key(s): s for s in shingle_sets(column, size) if len(s)}


def _recurring(sets) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of the sets have, and how many do."""
    value, count = np.unique(np.concatenate(list(sets)), return_counts=True)
    again = count > 1
    return value[again].view(np.int64), count[again].astype(np.int64)


def _survey(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One pass over the texts: a row of marks and ``head`` for each document (``is_doc``), and rows of
    ``again``: shingles that recur within about PART shingles, copies left out.

    A head is the set's first shingles, half as many again as ``_postings`` wants of short lists.
    """
    names = ["is_doc", "doc_id", "n", "key", "cells", "head", "again"]
    pair = pa.struct([("token", pa.int64()), ("n", pa.int64())])

    def found(sets):
        token, n = _recurring(sets)
        again = pa.ListArray.from_arrays(pa.array([0, len(token)], pa.int32()), pa.StructArray.from_arrays([pa.array(token), pa.array(n)], fields=list(pair)))
        none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([False]), *none, again], names)

    def run(batches):
        part, held = {}, 0
        for batch in batches:
            sets = shingle_sets(batch.column(1), size)
            keys = [class_key(s) if len(s) else None for s in sets]
            columns = [
                pa.array(np.ones(len(sets), bool)),
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(keys, pa.int64()),
                pa.array([histogram(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([s[: _head(len(s), percent)].tobytes() for s in sets], pa.binary()),
                pa.nulls(len(sets), pa.list_(pair)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)
            for key, s in zip(keys, sets):
                if len(s):
                    held += len(s) * (key not in part)
                    part[key] = s
            if held >= PART:
                yield found(part.values())
                part, held = {}, 0
        if part:
            yield found(part.values())

    schema = "is_doc boolean, doc_id bigint, n bigint, key bigint, cells binary, head binary, again array<struct<token:bigint,n:bigint>>"
    return docs.mapInArrow(frugal(run), schema)


def long_lists(survey: DataFrame, least: int):
    """Bitmap of shingles with long lists."""
    found = survey.where("NOT is_doc").select(F.inline("again")).groupBy("token").agg(F.sum("n").alias("n"))
    return hash_bitmap(found.where(F.col("n") >= least), F.col("token"))


def _need(n: int, percent: int) -> int:
    """Shingles of a set of n that are indexed."""
    return n - int(least_overlap(n, percent)) + 1


def _head(n: int, percent: int) -> int:
    return min(n, _need(n, percent) * 3 // 2 + 8)


def _long(is_long, sets: list[np.ndarray]) -> list[np.ndarray]:
    """Of each set, which shingles have long lists."""
    if not sets:
        return []
    return np.split(in_bitmap(is_long.value, np.concatenate(sets)), np.cumsum([len(s) for s in sets])[:-1])


def _postings(rows: DataFrame, sets_of, percent: int, is_long, buckets: int) -> DataFrame:
    """Indexed (shingle, class) pairs, packed by bucket.

    ``sets_of`` gives (key, set size, shingles) of a batch of ``rows``: whole sets, or heads, which
    are passed over if they lack some of what is indexed.

    Pairs of short lists go to a bucket by their shingle, so that a list is complete there;
    those of long lists by their class, so that no list has to be in one place.
    """

    def parted(t, k, by, is_long_part):
        place = ((by >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        t, k, place = t[order], k[order], place[order]
        ends = np.searchsorted(place, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(ends)).tolist():
            yield b, t[ends[b] : ends[b + 1]], k[ends[b] : ends[b + 1]], is_long_part

    def run(batches):
        tokens, keys, held = [], [], 0
        long_tokens, long_keys = [], []

        def out():
            rows = []
            if tokens:
                t, k = np.concatenate(tokens), np.concatenate(keys)
                rows += parted(t, k, t, False)
            if long_tokens:
                t, k = np.concatenate(long_tokens), np.concatenate(long_keys)
                rows += parted(t, k, mix(k.view(np.uint64)), True)
            columns = [
                pa.array([b for b, *_ in rows], pa.int32()),
                pa.array([t.tobytes() for _, t, *_ in rows], pa.binary()),
                pa.array([k.tobytes() for _, _, k, _ in rows], pa.binary()),
                pa.array([x for *_, x in rows], pa.bool_()),
            ]
            for x in (tokens, keys, long_tokens, long_keys):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, ["bucket", "tokens", "keys", "long"])

        for batch in batches:
            some = sets_of(batch)
            for (key, n, s), long_ in zip(some, _long(is_long, [s for _, _, s in some])):
                need = _need(n, percent)
                short = s[~long_][:need]
                if len(short) < need and len(s) < n:
                    continue  # a head that lacks some
                tokens.append(short)
                keys.append(np.full(len(short), key, np.int64))
                held += len(short)
                if len(short) < need:
                    more = s[long_][: need - len(short)]
                    long_tokens.append(more)
                    long_keys.append(np.full(len(more), key, np.int64))
                    held += len(more)
            if held > 250_000:
                yield out()
                held = 0
        if held:
            yield out()

    return rows.mapInArrow(frugal(run), "bucket int, tokens binary, keys binary, long boolean")


def _pairs_of(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (token, key) of some packets, sorted."""
    tokens = np.frombuffer(b"".join(rows["tokens"]), np.int64)
    keys = np.frombuffer(b"".join(rows["keys"]), np.int64)
    order = np.lexsort((keys, tokens))
    tokens, keys = tokens[order], keys[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])
    return tokens[new], keys[new]


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """Postings of one bucket: of short lists with two classes or more, and all of long ones."""
    tokens, keys = _pairs_of(rows[~rows["long"]])
    same = np.zeros(len(tokens), bool)
    equal = tokens[1:] == tokens[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    more = _pairs_of(rows[rows["long"]])
    give_back()
    return pd.DataFrame({"token": np.concatenate([tokens[same], more[0]]), "key": np.concatenate([keys[same], more[1]])})


def _lists(docs: DataFrame, survey: DataFrame, size: int, percent: int, is_long, buckets: int) -> DataFrame:
    """(token, key) of lists with two classes or more.

    Heads have what is indexed of nearly all sets.  The others, sets of many long lists, are made
    again from their texts (and those of a few more documents, which adds nothing new).
    """

    def heads(batch):
        key, n, head = (c.to_pylist() for c in batch.columns)
        found = {k: (k, m, np.frombuffer(h, np.uint64)) for k, m, h in zip(key, n, head)}
        return list(found.values())

    def lacking(batches):
        for batch in batches:
            n, sets = batch.column(1).to_pylist(), [np.frombuffer(h, np.uint64) for h in batch.column(2).to_pylist()]
            less = [len(s) < m and np.count_nonzero(~x) < _need(m, percent) for m, s, x in zip(n, sets, _long(is_long, sets))]
            yield batch.select(["doc_id"]).filter(pa.array(less, pa.bool_()))

    def whole(batch):
        return [(key, len(s), s) for key, s in _distinct_sets(batch.column(1), size).items()]

    known = survey.where("is_doc AND n > 0")
    packed = _postings(known.select("key", "n", "head"), heads, percent, is_long, buckets)
    rest = known.select("doc_id", "n", "head").mapInArrow(frugal(lacking), "doc_id bigint").select(F.xxhash64("doc_id").alias("place"))
    again = split_by_map(docs, F.xxhash64("doc_id"), rest)[1]
    packed = packed.unionByName(_postings(again, whole, percent, is_long, buckets))
    dealt = packed.repartition(min(buckets, 4 * shuffle_partitions(docs.sparkSession)), "bucket")
    return dealt.groupBy("bucket").applyInPandas(_shared, "token bigint, key bigint")


def divide_skip(query: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """Numbers of the sets that link with the query.

    Lists of the query's shingles over the sets are merged but for the ``L`` longest;
    what occurs ``T - L`` times or more is looked up in those by binary search.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    member = np.repeat(np.arange(len(sets)), sizes)
    values = np.concatenate(sets)
    at = np.minimum(np.searchsorted(query, values), len(query) - 1)
    inside = query[at] == values
    order = np.argsort(at[inside], kind="stable")
    at, member = at[inside][order], member[inside][order]  # lists by shingle, members ascending
    ends = np.searchsorted(at, np.arange(len(query) + 1))
    lengths = np.diff(ends)
    least = int(least_overlap(len(query), percent))
    longest = int(lengths.max(initial=0))
    skip = min(least - 1, int(least / (0.1 * np.log2(longest + 1) + 1)))
    by_length = np.argsort(lengths, kind="stable")
    short, long_ = by_length[: len(query) - skip], by_length[len(query) - skip :]
    merged = np.zeros(len(sets), np.int64)
    picked = [member[ends[j] : ends[j + 1]] for j in short.tolist()]
    if picked:
        # a stable sort of sorted runs is their merge
        run = np.sort(np.concatenate(picked), kind="stable")
        merged += np.bincount(run, minlength=len(sets))
    candidates = np.flatnonzero(merged >= least - skip)
    found = merged[candidates]
    long_ = long_[lengths[long_] > 0]
    if len(long_) and len(candidates):
        # many probes at once: the lists are one ascending run of (shingle, member)
        lists = at * len(sets) + member
        for part in np.array_split(np.sort(long_), 1 + (len(long_) * len(candidates) >> 18)):
            probes = part[:, None] * len(sets) + candidates
            place = np.minimum(np.searchsorted(lists, probes), len(lists) - 1)
            found = found + (lists[place] == probes).sum(axis=0)
    linked = 100 * found >= percent * (len(query) + sizes[candidates] - found)
    return candidates[linked].tolist()


def _near(percent: int):
    """Whether a pair's sizes and histograms allow a link; never wrong about a no."""

    @F.pandas_udf("boolean")
    def near(n: pd.Series, m: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        a, b = n.to_numpy(np.int64), m.to_numpy(np.int64)
        ok = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
        known = np.flatnonzero(ok & x.notna().to_numpy() & y.notna().to_numpy())
        if len(known):
            apart = histogram_distance([x.iat[i] for i in known], [y.iat[i] for i in known])
            # |A xor B| <= (n + m) (100 - percent) / (100 + percent)
            ok[known] = (100 + percent) * apart <= (a + b)[known] * (100 - percent)
        return pd.Series(ok)

    return near


def _sized(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs of similar sizes, with n_a and n_b."""
    sized = lambda k: classes.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"))
    alike = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return pairs.join(sized("a"), "a").join(sized("b"), "b").where(alike)


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b, n_a, n_b) of classes that link, as (a, b)."""
    tables = Tables(docs.sparkSession)
    pairs = tables.written(pairs)
    # histograms of the classes that are left
    some = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    cells = split_by_map(classes.select("key", "cells"), F.col("key"), some)[1].join(some, "key", "left_semi")
    side = lambda k: cells.select(F.col("key").alias(k), F.col("cells").alias(f"c_{k}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(_near(percent)("n_a", "n_b", "c_a", "c_b"))
    near = tables.written(near.select("a", "b"))
    tables.drop(pairs)
    rows = near.count()
    if not rows:
        return near
    wanted = near.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    # sets of the wanted classes only, from one document of each; the bitmaps may let a few more pass
    bits = hash_bitmap(wanted, F.col("key"))
    owners = split_by_map(classes.select("key", "doc_id"), F.col("key"), wanted)[1].select(F.xxhash64("doc_id").alias("place"))
    some = split_by_map(docs, F.xxhash64("doc_id"), owners)[1]

    def sets_of(batches):
        for batch in batches:
            found = _distinct_sets(batch.column(1), size)
            keys = np.fromiter(found, np.int64, len(found))
            pick = keys[in_bitmap(bits.value, keys)] if len(keys) else keys
            columns = [pa.array(pick), pa.array([found[k].tobytes() for k in pick.tolist()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "shingles"])

    sets = some.mapInArrow(frugal(sets_of), "key bigint, shingles binary").groupBy("key").agg(F.first("shingles").alias("shingles"))
    chunks = near.groupBy("a").agg(F.ceil(F.count("*") / CELL).cast("int").alias("chunks"))
    cells = near.join(chunks, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int")).select("a", "b", "chunk")
    queries = cells.select("a", F.col("a").alias("b"), "chunk").distinct()
    packs = max(1, -(-rows // 500))
    filled = cells.unionByName(queries).join(sets.withColumnRenamed("key", "b"), "b")
    filled = filled.withColumn("pack", F.pmod(F.xxhash64("a", "chunk"), F.lit(packs)).cast("int"))

    def search(pack: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (a, _), cell in pack.groupby(["a", "chunk"], sort=False):
            keys = cell["b"].to_numpy(np.int64)
            sets_ = [np.frombuffer(s, np.uint64) for s in cell["shingles"]]
            own = int(np.flatnonzero(keys == a)[0])
            rest = [i for i in range(len(keys)) if i != own]
            if rest:
                found += [(a, int(keys[rest[i]])) for i in divide_skip(sets_[own], [sets_[i] for i in rest], percent)]
        give_back()
        return pd.DataFrame({"a": [a for a, _ in found], "b": [b for _, b in found]}, dtype=np.int64)

    found = written(filled.groupBy("pack").applyInPandas(search, "a bigint, b bigint"))
    tables.drop()
    return found


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node that each reaches by the edges given)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for place in (x, y, label[x], label[y]):
            np.minimum.at(new, place, low)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _stars(seed: int):
    """A task that turns edges into stars (key, root, mark), by EDGES edges at a time.

    A star's root is the node of the least mark, a hash of the node and the seed.
    """

    def out(held):
        a, b = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b"))
        nodes = np.unique(np.concatenate([a, b]))
        marks = mix(nodes.view(np.uint64) ^ np.uint64(seed * _STEP & _MASK)).view(np.int64)
        order = np.argsort(marks, kind="stable")
        place = np.empty(len(nodes), np.int64)
        place[order] = np.arange(len(nodes))
        found, root = local_components(place[np.searchsorted(nodes, a)], place[np.searchsorted(nodes, b)])
        columns = [nodes[order[found]], nodes[order[root]], marks[order[root]]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "root", "mark"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= EDGES:
                yield out(held)
                held, n = [], 0
        if held:
            yield out(held)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(key, label): the smallest key that each node of the edges (a, b) reaches.

    Each level contracts the graph.  The edges of a partition become stars there, and a
    node takes the root of the least mark among its stars; the other roots it has are
    joined with that one by the edges of the next level.  Marks are drawn anew at each
    level, so a level leaves a constant share of the nodes at most, whatever the
    graph's shape, and a node has as many rows as there are stars with it, not
    as it has neighbours.
    """
    tables = Tables(edges.sparkSession)
    levels, rest = [], tables.written(edges.select("a", "b"))
    rows = rest.count()
    while not levels or rows:
        parts = rest.repartition(1 + rows // EDGES)  # EDGES of them each, whatever their number
        stars = parts.mapInArrow(_stars(len(levels)), "key bigint, root bigint, mark bigint")
        low = F.min(F.struct("mark", "root")).over(Window.partitionBy("key"))["root"]
        placed = tables.written(stars.select("key", "root", low.alias("low")))
        levels.append(placed.select("key", F.col("low").alias("label")).distinct())
        rest = placed.where("root != low").select(F.col("root").alias("a"), F.col("low").alias("b")).distinct()
        rows = rest.count()
    labels = levels.pop()
    while levels:
        above = labels.select(F.col("key").alias("label"), F.col("label").alias("top"))
        labels = levels.pop().join(above, "label", "left").select("key", F.coalesce("top", "label").alias("label"))
    labels = tables.written(labels)
    least = labels.groupBy("label").agg(F.min("key").alias("least"))
    out = written(labels.join(least, "label").select("key", F.col("least").alias("label")))
    tables.drop()
    return out


def _open_lists(lists: DataFrame, classes: DataFrame, labels: DataFrame, percent: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(classes with label and band, members of lists that have several components)."""
    # sizes of a linked pair are in the same band or the next
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent))).cast("int")
    label = F.coalesce("label", "key")
    known = classes.select("key", "n").join(labels, "key", "left").select("key", "n", label.alias("label"), band.alias("band"))
    placed = lists.join(known, "key")
    mixed = placed.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("length"))
    return known, tables.written(placed.join(mixed.where("low < high"), "token").drop("low", "high"))


def _more(members: DataFrame) -> DataFrame:
    """(key, more): in how many long lists a class is."""
    return members.where(F.col("length") > PAIRED).groupBy("key").agg(F.count("*").alias("more"))


def _short_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b) that short lists have, of similar sizes and different components.

    A pair stays if the short lists it shares, and the long ones it may share, are enough for a link.
    """
    short = members.where(F.col("length") <= PAIRED).drop("length").join(_more(members), "key", "left").fillna(0, ["more"])
    side = lambda k: [F.col(c).alias(c[0] + k) for c in ("key", "n", "label", "more")]
    left = short.select("token", *side("x"), F.posexplode(F.array("band", F.col("band") + 1)).alias("above", "band"))
    right = short.select("token", "band", *side("y"))
    alike = (F.col("lx") != F.col("ly")) & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
    once = (F.col("above") == 1) | (F.col("kx") < F.col("ky"))
    pairs = left.join(right, ["token", "band"]).where(alike & once)
    first = [F.first(c).alias(c) for c in ("nx", "ny", "mx", "my")]
    pairs = pairs.groupBy("kx", "ky").agg(F.count("*").alias("shared"), *first)
    pairs = pairs.where(F.col("shared") + F.least("mx", "my") >= shared_least(F.col("nx"), F.col("ny"), percent))
    turned = F.col("kx") > F.col("ky")
    n_a, n_b = F.when(turned, F.col("ny")).otherwise(F.col("nx")), F.when(turned, F.col("nx")).otherwise(F.col("ny"))
    return pairs.select(F.least("kx", "ky").alias("a"), F.greatest("kx", "ky").alias("b"), n_a.alias("n_a"), n_b.alias("n_b"))


def _block_pairs(members: DataFrame, known: DataFrame, classes: DataFrame, percent: int, nearest: int = 0) -> DataFrame:
    """Pairs of long lists whose histograms allow a link, found block by block.

    Classes that long lists connect form a family, cut by size band and hash into
    blocks.  A task has two blocks of histograms and yields only the pairs that pass,
    so no list is spelled out in pairs.  Pairs that share a short list too are left to
    ``_short_pairs``: the others need enough long lists.  With ``nearest``, each class is
    paired with so many of the block's closest ones only.
    """
    long_ = members.where(F.col("length") > PAIRED).select("token", "key")
    heads = long_.groupBy("token").agg(F.min("key").alias("a"))
    edges = long_.join(heads, "token").where("key != a").select("a", F.col("key").alias("b"))
    family = components(edges).withColumnRenamed("label", "family")
    rows = family.join(known, "key").join(_more(members), "key")
    sizes = rows.groupBy("family", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    at = lambda shift, name: sizes.select("family", (F.col("band") + shift).alias("band"), F.col("blocks").alias(name))
    rows = rows.join(at(0, "own"), ["family", "band"]).join(at(-1, "above"), ["family", "band"], "left").join(at(1, "below"), ["family", "band"], "left")
    rows = rows.withColumn("i", F.pmod(F.xxhash64("key"), F.col("own")).cast("int")).fillna(0, ["above", "below"])
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda band, i, other, j, left: F.struct(
        band.alias("p"), i.cast("int").alias("i"), other.alias("q"), j.cast("int").alias("j"), F.lit(left).alias("left")
    )
    b, i = F.col("band"), F.col("i")
    places = F.concat(
        F.transform(F.sequence(i, F.col("own") - 1), lambda j: cell(b, i, b, j, True)),
        F.transform(upto(i + 1), lambda j: cell(b, j, b, i, False)),
        F.transform(upto(F.col("above")), lambda j: cell(b, i, b + 1, j, True)),
        F.transform(upto(F.col("below")), lambda j: cell(b - 1, j, b, i, False)),
    )
    placed = rows.select("family", "key", "n", "label", "more", F.explode(places).alias("c")).select("family", "c.*", "key", "n", "label", "more")
    filled = placed.join(split_by_map(classes.select("key", "cells"), F.col("key"), family.select("key"))[1], "key")

    def near(part: pd.DataFrame) -> pd.DataFrame:
        left, right = part[part["left"]], part[~part["left"]]
        found = []
        n, label, keys, more = (right[c].to_numpy(np.int64) for c in ("n", "label", "key", "more"))
        widths = np.array([len(c) if c is not None else 0 for c in right["cells"]], np.int64)
        folded: dict = {}
        itself = part["p"].iat[0] == part["q"].iat[0] and part["i"].iat[0] == part["j"].iat[0]

        def matrix(width: int, to: int):
            if (width, to) not in folded:
                own = np.frombuffer(b"".join(right["cells"].iloc[np.flatnonzero(widths == width)]), np.uint8)
                folded[width, to] = own.reshape(-1, width // to, to).sum(axis=1, dtype=np.int16)
            return folded[width, to]

        # folded to the fewest cells first, which leaves few pairs to the finer ones
        coarse = np.zeros((len(n), LEAST_CELLS), np.int16)
        for width in np.unique(widths[widths > 0]).tolist():
            coarse[widths == width] = matrix(width, LEAST_CELLS)
        row = np.cumsum([widths == w for w in np.unique(widths)], axis=1)[np.searchsorted(np.unique(widths), widths), np.arange(len(n))] - 1 if len(n) else n
        for a in left.itertuples():
            larger = np.maximum(n, a.n)
            ok = (label != a.label) & (100 * np.minimum(n, a.n) >= percent * larger)
            ok &= np.minimum(more, a.more) > -(-percent * (n + a.n) // (100 + percent)) - least_overlap(larger, percent)
            if itself and not nearest:
                ok &= keys > a.key  # the other half of the cell has the same pairs
            if not ok.any():
                continue
            distance = np.zeros(len(n), np.int64)
            if a.cells is not None:
                mine = np.frombuffer(a.cells, np.uint8)
                use = np.flatnonzero(ok & (widths > 0))
                own = mine.reshape(-1, LEAST_CELLS).sum(axis=0, dtype=np.int16)
                apart = np.abs(coarse[use] - own).sum(axis=1, dtype=np.int64)
                far = (100 + percent) * apart > (n[use] + a.n) * (100 - percent)
                ok[use[far]] = False
                use = use[~far]
                for width in np.unique(widths[use]).tolist():
                    rows_ = use[widths[use] == width]
                    low = min(width, len(mine))
                    own = mine.reshape(-1, low).sum(axis=0, dtype=np.int16)
                    apart = np.abs(matrix(width, low)[row[rows_]] - own).sum(axis=1, dtype=np.int64)
                    distance[rows_] = apart
                    ok[rows_] = (100 + percent) * apart <= (n[rows_] + a.n) * (100 - percent)
            picked = np.flatnonzero(ok & (keys != a.key))
            if nearest and len(picked) > nearest:
                picked = picked[np.argsort(distance[picked], kind="stable")[:nearest]]
            found += [(min(a.key, k), max(a.key, k)) for k in keys[picked].tolist()]
        give_back()
        return pd.DataFrame({"a": [x for x, _ in found], "b": [y for _, y in found]}, dtype=np.int64)

    # cells are few bytes and much work, so their partitions are not put together
    dealt = filled.repartition(shuffle_partitions(members.sparkSession), "family", "p", "i", "q", "j")
    return dealt.groupBy("family", "p", "i", "q", "j").applyInPandas(near, "a bigint, b bigint")


def near_duplicates(
    df: DataFrame, text: str = "text", key: str = "doc_id", size: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    return _labelled(df, text, key, size, percent).drop("key", "label")


def _labelled(df: DataFrame, text: str, key: str, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The same with the key of the row's class and of its component, null for an empty set."""
    spark = prepare(df.sparkSession)
    docs = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    tables = Tables(spark)
    survey = tables.written(_survey(docs, size, percent))
    marks = survey.where("is_doc").select("doc_id", "n", "key", "cells")
    classes = tables.written(
        marks.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("cells").alias("cells"))
    )
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(shuffle_partitions(spark), int(total * (100 - percent) / 100 * 16 / BUCKET_BYTES) + 1)
    lists = tables.written(_lists(docs, survey, size, percent, long_lists(survey, LONG), buckets))

    heads = lists.groupBy("token").agg(F.min("key").alias("a"))
    stars = lists.join(heads, "token").where("key != a").groupBy("a", F.col("key").alias("b")).agg(F.count("*").alias("shared"))
    # a pair's other lists may have other heads, so half is enough here; round two counts exactly
    likely = 2 * F.col("shared") >= shared_least(F.col("n_a"), F.col("n_b"), percent)
    stars = tables.written(_sized(stars, classes, percent).where(likely).drop("shared"))
    first = _links(stars, classes, docs, size, percent)
    labels = components(first)

    tested, links = stars.select("a", "b"), first.select("a", "b")

    known, members = _open_lists(lists, classes, labels, percent, tables)
    pairs = tables.written(_short_pairs(members, percent).join(tested, ["a", "b"], "left_anti"))
    if members.where(F.col("length") > PAIRED).limit(1).count():
        # nearest neighbours first: they connect large groups of near copies with few pairs
        close = _block_pairs(members, known, classes, percent, NEAREST).distinct().join(tested, ["a", "b"], "left_anti")
        close = tables.written(close)
        tested = tested.unionByName(close)
        links = links.unionByName(_links(_sized(close, classes, percent), classes, docs, size, percent).select("a", "b"))
        labels = components(links)
        long_ = members.where(F.col("length") > PAIRED).select("token", "key")
        known, members = _open_lists(long_, classes, labels, percent, tables)
        end = lambda k: known.select(F.col("key").alias(k), F.col("label").alias(f"l_{k}"))
        pairs = pairs.join(end("a"), "a").join(end("b"), "b").where("l_a != l_b").drop("l_a", "l_b")
        if members.limit(1).count():
            pairs = pairs.unionByName(_sized(_block_pairs(members, known, classes, percent), classes, percent))
        pairs = pairs.distinct().join(tested, ["a", "b"], "left_anti")

    second = _links(pairs, classes, docs, size, percent)
    if second.limit(1).count():
        labels = components(links.unionByName(second.select("a", "b")))

    joined = classes.select("key", "doc_id").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = joined.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    owner = joined.join(least, "label").select("key", "label", "component_id")
    named = marks.where("n > 0").select("doc_id", F.col("n").alias("n_shingles"), "key").join(owner, "key")
    empty = marks.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "key", F.col("key").alias("label"))
    found = written(named.select("doc_id", "n_shingles", "component_id", "key", "label").unionByName(empty))
    tables.drop()
    return found


def keep_representatives(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component, that of the smallest doc_id, with all columns.

    Rows with an empty set stay.  Rows that share a doc_id are told apart by their texts: each
    is judged by its own component, and of those that repeat a doc_id and text, or a doc_id and
    component, one stays.  Rows without a doc_id stay, one of each component, unless it has a row
    with one.  Texts of rows that certainly stay are not moved (see ``split_by_map``).
    """
    verdicts = _labelled(df, text, key)
    # doc_ids that one row has are decided by themselves, all others by their rows' sets
    several = verdicts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_id"))
    gone = verdicts.where("doc_id IS NOT NULL AND doc_id != component_id").select(F.col("doc_id").alias("_id")).distinct()
    own = F.col(key).cast("bigint")
    doubtful = gone.unionByName(several).select(F.xxhash64("_id").alias("place"))
    sure, unsure = split_by_map(df, F.xxhash64(own), doubtful)
    # the input's columns travel as one, so that none of their names can clash
    row = F.struct(*[F.col(f"`{n}`") for n in df.columns]).alias("row")
    body = F.coalesce(F.col(text), F.lit("")).alias("body")
    rows = unsure.select(row, own.alias("id"), body)
    same = F.col("id").eqNullSafe(F.col("_id"))
    single = rows.join(several, same, "left_anti").join(gone, same, "left_anti").select("row.*")
    many = rows.join(several, same, "left_semi").withColumn("h", F.xxhash64("id", "body"))
    # the sets of these rows, by the hash of doc_id and text
    sets = _marks(many.select(F.col("h").alias("doc_id"), F.col("body").alias("text")), WORDS)
    sets = sets.select(F.col("doc_id").alias("h"), "key").distinct()
    component = verdicts.where("key IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "label", "component_id").distinct()
    judged = many.join(sets, "h").join(component, same & (F.col("key") == F.col("_key")), "left")
    stays = F.col("key").isNull() | F.col("id").eqNullSafe(F.col("component_id"))
    unit = F.when(F.col("key").isNull(), F.col("h")).otherwise(F.col("label"))
    one = Window.partitionBy("id", F.col("key").isNull(), unit).orderBy("h")
    kept = judged.where(stays).withColumn("_r", F.row_number().over(one)).where("_r = 1")
    return sure.unionByName(single).unionByName(kept.select("row.*"))
