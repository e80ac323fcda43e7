"""Deduplication operators against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from gleaner.llm import decontaminate, exact_dedup, jaccard_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_equal(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id))
    out = {}
    for text, own in groups.items():
        keep = min(own)[1]
        for _, doc_id in own:
            out[doc_id] = (keep, len(own), doc_id == keep, hashlib.sha256(text.encode()).hexdigest())
    return out


def test_exact_dedup_equals_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.equal_texts(documents).collect()}
    expected = brute_equal(rows)
    assert got == expected
    kept = exact_dedup.drop_copies(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, v in expected.items() if v[2])


def test_exact_dedup_edges(spark, edge_documents):
    rows = exact_dedup.equal_texts(edge_documents).collect()
    assert len(rows) == 8
    empty = [r for r in rows if r.group_size == 2]
    assert sorted((r.doc_id, r.kept, r.keep_id) for r in empty) == [(1, True, 1), (2, False, 1)]
    abc = [r for r in rows if r.group_size == 3]
    assert {r.keep_id for r in abc} == {None} and sum(r.kept for r in abc) == 1
    kept = exact_dedup.drop_copies(edge_documents)
    assert kept.count() == 5 and kept.columns == edge_documents.columns
    assert exact_dedup.equal_texts(edge_documents.limit(0)).count() == 0


def test_long_copies_share_their_recipe(spark):
    r = random.Random(3)
    body = " ".join(str(r.random()) for _ in range(9000))
    frame = spark.createDataFrame([(1, body), (2, body + " "), (3, body + "x"), (4, "y" + body)], "doc_id bigint, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.equal_texts(frame).collect()}
    assert got == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1)}
    recipes = {r.doc_id: r.recipe for r in exact_dedup.recipes(frame).collect()}
    # chunks are content-defined: all but the first are shared after a shift
    assert len(set(recipes[1]) & set(recipes[4])) >= len(set(recipes[1])) - 2


def brute_components(rows, percent=80):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    lists = collections.defaultdict(list)
    for i, s in enumerate(sets):
        shared = collections.Counter(j for x in s for j in lists[x])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            lists[x].append(i)
    ids = [r[0] for r in rows]
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {ids[i]: (len(sets[i]), least[find(i)]) for i in range(len(rows))}


def near_copies(seed=5, families=12, members=14):
    """Families of edited copies whose similarities spread around the threshold."""
    r = random.Random(seed)
    rows, doc_id = [], 100
    passage = [f"shared{i}" for i in range(30)]
    for f in range(families):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice([6, 40, 90, 300]))]
        if f % 3 == 0:
            base[3:3] = passage
        for _ in range(members):
            words = list(base)
            for _ in range(r.randrange(0, max(1, len(words) // 40) + 2)):
                words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
            if r.random() < 0.2:
                words += passage
            rows.append((doc_id, " ".join(words).title() if r.random() < 0.3 else "  ".join(words)))
            doc_id += 1
    r.shuffle(rows)
    return rows


def test_jaccard_join_equals_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(i + 10**6, t) for i, t in near_copies()]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame).collect()}
    assert got == brute_components(rows)


def test_one_group_of_thousands_of_near_copies(spark):
    """5,000 copies of one text with a few words of their own each, and clean texts beside them."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(5000):
        words = list(base)
        for _ in range(r.choice((1, 2, 3))):
            words[r.randrange(120)] = f"e{r.randrange(300)}"
        rows.append((i + 10, " ".join(words)))
    rows += [(10_000 + i, " ".join(f"c{r.randrange(10**6)}" for _ in range(60))) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    got = {x.doc_id: x.component_id for x in jaccard_join.near_duplicates(frame).collect()}
    shingles = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    alone = [i for i, _ in rows if got[i] == i and i != 10]
    for i in alone[:60]:  # whoever stayed alone has no link to anyone, by brute force
        for j, other in shingles.items():
            n = len(shingles[i] & other)
            assert i == j or 100 * n < 80 * (len(shingles[i]) + len(other) - n), (i, j)
    assert all(got[10_000 + i] == 10_000 + i for i in range(200))
    for i in r.sample(range(10, 5010), 60):  # and a linked pair is in one component
        for j in range(10, 5010, 7):
            n = len(shingles[i] & shingles[j])
            if 100 * n >= 80 * (len(shingles[i]) + len(shingles[j]) - n):
                assert got[i] == got[j]


def test_rows_that_a_map_leaves_alone(spark):
    from pyspark.sql import functions as F

    from gleaner.llm.sketch import split_by_map

    frame = spark.range(2000).withColumn("_word", F.lit("kept"))
    marked = spark.range(0, 2000, 50).select(F.xxhash64("id").alias("k"))
    sure, unsure = split_by_map(frame, F.xxhash64("id"), marked)
    assert sure.columns == frame.columns and sure.count() + unsure.count() == 2000
    assert {x.id for x in unsure.collect()} >= set(range(0, 2000, 50)) and unsure.count() < 60
    assert split_by_map(frame, F.xxhash64("id"), marked.limit(0))[1].count() == 0


def test_jaccard_join_with_long_lists(spark, monkeypatch):
    """Every recurring shingle is long: short lists alone don't reach a prefix."""
    monkeypatch.setattr(jaccard_join, "LONG", 2)
    monkeypatch.setattr(jaccard_join, "CELL", 4)
    monkeypatch.setattr(jaccard_join, "PAIRED", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rows = near_copies(seed=8, families=6, members=30)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame).collect()}
    assert got == brute_components(rows)


def test_chance_shingles_make_no_pairs(spark, monkeypatch):
    """Texts of similar size with one shingle in common are no candidates, however many share it."""
    monkeypatch.setattr(jaccard_join, "LONG", 10**9)
    r = random.Random(4)
    own = lambda n: [f"v{r.randrange(10**9)}" for _ in range(n)]
    rows = [(i, " ".join(["it", "is", "of", "the", "and", *own(40)])) for i in range(60)]
    rows += [(100, rows[7][1] + " more")]
    asked, real = [], jaccard_join._links
    monkeypatch.setattr(jaccard_join, "_links", lambda pairs, *rest: (asked.append(pairs.count()), real(pairs, *rest))[1])
    blocks = []
    monkeypatch.setattr(jaccard_join, "_block_pairs", lambda *rest: blocks.append(rest))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.near_duplicates(frame).collect()}
    assert got == brute_components(rows) and got[100][1] == 7
    assert sum(asked) == 1 and not blocks


@pytest.mark.parametrize("percent", [80, 50])
def test_linked_sets_share_enough_indexed_shingles(spark, percent):
    """The bound on indexed shingles holds for random pairs, long lists last, and is reached."""
    from pyspark.sql import functions as F

    r = random.Random(percent)
    pairs = []
    for _ in range(3000):
        n = r.choice((1, 2, 3, 5, 9, 10, 11, 30))
        a = {r.randrange(10**6) for _ in range(n)}
        b = {x for x in a if r.random() < 0.93} | {r.randrange(10**6) for _ in range(r.randrange(1 + n // 6))}
        if b and 100 * len(a & b) >= percent * len(a | b):
            first = [set(sorted(s, key=lambda x: (x % 3 == 0, x))[: jaccard_join._need(len(s), percent)]) for s in (a, b)]
            pairs.append((len(a), len(b), len(first[0] & first[1])))
    least = jaccard_join.shared_least(F.col("n"), F.col("m"), percent)
    spare = [x.spare for x in spark.createDataFrame(pairs, "n long, m long, shared long").select((F.col("shared") - least).alias("spare")).collect()]
    assert len(spare) > 1000 and min(spare) == 0


def test_texts_are_read_once_but_for_sets_of_long_lists(spark, monkeypatch):
    """Heads give the postings; sets whose heads lack short lists are made again, and no list changes."""
    from pyspark.sql import functions as F

    rows = [*near_copies(seed=5, families=5, members=25), *((10**7 + i, " ".join(f"u{i}x{j}" for j in range(60))) for i in range(300))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    jaccard_join.prepare(spark)
    survey = jaccard_join.written(jaccard_join._survey(docs, 5, 80))
    again = {}
    real = jaccard_join.split_by_map
    monkeypatch.setattr(jaccard_join, "split_by_map", lambda *a: again.setdefault("docs", real(*a)))
    lists = jaccard_join._lists(docs, survey, 5, 80, jaccard_join.long_lists(survey, 2), 4)
    got = {(r.token, r.key) for r in lists.collect()}
    assert 0 < again["docs"][1].count() < 200
    # all sets made from the texts
    bare = survey.withColumn("head", F.when(F.col("n") < 0, F.col("head")).otherwise(F.lit(b"")))
    monkeypatch.setattr(jaccard_join, "split_by_map", lambda df, *a: (df.limit(0), df))
    whole = jaccard_join._lists(docs, bare, 5, 80, jaccard_join.long_lists(survey, 2), 4)
    assert got == {(r.token, r.key) for r in whole.collect()}


def test_jaccard_join_edges(spark, edge_documents):
    rows = jaccard_join.near_duplicates(edge_documents).collect()
    assert len(rows) == 8
    assert sorted((r.doc_id, r.component_id) for r in rows if r.n_shingles == 0) == [(1, 1), (2, 2)]
    assert {r.component_id for r in rows if r.doc_id in (3, None)} == {3}
    kept = jaccard_join.keep_representatives(edge_documents)
    assert kept.columns == edge_documents.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()).count(3) == 1
    assert jaccard_join.near_duplicates(edge_documents.limit(0)).count() == 0


def test_divide_skip_equals_counting():
    r = np.random.default_rng(1)
    for _ in range(50):
        base = np.unique(r.integers(0, 400, 80).astype(np.uint64))
        sets = []
        for _ in range(r.integers(1, 30)):
            keep = base[r.random(len(base)) < r.choice([0.5, 0.85, 0.95])]
            sets.append(np.unique(np.concatenate([keep, r.integers(400, 500, r.integers(1, 9)).astype(np.uint64)])))
        expected = []
        for i, s in enumerate(sets):
            n = len(np.intersect1d(base, s))
            if 100 * n >= 80 * (len(base) + len(s) - n):
                expected.append(i)
        assert jaccard_join.divide_skip(base, sets) == expected


def test_histogram_distance_is_a_lower_bound():
    r = np.random.default_rng(2)
    for _ in range(100):
        a, b = (np.unique(r.integers(0, 2**63, r.integers(1, 3000)).astype(np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([a[: len(a) // 2], b]))
        apart = jaccard_join.histogram_distance([jaccard_join.histogram(a)], [jaccard_join.histogram(b)])[0]
        assert apart <= len(np.setxor1d(a, b))


def brute_overlaps(rows, items):
    """Documents that hold a whole item, allowing every sixth word to differ."""
    token = lambda t: re.findall(r"[a-z0-9'\x80-\U0010ffff]+", (t or "").translate(LOWER))
    out = set()
    for doc_id, text in rows:
        w = token(text)
        for item_id, item in items:
            v = token(item)
            for i in range(len(w) - len(v) + 1):
                if sum(a != b for a, b in zip(v, w[i : i + len(v)])) <= len(v) // 6:
                    out.add((doc_id, item_id))
    return out


def test_decontamination_finds_whole_and_edited_passages(spark, documents):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    r = random.Random(4)
    for i, (_, text) in enumerate(items):
        words = text.split()
        words[len(words) // 2] = "substituted"
        rows.append((50_000 + i, f"before it. {' '.join(words)} and after {r.random()}"))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(frame, benchmark).collect()}
    assert brute_overlaps(rows, items) <= found
    assert {50_000 + i for i in range(len(items))} <= {d for d, _ in found}
    clean = {d for d, _ in rows} - {d for d, _ in found}
    kept = decontaminate.drop_contaminated(frame, benchmark)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == clean


def test_decontamination_in_blocks(spark, documents, monkeypatch):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one = decontaminate.contaminated_pairs(documents, benchmark).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    assert sorted(decontaminate.contaminated_pairs(documents, benchmark).collect()) == sorted(one)
    kept = {r.doc_id for r in decontaminate.drop_contaminated(documents, benchmark).collect()}
    assert kept == {r.doc_id for r in documents.select("doc_id").collect()} - {r.doc_id for r in one}


def test_decontamination_edges(spark, edge_documents):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six"), (4, "too short")], "item_id bigint, text string")
    found = decontaminate.contaminated_pairs(edge_documents, benchmark).collect()
    assert [(r.doc_id, r.item_id, r.n_words) for r in found] == [(5, 3, 6)]
    assert decontaminate.contaminated_pairs(edge_documents, benchmark.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(edge_documents, benchmark).count() == 7
    assert decontaminate.drop_contaminated(edge_documents.limit(0), benchmark).count() == 0


@pytest.mark.parametrize("partitions", [1, 6])
def test_components_equal_union_find(spark, monkeypatch, partitions):
    """A path, many small components and an edge of a node with itself."""
    monkeypatch.setattr(jaccard_join, "EDGES", 50)
    r = random.Random(partitions)
    path = r.sample(range(-200, 200), 300)
    edges = [*zip(path, path[1:]), *((r.randrange(1000, 1300), r.randrange(1000, 1300)) for _ in range(150)), (5000, 5000)]
    least = {}
    for a, b in edges:
        least.setdefault(a, a), least.setdefault(b, b)
    for _ in least:
        before = dict(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    frame = spark.createDataFrame(edges, "a bigint, b bigint").repartition(partitions)
    assert {row.key: row.label for row in jaccard_join.components(frame).collect()} == least
    empty = spark.createDataFrame([], "a bigint, b bigint")
    assert jaccard_join.components(empty).count() == 0


def test_components_with_stars_that_differ_by_evaluation(spark, monkeypatch):
    """Each evaluation cuts the edges AX, XK, KZ at a random place, as remote shuffle blocks may."""

    def stars(batches):
        import os

        import pyarrow as pa

        from gleaner.llm.jaccard_join import local_components

        paths = {}
        for batch in batches:
            for a, b in zip(*(batch.column(c).to_pylist() for c in ("a", "b"))):
                paths.setdefault(a // 10, []).append((a, b))
        for own in paths.values():
            edges = np.array(sorted(own, key=lambda e: (max(e) % 10 == 3, min(e) % 10 != 0)))
            cut = 1 + os.urandom(1)[0] % 2
            for part in (edges[:cut], edges[cut:]):
                if len(part):
                    nodes, root = local_components(part[:, 0], part[:, 1])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (nodes, root, root)], ["key", "root", "mark"])

    monkeypatch.setattr(jaccard_join, "_stars", lambda seed: stars)
    edges = [(10 * c + a, 10 * c + b) for c in range(200) for a, b in ((0, 2), (2, 1), (1, 3))]
    frame = spark.createDataFrame(edges, "a bigint, b bigint").coalesce(1)
    found = {row.key: row.label for row in jaccard_join.components(frame).collect()}
    assert found == {10 * c + i: 10 * c for c in range(200) for i in range(4)}


def test_best_window_equals_all_windows():
    r = random.Random(13)
    for _ in range(3000):
        equal = np.array([r.random() < r.choice((0.7, 0.9)) for _ in range(r.randrange(0, 30))], bool)
        least = r.randrange(1, 14)
        good = [int(equal[i:j].sum()) for i in range(len(equal)) for j in range(i + least, len(equal) + 1) if 5 * equal[i:j].sum() >= 4 * (j - i)]
        window = decontaminate.best_window(equal, least)
        assert (window is None) == (not good)
        if good:
            i, j = window
            assert j - i >= least and 5 * equal[i:j].sum() >= 4 * (j - i) and equal[i:j].sum() == max(good)


@pytest.mark.parametrize("n,edits", [(20, 4), (15, 3), (15, 2), (13, 2), (13, 1), (12, 2), (10, 2), (10, 1), (8, 1), (5, 1), (3, 0), (1, 0)])
def test_edited_whole_items(n, edits):
    """All placements of substitutions inside the tolerance are found."""
    import itertools

    words = [f"word{i}" for i in range(n)]
    index = decontaminate.SeedIndex([1], [" ".join(words)])
    for places in itertools.combinations(range(n), edits):
        text = "before it " + " ".join("other" if i in places else w for i, w in enumerate(words)) + " after it"
        data = np.frombuffer(text.encode(), np.uint8)
        hits = index.overlaps(data, np.array([0, len(data)], np.int64))
        assert any(size >= min(n, 13) and 5 * equal >= 4 * size for *_, size, equal in hits), places


def test_masks_hit_every_good_window():
    """For 13 to 25 words; of a longer good window one half is good and has 13 words too."""
    import itertools

    masks = [int(m, 2) << s for m in decontaminate.MASKS for s in range(26 - len(m))]
    for n in range(13, 26):
        inside = [m for m in masks if m < 1 << n]
        for places in itertools.combinations(range(n), n // 5):
            bad = sum(1 << i for i in places)
            assert any(not m & bad for m in inside), (n, places)
