"""The source audit against plain loops; the skyband against its definition."""

import collections
import random
import re

import numpy as np
import pytest

from gleaner.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=30, top=50):
    counts, docs = collections.Counter(), collections.Counter()
    groups = collections.defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups[lang].add(source)
        docs.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
    out = set()
    for lang, sources in groups.items():
        kept = [t for (x, t), n in docs.items() if x == lang and n >= min_docs]
        v = len(kept)
        size = {s: sum(counts[lang, s, t] for t in kept) for s in sources}
        total = {t: sum(counts[lang, s, t] for s in sources) for t in kept}
        all_ = sum(total.values())
        p = {(s, t): 1 + 10**9 * (counts[lang, s, t] + 5) // (size[s] + 5 * v) for s in sources for t in kept}
        q = {t: 1 + 10**9 * (total[t] + 5) // (all_ + 5 * v) for t in kept}
        for s in sources:
            pair = [(-sum(abs(p[s, t] - p[o, t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(q[t] - p[s, t], t.encode()) for t in kept if counts[lang, s, t] and p[s, t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                out |= {(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(sorted(found)[:most])}
    return out


def rows_of(frame):
    assert frame.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(seed, n):
    """Texts whose terms lean to some sources, with ties, capitals, marks and empty groups."""
    r = random.Random(seed)
    terms = [f"{c}{d}" for c in ("alpha", "Beta", "été", "日本", "z", "ab") for d in ("", "x", "ÿ", "q", "😀", "n")]
    rows = []
    for i in range(n):
        lang, source = r.choice(["en", "fr", None, ""]), r.choice(["s1", "S2", "é", None, "t", ""])
        lean = terms[hash_of(source) :] + terms[: hash_of(source)]
        rows.append((r.choice([" ", "-", "9", "_", "\n"]).join(lean[int(r.random() ** 2 * len(lean))] for _ in range(r.randrange(0, 40))), lang, source))
    return rows + [("nothing kept here", "xx", "a"), ("", "xx", "b"), (None, "xx", None), ("only", "one", "group"), (None, "en", "wordless")]


def hash_of(source):
    return len(source or "") * 7 % 30


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string").repartition(6)


@pytest.mark.parametrize("min_docs, top", [(30, 50), (3, 4), (1, 1)])
def test_audit_equals_plain_loops(spark, min_docs, top):
    rows = made(min_docs, 700)
    assert rows_of(divergence.audit_sources(frame_of(spark, rows), min_docs=min_docs, top=top)) == brute(rows, min_docs, top)


def test_audit_of_documents(spark, documents):
    rows = [(r.text, r.lang, r.source) for r in documents.collect()]
    assert rows_of(divergence.audit_sources(documents)) == brute(rows)


def test_blocks_and_parts_change_nothing(spark, monkeypatch):
    rows = made(9, 600) + [(f"alpha beta s{i % 50} s{i % 7}", "en", f"more{i % 23}") for i in range(900)]
    for name, value in (("SOURCES", 4), ("CELLS", 64), ("BLOCK", 300)):
        monkeypatch.setattr(divergence, name, value)
    assert rows_of(divergence.audit_sources(frame_of(spark, rows), min_docs=5)) == brute(rows, 5)


def test_skyband_is_what_its_definition_says():
    r = np.random.default_rng(1)
    for k in (1, 3, 50):
        for n in (0, 1, 40, 900):
            a, total, term = r.integers(1, 30, n), r.integers(1, 60, n), r.permutation(n)
            expected = [i for i in range(n) if ((a >= a[i]) & (total <= total[i]) & (term < term[i])).sum() < k]
            assert divergence.skyband(a, total, term, k).tolist() == expected


def test_edges(spark, edge_documents):
    rows = [(r.text, r.lang, r.source) for r in edge_documents.collect()]
    assert rows_of(divergence.audit_sources(edge_documents, min_docs=1)) == brute(rows, 1)
    assert divergence.audit_sources(edge_documents.limit(0)).count() == 0
