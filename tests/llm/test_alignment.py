"""Token alignment against plain loops over both libraries' output of whole texts."""

import collections
import hashlib
import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from gleaner.llm import align  # noqa: E402
from gleaner.llm.queries import op11_token_alignment, tokenizer_path  # noqa: E402

PATHS = [tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    own = align.Aligner(*PATHS)
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1]), own._a_tokens(), own._b_tokens()


def brute(rows, libraries):
    """The contract's rows in the order given, by comparing every token with its neighbours."""
    a_lib, b_lib, a_bytes, b_bytes = libraries
    found, held = [], collections.Counter()
    for doc_id, text in rows:
        whole = b" " + (text or "").encode()
        a = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_lib.encode(text or "")
        if not text or b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
            found.append((doc_id, [], [], "", []))
            continue
        end_a, end_b = np.cumsum([len(a_bytes[i]) for i in a]).tolist(), np.cumsum([len(b_bytes[i]) for i in b]).tolist()
        links, j = [], 0
        for i, end in enumerate(end_a):
            begin = end_a[i - 1] if i else 0
            while j and end_b[j - 1] > begin:
                j -= 1
            while end_b[j] <= begin:
                j += 1
            k = j
            while k < len(b) and (end_b[k - 1] if k else 0) < end:
                links.append((a[i], b[k]))
                k += 1
            j = k - 1
        groups, i, j = [], 0, 0
        for end in sorted(set(end_a) & set(end_b)):
            x, y = end_a.index(end, i) + 1, end_b.index(end, j) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        held.update(set(links))
        found.append((doc_id, a, b, ";".join(groups), links))
    most = collections.Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [
        (
            doc_id, len(a), len(b), groups.count("|"), len(links), sum(held[p] == most[p[0]] for p in links),
            sum(held[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if a else "",
        )
        for doc_id, a, b, groups, links in found
    ]


def rows_of(frame):
    names = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


ODD = [
    None, "", " ", "  ", "a", " a", "\n", "\nfoo", "foo\n\n bar\t x ", "x" * 700, "ab " * 400 + "  end", "déjà  vu  x　y \u0085z",
    "▁mark", "mid▁dle word", "<|endoftext|> <s> </s> <unk> <0x41>", "a\x00b\x1c c\x1d\nd", "日本語 のテキスト 😀😀 test", "if (x) {\r\n\t  return;\r\n}", "é ﬁ Ａ１２",
    "don't we'll  I'M", "1234567890 12 345,678.90", "\r", "\t\t", "a \n b", "naïve—dash… “quotes”", "مرحبا بالعالم", "﻿bom", "a​b",
]


def test_digests_equal_plain_loops(spark, documents, libraries):
    r = random.Random(4)
    alphabet = ["a", "b", " ", "  ", "\n", "\r\n", "é", "▁", " ", " ", "1", "'s", "-", "Ā", "字", "🙂", "the", " of ", "\t"]
    made = ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 40))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(ODD + made)] + [(r.doc_id + 10**6, r.text) for r in documents.collect()]
    rows += [(None, "a null id"), (None, "a null id"), (5, "a"), (5, "other text of 5")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert rows_of(align.alignment_digests(frame, *PATHS)) == sorted(brute(rows, libraries), key=repr)


def test_slices_and_forgetting_change_nothing(spark, documents, libraries, monkeypatch):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    expected = sorted(brute(rows, libraries), key=repr)
    own = align.Aligner(*PATHS)
    monkeypatch.setattr(align, "PIECES", 50)
    data = np.frombuffer("".join(t or "" for _, t in rows).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len((t or "").encode()) for _, t in rows])])
    for a, b in align.slices(offsets, 5000):
        parts, first = own.pieces_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        assert len(parts) == first[-1] and own.sound[parts].all()
    assert rows_of(op11_token_alignment(spark, "/root/testdata/sf0.001")) == expected


def test_alignment_lists(spark, libraries):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string")
    digests = {d[0]: d for d in brute([(i, t) for i, t in enumerate(ODD)], libraries)}
    for r in align.align_texts(frame, *PATHS).collect():
        groups, i, j = [], 0, 0
        for x, y in zip(r.a_ends, r.b_ends):
            groups.append(",".join(map(str, r.a_ids[i:x])) + "|" + ",".join(map(str, r.b_ids[j:y])))
            i, j = x, y
        assert (i, j) == (len(r.a_ids), len(r.b_ids)) == digests[r.doc_id][1:3]
        assert (hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") == digests[r.doc_id][7]


def test_gallop_equals_search():
    r = np.random.default_rng(7)
    for _ in range(200):
        target = np.sort(r.choice(3000, r.integers(1, 200), replace=False))
        low = r.integers(0, len(target), 50)
        high = np.array([r.integers(x + 1, len(target) + 1) for x in low])
        values = r.integers(0, 3001, 50)
        got = align.gallop(values, target, r.integers(-5, 210, 50), low, high)
        assert got.tolist() == [a + int(np.searchsorted(target[a:b], v)) for v, a, b in zip(values, low, high)]


def test_edges(spark, edge_documents):
    rows = align.alignment_digests(edge_documents, *PATHS).collect()
    assert len(rows) == 8 and sorted(r.n_a for r in rows)[:2] == [0, 0]
    assert align.alignment_digests(edge_documents.limit(0), *PATHS).count() == 0
    assert align.align_texts(edge_documents.limit(0), *PATHS).count() == 0
