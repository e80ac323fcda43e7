"""Token operators against the libraries that they must equal."""

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import bpe_matrix, token_store
from gleaner.llm.kernels import text_bytes
from gleaner.llm.queries import tokenizer_path

P = pytest.importorskip("public_tokenizers")
TEXTS = [
    "", None, "a", " a", "a ", "  b", "a  b\t\nc \n", "\n", "é😀 hi\n\n\n  there 123abc's don't   ", "x" * 3000, "\x00a \x00b",
    "<|endoftext|> hi", "a b c　", "“quoted” text…", "tabs\tand\x1ccontrols\x85", "\n\nstart", "word " * 500,
]


def split(flat, sizes):
    return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    lines = map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))
    ranks = {base64.b64decode(a): int(b) for a, b in lines}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_matrix_bpe_equals_tiktoken(tiktoken_encoding):
    encoder = bpe_matrix.MatrixEncoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = split(*encoder.encode(*text_bytes(pa.array(TEXTS))))
    assert got == [tiktoken_encoding.encode_ordinary(t or "") for t in TEXTS]
    assert [encoder.decode(np.array(g, np.uint32)) for g in got] == [(t or "").encode() for t in TEXTS]


def test_cache_forgets_without_changing_ids(tiktoken_encoding):
    encoder = bpe_matrix.MatrixEncoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    encoder.cache.capacity = 50
    for start in range(0, 600, 100):
        texts = [f"word{i} other{i * 7}" for i in range(start, start + 100)]
        assert split(*encoder.encode(*text_bytes(pa.array(texts)))) == [tiktoken_encoding.encode_ordinary(t) for t in texts]


MARKS = ["hello <|endoftext|> x", "a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> ", "x\n<|endoftext|>\ny", "plain <|endof", "text|> plain"]


def fresh_tokenizer(path):
    """The library as it is: no switch of the operator's own is set."""
    return pytest.importorskip("tokenizers").Tokenizer.from_file(path)


def test_library_pieces_equal_whole_texts():
    path = P.path("byte_bpe_50k.json")
    got = split(*token_store.LibraryEncoder(path).encode(*text_bytes(pa.array(TEXTS + MARKS))))
    library = fresh_tokenizer(path)
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS + MARKS]
    assert got[len(TEXTS)] == [31373, 220, 50256, 2124]


def test_store_of_marks_and_repeated_rows(spark):
    """Ids and order with added tokens in the texts, a null doc_id and a repeated one."""
    path = tokenizer_path("byte_bpe_50k.json")
    library = fresh_tokenizer(path)
    rows = [(i, t) for i, t in enumerate(MARKS)] + [(None, "no id"), (3, "again"), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(token_store.store_round_trip(frame, path, 2).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *sorted(i for i, _ in rows if i is not None)]
    want = sorted((-1 if i is None else i, zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]


def test_long_pretokens_equal_tiktoken(tiktoken_encoding):
    """Runs without white space: random letters, one letter, many alphabets; and 1 MB of it in time."""
    import time

    r = np.random.default_rng(5)
    texts = ["".join(map(chr, r.integers(97, 123, n))) for n in (255, 256, 257, 300, 5000)]
    texts += ["".join(map(chr, r.integers(0x4E00, 0x9FA0, 3000))), "ab" * 2000, "e" * 4001, "ethe" * 700 + "=" * 900]
    encoder = bpe_matrix.MatrixEncoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert split(*encoder.encode(*text_bytes(pa.array(texts)))) == [tiktoken_encoding.encode_ordinary(t) for t in texts]
    long = "".join(map(chr, r.integers(97, 123, 1 << 20)))
    began = time.process_time()
    flat, _ = encoder.encode(*text_bytes(pa.array([long])))
    assert time.process_time() - began < 60 and encoder.decode(flat).decode() == long


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 4095, 4096, 4097, 20000])
@pytest.mark.parametrize("top", [2, 300, 50257, 2**32])
def test_simple8b_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    ids[: n // 3] %= 3
    assert (token_store.unpack(token_store.pack(ids)) == ids).all()


def test_store_in_order_of_doc_id(spark, documents):
    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = fresh_tokenizer(path)
    got = {r.doc_id: r for r in token_store.store_round_trip(documents, path, 2).collect()}
    start = 0
    for row in documents.orderBy("doc_id").collect():
        ids = tokenizer.encode(row.text or "", add_special_tokens=False).ids + [2]
        own = got[row.doc_id]
        assert (own.start, own.n_tokens) == (start, len(ids))
        assert own.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_store_edges(spark, edge_documents):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = token_store.store_round_trip(edge_documents, path, 2).collect()
    assert len(rows) == 8 and sorted(r.n_tokens for r in rows)[:2] == [1, 1]
    assert sorted(r.start for r in rows)[0] == 0
    assert token_store.store_round_trip(edge_documents.limit(0), path, 2).count() == 0


def test_encode_edges(spark, edge_documents, tiktoken_encoding):
    out = bpe_matrix.encode_texts(edge_documents, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rows = out.collect()
    assert len(rows) == 8
    for r in rows:
        ids = tiktoken_encoding.encode_ordinary(r.text or "")
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe_matrix.round_trips(out).count() == 8
    assert bpe_matrix.encode_texts(edge_documents.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
