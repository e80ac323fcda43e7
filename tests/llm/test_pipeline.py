"""The pipeline's stages, each against its own input, and the SQL oracles."""

import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from gleaner.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, documents):
    docs, sizes = documents, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF).cache()
        sizes.append(docs.count())
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == documents.columns, name
    assert sizes == sorted(sizes, reverse=True) and sizes[-2] == sizes[-1] > 0
    assert docs.select("doc_id").distinct().count() == sizes[-1]
    run = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert run == {r.doc_id: r.ids_sha256 for r in docs.collect()}


def test_stages_on_edges(spark, edge_documents, tmp_path):
    docs = edge_documents.select("doc_id", "text", "lang", "source", "n_chars")
    for frame in (docs, docs.limit(0)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            frame = stage(spark, frame, SF)
            if i + 1 < len(corpus_pipeline.STAGES):
                assert frame.columns == docs.columns
            frame.count()


def test_repeated_doc_ids_are_told_apart_by_their_texts(spark):
    """Doc_ids that several texts share, in every stage that drops rows."""
    from gleaner.llm import exact_dedup, jaccard_join

    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    rows = [(3, a), (5, a + " x"), (5, b), (7, c), (5, b), (9, ""), (9, None), (None, c + " y"), (None, "no id"), (None, "no id"), (3, a + " z")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = jaccard_join.keep_representatives(frame).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept)[-2:] == [(7, c), (9, "")]
    assert sorted(r.doc_id or 0 for r in kept) == [0, 3, 5, 7, 9] and {r.text for r in kept if r.doc_id == 5} == {b}
    assert {r.text for r in kept if r.doc_id is None} == {"no id"}
    kept = exact_dedup.drop_copies(frame).collect()
    texts = lambda rows: sorted({t or "" for _, t in rows})
    assert texts((r.doc_id, r.text) for r in kept) == texts(rows) and len(kept) == len(texts(rows))


def test_clashing_names_in_every_stage(spark, monkeypatch):
    from pyspark.sql import functions as F

    from gleaner.llm import decontaminate, exact_dedup, jaccard_join, license_scan, quality, url_rules

    names = ["_id", "_sha", "_chars", "repeats", "_n", "_r", "_s", "_scan", "_best", "_quality", "id", "sha", "h", "row", "_key", "body", "place", "component_id"]
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words), (2, words), (3, words + " end"), (4, "GPL v2 license"), (4, "mit license"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({n: F.lit(f"own {n}") for n in names})
    bench = spark.createDataFrame([(1, words), (2, " ".join(f"other{i}" for i in range(30)))], "item_id bigint, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    found = {
        "copies": (exact_dedup.drop_copies(frame), 5),
        "near": (jaccard_join.keep_representatives(frame), 4),
        "clean": (decontaminate.drop_contaminated(frame, bench), 3),
        "licences": (license_scan.scan_licenses(frame), 6),
        "urls": (url_rules.judge_urls(frame.withColumn("url", F.lit("http://a.org/es/x")), url_rules.CONTRACT_RULES), 6),
    }
    for name, (out, n) in found.items():
        got = out.collect()
        assert len(got) == n, name
        assert all(r[c] == f"own {c}" for r in got for c in names), name
    docs = frame.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"), *names)
    kept = corpus_pipeline.quality_stage(spark, docs, SF)
    assert kept.columns == docs.columns and all(r["_quality"] == "own _quality" for r in kept.collect())


def test_stages_equal_brute_force(spark, documents):
    """Every stage's rows against a plain reading of its own input."""
    import base64
    import hashlib

    import numpy as np
    from pyspark.sql import functions as F

    from test_duplicates import brute_components, brute_equal, brute_overlaps, near_copies

    from gleaner.llm import quality
    from gleaner.llm.labelled import held_out

    P, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    extra = [(i + 10**6, t) for i, t in near_copies(families=5)]
    added = spark.createDataFrame(extra, "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint")})
    docs = documents.unionByName(added.select(*documents.columns))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit_quality(docs, labels, ~held_out("doc_id", 5, 0))
    rows = lambda frame: [(r.doc_id, r.text) for r in frame.collect()]
    ids = lambda frame: {r.doc_id for r in frame.select("doc_id").collect()}
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality_classifier"](spark, docs, SF)
    accepted = set()
    for doc_id, text in rows(docs):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        if model.score(quality.feature_rows(raw, np.array([0, len(raw)])))[0] >= 0.3:
            accepted.add(doc_id)
    assert ids(kept) == accepted
    deduped = stages["exact_dedup"](spark, docs, SF)
    assert ids(deduped) == {i for i, v in brute_equal(rows(docs)).items() if v[2]}
    alone = stages["ngram_jaccard_join"](spark, docs, SF)
    assert ids(alone) == {i for i, (_, least) in brute_components(rows(docs)).items() if i == least}
    clean = stages["benchmark_decontamination"](spark, docs, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids(docs) - ids(clean) >= {d for d, _ in brute_overlaps(rows(docs), items)}
    lines = map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))
    ranks = {base64.b64decode(a): int(b) for a, b in lines}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = dict(rows(docs))
    for r in stages["byte_bpe"](spark, docs, SF).collect():
        assert r.ids_sha256 == hashlib.sha256(np.array(own.encode_ordinary(texts[r.doc_id] or ""), "<u4").tobytes()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    expected = con.execute(queries.ORACLE_SQL[name]).fetchdf()
    got = queries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    rows = lambda f: sorted(map(repr, f[columns].astype(object).where(f[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(expected)
