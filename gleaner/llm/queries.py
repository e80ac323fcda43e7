"""The corpus operators over the driver's tables, a query for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import align, bpe_matrix, decontaminate, divergence, exact_dedup, html_extract, jaccard_join, license_scan, mixture, quality, token_store, toxicity, url_rules
from gleaner.llm.labelled import held_out
from gleaner.llm.session import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_extract.extract_pages(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple-8b files of all documents' ids, read back."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_store.store_round_trip(documents, tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of benchmark items: the best overlap of each pair."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated_pairs(documents, _table(spark, sf_dir, "benchmark"))


def _classified(scored: DataFrame, modulus: int, remainder: int) -> DataFrame:
    return scored.select(
        "doc_id",
        held_out("doc_id", modulus, remainder).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op3_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NB-SVM quality scores of all documents, learned outside the held-out rows."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(documents, _table(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0))
    return _classified(quality.score_texts(documents, model), 5, 0)


def op7_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convolutional toxicity scores of all documents, learned outside the held-out rows."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(documents, _table(spark, sf_dir, "labels"), ~held_out("doc_id", 4, 2))
    return _classified(toxicity.score_toxicity(documents, model), 4, 2)


def op5_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature rules over all documents."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licenses(documents).drop("text")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrix BPE ids of all documents, hashed, and decoded again."""
    from public_tokenizers import PATTERN

    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe_matrix.encode_texts(documents, tokenizer_path("byte_bpe_50k.tiktoken"), PATTERN, ids=False)
    return out.drop("text")


def op8_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents."""
    return exact_dedup.equal_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"))


_OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def op9_divide_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components among all documents."""
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's allow and block rules over all pages."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, url_rules.CONTRACT_RULES).drop("url")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE against sentencepiece tokens of all documents, with corpus-wide pair counts."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return align.alignment_digests(documents, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_dominance_skyband(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language of all documents, and the terms they overuse."""
    return divergence.audit_sources(_table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix with source weights 1, 2, 3 takes of all documents."""
    return mixture.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("copies")


_OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), e AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id != b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), r AS (
  SELECT x AS doc_id, y AS reached FROM e
  UNION
  SELECT r.doc_id, e.y FROM r JOIN e ON r.reached = e.x
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.reached), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id
"""

_OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(regexp_extract(url, '(?s)://(.*)$', 1), '') AS rest FROM pages
), u AS (
  SELECT page_id,
         translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), r(verdict, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
)
SELECT u.page_id, u.host, u.path, arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule,
       coalesce(arg_max(r.verdict, length(r.rhost || r.rpath)), 'allow') AS verdict
FROM u LEFT JOIN r ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath)
GROUP BY ALL
"""

_OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), t AS (
  SELECT lang, source, r, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL
), k AS (
  SELECT lang, term, sum(n)::HUGEINT AS total FROM c GROUP BY ALL HAVING sum(docs) >= 30
), v AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS size FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), x AS (
  SELECT c.lang, c.source, c.term, c.n FROM c JOIN k USING (lang, term)
), s AS (
  SELECT g.lang, g.source, coalesce(sum(x.n), 0)::HUGEINT AS size FROM g LEFT JOIN x USING (lang, source) GROUP BY ALL
), p AS (
  SELECT s.lang, s.source, k.term, coalesce(x.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(x.n, 0) + 5)) // (s.size + 5 * v.v) AS p,
         1 + (1000000000::HUGEINT * (k.total + 5)) // (v.size + 5 * v.v) AS q
  FROM s JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN x ON x.lang = s.lang AND x.source = s.source AND x.term = k.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r
)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50
"""

QUERIES = {
    "op1_host_suffix_array": op1_host_suffix_array,
    "op2_token_ids": op2_token_ids,
    "op3_quality_nbsvm": op3_quality_nbsvm,
    "op4_spaced_seeds": op4_spaced_seeds,
    "op7_toxicity_cnn": op7_toxicity_cnn,
    "op5_license_signatures": op5_license_signatures,
    "op6_byte_bpe": op6_byte_bpe,
    "op8_chunk_recipes": op8_chunk_recipes,
    "op9_divide_skip": op9_divide_skip,
    "op10_url_verdicts": op10_url_verdicts,
    "op11_token_alignment": op11_token_alignment,
    "op12_dominance_skyband": op12_dominance_skyband,
    "op13_entropy_mix": op13_entropy_mix,
}

ORACLE_SQL = {
    "op8_chunk_recipes": _OP8_SQL,
    "op9_divide_skip": _OP9_SQL,
    "op10_url_verdicts": _OP10_SQL,
    "op12_dominance_skyband": _OP12_SQL,
}
