"""A PySpark engine for conversation memory; the public names below are loaded when they are used."""

from importlib import import_module

_NAMES = {
    "gleaner.plans.engine": "Engine GradingNotEnabledError",
    "gleaner.plans.store": "Store SchemaVersionError default_home store_path",
    "gleaner.plans.report": "AuditReport SentinelError render_memory write_memory audit_terminal audit_markdown audit_json recall_text search_text summary",
    "gleaner.plans.distill": "distill plan_run route",
    "gleaner.operators.judges": "Judge ColumnJudge ScriptedJudge IdealJudge normal_judge adversarial_judge planted_judge answer_errors",
    "gleaner.operators.questions": "candidate_questions pair_questions line_questions",
    "gleaner.operators.batching": "pack pack_pairs json_chars",
    "gleaner.operators.retrieval": "bm25_topk retrieve_similar oldest_equal",
    "gleaner.functions.redaction": "redact redaction_count",
    "gleaner.functions.chunking": "chunks",
    "gleaner.functions.text": "event_id claim_hash claim_norm claim_tokens jaccard",
    "gleaner.sources.memory_file": "memory_lines",
    "gleaner.sources.transcripts": "claude_statements codex_statements droid_statements parse_lines read_lines discover detect_source file_meta",
    "gleaner.streaming.ingest": "ingest_stream retry_failed",
}
_HOME = {name: module for module, names in _NAMES.items() for name in names.split()}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name in _HOME:
        return getattr(import_module(_HOME[name]), name)
    raise AttributeError(name)
