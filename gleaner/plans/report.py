"""Text renderings of small, ordered results on the driver."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime

from gleaner.functions.text import LEVELS

SENTINEL = "<!-- gleaner: generated file, edits will be lost -->"
PROBLEMS = ("STALE", "WRONG", "UNSUPPORTED", "REVIEW")
STALE_DAYS = 30


class SentinelError(Exception):
    """A file to be written over was not made by render_memory()."""


@dataclass
class AuditReport:
    """Verdict rows in file order, counts by keyword, and what the run spent."""

    lines: list
    counts: dict[str, int]
    run_id: int | None = None
    api_calls: int = 0
    usage: int = 0
    evidence_facts: int = 0
    evidence_statements: int = 0

    def problem_lines(self) -> list:
        return [v for v in self.lines if v["keyword"] in PROBLEMS]


def _clip(text: str, width: int) -> str:
    text = " ".join(text.split())
    return text if len(text) <= width else text[: width - 1].rstrip() + "…"


def plural(n: int, noun: str) -> str:
    return noun if n == 1 else noun + "s"


def _day(stamp: str) -> datetime:
    return datetime.strptime(stamp, "%Y-%m-%dT%H:%M:%SZ")


def vintage(said: str, now: str | None, verified: str | None) -> str:
    """When a claim was last said, whether that is long ago, and an old audit mark."""
    at = _day(said)
    text = f"said {at:%b} {at.day}"
    if now and (_day(now) - at).days > STALE_DAYS:
        text += " · stale"
    if verified:
        mark = _day(verified)
        return f"{text} · audit mark {mark:%b} {mark.day}"
    return f"{text} · unverified"


def seen(support: int, sessions: int | None) -> str:
    if sessions is None:
        return f"seen {support} {plural(support, 'time')}"
    return f"seen in {sessions} {plural(sessions, 'session')}"


def render_memory(facts: Iterable, asks: Iterable = (), now: str | None = None) -> str:
    """The memory file: facts (rows in memory order, ``sessions`` if known) by category, then open asks."""
    out, last = [SENTINEL, "# Memory", ""], None
    for f in facts:
        f = f.asDict() if hasattr(f, "asDict") else f
        if f["category"] != last:
            last = f["category"]
            out += ["", f"## {last.title()}"] if len(out) > 3 else [f"## {last.title()}"]
        level = LEVELS[max(0, min(3, round(f["significance"])))]
        claim = f["claim"].replace("\r\n", " ").replace("\r", " ").replace("\n", " ")
        said = vintage(f["last_supported_at"] or f["created_at"], now, f["verified_at"])
        out.append(f'- "{claim}" (`{last} · {level}` · confidence {f["confidence"]:.2f} · {seen(f["support_count"], f.get("sessions"))} · {said})')
    asks = list(asks)
    if asks:
        out += ["", "## Needs a decision"]
        out += [f"- #{a['fact_id']}: {_clip(a['claim'], 200)} / {_clip(a['partner_claim'] or '-', 200)}" for a in asks]
    return "\n".join(out) + "\n"


def write_memory(path: str, text: str, force: bool = False) -> None:
    """Write the memory file; one that this engine did not make is kept unless forced."""
    import os

    if os.path.exists(path) and not force:
        with open(path, encoding="utf-8") as f:
            if SENTINEL not in f.read():
                raise SentinelError(path)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def summary(report: AuditReport) -> str:
    """One sentence on the problems, or that there are none."""
    nouns = {"STALE": "stale line", "WRONG": "wrong line", "UNSUPPORTED": "unsupported line", "REVIEW": "line to review"}
    parts = [f"{report.counts[k]} {plural(report.counts[k], noun)}" for k, noun in nouns.items() if report.counts.get(k)]
    n = len(report.lines)
    if parts:
        text = "the memory file has " + ", ".join(parts)
        text += f"; {report.counts['KEEP']} keep" if report.counts.get("KEEP") else ""
    else:
        text = f"no problem found in {n} {plural(n, 'line')}" if n else "nothing to audit"
    if report.counts.get("MATCHED"):
        text += f"; {report.counts['MATCHED']} matched a stored fact word for word, which was not judged"
    return text


def footer(report: AuditReport) -> str:
    """Where the receipts are and what the run spent."""
    parts = [
        f"receipts: run {report.run_id}" if report.run_id is not None else "receipts: no run (nothing graded)",
        f"{report.api_calls} {plural(report.api_calls, 'call')}",
        f"{report.usage} tokens",
        f"evidence: {report.evidence_facts} facts, {report.evidence_statements} statements",
    ]
    return " · ".join(parts)


def audit_terminal(report: AuditReport) -> str:
    """Only lines with a problem, in file order."""
    rows = [f"{v['number']:>5}  {v['keyword']:<11}  {_clip(v['text'], 44)}" for v in report.problem_lines()]
    return "\n".join([*rows, summary(report), footer(report)])


def audit_markdown(report: AuditReport) -> str:
    rows = [f"| {v['number']} | {v['keyword']} | {v['text'].replace('|', chr(92) + '|')} |" for v in report.lines]
    return "\n".join(["| line | verdict | claim |", "| --- | --- | --- |", *rows, "", summary(report), "", footer(report)])


def audit_json(report: AuditReport) -> str:
    lines = [{k: v[k] for k in ("number", "text", "section", "keyword", "disposition", "confidence", "anchor_fact_id")} for v in report.lines]
    run = {k: getattr(report, k) for k in ("run_id", "api_calls", "usage", "evidence_facts", "evidence_statements")}
    return json.dumps({"counts": report.counts, "lines": lines, "run": run, "summary": summary(report)}, sort_keys=True, indent=2)


def _mark(f) -> str:
    return f"audit mark {f['verified_at'][:10]}" if f["verified_at"] else "unverified"


def recall_text(facts: Iterable, width: int = 200) -> str:
    return "\n".join(f"- {_clip(f['claim'], width)} [confidence {f['confidence']:.2f} · said {f['created_at'][:10]} · {_mark(f)}]" for f in facts)


def search_text(facts: Iterable, width: int = 240) -> str:
    """A line for each fact that a search found, with category and support."""
    return "\n".join(
        f"- {_clip(f['claim'], width)} [confidence {f['confidence']:.2f} · {f['category']} · support {f['support_count']} · said {f['created_at'][:10]} · {_mark(f)}]"
        for f in facts
    )

