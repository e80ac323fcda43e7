"""URL allow/block rules: a broadcast trie with longest-match precedence.

The trie's first levels are host labels read from the right (``com``, then
``example``), so one walk meets the rules of a host and of every parent domain.
Each host node carries a second trie over path segments, also read in one walk.
A rule's last path piece may be a part of a segment (``/en/7`` fits ``/en/70``),
so the node before it keeps such pieces by length, and a segment is looked up once for
each length that occurs there.

Precedence: the fitting rule with the most characters (host plus path) wins; on
a tie the longer host, then ``block`` before ``allow``.

The rule list is broadcast only up to ``MAX_RULES`` per trie; a longer list is cut
into several tries that are applied one after another, keeping the better match, so
no executor ever holds more than one bounded trie.

Defined edge cases: a null url or one without ``://`` has an empty host and path
and fits no rule (a rule's host must be non-empty); repeated rows are judged alike;
an empty table gives an empty result; extra input columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.session import unused

MAX_RULES = 200_000

#: The rules of the corpus contract: (verdict, host, path).
CONTRACT_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

_END = 0  # key of a node's own rule; labels and segments are strings
_PART = 1  # key of a node's unfinished last segments
_PATHS = 2  # key of a host node's path trie


def build_trie(rules) -> dict:
    """Nested dictionaries over reversed host labels, then path segments."""
    trie: dict = {}
    for verdict, host, path in rules:
        if not host:
            raise ValueError("a rule needs a host")
        node = trie
        for label in reversed(host.lower().split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(_PATHS, {})
        *whole, last = path.split("/")
        for segment in whole:
            node = node.setdefault(segment, {})
        rank = (len(host) + len(path), len(host), verdict == "block")
        slot = node if last == "" else node.setdefault(_PART, {}).setdefault(len(last), {})
        key = _END if last == "" else last
        if key not in slot or slot[key][0] < rank:
            slot[key] = (rank, host + path, verdict)
    return trie


def best_rule(trie: dict, host: str, path: str):
    """(rank, rule, verdict) of the best fitting rule, or None."""
    best = None
    segments = path.split("/")
    node = trie
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        at = node.get(_PATHS)
        for i, segment in enumerate(segments):
            if at is None:
                break
            found = at.get(_END)
            if found and (best is None or found[0] > best[0]):
                best = found
            for length, parts in at.get(_PART, {}).items():
                found = parts.get(segment[:length])
                if found and (best is None or found[0] > best[0]):
                    best = found
            # a segment counts as whole only when a slash follows it
            at = at.get(segment) if i + 1 < len(segments) else None
    return best


def judge_urls(df: DataFrame, rules, url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule and verdict of each url."""
    rules, best = list(rules), unused(df, "_best")
    address = F.coalesce(F.col(url), F.lit(""))
    rest = F.regexp_extract(address, r"(?s)://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    out = df.withColumns(
        {
            "host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
            "path": path,
        }
    ).withColumn(best, F.lit(None).cast("struct<score:long,rule:string,verdict:string>"))
    for start in range(0, len(rules), MAX_RULES):
        trie = df.sparkSession.sparkContext.broadcast(build_trie(rules[start : start + MAX_RULES]))

        @F.pandas_udf("struct<score:long,rule:string,verdict:string>")
        def match(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
            found = [best_rule(trie.value, h, p) for h, p in zip(hosts, paths)]
            # one number in the order of the rank tuple
            return pd.DataFrame(
                {
                    "score": [((f[0][0] << 24) + (f[0][1] << 1) + f[0][2]) if f else -1 for f in found],
                    "rule": [f[1] if f else None for f in found],
                    "verdict": [f[2] if f else None for f in found],
                }
            )

        out = out.withColumn(best, F.greatest(best, match("host", "path")))
    return out.withColumns(
        {
            "rule": F.col(f"{best}.rule"),
            "verdict": F.coalesce(F.col(f"{best}.verdict"), F.lit(default)),
        }
    ).drop(best)
