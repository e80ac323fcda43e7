"""License detection by ordered signature rules, with DataFrame functions only.

Each text is lower-cased (A-Z) and reduced to its words joined by single spaces.  A
rule is a regex over whole words, gated twice by plain substrings: the text must
have one of a few stems (one cheap pass that most texts end at), and then the
rule's own keyword.  The stems are derived from the rules, so that whatever a rule
matches has one of them.  A rule's matches are word intervals.  They are read in the order
of start, longest first; an interval inside an open one of the same or a higher
priority is suppressed, so "gnu lesser general public license version 3" does not
also count as the shorter names within it.  Base rules are never suppressed.

Everything is computed inside the row: no join, no shuffle, no Python.  The state
of the interval pass is the open intervals and the distinct labels; the list of one rule's
matches in a text is copied as it grows (8 bytes a match).

Defined edge cases: null and empty texts have no words and no labels; repeated
rows are scanned alike; an empty table gives an empty result; other columns pass
through, except that the result's own names are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.session import unused

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between the same words before A-Z are lower-cased.
GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: (label, phrase): counted in n_base; always kept.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: Before a short name with its version, so that the match covers a plain "under the gpl" too.
_U = r"(?:under (?:the )?(?:terms of (?:the )?)?)?"
#: One to twelve words, such as the name of a copyright holder.
_NAME = r"\w+" + r"(?: \w+)?" * 11
#: Between a name and its version's first digit: "2", "version 2", "v2", "v 2".
_V = r"(?: version| ver)?(?: v)? v?"
#: The same after a short name, which may be one word with it: "gplv2", "gpl 2", "gpl v2".
_S = r"(?: version| ver)?(?: v)? ?v?"

#: (label, keyword, name as a regex over words, SPDX words).
FAMILIES = (
    ("mit", "mit", r"mit(?: x11)? license", "mit"),
    ("mit-0", "mit", r"mit no attribution license", "mit 0"),
    ("x11", "x11", r"x11 license", "x11"),
    ("isc", "isc", r"isc license", "isc"),
    ("0bsd", "bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)(?: license)?", "0bsd"),
    ("bsd-1-clause", "bsd", r"(?:1 clause bsd|bsd 1 clause)(?: license)?", "bsd 1 clause"),
    ("bsd-2-clause", "bsd", r"(?:2 clause bsd|bsd 2 clause|simplified bsd|freebsd)(?: license)?", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:3 clause bsd|bsd 3 clause|new bsd|modified bsd)(?: license)?", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:4 clause bsd|bsd 4 clause|original bsd)(?: license)?", "bsd 4 clause"),
    ("apache-1.0", "apache", rf"apache(?: software)? license{_V}1 0", "apache 1 0"),
    ("apache-1.1", "apache", rf"apache(?: software)? license{_V}1 1", "apache 1 1"),
    ("apache-2.0", "apache", rf"apache(?: software)? license{_V}2(?: 0)?", "apache 2 0"),
    ("gpl-1.0", "general public", rf"(?:gnu )?general public license{_V}1(?: 0)?", "gpl 1 0"),
    ("gpl-2.0", "general public", rf"(?:gnu )?general public license{_V}2(?: 0)?", "gpl 2 0"),
    ("gpl-3.0", "general public", rf"(?:gnu )?general public license{_V}3(?: 0)?", "gpl 3 0"),
    ("lgpl-2.0", "general public", rf"(?:gnu )?library general public license{_V}2(?: 0)?", "lgpl 2 0"),
    ("lgpl-2.1", "general public", rf"(?:gnu )?lesser general public license{_V}2 1", "lgpl 2 1"),
    ("lgpl-3.0", "general public", rf"(?:gnu )?lesser general public license{_V}3(?: 0)?", "lgpl 3 0"),
    ("agpl-1.0", "general public", rf"affero general public license{_V}1(?: 0)?", "agpl 1 0"),
    ("agpl-3.0", "general public", rf"(?:gnu )?affero general public license{_V}3(?: 0)?", "agpl 3 0"),
    ("gfdl-1.1", "free documentation", rf"(?:gnu )?free documentation license{_V}1 1", "gfdl 1 1"),
    ("gfdl-1.2", "free documentation", rf"(?:gnu )?free documentation license{_V}1 2", "gfdl 1 2"),
    ("gfdl-1.3", "free documentation", rf"(?:gnu )?free documentation license{_V}1 3", "gfdl 1 3"),
    ("mpl-1.0", "mozilla", rf"mozilla public license{_V}1 0", "mpl 1 0"),
    ("mpl-1.1", "mozilla", rf"mozilla public license{_V}1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", rf"mozilla public license{_V}2(?: 0)?", "mpl 2 0"),
    ("epl-1.0", "eclipse", rf"eclipse public license{_V}1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse", rf"eclipse public license{_V}2(?: 0)?", "epl 2 0"),
    ("edl-1.0", "eclipse", rf"eclipse distribution license{_V}1(?: 0)?", "edl 1 0"),
    ("cddl-1.0", "common development", rf"common development and distribution license(?:{_V}1 0)?", "cddl 1 0"),
    ("cpl-1.0", "common public", rf"common public license{_V}1 0", "cpl 1 0"),
    ("eupl-1.1", "european union", rf"european union public license{_V}1 1", "eupl 1 1"),
    ("eupl-1.2", "european union", rf"european union public license{_V}1 2", "eupl 1 2"),
    ("artistic-1.0", "artistic", rf"artistic license{_V}1 0", "artistic 1 0"),
    ("artistic-2.0", "artistic", rf"artistic license{_V}2 0", "artistic 2 0"),
    ("bsl-1.0", "boost", rf"boost software license(?:{_V}1 0)?", "bsl 1 0"),
    ("busl-1.1", "business source", rf"business source license(?:{_V}1 1)?", "busl 1 1"),
    ("sspl-1.0", "server side", rf"server side public license(?:{_V}1)?", "sspl 1 0"),
    ("elastic-2.0", "elastic", rf"elastic license{_V}2(?: 0)?", "elastic 2 0"),
    ("zlib", "zlib", r"zlib(?: libpng)? license", "zlib"),
    ("libpng", "libpng", r"libpng license", "libpng"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense"),
    ("wtfpl", "what the", r"do what the \w+ you want to public license", "wtfpl"),
    ("psf-2.0", "license", rf"(?:python software foundation|psf) license(?:{_V}2)?", "psf 2 0"),
    ("ruby", "ruby", r"ruby license", "ruby"),
    ("php-3.01", "php", rf"php license{_V}3 0?1", "php 3 01"),
    ("perl-5", "perl", r"same terms as perl itself", "artistic 1 0 perl"),
    ("openssl", "openssl", r"openssl license", "openssl"),
    ("postgresql", "postgresql", r"postgresql license", "postgresql"),
    ("ncsa", "illinois", r"university of illinois(?: ncsa)? open source license", "ncsa"),
    ("w3c", "w3c", r"w3c software(?: notice and)? license", "w3c"),
    ("ofl-1.1", "open font", rf"(?:sil )?open font license(?:{_V}1 1)?", "ofl 1 1"),
    ("odbl-1.0", "open database", rf"open database license(?:{_V}1 0)?", "odbl 1 0"),
    ("pddl-1.0", "public domain dedication", r"public domain dedication and license", "pddl 1 0"),
    ("ms-pl", "microsoft", r"microsoft public license", "ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license", "ms rl"),
    ("afl-3.0", "academic free", rf"academic free license{_V}3 0", "afl 3 0"),
    ("osl-3.0", "open software", rf"open software license{_V}3 0", "osl 3 0"),
    ("vim", "vim", r"vim license", "vim"),
    ("curl", "curl", r"curl license", "curl"),
    ("openrail-m", "rail", r"(?:creativeml )?open ?rail m?(?: license)?", "openrail"),
) + tuple(
    (
        f"cc-{kind.replace(' ', '-')}-{version}",
        keyword,
        rf"{name}(?: {version[0]} {version[2]})(?: (?:international|unported|generic))?",
        f"cc {kind} {version[0]} {version[2]}",
    )
    for version in ("1.0", "2.0", "2.5", "3.0", "4.0")
    for kind, keyword, name in (
        ("by", "attribution", r"creative commons attribution(?: license)?"),
        ("by sa", "attribution", r"creative commons attribution share ?alike(?: license)?"),
        ("by nc", "attribution", r"creative commons attribution non ?commercial(?: license)?"),
        ("by nd", "attribution", r"creative commons attribution no ?deriv(?:ative)?s?(?: license)?"),
        ("by nc sa", "attribution", r"creative commons attribution non ?commercial share ?alike(?: license)?"),
        ("by nc nd", "attribution", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: license)?"),
    )
)

#: Phrasings that carry a family's name or SPDX words: (priority, confidence, template).
PHRASINGS = (
    (40, 1.0, r"spdx license identifier {spdx}"),
    (30, 0.95, r"(?:licensed|released|distributed|available|published|provided)(?: to you)? under (?:the )?(?:terms of (?:the )?)?{name}"),
    (20, 0.9, r"{name}"),
)

#: Rules that stand alone: (label, keyword, priority, confidence, regex).
SINGLE_RULES = (
    ("cc0-1.0", "cc0", 30, 0.95, r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-4.0", "cc by 4", 30, 0.9, r"cc by 4 0"),
    ("cc-by-3.0", "cc by 3", 30, 0.9, r"cc by 3 0"),
    ("cc-by-sa-4.0", "cc by sa", 30, 0.9, r"cc by sa 4 0"),
    ("cc-by-sa-3.0", "cc by sa", 30, 0.9, r"cc by sa 3 0"),
    ("cc-by-nc-4.0", "cc by nc", 30, 0.9, r"cc by nc 4 0"),
    ("cc-by-nc-3.0", "cc by nc", 30, 0.9, r"cc by nc 3 0"),
    ("cc-by-nd-4.0", "cc by nd", 30, 0.9, r"cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "cc by nc sa", 35, 0.9, r"cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "cc by nc nd", 35, 0.9, r"cc by nc nd 4 0"),
    ("mit", "permission", 30, 0.95, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission", 30, 0.95, r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution", 25, 0.8, r"redistribution and use in source and binary forms"),
    ("zlib", "warranty", 25, 0.8, r"this software is provided as is without any express or implied warranty"),
    ("gpl-2.0-or-later", "later", 35, 0.95, r"general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "later", 35, 0.95, r"general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0-or-later", "later", 35, 0.9, r"general public license(?: version)? 2 or(?: any)? later"),
    ("gpl-3.0-or-later", "later", 35, 0.9, r"general public license(?: version)? 3 or(?: any)? later"),
    ("lgpl", "lesser", 15, 0.7, r"(?:gnu )?lesser general public license"),
    ("agpl", "affero", 15, 0.7, r"(?:gnu )?affero general public license"),
    ("unlicense", "public domain", 30, 0.9, r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", 15, 0.6, r"(?:in|into|to) the public domain"),
    ("proprietary", "rights reserved", 10, 0.5, r"all rights reserved"),
    ("proprietary", "proprietary", 10, 0.5, r"proprietary and confidential"),
    # short names
    ("gpl-1.0", "gpl", 28, 0.9, rf"{_U}(?:gnu )?gpl{_S}1(?: 0)?"),
    ("gpl-2.0", "gpl", 28, 0.9, rf"{_U}(?:gnu )?gpl{_S}2(?: 0)?"),
    ("gpl-3.0", "gpl", 28, 0.9, rf"{_U}(?:gnu )?gpl{_S}3(?: 0)?"),
    ("gpl-2.0-only", "gpl", 33, 0.95, rf"{_U}(?:gnu )?gpl{_S}2(?: 0)? only"),
    ("gpl-3.0-only", "gpl", 33, 0.95, rf"{_U}(?:gnu )?gpl{_S}3(?: 0)? only"),
    ("gpl-2.0-or-later", "gpl", 33, 0.95, rf"{_U}(?:gnu )?gpl{_S}2(?: 0)?(?: licen(?:s|c)e)? or (?:any )?(?:later|newer)"),
    ("gpl-3.0-or-later", "gpl", 33, 0.95, rf"{_U}(?:gnu )?gpl{_S}3(?: 0)?(?: licen(?:s|c)e)? or (?:any )?(?:later|newer)"),
    ("lgpl-2.0", "lgpl", 28, 0.9, rf"{_U}(?:gnu )?lgpl{_S}2(?: 0)?"),
    ("lgpl-2.1", "lgpl", 29, 0.9, rf"{_U}(?:gnu )?lgpl{_S}2 1"),
    ("lgpl-3.0", "lgpl", 28, 0.9, rf"{_U}(?:gnu )?lgpl{_S}3(?: 0)?"),
    ("lgpl-2.1-or-later", "lgpl", 33, 0.95, rf"{_U}(?:gnu )?lgpl{_S}2 1(?: licen(?:s|c)e)? or (?:any )?(?:later|newer)"),
    ("lgpl-3.0-or-later", "lgpl", 33, 0.95, rf"{_U}(?:gnu )?lgpl{_S}3(?: 0)?(?: licen(?:s|c)e)? or (?:any )?(?:later|newer)"),
    ("agpl-3.0", "agpl", 28, 0.9, rf"{_U}(?:gnu )?agpl{_S}3(?: 0)?"),
    ("agpl-3.0-or-later", "agpl", 33, 0.95, rf"{_U}(?:gnu )?agpl{_S}3(?: 0)?(?: licen(?:s|c)e)? or (?:any )?(?:later|newer)"),
    ("gpl", "gpl", 12, 0.7, r"(?:gnu gpl|gpl licen(?:s|c)ed?|under (?:the )?(?:terms of (?:the )?)?gpl)"),
    ("lgpl", "lgpl", 12, 0.7, r"(?:gnu lgpl|lgpl licen(?:s|c)ed?|under (?:the )?(?:terms of (?:the )?)?lgpl)"),
    ("agpl", "agpl", 12, 0.7, r"(?:gnu agpl|agpl licen(?:s|c)ed?|under (?:the )?(?:terms of (?:the )?)?agpl)"),
    ("gfdl", "gfdl", 12, 0.7, rf"(?:gnu )?gfdl(?:{_S}1 (?:1|2|3))?"),
    ("apache-2.0", "apache", 28, 0.9, rf"apache{_S}2(?: 0)?(?: licen(?:s|c)ed?)?"),
    ("apache-2.0", "asl", 24, 0.8, rf"asl{_S}2(?: 0)?"),
    ("apache", "apache", 12, 0.7, r"apache licensed"),
    ("mit", "mit", 24, 0.85, r"mit(?: style| type)? licen(?:s|c)ed?"),
    ("mit", "expat", 24, 0.85, r"expat licen(?:s|c)e"),
    ("bsd", "bsd", 15, 0.7, r"bsd(?: style| type| like)? licen(?:s|c)ed?"),
    ("bsd-2-clause", "clause", 26, 0.9, r"(?:two clause bsd|bsd two clause)(?: licen(?:s|c)e)?"),
    ("bsd-3-clause", "clause", 26, 0.9, r"(?:three clause bsd|bsd three clause)(?: licen(?:s|c)e)?"),
    ("bsd-4-clause", "clause", 26, 0.9, r"(?:four clause bsd|bsd four clause)(?: licen(?:s|c)e)?"),
    ("isc", "isc", 24, 0.85, r"isc licensed"),
    ("mpl-1.1", "mpl", 28, 0.9, rf"mpl{_S}1 1"),
    ("mpl-2.0", "mpl", 28, 0.9, rf"mpl{_S}2(?: 0)?"),
    ("mpl", "mozilla", 12, 0.7, r"mozilla public licen(?:s|c)e"),
    ("epl-1.0", "epl", 28, 0.9, rf"epl{_S}1(?: 0)?"),
    ("epl-2.0", "epl", 28, 0.9, rf"epl{_S}2(?: 0)?"),
    ("epl", "eclipse", 12, 0.7, r"eclipse public licen(?:s|c)e"),
    ("cddl", "cddl", 12, 0.7, rf"cddl(?:{_S}1 (?:0|1))?"),
    ("eupl-1.2", "eupl", 28, 0.9, rf"eupl{_S}1 2"),
    ("eupl", "eupl", 12, 0.7, r"eupl"),
    ("ofl-1.1", "sil", 24, 0.8, rf"sil ofl(?:{_S}1 1)?"),
    ("artistic", "artistic", 12, 0.6, r"artistic licen(?:s|c)e"),
    ("cc", "creative commons", 8, 0.5, r"creative commons licen(?:s|c)e"),
    ("cc-by", "creative commons", 12, 0.7, r"creative commons attribution(?: licen(?:s|c)e)?"),
    ("cc0-1.0", "creative commons", 30, 0.95, r"creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?"),
    ("wtfpl", "wtfpl", 24, 0.9, r"wtfpl(?: v?2)?"),
    ("bsl-1.0", "boost", 24, 0.8, r"boost licen(?:s|c)e"),
    ("beerware", "beer", 24, 0.8, r"(?:beer ware|beerware) licen(?:s|c)e"),
    ("mulan-psl-2.0", "mulan", 28, 0.9, rf"mulan (?:psl|permissive software licen(?:s|c)e){_S}2(?: 0)?"),
    ("sleepycat", "sleepycat", 24, 0.8, r"sleepycat licen(?:s|c)e"),
    ("qpl-1.0", "q public", 24, 0.8, r"q public licen(?:s|c)e"),
    ("hippocratic", "hippocratic", 24, 0.8, r"hippocratic licen(?:s|c)e"),
    ("openrail", "openrail", 12, 0.7, r"(?:big(?:science|code) )?openrail"),
    ("llama-community", "llama", 24, 0.8, r"llama(?: 2| 3)?(?: 1| 2| 3)? community licen(?:s|c)e(?: agreement)?"),
    ("commercial", "commercial", 10, 0.5, r"commercial licen(?:s|c)e(?: agreement)?"),
    ("eula", "end user", 10, 0.6, r"end user licen(?:s|c)e agreement"),
    ("dual", "dual", 10, 0.5, r"dual licen(?:s|c)ed"),
    # sentences of licence texts and notices
    ("mit", "permission notice", 25, 0.9, r"the above copyright notice and this permission notice shall be included"),
    ("mit", "merchantability", 20, 0.7, r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("bsd", "redistributions", 25, 0.8, r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", 25, 0.8, r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the name", 28, 0.85, rf"neither the names? of {_NAME} may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials", 28, 0.9, r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "compliance", 28, 0.9, r"you may not use this file except in compliance with the licen(?:s|c)e"),
    ("apache-2.0", "applicable law", 25, 0.8, r"unless required by applicable law or agreed to in writing software distributed under the licen(?:s|c)e is distributed on an as is basis"),
    ("gpl", "free software", 22, 0.7, r"(?:is )?free software you can redistribute it and or modify it under the terms of the gnu general public licen(?:s|c)e"),
    ("lgpl", "free software", 22, 0.7, r"(?:is )?free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen(?:s|c)e"),
    ("agpl", "free software", 22, 0.7, r"(?:is )?free software you can redistribute it and or modify it under the terms of the gnu affero general public licen(?:s|c)e"),
    ("gpl", "absolutely no warranty", 15, 0.6, r"this program comes with absolutely no warranty"),
    ("mpl-2.0", "source code form", 30, 0.95, r"this source code form is subject to the terms of the mozilla public licen(?:s|c)e"),
    ("epl", "accompanying materials", 25, 0.8, r"this program and the accompanying materials are made available under the terms of the eclipse public licen(?:s|c)e"),
    ("cc0-1.0", "waived all copyright", 30, 0.9, rf"to the extent possible under law {_NAME} has waived all copyright"),
    ("isc", "permission to use", 26, 0.8, r"permission to use copy modify and distribute this software for any purpose"),
    ("unlicense", "anyone is free", 26, 0.85, r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("ofl-1.1", "font software", 28, 0.9, r"this font software is licensed under the sil open font licen(?:s|c)e"),
    ("zlib", "misrepresented", 25, 0.85, r"the origin of this software must not be misrepresented"),
    ("zlib", "plainly marked", 25, 0.85, r"altered source versions must be plainly marked as such"),
    ("bsl-1.0", "organization obtaining", 28, 0.9, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("openssl", "openssl project", 25, 0.85, r"this product includes software developed by the openssl project"),
    ("json", "not evil", 25, 0.85, r"the software shall be used for good not evil"),
    ("proprietary", "unauthorized copying", 15, 0.7, r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "confidential", 10, 0.5, r"confidential and proprietary"),
)


def signature_rules() -> list[tuple[str, str, int, float, str, bool]]:
    """All rules in order: (label, keyword, priority, confidence, regex, base)."""
    rules = [(label, phrase, 0, 0.7, phrase, True) for label, phrase in BASE]
    for label, keyword, name, spdx in FAMILIES:
        for priority, confidence, template in PHRASINGS:
            gate = "spdx" if "{spdx}" in template else keyword
            rules.append((label, gate, priority, confidence, template.format(name=name, spdx=spdx), False))
    return rules + [(*r, False) for r in SINGLE_RULES]


def rule_stem(keyword: str, pattern: str) -> str:
    """A part of a word that all matches of the rule have, or "" if only words of two letters are sure."""
    bare = pattern
    while "(" in bare:
        bare = re.sub(r"\(\?:[^()]*\)\??", "|", bare)
    if "licen" in re.sub(r"[a-z0-9 ]\?", "|", bare):
        return "licen"
    stem = max(keyword.split(), key=len)
    return stem if len(stem) > 2 else ""


def _may_match(text: Column, rules) -> Column:
    """Whether a text has the stem of any rule; for a rule without one, its keyword."""
    lowered = F.lower(text)
    stems = {(rule_stem(keyword, pattern), keyword) for _, keyword, _, _, pattern, _ in rules}
    found = F.lit(False)
    for stem in sorted({stem for stem, _ in stems if stem}):
        found = found | F.contains(lowered, F.lit(stem))
    for keyword in sorted({keyword for stem, keyword in stems if not stem}):
        found = found | F.regexp_like(lowered, F.lit(keyword.replace(" ", GAP_ANY_CASE)))
    return found


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _matching(norm: Column, rules) -> Column:
    """The rules that match the text, as structs; their regexes are literals, so each is compiled once.

    Rules of one keyword are tried together, after one look for it.
    """
    by_keyword: dict[str, list[Column]] = {}
    for label, keyword, priority, confidence, pattern, base in rules:
        # every word of a match is whole; neighbours share a space
        whole = rf"(?<= )(?:{pattern})(?= )"
        rule = F.struct(
            F.lit(label).alias("label"),
            F.lit(priority).alias("priority"),
            F.lit(confidence).alias("confidence"),
            F.lit(whole).alias("pattern"),
            F.lit(base).alias("base"),
        )
        by_keyword.setdefault(keyword, []).append(F.when(F.rlike(norm, F.lit(whole)), rule))
    none = F.lit(None).cast("array<struct<label:string,priority:int,confidence:double,pattern:string,base:boolean>>")
    groups = [F.when(F.contains(norm, F.lit(k)), F.array(*tried)).otherwise(none) for k, tried in by_keyword.items()]
    return F.filter(F.flatten(F.filter(F.array(*groups), lambda g: g.isNotNull())), lambda r: r.isNotNull())


def _intervals(norm: Column, rule: Column) -> Column:
    """Word intervals of a rule's matches, from a copy of the text with marks."""
    pieces = F.split(F.regexp_replace(norm, rule["pattern"], F.lit("\u0001$0\u0002")), "\u0001")
    start = F.struct(F.lit(-1).alias("words"), F.array().cast("array<struct<at:int,n:int>>").alias("found"))

    def step(state, piece):
        match = F.substring_index(piece, "\u0002", 1)
        is_match = F.contains(piece, F.lit("\u0002"))
        one = F.array(F.struct(state["words"].alias("at"), (_spaces(match) + 1).alias("n")))
        return F.struct(
            (state["words"] + _spaces(piece)).alias("words"),
            F.when(is_match, F.concat(state["found"], one)).otherwise(state["found"]).alias("found"),
        )

    return F.transform(
        F.aggregate(pieces, start, step)["found"],
        lambda x: F.struct(
            x["at"].alias("at"),
            (-x["n"]).alias("order"),
            (-rule["priority"]).alias("rank"),
            rule["label"].alias("label"),
            rule["confidence"].alias("confidence"),
            rule["base"].alias("base"),
        ),
    )


_EMPTY = "struct<labels:array<string>,base:array<string>,open:array<struct<stop:int,priority:int>>,n_base:bigint,first:int,last:int,score:double>"


def _resolve(found: Column) -> Column:
    """One pass over intervals by start and length: labels that are not suppressed."""

    def step(state, x):
        stop, priority = x["at"] - x["order"], -x["rank"]
        still = F.filter(state["open"], lambda o: o["stop"] > x["at"])
        hidden = ~x["base"] & F.exists(still, lambda o: (o["stop"] >= stop) & (o["priority"] >= priority))
        label = F.array(x["label"])
        return F.struct(
            F.when(hidden, state["labels"]).otherwise(F.array_union(state["labels"], label)).alias("labels"),
            F.when(x["base"], F.array_union(state["base"], label)).otherwise(state["base"]).alias("base"),
            F.when(hidden, still)
            .otherwise(F.array_union(still, F.array(F.struct(stop.alias("stop"), priority.alias("priority")))))
            .alias("open"),
            (state["n_base"] + x["base"].cast("bigint")).alias("n_base"),
            F.when(x["base"], F.coalesce(state["first"], x["at"])).otherwise(state["first"]).alias("first"),
            F.when(x["base"], x["at"]).otherwise(state["last"]).alias("last"),
            F.when(hidden, state["score"]).otherwise(F.greatest(state["score"], x["confidence"])).alias("score"),
        )

    none = F.struct(
        F.array().cast("array<string>").alias("labels"),
        F.array().cast("array<string>").alias("base"),
        F.array().cast("array<struct<stop:int,priority:int>>").alias("open"),
        F.lit(0).cast("bigint").alias("n_base"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
        F.lit(0.0).alias("score"),
    )
    return F.aggregate(F.array_sort(found), none.cast(_EMPTY), step)


def scan_licenses(df: DataFrame, text: str = "text", rules=None) -> DataFrame:
    """``df`` with n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rules = signature_rules() if rules is None else rules
    value = F.coalesce(F.col(text), F.lit(""))
    exact = F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    norm = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(exact, F.lit(f"({WORD})"), F.lit(1)), " "), F.lit(" "))

    # in an array of one text, so that the lambda computes it once
    def scan(n):
        return _resolve(F.flatten(F.transform(_matching(n, rules), lambda r: _intervals(n, r))))

    result = F.when(_may_match(value, rules), F.transform(F.array(norm), scan)[0])
    scan_ = unused(df, "_scan")
    out = df.withColumn(scan_, result)
    names = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return out.withColumns(
        {
            "n_words": F.size(F.array_remove(F.split(value, GAP_ANY_CASE), "")).cast("bigint"),
            "n_base": F.coalesce(F.col(f"{scan_}.n_base"), F.lit(0)).cast("bigint"),
            "first_word": F.col(f"{scan_}.first").cast("bigint"),
            "last_word": F.col(f"{scan_}.last").cast("bigint"),
            "base_labels": names(F.col(f"{scan_}.base")),
            "labels": names(F.col(f"{scan_}.labels")),
            "score": F.coalesce(F.col(f"{scan_}.score"), F.lit(0.0)),
        }
    ).drop(scan_)
