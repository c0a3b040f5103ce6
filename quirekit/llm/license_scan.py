"""License scans: ordered signature rules behind a keyword prefilter, overlaps settled by priority and containment.

Texts are brought to a normal form first: A-Z in lower case, words joined by
one blank. Rules are regular expressions over that form. A rule runs only where
its keyword stands. Of overlapping detections one that lies inside another of
the same or a higher priority is suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import prepare

#: Base phrases and their labels; every place counts and none is ever suppressed.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Families: label, keyword that must stand in the text, and the name as a pattern over normal form.
FAMILIES = (
    ("apache-1.1", "apache", r"apache (?:software )?licen[sc]e (?:version |v)?1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?(?:licen[sc]e )?(?:version |v)?2(?: 0)?(?: licen[sc]e)?"),
    ("mit", "mit", r"mit(?: expat| x11)? licen[sc]e"),
    ("mit-0", "mit", r"mit no attribution(?: licen[sc]e)?|mit 0 licen[sc]e"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: licen[sc]e)?"),
    ("0bsd", "bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)(?: licen[sc]e)?"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public licen[sc]e (?:version |v)1(?: 0)?"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[sc]e (?:version |v)2(?: 0)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[sc]e (?:version |v)3(?: 0)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl ?(?:version |v)?2(?: 0)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl ?(?:version |v)?3(?: 0)?"),
    ("lgpl-2.0", "general public", r"(?:gnu )?library general public licen[sc]e(?: (?:version |v)2(?: 0)?)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[sc]e (?:version |v)2 1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[sc]e (?:version |v)3(?: 0)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl ?(?:version |v)?2 1"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl ?(?:version |v)?3(?: 0)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[sc]e(?: (?:version |v)3(?: 0)?)?"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl ?(?:version |v)?3(?: 0)?"),
    ("gfdl-1.2", "documentation", r"(?:gnu )?free documentation licen[sc]e (?:version |v)1 2"),
    ("gfdl-1.3", "documentation", r"(?:gnu )?free documentation licen[sc]e(?: (?:version |v)1 3)?"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e (?:version |v)?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e(?: (?:version |v)?2(?: 0)?)?"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e (?:version |v)?1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e(?: (?:version |v)?2(?: 0)?)?"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[sc]e(?: (?:version |v)?1(?: 0)?)?"),
    ("cddl-1.0", "common development", r"common development and distribution licen[sc]e(?: (?:version |v)?1(?: 0)?)?"),
    ("cddl-1.1", "common development", r"common development and distribution licen[sc]e (?:version |v)?1 1"),
    ("cpl-1.0", "common public", r"common public licen[sc]e(?: (?:version |v)?1(?: 0)?)?"),
    ("eupl-1.1", "european union", r"european union public licen[sc]e (?:version |v)?1 1"),
    ("eupl-1.2", "european union", r"european union public licen[sc]e(?: (?:version |v)?1 2)?"),
    ("artistic-1.0", "artistic", r"artistic licen[sc]e(?: (?:version |v)?1(?: 0)?)?"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e (?:version |v)?2(?: 0)?"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("libpng", "libpng", r"libpng licen[sc]e"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e(?: (?:version |v)?1(?: 0)?)?"),
    ("busl-1.1", "business source", r"business source licen[sc]e(?: (?:version |v)?1 1)?"),
    ("sspl-1.0", "server side", r"server side public licen[sc]e(?: (?:version |v)?1(?: 0)?)?"),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e(?: (?:version |v)?2(?: 0)?)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "public licen", r"do what the fuck you want to public licen[sc]e"),
    ("psf-2.0", "python", r"python software foundation licen[sc]e(?: (?:version |v)?2(?: 0)?)?"),
    ("php-3.01", "php", r"php licen[sc]e(?: (?:version |v)?3 0?1)?"),
    ("ruby", "ruby", r"ruby licen[sc]e"),
    ("openssl", "openssl", r"openssl licen[sc]e"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[sc]e(?: (?:version |v)?1 1)?"),
    ("odbl-1.0", "open database", r"open database licen[sc]e(?: (?:version |v)?1(?: 0)?)?"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution licen[sc]e(?: (?:version |v)?1(?: 0)?)?"),
    ("pddl-1.0", "public domain dedication", r"(?:open data commons )?public domain dedication and licen[sc]e"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[sc]e(?: (?:version |v)?1(?: 0)?)?"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
    ("afl-3.0", "academic free", r"academic free licen[sc]e(?: (?:version |v)?3(?: 0)?)?"),
    ("osl-3.0", "open software", r"open software licen[sc]e(?: (?:version |v)?3(?: 0)?)?"),
    ("lppl-1.3c", "latex", r"latex project public licen[sc]e(?: (?:version |v)?1 3c?)?"),
    ("mulan-2.0", "mulan", r"mulan (?:permissive software|psl)(?: licen[sc]e)?(?: (?:version |v)?2(?: 0)?)?"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1-4] 0)?"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1-4] 0)?"),
    ("cc-by-nc", "cc by", r"cc by nc(?: [1-4] 0)?"),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1-4] 0)?"),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1-4] 0)?"),
    ("cc-by-4.0", "cc by", r"cc by 4 0"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] 0)?(?: (?:international|unported))?"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?(?: (?:international|unported))?"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s(?: [1-4] 0)?(?: (?:international|unported))?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] 0)?(?: (?:international|unported))?"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4] 0)?(?: (?:international|unported))?"),
    ("cc0-1.0", "creative commons", r"creative commons (?:zero|cc0)(?: [1-4] 0)?(?: universal)?"),
    # Bare names, without a version.
    ("apache", "apache", r"apache (?:software )?licen[sc]e"),
    ("bsd", "bsd", r"bsd(?: style| type)? licen[sc]e"),
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public licen[sc]e"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("agpl", "agpl", r"(?:gnu )?agpl"),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl"),
    ("cc-by", "cc by", r"cc by(?: [1-3] [05])?"),
    ("creative-commons", "creative commons", r"creative commons licen[sc]e"),
    # Further names.
    ("x11", "x11", r"x11 licen[sc]e"),
    ("mpl-1.0", "mozilla", r"mozilla public licen[sc]e (?:version |v)?1 0"),
    ("mpl", " mpl", r"mpl"),
    ("mpl-1.1", " mpl", r"mpl (?:version |v)?1 1"),
    ("mpl-2.0", " mpl", r"mpl ?(?:version |v)?2(?: 0)?"),
    ("eupl", "eupl", r"eupl"),
    ("eupl-1.1", "eupl", r"eupl (?:version |v)?1 1"),
    ("eupl-1.2", "eupl", r"eupl (?:version |v)?1 2"),
    ("cecill", "cecill", r"cecill(?: [bc])?(?: licen[sc]e)?"),
    ("apsl", "apple public", r"apple public source licen[sc]e"),
    ("ipl-1.0", "ibm public", r"ibm public licen[sc]e"),
    ("qpl-1.0", "q public", r"q public licen[sc]e"),
    ("zpl", "zope", r"zope public licen[sc]e"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("vim", "vim", r"vim licen[sc]e"),
    ("blueoak-1.0", "blue oak", r"blue oak model licen[sc]e"),
    ("hippocratic", "hippocratic", r"hippocratic licen[sc]e"),
    ("json", "json", r"json licen[sc]e"),
    ("ecl-2.0", "educational community", r"educational community licen[sc]e"),
    ("rpl", "reciprocal public", r"reciprocal public licen[sc]e"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by(?: [1-4] [05])?"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd(?: [1-4] [05])?"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd(?: [1-4] [05])?"),
    ("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero(?: 1 0)?"),
)

#: How a family is named: form, what stands before and after the name, priority, and how sure it is.
FORMS = (
    ("grant", r"(?:is |are )?(?:dual |re)?(?:licensed|released|distributed|published|available|provided|covered) (?:only )?(?:under|by|through) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?", r"(?: licen[sc]e)?(?: or (?:any )?later(?: version)?)?", 3, 0.95),
    ("spdx", r"spdx licen[sc]e identifier ", r"(?: only| or later)?", 3, 0.98),
    ("subject", r"(?:subject to|governed by|in accordance with|in compliance with|permitted under|pursuant to) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?", r"", 2, 0.9),
    ("notice", r"(?:copy of|text of|version of|see|read) (?:the )?", r"", 2, 0.7),
    ("name", r"", r"", 1, 0.5),
)

#: Rules outside the families: label, keyword, pattern, priority, how sure.
SINGLE = (
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 4, 0.99),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 4, 0.99),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee", 4, 0.99),
    ("zlib", "as is", r"this software is provided as is without any express or implied warranty in no event", 4, 0.95),
    ("apache-2.0", "apache", r"www apache org licenses license 2 0", 4, 0.95),
    ("gpl", "free software", r"this program is free software you can redistribute it and or modify it", 4, 0.95),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e", 4, 0.98),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain", 4, 0.99),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", 2, 0.8),
    ("proprietary", "proprietary", r"proprietary and confidential|confidential and proprietary|proprietary licen[sc]e", 2, 0.7),
    ("proprietary", "may", r"(?:may not|no part [a-z0-9 ]{0,60}may) be (?:copied|reproduced|distributed) (?:without|in any form)", 2, 0.7),
    ("copyright", "copyright", r"copyright (?:c )?(?:[12][0-9]{3})(?: [12][0-9]{3})*", 1, 0.4),
    ("apache-2.0", "applicable law", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis", 4, 0.9),
    ("mit", "permission notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 4, 0.95),
    ("bsd", "redistributions", r"redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice", 4, 0.95),
    ("bsd-3-clause", "endorse", r"neither the names? of [a-z0-9 ]{1,120}may be used to endorse or promote products derived from this software", 4, 0.9),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 4, 0.98),
    ("isc", "permission", r"permission to use copy modify and distribute this software for any purpose with or without fee", 4, 0.98),
    ("hpnd", "permission", r"permission to use copy modify (?:and distribute|distribute and sell) this software and its documentation for any purpose", 4, 0.9),
    ("postgresql", "written agreement", r"for any purpose without fee and without a written agreement is hereby granted", 4, 0.95),
    ("bsl-1.0", "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 4, 0.99),
    ("zlib", "plainly marked", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 4, 0.98),
    ("unlicense", "anyone is free", r"anyone is free to copy modify publish use compile sell or distribute this software", 4, 0.98),
    ("cc0-1.0", "waived", r"waived all copyright and related or neighbou?ring rights", 4, 0.95),
    ("gpl", "received a copy", r"you should have received a copy of the gnu general public licen[sc]e", 4, 0.95),
    ("lgpl", "received a copy", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e", 4, 0.95),
    ("agpl", "received a copy", r"you should have received a copy of the gnu affero general public licen[sc]e", 4, 0.95),
    ("gpl-2.0", "free software foundation", r"gnu general public licen[sc]e as published by the free software foundation (?:either )?version 2", 4, 0.98),
    ("gpl-3.0", "free software foundation", r"gnu general public licen[sc]e as published by the free software foundation (?:either )?version 3", 4, 0.98),
    ("lgpl-2.0", "free software foundation", r"gnu library general public licen[sc]e as published by the free software foundation (?:either )?version 2", 4, 0.98),
    ("lgpl-2.1", "free software foundation", r"gnu lesser general public licen[sc]e as published by the free software foundation (?:either )?version 2 1", 4, 0.98),
    ("lgpl-3.0", "free software foundation", r"gnu lesser general public licen[sc]e as published by the free software foundation (?:either )?version 3", 4, 0.98),
    ("agpl-3.0", "free software foundation", r"gnu affero general public licen[sc]e as published by the free software foundation (?:either )?version 3", 4, 0.98),
    ("gfdl", "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", 4, 0.98),
    ("artistic", "artistic", r"under the terms of either the gnu general public licen[sc]e or the artistic licen[sc]e", 4, 0.95),
    ("openssl", "openssl", r"this product includes software developed by the openssl project", 4, 0.95),
    ("php", "php", r"this product includes php software freely available from", 4, 0.95),
    ("json", "good not evil", r"the software shall be used for good not evil", 4, 0.98),
    ("beerware", "beer", r"as long as you retain this notice you can do whatever you want with this stuff [a-z0-9 ]{0,100}buy me a beer", 4, 0.98),
    ("proprietary", "strictly prohibited", r"unauthori[sz]ed (?:copying|use|reproduction|distribution|duplication) [a-z0-9 ]{0,80}strictly prohibited", 2, 0.7),
    ("reserved", "rights reserved", r"(?:all|some|no) rights reserved", 1, 0.6),
)


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keyword: str
    pattern: re.Pattern[str]
    priority: int
    sure: float


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in their order; of equal detections the first rule's stands."""
    found = [Rule(f"text:{label}:{i}", label, keyword, re.compile(rf"(?<= )(?:{p})(?= )"), priority, sure) for i, (label, keyword, p, priority, sure) in enumerate(SINGLE)]
    for form, before, after, priority, sure in FORMS:
        found += [Rule(f"{form}:{label}:{i}", label, keyword, re.compile(rf"(?<= )(?:{before})(?:{name}){after}(?= )"), priority, sure) for i, (label, keyword, name) in enumerate(FAMILIES)]
    return tuple(found)


@cache
def _by_keyword() -> tuple[tuple[str, tuple[Rule, ...]], ...]:
    by: dict[str, list[Rule]] = {}
    for r in rules():
        by.setdefault(r.keyword, []).append(r)
    return tuple((k, tuple(v)) for k, v in by.items())


@dataclass(frozen=True)
class Detection:
    """``first`` and ``last`` are the words, from 0, that a rule covers."""

    rule: str
    label: str
    first: int
    last: int
    priority: int
    sure: float


_TO_BLANK = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in bytes(range(256)).lower())


def normal_form(text: str | None) -> str:
    """Lower-cased words between single blanks, with one before the first and after the last."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().translate(_TO_BLANK).split()
    return (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass") if words else " "


def base_places(norm: str) -> list[tuple[int, str]]:
    """Offsets in the normal form at which base phrases stand, with their labels."""
    found = []
    for phrase, label in BASE:
        at = norm.find(needle := f" {phrase} ")
        while at >= 0:
            found.append((at, label))
            at = norm.find(needle, at + 1)
    return sorted(found)


def detect(norm: str) -> list[Detection]:
    """Detections of the rules that no other one of the same or a higher priority contains."""
    hits = []
    for keyword, own in _by_keyword():
        if keyword in norm:
            for r in own:
                hits += [(m.start(), m.end(), r) for m in r.pattern.finditer(norm)]
    # From the left, the longer first: what contains a hit has come before it.
    hits.sort(key=lambda h: (h[0], -h[1], -h[2].priority))
    reach = [0] * (1 + max((h[2].priority for h in hits), default=0))
    kept = []
    for a, b, r in hits:
        if max(reach[r.priority :]) < b:
            kept.append((a, b, r))
            reach[r.priority] = b
    first = word_positions(norm, [a for a, _, _ in kept])
    last = word_positions(norm, [b for _, b, _ in kept])
    return [Detection(r.name, r.label, i, j, r.priority, r.sure) for i, j, (_, _, r) in zip(first, last, kept, strict=True)]


def word_positions(norm: str, offsets: list[int]) -> list[int]:
    """Numbers of the words that start at or end before the offsets, which are counted in one pass."""
    at, blanks, found = 0, -1, {}
    for o in sorted(set(offsets)):
        blanks += norm.count(" ", at, o)
        at = o
        found[o] = blanks
    return [found[o] for o in offsets]


_TYPE = "struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base_labels: string, labels: string, score: double, detections: array<struct<rule: string, label: string, first: bigint, last: bigint>>>"
_SPANS = pa.list_(pa.struct([("rule", pa.string()), ("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))


def _scan(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in parts:
        rows = []
        for t in texts:
            norm = normal_form(t.as_py())
            base, found = base_places(norm), detect(norm)
            starts = word_positions(norm, [a + 1 for a, _ in base])
            names = {label for _, label in base}
            miss = 1.0
            for d in {d.label: d for d in sorted(found, key=lambda d: d.sure)}.values():
                miss *= 1 - d.sure
            score = max(1 - miss, 0.6 if base else 0.0)
            rows.append((
                norm.count(" ") - 1, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)),
                ",".join(sorted(names | {d.label for d in found})), score, [{"rule": d.rule, "label": d.label, "first": d.first, "last": d.last} for d in found],
            ))
        types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), _SPANS]
        names_ = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
        columns = zip(*rows, strict=True) if rows else [()] * len(types)
        yield pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, types, strict=True)], names_)


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    Words of the whole text count from 0. A null text counts as empty: no words,
    empty labels, null first_word and last_word, score 0. Columns of ``docs``
    of the same names are replaced. Every row comes back once.
    """
    prepare(docs.sparkSession)
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
    found = docs.withColumn("__scan", arrow_udf(_scan, _TYPE)(F.col("text").cast("string")))
    return found.withColumns({n: F.col(f"__scan.{n}") for n in names}).drop("__scan")
