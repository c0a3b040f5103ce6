"""License rules against examples of their own patterns."""

from itertools import chain
from re import _constants as C
from re import _parser

import pytest

from quirekit.llm import license_scan
from quirekit.llm.license_scan import detect, normal_form


def _examples(tree):
    """Matches of a parsed pattern, at least one for each alternative, option and number of repeats."""
    parts = []
    for op, arg in tree:
        if op is C.LITERAL:
            parts.append([chr(arg)])
        elif op is C.IN:
            parts.append([chr(a if o is C.LITERAL else a[0]) for o, a in arg])
        elif op is C.BRANCH:
            parts.append(list(chain.from_iterable(map(_examples, arg[1]))))
        elif op is C.SUBPATTERN:
            parts.append(_examples(arg[3]))
        elif op is C.MAX_REPEAT:
            low, high, sub = arg
            parts.append([x * n for n in dict.fromkeys((low, min(high, low + 1))) for x in _examples(sub)])
        else:
            assert op in (C.ASSERT, C.ASSERT_NOT), op
            parts.append([""])
    first = [p[0] for p in parts]
    return list(dict.fromkeys("".join([*first[:i], x, *first[i + 1 :]]) for i, p in enumerate(parts) for x in p))


def test_no_gate_is_narrower_than_its_rule():
    missed = []
    for r in license_scan.rules():
        for text in _examples(_parser.parse(r.pattern.pattern)):
            assert r.pattern.fullmatch(f" {text} ", 1, len(text) + 2) or r.pattern.search(f" {text} "), (r.name, text)
            if r.keyword not in f" {text} ":
                missed.append((r.name, r.keyword, text))
    assert not missed


@pytest.mark.parametrize("text", ["may not be copied without permission", "may not be distributed in any form", "No part of it may be reproduced in any form"])
def test_proprietary_notices_need_no_other_word(text):
    assert "proprietary" in {d.label for d in detect(normal_form(text))}


def test_wtfpl_in_both_spellings():
    for word in ("license", "licence"):
        assert {d.label for d in detect(normal_form(f"Do What The Fuck You Want To Public {word}"))} == {"wtfpl"}


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("licensed under the GNU GPL", {"gpl"}),
        ("Apache License", {"apache"}),
        ("BSD license", {"bsd"}),
        ("GNU Lesser General Public License", {"lgpl"}),
        ("distributed under the LGPL", {"lgpl"}),
        ("see https://creativecommons.org/licenses/by-nc-sa/4.0/", {"cc-by-nc-sa"}),
        ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License", {"gpl-2.0"}),
        ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", {"isc"}),
        # A version, where there is one, decides.
        ("licensed under the GNU GPL version 2 or later", {"gpl-2.0"}),
        ("Licensed under the Apache License, Version 2.0", {"apache-2.0"}),
        ("3-clause BSD license", {"bsd-3-clause"}),
        ("GNU Lesser General Public License v2.1", {"lgpl-2.1"}),
        ("CC BY-SA 4.0", {"cc-by-sa"}),
        ("CC BY 4.0", {"cc-by-4.0"}),
    ],
)
def test_notices_with_and_without_a_version(text, labels):
    assert {d.label for d in detect(normal_form(text))} == labels
