"""Licence notices and expressions: what is looked for, and how expressions are evaluated."""

from __future__ import annotations

import re
from typing import NamedTuple

# fixed values: phrases of the base labels
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_WEIGHT = 0.6

PHRASES: dict[str, tuple[str, float]] = {
    "mit license": ("mit", 0.7),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.95),
    "apache license version 2 0": ("apache-2.0", 0.9),
    "apache license 2 0": ("apache-2.0", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.95),
    "bsd license": ("bsd", 0.7),
    "bsd 2 clause": ("bsd-2-clause", 0.8),
    "bsd 3 clause": ("bsd-3-clause", 0.8),
    "isc license": ("isc", 0.7),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", 0.95),
    "zlib license": ("zlib", 0.7),
    "boost software license": ("bsl-1.0", 0.9),
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "gnu general public license version 2": ("gpl-2.0", 0.9),
    "gnu general public license version 3": ("gpl-3.0", 0.9),
    "gnu free documentation license": ("gfdl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "european union public licence": ("eupl", 0.9),
    "open database license": ("odbl", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "creative commons zero": ("cc0", 0.8),
    "cc0": ("cc0", 0.6),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nc": ("cc-by-nc", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc by nc sa": ("cc-by-nc-sa", 0.9),
    "cc by nc nd": ("cc-by-nc-nd", 0.9),
    "free and unencumbered software released into the public domain": ("unlicense", 0.95),
    "dedicated to the public domain": ("public-domain", 0.8),
    "confidential and proprietary": ("proprietary", 0.7),
    "no part of this publication may be reproduced": ("proprietary", 0.9),
}
"""Words of a notice, its label, and how sure it makes that the text is under a licence."""
TAGS = {"spdx license identifier": True, "license expression": True, "license": False, "licence": False}
"""Words before an expression; with ``False`` it must begin with a known identifier."""
TAG_WEIGHT = 0.99

OPENNESS = {
    0.0: "proprietary reserved",
    0.2: "agpl agpl-3.0 agpl-3.0-only agpl-3.0-or-later cc-by-nc cc-by-nc-4.0 cc-by-nd cc-by-nd-4.0 cc-by-nc-sa cc-by-nc-sa-4.0 cc-by-nc-nd cc-by-nc-nd-4.0 sspl-1.0 busl-1.1",
    0.4: "gpl gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later gfdl cc-by-sa cc-by-sa-3.0 cc-by-sa-4.0 eupl eupl-1.2 odbl odbl-1.0 osl-3.0",
    0.6: "lgpl lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later mpl mpl-1.1 mpl-2.0 epl epl-1.0 epl-2.0 cddl-1.0 artistic-2.0",
    0.8: "mit apache-2.0 bsd bsd-2-clause bsd-3-clause isc zlib bsl-1.0 cc-by cc-by-3.0 cc-by-4.0 ncsa postgresql python-2.0 psf-2.0 x11 openssl ofl-1.1 ms-pl upl-1.0",
    1.0: "cc0 cc0-1.0 unlicense public-domain 0bsd wtfpl mit-0 pddl-1.0",
}
"""How freely a text may be used: nothing granted, use restricted, share alike, share alike per file, credit, no terms."""
KNOWN = {name: value for value, names in OPENNESS.items() for name in names.split()}
SHARE_ALIKE, EXCEPTION = 0.4, 0.6
"""An exception lets a share-alike licence be combined with others, as one that holds per file."""

_BEFORE = re.compile(rb"""["']?[ \t]*[:=][ \t]*["']?""")
_TOKEN = re.compile(rb"[ \t]*+([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*+)")
_BINDS = {"or": 1, "and": 2, "with": 3}


class Expression(NamedTuple):
    text: str
    """Its tokens, joined by one space."""
    names: list[str]
    openness: float


def license_id(token: str) -> str:
    """Lower case; a plus means the version or any later one."""
    token = token.lower()
    return f"{token[:-1]}-or-later" if token.endswith("+") else token


def _openness(name: str) -> float:
    """That of the licence, or of its version without a suffix; of an unknown one nothing is granted."""
    plain = name.removesuffix("-or-later").removesuffix("-only")
    return KNOWN.get(name, KNOWN.get(plain, 0.0))


def _is_id(name: str) -> bool:
    """A known licence, or at least the form of an identifier."""
    return _openness(name) > 0 or name in KNOWN or "-" in name or any(c.isdigit() for c in name)


def read_expression(text: bytes, at: int, any_id: bool) -> Expression | None:
    """The licence expression that follows a tag which ends at byte ``at``; none if there is no sign or identifier.

    Shunting-yard: operands go to a stack of values, operators wait until one comes that binds no tighter. ``with``
    binds before ``and``, ``and`` before ``or``. Of parts joined by ``and`` all terms hold, so the least open counts; of
    ``or`` the reader may choose. The expression ends at the first token that does not fit; an operator that is left
    over is dropped, and parentheses that are still open end there.
    """
    sign = _BEFORE.match(text, at)
    if sign is None:
        return None
    values: list[float] = []
    waiting: list[str] = []
    tokens: list[str] = []
    names: list[str] = []
    operand = True

    def apply() -> None:
        kind, right = waiting.pop(), values.pop()
        left = values.pop()
        if kind == "or" or kind == "with" and left >= SHARE_ALIKE:
            values.append(max(left, right))
        else:
            values.append(min(left, right) if kind == "and" else left)

    at = sign.end()
    while (m := _TOKEN.match(text, at)) is not None:
        at, raw = m.end(), m[1].decode()
        ends = raw[-1] in ".:-" and raw not in "()"
        token = raw.rstrip(".:-").lower()
        if operand and raw == "(" and waiting[-1:] != ["with"]:
            waiting.append("(")
        elif operand and token not in _BINDS and raw not in "()":
            exception = waiting[-1:] == ["with"]
            name = license_id(token)
            if not (_is_id(name) if any_id or names else name in KNOWN):
                break
            values.append(EXCEPTION if exception else _openness(name))
            if not exception:
                names.append(name)
            operand = False
        elif not operand and token in _BINDS and not ends and (token, tokens[-1]) != ("with", ")"):
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[token]:
                apply()
            waiting.append(token)
            operand = True
        elif not operand and raw == ")" and "(" in waiting:
            while waiting[-1] != "(":
                apply()
            waiting.pop()
        else:
            break
        tokens.append(token.upper() if token in _BINDS else raw if raw in "()" else raw.rstrip(".:-"))
        if ends:
            break
    if not names:
        return None
    while operand and (tokens[-1] == "(" or tokens[-1].lower() in _BINDS):
        tokens.pop()
        waiting.pop()
    while waiting:
        if waiting[-1] == "(":
            waiting.pop()
            tokens.append(")")
        else:
            apply()
    return Expression(" ".join(tokens).replace("( ", "(").replace(" )", ")"), names, values[-1])
