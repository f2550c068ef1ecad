"""Literals that a text must hold before a pattern can match it, so that the regex engine only sees texts that may match.

Every way through the alternations of a pattern is a sequence of literals and gaps. Of each way the longest run of literals is taken;
a text without any of the runs cannot match. Runs are compared with an index of the text: its words in lower case, one space between
and around them, so that a word boundary next to a literal is a space in the run. Texts outside ASCII have no index and always go on to
the engine, since case and word boundaries mean more there.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from functools import lru_cache
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_WAYS = 512
GAP, EDGE = object(), object()


def index(text: Column) -> Column:
    """The index of a text; null for text outside ASCII."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) == F.octet_length(t), F.concat(F.lit(" "), F.regexp_replace(F.lower(t), r"[^a-z0-9_]+", " "), F.lit(" ")))


def _word(code: int) -> bool:
    return code < 128 and (chr(code).isalnum() or chr(code) == "_")


def _ways(tree, optional: bool = False) -> list[list]:  # noqa: ANN001
    """Each way as characters, " " for what only non-word characters can fill, EDGE for boundaries and GAP for the rest. optional: what
    may be left out makes two ways instead of a gap."""
    ways: list[list] = [[]]
    for kind, value in tree:
        if kind is op.LITERAL:
            new = [[chr(value).lower() if _word(value) else " "]]
        elif kind is op.AT:
            new = [[EDGE if value is op.AT_BOUNDARY else GAP]]
        elif kind is op.BRANCH:
            new = [w for part in value[1] for w in _ways(part, optional)]
        elif kind is op.SUBPATTERN:
            new = _ways(value[3], optional)
        elif kind is op.IN:
            blank = all(k is op.CATEGORY and v is op.CATEGORY_SPACE or k is op.LITERAL and not _word(v) for k, v in value)
            plain = all(k is op.LITERAL and _word(v) for k, v in value)
            new = [[" "]] if blank else [[chr(v).lower()] for _, v in value] if plain else [[GAP]]
        elif kind is op.MAX_REPEAT:
            least, most, part = value
            inner = _ways(part, optional)
            # blanks meet in one space of the index, so one or more of them are one
            new = [[], *inner] if optional and (least, most) == (0, 1) else [[GAP]] if not least else inner if inner == [[" "]] else [[*w, GAP] for w in inner]
        else:
            new = [[GAP]]
        if len(ways) * len(new) > MOST_WAYS:
            new = [[GAP]]
        ways = [a + b for a, b in product(ways, new)]
    return ways


def _runs(way: list) -> list[str]:
    runs, run = [], ""
    for x in [*way, GAP]:
        if x is GAP:
            runs.append(run)
            run = ""
        elif x is EDGE:
            if run and run[-1] != " ":
                run += " "
            elif not run:
                run = " "
        elif not (x == " " and run.endswith(" ")):
            run += x
    return runs


@lru_cache(maxsize=None)
def required(pattern: str) -> tuple[str, ...] | None:
    """Runs of which every match needs one; None if some way has none worth asking for."""
    found = set()
    for way in _ways(parser.parse(pattern)):
        best = max(_runs(way), key=lambda r: (len(r.strip()), len(r)))
        if len(best.strip()) < 2:
            return None
        found.add(best)
    return tuple(sorted(f for f in found if not any(g != f and g in f for g in found)))


@lru_cache(maxsize=None)
def whole_words(pattern: str) -> tuple[str, ...] | None:
    """Runs of which a text has one if and only if the pattern matches; None for patterns that are more than a choice of words."""
    ways = _ways(parser.parse(pattern), optional=True)
    if any(w[:1] != [EDGE] or w[-1:] != [EDGE] or not all(isinstance(x, str) and x != " " for x in w[1:-1]) or len(w) < 3 for w in ways):
        return None
    return tuple(sorted({f" {''.join(w[1:-1])} " for w in ways}))


def any_of(words: str, runs: tuple[str, ...]) -> Column:
    """Whether the index in column `words` holds any of the runs; the optimizer makes plain searches of it."""
    return F.expr(f"`{words}` LIKE ANY ({', '.join(repr('%' + r.replace('_', chr(92) * 2 + '_') + '%') for r in runs)})")


def may_match(words: str, pattern: str) -> Column:
    """Whether the text of this index may match; true where nothing can be said."""
    runs = required(pattern)
    return F.lit(True) if runs is None else F.col(words).isNull() | any_of(words, runs)
