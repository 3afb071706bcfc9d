"""Region-name normaliser used to match boundary features to metric rows:
lower-case, compatibility decomposition (NFKD), combining marks U+0300-036F and quotes
removed, runs of other non [a-z0-9] characters collapsed to one space, trimmed.

Only what a character leaves among [a-z0-9] matters, so the decomposition is a table
from code points to that rest, made from ``unicodedata`` when the plan is built and
applied by built-in string functions: one ``translate`` for rests of at most one
character, and replacements, in names that need them, for longer ones.  No Python runs
in the tasks.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARKS = re.compile("[̀-ͯ`']")
_OTHER = re.compile("[^a-z0-9]")


@cache
def folding_table() -> tuple[dict[str, str], dict[str, str]]:
    """(characters that leave one character or none, those that leave several)."""
    short, long = {}, {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if 0xD800 <= ord(c) < 0xE000:
            continue
        whole = unicodedata.normalize("NFKD", c)
        if whole == c and not _MARKS.match(c):
            continue
        rest = _OTHER.sub(" ", _MARKS.sub("", whole))
        if rest.strip() or not rest:
            (short if len(rest) < 2 else long)[c] = rest
    return short, long


def normalize_name(col: Column) -> Column:
    short, long = folding_table()
    kept = sorted(short, key=lambda c: short[c] == "")       # translate drops what has no counterpart
    name = F.lower(F.coalesce(col, F.lit("")))
    pairs = F.split(F.lit("\n".join(f"{c}\t{rest}" for c, rest in long.items())), "\n")
    expanded = F.aggregate(pairs, name, lambda n, p: F.replace(n, F.substring_index(p, "\t", 1), F.substring_index(p, "\t", -1)))
    name = F.when(name.rlike("[" + "".join(long) + "]"), expanded).otherwise(name)
    name = F.translate(name, "".join(kept) + "`'", "".join(short[c] for c in kept))
    return F.trim(F.regexp_replace(name, "[^a-z0-9]+", " "))
