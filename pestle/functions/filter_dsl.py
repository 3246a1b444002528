"""Row filter language: ``a<=5.3&&b!=3||c=~rx``, also with ``.lt. .le. .gt. .ge. .eq. .ne.``.

AND binds tightest, then OR, then the low-priority AND ``;;``; ``^^`` (exclusive or) only stands alone between
two conditions. A missing value makes a condition false (or true with ``missing_passes``), so that the
logic above it has two values only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CONDITION = re.compile(r"\s*(?P<name>[\w\-:.]+?)\s*(?P<op>==|!=|<=|>=|=~|=|<|>|\.(?:lt|le|gt|ge|eq|ne)\.)\s*(?P<value>.+?)\s*$")
WORDS = {".lt.": "<", ".le.": "<=", ".gt.": ">", ".ge.": ">=", ".eq.": "==", ".ne.": "!=", "=": "=="}
COMPARE = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
}


def condition(text: str, missing_passes: bool = False) -> Column:
    m = CONDITION.match(text)
    if m is None:
        raise ValueError(f"not a condition: {text!r}")
    op = WORDS.get(m["op"], m["op"])
    column = F.col(f"`{m['name']}`")
    if op == "=~":
        test = column.cast("string").rlike(m["value"])
    else:
        try:
            value = float(m["value"])
        except ValueError:
            raise ValueError(f"a number is needed in {text!r}") from None
        test = COMPARE[op](column.cast("double"), F.lit(value))
    return F.coalesce(test, F.lit(missing_passes))


def expression(text: str, missing_passes: bool = False) -> Column:
    """The filter as a Column; comparisons on plain columns still reach the scan's pushed filters."""
    if "^^" in text:
        parts = text.split("^^")
        if len(parts) != 2 or any(x in text for x in ("&&", "||", ";;")):
            raise ValueError("^^ joins exactly two conditions")
        a, b = (condition(p, missing_passes) for p in parts)
        return a != b

    def all_of(parts):
        out = None
        for p in parts:
            out = p if out is None else out & p
        return out

    low = []
    for group in text.split(";;"):
        either = None
        for alternative in group.split("||"):
            both = all_of(condition(c, missing_passes) for c in alternative.split("&&"))
            either = both if either is None else either | both
        low.append(either)
    return all_of(low)
