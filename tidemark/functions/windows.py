"""Spans of time that a question names, in two languages: windows, the base of prices, one month.

A question is cut into stretches that begin at a year and run to the next one; what stands in a stretch
says which months of the year are meant and whether the window opens or closes there. Driver-side: a
question is one short text.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from tidemark.functions.labels import ENGLISH, LETTERS, MONTHS, PLAIN

FOLD = str.maketrans(LETTERS, PLAIN)
NAMES = {name.translate(FOLD): i for i, names in enumerate(zip(*[[n[-1] for n in MONTHS], ENGLISH], strict=True), start=1) for name in names}
# Words for parts of a year and the months they mean, for windows that open or close, and
# for prices of a base; beginnings of folded words.
PARTS = {"son": (12, 12), "bas": (1, 1), "orta": (6, 6), "end": (12, 12), "beginning": (1, 1), "mid": (6, 6)}
OPENS = ("itibaren", "beri", "sonra", "since", "from", "after", "onwards")
CLOSES = ("kadar", "dek", "once", "until", "till", "before")
PRICES = ("fiyat", "price")
LATEST = ("son", "guncel", "bugun", "latest", "current")


@dataclass(frozen=True)
class Stretch:
    """A year, its months, and what the words around it say. ``stamped``: one month was named outright."""

    year: int
    first: int = 1
    last: int = 12
    stamped: bool = False
    part: bool = False
    edge: str | None = None


def words_of(text: str | None) -> list[str]:
    """Folded words; year and month written together or with a sign between come apart."""
    folded = (text or "").translate(FOLD).lower()
    folded = re.sub(r"\b((?:19|20)\d\d)(0[1-9]|1[0-2])\b", r"\1-\2", folded)
    return re.findall(r"(?:19|20)\d\d(?!\d)(?:[-/.](?:0?[1-9]|1[0-2])(?!\d))?|[a-z]+|\d+", folded)


def month_named(word: str) -> int | None:
    """The month whose name a word begins with; short names must be whole but for an ending of case."""
    return next((m for name, m in NAMES.items() if word == name or (word.startswith(name) and len(name) > 3)), None)


def stretches(text: str | None) -> list[Stretch]:
    """All years of a text with what belongs to each; a month's name may stand before or after its year."""
    words, out = words_of(text), []
    at = [i for i, w in enumerate(words) if re.match(r"(?:19|20)\d\d", w)]
    named = next((i for i, w in enumerate(words) if month_named(w)), len(words))
    leads = bool(at) and named < at[0]  # names of months stand before their years, or behind them, throughout
    for n, i in enumerate(at):
        year, _, digits = re.match(r"(\d{4})([-/.]?)(\d*)", words[i]).groups()
        after = words[i + 1 : at[n + 1] if n + 1 < len(at) else len(words)]
        before = words[i - 1] if i and (i - 1 not in at) else ""
        month = int(digits) if digits else (month_named(before) if leads else month_named(after[0]) if after else None)
        near = [w for w in after[:4] if not month_named(w)]
        edge = next((e for w in near for e, beginnings in (("opens", OPENS), ("closes", CLOSES)) if w.startswith(beginnings)), None)
        edge = edge or ("opens" if before in ("since", "from") else "closes" if before in ("until", "till", "before") else None)
        span = (month, month) if month else part_of_year(near)
        out.append(Stretch(int(year), *(span or (1, 12)), stamped=bool(month), part=bool(span and not month), edge=edge))
    return out


def part_of_year(words: list[str]) -> tuple[int, int] | None:
    """The months that words behind a year mean: its end, middle or start, its first n months, a half, a quarter."""
    for i, w in enumerate(words[:2]):
        following = words[i + 1] if i + 1 < len(words) else ""
        if w in ("ilk", "first"):
            return (1, int(following)) if following.isdigit() and 1 <= int(following) <= 12 else (1, 6)
        if w in ("ikinci", "second"):
            return 7, 12
        if w.isdigit() and following.startswith(("ceyre", "quarter")) and 1 <= int(w) <= 4:
            return 3 * int(w) - 2, 3 * int(w)
        for beginning, months in PARTS.items():
            if w.startswith(beginning) and not w.startswith(OPENS):
                return months
    return None


def window(text: str | None) -> tuple[str | None, str | None]:
    """(first, last) month of the window a question names, as first days; None where it is open.

    One year is all of it, also if one of its months is stamped; words for a part narrow it, and words such
    as "since" or "until" leave the other end open. Several years run from the earliest to the latest.
    """
    found = stretches(text)
    if not found:
        return None, None
    day = lambda y, m: dt.date(y, m, 1).isoformat()
    if len(found) > 1:
        return min(day(s.year, s.first) for s in found), max(day(s.year, s.last) for s in found)
    s = found[0]
    if s.edge == "opens":
        return day(s.year, s.first), None
    if s.edge == "closes":
        return None, day(s.year, s.last if s.part or s.stamped else 12)
    return (day(s.year, 1), day(s.year, 12)) if s.stamped else (day(s.year, s.first), day(s.year, s.last))


def base_period(text: str | None) -> str | None:
    """The month whose prices a question asks for: a named month, the December of a named year, "end" for the
    latest, None where it names no prices."""
    words = words_of(text)
    at = next((i for i, w in enumerate(words) if w.startswith(PRICES)), None)
    if at is None:
        return None
    before = words[max(0, at - 4) : at]
    named = stretches(" ".join(before))
    if named:
        s = named[-1]
        return dt.date(s.year, s.last if s.stamped else 12, 1).isoformat()
    return "end" if any(w.startswith(LATEST) for w in before) else None


def single_month(text: str | None) -> str | None:
    """The one month that a question names, or None if it names none or several."""
    stamped = [s for s in stretches(text) if s.stamped]
    return dt.date(stamped[0].year, stamped[0].first, 1).isoformat() if len(stamped) == 1 else None
