"""Words for periods as half-open windows of days. Today is always given, never read from a clock.

A text is read as tokens (numbers, words, single marks). Parsers for a written day, a range of two, a month and so on
are tried at each token; the first that reads one decides. What reads as a day that doesn't exist, or as a range that
ends before it begins, has no window, so that nobody gets an answer for another period than the one they named.
"""

from __future__ import annotations

import datetime as dt
import re

D = dt.timedelta
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
# Words that join two days, stand before a month, and follow a number.
JOINERS = frozenset("to till until and - –".split())
BEFORE_MONTH = frozenset("in for of during".split())
ORDINALS = frozenset("st nd rd th".split())
SPELLINGS = {"toady": "today", "todays": "today", "yesterdays": "yesterday", "tomorrows": "tomorrow"}

Window = tuple[dt.date, dt.date]


class Impossible(ValueError):
    """A day that is written and doesn't exist, or a range that runs backwards."""


def tokens(text: str) -> list[str]:
    found = re.findall(r"[0-9]+|[^\W\d_]+(?:['’]s)?|[^\w\s]", text.lower())
    words = [re.sub(r"['’]s$", "", t) if len(t) > 3 else t for t in found]
    return [SPELLINGS.get(t, t) for t in words]


def _month_number(word: str) -> int | None:
    """1 to 12 for a month's name, its first three letters, or sept."""
    return next((i for i, m in enumerate(MONTHS, 1) if word == m or word == m[:3] or (word == "sept" and i == 9)), None)


def month(year: int, number: int) -> Window:
    first = dt.date(year, number, 1)
    return first, (first + D(31)).replace(day=1)


def _made(year: int | None, number: int, day: int, today: dt.date) -> dt.date:
    """Without a year the latest such day that isn't in the future."""
    try:
        if year is not None:
            return dt.date(year, number, day)
        made = dt.date(today.year, number, day)
        return made if made <= today else made.replace(year=made.year - 1)
    except ValueError:
        raise Impossible(f"no day {day}.{number}.{year or ''}") from None


class _Reader:
    """Parsers over the tokens; each gives (value, index behind) or None."""

    def __init__(self, text: str, today: dt.date) -> None:
        self.t, self.today = tokens(text), today

    def at(self, i: int) -> str:
        return self.t[i] if 0 <= i < len(self.t) else ""

    def number(self, i: int, *digits: int) -> bool:
        return self.at(i).isdigit() and len(self.at(i)) in digits

    def year_behind(self, i: int) -> tuple[int | None, int]:
        i += self.at(i) == ","
        return (int(self.at(i)), i + 1) if self.number(i, 4) else (None, i - (self.at(i - 1) == ","))

    def day(self, i: int) -> tuple[dt.date, int] | None:
        sign = self.at(i + 1)
        if sign in ("-", "/", ".") and self.at(i + 3) == sign and self.number(i + 2, 1, 2):
            if self.number(i, 4) and self.number(i + 4, 1, 2):
                return _made(int(self.at(i)), int(self.at(i + 2)), int(self.at(i + 4)), self.today), i + 5
            if self.number(i, 1, 2) and self.number(i + 4, 2, 4):
                year = int(self.at(i + 4)) + (2000 if len(self.at(i + 4)) == 2 else 0)
                return _made(year, int(self.at(i + 2)), int(self.at(i)), self.today), i + 5
        if self.number(i, 1, 2):
            j = i + 1 + (self.at(i + 1) in ORDINALS)
            j += self.at(j) in ("of", "-", "/")
            if number := _month_number(self.at(j)):
                year, end = self.year_behind(j + 1 + (self.at(j + 1) in (".", "-", "/")))
                return _made(year, number, int(self.at(i)), self.today), end
        if (number := _month_number(self.at(i))) and self.number(j := i + 1 + (self.at(i + 1) == "."), 1, 2):
            year, end = self.year_behind(j + 1 + (self.at(j + 1) in ORDINALS))
            return _made(year, number, int(self.at(j)), self.today), end
        return None

    def days(self, i: int) -> tuple[Window, str] | None:
        """A day, or a range of two."""
        if (first := self.day(i)) is None:
            return None
        a, j = first
        if self.at(j) in JOINERS and (second := self.day(j + 1)):
            b = second[0]
            if b < a:
                raise Impossible(f"{a} to {b}")
            return (a, b + D(1)), f"{a} to {b}"
        return (a, a + D(1)), str(a)

    def relative(self, i: int) -> tuple[Window, str] | None:
        today, monday, word, then = self.today, self.today - D(self.today.weekday()), self.at(i), self.at(i + 1)
        around = {"yesterday": -1, "today": 0, "tomorrow": 1}
        if word in around:
            day = today + D(around[word])
            return (day, day + D(1)), word
        if word in ("last", "this", "next") and then == "week":
            start = monday + D(7 * ("last", "this", "next").index(word) - 7)
            return (start, start + D(7)), f"{word} week"
        if word in ("last", "this", "next") and then == "month":
            this = month(today.year, today.month)
            day = {"last": this[0] - D(1), "this": today, "next": this[1]}[word]
            return month(day.year, day.month), f"{word} month"
        if word in ("last", "past", "next") and then.isdigit() and self.at(i + 2) in ("day", "days"):
            label = f"{word} {then} {self.at(i + 2)}"
            return ((today, today + D(int(then))) if word == "next" else (today - D(int(then)), today + D(1))), label
        return None

    def weekday(self, i: int) -> tuple[Window, str] | None:
        last = self.at(i) == "last"
        if (name := self.at(i + last)) not in WEEKDAYS:
            return None
        back = (self.today.weekday() - WEEKDAYS.index(name)) % 7
        day = self.today - D(back or 7 * last)
        return (day, day + D(1)), "last " * last + name

    def named_month(self, i: int) -> tuple[Window, str] | None:
        """A month with a year behind it, or a word such as in before it; so may is no month in "may I see"."""
        if (number := _month_number(self.at(i))) is None:
            return None
        if self.number(i + 1, 4):
            return month(int(self.at(i + 1)), number), f"{self.at(i)} {self.at(i + 1)}"
        if len(self.t) > 1 and self.at(i - 1) not in BEFORE_MONTH:
            return None
        return month(self.today.year if number <= self.today.month else self.today.year - 1, number), self.at(i)


def window(text: str, today: dt.date) -> tuple[Window, str] | None:
    """(window, label); None where the text names a day that doesn't exist or a range that runs backwards. Without a
    period: the next seven days."""
    read = _Reader(text, today)
    try:
        for parser in (read.days, read.relative, read.weekday, read.named_month):
            for i in range(len(read.t)):
                if found := parser(i):
                    return found
    except Impossible:
        return None
    return (today, today + D(7)), "next 7 days"


def wider(label: str) -> tuple[str, ...]:
    """What to offer where a period has nothing: a neighbour, then the next longer span; thirty days for any other."""
    words = label.split()
    if label in ("today", "yesterday", "tomorrow"):
        return {"today": ("yesterday",), "yesterday": (), "tomorrow": ()}[label] + ("this week",) + {"today": (), "yesterday": ("last week",), "tomorrow": ("next week",)}[label]
    if len(words) == 2 and words[1] in ("week", "month"):
        longer = {"week": f"{words[0]} month", "month": f"{'next' if words[0] == 'next' else 'last'} 90 days"}[words[1]]
        return (longer, f"last {words[1]}") if words[0] == "this" else (longer,)
    return ("last 30 days",)
