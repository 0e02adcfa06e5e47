"""The few places where a view's SQL is written differently for Spark and for other engines."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    name: str

    def days(self, later: str, earlier: str) -> str:
        """Whole days from one date to another."""
        return f"datediff({later}, {earlier})" if self.name == "spark" else f"date_diff('day', {earlier}, {later})"

    def plus(self, date: str, days: int | str) -> str:
        return f"date_add({date}, {days})" if self.name == "spark" else f"CAST({date} + {days} AS date)"

    def json(self, text: str, key: str) -> str:
        return f"get_json_object({text}, '$.{key}')" if self.name == "spark" else f"json_extract_string({text}, '$.{key}')"

    def text_of(self, date: str) -> str:
        return f"date_format({date}, 'yyyy-MM-dd')" if self.name == "spark" else f"strftime({date}, '%Y-%m-%d')"

    def minutes(self, stamp: str) -> str:
        """Minutes since midnight."""
        return f"(hour({stamp}) * 60 + minute({stamp}))"


SPARK, ANSI = Dialect("spark"), Dialect("ansi")
