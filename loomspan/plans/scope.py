"""Row-level security: which rows and documents a user may see."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_CODE = re.compile(r"[A-Za-z0-9 _-]{1,40}")


class NoAccess(PermissionError):
    """The scope has no code at all, so nothing may be read."""


@dataclass(frozen=True)
class Scope:
    """``*`` in ``factories`` stands for all. Codes are checked, so that they can stand in a key or a filter."""

    factories: tuple[str, ...] = ("*",)
    departments: tuple[str, ...] = ()
    confidentiality: int = 0
    buyers: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for code in (*self.factories, *self.departments, *self.buyers, *self.groups):
            if code != "*" and not _CODE.fullmatch(code):
                raise ValueError(f"not a code: {code!r}")

    @property
    def unrestricted(self) -> bool:
        return "*" in self.factories

    def key(self) -> str:
        """One text for equal scopes, in whatever order their codes were given; part of every cache key."""
        return "|".join([",".join(sorted(x)) for x in (self.factories, self.departments, self.buyers, self.groups)] + [str(self.confidentiality)])

    def rows(self, column: str) -> Column | None:
        """The filter for a view's scope column; None if all rows may be seen."""
        if self.unrestricted:
            return None
        if not self.factories:
            raise NoAccess("the scope holds no factory")
        return F.col(column).isin(*self.factories)

    def listed(self, column: str, codes: Column) -> Column:
        """The same as a test against a comma-separated list that a session carries; null or empty shows nothing."""
        return F.coalesce((codes == "*") | F.concat(F.lit(","), codes, F.lit(",")).contains(F.concat(F.lit(","), F.col(column), F.lit(","))), F.lit(False))

    def documents(self, factory: str = "factory", department: str = "department", level: str = "confidentiality", buyer: str = "buyer") -> Column:
        """Own and group-wide factory and department, up to the confidentiality, and no buyer or an own one."""
        own = lambda column, codes: F.col(column).isin("GROUP", "", *codes)
        place = F.lit(True) if self.unrestricted else own(factory, self.factories)
        return place & own(department, self.departments) & (F.col(level) <= self.confidentiality) & F.col(buyer).isin("", *self.buyers)


EVERYTHING = Scope()
