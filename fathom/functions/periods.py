"""Period strings such as ``1W`` or ``3M`` and the labels of the buckets they cut a calendar into.

Days are labelled by themselves, weeks by their Sunday, months and years by their last day. Buckets of
several units count from the series' own first unit: several days from its first date (labelled by their
first day), several weeks, months or years by the last unit that the bucket covers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.errors import ConfigurationError

_PERIOD = re.compile(r"(\d*)([DWMY])")


@dataclass(frozen=True)
class Period:
    count: int
    unit: str

    @classmethod
    def parse(cls, text: str) -> Period:
        found = _PERIOD.fullmatch(text)
        if not found or found[1] and int(found[1]) < 1:
            raise ConfigurationError(f"not a period: {text!r} (a count and one of D, W, M, Y)")
        return cls(int(found[1] or 1), found[2])

    def unit_end(self, date: Column) -> Column:
        """The last day of the single unit that holds ``date``."""
        if self.unit == "D":
            return date
        if self.unit == "W":
            return F.date_add(F.trunc(date, "week").cast("date"), 6)
        if self.unit == "M":
            return F.last_day(date)
        return F.make_date(F.year(date), F.lit(12), F.lit(31))

    @property
    def anchored(self) -> bool:
        """Whether labels depend on where a series begins."""
        return self.count > 1

    def label(self, date: Column, first: Column | None = None) -> Column:
        """The label of the bucket that holds ``date`` in a series whose first date is ``first``."""
        if not self.anchored:
            return self.unit_end(date)
        n = self.count
        if self.unit == "D":
            return F.date_add(first, (F.floor(F.datediff(date, first) / n) * n).cast("int"))
        end, start = self.unit_end(date), self.unit_end(first)
        if self.unit == "W":
            return F.date_add(start, (F.ceil(F.datediff(end, start) / (7 * n)) * (7 * n)).cast("int"))
        if self.unit == "M":
            months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
            return F.last_day(F.add_months(start, (F.ceil(months / n) * n).cast("int")))
        years = F.year(end) - F.year(start)
        return F.make_date(F.year(start) + (F.ceil(years / n) * n).cast("int"), F.lit(12), F.lit(31))

    def step(self) -> str:
        """The interval between labels, for ``sequence``."""
        return {"D": f"INTERVAL {self.count} DAY", "W": f"INTERVAL {7 * self.count} DAY", "M": f"INTERVAL {self.count} MONTH", "Y": f"INTERVAL {self.count} YEAR"}[self.unit]
