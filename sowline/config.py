"""Parameters that the saved queries kept in a one-row "declares" CTE.

A frozen dataclass passed to the plan functions; every value becomes a
literal in the plan, so filters on it reach the parquet reader.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Declares:
    start_date: dt.date
    end_date: dt.date
    sites: tuple[str, ...] = ()
    local_time_zone: str = "America/Chicago"
    labels: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict, compare=False)

    def days(self) -> int:
        return (self.end_date - self.start_date).days + 1
