"""Document filters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import strip


@dataclass(frozen=True)
class Filters:
    """Blank fields are off. Dates are compared as text with last_modified_at, so a missing one passes `to_date` alone."""

    space_key: str = ""
    page_id: str = ""
    from_date: str = ""
    to_date: str = ""
    candidate: int = 0

    def condition(self) -> Column | None:
        found = []
        if space := strip(self.space_key):
            found.append(F.col("space_key") == space)
        if page := strip(self.page_id):
            found.append(F.col("page_id") == page)
        if start := strip(self.from_date):
            found.append(F.col("last_modified_at") >= start)
        if end := strip(self.to_date):
            found.append(F.col("last_modified_at") <= end + "T23:59:59Z")
        return reduce(lambda a, b: a & b, found) if found else None

    def apply(self, documents: DataFrame) -> DataFrame:
        condition = self.condition()
        return documents if condition is None else documents.filter(condition)
