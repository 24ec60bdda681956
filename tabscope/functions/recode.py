"""Category recoding from ordered rule lists."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class RecodeRule(NamedTuple):
    """Rows whose text starts with / contains ``text`` get ``label``."""

    how: Literal["prefix", "contains"]
    text: str
    label: str

    def matches(self, column: Column) -> Column:
        return column.startswith(self.text) if self.how == "prefix" else column.contains(self.text)


def recode(column: Column, rules: Sequence[RecodeRule], default: str) -> Column:
    """The label of the first rule that matches; ``default`` otherwise, also for NULL."""
    result = F.lit(default)
    for rule in reversed(rules):
        result = F.when(rule.matches(column), F.lit(rule.label)).otherwise(result)
    return result


def collapse_levels(column: Column, keep: Sequence[str], other: str) -> Column:
    """Keep the listed levels and merge the rest (NULL included)."""
    return F.when(column.isin(*keep), column).otherwise(F.lit(other))
