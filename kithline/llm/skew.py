"""A join of rows with what was found for their groups, which no large group slows down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many groups can each have more than this share's inverse of all rows.
LARGE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], n: str, total: int) -> DataFrame:
    """rows.join(groups, key); groups has one row for each key, with the number n of its rows.

    Groups with more than a thousandth of all rows, of which there are a thousand at most, are
    broadcast, so their rows stay where they are; the rows of the others are shuffled.  Both
    sides are read twice and should be tables.
    """
    large = F.col(n) > max(total // LARGE, 1)
    few = F.broadcast(groups.filter(large))
    rest = rows.join(few.select(*key), key, "left_anti").join(groups.filter(~large), key)
    return rows.join(few, key).unionByName(rest)
