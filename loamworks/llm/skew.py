"""Lookups of rows in a table with one row for each key, some of which a large share of the rows may have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot that one in so many rows has; no more than so many keys can be, so they can be sent to all tasks.
HOT = 2000


def looked_up(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """rows joined with a written table (on, hot and more): hot keys by broadcast, the others by shuffle, so no task gets all rows of one."""
    hot = table.where("hot")
    others = rows.join(F.broadcast(hot.select(on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(others.join(table.where("NOT hot"), on)).drop("hot")
