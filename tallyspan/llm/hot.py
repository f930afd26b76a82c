"""Joins with a table that has one row per key, where some keys hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than a 1 / HUBS share of all rows is a hub; there are fewer than HUBS of them, so they are broadcast.
HUBS = 4096


def with_hubs(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows joined to table, unique by key, whose column n is the number of the key's rows among `total`.

    Rows of hubs stay where they are and meet a broadcast of fewer than HUBS rows; no other key brings more than a
    1 / HUBS share of the rows to one task. Null keys join nothing.
    """
    hub = F.col(n) > total // HUBS
    hubs = F.broadcast(table.where(hub))
    rest = rows.join(hubs.select(key), key, "left_anti")
    return rest.join(table.where(~hub), key).unionByName(rows.join(hubs, key))
