"""Joins of many rows to one for keys that hold a large share of all rows.

A plain inner or left join with the many rows on its left needs nothing from here: adaptive execution
splits its large partitions. A caller that knows of keys beyond that cuts every key into a number of pieces it
names; the plan and the rows do not depend on how large the data are.

The piece of a row is a hash of its content and of the input partition it sits in. It does not
depend on row order, so a task that runs again after a lost executor puts every row into the
same piece. Identical copies spread as well: a piece never gets more of them than one input task
has read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_pieces(
    facts: DataFrame, unique: DataFrame, keys: Sequence[str], pieces: int, how: str = "inner"
) -> DataFrame:
    """``facts`` (many rows per key) joined to ``unique`` (one row per key), each key in ``pieces``.

    ``how`` is ``inner`` or ``left``. ``unique`` is repeated once per piece.
    """
    spread = F.pmod(F.xxhash64(*facts.columns, F.spark_partition_id()), F.lit(pieces)).cast("int")
    left = facts.withColumn("_piece", spread)
    right = unique.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    return left.join(right, [*keys, "_piece"], how).drop("_piece")


def with_unmatched(
    joined: DataFrame, facts: DataFrame, unique: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """An inner join with the rows of ``unique`` that have no facts. Unlike an outer join with the
    many rows on its left, both parts can be split."""
    keys = list(keys)
    alone = unique.join(facts.select(*keys).distinct(), keys, "left_anti")
    return joined.unionByName(alone, allowMissingColumns=True)
