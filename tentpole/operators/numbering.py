"""Numbers for all rows in an order, without gathering them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tentpole.scratch import saved

#: Bits of a row's number that say where it is in its partition.
WITHIN = 33


def numbered(df: DataFrame, order: list[Column | str], name: str, first: int = 0) -> DataFrame:
    """Add the place of each row in the order of ``order``, counted from ``first``, as a long.

    Rows are dealt to partitions by ranges of the order and sorted there; a row's
    place is its place in its partition and the rows of the partitions before
    it, of which the driver sees one count each. Rows that ``order`` does not
    tell apart come in any order, and all of them in one partition, so it should
    end with something unique. An empty table gives none.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written, so that partitions and places are those of one run.
    rows = saved(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()), "ranges")
    part, within = F.shiftright("__m", WITHIN), F.col("__m").bitwiseAND((1 << WITHIN) - 1)
    counts = sorted((r[0], r[1]) for r in rows.groupBy(part.alias("p")).count().collect())
    before, offsets = 0, []
    for p, count in counts:
        offsets += [F.lit(p), F.lit(before)]
        before += count
    offset = F.try_element_at(F.create_map(*offsets), part) if offsets else F.lit(0)
    return rows.withColumn(name, (offset + within + first).cast("long")).drop("__m")
