"""Entities stored by where they are, so that a search around a place reads little of them.

The earth is cut into cells of one degree, numbered row by row from the south.
A table sorted by cell has the least and greatest cell of each row group in its
files' statistics. A circle touches a few stretches of cells, one or two in each
row that it crosses; as a filter they let Parquet pass over all other row
groups. The exact distance follows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tentpole.functions.geo import RADIUS_KM

#: Cells in a row, and rows.
ACROSS, ROWS = 360, 180


def cell_of(lat: Column, lon: Column) -> Column:
    """The cell of a point; null without one."""
    row = F.least(F.greatest(F.floor(lat + 90), F.lit(0)), F.lit(ROWS - 1))
    cell = row * ACROSS + F.least(F.greatest(F.floor(lon + 180), F.lit(0)), F.lit(ACROSS - 1))
    return F.when(lat.isNotNull() & lon.isNotNull(), cell.cast("int"))


def stored(entities: DataFrame, path: str, group_bytes: int = 8_000_000, lat: str = "lat", lon: str = "lon") -> None:
    """Write entities with their ``cell``, in ranges of it and sorted by it; those without a point come first.

    ``group_bytes`` is the size of a row group: the less, the finer the search.
    """
    rows = entities.withColumn("cell", cell_of(F.col(lat), F.col(lon)))
    rows.repartitionByRange("cell", lat, lon).sortWithinPartitions("cell", lat, lon).write.option("parquet.block.size", group_bytes).parquet(path)


def stretches(home: tuple[float, float], km: float) -> list[tuple[int, int]]:
    """First and last cells of the stretches that a circle around a place touches: not more than two in each of 180 rows."""
    lat, lon = home
    angle = min((km + 1e-6) / RADIUS_KM, math.pi)
    reach = math.degrees(angle)
    low, high = max(lat - reach, -90.0), min(lat + reach, 90.0)
    # The circle's width in longitude; a circle with a pole in it goes all around.
    narrow = math.cos(math.radians(lat))
    wide = 180.0 if lat + reach >= 90 or lat - reach <= -90 or math.sin(angle) >= narrow else math.degrees(math.asin(math.sin(angle) / narrow)) + 1e-9
    place = lambda x: min(max(int(math.floor(x + 180)), 0), ACROSS - 1)
    if wide >= 180:
        parts = [(0, ACROSS - 1)]
    elif lon - wide < -180:
        parts = [(0, place(lon + wide)), (place(lon - wide + 360), ACROSS - 1)]
    elif lon + wide > 180:
        parts = [(0, place(lon + wide - 360)), (place(lon - wide), ACROSS - 1)]
    else:
        parts = [(place(lon - wide), place(lon + wide))]
    rows = range(min(max(math.floor(low + 90), 0), ROWS - 1), min(math.floor(high + 90), ROWS - 1) + 1)
    out: list[tuple[int, int]] = []
    for row in rows:
        for a, b in parts:
            first, last = row * ACROSS + a, row * ACROSS + b
            if out and out[-1][1] + 1 >= first:
                out[-1] = (out[-1][0], max(last, out[-1][1]))
            else:
                out.append((first, last))
    return out


def touched(home: tuple[float, float], km: float, no_place: bool = False, cell: str = "cell") -> Column:
    """Whether a row's cell is one that a circle touches; with ``no_place`` rows without a cell too."""
    out = F.col(cell).isNull() if no_place else F.lit(False)
    for a, b in stretches(home, km):
        out = out | F.col(cell).between(a, b)
    return out
