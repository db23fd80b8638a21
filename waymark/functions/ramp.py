"""The density colour ramp as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Breaks of the ramp and the colours between which it is linear; the colour of no density.
BREAKS = [0.0, 0.33, 0.66, 1.0]
COLORS = [(0.4, 0.4, 0.4), (1.0, 1.0, 0.0), (1.0, 0.65, 0.0), (1.0, 0.0, 0.0)]
DEFAULT = (0.4, 0.4, 0.4, 0.8)
#: Widths of the pieces, as published with the breaks.
WIDTHS = [0.33, 0.33, 0.34]


def ramp(share: Column) -> list[Column]:
    """Red, green, blue and alpha (float) of a share of 0 to 1."""
    out = []
    for k in range(3):
        piece = None
        for i in (2, 1, 0):
            low, high = COLORS[i][k], COLORS[i + 1][k]
            value = F.lit(low) + (share - BREAKS[i]) / WIDTHS[i] * (high - low)
            piece = value if piece is None else F.when(share < BREAKS[i + 1], value).otherwise(piece)
        out.append(piece.cast("float"))
    return [*out, F.lit(1.0).cast("float")]
