"""Time helpers: frames, cutoffs, minutes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the study: the game runs at 15 frames per second, so a
# minute is 900 frames. The study sweeps 19 cutoffs 4500..85500 by 4500
# and then the longest match (238556 frames); the adapter's are below.
FRAMES_PER_SECOND = 15
FRAMES_PER_MINUTE = 15 * 60

# Cutoffs of the lineitem adapter (frame = days since 1995-01-01, 1..2499):
# 125..2375 by 125, then 3650, which is past every frame ("everything").
ADAPTER_STEP = 125
ADAPTER_CUTOFFS = list(range(125, 2376, 125)) + [3650]


def frames_to_minutes(frames) -> Column:
    c = frames if isinstance(frames, Column) else F.col(frames)
    return c.cast("double") / F.lit(float(FRAMES_PER_MINUTE))


def first_cutoff_above(frame, cutoffs: list[int]) -> Column:
    """Smallest cutoff strictly greater than ``frame`` (null if none).

    Strict ``<`` is the study's boundary: a row at frame f counts for
    every cutoff c with f < c. A CASE chain over the sorted literal cutoffs
    stays inside whole-stage codegen, so the sweep needs one pass over the
    scored rows, not one per cutoff.
    """
    fc = frame if isinstance(frame, Column) else F.col(frame)
    cs = sorted(int(c) for c in cutoffs)
    expr = F.when(fc < F.lit(cs[0]), F.lit(cs[0]))
    for c in cs[1:]:
        expr = expr.when(fc < F.lit(c), F.lit(c))
    return expr
