"""Analysis parameters and their validation.

Invalid parameters raise ``ValueError`` when a query is built, instead of
printing and returning 0 for every pair.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

LEVELS = ("1%", "5%", "10%")
SPREADS = ("cross", "aligned")
ALIGNS = ("rank", "date")
SERIES = ("close", "walk")
#: Smallest window with a defined t.
MIN_WINDOW = 4


@dataclass(frozen=True)
class AnalysisConfig:
    """Parameters of one pair analysis run.

    min_days / min_mean_volume: strict ``>`` eligibility tests on the whole
    history of a ticker. Each eligible series is cut to its newest
    ``min_days`` bars and the statistics use positions
    ``[begin_day, ndays)`` of that cut (0 = newest), so only the newest
    ``min(ndays, min_days)`` bars are ever read.

    spread: ``cross`` is the spread over every (a_i, b_j) combination of the
    two windows, ``aligned`` the position-wise residual.
    align: ``rank`` pairs bars by position after trimming, ``date`` by
    calendar date (pairs sharing fewer than ``min_overlap`` dates are left out).
    series: ``close`` or ``walk`` (running sum of close - walk_offset by date).
    forward: run the unit-root regression oldest-first instead of newest-first.
    pair_blocks: number of ticker blocks for pair formation; ``None`` derives
    it from ``spark.sql.shuffle.partitions``.
    """

    min_days: int = 2000
    min_mean_volume: float = 20000.0
    ndays: int = 100
    begin_day: int = 0
    z_thresh: float = 2.0
    crit_level: str = "5%"
    spread: str = "cross"
    align: str = "rank"
    min_overlap: int = 10
    series: str = "close"
    walk_offset: float = 1500.0
    forward: bool = False
    universe_limit: int | None = None
    pair_blocks: int | None = None

    def validate(self) -> "AnalysisConfig":
        if self.begin_day < 0 or self.begin_day >= self.ndays:
            raise ValueError(f"begin_day must be in [0, ndays): {self.begin_day}")
        if self.z_thresh < 0:
            raise ValueError(f"z_thresh must be >= 0: {self.z_thresh}")
        if self.crit_level not in LEVELS:
            raise ValueError(f"crit_level must be one of {LEVELS}: {self.crit_level!r}")
        if self.spread not in SPREADS:
            raise ValueError(f"spread must be one of {SPREADS}: {self.spread!r}")
        if self.align not in ALIGNS:
            raise ValueError(f"align must be one of {ALIGNS}: {self.align!r}")
        if self.series not in SERIES:
            raise ValueError(f"series must be one of {SERIES}: {self.series!r}")
        if self.min_days < 0 or self.ndays <= 0:
            raise ValueError("min_days must be >= 0 and ndays > 0")
        if self.window < MIN_WINDOW:
            raise ValueError(f"the window has {self.window} bars; a unit-root t needs {MIN_WINDOW}")
        if self.min_overlap < MIN_WINDOW:
            raise ValueError(f"min_overlap must be >= {MIN_WINDOW}: a unit-root t needs as many bars")
        if self.universe_limit is not None and self.universe_limit < 0:
            raise ValueError("universe_limit must be >= 0")
        if self.pair_blocks is not None and self.pair_blocks < 1:
            raise ValueError("pair_blocks must be >= 1")
        return self

    @property
    def trim(self) -> int:
        """Newest bars kept per series: the smaller of the two trims."""
        return min(self.ndays, self.min_days)

    @property
    def window(self) -> int:
        """Bars per analysis window (equal for every series)."""
        return max(self.trim - self.begin_day, 0)

    def with_(self, **kw) -> "AnalysisConfig":
        return replace(self, **kw).validate()
