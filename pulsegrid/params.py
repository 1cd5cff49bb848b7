"""Detector parameters. The defaults equal the monitored service's fixed values."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values.
ERROR_LEVELS = ("ERROR", "CRITICAL")
VALID_LEVELS = ("ERROR", "WARNING", "INFO", "DEBUG", "TRACE", "CRITICAL", "UNKNOWN")
PAGE_DEFAULT = 20
MAX_ATTEMPTS = 3
BACKOFF_BASE_S = 2
DISABLE_AFTER = 10

MICROS = 1_000_000


@dataclass(frozen=True)
class DetectorParams:
    """One set of thresholds. Times are in seconds."""

    window_s: int = 60
    alpha: float = 0.3
    sensitivity: float = 2.5  # reported in evidence only, as the service does
    warmup_required: int = 10
    warn_k: float = 2.5
    crit_k: float = 5.0
    sustained_warn_s: int = 600
    sustained_crit_s: int = 900
    silence_s: int = 120
    cascade_window_s: int = 300
    cascade_min_services: int = 3
    novel_ttl_s: int = 86_400
    # None: observations are event-time windows. A name: that column's batches.
    batch_col: str | None = None
    # True puts the triggering source's service on SUSTAINED and CASCADE alerts.
    carry_service: bool = False

    @property
    def cell_s(self) -> int:
        """Length of the time cells in which rows of one key are ordered.

        A cell holds at most 4096 windows of a source. Batches can come at any
        rate, so their cells are short.
        """
        return 60 if self.batch_col else 4096 * self.window_s
