"""Metrics of an import: what each batch counted on its way through, and how long batches took."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

c = F.col


def observed(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """df, and what is known of the counts once the first action on it has run; no pass of its own."""
    seen = Observation()
    return df.observe(seen, *(v.alias(k) for k, v in counts.items())), seen


def observed_matches(matched: DataFrame) -> tuple[DataFrame, Observation]:
    """The result of rides.match_pending with counts of matched and too short rides."""
    return observed(matched, matched=F.count_if(c("status") == "PENDING"), too_short=F.count_if(c("status") == "SKIPPED"), edges=F.sum(F.size("edge_ids")), most_edges=F.max(F.size("edge_ids")))


def match_rate(located: int, seen: Observation) -> float | None:
    """The share of rides that matched, in percent, of those that were given to match; null without any."""
    got = seen.get
    tried = located - got["too_short"]
    return round(100 * got["matched"] / tried, 1) if tried > 0 else None


@dataclass
class ImportMetrics:
    """Sums and maxima over the batches of an import."""

    batches: int = 0
    files: int = 0
    empty: int = 0  # files without a line
    without_points: int = 0
    points: int = 0
    most_points: int = 0
    incidents: int = 0
    failed_batches: int = 0
    seconds: float = 0.0
    slowest: float = 0.0

    def add(self, seconds: float, **counts: int | None) -> None:
        self.batches += 1
        self.seconds += seconds
        self.slowest = max(self.slowest, seconds)
        for k, v in counts.items():
            old = getattr(self, k)
            setattr(self, k, max(old, v or 0) if k.startswith("most") else old + (v or 0))

    def summary(self) -> dict[str, float | None]:
        """All of it, with points a file, seconds a batch and files a second; null where nothing was imported."""
        each = lambda a, b: round(a / b, 6) if b else None
        return asdict(self) | {"points_a_file": each(self.points, self.files - self.empty), "seconds_a_batch": each(self.seconds, self.batches), "files_a_second": each(self.files, self.seconds)}


class Progress(StreamingQueryListener):
    """Batches, rows read (each time that a batch reads them) and the longest batch of each running query, by its name or id; add it to spark.streams."""

    def __init__(self):
        self.queries: dict[str, dict[str, int]] = {}
        self.failed: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        own = self.queries.setdefault(p.name or str(p.id), {"batches": 0, "rows": 0, "longest_ms": 0})
        own["batches"] += 1
        own["rows"] += p.numInputRows
        own["longest_ms"] = max(own["longest_ms"], p.durationMs.get("triggerExecution", 0))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failed[str(event.id)] = event.exception
