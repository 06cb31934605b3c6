"""Results that build up while evidence streams in: keyed state, late evidence, and snapshots without repeats."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from siltstone.functions.vocabulary import RESULTS, THRESHOLD
from siltstone.operators.results import merge_evidence

#: Seconds between two events, of results and of progress.
RESULTS_EVERY, PROGRESS_EVERY = 0.12, 0.2
EVIDENCE = "path string, seq long, probability double, score double"


class Snapshots:
    """For ``foreachBatch`` over merged evidence: emits the top hits, leaving ``hits`` out of an event while they did not
    change, and nothing at all sooner than ``every`` seconds after the last event; ``flush`` emits what was held back.

    It keeps the last event only.  A batch that is run again gives the same hits."""

    def __init__(self, emit: Callable[[dict], None], limit: int = RESULTS, every: float = 0.0, clock: Callable[[], float] = time.monotonic):
        self.emit, self.limit, self.every, self.clock = emit, limit, every, clock
        self.last, self.held, self.at = None, None, float("-inf")

    def __call__(self, merged: DataFrame, number: int) -> None:
        # Counted on the way, so that the batch is computed once.
        counts = Observation()
        verified = F.col("probability").isNotNull()
        seen = merged.observe(counts, F.count_if(verified).alias("verified"), F.count_if(~verified).alias("unverified"))
        best = seen.orderBy(F.desc(verified), F.desc(F.coalesce("probability", "score")), "path").limit(self.limit)
        rows = [r.asDict() for r in best.collect()]  # at most ``limit``
        found = counts.get
        self.held = ({"type": "results", "batch": number, "matchCount": found["verified"] + found["unverified"], **found}, rows)
        if self.clock() - self.at >= self.every:
            self.flush()

    def flush(self, force: bool = False) -> None:
        """Emits the event held back, if there is one; with ``force`` its hits even if they are the last ones."""
        if self.held is None:
            return
        event, rows = self.held
        self.held, self.at = None, self.clock()
        if force or rows != self.last:
            event, self.last = event | {"hits": rows}, rows
        self.emit(event)


def publish(evidence: DataFrame, snapshots: Snapshots, checkpoint: str, threshold: float = THRESHOLD, **trigger) -> StreamingQuery:
    """Starts the query: the state store keeps the last verdict and the last local evidence of each path, changes of which
    are written as deltas, and every batch hands all hits to ``snapshots``.  ``evidence`` has the columns EVIDENCE."""
    merged = merge_evidence(evidence.select("path", "seq", "probability", "score"), threshold)
    return merged.writeStream.outputMode("complete").foreachBatch(snapshots).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


class Progress(StreamingQueryListener):
    """Emits rows read so far, at most every PROGRESS_EVERY seconds."""

    def __init__(self, emit: Callable[[dict], None], every: float = PROGRESS_EVERY):
        self.emit, self.every, self.rows, self.at = emit, every, 0, float("-inf")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        if time.monotonic() - self.at >= self.every:
            self.at = time.monotonic()
            self.emit({"type": "progress", "scanned": self.rows})

    def onQueryTerminated(self, event) -> None:
        self.emit({"type": "progress", "scanned": self.rows})


def json_lines(write: Callable[[str], None], search: str | None = None) -> Callable[[dict], None]:
    """A sink of one ASCII JSON object a line, with the search's id if given; NaN is refused."""
    tag = {} if search is None else {"searchId": search}
    return lambda event: write(json.dumps(event | tag, allow_nan=False, ensure_ascii=True) + "\n")
