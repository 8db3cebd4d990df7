"""Row counts of a query, from Spark's own progress reports: no extra pass over a batch."""

from __future__ import annotations

import json
import logging
import threading

from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

log = logging.getLogger(__name__)

# The name under which a query observes the rows it hands to its table.
WRITTEN = "written"


def batch_counts(report: dict) -> dict[str, int]:
    """Counts of one batch, from its progress report.

    Late rows are counted after the partial aggregation, so several late rows of one window and
    partition may count as one. The state of a query with dedup is not counted.
    """
    states = report.get("stateOperators", [])
    written = report.get("observedMetrics", {}).get(WRITTEN, {})
    return {
        "input_rows": report["numInputRows"],
        "written_rows": written.get("rows", 0),
        "late_rows": sum(s["numRowsDroppedByWatermark"] for s in states),
        "state_rows": sum(s["numRowsTotal"] for s in states),
    }


_SUMMED = ("input_rows", "written_rows", "late_rows")
# Runs whose sums are remembered; what has to last is in the tables (`LakeTable.batch_counts`).
RUNS = 100
# What BatchLog has seen of each run: its first and last batch, and the totals from the one to the other.
_seen: dict[str, tuple[int, int, dict[str, int]]] = {}
_lock = threading.Lock()


def _added(result: dict[str, int], counts: dict[str, int]) -> dict[str, int]:
    summed = {name: result[name] + counts[name] for name in _SUMMED}
    return {"batches": result["batches"] + 1, **summed, "state_rows": counts["state_rows"]}


def totals(query: StreamingQuery) -> dict[str, int]:
    """Counts over the batches of a query's run; state_rows are those of the last.

    All batches count that a `BatchLog` added before the run has seen; of the others those that Spark keeps
    (spark.sql.streaming.numRecentProgressUpdates, 100 by default).
    """
    none = dict.fromkeys(("batches", *_SUMMED, "state_rows"), 0)
    with _lock:
        first, last, sums = _seen.get(str(query.runId), (0, -1, none))
    recent = [json.loads(p.json) for p in query.recentProgress]
    result = none
    for report in recent:
        if report["batchId"] < first:
            result = _added(result, batch_counts(report))
    result = {name: result[name] + sums[name] for name in none} | {"state_rows": sums["state_rows"]}
    for report in recent:
        if report["batchId"] > last and report["batchId"] >= first:
            result = _added(result, batch_counts(report))
    return result


class BatchLog(StreamingQueryListener):
    """Logs one line per batch and sums the counts for `totals`; add it with spark.streams.addListener."""

    def onQueryStarted(self, event) -> None:
        log.info("%s: started", event.name)

    def onQueryProgress(self, event) -> None:
        report = json.loads(event.progress.json)
        counts = batch_counts(report)
        run, batch = str(event.progress.runId), report["batchId"]
        with _lock:
            first, last, sums = _seen.get(run, (batch, -1, dict.fromkeys(("batches", *_SUMMED, "state_rows"), 0)))
            if batch > last:  # a second log sees each batch again
                _seen.pop(run, None)
                _seen[run] = (first, batch, _added(sums, counts))
                while len(_seen) > RUNS:  # those that have been silent longest
                    del _seen[next(iter(_seen))]
        text = ", ".join(f"{name} {value}" for name, value in counts.items())
        log.info("%s: batch %d, %s", event.progress.name, event.progress.batchId, text)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        log.info("query %s: ended%s", event.id, f", {event.exception}" if event.exception else "")
