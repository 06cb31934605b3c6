"""Searches by request: one JSON object a line asks for a search, cancels it or ends the session."""

from __future__ import annotations

import json
import os
import threading
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from siltstone.operators.judge import Judge
from siltstone.plans.search import Options, Stopped, search

# The longest query and request.
QUERY, REQUEST = 2_000, 64 << 10


def parsed(line: str) -> dict:
    """A request, checked: type (search, cancel or shutdown), and of a search id, root, query and options."""
    if len(line.encode()) > REQUEST:
        raise ValueError("the request is too large")
    given = json.loads(line)
    if not isinstance(given, dict) or given.get("type") not in ("search", "cancel", "shutdown"):
        raise ValueError("not a request")
    if given["type"] == "search":
        given["query"] = str(given.get("query") or "").strip()[:QUERY]
        given["id"] = str(given.get("id") or uuid.uuid4())
        options = given.get("options") or {}
        given["options"] = Options(**{k: v for k, v in options.items() if k in Options.__dataclass_fields__})
    return given


def credential(variable: str, file: str | None = None) -> str | None:
    """A key from the environment, else from a file; it is kept in memory only."""
    if key := os.environ.get(variable, "").strip():
        return key
    if file and os.path.isfile(file):
        with open(file, encoding="utf-8") as source:
            return source.read().strip() or None
    return None


class Session:
    """``handle`` takes requests.  A new search cancels the one before, whose jobs end and which emits no more results
    but its last event.  Events carry the search's id; phases are scanning, then complete, partial, stopped or error."""

    def __init__(self, spark: SparkSession, emit: Callable[[dict], None], judge: Callable[[], Judge | None] = lambda: None):
        self.spark, self.emit, self.judge = spark, emit, judge
        self.stop, self.thread, self.group, self.open = threading.Event(), None, None, True

    def handle(self, line: str) -> None:
        request = parsed(line)
        if request["type"] == "search" and not request["query"]:
            return
        self.cancel()
        if request["type"] == "shutdown":
            self.open = False
        if request["type"] == "search" and self.open:
            self.stop, self.group = threading.Event(), request["id"]
            self.thread = InheritableThread(target=self._run, args=(request, self.stop), daemon=True)
            self.thread.start()

    def cancel(self) -> None:
        """Ends the search that runs, and waits for its last event."""
        if self.thread is None:
            return
        self.stop.set()
        while self.thread.is_alive():
            self.spark.sparkContext.cancelJobGroup(self.group)
            self.thread.join(0.1)
        self.thread = None

    def wait(self) -> None:
        if self.thread is not None:
            self.thread.join()

    def _run(self, request: dict, stop: threading.Event) -> None:
        stats: dict = {}
        judge = self.judge()

        def say(phase: str, **more) -> None:
            known = stats | (judge.stats if judge else {})
            self.emit({"type": "results", "searchId": request["id"], "phase": phase, "stats": known, **more})

        self.spark.sparkContext.setJobGroup(request["id"], "search", True)
        say("scanning")
        try:
            hits, phase = search(self.spark, request["root"], request["query"], request["options"], judge, stats, stop)
            rows = [r.asDict() for r in hits.collect()]  # at most RESULTS
            say("stopped" if stop.is_set() else phase, hits=rows, matchCount=len(rows))
        except Exception as error:  # the session goes on, whatever became of one search
            stopped = stop.is_set() or isinstance(error, Stopped)
            say("stopped" if stopped else "error", message="" if stopped else str(error).splitlines()[0][:200])
