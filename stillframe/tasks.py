"""Asynchronous imports: a bounded pool on the driver, a status per task, finished tasks forgotten past a limit."""

from __future__ import annotations

import itertools
import os
import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from .errors import InvalidArgument, NotFound


class Imports:
    def __init__(self, workers: int | None = None, queue: int = 100, remember: int = 200):
        workers = workers or max(2, os.cpu_count() or 2)
        self.pool = ThreadPoolExecutor(workers)
        self.limit, self.remember = workers + queue, remember
        self.tasks: dict[str, dict] = {}
        self.numbers = itertools.count(1)
        self.lock = threading.Lock()

    def submit(self, work: Callable[[], object]) -> str:
        """Start work() when a worker is free; returns its id. A full queue refuses."""
        with self.lock:
            if sum(t["status"] == "RUNNING" for t in self.tasks.values()) >= self.limit:
                raise InvalidArgument("too many imports are waiting")
            if len(self.tasks) >= self.remember:
                self.tasks = {k: t for k, t in self.tasks.items() if t["status"] == "RUNNING"}
            name = f"import-{next(self.numbers)}"
            self.tasks[name] = {"status": "RUNNING", "result": None, "error": None}
            task = self.tasks[name]

        def run() -> None:
            try:
                task["result"] = work()
                task["status"] = "SUCCESS"
            except Exception as e:
                task["error"] = str(e)
                task["status"] = "FAILED"

        self.pool.submit(run)
        return name

    def status(self, name: str) -> dict:
        with self.lock:
            if name not in self.tasks:
                raise NotFound(f"no import {name}")
            return dict(self.tasks[name])

    def close(self) -> None:
        self.pool.shutdown(wait=True)
