"""Structured logs and profiles of the service's calls, as the settings ask for them."""

from __future__ import annotations

import cProfile
import json
import logging
import pstats
import sys
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from pathlib import Path

LOGGER = "quarry"
#: Lines of a profile, by cumulative time.
PROFILE_LINES = 60
_running = False
HANDLER = logging.StreamHandler(sys.stderr)


class _Lines(logging.Formatter):
    """One JSON object a line, or plain text when debugging."""

    def __init__(self, debug: bool):
        super().__init__()
        self.debug = debug

    def format(self, record: logging.LogRecord) -> str:
        at = datetime.fromtimestamp(record.created, UTC).isoformat()
        more = getattr(record, "fields", {})
        if self.debug:
            return " ".join([at, record.levelname.lower(), record.getMessage(), *(f"{k}={v!r}" for k, v in more.items())])
        return json.dumps({"timestamp": at, "level": record.levelname.lower(), "event": record.getMessage()} | more, default=str)


def logger(debug: bool = False) -> logging.Logger:
    """The service's logger on standard error; its level and form follow ``debug``."""
    log = logging.getLogger(LOGGER)
    log.addHandler(HANDLER)  # once, however often it is asked for
    log.propagate = False
    HANDLER.setFormatter(_Lines(debug))
    log.setLevel(logging.DEBUG if debug else logging.INFO)
    return log


def say(log: logging.Logger, event: str, level: int = logging.INFO, **fields) -> None:
    log.log(level, event, extra={"fields": fields})


@contextmanager
def profiled(name: str, enabled: bool, folder: str = "profiles") -> Iterator[None]:
    """With ``enabled``, a report of the driver's calls in ``folder``, written even if the call fails; a call within another is part of its report."""
    global _running
    if not enabled or _running:
        yield
        return
    profile, _running = cProfile.Profile(), True
    try:
        with profile:
            yield
    finally:
        _running = False
        Path(folder).mkdir(parents=True, exist_ok=True)
        with (Path(folder) / f"{name}-{datetime.now(UTC):%Y%m%dT%H%M%S}-{time.perf_counter_ns()}.txt").open("w") as out:
            pstats.Stats(profile, stream=out).sort_stats("cumulative").print_stats(PROFILE_LINES)
