"""The hybrid logical clock and peer ids, on the driver: one timestamp for each commit."""

from __future__ import annotations

import secrets
import threading
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codec import MAX_U32

#: A timestamp is unix milliseconds whose low eight bits count within their window of 256 ms.
LOW = 0xFF


class Clock:
    def __init__(self, now=lambda: int(time.time() * 1000)):
        self._now, self._last, self._lock = now, 0, threading.Lock()

    def next(self) -> int:
        """Later than every timestamp given or seen before, and no earlier than the wall clock's window."""
        with self._lock:
            self._last = max(self._now() & ~LOW, self._last) + 1
            return self._last

    def sync(self, seen: int) -> int:
        """Takes note of a remote timestamp; returns the last one before."""
        with self._lock:
            last, self._last = self._last, max(self._last, seen)
            return last


def check_pid(pid: int) -> int:
    if not 1 <= pid <= MAX_U32:
        raise ValueError(f"peer id {pid} is not in 1..{MAX_U32}")
    return pid


def new_pid() -> int:
    return secrets.randbelow(MAX_U32) + 1


def show_pid(pid: int) -> str:
    return f"{check_pid(pid):x}"


def show_pid_col(pid: Column) -> Column:
    return F.lower(F.hex(pid.cast("long")))


def read_pid_col(text: Column) -> Column:
    """The peer id of its hex text; null if it is none."""
    pid = F.conv(F.when(text.rlike("^[0-9A-Fa-f]{1,8}$"), text), 16, 10).cast("long")
    return F.when(pid > 0, pid)


def hlc_of(ts: Column) -> Column:
    """Milliseconds of a timestamp, truncated, with the low bits cleared."""
    return F.unix_millis(ts.cast("timestamp")).bitwiseAND(F.lit(~LOW).cast("long"))


def time_of(hlc: Column) -> Column:
    return F.timestamp_millis(hlc)


def show_hlc(hlc: Column) -> Column:
    """ISO-8601 in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_millis(hlc), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
