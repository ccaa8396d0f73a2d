"""Appending human decisions to a hash-chained log, from any number of writers at once. The query layer never imports this module.

A log is a file of lines, or a folder of segments for places without locks: a segment is a file named by the number of its
first line. Either way an entry is linked to the line that is really before it, so writers that race never fork the chain.
"""

from __future__ import annotations

import datetime
import fcntl
import hashlib
import json
import os
import tempfile
from collections.abc import Callable
from typing import BinaryIO

from ledgerloom.operators.decisions import ACTIONS, GENESIS

#: Bytes read at a time from a log's end.
TAIL = 1 << 16


class NotAHumanDecision(ValueError):
    """Only people decide."""


class TornLog(ValueError):
    """The last line was never finished: someone has to look before anything is linked to it."""


def _entry(seen: dict, action: str, actor: str, note: str, correction: str | None, state: str, why: str, now: datetime.datetime | None) -> Callable[[str], dict]:
    if actor != "human":
        raise NotAHumanDecision(f"{actor!r} can't decide")
    if action not in ACTIONS:
        raise ValueError(f"unknown action {action!r}")
    if action == "correct" and correction is None:
        raise ValueError("a correction needs a value")
    at = (now or datetime.datetime.now(datetime.timezone.utc)).isoformat()
    return lambda prev: {"schema": 1, "prev": prev, "at": at, "actor": actor, "action": action, "note": note, "correction": correction, "seen": seen, "state": state, "why": why}


def last_line(log: BinaryIO) -> bytes | None:
    """The last line of an open log, read from its end; None for an empty one."""
    end, kept = log.seek(0, os.SEEK_END), b""
    while end and b"\n" not in kept.rstrip(b"\n"):
        start = max(0, end - TAIL)
        log.seek(start)
        kept, end = log.read(end - start) + kept, start
    if kept and not kept.endswith(b"\n"):
        raise TornLog("the last line of the log has no end")
    return kept.rstrip(b"\n").rpartition(b"\n")[2] or None


def _digest(line: bytes | None) -> str:
    return GENESIS if line is None else hashlib.sha256(line).hexdigest()


def _shown(entry: dict) -> bytes:
    return json.dumps(entry, ensure_ascii=False).encode() + b"\n"


def record(path: str, seen: dict, action: str, *, actor: str, note: str = "", correction: str | None = None, state: str = "", why: str = "", now: datetime.datetime | None = None) -> dict:
    """Appends one decision to the log file, linked to the line before it, and forces it to disk.

    The file is locked from looking at its end to writing there; only the end is read, however long the log.
    """
    make = _entry(seen, action, actor, note, correction, state, why, now)
    with open(path, "a+b") as log:
        fcntl.flock(log, fcntl.LOCK_EX)
        entry = make(_digest(last_line(log)))
        log.write(_shown(entry))
        log.flush()
        os.fsync(log.fileno())
    return entry


def record_segment(folder: str, seen: dict, action: str, *, actor: str, note: str = "", correction: str | None = None, state: str = "", why: str = "", now: datetime.datetime | None = None) -> dict:
    """Appends one decision to a log of segments: a file of its own, which appears whole and only if its number is still free.

    A writer that finds the number taken links its decision to what took it and tries the next.
    """
    make = _entry(seen, action, actor, note, correction, state, why, now)
    os.makedirs(folder, exist_ok=True)
    while True:
        names = sorted(n for n in os.listdir(folder) if n.endswith(".jsonl") and not n.startswith("."))
        number, line = 1, None
        if names:
            with open(os.path.join(folder, names[-1]), "rb") as segment:
                lines = segment.read().split(b"\n")[:-1]
            number, line = int(names[-1].split(".")[0]) + len(lines), lines[-1]
        entry = make(_digest(line))
        with tempfile.NamedTemporaryFile(dir=folder, prefix=".", suffix=".tmp") as draft:
            draft.write(_shown(entry))
            draft.flush()
            os.fsync(draft.fileno())
            try:
                os.link(draft.name, os.path.join(folder, f"{number:012d}.jsonl"))
                return entry
            except FileExistsError:
                continue
