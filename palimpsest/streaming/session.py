"""Keyed viewer sessions: late answers are told by generation, not by time.

``step`` is one pure transition. It runs on a stream through
``applyInPandasWithState``, and over a finished table by session.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from palimpsest.operators.integrity import EngineError

OUTPUT = "session string, seq long, type string, requested string, displayed string, generation long, token long, status string, error string, warning string, rejected string, commands string"


@dataclass
class State:
    """Nothing is on screen until tiles have come, so a session starts by loading its first edition."""

    requested: str
    displayed: str | None = None
    generation: int = 0
    token: int = 0
    status: str = "loading"
    error: str | None = None
    warning: str | None = None
    reloads: dict[str, int] = field(default_factory=dict)
    resets: int = 0
    rejected: str | None = None  # why the last event was refused


def opening(editions: list[str], initial: str | None = None) -> State:
    """State before any event; an initial edition outside the order is an error."""
    if not editions or (initial is not None and initial not in editions):
        raise EngineError("session", f"the initial edition {initial} is not in the order" if editions else "there are no editions")
    return State(initial or editions[0])


def _select(s: State, edition: str) -> list[str]:
    if edition == s.requested and s.status == "displayed":
        return []
    left = s.requested if s.requested not in (edition, s.displayed) else None
    shown = edition == s.displayed
    s.requested, s.error, s.status = edition, None, "displayed" if shown else "loading"
    s.generation += 1
    return [f"hide:{left}"] * (left is not None) + [f"show:{edition}"] * (not shown)


def _retry(s: State) -> list[str]:
    edition, shown, out = s.requested, s.requested == s.displayed, []
    if not shown or s.warning is not None:
        s.reloads[edition] = s.reloads.get(edition, 0) + 1
        out = [f"reload:{edition}:{s.reloads[edition]}"] + [f"show:{edition}"] * (not shown)
    if shown:
        s.warning = None  # the tiles are asked for again
    s.generation += 1
    s.status, s.error = "displayed" if shown else "loading", None
    return out


def _current(s: State, event: dict) -> bool:
    """The answer is to the open request, seen from where the camera is; unstamped answers are."""
    return event.get("generation") in (None, s.generation) and event.get("viewport_token") in (None, s.token)


def step(s: State, event: dict, editions: list[str]) -> list[str]:
    """Change the state by one event; the commands for the map come back in order.

    An unknown edition is refused: ``rejected`` says why and nothing else changes,
    so that one bad event does not end a stream. A warning stays through moves and
    further selections until another edition is shown or the shown one is retried.
    """
    kind, edition = event["type"], event.get("edition_id")
    s.rejected = None
    if kind == "select":
        if edition in editions:
            return _select(s, edition)
        s.rejected = f"unknown edition {edition}"
    elif kind in ("previous", "next"):
        to = editions.index(s.requested) + (1 if kind == "next" else -1)
        if 0 <= to < len(editions):
            return _select(s, editions[to])
    elif kind == "retry":
        return _retry(s)
    elif kind == "reset":
        s.resets += 1
        return ["camera:reset"]
    elif kind in ("movestart", "zoomstart"):
        s.token += 1
    elif kind == "idle":
        if s.status == "loading" and event.get("source_loaded") and _current(s, event):
            old, s.displayed, s.status, s.error, s.warning = s.displayed, s.requested, "displayed", None, None
            return [] if old == s.displayed else [f"reveal:{s.displayed}"] + [f"hide:{old}"] * (old is not None)
    elif kind == "error":
        source, message = event.get("source_id"), event.get("message") or "tile request failed"
        if s.status == "loading" and source in (None, s.requested):
            if event.get("generation") in (None, s.generation):
                s.status, s.error = "error", message
        elif source is not None and source == s.displayed:
            s.warning = message
    return []


def _row(session: str, event: dict, s: State, commands: list[str]) -> tuple:
    return (session, event["seq"], event["type"], s.requested, s.displayed, s.generation, s.token, s.status, s.error, s.warning, s.rejected, " ".join(commands))


_NAMES = [f.split()[0] for f in OUTPUT.split(", ")]


def _clean(frame: pd.DataFrame) -> list[dict]:
    rows = frame.astype(object).where(frame.notna(), None).to_dict("records")
    return sorted(rows, key=lambda e: e["seq"])


def replay(events: DataFrame, editions: list[str], initial: str | None = None) -> DataFrame:
    """State after every event of a finished table."""
    opening(editions, initial)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        s, out = opening(editions, initial), []
        for e in _clean(frame):
            commands = step(s, e, editions)
            out.append(_row(key[0], e, s, commands))
        return pd.DataFrame(out, columns=_NAMES)

    return events.groupBy("session").applyInPandas(run, OUTPUT)


def stream(events: DataFrame, editions: list[str], initial: str | None = None) -> DataFrame:
    """State after every event of a stream; nothing expires by time."""
    opening(editions, initial)

    def run(key, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        s = State(**json.loads(held.get[0])) if held.exists else opening(editions, initial)
        whole = pd.concat(list(frames))  # a session's events of one batch, put in order before any is applied
        out = []
        for e in _clean(whole):
            commands = step(s, e, editions)
            out.append(_row(key[0], e, s, commands))
        held.update((json.dumps(asdict(s)),))
        yield pd.DataFrame(out, columns=_NAMES)

    return events.groupBy("session").applyInPandasWithState(run, OUTPUT, "state string", "append", "NoTimeout")


def ledger_stream(receipts: DataFrame, path: str, keys: list[str], payload: str, checkpoint: str):
    """Append receipts once: a batch that contradicts the ledger fails and changes nothing."""
    from palimpsest.operators.ledger import append_once

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            ledger = spark.read.schema(batch.schema).parquet(path)
            ledger.limit(1).count()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            ledger = spark.createDataFrame([], batch.schema)
        append_once(ledger, batch, keys, payload).write.mode("append").parquet(path)

    return receipts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and type, with a watermark; for tables and streams alike."""
    from pyspark.sql import functions as F

    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
