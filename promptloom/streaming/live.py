"""Live analysis of prompts that are being edited: only an edit that nothing follows for a while is analysed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import score

#: How long an edit has to stand, in milliseconds of event time. Fixed value.
QUIET_MS = 120


def settled(pending: list[tuple[int, str]], quiet: int, watermark: int) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """(edits that stood, edits still open) of a prompt's edits (microseconds, text) in order: an edit is decided once the watermark has passed its quiet time."""
    stood, still = [], []
    for i, (at, text) in enumerate(pending):
        if at + quiet > watermark:
            still = pending[i:]
            break
        if i + 1 == len(pending) or pending[i + 1][0] - at >= quiet:
            stood.append((at, text))
    return stood, still


def debounce(edits: DataFrame, quiet_ms: int = QUIET_MS, late: str = "10 seconds") -> DataFrame:
    """Of a stream of edits (prompt_id, ts timestamp, text) those after which their prompt rests for ``quiet_ms`` of event time.

    Edits may come up to ``late`` out of order; later ones are dropped, as are rows without a prompt_id or a ts. Of
    edits with the same ts the last by text counts. A prompt's state is its open edits, those of the last ``late`` and
    quiet time at most, and goes when they are decided; a timer decides them when no further edit comes.
    """
    quiet = quiet_ms * 1000

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs() * 1000
        pending = list(zip(*state.get, strict=True)) if state.exists else []
        if not state.hasTimedOut:
            for frame in frames:
                pending += [(int(at), text) for at, text in zip(frame["at"], frame["text"], strict=True) if at >= watermark]
        pending = sorted(dict(sorted(pending, key=lambda e: (e[0], e[1] or ""))).items())
        stood, still = settled(pending, quiet, watermark)
        if still:
            state.update(([at for at, _ in still], [text for _, text in still]))
            state.setTimeoutTimestamp(max(-(-(still[0][0] + quiet) // 1000), watermark // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"prompt_id": [key[0]] * len(stood), "at": [at for at, _ in stood], "text": [text for _, text in stood]})

    rows = edits.where("prompt_id is not null and ts is not null").withWatermark("ts", late).select("prompt_id", "ts", F.unix_micros("ts").alias("at"), "text")
    kind = edits.schema["prompt_id"].dataType.simpleString()
    out = rows.groupBy("prompt_id").applyInPandasWithState(decide, f"prompt_id {kind}, at long, text string", "at array<long>, text array<string>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("prompt_id", F.timestamp_micros("at").alias("ts"), "text")


def analysing_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``guard.start`` that writes the analysis of the edits that stood; a batch that runs twice is there once."""

    def write(batch: DataFrame, number: int) -> None:
        score.analyze(batch).select("prompt_id", "ts", "tokens", "task_type", "composite", "tier").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
