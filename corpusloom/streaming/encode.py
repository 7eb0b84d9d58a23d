"""Encoding of texts that arrive in chunks, with Structured Streaming state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Characters always kept back: a contraction may still grow by two.
HELD = 2


def prefix(encoder, buffer: str, end: int) -> list[int]:
    """ids of the first ``end`` characters; an error if that parts a pretoken or a special token."""
    size, taken = 0, []
    for part in encoder.split(buffer):
        if size >= end:
            break
        size += len(part[0])
        taken.append(part)
    if size != end:
        raise ValueError(f"a prefix of {end} characters ends within a token")
    return encoder.parts(taken)


def flush(encoder, buffer: str) -> tuple[list[int], str]:
    """ids of the prefix that no further chunk can change, and the rest.

    Kept back: the last part, and as many characters as a special token may
    still need to be recognised.
    """
    keep = max([HELD, *(len(s) - 1 for s in encoder.specials)])
    parts = encoder.split(buffer)
    rest = 0
    while parts and (rest < keep or not rest):
        rest += len(parts.pop()[0])
    return encoder.parts(parts), buffer[len(buffer) - rest :]


def encode_stream(chunks: DataFrame, model) -> DataFrame:
    """(stream_id, batch, ids) of a stream of (stream_id, seq, chunk, last).

    A stream is one text, its chunks numbered from 0.  A chunk that comes early
    waits in the state for those before it, one that came already is left out, and
    one after ``last`` is an error.  The row with ``last`` ends the stream: it
    flushes and drops its state.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(model.encoder())

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, number, expected, early = state.get if state.exists else ("", 0, 0, "{}")
        waiting = {int(seq): tuple(x) for seq, x in json.loads(early).items()}
        for frame in frames:
            for seq, chunk, last in zip(frame["seq"].tolist(), frame["chunk"], frame["last"].tolist(), strict=True):
                if seq >= expected:
                    waiting[seq] = (chunk or "", bool(last))
        out: list[int] = []
        ended = False
        while not ended and expected in waiting:
            chunk, ended = waiting.pop(expected)
            expected += 1
            done, rest = flush(shared.value, rest + chunk)
            out += done
        if ended:
            if waiting:
                raise ValueError(f"stream {key[0]} goes on after its last chunk")
            out += shared.value.text(rest)
            if state.exists:
                state.remove()
        else:
            state.update((rest, number + 1, expected, json.dumps(waiting)))
        yield pd.DataFrame({"stream_id": [key[0]], "batch": [number], "ids": [out]})

    return chunks.groupBy("stream_id").applyInPandasWithState(
        step, "stream_id long, batch int, ids array<int>", "rest string, number int, expected int, early string", "append", GroupStateTimeout.NoTimeout
    )
