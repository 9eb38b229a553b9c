"""Framed streams: sequence, base-hash and completion checks with state for each stream.

The state of a stream is its last sequence number, the hash of its document and whether it ended.
Frames of a micro-batch are put in order before they are judged.  ``classify_frames`` is the
streaming form; on a batch it gives what replaying the frames in order gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "sid long, pos long, seq long, status string"
STATE = "last long, ended boolean, state_hash string"


def judge(last: int | None, ended: bool, state_hash: str | None, seq: int, base: str | None) -> str:
    """first, ok, duplicate, gap, base_mismatch or after_final for a frame of a stream."""
    if ended:
        return "after_final"
    if last is not None and seq <= last:
        return "duplicate"
    if base is not None and state_hash is not None and base != state_hash:
        return "base_mismatch"
    if last is None:
        return "first"
    return "gap" if seq > last + 1 else "ok"


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, ended, state_hash = state.get if state.exists else (None, False, None)
    if last is not None and last < 0:
        last = None
    whole = pd.concat(list(frames), ignore_index=True).sort_values("pos", kind="stable")
    out = []
    for row in whole.itertuples(index=False):
        base = getattr(row, "base_hash", None)
        status = judge(last, ended, state_hash, int(row.seq), base if isinstance(base, str) else None)
        if status in ("first", "ok", "gap"):
            last = int(row.seq)
            new = getattr(row, "state_hash", None)
            state_hash = new if isinstance(new, str) else state_hash
            ended = ended or bool(getattr(row, "is_final", False))
        out.append((int(key[0]), int(row.pos), int(row.seq), status))
    state.update((-1 if last is None else last, bool(ended), state_hash))
    yield pd.DataFrame(out, columns=["sid", "pos", "seq", "status"])


def classify_frames(frames: DataFrame) -> DataFrame:
    """(sid, pos, seq, status) of a stream of frames (sid, pos, seq[, base_hash, state_hash, is_final])."""
    return frames.groupBy("sid").applyInPandasWithState(_update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
