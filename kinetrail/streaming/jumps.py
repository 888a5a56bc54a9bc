"""Jumps and gap filling on unbounded streams of assignments.

The batch forms are windows over a particle's whole series; here each particle
keeps three numbers of state (last known site, its frame, last jump frame) and
rows are taken in frame order.  Rows of a particle have to arrive in order
across batches, as trajectory writers emit them; within a batch they are
sorted.  Late rows, at or before a frame already taken, are dropped and
counted out by the ``late`` flag of the output.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "frame long, mobile long, site int, from_site int, jumped boolean, lag long, late boolean"
STATE = "last_known int, last_frame long, last_jump long, known_frame long"


def stream_jumps(assign: DataFrame, frame_threshold: int = 0) -> DataFrame:
    """Each row with its filled site, whether it is a jump (unknowns looked through), from where and after how long.

    The first *frame_threshold* frames of an unknown run take the last known
    site.  *assign*: a stream of (frame, mobile, site).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seen, jumped_at, known_at = state.get if state.exists else (-1, -1, -1, -1)
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        out = []
        for frame, site in pd.concat(parts).sort_values("frame")[["frame", "site"]].itertuples(index=False):
            if frame <= seen:
                out.append((frame, key[0], site, last, False, None, True))
                continue
            before, jump, lag = last, False, None
            if site >= 0:
                jump = frame > 0 and site != last
                if jump and last >= 0:
                    lag, jumped_at = frame - jumped_at, frame
                last, known_at = site, frame
            elif frame - known_at - 1 < frame_threshold:
                site = last
            seen = frame
            out.append((frame, key[0], site, before, jump, lag, False))
        state.update((int(last), int(seen), int(jumped_at), int(known_at)))
        yield pd.DataFrame(out, columns=["frame", "mobile", "site", "from_site", "jumped", "lag", "late"]).astype({"lag": "Int64"})

    return assign.select("frame", "mobile", "site").groupBy("mobile").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
