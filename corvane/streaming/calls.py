"""The call limiter: a sliding window in which denied calls don't count, in batch and as a stream."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW_US = 60_000_000
OUT = "call_id long, allowed boolean, retry_after int"


def decide(times: dict[str, list[int]], now: int, tool: str, limits: dict[str, int]) -> tuple[bool, int | None]:
    """One call of one user; `times` holds the counted calls of each scope and is brought up to date.

    A call is counted, in all its scopes, only if all of them have room. Else: seconds until the first full scope has.
    """
    scopes = [s for s in ("*", tool) if s in limits]
    for s in scopes:
        times[s] = [t for t in times.get(s, []) if t > now - WINDOW_US]
    full = [times[s] for s in scopes if len(times[s]) >= limits[s]]
    if full:
        wait = full[0][0] + WINDOW_US - now if full[0] else WINDOW_US
        return False, max(1, math.ceil(wait / 1e6))
    for s in scopes:
        times[s].append(now)
    return True, None


def limit_calls(calls: DataFrame, limits: dict[str, int], user: str = "user_id", at_us: str = "us", tool: str = "tool", call: str = "call_id") -> DataFrame:
    """Decisions on all calls, in order of time and call.

    After a pause of a whole window nothing is left to remember, so each burst between pauses is dealt
    out on its own, and read in order: a task remembers the calls of one window, never a user's history.
    """
    w = Window.partitionBy(user).orderBy(at_us, call)
    paused = (F.col(at_us) - F.lag(at_us).over(w) >= WINDOW_US).cast("int")
    bursts = calls.select(F.col(user).alias("u"), F.col(at_us).alias("us"), F.col(tool).alias("tool"), F.col(call).alias("call_id"), F.sum(F.coalesce(paused, F.lit(0))).over(w).alias("burst"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, times = None, {}
        for f in frames:
            got = []
            for u, burst, us, t in zip(f["u"], f["burst"], f["us"], f["tool"]):
                if (u, burst) != last:
                    last, times = (u, burst), {}
                got.append(decide(times, us, t, limits))
            yield pd.DataFrame({"call_id": f["call_id"], "allowed": [g[0] for g in got], "retry_after": pd.array([g[1] for g in got], dtype="Int32")})

    return bursts.repartition("u", "burst").sortWithinPartitions("u", "burst", "us", "call_id").mapInPandas(run, OUT)


def limit_stream(calls: DataFrame, limits: dict[str, int], user: str = "user_id") -> DataFrame:
    """The same on a stream of (call_id, user_id, tool, us). Calls of a trigger are taken in order of time.

    A user's state goes after a window without calls.
    """
    scopes = sorted(limits)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = dict(zip(scopes, [list(x) for x in state.get[0]])) if state.exists else {}
        group = pd.concat(list(frames)).sort_values(["us", "call_id"])
        got = [decide(times, int(us), t, limits) for us, t in zip(group["us"], group["tool"])]
        state.update(([times.get(s, []) for s in scopes],))
        state.setTimeoutDuration(WINDOW_US // 1000)
        yield pd.DataFrame({"call_id": group["call_id"], "allowed": [g[0] for g in got], "retry_after": pd.array([g[1] for g in got], dtype="Int32")})

    return calls.groupBy(user).applyInPandasWithState(run, OUT, "times array<array<long>>", "append", GroupStateTimeout.ProcessingTimeTimeout)
