"""Stateful operators over a stream of calls, keyed by session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A session's delivered ids are forgotten beyond so many; an idle session's state goes after so many milliseconds. With idle_ms=None state stays: timeouts make a query run batches without data for ever, which a query that is to end with its input can't have.
MOST_DELIVERED, IDLE_MS = 20_000, 60 * 60 * 1000


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def drop_delivered(chunks: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Rows (session_id, seq, ord, id) of chunks that their session has not had: state is the set of delivered ids.

    Within a micro-batch rows go by seq, then ord. A session with more than MOST_DELIVERED ids begins anew; idle ones
    time out.
    """

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = set(state.get[0]) if state.exists else set()
        fresh = []
        for r in pd.concat(list(rows)).sort_values(["seq", "ord"]).itertuples(index=False):
            if r.id not in seen:
                seen.add(r.id)
                fresh.append((key[0], r.seq, r.ord, r.id))
        if len(seen) > MOST_DELIVERED:
            seen = set()
        state.update((sorted(seen),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(fresh, columns=["session_id", "seq", "ord", "id"])

    return chunks.select("session_id", "seq", "ord", "id").groupBy("session_id").applyInPandasWithState(run, "session_id string, seq long, ord int, id string", "ids array<string>", "append", _timeout(idle_ms))


def share(used: float, limit: float, least: float = 0.3) -> float:
    """Share of the budget that a session still gets: all up to half its limit, then falling to ``least``."""
    usage = used / limit
    return 1.0 if usage <= 0.5 else max(least, 1 - (usage - 0.5) / 0.5 * (1 - least))


def adaptive_budgets(calls: DataFrame, limit: int, budget: int, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Rows (session_id, seq, effective_budget, used) from calls (session_id, seq, tokens): each call's budget depends on what the session's earlier calls delivered, which depends on theirs.

    A call of at least its budget delivers its budget, a smaller one all its tokens. ``used`` is kept as state.
    """

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            now = int(budget * share(used, limit) + 0.5)
            used += min(int(r.tokens), now)
            out.append((key[0], r.seq, now, used))
        state.update((used,))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["session_id", "seq", "effective_budget", "used"])

    return calls.select("session_id", "seq", "tokens").groupBy("session_id").applyInPandasWithState(run, "session_id string, seq long, effective_budget long, used long", "used long", "append", _timeout(idle_ms))


def sink_traces(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream of traces to a Parquet table, each id once: rows that the table has are left out of each micro-batch."""

    def write(batch: DataFrame, _: int) -> None:
        from ..sources.tables import append_traces

        append_traces(batch, path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
