"""The task queue as a Structured Streaming query.

``applyInPandasWithState`` keeps one small state a task (key: task_id), so claims and
completions of a task meet in one place. For each field the state holds the newest event
that set it, so events may come late and in any order: the result of draining all of them
equals the batch fold. ``run_provider`` and ``run_tasks`` run a provider on claimed tasks; the
loop around them is in ``streaming.worker``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagewright.operators.queue import STATUS

#: The fields that the newest event of a kind decides, and the events that set each.
_FIELDS = {"last": (None, ("event", "job_id", "kind", "error")), "worker": (("claimed", "completed", "failed"), ("worker_id",)), "done": (("completed",), ("result",))}
_STATE = (
    "last_ts double, last_seq long, event string, job_id string, kind string, error string, worker_ts double, worker_seq long, worker_id string, "
    "done_ts double, done_seq long, result string, created double, leased double, events long"
)
_NAMES = [c.split(" ")[0] for c in _STATE.split(", ")]
OUTPUT = "task_id string, job_id string, kind string, status string, created_at timestamp, leased_at timestamp, worker_id string, result string, error string, events long"


def _none(x):
    return None if x is None or x != x else x


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, keep_ms: int | None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    s = dict(zip(_NAMES, state.get)) if state.exists else dict.fromkeys(_NAMES) | {"events": 0}
    for frame in frames:
        s["events"] += len(frame)
        for name, (events, fields) in _FIELDS.items():
            rows = frame if events is None else frame[frame["event"].isin(events)]
            if len(rows):
                r = rows.sort_values(["ts", "seq"]).iloc[-1]
                at = (float(r["ts"]), int(r["seq"]))
                if s[f"{name}_ts"] is None or at >= (s[f"{name}_ts"], s[f"{name}_seq"]):
                    s |= {f"{name}_ts": at[0], f"{name}_seq": at[1]} | {f: _none(r[f]) for f in fields}
        for field, event, pick in (("created", "created", min), ("leased", "claimed", max)):
            at = frame["ts"][frame["event"] == event]
            if len(at):
                t = float(at.min() if pick is min else at.max())
                s[field] = t if s[field] is None else pick(s[field], t)
    status = STATUS[s["event"]]
    state.update(tuple(s[n] for n in _NAMES))
    if keep_ms is not None and status in ("completed", "failed"):
        state.setTimeoutDuration(keep_ms)
    error = s["error"][:4000] if status == "failed" and s["error"] else None
    when = lambda t: None if t is None else pd.Timestamp(round(t * 1e6), unit="us")
    yield pd.DataFrame([[key[0], s["job_id"], s["kind"], status, when(s["created"]), when(s["leased"]), s["worker_id"], s["result"], error, s["events"]]], columns=[c.split(" ")[0] for c in OUTPUT.split(", ")])


def fold_stream(events: DataFrame, keep_seconds: float | None = None) -> DataFrame:
    """Events (task_id, job_id, kind, ts, seq, event, worker_id, result, error) as a stream ->
    the state of each task that changed, in update mode. With ``keep_seconds`` the state of
    an ended task goes after so long without an event; later ones then start afresh. Such a
    query needs a processing-time trigger: while it waits for timeouts it always has another
    batch to run, so that one for the available data would not end."""
    keep = None if keep_seconds is None else max(1, int(keep_seconds * 1000))
    e = events.select("task_id", "job_id", "kind", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("seq").cast("long").alias("seq"), "event", "worker_id", "result", "error")
    timeout = GroupStateTimeout.NoTimeout if keep is None else GroupStateTimeout.ProcessingTimeTimeout
    return e.groupBy("task_id").applyInPandasWithState(lambda k, f, s: _step(k, f, s, keep), OUTPUT, _STATE, "update", timeout)


OUTCOME = "task_id string, event string, worker_id string, result string, error string"


def run_provider(claimed: DataFrame, provider: Callable[[list[dict]], list], worker_id: str) -> DataFrame:
    """Claimed tasks -> outcome events; a provider failure fails every task of its batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tasks = b.to_dict("records")
            try:
                results, error = provider(tasks), None
                if len(results) != len(tasks):
                    raise ValueError(f"{len(results)} results for {len(tasks)} tasks")
            except Exception as e:  # noqa: BLE001  whatever a provider raises
                results, error = [None] * len(tasks), str(e)[:4000]
            yield pd.DataFrame({"task_id": b["task_id"], "event": "failed" if error is not None else "completed", "worker_id": worker_id, "result": results, "error": error})

    return claimed.mapInPandas(run, OUTCOME)


def run_tasks(claimed: DataFrame, call: Callable[[dict], str], worker_id: str, timeout_seconds: float | None = 120.0, concurrency: int = 1) -> DataFrame:
    """Claimed tasks -> outcome events, one call each, at most ``concurrency`` at a time in a
    worker. A call that takes longer than the timeout (none or 0: no limit) fails its task, as
    does one that raises; the others go on."""
    limit = timeout_seconds if timeout_seconds is not None and timeout_seconds > 0 else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(task: dict) -> dict:
            alone = ThreadPoolExecutor(1)
            try:
                return {"event": "completed", "result": alone.submit(call, task).result(limit), "error": None}
            except Late:
                return {"event": "failed", "result": None, "error": f"VLM crop parse timed out after {limit:g}s"}  # fixed text
            except Exception as e:  # noqa: BLE001  whatever a provider raises
                return {"event": "failed", "result": None, "error": str(e)[:4000]}
            finally:
                alone.shutdown(wait=False, cancel_futures=True)

        with ThreadPoolExecutor(max(1, concurrency)) as pool:
            for b in batches:
                out = pd.DataFrame(list(pool.map(one, b.to_dict("records"))), columns=["event", "result", "error"])
                yield pd.DataFrame({"task_id": b["task_id"].to_numpy(), "event": out["event"], "worker_id": worker_id, "result": out["result"], "error": out["error"]})

    return claimed.mapInPandas(run, OUTCOME)


def debounce(requests: DataFrame, cooldown_seconds: float) -> DataFrame:
    """Cleanup requests (ts) -> whether each one runs: not within the cooldown of the last
    one that ran in the same group. A request without a time runs and delays none; the
    times of a group are folded in one place."""
    from pyspark.sql import Window

    cooldown = int(cooldown_seconds * 1e6)

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame, runs, last = frame.sort_values("_n"), [], None
        for t in frame["_t"]:
            runs.append(bool(pd.isna(t) or last is None or t - last >= cooldown))
            last = t if runs[-1] and not pd.isna(t) else last
        return frame[["group", "_n"]].assign(runs=runs)

    w = Window.partitionBy("group").orderBy("ts")
    numbered = requests.withColumns({"_t": F.unix_micros(F.col("ts").cast("timestamp")), "_n": F.row_number().over(w)})
    group = requests.schema["group"].dataType.simpleString()
    ran = numbered.select("group", "_n", "_t").groupBy("group").applyInPandas(fold, f"group {group}, _n int, runs boolean")
    ran = ran.select(F.col("group").alias("_g"), F.col("_n").alias("_m"), "runs")
    return numbered.join(ran, F.col("group").eqNullSafe(F.col("_g")) & (F.col("_n") == F.col("_m"))).select(*requests.columns, "runs")
