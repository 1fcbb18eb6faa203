"""Folds with keyed state: request pairing and policy verdicts of a stream of frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from ..functions.jsonvalue import text_at
from ..operators.events import classify_frames
from ..operators.policy import HOLD_SECONDS

#: Shards of the state of open requests, and pieces into which the sessions of a block are dealt.
SHARDS = 256


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind()) for name, kind in fields.items()])


def with_epoch(frames: DataFrame) -> DataFrame:
    return frames if "epoch" in frames.columns else frames.withColumn("epoch", F.lit(0).cast("bigint"))


# ---- pairing ------------------------------------------------------------------------------

_ID = _struct(session_id=StringType, epoch=LongType, space=StringType, id_key=StringType)
_OPEN = _struct(ord=LongType, seq=LongType, label=StringType, call=BooleanType)
_REQUEST = ["ord", "seq", "label", "call"]
STEPS = (
    "session_id string, epoch bigint, shard bigint, step string, ord bigint, seq bigint, role string, "
    "pair_space string, id_key string, label string, call boolean, opens boolean, "
    "before_ord bigint, before_seq bigint, before_label string, before_call boolean"
)
PAIRED = (
    "session_id string, epoch bigint, ord bigint, seq bigint, role string, responds_to string, "
    "answers_call boolean, request_ord bigint, request_seq bigint, orphaned boolean"
)


def _inside_blocks(shards: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Steps of the sessions of one piece of a block: answers that find the row before them in the
    block (done), answers that are the first of their group there (ask), and the last row of each
    group (tail)."""

    def steps(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("ord", kind="stable").reset_index(drop=True)
        groups = block.groupby(["session_id", "epoch", "pair_space", "id_key"], sort=False, dropna=False)
        before = groups[["opens", *_REQUEST]].shift(1)
        first, last = groups.cumcount() == 0, groups.cumcount(ascending=False) == 0
        open_before = before["opens"].eq(True)
        for name in _REQUEST:
            block[f"before_{name}"] = before[name].where(open_before)
        answers = ~block["opens"]
        done = block[answers & ~first].assign(step="done")
        # settled rows need no state and go anywhere
        done["shard"] = done["ord"] % shards
        ask = block[answers & first].assign(step="ask")
        # an answer that is alone in its block closes its group by asking
        tail = block[last & ~(answers & first)].assign(step="tail")
        made = pd.concat([done, ask, tail])[[c.split()[0] for c in STEPS.split(", ")]]
        return made.astype({"seq": "Int64", "before_ord": "Int64", "before_seq": "Int64", "before_call": "boolean"})

    return steps


def _pairing(idle_ms: int | None) -> Callable[[], StatefulProcessor]:
    class Pairing(StatefulProcessor):
        """Open requests of one shard, by session, initiator and id: the carry between the blocks
        of a session, and between batches."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.open = handle.getMapState("open", _ID, _OPEN, idle_ms)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            # chunks of a key come in any order
            batch = pd.concat(list(rows))
            done = batch[batch["step"] == "done"]
            moving = batch[batch["step"] != "done"].sort_values("ord", kind="stable")
            # only what the batch asks for is read, and each group it touches is written once
            held, asked, none = {}, [], (None, None, None, None)
            columns = ["session_id", "epoch", "pair_space", "id_key", "step", "opens", *_REQUEST]
            for *name, step, opens, ord_, seq, label, call in zip(*[moving[c].tolist() for c in columns], strict=True):
                name = tuple(name)
                if step == "ask":
                    if name in held:
                        found = held[name]
                    else:
                        found = self.open.getValue(name) if self.open.containsKey(name) else None
                    asked.append(tuple(found) if found else none)
                    held[name] = None
                elif opens:
                    held[name] = (int(ord_), None if pd.isna(seq) else int(seq), label, bool(call))
                else:
                    held[name] = None
            for name, request in held.items():
                if request is None:
                    self.open.removeKey(name)
                else:
                    self.open.updateValue(name, request)
            ask = moving[moving["step"] == "ask"].copy()
            for k, name in enumerate(_REQUEST):
                ask[f"before_{name}"] = pd.Series([a[k] for a in asked], index=ask.index, dtype=object)
            for part in (done, ask):
                yield pd.DataFrame({
                    "session_id": part["session_id"], "epoch": part["epoch"],
                    "ord": part["ord"], "seq": part["seq"].astype("Int64"), "role": part["role"],
                    "responds_to": part["before_label"], "answers_call": part["before_call"].astype("boolean"),
                    "request_ord": part["before_ord"].astype("Int64"), "request_seq": part["before_seq"].astype("Int64"),
                    "orphaned": part["before_ord"].isna(),
                })

    return Pairing


def live_pairing(frames: DataFrame, idle_hours: float | None = None, shards: int = SHARDS) -> DataFrame:
    """Stream of answers with the request each one answers: ``build_events``' pairing.

    It has two levels.  Inside the part of a block that a batch brings, an answer looks at the
    row before it in its group; the sessions of a block are dealt into ``shards`` pieces, so many
    short sessions share a pass.  What is open across blocks and batches is state, in ``shards``
    shards by session, initiator and id: it is asked by the first row of a group in a block and
    changed by the last.  So neither a session nor an id that many requests reuse is one task, and
    the passes of a batch grow with its blocks, not with its sessions.
    With ``idle_hours`` requests unanswered for so long are forgotten.  A raised epoch has keys
    of its own, so nothing of a replaced log answers.  Needs the RocksDB state store.
    """
    opens = F.col("role").isin("call", "client_request", "server_message")
    rows = classify_frames(with_epoch(frames), "epoch").filter("pair_space IS NOT NULL").select(
        "session_id", "epoch", "block", F.pmod(F.xxhash64("session_id", "epoch"), F.lit(shards)).alias("piece"),
        F.pmod(F.xxhash64("session_id", "epoch", "pair_space", "id_key"), F.lit(shards)).alias("shard"),
        "ord", "seq", "role", "pair_space", "id_key", opens.alias("opens"),
        F.coalesce("call_name", F.concat(F.lit("<"), F.col("method"), F.lit(">"))).alias("label"),
        (F.col("role") == "call").alias("call"),
    )
    idle = None if idle_hours is None else int(idle_hours * 3_600_000)
    steps = rows.groupBy("block", "piece").applyInPandas(_inside_blocks(shards), STEPS)
    return steps.groupBy("shard").transformWithStateInPandas(
        _pairing(idle)(), outputStructType=PAIRED, outputMode="Append",
        timeMode="None" if idle is None else "ProcessingTime",
    )


def open_requests(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The requests without an answer that a pairing query holds, read from its state."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "open").load()
    return state.select(
        "user_map_key.session_id", "user_map_key.epoch", "user_map_key.space", "user_map_key.id_key",
        "user_map_value.ord", "user_map_value.seq", "user_map_value.label",
    )


def state_sizes(query: StreamingQuery) -> list[dict]:
    """Rows and bytes of state after each batch that a query still reports."""
    return [
        {"batch": p["batchId"], "rows": s["numRowsTotal"], "bytes": s["memoryUsedBytes"]}
        for p in query.recentProgress for s in p["stateOperators"]
    ]


# ---- verdicts per call, with a wait for the first surface -------------------------------------

_VERDICT = _struct(session_id=StringType, seq=LongType, tool_name=StringType, verdict=StringType)
_SURFACE = StructType([StructField("names", ArrayType(StringType()))])
_WAITING = _struct(seq=LongType, tool_name=StringType, due=LongType)


def _policy(hold_ms: int, enforce: bool, idle_ms: int) -> Callable[[], StatefulProcessor]:
    class Policy(StatefulProcessor):
        """Latest surface and waiting calls of one epoch of a session."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.surface = handle.getValueState("surface", _SURFACE, idle_ms)
            self.waiting = handle.getListState("waiting", _WAITING, idle_ms)

        def _names(self) -> set[str] | None:
            return set(self.surface.get()[0]) if self.surface.exists() else None

        def _verdict(self, tool: str, names: set[str]) -> str:
            if tool in names:
                return "forward"
            return "blocked" if enforce else "gate_disabled"

        def _release(self, names: set[str]) -> list[tuple]:
            held = list(self.waiting.get()) if self.waiting.exists() else []
            if held:
                self.waiting.clear()
            return [(seq, tool, self._verdict(tool, names)) for seq, tool, _ in held]

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            names, out = self._names(), []
            # chunks of a key come in any order: a listing must not be seen after its call
            for row in pd.concat(list(rows)).sort_values("ord", kind="stable").itertuples():
                if row.surface is not None:
                    names = set(row.surface)
                    self.surface.update((sorted(names),))
                    out += self._release(names)
                elif names is not None:
                    out.append((row.seq, row.tool_name, self._verdict(row.tool_name, names)))
                else:
                    due = timerValues.getCurrentProcessingTimeInMs() + hold_ms
                    self.waiting.appendValue((row.seq, row.tool_name, due))
                    self.handle.registerTimer(due)
            yield self._frame(key, out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = expiredTimerInfo.getExpiryTimeInMs()
            held = list(self.waiting.get()) if self.waiting.exists() else []
            late = [h for h in held if h[2] <= now]
            rest = [h for h in held if h[2] > now]
            if late:
                self.waiting.put(rest) if rest else self.waiting.clear()
            yield self._frame(key, [(seq, tool, "gate_skipped") for seq, tool, _ in late])

        @staticmethod
        def _frame(key, rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(
                [(key[0], *row) for row in rows], columns=["session_id", "seq", "tool_name", "verdict"]
            )

    return Policy


def live_policy(
    frames: DataFrame, hold: float = HOLD_SECONDS, enforce: bool = True, idle_hours: float = 24.0
) -> DataFrame:
    """Stream of verdicts per call: a decision table, it blocks no traffic.

    A call that finds no surface waits; the first listing decides it, or a timer
    marks it as skipped.  State of a silent session expires after ``idle_hours``; a replaced
    log starts with none.  Needs the RocksDB state store, and a trigger by time or ``once``: with
    ``availableNow`` Spark goes on as long as timers may come due.
    """
    frame = F.col("frame")
    tools = F.try_variant_get(frame, "$.result.tools", "array<variant>")
    names = F.filter(F.transform(tools, lambda t: text_at(t, "$.name")), lambda n: n.isNotNull())
    rows = (
        classify_frames(with_epoch(frames), "epoch")
        .filter("role IN ('call', 'response', 'server_message')")
        .select(
            "session_id", "epoch", "ord", "seq", F.col("call_name").alias("tool_name"),
            F.when((F.col("role") != "call") & tools.isNotNull(), names).alias("surface"),
        )
        .filter("tool_name IS NOT NULL OR surface IS NOT NULL")
    )
    processor = _policy(int(hold * 1000), enforce, int(idle_hours * 3_600_000))
    return rows.groupBy("session_id", "epoch").transformWithStateInPandas(
        processor(), outputStructType=_VERDICT, outputMode="Append", timeMode="ProcessingTime"
    )
