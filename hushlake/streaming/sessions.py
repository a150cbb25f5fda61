"""Keyed state on event time: ordered folds, resets by control rows, and expiry by timers.

Rows of a key arrive in pieces.  One piece is sorted in memory; several are first dealt into slices of their order in
the state store and then taken slice by slice, so a hot key never has all its rows of a batch in memory (a slice holds
``SLICE`` steps of the order).  Control rows reset a key as soon as they are reached in order.  With an event time, a
timer drops a key's state once the watermark has passed its last event by the idle time; without one, the
clock decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SLICE = 4096
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: One step of a fold: (sorted rows, state before) -> (rows out, state after).
Fold = Callable[[pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple]]


class OrderedFold(StatefulProcessor):
    """Folds the rows of each key in the order of ``order`` (the first column is a whole number that slices are cut by)."""

    def __init__(self, fold: Fold, order: list[str], carry: T.StructType, at: str | None, idle_ms: int | None, expired=None):
        self.fold, self.order, self.carry_type = fold, order, carry
        self.at, self.idle_ms, self.expired = at, idle_ms, expired

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carry = handle.getValueState("carry", self.carry_type)
        self.spool = handle.getMapState("spool", T.StructType().add("slice", "long"), T.StructType().add("pieces", T.ArrayType(T.BinaryType())))
        self.seen = handle.getValueState("seen", T.StructType().add("ms", "long"))

    def _pieces(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = next(rows, None), next(rows, None)
        if second is None:
            if first is not None:
                yield first.sort_values(self.order, kind="stable")
            return
        for piece in chain([first, second], rows):
            for s, part in piece.groupby(piece[self.order[0]] // SLICE):
                batch = pa.RecordBatch.from_pandas(part, preserve_index=False)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as writer:
                    writer.write_batch(batch)
                held = self.spool.getValue((int(s),))
                self.spool.updateValue((int(s),), ([*(held[0] if held else []), sink.getvalue().to_pybytes()],))
        for (s,) in sorted(self.spool.keys()):
            parts = [pa.ipc.open_stream(bytes(p)).read_pandas() for p in self.spool.getValue((s,))[0]]
            self.spool.removeKey((s,))
            yield pd.concat(parts).sort_values(self.order, kind="stable")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        carry = self.carry.get() if self.carry.exists() else None
        newest = self.seen.get()[0] if self.seen.exists() else None
        for piece in self._pieces(rows):
            if self.at is not None:
                last = int(piece[self.at].max().timestamp() * 1000)
                newest = last if newest is None else max(newest, last)
            out, carry = self.fold(piece, carry)
            if len(out):
                yield out
        if carry is not None:
            self.carry.update(carry)
        if self.idle_ms is not None:
            base = newest if self.at is not None else timerValues.getCurrentProcessingTimeInMs()
            if base is not None:
                self.seen.update((base,))
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(base + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        carry = self.carry.get() if self.carry.exists() else None
        self.carry.clear()
        self.seen.clear()
        if self.expired is not None and carry is not None:
            yield self.expired(key, carry)

    def close(self) -> None:
        pass


def rocks_state(spark: SparkSession) -> None:
    """The state store that this module's operators need; a session that names one already keeps it."""
    if not spark.conf.get(_PROVIDER).endswith("RocksDBStateStoreProvider"):
        spark.conf.set(_PROVIDER, _ROCKS)


def fold_stream(
    stream: DataFrame, key: str, order: list[str], fold: Fold, out: str, carry: str,
    at: str | None = None, late: str = "10 minutes", idle_ms: int | None = None, expired=None,
) -> DataFrame:
    """Applies ``fold`` to every key of ``stream`` in order; ``out`` and ``carry`` are the schemas of rows and state."""
    rocks_state(stream.sparkSession)
    timed = stream.withWatermark(at, late) if at else stream
    mode = "None" if idle_ms is None else "EventTime" if at else "ProcessingTime"
    processor = OrderedFold(fold, order, T.StructType.fromDDL(carry), at, idle_ms, expired)
    return timed.groupBy(key).transformWithStateInPandas(processor, outputStructType=out, outputMode="append", timeMode=mode)


# --- Rows whose content changed --------------------------------------------------------
def changed_rows(stream: DataFrame, key: str, hash_col: str, order: str, at: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """Rows whose content hash differs from the last one of the key; state is one hash per key."""
    kind = stream.schema[key].dataType.simpleString()

    def fold(rows: pd.DataFrame, carry: tuple | None):
        before = rows[hash_col].shift(1)
        before.iloc[0] = carry[0] if carry else None
        new = rows[(rows[hash_col] != before) & ~(rows[hash_col].isna() & before.isna() & bool(carry))]
        out = pd.DataFrame({key: new[key], "order": new[order].astype("int64"), "hash": new[hash_col]})
        last = rows[hash_col].iloc[-1]
        return out, (None if pd.isna(last) else last,)

    columns = [key, order, hash_col, *([at] if at else [])]
    return fold_stream(stream.select(*columns), key, [order], fold, f"{key} {kind}, order bigint, hash string", "hash string", at, idle_ms=idle_ms)


# --- What is left of a tab after its last navigation -----------------------------------
def tab_rows(
    stream: DataFrame, tab: str, order: list[str], nav: str, at: str | None = None, late: str = "10 minutes", idle_ms: int | None = None,
) -> DataFrame:
    """Rows behind a tab's last navigation so far, and a control row for each reset.

    ``order`` names one or two whole numbers.  Output: tab, the order columns, kind (``row``, ``reset`` when a
    navigation came, ``expired`` when the tab was idle too long).  Rows that lie before a navigation already seen are
    dropped at once; ``current_rows`` takes off those that a later reset has overtaken.
    """
    kind = stream.schema[tab].dataType.simpleString()
    first, second = order[0], order[-1]
    columns = [tab, *dict.fromkeys(order)]

    def step(rows: pd.DataFrame, carry: tuple | None):
        floor, top = ((carry[0], carry[1]), (carry[2], carry[3])) if carry else ((None, None), None)
        is_nav = rows[nav].fillna(False).astype(bool)
        marks = rows[is_nav]
        if len(marks):
            last = (int(marks[first].iloc[-1]), int(marks[second].iloc[-1]))
            floor = last if floor[0] is None else max(floor, last)
        alive = ~is_nav
        if floor[0] is not None:
            alive &= (rows[first] > floor[0]) | ((rows[first] == floor[0]) & (rows[second] > floor[1]))
        out = rows[alive][columns].assign(kind="row")
        if len(marks):
            out = pd.concat([marks.iloc[-1:][columns].assign(kind="reset"), out])
        end = (int(rows[first].iloc[-1]), int(rows[second].iloc[-1]))
        return out, (*floor, *(end if top is None else max(top, end)))

    def expired(key, carry: tuple) -> pd.DataFrame:
        row = {tab: [key[0]], first: [carry[2]], second: [carry[3]], "kind": ["expired"]}
        return pd.DataFrame(row)[[*columns, "kind"]]

    schema = ", ".join([f"{tab} {kind}", *[f"{c} bigint" for c in dict.fromkeys(order)], "kind string"])
    wanted = list(dict.fromkeys([*columns, nav, *([at] if at else [])]))
    state = "nav bigint, nav_tie bigint, top bigint, top_tie bigint"
    return fold_stream(stream.select(*wanted), tab, order, step, schema, state, at, late, idle_ms, expired)


def current_rows(rows: DataFrame, tab: str, order: list[str]) -> DataFrame:
    """Of the output of ``tab_rows``: the rows that no reset and no expiry has overtaken."""
    last = rows.filter("kind <> 'row'").groupBy(tab).agg(F.max(F.struct(*order)).alias("__last"))
    joined = rows.filter("kind = 'row'").join(last, tab, "left")
    return joined.filter(F.col("__last").isNull() | (F.struct(*order) > F.col("__last"))).drop("__last", "kind")


# --- The send gate ---------------------------------------------------------------------
GATE_COLUMNS = ["state", "reason", "allowed", "clean_hash", "hash"]


def gate_rows(
    judged: DataFrame, key: str, order: str, scan: str, reset: str | None = None,
    at: str | None = None, late: str = "10 minutes", idle_ms: int | None = None,
) -> DataFrame:
    """Verdicts of judged edits as a stream: older scans are stale, edits after a verified text lock it again.

    A row with ``reset`` is a navigation: it closes the conversation's state and is itself reported as idle.  State is one scan
    number and one fingerprint per conversation.
    """
    kind = judged.schema[key].dataType.simpleString()

    def fold(rows: pd.DataFrame, carry: tuple | None):
        newest, verified = carry if carry else (None, None)
        rows = rows.reset_index(drop=True)
        mark = rows["reset"].fillna(False).astype(bool)
        part = mark.cumsum()
        scans = rows[scan].where(~mark).astype("float64")
        best = scans.groupby(part).cummax().groupby(part).shift(1).groupby(part).ffill()
        if newest is not None:
            best = best.where(part > 0, best.fillna(newest).clip(lower=newest))
        stale = (scans < best) & ~mark
        live = ~stale & ~mark
        clean = rows["clean_hash"].where(rows["allowed"].fillna(False).astype(bool))
        kept = pd.DataFrame({"part": part[live], "clean": clean[live]})
        before = kept.groupby("part")["clean"].shift(1)
        opens = ~kept["part"].duplicated()
        before = before.where(~(opens & (kept["part"] == 0)), verified)
        relocked = before.notna() & (before != rows["hash"][live])
        out = pd.DataFrame({
            key: rows[key], "turn": rows[order],
            "state": rows["state"].where(live, "STALE").where(~mark, "IDLE"),
            "reason": rows["reason"].where(live, "STALE_SCAN").where(~mark, "NAVIGATED"),
            "allowed": rows["allowed"].fillna(False).astype(bool) & live,
            "relocked": relocked.reindex(rows.index, fill_value=False).astype(bool),
        })
        last = part.iloc[-1]
        ended = scans[part == last].max()
        if last == 0 and newest is not None:
            ended = newest if pd.isna(ended) else max(ended, newest)
        tail = kept[kept["part"] == last]["clean"]
        verified = (tail.iloc[-1] if len(tail) else verified if last == 0 else None)
        return out, (None if pd.isna(ended) else int(ended), None if pd.isna(verified) else verified)

    flagged = judged.withColumn("reset", F.col(reset) if reset else F.lit(False))
    wanted = flagged.select(key, order, scan, "reset", *GATE_COLUMNS, *([at] if at else []))
    schema = f"{key} {kind}, turn bigint, state string, reason string, allowed boolean, relocked boolean"
    return fold_stream(wanted, key, [order, scan], fold, schema, "newest bigint, verified string", at, late, idle_ms)
