"""Grasp flags over a live frame table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_schmitt(frames: DataFrame, close: float, open_: float, clip: str = "clip", frame: str = "frame", width: str = "width") -> DataFrame:
    """clip, frame, closed of a streaming ``frames``: closed below ``close``, open above ``open_``, else as before.

    State is a clip's last flag. Frames of a clip are taken in order of ``frame`` within a
    batch; a frame that comes in a later batch than its successors continues from the
    state as it is then.
    """
    kinds = {c: frames.schema[c].dataType.simpleString() for c in (clip, frame)}

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed = state.get[0] if state.exists else False
        rows = pd.concat(list(batches)).sort_values(frame, kind="stable")
        flags = []
        for w in rows[width]:
            if pd.notna(w):
                closed = True if w < close else False if w > open_ else closed
            flags.append(closed)
        state.update((bool(closed),))
        yield pd.DataFrame({clip: rows[clip].to_numpy(), frame: rows[frame].to_numpy(), "closed": flags})

    schema = f"`{clip}` {kinds[clip]}, `{frame}` {kinds[frame]}, closed boolean"
    return frames.groupBy(clip).applyInPandasWithState(run, schema, "closed boolean", "append", GroupStateTimeout.NoTimeout)


#: The state store that keyed state with timers needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_POINT = ("hx", "hy", "hz", "ox", "oy", "oz")
_NUMBERS = ("width", *_POINT)
_FRAME = ", ".join(["frame bigint", "ms bigint", *[f"{c} double" for c in _NUMBERS], "hand_valid boolean, obj_valid boolean"])
_FLAGS = "frame bigint, contact boolean, coupled boolean, raw boolean"


class _Grasps(StatefulProcessor):
    """One clip: frames wait until the watermark has passed them, then go through the detector in order.

    State is the frames that wait, a row of what the detector knows of the frames before, and the flags of a run
    that is still too short to tell whether it stays.
    """

    def __init__(self, clip: str, close: float, open_: float, least_run: int, fps: float, within: float, least_cos: float, least_speed: float, idle_ms: int):
        self.clip, self.close_at, self.open_at, self.least_run, self.fps = clip, close, open_, least_run, fps
        self.within, self.least_cos, self.least_speed, self.idle_ms = within, least_cos, least_speed, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _FRAME)
        self.known = handle.getValueState("known", f"narrow boolean, both boolean, {', '.join(f'{c} double' for c in _POINT)}, value boolean, length bigint, first boolean, kept boolean, last_ms bigint")
        self.run = handle.getListState("run", _FLAGS)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [tuple(r) for f in rows for r in self._plain(f)]
        self.waiting.appendList(new)
        yield from self._release(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._release(key, timerValues.getCurrentWatermarkInMs())

    def _plain(self, f: pd.DataFrame) -> Iterator[list]:
        for r in f.to_dict("records"):
            number = lambda c: None if pd.isna(r[c]) else float(r[c])  # noqa: B023, E731
            yield [int(r["frame"]), int(pd.Timestamp(r["t"]).value // 1_000_000), *map(number, _NUMBERS), *(bool(r[c]) if pd.notna(r[c]) else False for c in ("hand_valid", "obj_valid"))]

    def _release(self, key: tuple, watermark: int) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _FRAME.split(", ")]
        frames = sorted((dict(zip(names, r, strict=True)) for r in self.waiting.get()), key=lambda r: r["frame"])
        due, later = [r for r in frames if r["ms"] <= watermark], [r for r in frames if r["ms"] > watermark]
        out: list[tuple] = []
        if due:
            known = dict(zip(self._known_names(), self.known.get(), strict=True)) if self.known.exists() else self._start()
            run = [tuple(r) for r in self.run.get()] if self.run.exists() else []
            for r in due:
                run, done = self._step(known, run, r)
                out += done
            self.known.update(tuple(known[c] for c in self._known_names()))
            self._put(self.run, run)
            self._put(self.waiting, [tuple(r[c] for c in names) for r in later])
        if later:
            self.handle.registerTimer(min(r["ms"] for r in later))
        elif self.known.exists():
            last = dict(zip(self._known_names(), self.known.get(), strict=True))
            if watermark >= last["last_ms"] + self.idle_ms:
                # The clip is over: its last run stays, however short it is.
                out += [tuple(r) for r in self.run.get()] if self.run.exists() else []
                for state in (self.known, self.run, self.waiting):
                    state.clear()
            else:
                self.handle.registerTimer(last["last_ms"] + self.idle_ms)
        if out:
            frame, contact, coupled, closed = zip(*out, strict=True)
            yield pd.DataFrame({self.clip: [key[0]] * len(out), "frame": frame, "contact": contact, "coupled": coupled, "closed": closed})

    @staticmethod
    def _put(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    @staticmethod
    def _known_names() -> list[str]:
        return ["narrow", "both", *_POINT, "value", "length", "first", "kept", "last_ms"]

    def _start(self) -> dict:
        return {"narrow": False, "both": False, **dict.fromkeys(_POINT), "value": None, "length": 0, "first": True, "kept": None, "last_ms": 0}

    def _step(self, known: dict, run: list[tuple], r: dict) -> tuple[list[tuple], list[tuple]]:
        """The run that waits and the flags that are settled after frame ``r``; ``known`` changes."""
        w = r["width"]
        known["narrow"] = known["narrow"] if w is None else w < self.close_at or (w <= self.open_at and known["narrow"])
        ok = r["hand_valid"] and r["obj_valid"]
        whole = all(r[c] is not None for c in _POINT)
        contact = coupled = False
        if ok and whole:
            contact = sum((r[h] - r[o]) ** 2 for h, o in zip(_POINT[:3], _POINT[3:], strict=True)) ** 0.5 < self.within
            if known["both"] and known["hx"] is not None:
                v = [(r[c] - known[c]) * self.fps for c in _POINT]
                hand, obj = (sum(x * x for x in p) ** 0.5 for p in (v[:3], v[3:]))
                coupled = obj >= self.least_speed and hand >= 1e-6 and sum(a * b for a, b in zip(v[:3], v[3:], strict=True)) > self.least_cos * hand * obj
        known.update({c: r[c] if whole else None for c in _POINT}, both=ok, last_ms=max(known["last_ms"], r["ms"]))
        value = known["narrow"] and (contact or coupled) or (coupled and contact)
        flags = (r["frame"], contact, coupled, bool(value))
        if known["value"] is None or value == known["value"]:
            known.update(value=value, length=known["length"] + 1)
            done: list[tuple] = []
            run = [*run, flags]
        else:
            # The run before was too short, or it would have been settled: it takes the value of the last one that stays.
            done = [(*f[:3], known["kept"]) for f in run]
            run = [flags]
            known.update(value=value, length=1, first=False)
        if known["first"] or known["length"] >= self.least_run:
            known["kept"] = value
            done, run = done + run, []
        return run, done


def stream_grasps(frames: DataFrame, close: float, open_: float, fps: float, least_run: int = 3, delay: str = "10 seconds", idle: str = "60 seconds", clip: str = "clip", within: float = 0.05, least_cos: float = 0.6, least_speed: float = 0.02) -> DataFrame:
    """clip, frame, contact, coupled, closed of a streaming ``frames``: what the batch's grasp state gives, whatever order frames come in.

    ``frames`` has clip, frame, t (a timestamp that rises with frame), width, hx..hz, ox..oz, hand_valid, obj_valid. A frame
    may come ``delay`` late; until then the frames after it wait, so a clip holds that many seconds of frames as state. A
    later one is dropped. A clip without frames for ``idle`` is over: its last run is settled and its state goes. The
    session needs the state store of ROCKSDB.
    """
    spark = frames.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    kind = frames.schema[clip].dataType.simpleString()
    numbers = [F.col(c).cast("double").alias(c) for c in _NUMBERS]
    rows = frames.withWatermark("t", delay).select(clip, F.col("frame").cast("bigint").alias("frame"), "t", *numbers, "hand_valid", "obj_valid")
    detector = _Grasps(clip, close, open_, least_run, float(fps), within, least_cos, least_speed, idle_ms)
    schema = f"`{clip}` {kind}, frame bigint, contact boolean, coupled boolean, closed boolean"
    return rows.groupBy(clip).transformWithStateInPandas(detector, schema, "Append", "EventTime")
