"""Structured Streaming jobs: bars from ticks, keyed upserts, and the batch folds as stateful operators."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.operators.reversals import share as share_of
from barloom.operators.signals import FRESH_SIGNALS, signal_step, trend_step

c = F.col
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_bars(ticks: DataFrame, timeframe: str, width: str, late: str = "1 hour") -> DataFrame:
    """Tumbling OHLCV bars from (symbol, ts, price, quantity, seq).

    In update mode a forming bar is sent again on every change; in append mode a bar is sent once,
    when the watermark has passed its end.
    """
    return (
        ticks.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "symbol")
        .agg(
            F.min_by("price", F.struct("ts", "seq")).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", F.struct("ts", "seq")).alias("close"),
            F.sum("quantity").alias("volume"),
        )
        .select("symbol", F.lit(timeframe).alias("timeframe"), c("window.start").alias("time"), "open", "high", "low", "close", "volume")
    )


def stream_upsert_bars(versions: DataFrame, late: str = "1 hour") -> DataFrame:
    """The newest version of each bar by ``seq``; state for a bar goes once the watermark passed it."""
    fields = [x for x in versions.columns if x not in ("symbol", "timeframe", "time")]
    return (
        versions.withWatermark("time", late)
        .groupBy("symbol", "timeframe", "time")
        .agg(F.max_by(F.struct(*fields), "seq").alias("v"))
        .select("symbol", "timeframe", "time", "v.*")
    )


def stream_alerts(alerts: DataFrame, late: str = "1 day") -> DataFrame:
    """Alerts with repeats of one id dropped while the watermark remembers it."""
    return alerts.withWatermark("time", late).dropDuplicatesWithinWatermark(["symbol", "alert_id"])


def stream_funding_monitor(rates: DataFrame, threshold_pct: float = 0.03) -> DataFrame:
    return rates.filter(F.abs(c("funding_rate") * 100) >= threshold_pct)


# ---- folds -----------------------------------------------------------------------------------


def packed(value, kind: T.DataType):
    """A plain value as a tuple for state of the given type; a dict stands for a struct, a list of numbers for an array."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(packed(value.get(f.name), f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return [packed(x, kind.elementType) for x in value]
    if isinstance(kind, T.MapType):
        return {k: packed(x, kind.valueType) for k, x in value.items()}
    return float(value) if isinstance(kind, T.DoubleType) else value


def unpacked(value, kind: T.DataType):
    """The value that ``packed`` took, without a struct's empty fields."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        fields = {f.name: unpacked(x, f.dataType) for f, x in zip(kind, value)}
        return {k: x for k, x in fields.items() if x is not None}
    if isinstance(kind, T.ArrayType):
        return [unpacked(x, kind.elementType) for x in value]
    if isinstance(kind, T.MapType):
        return {k: unpacked(x, kind.valueType) for k, x in value.items()}
    return value


def frozen(rows: pd.DataFrame, columns: pa.Schema) -> tuple[bytes]:
    """Rows as one binary state value, an Arrow table of typed columns."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, columns) as out:
        out.write_table(pa.Table.from_pandas(rows, schema=columns, preserve_index=False))
    return (sink.getvalue().to_pybytes(),)


def thawed(held: tuple | None, columns: pa.Schema) -> pa.Table:
    """The rows that ``frozen`` took; none for an empty state."""
    return columns.empty_table() if held is None else pa.ipc.open_stream(bytes(held[0])).read_all()


class TimelineProcessor(StatefulProcessor):
    """Rows of a key wait in map state by chunks of time until the watermark has passed them.

    Files may come late and out of order by as much as the watermark allows. What a part of a batch brings to a chunk is
    one value of its own, so that nothing that waits is read or written again until it is due. A batch sets one timer for
    the newest row it brings to each chunk; the first timer of a key that fires releases all rows that are due, chunk by
    chunk in the order of time. So a call to the state is made for a piece of a chunk, not for a row.
    """

    fields: pa.Schema
    chunk_us = 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "chunk long, piece long", "rows binary")
        self.pieces = handle.getValueState("pieces", "n long")
        self.released: dict = {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.pieces.get()
        piece, newest = held[0] if held is not None else 0, {}
        for part in rows:
            for chunk, at in part.groupby(part["us"] // self.chunk_us).indices.items():
                here = part.iloc[at]
                self.waiting.updateValue((int(chunk), piece), frozen(here, self.fields))
                newest[chunk] = max(newest.get(chunk, 0), int(here["us"].max()))
            piece += 1
        self.pieces.update((piece,))
        for us in newest.values():
            self.wake(us)
        return iter(())

    def wake(self, us: int) -> None:
        """A timer for the first whole millisecond at or after an instant."""
        self.handle.registerTimer(-(-us // 1000))

    def due(self, watermark_ms: int) -> Iterator[pd.DataFrame]:
        """The waiting rows up to the watermark, taken out of the state: a chunk at a time, rows of one instant as they were read."""
        limit = watermark_ms * 1000
        pieces: dict[int, list[int]] = {}
        for chunk, piece in list(self.waiting.keys()):
            if chunk * self.chunk_us <= limit:
                pieces.setdefault(chunk, []).append(piece)
        for chunk in sorted(pieces):
            keys = [(chunk, piece) for piece in sorted(pieces[chunk])]
            rows = pa.concat_tables([thawed(self.waiting.getValue(k), self.fields) for k in keys]).to_pandas()
            for k in keys:
                self.waiting.removeKey(k)
            later = rows[rows["us"] > limit]
            if len(later):
                self.waiting.updateValue(keys[0], frozen(later, self.fields))
                self.wake(int(later["us"].max()))
            yield rows[rows["us"] <= limit].sort_values("us", kind="stable")

    def release(self, key, watermark_ms: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        if self.released.get(key) != watermark:  # the key's other timers of this batch find nothing
            self.released[key] = watermark
            yield from self.release(key, watermark)

    def close(self) -> None:
        pass


BAR = ("open", "high", "low", "close", "volume")


class FoldProcessor(TimelineProcessor):
    """Runs ``step(state dict, bar dict) -> (state, rows)`` over each key's closed bars in time order.

    Of several versions of a bar the last one read counts. The fold's state has typed columns, ``held``, after the version
    of that layout; a checkpoint of another version is refused.
    """

    version = 2
    fields = pa.schema([("us", pa.int64()), *((x, pa.float64()) for x in BAR)])
    columns: tuple = ()
    held: str = ""

    def __init__(self):
        self.layout = T.DataType.fromDDL(f"version int, {self.held}")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("fold", self.layout)

    def step(self, state: dict, bar: dict):
        raise NotImplementedError

    def release(self, key, watermark_ms: int) -> Iterator[pd.DataFrame]:
        state = None
        for rows in self.due(watermark_ms):
            out = []
            newest = rows.drop_duplicates("us", keep="last")
            for us, *bar in zip(*(newest[x].tolist() for x in ("us", *BAR))):
                if state is None:
                    state = unpacked(self.state.get(), self.layout) or {"version": self.version}
                    if state["version"] != self.version:
                        raise ValueError(f"the checkpoint holds state of version {state['version']}, this is {self.version}")
                state, found = self.step(state, {**dict(zip(BAR, bar)), "time": pd.Timestamp(us, unit="us")})
                out += [(*key, *r) for r in found]
            yield pd.DataFrame(out, columns=list(self.columns))
        if state is not None:
            self.state.update(packed(state, self.layout))


def running_average(s: dict, name: str, value: float, period: int):
    """Wilder average kept in ``s``: mean of the first ``period`` values, then smoothed."""
    held = s.get(name) or [0, 0.0]
    n, avg = held
    n += 1
    avg = avg + value / period if n <= period else (avg * (period - 1) + value) / period
    s[name] = [n, avg]
    return avg if n >= period else None


def true_range(s: dict, bar: dict) -> float:
    before = s.get("close")
    span = bar["high"] - bar["low"]
    return span if before is None else max(span, abs(bar["high"] - before), abs(bar["low"] - before))


class SuperTrendProcessor(FoldProcessor):
    columns = ("symbol", "timeframe", "time", "st_value", "st_direction")
    schema = "symbol string, timeframe string, time timestamp, st_value double, st_direction string"
    held = "close double, atr array<double>, band array<double>"

    def __init__(self, period: int = 60, factor: float = 4.0):
        super().__init__()
        self.period, self.factor = period, factor

    def step(self, s, bar):
        atr = running_average(s, "atr", true_range(s, bar), self.period)
        row = (bar["time"], None, None)
        if atr is not None:
            s["band"], value, bullish = trend_step(s.get("band"), bar["high"], bar["low"], bar["close"], s.get("close"), atr, self.factor)
            row = (bar["time"], value, "bullish" if bullish else "bearish")
        s["close"] = bar["close"]
        return s, [row]


class ZigzagProcessor(FoldProcessor):
    """Fine and big swing turns as they are confirmed."""

    columns = ("symbol", "timeframe", "time", "level", "is_top", "price")
    schema = "symbol string, timeframe string, time timestamp, level string, is_top boolean, price double"
    held = "fine array<double>, big array<double>"

    def __init__(self, fine: float = 0.007, big: float = 0.02):
        super().__init__()
        self.levels = {"fine": fine, "big": big}

    def step(self, s, bar):
        out = []
        for name, share in self.levels.items():
            up, px = s.get(name) or [True, bar["high"]]
            if up:
                px = max(px, bar["high"])
                if share_of(px - bar["low"], px) >= share:
                    out.append((bar["time"], name, True, px))
                    up, px = False, bar["low"]
            else:
                px = min(px, bar["low"])
                if share_of(bar["high"] - px, px) >= share:
                    out.append((bar["time"], name, False, px))
                    up, px = True, bar["high"]
            s[name] = [up, px]
        return s, out


class SignalProcessor(FoldProcessor):
    """Entry signals with the batch machine; its inputs are kept as incremental averages."""

    columns = ("symbol", "timeframe", "rn", "time", "side", "kind", "entry", "stop", "target1", "target2", "status", "hit_t1", "closed_rn")
    schema = (
        "symbol string, timeframe string, rn long, time timestamp, side string, kind string, entry double, stop double, target1 double, "
        "target2 double, status string, hit_t1 boolean, closed_rn long"
    )
    followed = "struct<rn:long,t:long,side:string,kind:string,entry:double,stop:double,target1:double,target2:double>"
    held = (
        "rn long, close double, high double, low double, closes array<double>, "
        + ", ".join(f"{x} array<double>" for x in ("atr60", "atr14", "gain", "loss", "tr", "plus", "minus", "dx"))
        + f", m struct<trend:array<double>,side:string,last:map<string,long>,active:{followed},status:string,t1:boolean,"
        f"shown:{followed},shown_status:string>"
    )

    def __init__(self, period: int = 60, factor: float = 4.0):
        super().__init__()
        self.period, self.factor = period, factor
        self.machine = signal_step(factor, "signals", last_closed=True)

    def step(self, s, bar):
        s["m"] = {**FRESH_SIGNALS, "last": {}, **s.get("m", {})}
        s["rn"] = s.get("rn", 0) + 1
        before, tr = s.get("close"), true_range(s, bar)
        atr60 = running_average(s, "atr60", tr, self.period)
        atr14 = running_average(s, "atr14", tr, 14)
        s["closes"] = [*s.get("closes", [])[-59:], bar["close"]]
        wma = sum((k + 1) * x for k, x in enumerate(s["closes"])) / 1830 if len(s["closes"]) == 60 else None
        rsi = adx = None
        if before is not None:
            move = bar["close"] - before
            gain, loss = running_average(s, "gain", max(move, 0.0), 14), running_average(s, "loss", max(-move, 0.0), 14)
            if gain is not None:
                rsi = 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
            up, down = bar["high"] - s["high"], s["low"] - bar["low"]
            # Averages instead of sums: the ratios of the directional index are the same.
            t = running_average(s, "tr", tr, 14)
            plus = running_average(s, "plus", up if up > down and up > 0 else 0.0, 14)
            minus = running_average(s, "minus", down if down > up and down > 0 else 0.0, 14)
            if t:
                total = plus + minus
                adx = running_average(s, "dx", abs(plus - minus) / total * 100 if total else 0.0, 14)
        values = (s["rn"], s["rn"] + 1, bar["time"].to_pydatetime(), bar["high"], bar["low"], bar["close"], before, atr60, atr14, wma, rsi, adx)
        s["m"], out = self.machine(s["m"], values)
        s |= {"close": bar["close"], "high": bar["high"], "low": bar["low"]}
        return s, out


def stream_fold(bars: DataFrame, processor: FoldProcessor, late: str = "1 hour") -> DataFrame:
    """Stateful fold of closed bars (symbol, timeframe, time, open, high, low, close, volume).

    Bars up to ``late`` behind the newest one are put in order. Needs the RocksDB state store (``ROCKSDB``).
    """
    timed = bars.withWatermark("time", late).select("symbol", "timeframe", "time", F.unix_micros("time").alias("us"), *[c(x).cast("double") for x in BAR])
    return timed.groupBy("symbol", "timeframe").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.schema, outputMode="Append", timeMode="EventTime"
    )


def stream_walls_ttl(updates: DataFrame, ttl: str, late: str = "1 hour") -> DataFrame:
    """Resting orders that live until nothing was heard of them for ``ttl``: updates (id, ts, usd).

    One row per life of an order, sent when the watermark has passed its end: first and last word, the time it is
    gone, how often it was heard of and its largest size. An order that comes back later has a new life.
    """
    life = F.session_window("ts", ttl)
    return updates.withWatermark("ts", late).groupBy(life, "id").agg(F.count(F.lit(1)).alias("updates"), F.max("usd").alias("most_usd"), F.max("ts").alias("last_seen")).select(
        "id", c("session_window.start").alias("since"), "last_seen", c("session_window.end").alias("gone_at"), "updates", "most_usd"
    )


SWEEP_SLACK = 0.0005


class WallLives(TimelineProcessor):
    """Lives of resting orders that end when a bar trades past them or nothing is heard of them for ``ttl_us``.

    Updates come before bars of the same instant; several of one order at one instant count together, with their highest
    price and size. The standing orders of a key are read whole with every release; in it, a bar meets only the orders it
    sweeps and those whose time has run out (``Standing``).
    """

    schema = (
        "symbol string, id string, side string, price double, since timestamp, last_seen timestamp, gone_at timestamp, "
        "reason string, updates long, most_usd double"
    )
    columns = ("symbol", "id", "side", "price", "since", "last_seen", "gone_at", "reason", "updates", "most_usd")
    fields = pa.schema([("us", pa.int64()), ("id", pa.string()), ("side", pa.string()), *((x, pa.float64()) for x in ("price", "usd", "high", "low"))])

    def __init__(self, ttl_us: int, slack: float):
        self.ttl_us, self.slack = ttl_us, slack

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.walls = handle.getValueState("walls", "walls binary")

    def release(self, key, watermark_ms: int) -> Iterator[pd.DataFrame]:
        held = thawed(self.walls.get(), Standing.fields).to_pandas()
        walls = Standing(held, self.ttl_us, self.slack)
        for rows in self.due(watermark_ms):
            rows = rows.assign(bar=rows["id"].isna()).sort_values(["us", "bar"], kind="stable")
            for us, bar, name, side, price, usd, high, low in zip(*(rows[x].tolist() for x in ("us", "bar", "id", "side", "price", "usd", "high", "low"))):
                walls.expire(us)
                if bar:
                    walls.sweep(us, high, low)
                else:
                    walls.hear(us, name, side, price, usd)
            walls.forget()
            yield self.lives(key[0], walls.ended())
        walls.expire(watermark_ms * 1000)
        yield self.lives(key[0], walls.ended())
        self.walls.update(frozen(walls.frame(), Standing.fields))
        if walls.by_id:
            self.wake(min(w[3] for w in walls.by_id.values()) + self.ttl_us)

    def lives(self, symbol: str, ended: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(ended, columns=list(self.columns[1:]))
        for name in ("since", "last_seen", "gone_at"):
            out[name] = pd.to_datetime(out[name].astype("int64"), unit="us")
        out.insert(0, "symbol", symbol)
        return out


class Standing:
    """Standing orders by id, with those next to expire and next to be swept at the front of three queues.

    A queue keeps a place for every word on an order; a place that a later word or the order's end made void is skipped.
    """

    columns = ("id", "side", "price", "since", "seen", "updates", "most_usd")
    fields = pa.schema(
        [("id", pa.string()), ("side", pa.string()), ("price", pa.float64()), ("since", pa.int64()), ("seen", pa.int64()), ("updates", pa.int64()), ("most_usd", pa.float64())]
    )
    spare = 10_000

    def __init__(self, held: pd.DataFrame, ttl_us: int, slack: float):
        self.ttl_us, self.slack, self.word, self.out = ttl_us, slack, 0, []
        self.by_id: dict[str, tuple] = {}
        self.quiet: deque = deque()
        self.sells: list = []
        self.buys: list = []
        for name, *wall in zip(*(held[x].tolist() for x in self.columns)):
            self._place(name, *wall)
        self.quiet = deque(sorted(self.quiet))

    def _place(self, name: str, side: str, price: float, since: int, seen: int, updates: int, most_usd: float) -> None:
        self.word += 1
        self.by_id[name] = (side, price, since, seen, updates, most_usd, self.word)
        self.quiet.append((seen, self.word, name))
        bound = price * (1 + self.slack) if side == "sell" else -(price * (1 - self.slack))
        if bound == bound:  # no bar trades past a price that is no number
            heappush(self.sells if side == "sell" else self.buys, (bound, self.word, name))

    def _stands(self, place: tuple) -> bool:
        wall = self.by_id.get(place[2])
        return wall is not None and wall[6] == place[1]

    def _gone(self, name: str, at: int, reason: str) -> None:
        side, price, since, seen, updates, most, _ = self.by_id.pop(name)
        self.out.append((name, side, price, since, seen, at, reason, updates, most))

    def hear(self, us: int, name: str, side: str, price: float, usd: float) -> None:
        was = self.by_id.get(name)
        if was is None:
            self._place(name, side, price, us, us, 1, usd)
            return
        if was[3] == us:  # told twice at one instant: the side and price of the higher price
            side, price = max(was[:2], (side, price), key=lambda x: (x[1], x[0]))
        self._place(name, side, price, was[2], us, was[4] + 1, max(was[5], usd))

    def expire(self, now: int) -> None:
        while self.quiet and self.quiet[0][0] + self.ttl_us <= now:
            place = self.quiet.popleft()
            if self._stands(place):
                self._gone(place[2], place[0] + self.ttl_us, "expired")

    def sweep(self, us: int, high: float, low: float) -> None:
        """End the orders that a bar's wick traded past by more than the slack between venues."""
        for queue, reach in ((self.sells, high), (self.buys, -low)):
            while queue and queue[0][0] < reach:
                place = heappop(queue)
                if self._stands(place):
                    self._gone(place[2], us, "swept")

    def forget(self) -> None:
        """Drop void places when they outnumber the orders."""
        for queue in (self.sells, self.buys):
            if len(queue) > 2 * len(self.by_id) + self.spare:
                queue[:] = filter(self._stands, queue)
                heapify(queue)
        if len(self.quiet) > 2 * len(self.by_id) + self.spare:
            self.quiet = deque(filter(self._stands, self.quiet))

    def ended(self) -> list[tuple]:
        out, self.out = self.out, []
        return out

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame([(name, *wall[:6]) for name, wall in self.by_id.items()], columns=list(self.columns))


def stream_wall_lives(updates: DataFrame, bars: DataFrame, ttl_seconds: float, late: str = "1 hour", slack: float = SWEEP_SLACK, shards: int = 8) -> DataFrame:
    """Resting orders met with the bars of their symbol: one row per life, with how it ended.

    ``updates`` (symbol, id, side, price, usd, time) say that an order rests; ``bars`` (symbol, time, high, low) are
    known by their opening time. An order is swept by the first bar that opens at or after the last word on it and trades
    past its price; it stays gone when the price pulls back, and only a later word gives it a new life. Otherwise it
    expires ``ttl_seconds`` after the last word. Both streams have their own watermark and the slower one counts. The time
    to live runs in event time, by timers, so that a replay ends lives at the same instants; state TTL would run by the
    wall clock. A symbol's orders are dealt over ``shards`` groups by id, and its few bars are sent to each of them.
    Rows without a symbol, time or id (bars: time, high or low) are left out. Needs the RocksDB state store (``ROCKSDB``).
    """
    no_number, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    said = updates.filter("symbol is not null and time is not null and id is not null and price is not null").withWatermark("time", late).select(
        "symbol", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "time", "id", "side", c("price").cast("double").alias("price"),
        F.coalesce(c("usd").cast("double"), F.lit(0.0)).alias("usd"), no_number.alias("high"), no_number.alias("low"),
    )
    traded = bars.filter("symbol is not null and time is not null and high is not null and low is not null").withWatermark("time", late).select(
        "symbol", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "time", no_text.alias("id"), no_text.alias("side"),
        no_number.alias("price"), no_number.alias("usd"), c("high").cast("double").alias("high"), c("low").cast("double").alias("low"),
    )
    both = said.unionByName(traded).withColumn("us", F.unix_micros("time"))
    lives = WallLives(round(ttl_seconds * 1e6), slack)
    return both.groupBy("symbol", "shard").transformWithStateInPandas(
        statefulProcessor=lives, outputStructType=WallLives.schema, outputMode="Append", timeMode="EventTime"
    )
