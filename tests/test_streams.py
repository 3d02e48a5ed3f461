"""Stateful streams against batch folds and brute force, with a restart in the middle."""

import random
from datetime import datetime, timedelta

import pandas as pd
from helpers import SCHEMA, close_to, lcg_closes
from pyspark.sql import functions as F

from barloom.session import shared_folder
from barloom.streaming import jobs as J

WALLS = "symbol string, id string, side string, price double, usd double, time timestamp"
REACH = "symbol string, time timestamp, high double, low double"
START = datetime(2024, 1, 1)


def append(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run_to_end(spark, stream, base):
    """One run over all that is there; the rows of every batch are kept under ``base``."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.ROCKSDB)
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{base}/out/_n={number}")
    stream.writeStream.option("checkpointLocation", f"{base}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def kept(spark, stream, base):
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{base}/out").filter(F.col("symbol") != "~")


def bar_rows(n):
    closes, rows, before = lcg_closes(n), [], 100.0
    for i, x in enumerate(closes):
        rows.append(("AAA", "1h", START + timedelta(hours=i), before, max(before, x) * 1.002, min(before, x) * 0.998, x, 5.0))
        before = x
    return rows


def sign(hours):
    return ("~", "1h", START + timedelta(hours=hours), 1.0, 1.0, 1.0, 1.0, 1.0)


def test_folds_go_on_from_the_checkpoint(spark, tmp_path):
    rows = bar_rows(260)
    late = rows[120:124]
    parts = [rows[:60], rows[60:120] + rows[124:130], late + rows[130:190], rows[190:], [sign(600)], [sign(900)]]
    for processor in (J.SuperTrendProcessor, J.ZigzagProcessor, J.SignalProcessor):
        name = processor.__name__
        source, base = f"{shared_folder(spark)}/{name}-{random.random()}", str(tmp_path / name)
        batch = []
        state, step = {}, processor().step
        for symbol, timeframe, time, *bar in sorted(rows, key=lambda x: x[2]):
            state, out = step(state, {**dict(zip(J.BAR, bar)), "time": pd.Timestamp(time)})
            batch += [(symbol, timeframe, *(x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in r)) for r in out]
        for k, part in enumerate(parts):
            append(spark, part, SCHEMA, source)
            if k in (1, 2, 3, 5):  # the stream ends and starts again from its checkpoint
                stream = J.stream_fold(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), processor(), "20 hours")
                run_to_end(spark, stream, base)
        got = sorted(tuple(r) for r in kept(spark, stream, base).collect())
        assert len(got) == len(batch)
        for a, b in zip(got, sorted(batch)):
            assert all(close_to(x, y) for x, y in zip(a, b)), (a, b)


def lives_by_hand(updates, bars, ttl, slack=J.SWEEP_SLACK):
    """Every life from the rows of one order at a time, in the order of time."""
    out = []
    for symbol, name in sorted({(u[0], u[1]) for u in updates}):
        events = sorted([(u[5], 0, u) for u in updates if u[:2] == (symbol, name)], key=lambda e: (e[0], e[2][3]))
        events += [(b[1], 1, b) for b in bars if b[0] == symbol]
        life = None
        for at, is_bar, row in sorted(events, key=lambda e: (e[0], e[1])) + [(datetime(2030, 1, 1), 1, None)]:
            if life and life["seen"] + ttl <= at:
                out.append((symbol, name, life["since"], life["seen"], life["seen"] + ttl, "expired", life["n"], life["most"]))
                life = None
            if row is None:
                continue
            if not is_bar:
                life = life or {"since": at, "n": 0, "most": row[4]}
                life |= {"seen": at, "n": life["n"] + 1, "most": max(life["most"], row[4]), "side": row[2], "price": row[3]}
            elif life and (row[2] > life["price"] * (1 + slack) if life["side"] == "sell" else row[3] < life["price"] * (1 - slack)):
                out.append((symbol, name, life["since"], life["seen"], at, "swept", life["n"], life["most"]))
                life = None
    return sorted(out)


def lives_by_stream(spark, updates, bars, ttl, base, cuts=3):
    """Both streams in parts by time, started again from the checkpoint before each part."""
    u_path, b_path = f"{base}/u", f"{base}/b"
    signs = lambda hours: ([("~", "~", "sell", 1e9, 1.0, START + timedelta(hours=hours))], [("~", START + timedelta(hours=hours), 1.0, 1.0)])
    last = max([u[5] for u in updates] + [b[1] for b in bars])
    edges = [START + (last - START) * (k + 1) / cuts for k in range(cuts)]
    before = datetime(1970, 1, 1)
    for edge in edges:
        for rows, path, schema, at in ((updates, u_path, WALLS, 5), (bars, b_path, REACH, 1)):
            append(spark, [x for x in rows if before < x[at] <= edge], schema, path)
        before = edge
        stream = J.stream_wall_lives(spark.readStream.schema(WALLS).parquet(u_path), spark.readStream.schema(REACH).parquet(b_path), ttl.total_seconds(), "2 hours", shards=3)
        run_to_end(spark, stream, base)
    for hours in (4000, 8000):
        a, b = signs(hours)
        append(spark, a, WALLS, u_path)
        append(spark, b, REACH, b_path)
        run_to_end(spark, stream, base)
    rows = kept(spark, stream, base).select("symbol", "id", "since", "last_seen", "gone_at", "reason", "updates", "most_usd").collect()
    return sorted(tuple(r) for r in rows)


def test_a_swept_order_stays_gone_until_heard_of(spark, tmp_path):
    at = lambda hours: START + timedelta(hours=hours)
    updates = [("X", "a", "sell", 100.0, 7.0, at(1)), ("X", "a", "sell", 100.0, 9.0, at(2)), ("X", "a", "sell", 100.0, 3.0, at(8)), ("X", "b", "buy", 90.0, 5.0, at(1)),
               ("X", "c", "sell", 100.0, 1.0, at(4)), ("X", "d", "sell", 100.04, 1.0, at(1))]
    # The wick at 4 passes "a" and "c" (told at that very instant), not "d" within the slack; the pullback at 5 changes nothing.
    bars = [("X", at(3), 99.0, 95.0), ("X", at(4), 100.06, 95.0), ("X", at(5), 96.0, 94.0), ("X", at(12), 97.0, 94.0)]
    got = lives_by_stream(spark, updates, bars, timedelta(hours=6), str(tmp_path), 2)
    assert got == [
        ("X", "a", at(1), at(2), at(4), "swept", 2, 9.0), ("X", "a", at(8), at(8), at(14), "expired", 1, 3.0), ("X", "b", at(1), at(1), at(7), "expired", 1, 5.0),
        ("X", "c", at(4), at(4), at(4), "swept", 1, 1.0), ("X", "d", at(1), at(1), at(7), "expired", 1, 1.0),
    ]


def test_wall_lives_against_brute_force(spark, tmp_path):
    dice = random.Random(11)
    at = lambda: START + timedelta(minutes=dice.randrange(1, 6000))
    updates = [(s, f"w{k}", "sell" if k % 2 else "buy", (103 if k % 2 else 97) + dice.random() * 2, float(dice.randrange(1, 50)), t)
               for s in ("X", "Y") for k in range(8) for t in {at() for _ in range(25)}]
    updates += [updates[3]] * 2
    bars = [(s, START + timedelta(hours=h), 100 + dice.random() * 4.5, 100 - dice.random() * 4.5) for s in ("X", "Y") for h in range(1, 100)]
    ttl = timedelta(hours=5)
    want = lives_by_hand(updates, bars, ttl)
    assert {x[5] for x in want} == {"swept", "expired"}
    assert lives_by_stream(spark, updates, bars, ttl, str(tmp_path)) == want
