"""Wall lives without a stream: what is written to state, and the ends of lives against brute force."""

import pickle
import random
from datetime import datetime, timedelta

import pandas as pd
from test_streams import lives_by_hand

from barloom.streaming import jobs as J

START = datetime(2024, 1, 1)
DAY = 86_400_000_000


class State(dict):
    """Value or map state of one key; counts the bytes of the values written."""

    written = 0

    def get(self):
        return self.getValue("")

    def update(self, value):
        self.updateValue("", value)

    def getValue(self, key):
        return super().get(key)

    def updateValue(self, key, value):
        self.written += len(pickle.dumps(value))
        self[key] = value

    def removeKey(self, key):
        del self[key]


class Handle:
    def __init__(self):
        self.states = {}

    def getMapState(self, name, *schemas):
        return self.states.setdefault(name, State())

    def getValueState(self, name, schema):
        return self.states.setdefault(name, State())

    def registerTimer(self, ms):
        pass


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def frame(rows):
    return pd.DataFrame(rows, columns=["us", "id", "side", "price", "usd", "high", "low"])


def micros(at):
    return (at - START) // timedelta(microseconds=1)


def bytes_written(parts):
    handle, lives = Handle(), J.WallLives(DAY, J.SWEEP_SLACK)
    lives.init(handle)
    told = lambda k: (k * 1000 + 17, f"w{k}", "sell", 100.0, 1.0, None, None)
    list(lives.handleInputRows(("X", 0), iter([frame([told(k) for k in range(p * 300, p * 300 + 300)]) for p in range(parts)]), None))
    return sum(s.written for s in handle.states.values())


def test_what_waits_is_written_once():
    assert bytes_written(16) < 2.5 * bytes_written(8)


def test_ends_of_lives_against_brute_force():
    dice = random.Random(5)
    for trial in range(30):
        at = lambda: START + timedelta(hours=dice.randrange(1, 400))
        updates = sorted({("X", f"w{k}", "sell" if k % 2 else "buy", float(dice.randrange(96, 104)), at()) for k in range(6) for _ in range(30)}, key=lambda u: u[4])
        updates = [(*u[:4], float(dice.randrange(1, 50)), u[4]) for u in updates]
        bars = [("X", START + timedelta(hours=h), 100 + dice.random() * 4.5, 100 - dice.random() * 4.5) for h in range(1, 400, 3)]
        rows = [(micros(u[5]), u[1], u[2], u[3], u[4], None, None) for u in updates] + [(micros(b[1]), None, None, None, None, b[2], b[3]) for b in bars]
        dice.shuffle(rows)
        ttl = timedelta(hours=dice.choice([5, 20, 90]))
        handle, lives = Handle(), J.WallLives(ttl // timedelta(microseconds=1), J.SWEEP_SLACK)
        lives.init(handle)
        cut = dice.randrange(100, 300) * 3_600_000_000  # what is later is read in a second batch
        got = []
        for batch, watermark in ((rows[:40], None), ([r for r in rows[40:] if r[0] <= cut], cut // 1000), ([r for r in rows[40:] if r[0] > cut], 10**12)):
            list(lives.handleInputRows(("X", 0), iter([frame(batch[:50]), frame(batch[50:])]), None))
            if watermark:
                got += [r for out in lives.handleExpiredTimer(("X", 0), Clock(watermark), None) for r in out.itertuples(index=False)]
        got = sorted((r.symbol, r.id, *(START + timedelta(microseconds=(t - pd.Timestamp(0)) // pd.Timedelta(microseconds=1)) for t in (r.since, r.last_seen, r.gone_at)), r.reason, r.updates, r.most_usd) for r in got)
        assert got == lives_by_hand(updates, bars, ttl), trial


def test_places_of_old_words_are_forgotten():
    walls = J.Standing(J.Standing.fields.empty_table().to_pandas(), DAY, 0.0)
    walls.spare = 4
    for us in range(100):
        walls.hear(us, "a", "sell", 100.0 + us, 1.0)
        walls.forget()
    assert len(walls.sells) <= 7 and len(walls.quiet) <= 7
    walls.sweep(100, 150.0, 1.0)
    assert not walls.ended()  # only the price told last counts
    walls.sweep(101, 200.0, 1.0)
    assert [x[5:7] for x in walls.ended()] == [(101, "swept")]
