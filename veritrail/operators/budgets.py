"""Budgets as ordered state: reservations charged at their worst case, settled or given back, under ceilings of run, session and day.

Log: (ledger, seq, session, run, op, kind, reservation, tokens, micros, bytes, day). op is reserve, settle or abandon; kind, of a
reservation, model_call, fetch or index_lookup; amounts are estimates of a reservation, actual ones of a settlement, and
the bytes that came of an abandoned fetch (null: unknown). Money is in millionths, whole numbers. A ledger is what shares the ceiling of a
day; its events are taken in the order of seq. Names of dimensions are fixed values, and so is the order in which they are asked.

A reservation that a ceiling of its run refuses charges nothing. One that only session or day refuse gives back what its run
was charged, while session and day stay charged: too much is the safe side. A settlement charges what was used, then tells what it
exceeds. A model call that is abandoned gives all back; a fetch keeps its count and the bytes that came, or all if unknown. A
refund of another day's reservation is dropped from the day's total. No total falls below zero.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What a run's counters count, in order.
COUNTERS = ("calls", "tokens", "micros", "fetches", "lookups", "bytes")
#: Limits: of a run's counters, of a session and of a day.
LIMITS = {"model_calls": 40, "tokens": 400_000, "cost_usd": 5_000_000, "fetches": 60, "index_lookups": 200, "fetch_bytes": 500_000_000, "session_cost_usd": 20_000_000, "daily_cost_usd": 50_000_000}
_COLUMNS = ("ledger", "seq", "session", "run", "op", "kind", "reservation", "tokens", "micros", "bytes", "day")
RESULT = "ledger long, seq long, status string, dimension string, " + ", ".join(f"{c} long" for c in COUNTERS) + ", session_micros long, day_micros long"


class Ledger:
    """The state of one ledger: counters of runs, totals of sessions and of the day, and reservations that are open."""

    def __init__(self, limits: dict[str, int], state: dict | None = None):
        self.limits, self.state = limits, state or {"runs": {}, "sessions": {}, "day": None, "total": 0, "open": {}}

    def _shared(self, session: str, micros: int, day: str, reserved: str) -> str | None:
        """Charges session and day, both in any case; the first ceiling that is exceeded."""
        s = self.state
        s["sessions"][session] = total = max(0, s["sessions"].get(session, 0) + micros)
        if s["day"] != day:
            s["day"], s["total"] = day, 0
        if not (micros < 0 and reserved != day):
            s["total"] = max(0, s["total"] + micros)
        return "session_cost_usd" if total > self.limits["session_cost_usd"] else "daily_cost_usd" if s["total"] > self.limits["daily_cost_usd"] else None

    def _reserve(self, e, run: dict) -> tuple[str, str | None]:
        limits, name = self.limits, str(e.reservation)
        if name in self.state["open"]:
            return "problem", "reservation_is_open"
        tokens, micros, size = int(e.tokens or 0), int(e.micros or 0), int(e.bytes or 0)
        if e.kind == "model_call":
            asked = (("model_calls", run["calls"] + 1), ("tokens", run["tokens"] + tokens), ("cost_usd", run["micros"] + micros))
        else:
            counted = "fetches" if e.kind == "fetch" else "lookups"
            asked = (("fetches" if e.kind == "fetch" else "index_lookups", run[counted] + 1), ("fetch_bytes", run["bytes"] + size))
        over = next((d for d, n in asked if n > limits[d]), None)
        if over:
            return "refused", over
        if e.kind == "model_call":
            over = self._shared(str(e.session), micros, e.day, e.day)
            if over:
                return "refused", over
            run["calls"], run["tokens"], run["micros"] = run["calls"] + 1, run["tokens"] + tokens, run["micros"] + micros
        else:
            run[counted], run["bytes"] = run[counted] + 1, run["bytes"] + size
        self.state["open"][name] = [str(e.run), str(e.session), e.kind, tokens, micros, size, e.day]
        return "admitted", None

    def _close(self, e) -> tuple[str, str | None, dict]:
        held = self.state["open"].pop(str(e.reservation), None)
        if held is None:
            return "problem", "no_open_reservation", self.run(e.run)
        name, session, kind, tokens, micros, size, reserved = held
        run, limits = self.run(name), self.limits
        if kind != "model_call":
            used = size if e.bytes is None else int(e.bytes)
            run["bytes"] = max(0, run["bytes"] + used - size)
            over = "fetch_bytes" if e.op == "settle" and run["bytes"] > limits["fetch_bytes"] else None
        elif e.op == "settle":
            run["tokens"], run["micros"] = max(0, run["tokens"] + int(e.tokens or 0) - tokens), max(0, run["micros"] + int(e.micros or 0) - micros)
            over = self._shared(session, int(e.micros or 0) - micros, e.day, reserved)
            over = over or ("tokens" if run["tokens"] > limits["tokens"] else "cost_usd" if run["micros"] > limits["cost_usd"] else None)
        else:
            run["calls"], run["tokens"], run["micros"] = max(0, run["calls"] - 1), max(0, run["tokens"] - tokens), max(0, run["micros"] - micros)
            self._shared(session, -micros, e.day, reserved)
            over = None
        return ("settled" if e.op == "settle" else "abandoned"), over, run

    def run(self, name) -> dict:
        return self.state["runs"].setdefault(str(name), dict.fromkeys(COUNTERS, 0))

    def take(self, e) -> tuple:
        """(status, dimension, counters of the run, session's total, day's total) after an event."""
        run = self.run(e.run)
        if e.op == "reserve":
            status, dimension = self._reserve(e, run)
        elif e.op in ("settle", "abandon"):
            status, dimension, run = self._close(e)
        else:
            status, dimension = "problem", "unknown_op"
        return status, dimension, *[run[c] for c in COUNTERS], self.state["sessions"].get(str(e.session), 0), self.state["total"]


def _picked(log: DataFrame) -> DataFrame:
    whole = ("ledger", "seq", "tokens", "micros", "bytes")
    return log.select(*[F.col(c).cast("long" if c in whole else "string").alias(c) for c in _COLUMNS])


def _taken(ledger: Ledger, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.astype(object).where(rows.notna(), None)
    out = [(e.ledger, e.seq, *ledger.take(e)) for e in rows.itertuples(index=False)]
    return pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])


def admitted(log: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """(ledger, seq, status, dimension, counters of the run, session_micros, day_micros) after each event.

    status: admitted, refused (dimension names the ceiling), settled, abandoned (dimension: what is exceeded now) or problem
    (reservation_is_open, no_open_reservation, unknown_op). Each ledger's events are sorted and folded as they stream
    through one task, which holds runs, sessions and open reservations of one ledger and never its events: a
    ceiling that all share has an order, so a ledger is not divided. Events with a null ledger or seq have no place and no row.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, ledger = None, None
        for frame in frames:
            for name, rows in frame.groupby("ledger", sort=True):
                if name != current:
                    current, ledger = name, Ledger(limits)
                yield _taken(ledger, rows)

    return _picked(log).where("ledger IS NOT NULL AND seq IS NOT NULL").repartition("ledger").sortWithinPartitions("ledger", "seq").mapInPandas(fold, RESULT)


def admissions(log: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """The same over a stream: what a ledger holds is its state; within a batch events are sorted, across batches arrival is the order."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ledger = Ledger(limits, json.loads(state.get[0]) if state.exists else None)
        out = _taken(ledger, pd.concat(list(frames)).sort_values("seq"))
        state.update((json.dumps(ledger.state),))
        yield out

    picked = _picked(log).where("ledger IS NOT NULL AND seq IS NOT NULL")
    return picked.groupBy("ledger").applyInPandasWithState(step, RESULT, "held string", "append", GroupStateTimeout.NoTimeout)
