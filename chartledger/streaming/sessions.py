"""Per-session state of streaming jobs: escalation that only rises, and expiry by timers.

One state row per session is read and written once a batch, so no batch reads earlier output. A
session's timer stands at its earliest possible end; when the watermark passes it, the session is
told as expired and its state is removed.
"""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from chartledger.config.rules import ESCALATION_RULES
from chartledger.config.vocabulary import PRIORITIES
from chartledger.functions.conditions import condition_sql, quote

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocks(df: DataFrame) -> None:
    """Keep state in the embedded store that stateful processors need."""
    df.sparkSession.conf.set(PROVIDER, ROCKS)


class RuleTable:
    """Rules over numbered conditions: what a value meets is told by numbers, so the state of a
    path is its order and those numbers, whatever the value."""

    def __init__(self, rules=ESCALATION_RULES):
        self.conditions, self.number, self.by_path = [], {}, {}
        self.rules = []
        for _id, level, _label, clauses in rules:
            told = [frozenset(self._numbered(c) for c in clause) for clause in clauses]
            self.rules.append((PRIORITIES.index(level), told))
        # What holds while a path has no value.
        self.absent = {p: frozenset(i for i in held if self._holds_without_value(i))
                       for p, held in self.by_path.items()}

    def _numbered(self, condition) -> int:
        path, op, arg = condition
        key = (path, op, tuple(arg) if isinstance(arg, list) else arg)
        if key not in self.number:
            self.number[key] = len(self.conditions)
            self.by_path.setdefault(path, []).append(len(self.conditions))
            self.conditions.append(condition)
        return self.number[key]

    def _holds_without_value(self, i: int) -> bool:
        _path, op, arg = self.conditions[i]
        return op in ("recorded", "not_recorded") and bool(arg) == (op == "not_recorded")

    def held_sql(self, value: str = "value") -> str:
        """Numbers of the conditions that a row's value meets, as an array."""
        cases = []
        for path, numbers in self.by_path.items():
            tests = ", ".join(
                f"CASE WHEN {condition_sql(self.conditions[i], lambda _p: value)} THEN {i} END"
                for i in numbers)
            cases.append(f"WHEN path = {quote(path)} THEN array_compact(array({tests}))")
        return f"CASE {' '.join(cases)} END" if cases else "CAST(NULL AS ARRAY<INT>)"

    def priority(self, held: dict[str, frozenset]) -> int:
        """The highest level of a rule that has a clause all of whose conditions hold."""
        true = frozenset().union(*[held.get(p, none) for p, none in self.absent.items()])
        return max((level for level, clauses in self.rules if any(c <= true for c in clauses)),
                   default=0)


def marked_facts(facts: DataFrame, table: RuleTable) -> DataFrame:
    """Facts as the processor reads them: session_id, at (microseconds), seq, path (null where no
    rule reads it), held. Conditions are evaluated here, by Spark's own expressions."""
    known = F.col("path").isin(*table.by_path)
    return facts.filter("session_id IS NOT NULL").select(
        "session_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.col("seq").cast("long").alias("seq"), F.when(known, F.col("path")).alias("path"),
        F.expr(table.held_sql()).alias("held"))


def _rank(at, seq) -> tuple:
    """Order of facts; missing times and numbers come first."""
    return (at is not None, at or 0, seq is not None, seq or 0)


class PriorityProcessor(StatefulProcessor):
    """The last value of every rule path and the priority of a session; one row per increase."""

    STATE = "priority int, paths array<string>, at array<bigint>, seq array<bigint>, " \
            "held array<string>"
    OUT = "session_id string, from_priority int, to_priority int"

    def __init__(self, table: RuleTable):
        self.table = table

    def init(self, handle) -> None:
        self.state = handle.getValueState("session", self.STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        told, before = {}, None
        if self.state.exists():
            before, *lists = self.state.get()
            told = {p: (t, s, h) for p, t, s, h in zip(*lists, strict=True)}
        for r in rows:
            if r.path is None or r.held is None:
                continue
            if r.path not in told or _rank(r.at, r.seq) >= _rank(*told[r.path][:2]):
                told[r.path] = (r.at, r.seq, ",".join(map(str, sorted(r.held))))
        held = {p: frozenset(int(i) for i in h.split(",") if i) for p, (_t, _s, h) in told.items()}
        now = self.table.priority(held)
        top = now if before is None else max(before, now)
        columns = [list(c) for c in zip(*[(p, *v) for p, v in told.items()], strict=True)]
        self.state.update((top, *(columns or [[], [], [], []])))
        if before is None or now > before:
            yield Row(session_id=key[0], from_priority=before, to_priority=now)

    def close(self) -> None:
        pass


class ExpiryProcessor(StatefulProcessor):
    """Open stretches of a session (first and last time in microseconds, rows), told when the
    watermark passes their end. ``fixed`` ends a stretch ``ttl_seconds`` after its first row, else
    after its last one. Open stretches reach back no further than the watermark's delay."""

    STATE = "starts array<bigint>, lasts array<bigint>, counts array<bigint>"
    OUT = "session_id string, started_at bigint, expired_at bigint, rows bigint"

    def __init__(self, ttl_seconds: int, fixed: bool):
        self.ttl, self.fixed = ttl_seconds * 1_000_000, fixed

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", self.STATE)

    def _end(self, stretch) -> int:
        return stretch[0 if self.fixed else 1] + self.ttl

    def _joined(self, stretches: list) -> list:
        """Stretches in order, each ending before the next begins."""
        out = []
        for start, last, rows in sorted(stretches):
            if out and start < self._end(out[-1]):
                out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + rows)
            else:
                out.append((start, last, rows))
        return out

    def _keep(self, stretches: list) -> None:
        """Store what is open and move the timer to the earliest end; without any, remove both."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if not stretches:
            self.state.clear()
            return
        self.state.update(tuple(list(c) for c in zip(*stretches, strict=True)))
        self.handle.registerTimer(-(-min(self._end(s) for s in stretches) // 1000))

    def _open(self) -> list:
        return list(zip(*self.state.get(), strict=True)) if self.state.exists() else []

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self._keep(self._joined(self._open() + [(r.at, r.at, 1) for r in rows]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        stretches = self._open()
        self._keep([s for s in stretches if self._end(s) > passed])
        for s in stretches:
            if self._end(s) <= passed:
                yield Row(session_id=key[0], started_at=s[0], expired_at=self._end(s), rows=s[2])

    def close(self) -> None:
        pass
