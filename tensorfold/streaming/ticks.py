"""Fields over ticks: feedback, sensors, actuators, checkpoints, and the same on tables and live streams.

A graph's body computes, from the values of a tick, its outputs and the next values of its registers. ``reset`` sets
registers to their initial fields, pulls the sensors and evaluates once, so outputs hold at time 0; a step
moves every register and sensor on together. Registers are written to the shared folder at each step, so
lineage doesn't grow with time, and a lost executor costs no more than the step's own tasks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..field import Field
from ..sources.tables import read_field, write_field
from ..types import FieldType, check


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it; one of our own only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    check(bool(found) or spark.sparkContext.master.startswith("local"), "name a folder that all executors share in spark.checkpoint.dir")
    return (found or "file:///tmp/checkpoints/tensorfold").rstrip("/")


class Sensor:
    """A source of frames: ``next_value`` gives an array or field, or None, which keeps the last frame.

    A pipelined sensor fetches one frame ahead: after reset it has been asked twice, and frame t is still seen at
    time t. An unpipelined one is asked once for each tick and must answer. Without a first frame the field is 0.
    """

    def __init__(self, type: FieldType, next_value: Callable[[], object], pipelined: bool = True, reset_hook: Callable[[], None] | None = None):
        self.type, self.next_value, self.pipelined, self.reset_hook = type, next_value, pipelined, reset_hook
        self.now: Field | None = None
        self.ahead: Field | None = None

    def _fetch(self, spark: SparkSession) -> Field | None:
        value = self.next_value()
        if value is None:
            check(self.pipelined, "an unpipelined sensor answers at each tick")
            return None
        f = value if isinstance(value, Field) else Field.of(spark, value, len(self.type.tensor), self.type.kind)
        check(f.type == self.type, f"the sensor's frame is {f.type}, not {self.type}")
        return f

    def reset(self, spark: SparkSession) -> None:
        if self.reset_hook:
            self.reset_hook()
        first = self._fetch(spark)
        if first is None:
            from ..operators.shape import fill

            first = Field.generate(spark, self.type.shape, lambda *_: fill(self.type), self.type.tensor, self.type.kind)
        self.now = first
        self.ahead = self._fetch(spark) if self.pipelined else None

    def advance(self, spark: SparkSession) -> None:
        self.now = (self.ahead if self.pipelined else self._fetch(spark)) or self.now
        if self.pipelined:
            self.ahead = self._fetch(spark)


class Actuator:
    """A consumer of an output: a pipelined one is given ``init`` at reset and then the value of the tick before."""

    def __init__(self, output: str, consume: Callable[[Field], None], pipelined: bool = True, init: Field | None = None):
        self.output, self.consume, self.pipelined, self.init = output, consume, pipelined, init


class TickGraph:
    """``body(values, time)`` gets the registers' and sensors' fields by name and returns outputs by name; an output named
    like a register is that register's next value. A larger next value is trimmed to the register's shape."""

    def __init__(self, spark: SparkSession, body: Callable[[dict[str, Field], int], dict[str, Field]], registers: dict[str, Field] | None = None, sensors: dict[str, Sensor] | None = None, actuators: list[Actuator] | None = None):
        self.spark, self.body, self.initial = spark, body, registers or {}
        self.sensors, self.actuators = sensors or {}, actuators or []
        self.registers: dict[str, Field] = {}
        self.outputs: dict[str, Field] = {}
        self.time = -1
        self._stopped = False
        self.folder = f"{shared_folder(spark)}/ticks-{uuid.uuid4().hex[:12]}"

    def _evaluate(self) -> None:
        self.outputs = self.body({**self.registers, **{n: s.now for n, s in self.sensors.items()}}, self.time)

    def reset(self) -> TickGraph:
        self.time, self.registers = 0, dict(self.initial)
        for s in self.sensors.values():
            s.reset(self.spark)
        self._evaluate()
        for a in self.actuators:
            if not a.pipelined:
                a.consume(self.outputs[a.output])
            else:
                a.consume(a.init or self.outputs[a.output] * 0.0)
        return self

    def step(self, n: int = 1) -> TickGraph:
        if self.time < 0:
            self.reset()
        for _ in range(n):
            before = self.outputs
            following = {}
            for name, now in self.registers.items():
                value = before.get(name, now)
                if value.shape != now.shape:
                    from ..operators.shape import trim

                    value = trim(value, now.shape)
                check(value.type == now.type, f"the register {name} is {now.type}, its next value {value.type}")
                path = f"{self.folder}/{name}/{self.time + 1}"
                write_field(value, path)
                following[name] = read_field(self.spark, path)
            for a in self.actuators:
                if a.pipelined:
                    a.consume(before[a.output])
            self.registers, self.time = following, self.time + 1
            for s in self.sensors.values():
                s.advance(self.spark)
            self._evaluate()
            for a in self.actuators:
                if not a.pipelined:
                    a.consume(self.outputs[a.output])
        return self

    def run(self, most: int | None = None) -> TickGraph:
        """Step until ``stop`` is called, as by an actuator, or ``most`` ticks are done."""
        self._stopped = False
        if self.time < 0:
            self.reset()
        while not self._stopped and (most is None or most > 0):
            self.step()
            most = None if most is None else most - 1
        return self

    def stop(self) -> None:
        """End ``run`` after the tick that is being done."""
        self._stopped = True

    def names(self) -> list[str]:
        """What can be read: outputs, registers and sensors."""
        return sorted({*self.outputs, *self.registers, *self.sensors})

    def field(self, name: str) -> Field:
        """The field of this tick that has a name; an output hides the register it sets."""
        for where in (self.outputs, self.registers):
            if name in where:
                return where[name]
        check(name in self.sensors, f"no field is named {name}")
        return self.sensors[name].now

    def read(self, name: str):
        """A probed value of this tick, as an array."""
        return self.field(name).read()

    def read_all(self) -> dict:
        """All named values of this tick, as arrays."""
        return {name: self.read(name) for name in self.names()}

    def save(self, path: str) -> None:
        """Time, registers and sensors' current frames; the body is code and isn't saved."""
        state = {**{f"register/{n}": f for n, f in self.registers.items()}, **{f"sensor/{n}": s.now for n, s in self.sensors.items() if s.now is not None}}
        for name, f in state.items():
            write_field(f, f"{path}/{name}")
        manifest = json.dumps({"time": self.time, "state": sorted(state)})
        self.spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    def restore(self, path: str) -> TickGraph:
        """Go on from a saved state; sensors go on with their own next frames."""
        manifest = json.loads(self.spark.read.text(f"{path}/manifest").first()[0])
        self.time = manifest["time"]
        for name in manifest["state"]:
            kind, own = name.split("/", 1)
            if kind == "register":
                self.registers[own] = read_field(self.spark, f"{path}/{name}")
            else:
                self.sensors[own].now = read_field(self.spark, f"{path}/{name}")
        self._evaluate()
        return self


# ---- ticks as a column of a table ------------------------------------------------------------------------------


def hold_last(frames: DataFrame, tick: str, value: str, keys: tuple[str, ...] = (), first: float = 0.0) -> Column:
    """An asynchronous sensor over a table: the last value that isn't null, ``first`` before there is one."""
    w = W.partitionBy(*keys).orderBy(tick).rowsBetween(W.unboundedPreceding, 0)
    return F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(first))


def delay(value: str, tick: str, keys: tuple[str, ...] = (), n: int = 1, init: float = 0.0) -> Column:
    """n registers in a row, or for n = 1 a pipelined actuator: the value n ticks ago, ``init`` before."""
    return F.lag(value, n, init).over(W.partitionBy(*keys).orderBy(tick))


def accumulate(value: str, tick: str, keys: tuple[str, ...] = (), init: float = 0.0) -> Column:
    """The register x <== x + value: at tick t, ``init`` and the values of all ticks before."""
    w = W.partitionBy(*keys).orderBy(tick).rowsBetween(W.unboundedPreceding, -1)
    return F.lit(init) + F.coalesce(F.sum(value).over(w), F.lit(0.0))


# ---- live streams ----------------------------------------------------------------------------------------------


def hold_last_stream(stream: DataFrame, key: str, tick: str, value: str, first: float = 0.0) -> DataFrame:
    """(key, tick, value) of a live stream of frames: nulls take the key's last value, over micro-batches.

    The state is one number for each key. Within a micro-batch a key's rows are taken by tick.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key_, batches: Iterator, state: GroupState):
        import pandas as pd

        rows = pd.concat(list(batches)).sort_values("tick", kind="stable")
        last = state.get[0] if state.exists else first
        rows["value"] = rows["value"].ffill().fillna(last)
        state.update((float(rows["value"].iloc[-1]),))
        yield rows[["key", "tick", "value"]]

    named = stream.select(F.col(key).cast("string").alias("key"), F.col(tick).cast("bigint").alias("tick"), F.col(value).cast("double").alias("value"))
    return named.groupBy("key").applyInPandasWithState(run, "key string, tick bigint, value double", "last double", "append", GroupStateTimeout.NoTimeout)


def windowed_sum(stream: DataFrame, time: str, value: str, length: str, late: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums over tumbling windows of event time; what comes later than ``late`` is left out. An extension: the ticks
    of fields have no event time."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.sum(value).alias("sum_value"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "sum_value", "n")
