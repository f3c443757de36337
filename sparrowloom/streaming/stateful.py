"""Streams with state of their own: weighted interleave, action plans, chunk caches, rollouts.

Each operator is a processor with state per key that Spark keeps in its state
store (transformWithState needs the RocksDB one: rocksdb()), so a restart from
the checkpoint goes on where it stopped. Rows of a key must arrive in order
from batch to batch; a key's rows of one batch are sorted by `order` here.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import chain

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StructField, StructType

def _struct(**fields: DataType) -> StructType:
    """Workers have no session that could parse a schema."""
    return StructType([StructField(n, t) for n, t in fields.items()])


LONG, DOUBLES = LongType(), ArrayType(DoubleType())
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def rocksdb(spark: SparkSession) -> None:
    """Fail where the session's state store can't hold these operators' state."""
    found = spark.conf.get(PROVIDER)
    if "RocksDB" not in found:
        raise ValueError(f"{PROVIDER} is {found}: set org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _schema(rows: DataFrame, *columns: str) -> str:
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ", ".join(f"`{c}` {fields[c]}" for c in columns)


class _Processor(StatefulProcessor):
    """row makes an output row of its values."""

    row: Row

    def close(self) -> None:
        pass


def _run(rows: DataFrame, keys: list[str], processor: _Processor, out: str) -> DataFrame:
    rocksdb(rows.sparkSession)
    schema = StructType.fromDDL(out)
    processor.row = Row(*schema.names)
    return rows.groupBy(*keys).transformWithState(processor, schema, "append", "none")


def _sorted(rows: Iterator[Row], order: str) -> list[Row]:
    return sorted(rows, key=lambda r: (r[order] is not None, r[order]))


class _Queue:
    """A first-in, first-out queue in a map state: rows by number, first and next number in a value state."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, schema: StructType):
        self.items = handle.getMapState(f"{name}_items", _struct(n=LONG), schema)
        self.ends = handle.getValueState(f"{name}_ends", _struct(first=LONG, next=LONG))

    def _span(self) -> tuple[int, int]:
        return tuple(self.ends.get()) if self.ends.exists() else (0, 0)

    def __len__(self) -> int:
        first, after = self._span()
        return after - first

    def push(self, value: tuple) -> None:
        first, after = self._span()
        self.items.updateValue((after,), value)
        self.ends.update((first, after + 1))

    def pop(self) -> tuple:
        first, after = self._span()
        value = tuple(self.items.getValue((first,)))
        self.items.removeKey((first,))
        self.ends.update((first + 1, after))
        return value


def next_source(taken: list[int], shares: list[Fraction]) -> int:
    """Whose turn it is after so many rows of each: of those behind enough, the one that would be a whole row behind first.

    This keeps every source within one row of its share of every prefix (the
    chairman assignment rule), which picking the largest deficit does not for three sources or more.
    """
    n, slack = sum(taken) + 1, Fraction(1, max(1, 2 * len(shares) - 2))
    return min((i for i, s in enumerate(shares) if n * s - taken[i] >= slack or len(shares) == 1), key=lambda i: ((1 - slack - n * shares[i] + taken[i]) / shares[i], i))


class _Interleaver(_Processor):
    def __init__(self, weights: dict[str, float], order: str, payload: list[str], schema: StructType):
        total = sum(Fraction(str(w)) for w in weights.values())
        self.names, self.shares = list(weights), [Fraction(str(w)) / total for w in weights.values()]
        self.order, self.payload, self.schema = order, payload, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queues = [_Queue(handle, f"source_{i}", self.schema) for i in range(len(self.names))]
        self.taken = handle.getValueState("taken", _struct(taken=ArrayType(LONG)))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers) -> Iterator[Row]:  # noqa: N802
        taken = list(self.taken.get()[0]) if self.taken.exists() else [0] * len(self.names)
        for r in _sorted(rows, self.order):
            self.queues[self.names.index(r.loader)].push(tuple(r[c] for c in self.payload))
        while len(self.queues[turn := next_source(taken, self.shares)]):
            value = self.queues[turn].pop()
            yield self.row(*key, sum(taken), self.names[turn], *value)
            taken[turn] += 1
        self.taken.update((taken,))


def weighted_interleave(streams: dict[str, DataFrame], weights: dict[str, float], order: str, lanes: int = 1) -> DataFrame:
    """(lane, place, loader, columns): the streams' rows in an order in which each has its share by weight of every prefix, to within one row.

    State holds each source's waiting rows and how many were taken; where it is
    the turn of one that has none, the others wait for it. Rows are dealt to
    lanes by a hash of order, each of which interleaves on its own: with one lane there is one order and one task.
    """
    if set(streams) != set(weights) or min(weights.values()) <= 0:
        raise ValueError("each stream needs a weight above 0")
    tagged = None
    for name, stream in streams.items():
        own = stream.withColumns({"loader": F.lit(name), "lane": F.pmod(F.xxhash64(order), F.lit(lanes)).cast("int")})
        tagged = own if tagged is None else tagged.unionByName(own, allowMissingColumns=True)
    payload = [c for c in tagged.columns if c not in ("loader", "lane")]
    schema = _schema(tagged, *payload)
    return _run(tagged, ["lane"], _Interleaver(weights, order, payload, StructType.fromDDL(schema)), f"lane int, place bigint, loader string, {schema}")


class _Planner(_Processor):
    def __init__(self, order: str, held: int):
        self.order, self.held = order, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.plan = _Queue(handle, "plan", _struct(action=DOUBLES))
        self.waiting = _Queue(handle, "waiting", _struct(n=LONG))
        self.pose = handle.getValueState("pose", _struct(pose=DOUBLES))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers) -> Iterator[Row]:  # noqa: N802
        pose = self.pose.get()[0] if self.pose.exists() else None
        for r in _sorted(rows, self.order):
            if r.plan is not None:
                for action in r.plan:
                    self.plan.push((action,))
                if r.plan:
                    # The next question starts from where this plan ends.
                    pose = r.plan[-1][: self.held]
                    self.pose.update((pose,))
            else:
                if not len(self.plan):
                    # The first step without an action asks for a plan; those after it wait along.
                    if not len(self.waiting):
                        yield self.row(*key, r[self.order], True, None, pose)
                    self.waiting.push((r[self.order],))
                else:
                    yield self.row(*key, r[self.order], False, self.plan.pop()[0], pose)
            while len(self.plan) and len(self.waiting):
                step = self.waiting.pop()[0]
                yield self.row(*key, step, False, self.plan.pop()[0], pose)
                if len(self.waiting) and not len(self.plan):
                    # This plan was too short for all that wait.
                    first = self.waiting.pop()[0]
                    yield self.row(*key, first, True, None, pose)
                    rest = [self.waiting.pop() for _ in range(len(self.waiting))]
                    for w in chain([(first,)], rest):
                        self.waiting.push(w)


def action_plans(rows: DataFrame, key: str, order: str, held: int = 9) -> DataFrame:
    """(key, order, asks, action, pose) from steps and plans of episodes (key, order, plan: null for a step, else a list of vectors).

    A step takes the next planned action; where there is none it asks once for a
    plan, from the pose that the last plan ended in (its last action's first
    `held` numbers; null before any plan), and gets its action when the plan comes.
    """
    own = rows.select(key, order, F.transform("plan", lambda a: F.transform(a, lambda x: x.cast("double"))).alias("plan"))
    own = own.withColumn(order, F.col(order).cast("bigint"))
    return _run(own, [key], _Planner(order, held), f"{_schema(own, key)}, `{order}` bigint, asks boolean, action array<double>, pose array<double>")


class _Chunker(_Processor):
    def __init__(self, order: str, frame: str, schema: StructType, first: int, size: int, kept: int):
        self.order, self.frame, self.schema, self.first, self.size, self.kept = order, frame, schema, first, size, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", self.schema)
        self.ring = handle.getListState("ring", self.schema)
        self.chunk = handle.getValueState("chunk", _struct(chunk=LONG))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers) -> Iterator[Row]:  # noqa: N802
        chunk = self.chunk.get()[0] if self.chunk.exists() else 0
        held = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        ring = [tuple(x) for x in self.ring.get()] if self.ring.exists() else []
        for r in _sorted(rows, self.order):
            held.append((r[self.order], r[self.frame]))
            if len(held) == (self.size if chunk else self.first):
                yield self.row(*key, chunk, [h[0] for h in held], [h[1] for h in held], [x[1] for x in ring])
                ring = (ring + held)[-self.kept :]
                held, chunk = [], chunk + 1
        self.chunk.update((chunk,))
        for state, values in ((self.open, held), (self.ring, ring)):
            if values:
                state.put(values)
            elif state.exists():
                state.clear()


def chunk_frames(rows: DataFrame, key: str, order: str, frame: str, first: int = 1, size: int = 4, kept: int = 2) -> DataFrame:
    """(key, chunk, places, frames, cache): whole chunks of first, size, size, ... frames of a series, each with the `kept` frames before it.

    State holds the frames of the chunk that is not whole yet (one that never
    gets whole is not given out) and a ring of the last `kept` frames.
    """
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    state = f"at {fields[order]}, frame {fields[frame]}"
    out = f"{_schema(rows, key)}, chunk bigint, places array<{fields[order]}>, frames array<{fields[frame]}>, cache array<{fields[frame]}>"
    return _run(rows.select(key, order, frame), [key], _Chunker(order, frame, StructType.fromDDL(state), first, size, kept), out)


def doubled_frames(chunks: DataFrame, key: str) -> DataFrame:
    """(key, frame, value, half) of chunk_frames(): each frame (an array of two halves of channels) becomes two, 2t and 2t + 1."""
    frames = chunks.select(key, F.explode(F.arrays_zip("places", "frames")).alias("f"))
    return frames.select(key, F.col("f.places").alias("t"), F.posexplode("f.frames").alias("half", "value")).select(key, (F.col("t") * 2 + F.col("half")).cast("bigint").alias("frame"), "half", "value")


class _Rollout(_Processor):
    def __init__(self, order: str, done: str, horizon: int, payload: list[str]):
        self.order, self.done, self.horizon, self.payload = order, done, horizon, payload

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", _struct(steps=LONG, over=BooleanType()))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers) -> Iterator[Row]:  # noqa: N802
        steps, over = self.state.get() if self.state.exists() else (0, False)
        for r in [] if over else _sorted(rows, self.order):
            won = bool(r[self.done])
            steps += 1
            over = won or steps >= self.horizon
            yield self.row(*key, *(r[c] for c in self.payload), steps - 1, over, won)
            if over:
                break
        self.state.update((steps, over))


def rollouts(rows: DataFrame, key: str, order: str, done: str, horizon: int) -> DataFrame:
    """(key, columns, step, ends, won): an episode's rows up to the first that is done, or up to its horizon; what comes later is dropped."""
    payload = [c for c in rows.columns if c != key]
    return _run(rows, [key], _Rollout(order, done, horizon, payload), f"{_schema(rows, key, *payload)}, step bigint, ends boolean, won boolean")
