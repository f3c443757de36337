"""Training rows from frames of trajectory data sets, from end to end: registered row generators.

A generator names its set's handler (rates, rotations, grippers, arms, margins)
and may override what a set does its own way: the arms' vectors, their clocks,
the candidates, the instruction. Overrides are functions to column expressions,
so one plan makes the rows of all sets side by side: arms -> clocks ->
candidates -> look-ahead of both arms -> still anchors dropped -> slice ->
instruction -> token layout -> domain.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions import text as X
from ..functions.hashing import uniform
from . import handlers as H
from . import vectors as V

#: How a batch gathers a column: rows of one size (stack), or as they are (list).
COLLATE = {"tokens": "stack", "labels": "stack", "proprio": "stack", "action": "stack", "domain": "list", "instruction": "list"}


@dataclass(frozen=True)
class Generator:
    """What a set does its own way. Functions take nothing and read the columns left, right (position, rotation, gripper), left_time, right_time, index, n, instruction and handler."""

    left: Callable[[], Column] | None = None
    right: Callable[[], Column] | None = None
    left_time: Callable[[], Column] | None = None
    right_time: Callable[[], Column] | None = None
    candidate: Callable[[], Column] | None = None
    instruction: Callable[[], Column] | None = None
    relative: tuple[int, ...] = ()
    collate: dict[str, str] = field(default_factory=lambda: dict(COLLATE))


GENERATORS: dict[str, Generator] = {}


def register_generator(name: str, generator: Generator) -> None:
    """Add or replace the generator of a data set that has a handler."""
    H.handler_of(name)
    unknown = set(generator.collate.values()) - {"stack", "list"}
    if unknown:
        raise KeyError(f"unknown ways to collate: {unknown}")
    GENERATORS[name] = generator


def _arm(side: str) -> Column:
    return H.arm_vector(F.col(f"{side}.position"), F.col(f"{side}.rotation"), F.col(f"{side}.gripper"))


def _by_set(generators: dict[str, Generator], what: str, default: Column) -> Column:
    """The set's own expression, or the default one."""
    for name, g in generators.items():
        if getattr(g, what) is not None:
            default = F.when(F.col("handler.name") == name, getattr(g, what)()).otherwise(default)
    return default


def _relative(generators: dict[str, Generator]) -> Column:
    out = F.array().cast("array<int>")
    for name, g in generators.items():
        if g.relative:
            out = F.when(F.col("handler.name") == name, F.array(*map(F.lit, g.relative))).otherwise(out)
    return out


def frames_of(frames: DataFrame, set_name: str, series: list[str], generators: dict[str, Generator] | None = None) -> DataFrame:
    """(set, series, index, n, handler, left, right, lt, rt, ref, hertz, horizon, instruction): frames with both arms as vectors and their clocks.

    frames: (set_name, series, index, left and right: structs of position, rotation, gripper,
    left_time, right_time, hertz, horizon, instruction); the last five may be null where the set's handler knows better.
    """
    own, n = GENERATORS if generators is None else generators, F.count("*").over(Window.partitionBy(*series))
    known = H.with_parameters(frames.withColumnRenamed(set_name, "set"), "set").withColumn("n", n)
    hertz, horizon = F.coalesce("handler.frequency", "hertz").cast("double"), F.coalesce("handler.duration", "horizon").cast("double")
    even = F.col("index") / hertz
    clock = lambda side: _by_set(own, f"{side}_time", F.when(F.col("handler.own_clocks"), F.coalesce(f"{side}_time", even)).otherwise(even)).cast("double")
    one_arm = F.when(F.col("handler.arms") == 2, _arm("right")).otherwise(F.array_repeat(F.lit(0.0), 10))
    made = known.withColumns({"hertz": hertz, "horizon": horizon, "lt": clock("left"), "rt": clock("right"), "l": _by_set(own, "left", _arm("left")), "r": _by_set(own, "right", one_arm), "said": _by_set(own, "instruction", F.col("instruction"))})
    return made.select("set", *series, "index", "n", "handler", F.col("l").alias("left"), F.col("r").alias("right"), "lt", "rt", ((F.col("lt") + F.col("rt")) / 2).alias("ref"), "hertz", "horizon", F.col("said").alias("instruction"))


def sample_rows(frames: DataFrame, series: list[str], actions: int, generators: dict[str, Generator] | None = None) -> DataFrame:
    """(set, series, index, future_index, instruction, proprio, action) from frames_of(): a row for each candidate that moves."""
    own = GENERATORS if generators is None else generators
    last = F.max("ref").over(Window.partitionBy(*series))
    usual = (F.col("index") < F.col("n") - F.col("handler.margin")) & (F.col("index") % F.col("handler.stride") == 0)
    picked = frames.withColumn("last", last).where(_by_set(own, "candidate", usual))
    points = V.look_ahead(picked, [*series, "index"], "ref", F.col("horizon"), F.col("last"), actions)
    found = V.interpolate(frames, points, series, {"left": "lt", "right": "rt"})
    paths = V.sequences(found, [*series, "index"], ["left", "right"])
    moving = paths.where(~(V.still(F.col("left")) & V.still(F.col("right"))))
    facts = picked.select("set", *series, "index", "handler", "instruction", F.least(F.col("index") + F.col("horizon") * F.col("hertz"), F.col("last") * F.col("hertz")).cast("bigint").alias("future_index"))
    joined = moving.join(facts, [*series, "index"])
    cut = V.action_slice(F.zip_with("left", "right", lambda a, b: F.concat(a, b)), _relative(own))
    return joined.withColumn("_cut", cut).select("set", *series, "index", "future_index", "instruction", F.col("_cut.proprio").alias("proprio"), F.col("_cut.action").alias("action"))


def training_rows(frames: DataFrame, set_name: str, series: list[str], domains: DataFrame, tokens: Callable[[Column], Column], actions: int, n_image: int, length: int, ids: S.Ids = S.Ids(), suffix: str = " Future image:", seed: str | None = None, generators: dict[str, Generator] | None = None) -> DataFrame:
    """sample_rows() with the token layout and the domain: (..., domain, tokens, labels, positions, used), and place, their order by seed.

    domains: (name, domain), broadcast (a row for each set); a set without one has domain 0. generators: those of the registry unless given.
    """
    rows = sample_rows(frames_of(frames, set_name, series, generators), series, actions, generators)
    laid = rows.withColumn("_s", S.with_actions(tokens(X.with_suffix_sentence(F.col("instruction"), suffix)), n_image, actions, length, ids))
    named = laid.join(F.broadcast(domains.select(F.col("name").alias("_name"), F.col("domain").alias("_domain"))), F.col("set") == F.col("_name"), "left")
    place = uniform(F.concat_ws(":", "set", *series, "index"), seed) if seed else F.col("index").cast("double")
    return named.select(*rows.columns, F.coalesce("_domain", F.lit(0)).alias("domain"), "_s.*", place.alias("place"))


def collate_by(rows: DataFrame, batch: str, order: str, spec: dict[str, str] | None = None) -> DataFrame:
    """A row for each batch, columns as arrays in order; those to stack must have one size in a batch, else the job fails."""
    spec = spec or COLLATE
    gathered = rows.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(order, *spec))).alias("_rows"))
    out = []
    for c, way in spec.items():
        values = F.col(f"_rows.{c}")
        if way == "stack":
            sizes = F.size(F.array_distinct(F.transform(values, lambda v: F.size(v))))
            values = F.when(sizes <= 1, values).otherwise(F.raise_error(F.lit(f"rows of {c} differ in size")))
        out.append(values.alias(c))
    return gathered.select(batch, *out)
