"""Trajectory data sets as one parameter table: rates, rotations, gripper rules, arms and margins.

A data set is a row of the table, joined by broadcast (a few dozen rows); its
rotation and gripper rule name column expressions. New sets, rotations and rules
are registered, and a name that is not fails instead of passing as another.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import astuple, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


@dataclass(frozen=True)
class Handler:
    """frequency: rows a second; duration: seconds of a query; margin: rows left at the end; stride: of candidates; own_clocks: an arm has its own time axis."""

    name: str
    frequency: int | None
    duration: int | None
    rotation: str
    gripper: str
    arms: int
    margin: int
    stride: int = 1
    own_clocks: bool = False
    shuffled: bool = False


# The data sets.
HANDLERS = {
    h.name: h
    for h in (
        Handler("Calvin", 30, 1, "euler", "below 0", 1, 20),
        Handler("RT1", 3, 10, "quaternion", "raw", 1, 6),
        Handler("Bridge", 5, 5, "euler", "inverted", 1, 10),
        Handler("libero", 30, 1, "six", "above 0", 1, 10),
        Handler("VLABench", 30, 1, "euler", "raw", 1, 15),
        Handler("robotwin2_clean", 30, 1, "quaternion", "inverted", 2, 10),
        Handler("robocasa-human", 30, 1, "six", "above 0", 1, 30),
        Handler("AIR-AGILEX", 30, 2, "quaternion", "scaled below 1", 2, 30, stride=2),
        Handler("AIR-AGILEX-HQ", 30, 2, "six", "scaled below 1", 2, 60, own_clocks=True, shuffled=True),
        Handler("AIRBOT", 10, 3, "six", "below half", 1, 10),
        Handler("widowx-air", 5, 5, "six", "below half", 1, 15),
        Handler("atecup", 30, 1, "six", "raw", 1, 10),
        Handler("Droid-Left", 15, 4, "euler", "raw", 1, 30),
        Handler("robomind-franka", 30, 4, "euler", "raw", 1, 30),
        Handler("robomind-agilex", 30, 4, "euler", "above 2.5", 2, 30),
        Handler("robomind-franka-dual", 30, 4, "euler", "raw", 2, 30),
        Handler("AGIBOT", 30, 4, "quaternion", "raw", 2, 30, stride=4),
        Handler("agiworld-on-site-pack", None, None, "quaternion", "raw", 2, 0),
    )
}

#: Numbers that a rotation takes, and the six numbers from an array that begins with them.
ROTATIONS: dict[str, tuple[int, Callable[[Column], Column]]] = {
    "euler": (3, lambda v: G.six_numbers(G.euler_matrix(v[0], v[1], v[2]))),
    "quaternion": (4, lambda v: G.six_numbers(G.quaternion_matrix(v[0], v[1], v[2], v[3]))),
    "six": (6, lambda v: F.slice(v, 1, 6)),
}
#: The gripper as a number: rules give 1 for closed.
GRIPPERS: dict[str, Callable[[Column], Column]] = {
    "raw": lambda g: g,
    "inverted": lambda g: 1 - g,
    "below 0": lambda g: (g < 0).cast("double"),
    "above 0": lambda g: (g > 0).cast("double"),
    "below half": lambda g: (g < 0.5).cast("double"),
    "above 2.5": lambda g: (g > 2.5).cast("double"),
    "scaled below 1": lambda g: (g * 50 < 1).cast("double"),
}


def register(handler: Handler) -> None:
    """Add or replace a data set; its rotation and gripper rule must be known."""
    if handler.rotation not in ROTATIONS or handler.gripper not in GRIPPERS:
        raise KeyError(f"unknown rotation or gripper rule: {handler.rotation}, {handler.gripper}")
    HANDLERS[handler.name] = handler


def handler_of(name: str) -> Handler:
    if name not in HANDLERS:
        raise KeyError(f"no handler for data set {name}")
    return HANDLERS[name]


def parameters(spark: SparkSession) -> DataFrame:
    kinds = {"frequency": "int", "duration": "int", "arms": "int", "margin": "int", "stride": "int", "own_clocks": "boolean", "shuffled": "boolean"}
    return spark.createDataFrame([astuple(h) for h in HANDLERS.values()], ", ".join(f"{f.name} {kinds.get(f.name, 'string')}" for f in fields(Handler)))


def with_parameters(rows: DataFrame, name: str) -> DataFrame:
    """rows with their data set's parameters in a struct column handler; an unknown set fails."""
    known = parameters(rows.sparkSession)
    known = known.select(F.col("name").alias("_name"), F.struct(*known.columns).alias("handler"))
    missing = F.raise_error(F.concat(F.lit("no handler for data set "), F.coalesce(F.col(name), F.lit("null"))))
    return rows.join(F.broadcast(known), F.col(name) == F.col("_name"), "left").withColumn("handler", F.when(F.col("handler").isNotNull(), F.col("handler")).otherwise(missing)).drop("_name")


def arm_vector(position: Column, rotation: Column, gripper: Column) -> Column:
    """Ten numbers of an arm: position, six of the rotation, gripper, by the rules of the column handler."""
    six = F.lit(None).cast("array<double>")
    for name, (_, f) in ROTATIONS.items():
        six = F.when(F.col("handler.rotation") == name, f(rotation)).otherwise(six)
    closed = F.lit(None).cast("double")
    for name, rule in GRIPPERS.items():
        closed = F.when(F.col("handler.gripper") == name, rule(gripper)).otherwise(closed)
    return G.pose_vector(position, six, closed)


def both_arms(left: Column, right: Column) -> Column:
    """The left arm's ten numbers and the right one's; a single arm has zeroes on the right."""
    return F.concat(left, F.when(F.col("handler.arms") == 2, right).otherwise(F.array_repeat(F.lit(0.0), 10)))


def candidate_rows(rows: DataFrame, series: list[str], index: str) -> DataFrame:
    """Rows (with handler) at their set's stride that leave its margin to the series' end."""
    n = F.count("*").over(Window.partitionBy(*series))
    return rows.withColumn("_n", n).where((F.col(index) < F.col("_n") - F.col("handler.margin")) & (F.col(index) % F.col("handler.stride") == 0)).drop("_n")


def merge_clocks(left: DataFrame, right: DataFrame, series: list[str]) -> DataFrame:
    """(series, anchor, k, at, left, right) of two arms resampled on clocks of their own: the common time is the mean of both."""
    key = [*series, "anchor", "k"]
    l_, r_ = left.select(*key, F.col("at").alias("_l"), F.col("value").alias("left")), right.select(*key, F.col("at").alias("_r"), F.col("value").alias("right"))
    return l_.join(r_, key).select(*key, ((F.col("_l") + F.col("_r")) / 2).alias("at"), "left", "right")
