"""Vehicle profiles as declarative rules compiled to column expressions.

A profile says how fast a vehicle moves on each kind of way, in which directions, and which
turns it may not take.  Factors are evaluated on the dictionary of attribute sets and joined
to edges by type, so the rules run once for each set and not once for each edge.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the built-in profiles, in km/h.
CAR_SPEEDS = {
    "motorway": 120, "motorway_link": 120, "trunk": 120, "trunk_link": 120, "primary": 90, "primary_link": 90,
    "secondary": 70, "secondary_link": 70, "tertiary": 70, "tertiary_link": 70, "unclassified": 50, "residential": 50,
    "service": 50, "services": 50, "road": 15, "living_street": 15, "ferry": 15,
}
BICYCLE_SPEEDS = dict.fromkeys(
    "primary primary_link secondary secondary_link tertiary tertiary_link unclassified residential service services road track cycleway path living_street ferry".split(), 15
)
PEDESTRIAN_SPEEDS = dict.fromkeys(
    "primary primary_link secondary secondary_link tertiary tertiary_link unclassified residential service services road track cycleway footway pedestrian path steps living_street ferry".split(), 5
)


@dataclass(frozen=True)
class Profile:
    name: str
    speeds: dict[str, int] = field(default_factory=dict)
    #: Factor (hundredths of seconds per metre, whole) is numerator / speed; None: factor 1 wherever there is access.
    numerator: float | None = 3600.0
    oneway_keys: tuple[str, ...] = ("oneway",)
    #: Column of attributes -> boolean: a turn of that type is forbidden.
    forbids: Callable[[Column], Column] | None = None
    honour_access: bool = False
    #: Column of attributes -> whole number: what a turn cost of that type is multiplied with before it is added to a path.
    turn_weight: Callable[[Column], Column] | None = None

    @property
    def keys(self) -> tuple[str, ...]:
        """Attribute keys that the profile reads."""
        return ("highway", "route", "junction", *self.oneway_keys, *(("access",) if self.honour_access else ()))

    def speed(self, attrs: Column) -> Column:
        kind = F.when(attrs["route"] == "ferry", "ferry").otherwise(attrs["highway"])
        table = F.create_map(*[F.lit(x) for pair in self.speeds.items() for x in pair])
        speed = F.coalesce(table[kind], F.lit(0))
        return F.when(attrs["access"].isin("no", "private"), 0).otherwise(speed) if self.honour_access else speed

    def directions(self, attrs: Column) -> tuple[Column, Column]:
        """(may go forward, may go backward); the last of the keys that is set decides."""
        value = F.coalesce(*[attrs[k] for k in reversed(self.oneway_keys)], F.when(attrs["junction"] == "roundabout", "yes"), F.lit("no"))
        return value != "-1", ~value.isin("yes", "true", "1")

    def turn_factor(self, attrs: Column) -> tuple[Column, Column]:
        """(factor, forbidden) of a turn type; both count only where the turn has a cost."""
        factor = F.lit(0) if self.turn_weight is None else self.turn_weight(attrs)
        forbidden = F.lit(False) if self.forbids is None else self.forbids(attrs)
        return F.coalesce(factor, F.lit(0)).cast("long"), F.coalesce(forbidden, F.lit(False))

    def factors(self, attrs: Column) -> list[Column]:
        """fwd_factor, bwd_factor (long), fwd_speed, bwd_speed (hundredths of m/s), can_stop."""
        speed = self.speed(attrs)
        forward, backward = self.directions(attrs)
        factor = F.when(speed > 0, F.floor(F.lit(self.numerator) / speed) if self.numerator is not None else F.lit(1)).otherwise(0).cast("long")
        pace = F.floor(speed / F.lit(3.6) * 100).cast("int")
        zero = F.lit(0)
        return [
            F.when(forward, factor).otherwise(zero).cast("long").alias("fwd_factor"),
            F.when(backward, factor).otherwise(zero).cast("long").alias("bwd_factor"),
            F.when(forward, pace).otherwise(zero).cast("int").alias("fwd_speed"),
            F.when(backward, pace).otherwise(zero).cast("int").alias("bwd_speed"),
            (speed > 0).alias("can_stop"),
        ]


def _car_turns(attrs: Column) -> Column:
    return F.coalesce(attrs["barrier"].isNotNull() | (attrs["type"] == "restriction"), F.lit(False))


def _bicycle_turns(attrs: Column) -> Column:
    return F.coalesce((attrs["restriction"] == "yes") & (attrs["bicycle"] == "yes"), F.lit(False))


CAR = Profile("car", CAR_SPEEDS, 3600.0, forbids=_car_turns)
CAR_SHORT = Profile("car.short", CAR_SPEEDS, None, forbids=_car_turns)
BICYCLE = Profile("bicycle", BICYCLE_SPEEDS, 360.0, ("oneway", "oneway:bicycle"), _bicycle_turns)
PEDESTRIAN = Profile("pedestrian", PEDESTRIAN_SPEEDS, 360.0, ("oneway:foot",))
PROFILES = {p.name: p for p in (CAR, CAR_SHORT, BICYCLE, PEDESTRIAN)}


def edge_factors(types: DataFrame, *profiles: Profile) -> DataFrame:
    """profile, type_id and factors of every attribute set in ``types`` (type_id, attrs)."""
    out = None
    for p in profiles:
        part = types.select(F.lit(p.name).alias("profile"), "type_id", *p.factors(F.col("attrs")))
        out = part if out is None else out.unionByName(part)
    return out


def turn_factors(types: DataFrame, *profiles: Profile) -> DataFrame:
    """profile, turn_type_id, factor, is_binary (forbidden) of every turn type in ``types`` (turn_type_id, attrs)."""
    out = None
    for p in profiles:
        factor, binary = p.turn_factor(F.col("attrs"))
        part = types.select(F.lit(p.name).alias("profile"), "turn_type_id", factor.alias("factor"), binary.alias("is_binary"))
        out = part if out is None else out.unionByName(part)
    return out


#: Types up to this many are broadcast to the edges; more are joined by key.
BROADCAST_TYPES = 100_000


def _typed(edges: DataFrame, types: DataFrame, key: str) -> DataFrame:
    few = types.count() <= BROADCAST_TYPES
    types = types.select(key, "type_id")
    return edges.join(F.broadcast(types) if few else types, key).select("edge_id", "type_id")


def prepare(edges: DataFrame, *profiles: Profile) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edge_id, type_id), (type_id, attrs) and (profile, type_id, factors): edges typed by what the profiles read of their attributes.

    Attributes that no profile reads make no types of their own; with other profiles the types are made anew.
    """
    from waymark.functions.attributes import canonical, keep
    from waymark.storage import numbered

    keys = sorted({k for p in profiles for k in p.keys})
    typed = edges.select("edge_id", keep(F.coalesce("attrs", F.create_map().cast("map<string,string>")), keys).alias("attrs")).withColumn("text", F.to_json(canonical(F.col("attrs"))))
    types = numbered(typed.groupBy("text").agg(F.first("attrs").alias("attrs")), "text").withColumnRenamed("id", "type_id")
    return _typed(typed, types, "text"), types.select("type_id", "attrs"), edge_factors(types, *profiles)


def minimise(edges: DataFrame, *profiles: Profile) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of :func:`prepare` with as few types as can be: sets of attributes that cost the same for every profile are one.

    Sets are rated whole, so nothing hangs on ``keys`` being complete.  A type's attributes are the shortest of its sets,
    without what no profile says it reads where that is rated the same.
    """
    from waymark.functions.attributes import canonical, keep
    from waymark.storage import numbered

    keys = sorted({k for p in profiles for k in p.keys})
    rated = lambda attrs: F.to_json(F.array(*[F.struct(*p.factors(attrs)) for p in profiles]))
    full = edges.select("edge_id", F.coalesce("attrs", F.create_map().cast("map<string,string>")).alias("attrs")).withColumn("text", F.to_json(canonical(F.col("attrs"))))
    sets = full.groupBy("text").agg(F.first("attrs").alias("attrs")).withColumn("rating", rated(F.col("attrs"))).withColumn("kept", keep(F.col("attrs"), keys))
    sets = sets.withColumn("kept", F.when(rated(F.col("kept")) == F.col("rating"), F.col("kept")).otherwise(F.col("attrs")))
    order = F.struct(F.size("kept"), F.to_json(canonical(F.col("kept"))))
    types = numbered(sets.groupBy("rating").agg(F.min_by("kept", order).alias("attrs")), "rating").withColumnRenamed("id", "type_id")
    by_set = sets.select("text", "rating").join(types.select("rating", "type_id"), "rating").select("text", "type_id")
    return _typed(full, by_set, "text"), types.select("type_id", "attrs"), edge_factors(types, *profiles)
