"""Turn-by-turn instructions: a scan along each route, and texts in several languages.

A route is read as arrays: points, and for every point the attributes of the piece that
leads away from it and the branches there.  Generators are asked in order at each point; the
first answer wins and the scan goes on where it ends.  A positive turn is to the left.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import line_length
from waymark.operators.texts import Settings, Texts


def signed(angle: float) -> int:
    """(-180, 180], cut towards zero."""
    a = angle % 360
    return int(a - 360 if a > 180 else a)


def _sign(x: int) -> int:
    return (x > 0) - (x < 0)


def _bearing(a: tuple[float, float], b: tuple[float, float]) -> float:
    """Angle with the meridian, 0 for points that coincide."""
    east, north = (b[0] - a[0]) * math.cos(math.radians(a[1])), b[1] - a[1]
    return math.degrees(math.atan2(east, north)) if east or north else 0.0


class Branch(NamedTuple):
    """A way that leaves the route at a point: its next point, and its attributes."""

    lon: float
    lat: float
    attrs: dict[str, str] = {}


@dataclass
class Line:
    """One route, indexed by point; piece k leads from point k to the next."""

    points: list[tuple[float, float]]
    attrs: list[dict[str, str]]
    branches: dict[int, list[Branch]] = field(default_factory=dict)

    @cached_property
    def last(self) -> int:
        return len(self.points) - 1

    @cached_property
    def _metres(self) -> list[float]:
        pairs = zip(self.points, self.points[1:], strict=False)
        return [math.hypot(math.radians(c - a) * math.cos(math.radians((b + d) / 2)), math.radians(d - b)) * 6_371_000 for (a, b), (c, d) in pairs]

    @cached_property
    def _departing(self) -> list[float]:
        return [*map(_bearing, self.points, self.points[1:]), 0.0]

    @cached_property
    def _turns(self) -> list[int]:
        d = self._departing
        return [signed(a - b) for a, b in zip([0.0, *d], d, strict=False)]

    @cached_property
    def _along(self) -> list[int]:
        """For every point the first one after it where a street that is followed ends: the same for all points before it on that street."""
        out = [self.last] * (self.last + 1)
        for k in range(self.last - 2, -1, -1):
            i = k + 1
            goes_on = abs(self._turns[i]) <= 35 and self.name(i) == self.name(k) and not self.ring(i)
            out[k] = out[i] if goes_on else i
        return out

    def metres(self, k: int) -> float:
        return self._metres[k]

    def departing(self, k: int) -> float:
        """Bearing of the piece after a point; 0 at the end, where nothing follows."""
        return self._departing[k]

    def arriving(self, k: int) -> float:
        return self._departing[k - 1] if k > 0 else 0.0

    def turn(self, k: int) -> int:
        """Change of direction at a point."""
        return self._turns[k]

    def name(self, k: int) -> str | None:
        return self.attrs[k].get("name")

    def ring(self, k: int) -> bool:
        return self.attrs[k].get("junction") == "roundabout"

    def until(self, k: int, goes_on: Callable[[int], bool]) -> int:
        """The first point after ``k`` where something that began there does not go on; the last point if it always does."""
        return next((i for i in range(k + 1, self.last) if not goes_on(i)), self.last)

    def span(self, k: int, end: int) -> tuple[int, float]:
        """Sum of the turns at the points from ``k`` to before ``end``, and metres of the pieces there."""
        return sum(map(self.turn, range(k, end))), sum(map(self.metres, range(k, end)))


Found = tuple[str, int, int, int, dict[str, Any]]


def start(r: Line, k: int) -> Found | None:
    return ("start", 0, 0, 0, {"startdegrees": str(signed(r.departing(0))), "projectiondistance": "0"}) if k == 0 else None


def end(r: Line, k: int) -> Found | None:
    return ("end", k, k + 1, 0, {"projectiondistance": "0"}) if k == r.last - 1 else None


def roundabout(r: Line, k: int) -> Found | None:
    """From the point before the ring to the point after the exit, if the route goes on there; the turn is that from the way in to the way out.

    Exits are counted by the ways that leave at the ring's points, the first one included.
    """
    if k >= r.last - 1 or not r.ring(k + 1):
        return None
    out = r.until(k, r.ring)
    passed = sum(len(r.branches.get(i, ())) for i in range(k + 1, out))
    return ("roundabout", k, out + (out + 1 < r.last), signed(r.arriving(k) - r.departing(out)), {"exitnumber": str(passed + 1)})


def _steep(total: int, metres: float) -> bool:
    return abs(total) >= 45 or not metres or abs(total) / metres >= 2.5


def _inside(r: Line, k: int, side: int) -> bool:
    """Whether a way leaves on the side to which the route bends, at least as sharply as the route turns."""
    return any(_sign(t) == side and abs(t) >= abs(r.turn(k)) for t in (signed(r.arriving(k) - _bearing(r.points[k], b[:2])) for b in r.branches.get(k, ())))


def follow_bend(r: Line, k: int) -> Found | None:
    """Turns to one side under one name, in pieces of at most 35 metres, with no way inside the bend."""
    if not 0 < k < r.last:
        return None
    side = _sign(r.turn(k))
    out = r.until(k, lambda i: r.metres(i) <= 35 and _sign(r.turn(i)) == side and r.name(i) == r.name(k) and not _inside(r, i, side))
    total, metres = r.span(k, out)
    return ("followbend", k, out, total, {}) if out - k > 2 and _steep(total, metres) else None


def follow_along(r: Line, k: int) -> Found | None:
    """One name and no turn over 35 degrees; the turn is that between the ways in at both ends."""
    if not 0 < k < r.last:
        return None
    out = r._along[k]
    total = signed(r.arriving(out) - r.arriving(k))
    # A turn of under 45 degrees is steep over a few metres only: no need to measure on.
    return None if abs(total) >= 45 or total and _steep(total, r.span(k, min(out, k + 1))[1]) and _steep(total, r.span(k, out)[1]) else ("followalong", k, out, total, {})


def turn(r: Line, k: int) -> Found | None:
    """Turns to one side in pieces of at most 5 metres."""
    if not 0 < k < r.last:
        return None
    side = _sign(r.turn(k))
    out = r.until(k, lambda i: r.metres(i) <= 5 and _sign(r.turn(i)) == side)
    total, metres = r.span(k, out)
    return ("turn", k, out - 1, total, {}) if _steep(total, metres) else None


def intersection(r: Line, k: int) -> Found | None:
    """Rank of the way taken among the ways at a point, from left to right; ``roads`` has all of them in that order.

    The direction of another way is measured from its next point to the crossing, that of the way taken from the crossing on.
    """
    if k + 1 >= r.last or not r.branches.get(k):
        return None
    own = r.turn(k)
    others = [(signed(r.arriving(k) - _bearing((b[0], b[1]), r.points[k])), dict(b[2]) if len(b) > 2 else {}) for b in r.branches[k]]
    rank = sum(t >= own for t, _ in others)
    roads = sorted(others, key=lambda x: -x[0])
    roads.insert(rank, (own, r.attrs[k]))
    return ("intersection", k, k + 1, own, {"rank": str(rank), "actualindex": str(rank), "ways": str(len(roads)), "roads": roads})


def base(r: Line, k: int) -> Found | None:
    """What to do at the next point, wherever that is not the last."""
    return ("base", k, k + 1, r.turn(k + 1), {}) if k + 1 < r.last else None


GENERATORS: dict[str, Callable[[Line, int], Found | None]] = {"start": start, "end": end, "roundabout": roundabout, "followbend": follow_bend, "followalong": follow_along, "turn": turn, "intersection": intersection, "base": base}
DEFAULT = ("start", "roundabout", "followbend", "followalong", "turn", "base")


def scan(r: Line, generators=DEFAULT, *, gaps: bool = False) -> list[Found]:
    """The first answer at each point, going on where it ends, and the end.

    A point where no generator answers is an error, or with ``gaps`` passed over.
    """
    chosen = [g if callable(g) else GENERATORS[g] for g in generators]
    out, k = [], 0
    while k < r.last:
        found = next((f for g in chosen if (f := g(r, k))), None)
        if found:
            out.append(found)
        elif not gaps:
            raise ValueError(f"no generator has an instruction for point {k}")
        k = max(k + 1, found[2] if found else 0)
    return [*out, end(r, r.last - 1)]


def value(r: Line, f: Found, key: str) -> str | None:
    """A property (in lower case), or an attribute where the instruction begins (.), ends (+), or of the piece before it (-)."""
    kind, k, end, degrees, extra = f
    if key[0] in ".+-":
        at = {".": k, "+": end, "-": k - 1}[key[0]]
        return r.attrs[at].get(key[1:]) if 0 <= at < r.last else None
    found = {"type": kind, "turndegrees": str(degrees), "shapeindex": str(k), "shapeindexend": str(end)}.get(key, extra.get(key))
    return found if isinstance(found, str) else None


def text(r: Line, f: Found, texts: Texts) -> str:
    return texts(lambda key: value(r, f, key))


_INSTRUCTION = "seq int, type string, shape_idx int, shape_idx_end int, turn_degrees int, exit_number int, roads array<struct<degrees:int,attrs:map<string,string>>>, texts map<string,string>"


def instructions(routes: DataFrame, *, generators=None, languages: tuple[str, ...] = ("en",), settings: Settings | None = None, gaps: bool = False) -> DataFrame:
    """Routes (query_id, shape, meta as built by ``routes.build``) to query_id, seq, type, shape_idx, shape_idx_end, turn_degrees, exit_number (of roundabouts), roads (at intersections, from the left), texts (by language).

    An optional column ``branches`` (array of shape_idx, lon, lat, and if there are any attrs) gives the ways that are passed.
    ``gaps``: points where none of the generators answers are passed over instead of failing.
    """
    settings = Settings() if settings is None else settings
    generators = settings.generators if generators is None else generators
    rules = {c: settings.languages[c] for c in languages}
    kind = routes.schema["query_id"].dataType.simpleString()
    sides = F.col("branches") if "branches" in routes.columns else F.array().cast("array<struct<shape_idx:int,lon:double,lat:double>>")
    if "branches" not in routes.columns or "attrs" not in routes.schema["branches"].dataType.elementType.names:
        sides = F.transform(sides, lambda b: b.withField("attrs", F.create_map().cast("map<string,string>")))
    metas = F.transform("meta", lambda m: F.struct(m["shape_idx"].alias("shape_idx"), F.from_json(m["attrs"], "map<string,string>").alias("attrs")))
    tags = lambda m: {k: v for k, v in (dict(m) if m is not None else {}).items() if v is not None}

    def line(q) -> Line:
        attrs: list[dict[str, str]] = []
        for m in q.meta:
            attrs += [tags(m["attrs"])] * (m["shape_idx"] - len(attrs))
        r = Line([(p["lon"], p["lat"]) for p in q.shape], attrs)
        for b in q.branches if q.branches is not None else ():
            r.branches.setdefault(b["shape_idx"], []).append(Branch(b["lon"], b["lat"], tags(b["attrs"])))
        return r

    def rows(q, texts: dict[str, Texts]) -> Iterator[tuple]:
        r = line(q)
        for n, f in enumerate(scan(r, generators, gaps=gaps) if r.last > 0 else ()):
            roads = [{"degrees": d, "attrs": a} for d, a in f[4].get("roads", ())]
            yield q.query_id, n, *f[:4], int(f[4]["exitnumber"]) if "exitnumber" in f[4] else None, roads, {c: text(r, f, texts[c]) for c in languages}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = {c: Texts(r) for c, r in rules.items()}
        for b in batches:
            out = pd.DataFrame([x for q in b.itertuples(index=False) for x in rows(q, texts)], columns=["query_id", *(c.split()[0] for c in _INSTRUCTION.split(", "))])
            yield out.astype({"exit_number": "Int32"})

    picked = routes.select("query_id", "shape", metas.alias("meta"), sides.alias("branches"))
    return picked.mapInPandas(run, f"query_id {kind}, {_INSTRUCTION}")


def augment(routes: DataFrame, found: DataFrame, prefix: str = "instruction:") -> DataFrame:
    """Routes whose metas also hold the texts of the instruction they lie in, under ``prefix`` and the language.

    Metas and instructions end at different points of the shape: the new metas end at both.
    Distances are measured along the shape, times follow the old meta's speed.  A route
    without instructions keeps its metas.
    """
    listed = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("shape_idx_end").alias("end"), "seq", F.to_json("texts").alias("texts")))).alias("found"))
    joined = routes.join(listed, "query_id", "left").withColumn("found", F.coalesce("found", F.array().cast(listed.schema["found"].dataType)))
    last = F.element_at("meta", -1)["shape_idx"]
    ends = F.array_sort(F.array_distinct(F.concat(F.transform("meta", lambda m: m["shape_idx"]), F.transform("found", lambda f: f["end"]))))
    joined = joined.withColumn("ends", F.filter(ends, lambda e: (e > 0) & (e <= last)))
    begins = F.slice(F.concat(F.array(F.lit(0)), "ends"), F.lit(1), F.size("ends"))

    def piece(end, begin):
        m = F.filter("meta", lambda m: m["shape_idx"] >= end)[0]
        texts = F.from_json(F.get(F.filter("found", lambda f: f["end"] >= end), F.lit(0))["texts"], "map<string,string>")
        own = F.map_filter(F.from_json(m["attrs"], "map<string,string>"), lambda k, _: ~k.startswith(prefix))
        named = F.transform_keys(F.coalesce(texts, F.create_map().cast("map<string,string>")), lambda k, _: F.concat(F.lit(prefix), k))
        metres = line_length(F.slice("shape", begin + 1, end - begin + 1))
        seconds = F.when(m["metres"] > 0, metres * m["seconds"] / m["metres"]).otherwise(0.0)
        return F.struct(end.alias("shape_idx"), m["edge_id"].alias("edge_id"), m["forward"].alias("forward"), F.to_json(F.map_concat(F.coalesce(own, F.create_map().cast("map<string,string>")), named)).alias("attrs"), metres.alias("metres"), seconds.alias("seconds"))

    return joined.withColumn("meta", F.zip_with("ends", begins, piece)).select(*routes.columns)
