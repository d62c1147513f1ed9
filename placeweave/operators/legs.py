"""The graph of visit slots of a trip: which slot can follow which, how long the leg takes and what it costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions import geo
from placeweave.operators.routes import paths_in_any_zone
from placeweave.operators.trips import day_frame, travel_at

# The three kinds of nodes, minutes added for a leg through a flood zone in a storm.
START, PLACE, END = 0, 1, 2
FLOOD_MINUTES = 30


#: Fields of a node: the range it can be left from and reached by, what it costs, and where it lies.
_NODE = {"kind": "int", "place": "bigint", "lo": "bigint", "hi": "bigint", "visit_minutes": "bigint", "weather_cost": "int", "factor": "double", "stormy": "boolean",
         "lat": "double", "lon": "double"}


def _node(**fields: Column) -> Column:
    return F.struct(*[fields[c].cast(kind).alias(c) for c, kind in _NODE.items()])


def _met(slots: DataFrame, trips: DataFrame) -> DataFrame:
    """``trip, day, a, b, mode``: every node of a trip's day that can be left with every other one that may be reached. The slots of a trip come as
    one row, as its days do, so nothing is sent for each of its pairs."""
    node = _node(kind=F.lit(PLACE), **{c: F.col(c) for c in _NODE if c != "kind"})
    own = slots.groupBy("trip").agg(F.collect_list(F.struct("day", node.alias("node"))).alias("_slots"))
    frame = ["start_day", "end_day", "start_min", "end_min", "day_start", "day_end", "mode", "from_lat", "from_lon", "to_lat", "to_lon"]
    every = trips.filter("trip IS NOT NULL").groupBy("trip").agg(F.collect_list(F.struct(*frame)).alias("_trips")).join(own, "trip", "left").withColumn(
        "_slots", F.coalesce("_slots", F.array().cast(f"array<struct<day:int,node:struct<{','.join(f'{c}:{kind}' for c, kind in _NODE.items())}>>>")))
    framed = F.flatten(F.transform("_trips", lambda t: F.when(t["start_day"] <= t["end_day"], F.sequence(t["start_day"], t["end_day"])).otherwise(F.array().cast("array<int>"))))
    days = every.withColumn("day", F.explode(F.array_distinct(F.concat(framed, F.transform("_slots", lambda s: s["day"])))))

    def bound(kind: int, lat: str, lon: str) -> Column:
        def at(t: Column) -> Column:
            lo, hi = day_frame(lambda name: t[name], F.col("day"))
            return _node(kind=F.lit(kind), place=F.lit(None), lo=lo, hi=hi, visit_minutes=F.lit(0), weather_cost=F.lit(0), factor=F.lit(1.0), stormy=F.lit(False), lat=t[lat], lon=t[lon])

        return F.transform(F.filter("_trips", lambda t: (t["start_day"] <= F.col("day")) & (F.col("day") <= t["end_day"])), at)

    here = F.transform(F.filter("_slots", lambda s: s["day"] == F.col("day")), lambda s: s["node"])
    nodes = days.select("trip", "day", F.transform("_trips", lambda t: t["mode"]).alias("_modes"), here.alias("_here"),
                        bound(START, "from_lat", "from_lon").alias("_from"), bound(END, "to_lat", "to_lon").alias("_to"))
    left = nodes.select("trip", "day", "_modes", F.concat("_here", "_to").alias("_b"), F.explode(F.concat("_from", "_here")).alias("a"))
    # The range of the second slot bounds the pairs before any travel time is known.
    reached = F.filter("_b", lambda b: (F.col("a.lo") + F.col("a.visit_minutes") <= b["hi"]) & ~(
        (F.col("a.kind") == PLACE) & (b["kind"] == PLACE) & (F.col("a.place") == b["place"])))
    return left.select("trip", "day", "_modes", "a", F.explode(reached).alias("b")).select("trip", "day", "a", "b", F.explode("_modes").alias("mode"))


def slot_legs(slots: DataFrame, trips: DataFrame, zones: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """``trip, day, from_kind, from_place, from_lo, to_kind, to_place, to_lo, minutes, cost, flooded``: the legs that can be made.

    ``slots`` are open ones (``trip, day, place, lo, hi, visit_minutes, weather_cost, factor, stormy, lat, lon``), ``trips`` carry
    ``mode, from_lat, from_lon, to_lat, to_lon`` beside the columns of ``trip_days``. A leg joins two slots of one trip and day, of different
    places, the day's start to a slot, a slot to the day's end, or both; it is there when whoever arrives as early as the first slot allows
    and stays for the visit reaches the second before its range ends. Hour and weather of a leg are those of the slot it leads to; of the way
    back, those of the slot left. Minutes are the estimate, or the measured time (``measured`` as in ``travel_at``) nearest to the middle of that
    slot, times its factor. Cost adds the weather cost of the slot reached and, in a storm, a charge for crossing a zone.

    Only lines that a storm may meet are looked for in the zones."""
    met = _met(slots, trips).select(
        "trip", "day", F.col("a.kind").alias("from_kind"), F.col("a.place").alias("from_place"), F.col("a.lo").alias("from_lo"), F.col("a.hi").alias("from_hi"),
        F.col("a.visit_minutes").alias("from_stay"), F.col("a.factor").alias("from_factor"), F.col("a.stormy").alias("from_stormy"),
        F.col("b.kind").alias("to_kind"), F.col("b.place").alias("to_place"), F.col("b.lo").alias("to_lo"), F.col("b.hi").alias("to_hi"),
        F.col("b.weather_cost").alias("weather_cost"), F.col("b.factor").alias("to_factor"), F.col("b.stormy").alias("to_stormy"),
        F.col("a.lat").alias("lat1"), F.col("a.lon").alias("lon1"), F.col("b.lat").alias("lat2"), F.col("b.lon").alias("lon2"), "mode")
    legs = met.withColumn("km", geo.road_km(*[F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]))
    leaves = F.col("from_lo") + F.col("from_stay")
    back = F.col("to_kind") == END
    mid = F.when(back & (F.col("from_kind") == START), F.lit(None)).when(
        back, F.floor((F.col("from_lo") + F.col("from_hi")) / 2) + F.col("from_stay")).otherwise(F.floor((F.col("to_lo") + F.col("to_hi")) / 2))
    legs = legs.withColumns({"factor": F.when(back, F.col("from_factor")).otherwise(F.col("to_factor")),
                             "stormy": F.when(back, F.col("from_stormy")).otherwise(F.col("to_stormy")), "minute": mid})
    if measured is None:
        base = legs.withColumn("base", geo.travel_minutes(F.col("km"), F.col("mode")))
    else:
        base = travel_at(legs.withColumnsRenamed({"from_place": "origin", "to_place": "dest", "minutes": "_m"}), measured).withColumnsRenamed(
            {"origin": "from_place", "dest": "to_place", "minutes": "base"})
    timed = base.withColumn("minutes", F.ceil(F.col("base") * F.col("factor")).cast("int")).filter(leaves + F.col("minutes") <= F.col("to_hi"))
    line = [F.when(F.col("stormy"), F.col(c)) for c in ("lat1", "lon1", "lat2", "lon2")]
    flooded = F.col("stormy") & F.col("_wet")
    return paths_in_any_zone(timed, zones, {"_wet": line}).select(
        "trip", "day", "from_kind", "from_place", "from_lo", "to_kind", "to_place", "to_lo", "minutes",
        (F.col("minutes") + F.col("weather_cost") + F.when(flooded, FLOOD_MINUTES).otherwise(0)).alias("cost"), flooded.alias("flooded"))


def leg_choices(legs: DataFrame) -> DataFrame:
    """``trip, day, from_kind, from_place, to_kind, to_place, slots, minutes, cost, flooded``: between two places, the number of pairs of slots,
    the fewest minutes, the lowest cost and the pairs whose line is flooded."""
    return legs.groupBy("trip", "day", "from_kind", "from_place", "to_kind", "to_place").agg(
        F.count(F.lit(1)).alias("slots"), F.min("minutes").alias("minutes"), F.min("cost").alias("cost"), F.count_if("flooded").alias("flooded"))
