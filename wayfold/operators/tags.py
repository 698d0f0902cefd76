"""Tag parsing and way attributes as folds over tag arrays.

Tags stay arrays of (k, v): their order and repeats have meaning.  A parsed tag
is (parts, first, val, sel, pos): the set of key parts, the first one, the
value, its selectivity and its place; arrays are sorted by (sel, pos), so later
ones are more specific and overwrite earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import dims, scalars



def tag_value(tags: Column, key: str) -> Column:
    """Value of the first tag with a key, else the empty string."""
    return F.coalesce(F.get(F.filter(tags, lambda t: t["k"] == key), 0)["v"], F.lit(""))


def _any(parts: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(parts, dims.strings(names))


def selectivity(parts: Column) -> Column:
    """Low for broad keys, high for specific ones."""

    def worth(condition: Column, points: int) -> Column:
        return F.when(condition, points).otherwise(0)

    return (
        worth(_any(parts, dims.MODIFIERS), 10)
        + worth(F.array_contains(parts, "lanes_inner"), 100)
        + worth(F.array_contains(parts, "vehicle"), 1000)
        + worth(_any(parts, ("motor_vehicle", "psv")), 10_000)
        + worth(_any(parts, dims.VEHICLES), 100_000)
    )


def parse_tags(tags: Column) -> Column:
    """Parsed tags of an array of (k, v); keys with an unknown part are left out.

    Each step is a pass of its own over the tags, so that no part of it is
    evaluated twice for a tag.
    """
    raw = F.transform(tags, lambda t, i: F.struct(i.alias("pos"), F.split(t["k"], ":").alias("raw"), t["v"].alias("val")))
    named = F.transform(
        raw, lambda t: F.struct(t["pos"].alias("pos"), F.get(t["raw"], 0).alias("first"), F.transform(t["raw"], lambda p, i: F.when((i > 0) & (p == "lanes"), F.lit("lanes_inner")).otherwise(p)).alias("parts"), t["val"].alias("val"))
    )
    known = F.filter(named, lambda t: F.forall(t["parts"], lambda p: p.isin(*dims.KEY_PARTS)))
    one = F.transform(
        known, lambda t: F.struct(selectivity(t["parts"]).alias("sel"), t["pos"].alias("pos"), F.array_sort(F.array_distinct(t["parts"])).alias("parts"), t["first"].alias("first"), t["val"].alias("val"))
    )
    return F.array_sort(one)


def has_all(parts: Column, names: tuple[str, ...]) -> Column:
    return F.size(F.array_except(dims.strings(names), parts)) == 0


def find_value(ptags: Column, names: tuple[str, ...]) -> Column:
    """Value of the first parsed tag with exactly these parts, else the empty string."""
    wanted = dims.strings(tuple(sorted(names)))
    return F.coalesce(F.get(F.filter(ptags, lambda t: t["parts"] == wanted), 0)["val"], F.lit(""))


def _rest(parts: Column, modifiers: tuple[str, ...]) -> Column:
    return F.array_sort(F.array_except(parts, dims.strings(modifiers)))


def _lane_speed(value: Column, lanes: Column) -> Column:
    best = F.array_max(F.transform(F.split(value, r"\|"), lambda v: F.coalesce(scalars.parse_speed(v), F.lit(-1))))
    return F.when(lanes, best).otherwise(F.coalesce(scalars.parse_speed(value), F.lit(-1)))


#: Key parts that name vehicles of a kind, besides that kind's own access keys.
CAR, BICYCLE = ("vehicle", "motor_vehicle", "motorcar"), ("vehicle", "bicycle")


def maxspeed(ptags: Column, vehicles: tuple[str, ...] = CAR) -> Column:
    """(forward, backward) km/h for a kind of vehicle; 0 where no tag gives one."""
    own = F.filter(ptags, lambda t: _rest(t["parts"], ("forward", "backward", "lanes_inner", *vehicles)) == dims.strings(("maxspeed",)))
    read = F.transform(
        own,
        lambda t: F.struct(
            _lane_speed(t["val"], F.array_contains(t["parts"], "lanes_inner")).alias("speed"), F.array_contains(t["parts"], "forward").alias("forward"), F.array_contains(t["parts"], "backward").alias("backward")
        ),
    )
    good = F.filter(read, lambda t: t["speed"].between(1, 1023))
    last = lambda rows: F.coalesce(F.try_element_at(rows, F.lit(-1))["speed"], F.lit(0))
    return F.struct(last(F.filter(good, lambda t: t["forward"] | ~t["backward"])).alias("forward"), last(F.filter(good, lambda t: ~t["forward"])).alias("backward"))


def car_maxspeed(ptags: Column) -> Column:
    return maxspeed(ptags, CAR)


def bicycle_maxspeed(ptags: Column) -> Column:
    return maxspeed(ptags, BICYCLE)


def access(ptags: Column, default: Column, vehicles: tuple[str, ...] = CAR) -> Column:
    """(forward, backward) access ordinals for a kind of vehicle, from a default for both.

    Broad keys come first and specific ones overwrite them; ``access`` alone
    never opens what is closed, and lanes without a value only improve.
    """
    kinds = [("access",), *[("access", v) for v in vehicles], *[(v,) for v in vehicles]]
    wheels = "bicycle" in vehicles
    turned = ("forward", "backward", "lanes_inner", "both_ways") if wheels else ("forward", "backward", "lanes_inner")

    def ordinal(value: Column, of_wheels: Column) -> Column:
        known = dims.ordinal(dims.ACCESS, value)
        return F.when(of_wheels & (value == "use_sidepath"), F.lit(0)).otherwise(known) if wheels else known

    rests = F.transform(ptags, lambda t: F.struct(_rest(t["parts"], turned).alias("rest"), t["parts"].alias("parts"), t["first"].alias("first"), t["val"].alias("val")))
    own = F.filter(rests, lambda t: F.array_contains(F.array(*[dims.strings(tuple(sorted(k))) for k in kinds]), t["rest"]))
    each = F.transform(
        own,
        lambda t: F.struct(
            (t["rest"] == dims.strings(("access",))).alias("weak"),
            F.when(F.array_contains(t["parts"], "lanes_inner"), F.split(t["val"], r"\|")).otherwise(F.array(t["val"])).alias("values"),
            (t["first"] == "bicycle").alias("wheels"),
            F.array_contains(t["parts"], "forward").alias("forward"),
            F.array_contains(t["parts"], "backward").alias("backward"),
        ),
    )
    valued = F.transform(
        each,
        lambda t: F.struct(
            # unknown values mean no
            F.greatest(F.lit(0), F.coalesce(F.array_max(F.transform(t["values"], lambda v: ordinal(v, t["wheels"]))), F.lit(0))).alias("value"),
            F.array_contains(t["values"], "").alias("improve"),
            t["weak"].alias("weak"),
            t["forward"].alias("forward"),
            t["backward"].alias("backward"),
        ),
    )

    def fold(held: Column, tag: Column) -> Column:
        def side(now: Column, hit: Column) -> Column:
            return F.when(hit & (~tag["weak"] | (now != 0)) & (~tag["improve"] | (tag["value"] > now)), tag["value"]).otherwise(now)

        return F.struct(side(held["forward"], tag["forward"] | ~tag["backward"]).alias("forward"), side(held["backward"], tag["backward"] | ~tag["forward"]).alias("backward"))

    return F.aggregate(valued, F.struct(default.cast("int").alias("forward"), default.cast("int").alias("backward")), fold)


def car_access(ptags: Column, default: Column) -> Column:
    return access(ptags, default, CAR)


def bicycle_access(ptags: Column, default: Column) -> Column:
    return access(ptags, default, BICYCLE)


def direction(ptags: Column, highway: Column, vehicles: tuple[str, ...] = CAR) -> Column:
    """Direction name for a kind of vehicle; null for an unknown oneway value."""
    ring = F.exists(ptags, lambda t: F.array_contains(t["parts"], "junction") & t["val"].isin("roundabout", "circular"))
    default = F.when(highway.startswith("motorway") | ring, "forward").otherwise("both")
    names = F.create_map(*[F.lit(x) for pair in dims.DIRECTIONS.items() for x in pair])
    own = F.filter(ptags, lambda t: (t["first"] == "oneway") & (F.size(F.array_except(t["parts"], dims.strings(("oneway", *vehicles)))) == 0))
    return F.when(F.size(own) > 0, F.try_element_at(names, F.element_at(own, -1)["val"])).otherwise(default)


def car_direction(ptags: Column, highway: Column) -> Column:
    return direction(ptags, highway, CAR)


def bicycle_direction(ptags: Column, highway: Column) -> Column:
    """As for cars, and an opposite cycleway opens a one-way road."""
    opposite = F.exists(ptags, lambda t: (t["first"] == "cycleway") & (F.size(F.array_except(t["parts"], dims.strings(("cycleway", "left", "right")))) == 0) & t["val"].startswith("opposite"))
    own = direction(ptags, highway, BICYCLE)
    open_now = own.isin("both", "alternating", "reversible")
    return F.when(opposite & own.isNull(), "backward").when(opposite & ~open_now, "both").otherwise(own)


def _best_named(values: tuple[str, ...], value: Column, lanes: Column) -> Column:
    """Ordinal of a value, of lanes the best (least) one; null if it is unknown."""
    return F.when(lanes, F.array_min(F.transform(F.split(value, r"\|"), lambda v: dims.ordinal(values, v)))).otherwise(dims.ordinal(values, value))


def surface(ptags: Column) -> Column:
    """(surface, smoothness, tracktype) ordinals forward and backward; null without a known one."""
    wanted = {"surface": dims.SURFACES, "smoothness": dims.SMOOTHNESS, "tracktype": dims.TRACKTYPES}
    plain = dims.strings((*wanted, "lanes_inner", "forward", "backward"))
    own = F.filter(ptags, lambda t: F.arrays_overlap(t["parts"], dims.strings(tuple(wanted))) & (F.size(F.array_except(t["parts"], plain)) == 0))

    def side(name: str, other: str) -> Column:
        mine = F.filter(own, lambda t: F.array_contains(t["parts"], name) & (F.lit(True) if name == "tracktype" else ~F.array_contains(t["parts"], other)))
        last = F.try_element_at(mine, F.lit(-1))
        lanes = F.lit(False) if name == "tracktype" else F.coalesce(F.array_contains(last["parts"], "lanes_inner"), F.lit(False))
        return _best_named(wanted[name], last["val"], lanes)

    return F.struct(*[side(name, other).alias(f"{name}_{way}") for name in wanted for way, other in (("forward", "backward"), ("backward", "forward"))])


def zones(ptags: Column) -> Column:
    """country, environment and motorroad (forward, backward) that speed and zone tags name."""
    kinds = F.array(*[dims.strings(k) for k in (("maxspeed",), ("maxspeed", "source"), ("maxspeed", "type"), ("maxspeed", "zone"), ("traffic", "zone"))])
    turned = ("forward", "backward", "both_ways")
    sides = F.transform(
        ptags,
        lambda t: F.struct(
            _rest(t["parts"], turned).alias("rest"), t["val"].alias("val"), F.array_contains(t["parts"], "forward").alias("forward"), F.array_contains(t["parts"], "backward").alias("backward"),
            F.split(t["val"], ":", 2).alias("said"),
        ),
    )
    speeds = F.filter(sides, lambda t: F.array_contains(kinds, t["rest"]) & ~t["val"].rlike("^([0-9]|$)"))
    said = F.transform(
        speeds, lambda t: F.struct(F.when(F.size(t["said"]) > 1, scalars.country_number(F.get(t["said"], 0))).otherwise(0).alias("ncc"), F.element_at(t["said"], -1).alias("env"), t["forward"].alias("forward"), t["backward"].alias("backward"))
    )
    last = lambda rows, field: F.try_element_at(rows, F.lit(-1))[field]
    place = F.filter(said, lambda t: t["env"].isin("rural", "urban"))
    roads = F.filter(sides, lambda t: t["rest"] == dims.strings(("motorroad",)))
    ahead, behind = (lambda t: t["forward"] | ~t["backward"]), (lambda t: ~t["forward"])
    return F.struct(
        scalars.country_code(F.coalesce(last(F.filter(said, lambda t: t["ncc"] > 0), "ncc"), F.lit(0))).alias("country"),
        last(F.filter(place, ahead), "env").alias("env_forward"),
        last(F.filter(place, behind), "env").alias("env_backward"),
        F.coalesce(last(F.filter(roads, ahead), "val") == "yes", F.lit(False)).alias("motorroad_forward"),
        F.coalesce(last(F.filter(roads, behind), "val") == "yes", F.lit(False)).alias("motorroad_backward"),
    )


def way_attributes(ptags: Column, highway: Column, default_access: Column, default_speed: Column, limit: Column, vehicles: tuple[str, ...] = CAR) -> Column:
    """(access, speed) forward and backward of a way, null where a kind of vehicle can't drive.

    Direction, then access, then speed; alternating traffic takes a third of it.
    """
    car = vehicles == CAR
    way = direction(ptags, highway, CAR) if car else bicycle_direction(ptags, highway)
    parts = F.struct(way.alias("way"), access(ptags, default_access, vehicles).alias("access"), maxspeed(ptags, vehicles).alias("speed"))

    def sides(p: Column) -> Column:
        both = p["way"].isin("both", "alternating", "reversible")

        def side(name: str) -> Column:
            tagged = scalars.limited_speed(p["speed"][name], default_speed, limit)
            speed = F.when(p["way"] == "alternating", F.floor(tagged / 3)).otherwise(tagged) if car else tagged
            return F.when((both | (p["way"] == name)) & scalars.routable(p["access"][name]) & (speed > 0), F.struct(p["access"][name].alias("access"), speed.cast("int").alias("speed")))

        return F.struct(side("forward").alias("forward"), side("backward").alias("backward"))

    return scalars.let(parts, sides)


def lane_count(ptags: Column) -> Column:
    """Lanes of a way: ``lanes``, else the sum of its two directions; 0 if unknown."""

    def n(*parts: str) -> Column:
        return F.coalesce(F.round(find_value(ptags, parts).try_cast("double")).cast("int"), F.lit(0))

    both = n("lanes")
    return F.when(both > 0, both).otherwise(n("forward", "lanes") + n("backward", "lanes"))


def priority_road(ptags: Column) -> Column:
    return find_value(ptags, ("priority_road",)).isin("designated", "yes", "yes_unposted")


def signature(tags: Column, left_out: tuple[str, ...] = ("name",)) -> Column:
    """The tags of a way as one string, to find equal ways."""
    kept = F.filter(tags, lambda t: ~t["k"].isin(*left_out))
    return F.array_join(F.array_sort(F.transform(kept, lambda t: F.concat(t["k"], F.lit("="), t["v"]))), " ## ")


def grep(objects: DataFrame, expression: str) -> DataFrame:
    """id, k, v of the tags that match ``re{&&[!]re}``, in any letter case, over ``key=value``."""
    terms = [(t[1:], False) if t.startswith("!") else (t, True) for t in expression.split("&&")]
    line = F.concat(F.col("tag.k"), F.lit("="), F.col("tag.v"))
    rows = objects.select("id", F.explode("tags").alias("tag"))
    for pattern, wanted in terms:
        found = line.rlike(f"(?i){pattern}")
        rows = rows.where(found if wanted else ~found)
    return rows.select("id", F.col("tag.k").alias("k"), F.col("tag.v").alias("v"))


def frequencies(rows: DataFrame, by: list[str]) -> DataFrame:
    """n and the least id as an example, for each key."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("example"))


def top_values(rows: DataFrame, n: int) -> DataFrame:
    """The n most frequent values of each key, with the key's totals."""
    counted = frequencies(rows, ["k", "v"])
    totals = rows.groupBy("k").agg(F.count(F.lit(1)).alias("total"), F.count_distinct("v").alias("uniq"))
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.col("n").desc(), F.col("v")))
    return counted.withColumn("place", place).where(F.col("place") <= n).join(totals, "k")
