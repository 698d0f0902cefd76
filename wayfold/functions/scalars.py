"""Scalar column functions: distances, angles, codes, costs and metrics.

Coordinates are integers in microdegrees, distances in centimetres, times in
milliseconds.  Everything is built-in column arithmetic, inside generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions import dims

EARTH_CM = 637_100_000.0
MERCATOR_LAT = 85.0511289
TILE = 256


def _rad(e6: Column) -> Column:
    return (e6.cast("double") / F.lit(1e6)) * F.lit(math.pi / 180.0)


def haversine_cm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in whole centimetres."""
    up, across = F.sin((_rad(lat2) - _rad(lat1)) / 2.0), F.sin((_rad(lon2) - _rad(lon1)) / 2.0)
    a = up * up + F.cos(_rad(lat1)) * F.cos(_rad(lat2)) * across * across
    return F.round(F.lit(2.0 * EARTH_CM) * F.atan2(F.sqrt(a), F.sqrt(1.0 - a))).cast("long")


def bearing_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle bearing from north, 0 up to 360."""
    turn = _rad(lon2) - _rad(lon1)
    y = F.sin(turn) * F.cos(_rad(lat2))
    x = F.cos(_rad(lat1)) * F.sin(_rad(lat2)) - F.sin(_rad(lat1)) * F.cos(_rad(lat2)) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def angle_to_east(lat1: Column, lon1: Column, lat2: Column, lon2: Column, length_cm: Column) -> Column:
    """Counter-clockwise whole degrees from east of a segment of known length."""
    rise = F.abs(lat2.cast("long") - lat1.cast("long")).cast("double") / F.lit(1e6)
    height = F.round(F.lit(EARTH_CM * math.pi * 2 / 360.0) * rise)
    steep = F.when(height < length_cm, F.round(F.lit(180.0) * F.asin(height / length_cm) / F.lit(math.pi))).otherwise(F.lit(90.0)).cast("int")
    north, east = lat2 >= lat1, lon2 >= lon1
    angle = F.when(north & east, steep).when(north, 180 - steep).when(east, F.pmod(360 - steep, F.lit(360))).otherwise(180 + steep)
    return F.when(length_cm == 0, F.lit(0)).otherwise(angle).cast("int")


def turn_angle(first: Column, second: Column) -> Column:
    """Change of direction between two angles, in (-180, 180]."""
    a = second - first
    return F.when(a > 180, a - 360).when(a <= -180, a + 360).otherwise(a)


def local_xy(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> tuple[Column, Column]:
    """Offset in centimetres on the plane that touches at the first point."""
    x = F.lit(EARTH_CM) * _rad(lon1 - lon0) * F.cos(_rad(lat0))
    return x, F.lit(EARTH_CM) * _rad(lat1 - lat0)


def segment_distance(lat: Column, lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> tuple[Column, Column]:
    """(distance in cm, fraction of the way from a to b) of the closest point of a segment."""
    px, py = local_xy(a_lat, a_lon, lat, lon)
    bx, by = local_xy(a_lat, a_lon, b_lat, b_lon)
    square = bx * bx + by * by
    part = F.when(square < 1e-10, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * bx + py * by) / square)))
    dx, dy = px - part * bx, py - part * by
    return F.sqrt(dx * dx + dy * dy), part


def rect_distance(lat: Column, lon: Column, low_lat: Column, low_lon: Column, high_lat: Column, high_lon: Column) -> Column:
    """0 inside a rectangle, else the distance to its nearest side in cm."""
    sides = [(low_lat, low_lon, low_lat, high_lon), (high_lat, low_lon, high_lat, high_lon), (low_lat, low_lon, high_lat, low_lon), (low_lat, high_lon, high_lat, high_lon)]
    nearest = F.least(*[segment_distance(lat, lon, *s)[0] for s in sides])
    return F.when(lat.between(low_lat, high_lat) & lon.between(low_lon, high_lon), F.lit(0.0)).otherwise(nearest)


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Web-Mercator world pixels at zoom 0 of degrees."""
    held = F.greatest(F.lit(-MERCATOR_LAT), F.least(F.lit(MERCATOR_LAT), lat))
    y = F.lit(math.pi) - F.ln(F.tan(F.lit(math.pi / 4) + held * F.lit(math.pi / 180) / 2.0))
    return (lon + 180.0) * F.lit(TILE / 360.0), y * F.lit(TILE / (2 * math.pi))


def zoomed(world: Column, zoom: int) -> Column:
    """World pixels to whole pixels of a zoom level, truncated."""
    return (world * F.lit(float(1 << zoom))).cast("int")


def tile_to_world(zoom: Column, tile: Column) -> Column:
    return (F.lit(TILE) * tile).cast("double") / F.pow(F.lit(2.0), zoom)


def country_number(code: Column) -> Column:
    """Two capital letters to their number; 0 for anything else."""
    n0, n1 = F.ascii(F.substring(code, 1, 1)) - 64, F.ascii(F.substring(code, 2, 1)) - 64
    good = (F.length(code) == 2) & n0.between(1, 26) & n1.between(1, 26)
    return F.when(good, n0 * 32 + n1).otherwise(F.lit(0)).cast("int")


def country_code(number: Column) -> Column:
    """The two letters of a country number; ``--`` for 0."""
    return F.when(number == 0, F.lit("--")).otherwise(F.concat(F.char(F.shiftright(number, 5) + 64), F.char(number.bitwiseAND(F.lit(31)) + 64)))


def compress_turn_cost(ms: Column) -> Column:
    """The code of the nearest of 63 costs, the lower one on a tie; 63 beyond the last."""
    costs = dims.TURN_COSTS

    def half(low: int, high: int) -> Column:
        """Comparisons with the middles between costs, halving: a search of the list would go through all of it for each row."""
        if low == high:
            return F.lit(low)
        at = (low + high + 1) // 2
        return F.when(ms * 2 > costs[at - 1] + costs[at], half(at, high)).otherwise(half(low, at - 1))

    return F.when(ms > costs[-1], F.lit(63)).when(ms.isNotNull(), half(0, len(costs) - 1)).cast("int")


def turn_code(ms: int) -> Column:
    """``compress_turn_cost`` of a known number."""
    costs = dims.TURN_COSTS
    return F.lit(0 if ms == 0 else 63 if ms > costs[-1] else min(range(len(costs)), key=lambda n: (abs(costs[n] - ms), n)))


def decompress_turn_cost(code: Column) -> Column:
    values = F.array(*[F.lit(v).cast("long") for v in (*dims.TURN_COSTS, dims.NO_PASSAGE)])
    return F.get(values, code)


def curve_cost(angle: Column) -> Column:
    """Milliseconds of a turn by its angle."""
    a = F.abs(angle)
    return F.when(a <= 20, F.lit(0)).when(a <= 60, F.lit(500)).when(a <= 120, F.lit(2000)).when(a <= 179, F.lit(4000)).otherwise(F.lit(20000))


def whole_div(a: Column, b: Column) -> Column:
    """Integer division of longs, truncated toward zero."""
    return ((a - a % b) / b).cast("long")


def time_metric(distance_cm: Column, kmh: Column, turn_ms: Column) -> Column:
    """Milliseconds for a distance at a speed, and a turn."""
    return whole_div(distance_cm * 36, kmh) + turn_ms


def limited_speed(tagged: Column, default: Column, limit: Column) -> Column:
    """A tagged speed over 0 before the default, both under the limit (0: none)."""
    own = F.when(tagged > 0, tagged).otherwise(default)
    return F.when((limit > 0) & (own > limit), limit).otherwise(own)


def zigzag(value: Column) -> Column:
    return F.shiftright(value, 63).bitwiseXOR(F.shiftleft(value, 1))


def unzigzag(value: Column) -> Column:
    return F.shiftrightunsigned(value, 1).bitwiseXOR(-value.bitwiseAND(F.lit(1).cast("long")))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def parse_speed(value: Column) -> Column:
    """km/h of a maxspeed value; null if it is none."""

    def units(split: Column) -> Column:
        n, unit = F.get(split, 0).cast("int"), F.get(split, 1)
        scaled = F.when(unit == "mph", F.floor(n * 1.609344 + 0.5)).when(unit == "knots", F.floor(n * 1.852 + 0.5)).otherwise(n)
        return F.when(value == "none", F.lit(1023)).when(value == "walk", F.lit(7)).when(value.rlike(r"^[0-9]{1,5}( (mph|knots|km/h))?$"), F.pmod(scaled, F.lit(65536))).cast("int")

    # other values become two empty parts, so that nothing is cast that is no number
    return let(F.when(value.rlike(r"^[0-9]{1,5}( |$)"), F.split(value, " ")), units)


def curve_speed(arc_cm: Column, degrees: Column) -> Column:
    """The most km/h that a curve of a length and a turn allows, at half of gravity sideways."""
    return F.sqrt(F.lit(3.6 * 3.6 * 0.5 * 9.81 * 0.01) * arc_cm / (degrees * F.lit(math.pi) / 180.0))


#: Metres per second squared, (faster, slower), of kinds of vehicles.
PACES = {"motorcar": (3.0, 2.0), "hgv": (2.0, 1.5), "bicycle": (1.5, 1.5)}


def speed_change_cm(kmh_1: Column, kmh_2: Column, vehicle: str = "motorcar") -> Column:
    """Whole centimetres that a change of speed takes."""
    faster, slower = PACES[vehicle]
    a, b = kmh_1 / 3.6, kmh_2 / 3.6
    return F.abs(F.round(100.0 * (a * a - b * b) / (2.0 * F.when(a >= b, F.lit(slower)).otherwise(F.lit(faster))))).cast("long")


def round_1(value: Column) -> Column:
    """One decimal place, halves away from zero."""
    return F.signum(value) * F.floor(F.abs(value) * 10.0 + 0.5) / 10.0


def edge_name(street: Column, way: Column, a: Column, b: Column) -> Column:
    return F.format_string("<%s> (w:%d %d->%d)", street, way, a, b)


def varint_hex(value: Column) -> Column:
    """Hexadecimal digits of a whole number's bytes with seven bits each, the lowest first; all but the last have the top bit."""
    places = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda n: (n == 0) | (shifted(value, n) > 0))
    return F.array_join(F.transform(places, lambda n: F.lpad(F.hex(shifted(value, n).bitwiseAND(F.lit(127)) + F.when(shifted(value, n + 1) > 0, 128).otherwise(0)), 2, "0")), "")


def shifted(value: Column, sevens: Column) -> Column:
    """A number without its lowest groups of seven bits; 0 where none is left."""
    # bits are shifted: a double holds 53 of them only
    return F.when(sevens > 8, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", value.cast("long"), (sevens * 7).cast("int")))


def without_prefix(text: Column, prefix: str) -> Column:
    """(whether a text began with a prefix, the rest)."""
    has = text.startswith(prefix)
    return F.struct(has.alias("had"), F.when(has, F.substring(text, len(prefix) + 1, 1 << 30)).otherwise(text).alias("rest"))


def routable(access: Column) -> Column:
    """Access ordinals that a route may use: customers and better."""
    return access >= 2


def free_access(access: Column) -> Column:
    return access >= 5


def restricted_access(access: Column) -> Column:
    return access.between(2, 4)
