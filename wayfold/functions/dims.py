"""Fixed dimension values: their order is meaning (ordinals)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Road classes, from the most to the least important.
HIGHWAYS = (
    "motorway", "motorway_junction", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary",
    "secondary_link", "tertiary", "tertiary_link", "turning_circle", "residential", "unclassified", "living_street",
    "service", "busway", "bus_guideway", "cycleway", "footway", "track", "pedestrian", "path", "steps", "escape", "road",
    "bridleway",
)
#: Classes that are no roads: nodes of roads that appear as ways too.
ROADS = tuple(h for h in HIGHWAYS if h not in ("motorway_junction", "turning_circle"))
# Access, from none to the best.
ACCESS = ("no", "private", "customers", "delivery", "destination", "dismount", "permissive", "yes", "designated")
# The key parts that a tag key may have.
KEY_PARTS = (
    "access", "advisory", "backward", "barrier", "bicycle", "bicycle_road", "both", "both_ways", "bridge", "bus",
    "change", "conditional", "crossing", "cycleway", "direction", "foot", "footway", "forward", "hgv", "highway",
    "horse", "incline", "junction", "lane", "lane_markings", "lanes", "lanes_inner", "layer", "left", "lit", "locked",
    "markings", "maxspeed", "moped", "motor_vehicle", "motorcar", "motorcycle", "motorroad", "name", "oneway",
    "practical", "priority_road", "psv", "public_transport", "railway", "right", "service", "sidewalk", "signals",
    "smoothness", "source", "stop", "surface", "toll", "tracktype", "traffic", "traffic_calming", "traffic_sign",
    "traffic_signals", "tunnel", "turn", "type", "variable", "vehicle", "width", "zone",
)
# Vehicles and directions that make a key more specific.
VEHICLES = ("motorcar", "motorcycle", "moped", "horse", "foot", "bus", "hgv", "bicycle")
MODIFIERS = ("forward", "backward", "left", "right", "both", "both_ways")
# Milliseconds of the turn-cost codes 0..62; code 63 is no passage.
TURN_COSTS = (
    0, 100, 200, 300, 400, 500, 600, 700, 800, 900, 1000, 1100, 1200, 1300, 1400, 1500, 1600, 1900, 2200, 2500, 2800, 3300, 3800, 4300, 5000, 5700, 6600, 7600, 8700, 10000, 11500, 13200,
    17200, 22400, 29100, 37800, 49200, 63900, 83100, 108000, 140400, 182600, 237300, 308500, 401100, 521400, 677800,
    881200, 1145500, 1489200, 1935900, 2516700, 3271700, 4253200, 5529200, 7188000, 9344300, 12147700, 15791900,
    20529500, 26688400, 34694900, 45103400,
)
NO_PASSAGE = 1_000_000_000

# Surfaces, from the best to the worst of each group.
SURFACES = (
    "n/a", "paved", "asphalt", "chipseal", "concrete", "concrete:lanes", "concrete:plates", "paving_stones",
    "paving_stones:lanes", "grass_paver", "sett", "unhewn_cobblestone", "cobblestone", "bricks", "metal", "metal_grid",
    "wood", "stepping_stones", "rubber", "tiles", "unpaved", "compacted", "fine_gravel", "gravel", "shells", "rock",
    "pebblestone", "ground", "dirt", "earth", "grass", "mud", "sand", "woodchips", "snow", "ice", "salt", "clay",
    "tartan", "artificial_turf", "acrylic", "carpet", "plastic",
)
# Smoothness, from the best to the worst.
SMOOTHNESS = ("n/a", "excellent", "good", "intermediate", "bad", "very_bad", "horrible", "very_horrible", "impassable")
# Track grades, from the best to the worst.
TRACKTYPES = ("n/a", "grade1", "grade2", "grade3", "grade4", "grade5")
#: Vehicles that pass open barriers.
_ALL = ("foot", "bicycle", "motorcar", "truck", "hgv", "bus", "agricultural", "motorcycle", "horse", "emergency")
# Barriers with the vehicles that may pass them.
BARRIERS = {
    "block": (), "bollard": ("foot", "bicycle", "motorcycle"), "border_control": _ALL, "bump_gate": _ALL,
    "bus_trap": ("bus", "truck", "hgv"), "cattle_grid": _ALL, "chain": ("foot", "bicycle", "motorcycle"), "checkpoint": _ALL,
    "city_wall": (), "coupure": _ALL, "cycle_barrier": ("foot", "bicycle"), "debris": (), "ditch": _ALL, "entrance": _ALL,
    "fence": (), "full-height_turnstile": ("foot",), "gate": _ALL, "hedge": (),
    "height_restrictor": ("foot", "bicycle", "motorcar", "truck", "hgv", "bus", "agricultural", "motorcycle", "emergency"),
    "horse_stile": ("horse", "foot"), "kerb": ("foot", "bicycle", "wheelchair"), "kissing_gate": ("foot", "bicycle"),
    "lift_gate": _ALL, "log": ("foot", "bicycle", "4wd"), "motorcycle_barrier": ("foot", "bicycle"), "rope": ("foot", "bicycle"),
    "sally_port": ("military",), "slipway": ("foot", "bicycle", "boat"), "spikes": ("foot",), "stile": ("foot",), "stone": (),
    "sump_buster": ("4wd",), "swing_gate": _ALL, "tank_trap": (), "toll_booth": _ALL, "turnstile": ("foot",), "wall": (),
    "width_restrictor": ("foot", "bicycle", "motorcar", "truck", "hgv", "bus", "agricultural", "motorcycle", "emergency"),
    "wire_fence": (), "yes": _ALL,
}
# What `oneway` may say.
DIRECTIONS = {"yes": "forward", "-1": "backward", "no": "both", "alternating": "alternating", "reversible": "reversible"}


def strings(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def ordinal(values: tuple[str, ...], col: Column) -> Column:
    """Place of a name in ``values``, null if it is unknown."""
    return F.when(F.array_position(strings(values), col) > 0, F.array_position(strings(values), col) - 1).cast("int")


def name_of(values: tuple[str, ...], col: Column) -> Column:
    """Name at a place, null outside."""
    return F.when(col.between(0, len(values) - 1), F.get(strings(values), col))
