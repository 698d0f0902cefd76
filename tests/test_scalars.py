"""Golden values of scalar functions and tag folds."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wayfold.functions import scalars
from wayfold.operators import tags


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row.asDict()


def test_distance_and_angles(spark):
    lit = F.lit
    got = one(
        spark,
        paris_berlin=scalars.haversine_cm(lit(48856600), lit(2352200), lit(52520000), lit(13405000)),
        t1=scalars.turn_angle(lit(0), lit(181)),
        t2=scalars.turn_angle(lit(90), lit(270)),
        t3=scalars.turn_angle(lit(269), lit(0)),
    )
    assert got == {"paris_berlin": 87746333, "t1": -179, "t2": 180, "t3": 91}


@pytest.mark.parametrize(("ms", "code"), [(0, 0), (100, 1), (200, 2), (11600, 30), (12300, 30), (12400, 31), (13100, 31), (13200, 31), (13300, 31), (45103400, 62), (45103401, 63)])
def test_turn_cost_codec(spark, ms, code):
    assert one(spark, c=scalars.compress_turn_cost(F.lit(ms).cast("long")))["c"] == code


def test_segment_distance(spark):
    d, part = scalars.segment_distance(F.lit(0), F.lit(1_500_000), F.lit(0), F.lit(1_000_000), F.lit(0), F.lit(2_000_000))
    got = one(spark, d=d, part=part)
    assert got["d"] == pytest.approx(0, abs=1) and got["part"] == pytest.approx(0.5)


def _tags(*pairs):
    return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in pairs])


@pytest.mark.parametrize(
    ("pairs", "forward", "backward"),
    [([("maxspeed:lanes", "30|40")], 40, 40), ([("maxspeed:bicycle", "20")], 0, 0), ([("maxspeed:forward", "50")], 50, 0), ([("maxspeed", "50"), ("maxspeed:backward", "30")], 50, 30), ([("maxspeed", "bogus")], 0, 0)],
)
def test_car_maxspeed(spark, pairs, forward, backward):
    got = one(spark, s=tags.car_maxspeed(tags.parse_tags(_tags(*pairs))))["s"]
    assert (got["forward"], got["backward"]) == (forward, backward)


@pytest.mark.parametrize(
    ("default", "pairs", "forward", "backward"),
    [
        (0, [("access", "yes")], 0, 0),
        (7, [("access:lanes:backward", "no|")], 7, 7),
        (7, [("access:lanes:backward", "no|no")], 7, 0),
        (7, [("motor_vehicle:forward", "no"), ("vehicle", "yes")], 0, 7),
        (7, [("access", "forestry")], 0, 0),
    ],
)
def test_car_access(spark, default, pairs, forward, backward):
    got = one(spark, s=tags.car_access(tags.parse_tags(_tags(*pairs)), F.lit(default)))["s"]
    assert (got["forward"], got["backward"]) == (forward, backward)


def test_unknown_key_parts_are_left_out(spark):
    got = one(spark, p=tags.parse_tags(_tags(("maxspeed:blabla", "10"), ("lanes:hgv", "2"), ("hgv:lanes", "1"))))["p"]
    assert [t["parts"] for t in got] == [["hgv", "lanes"], ["hgv", "lanes_inner"]]
