"""Scenes drawn from a specification and a seed, reproducible from hashes alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draws

OBJECT_TYPE = (
    "struct<category:string,instances:array<string>,x:array<double>,y:array<double>,"
    "z:array<double>,yaw:array<double>,count:array<double>>"
)


def _ranged(identity: Column, seed: Column, at: Column, bounds: Column, default: float) -> Column:
    drawn = draws.in_range(draws.unit(identity, seed, at), F.get(bounds, 0), F.get(bounds, 1))
    return F.when(bounds.isNull(), F.lit(default)).otherwise(drawn)


def _used(bounds: Column) -> Column:
    """A missing range takes its default and uses up no draw."""
    return F.when(bounds.isNull(), 0).otherwise(1)


def draw_scene(rows: DataFrame) -> DataFrame:
    """Adds `placed` (one struct per placed object) and both lighting values.

    Needs columns identity (binary), seed, objects, intensity, temperature.
    Object order is fixed: count first, then instance, x, y, z and yaw for each
    copy. The start of every object depends on the counts drawn before it, so
    starts are accumulated along the (short) object list of the row.
    """
    identity, seed = F.col("identity"), F.col("seed")
    plan_type = f"struct<at:bigint,plan:array<struct<o:{OBJECT_TYPE},first:bigint,per:bigint,n:bigint>>>"

    def step(acc: Column, o: Column) -> Column:
        count = o.getField("count")
        n = F.when(count.isNull(), F.lit(1).cast("bigint")).otherwise(
            draws.integer(draws.unit(identity, seed, acc.getField("at")), F.get(count, 0), F.get(count, 1))
        )
        first = acc.getField("at") + _used(count)
        per = (F.lit(1) + _used(o.getField("x")) + _used(o.getField("y")) + _used(o.getField("z")) + _used(o.getField("yaw"))).cast("bigint")
        entry = F.struct(o.alias("o"), first.cast("bigint").alias("first"), per.alias("per"), n.cast("bigint").alias("n"))
        return F.struct(
            (first + per * n).cast("bigint").alias("at"), F.concat(acc.getField("plan"), F.array(entry)).alias("plan")
        ).cast(plan_type)

    start = F.expr("named_struct('at', cast(0 as bigint), 'plan', array())").cast(plan_type)
    planned = rows.withColumn("_plan", F.aggregate("objects", start, step))

    def copies(p: Column) -> Column:
        o = p.getField("o")

        def one(k: Column) -> Column:
            base = p.getField("first") + p.getField("per") * k
            at_x = base + 1
            at_y = at_x + _used(o.getField("x"))
            at_z = at_y + _used(o.getField("y"))
            at_yaw = at_z + _used(o.getField("z"))
            size = F.size(o.getField("instances"))
            return F.struct(
                o.getField("category").alias("category"),
                F.get(o.getField("instances"), draws.pick(draws.unit(identity, seed, base), size).cast("int")).alias("instance"),
                _ranged(identity, seed, at_x, o.getField("x"), 0.0).alias("x"),
                _ranged(identity, seed, at_y, o.getField("y"), 0.0).alias("y"),
                _ranged(identity, seed, at_z, o.getField("z"), 0.0).alias("z"),
                _ranged(identity, seed, at_yaw, o.getField("yaw"), 0.0).alias("yaw"),
            )

        numbers = F.when(p.getField("n") > 0, F.sequence(F.lit(0).cast("bigint"), p.getField("n") - 1)).otherwise(
            F.array().cast("array<bigint>")
        )
        return F.transform(numbers, one)

    at = F.col("_plan.at")
    return planned.select(
        *rows.columns,
        F.flatten(F.transform("_plan.plan", copies)).alias("placed"),
        _ranged(identity, seed, at, F.col("intensity"), 1.0).alias("lighting_intensity"),
        _ranged(identity, seed, at + _used(F.col("intensity")), F.col("temperature"), 5000.0).alias("lighting_temperature"),
    )


def scene_digest() -> Column:
    """Hex digest of a drawn scene with base and embodiment columns."""
    lines = F.transform(
        "placed",
        lambda o: F.format_string(
            "%s|%s|%.6f|%.6f|%.6f|%.6f",
            o.getField("category"), o.getField("instance"), o.getField("x"), o.getField("y"), o.getField("z"), o.getField("yaw"),
        ),
    )
    text = F.array_join(
        F.concat(
            F.array("base", "embodiment"),
            lines,
            F.array(F.format_string("%.6f", "lighting_intensity"), F.format_string("%.3f", "lighting_temperature")),
        ),
        "\n",
    )
    return F.sha2(text.cast("binary"), 256)
