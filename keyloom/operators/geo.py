"""Geospatial sets: GEOADD GEODIST GEOHASH GEOPOS GEORADIUS GEORADIUSBYMEMBER."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import geo as g
from keyloom.model import KEY
from keyloom.operators import core

MEMBER = [*KEY, "member"]


def geoadd(table: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of (db, key, member, lon, lat); out-of-range coordinates raise."""
    ok = F.col("lon").between(*g.LON) & F.col("lat").between(*g.LAT)
    scored = new.withColumn("score", F.when(ok, g.encode_score(F.col("lon"), F.col("lat"))).otherwise(F.raise_error(F.lit("invalid longitude or latitude")).cast("bigint")))
    return core.upsert(table, scored, MEMBER)


def geodist(table: DataFrame, pairs: DataFrame, unit: str = "m") -> DataFrame:
    """Distance for rows (db, key, a, b) of pairs."""
    at = lambda side: table.select(*KEY, F.col("member").alias(side), F.col("lon").alias(f"lon_{side}"), F.col("lat").alias(f"lat_{side}"))
    both = pairs.join(at("a"), [*KEY, "a"]).join(at("b"), [*KEY, "b"])
    d = g.haversine(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b"))
    return both.select(*KEY, "a", "b", (d / g.UNITS[unit]).alias("dist"))


def geohash(table: DataFrame) -> DataFrame:
    return table.select(*MEMBER, g.geohash(F.col("lon"), F.col("lat")).alias("hash"))


def geopos(table: DataFrame) -> DataFrame:
    """Coordinates as stored: the corner of the score's cell."""
    return table.select(*MEMBER, g.decode_lon(F.col("score")).alias("lon"), g.decode_lat(F.col("score")).alias("lat"))


def georadius(table: DataFrame, lon: float, lat: float, radius: float, unit: str = "m", count: int | None = None, desc: bool = False) -> DataFrame:
    """Members within a radius, with dist in unit. The latitude band is a plain range that reaches the scan."""
    metres = radius * g.UNITS[unit]
    band = math.degrees(metres / g.RADIUS_M) + 1e-9
    near = table.where(F.col("lat").between(lat - band, lat + band))
    d = g.haversine(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat"))
    hit = near.withColumn("dist", d / g.UNITS[unit]).where(F.col("dist") <= radius)
    if count is None:
        return hit
    order = [F.col("dist").desc() if desc else F.col("dist"), F.col("member")]
    return hit.withColumn("_rn", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))).where(F.col("_rn") <= count).drop("_rn")


def georadiusbymember(table: DataFrame, centres: DataFrame, radius: float, unit: str = "m") -> DataFrame:
    """For each (db, key, member) of centres the other members within radius: an equi-join on cells, then the exact
    distance. A cell is a piece of a latitude band as high as the radius, so a centre meets three bands, and in each the
    few pieces that its circle's longitudes reach; towards the poles bands have fewer pieces, at last one.
    """
    angle = radius * g.UNITS[unit] / g.RADIUS_M
    band = math.degrees(angle) + 1e-9

    def pieces(b: Column) -> Column:
        edge = F.least(F.greatest(F.abs(b * band), F.abs((b + 1) * band)), F.lit(90.0))
        return F.greatest(F.floor(F.cos(F.radians(edge)) * 180 / band), F.lit(1)).cast("bigint")

    def piece(lon: Column, b: Column) -> Column:
        return F.floor((lon + 180) / 360 * pieces(b))

    lat, lon, b = F.col("lat"), F.col("lon"), F.col("_band")
    own = table.select(*MEMBER, "lon", "lat", F.floor(lat / band).alias("_band")).withColumn("_piece", F.pmod(piece(lon, b), pieces(b)))
    mid = own.join(centres.select(*MEMBER), MEMBER, "left_semi")
    mid = mid.select(*KEY, F.col("member").alias("centre"), lon.alias("_lon"), lat.alias("_lat"), F.explode(F.array(*(b + i for i in (-1, 0, 1)))).alias("_band"))
    near_pole = (F.abs("_lat") + band >= 90) | F.lit(angle >= math.pi / 2)
    reach = F.when(near_pole, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(math.sin(min(angle, math.pi / 2))) / F.cos(F.radians("_lat")), F.lit(1.0)))) + 1e-9)
    low, high = piece(F.col("_lon") - reach, b), piece(F.col("_lon") + reach, b)
    met = F.when(high - low + 1 >= pieces(b), F.sequence(F.lit(0).cast("bigint"), pieces(b) - 1)).otherwise(F.transform(F.sequence(low, high), lambda i: F.pmod(i, pieces(b))))
    mid = mid.withColumn("_piece", F.explode(met))
    d = g.haversine(F.col("_lon"), F.col("_lat"), F.col("lon"), F.col("lat")) / g.UNITS[unit]
    hit = mid.join(own, [*KEY, "_band", "_piece"]).where("member <> centre").withColumn("dist", d).where(F.col("dist") <= radius)
    return hit.select(*KEY, "centre", "member", "dist")
