"""Coordinates with stated confidence, and distances that are never invented."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from playbill import vocab
from playbill.functions.text import city_key, col, search_text_py


def _city_table(value):
    """Constant map from city key to `value(city)`; twenty-three fixed entries."""
    pairs = {search_text_py(name): name for name in vocab.CITY_COORDS}
    pairs.update(vocab.CITY_ALIASES)
    flat = [F.lit(x) for key, name in pairs.items() for x in (key, value(name))]
    return F.create_map(*flat)


def canonical_city(c) -> Column:
    return F.try_element_at(_city_table(lambda n: n), city_key(c))


def known_origin(name: str | None) -> tuple[float, float] | None:
    """Coordinates of an origin city given as a constant."""
    key = " ".join(w for w in search_text_py(name or "").split() if w not in ("kommun", "stad", "city", "sweden", "sverige"))
    for city, point in vocab.CITY_COORDS.items():
        if search_text_py(city) == key:
            return point
    alias = vocab.CITY_ALIASES.get(key)
    return vocab.CITY_COORDS[alias] if alias else None


def resolve_location(lat="latitude", lon="longitude", vlat="venue_latitude", vlon="venue_longitude", city="city") -> Column:
    """struct(lat, lon, confidence, canonical_city): exact, venue, city centroid or unknown."""
    lat, lon, vlat, vlon = col(lat), col(lon), col(vlat), col(vlon)
    name = canonical_city(city)
    exact, venue = lat.isNotNull() & lon.isNotNull(), vlat.isNotNull() & vlon.isNotNull()
    city_lat = F.try_element_at(_city_table(lambda n: vocab.CITY_COORDS[n][0]), city_key(city))
    city_lon = F.try_element_at(_city_table(lambda n: vocab.CITY_COORDS[n][1]), city_key(city))
    return F.struct(
        F.when(exact, lat).when(venue, vlat).otherwise(city_lat).alias("lat"),
        F.when(exact, lon).when(venue, vlon).otherwise(city_lon).alias("lon"),
        F.when(exact, "exact").when(venue, "venue").when(name.isNotNull(), "city").otherwise("unknown").alias("confidence"),
        name.alias("canonical_city"),
    )


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(half_lon), F.lit(2.0))
    return F.lit(2 * vocab.EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def distance_km(lat: Column, lon: Column, origin: str | None) -> Column:
    """Whole kilometres (half to even) from a known origin city; null if either end is unknown."""
    point = known_origin(origin)
    if point is None:
        return F.lit(None).cast("int")
    return F.bround(haversine_km(F.lit(point[0]), F.lit(point[1]), lat, lon)).cast("int")
