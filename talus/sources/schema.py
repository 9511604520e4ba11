"""Declared schemas: named coordinates everywhere, so their order can't be mixed up."""

from __future__ import annotations

POINT = "struct<lng: double, lat: double>"
SEGMENTS = f"trail_id string, ord long, props map<string, string>, parts array<array<{POINT}>>"
WAYS = f"osm_id string, name string, tags map<string, string>, points array<{POINT}>"
RELATIONS = "id string, tags map<string, string>, members array<string>"
POINTS = "id string, kind string, name string, ele_m double, lat double, lng double"
SITES = "id string, kind string, name string, lat double, lng double, source string, details map<string, string>"
ROUTE_POINTS = "file string, seq long, lat double, lng double, ele double"
