"""Registered queries of the spatial functions: shapes made of a row's numbers, whose measures DuckDB computes as arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spatial as G
from ..sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

C = F.col
X = lambda: (C("c_custkey") % 7 + 1).cast("double")
Y = lambda: (C("c_nationkey") % 5 + 1).cast("double")
_x, _y = "(c_custkey % 7 + 1)", "(c_nationkey % 5 + 1)"


def _text(shape: str):
    """Text with {x}, {y} and sums like {x+2} replaced by the row's numbers."""
    def make():
        out, rest = [], shape
        while "{" in rest:
            head, _, rest = rest.partition("{")
            body, _, rest = rest.partition("}")
            name, _, more = body.partition("+")
            out += [F.lit(head), ((X() if name == "x" else Y()).cast("bigint") + int(more or 0)).cast("string")]
        return F.concat(*out, F.lit(rest))

    return make


def _shape(shape: str):
    return lambda: G.geom_from_text(_text(shape)())


def _duck(shape: str) -> str:
    out = "'" + shape + "'"
    for name, value in (("x", _x), ("y", _y)):
        for k in range(0, 12):
            out = out.replace("{" + name + (f"+{k}" if k else "") + "}", f"' || CAST({value} + {k} AS BIGINT) || '")
    return out


POINT = _shape("POINT({x} {y})")
LINE = _shape("LINESTRING(0 0,{x} 0,{x} {y})")
BOX = _shape("POLYGON((0 0,{x} 0,{x} {y},0 {y},0 0))")
RING = _shape("POLYGON((0 0,{x+4} 0,{x+4} {y+4},0 {y+4},0 0),(1 1,2 1,2 2,1 2,1 1))")
FAR = _shape("POLYGON(({x+1} 0,{x+3} 0,{x+3} {y},{x+1} {y},{x+1} 0))")
NEXT = _shape("POLYGON(({x} 0,{x+3} 0,{x+3} {y},{x} {y},{x} 0))")
UNIT = lambda: G.geom_from_text(F.lit("POLYGON((0 0,4 0,4 4,0 4,0 0))"))


def _add(name: str, **columns) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "customer").select("c_custkey", *(make().alias(c) for c, (make, _) in columns.items()))

    QUERIES[name] = run
    ORACLE_SQL[name] = "SELECT c_custkey, " + ", ".join(f"{duck} AS {c}" for c, (_, duck) in columns.items()) + " FROM customer"


def _t(make):
    return lambda: G.st_as_text(make())


_add("spatial_points", x=(lambda: G.st_x(POINT()), f"CAST({_x} AS DOUBLE)"), y=(lambda: G.st_y(POINT()), f"CAST({_y} AS DOUBLE)"), t=(_t(lambda: G.point(X(), Y())), _duck("POINT({x} {y})")), w=(_t(lambda: G.st_swap_xy(POINT())), _duck("POINT({y} {x})")), s=(lambda: G.st_srid(G.st_set_srid(POINT(), 4326)), "CAST(4326 AS BIGINT)"), la=(lambda: G.st_latitude(POINT()), f"CAST({_y} AS DOUBLE)"), lo=(lambda: G.st_longitude(POINT()), f"CAST({_x} AS DOUBLE)"), k=(lambda: G.st_geometry_type(POINT()), "'POINT'"))
_add("spatial_build", l=(_t(lambda: G.line_string(G.point(F.lit(0), F.lit(0)), G.point(X(), Y()))), _duck("LINESTRING(0 0,{x} {y})")), p=(_t(lambda: G.polygon(G.st_exterior_ring(BOX()))), _duck("POLYGON((0 0,{x} 0,{x} {y},0 {y},0 0))")), m=(_t(lambda: G.multi_point(POINT(), G.point(F.lit(0), F.lit(0)))), _duck("MULTIPOINT(({x} {y}),(0 0))")), n=(_t(lambda: G.multi_line_string(LINE(), LINE())), _duck("MULTILINESTRING((0 0,{x} 0,{x} {y}),(0 0,{x} 0,{x} {y}))")), q=(_t(lambda: G.multi_polygon(BOX())), _duck("MULTIPOLYGON(((0 0,{x} 0,{x} {y},0 {y},0 0)))")), c=(_t(lambda: G.geometry_collection(POINT(), LINE())), _duck("GEOMETRYCOLLECTION(POINT({x} {y}),LINESTRING(0 0,{x} 0,{x} {y}))")), e=(_t(lambda: G.st_make_envelope(G.point(F.lit(0), F.lit(0)), POINT())), _duck("POLYGON((0 0,{x} 0,{x} {y},0 {y},0 0))")))
_add("spatial_text_wkb", b=(_t(lambda: G.geom_from_wkb(G.st_as_binary(RING()))), _duck("POLYGON((0 0,{x+4} 0,{x+4} {y+4},0 {y+4},0 0),(1 1,2 1,2 2,1 2,1 1))")), h=(lambda: F.hex(F.substring(G.st_as_binary(POINT()), 1, 5)), "'0101000000'"), j=(lambda: G.st_as_geojson(POINT()), f"'{{\"type\": \"Point\", \"coordinates\": [' || CAST(CAST({_x} AS DOUBLE) AS VARCHAR) || ', ' || CAST(CAST({_y} AS DOUBLE) AS VARCHAR) || ']}}'"), g=(_t(lambda: G.geom_from_geojson(G.st_as_geojson(LINE()))), _duck("LINESTRING(0 0,{x} 0,{x} {y})")), k=(_t(lambda: G.of_kind(POINT(), "POINT")), _duck("POINT({x} {y})")))
_add("spatial_measures", a=(lambda: G.st_area(BOX()), f"CAST({_x} * {_y} AS DOUBLE)"), r=(lambda: G.st_area(RING()), f"CAST(({_x} + 4) * ({_y} + 4) - 1 AS DOUBLE)"), l=(lambda: G.st_length(LINE()), f"CAST({_x} + {_y} AS DOUBLE)"), c=(lambda: G.st_x(G.st_centroid(BOX())), f"CAST({_x} / 2.0 AS DOUBLE)"), d=(lambda: F.round(G.st_distance(POINT(), G.point(F.lit(-3), F.lit(-4))), 6), f"round(sqrt(({_x} + 3) ** 2 + ({_y} + 4) ** 2), 6)"), e=(lambda: G.st_distance(BOX(), FAR()), "1.0::DOUBLE"), f=(lambda: F.round(G.st_distance_sphere(G.point(F.lit(0), F.lit(0)), G.point(F.lit(0), Y())), 3), f"round(radians({_y}) * 6370986.0, 3)"), h=(lambda: F.round(G.st_hausdorff_distance(LINE(), G.line_string(G.point(F.lit(0), F.lit(0)), G.point(X(), F.lit(0)))), 6), f"CAST(least({_y}, sqrt({_x} ** 2 + {_y} ** 2)) AS DOUBLE)"), i=(lambda: G.st_frechet_distance(LINE(), LINE()), "0.0::DOUBLE"))
_add("spatial_parts", n=(lambda: G.st_num_points(LINE()), "3"), s=(_t(lambda: G.st_start_point(LINE())), "'POINT(0 0)'"), e=(_t(lambda: G.st_end_point(LINE())), _duck("POINT({x} {y})")), p=(_t(lambda: G.st_point_n(LINE(), F.lit(2))), _duck("POINT({x} 0)")), o=(_t(lambda: G.st_point_n(LINE(), F.lit(9))), "NULL::VARCHAR"), x=(_t(lambda: G.st_exterior_ring(BOX())), _duck("LINESTRING(0 0,{x} 0,{x} {y},0 {y},0 0)")), i=(lambda: G.st_num_interior_rings(RING()), "1"), j=(_t(lambda: G.st_interior_ring_n(RING(), F.lit(1))), "'LINESTRING(1 1,2 1,2 2,1 2,1 1)'"), g=(_t(lambda: G.st_geometry_n(G.multi_point(POINT(), POINT()), F.lit(2))), _duck("POINT({x} {y})")), c=(lambda: G.st_num_geometries(G.geometry_collection(POINT(), LINE())), "2"), d=(lambda: G.st_dimension(BOX()), "2"))
_add("spatial_shapes", e=(_t(lambda: G.st_envelope(LINE())), _duck("POLYGON((0 0,{x} 0,{x} {y},0 {y},0 0))")), h=(_t(lambda: G.st_convex_hull(G.multi_point(G.point(F.lit(0), F.lit(0)), G.point(X(), F.lit(0)), POINT(), G.point(F.lit(0), Y()), G.point(X() / 2, Y() / 2)))), _duck("POLYGON((0 0,{x} 0,{x} {y},0 {y},0 0))")), s=(_t(lambda: G.st_simplify(G.geom_from_text(_text("LINESTRING(0 0,{x} 0,{x+1} 0,{x+2} {y})")()), F.lit(0.0))), _duck("LINESTRING(0 0,{x+1} 0,{x+2} {y})")), i=(_t(lambda: G.st_line_interpolate_point(G.line_string(G.point(F.lit(0), F.lit(0)), G.point(X() * 2, F.lit(0))), F.lit(0.5))), _duck("POINT({x} 0)")), j=(_t(lambda: G.st_line_interpolate_points(G.line_string(G.point(F.lit(0), F.lit(0)), G.point(X() * 2, F.lit(0))), F.lit(0.5))), f"'MULTIPOINT((' || CAST({_x} AS BIGINT) || ' 0),(' || CAST({_x} * 2 AS BIGINT) || ' 0))'"), k=(_t(lambda: G.st_point_at_distance(LINE(), X())), _duck("POINT({x} 0)")))
_add("spatial_state", e=(lambda: G.st_is_empty(G.geom_from_text(F.concat(F.lit("GEOMETRYCOLLECTION EMPTY"), F.left("c_name", F.lit(0))))), "1"), c=(lambda: G.st_is_closed(G.st_exterior_ring(BOX())), "1"), o=(lambda: G.st_is_closed(LINE()), "0"), s=(lambda: G.st_is_simple(_shape("LINESTRING(0 0,{x} {y},{x} 0,0 {y})")()), "0"), t=(lambda: G.st_is_simple(LINE()), "1"), v=(lambda: G.st_is_valid(BOX()), "1"), w=(lambda: G.st_is_valid(_shape("POLYGON((0 0,{x} {y},{x} 0,0 {y},0 0))")()), "0"), n=(_t(lambda: G.st_validate(_shape("POLYGON((0 0,{x} {y},{x} 0,0 {y},0 0))")())), "NULL::VARCHAR"))
_add("spatial_relations", c=(lambda: G.st_contains(UNIT(), POINT()), f"CAST({_x} < 4 AND {_y} < 4 AS INT)"), w=(lambda: G.st_within(POINT(), UNIT()), f"CAST({_x} < 4 AND {_y} < 4 AS INT)"), i=(lambda: G.st_intersects(UNIT(), POINT()), f"CAST({_x} <= 4 AND {_y} <= 4 AS INT)"), d=(lambda: G.st_disjoint(UNIT(), POINT()), f"CAST({_x} > 4 OR {_y} > 4 AS INT)"), t=(lambda: G.st_touches(UNIT(), POINT()), f"CAST({_x} <= 4 AND {_y} <= 4 AND ({_x} = 4 OR {_y} = 4) AS INT)"), n=(lambda: G.st_touches(BOX(), NEXT()), "1"), f=(lambda: G.st_intersects(BOX(), FAR()), "0"), e=(lambda: G.st_equals(UNIT(), BOX()), f"CAST({_x} = 4 AND {_y} = 4 AS INT)"), b=(lambda: G.st_within(BOX(), UNIT()), f"CAST({_x} <= 4 AND {_y} <= 4 AS INT)"), o=(lambda: G.st_overlaps(UNIT(), BOX()), f"CAST(({_x} > 4 AND {_y} < 4) OR ({_x} < 4 AND {_y} > 4) AS INT)"), x=(lambda: G.st_crosses(G.geom_from_text(_text("LINESTRING(1 1,{x+1} 1)")()), UNIT()), f"CAST({_x} + 1 > 4 AS INT)"))
_add("spatial_mbr", a=(lambda: G.mbr_contains(UNIT(), BOX()), f"CAST({_x} <= 4 AND {_y} <= 4 AS INT)"), b=(lambda: G.mbr_within(BOX(), UNIT()), f"CAST({_x} <= 4 AND {_y} <= 4 AS INT)"), c=(lambda: G.mbr_covers(UNIT(), POINT()), f"CAST({_x} <= 4 AND {_y} <= 4 AS INT)"), d=(lambda: G.mbr_covered_by(POINT(), UNIT()), f"CAST({_x} <= 4 AND {_y} <= 4 AS INT)"), e=(lambda: G.mbr_equals(UNIT(), BOX()), f"CAST({_x} = 4 AND {_y} = 4 AS INT)"), f=(lambda: G.mbr_disjoint(BOX(), FAR()), "1"), g=(lambda: G.mbr_intersects(BOX(), NEXT()), "1"), h=(lambda: G.mbr_touches(BOX(), NEXT()), "1"), i=(lambda: G.mbr_overlaps(UNIT(), BOX()), f"CAST(({_x} > 4 AND {_y} <= 4) OR ({_x} <= 4 AND {_y} > 4) OR ({_x} > 4 AND {_y} > 4 AND FALSE) AS INT) * CAST(NOT ({_x} >= 4 AND {_y} >= 4) AS INT)"))
_add("spatial_geohash", a=(lambda: G.st_geohash(G.point(X() - X(), Y() - Y()), F.lit(5)), "'s0000'"), b=(lambda: G.st_geohash(G.geom_from_text(F.concat(F.lit("POINT(-5.603027 42.604980)"), F.left("c_name", F.lit(0)))), F.lit(5)), "'ezs42'"), c=(lambda: G.st_lat_from_geohash(G.st_geohash(POINT(), F.lit(12))), f"CAST({_y} AS DOUBLE)"), d=(lambda: G.st_long_from_geohash(G.st_geohash(POINT(), F.lit(12))), f"CAST({_x} AS DOUBLE)"), e=(_t(lambda: G.st_point_from_geohash(G.st_geohash(POINT(), F.lit(12)))), _duck("POINT({x} {y})")))


def spatial_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.point(C("n_nationkey").cast("double"), C("n_regionkey").cast("double"))
    return table(spark, sf_dir, "nation").select("n_regionkey", g.alias("g")).groupBy("n_regionkey").agg(G.st_collect(C("g")).alias("g")).select("n_regionkey", G.st_num_geometries("g").alias("n"), G.st_geometry_type("g").alias("k"))


QUERIES["spatial_collect"] = spatial_collect
ORACLE_SQL["spatial_collect"] = "SELECT n_regionkey, CAST(count(*) AS INT) AS n, 'MULTIPOINT' AS k FROM nation GROUP BY n_regionkey"
