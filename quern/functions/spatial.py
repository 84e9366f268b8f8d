"""Planar geometry with MySQL results. A geometry is binary: four bytes of SRID, then WKB; functions run in Arrow batches.

In Python a geometry is (kind, coordinates): a point's are (x, y), a line's a list of points, a polygon's a list of
rings, a multi geometry's a list of its parts' coordinates, a collection's a list of geometries.
"""

from __future__ import annotations

import json
import math
import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ["", "POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION"]
_PART = {"MULTIPOINT": "POINT", "MULTILINESTRING": "LINESTRING", "MULTIPOLYGON": "POLYGON"}
EARTH = 6370986.0  # metres; the default radius of distances on a sphere (a fixed value)


# texts and bytes
def number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() and abs(x) < 1e15 else repr(float(x))


def to_wkt(g) -> str:
    kind, c = g
    point = lambda p: f"{number(p[0])} {number(p[1])}"
    line = lambda pts: "(" + ",".join(map(point, pts)) + ")"
    area = lambda rings: "(" + ",".join(map(line, rings)) + ")"
    if kind == "GEOMETRYCOLLECTION":
        return "GEOMETRYCOLLECTION(" + ",".join(map(to_wkt, c)) + ")" if c else "GEOMETRYCOLLECTION EMPTY"
    body = {
        "POINT": lambda: f"({point(c)})", "LINESTRING": lambda: line(c), "POLYGON": lambda: area(c), "MULTIPOINT": lambda: "(" + ",".join(f"({point(p)})" for p in c) + ")",
        "MULTILINESTRING": lambda: area(c), "MULTIPOLYGON": lambda: "(" + ",".join(map(area, c)) + ")",
    }
    return kind + body[kind]()


def from_wkt(text: str):
    tokens = re.findall(r"[A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),]", text)
    at = 0

    def take(x: str | None = None) -> str:
        nonlocal at
        if at >= len(tokens) or x is not None and tokens[at] != x:
            raise ValueError("3037: Invalid GIS data provided to function st_geometryfromtext.")
        at += 1
        return tokens[at - 1]

    def some(one) -> list:
        take("(")
        out = [one()]
        while tokens[at : at + 1] == [","]:
            take(",")
            out.append(one())
        take(")")
        return out

    def coordinate() -> float:
        text_ = take()
        if not re.fullmatch(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", text_):
            raise ValueError("3037: Invalid GIS data provided to function st_geometryfromtext.")
        return float(text_)

    point = lambda: (coordinate(), coordinate())
    line = lambda: some(point)
    area = lambda: some(line)

    def bare():
        if tokens[at : at + 1] == ["("]:
            return some(point)[0]
        return point()

    def geometry():
        kind = take().upper()
        kind = "GEOMETRYCOLLECTION" if kind == "GEOMCOLLECTION" else kind
        if tokens[at : at + 1] and tokens[at].upper() == "EMPTY":
            take()
            return kind, []
        read = {"POINT": lambda: some(point)[0], "LINESTRING": line, "POLYGON": area, "MULTIPOINT": lambda: some(bare), "MULTILINESTRING": area, "MULTIPOLYGON": lambda: some(area), "GEOMETRYCOLLECTION": lambda: some(geometry)}
        if kind not in read:
            raise ValueError("3037: Invalid GIS data provided to function st_geometryfromtext.")
        return kind, read[kind]()

    out = geometry()
    if at != len(tokens):
        raise ValueError("3037: Invalid GIS data provided to function st_geometryfromtext.")
    return out


def to_wkb(g) -> bytes:
    kind, c = g
    head = struct.pack("<BI", 1, KINDS.index(kind))
    points = lambda pts: struct.pack("<I", len(pts)) + b"".join(struct.pack("<dd", *p) for p in pts)
    if kind == "POINT":
        return head + struct.pack("<dd", *c)
    if kind == "LINESTRING":
        return head + points(c)
    if kind == "POLYGON":
        return head + struct.pack("<I", len(c)) + b"".join(map(points, c))
    parts_ = c if kind == "GEOMETRYCOLLECTION" else [(_PART[kind], x) for x in c]
    return head + struct.pack("<I", len(parts_)) + b"".join(map(to_wkb, parts_))


def from_wkb(raw: bytes):
    at = 0

    def read(form: str):
        nonlocal at
        out = struct.unpack_from(form, raw, at)
        at += struct.calcsize(form)
        return out

    def geometry():
        order = "<" if read("B")[0] else ">"
        kind = KINDS[read(order + "I")[0]]
        count = lambda: read(order + "I")[0]
        points = lambda: [read(order + "dd") for _ in range(count())]
        if kind == "POINT":
            return kind, read(order + "dd")
        if kind == "LINESTRING":
            return kind, points()
        if kind == "POLYGON":
            return kind, [points() for _ in range(count())]
        inner = [geometry() for _ in range(count())]
        return kind, inner if kind == "GEOMETRYCOLLECTION" else [x[1] for x in inner]

    return geometry()


def pack(g, srid: int = 0) -> bytes:
    return struct.pack("<I", srid) + to_wkb(g)


def unpack(raw: bytes):
    return from_wkb(bytes(raw)[4:])


_JSON = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon"}


def to_geojson(g) -> dict:
    kind, c = g
    if kind == "GEOMETRYCOLLECTION":
        return {"type": "GeometryCollection", "geometries": [to_geojson(x) for x in c]}
    plain = lambda x: [plain(y) for y in x] if isinstance(x, (list, tuple)) else float(x)
    return {"type": _JSON[kind], "coordinates": plain(c)}


def from_geojson(x: dict):
    if x["type"] == "Feature":
        return from_geojson(x["geometry"])
    if x["type"] in ("GeometryCollection", "FeatureCollection"):
        return "GEOMETRYCOLLECTION", [from_geojson(y) for y in x.get("geometries", x.get("features", []))]
    deep = lambda c: tuple(map(float, c[:2])) if not isinstance(c[0], list) else [deep(y) for y in c]
    return x["type"].upper(), deep(x["coordinates"])


# parts
def parts(g) -> list:
    kind, c = g
    if kind == "GEOMETRYCOLLECTION":
        return [p for x in c for p in parts(x)]
    return [(_PART[kind], x) for x in c] if kind in _PART else [g]


def points_of(g) -> list:
    return [p for kind, c in parts(g) for p in ([c] if kind == "POINT" else c if kind == "LINESTRING" else [q for r in c for q in r])]


def segments_of(g) -> list:
    lines = [x for kind, c in parts(g) for x in ([c] if kind == "LINESTRING" else c if kind == "POLYGON" else [])]
    return [s for x in lines for s in zip(x, x[1:])]


def areas_of(g) -> list:
    return [c for kind, c in parts(g) if kind == "POLYGON"]


def box(g):
    pts = points_of(g)
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    return min(xs), min(ys), max(xs), max(ys)


# measures
def ring_area(r) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:])) / 2


def area(g) -> float:
    return sum(abs(ring_area(c[0])) - sum(abs(ring_area(h)) for h in c[1:]) for c in areas_of(g))


def length(g) -> float:
    return sum(math.dist(a, b) for kind, c in parts(g) if kind == "LINESTRING" for a, b in zip(c, c[1:]))


def centroid(g):
    weight = x = y = 0.0
    if areas_of(g):
        for c in areas_of(g):
            for i, r in enumerate(c):
                own = ring_area(r)
                sign = (1 if i == 0 else -1) * (1 if own >= 0 else -1)
                for a, b in zip(r, r[1:]):
                    k = (a[0] * b[1] - b[0] * a[1]) * sign / 2
                    weight, x, y = weight + k, x + k * (a[0] + b[0]) / 3, y + k * (a[1] + b[1]) / 3
    elif segments_of(g):
        for a, b in segments_of(g):
            k = math.dist(a, b)
            weight, x, y = weight + k, x + k * (a[0] + b[0]) / 2, y + k * (a[1] + b[1]) / 2
    else:
        for a in points_of(g):
            weight, x, y = weight + 1, x + a[0], y + a[1]
    return "POINT", (x / weight, y / weight)


def hull(g):
    pts = sorted(set(points_of(g)))
    if len(pts) == 1:
        return "POINT", pts[0]

    def half(some):
        out = []
        for p in some:
            while len(out) > 1 and _turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(pts) + half(pts[::-1])
    return ("LINESTRING", ring) if len(ring) == 2 else ("POLYGON", [[*ring, ring[0]]])


def _turn(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def on_segment(p, a, b) -> bool:
    return _turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def place(p, rings) -> int:
    """1 inside a polygon, 0 on its boundary, -1 outside."""
    if any(on_segment(p, a, b) for r in rings for a, b in zip(r, r[1:])):
        return 0
    inside = False
    for r in rings:
        for a, b in zip(r, r[1:]):
            if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
                inside = not inside
    return 1 if inside else -1


def _sides(s, t):
    (a, b), (c, d) = s, t
    sign = lambda x: (x > 0) - (x < 0)
    return sign(_turn(a, b, c)), sign(_turn(a, b, d)), sign(_turn(c, d, a)), sign(_turn(c, d, b))


def _cross(s, t) -> bool:
    """Two segments cross inside both."""
    a, b, c, d = _sides(s, t)
    return a * b < 0 and c * d < 0


def _meet(s, t) -> bool:
    return _cross(s, t) or any(on_segment(p, *t) for p in s) or any(on_segment(p, *s) for p in t)


def where(p, g) -> int:
    """1 in the interior of a geometry, 0 on its boundary, -1 outside."""
    best = -1
    for kind, c in parts(g):
        if kind == "POINT":
            at = 1 if p == c else -1
        elif kind == "POLYGON":
            at = place(p, c)
        else:
            at = -1 if not any(on_segment(p, a, b) for a, b in zip(c, c[1:])) else 0 if c[0] != c[-1] and p in (c[0], c[-1]) else 1
        best = max(best, at)
    return best


def _probes(g, other) -> list:
    """Points that tell where g runs against other: its vertices, and midpoints between all its meetings with other's edges."""
    out = list(points_of(g))
    for s in segments_of(g):
        (ax, ay), (bx, by) = s
        cuts = {0.0, 1.0}
        for t in segments_of(other):
            (cx, cy), (dx, dy) = t
            div = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if div:
                u = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / div
                if 0 < u < 1:
                    cuts.add(u)
            else:
                for p in t:
                    if on_segment(p, *s):
                        cuts.add((p[0] - ax) / (bx - ax) if bx != ax else (p[1] - ay) / (by - ay))
        for p in (q for q in points_of(other) if on_segment(q, *s)):
            cuts.add((p[0] - ax) / (bx - ax) if bx != ax else (p[1] - ay) / (by - ay) if by != ay else 0.0)
        order = sorted(cuts)
        out += [(ax + (bx - ax) * (u + v) / 2, ay + (by - ay) * (u + v) / 2) for u, v in zip(order, order[1:])]
    return out


def _near(p, g, tiny: float = 1e-9) -> int:
    """where(), with the boundary a little wide, for computed points."""
    at = where(p, g)
    if at < 1 and any(_point_segment(p, *s) < tiny for s in segments_of(g)):
        return 0 if areas_of(g) else max(at, 1 if not any(math.dist(p, q) < tiny for kind, c in parts(g) if kind == "LINESTRING" and c[0] != c[-1] for q in (c[0], c[-1])) else 0)
    return at


def intersects(a, b) -> bool:
    return any(where(p, b) >= 0 for p in points_of(a)) or any(where(p, a) >= 0 for p in points_of(b)) or any(_meet(s, t) for s in segments_of(a) for t in segments_of(b))


def _inner_point(rings):
    """A point inside a polygon."""
    ys = sorted({p[1] for r in rings for p in r})
    for y0, y1 in zip(ys, ys[1:]):
        y = (y0 + y1) / 2
        xs = sorted(a[0] + (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) for r in rings for a, b in zip(r, r[1:]) if (a[1] > y) != (b[1] > y))
        for x0, x1 in zip(xs[::2], xs[1::2]):
            if x1 > x0:
                return (x0 + x1) / 2, y
    return rings[0][0]


def dimension(g) -> int:
    return max(({"POINT": 0, "LINESTRING": 1, "POLYGON": 2}[kind] for kind, _ in parts(g)), default=-1)


def interiors_meet(a, b) -> bool:
    if dimension(a) == 2 and dimension(b) == 2:
        if any(_cross(s, t) for s in segments_of(a) for t in segments_of(b)):
            return True
        return any(_near(p, b) == 1 for p in _probes(a, b)) or any(_near(p, a) == 1 for p in _probes(b, a)) or any(where(_inner_point(c), b) == 1 for c in areas_of(a)) or any(where(_inner_point(c), a) == 1 for c in areas_of(b))
    low, high = (a, b) if dimension(a) <= dimension(b) else (b, a)
    if dimension(low) == 1 and dimension(high) == 1 and any(_cross(s, t) for s in segments_of(low) for t in segments_of(high)):
        return True
    return any(_near(p, high) == 1 and _near(p, low) == 1 for p in _probes(low, high))


def within(a, b) -> bool:
    """No point of a outside b, and their interiors meet."""
    if any(_near(p, b) < 0 for p in _probes(a, b)) or dimension(a) > dimension(b):
        return False
    if dimension(a) == 2 and any(_near(_inner_point(c), b) < 0 for c in areas_of(a)):
        return False
    if dimension(a) == 2 and any(where(_inner_point([h]), b) < 0 and where(_inner_point([h]), a) >= 0 for c in areas_of(b) for h in c[1:]):
        return False
    return interiors_meet(a, b)


def touches(a, b) -> bool:
    return not (dimension(a) == 0 and dimension(b) == 0) and intersects(a, b) and not interiors_meet(a, b)


def crosses(a, b) -> bool:
    da, db = dimension(a), dimension(b)
    if da < db:
        return interiors_meet(a, b) and not within(a, b)
    return da == db == 1 and any(_cross(s, t) for s in segments_of(a) for t in segments_of(b)) and not within(a, b) and not within(b, a)


def overlaps(a, b) -> bool:
    return dimension(a) == dimension(b) and interiors_meet(a, b) and not within(a, b) and not within(b, a) and not (dimension(a) == 1 and crosses(a, b))


def equals(a, b) -> bool:
    return set(points_of(a)) == set(points_of(b)) if dimension(a) == dimension(b) == 0 else within(a, b) and within(b, a)


def _point_segment(p, a, b) -> float:
    d = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
    t = max(0.0, min(1.0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / d)) if d else 0.0
    return math.dist(p, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))


def distance(a, b) -> float:
    if intersects(a, b):
        return 0.0
    found = [math.dist(p, q) for p in points_of(a) for q in points_of(b)]
    found += [_point_segment(p, *s) for p in points_of(a) for s in segments_of(b)] + [_point_segment(p, *s) for p in points_of(b) for s in segments_of(a)]
    return min(found)


def sphere(a, b, radius: float = EARTH) -> float:
    """The least great-circle distance of two geometries' points, degrees as (longitude, latitude)."""
    def one(p, q):
        x, y, u, v = map(math.radians, (*p, *q))
        h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
        return 2 * radius * math.asin(math.sqrt(h))

    return min(one(p, q) for p in points_of(a) for q in points_of(b))


def hausdorff(a, b) -> float:
    """Discrete: over the vertices."""
    far = lambda s, t: max(min(math.dist(p, q) for q in t) for p in s)
    return max(far(points_of(a), points_of(b)), far(points_of(b), points_of(a)))


def frechet(a, b) -> float:
    """Discrete: over the vertices in order."""
    p, q = points_of(a), points_of(b)
    row: list[float] = []
    for i, x in enumerate(p):
        new: list[float] = []
        for j, y in enumerate(q):
            before = [v for v in (row[j] if i else None, new[j - 1] if j else None, row[j - 1] if i and j else None) if v is not None]
            new.append(max(min(before, default=0.0), math.dist(x, y)))
        row = new
    return row[-1]


def simplify(g, limit: float):
    """Douglas-Peucker on each line and ring."""
    def line(pts):
        if len(pts) < 3:
            return pts
        k, d = max(((i, _point_segment(pts[i], pts[0], pts[-1])) for i in range(1, len(pts) - 1)), key=lambda x: x[1])
        return [pts[0], pts[-1]] if d <= limit else line(pts[: k + 1])[:-1] + line(pts[k:])

    kind, c = g
    change = {"POINT": lambda x: x, "LINESTRING": line, "POLYGON": lambda rs: [line(r) for r in rs]}
    if kind == "GEOMETRYCOLLECTION":
        return kind, [simplify(x, limit) for x in c]
    return kind, [change[_PART[kind]](x) for x in c] if kind in _PART else change[kind](c)


def along(g, distance_: float):
    """The point of a line at a distance from its start."""
    pts = g[1]
    for a, b in zip(pts, pts[1:]):
        d = math.dist(a, b)
        if distance_ <= d:
            t = distance_ / d if d else 0.0
            return "POINT", (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
        distance_ -= d
    return "POINT", pts[-1]


def along_all(g, share: float):
    n = int(1 / share + 1e-9)
    return "MULTIPOINT", [along(g, length(g) * share * (k + 1))[1] for k in range(n)]


def swapped(g):
    flip = lambda x: (x[1], x[0]) if isinstance(x, tuple) else [flip(y) for y in x]
    return g[0], [swapped(x) for x in g[1]] if g[0] == "GEOMETRYCOLLECTION" else flip(g[1])


def envelope(g):
    x0, y0, x1, y1 = box(g)
    if x0 == x1 and y0 == y1:
        return "POINT", (x0, y0)
    if x0 == x1 or y0 == y1:
        return "LINESTRING", [(x0, y0), (x1, y1)]
    return "POLYGON", [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]


def simple(g) -> bool:
    """No line meets itself but at its ends; points don't repeat."""
    if dimension(g) == 0:
        return len(set(points_of(g))) == len(points_of(g))
    for kind, c in parts(g):
        if kind == "LINESTRING":
            s = list(zip(c, c[1:]))
            for i in range(len(s)):
                for j in range(i + 1, len(s)):
                    closed = i == 0 and j == len(s) - 1 and c[0] == c[-1]
                    if j == i + 1 or closed:
                        if _cross(s[i], s[j]) or (on_segment(s[j][1], *s[i]) and not closed) or (on_segment(s[i][0], *s[j]) and not closed):
                            return False
                    elif _meet(s[i], s[j]):
                        return False
    return True


def valid(g) -> bool:
    for kind, c in parts(g):
        if kind == "LINESTRING" and (len(c) < 2 or len(set(c)) < 2):
            return False
        if kind == "POLYGON":
            for r in c:
                if len(r) < 4 or r[0] != r[-1] or ring_area(r) == 0 or not simple(("LINESTRING", r)):
                    return False
            if any(place(p, [c[0]]) < 0 for h in c[1:] for p in h):
                return False
    return True


_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"  # the digits of geohashes (a fixed value)


def geohash(lon: float, lat: float, n: int) -> str:
    spans, out, bit, cell, even = [[-180.0, 180.0], [-90.0, 90.0]], "", 0, 0, 0
    while len(out) < n:
        span, v = spans[even], (lon, lat)[even]
        mid = sum(span) / 2
        cell = cell * 2 + (v >= mid)
        span[0 if v >= mid else 1] = mid
        even ^= 1
        bit += 1
        if bit == 5:
            out, bit, cell = out + _BASE32[cell], 0, 0
    return out


def from_geohash(text: str) -> tuple[float, float]:
    """(longitude, latitude): the cell's middle, with as few digits as tell it."""
    spans, even = [[-180.0, 180.0], [-90.0, 90.0]], 0
    for c in text.lower():
        for k in (16, 8, 4, 2, 1):
            span = spans[even]
            span[0 if _BASE32.index(c) & k else 1] = sum(span) / 2
            even ^= 1
    out = []
    for lo, hi in spans:
        mid, digits = (lo + hi) / 2, 0
        while digits < 12 and not lo <= round(mid, digits) <= hi:
            digits += 1
        out.append(round(mid, digits))
    return out[0], out[1]


# Columns
def _apply(f, kind: str, *columns: Column) -> Column:
    """f of the row's values; NULL if any is. Rows of equal values in a batch share one call."""
    @F.pandas_udf(kind)
    def run(*batch: pd.Series) -> pd.Series:
        none = lambda v: v is None or isinstance(v, float) and v != v
        one = lambda row: None if any(map(none, row)) else f(*row)
        rows = list(zip(*(b.tolist() for b in batch)))
        # arrays have no hash, and 0.0 equals -0.0
        if not all(isinstance(v, (str, bytes, int, type(None))) for row in rows for v in row):
            return pd.Series(list(map(one, rows)), dtype=object)
        known = {row: one(row) for row in set(rows)}
        return pd.Series([known[row] for row in rows], dtype=object)

    return run(*columns)


def _geometry(f):
    """f on geometries and other values, with a geometry as its result, of the first one's SRID."""
    def run(raw, *rest):
        g = f(unpack(raw), *(unpack(x) if isinstance(x, (bytes, bytearray)) else x for x in rest))
        return None if g is None else bytes(raw)[:4] + to_wkb(g)

    return lambda *c: _apply(run, "binary", *c)


def _value(f, kind: str):
    return lambda *c: _apply(lambda *row: f(*(unpack(x) if isinstance(x, (bytes, bytearray)) else x for x in row)), kind, *c)


def _truth(f):
    return _value(lambda *a: int(f(*a)), "int")


def geom_from_text(text: Column, srid: int = 0) -> Column:
    return _apply(lambda t: pack(from_wkt(t), srid), "binary", text)


def geom_from_wkb(raw: Column, srid: int = 0) -> Column:
    return _apply(lambda b: pack(from_wkb(bytes(b)), srid), "binary", raw)


def geom_from_geojson(text: Column, srid: int = 4326) -> Column:
    return _apply(lambda t: pack(from_geojson(json.loads(t)), srid), "binary", text)


def of_kind(g: Column, kind: str) -> Column:
    """What ST_PointFromText, ST_PolyFromWKB and their like add: an error for another kind of geometry."""
    def check(raw):
        if unpack(raw)[0] != kind:
            raise ValueError(f"3516: not a {kind}")
        return bytes(raw)

    return _apply(check, "binary", g)


def point(x: Column, y: Column) -> Column:
    return _apply(lambda a, b: pack(("POINT", (float(a), float(b)))), "binary", x, y)


def _collected(kind: str, part: str):
    def run(*raw):
        some = [unpack(x) for x in raw]
        if part and any(g[0] != part for g in some):
            raise ValueError(f"1367: a {kind} is made of {part}s")
        return pack((kind, [g[1] for g in some] if part else some))

    return lambda *c: _apply(run, "binary", *c)


line_string = _collected("LINESTRING", "POINT")
polygon = _collected("POLYGON", "LINESTRING")
multi_point = _collected("MULTIPOINT", "POINT")
multi_line_string = _collected("MULTILINESTRING", "LINESTRING")
multi_polygon = _collected("MULTIPOLYGON", "POLYGON")
geometry_collection = _collected("GEOMETRYCOLLECTION", "")

st_as_text = _value(to_wkt, "string")
st_as_binary = lambda g: F.substring(g, 5, 1 << 30)
st_as_geojson = _value(lambda g: json.dumps(to_geojson(g)), "string")
st_srid = lambda g: _apply(lambda b: int.from_bytes(bytes(b)[:4], "little"), "bigint", g)
st_set_srid = lambda g, n: _apply(lambda b: struct.pack("<I", n) + bytes(b)[4:], "binary", g)
st_x = _value(lambda g: g[1][0], "double")
st_y = _value(lambda g: g[1][1], "double")
st_longitude, st_latitude = st_x, st_y
st_geometry_type = _value(lambda g: "GEOMCOLLECTION" if g[0] == "GEOMETRYCOLLECTION" else g[0], "string")
st_dimension = _value(dimension, "int")
st_envelope = _geometry(envelope)
st_is_empty = _truth(lambda g: not points_of(g))
st_is_simple = _truth(simple)
st_is_valid = _truth(valid)
st_validate = _geometry(lambda g: g if valid(g) else None)
st_is_closed = _truth(lambda g: all(c[0] == c[-1] for kind, c in parts(g) if kind == "LINESTRING"))
st_length = _value(length, "double")
st_area = _value(area, "double")
st_centroid = _geometry(centroid)
st_convex_hull = _geometry(hull)
st_exterior_ring = _geometry(lambda g: ("LINESTRING", g[1][0]))
st_interior_ring_n = _geometry(lambda g, n: ("LINESTRING", g[1][n]) if 1 <= n < len(g[1]) else None)
st_num_interior_rings = _value(lambda g: len(g[1]) - 1, "int")
st_num_points = _value(lambda g: len(g[1]), "int")
st_num_geometries = _value(lambda g: len(g[1]), "int")
st_start_point = _geometry(lambda g: ("POINT", g[1][0]))
st_end_point = _geometry(lambda g: ("POINT", g[1][-1]))
st_point_n = _geometry(lambda g, n: ("POINT", g[1][n - 1]) if 1 <= n <= len(g[1]) else None)
st_geometry_n = _geometry(lambda g, n: None if not 1 <= n <= len(g[1]) else g[1][n - 1] if g[0] == "GEOMETRYCOLLECTION" else (_PART[g[0]], g[1][n - 1]))
st_swap_xy = _geometry(swapped)
st_simplify = _geometry(simplify)
st_line_interpolate_point = _geometry(lambda g, t: along(g, length(g) * t))
st_line_interpolate_points = _geometry(along_all)
st_point_at_distance = _geometry(along)
st_make_envelope = _geometry(lambda a, b: envelope(("MULTIPOINT", [a[1], b[1]])))
st_distance = _value(distance, "double")
st_distance_sphere = _value(sphere, "double")
st_hausdorff_distance = _value(hausdorff, "double")
st_frechet_distance = _value(frechet, "double")
st_intersects = _truth(intersects)
st_disjoint = _truth(lambda a, b: not intersects(a, b))
st_contains = _truth(lambda a, b: within(b, a))
st_within = _truth(within)
st_touches = _truth(touches)
st_crosses = _truth(crosses)
st_overlaps = _truth(overlaps)
st_equals = _truth(equals)
st_geohash = _value(lambda g, n: geohash(*g[1], n), "string")
st_lat_from_geohash = lambda c: _apply(lambda t: from_geohash(t)[1], "double", c)
st_long_from_geohash = lambda c: _apply(lambda t: from_geohash(t)[0], "double", c)
st_point_from_geohash = lambda c, srid=0: _apply(lambda t: pack(("POINT", from_geohash(t)), srid), "binary", c)


def _boxes(f):
    return _truth(lambda a, b: f(box(a), box(b)))


def _inside(a, b) -> bool:
    return b[0] <= a[0] and b[1] <= a[1] and a[2] <= b[2] and a[3] <= b[3]


def _proper(a, b) -> bool:
    """The interiors of two boxes meet; a box without width is its own interior."""
    one = lambda lo, hi, u, v: max(lo, u) < min(hi, v) or lo == hi and u < lo < v or u == v and lo < u < hi or lo == hi == u == v
    return one(a[0], a[2], b[0], b[2]) and one(a[1], a[3], b[1], b[3])


def _apart(a, b) -> bool:
    return a[2] < b[0] or b[2] < a[0] or a[3] < b[1] or b[3] < a[1]


mbr_contains = _boxes(lambda a, b: _inside(b, a) and _proper(a, b))
mbr_within = _boxes(lambda a, b: _inside(a, b) and _proper(a, b))
mbr_covers = _boxes(lambda a, b: _inside(b, a))
mbr_covered_by = _boxes(_inside)
mbr_disjoint = _boxes(_apart)
mbr_intersects = _boxes(lambda a, b: not _apart(a, b))
mbr_equals = _boxes(lambda a, b: a == b)
mbr_touches = _boxes(lambda a, b: not _apart(a, b) and not _proper(a, b))
mbr_overlaps = _boxes(lambda a, b: _proper(a, b) and not _inside(a, b) and not _inside(b, a))


def st_collect(g: Column) -> Column:
    """ST_Collect of a group: a multi geometry of one kind, else a collection; NULLs are left out, no geometry gives NULL."""
    def run(some):
        found = [unpack(x) for x in some]
        kinds = {x[0] for x in found}
        multi = {v: k for k, v in _PART.items()}
        if len(kinds) == 1 and (kind := kinds.pop()) in multi:
            return pack((multi[kind], [x[1] for x in found]))
        return pack(("GEOMETRYCOLLECTION", found))

    all_ = F.array_sort(F.collect_list(g))
    return F.when(F.size(all_) > 0, _apply(run, "binary", all_))
