"""Geometry at its edges."""

import pytest

from quern.functions import spatial as G


def g(text):
    return G.from_wkt(text)


def test_texts_and_bytes():
    for text in ("POINT(1 -2.5)", "LINESTRING(0 0,1 1)", "POLYGON((0 0,4 0,4 4,0 0),(1 1,2 1,2 2,1 1))", "MULTIPOINT((1 1),(2 2))", "MULTILINESTRING((0 0,1 1),(2 2,3 3))", "MULTIPOLYGON(((0 0,1 0,1 1,0 0)))", "GEOMETRYCOLLECTION(POINT(1 1),LINESTRING(0 0,1 1))", "GEOMETRYCOLLECTION EMPTY"):
        assert G.to_wkt(g(text)) == text and G.from_wkb(G.to_wkb(g(text))) == g(text)
    for text in ("POINT(1)", "POINT(1 2", "CIRCLE(1 2)", "POINT(1 2) x"):
        with pytest.raises(ValueError, match="3037"):
            g(text)


def test_relations():
    square, hole = g("POLYGON((0 0,4 0,4 4,0 4,0 0))"), g("POLYGON((0 0,9 0,9 9,0 9,0 0),(2 2,7 2,7 7,2 7,2 2))")
    inside, line = g("POLYGON((3 3,5 3,5 5,3 5,3 3))"), g("LINESTRING(-1 2,5 2)")
    assert not G.within(inside, hole) and not G.intersects(inside, hole) and G.overlaps(square, inside)
    assert G.crosses(line, square) and not G.within(line, square) and G.touches(g("LINESTRING(0 0,4 0)"), square)
    assert G.within(g("LINESTRING(1 1,2 2)"), square) and G.equals(square, g("POLYGON((4 4,0 4,0 0,4 0,4 4))"))
    assert G.distance(square, g("POINT(7 8)")) == 5.0 and G.area(hole) == 56.0
    assert not G.valid(g("POLYGON((0 0,2 2,2 0,0 2,0 0))")) and not G.simple(g("LINESTRING(0 0,2 2,2 0,0 2)"))
