"""Geography functions in the plane: boolean operations, touching, simplifying, snapping, and the binary form."""

import math
import random
import struct

import pandas as pd
import pytest

from basalt.functions import udfs
from basalt.functions.geo import parse, st_combine, st_from_wkb, st_line, st_measure2, st_shape


def square(x, y, side):
    return f"POLYGON(({x} {y}, {x + side} {y}, {x + side} {y + side}, {x} {y + side}, {x} {y}))"


def area(wkt):
    polys = [parse(wkt)[1]] if wkt.startswith("POLYGON") else parse(wkt)[1]
    ring = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:]))) / 2
    return sum(ring(p[0]) - sum(map(ring, p[1:])) for p in polys)


def star(rnd):
    n = rnd.randint(3, 9)
    ps = [(round(math.cos(2 * math.pi * i / n) * r, 3), round(math.sin(2 * math.pi * i / n) * r, 3)) for i, r in ((i, rnd.uniform(0.3, 2)) for i in range(n))]
    return "POLYGON((" + ", ".join(f"{x} {y}" for x, y in [*ps, ps[0]]) + "))"


def test_boolean_operations_share_out_the_area():
    rnd = random.Random(1)
    for _ in range(100):
        a, b = star(rnd), star(rnd)
        union, both, left, right = (area(st_combine(x, y, w)) for x, y, w in ((a, b, "union"), (a, b, "intersection"), (a, b, "difference"), (b, a, "difference")))
        assert union == pytest.approx(both + left + right, abs=1e-9)
        assert area(a) == pytest.approx(both + left, abs=1e-9) and area(b) == pytest.approx(both + right, abs=1e-9)


def test_holes_shared_edges_and_empty_results():
    hole = st_combine(square(0, 0, 4), square(1, 1, 2), "difference")
    assert area(hole) == 12 and len(parse(hole)[1][0]) == 2
    assert area(st_combine(hole, square(1, 1, 2), "union")) == 16
    assert st_combine(square(0, 0, 1), square(0, 0, 1), "difference") == "MULTIPOLYGON EMPTY"
    assert st_combine(square(0, 0, 1), square(1, 0, 1), "intersection") == "MULTIPOLYGON EMPTY"
    with pytest.raises(ValueError, match="polygons"):
        st_combine("POINT(0 0)", square(0, 0, 1), "union")


@pytest.mark.parametrize(
    "a,b,want",
    [
        (square(0, 0, 1), square(1, 0, 1), 1),
        (square(0, 0, 1), square(0.5, 0, 1), 0),
        (square(0, 0, 1), square(0, 0, 1), 0),
        (square(0, 0, 1), square(3, 0, 1), 0),
        ("POINT(1 0.5)", square(0, 0, 1), 1),
        ("POINT(.5 .5)", square(0, 0, 1), 0),
        ("LINESTRING(0 0, 1 1)", "LINESTRING(1 1, 2 0)", 1),
        ("LINESTRING(0 0, 2 2)", "LINESTRING(0 2, 2 0)", 0),
        ("LINESTRING(1 0.5, 3 0.5)", square(0, 0, 1), 1),
        ("LINESTRING(0.5 0.5, 3 0.5)", square(0, 0, 1), 0),
        ("POINT(0 0)", "POINT(0 0)", 0),
    ],
)
def test_touches(a, b, want):
    assert st_measure2(a, b, "touches") == st_measure2(b, a, "touches") == want


def test_shapes():
    assert st_shape("POINT(-122.4194567 37.7749123)", 0.0001, "snap") == "POINT(-122.4195 37.7749)"
    assert st_shape("LINESTRING(0 0, 1 0.0001, 2 0, 3 5, 4 0)", 1000.0, "simplify") == "LINESTRING(0 0, 2 0, 3 5, 4 0)"
    assert st_shape(square(0, 0, 1), 1e9, "simplify").count(",") == 3
    ring = parse(st_shape("POINT(10 60)", 1000.0, "buffer"))[1][0]
    assert len(ring) == 33 and max(p[1] for p in ring) == pytest.approx(60 + 1000 / 111320)
    assert st_combine("LINESTRING(0 0, 1 1)", "POINT(1 0)", "closest") == "POINT(0.5 0.5)"
    assert st_combine(square(0, 0, 1), "POINT(0.5 0.5)", "closest") == "POINT(0.5 0.5)"
    assert st_line(["POINT(0 0)", "POINT(1 2)"]) == "LINESTRING(0 0, 1 2)"


def test_binary_form():
    point = lambda order, mark, x, y: struct.pack(f"{order}BIdd", mark, 1, x, y)
    assert st_from_wkb(point("<", 1, 1.5, -2.0)) == st_from_wkb(point(">", 0, 1.5, -2.0)) == "POINT(1.5 -2)"
    ring = struct.pack("<BIII", 1, 3, 1, 4) + struct.pack("<8d", 0, 0, 1, 0, 1, 1, 0, 0)
    assert st_from_wkb(ring) == "POLYGON((0 0, 1 0, 1 1, 0 0))"
    many = struct.pack("<BII", 1, 4, 2) + point("<", 1, 1, 2) + point("<", 1, 3, 4)
    assert st_from_wkb(many) == "MULTIPOINT(1 2, 3 4)"
    assert st_from_wkb(b"POINT(1 2)") == "POINT(1 2)"


def test_functions_by_row_work_out_equal_rows_once(spark, monkeypatch):
    """A large table of few different arguments costs their number, and equal values of different kinds stay apart."""
    calls = []
    f = udfs._vectorised("string", lambda a, b: (calls.append((a, b)), f"{a!r} {b!r}")[1]).func
    monkeypatch.setattr(udfs, "KNOWN", 50)
    a, b = [f"POINT({i % 20} 1)" for i in range(4000)], [0.5] * 4000
    assert list(f(pd.Series(a), pd.Series(b))) == [f"{x!r} 0.5" for x in a]
    assert len(calls) == 20
    odd = [1, 1.0, True, 0.0, -0.0, None, float("nan"), [1], "x" * 1000]
    for _ in range(2):
        got = list(f(pd.Series(odd, dtype=object), pd.Series(["y"] * len(odd))))
        assert got == [None if x is None or x != x else f"{x!r} 'y'" for x in odd]
    many = [str(i) for i in range(500)]
    assert list(f(pd.Series(many), pd.Series(many))) == [f"{x!r} {x!r}" for x in many]
