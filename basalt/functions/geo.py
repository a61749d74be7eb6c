"""Geography over WKT text: parsing, measures on the sphere, and simple planar predicates."""

from __future__ import annotations

import json
import math
import re
import struct
from fractions import Fraction

RADIUS = 6371008.7714  #: metres, the mean radius of the Earth
DEGREE = 111320.0  #: metres to a degree
_TYPES = ("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION")
_GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"

Point = tuple[float, float]


def parse(wkt: str) -> tuple[str, list]:
    """(type, nested coordinate lists) of a WKT text; a point is one pair, a polygon a list of rings."""
    m = re.fullmatch(r"\s*([A-Za-z]+)\s*(EMPTY|\(.*\))\s*", wkt, re.S | re.I)
    if not m or m[1].upper() not in _TYPES:
        raise ValueError(f"invalid WKT: {wkt!r}")
    kind = m[1].upper()
    if m[2].upper() == "EMPTY":
        return kind, []
    if kind == "GEOMETRYCOLLECTION":
        return kind, [parse(p) for p in re.findall(r"[A-Za-z]+\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)", m[2][1:-1])]
    pair = lambda p: f"[{float(p[1])},{float(p[2])}]"
    listed = re.sub(r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s+(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)", pair, m[2]).replace("(", "[").replace(")", "]")
    coords = json.loads(listed)
    if kind == "POINT":
        return kind, [tuple(coords[0])]
    if kind == "MULTIPOINT":
        return kind, [tuple(c[0] if isinstance(c[0], list) else c) for c in coords]
    as_points = lambda ring: [tuple(p) for p in ring]
    if kind == "LINESTRING":
        return kind, as_points(coords)
    if kind == "MULTIPOLYGON":
        return kind, [[as_points(r) for r in poly] for poly in coords]
    return kind, [as_points(r) for r in coords]


def points(g: tuple[str, list]) -> list[Point]:
    """All points of a geometry, in order."""
    out: list[Point] = []

    def walk(x):
        if isinstance(x, tuple) and len(x) == 2 and isinstance(x[0], (int, float)):
            out.append(x)
        elif isinstance(x, tuple):
            walk(x[1])
        else:
            for y in x:
                walk(y)

    walk(g[1])
    return out


def rings(g: tuple[str, list]) -> list[list[Point]]:
    return [r for poly in g[1] for r in poly] if g[0] == "MULTIPOLYGON" else g[1] if g[0] == "POLYGON" else []


def lines(g: tuple[str, list]) -> list[list[Point]]:
    return [g[1]] if g[0] == "LINESTRING" else g[1] if g[0] == "MULTILINESTRING" else rings(g)


def _num(x: float) -> str:
    return repr(int(x)) if float(x).is_integer() else repr(float(x))


def write(kind: str, coords) -> str:
    pair = lambda p: f"{_num(p[0])} {_num(p[1])}"
    ring = lambda r: "(" + ", ".join(map(pair, r)) + ")"
    if not coords:
        return f"{kind} EMPTY"
    if kind == "POINT":
        return f"POINT({pair(coords[0])})"
    if kind in ("LINESTRING", "MULTIPOINT"):
        return kind + ring(coords)
    if kind in ("POLYGON", "MULTILINESTRING"):
        return kind + "(" + ", ".join(map(ring, coords)) + ")"
    return kind + "(" + ", ".join("(" + ", ".join(map(ring, p)) + ")" for p in coords) + ")"


def arc(a: Point, b: Point) -> float:
    """Great-circle distance in metres (haversine)."""
    (x1, y1), (x2, y2) = [(math.radians(p[0]), math.radians(p[1])) for p in (a, b)]
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * RADIUS * math.asin(min(1.0, math.sqrt(h)))


def _to_segment(p: Point, a: Point, b: Point, scale: float | None = None) -> Point:
    scale = math.cos(math.radians(p[1])) if scale is None else scale
    ax, ay, bx, by = (a[0] - p[0]) * scale, a[1] - p[1], (b[0] - p[0]) * scale, b[1] - p[1]
    dx, dy = bx - ax, by - ay
    t = 0.0 if dx == dy == 0 else max(0.0, min(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
    return a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])


def _segments(g):
    return [s for line in lines(g) for s in zip(line, line[1:])]


def inside(p: Point, g) -> bool:
    """Whether a point lies in the polygons of ``g`` (border included), by crossings."""
    hit = False
    for ring in rings(g):
        for a, b in zip(ring, ring[1:]):
            cross = (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
            if cross == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1]):
                return True
            if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
                hit = not hit
    return hit


def _cross(s, t) -> bool:
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    (a, b), (c, d) = s, t
    o = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
    if (o[0] > 0) != (o[1] > 0) and (o[2] > 0) != (o[3] > 0):
        return True
    on = lambda p, q, r: min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])
    return any(v == 0 and on(*e) for v, e in zip(o, ((a, b, c), (a, b, d), (c, d, a), (c, d, b))))


def intersects(g, h) -> bool:
    if any(inside(p, h) for p in points(g)) or any(inside(p, g) for p in points(h)):
        return True
    if set(points(g)) & set(points(h)) or any(_cross(s, t) for s in _segments(g) for t in _segments(h)):
        return True
    return any(_to_segment(p, *s) == p for a, b in ((g, h), (h, g)) if not lines(a) for p in points(a) for s in _segments(b))


def st_distance(a: str, b: str) -> float | None:
    g, h = parse(a), parse(b)
    if not points(g) or not points(h):
        return None
    if intersects(g, h):
        return 0.0
    best = min(arc(p, q) for p in points(g) for q in points(h))
    for x, y in ((g, h), (h, g)):
        best = min([best, *(arc(p, _to_segment(p, *s)) for p in points(x) for s in _segments(y))])
    return best


def st_measure2(a: str, b: str, what: str) -> float:
    g, h = parse(a), parse(b)
    if what == "maxdistance":
        return max(arc(p, q) for p in points(g) for q in points(h))
    if what == "intersects":
        return float(intersects(g, h))
    if what == "touches":
        return float(intersects(g, h) and not _interiors_meet(g, h))
    if what == "equals":
        return float(g == h or (g[0] == h[0] and set(points(g)) == set(points(h))))
    if rings(g):
        return float(all(inside(p, g) for p in points(h)) and bool(points(h)))
    return float(set(points(h)) <= set(points(g)) or (g[0] == "LINESTRING" and all(any(arc(p, _to_segment(p, *s)) < 1e-6 for s in _segments(g)) for p in points(h))))


def _ring_area(ring) -> float:
    total = 0.0
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        total += math.radians(x2 - x1) * (2 + math.sin(math.radians(y1)) + math.sin(math.radians(y2)))
    return abs(total) * RADIUS * RADIUS / 2


def st_number(a: str, what: str) -> float:
    g = parse(a)
    if what == "numpoints":
        return float(len(points(g)))
    if what == "dimension":
        return float(2 if "POLYGON" in g[0] else 1 if "LINE" in g[0] else 0)
    if what in ("length", "perimeter"):
        own = rings(g) if what == "perimeter" else [] if rings(g) else lines(g)
        return sum(arc(p, q) for line in own for p, q in zip(line, line[1:]))
    if what == "area":
        polys = g[1] if g[0] == "MULTIPOLYGON" else [g[1]] if g[0] == "POLYGON" else []
        return sum(_ring_area(p[0]) - sum(map(_ring_area, p[1:])) for p in polys if p)
    if what == "collection":
        return float(g[0].startswith("MULTI") or g[0] == "GEOMETRYCOLLECTION")
    closed = g[0] in ("POINT", "MULTIPOINT", "POLYGON", "MULTIPOLYGON") or bool(g[1]) and g[1][0] == g[1][-1]
    if what == "closed":
        return float(closed)
    return float(g[0] == "LINESTRING" and closed and len(set(g[1])) == len(g[1]) - 1)


def hull(ps: list[Point]) -> list[Point]:
    """The convex hull, counter-clockwise from its leftmost point, by monotone chains."""
    ps = sorted(set(ps))
    if len(ps) < 3:
        return ps

    def chain(order):
        out: list[Point] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(ps) + chain(ps[::-1])


def st_text(a: str, what: str) -> str | None:
    if what == "fromgeojson":
        o = json.loads(a)
        c = o["coordinates"]
        deep = lambda x: tuple(x) if not isinstance(x[0], list) else [deep(y) for y in x]
        return write(o["type"].upper(), [deep(c)] if o["type"] == "Point" else deep(c))
    g = parse(a)
    ps = points(g)
    if what == "geojson":
        name = {t.lower(): n for t, n in zip(_TYPES, ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection"))}[g[0].lower()]
        deep = lambda x: list(x) if isinstance(x, tuple) else [deep(y) for y in x]
        return json.dumps({"type": name, "coordinates": deep(g[1][0] if g[0] == "POINT" else g[1])})
    if what == "type":
        return {t: n for t, n in zip(_TYPES, ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection"))}[g[0]]
    if not ps:
        return None
    if what in ("start", "end"):
        return write("POINT", [ps[0 if what == "start" else -1]]) if g[0] == "LINESTRING" else None
    if what == "centroid":
        own = ps[:-1] if rings(g) else ps
        return write("POINT", [(sum(p[0] for p in own) / len(own), sum(p[1] for p in own) / len(own))])
    if what == "hull":
        h = hull(ps)
        return write("POLYGON", [[*h, h[0]]]) if len(h) > 2 else write("LINESTRING" if len(h) == 2 else "POINT", h)
    if what == "box":
        x, y = sorted(p[0] for p in ps), sorted(p[1] for p in ps)
        return write("POLYGON", [[(x[0], y[0]), (x[-1], y[0]), (x[-1], y[-1]), (x[0], y[-1]), (x[0], y[0])]])
    if rings(g):
        return write("LINESTRING", g[1][0]) if g[0] == "POLYGON" and len(g[1]) == 1 else write("MULTILINESTRING", rings(g))
    return write("MULTIPOINT", [ps[0], ps[-1]]) if g[0] == "LINESTRING" and ps[0] != ps[-1] else f"{'MULTIPOINT' if g[0] == 'LINESTRING' else 'GEOMETRYCOLLECTION'} EMPTY"


def st_pointn(a: str, n: int) -> str | None:
    ps = points(parse(a))
    n = n - 1 if n > 0 else n
    return write("POINT", [ps[n]]) if -len(ps) <= n < len(ps) else None


def st_parse(a: str) -> str:
    return write(*parse(a)) if parse(a)[0] != "GEOMETRYCOLLECTION" else a


def st_make2(a: str, b: str, what: str) -> str:
    return write("LINESTRING", points(parse(a)) + points(parse(b)))


def st_geohash(a: str, size: int) -> str:
    """Interleaved halvings of longitude and latitude, five to a letter."""
    (x, y), bits = points(parse(a))[0], 0
    box = [[-180.0, 180.0], [-90.0, 90.0]]
    for i in range(5 * size):
        low, high = box[i % 2]
        mid = (low + high) / 2
        up = (x, y)[i % 2] >= mid
        bits = bits << 1 | up
        box[i % 2] = [mid, high] if up else [low, mid]
    return "".join(_GEOHASH[bits >> 5 * (size - 1 - i) & 31] for i in range(size))


def st_from_geohash(s: str) -> str:
    box = [[-180.0, 180.0], [-90.0, 90.0]]
    for i, c in enumerate(s.lower()):
        v = _GEOHASH.index(c)
        for j in range(5):
            axis = (5 * i + j) % 2
            mid = sum(box[axis]) / 2
            box[axis][0 if v >> (4 - j) & 1 else 1] = mid
    return write("POINT", [(sum(box[0]) / 2, sum(box[1]) / 2)])


def _winding(ring: list) -> Fraction:
    """Twice the signed area of a closed ring; positive if counter-clockwise."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))


def _directed(g) -> list:
    """Exact edges of the polygons of ``g`` with the inside on their left."""
    out = []
    for poly in g[1] if g[0] == "MULTIPOLYGON" else [g[1]]:
        for n, ring in enumerate(poly):
            exact = [(Fraction(x), Fraction(y)) for x, y in ring]
            if (_winding(exact) > 0) != (n == 0):
                exact.reverse()
            out += [(a, b) for a, b in zip(exact, exact[1:]) if a != b]
    return out


def _cut(edges: list, by: list) -> list:
    """Edges split wherever an edge of ``by`` meets them."""
    out = []
    for a, b in edges:
        dx, dy = b[0] - a[0], b[1] - a[1]
        along = lambda p: (p[0] - a[0]) * dx + (p[1] - a[1]) * dy  # noqa: B023, E731
        at = {a, b}
        for c, d in by:
            ex, ey = d[0] - c[0], d[1] - c[1]
            cross = dx * ey - dy * ex
            if cross:
                t, u = ((c[0] - a[0]) * ey - (c[1] - a[1]) * ex) / cross, ((c[0] - a[0]) * dy - (c[1] - a[1]) * dx) / cross
                if 0 <= t <= 1 and 0 <= u <= 1:
                    at.add((a[0] + t * dx, a[1] + t * dy))
            elif (c[0] - a[0]) * dy == (c[1] - a[1]) * dx:
                at |= {p for p in (c, d) if 0 <= along(p) <= dx * dx + dy * dy}
        ordered = sorted(at, key=along)
        out += list(zip(ordered, ordered[1:]))
    return out


def _within(p, edges: list) -> bool:
    """Whether a point that is on no edge lies inside, by crossings to its right."""
    hits = [p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0] for a, b in edges if (a[1] > p[1]) != (b[1] > p[1])]
    return sum(hits) % 2 == 1


def _sides(parts: list, other: list, edges: list) -> dict:
    """Cut edges by where they run: inside the other, outside, along it, or along it the other way."""
    out: dict[str, list] = {"in": [], "out": [], "same": [], "against": []}
    there = set(other)
    for a, b in parts:
        middle = ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)
        where = "same" if (a, b) in there else "against" if (b, a) in there else "in" if _within(middle, edges) else "out"
        out[where].append((a, b))
    return out


def _stitched(edges: list) -> list:
    """Closed rings of directed edges, turning left as far as possible, so that rings that touch stay apart."""
    leaving: dict = {}
    for a, b in edges:
        leaving.setdefault(a, []).append(b)
    out = []
    while leaving:
        start = next(iter(leaving))
        ring = [start]
        while len(ring) == 1 or ring[-1] != start:
            here = ring[-1]
            heading = math.atan2(here[1] - ring[-2][1], here[0] - ring[-2][0]) if len(ring) > 1 else 0.0
            turn = lambda p: (math.atan2(p[1] - here[1], p[0] - here[0]) - heading + math.pi) % (2 * math.pi)  # noqa: B023, E731
            ring.append(max(leaving[here], key=turn))
            leaving[here].remove(ring[-1])
            if not leaving[here]:
                del leaving[here]
        out.append(ring)
    return out


def combine(g, h, what: str) -> list:
    """The polygons of a union, intersection or difference of polygons in the plane, on exact fractions."""
    if any("POLYGON" not in x[0] for x in (g, h)):
        raise ValueError(f"ST_{what.upper()} takes polygons")
    e, f = _directed(g), _directed(h)
    p, q = _cut(e, f), _cut(f, e)
    a, b = _sides(p, q, f), _sides(q, p, e)
    back = [(y, x) for x, y in b["in"]]
    rings_ = _stitched({"union": a["out"] + b["out"] + a["same"], "intersection": a["in"] + b["in"] + a["same"], "difference": a["out"] + back + a["against"]}[what])
    outer = [[r] for r in rings_ if _winding(r) > 0]
    for hole in (r for r in rings_ if _winding(r) < 0):
        x, y = ((hole[0][i] + hole[1][i]) / 2 for i in (0, 1))
        holder = [o for o in outer if _within((x, y), list(zip(o[0], o[0][1:])))]
        if holder:
            min(holder, key=lambda o: _winding(o[0])).append(hole)
    return [[[(float(x), float(y)) for x, y in r] for r in poly] for poly in outer]


def _ends(g) -> set:
    """The boundary points of lines."""
    return {p for line in lines(g) if line and line[0] != line[-1] for p in (line[0], line[-1])}


def _interiors_meet(g, h) -> bool:
    if rings(h) and not rings(g):
        g, h = h, g
    if rings(g):
        if rings(h):
            return bool(combine(g, h, "intersection"))
        edges = _directed(g)
        exact = [((Fraction(a[0]), Fraction(a[1])), (Fraction(b[0]), Fraction(b[1]))) for a, b in _segments(h) if a != b]
        if not lines(h):
            spots = [(Fraction(x), Fraction(y)) for x, y in points(h)]
        else:
            spots = [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in _cut(exact, edges)]
        on = lambda p, a, b: (b[0] - a[0]) * (p[1] - a[1]) == (b[1] - a[1]) * (p[0] - a[0]) and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])
        return any(_within(p, edges) and not any(on(p, *s) for s in edges) for p in spots)
    ends = _ends(g) | _ends(h)
    if not lines(g) or not lines(h):
        return any(p not in ends for p in points(g if not lines(g) else h))
    exact = [[((Fraction(a[0]), Fraction(a[1])), (Fraction(b[0]), Fraction(b[1]))) for a, b in _segments(x) if a != b] for x in (g, h)]
    p, q = _cut(*exact), _cut(*exact[::-1])
    met = {x for s in p for x in s} & {x for s in q for x in s}
    return any((s in q) or (s[::-1] in q) for s in p) or any((float(x), float(y)) not in ends for x, y in met)


def thinned(line: list[Point], least: float, keep: int) -> list[Point]:
    """A line without the points whose triangles with their neighbours are at most ``least``, smallest first (Visvalingam)."""
    line = list(line)
    while len(line) > keep:
        areas = [abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) / 2 for a, b, c in zip(line, line[1:], line[2:])]
        if min(areas) > least:
            break
        del line[areas.index(min(areas)) + 1]
    return line


def st_shape(a: str, by: float, what: str) -> str:
    """ST_SIMPLIFY (metres), ST_SNAPTOGRID (degrees) and ST_BUFFER (metres; the hull of circles of 32 corners around the points)."""
    g = parse(a)
    if what == "simplify":
        if g[0] == "LINESTRING":
            return write(g[0], thinned(g[1], by / DEGREE, 2))
        return write(g[0], [thinned(g[1][0], by / DEGREE, 4)]) if g[0] == "POLYGON" and g[1] else a
    if what == "snap":
        snap = lambda x: tuple(round(round(v / by) * by, 12) for v in x) if isinstance(x, tuple) else [snap(y) for y in x]
        return write(g[0], snap(g[1]))
    corners = [(math.cos(2 * math.pi * i / 32), math.sin(2 * math.pi * i / 32)) for i in range(32)]
    around = [(x + by / DEGREE / max(math.cos(math.radians(y)), 1e-9) * u, y + by / DEGREE * v) for x, y in points(g) for u, v in corners]
    h = hull(around)
    return write("POLYGON", [[*h, h[0]]]) if len(h) > 2 else "POLYGON EMPTY"


def st_combine(a: str, b: str, what: str) -> str | None:
    g, h = parse(a), parse(b)
    if what != "closest":
        return write("MULTIPOLYGON", combine(g, h, what))
    if not points(g) or not points(h):
        return None
    p = points(h)[0]
    if inside(p, g):
        return write("POINT", [p])
    near = [_to_segment(p, *s, scale=1.0) for s in _segments(g)] or points(g)
    return write("POINT", [min(near, key=lambda q: (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2)])


def st_line(wkts) -> str:
    """A line through the points of all geometries of an array."""
    return write("LINESTRING", [p for a in wkts for p in points(parse(a))])


def st_from_wkb(data: bytes) -> str:
    """WKT of well-known binary, or of what ST_ASBINARY gives: the bytes of the text."""
    if data[0] > 1:
        return st_parse(data.decode())
    at = 0

    def take(form: str, order: str):
        nonlocal at
        out = struct.unpack_from(order + form, data, at)
        at += struct.calcsize("=" + form)
        return out

    def get() -> tuple[str, list]:
        order = "<" if take("B", "<")[0] else ">"
        kind = _TYPES[take("I", order)[0] - 1]
        row = lambda: [take("dd", order) for _ in range(take("I", order)[0])]
        if kind == "POINT":
            p = take("dd", order)
            return kind, [] if math.isnan(p[0]) else [p]
        if kind == "LINESTRING":
            return kind, row()
        n = take("I", order)[0]
        if kind == "POLYGON":
            return kind, [row() for _ in range(n)]
        parts = [get() for _ in range(n)]
        return kind, parts if kind == "GEOMETRYCOLLECTION" else [p[1][0] if kind == "MULTIPOINT" else p[1] for p in parts]

    kind, coords = get()
    if kind == "GEOMETRYCOLLECTION":
        return f"{kind}({', '.join(write(*c) for c in coords)})" if coords else f"{kind} EMPTY"
    return write(kind, coords)


#: (name, result type, function) of what is callable from SQL.
FUNCTIONS = [
    ("st_parse", "string", st_parse), ("st_distance", "double", st_distance), ("st_measure2", "double", st_measure2), ("st_number", "double", st_number),
    ("st_text", "string", st_text), ("st_pointn", "string", st_pointn), ("st_make2", "string", st_make2), ("st_geohash", "string", st_geohash), ("st_from_geohash", "string", st_from_geohash),
    ("st_shape", "string", st_shape), ("st_combine", "string", st_combine), ("st_line", "string", st_line), ("st_from_wkb", "string", st_from_wkb),
]
