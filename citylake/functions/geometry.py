"""Geometry as a plain struct, with its functions as native Spark SQL expressions.

geom = struct<kind, srid, parts, bbox>
  kind   POINT | LINE | POLYGON (always the multi form)
  parts  array of parts, each an array of rings, each an array of [x, y]
         polygon: ring 0 is the shell, the others are holes; line and point: one ring a part
  bbox   struct<xmin, ymin, xmax, ymax>, computed once so that scans can prune on it

An *edge* is struct<x1, y1, x2, y2>. Most predicates work on edge arrays, which is also the
form in which the spatial join ships geometry.

Arguments are column names or SQL text; every function returns a Column, and ``name.sql(...)``
returns the text, to be nested in other expressions. Text is parsed once in the JVM, which keeps
plans with many nested lambdas cheap to build.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT, LINE, POLYGON = "POINT", "LINE", "POLYGON"
RD, WGS84 = 28992, 4326

PARTS_TYPE = "array<array<array<array<double>>>>"
GEOM_TYPE = (
    f"struct<kind:string,srid:int,parts:{PARTS_TYPE},"
    "bbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>"
)


class expression:
    """A function that writes SQL text, callable as a Column."""

    def __init__(self, fn: Callable[..., str]):
        self.sql = fn
        self.__doc__ = fn.__doc__
        self.__name__ = fn.__name__

    def __call__(self, *args, **kwargs) -> Column:
        return F.expr(self.sql(*args, **kwargs))


def let(name: str, value: str, body: str) -> str:
    """Text of ``body`` with ``name`` bound to a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def num(v) -> str:
    """Text of a double: a number becomes a literal, text stays."""
    return v if isinstance(v, str) else f"{float(v)!r}D"


# --- construction ---------------------------------------------------------------------

def vertices(parts: str) -> str:
    """All vertices of a parts array, in order."""
    return f"flatten(flatten({parts}))"


def _bbox(parts: str) -> str:
    xs, ys = "transform(bv, bp -> bp[0])", "transform(bv, bp -> bp[1])"
    box = f"named_struct('xmin', array_min({xs}), 'ymin', array_min({ys}), 'xmax', array_max({xs}), 'ymax', array_max({ys}))"
    return let("bv", vertices(parts), box)


@expression
def make_geom(kind: str, srid: str | int, parts: str) -> str:
    """Geometry of a kind (SQL text) with its box; NULL when there is no vertex."""
    some = "exists(gp, gq -> exists(gq, gr -> size(gr) > 0))"
    built = f"named_struct('kind', {kind}, 'srid', CAST({srid} AS INT), 'parts', gp, 'bbox', {_bbox('gp')})"
    return let("gp", f"CAST({parts} AS {PARTS_TYPE})", f"CASE WHEN {some} THEN {built} END")


def _built(kind: str, srid: str | int, vertices: list, parts: str) -> str:
    """Geometry whose vertices are known one by one: no lambda, so that the box is plain arithmetic and a query
    that reads only the box builds nothing else."""
    xs, ys = ([f"CAST({num(v[k])} AS DOUBLE)" for v in vertices] for k in (0, 1))
    pick = lambda f, v: f"{f}({', '.join(v)})" if len(v) > 1 else v[0]
    box = f"named_struct('xmin', {pick('least', xs)}, 'ymin', {pick('least', ys)}, 'xmax', {pick('greatest', xs)}, 'ymax', {pick('greatest', ys)})"
    return f"named_struct('kind', '{kind}', 'srid', CAST({srid} AS INT), 'parts', {parts}, 'bbox', {box})"


def _xy(x, y) -> str:
    return f"array(CAST({num(x)} AS DOUBLE), CAST({num(y)} AS DOUBLE))"


def _ring(xys: list) -> str:
    return f"array({', '.join(_xy(x, y) for x, y in xys)})"


@expression
def point(x, y, srid: int = RD) -> str:
    return _built(POINT, srid, [(x, y)], f"array(array(array({_xy(x, y)})))")


@expression
def multipoint(xys: list, srid: int = RD) -> str:
    return make_geom.sql(f"'{POINT}'", srid, f"array({', '.join(f'array(array({_xy(x, y)}))' for x, y in xys)})")


@expression
def line(xys: list, srid: int = RD) -> str:
    return _built(LINE, srid, xys, f"array(array({_ring(xys)}))")


@expression
def polygon(shell: list, holes: list | None = None, srid: int = RD) -> str:
    every = [shell, *(holes or [])]
    return _built(POLYGON, srid, [v for r in every for v in r], f"array(array({', '.join(_ring(r) for r in every)}))")


@expression
def box(xmin, ymin, xmax, ymax, srid: int = RD) -> str:
    return polygon.sql([(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)], srid=srid)


@expression
def with_srid(geom: str, default: int) -> str:
    """Fill a missing reference system."""
    fields = ", ".join(f"'{f}', {geom}.{f}" if f != "srid" else f"'srid', coalesce({geom}.srid, {default})" for f in ("kind", "srid", "parts", "bbox"))
    return f"CASE WHEN {geom} IS NOT NULL THEN named_struct({fields}) END"


@expression
def from_geojson(type_: str, coordinates: str, srid: int) -> str:
    """Geometry of a GeoJSON ``type`` and the raw text of its ``coordinates``.

    Single geometries become their multi form; unknown types give NULL. Only x and y are kept.
    """
    read = lambda depth: f"from_json({coordinates}, '{'array<' * depth}double{'>' * depth}')"
    parts = f"""CASE {type_}
        WHEN 'Point' THEN array(array(array({read(1)})))
        WHEN 'MultiPoint' THEN transform({read(2)}, jp -> array(array(jp)))
        WHEN 'LineString' THEN array(array({read(2)}))
        WHEN 'MultiLineString' THEN transform({read(3)}, jr -> array(jr))
        WHEN 'Polygon' THEN array({read(3)})
        WHEN 'MultiPolygon' THEN {read(4)} END"""
    flat = f"transform({parts}, fp -> transform(fp, fr -> transform(fr, fv -> slice(fv, 1, 2))))"
    kind = f"""CASE WHEN {type_} IN ('Point', 'MultiPoint') THEN '{POINT}'
        WHEN {type_} IN ('LineString', 'MultiLineString') THEN '{LINE}'
        WHEN {type_} IN ('Polygon', 'MultiPolygon') THEN '{POLYGON}' END"""
    return f"CASE WHEN {kind} IS NOT NULL THEN {make_geom.sql(kind, srid, flat)} END"


@expression
def to_multi(geom: str, kind: str) -> str:
    """The geometry if it is of the wanted kind, else NULL. Parts are multi already."""
    return f"CASE WHEN {geom}.kind = '{kind}' THEN {geom} END"


@expression
def geojson_text(geom: str) -> str:
    """The geometry as GeoJSON text in its multi form."""
    part = lambda type_, coords: f"concat('{{\"type\":\"{type_}\",\"coordinates\":', to_json({coords}), '}}')"
    return f"""CASE {geom}.kind
        WHEN '{POINT}' THEN {part('MultiPoint', f'transform({geom}.parts, tp -> tp[0][0])')}
        WHEN '{LINE}' THEN {part('MultiLineString', f'transform({geom}.parts, tp -> tp[0])')}
        WHEN '{POLYGON}' THEN {part('MultiPolygon', f'{geom}.parts')} END"""


# --- edges ----------------------------------------------------------------------------

@expression
def ring_edges(r: str) -> str:
    n = f"greatest(size({r}) - 1, 0)"
    edge = "named_struct('x1', ra[0], 'y1', ra[1], 'x2', rb[0], 'y2', rb[1])"
    return f"zip_with(slice({r}, 1, {n}), slice({r}, 2, {n}), (ra, rb) -> {edge})"


@expression
def edges(geom: str) -> str:
    return f"flatten(transform(flatten({geom}.parts), er -> {ring_edges.sql('er')}))"


@expression
def anchors(geom: str) -> str:
    """First vertex of every part."""
    return f"transform({geom}.parts, ap -> ap[0][0])"


def _side(e: str, x: str, y: str) -> str:
    """> 0 left of the edge, < 0 right of it, 0 on its line."""
    return f"(({e}.x2 - {e}.x1) * (({y}) - {e}.y1) - ({e}.y2 - {e}.y1) * (({x}) - {e}.x1))"


def _in_edge_box(e: str, x: str, y: str) -> str:
    return (
        f"(({x}) BETWEEN least({e}.x1, {e}.x2) AND greatest({e}.x1, {e}.x2) "
        f"AND ({y}) BETWEEN least({e}.y1, {e}.y2) AND greatest({e}.y1, {e}.y2))"
    )


@expression
def crossings(x: str, y: str, edge_array: str) -> str:
    """Number of edges that a ray from the point towards +x crosses, half-open in y."""
    spans = f"(ie.y1 > ({y})) <> (ie.y2 > ({y}))"
    right = f"CASE WHEN ie.y2 > ie.y1 THEN {_side('ie', x, y)} > 0 ELSE {_side('ie', x, y)} < 0 END"
    return f"size(filter({edge_array}, ie -> {spans} AND {right}))"


@expression
def parity_inside(x: str, y: str, edge_array: str) -> str:
    """Even-odd rule. Holes and parts need no special care."""
    return f"{crossings.sql(x, y, edge_array)} % 2 = 1"


@expression
def on_edge(x: str, y: str, edge_array: str) -> str:
    return f"exists({edge_array}, oe -> {_in_edge_box('oe', x, y)} AND {_side('oe', x, y)} = 0)"


@expression
def segments_touch(a: str, b: str) -> str:
    """True when two closed segments share a point."""
    s1, s2 = _side(a, f"{b}.x1", f"{b}.y1"), _side(a, f"{b}.x2", f"{b}.y2")
    s3, s4 = _side(b, f"{a}.x1", f"{a}.y1"), _side(b, f"{a}.x2", f"{a}.y2")
    return f"""((signum({s1}) * signum({s2}) < 0 AND signum({s3}) * signum({s4}) < 0)
        OR ({s1} = 0 AND {_in_edge_box(a, f'{b}.x1', f'{b}.y1')}) OR ({s2} = 0 AND {_in_edge_box(a, f'{b}.x2', f'{b}.y2')})
        OR ({s3} = 0 AND {_in_edge_box(b, f'{a}.x1', f'{a}.y1')}) OR ({s4} = 0 AND {_in_edge_box(b, f'{a}.x2', f'{a}.y2')}))"""


def _edge_boxes_meet(a: str, b: str) -> str:
    one = lambda c: (
        f"least({a}.{c}1, {a}.{c}2) <= greatest({b}.{c}1, {b}.{c}2) AND least({b}.{c}1, {b}.{c}2) <= greatest({a}.{c}1, {a}.{c}2)"
    )
    return f"{one('x')} AND {one('y')}"


def _all_touch(a: str, b: str) -> str:
    return f"exists({a}, ta -> exists({b}, tb -> {_edge_boxes_meet('ta', 'tb')} AND {segments_touch.sql('ta', 'tb')}))"


@expression
def sweep(a: str, b: str) -> str:
    """struct<hit, tests>: do two arrays of edges share a point, and how many pairs of edges were compared.

    A line sweeps up over the edges of both, by their lower y, with the edges of either array that it still
    meets in a list. An edge is compared with those in the other list, that is, only with edges whose range of
    y overlaps its own; the sweep rests at the first hit.
    """
    mark = lambda of, edges: f"transform({edges}, we -> named_struct('lo', least(we.y1, we.y2), 'hi', greatest(we.y1, we.y2), 'of', {of}, 'e', we))"
    in_turn = f"array_sort(concat({mark(0, a)}, {mark(1, b)}), (wl, wr) -> CASE WHEN wl.lo < wr.lo THEN -1 WHEN wl.lo > wr.lo THEN 1 ELSE 0 END)"
    none = "CAST(array() AS ARRAY<STRUCT<hi: DOUBLE, of: INT, e: STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>>>)"
    start = f"named_struct('live', {none}, 'hit', false, 'tests', 0)"
    other = "filter(wk, wo -> wo.of <> wn.of)"
    hit = f"exists(wx, wo -> {_edge_boxes_meet('wo.e', 'wn.e')} AND {segments_touch.sql('wo.e', 'wn.e')})"
    after = f"""named_struct('live', concat(wk, array(named_struct('hi', wn.hi, 'of', wn.of, 'e', wn.e))),
        'hit', {hit}, 'tests', ws.tests + size(wx))"""
    step = let("wk", "filter(ws.live, wo -> wo.hi >= wn.lo)", let("wx", other, after))
    end = "wf -> named_struct('hit', wf.hit, 'tests', wf.tests)"
    return f"aggregate({in_turn}, {start}, (ws, wn) -> CASE WHEN ws.hit THEN ws ELSE {step} END, {end})"


@expression
def edges_touch(a: str, b: str) -> str:
    """Do two arrays of edges share a point. Few edges are compared one by one, more by a sweep."""
    return f"CASE WHEN size({a}) * size({b}) <= 256 THEN {_all_touch(a, b)} ELSE {sweep.sql(a, b)}.hit END"


@expression
def distance2_to_edge(x: str, y: str, e: str) -> str:
    """Squared distance from a point to a closed segment."""
    dx, dy = f"({e}.x2 - {e}.x1)", f"({e}.y2 - {e}.y1)"
    t = f"greatest(0D, least(1D, coalesce(try_divide((({x}) - {e}.x1) * {dx} + (({y}) - {e}.y1) * {dy}, {dx} * {dx} + {dy} * {dy}), 0D)))"
    off = f"named_struct('u', ({x}) - ({e}.x1 + dt * {dx}), 'v', ({y}) - ({e}.y1 + dt * {dy}))"
    return let("dt", t, let("dd", off, "dd.u * dd.u + dd.v * dd.v"))


@expression
def nearby(a: str, b: str, d: float) -> str:
    """``segments_within`` without a lambda, for rows that each hold one pair: compiled as plain arithmetic."""
    def distance2(x, y, e):
        dx, dy = f"({e}.x2 - {e}.x1)", f"({e}.y2 - {e}.y1)"
        t = f"greatest(0D, least(1D, coalesce(try_divide(({x} - {e}.x1) * {dx} + ({y} - {e}.y1) * {dy}, {dx} * {dx} + {dy} * {dy}), 0D)))"
        u, v = f"({x} - ({e}.x1 + {t} * {dx}))", f"({y} - ({e}.y1 + {t} * {dy}))"
        return f"{u} * {u} + {v} * {v}"

    ends = [(b, a, 1), (b, a, 2), (a, b, 1), (a, b, 2)]
    near = " OR ".join(f"{distance2(f'{p}.x{i}', f'{p}.y{i}', q)} <= {num(float(d) ** 2)}" for q, p, i in ends)
    return f"({near} OR {segments_touch.sql(a, b)})"


@expression
def segments_within(a: str, b: str, d: float) -> str:
    d2 = num(float(d) ** 2)
    ends = [(b, a, 1), (b, a, 2), (a, b, 1), (a, b, 2)]
    near = " OR ".join(f"{distance2_to_edge.sql(f'{p}.x{i}', f'{p}.y{i}', q)} <= {d2}" for q, p, i in ends)
    return f"({segments_touch.sql(a, b)} OR {near})"


# --- predicates on whole geometries ---------------------------------------------------

@expression
def contains_point(geom: str, x: str, y: str) -> str:
    """Strict: a point on the boundary is not contained."""
    inside = f"NOT {on_edge.sql(x, y, 'ce')} AND {parity_inside.sql(x, y, 'ce')}"
    return f"({geom}.kind = '{POLYGON}' AND {let('ce', edges.sql(geom), inside)})"


@expression
def bbox_overlap(a: str, b: str) -> str:
    return f"({a}.xmin <= {b}.xmax AND {b}.xmin <= {a}.xmax AND {a}.ymin <= {b}.ymax AND {b}.ymin <= {a}.ymax)"


@expression
def intersects(a: str, b: str) -> str:
    """Share at least one point, boundaries included. For pairs; use the spatial join for tables."""
    def hit(g, of, e):
        inside = f"({on_edge.sql('hp[0]', 'hp[1]', e)} OR ({of}.kind = '{POLYGON}' AND {parity_inside.sql('hp[0]', 'hp[1]', e)}))"
        return f"exists({anchors.sql(g)}, hp -> {inside})"

    same = f"arrays_overlap({anchors.sql(a)}, {anchors.sql(b)})"
    any_ = f"({same} OR {edges_touch.sql('xa', 'xb')} OR {hit(a, b, 'xb')} OR {hit(b, a, 'xa')})"
    return f"({bbox_overlap.sql(f'{a}.bbox', f'{b}.bbox')} AND {let('xa', edges.sql(a), let('xb', edges.sql(b), any_))})"


# --- measures -------------------------------------------------------------------------

def _total(values: str) -> str:
    return f"aggregate({values}, 0D, (sa, sv) -> sa + sv)"


def _moment_fields(a: str, x: str, y: str) -> str:
    return f"named_struct('a', {a}, 'mx', {x}, 'my', {y})"


def _ring_moments(r: str, weight: str) -> str:
    """struct<a, mx, my> of one ring: area and first moments, orientation removed, times the weight."""
    ox, oy = f"{r}[0][0]", f"{r}[0][1]"
    cross = f"((me.x1 - {ox}) * (me.y2 - {oy}) - (me.y1 - {oy}) * (me.x2 - {ox}))"
    step = _moment_fields(
        "ma.a + mc / 2", f"ma.mx + mc * (me.x1 + me.x2 - 2 * {ox}) / 6", f"ma.my + mc * (me.y1 + me.y2 - 2 * {oy}) / 6"
    )
    start = _moment_fields("0D", "0D", "0D")
    done = _moment_fields(
        f"sign(mf.a) * {weight} * mf.a", f"sign(mf.a) * {weight} * (mf.mx + mf.a * {ox})", f"sign(mf.a) * {weight} * (mf.my + mf.a * {oy})"
    )
    return f"aggregate({ring_edges.sql(r)}, {start}, (ma, me) -> {let('mc', cross, step)}, mf -> {done})"


@expression
def ring_moments(geom: str) -> str:
    """Moments of every ring, holes negative."""
    shell = f"transform(slice(mp, 1, 1), mr -> {_ring_moments('mr', '1')})"
    holes = f"transform(slice(mp, 2, greatest(size(mp) - 1, 0)), mr -> {_ring_moments('mr', '-1')})"
    return f"flatten(transform({geom}.parts, mp -> concat({shell}, {holes})))"


@expression
def area(geom: str) -> str:
    """Planar area in square units of the reference system; 0 for points and lines."""
    total = _total(f"transform({ring_moments.sql(geom)}, am -> am.a)")
    return f"CASE WHEN {geom}.kind = '{POLYGON}' THEN {total} WHEN {geom} IS NOT NULL THEN 0D END"


@expression
def edge_length(e: str) -> str:
    return f"hypot({e}.x2 - {e}.x1, {e}.y2 - {e}.y1)"


def _edge_sum(geom: str) -> str:
    one = edge_length.sql("le")
    return _total(f"transform({edges.sql(geom)}, le -> {one})")


@expression
def length(geom: str) -> str:
    return f"CASE WHEN {geom} IS NOT NULL THEN {_edge_sum(geom)} END"


def _weighted(values: str, v: str, w: str, x: str, y: str) -> str:
    """struct<x, y> of weighted sums over the weight sum; NULL fields when the weight is zero."""
    fields = lambda a, b, c: f"named_struct('w', {a}, 'x', {b}, 'y', {c})"
    total = f"aggregate({values}, {fields('0D', '0D', '0D')}, (wa, {v}) -> {fields(f'wa.w + {w}', f'wa.x + {x}', f'wa.y + {y}')})"
    return let("wt", total, "named_struct('x', try_divide(wt.x, wt.w), 'y', try_divide(wt.y, wt.w))")


@expression
def centroid(geom: str) -> str:
    """struct<x, y>: area-weighted for polygons, length-weighted for lines, mean for points."""
    poly = _weighted(ring_moments.sql(geom), "cm", "cm.a", "cm.mx", "cm.my")
    ln = edge_length.sql("cl")
    along = _weighted(edges.sql(geom), "cl", ln, f"{ln} * (cl.x1 + cl.x2) / 2", f"{ln} * (cl.y1 + cl.y2) / 2")
    middle = _weighted(vertices(f"{geom}.parts"), "cv", "1", "cv[0]", "cv[1]")
    best = f"CASE {geom}.kind WHEN '{POLYGON}' THEN {poly} WHEN '{LINE}' THEN {along} ELSE {middle} END"
    # a polygon without area or a line without length has no weighted centre
    return f"CASE WHEN {geom} IS NOT NULL THEN {let('cb', best, f'CASE WHEN cb.x IS NOT NULL THEN cb ELSE {middle} END')} END"


# --- reprojection between the Dutch grid and WGS84 ------------------------------------

# The published polynomial approximation, as (power of first, power of second, coefficient).
_LAT = ((0, 1, 3235.65389), (2, 0, -32.58297), (0, 2, -0.24750), (2, 1, -0.84978), (0, 3, -0.06550),
        (2, 2, -0.01709), (1, 0, -0.00738), (4, 0, 0.00530), (2, 3, -0.00039), (4, 1, 0.00033), (1, 1, -0.00012))
_LON = ((1, 0, 5260.52916), (1, 1, 105.94684), (1, 2, 2.45656), (3, 0, -0.81885), (1, 3, 0.05594), (3, 1, -0.05607),
        (0, 1, 0.01199), (3, 2, -0.00256), (1, 4, 0.00128), (0, 2, 0.00022), (2, 0, -0.00022), (5, 0, 0.00026))
_X = ((0, 1, 190094.945), (1, 1, -11832.228), (2, 1, -114.221), (0, 3, -32.391), (1, 0, -0.705), (3, 1, -2.340),
      (1, 3, -0.608), (0, 2, -0.008), (2, 3, 0.148))
_Y = ((1, 0, 309056.544), (0, 2, 3638.893), (2, 0, 73.077), (1, 2, -157.984), (3, 0, 59.788), (0, 1, 0.433),
      (2, 2, -6.439), (1, 1, -0.032), (0, 4, 0.092), (1, 4, -0.054))
_X0, _Y0, _LAT0, _LON0 = 155000.0, 463000.0, 52.15517440, 5.38720621


def _poly_text(terms, a: str, b: str) -> str:
    """Sum of c * a^p * b^q as SQL text."""
    return " + ".join(f"({' * '.join([a] * p + [b] * q + [num(c)])})" for p, q, c in terms)


def _poly_value(terms, a: float, b: float) -> float:
    return sum(c * a**p * b**q for p, q, c in terms)


def _supported(from_srid: int, to_srid: int) -> None:
    if from_srid != to_srid and {from_srid, to_srid} != {RD, WGS84}:
        raise ValueError(f"no transformation from {from_srid} to {to_srid}")


def project_point(a: float, b: float, from_srid: int, to_srid: int) -> tuple[float, float]:
    """Move one point given as plain numbers, such as a corner of a filter box."""
    _supported(from_srid, to_srid)
    if from_srid == to_srid:
        return a, b
    if from_srid == RD:
        u, v = (a - _X0) * 1e-5, (b - _Y0) * 1e-5
        return _poly_value(_LON, u, v) / 3600 + _LON0, _poly_value(_LAT, u, v) / 3600 + _LAT0
    u, v = (b - _LAT0) * 0.36, (a - _LON0) * 0.36
    return _poly_value(_X, u, v) + _X0, _poly_value(_Y, u, v) + _Y0


@expression
def project_xy(a: str, b: str, from_srid: int, to_srid: int) -> str:
    """array(x, y) of a point moved between two supported reference systems."""
    _supported(from_srid, to_srid)
    if from_srid == to_srid:
        return f"array({a}, {b})"
    if from_srid == RD:
        start = f"named_struct('u', (({a}) - {num(_X0)}) * 1e-5D, 'v', (({b}) - {num(_Y0)}) * 1e-5D)"
        first = f"({_poly_text(_LON, 'pj.u', 'pj.v')}) / 3600 + {num(_LON0)}"
        second = f"({_poly_text(_LAT, 'pj.u', 'pj.v')}) / 3600 + {num(_LAT0)}"
    else:
        start = f"named_struct('u', (({b}) - {num(_LAT0)}) * 0.36D, 'v', (({a}) - {num(_LON0)}) * 0.36D)"
        first = f"({_poly_text(_X, 'pj.u', 'pj.v')}) + {num(_X0)}"
        second = f"({_poly_text(_Y, 'pj.u', 'pj.v')}) + {num(_Y0)}"
    return let("pj", start, f"array({first}, {second})")


@expression
def transform_geom(geom: str, to_srid: int) -> str:
    """Reproject; geometry already in the target system is untouched, other systems are an error."""
    if to_srid not in (RD, WGS84):
        raise ValueError(f"no transformation to {to_srid}")
    from_srid = WGS84 if to_srid == RD else RD
    vertex = project_xy.sql("pv[0]", "pv[1]", from_srid, to_srid)
    moved = f"transform({geom}.parts, pp -> transform(pp, pr -> transform(pr, pv -> {vertex})))"
    return f"""CASE WHEN {geom}.srid = {to_srid} THEN {geom}
        WHEN {geom}.srid = {from_srid} THEN {make_geom.sql(f'{geom}.kind', to_srid, moved)}
        WHEN {geom} IS NOT NULL THEN CAST(raise_error(concat('no transformation from srid ', coalesce(CAST({geom}.srid AS STRING), 'NULL'))) AS {GEOM_TYPE}) END"""
