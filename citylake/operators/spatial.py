"""Spatial joins as equi-joins on grid cells.

Every feature is cut into *tiles*, one for each grid cell its bounding box meets. A tile
carries only what a test inside that cell needs:

  near     edges whose box meets the cell
  far, odd what the even-odd rule needs from the edges right of the cell: the y-intervals of
           those that end inside the cell's band, and the parity of those that span it
  full     the cell lies wholly inside the polygon (no edge near it), so no edge is shipped
  anchors  first vertex of every part, in the tile of the cell that holds it

Two features share a point iff their boundaries touch (seen in the cell of the touching
point) or an anchor of one lies inside the other (seen in the anchor's cell), so the tests
are exact whatever the cells are. A polygon with 10 000 edges ships a few hundred of them
per cell, and the join is an ordinary equi-join: Catalyst broadcasts the tile side when its
size is below the session's threshold, and otherwise shuffles it on the cell.

Cells follow density. ``cells_for`` counts the features of both sides and splits a cell that
holds too many into 4 x 4, and those again, down to some metres: a tree whose leaves both
sides share. Splits are a bounded list of cell numbers inside the query text, so finding the
leaves of a feature is a hash lookup a level and no join. A smallest cell that is still full
(features on one spot) is salted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citylake.functions import geometry as G

CELL = 5000.0
SALTS = 4
FAN = 4  # a cell is split into FAN x FAN
STEPS = 4  # times that a cell can be split, down to about 20 m
CAPACITY = 4096  # features of both sides from which a cell is split
MOST_SPLITS = 1024  # cells split in one step: those that hold most


@dataclass(frozen=True)
class Cells:
    """A grid whose cells are split where many features are: by step, the numbers of the cells to split; ``hot``
    are cells of the last step that hold too many still. Every side of a join must be cut by the same cells."""

    cell: float = CELL
    splits: tuple[tuple[int, ...], ...] = ()
    hot: tuple[int, ...] = ()
    salts: int = 1  # of all cells
    hot_salts: int = 16

    def size(self, step: int) -> float:
        return self.cell / FAN**step

    def of_point(self, x: str, y: str) -> str:
        """Text of the leaf that holds a point: struct<step, x, y, size>."""
        cases = ""
        for step, split in enumerate(self.splits):
            if split:
                cases += f" WHEN NOT ({_number(index(x, self.size(step)), index(y, self.size(step)))} IN ({_listed(split)})) THEN {self._at(step, x, y)}"
        last = self._at(len(self.splits), x, y)
        return f"CASE{cases} ELSE {last} END" if cases else last

    def _at(self, step: int, x: str, y: str) -> str:
        return _cell(step, index(x, self.size(step)), index(y, self.size(step)), self.size(step))

    def children(self, step: int, c: str, box: str) -> str:
        """Text of the cells that a cell ``c`` stands for after a step: those inside it that the box meets if it
        is split, else itself."""
        size = self.size(step + 1)
        span = lambda a, v: (
            f"sequence(greatest({c}.{a} * {FAN}, {index(f'{box}.{v}min', size)}), least({c}.{a} * {FAN} + {FAN - 1}, {index(f'{box}.{v}max', size)}))"
        )
        inner = f"flatten(transform({span('x', 'x')}, sx -> transform({span('y', 'y')}, sy -> {_cell(step + 1, 'sx', 'sy', size)})))"
        return f"CASE WHEN {c}.step = {step} AND {_number(f'{c}.x', f'{c}.y')} IN ({_listed(self.splits[step])}) THEN {inner} ELSE array({c}) END"

    def salts_of(self, c: str) -> str:
        """Text of how many salts a cell has."""
        if not self.hot:
            return str(self.salts)
        return f"CASE WHEN {c}.step = {STEPS} AND {_number(f'{c}.x', f'{c}.y')} IN ({_listed(self.hot)}) THEN {max(self.salts, self.hot_salts)} ELSE {self.salts} END"

    @property
    def salted(self) -> bool:
        return self.salts > 1 or bool(self.hot)


def _number(x: str, y: str) -> str:
    return f"(({x}) * 4294967296 + ({y}))"


def _listed(numbers: Sequence[int]) -> str:
    return ", ".join(f"{n}L" for n in numbers)


def _cell(step: int, x: str, y: str, size: float) -> str:
    return f"named_struct('step', {step}, 'x', {x}, 'y', {y}, 'size', {G.num(size)})"


def cells_for(*sides: tuple[DataFrame, str], cell: float = CELL, capacity: int = CAPACITY, most: int = MOST_SPLITS, steps: int = STEPS) -> Cells:
    """Cells for a join of tables given as (table, its geometry column), or (table, "x y") for points.

    Counts features by the cell of their box's middle, once over all, then once for each step inside the cells
    that were split before. What comes to the driver are cells with more than ``capacity``, at most ``most`` a
    step.
    """
    spark = sides[0][0].sparkSession
    names = {f"side{k}": df for k, (df, _) in enumerate(sides)}
    middle = []
    for name, (_, geom) in zip(names, sides):
        x, y = geom.split() if " " in geom else (f"({geom}.bbox.xmin + {geom}.bbox.xmax) / 2", f"({geom}.bbox.ymin + {geom}.bbox.ymax) / 2")
        middle.append(f"SELECT {x} AS x, {y} AS y FROM {{{name}}}")
    splits: list[tuple[int, ...]] = []
    for step in range(steps + 1):
        size = cell / FAN**step
        inside = f"AND {_number(index('x', size * FAN), index('y', size * FAN))} IN ({_listed(splits[-1])})" if step else ""
        text = f"""SELECT n, count(*) AS k FROM (SELECT {_number(index('x', size), index('y', size))} AS n FROM ({' UNION ALL '.join(middle)})
            WHERE x IS NOT NULL AND y IS NOT NULL {inside}) GROUP BY n HAVING k > {int(capacity)} ORDER BY k DESC, n LIMIT {int(most)}"""
        full = tuple(sorted(r["n"] for r in spark.sql(text, **names).collect()))
        if not full:
            return Cells(cell, tuple(splits))
        splits.append(full)
    return Cells(cell, tuple(splits[:-1]), splits[-1])


def index(v: str, cell: float) -> str:
    return f"CAST(floor(({v}) / {G.num(cell)}) AS BIGINT)"


def low(i: str, cell: float) -> str:
    return f"(({i}) * {G.num(cell)})"


def cells_between(a: str, b: str, cell: float) -> str:
    return f"explode(sequence({index(a, cell)}, {index(b, cell)}))"


def tiles_sql(source: str, id_col: str, geom: str, cells: Cells, keep: Sequence[str] = (), repeat: bool = False) -> str:
    """Query text for the tiles of a table: id, c (the cell), area, box, full, anchors, near, far, odd, kept (a
    struct), and with ``repeat`` salt: every tile once for each salt of its cell.

    Rows of cells come first: the band of edges is cut once per row, not once per cell. A feature whose box lies
    inside one leaf is its own tile: all its edges are near, none is beyond, and nothing needs to be cut.
    """
    kept = ", kept" if keep else ""
    pack = f", struct({', '.join(keep)}) AS kept" if keep else ""
    size = cells.size(0)
    x0, x1, y0, y1 = "(c.x * c.size)", "((c.x + 1) * c.size)", "(c.y * c.size)", "((c.y + 1) * c.size)"
    in_row = f"greatest(e.y1, e.y2) >= {y0} AND least(e.y1, e.y2) <= {y1}"
    spans = f"least(e.y1, e.y2) <= {y0} AND greatest(e.y1, e.y2) >= {y1}"
    near = f"filter(band, e -> greatest(e.x1, e.x2) >= {x0} AND least(e.x1, e.x2) <= {x1} AND {in_row})"
    beyond = f"CASE WHEN area THEN filter(band, e -> least(e.x1, e.x2) > {x1} AND {in_row}) END"
    odd = f"size(filter(bd, e -> {spans})) % 2"
    far = f"transform(filter(bd, e -> NOT ({spans})), e -> named_struct('a', e.y1, 'b', e.y2))"
    anchors = f"filter(first, p -> {index('p[0]', 'c.size')} = c.x AND {index('p[1]', 'c.size')} = c.y)"
    middle = f"{y0} + c.size / 2"
    full = f"area AND size(nr) = 0 AND (size({_straddling('fa', middle)}) + od) % 2 = 1"
    fields = f"""named_struct('near', nr, 'anchors', {anchors}, 'odd', od, 'full', fu, 'far', CASE WHEN fu THEN slice(fa, 1, 0) ELSE fa END)"""
    # everything of one cell is built at once, so later filters cannot make it run twice
    one = G.let("nr", near, G.let("bd", beyond, G.let("od", odd, G.let("fa", far, G.let("fu", full, fields)))))
    box = f"{geom}.bbox"
    corners = [cells.of_point(f"{box}.x{m}", f"{box}.y{m}") for m in ("min", "max")]
    rows = f"""
        SELECT {id_col} AS id{pack}, {geom}.kind = '{G.POLYGON}' AS area, {box} AS box, {G.anchors.sql(geom)} AS first,
               {G.edges.sql(geom)} AS edges, {corners[0]} AS leaf, {corners[1]} AS last, {cells_between(f'{box}.ymin', f'{box}.ymax', size)} AS cy
        FROM {source} WHERE {geom} IS NOT NULL"""
    lowest, highest = low("cy", size), low("cy + 1", size)
    band = f"filter(edges, e -> greatest(e.y1, e.y2) >= {lowest} AND least(e.y1, e.y2) <= {highest})"
    known = "filter(edges, e -> e.x1 + e.y1 + e.x2 + e.y2 IS NOT NULL)"
    single = "leaf.x = last.x AND leaf.y = last.y AND leaf.step = last.step"
    columns = f"id{kept}, area, first, box, band, leaf, single"
    own = lambda mine, cut: f"CASE WHEN single THEN {mine} ELSE {cut} END"
    rows = f"SELECT *, coalesce({single}, false) AS single FROM ({rows})"
    rows = f"SELECT id{kept}, area, first, cy, box, leaf, single, {own(known, band)} AS band FROM ({rows})"
    found = f"transform(sequence({index('box.xmin', size)}, {index('box.xmax', size)}), cx -> {_cell(0, 'cx', 'cy', size)})"
    found = f"SELECT {columns}, {own('array(leaf)', found)} AS cs FROM ({rows})"
    for step, split in enumerate(cells.splits):
        inner = f"flatten(transform(cs, c -> {cells.children(step, 'c', 'box')}))"
        found = f"SELECT {columns}, {own('cs', inner)} AS cs FROM ({found})"
    points = "filter(first, p -> p[0] IS NOT NULL AND p[1] IS NOT NULL)"
    none = "CAST(array() AS ARRAY<STRUCT<a: DOUBLE, b: DOUBLE>>)"
    whole = f"named_struct('near', band, 'anchors', {points}, 'odd', 0, 'full', false, 'far', {none})"
    cut = f"transform(cs, c -> named_struct('c', c, 't', {one}))"
    listed = own(f"array(named_struct('c', leaf, 't', {whole}))", cut)
    tiles = f"SELECT id{kept}, area, box, explode({listed}) AS u FROM ({found})"
    salt = f", explode(sequence(0, {cells.salts_of('u.c')} - 1)) AS salt" if repeat and cells.salted else ""
    return f"""
        SELECT id{kept}, area, box, u.c, u.t.near, u.t.anchors, u.t.odd, u.t.full, u.t.far{salt}
        FROM ({tiles}) WHERE size(u.t.near) > 0 OR u.t.full OR size(u.t.anchors) > 0"""


def _straddling(far: str, y: str) -> str:
    return f"filter({far}, h -> (h.a > ({y})) <> (h.b > ({y})))"


def _inside(t: str, x: str, y: str, strict: bool = False) -> str:
    """Test of a point that lies in the cell of tile ``t``."""
    crossed = f"{G.crossings.sql(x, y, f'{t}.near')} + size({_straddling(f'{t}.far', y)}) + {t}.odd"
    inside = f"({t}.area AND ({crossed}) % 2 = 1)"
    edge = G.on_edge.sql(x, y, f"{t}.near")
    return f"({t}.full OR {f'({inside} AND NOT {edge})' if strict else f'{inside} OR {edge}'})"


def _salt_of(key: str, cells: Cells, c: str = "c") -> str:
    return f", CAST(pmod(xxhash64({key}), {cells.salts_of(c)}) AS INT) AS salt" if cells.salted else ""


def _same_cell(a: str, b: str, cells: Cells) -> str:
    same = " AND ".join(f"{a}.c.{k} = {b}.c.{k}" for k in (("step", "x", "y") if cells.splits else ("x", "y")))
    return f"{same} AND {a}.salt = {b}.salt" if cells.salted else same


def tiles(df: DataFrame, id_col: str, geom_col: str = "geom", cells: Cells = Cells()) -> DataFrame:
    return df.sparkSession.sql(tiles_sql("{df}", id_col, geom_col, cells), df=df)


def point_join(
    points: DataFrame,
    zones: DataFrame,
    zone_id: str,
    x: str = "x",
    y: str = "y",
    geom: str = "geom",
    strict: bool = False,
    cells: Cells | None = None,
    alias: str = "zone_id",
) -> DataFrame:
    """Every point row with the id of each zone that holds it (boundary included unless strict).

    A point has one cell, so no pair can come out twice and nothing is shuffled afterwards. Without ``cells``
    the points are counted first, see ``cells_for``.
    """
    return _point_query(points, zones, zone_id, x, y, geom, strict, cells, alias)


def _point_query(points, zones, zone_id, x, y, geom, strict, cells, alias) -> DataFrame:
    cells = cells or cells_for((points, f"{x} {y}"))
    # a few plain columns spread rows that share one coordinate
    plain = [f.name for f in points.schema.fields if f.dataType.typeName() in ("long", "integer", "string")][:2]
    columns = ", ".join(f"p.`{c}`" for c in points.columns)
    text = f"""
        SELECT {columns}{f', z.id AS {alias}' if alias else ''}
        FROM (SELECT *{_salt_of(', '.join([x, y, *plain]), cells)}
              FROM (SELECT *, {cells.of_point(x, y)} AS c FROM {{points}} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)) p
        {'JOIN' if alias else 'LEFT SEMI JOIN'} ({tiles_sql('{zones}', zone_id, geom, cells, repeat=True)}) z
          ON {_same_cell('p', 'z', cells)} AND (z.full OR size(z.near) > 0) AND {_inside('z', f'p.{x}', f'p.{y}', strict)}"""
    return points.sparkSession.sql(text, points=points, zones=zones)


def points_within(
    points: DataFrame, zones: DataFrame, zone_id: str, x: str = "x", y: str = "y", geom: str = "geom", cells: Cells | None = None,
) -> DataFrame:
    """Points that lie in at least one zone, each once. A semi join, so overlapping zones need no clean-up."""
    return _point_query(points, zones, zone_id, x, y, geom, False, cells, None)


def spatial_join(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    left_geom: str = "geom",
    right_geom: str = "geom",
    keep: Sequence[str] = (),
    cells: Cells | None = None,
) -> DataFrame:
    """Distinct pairs (left_id, right_id) of features that share at least one point.

    Works for any mix of points, lines and polygons. A feature that crosses two zones is
    paired with both. ``keep`` names left columns (measures) to carry along, which saves a join
    back to the left table. ``right`` is the side whose tiles are repeated for each salt. Without ``cells``
    the features of both sides are counted first, see ``cells_for``.

    Features are dealt over all tasks before they are cut, since a table in few files would be cut by few.
    """
    cells = cells or cells_for((left, left_geom), (right, right_geom))
    out_left, out_right = (left_id, right_id) if left_id != right_id else (f"left_{left_id}", f"right_{right_id}")
    kept = "".join(f", pair.a.kept.{k} AS {k}" for k in keep)
    tests = [
        "(pair.a.full AND (pair.b.full OR size(pair.b.anchors) > 0))",
        "(pair.b.full AND size(pair.a.anchors) > 0)",
        f"exists(pair.a.anchors, p -> {_inside('pair.b', 'p[0]', 'p[1]')})",
        f"exists(pair.b.anchors, p -> {_inside('pair.a', 'p[0]', 'p[1]')})",
        "coalesce(arrays_overlap(pair.a.anchors, pair.b.anchors), false)",
        G.edges_touch.sql("pair.a.near", "pair.b.near"),
    ]
    side = lambda s, more="": f"named_struct({', '.join(repr(c) + f', {s}.{c}' for c in ('id', 'area', 'near', 'anchors', 'odd', 'full', 'far'))}{more})"
    pack = ", 'kept', a.kept" if keep else ""
    # the join compares boxes alone, in compiled code; a row of its own keeps the tests of edges out of its condition
    text = f"""
        SELECT pair.a.id AS {out_left}, pair.b.id AS {out_right}{kept} FROM (
          SELECT explode(array(named_struct('a', {side('a', pack)}, 'b', {side('b')}))) AS pair
          FROM (SELECT *{_salt_of('id', cells)} FROM ({tiles_sql('{left}', left_id, left_geom, cells, keep)})) a
          JOIN ({tiles_sql('{right}', right_id, right_geom, cells, repeat=True)}) b ON {_same_cell('a', 'b', cells)}
            AND a.box.xmin <= b.box.xmax AND b.box.xmin <= a.box.xmax AND a.box.ymin <= b.box.ymax AND b.box.ymin <= a.box.ymax)
        WHERE {' OR '.join(tests)}"""
    used = left.select(left_id, left_geom, *[k for k in dict.fromkeys(keep) if k not in (left_id, left_geom)])
    pairs = left.sparkSession.sql(text, left=used.repartition(left_id), right=right.select(right_id, right_geom).repartition(right_id))
    return pairs.dropDuplicates([out_left, out_right])


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt over all tasks. Few bytes can stand for much work: a table in one small file would be one task's,
    and adaptive execution would put its shuffled rows together again if the number were left open."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def segments_sql(source: str, id_col: str, geom: str) -> str:
    """One row per edge of every line: id, e."""
    return f"SELECT {id_col} AS id, explode({G.edges.sql(geom)}) AS e FROM {source} WHERE {geom} IS NOT NULL"


def _segment_cells_sql(segments: str, cell: float, d: float = 0.0) -> str:
    """Segments repeated for every cell within d of them (and few more), found by walking the grid: for each row
    of cells the stretch of the segment that comes within d of the row gives the columns, so a long diagonal
    costs the cells along it and not its box."""
    slack = d + cell * 1e-9  # for the rounding of where a segment crosses a grid line
    rows = cells_between(f"least(e.y1, e.y2) - {G.num(slack)}", f"greatest(e.y1, e.y2) + {G.num(slack)}", cell)

    def at(y: str, default: str) -> str:
        part = f"coalesce(try_divide({y} - e.y1, e.y2 - e.y1), {default})"
        return f"e.x1 + greatest(0D, least(1D, {part})) * (e.x2 - e.x1)"

    enters, leaves = at(f"{low('cy', cell)} - {G.num(slack)}", "0D"), at(f"{low('cy + 1', cell)} + {G.num(slack)}", "1D")
    reach = f"SELECT *, {enters} AS xa, {leaves} AS xb FROM (SELECT id, e, {rows} AS cy FROM ({segments}))"
    columns = cells_between(f"least(xa, xb) - {G.num(slack)}", f"greatest(xa, xb) + {G.num(slack)}", cell)
    return f"SELECT id, e, cy, {columns} AS cx FROM ({reach})"


def distance_join(
    lines: DataFrame, zones: DataFrame, line_id: str, zone_id: str, d: float,
    line_geom: str = "geom", zone_geom: str = "geom", cell: float = CELL, salts: int = SALTS, within: str | None = None,
) -> DataFrame:
    """Distinct pairs of a line and a polygon at most ``d`` apart (exact, no buffer polygon).

    A segment inside a zone is found in the cell of its start; any other near one in the cell of
    the zone's nearest edge point. Boxes are compared before edges, and then one segment with one edge a row by
    compiled arithmetic; the inside is asked for once, beside a zone's first edge. ``within`` names a column of the zones that must equal ``line_id``: a zone then
    meets only the lines of its own group.
    """
    cells = Cells(cell, salts=salts)
    same = f" AND s.id = z.kept.{within}" if within else ""
    reach = G.num(d * (1 + 1e-9) + cell * 1e-9)
    boxes = " AND ".join(
        f"least(s.e.{v}1, s.e.{v}2) <= z.box.{v}max + {reach} AND greatest(s.e.{v}1, s.e.{v}2) >= z.box.{v}min - {reach}" for v in "xy"
    )
    start_here = f"{index('e.x1', cell)} = z.c.x AND {index('e.y1', cell)} = z.c.y"
    in_box = "e.x1 BETWEEN z.box.xmin AND z.box.xmax AND e.y1 BETWEEN z.box.ymin AND z.box.ymax"
    inside = f"CASE WHEN coalesce(k, 0) = 0 AND {start_here} AND {in_box} THEN {_inside('z', 'e.x1', 'e.y1')} ELSE false END"
    text = f"""
        SELECT DISTINCT line AS {line_id}, z.id AS {zone_id} FROM (
          SELECT s.id AS line, s.e, z.*
          FROM (SELECT *, {_cell(0, 'cx', 'cy', cell)} AS c{_salt_of('id, e', cells)} FROM ({_segment_cells_sql(segments_sql('{lines}', line_id, line_geom), cell, d)})) s
          JOIN ({tiles_sql('{zones}', zone_id, zone_geom, cells, [within] if within else (), repeat=True)}) z ON {_same_cell('s', 'z', cells)}{same} AND {boxes}) z
        LATERAL VIEW OUTER posexplode(near) AS k, f WHERE {G.nearby.sql('e', 'f', d)} OR {inside}"""
    used = dict.fromkeys([zone_id, zone_geom, *([within] if within else [])])
    return lines.sparkSession.sql(text, lines=dealt(lines.select(line_id, line_geom)), zones=dealt(zones.select(*used)))


def clip_length(
    lines: DataFrame, zones: DataFrame, line_id: str, zone_id: str,
    line_geom: str = "geom", zone_geom: str = "geom", cell: float = CELL, salts: int = SALTS,
) -> DataFrame:
    """Length of the lines inside each zone: zone_id, length.

    Segments are first cut at the grid lines, so a piece needs only the zone's edges near its
    own cell. Within a cell a piece is cut where it crosses the zone's boundary, and the parts
    whose midpoint is inside are added up. A cut on a grid line belongs to the cell of its
    midpoint, so nothing is counted twice.
    """

    cells = Cells(cell, salts=salts)

    def enter_leave(c):
        a = f"try_divide({low(f'c{c}', cell)} - e.{c}1, d{c})"
        b = f"try_divide({low(f'c{c} + 1', cell)} - e.{c}1, d{c})"
        return f"coalesce(least({a}, {b}), 0D)", f"coalesce(greatest({a}, {b}), 1D)"

    (xa, xb), (ya, yb) = enter_leave("x"), enter_leave("y")
    mid = lambda c: f"e.{c}1 + (t0 + t1) / 2 * d{c}"
    delta = f"SELECT *, e.x2 - e.x1 AS dx, e.y2 - e.y1 AS dy FROM ({_segment_cells_sql(segments_sql('{lines}', line_id, line_geom), cell)})"
    pieces = f"SELECT *, greatest(0D, {xa}, {ya}) AS t0, least(1D, {xb}, {yb}) AS t1 FROM ({delta})"
    own = f"t0 < t1 AND {index(mid('x'), cell)} = cx AND {index(mid('y'), cell)} = cy"
    # where the segment crosses the line through an edge; NULL when parallel
    cut = "try_divide((f.x1 - s.e.x1) * (f.y2 - f.y1) - (f.y1 - s.e.y1) * (f.x2 - f.x1), s.dx * (f.y2 - f.y1) - s.dy * (f.x2 - f.x1))"
    stops = f"array_sort(concat(array(s.t0, s.t1), filter(transform(z.near, f -> {cut}), t -> t > s.t0 AND t < s.t1)))"
    inside = _inside("z", "s.e.x1 + m * s.dx", "s.e.y1 + m * s.dy")
    n = "size(k) - 1"
    share = f"zip_with(slice(k, 1, {n}), slice(k, 2, {n}), (a, b) -> CASE WHEN {G.let('m', '(a + b) / 2', inside)} THEN b - a ELSE 0D END)"
    text = f"""
        SELECT z.id AS {zone_id}, sum({G.let('k', stops, f'aggregate({share}, 0D, (u, v) -> u + v)')} * hypot(s.dx, s.dy)) AS length
        FROM (SELECT *, {_cell(0, 'cx', 'cy', cell)} AS c{_salt_of('id, e', cells)} FROM ({pieces}) WHERE {own}) s
        JOIN ({tiles_sql('{zones}', zone_id, zone_geom, cells, repeat=True)}) z ON {_same_cell('s', 'z', cells)}
        GROUP BY z.id"""
    return lines.sparkSession.sql(text, lines=lines, zones=zones)


def assign_by_centroid(
    features: DataFrame, zones: DataFrame, feature_id: str, zone_id: str,
    geom: str = "geom", zone_geom: str = "geom", cells: Cells | None = None,
) -> DataFrame:
    """(feature_id, zone_id, matches, error): the zone that strictly holds the feature's centroid.

    Exactly one zone must match; none or several leave zone_id NULL and name the error.
    """
    cells = cells or cells_for((features, geom))  # boxes tell where features are, without their centroids
    # a row of its own for the centroid, so that no filter or column above it computes it again
    c = dealt(features.select(feature_id, geom)).selectExpr(feature_id, f"explode(array({G.centroid.sql(geom)})) AS _c").select(feature_id, "_c.x", "_c.y")
    found = point_join(c, zones, zone_id, geom=zone_geom, strict=True, cells=cells, alias="_zone")
    per_feature = found.groupBy(feature_id).agg(F.count("*").alias("matches"), F.min("_zone").alias("_zone"))
    out = features.select(feature_id).join(per_feature, feature_id, "left")
    n = F.coalesce(F.col("matches"), F.lit(0))
    return out.select(
        feature_id,
        F.when(n == 1, F.col("_zone")).alias(zone_id),
        n.alias("matches"),
        F.when(n == 0, "no match").when(n > 1, "several matches").alias("error"),
    )


def buffer_runs(lines: DataFrame, group: str, d: float, step: float, geom: str = "geom") -> DataFrame:
    """Runs (group, row, a, b) of neighbouring grid cells, columns a to b of a row, whose centres are within ``d``
    of a line of the group; runs of several segments may overlap.

    A row of cells is cut to the reach of the segment before its columns are looked at, so a long
    diagonal costs its own corridor and not its bounding box, and what leaves a task is a row for each segment and
    row of cells, not one for each cell.
    """
    d_ = G.num(d)
    # x of the segment where it enters and leaves the band that is within d of the row
    at = lambda sign, default: (
        f"e.x1 + greatest(0D, least(1D, coalesce(try_divide(yc {sign} {d_} - e.y1, e.y2 - e.y1), {default}))) * (e.x2 - e.x1)"
    )
    rows = f"""SELECT id, e, {cells_between(f'least(e.y1, e.y2) - {d_}', f'greatest(e.y1, e.y2) + {d_}', step)} AS row
        FROM ({segments_sql('{lines}', group, geom)})"""
    reach = f"SELECT *, {at('-', '0D')} AS xa, {at('+', '1D')} AS xb FROM (SELECT *, {low('row', step)} + {G.num(step / 2)} AS yc FROM ({rows}))"
    span = f"sequence({index(f'least(xa, xb) - {d_}', step)}, {index(f'greatest(xa, xb) + {d_}', step)})"
    # squared distance to the segment; what is the same for a row is computed once
    fixed = "e.x2 - e.x1 AS dx, e.y2 - e.y1 AS dy, (yc - e.y1) * (e.y2 - e.y1) AS up, (e.x2 - e.x1) * (e.x2 - e.x1) + (e.y2 - e.y1) * (e.y2 - e.y1) AS dd"
    xc = f"({low('col', step)} + {G.num(step / 2)})"
    t = f"greatest(0D, least(1D, coalesce(try_divide(({xc} - e.x1) * dx + up, dd), 0D)))"
    u, v = f"({xc} - (e.x1 + {t} * dx))", f"(yc - (e.y1 + {t} * dy))"
    near = f"filter(span, col -> {u} * {u} + {v} * {v} <= {G.num(float(d) ** 2)})"
    run = lambda a, b: f"named_struct('a', {a}, 'b', {b})"
    # the cells of a row within d of a segment lie together, but for rounding
    runs = f"""CASE WHEN size(cs) = 0 THEN slice(array({run('0L', '0L')}), 1, 0)
        WHEN element_at(cs, -1) - cs[0] = size(cs) - 1 THEN array({run('cs[0]', 'element_at(cs, -1)')}) ELSE transform(cs, c -> {run('c', 'c')}) END"""
    text = f"""SELECT id AS {group}, row, run.a, run.b FROM (
        SELECT id, row, explode({G.let('cs', near, runs)}) AS run FROM (SELECT id, e, row, yc, {fixed}, {span} AS span FROM ({reach})))"""
    return lines.sparkSession.sql(text, lines=dealt(lines.select(group, geom)))


def buffer_cells(lines: DataFrame, group: str, d: float, step: float, geom: str = "geom") -> DataFrame:
    """Distinct grid cells (group, col, row) whose centre is within ``d`` of a line of the group."""
    return buffer_runs(lines, group, d, step, geom).select(group, F.explode(F.sequence("a", "b")).alias("col"), "row").distinct()


def buffer_area(lines: DataFrame, group: str, d: float, step: float, geom: str = "geom") -> DataFrame:
    """Area of the dissolved buffer of width ``d`` around each group's lines: (group, area).

    Counted on a grid of ``step``; the error is about perimeter * step / 2. No cell is listed: the runs of a row
    are merged in order, each adding the columns beyond those before it.
    """
    runs = buffer_runs(lines, group, d, step, geom).distinct()
    before = Window.partitionBy(group, "row").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest(F.max("b").over(before), F.col("a") - 1)
    added = runs.select(group, F.greatest(F.col("b") - seen, F.lit(0)).alias("n"))
    return added.groupBy(group).agg((F.sum("n") * F.lit(float(step) ** 2)).alias("area"))
