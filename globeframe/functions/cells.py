"""Cell ids in Catalyst: bit arithmetic on BIGINT, and the Hilbert chain as projections.

Ids hold raw bits, so those of faces 4 and 5 are negative: order by ``order_key``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels import grid
from . import vectors as V
from .bind import let
from .vectors import _c

MIN_LONG = -(2**63)
# Derivatives of the grid's metrics (dimension, value at level 0).
METRICS = {
    "min_angle_span": (1, 4 / 3),
    "avg_angle_span": (1, math.pi / 2),
    "max_angle_span": (1, 1.7048971791992185),
    "min_width": (1, 2 * math.sqrt(2) / 3),
    "avg_width": (1, 1.4345236728860995),
    "max_width": (1, 1.7048971791992185),
    "min_edge": (1, 2 * math.sqrt(2) / 3),
    "avg_edge": (1, 1.4592137463861061),
    "max_edge": (1, 1.7048971791992185),
    "min_diag": (1, 8 * math.sqrt(2) / 9),
    "avg_diag": (1, 2.0604227389984717),
    "max_diag": (1, 2.438654594434021),
    "min_area": (2, 8 * math.sqrt(2) / 9),
    "avg_area": (2, 4 * math.pi / 6),
    "max_area": (2, 2.6357992569631614),
}
MAX_EDGE_ASPECT, MAX_DIAG_ASPECT = 1.4426158075733853, math.sqrt(3)


def metric_value(name: str, level) -> Column:
    dim, deriv = METRICS[name]
    return F.lit(deriv) * F.pow(F.lit(2.0), -dim * _c(level))


def metric_min_level(name: str, value: float) -> int:
    """The first level whose metric is at most ``value``; the last level if none is."""
    dim, deriv = METRICS[name]
    return next((k for k in range(31) if deriv * 2.0 ** (-dim * k) <= value), 30)


def metric_max_level(name: str, value: float) -> int:
    """The last level whose metric is at least ``value``; 0 if none is."""
    dim, deriv = METRICS[name]
    return next((k for k in range(30, -1, -1) if deriv * 2.0 ** (-dim * k) >= value), 0)


def metric_closest_level(name: str, value: float) -> int:
    dim, _ = METRICS[name]
    return metric_max_level(name, value / (math.sqrt(2) if dim == 1 else 2))


def order_key(cell) -> Column:
    return _c(cell).bitwiseXOR(F.lit(MIN_LONG))


def lsb(cell) -> Column:
    return _c(cell).bitwiseAND(-_c(cell))


def level_lsb(level) -> Column:
    if isinstance(level, int):
        return F.lit(1 << (2 * (30 - level))).cast("long")
    return F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(60) - 2 * _c(level)).cast("int"))


def level(cell) -> Column:
    return (F.lit(30) - F.floor(F.bit_count(lsb(cell) - 1) / 2)).cast("int")


def face(cell) -> Column:
    return F.shiftrightunsigned(_c(cell), 61).cast("int")


def position(cell) -> Column:
    return _c(cell).bitwiseAND(F.lit((1 << 61) - 1))


def is_leaf(cell) -> Column:
    return _c(cell).bitwiseAND(F.lit(1)) == 1


def is_face(cell) -> Column:
    return _c(cell).bitwiseAND(F.lit((1 << 60) - 1)) == 0


def is_valid(cell) -> Column:
    c = _c(cell)
    safe = F.when(c == MIN_LONG, F.lit(0).cast("long")).otherwise(c)
    return (face(c) < 6) & (lsb(safe).bitwiseAND(F.lit(0x1555555555555555)) != 0)


@let
def parent(cell, at_level=None) -> Column:
    """The ancestor at a level, or the parent."""
    one = F.shiftleft(lsb(cell), 2) if at_level is None else level_lsb(at_level)
    return _c(cell).bitwiseAND(-one).bitwiseOR(one)


def child(cell, k: int) -> Column:
    step = F.shiftright(lsb(cell), 2)
    return _c(cell) + (2 * k - 3) * step


def children(cell) -> Column:
    return F.array(*(child(cell, k) for k in range(4)))


def child_position(cell) -> Column:
    """Which child of its parent a cell is, 0 to 3."""
    step = F.call_function("shiftrightunsigned", _c(cell), (2 * (F.lit(30) - level(cell)) + 1).cast("int"))
    return step.bitwiseAND(F.lit(3)).cast("int")


def ancestors(cell, from_level: int, to_level: int, step: int = 1) -> Column:
    """The ancestors at levels from_level, from_level + step, ..., to_level."""
    return F.array(*(parent(cell, k) for k in range(from_level, to_level + 1, step)))


def range_min(cell) -> Column:
    return _c(cell).bitwiseXOR(lsb(cell)).bitwiseOR(F.lit(1))


def range_max(cell) -> Column:
    return _c(cell).bitwiseOR(lsb(cell) - 1)


def contains(a, b) -> Column:
    k = order_key(b)
    return (k >= order_key(range_min(a))) & (k <= order_key(range_max(a)))


def intersects(a, b) -> Column:
    return (order_key(range_min(b)) <= order_key(range_max(a))) & (order_key(range_max(b)) >= order_key(range_min(a)))


def next_cell(cell) -> Column:
    """The next cell of the level along the curve; past the end of face 5 it is no valid id."""
    return F.try_add(_c(cell), F.shiftleft(lsb(cell), 1))


def previous_cell(cell) -> Column:
    return F.try_subtract(_c(cell), F.shiftleft(lsb(cell), 1))


def distance_from_begin(cell) -> Column:
    """How many cells of its level come before it on the curve."""
    shift = (2 * (F.lit(30) - level(cell)) + 1).cast("int")
    return F.call_function("shiftrightunsigned", _c(cell), shift)


# Steps along the curve: a cell is its number among the cells of its level.


def _shift_of(at_level) -> Column:
    return (2 * (F.lit(30) - _c(at_level)) + 1).cast("int") if not isinstance(at_level, int) else F.lit(2 * (30 - at_level) + 1)


def cells_at(at_level) -> Column:
    """How many cells a level has."""
    return F.call_function("shiftleft", F.lit(6).cast("long"), (2 * _c(at_level)).cast("int")) if not isinstance(at_level, int) else F.lit(6 << (2 * at_level)).cast("long")


def from_steps(steps, at_level) -> Column:
    """The cell after so many others of its level; the number of all gives the end, no valid id."""
    return F.call_function("shiftleft", _c(steps), _shift_of(at_level)).bitwiseOR(level_lsb(at_level))


def begin(at_level) -> Column:
    return from_steps(F.lit(0).cast("long"), at_level)


def end(at_level) -> Column:
    return from_steps(cells_at(at_level), at_level)


@let
def _stepped(cell, steps, at_level) -> Column:
    here, total = distance_from_begin(cell), cells_at(at_level)
    return from_steps(here + F.greatest(-here, F.least(_c(steps), total - here)), at_level)


def advance(cell, steps) -> Column:
    """So many steps on or back at the cell's level, stopping at the begin and the end."""
    return _stepped(cell, _c(steps).cast("long") if not isinstance(steps, int) else F.lit(steps).cast("long"), level(cell))


@let
def _wrapped(cell, steps, at_level) -> Column:
    total = cells_at(at_level)
    return from_steps(F.pmod(distance_from_begin(cell) + F.pmod(_c(steps), total) - total, total), at_level)


def advance_wrap(cell, steps) -> Column:
    """The same, going round from the last cell to the first."""
    return _wrapped(cell, _c(steps).cast("long") if not isinstance(steps, int) else F.lit(steps).cast("long"), level(cell))


def next_wrap(cell) -> Column:
    return advance_wrap(cell, 1)


def previous_wrap(cell) -> Column:
    return advance_wrap(cell, -1)


def from_face(face_col) -> Column:
    return F.shiftleft(_c(face_col).cast("long"), 61).bitwiseOR(F.lit(1 << 60))


def from_face_pos_level(face_col, pos, at_level) -> Column:
    """The cell of a level at a position on a face's curve."""
    return parent(F.shiftleft(_c(face_col).cast("long"), 61).bitwiseOR(_c(pos)).bitwiseOR(F.lit(1)), at_level)


def from_face_ij(face_col, i, j) -> Column:
    return leaf_at(face_col, i, j)


@let
def from_debug_string(text) -> Column:
    """The cell of a ``face/path``; null where it is none."""
    t = _c(text)
    depth = (F.length(t) - 2).cast("int")
    digits = F.filter(F.split(F.substr(t, F.lit(3)), ""), lambda d: d != "")
    path = F.aggregate(digits, F.lit(0).cast("long"), lambda n, d: F.shiftleft(n, 2).bitwiseOR(d.cast("long")))
    at = F.call_function("shiftleft", path, (61 - 2 * depth).cast("int"))
    whole = F.shiftleft(F.substring(t, 1, 1).cast("long"), 61).bitwiseOR(at).bitwiseOR(level_lsb(depth))
    return F.when(t.rlike("^[0-5]/[0-3]{0,30}$"), whole)


@let
def maximum_tile(cell, limit) -> Column:
    """The largest cell that starts where ``cell`` does and ends before ``limit`` starts; ``limit``
    if there is none."""
    start, stop = range_min(cell), order_key(range_min(limit))
    tiles = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: parent(start, k))
    fit = F.filter(tiles, lambda t: (range_min(t) == start) & (order_key(range_max(t)) < stop))
    return F.when(order_key(start) >= stop, _c(limit)).otherwise(F.element_at(fit, 1))


@let
def common_ancestor_level(a, b) -> Column:
    """Level of the smallest cell with both, null on different faces."""
    bits = _c(a).bitwiseXOR(_c(b))
    wide = F.greatest(F.when(bits < 0, F.lit(2**63 - 1)).otherwise(bits), lsb(a), lsb(b))
    high = F.floor(F.log2(wide.cast("double"))).cast("int")
    # log2 of a long near a power of two can round up.
    high = F.when(F.call_function("shiftright", wide, high) == 0, high - 1).otherwise(high)
    return F.when((bits >= 0) & (high <= 60), F.floor((60 - high) / 2).cast("int"))


def token(cell) -> Column:
    """Hex without trailing zeros; X for 0."""
    return F.when(_c(cell) == 0, "X").otherwise(F.rtrim(F.lower(F.lpad(F.hex(_c(cell)), 16, "0")), F.lit("0")))


@let
def from_token(text) -> Column:
    """The id of a token; 0 where it is none."""
    t = _c(text)
    high, low = (F.conv(F.substring(F.rpad(t, 16, "0"), s, 8), 16, 10).cast("long") for s in (1, 9))
    high = F.when(high >= 2**31, high - 2**32).otherwise(high)
    return F.when(t.rlike("^[0-9a-fA-F]{1,16}$"), F.shiftleft(high, 32).bitwiseOR(low)).otherwise(F.lit(0).cast("long"))


def debug_string(cell) -> Column:
    """face/child path."""
    digits = F.transform(F.sequence(F.lit(1), F.greatest(level(cell), F.lit(1))), lambda k: F.call_function("shiftrightunsigned", _c(cell), (F.lit(61) - 2 * k).cast("int")).bitwiseAND(F.lit(3)).cast("string"))
    path = F.when(level(cell) > 0, F.array_join(digits, "")).otherwise("")
    return F.concat(face(cell).cast("string"), F.lit("/"), path)


# The coordinate chain.


def face_of(p) -> Column:
    x, y, z = V.xyz(p)
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    axis = F.when(ax > ay, F.when(ax > az, 0).otherwise(2)).otherwise(F.when(ay > az, 1).otherwise(2))
    main = F.when(axis == 0, x).when(axis == 1, y).otherwise(z)
    return F.when(main < 0, axis + 3).otherwise(axis)


def uv_of(face_col, p) -> tuple[Column, Column]:
    x, y, z = V.xyz(p)
    pick = lambda *e: F.element_at(F.array(*e), face_col + 1)
    safe = lambda a, b: F.try_divide(a, b)
    u = pick(safe(y, x), safe(-x, y), safe(-x, z), safe(z, x), safe(z, y), safe(-y, z))
    v = pick(safe(z, x), safe(z, y), safe(-y, z), safe(y, x), safe(-x, y), safe(-x, z))
    return u, v


def uv_to_st(u) -> Column:
    return F.when(_c(u) >= 0, 0.5 * F.sqrt(1 + 3 * _c(u))).otherwise(1 - 0.5 * F.sqrt(1 - 3 * _c(u)))


def st_to_uv(s) -> Column:
    return F.when(_c(s) >= 0.5, (4 * _c(s) * _c(s) - 1) / 3).otherwise((1 - 4 * (1 - _c(s)) * (1 - _c(s))) / 3)


def st_to_ij(s) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(grid.SIZE - 1), F.floor(_c(s) * grid.SIZE))).cast("long")


def _table(values) -> Column:
    return F.expr(f"array({','.join(str(int(v)) for v in values)})")


#: The bytes of a position from the highest: each holds four levels of the curve.
_BYTES = "array(7, 6, 5, 4, 3, 2, 1, 0)"


def _shift(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits.cast("int"))


@let
def leaf_at(face_col, i, j) -> Column:
    """The leaf cell of a face and (i, j): a fold that turns four levels at a time into a byte.

    A fold names its inputs once, so a filter or join that Catalyst pushes through the
    column copies a small tree, where a chain of projections would double at each step.
    """
    f, i, j = _c(face_col).cast("long"), _c(i), _c(j)
    start = F.struct(F.lit(0).cast("long").alias("n"), f.bitwiseAND(F.lit(1)).alias("o"))

    def step(state: Column, k: Column) -> Column:
        nibble = lambda c: _shift(c, 4 * k).bitwiseAND(F.lit(15))
        key = F.shiftleft(nibble(i), 6).bitwiseOR(F.shiftleft(nibble(j), 2)).bitwiseOR(state["o"])
        got = F.element_at(_table(grid.FORWARD), (key + 1).cast("int")).cast("long")
        return F.struct(F.shiftleft(state["n"], 8).bitwiseOR(F.shiftright(got, 2)).alias("n"), got.bitwiseAND(F.lit(3)).alias("o"))

    place = F.aggregate(F.expr(_BYTES), start, step, lambda state: state["n"])
    return F.shiftleft(f, 61).bitwiseOR(F.shiftleft(place, 1)).bitwiseOR(F.lit(1))


@let
def face_ij(p) -> Column:
    """face, i and j of a point, as a struct."""
    return _face_ij(p, face_of(p))


@let
def _face_ij(p, f) -> Column:
    u, v = uv_of(_c(f), p)
    return F.struct(_c(f).alias("face"), st_to_ij(uv_to_st(u)).alias("i"), st_to_ij(uv_to_st(v)).alias("j"))


@let
def _leaf_of(place) -> Column:
    return leaf_at(_c(place)["face"], _c(place)["i"], _c(place)["j"])


@let
def _center_of(cell, place) -> Column:
    size = F.call_function("shiftleft", F.lit(1).cast("long"), (30 - level(cell)).cast("int"))
    mid = lambda a: st_to_uv((_c(place)[a].bitwiseAND(-size) + size / 2) / grid.SIZE)
    return _project(face(cell), mid("i"), mid("j"))


@let
def _project(f, u, v) -> Column:
    return V.normalize(uv_to_xyz(f, u, v))


@let
def ij_of(cell) -> Column:
    """i and j of a leaf of the cell, as a struct: the fold backwards."""
    rest = F.shiftright(_c(cell), 1).bitwiseAND(F.lit((1 << 60) - 1))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("i"), zero.alias("j"), face(cell).cast("long").bitwiseAND(F.lit(1)).alias("o"))

    def step(state: Column, k: Column) -> Column:
        key = F.shiftleft(_shift(rest, 8 * k).bitwiseAND(F.lit(255)), 2).bitwiseOR(state["o"])
        got = F.element_at(_table(grid.BACK), (key + 1).cast("int")).cast("long")
        i = F.shiftleft(state["i"], 4).bitwiseOR(F.shiftright(got, 6))
        j = F.shiftleft(state["j"], 4).bitwiseOR(F.shiftright(got, 2).bitwiseAND(F.lit(15)))
        return F.struct(i.alias("i"), j.alias("j"), got.bitwiseAND(F.lit(3)).alias("o"))

    return F.aggregate(F.expr(_BYTES), start, step, lambda state: F.struct(state["i"].alias("i"), state["j"].alias("j")))


def with_cell(df: DataFrame, p, name: str = "cell", level: int = 30, keep_ij: bool = False) -> DataFrame:
    """Adds the id of the cell of a level at point p, null where p is; on whole Arrow batches, in a
    small part of the time of the fold ``leaf_at``, which gives the same ids."""
    added = {name: "long"} | ({f"{name}_face": "int", f"{name}_i": "long", f"{name}_j": "long"} if keep_ij else {})
    kept = [c for c in df.columns if c not in added]
    point = _c(p)
    source = df.select(*(f"`{c}`" for c in kept), *(point[c].cast("double").alias(f"_globe_{c}") for c in "xyz"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xyz = [b.column(len(kept) + k) for k in range(3)]
            p = np.stack([x.to_numpy(zero_copy_only=False) for x in xyz], -1) if b.num_rows else np.zeros((0, 3))
            missing = np.isnan(p).any(-1)
            face, i, j = grid.face_ij(np.where(missing[:, None], 1.0, p))
            values = [(grid.parent(grid.from_ij(face, i, j), level), pa.int64()), (face, pa.int32()), (i, pa.int64()), (j, pa.int64())]
            new = [pa.array(v, mask=missing).cast(kind) for v, kind in values[: len(added)]]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *new], [*kept, *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(kept)]), *(f"`{c}` {t}" for c, t in added.items())])
    return source.mapInArrow(run, schema)


def with_center(df: DataFrame, cell, name: str = "center") -> DataFrame:
    """Adds the unit vector at a cell's centre."""
    return df.withColumn(name, _center_of(cell, ij_of(cell)))


def uv_to_xyz(face_col, u, v) -> Column:
    pick = lambda *e: F.element_at(F.array(*e), _c(face_col) + 1)
    one, u, v = F.lit(1.0), _c(u), _c(v)
    return V.vector(pick(one, -u, -u, -one, v, v), pick(u, one, -v, -v, -one, u), pick(v, v, one, -u, -u, -one))


@let
def _bounds(cell, place) -> Column:
    size = F.call_function("shiftleft", F.lit(1).cast("long"), (30 - level(cell)).cast("int"))
    low = lambda a: _c(place)[a].bitwiseAND(-size)
    edge = lambda x: st_to_uv(x / F.lit(float(grid.SIZE)))
    return F.struct(edge(low("i")).alias("u_lo"), edge(low("i") + size).alias("u_hi"), edge(low("j")).alias("v_lo"), edge(low("j") + size).alias("v_hi"))


def bound_uv(cell) -> Column:
    """The cell's rectangle on its face: u_lo, u_hi, v_lo, v_hi."""
    return _bounds(cell, ij_of(cell))


@let
def _center_si_ti(cell, place) -> Column:
    size = F.call_function("shiftleft", F.lit(1).cast("long"), (30 - level(cell)).cast("int"))
    mid = lambda a: 2 * _c(place)[a].bitwiseAND(-size) + size
    return F.struct(face(cell).alias("face"), mid("i").alias("si"), mid("j").alias("ti"))


def center_si_ti(cell) -> Column:
    """face, si and ti of the centre, in half leaf widths."""
    return _center_si_ti(cell, ij_of(cell))


@let
def expanded_by_distance_uv(bound, radians) -> Column:
    """A face rectangle grown so that it holds all points within a distance; shrunk if negative,
    to its low corner if nothing is left."""
    b, sin = _c(bound), F.sin(_c(radians))
    wide, high = F.greatest(F.abs(b["u_lo"]), F.abs(b["u_hi"])), F.greatest(F.abs(b["v_lo"]), F.abs(b["v_hi"]))

    def moved(u: Column, across: Column, by: Column) -> Column:
        turn = by * F.sqrt((1 + u * u + across * across) / (1 + u * u))
        cos = F.sqrt(1 - turn * turn)
        return (cos * u + turn) / (cos - turn * u)

    grown = {"u_lo": moved(b["u_lo"], high, -sin), "u_hi": moved(b["u_hi"], high, sin), "v_lo": moved(b["v_lo"], wide, -sin), "v_hi": moved(b["v_hi"], wide, sin)}
    gone = (grown["u_lo"] > grown["u_hi"]) | (grown["v_lo"] > grown["v_hi"])
    corner = {"u_lo": b["u_lo"], "u_hi": b["u_lo"], "v_lo": b["v_lo"], "v_hi": b["v_lo"]}
    return F.struct(*(F.when(gone, corner[k]).otherwise(v).alias(k) for k, v in grown.items()))


def average_area(cell) -> Column:
    return metric_value("avg_area", level(cell))
