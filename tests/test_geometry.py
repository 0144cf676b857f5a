"""Geometry verdicts on known shapes, and the grid against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablekeep.operators import geometry
from tablekeep.plans.fixtures import Inputs
from tablekeep.sources.wkt import assemble_wkt, explode_wkt

CASES = {
    "null": (None, None),
    "bowtie": ("POLYGON((0 0, 2 2, 2 0, 0 2, 0 0))", "ring_self_intersection"),
    "spike": ("POLYGON((0 0, 4 0, 4 4, 2 4, 2 2, 2 4, 0 4, 0 0))", "ring_self_intersection"),
    "empty": ("POLYGON EMPTY", "empty"),
    "repeated": ("LINESTRING(0 0, 10 0, 10 0, 20 0)", "repeated_points"),
    "tiny polygon": ("POLYGON((0 0, 0.002 0, 0.001 0.0005, 0 0))", None),
    "short line": ("LINESTRING(0 0, 0.0005 0)", None),
    "crossing line": ("LINESTRING(0 0, 10 10, 10 0, 0 10)", None),
    "arc": ("CIRCULARSTRING(0 0, 1 1, 2 0)", "arc"),
    "straight compound curve": ("COMPOUNDCURVE((0 0, 1 1), (1 1, 2 0))", None),
    "compound curve with an arc": ("COMPOUNDCURVE((0 0, 1 1), CIRCULARSTRING(1 1, 2 2, 3 1))", "arc"),
    "straight curve polygon": ("CURVEPOLYGON(COMPOUNDCURVE((0 0, 9 0), (9 0, 9 9, 0 9, 0 0)), (1 1, 2 1, 2 2, 1 1))", None),
    "curve polygon with a hole outside": ("CURVEPOLYGON((0 0, 9 0, 9 9, 0 9, 0 0), (11 1, 12 1, 12 2, 11 1))", "hole_outside_shell"),
    "multisurface with parts inside": ("MULTISURFACE(((0 0, 9 0, 9 9, 0 9, 0 0)), CURVEPOLYGON((3 3, 4 3, 4 4, 3 3)))", "parts_overlap"),
    "multicurve": ("MULTICURVE((0 0, 1 1), COMPOUNDCURVE((0 0, 5 0), CIRCULARSTRING(5 0, 6 1, 7 0)))", "arc"),
    "collection": ("GEOMETRYCOLLECTION(POINT(1 2), LINESTRING(0 0, 1 1), POLYGON((0 0, 1 0, 1 1, 0 0)), POLYGON((0 0, 1 0, 1 1, 0 0)))", None),
    "collection with a bowtie": ("GEOMETRYCOLLECTION(POINT(1 2), POLYGON((0 0, 2 2, 2 0, 0 2, 0 0)))", "ring_self_intersection"),
    "collection in a collection": ("GEOMETRYCOLLECTION(GEOMETRYCOLLECTION(POINT EMPTY), GEOMETRYCOLLECTION(POLYGON((0 0, 2 2, 2 0, 0 2, 0 0))))", "ring_self_intersection"),
    "collection with a multipolygon": (
        "GEOMETRYCOLLECTION(MULTIPOLYGON(((0 0, 9 0, 9 9, 0 9, 0 0)), ((3 3, 4 3, 4 4, 3 3))), POINT(1 1))", "parts_overlap"),
    "collection of overlapping polygons": ("GEOMETRYCOLLECTION(POLYGON((0 0, 9 0, 9 9, 0 9, 0 0)), POLYGON((3 3, 4 3, 4 4, 3 3)))", None),
    "collection with an arc": ("GEOMETRYCOLLECTION(LINESTRING(0 0, 1 1), CIRCULARSTRING(0 0, 1 1, 2 0))", "arc"),
    "collection with repeats": ("GEOMETRYCOLLECTION(POINT(0 0), MULTIPOINT(1 1, 1 1), LINESTRING(0 0, 10 0, 10 0, 20 0))", "repeated_points"),
    "empty collection": ("GEOMETRYCOLLECTION(POINT EMPTY, POLYGON EMPTY)", "empty"),
    "square": ("POLYGON((0 0, 100 0, 100 100, 0 100, 0 0))", None),
    "line": ("LINESTRING(0 0, 100 100)", None),
    "point": ("POINT(100 200)", None),
    "square z": ("POLYGON Z((0 0 10, 100 0 11, 100 100 12, 0 100 13, 0 0 10))", None),
    "tiny z": ("POLYGON Z((0 0 0, 0.0001 0 0, 0.0001 0.0001 0, 0 0.0001 0, 0 0 0))", None),
    "bad part": ("MULTIPOLYGON(((0 0, 1 0, 1 1, 0 1, 0 0)), ((10 10, 12 12, 12 10, 10 12, 10 10)))", "ring_self_intersection"),
    "multiline": ("MULTILINESTRING((0 0, 10 0), (20 20, 30 30, 30 20, 20 30))", None),
    "open ring": ("POLYGON((0 0, 1 0, 1 1, 0 1))", "ring_not_closed"),
    "bowtie with repeats": ("POLYGON((0 0, 2 2, 2 2, 2 0, 0 2, 0 0))", "ring_self_intersection"),
    "repeated ring": ("POLYGON((0 0, 4 0, 4 0, 4 4, 0 4, 0 0))", "repeated_points"),
    "one-point line": ("LINESTRING(1 1, 1 1)", "too_few_points"),
    "good hole": ("POLYGON((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 2 1, 2 2, 1 1))", None),
    "hole outside": ("POLYGON((0 0, 9 0, 9 9, 0 9, 0 0), (11 1, 12 1, 12 2, 11 1))", "hole_outside_shell"),
    "hole far above": ("POLYGON((0 0, 9 0, 9 9, 0 9, 0 0), (1 11, 2 11, 2 12, 1 11))", "hole_outside_shell"),
    "part in hole": ("MULTIPOLYGON(((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 8 1, 8 8, 1 8, 1 1)), ((3 3, 4 3, 4 4, 3 3)))", None),
    "part inside": ("MULTIPOLYGON(((0 0, 9 0, 9 9, 0 9, 0 0)), ((3 3, 4 3, 4 4, 3 3)))", "parts_overlap"),
    "part inside by corners": ("MULTIPOLYGON(((0 0, 10 0, 10 10, 0 10, 0 0)), ((5 0, 10 5, 5 10, 0 5, 5 0)))", "parts_overlap"),
    "hole in a notch": ("POLYGON((0 0, 10 0, 10 10, 6 10, 6 5, 4 5, 4 10, 0 10, 0 0), (4 7, 5 5, 6 7, 4 7))", "hole_outside_shell"),
    "hole in a hole": ("POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (1 1, 9 1, 9 9, 1 9, 1 1), (3 3, 4 3, 4 4, 3 4, 3 3))", "holes_nested"),
    "hole in a hole by corners": ("POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (1 1, 9 1, 9 9, 1 9, 1 1), (5 1, 9 5, 5 9, 1 5, 5 1))", "holes_nested"),
    "interior cut by one hole": ("POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (5 0, 6 5, 5 10, 4 5, 5 0))", "interior_cut"),
    "interior cut by three holes": (
        "POLYGON((0 0, 12 0, 12 12, 0 12, 0 0), (2 2, 6 2, 4 4, 2 2), (6 2, 10 2, 8 4, 6 2), (4 4, 8 4, 6 8, 4 4))", "interior_cut"),
    "hole touching once": ("POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (5 0, 6 5, 4 5, 5 0))", None),
    "chain of touching holes": ("POLYGON((0 0, 12 0, 12 12, 0 12, 0 0), (0 6, 2 5, 4 6, 2 7, 0 6), (4 6, 6 5, 8 6, 6 7, 4 6))", None),
    "touching parts": ("MULTIPOLYGON(((0 0, 1 0, 1 1, 0 0)), ((1 1, 2 1, 2 2, 1 1)))", None),
    "shared edge": ("MULTIPOLYGON(((0 0, 1 0, 1 1, 0 1, 0 0)), ((1 0, 2 0, 2 1, 1 1, 1 0)))", "parts_overlap"),
}


def verdicts(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "name string, geom string")
    features, vertices = explode_wkt(df, "name", "geom")
    return {r.feature_id: r for r in geometry.explain_geometry(features, vertices).collect()}


def test_known_shapes(spark):
    got = {k: r.reason_code for k, r in verdicts(spark, {k: v[0] for k, v in CASES.items()}).items()}
    assert got == {k: v[1] for k, v in CASES.items()}


def test_arc_names_its_type(spark):
    assert verdicts(spark, {"a": CASES["arc"][0]})["a"].detail == "CIRCULARSTRING"


def test_pieces_do_not_change_verdicts(spark, monkeypatch):
    monkeypatch.setattr(geometry.walk, "__defaults__", (2,))
    got = {k: r.reason_code for k, r in verdicts(spark, {k: v[0] for k, v in CASES.items()}).items()}
    assert got == {k: v[1] for k, v in CASES.items()}


def star(n, rng, wild):
    angle = np.linspace(0, 2 * np.pi, n, endpoint=False)
    radius = 1000 + rng.integers(-300, 300, n)
    pts = np.round(np.c_[np.cos(angle), np.sin(angle)] * radius[:, None]).astype(int)
    if wild:
        i, j = sorted(rng.choice(n, 2, replace=False))
        pts[[i, j]] = pts[[j, i]]
    return np.vstack([pts, pts[:1]])


def meets(p):
    """Pairs of non-neighbouring or overlapping segments of one closed ring, by brute force."""
    seg = [(p[i], p[i + 1]) for i in range(len(p) - 1) if tuple(p[i]) != tuple(p[i + 1])]
    m, bad = len(seg), set()

    def turn(a, b, c):
        return np.sign((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1]))

    for i in range(m):
        for j in range(i + 1, m):
            (a, b), (c, d) = seg[i], seg[j]
            if min(a[0], b[0]) > max(c[0], d[0]) or min(c[0], d[0]) > max(a[0], b[0]):
                continue
            if min(a[1], b[1]) > max(c[1], d[1]) or min(c[1], d[1]) > max(a[1], b[1]):
                continue
            o = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
            if o[0] * o[1] > 0 or o[2] * o[3] > 0:
                continue
            if j == i + 1 or (i == 0 and j == m - 1):
                wx = min(max(a[0], b[0]), max(c[0], d[0])) - max(min(a[0], b[0]), min(c[0], d[0]))
                wy = min(max(a[1], b[1]), max(c[1], d[1])) - max(min(a[1], b[1]), min(c[1], d[1]))
                if not (o[0] == 0 and o[1] == 0 and (wx > 0 or wy > 0)):
                    continue
            bad.add((i + 1, j + 1))
    return bad


@pytest.mark.parametrize("block", [2, 256])
def test_grid_finds_every_conflict(spark, monkeypatch, block):
    """Large rings take the grid path; small cells and blocks force refinement and splitting."""
    monkeypatch.setattr(geometry, "CELL", 1)
    monkeypatch.setattr(geometry, "BLOCK", block)
    rng = np.random.default_rng(7)
    rings = {k: star(90, rng, k % 2 == 0) for k in range(6)}
    rings[6] = np.vstack([rng.integers(0, 40, (120, 2)), [[0, 0]]])
    rings[6][-1] = rings[6][0]
    rows = [(k, 1, 1, i + 1, float(x), float(y)) for k, p in rings.items() for i, (x, y) in enumerate(p)]
    vertices = spark.createDataFrame(rows, "feature_id long, part int, ring int, idx int, x double, y double")
    features = spark.createDataFrame([(k, "POLYGON") for k in rings], "feature_id long, geom_type string")
    found = geometry.segment_conflicts(geometry.judged_pairs(geometry.polygon_segments(features, vertices))).collect()
    got = {k: {(r.i, r.i2) for r in found if r.feature_id == k} for k in rings}
    assert got == {k: meets(p) for k, p in rings.items()}


@pytest.mark.parametrize("few", [32, 2])
def test_parts_inside_each_other(spark, monkeypatch, few):
    """Many square parts on a board, some holding a smaller one, found directly and by grid."""
    monkeypatch.setattr(geometry, "FEW_PARTS", few)
    rings, nested = [], set()
    for n in range(30):
        x, y = 10 * (n % 6), 10 * (n // 6)
        rings.append((2 * n + 1, 1, x, y, 8))
        if n % 4 == 0:
            rings.append((2 * n + 2, 1, x + 2, y + 2, 3))
            nested.add(2 * n + 2)
        elif n % 4 == 1:  # an island in a hole is fine
            rings += [(2 * n + 1, 2, x + 1, y + 1, 6), (2 * n + 2, 1, x + 2, y + 2, 3)]
    corners = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    rows = [(1, p, r, i + 1, float(x + dx * w), float(y + dy * w)) for p, r, x, y, w in rings for i, (dx, dy) in enumerate(corners)]
    vertices = spark.createDataFrame(rows, "feature_id long, part int, ring int, idx int, x double, y double")
    features = spark.createDataFrame([(1, "MULTIPOLYGON")], "feature_id long, geom_type string")
    segments = geometry.polygon_segments(features, vertices)
    assert geometry.segment_conflicts(geometry.meetings(segments)).count() == 0
    found = geometry.misplaced_vertices(segments).collect()
    assert {(r.part, r.part2, r.reason_code) for r in found} == {(p, p - 1, "parts_overlap") for p in nested}


def test_wkt_round_trip(spark):
    texts = {k: v[0] for k, v in CASES.items() if v[0] and " Z" not in v[0] and "CIRC" not in v[0] and "COLL" not in v[0] and "CURVE" not in v[0] and "SURF" not in v[0]}
    df = spark.createDataFrame(list(texts.items()), "name string, geom string")
    features, vertices = explode_wkt(df, "name", "geom")
    back = assemble_wkt(features, vertices.drop("z", "m")).withColumnRenamed("feature_id", "name")
    again_f, again_v = explode_wkt(back, "name", "wkt")
    for first, second in ((features, again_f), (vertices, again_v)):
        cols = [c for c in first.columns if c not in ("srid", "parse_error")]
        assert sorted(map(str, first.select(cols).collect())) == sorted(map(str, second.select(cols).collect()))


def test_wkt_errors(spark):
    texts = {"a": "POINT(1)", "b": "LINESTRING(0 0, 1 1", "c": "CIRCLE(1 2)", "d": "POINT(1 2 3 4 5)", "e": "srid=3006;pointm(1 2 3)", "f": "POINT(1,2)", "g": "POINT(-1.5e3 .5)"}
    df = spark.createDataFrame(list(texts.items()), "name string, geom string")
    features, vertices = explode_wkt(df, "name", "geom")
    got = {r.feature_id: (r.geom_type, r.srid, r.coord_dim, r.parse_error) for r in features.collect()}
    assert got["e"] == ("POINT", 3006, 3, None)
    assert {k for k, v in got.items() if v[3]} == {"a", "b", "c", "d", "f"}
    points = {r.feature_id: (r.x, r.y, r.z, r.m) for r in vertices.collect()}
    assert points == {"e": (1.0, 2.0, None, 3.0), "g": (-1500.0, 0.5, None, None)}


def test_nonfinite(spark):
    rows = [(1, 1, 1, i + 1, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (1.0, float("nan")), (1.0, 1.0), (0.0, 0.0)])]
    vertices = spark.createDataFrame(rows, "feature_id long, part int, ring int, idx int, x double, y double")
    features = spark.createDataFrame([(1, "POLYGON")], "feature_id long, geom_type string")
    assert geometry.explain_geometry(features, vertices).first().reason_code == "nonfinite_coordinate"


WELL_FORMED = [
    "POINT(1 2)",
    "POINT M(1 2 3)",
    "POINT ZM (1 2 3 4)",
    "POINT Z(10000000 0.0001 3.25)",
    "LINESTRING(0 0, 1 1)",
    "POLYGON((0 0, 1 0, 1 1, 0 0))",
    "MULTIPOINT(1 2, 3 4)",
    "MULTIPOINT((1 2), (3 4))",
    "MULTIPOINT(1 2)",
    "MULTIPOINT((1 2))",
    "MULTIPOINT(EMPTY, (1 2))",
    "MULTILINESTRING((0 0,1 1),EMPTY)",
    "MULTIPOLYGON(EMPTY,((0 0,1 0,1 1,0 0)))",
    "MULTIPOLYGON(((0 0, 1 0, 1 1, 0 0),(0 0, 1 0, 1 1, 0 0)),((0 0, 1 0, 1 1, 0 0)))",
    "MULTIPOLYGON(EMPTY)",
    "POINT EMPTY",
    "GEOMETRYCOLLECTION(POINT(1 2), LINESTRING(0 0, 1 1))",
    "COMPOUNDCURVE((0 0, 1 1),CIRCULARSTRING(1 1, 2 2, 3 1))",
    "GEOMETRYCOLLECTION(POINT EMPTY)",
    "GEOMETRYCOLLECTION Z(POINT Z (1 2 3), MULTIPOINT Z((1 2 3), EMPTY))",
    "GEOMETRYCOLLECTION(POINT(1e3 -2E+4))",
    "MULTISURFACE(((0 0, 1 0, 1 1, 0 0)), CURVEPOLYGON(CIRCULARSTRING(0 0, 1 1, 0 0)))",
    " SRID=3006; point ( 1  2 ) ",
]
MALFORMED = [
    "POLYGON((0 0, 1 0, 1 1, 0 0)",
    "POLYGON(0 0, 1 0, 1 1, 0 0)",
    "LINESTRING((0 0),(1 1))",
    "LINESTRING(0 0, 1 1 1)",
    "POINT(1 2)(3 4)",
    "POINT((1 2))",
    "POINT(1 2, 3 4)",
    "POINT Z(1 2)",
    "MULTIPOLYGON((0 0, 1 0, 1 1, 0 0))",
    "POINT(1)",
    "POINT(a b)",
    "LINESTRING(0 0,,1 1)",
    "POLYGON((0 0, 1 0, 1 1, 0 0),)",
    "GEOMETRYCOLLECTION(POINT(1 2)",
    "GEOMETRYCOLLECTION(POINT(1 2)) POINT(1 2)",
    "GEOMETRYCOLLECTION(POINT(1 2),)",
    "GEOMETRYCOLLECTION((1 2))",
    "GEOMETRYCOLLECTION(POINT(1 2, 3 4))",
    "GEOMETRYCOLLECTION(POLYGON(0 0, 1 0, 1 1, 0 0))",
    "GEOMETRYCOLLECTION(POINT(1 2) LINESTRING(0 0, 1 1))",
    "GEOMETRYCOLLECTION(CIRCLE(1 2))",
    "GEOMETRYCOLLECTION(7, POINT(1 2))",
    "COMPOUNDCURVE((0 0, 1 1), (2 2, 3 3))",
    "COMPOUNDCURVE(LINESTRING(0 0, 1 1))",
    "CURVEPOLYGON(COMPOUNDCURVE((0 0, 4 0), (5 0, 4 4, 0 0)))",
    "MULTISURFACE((0 0, 1 0, 1 1, 0 0))",
]


def test_brackets_dimensions_and_empty_members(spark):
    df = spark.createDataFrame(list(enumerate(WELL_FORMED + MALFORMED)), "id long, geom string")
    features, vertices = explode_wkt(df, "id", "geom")
    errors = {r.feature_id: r.parse_error for r in features.collect()}
    assert [x for i, x in enumerate(WELL_FORMED) if errors[i]] == []
    assert [x for i, x in enumerate(MALFORMED, len(WELL_FORMED)) if not errors[i]] == []
    text = {r.feature_id: r.wkt for r in assemble_wkt(features, vertices).collect()}
    back = {WELL_FORMED[i]: text[i] for i in range(len(WELL_FORMED))}
    for same in ("POINT M(1 2 3)", "POINT Z(10000000 0.0001 3.25)", "LINESTRING(0 0, 1 1)", "POINT EMPTY"):
        assert back[same] == same
    assert back["MULTIPOLYGON(EMPTY,((0 0,1 0,1 1,0 0)))"] == "MULTIPOLYGON(((0 0, 1 0, 1 1, 0 0)))"
    assert back["MULTIPOLYGON(EMPTY)"] == "MULTIPOLYGON EMPTY"


def exact_side(x, y, x2, y2, px, py):
    from fractions import Fraction as Q

    d = (Q(x2) - Q(x)) * (Q(py) - Q(y)) - (Q(px) - Q(x)) * (Q(y2) - Q(y))
    return (d > 0) - (d < 0)


def test_side_is_exact(spark):
    """Points on a segment, one step of a double beside it, and everything in between, near 6,395,000."""
    from pyspark.sql import functions as F

    from tablekeep.functions.exact import side

    rng = np.random.default_rng(3)
    rows = []
    for k in range(600):
        ox, oy = (6_395_000.0, 150_000.0) if k % 3 else (0.1, 0.7)
        x, y, dx, dy = ox + rng.random(), oy + rng.random(), rng.integers(1, 50) / 8, rng.integers(1, 50) / 8
        x2, y2 = x + 4 * dx, y + 4 * dy
        px, py = x + dx * rng.integers(0, 5), y + dy * rng.integers(0, 5)
        t = rng.integers(0, 5)
        px, py = (px, py) if k % 2 else (x + t * dx, y + t * dy)
        for _ in range(rng.integers(0, 3)):
            px = float(np.nextafter(px, [np.inf, -np.inf][rng.integers(0, 2)]))
        rows.append(tuple(map(float, (x, y, x2, y2, px, py))))
    rows += [(0.0, 0.0, 4.0, 4.0, 2.0, 2.0), (1.0, 1.0, 1.0, 5.0, 1.0, 3.0), (0.5, 0.5, 12.0, 12.0, 24.0, 24.0), (1e100, 0.1, 1e-100, 3.0, 1e99, 2.0)]
    df = spark.createDataFrame(rows, "x double, y double, x2 double, y2 double, px double, py double").repartition(3)
    got = df.select("*", side(*map(F.col, ("x", "y", "x2", "y2", "px", "py"))).alias("s")).collect()
    assert [r for r in got if r.s != exact_side(*r[:6])] == []
    plain = [np.sign((r.x2 - r.x) * (r.py - r.y) - (r.px - r.x) * (r.y2 - r.y)) for r in got]
    assert sum(p != r.s for p, r in zip(plain, got)) > 20  # doubles alone would be wrong here


def test_crossing_one_step_from_touching(spark):
    """A hole whose corner lies a single step of a double inside, on, or outside the shell's slanted edge."""
    a, b = (6_395_000.1, 150_000.2), (6_395_010.7, 150_007.9)
    px = 6_395_004.3
    py = a[1] + (px - a[0]) * (b[1] - a[1]) / (b[0] - a[0])
    texts, want = {}, {}
    for k in range(-3, 4):
        y = py
        for _ in range(abs(k)):
            y = float(np.nextafter(y, np.inf if k > 0 else -np.inf))
        texts[k] = f"POLYGON(({a[0]!r} {a[1]!r}, {b[0]!r} 150000.0, {b[0]!r} {b[1]!r}, {a[0]!r} {a[1]!r}), ({px!r} {y!r}, {px!r} 150002.0, {px + 1!r} 150002.0, {px!r} {y!r}))"
        want[k] = "rings_cross" if exact_side(*a, *b, px, y) > 0 else None
    assert len(set(want.values())) == 2
    assert {k: r.reason_code in ("rings_cross", "hole_outside_shell") for k, r in verdicts(spark, {str(k): v for k, v in texts.items()}).items()} == {str(k): v is not None for k, v in want.items()}


def test_ring_on_itself_leaves_one_row(spark):
    """A ring that runs along the same line over and over: many conflicting pairs, one stored row."""
    rows = [(1, 1, 1, i + 1, float(i % 2), 0.0) for i in range(301)]
    vertices = spark.createDataFrame(rows, "feature_id long, part int, ring int, idx int, x double, y double")
    features = spark.createDataFrame([(1, "POLYGON")], "feature_id long, geom_type string")
    met = geometry.meetings(geometry.polygon_segments(features, vertices)).collect()
    assert [(r.i, r.i2) for r in met] == [(1, 2)]
    assert geometry.ring_self_intersections(features, vertices).collect() == [(1, 1, 1, 1, 2)]


def test_checks_by_member(spark):
    texts = {k: CASES[k][0] for k in ("collection with a bowtie", "collection with repeats", "collection with a multipolygon", "arc", "collection with an arc", "straight compound curve")}
    features, vertices = explode_wkt(spark.createDataFrame(list(texts.items()), "name string, geom string"), "name", "geom")
    assert {(r.feature_id, r.part) for r in geometry.ring_self_intersections(features, vertices).collect()} == {("collection with a bowtie", 2)}
    assert {(r.feature_id, r.part, r.first_idx) for r in geometry.repeated_points(features, vertices).collect()} == {("collection with repeats", 4, 2)}
    assert set(map(tuple, geometry.hole_and_part_checks(features, vertices).collect())) == {("collection with a multipolygon", "parts_overlap")}
    assert {r.feature_id for r in geometry.has_arc(features, vertices).collect()} == {"arc", "collection with an arc"}


def inside(p, ring):
    """1 inside, 0 on, -1 outside of a closed ring of whole-number points."""
    odd = False
    for (x, y), (x2, y2) in zip(ring, ring[1:]):
        s = (x2 - x) * (p[1] - y) - (p[0] - x) * (y2 - y)
        if s == 0 and min(x, x2) <= p[0] <= max(x, x2) and min(y, y2) <= p[1] <= max(y, y2):
            return 0
        if (y > p[1]) != (y2 > p[1]) and (s > 0) == (y2 > y):
            odd = not odd
    return 1 if odd else -1


def comb(teeth, height=1000, x0=0):
    """A closed ring: a bar with upright teeth and gaps of one unit each."""
    top = [(x0 + 2 * teeth, 0)]
    for k in range(teeth - 1, -1, -1):
        top += [(x0 + 2 * k + 1, height), (x0 + 2 * k, height), (x0 + 2 * k, 1), (x0 + 2 * k - 1, 1)]
    return [(x0 - 1, 0), *top, (x0 - 1, 0)]


@pytest.mark.parametrize("seed", range(4))
def test_placement_in_cells_against_brute_force(spark, monkeypatch, seed):
    """Large star-shaped and comb-shaped parts with triangles anywhere in and around them, corners of the grid included."""
    monkeypatch.setattr(geometry, "CELL", [1, 2, 4, 16][seed])
    rng = np.random.default_rng(seed)
    angle = np.linspace(0, 2 * np.pi, 80, endpoint=False)
    radius = rng.integers(30, 100, 80)
    shell = [tuple(map(int, p)) for p in np.round(np.c_[np.cos(angle), np.sin(angle)] * radius[:, None])]
    shells = {1: [*shell, shell[0]], 2: comb(40, 60, 200), 3: [(y, x) for x, y in comb(40, 60, 300)]}
    rings = {(p, 1): r for p, r in shells.items()}
    for part, (low, high) in {1: (-110, 110), 2: (195, 290), 3: (-20, 400)}.items():
        for k in range(2, 40):
            x, y = rng.integers(low, high), rng.integers(-110, 110) if part == 1 else rng.integers(-5, 70)
            x, y = (y, x) if part == 3 else (x, y)
            a = [(x, y), (x + rng.integers(1, 3), y), (x, y + rng.integers(1, 3))]
            rings[part, k] = [tuple(map(int, q)) for q in [*a, a[0]]]
    rows = [(1, p, r, i + 1, float(x), float(y)) for (p, r), pts in rings.items() for i, (x, y) in enumerate(pts)]
    vertices = spark.createDataFrame(rows, "feature_id long, part int, ring int, idx int, x double, y double")
    features = spark.createDataFrame([(1, "MULTIPOLYGON")], "feature_id long, geom_type string")
    found = {(r.part, r.ring, r.reason_code, r.part2) for r in geometry.misplaced_vertices(geometry.polygon_segments(features, vertices)).collect()}
    want = set()
    for (p, r), pts in rings.items():
        for q in pts[:-1]:
            if r > 1 and inside(q, rings[p, 1]) < 0:
                want.add((p, r, "hole_outside_shell", p))
            for t in shells:
                others = [inside(q, ring) for (part, k), ring in rings.items() if part == t and (part, k) != (p, r)]
                holes = [inside(q, ring) for (part, k), ring in rings.items() if part == t == p and k > 1 and k != r]
                if t != p and 0 not in others and others.count(1) % 2:
                    want.add((p, r, "parts_overlap", t))
                if t == p and r > 1 and 0 not in holes and holes.count(1) % 2:
                    want.add((p, r, "holes_nested", p))
    assert {f for f in found if f in want} == want
    assert len(want) > 20 and len({w[2] for w in want}) >= 2
    # What else is found comes from the middles of segments whose ends both touch.
    assert all(geometry.REASONS[f[2]] for f in found - want) and len(found - want) <= 0.2 * len(want)


def test_comb_stays_linear(spark):
    """Rows of the cell and crossing tables of a comb grow with its teeth, not with their square."""
    from pyspark.sql import functions as F

    sizes = []
    for teeth in (2_000, 4_000):
        pts = comb(teeth)
        hole = [(2, 100), (2.5, 100), (2.25, 200), (2, 100)]
        rows = [(1, 1, r, i + 1, float(x), float(y)) for r, ring in ((1, pts), (2, hole)) for i, (x, y) in enumerate(ring)]
        vertices = spark.createDataFrame(rows, "feature_id long, part int, ring int, idx int, x double, y double")
        segments = geometry.polygon_segments(spark.createDataFrame([(1, "POLYGON")], "feature_id long, geom_type string"), vertices)
        grids = geometry.part_grids(segments.filter("several"))
        walls = segments.join(grids, ["feature_id", "part"]).withColumnsRenamed({"part": "t_part", "ring": "t_ring"})
        cells = geometry._wall_cells(walls)
        sizes.append((cells.count(), geometry._corner_crossings(walls).count(), cells.groupBy("cx", "cy").count().agg(F.max("count")).first()[0]))
        assert geometry.misplaced_vertices(segments).collect() == []
    (a, b, most), (a2, b2, most2) = sizes
    assert a < 4 * 8_000 and a2 < 2.2 * a and b2 <= 2.2 * b and most2 <= max(most, 40)


def test_features_are_not_broadcast(spark, monkeypatch):
    """Stored feature keys look small on disk; joined by broadcast, all of them would pass through the driver."""
    features = spark.range(200_000).select(F.col("id").alias("feature_id"), F.lit("POLYGON").alias("geom_type"))
    vertices = spark.range(5_000_000).select(  # planned, never run
        F.floor(F.col("id") / 5).alias("feature_id"), F.lit(1).alias("part"), F.lit(1).alias("ring"), (F.col("id") % 5 + 1).cast("int").alias("idx"),
        (F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"),
    )
    monkeypatch.setattr(geometry, "materialize", lambda df, label: df)
    for df in (geometry.polygon_segments(features, vertices), geometry.ring_problems(features, vertices)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_segments_and_their_sides_are_shuffled_once(spark, monkeypatch, tmp_path):
    """The wide rows, vertices by ring piece and segments by feature, cross the network once, however often they are read."""
    monkeypatch.setattr(geometry, "materialize", lambda df, label: df)
    rows = [(f, p, 1, i + 1, float(x), float(y)) for f in range(9) for p in (1, 2) for i, (x, y) in enumerate([(0, 0), (9, p), (9, 9), (0, 0)])]
    spark.createDataFrame(rows, "feature_id long, part int, ring int, idx int, x double, y double").write.parquet(f"{tmp_path}/vertices")
    spark.range(9).select(F.col("id").alias("feature_id"), F.lit("MULTIPOLYGON").alias("geom_type")).write.parquet(f"{tmp_path}/features")
    features, vertices = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("features", "vertices"))
    adaptive, broadcast = "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"
    before = {c: spark.conf.get(c) for c in (adaptive, broadcast)}
    try:
        spark.conf.set(adaptive, "false")
        spark.conf.set(broadcast, "-1")
        segments = geometry.polygon_segments(features, vertices)
        segments.write.parquet(f"{tmp_path}/segments")
        stored = spark.read.parquet(f"{tmp_path}/segments")
        few = stored.filter("m <= 64")  # the features that are one cell
        pairs = geometry.judged_pairs(few)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (segments, pairs)]
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
    made = [[x for x in plan.splitlines() if "+- Exchange hashpartitioning" in x] for plan in plans]
    # By ring piece: the vertices, and the facts that are joined to their segments. By feature: one side, which is the other one as well.
    assert len([x for x in made[0] if "piece" in x]) == 2
    assert len(made[1]) == 1 and "ReusedExchange" in plans[1]


def test_parts_that_nothing_lies_in_are_not_paired(spark):
    """A part of one ring away from all others is tested against nothing; holes and overlapping boxes are. Extents come with grids only."""
    square = lambda f, p, r, x, w: [(f, p, r, i + 1, x + a * w, b * w) for i, (a, b) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)])]
    rows = [
        *square(1, 1, 1, 0.0, 4.0), *square(1, 2, 1, 50.0, 4.0), *square(1, 3, 1, 51.0, 9.0),
        *square(2, 1, 1, 0.0, 9.0), *square(2, 1, 2, 1.0, 2.0), *square(2, 2, 1, 50.0, 4.0),
        *(v for p in range(1, 18) for v in square(3, p, 1, 50.0 * p, 4.0)),
    ]
    vertices = spark.createDataFrame(rows, "feature_id long, part int, ring int, idx int, x double, y double")
    features = spark.createDataFrame([(f, "MULTIPOLYGON") for f in (1, 2, 3)], "feature_id long, geom_type string")
    segments = geometry.polygon_segments(features, vertices)
    extents = {(r.feature_id, r.m, r.fx0, r.fx1) for r in segments.collect()}
    assert extents == {(1, 12, None, None), (2, 12, None, None), (3, 68, 50.0, 854.0)}
    pairs = geometry._overlapping_parts(geometry.part_grids(segments.filter("several")))
    assert sorted((r.feature_id, r.part, r.t_part) for r in pairs.collect()) == [(1, 2, 3), (1, 3, 2), (2, 1, 1)]


def test_shared_view_is_worked_out_once(spark, tmp_path):
    """Stored views read the stored base of the vertices, not the line items again, and hold the same rows."""
    spark.range(1).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(4).selectExpr(
        "id AS o_orderkey", "'F' AS o_orderstatus", "'1-URGENT' AS o_orderpriority", "30000.0D AS o_totalprice"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(12).selectExpr(
        "id % 3 AS l_orderkey", "id AS l_linenumber", "id AS l_partkey", "id AS l_suppkey", "id * 1.5D AS l_extendedprice",
        "id * id * 1.0D AS l_quantity", "0.1D AS l_discount", "0.1D AS l_tax", "DATE'2024-01-01' AS l_shipdate",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    fx, fresh = Inputs(spark, str(tmp_path)), Inputs(spark, str(tmp_path))
    names = ("geom_features", "geom_vertices")
    want = {n: sorted(map(tuple, fresh[n].collect()), key=repr) for n in names}
    assert {n: sorted(map(tuple, fx.stored(n).collect()), key=repr) for n in names} == want and len(want["geom_vertices"]) > 12
    assert "lineitem" not in Inputs.__getitem__(fx, "geom_vertices")._jdf.queryExecution().executedPlan().toString()


def test_texts_of_one_task_are_parsed_in_many(spark):
    """Rows that come in one task, as from a small file, are parsed in slices; repeated and missing ids do not mix texts."""
    from pyspark.sql import functions as F

    flat = spark.range(0, 60_000, 1, 1).select("id", F.format_string("POINT(%d 1)", "id").alias("geom"))
    _, vertices = explode_wkt(flat, "id", "geom")
    assert len(vertices.inputFiles()) >= 3
    curves = spark.range(0, 60_000, 1, 1).select("id", F.format_string("GEOMETRYCOLLECTION(POINT(%d 1), COMPOUNDCURVE((0 0, 1 1), (1 1, 2 2)))", "id").alias("geom"))
    _, vertices = explode_wkt(curves, "id", "geom")
    assert len([f for f in vertices.inputFiles() if "/wkt-lists-" in f]) >= 3
    assert vertices.count() == 4 * 60_000
    text = "GEOMETRYCOLLECTION(POLYGON((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1)), MULTISURFACE(((9 0, 10 0, 10 1, 9 0), (7 7, 8 7, 8 8, 7 7))))"
    features, vertices = explode_wkt(spark.createDataFrame([(1, text), (None, text)], "id long, geom string"), "id", "geom")
    assert {(r.feature_id, r.parse_error) for r in features.collect()} == {(1, None), (None, None)}
    found = {(r.feature_id, r.member, r.part, r.ring) for r in vertices.collect()}
    assert found == {(1, 1, 1, 1), (1, 1, 1, 2), (1, 2, 2, 1), (1, 2, 2, 2)}
