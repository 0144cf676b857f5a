"""Catalogue: sources, sinks and format adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablekeep.operators import geometry
from tablekeep.plans.catalog import query
from tablekeep.session import materialize, scratch_path
from tablekeep.sources import inventory, tables, text, wkt

# One geometry text per order: a = order key, b = customer key.
TEXTS = """SELECT o_orderkey AS fid, CASE o_orderkey % 9
  WHEN 0 THEN concat('POINT(', a, ' ', b, ')')
  WHEN 1 THEN concat('SRID=3007;LINESTRING (', a, ' ', b, ', ', b, ' ', a, ',0 0)')
  WHEN 2 THEN concat('POLYGON((0 0, ', a, ' 0, ', a, ' ', b, ', 0 0), (1 1, 2 1, 2 ', b, ', 1 1))')
  WHEN 3 THEN concat('MULTIPOINT((', a, ' ', b, '), (', b, ' 0))')
  WHEN 4 THEN concat('MULTIPOLYGON(((0 0, 1 0, 1 ', b, ', 0 0)), ((5 5, 6 5, 6 6, 5 5), (7 7, 8 7, 8 ', a, ', 7 7)))')
  WHEN 5 THEN 'MULTILINESTRING EMPTY'
  WHEN 6 THEN concat('LINESTRING Z(', a, ' 1 2, ', b, ' 3 4.5)')
  WHEN 7 THEN concat('POINT(', a, ' x)')
  ELSE CASE WHEN o_orderstatus = 'F' THEN NULL ELSE concat('hello ', b) END END AS geom
FROM (SELECT o_orderkey, o_orderstatus, CAST(o_orderkey AS STRING) AS a, CAST(o_custkey AS STRING) AS b FROM orders) q"""


@query("g01_explode_wkt_features", """
SELECT o_orderkey AS feature_id, CASE o_orderkey % 9 WHEN 0 THEN 'POINT' WHEN 1 THEN 'LINESTRING' WHEN 2 THEN 'POLYGON' WHEN 3 THEN 'MULTIPOINT'
    WHEN 4 THEN 'MULTIPOLYGON' WHEN 5 THEN 'MULTILINESTRING' WHEN 6 THEN 'LINESTRING' END AS geom_type,
  CASE WHEN o_orderkey % 9 = 1 THEN 3007 WHEN o_orderkey % 9 < 7 THEN 0 END AS srid,
  CASE WHEN o_orderkey % 9 = 6 THEN 3 WHEN o_orderkey % 9 < 7 THEN 2 END AS coord_dim,
  CASE o_orderkey % 9 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 8 WHEN 3 THEN 2 WHEN 4 THEN 12 WHEN 5 THEN 0 WHEN 6 THEN 2 END AS n_points,
  CASE WHEN o_orderkey % 9 < 7 THEN o_orderkey % 9 = 5 END AS is_empty,
  CASE WHEN o_orderkey % 9 = 7 THEN 'bad_coordinate' WHEN o_orderkey % 9 = 8 AND o_orderstatus <> 'F' THEN 'not_wkt' END AS parse_error
FROM orders
""")
def _(fx):
    return wkt.explode_wkt(fx.sql(TEXTS), "fid", "geom")[0]


@query("g01_explode_wkt_vertices", """
WITH o AS (SELECT o_orderkey AS f, o_orderkey % 9 AS k, CAST(o_orderkey AS DOUBLE) AS a, CAST(o_custkey AS DOUBLE) AS b FROM orders),
v AS (
SELECT f, 1 AS part, 1 AS ring, 1 AS idx, a AS x, b AS y, NULL AS z FROM o WHERE k = 0
UNION ALL SELECT f, 1, 1, t.i, CASE t.i WHEN 1 THEN a WHEN 2 THEN b ELSE 0 END, CASE t.i WHEN 1 THEN b WHEN 2 THEN a ELSE 0 END, NULL FROM o, unnest([1, 2, 3]) AS t(i) WHERE k = 1
UNION ALL SELECT f, 1, 1, t.i, CASE WHEN t.i IN (2, 3) THEN a ELSE 0 END, CASE t.i WHEN 3 THEN b ELSE 0 END, NULL FROM o, unnest([1, 2, 3, 4]) AS t(i) WHERE k = 2
UNION ALL SELECT f, 1, 2, t.i, CASE WHEN t.i IN (2, 3) THEN 2 ELSE 1 END, CASE t.i WHEN 3 THEN b ELSE 1 END, NULL FROM o, unnest([1, 2, 3, 4]) AS t(i) WHERE k = 2
UNION ALL SELECT f, t.i, 1, 1, CASE t.i WHEN 1 THEN a ELSE b END, CASE t.i WHEN 1 THEN b ELSE 0 END, NULL FROM o, unnest([1, 2]) AS t(i) WHERE k = 3
UNION ALL SELECT f, 1, 1, t.i, CASE WHEN t.i IN (2, 3) THEN 1 ELSE 0 END, CASE t.i WHEN 3 THEN b ELSE 0 END, NULL FROM o, unnest([1, 2, 3, 4]) AS t(i) WHERE k = 4
UNION ALL SELECT f, 2, 1, t.i, CASE WHEN t.i IN (2, 3) THEN 6 ELSE 5 END, CASE t.i WHEN 3 THEN 6 ELSE 5 END, NULL FROM o, unnest([1, 2, 3, 4]) AS t(i) WHERE k = 4
UNION ALL SELECT f, 2, 2, t.i, CASE WHEN t.i IN (2, 3) THEN 8 ELSE 7 END, CASE t.i WHEN 3 THEN a ELSE 7 END, NULL FROM o, unnest([1, 2, 3, 4]) AS t(i) WHERE k = 4
UNION ALL SELECT f, 1, 1, t.i, CASE t.i WHEN 1 THEN a ELSE b END, CASE t.i WHEN 1 THEN 1 ELSE 3 END, CASE t.i WHEN 1 THEN 2 ELSE 4.5 END FROM o, unnest([1, 2]) AS t(i) WHERE k = 6)
SELECT f AS feature_id, part, ring, idx, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, CAST(NULL AS DOUBLE) AS m FROM v
""")
def _(fx):
    return wkt.explode_wkt(fx.sql(TEXTS), "fid", "geom")[1].drop("member", "member_type")


# One collection or curve per order: a = order key, b = customer key, both raised by one, so above 0.
NESTED = """SELECT o_orderkey AS fid, CASE o_orderkey % 11
  WHEN 0 THEN concat('GEOMETRYCOLLECTION(POINT(', a, ' ', b, '), POLYGON((0 0, 2 2, 2 0, 0 2, 0 0)))')
  WHEN 1 THEN concat('GEOMETRYCOLLECTION(POINT(', a, ' ', b, '), POLYGON((0 0, ', a, ' 0, ', a, ' 1, 0 0)), POLYGON((0 0, ', a, ' 0, ', a, ' 1, 0 0)))')
  WHEN 2 THEN concat('COMPOUNDCURVE((0 0, 1 ', a, '), (1 ', a, ', 2 ', b, '))')
  WHEN 3 THEN concat('COMPOUNDCURVE((0 0, 1 ', a, '), CIRCULARSTRING(1 ', a, ', 2 5, 3 0))')
  WHEN 4 THEN concat('CURVEPOLYGON(COMPOUNDCURVE((0 0, ', a, ' 0), (', a, ' 0, ', a, ' 9, 0 0)), (-1 1, -2 1, -2 ', b, ', -1 1))')
  WHEN 5 THEN concat('MULTISURFACE(((0 0, ', a, ' 0, ', a, ' ', a, ', 0 0)), CURVEPOLYGON((-9 0, -8 0, -8 ', b, ', -9 0)))')
  WHEN 6 THEN concat('GEOMETRYCOLLECTION(GEOMETRYCOLLECTION(LINESTRING(0 0, ', a, ' 0, ', a, ' 0, 1 1)), MULTIPOINT(1 1, 1 1), POINT EMPTY)')
  WHEN 7 THEN 'GEOMETRYCOLLECTION(POINT EMPTY, GEOMETRYCOLLECTION(POLYGON EMPTY))'
  WHEN 8 THEN concat('GEOMETRYCOLLECTION(POINT(', a, ' 1), CIRCULARSTRING(0 0, 1 1, ', b, ' 0))')
  WHEN 9 THEN concat('GEOMETRYCOLLECTION(POINT(', a, ' 1)')
  ELSE concat('COMPOUNDCURVE((0 0, 1 1), (2 2, 3 ', a, '))') END AS geom
FROM (SELECT o_orderkey, CAST(o_orderkey + 1 AS STRING) AS a, CAST(o_custkey + 1 AS STRING) AS b FROM orders) q"""


@query("g01_explode_wkt_members", """
WITH o AS (SELECT o_orderkey AS f, o_orderkey % 11 AS k, CAST(o_orderkey + 1 AS DOUBLE) AS a, CAST(o_custkey + 1 AS DOUBLE) AS b FROM orders),
t AS (SELECT * FROM (VALUES
  (0, 1, 'POINT', 1, 1, 'a b'), (0, 2, 'POLYGON', 2, 1, '0 0,2 2,2 0,0 2,0 0'),
  (1, 1, 'POINT', 1, 1, 'a b'), (1, 2, 'POLYGON', 2, 1, '0 0,a 0,a 1,0 0'), (1, 3, 'POLYGON', 3, 1, '0 0,a 0,a 1,0 0'),
  (2, 1, 'LINESTRING', 1, 1, '0 0,1 a,2 b'), (3, 1, 'COMPOUNDCURVE', 1, 1, '0 0,1 a,2 5,3 0'),
  (4, 1, 'POLYGON', 1, 1, '0 0,a 0,a 9,0 0'), (4, 1, 'POLYGON', 1, 2, '-1 1,-2 1,-2 b,-1 1'),
  (5, 1, 'MULTIPOLYGON', 1, 1, '0 0,a 0,a a,0 0'), (5, 1, 'MULTIPOLYGON', 2, 1, '-9 0,-8 0,-8 b,-9 0'),
  (6, 1, 'LINESTRING', 1, 1, '0 0,a 0,a 0,1 1'), (6, 2, 'MULTIPOINT', 2, 1, '1 1'), (6, 2, 'MULTIPOINT', 3, 1, '1 1'),
  (8, 1, 'POINT', 1, 1, 'a 1'), (8, 2, 'CIRCULARSTRING', 2, 1, '0 0,1 1,b 0')) AS v(k, member, member_type, part, ring, pts)),
p AS (SELECT k, member, member_type, part, ring, unnest(string_split(pts, ',')) AS p, generate_subscripts(string_split(pts, ','), 1) AS idx FROM t)
SELECT f AS feature_id, member, member_type, part, ring, idx,
  CASE split_part(p, ' ', 1) WHEN 'a' THEN a WHEN 'b' THEN b ELSE CAST(split_part(p, ' ', 1) AS DOUBLE) END AS x,
  CASE split_part(p, ' ', 2) WHEN 'a' THEN a WHEN 'b' THEN b ELSE CAST(split_part(p, ' ', 2) AS DOUBLE) END AS y
FROM o JOIN p ON p.k = o.k
""")
def _(fx):
    return wkt.explode_wkt(fx.sql(NESTED), "fid", "geom")[1].drop("z", "m")


@query("g08_explain_members", """
SELECT o_orderkey AS feature_id, CASE o_orderkey % 11 WHEN 0 THEN 'ring_self_intersection' WHEN 3 THEN 'arc' WHEN 4 THEN 'hole_outside_shell'
    WHEN 6 THEN 'repeated_points' WHEN 7 THEN 'empty' WHEN 8 THEN 'arc' END AS reason_code,
  CASE o_orderkey % 11 WHEN 0 THEN 'part 2 ring 1 segment 1 and part 2 ring 1 segment 3' WHEN 3 THEN 'COMPOUNDCURVE' WHEN 4 THEN 'part 1 ring 2 against part 1'
    WHEN 6 THEN 'part 1 ring 1 point 2' WHEN 8 THEN 'CIRCULARSTRING' END AS detail
FROM orders
""")
def _(fx):
    features, vertices = (materialize(df, "nested-texts") for df in wkt.explode_wkt(fx.sql(NESTED), "fid", "geom"))
    return geometry.explain_geometry(features, vertices)


@query("g04_has_arc_members", """
SELECT o_orderkey AS feature_id, CASE o_orderkey % 11 WHEN 3 THEN 'COMPOUNDCURVE' ELSE 'GEOMETRYCOLLECTION' END AS geom_type
FROM orders WHERE o_orderkey % 11 IN (3, 8)
""")
def _(fx):
    features, vertices = wkt.explode_wkt(fx.sql(NESTED), "fid", "geom")
    return geometry.has_arc(features, vertices)


@query("g01_assemble_wkt", """
SELECT f.feature_id, CASE WHEN f.geom_type = 'CIRCULARSTRING' THEN NULL WHEN v.t IS NULL THEN concat(f.geom_type, ' EMPTY')
  WHEN f.geom_type = 'POLYGON' THEN concat('POLYGON((', v.t, '))') ELSE concat(f.geom_type, '(', v.t, ')') END AS wkt
FROM geom_features f LEFT JOIN (SELECT feature_id, string_agg(concat(x, ' ', y), ', ' ORDER BY idx) AS t FROM geom_vertices GROUP BY 1) v ON v.feature_id = f.feature_id
""")
def _(fx):
    return wkt.assemble_wkt(fx.stored("geom_features"), fx.stored("geom_vertices"))


@query("s02_read_inventory", "SELECT table_id, schema_name, table_name, column_name, ordinal_position, data_type FROM inv_columns")
def _(fx):
    columns = fx["inv_columns"].select("table_id", "schema_name", "table_name", "column_name", "ordinal_position", "data_type")
    return inventory.stored(columns, "inv_columns")


@query("s04_write_history", "SELECT *, CAST(h_ts AS DATE) AS h_date FROM history_rows")
def _(fx):
    path = scratch_path(fx.spark, "history")
    tables.write_history(fx["history_rows"], path, ["gid"])
    return tables.read_history(fx.spark, path)


@query("s06_write_register", """
SELECT schema_name, table_name, 2 AS srid FROM inv_tables WHERE kind = 'LARGE'
UNION ALL SELECT schema_name, table_name, 1 FROM inv_tables WHERE kind = 'SMALL'
""")
def _(fx):
    path = scratch_path(fx.spark, "register")
    base = fx["inv_tables"].select("schema_name", "table_name", "kind")
    key = ["schema_name", "table_name"]
    first = base.filter("kind IN ('LARGE', 'SMALL')").select(*key, F.lit(1).alias("srid"))
    tables.write_register(first, path, key)
    tables.write_register(base.filter("kind = 'LARGE'").select(*key, F.lit(2).alias("srid")), path, key)
    return tables.read_register(fx.spark, path)


@query("s07_decode_text", "SELECT doc_id, text AS raw_text, regexp_matches(text, '^[\\x00-\\x7F]*$') AS raw_was_utf8 FROM documents")
def _(fx):
    # Only characters windows-1252 has survive the trip through it, so the check is an identity.
    legacy = fx.table("documents").select("doc_id", F.encode("text", "ISO-8859-1").alias("raw"))
    return text.decode_text(legacy, "raw").drop("raw")
