"""Inputs of the catalogue: views derived by plain SQL from the given tables.

The same text runs on Spark and on the checking engine, so an operator's input is identical on
both sides while its expected output is written separately. Every view spans its whole source
table. Where the two dialects differ in how a row is repeated, the text holds ``{REPEAT5}``.
"""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession

from tablekeep.session import materialize_tidy

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

# ---------------------------------------------------------------- inventory snapshots
VIEWS["inv_tables"] = """
SELECT CAST(p_partkey AS BIGINT) AS table_id,
  CASE p_partkey % 16
    WHEN 0 THEN 'public' WHEN 1 THEN 'pg_temp_3' WHEN 2 THEN 'sk3_ext_old'
    WHEN 3 THEN 'sk0_foo_bar' WHEN 4 THEN 'sk0_ext_xkbay' WHEN 5 THEN 'sk0extpartial'
    ELSE concat(CASE p_partkey % 4 WHEN 0 THEN 'sk0' WHEN 1 THEN 'sk1' WHEN 2 THEN 'sk2' ELSE 'skx' END, '_',
                CASE p_size % 3 WHEN 0 THEN 'ext' WHEN 1 THEN 'kba' ELSE 'sys' END, '_',
                lower(replace(p_brand, '#', ''))) END AS schema_name,
  concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey AS STRING),
         CASE WHEN p_partkey % 29 = 0 THEN repeat('x', 50) ELSE '' END,
         CASE p_size % 7 WHEN 0 THEN '_p' WHEN 1 THEN '_l' WHEN 2 THEN '_y' WHEN 3 THEN '_g'
                         WHEN 4 THEN '' WHEN 5 THEN 'ap' ELSE '_h' END) AS table_name,
  p_type AS kind, p_size AS size_class
FROM part
"""
VIEWS["inv_schemas"] = "SELECT DISTINCT schema_name FROM inv_tables"
VIEWS["inv_all_tables"] = """
SELECT table_id, schema_name, table_name FROM inv_tables
UNION ALL
SELECT table_id + 1000000000000 AS table_id, schema_name, concat(table_name, '_h') AS table_name
FROM inv_tables WHERE kind IN ('PROMO', 'LARGE', 'SMALL')
"""
VIEWS["inv_geometry"] = """
SELECT table_id, schema_name, table_name,
  CASE WHEN table_id % 23 = 0 THEN 'the_geom' ELSE 'geom' END AS geometry_column,
  CASE table_id % 9 WHEN 0 THEN 'POINT' WHEN 1 THEN 'MULTIPOINT' WHEN 2 THEN 'LINESTRING'
    WHEN 3 THEN 'MULTILINESTRING' WHEN 4 THEN 'POLYGON' WHEN 5 THEN 'MULTIPOLYGON'
    WHEN 6 THEN 'POINTM' WHEN 7 THEN 'GEOMETRY' ELSE 'CIRCULARSTRING' END AS type,
  CASE WHEN table_id % 9 = 6 THEN 3 ELSE CAST(2 + table_id % 3 AS INT) END AS coord_dimension,
  CASE table_id % 4 WHEN 0 THEN 3006 WHEN 1 THEN 4326 ELSE 3007 END AS srid
FROM inv_tables WHERE kind <> 'ECONOMY'
UNION ALL
SELECT table_id, schema_name, table_name, 'geom2', 'POINT', 2, 3007
FROM inv_tables WHERE kind <> 'ECONOMY' AND size_class = 31
"""
VIEWS["inv_columns"] = """
SELECT t.table_id, t.schema_name, t.table_name, c.column_name, c.ordinal_position,
  CASE c.ordinal_position % 4 WHEN 0 THEN 'integer' WHEN 1 THEN 'text' WHEN 2 THEN 'numeric'
       ELSE 'character varying' END AS data_type,
  CASE WHEN c.ordinal_position % 4 = 3 AND t.size_class > 25 THEN 100 + t.size_class END AS max_length,
  CASE WHEN c.ordinal_position % 4 = 2 AND t.size_class > 10 THEN 12 END AS numeric_precision,
  CASE WHEN c.ordinal_position % 4 = 2 AND t.size_class > 10 THEN 3 END AS numeric_scale,
  CASE WHEN c.ordinal_position % 4 = 1 AND t.size_class > 40 THEN 'sv_SE' END AS collation_name,
  (t.size_class = 41 AND c.ordinal_position = 4) AS is_identity
FROM inv_tables t
JOIN (SELECT DISTINCT l_partkey, CAST(l_linenumber AS INT) AS ordinal_position,
        CASE WHEN l_linenumber = 6 AND l_partkey % 6 = 0 THEN 'skapad_av'
             WHEN l_linenumber = 7 AND l_partkey % 10 = 0 THEN 'gid'
             WHEN l_linenumber = 3 AND l_partkey % 37 = 0 THEN 'kol_temp0001'
             WHEN l_linenumber = 5 AND l_partkey % 12 = 0 THEN 'select'
             ELSE concat('kol_', CAST(l_linenumber AS STRING)) END AS column_name
      FROM lineitem) c ON c.l_partkey = t.table_id
"""
VIEWS["inv_views"] = """
SELECT t.schema_name,
  concat(CASE s.s_suppkey % 5 WHEN 0 THEN 'x_' WHEN 1 THEN 'vy' ELSE 'v_' END, t.table_name) AS view_name,
  t.table_id AS base_table_id,
  CASE s.s_suppkey % 3 WHEN 0 THEN 'SELECT gid, ST_Buffer (geom, 10) AS geom FROM t'
       ELSE 'SELECT * FROM t' END AS definition
FROM supplier s JOIN inv_tables t ON t.table_id = s.s_suppkey
"""
VIEWS["view_geometry"] = """
SELECT v.schema_name, v.view_name AS table_name, g.geometry_column, g.type
FROM inv_views v JOIN inv_geometry g ON g.table_id = v.base_table_id
"""
# A laid-out inventory: tables as they would look after conforming, with drift seeded in.
VIEWS["laid_out_columns"] = """
SELECT table_id, schema_name, table_name, column_name, pos AS ordinal_position FROM (
  SELECT table_id, schema_name, table_name, 'gid' AS column_name,
    CASE WHEN size_class = 17 THEN 3 ELSE 1 END AS pos FROM inv_tables
  UNION ALL
  SELECT table_id, schema_name, table_name, column_name,
    CASE WHEN size_class = 17 AND k = 3 THEN 1 ELSE k END FROM (
      SELECT c.table_id, c.schema_name, c.table_name, c.column_name, t.size_class,
        CAST(1 + row_number() OVER (PARTITION BY c.table_id ORDER BY c.ordinal_position) AS INT) AS k
      FROM inv_columns c JOIN inv_tables t ON t.table_id = c.table_id
      WHERE c.column_name NOT IN ('gid', 'skapad_av')) u
  UNION ALL
  SELECT table_id, schema_name, table_name, 'skapad_tidpunkt', 20 FROM inv_tables WHERE size_class <> 9
  UNION ALL
  SELECT table_id, schema_name, table_name, 'skapad_av', 21 FROM inv_tables WHERE schema_name LIKE '%_kba_%'
  UNION ALL
  SELECT table_id, schema_name, table_name, 'andrad_tidpunkt', 22 FROM inv_tables WHERE schema_name LIKE '%_kba_%'
  UNION ALL
  SELECT table_id, schema_name, table_name, 'andrad_av', 23 FROM inv_tables
  WHERE schema_name LIKE '%_kba_%' OR size_class = 12
  UNION ALL
  SELECT table_id, schema_name, table_name, 'geom', CASE WHEN size_class = 5 THEN 19 ELSE 24 END
  FROM inv_tables WHERE kind <> 'ECONOMY') q
"""
VIEWS["inv_constraints"] = """
SELECT table_id, schema_name, table_name, concat(table_name, '_pk') AS constraint_name, 'p' AS contype,
  '1' AS conkey, 'PRIMARY KEY (kol_1)' AS definition FROM inv_tables
UNION ALL
SELECT table_id, schema_name, table_name, concat(table_name, '_uq'), 'u', '2,3', 'UNIQUE (kol_2, kol_3)'
FROM inv_tables WHERE kind IN ('PROMO', 'LARGE')
UNION ALL
SELECT table_id, schema_name, table_name, concat(table_name, '_c1'), 'c', '4', 'CHECK (kol_4 > 0)'
FROM inv_tables WHERE kind <> 'SMALL'
UNION ALL
SELECT table_id, schema_name, table_name, concat(table_name, '_c2'), 'c', '4,5', 'CHECK (kol_4 < 9; kol_5 > 1)'
FROM inv_tables WHERE kind = 'MEDIUM'
UNION ALL
SELECT table_id, schema_name, table_name, concat(table_name, '_c3'), 'c', '4,4', 'CHECK (kol_4 > 1 OR kol_4 < 0)'
FROM inv_tables WHERE kind = 'ECONOMY'
UNION ALL
SELECT table_id, schema_name, table_name, concat(table_name, '_c4'), 'c', '12,2,10,2', 'CHECK (kol_12 > kol_2 + kol_10)'
FROM inv_tables WHERE kind = 'PROMO'
UNION ALL
SELECT table_id, schema_name, table_name, concat(table_name, '_uq2'), 'u', '10,2', 'UNIQUE (kol_10, kol_2)'
FROM inv_tables WHERE kind = 'PROMO'
UNION ALL
SELECT table_id, schema_name, table_name, concat(table_name, '_fk'), 'f', '6', 'FOREIGN KEY (kol_6) REFERENCES t(a)'
FROM inv_tables WHERE kind IN ('STANDARD', 'SMALL')
"""
VIEWS["inv_attributes"] = """
SELECT table_id, schema_name, table_name, column_name, ordinal_position,
  (ordinal_position = 1 OR column_name = 'kol_2') AS not_null,
  CASE WHEN column_name IN ('kol_5', 'skapad_av') THEN '42' END AS default_expr,
  CASE WHEN is_identity THEN 'a' WHEN column_name = 'gid' THEN 'd' ELSE '' END AS identity_kind
FROM inv_columns
"""
VIEWS["inv_indexes"] = """
SELECT table_id, schema_name, table_name,
  concat(left(table_name, 50), '_geom_gidx') AS index_name, 'gist' AS method FROM inv_geometry
UNION ALL
SELECT table_id, schema_name, table_name, concat('sidx_', table_name, '_geom'), 'gist'
FROM inv_geometry WHERE type IN ('POLYGON', 'POINTM')
UNION ALL
SELECT table_id, schema_name, table_name, concat(table_name, '_kol'), 'btree' FROM inv_tables
"""
VIEWS["inv_triggers"] = """
SELECT schema_name, table_name, 'force_gid' AS trigger_name FROM inv_tables WHERE kind <> 'SMALL'
UNION ALL
SELECT schema_name, table_name, 'check_geometry' FROM inv_geometry WHERE type <> 'POLYGON'
UNION ALL
SELECT schema_name, table_name, 'drop_placeholder' FROM placeholder_register
UNION ALL
SELECT schema_name, table_name, concat('trg_', table_name, '_qa') FROM inv_tables WHERE kind = 'PROMO'
"""
VIEWS["gid_tables"] = "SELECT schema_name, table_name FROM inv_tables WHERE kind <> 'ECONOMY'"
VIEWS["qa_functions"] = """
SELECT schema_name, concat('trg_fn_', table_name, '_qa') AS function_name
FROM inv_tables WHERE kind IN ('PROMO', 'LARGE')
UNION ALL
SELECT schema_name, concat('trg_fn_', table_name, 'gone_qa') FROM inv_tables WHERE kind = 'SMALL'
"""
VIEWS["history_metadata"] = """
SELECT table_id, schema_name AS parent_schema, table_name AS parent_table, schema_name AS history_schema,
  left(concat(table_name, '_h'), 63) AS history_table
FROM inv_tables WHERE kind IN ('PROMO', 'LARGE', 'SMALL')
"""
VIEWS["inv_history_columns"] = """
SELECT c.schema_name, m.history_table, c.column_name,
  CASE WHEN c.ordinal_position = 4 AND t.size_class < 10 THEN 'bigint' ELSE c.data_type END AS data_type
FROM inv_columns c JOIN inv_tables t ON t.table_id = c.table_id JOIN history_metadata m ON m.table_id = c.table_id
WHERE NOT (c.column_name = 'kol_2' AND t.kind = 'PROMO')
UNION ALL
SELECT history_schema, history_table, 'h_typ', 'character' FROM history_metadata
UNION ALL
SELECT m.history_schema, m.history_table, 'borttagen', 'text'
FROM history_metadata m JOIN inv_tables t ON t.table_id = m.table_id WHERE t.kind = 'LARGE'
"""
VIEWS["placeholder_register"] = """
SELECT schema_name, table_name, CAST(table_id AS BIGINT) AS gid FROM inv_tables WHERE kind = 'LARGE'
UNION ALL
SELECT schema_name, concat(table_name, '_dropped'), CAST(table_id AS BIGINT) FROM inv_tables WHERE kind = 'PROMO'
"""

# ---------------------------------------------------------------- access inventories
VIEWS["inv_roles"] = """
SELECT concat('r_', schema_name) AS role_name, schema_name LIKE 'sk2%' AS can_login FROM inv_schemas
UNION ALL
SELECT concat('w_', schema_name), false FROM inv_schemas WHERE schema_name NOT LIKE '%brand1%'
UNION ALL
SELECT concat('gs_r_', schema_name), true FROM inv_schemas WHERE schema_name NOT LIKE '%brand2%'
UNION ALL
SELECT concat('gs_w_', schema_name), true FROM inv_schemas
UNION ALL
SELECT lower(replace(c_name, '#', '_')), true FROM customer
UNION ALL
SELECT concat('ad_', lower(replace(s_name, '#', '_'))), false FROM supplier
"""
VIEWS["inv_credentials"] = """
SELECT concat('gs_r_', schema_name) AS role_name, true AS can_login FROM inv_schemas WHERE schema_name NOT LIKE 'skx%'
UNION ALL
SELECT concat('gs_w_', schema_name), true FROM inv_schemas
UNION ALL
SELECT concat('r_', schema_name), false FROM inv_schemas
"""
VIEWS["inv_members"] = """
SELECT concat('r_', schema_name) AS group_role, concat('gs_r_', schema_name) AS member FROM inv_schemas
WHERE schema_name NOT LIKE '%sys%'
UNION ALL
SELECT concat('w_', schema_name), concat('gs_w_', schema_name) FROM inv_schemas
UNION ALL
SELECT 'service_accounts', concat('gs_r_', schema_name) FROM inv_schemas WHERE schema_name NOT LIKE '%ext%'
UNION ALL
SELECT 'service_accounts', concat('gs_w_', schema_name) FROM inv_schemas
UNION ALL
SELECT 'service_accounts', concat('r_', schema_name) FROM inv_schemas WHERE schema_name LIKE 'sk2%'
UNION ALL
SELECT 'system_owner', concat('r_', schema_name) FROM inv_schemas WHERE schema_name LIKE 'sk1%'
UNION ALL
SELECT concat('ad_supplier_', lpad(CAST(c_nationkey AS STRING), 9, '0')), lower(replace(c_name, '#', '_')) FROM customer
UNION ALL
SELECT concat('ad_supplier_', lpad(CAST(s_nationkey AS STRING), 9, '0')), concat('ad_', lower(replace(s_name, '#', '_')))
FROM supplier WHERE s_suppkey > s_nationkey
"""
VIEWS["actual_grants"] = """
SELECT concat('r_', schema_name) AS role_name, schema_name, 'schema' AS object_kind, 'USAGE' AS privilege FROM inv_schemas
UNION ALL
SELECT concat('r_', schema_name), schema_name, 'table', 'SELECT' FROM inv_schemas WHERE schema_name NOT LIKE '%brand3%'
UNION ALL
SELECT concat('w_', schema_name), schema_name, 'schema', 'USAGE' FROM inv_schemas
UNION ALL
SELECT concat('w_', schema_name), schema_name, 'table', 'SELECT' FROM inv_schemas
UNION ALL
SELECT concat('r_', schema_name), schema_name, 'table', 'DELETE' FROM inv_schemas WHERE schema_name LIKE 'sk0%'
"""
VIEWS["group_mappings"] = """
SELECT c_custkey AS mapping_id,
  concat('ad_supplier_', lpad(CAST(c_custkey % 137 AS STRING), 9, '0')) AS group_role,
  concat('r_', t.schema_name) AS schema_role
FROM customer JOIN inv_tables t ON t.table_id = c_custkey
"""
VIEWS["layer_rules"] = """
SELECT concat(schema_name, '.*.r') AS rule_key,
  CASE WHEN schema_name LIKE '%brand1%' THEN 'OLD_ROLE' ELSE concat('r_', schema_name) END AS role
FROM inv_schemas WHERE schema_name NOT LIKE '%sys%'
UNION ALL
SELECT concat(schema_name, '.*.w'), concat('w_', schema_name) FROM inv_schemas WHERE schema_name NOT LIKE '%ext%'
"""
VIEWS["external_workspaces"] = """
SELECT schema_name AS workspace FROM inv_schemas WHERE schema_name NOT LIKE '%brand1%'
UNION ALL
SELECT concat(schema_name, '_old') FROM inv_schemas WHERE schema_name LIKE '%brand2%'
UNION ALL
SELECT concat('demo_', n_name) FROM nation
"""
VIEWS["known_elsewhere"] = "SELECT concat(schema_name, '_old') AS schema_name FROM inv_schemas WHERE schema_name LIKE '%brand21%'"

# ---------------------------------------------------------------- geometry
VIEWS["geom_vertices_base"] = """
SELECT feature_id, idx, CAST(count(*) OVER (PARTITION BY feature_id) AS INT) AS n, x, y FROM (
  SELECT l_orderkey AS feature_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey
         ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS INT) AS idx,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS x, CAST(round(l_quantity * 100) AS BIGINT) AS y
  FROM lineitem) q
"""
VIEWS["geom_features"] = """
SELECT o_orderkey AS feature_id,
  CASE WHEN o_orderkey % 97 = 0 THEN 'CIRCULARSTRING'
       WHEN v.n IS NULL THEN 'POLYGON' WHEN v.n = 1 THEN 'POINT' WHEN v.n = 2 THEN 'LINESTRING'
       WHEN o_orderkey % 3 = 0 THEN 'LINESTRING' ELSE 'POLYGON' END AS geom_type,
  CASE o_orderkey % 11 WHEN 0 THEN 3006 WHEN 1 THEN 4326 ELSE 3007 END AS srid, 2 AS coord_dim,
  CASE o_orderstatus WHEN 'F' THEN 'sk1_kba_parks' WHEN 'O' THEN 'sk0_ext_import' ELSE 'sk2_kba_roads' END AS schema_name
FROM orders LEFT JOIN (SELECT feature_id, max(n) AS n FROM geom_vertices_base GROUP BY feature_id) v
  ON v.feature_id = o_orderkey
"""
VIEWS["geom_vertices"] = """
SELECT feature_id, 1 AS part, 1 AS ring,
  CAST(row_number() OVER (PARTITION BY feature_id ORDER BY idx, sub) AS INT) AS idx, x, y
FROM (
  SELECT b.feature_id, b.idx, 0 AS sub, b.x, b.y FROM geom_vertices_base b
  UNION ALL
  SELECT b.feature_id, b.idx, 1, b.x, b.y FROM geom_vertices_base b
  JOIN orders o ON o.o_orderkey = b.feature_id WHERE b.idx = 2 AND o.o_orderpriority = '1-URGENT'
  UNION ALL
  SELECT b.feature_id, b.n + 1, 0, b.x, b.y FROM geom_vertices_base b
  JOIN geom_features f ON f.feature_id = b.feature_id
  JOIN orders o ON o.o_orderkey = b.feature_id
  WHERE b.idx = 1 AND f.geom_type = 'POLYGON' AND o.o_totalprice > 20000) q
"""
# Multi-part features: one rectangle per line item, some with a hole that is inside, crosses the
# shell, lies outside it or touches it.
VIEWS["shape_rings"] = """
SELECT feature_id, part, 1 AS ring, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM shape_boxes
UNION ALL
SELECT feature_id, part, 2,
  CASE hole WHEN 'inside' THEN x0 + w / 4 WHEN 'touch' THEN x0 WHEN 'cross' THEN x0 + w / 2 ELSE x0 + 2 * w END,
  y0 + h / 4,
  CASE hole WHEN 'inside' THEN x0 + w / 2 WHEN 'touch' THEN x0 + w / 2 WHEN 'cross' THEN x0 + 2 * w ELSE x0 + 3 * w END,
  y0 + h / 2
FROM shape_boxes WHERE hole <> 'none'
"""
VIEWS["shape_boxes"] = """
SELECT l_orderkey AS feature_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey
       ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS INT) AS part,
  CAST(round(l_extendedprice) AS DOUBLE) * 100 AS x0, CAST(l_suppkey % 50 AS DOUBLE) * 1000 AS y0,
  CAST(l_quantity AS DOUBLE) * 4000 + 4000 AS w, CAST(l_linenumber AS DOUBLE) * 400 AS h,
  CASE WHEN l_returnflag <> 'R' OR l_linestatus = 'F' THEN 'none'
       WHEN l_discount < 0.07 THEN 'inside' WHEN l_discount < 0.08 THEN 'touch'
       WHEN l_discount < 0.09 THEN 'cross' ELSE 'outside' END AS hole
FROM lineitem
"""
VIEWS["shape_vertices"] = """
SELECT feature_id, part, ring, CAST(k + 1 AS INT) AS idx,
  CASE WHEN k IN (0, 3, 4) THEN x0 ELSE x1 END AS x, CASE WHEN k IN (0, 1, 4) THEN y0 ELSE y1 END AS y
FROM shape_rings {REPEAT5}
"""
VIEWS["shape_features"] = """
SELECT o_orderkey AS feature_id, 'MULTIPOLYGON' AS geom_type, 3007 AS srid, 2 AS coord_dim,
  'sk1_kba_parks' AS schema_name FROM orders
"""

# ---------------------------------------------------------------- history and logs
VIEWS["orders_before"] = """
SELECT o_orderkey AS gid, o_custkey AS kund, o_orderstatus AS status, o_totalprice AS total, o_orderdate AS datum,
  o_orderdate AS andrad_tidpunkt, 'import' AS andrad_av
FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')
"""
VIEWS["orders_after"] = """
SELECT o_orderkey AS gid, o_custkey AS kund,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS total, o_orderdate AS datum,
  o_orderdate AS andrad_tidpunkt, 'import' AS andrad_av
FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')
"""
VIEWS["change_feed"] = """
SELECT user_id AS gid, event_id AS seq, ts,
  CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op,
  concat('user_', CAST(event_id % 5 AS STRING)) AS changed_by, value AS varde, props AS detalj
FROM events
"""
VIEWS["current_rows"] = """
SELECT c_custkey AS gid, c_acctbal AS varde, c_mktsegment AS detalj,
  CAST('2023-12-31 00:00:00' AS TIMESTAMP) AS skapad_tidpunkt, 'import' AS skapad_av,
  CAST(NULL AS TIMESTAMP) AS andrad_tidpunkt, CAST(NULL AS STRING) AS andrad_av
FROM customer WHERE c_mktsegment <> 'BUILDING'
"""
VIEWS["history_rows"] = """
SELECT CASE event_type WHEN 'error' THEN 'D' ELSE 'U' END AS h_type, ts AS h_ts,
  concat('user_', CAST(event_id % 5 AS STRING)) AS h_by, user_id AS gid, event_id AS seq, value AS varde, event_type AS status
FROM events WHERE event_type <> 'signup'
"""
VIEWS["ddl_log"] = """
SELECT e.event_id AS seq, e.ts, t.table_id, t.schema_name, t.table_name,
  CASE e.event_type WHEN 'signup' THEN 'CREATE TABLE' WHEN 'purchase' THEN 'ADD GEOMETRY'
    WHEN 'error' THEN 'DROP TABLE' WHEN 'click' THEN 'RENAME TO' ELSE 'ADD COLUMN' END AS command,
  CASE e.event_id % 3 WHEN 0 THEN 'fme' WHEN 1 THEN 'FME Desktop' ELSE 'anna' END AS session_user_name,
  CASE e.event_id % 7 WHEN 0 THEN 'FME' ELSE 'anna' END AS current_user_name,
  CASE e.event_id % 11 WHEN 0 THEN 'fme' ELSE 'psql' END AS application_name,
  CASE WHEN e.event_type = 'click' THEN concat(t.table_name, '_r', CAST(e.event_id % 5 AS STRING)) END AS new_name,
  CASE WHEN e.event_type = 'purchase'
       THEN CASE e.event_id % 3 WHEN 0 THEN 'POINT' WHEN 1 THEN 'LINESTRING' ELSE 'POLYGON' END END AS geom_type
FROM events e JOIN inv_tables t ON t.table_id = e.user_id
"""
# Rows of the three registers with the place in the log where they were written; the upsert keeps the last.
VIEWS["register_rows"] = """
SELECT CASE WHEN geom_type IS NOT NULL THEN 'srid_deviation' WHEN command = 'CREATE TABLE' THEN 'pending_geometry' ELSE 'placeholder' END AS register,
  schema_name, table_name, max(seq) AS seq
FROM ddl_log WHERE command <> 'DROP TABLE' AND seq % 3 <> 1
GROUP BY CASE WHEN geom_type IS NOT NULL THEN 'srid_deviation' WHEN command = 'CREATE TABLE' THEN 'pending_geometry' ELSE 'placeholder' END,
  schema_name, table_name
UNION ALL
SELECT 'placeholder', history_schema, history_table, CAST(NULL AS BIGINT) FROM history_metadata
UNION ALL
SELECT 'placeholder', schema_name, table_name, CAST(NULL AS BIGINT) FROM placeholder_register
"""
VIEWS["schema_ddl"] = """
SELECT e.event_id AS seq, t.schema_name,
  CASE e.event_type WHEN 'click' THEN concat('ALTER SCHEMA ', t.schema_name, ' RENAME TO x', CAST(e.event_id AS STRING))
    WHEN 'view' THEN concat('alter schema ', t.schema_name, ' rename   to y')
    WHEN 'error' THEN concat('ALTER SCHEMA ', t.schema_name, ' OWNER TO RENAMETO')
    WHEN 'signup' THEN concat('ALTER TABLE ', t.table_name, ' RENAME TO z')
    ELSE concat('CREATE SCHEMA ', t.schema_name) END AS command
FROM events e JOIN inv_tables t ON t.table_id = e.user_id
"""
VIEWS["schema_events"] = """
SELECT event_id AS seq, ts,
  CASE WHEN event_type IN ('error', 'view') THEN 'schema_drop' ELSE 'schema_create' END AS channel,
  CASE WHEN event_id % 50 = 0 THEN '' WHEN event_id % 50 = 1 THEN 'min_data'
       ELSE concat('sk', CAST(user_id % 4 AS STRING), '_kba_u', CAST(user_id AS STRING)) END AS payload
FROM events
"""
VIEWS["alerts"] = """
SELECT event_id AS seq, ts, concat(event_type, '_', CAST(user_id % 3 AS STRING)) AS subject FROM events
"""
VIEWS["call_outcomes"] = """
SELECT CAST(floor(event_id / 5) AS BIGINT) AS call_id, event_id AS seq, ts,
  CASE event_type WHEN 'click' THEN 'timeout' WHEN 'view' THEN 'connection_error' ELSE 'response' END AS outcome,
  CASE event_type WHEN 'purchase' THEN 200 WHEN 'signup' THEN 404 WHEN 'error' THEN 503 END AS status_code,
  CASE WHEN event_id % 2 = 0 THEN 'schema_create' ELSE 'schema_drop' END AS channel
FROM events
"""

# ---------------------------------------------------------------- the shipped standard, as SQL
VIEWS["std_levels"] = """
SELECT * FROM (VALUES ('sk0', true, true), ('sk1', true, false), ('sk2', false, false), ('skx', false, false))
  AS v(prefix, publish, anonymous_read)
"""
VIEWS["std_categories"] = """
SELECT * FROM (VALUES ('ext', false), ('kba', true), ('sys', false)) AS v(prefix, validate_geometry)
"""
VIEWS["std_roles"] = """
SELECT * FROM (VALUES ('r_{schema}', 'read', false, NULL), ('w_{schema}', 'write', false, NULL),
  ('gs_r_{schema}', 'read', true, 'r_{schema}'), ('gs_w_{schema}', 'write', true, 'w_{schema}'))
  AS v(role, kind, login, inherits)
"""

# ---------------------------------------------------------------- settings and texts
VIEWS["settings_default"] = """
SELECT p_brand AS setting, p_type AS variant, min(p_size) AS value, 'default' AS note, count(*) AS added_column
FROM part GROUP BY p_brand, p_type
"""
VIEWS["settings_saved"] = """
SELECT p_brand AS setting, p_type AS variant, max(p_size) AS value, 'edited' AS note, min(p_name) AS removed_column
FROM part WHERE p_type <> 'SMALL' GROUP BY p_brand, p_type
UNION ALL
SELECT n_name, 'CUSTOM', n_regionkey, 'own row', 'x' FROM nation
"""

SHARED = {"geom_vertices_base"}  # read by several stored views, each of which would work it out anew

_NAMES = re.compile(r"\b(" + "|".join(sorted(VIEWS, key=len, reverse=True)) + r")\b")
_BASES = re.compile(r"\b(" + "|".join(BASE_TABLES) + r")\b")
_REPEAT = {
    "spark": "LATERAL VIEW explode(array(0, 1, 2, 3, 4)) five AS k",
    "duckdb": ", unnest([0, 1, 2, 3, 4]) AS five(k)",
}


def _needed(sql: str, seen: list[str], given: Collection[str] = ()) -> list[str]:
    for name in dict.fromkeys(_NAMES.findall(sql)):
        if name not in seen and name not in given:
            _needed(VIEWS[name], seen, given)
            if name not in seen:
                seen.append(name)
    return seen


def with_views(sql: str, dialect: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` preceded by the views it uses, in dependency order, as one WITH clause."""
    parts = [f"{n} AS ({t})" for n, t in (extra or {}).items()]
    parts += [f"{name} AS ({VIEWS[name].strip()})" for name in _needed(sql, [], extra or {})]
    if parts:
        lead = "WITH RECURSIVE " if dialect == "duckdb" else "WITH "
        own = re.match(r"\s*WITH\s+", sql)
        joined = ",\n".join(parts)
        sql = lead + joined + (",\n" + sql[own.end():] if own else "\n" + sql)
    text = sql
    return text.replace("{REPEAT5}", _REPEAT[dialect])


class Inputs:
    """Derived inputs of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._stored: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")

    def stored(self, name: str) -> DataFrame:
        """The view written out once, like the stored table it stands for."""
        if name not in self._stored:
            for shared in SHARED & set(_needed(VIEWS[name], [])):
                self.stored(shared)
            self._stored[name] = materialize_tidy(self[name], name)
        return self._stored[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, sql: str) -> DataFrame:
        given = {}
        for name, df in self._stored.items():
            view = f"stored_{name}_{id(df)}"
            df.createOrReplaceTempView(view)
            given[name] = f"SELECT * FROM {view}"
        text = with_views(sql, "spark", given)
        used = dict.fromkeys(_BASES.findall(text))
        bases = {name: f"SELECT * FROM parquet.`{self.folder}/{name}.parquet`" for name in used}
        return self.spark.sql(with_views(sql, "spark", bases | given))
