"""Catalogue: conforming tables, layout audits, settings, data constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablekeep.config import Config
from tablekeep.operators import conform, constraints, names, settings
from tablekeep.plans.catalog import query

CFG = Config()
AS_OF = "2024-02-01 00:00:00"
USER = "steward"

INCOMING = """SELECT o_orderkey AS orderno, o_custkey AS kund, o_orderpriority AS skapad_av, o_orderstatus AS status,
  concat('POINT(', CAST(o_custkey AS STRING), ' ', CAST(o_orderkey AS STRING), ')') AS geom, 'x' AS gid,
  o_totalprice AS total, o_orderdate AS datum FROM orders"""


@query("c01_standard_layouts", """
WITH s AS (
  SELECT schema_name, table_name, 1 AS section, 1 AS sort_key, 'gid' AS column_name, 'integer GENERATED ALWAYS AS IDENTITY' AS data_type, NULL AS default_value FROM inv_tables
  UNION ALL SELECT schema_name, table_name, 2, ordinal_position, column_name, data_type, NULL FROM inv_columns
    WHERE column_name NOT IN ('gid', 'skapad_tidpunkt', 'skapad_av', 'andrad_tidpunkt', 'andrad_av')
  UNION ALL SELECT schema_name, table_name, 3, -4, 'skapad_tidpunkt', 'timestamptz', 'NOW()' FROM inv_tables
  UNION ALL SELECT schema_name, table_name, 3, -3, 'skapad_av', 'character varying', 'session_user' FROM inv_tables WHERE schema_name LIKE '%_kba_%'
  UNION ALL SELECT schema_name, table_name, 3, -2, 'andrad_tidpunkt', 'timestamptz', NULL FROM inv_tables WHERE schema_name LIKE '%_kba_%'
  UNION ALL SELECT schema_name, table_name, 3, -1, 'andrad_av', 'character varying', NULL FROM inv_tables WHERE schema_name LIKE '%_kba_%'
  UNION ALL SELECT schema_name, table_name, 4, 0, 'geom', concat('geometry(', regexp_replace(type, '[ZM]+$', ''),
      CASE WHEN coord_dimension = 4 THEN 'ZM' WHEN coord_dimension = 3 AND type LIKE '%M' THEN 'M' WHEN coord_dimension = 3 THEN 'Z' ELSE '' END,
      ',', srid, ')'), NULL FROM inv_geometry WHERE geometry_column = 'geom')
SELECT schema_name, table_name, row_number() OVER (PARTITION BY schema_name, table_name ORDER BY section, sort_key) AS position,
  section, column_name, data_type, default_value FROM s
""")
def _(fx):
    return conform.standard_layouts(fx["inv_columns"], fx["inv_tables"], fx["inv_geometry"], CFG)


@query("c01_dropped_user_columns", """
SELECT schema_name, table_name, column_name, column_name = 'gid' OR schema_name LIKE '%_kba_%' AS replaced_by_standard
FROM inv_columns WHERE column_name IN ('gid', 'skapad_av')
""")
def _(fx):
    return conform.dropped_user_columns(fx["inv_columns"], CFG)


@query("c02_conform", f"""
SELECT row_number() OVER (ORDER BY o_orderkey) AS gid, o_orderkey AS orderno, o_custkey AS kund, o_orderstatus AS status,
  o_totalprice AS total, o_orderdate AS datum, TIMESTAMP '{AS_OF}' AS skapad_tidpunkt, '{USER}' AS skapad_av,
  CAST(NULL AS TIMESTAMP) AS andrad_tidpunkt, CAST(NULL AS VARCHAR) AS andrad_av,
  concat('POINT(', o_custkey, ' ', o_orderkey, ')') AS geom
FROM orders
""")
def _(fx):
    return conform.conform(fx.sql(INCOMING), "sk1_kba_orders", CFG, AS_OF, USER, ["orderno"])


@query("c02_conform_external", f"""
SELECT row_number() OVER (ORDER BY o_orderkey) AS gid, o_orderkey AS orderno, o_custkey AS kund, o_orderstatus AS status,
  o_totalprice AS total, o_orderdate AS datum, TIMESTAMP '{AS_OF}' AS skapad_tidpunkt,
  concat('POINT(', o_custkey, ' ', o_orderkey, ')') AS geom
FROM orders
""")
def _(fx):
    return conform.conform(fx.sql(INCOMING), "sk0_ext_orders", CFG, AS_OF, USER, ["orderno"])


@query("c03_apply_defaults", f"""
SELECT l_orderkey AS orderno, l_linenumber AS radnr, coalesce(CASE WHEN l_returnflag <> 'R' THEN l_shipdate END, TIMESTAMP '{AS_OF}') AS skapad_tidpunkt,
  coalesce(CASE WHEN l_linestatus = 'F' THEN 'loader' END, '{USER}') AS skapad_av,
  CASE WHEN l_returnflag = 'A' THEN 'editor' END AS andrad_av FROM lineitem
""")
def _(fx):
    df = fx.table("lineitem").select(
        F.col("l_orderkey").alias("orderno"),
        F.col("l_linenumber").alias("radnr"),
        F.when(F.col("l_returnflag") != "R", F.col("l_shipdate")).alias("skapad_tidpunkt"),
        F.when(F.col("l_linestatus") == "F", "loader").alias("skapad_av"),
        F.when(F.col("l_returnflag") == "A", "editor").alias("andrad_av"),
    )
    return conform.apply_defaults(df, "sk1_kba_rows", CFG, AS_OF, USER)


@query("c04_generated_columns", """
SELECT l_orderkey AS orderno, l_quantity AS antal, l_extendedprice AS belopp, l_quantity * 2 AS dubbel,
  l_extendedprice * (1 - l_discount) AS netto FROM lineitem
""")
def _(fx):
    df = fx.table("lineitem").select(
        F.col("l_orderkey").alias("orderno"), F.col("l_quantity").alias("antal"), F.col("l_extendedprice").alias("belopp"),
        F.lit(0.0).alias("dubbel"), F.col("l_discount").alias("rabatt"),
    )
    return conform.generated_columns(df, {"dubbel": "antal * 2", "netto": "belopp * (1 - rabatt)"}).drop("rabatt")


@query("c05_reorder", """
SELECT o_orderkey AS gid, o_totalprice AS total, 'ny' AS ny_kolumn, o_orderdate AS skapad_tidpunkt, o_orderpriority AS andrad_av,
  o_orderstatus AS geom, 'gid,total,ny_kolumn,skapad_tidpunkt,andrad_av,geom,column_order' AS column_order FROM orders
""")
def _(fx):
    df = fx.table("orders").select(
        F.col("o_orderkey").alias("gid"), F.col("o_orderpriority").alias("andrad_av"), F.col("o_totalprice").alias("total"),
        F.col("o_orderstatus").alias("geom"), F.col("o_orderdate").alias("skapad_tidpunkt"), F.lit("ny").alias("ny_kolumn"),
    )
    out = conform.reorder(df, "sk1_kba_orders", CFG)
    return out.withColumn("column_order", F.lit(",".join(out.columns + ["column_order"])))


@query("c06_check_layout", """
WITH f AS (
  SELECT schema_name, table_name, min(ordinal_position) AS lo, max(ordinal_position) AS hi, count(*) AS n,
    max(CASE WHEN column_name = 'gid' THEN ordinal_position END) AS gid_at,
    max(CASE WHEN column_name = 'geom' THEN ordinal_position END) AS geom_at,
    max(CASE WHEN column_name NOT IN ('gid', 'skapad_tidpunkt', 'skapad_av', 'andrad_tidpunkt', 'andrad_av', 'geom') THEN ordinal_position END) AS u
  FROM laid_out_columns GROUP BY 1, 2),
wanted AS (
  SELECT schema_name, table_name, unnest(CASE WHEN schema_name LIKE '%_kba_%' THEN ['gid', 'skapad_tidpunkt', 'skapad_av', 'andrad_tidpunkt', 'andrad_av']
    ELSE ['gid', 'skapad_tidpunkt'] END) AS column_name FROM inv_tables),
have AS (SELECT schema_name, table_name, column_name, ordinal_position FROM laid_out_columns
  WHERE column_name IN ('gid', 'skapad_tidpunkt', 'skapad_av', 'andrad_tidpunkt', 'andrad_av'))
SELECT w.schema_name, w.table_name, 'missing' AS problem, w.column_name FROM wanted w LEFT JOIN have h USING (schema_name, table_name, column_name) WHERE h.ordinal_position IS NULL
UNION ALL
SELECT h.schema_name, h.table_name, 'unexpected', h.column_name FROM have h LEFT JOIN wanted w USING (schema_name, table_name, column_name)
  WHERE w.schema_name IS NULL
UNION ALL SELECT schema_name, table_name, 'not_first', 'gid' FROM f WHERE gid_at <> lo
UNION ALL SELECT schema_name, table_name, 'not_last', 'geom' FROM f WHERE geom_at < hi
UNION ALL SELECT h.schema_name, h.table_name, 'misordered', h.column_name FROM have h JOIN f USING (schema_name, table_name)
  WHERE h.column_name <> 'gid' AND h.ordinal_position < f.u
UNION ALL SELECT schema_name, table_name, 'gap', '*' FROM f WHERE hi - lo + 1 <> n
""")
def _(fx):
    return conform.check_layout(fx["laid_out_columns"], fx["inv_tables"], CFG)


@query("c07_assign_gid", """
SELECT 1000 + row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS gid,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity FROM lineitem
""")
def _(fx):
    df = fx.table("lineitem").select(
        F.lit(-1).alias("gid"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"
    )
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    return conform.assign_gid(df, order, start=1001)


@query("c08_own_identity", """
SELECT schema_name, table_name, column_name FROM inv_columns WHERE is_identity AND column_name <> 'gid'
""")
def _(fx):
    return conform.own_identity_warnings(fx["inv_columns"])


TYPE_TEXT = """concat(CASE WHEN data_type = 'character varying' AND max_length IS NOT NULL THEN concat('character varying(', max_length, ')')
  WHEN data_type = 'numeric' AND numeric_precision IS NOT NULL THEN concat('numeric(', numeric_precision, ',', numeric_scale, ')')
  ELSE data_type END, CASE WHEN collation_name IS NOT NULL THEN concat(' COLLATE ', collation_name) ELSE '' END)"""


@query("c09_render_types", f"""
SELECT schema_name, table_name, column_name, ordinal_position, {TYPE_TEXT} AS full_type FROM inv_columns
UNION ALL
SELECT schema_name, table_name, geometry_column, 99, concat('geometry(', regexp_replace(type, '[ZM]+$', ''),
  CASE WHEN coord_dimension = 4 THEN 'ZM' WHEN coord_dimension = 3 AND type LIKE '%M' THEN 'M' WHEN coord_dimension = 3 THEN 'Z' ELSE '' END,
  ',', srid, ')') FROM inv_geometry
""")
def _(fx):
    geo = fx["inv_geometry"]
    as_columns = geo.select(
        "table_id", *conform.KEY, F.col("geometry_column").alias("column_name"), F.lit(99).alias("ordinal_position"),
        F.lit("USER-DEFINED").alias("data_type"),
    )
    columns = fx["inv_columns"].unionByName(as_columns, allowMissingColumns=True)
    return conform.render_types(columns, names.geometry_info(geo))


@query("c10_create_statements", f"""
SELECT schema_name, table_name, concat('CREATE TABLE "', schema_name, '"."', table_name, '" (',
  string_agg(concat('"', column_name, '" ', data_type, CASE WHEN default_value IS NOT NULL THEN concat(' DEFAULT ', default_value) ELSE '' END),
    ', ' ORDER BY section, sort_key), ')') AS statement
FROM (
  SELECT schema_name, table_name, 1 AS section, 1 AS sort_key, 'gid' AS column_name, 'integer GENERATED ALWAYS AS IDENTITY' AS data_type, NULL AS default_value FROM inv_tables
  UNION ALL SELECT schema_name, table_name, 2, ordinal_position, column_name, {TYPE_TEXT}, NULL FROM inv_columns
    WHERE column_name NOT IN ('gid', 'skapad_av')
  UNION ALL SELECT schema_name, table_name, 3, -4, 'skapad_tidpunkt', 'timestamptz', 'NOW()' FROM inv_tables
  UNION ALL SELECT schema_name, table_name, 3, -3, 'skapad_av', 'character varying', 'session_user' FROM inv_tables WHERE schema_name LIKE '%_kba_%'
  UNION ALL SELECT schema_name, table_name, 3, -2, 'andrad_tidpunkt', 'timestamptz', NULL FROM inv_tables WHERE schema_name LIKE '%_kba_%'
  UNION ALL SELECT schema_name, table_name, 3, -1, 'andrad_av', 'character varying', NULL FROM inv_tables WHERE schema_name LIKE '%_kba_%'
  UNION ALL SELECT schema_name, table_name, 4, 0, 'geom', concat('geometry(', regexp_replace(type, '[ZM]+$', ''),
      CASE WHEN coord_dimension = 4 THEN 'ZM' WHEN coord_dimension = 3 AND type LIKE '%M' THEN 'M' WHEN coord_dimension = 3 THEN 'Z' ELSE '' END,
      ',', srid, ')'), NULL FROM inv_geometry WHERE geometry_column = 'geom') q
GROUP BY schema_name, table_name
""")
def _(fx):
    columns = conform.render_types(fx["inv_columns"]).withColumnRenamed("full_type", "data_type")
    return conform.create_statements(conform.standard_layouts(columns, fx["inv_tables"], fx["inv_geometry"], CFG))


# ------------------------------------------------------------------ the standard itself
CANDIDATES = """SELECT concat(p_name, CASE WHEN p_size = 50 THEN repeat('y', 60) ELSE CAST(p_partkey % 500 AS STRING) END) AS name,
  p_size - 25 AS position, CASE p_size % 6 WHEN 0 THEN 'LIKE ''%_kba_%''' WHEN 1 THEN '= ''a''; DROP' WHEN 2 THEN 'is not null'
    WHEN 3 THEN 'upper(x)' WHEN 4 THEN concat('IN (''', repeat('z', 250), ''')') ELSE 'NOT LIKE ''x''' END AS schema_rule FROM part"""


@query("n05_validate_config", f"""
WITH c AS ({CANDIDATES})
SELECT 'columns' AS standard, name AS entry, 'name_too_long' AS violation FROM c WHERE length(name) > 63
UNION ALL SELECT 'columns', name, 'position_zero' FROM c WHERE position = 0
UNION ALL SELECT 'columns', name, 'rule_semicolon' FROM c WHERE schema_rule LIKE '%;%'
UNION ALL SELECT 'columns', name, 'rule_too_long' FROM c WHERE length(schema_rule) >= 200
UNION ALL SELECT 'columns', name, 'rule_start' FROM c WHERE NOT regexp_matches(schema_rule, '(?i)^(=|<>|!=|<|<=|>|>=|LIKE|NOT|IN|IS)\\s')
UNION ALL SELECT 'columns', name, 'duplicate' FROM c GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'levels', p_brand, 'prefix' FROM part WHERE NOT regexp_matches(p_brand, '^sk[a-z0-9]+$')
UNION ALL SELECT 'levels', p_brand, 'duplicate' FROM part GROUP BY p_brand HAVING count(*) > 1
""")
def _(fx):
    return settings.config_violations(
        {"columns": fx.sql(CANDIDATES), "levels": fx.table("part").select(F.col("p_brand").alias("prefix"))}
    )


@query("s05_restore_settings", """
SELECT coalesce(d.setting, s.setting) AS setting, coalesce(d.variant, s.variant) AS variant,
  CASE WHEN s.setting IS NOT NULL THEN s.value ELSE d.value END AS value,
  CASE WHEN s.setting IS NOT NULL THEN s.note ELSE d.note END AS note, d.added_column
FROM settings_default d FULL OUTER JOIN settings_saved s ON d.setting = s.setting AND d.variant = s.variant
""")
def _(fx):
    return settings.restore_settings(fx["settings_default"], fx["settings_saved"], ["setting", "variant"])


@query("s05_restore_rows", """
SELECT setting, variant, value, note, added_column FROM settings_default
UNION ALL SELECT setting, variant, value, note, NULL FROM settings_saved s
WHERE NOT EXISTS (SELECT 1 FROM settings_default d WHERE d.setting = s.setting AND d.variant = s.variant)
""")
def _(fx):
    return settings.restore_rows(fx["settings_default"], fx["settings_saved"], ["setting", "variant"])


# ------------------------------------------------------------------ constraints on data
@query("k01_classify_rules", """
WITH k AS (SELECT table_id, schema_name, table_name, constraint_name, contype, definition,
    count(DISTINCT a) AS n_columns, CASE WHEN contype = 'c' THEN (SELECT string_agg(CAST(b AS VARCHAR), ',' ORDER BY b)
      FROM (SELECT DISTINCT unnest(array_agg(CAST(a AS INT))) AS b)) ELSE conkey END AS attnums
  FROM (SELECT *, unnest(string_split(conkey, ',')) AS a FROM inv_constraints) GROUP BY table_id, schema_name, table_name, constraint_name, contype, definition, conkey)
SELECT schema_name, table_name, constraint_name AS rule_name, CASE WHEN contype = 'f' THEN 'foreign_key' WHEN contype = 'p' THEN 'primary_key'
    WHEN contype = 'u' THEN 'unique' ELSE 'check' END AS rule_kind,
  CASE WHEN contype = 'c' AND n_columns = 1 THEN 'column' ELSE 'table' END AS rule_scope, attnums AS columns, definition FROM k
UNION ALL SELECT schema_name, table_name, column_name, 'not_null', 'column', CAST(ordinal_position AS VARCHAR), 'NOT NULL' FROM inv_attributes WHERE not_null
UNION ALL SELECT schema_name, table_name, column_name, 'default', 'column', CAST(ordinal_position AS VARCHAR), default_expr FROM inv_attributes WHERE default_expr IS NOT NULL
UNION ALL SELECT schema_name, table_name, column_name, 'identity', 'column', CAST(ordinal_position AS VARCHAR),
  CASE identity_kind WHEN 'a' THEN 'GENERATED ALWAYS AS IDENTITY' ELSE 'GENERATED BY DEFAULT AS IDENTITY' END FROM inv_attributes WHERE identity_kind <> ''
""")
def _(fx):
    return constraints.classify_rules(fx["inv_constraints"], fx["inv_attributes"])


NULLABLE = """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS kund,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS total, o_orderdate FROM orders"""


@query("k02_check_not_null", f"""
WITH t AS ({NULLABLE})
SELECT 'kund' AS column_name, count(*) - count(kund) AS n_null FROM t
UNION ALL SELECT 'total', count(*) - count(total) FROM t
UNION ALL SELECT 'o_orderdate', count(*) - count(o_orderdate) FROM t
""")
def _(fx):
    return constraints.check_not_null(fx.sql(NULLABLE), ["kund", "total", "o_orderdate"])


@query("k03_check_predicates", f"""
WITH t AS ({NULLABLE})
SELECT 'positive' AS check_name, count(*) FILTER (WHERE NOT total > 50000) AS n_violations FROM t
UNION ALL SELECT 'known', count(*) FILTER (WHERE NOT (kund >= 10 OR total < 1000)) FROM t
""")
def _(fx):
    return constraints.check_predicates(fx.sql(NULLABLE), {"positive": "total > 50000", "known": "kund >= 10 OR total < 1000"})


@query("k04_check_unique", """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1
""")
def _(fx):
    return constraints.check_unique(fx.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("k05_check_foreign_key", f"""
WITH t AS ({NULLABLE}), p AS (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY')
SELECT kund, count(*) AS n_orphans FROM t WHERE kund IS NOT NULL AND kund NOT IN (SELECT c_custkey FROM p) GROUP BY kund
""")
def _(fx):
    parent = fx.table("customer").filter("c_mktsegment <> 'MACHINERY'")
    return constraints.check_foreign_key(fx.sql(NULLABLE), parent, {"kund": "c_custkey"})


@query("k06_restore_plan", """
WITH k AS (SELECT schema_name, table_name, constraint_name, contype, definition, count(DISTINCT a) AS n
  FROM (SELECT *, unnest(string_split(conkey, ',')) AS a FROM inv_constraints) GROUP BY 1, 2, 3, 4, 5),
r AS (
SELECT schema_name, table_name, 1 AS stage, index_name AS rule_name, 'index' AS rule_kind FROM inv_indexes
UNION ALL SELECT schema_name, table_name, 2, constraint_name, CASE contype WHEN 'u' THEN 'unique' ELSE 'check' END FROM k WHERE contype = 'u' OR (contype = 'c' AND n > 1)
UNION ALL SELECT schema_name, table_name, 3, constraint_name, 'foreign_key' FROM k WHERE contype = 'f'
UNION ALL SELECT schema_name, table_name, 4, column_name, 'not_null' FROM inv_attributes WHERE not_null
UNION ALL SELECT schema_name, table_name, 5, constraint_name, 'check' FROM k WHERE contype = 'c' AND n = 1
UNION ALL SELECT schema_name, table_name, 6, column_name, 'default' FROM inv_attributes WHERE default_expr IS NOT NULL
  AND column_name NOT IN ('gid', 'skapad_tidpunkt', 'skapad_av', 'andrad_tidpunkt', 'andrad_av')
UNION ALL SELECT schema_name, table_name, 7, column_name, 'identity' FROM inv_attributes WHERE identity_kind <> '')
SELECT *, row_number() OVER (PARTITION BY schema_name, table_name ORDER BY stage, rule_name) AS step FROM r
""")
def _(fx):
    classified = constraints.classify_rules(fx["inv_constraints"], fx["inv_attributes"])
    return constraints.restore_plan(classified, fx["inv_indexes"], CFG)
