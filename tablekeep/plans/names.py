"""Catalogue: naming and structure audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablekeep.config import Config
from tablekeep.operators import names
from tablekeep.plans.catalog import query

CFG = Config()
PATTERN = "^(sk0|sk1|sk2|skx)_(ext|kba|sys)_.+$"


@query("n01_schema_pattern", """
SELECT schema_name, p.schema_pattern, p.level_pattern,
  regexp_matches(schema_name, p.schema_pattern) AS matches_schema,
  regexp_matches(schema_name, p.level_pattern) AS matches_level
FROM inv_schemas, (SELECT concat('^(', l.a, ')_(', c.a, ')_.+$') AS schema_pattern, concat('^(', l.a, ')_') AS level_pattern
  FROM (SELECT string_agg(prefix, '|' ORDER BY prefix) AS a FROM std_levels) l,
       (SELECT string_agg(prefix, '|' ORDER BY prefix) AS a FROM std_categories) c) p
""")
def _(fx):
    return names.match_patterns(names.schema_names(fx["inv_tables"]), CFG)


@query("n02_check_schema_names", f"""
SELECT schema_name, status, CASE WHEN status = 'invalid' THEN
    CASE WHEN regexp_matches(schema_name, '^(sk0|sk1|sk2|skx)_') THEN 'category_or_name' ELSE 'level' END END AS reason
FROM (SELECT schema_name, CASE WHEN schema_name IN ('public', 'information_schema') OR schema_name LIKE 'pg\\_%' ESCAPE '\\' THEN 'exempt'
    WHEN regexp_matches(schema_name, '{PATTERN}') THEN 'valid' ELSE 'invalid' END AS status FROM inv_schemas)
""")
def _(fx):
    return names.check_schema_names(names.schema_names(fx["inv_tables"]), CFG)


@query("n03_parse_schemas", """
SELECT s.schema_name, l.prefix IS NOT NULL AS valid, l.prefix AS level, c.prefix AS category,
  substr(s.schema_name, length(l.prefix) + length(c.prefix) + 3) AS description
FROM inv_schemas s LEFT JOIN (std_levels l JOIN std_categories c ON true)
  ON starts_with(s.schema_name, concat(l.prefix, '_', c.prefix, '_')) AND length(s.schema_name) > length(l.prefix) + length(c.prefix) + 2
""")
def _(fx):
    return names.parse_schemas(names.schema_names(fx["inv_tables"]), CFG)


RULES = [
    ("all", "IS NOT NULL"),
    ("internal", "LIKE '%_kba_%'"),
    ("listed", "IN ('sk0_ext_xkbay', 'public')"),
    ("not_system", "NOT LIKE '%_sys_%'"),
    ("after", ">= 'sk1'"),
    ("call", "= upper('x')"),
    ("no_start", "sk0_ext_xkbay"),
]


@query("n04_eval_schema_rules", """
SELECT schema_name, 'all' AS rule_id, schema_name IS NOT NULL AS matches, NULL AS rule_error FROM inv_schemas
UNION ALL SELECT schema_name, 'internal', schema_name LIKE '%_kba_%', NULL FROM inv_schemas
UNION ALL SELECT schema_name, 'listed', schema_name IN ('sk0_ext_xkbay', 'public'), NULL FROM inv_schemas
UNION ALL SELECT schema_name, 'not_system', schema_name NOT LIKE '%_sys_%', NULL FROM inv_schemas
UNION ALL SELECT schema_name, 'after', schema_name >= 'sk1', NULL FROM inv_schemas
UNION ALL SELECT schema_name, 'call', false, 'not_a_literal_test' FROM inv_schemas
UNION ALL SELECT schema_name, 'no_start', false, 'bad_start' FROM inv_schemas
""")
def _(fx):
    return names.eval_schema_rules(names.schema_names(fx["inv_tables"]), RULES)


@query("n06_publishable_schemas", """
SELECT s.schema_name FROM inv_schemas s WHERE EXISTS (SELECT 1 FROM std_levels l, std_categories c
  WHERE l.publish AND regexp_matches(s.schema_name, concat('^', l.prefix, '_', c.prefix, '_')))
""")
def _(fx):
    return names.publishable_schemas(names.schema_names(fx["inv_tables"]), CFG)


@query("n07_publish_events", """
SELECT schema_name, level, 'publish' AS action FROM (
  SELECT s.schema_name, l.prefix AS level, row_number() OVER (PARTITION BY s.schema_name ORDER BY length(l.prefix) DESC, l.prefix) AS k
  FROM inv_schemas s JOIN std_levels l ON l.publish AND s.schema_name LIKE concat(l.prefix, '_%')
  WHERE s.schema_name NOT IN ('public', 'information_schema') AND NOT regexp_matches(s.schema_name, '^pg_')) WHERE k = 1
""")
def _(fx):
    return names.publish_events(names.schema_names(fx["inv_tables"]), CFG)


@query("n08_anonymous_read", """
SELECT s.schema_name, split_part(s.schema_name, '_', 1) AS level, coalesce(l.anonymous_read, false) AS anonymous_read
FROM inv_schemas s LEFT JOIN std_levels l ON l.prefix = split_part(s.schema_name, '_', 1)
""")
def _(fx):
    return names.anonymous_read(names.schema_names(fx["inv_tables"]), CFG)


BASAL = "regexp_replace(type, '[ZM]+$', '')"
SUFFIX = """CASE WHEN {t} IN ('POINT', 'MULTIPOINT') THEN '_p' WHEN {t} IN ('LINESTRING', 'MULTILINESTRING') THEN '_l'
  WHEN {t} IN ('POLYGON', 'MULTIPOLYGON') THEN '_y' ELSE '_g' END"""


@query("n09_geometry_info", f"""
SELECT schema_name, table_name, geometry_column, basal_type, dimension_suffix, concat(basal_type, dimension_suffix) AS full_type,
  srid, concat('geometry(', basal_type, dimension_suffix, ',', srid, ')') AS definition
FROM (SELECT *, {BASAL} AS basal_type, CASE WHEN coord_dimension = 4 THEN 'ZM'
    WHEN coord_dimension = 3 AND type LIKE '%M' THEN 'M' WHEN coord_dimension = 3 THEN 'Z' ELSE '' END AS dimension_suffix
  FROM inv_geometry)
""")
def _(fx):
    return names.geometry_info(fx["inv_geometry"])


@query("n10_expected_suffix", f"""
SELECT schema_name, table_name, geometry_column, {SUFFIX.format(t=BASAL)} AS expected_suffix FROM inv_geometry
""")
def _(fx):
    from tablekeep.functions.naming import basal_type, expected_suffix

    return fx["inv_geometry"].select(
        *names.KEY, "geometry_column", expected_suffix(basal_type(F.col("type"))).alias("expected_suffix")
    )


@query("n11_check_tables", f"""
WITH g AS (SELECT schema_name, table_name, count(*) AS n, min(geometry_column) AS col, min({BASAL}) AS t
  FROM inv_geometry GROUP BY 1, 2)
SELECT i.schema_name, i.table_name, coalesce(g.n, 0) AS n_geometries,
  CASE WHEN g.n = 1 THEN {SUFFIX.format(t='g.t')} END AS expected_suffix,
  CASE WHEN length(i.table_name) > 54 THEN 'name_too_long'
    WHEN g.n IS NULL THEN CASE WHEN regexp_matches(i.table_name, '_[plyg]$') THEN 'reserved_suffix' END
    WHEN g.n > 1 THEN 'several_geometries' WHEN g.col <> 'geom' THEN 'geometry_column_name'
    WHEN i.table_name NOT LIKE concat('%', {SUFFIX.format(t='g.t')}) THEN 'wrong_suffix' END AS code
FROM inv_tables i LEFT JOIN g USING (schema_name, table_name)
""")
def _(fx):
    return names.check_tables(fx["inv_tables"], fx["inv_geometry"])


@query("n12_suggest_names", f"""
SELECT schema_name, table_name, expected_suffix, concat(regexp_replace(table_name, '_[plyg]$', ''), expected_suffix) AS suggested_name
FROM (SELECT schema_name, table_name, {SUFFIX.format(t=f"min({BASAL})")} AS expected_suffix
  FROM inv_geometry GROUP BY 1, 2 HAVING count(*) = 1)
""")
def _(fx):
    return names.suggest_names(fx["inv_tables"], fx["inv_geometry"])


@query("n13_check_views", f"""
WITH g AS (SELECT schema_name, table_name, count(*) AS n, min(type) AS t FROM view_geometry GROUP BY 1, 2),
w AS (SELECT v.schema_name, v.view_name, v.definition, coalesce(g.n, 0) AS n, g.t,
  CASE WHEN g.n IS NULL THEN '' WHEN g.n = 1 THEN {SUFFIX.format(t='g.t')} ELSE '_g' END AS suffix
  FROM inv_views v LEFT JOIN g ON g.schema_name = v.schema_name AND g.table_name = v.view_name)
SELECT schema_name, view_name, n AS n_geometries, suffix AS expected_suffix,
  CASE WHEN view_name LIKE 'v_%' AND view_name LIKE concat('%', suffix) THEN NULL
    WHEN n = 1 AND t = 'GEOMETRY' AND regexp_matches(definition, '(?i)ST_[A-Za-z]+\\s*\\(') THEN 'cast_needed'
    ELSE 'view_name' END AS code
FROM w
""")
def _(fx):
    return names.check_views(fx["inv_views"], fx["view_geometry"])


@query("n14_check_history_names", """
SELECT t.schema_name, t.table_name, left(t.table_name, length(t.table_name) - 2) AS parent_table,
  CASE WHEN EXISTS (SELECT 1 FROM inv_all_tables p WHERE p.schema_name = t.schema_name
    AND p.table_name = left(t.table_name, length(t.table_name) - 2)) THEN 'history_table' ELSE 'reserved_suffix' END AS status
FROM inv_all_tables t WHERE right(t.table_name, 2) = '_h'
""")
def _(fx):
    return names.check_history_names(fx["inv_all_tables"])


@query("n15_in_scope", """
SELECT t.table_id, t.schema_name, t.table_name FROM inv_all_tables t
WHERE t.schema_name <> 'public' AND NOT starts_with(t.schema_name, 'pg_temp')
  AND NOT (right(t.table_name, 2) = '_h' AND EXISTS (SELECT 1 FROM inv_all_tables p WHERE p.schema_name = t.schema_name
    AND p.table_name = left(t.table_name, length(t.table_name) - 2)))
  AND NOT EXISTS (SELECT 1 FROM inv_columns c WHERE c.schema_name = t.schema_name AND c.table_name = t.table_name
    AND c.column_name LIKE '%_temp0001')
""")
def _(fx):
    return names.in_scope(fx["inv_all_tables"], fx["inv_columns"])


@query("n16_derived_names", """
SELECT schema_name, table_name, left(concat(table_name, '_h'), 63) AS history_table,
  concat(left(table_name, 50), '_h_idx') AS history_index, concat(left(table_name, 50), '_geom_gidx') AS spatial_index,
  concat('validera_geom_', table_name) AS check_name, concat('trg_fn_', table_name, '_qa') AS trigger_function,
  concat('trg_', table_name, '_qa') AS trigger_name,
  count(*) OVER (PARTITION BY schema_name, left(table_name, 50)) > 1 AS index_collision
FROM inv_all_tables
""")
def _(fx):
    return names.derived_names(fx["inv_all_tables"])


@query("n17_system_user_sessions", """
SELECT seq, session_user_name, current_user_name, application_name,
  (lower(session_user_name) = 'fme' OR lower(current_user_name) = 'fme' OR lower(application_name) = 'fme') AS is_system_user
FROM ddl_log
""")
def _(fx):
    cols = ["session_user_name", "current_user_name", "application_name"]
    return names.is_system_user(fx["ddl_log"].select("seq", *cols), CFG, cols)


@query("n18_tables_to_validate", """
SELECT t.table_id, t.schema_name, t.table_name FROM inv_tables t WHERE EXISTS (SELECT 1 FROM std_categories d
  WHERE d.validate_geometry AND regexp_matches(t.schema_name, concat('^(sk0|sk1|sk2|skx)_', d.prefix, '_')))
""")
def _(fx):
    return names.tables_to_validate(fx["inv_tables"], CFG)


@query("n19_check_schema_renames", """
SELECT d.seq, d.schema_name, 'schema_rename_blocked' AS code,
  coalesce(r.n, 0) AS n_roles, coalesce(m.n, 0) AS n_history_tables
FROM schema_ddl d
LEFT JOIN (SELECT s.schema_name, count(*) AS n FROM inv_schemas s JOIN inv_roles r ON r.role_name IN
  (concat('r_', s.schema_name), concat('w_', s.schema_name), concat('gs_r_', s.schema_name), concat('gs_w_', s.schema_name)) GROUP BY 1) r
  ON r.schema_name = d.schema_name
LEFT JOIN (SELECT parent_schema, count(*) AS n FROM history_metadata GROUP BY 1) m ON m.parent_schema = d.schema_name
WHERE lower(d.command) LIKE 'alter schema %' AND regexp_matches(lower(d.command), ' rename +to ')
""")
def _(fx):
    return names.check_schema_renames(fx["schema_ddl"], fx["inv_roles"], fx["history_metadata"])
