"""Catalogue: registers, maintenance, access model, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablekeep.config import Config
from tablekeep.operators import access, names, reconcile, registers
from tablekeep.plans.catalog import query
from tablekeep.plans.names import BASAL, SUFFIX

CFG = Config()
AS_OF = "2024-02-01 00:00:00"

# One pass per log row with correlated look-backs; the Spark side folds the log instead.
LOG = """
WITH e AS MATERIALIZED (SELECT *, lower(session_user_name) = 'fme' OR lower(current_user_name) = 'fme' OR lower(application_name) = 'fme' AS sysuser,
    CASE WHEN regexp_matches(table_name, '_[plyg]$') THEN right(table_name, 2) END AS own,
    CASE geom_type WHEN 'POINT' THEN '_p' WHEN 'LINESTRING' THEN '_l' WHEN 'POLYGON' THEN '_y' END AS wanted FROM ddl_log
  WHERE schema_name <> 'public' AND NOT starts_with(schema_name, 'pg_temp')),
m AS MATERIALIZED (SELECT *, CASE WHEN command = 'DROP TABLE' OR (command = 'ADD GEOMETRY' AND (own IS NULL OR own = wanted)) THEN 'clear'
    WHEN command = 'CREATE TABLE' AND own IS NOT NULL AND sysuser THEN 'set' END AS mark FROM e),
s AS MATERIALIZED (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY schema_name, table_name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM m),
arrivals AS (SELECT seq, schema_name, table_name, coalesce(before = 'set', false) AS was_pending, wanted AS expected_suffix,
  CASE WHEN before = 'set' THEN CASE WHEN own <> wanted THEN 'suffix_conflict' ELSE 'completed' END
    WHEN right(table_name, 1) = right(wanted, 1) THEN 'accepted' ELSE 'wrong_suffix' END AS outcome FROM s WHERE command = 'ADD GEOMETRY'),
pending AS MATERIALIZED (SELECT schema_name, table_name, arg_min(ts, seq) AS registered_at, arg_min(session_user_name, seq) AS registered_by FROM m x
  WHERE mark = 'set' AND seq > coalesce((SELECT max(seq) FROM m y WHERE y.mark = 'clear' AND y.schema_name = x.schema_name AND y.table_name = x.table_name), -1)
  GROUP BY 1, 2)
"""


@query("m01_pending_from_log", LOG + "SELECT * FROM pending")
def _(fx):
    return registers.pending_from_log(fx["ddl_log"], CFG)


@query("m01_rejected_creations", LOG + """SELECT seq, schema_name, table_name, 'reserved_suffix' AS code FROM e
WHERE command = 'CREATE TABLE' AND own IS NOT NULL AND NOT sysuser""")
def _(fx):
    return registers.rejected_creations(fx["ddl_log"], CFG)


@query("m02_geometry_arrivals", LOG + """SELECT *, CASE WHEN outcome = 'wrong_suffix'
  THEN concat(regexp_replace(table_name, '_[plyg]$', ''), expected_suffix) END AS suggested_name FROM arrivals""")
def _(fx):
    return registers.geometry_arrivals(fx["ddl_log"], CFG)


@query("m02_pending_suffix_conflicts", LOG + "SELECT seq, schema_name, table_name, expected_suffix FROM arrivals WHERE outcome = 'suffix_conflict'")
def _(fx):
    return registers.pending_suffix_conflicts(fx["ddl_log"], CFG)


@query("m03_unregistered_geometry", LOG + """SELECT seq, schema_name, table_name, expected_suffix,
  concat(regexp_replace(table_name, '_[plyg]$', ''), expected_suffix) AS suggested_name FROM arrivals WHERE outcome = 'wrong_suffix'""")
def _(fx):
    return registers.unregistered_geometry(fx["ddl_log"], CFG)


@query("m04_pending_age", LOG + """
SELECT schema_name, table_name, registered_by, CAST(floor(epoch(TIMESTAMP '2024-01-31 00:00:00')) - floor(epoch(registered_at)) AS BIGINT) AS elapsed_seconds,
  CASE WHEN floor(epoch(TIMESTAMP '2024-01-31 00:00:00')) - floor(epoch(registered_at)) < 3600 THEN 'normal'
    WHEN floor(epoch(TIMESTAMP '2024-01-31 00:00:00')) - floor(epoch(registered_at)) < 86400 THEN 'likely_failed' ELSE 'critical' END AS status,
  registered_at < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 2 HOUR AS alert FROM pending
""")
def _(fx):
    return registers.pending_age(registers.pending_from_log(fx["ddl_log"], CFG), "2024-01-31 00:00:00")


RULES = """
WITH w AS (
SELECT DISTINCT schema_name, table_name, 'force_gid' AS rule FROM gid_tables WHERE regexp_matches(schema_name, '^(sk0|sk1|sk2|skx)_')
UNION SELECT schema_name, table_name, 'check_geometry' FROM inv_geometry g WHERE geometry_column = 'geom' AND regexp_matches(schema_name, '^(sk0|sk1|sk2|skx)_kba_')
UNION SELECT schema_name, table_name, 'drop_placeholder' FROM placeholder_register r
  WHERE EXISTS (SELECT 1 FROM inv_tables t WHERE t.schema_name = r.schema_name AND t.table_name = r.table_name)
UNION SELECT t.schema_name, t.table_name, concat('trg_', t.table_name, '_qa') FROM inv_tables t JOIN qa_functions q
  ON q.schema_name = t.schema_name AND q.function_name = concat('trg_fn_', t.table_name, '_qa') WHERE regexp_matches(t.schema_name, '^(sk0|sk1|sk2|skx)_')),
r AS (SELECT w.*, CASE WHEN EXISTS (SELECT 1 FROM inv_triggers i WHERE i.schema_name = w.schema_name AND i.table_name = w.table_name
  AND i.trigger_name = w.rule) THEN 'exists' ELSE 'create' END AS action FROM w)
"""


def _row_rules(fx):
    return registers.missing_row_rules(
        fx["inv_tables"], fx["gid_tables"], fx["inv_geometry"], fx["placeholder_register"], fx["qa_functions"], fx["inv_triggers"], CFG
    )


@query("m05_missing_row_rules", RULES + "SELECT * FROM r")
def _(fx):
    return _row_rules(fx)


@query("a08_action_summary", RULES + """SELECT CASE WHEN starts_with(rule, 'trg_') THEN 'history' ELSE rule END AS rule_kind, action, count(*) AS n_tables
FROM r GROUP BY 1, 2""")
def _(fx):
    return registers.action_summary(_row_rules(fx))


@query("m06_stale_registers", """
SELECT r.* FROM placeholder_register r LEFT JOIN inv_tables t ON t.schema_name = r.schema_name AND t.table_name = r.table_name WHERE t.table_id IS NULL
""")
def _(fx):
    return registers.stale_registers(fx["placeholder_register"], fx["inv_tables"])


@query("m07_duplicate_spatial_indexes", """
SELECT schema_name, table_name, index_name FROM inv_indexes WHERE method = 'gist' AND index_name <> concat(left(table_name, 50), '_geom_gidx')
""")
def _(fx):
    return registers.duplicate_spatial_indexes(fx["inv_indexes"])


SRIDS = f"""(SELECT schema_name, table_name, min(srid) AS srid, TIMESTAMP '{AS_OF}' AS registered_at, 'steward' AS registered_by FROM inv_geometry
  WHERE srid <> 3007 AND schema_name <> 'public' AND NOT starts_with(schema_name, 'pg_temp')
    AND (schema_name, table_name) IN (SELECT (schema_name, table_name) FROM inv_tables)
    AND (schema_name, table_name) NOT IN (SELECT (schema_name, concat(table_name, '_h')) FROM inv_tables)
    AND (schema_name, table_name) NOT IN (SELECT (schema_name, table_name) FROM inv_columns WHERE column_name LIKE '%_temp0001')
  GROUP BY 1, 2)"""


@query("g11_srid_deviations", f"SELECT * FROM {SRIDS}")
def _(fx):
    return registers.srid_deviations(fx["inv_geometry"], CFG, AS_OF, "steward", names.in_scope(fx["inv_tables"], fx["inv_columns"]))


REGISTER = """SELECT schema_name, table_name, 9999 AS srid, CAST('2023-05-05 00:00:00' AS TIMESTAMP) AS registered_at, 'old' AS registered_by
  FROM inv_tables WHERE kind IN ('LARGE', 'ECONOMY')"""


@query("s06_register_update", f"""
SELECT coalesce(n.schema_name, o.schema_name) AS schema_name, coalesce(n.table_name, o.table_name) AS table_name, coalesce(n.srid, o.srid) AS srid,
  coalesce(n.registered_at, o.registered_at) AS registered_at, coalesce(n.registered_by, o.registered_by) AS registered_by
FROM ({REGISTER}) o FULL OUTER JOIN {SRIDS} n ON n.schema_name = o.schema_name AND n.table_name = o.table_name
""")
def _(fx):
    old = fx.sql(REGISTER).withColumn("registered_at", F.col("registered_at").cast("timestamp_ntz"))
    return registers.merge_register(old, registers.srid_deviations(fx["inv_geometry"], CFG, AS_OF, "steward", names.in_scope(fx["inv_tables"], fx["inv_columns"])), registers.KEY)


@query("s06_register_ignore", f"""
SELECT coalesce(n.schema_name, o.schema_name) AS schema_name, coalesce(n.table_name, o.table_name) AS table_name, coalesce(o.srid, n.srid) AS srid,
  coalesce(o.registered_at, n.registered_at) AS registered_at, coalesce(o.registered_by, n.registered_by) AS registered_by
FROM ({REGISTER}) o FULL OUTER JOIN {SRIDS} n ON n.schema_name = o.schema_name AND n.table_name = o.table_name
""")
def _(fx):
    old = fx.sql(REGISTER).withColumn("registered_at", F.col("registered_at").cast("timestamp_ntz"))
    return registers.merge_register(old, registers.srid_deviations(fx["inv_geometry"], CFG, AS_OF, "steward", names.in_scope(fx["inv_tables"], fx["inv_columns"])), registers.KEY, update=False)


@query("g12_placeholder_geometry", f"""
SELECT schema_name, table_name, srid, CASE {BASAL} WHEN 'POINT' THEN 'POINT(160000 6395000)' WHEN 'MULTIPOINT' THEN 'MULTIPOINT((160000 6395000))'
  WHEN 'LINESTRING' THEN 'LINESTRING(160000 6395000, 160100 6395100)' WHEN 'MULTILINESTRING' THEN 'MULTILINESTRING((160000 6395000, 160100 6395100))'
  WHEN 'MULTIPOLYGON' THEN 'MULTIPOLYGON(((160000 6395000, 160100 6395000, 160100 6395100, 160000 6395100, 160000 6395000)))'
  ELSE 'POLYGON((160000 6395000, 160100 6395000, 160100 6395100, 160000 6395100, 160000 6395000))' END AS placeholder
FROM inv_geometry WHERE geometry_column = 'geom'
""")
def _(fx):
    return registers.placeholder_geometry(fx["inv_geometry"])


# Rows of governed tables: the registered placeholder (gid = table_id) and, for many, real rows.
TABLE_ROWS = """SELECT t.schema_name, t.table_name, CAST(t.table_id AS BIGINT) AS gid, 'placeholder' AS body FROM inv_tables t WHERE t.kind = 'LARGE'
UNION ALL SELECT t.schema_name, t.table_name, 10000000 + l.l_orderkey * 100 + l.l_linenumber, l.l_returnflag FROM lineitem l
  JOIN inv_tables t ON t.table_id = l.l_partkey WHERE t.size_class > 20"""
READY = f"""
WITH r AS MATERIALIZED ({TABLE_ROWS}), g AS MATERIALIZED (SELECT * FROM placeholder_register),
ready AS MATERIALIZED (SELECT DISTINCT r.schema_name, r.table_name FROM r WHERE (r.schema_name, r.table_name) IN (SELECT (schema_name, table_name) FROM g)
  AND (r.schema_name, r.table_name, r.gid) NOT IN (SELECT (schema_name, table_name, gid) FROM g))
"""


def _dropped(fx, part):
    return registers.drop_placeholders(fx.sql(TABLE_ROWS), fx["placeholder_register"], AS_OF, "loader")[part]


@query("g13_drop_placeholders_rows", READY + """SELECT r.* FROM r WHERE NOT ((r.schema_name, r.table_name) IN (SELECT (schema_name, table_name) FROM ready)
  AND (r.schema_name, r.table_name, r.gid) IN (SELECT (schema_name, table_name, gid) FROM g))""")
def _(fx):
    return _dropped(fx, "rows")


@query("g13_drop_placeholders_register", READY + "SELECT g.* FROM g WHERE (schema_name, table_name) NOT IN (SELECT (schema_name, table_name) FROM ready)")
def _(fx):
    return _dropped(fx, "register")


@query("g13_drop_placeholders_history", READY + f"""SELECT 'D' AS h_type, TIMESTAMP '{AS_OF}' AS h_ts, 'loader' AS h_by, r.*, true AS is_placeholder FROM r
WHERE (r.schema_name, r.table_name) IN (SELECT (schema_name, table_name) FROM ready)
  AND (r.schema_name, r.table_name, r.gid) IN (SELECT (schema_name, table_name, gid) FROM g)""")
def _(fx):
    return _dropped(fx, "history")


# ------------------------------------------------------------------ access
EXPECTED = """
WITH x AS (SELECT s.schema_name, replace(r.role, '{schema}', s.schema_name) AS role_name, r.kind, r.login,
    replace(r.inherits, '{schema}', s.schema_name) AS inherits
  FROM inv_schemas s, std_roles r WHERE regexp_matches(s.schema_name, '^(sk0|sk1|sk2|skx)_'))
"""


def _expected(fx):
    return access.expected_roles(access.governed_schemas(names.schema_names(fx["inv_tables"]), CFG), CFG)


@query("r01_expected_roles", EXPECTED + "SELECT * FROM x")
def _(fx):
    return _expected(fx)


@query("r02_role_drift", EXPECTED + """
SELECT x.schema_name, x.role_name,
  CASE WHEN r.role_name IS NULL THEN 'missing' WHEN NOT x.login AND r.can_login THEN 'login_must_go'
    WHEN x.login AND NOT EXISTS (SELECT 1 FROM inv_credentials c WHERE c.role_name = x.role_name AND c.can_login) THEN 'no_credential' ELSE 'correct' END AS state,
  CASE WHEN x.inherits IS NULL THEN NULL WHEN NOT EXISTS (SELECT 1 FROM inv_roles p WHERE p.role_name = x.inherits) THEN 'parent_missing'
    WHEN NOT EXISTS (SELECT 1 FROM inv_members m WHERE m.group_role = x.inherits AND m.member = x.role_name) THEN 'missing' ELSE 'granted' END AS inheritance,
  CASE WHEN EXISTS (SELECT 1 FROM inv_members m WHERE m.group_role = 'service_accounts' AND m.member = x.role_name)
    THEN CASE WHEN x.login THEN 'member' ELSE 'must_leave' END ELSE CASE WHEN x.login THEN 'missing' ELSE 'none' END END AS membership
FROM x LEFT JOIN inv_roles r ON r.role_name = x.role_name
""")
def _(fx):
    return access.role_drift(_expected(fx), fx["inv_roles"], fx["inv_credentials"], fx["inv_members"], CFG)


GRANTED = EXPECTED + """, gr AS (SELECT x.role_name, x.schema_name, p.object_kind, p.privilege FROM x JOIN (VALUES
  ('read', 'schema', 'USAGE'), ('read', 'table', 'SELECT'), ('write', 'schema', 'USAGE'), ('write', 'table', 'SELECT'), ('write', 'table', 'INSERT'),
  ('write', 'table', 'UPDATE'), ('write', 'table', 'DELETE'), ('write', 'sequence', 'USAGE'), ('write', 'sequence', 'SELECT'))
  AS p(kind, object_kind, privilege) ON p.kind = x.kind WHERE x.inherits IS NULL)
"""


@query("r03_expected_grants", GRANTED + "SELECT * FROM gr")
def _(fx):
    return access.expected_grants(_expected(fx))


@query("r04_grant_drift", GRANTED + """SELECT role_name, schema_name, object_kind, privilege, 'missing' AS drift
  FROM (SELECT role_name, schema_name, object_kind, privilege FROM gr EXCEPT SELECT role_name, schema_name, object_kind, privilege FROM actual_grants)
UNION ALL SELECT role_name, schema_name, object_kind, privilege, 'unexpected'
  FROM (SELECT role_name, schema_name, object_kind, privilege FROM actual_grants EXCEPT SELECT role_name, schema_name, object_kind, privilege FROM gr)""")
def _(fx):
    return access.grant_drift(access.expected_grants(_expected(fx)), fx["actual_grants"])


MAPPED = """
WITH a AS (SELECT mapping_id, group_role, schema_role, CASE WHEN group_role NOT IN (SELECT role_name FROM inv_roles) THEN 'skip_group_missing'
  WHEN schema_role NOT IN (SELECT role_name FROM inv_roles) THEN 'skip_role_missing' ELSE 'grant' END AS action FROM group_mappings)
"""


@query("r05_group_grants", MAPPED + "SELECT * FROM a")
def _(fx):
    return access.group_grants(fx["group_mappings"], fx["inv_roles"])


@query("a07_grant_summary", MAPPED + """SELECT count(*) AS handled, count(*) FILTER (WHERE action = 'grant' AND s_suppkey IS NULL) AS granted,
  count(*) FILTER (WHERE action <> 'grant') AS skipped, count(*) FILTER (WHERE action = 'grant' AND s_suppkey IS NOT NULL) AS failed
FROM a LEFT JOIN supplier ON s_suppkey = mapping_id""")
def _(fx):
    failed = fx.table("supplier").select(F.col("s_suppkey").alias("mapping_id"))
    return access.grant_summary(access.group_grants(fx["group_mappings"], fx["inv_roles"]), failed)


@query("r06_roles_to_remove", """
SELECT d.schema_name, r.role_name FROM (SELECT DISTINCT schema_name FROM schema_ddl WHERE lower(command) LIKE 'alter schema%rename%') d
JOIN inv_roles r ON r.role_name IN (concat('r_', d.schema_name), concat('w_', d.schema_name), concat('gs_r_', d.schema_name), concat('gs_w_', d.schema_name))
WHERE d.schema_name NOT IN ('public', 'information_schema') AND left(d.schema_name, 3) <> 'pg_'
""")
def _(fx):
    gone = fx["schema_ddl"].filter("lower(command) LIKE 'alter schema%rename%'")
    return access.roles_to_remove(gone, fx["inv_roles"], CFG)


@query("r07_effective_roles", """
WITH reach AS (SELECT member, group_role FROM inv_members UNION SELECT r.member, m.group_role FROM reach r JOIN inv_members m ON m.member = r.group_role)
SELECT member, group_role FROM reach
""")
def _(fx):
    return access.effective_roles(fx["inv_members"])


LAYERS = """
WITH x AS (SELECT concat(schema_name, '.*.r') AS rule_key, concat('r_', schema_name, CASE WHEN split_part(schema_name, '_', 1) = 'sk0' THEN ',ROLE_ANONYMOUS' ELSE '' END) AS role FROM inv_schemas
  UNION ALL SELECT concat(schema_name, '.*.w'), concat('w_', schema_name) FROM inv_schemas)
"""


@query("r08_layer_rule_drift", LAYERS + """SELECT x.rule_key, x.role, c.role AS current_role,
  CASE WHEN c.role IS NULL THEN 'create' WHEN c.role = x.role THEN 'keep' ELSE 'correct' END AS action
FROM x LEFT JOIN layer_rules c ON c.rule_key = x.rule_key""")
def _(fx):
    return access.layer_rule_drift(access.expected_layer_rules(names.schema_names(fx["inv_tables"]), CFG), fx["layer_rules"])


# ------------------------------------------------------------------ reconciliation
OURS = """
WITH o AS (SELECT schema_name FROM inv_schemas WHERE regexp_matches(schema_name, '^(sk0|sk1)_(ext|kba|sys)_')), t AS (SELECT DISTINCT workspace AS schema_name FROM external_workspaces)
"""
FORWARD = """SELECT schema_name, CASE WHEN schema_name IN (SELECT schema_name FROM t) THEN 'refresh' ELSE 'create' END AS action FROM o
UNION ALL SELECT schema_name, 'orphan' FROM t WHERE schema_name NOT IN (SELECT schema_name FROM o) AND regexp_matches(schema_name, '^(sk0|sk1|sk2|skx)_(ext|kba|sys)_.+$')
  AND split_part(schema_name, '_', 1) IN (SELECT split_part(schema_name, '_', 1) FROM o)"""


@query("t01_reconcile", OURS + FORWARD)
def _(fx):
    return reconcile.reconcile(names.schema_names(fx["inv_tables"]), fx["external_workspaces"], CFG)


@query("t01_reconcile_several", OURS + FORWARD + " AND schema_name NOT IN (SELECT schema_name FROM known_elsewhere)")
def _(fx):
    return reconcile.reconcile(names.schema_names(fx["inv_tables"]), fx["external_workspaces"], CFG, fx["known_elsewhere"])


@query("u02_set_differences", """
SELECT schema_name, 'ours' AS only_in FROM (SELECT schema_name FROM inv_schemas EXCEPT SELECT workspace FROM external_workspaces)
UNION ALL SELECT workspace, 'theirs' FROM (SELECT workspace FROM external_workspaces EXCEPT SELECT schema_name FROM inv_schemas)
""")
def _(fx):
    return reconcile.set_differences(fx["inv_tables"], fx["external_workspaces"].withColumnRenamed("workspace", "schema_name"))


VALID = "(SELECT * FROM schema_events WHERE regexp_matches(payload, '^(sk0|sk1|sk2|skx)_(ext|kba|sys)_.+$'))"


@query("t02_lifecycle_state", f"""
SELECT payload AS schema_name, CASE WHEN channel = 'schema_create' THEN 'present' ELSE 'dropped' END AS state, ts AS since, n_events FROM (
  SELECT *, row_number() OVER (PARTITION BY payload ORDER BY ts DESC, seq DESC) AS k, count(*) OVER (PARTITION BY payload) AS n_events FROM {VALID}) WHERE k = 1
""")
def _(fx):
    return reconcile.lifecycle_state(fx["schema_events"], CFG)


@query("t07_classify_attempts", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY seq) AS attempt FROM call_outcomes)
SELECT call_id, seq, attempt, channel, CASE WHEN outcome <> 'response' THEN 'transient' WHEN status_code >= 400 THEN 'permanent' ELSE 'delivered' END AS kind,
  CASE WHEN outcome <> 'response' THEN CASE attempt WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 3 THEN 10 END END AS wait_seconds FROM n
""")
def _(fx):
    return reconcile.classify_attempts(fx["call_outcomes"])


@query("t07_classify_failures", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY seq) AS attempt FROM call_outcomes),
f AS (SELECT call_id, min(attempt) FILTER (WHERE outcome = 'response') AS fin FROM n WHERE attempt <= 4 GROUP BY 1)
SELECT n.call_id, 'failed' AS status, attempt AS attempts, CASE attempt WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 7 ELSE 17 END AS waited_seconds, NULL AS resend_channel
FROM n JOIN f ON f.call_id = n.call_id AND n.attempt = f.fin WHERE n.status_code >= 400
UNION ALL SELECT n.call_id, 'given_up', 4, 17, n.channel FROM n JOIN f ON f.call_id = n.call_id WHERE f.fin IS NULL AND n.attempt = 4
""")
def _(fx):
    return reconcile.classify_failures(fx["call_outcomes"])


@query("t09_dedupe_events", """
SELECT channel, payload, ts, seq FROM (SELECT *, row_number() OVER (PARTITION BY channel, payload ORDER BY ts, seq) AS k FROM schema_events) WHERE k = 1
""")
def _(fx):
    return reconcile.dedupe_events(fx["schema_events"])
