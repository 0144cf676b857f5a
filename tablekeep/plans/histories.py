"""Catalogue: row history."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablekeep.config import Config
from tablekeep.operators import history
from tablekeep.plans.catalog import query
from tablekeep.plans.conforming import TYPE_TEXT

CFG = Config()
AS_OF = "2024-02-01 00:00:00"
TRACKED = ["andrad_tidpunkt", "andrad_av"]


@query("h01_qa_columns", """
SELECT schema_name, table_name, column_name, CASE column_name WHEN 'andrad_av' THEN 'session_user' ELSE 'NOW()' END AS expression
FROM laid_out_columns WHERE column_name IN ('andrad_tidpunkt', 'andrad_av')
""")
def _(fx):
    return history.qa_columns(fx["laid_out_columns"], CFG)


@query("h02_history_layouts", f"""
WITH r AS (SELECT schema_name, table_name, ordinal_position AS k, column_name, {TYPE_TEXT} AS full_type FROM inv_columns
  UNION ALL SELECT DISTINCT schema_name, table_name, -3, 'h_type', 'char(1)' FROM inv_columns
  UNION ALL SELECT DISTINCT schema_name, table_name, -2, 'h_ts', 'timestamptz' FROM inv_columns
  UNION ALL SELECT DISTINCT schema_name, table_name, -1, 'h_by', 'text' FROM inv_columns)
SELECT schema_name, table_name, left(concat(table_name, '_h'), 63) AS history_table,
  row_number() OVER (PARTITION BY schema_name, table_name ORDER BY k) AS position, column_name, full_type FROM r
""")
def _(fx):
    return history.history_layouts(fx["inv_columns"])


@query("h03_history_from_snapshots", f"""
SELECT CASE WHEN a.gid IS NULL THEN 'D' ELSE 'U' END AS h_type, TIMESTAMP '{AS_OF}' AS h_ts, 'anna' AS h_by, b.gid, b.kund, b.status,
  b.total, b.datum, CASE WHEN a.gid IS NULL THEN TIMESTAMP '{AS_OF}' ELSE b.andrad_tidpunkt END AS andrad_tidpunkt,
  CASE WHEN a.gid IS NULL THEN 'anna' ELSE b.andrad_av END AS andrad_av
FROM orders_before b LEFT JOIN orders_after a ON a.gid = b.gid
WHERE a.gid IS NULL OR a.kund IS DISTINCT FROM b.kund OR a.status IS DISTINCT FROM b.status
  OR a.total IS DISTINCT FROM b.total OR a.datum IS DISTINCT FROM b.datum
""")
def _(fx):
    return history.history_from_snapshots(fx["orders_before"], fx["orders_after"], ["gid"], AS_OF, "anna", TRACKED)


# The feed folded change by change, so nothing of the windowed plan is repeated in the check.
FOLD = """
WITH feed AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY ts, seq) AS k FROM change_feed),
fold AS (
  SELECT c.gid, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS h_type, CAST(NULL AS TIMESTAMP) AS h_ts,
    CAST(NULL AS VARCHAR) AS h_by, true AS live, c.varde, c.detalj, c.skapad_tidpunkt, c.skapad_av, c.andrad_tidpunkt, c.andrad_av,
    CAST(NULL AS DOUBLE) AS o_varde, CAST(NULL AS VARCHAR) AS o_detalj, CAST(NULL AS TIMESTAMP) AS o_ct, CAST(NULL AS VARCHAR) AS o_cb,
    CAST(NULL AS TIMESTAMP) AS o_mt, CAST(NULL AS VARCHAR) AS o_mb
  FROM {start} c
  UNION ALL
  SELECT f.gid, f.k, f.seq, CASE WHEN s.live AND f.op IN ('U', 'D') THEN f.op END, f.ts, f.changed_by,
    CASE f.op WHEN 'I' THEN true WHEN 'D' THEN false ELSE s.live END,
    CASE WHEN (f.op = 'I' AND NOT s.live) OR (f.op = 'U' AND s.live) THEN f.varde ELSE s.varde END,
    CASE WHEN (f.op = 'I' AND NOT s.live) OR (f.op = 'U' AND s.live) THEN f.detalj ELSE s.detalj END,
    CASE WHEN f.op = 'I' AND NOT s.live THEN f.ts ELSE s.skapad_tidpunkt END,
    CASE WHEN f.op = 'I' AND NOT s.live THEN f.changed_by ELSE s.skapad_av END,
    CASE WHEN f.op = 'I' AND NOT s.live THEN NULL WHEN f.op = 'U' AND s.live THEN f.ts ELSE s.andrad_tidpunkt END,
    CASE WHEN f.op = 'I' AND NOT s.live THEN NULL WHEN f.op = 'U' AND s.live THEN f.changed_by ELSE s.andrad_av END,
    s.varde, s.detalj, s.skapad_tidpunkt, s.skapad_av,
    CASE WHEN f.op = 'D' THEN f.ts ELSE s.andrad_tidpunkt END, CASE WHEN f.op = 'D' THEN f.changed_by ELSE s.andrad_av END
  FROM fold s JOIN feed f ON f.gid = s.gid AND f.k = s.k + 1)
"""
EMPTY_START = """(SELECT DISTINCT gid, CAST(NULL AS DOUBLE) AS varde, CAST(NULL AS VARCHAR) AS detalj, CAST(NULL AS TIMESTAMP) AS skapad_tidpunkt,
  CAST(NULL AS VARCHAR) AS skapad_av, CAST(NULL AS TIMESTAMP) AS andrad_tidpunkt, CAST(NULL AS VARCHAR) AS andrad_av FROM change_feed)"""
WITH_CURRENT = """(SELECT * FROM current_rows UNION ALL SELECT DISTINCT gid, CAST(NULL AS DOUBLE), NULL, CAST(NULL AS TIMESTAMP), NULL,
  CAST(NULL AS TIMESTAMP), NULL FROM change_feed WHERE gid NOT IN (SELECT gid FROM current_rows))"""
HISTORY_OUT = """SELECT h_type, h_ts, h_by, gid, seq, o_varde AS varde, o_detalj AS detalj, o_ct AS skapad_tidpunkt, o_cb AS skapad_av,
  o_mt AS andrad_tidpunkt, o_mb AS andrad_av FROM fold WHERE h_type IS NOT NULL"""
FOLD_EMPTY = FOLD.replace("{start}", EMPTY_START).replace("true AS live", "false AS live")
FOLD_CURRENT = FOLD.replace("{start}", WITH_CURRENT).replace("true AS live", "c.skapad_tidpunkt IS NOT NULL AS live")


@query("h04_history_from_changes", FOLD_EMPTY + HISTORY_OUT)
def _(fx):
    return history.history_from_changes(fx["change_feed"], ["gid"], ["varde", "detalj"])


@query("h04_history_with_current", FOLD_CURRENT + HISTORY_OUT)
def _(fx):
    return history.history_from_changes(fx["change_feed"], ["gid"], ["varde", "detalj"], current=fx["current_rows"])


@query("h05_apply_changes", FOLD_CURRENT + """SELECT gid, varde, detalj, skapad_tidpunkt, skapad_av, andrad_tidpunkt, andrad_av
FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY k DESC) AS last FROM fold) WHERE last = 1 AND live""")
def _(fx):
    return history.apply_changes(fx["current_rows"], fx["change_feed"], ["gid"], ["varde", "detalj"])


@query("h06_history_recent", "SELECT * FROM history_rows ORDER BY h_ts DESC, seq LIMIT 20")
def _(fx):
    return history.history_recent(fx["history_rows"], 20, ["seq"])


@query("h07_history_of_row", "SELECT * FROM history_rows WHERE gid = 7")
def _(fx):
    return history.history_of_row(fx["history_rows"], "gid", 7)


@query("h08_history_by_user", f"""
SELECT * FROM history_rows WHERE h_by = 'user_3' AND h_ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY
""")
def _(fx):
    return history.history_by_user(fx["history_rows"], "user_3", AS_OF, 7)


@query("h09_restore_deleted", """
SELECT gid, seq, varde, status FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY h_ts DESC, seq DESC) AS k
  FROM history_rows WHERE h_type = 'D') WHERE k = 1 AND gid NOT IN (SELECT gid FROM current_rows)
""")
def _(fx):
    return history.restore_deleted(fx["history_rows"], fx["current_rows"], ["gid"], ["h_ts", "seq"])


@query("h10_tables_with_history", """
SELECT t.table_id, t.schema_name, t.table_name, m.history_table, m.history_table IS NOT NULL AS has_history
FROM inv_tables t LEFT JOIN history_metadata m ON m.table_id = t.table_id
""")
def _(fx):
    return history.tables_with_history(fx["inv_tables"], fx["history_metadata"])


@query("h11_history_schema_diff", f"""
WITH p AS (SELECT c.schema_name, m.history_table, c.column_name, c.data_type, {TYPE_TEXT} AS full_type
  FROM inv_columns c JOIN history_metadata m ON m.parent_schema = c.schema_name AND m.parent_table = c.table_name),
h AS (SELECT * FROM inv_history_columns)
SELECT p.schema_name, p.history_table, p.column_name, 'missing' AS problem, p.full_type AS type_to_add FROM p
  WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.schema_name = p.schema_name AND h.history_table = p.history_table AND h.column_name = p.column_name)
UNION ALL SELECT h.schema_name, h.history_table, h.column_name, 'extra', NULL FROM h WHERE NOT starts_with(h.column_name, 'h_')
  AND NOT EXISTS (SELECT 1 FROM p WHERE h.schema_name = p.schema_name AND h.history_table = p.history_table AND h.column_name = p.column_name)
UNION ALL SELECT p.schema_name, p.history_table, p.column_name, 'type_mismatch', NULL FROM p JOIN h USING (schema_name, history_table, column_name)
  WHERE h.data_type <> p.data_type
""")
def _(fx):
    return history.history_schema_diff(fx["inv_columns"], fx["inv_history_columns"], fx["history_metadata"])


@query("h12_sync_history", """
SELECT h_type, h_ts, h_by, gid, seq, varde, status, CAST(NULL AS BIGINT) AS kund, CAST(NULL AS TIMESTAMP) AS andrad_tidpunkt,
  CAST(NULL AS VARCHAR) AS andrad_av, CAST(NULL AS VARCHAR) AS geom,
  'h_type,h_ts,h_by,gid,seq,varde,status,kund,andrad_tidpunkt,andrad_av,geom' AS column_order FROM history_rows
""")
def _(fx):
    parent = fx.sql(
        "SELECT gid, varde, status, 'p' AS geom, CAST(NULL AS TIMESTAMP_NTZ) AS andrad_tidpunkt, gid AS kund, h_by AS andrad_av FROM history_rows"
    )
    out = history.sync_history(fx["history_rows"], parent, "sk1_kba_x", CFG)
    return out.withColumn("column_order", F.lit(",".join(out.columns)))


@query("h13_propagate_renames", """
WITH r AS (SELECT table_id, new_name, row_number() OVER (PARTITION BY table_id ORDER BY seq DESC) AS k FROM ddl_log WHERE command = 'RENAME TO')
SELECT m.table_id, m.parent_schema, coalesce(r.new_name, m.parent_table) AS parent_table, m.history_schema,
  coalesce(left(r.new_name || '_h', 63), m.history_table) AS history_table
FROM history_metadata m LEFT JOIN r ON r.table_id = m.table_id AND r.k = 1
""")
def _(fx):
    return history.propagate_renames(fx["history_metadata"], fx["ddl_log"])


DROPS = """(SELECT * FROM ddl_log WHERE command = 'DROP TABLE' AND right(table_name, 2) <> '_h' AND schema_name <> 'public' AND left(schema_name, 3) <> 'pg_')"""


@query("h14_drop_cleanup", f"""
SELECT d.table_id, d.schema_name, d.table_name, coalesce(m.history_table, concat(d.table_name, '_h')) AS history_table,
  CASE WHEN m.table_id IS NULL THEN 'default_name' ELSE 'metadata' END AS found_by,
  EXISTS (SELECT 1 FROM inv_all_tables t WHERE t.schema_name = d.schema_name
    AND t.table_name = coalesce(m.history_table, concat(d.table_name, '_h'))) AS history_exists,
  concat('trg_fn_', d.table_name, '_qa') AS trigger_function,
  (d.schema_name, concat('trg_fn_', d.table_name, '_qa')) IN (SELECT (schema_name, function_name) FROM qa_functions) AS function_exists
FROM (SELECT DISTINCT table_id, schema_name, table_name FROM {DROPS}) d
LEFT JOIN history_metadata m ON m.table_id = d.table_id
""")
def _(fx):
    return history.drop_cleanup(fx["ddl_log"], fx["history_metadata"], fx["inv_all_tables"], fx["qa_functions"])


@query("h14_registers_after_drop", f"""
SELECT r.* FROM register_rows r WHERE NOT EXISTS (SELECT 1 FROM {DROPS} d
  WHERE d.schema_name = r.schema_name AND d.table_name = r.table_name AND d.seq >= coalesce(r.seq, -1))
""")
def _(fx):
    return history.registers_after_drop(fx["register_rows"], fx["ddl_log"])


@query("h14_metadata_after_drop", f"SELECT * FROM history_metadata WHERE table_id NOT IN (SELECT table_id FROM {DROPS})")
def _(fx):
    return history.metadata_after_drop(fx["history_metadata"], fx["ddl_log"])


@query("h14_table_lifetimes", f"""
WITH e AS (SELECT schema_name, table_name, seq AS until FROM {DROPS}
  UNION ALL SELECT DISTINCT schema_name, table_name, CAST(NULL AS BIGINT) FROM ddl_log)
SELECT schema_name, table_name, row_number() OVER w AS life, lag(until) OVER w AS since, until
FROM e WINDOW w AS (PARTITION BY schema_name, table_name ORDER BY until NULLS LAST)
""")
def _(fx):
    return history.table_lifetimes(fx["ddl_log"])


@query("h15_as_of", FOLD_CURRENT + """SELECT gid, varde, detalj, skapad_tidpunkt, skapad_av FROM (
  SELECT *, row_number() OVER (PARTITION BY gid ORDER BY k DESC) AS last FROM fold WHERE h_ts IS NULL OR h_ts <= TIMESTAMP '2024-01-15 12:00:00')
WHERE last = 1 AND live""")
def _(fx):
    feed, now = fx["change_feed"], fx["current_rows"]
    log = history.history_from_changes(feed, ["gid"], ["varde", "detalj"], current=now)
    after = history.apply_changes(now, feed, ["gid"], ["varde", "detalj"])
    # A delete overwrites the tracked columns of its own image, so those two are not compared.
    return history.as_of(after, log, ["gid"], "2024-01-15 12:00:00").drop(*TRACKED)


@query("h16_change_summary", """
SELECT h_by, CAST(h_ts AS DATE) AS day, h_type, count(*) AS n_changes FROM history_rows GROUP BY 1, 2, 3
""")
def _(fx):
    return history.change_summary(fx["history_rows"])


@query("h16_changed_columns", """
WITH n AS (SELECT h_type, varde, status, lead(varde) OVER w AS next_varde, lead(status) OVER w AS next_status, lead(gid) OVER w AS more
  FROM history_rows WINDOW w AS (PARTITION BY gid ORDER BY h_ts, seq))
SELECT 'varde' AS column_name, count(*) FILTER (WHERE varde IS DISTINCT FROM next_varde) AS n_changes FROM n WHERE more IS NOT NULL AND h_type = 'U'
UNION ALL SELECT 'status', count(*) FILTER (WHERE status IS DISTINCT FROM next_status) FROM n WHERE more IS NOT NULL AND h_type = 'U'
""")
def _(fx):
    return history.changed_columns(fx["history_rows"], ["gid"], ["varde", "status"])
