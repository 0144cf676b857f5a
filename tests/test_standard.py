"""The standard, its rules, and single-table conforming."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablekeep.config import Config, Level, StandardColumn, config_from_frames, load_config, save_config
from tablekeep.functions import rules
from tablekeep.functions.rules import rule_problem
from tablekeep.operators import access, conform, constraints, history, names, reconcile, registers
from tablekeep.session import scratch_path
from tablekeep.sources.inventory import inventory_of_frames
from tablekeep.sources.text import decode_text

CFG = Config()
AS_OF = "2024-02-01 00:00:00"


@pytest.mark.parametrize(
    "rule,problem",
    [
        ("IS NOT NULL", None),
        ("LIKE '%_kba_%'", None),
        ("IN ('a', 'b')", None),
        ("NOT LIKE '%_sys_%'", None),
        ("= 'a'; DROP TABLE x", "semicolon"),
        ("= " + "'" + "x" * 250 + "'", "too_long"),
        ("upper(x)", "bad_start"),
        ("= 'a", "unbalanced_quote"),
        ("= (SELECT 'a')", "not_a_literal_test"),
        ("= current_user()", "not_a_literal_test"),
        ("LIKE 'a' OR", "syntax"),
        (None, "missing"),
    ],
)
def test_rule_safety(spark, rule, problem):
    assert rule_problem(rule) == problem


def schema_status(spark, *schemas):
    df = spark.createDataFrame([(s,) for s in schemas], "schema_name string")
    return {r.schema_name: r.status for r in names.check_schema_names(df, CFG).collect()}


def test_schema_names(spark):
    got = schema_status(spark, "sk0_ext_sgu", "sk1_kba_bygg", "skx_sys_x", "sk9_ext_a", "sk0_foo_a", "sk0_ext_", "public", "pg_toast", "min_data")
    assert got == {
        "sk0_ext_sgu": "valid", "sk1_kba_bygg": "valid", "skx_sys_x": "valid", "sk9_ext_a": "invalid", "sk0_foo_a": "invalid",
        "sk0_ext_": "invalid", "public": "exempt", "pg_toast": "exempt", "min_data": "invalid",
    }


def test_table_rules(spark):
    tables = [
        ("a_p", "POINT"), ("b_l", "POINT"), ("karp", "POINT"), ("rör_l", "LINESTRING"), ("åkrar_y", "MULTIPOLYGON"),
        ("c_p", None), ("d", None), ("m_p", "POINTM"), ("x" * 55, None), ("k_g", "GEOMETRY"),
    ]
    inv = spark.createDataFrame([(i, "sk1_kba_a", t) for i, (t, _) in enumerate(tables)], "table_id long, schema_name string, table_name string")
    geo = spark.createDataFrame(
        [("sk1_kba_a", t, "geom", g) for t, g in tables if g], "schema_name string, table_name string, geometry_column string, type string"
    )
    got = {r.table_name: r.code for r in names.check_tables(inv, geo).collect()}
    assert {k: v for k, v in got.items() if v} == {"b_l": "wrong_suffix", "c_p": "reserved_suffix", "x" * 55: "name_too_long"}
    strict = {r.table_name: r.code for r in names.check_tables(inv, geo, strict=True).collect()}
    assert strict["karp"] == "wrong_suffix"


def test_conform_orders_columns_and_drops_collisions(spark):
    df = spark.createDataFrame([("b", "me", "g1", 2), ("a", "you", "g2", 1)], "namn string, skapad_av string, geom string, nr int")
    out = conform.conform(df, "sk1_kba_test", CFG, AS_OF, "anna", ["nr"])
    assert out.columns == ["gid", "namn", "nr", "skapad_tidpunkt", "skapad_av", "andrad_tidpunkt", "andrad_av", "geom"]
    rows = {r.namn: r for r in out.collect()}
    assert rows["a"].gid == 1 and rows["b"].gid == 2
    assert rows["a"].skapad_av == "anna" and rows["a"].andrad_tidpunkt is None
    external = conform.conform(df, "sk0_ext_test", CFG, AS_OF, "anna", ["nr"])
    assert external.columns == ["gid", "namn", "nr", "skapad_tidpunkt", "geom"]


def test_reserved_words_are_quoted(spark):
    words = ["left", "right", "select", "where", "order", "group", "check", "end", "desc", "from", "do", "null", "column", "like"]
    layouts = spark.createDataFrame(
        [("s", "t", i, w, "text", None) for i, w in enumerate(words)],
        "schema_name string, table_name string, position int, column_name string, data_type string, default_value string",
    )
    text = conform.create_statements(layouts).first().statement
    assert all(f'"{w}" text' in text for w in words)


def test_config_round_trip(spark):
    path = scratch_path(spark, "config")
    mine = CFG.with_(levels=CFG.levels + (Level("sc1", "custom", True, False),))
    save_config(mine, spark, path)
    back = load_config(spark, path)
    assert sorted(back.levels) == sorted(mine.levels) and sorted(back.columns, key=str) == sorted(mine.columns, key=str)
    assert load_config(spark) == CFG
    assert Config(levels=()).schema_pattern("kept") == "kept"


def test_config_of_any_size(spark):
    many = spark.range(3000).selectExpr("concat('l', id) AS prefix", "'d' AS description", "true AS publish", "false AS anonymous_read")
    assert len(config_from_frames({"levels": many}).levels) == 3000


def test_defaults_run_only_literals():
    assert rules.is_literal("'it''s'") and rules.is_literal("-1.5") and rules.is_literal("NULL") and rules.is_literal("true")
    assert not any(map(rules.is_literal, ["f(1)", "a", "'a' || 'b'", "1; 2", "'\\'"]))
    with pytest.raises(ValueError):
        conform.default_value("java_method('a', 'b')", AS_OF, "u")


def test_check_columns_sort_as_numbers(spark):
    rows = [("s", "t", "c", "c", "12,2,10,2", ""), ("s", "t", "u", "u", "10,2", "")]
    given = spark.createDataFrame(rows, "schema_name string, table_name string, constraint_name string, contype string, conkey string, definition string")
    none = spark.createDataFrame([], "schema_name string, table_name string, column_name string, ordinal_position int, not_null boolean, default_expr string, identity_kind string")
    assert {r.rule_name: r["columns"] for r in constraints.classify_rules(given, none).collect()} == {"c": "2,10,12", "u": "10,2"}


def test_roles_at_any_depth(spark):
    chain = [(f"r{i}", f"r{i + 1}") for i in range(100)] + [("r100", "r0")]
    assert access.effective_roles(spark.createDataFrame(chain, "member string, group_role string")).count() == 101 * 101


def test_attempts_follow_the_sequence(spark):
    rows = [("c", i + 1, dt.datetime(2024, 1, 1, *t), "timeout", None, "x") for i, t in enumerate([(10, 0, 5), (9, 59, 59), (10, 0, 10)])]
    calls = spark.createDataFrame(rows, "call_id string, seq long, ts timestamp_ntz, outcome string, status_code int, channel string")
    assert [r.attempt for r in reconcile.classify_attempts(calls).orderBy("seq").collect()] == [1, 2, 3]


def test_as_of_keeps_rows_without_creation_time(spark):
    now = spark.createDataFrame([(1, None), (2, dt.datetime(2024, 1, 1)), (3, dt.datetime(2025, 1, 1))], "gid long, skapad_tidpunkt timestamp_ntz")
    log = spark.createDataFrame([], "h_ts timestamp_ntz, seq long, gid long, skapad_tidpunkt timestamp_ntz")
    assert sorted(r.gid for r in history.as_of(now, log, ["gid"], "2024-06-01 00:00:00").collect()) == [1, 2]


def test_deleted_rows_carry_own_defaults(spark):
    before = spark.createDataFrame([(1, "x", "old")], "gid long, v string, note string")
    out = history.history_from_snapshots(before, before.limit(0), ["gid"], AS_OF, "anna", {"note": "'gone'"}).collect()
    assert [(r.h_type, r.v, r.note) for r in out] == [("D", "x", "gone")]


def test_public_and_temporary_tables_are_not_judged(spark):
    rows = [(i, s, "a_p", "CREATE TABLE", u, None) for i, (s, u) in enumerate([("public", "fme"), ("pg_temp_3", "fme"), ("public", "anna"), ("sk0_ext_a", "fme"), ("sk0_ext_b", "anna")])]
    log = spark.createDataFrame(rows, "seq long, schema_name string, table_name string, command string, session_user_name string, geom_type string")
    log = log.selectExpr("*", "'anna' AS current_user_name", "'psql' AS application_name", "timestamp_ntz '2024-01-01' AS ts")
    assert [r.schema_name for r in registers.pending_from_log(log, CFG).collect()] == ["sk0_ext_a"]
    assert [r.schema_name for r in registers.rejected_creations(log, CFG).collect()] == ["sk0_ext_b"]


def test_custom_default_and_rule(spark):
    cfg = CFG.with_(columns=CFG.columns + (StandardColumn("kommun", 2, "text", "'1384'", "= 'sk0_ext_a'", False, None),))
    df = spark.range(2).withColumnRenamed("id", "nr")
    assert conform.conform(df, "sk0_ext_a", cfg, AS_OF, "u", ["nr"]).columns[:3] == ["gid", "kommun", "nr"]
    assert "kommun" not in conform.conform(df, "sk0_ext_b", cfg, AS_OF, "u", ["nr"]).columns


def test_inventory_of_frames(spark):
    inv = inventory_of_frames(spark, {("sk0_ext_a", "t"): spark.range(1)})
    assert inv["inv_columns"].select("column_name", "data_type").first() == ("id", "bigint")


def test_windows_1252(spark):
    df = spark.createDataFrame([(bytearray(b"Sch\xf6n"),), (bytearray("Schön".encode()),), (bytearray(b"\x80 5"),)], "b binary")
    got = [(r.b_text, r.b_was_utf8) for r in decode_text(df, "b").collect()]
    assert got == [("Schön", False), ("Schön", True), ("€ 5", False)]


def test_gid_is_replaced(spark):
    df = spark.createDataFrame([(99, "a"), (98, "b")], "gid long, v string")
    assert [tuple(r) for r in conform.assign_gid(df, ["v"], start=10).orderBy("gid").collect()] == [(10, "a"), (11, "b")]


def test_plans_stay_clean(spark):
    """Audits need no Python worker and no nested-loop join."""
    from tablekeep.plans import QUERIES

    for name in ("n03_parse_schemas", "n06_publishable_schemas", "n18_tables_to_validate", "c06_check_layout", "r01_expected_roles"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    assert F is not None
