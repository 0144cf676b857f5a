"""Schema rules: the text after ``<schema name>`` in a yes/no test, kept in the standard."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MAX_LENGTH = 200
# Fixed value: how a rule has to begin.
RULE_START = r"^(=|<>|!=|<|<=|>|>=|LIKE|NOT|IN|IS)\s"

# What may appear in a rule besides string literals: comparison signs, brackets, commas, keywords.
_WORDS = {"LIKE", "NOT", "IN", "IS", "NULL", "AND", "OR", "BETWEEN", "TRUE", "FALSE"}
_LITERAL = re.compile(r"'(?:[^']|'')*'")


def rule_problem(rule: str | None) -> str | None:
    """Why a rule is unsafe or meaningless, or None. Rules become code, so this is strict:
    only literals, comparison signs and a few keywords; a name, call or subquery is refused."""
    if rule is None:
        return "missing"
    if ";" in rule:
        return "semicolon"
    if len(rule) >= MAX_LENGTH:
        return "too_long"
    if not re.match(RULE_START, rule, re.IGNORECASE):
        return "bad_start"
    bare = _LITERAL.sub(" ", rule)
    if "'" in bare:
        return "unbalanced_quote"
    if re.search(r"[^\s=<>!(),A-Za-z]", bare) or any(w.upper() not in _WORDS for w in re.findall(r"[A-Za-z]+", bare)):
        return "not_a_literal_test"
    if re.search(r"\(", re.sub(r"(?i)\bIN\s*\(", " ", bare)):
        return "not_a_literal_test"
    try:
        SparkSession.active().range(0).selectExpr(f"(CAST(NULL AS STRING) {rule}) = TRUE")
    except (ParseException, AnalysisException):
        return "syntax"
    return None


def is_literal(text: str) -> bool:
    """One string, number, boolean or NULL; defaults become code, so names and calls are refused."""
    return bool(re.fullmatch(r"'(?:[^'\\]|'')*'|[+-]?\d+(\.\d+)?|(?i:true|false|null)", text.strip()))


def escape_underscores(rule: str) -> str:
    """``strict`` form of a LIKE rule: ``_`` stands for itself instead of any one character."""
    return _LITERAL.sub(lambda m: m.group(0).replace("_", "\\\\_"), rule)


def rule_matches(schema: str, rule: str, strict: bool = False) -> Column:
    """Boolean column: does the schema-name column satisfy the rule? NULL and bad rules: no."""
    if rule_problem(rule):
        return F.lit(False)
    text = escape_underscores(rule) if strict and re.search(r"(?i)\bLIKE\b", rule) else rule
    return F.coalesce(F.expr(f"(`{schema}` {text})"), F.lit(False))
