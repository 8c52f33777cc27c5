"""Declarative fit rules, compiled to Columns when the plan is made.

An attribute is a struct(many, values): whether it is a list, and its values as struct(kind, text, number), where
``kind`` is ``s``, ``n`` or ``b``.  A null attribute is one that is not there.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweft.config import folded
from kinweft.functions.scalars import folded as folded_column
from kinweft.functions.scalars import score

ATTRIBUTE = "struct<many:boolean,values:array<struct<kind:string,text:string,number:double>>>"


def _typed(value: Any) -> tuple[str, str | None, float | None]:
    if isinstance(value, bool):
        return "b", str(value).lower(), None
    if isinstance(value, (int, float)):
        return "n", None, float(value)
    return "s", folded(value), None


def attribute(value: Any) -> tuple | None:
    """A configured attribute as a row of :data:`ATTRIBUTE`."""
    if value is None:
        return None
    return isinstance(value, list), [_typed(v) for v in (value if isinstance(value, list) else [value])]


def text_attribute(text: Column) -> Column:
    """A text column as an attribute; null is absent."""
    one = F.struct(F.lit("s").alias("kind"), folded_column(text).alias("text"), F.lit(None).cast("double").alias("number"))
    return F.when(text.isNotNull(), F.struct(F.lit(False).alias("many"), F.array(one).alias("values")).cast(ATTRIBUTE))


def _is(x: Column, expected: Any) -> Column:
    kind, text, number = _typed(expected)
    return (x["kind"] == kind) & (x["number"] == number if kind == "n" else x["text"] == text)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def matches(rule: dict[str, Any], attr: Column) -> Column:
    """Whether an attribute satisfies a rule; never null."""
    kind, value = rule["operator"], rule.get("value")
    values, absent = attr["values"], attr.isNull()
    expected = value if isinstance(value, list) else [value]
    known = [e for e in expected if e is not None and not isinstance(e, dict)]
    if kind == "exists":
        empty = ~attr["many"] & (F.get(values, 0)["kind"] == "s") & (F.get(values, 0)["text"] == "")
        return ~absent & ~F.coalesce(empty, F.lit(False))
    if kind == "equals":
        if not expected:
            return F.lit(False)
        if expected[0] is None:
            return absent
        return F.coalesce(F.exists(values, lambda x: _is(x, expected[0])), F.lit(False)) if known else F.lit(False)
    if kind == "in":
        return F.coalesce(F.exists(values, lambda x: _any([_is(x, e) for e in known])), F.lit(None in expected))
    if kind == "not_in":
        return F.coalesce(~F.exists(values, lambda x: _any([_is(x, e) for e in known])), F.lit(None not in expected))
    if kind == "contains_token":
        wanted = [folded(e) for e in known if isinstance(e, str)]
        return F.coalesce(F.exists(values, lambda x: (x["kind"] == "s") & _any([F.array_contains(F.split(x["text"], r"[^\p{L}\p{N}]+", -1), e) for e in wanted])), F.lit(False))
    first = F.try_element_at(values, F.lit(1))
    if not isinstance(value, dict):
        return F.lit(False)
    inside = first["kind"] == "n"
    if "min" in value:
        inside = inside & (first["number"] >= value["min"])
    if "max" in value:
        inside = inside & (first["number"] <= value["max"])
    return F.coalesce(inside, F.lit(False))


def evaluate(rules: dict[str, Any], attributes: dict[str, Column]) -> Column:
    """struct(matched, score, matched_rule_ids, failed_rule_ids) of a rule set."""
    each = [(r, matches(r, attributes[r["field"]])) for r in rules["rules"]]
    required = [m for r, m in each if r["required"]]
    matched = reduce(lambda a, b: a & b, required, F.lit(True)) if rules["mode"] == "all" else _any(required)
    weight = reduce(lambda a, b: a + b, [F.when(m, r["weight"]).otherwise(0) for r, m in each])
    total = sum(r["weight"] for r, _ in each) or 1
    ids = [F.array_sort(F.array_compact(F.array(*[F.when(m if hit else ~m, F.lit(r["ruleId"])) for r, m in each]))) for hit in (True, False)]
    return F.struct(matched.alias("matched"), score(weight * 100 / F.lit(float(total))).alias("score"), ids[0].alias("matched_rule_ids"), ids[1].alias("failed_rule_ids"))


def persona_outcome(persona: Column, scoring: dict[str, Any]) -> Column:
    sure = persona["matched"] & (persona["score"] >= scoring["personaMatchedThreshold"])
    return F.when(sure, "matched").when(persona["score"] >= scoring["uncertainLowerBound"], "uncertain").otherwise("not_matched")


def category(direct: Column, target: Column, icp_matched: Column, outcome: Column) -> Column:
    """The one class an edge can have, or null."""
    own = F.when((outcome == "matched") & icp_matched, "A").when(target, "B")
    broker = F.when(target & (outcome == "matched"), "C").when(target, "D")
    return F.when(direct, own).otherwise(broker)
