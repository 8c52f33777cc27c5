"""The configuration and the policy of an evaluation: checked, completed with defaults, and ready to hash."""

from __future__ import annotations

import re
import unicodedata
from datetime import UTC, datetime
from typing import Any

from kinweft.functions.digest import canonical_json, sha256_hex

FIELDS = ("canonical_name", "domain", "industry", "geography", "employee_count", "stage", "technology", "title", "function", "seniority", "crm_state")
OPERATORS = ("equals", "in", "not_in", "contains_token", "range", "exists")
SUPPRESSION_KINDS = ("person", "organization", "domain", "source", "snapshot", "category", "crm_state")
WEIGHTS = ("accountFit", "personaFit", "relationshipConfidence", "employmentConfidence", "pathConfidence", "freshness")
CATEGORIES = ("A", "B", "C", "D")
DIRECT_SCOPE, BROKER_SCOPE = "A_ICP_FIT_INCLUDING_TARGETS_B_TARGET_LIST_ONLY", "C_D_TARGET_LIST_ONLY"

_ID = re.compile(r"[a-zA-Z0-9][a-zA-Z0-9._:-]{0,199}")
_CODE = re.compile(r"[A-Z][A-Z0-9_]{2,63}")


class ConfigError(ValueError):
    """A configuration, policy or mapping that is not valid."""


def folded(value: Any) -> Any:
    return unicodedata.normalize("NFKC", value).strip().lower() if isinstance(value, str) else value


def instant(text: str) -> datetime:
    """The instant of an ISO date-time with an offset."""
    try:
        made = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except (ValueError, AttributeError) as e:
        raise ConfigError(f"not an instant: {text!r}") from e
    if made.tzinfo is None:
        raise ConfigError(f"an instant needs an offset: {text!r}")
    return made.astimezone(UTC)


def iso(at: datetime) -> str:
    return at.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


class _Reader:
    """Reads one object strictly: every field is known, present unless it has a default, and of its kind."""

    def __init__(self, value: Any, where: str):
        if not isinstance(value, dict):
            raise ConfigError(f"{where}: an object is needed")
        self.value, self.where, self.out = dict(value), where, {}

    def take(self, name: str, check, default: Any = ...) -> _Reader:
        if name in self.value:
            self.out[name] = check(self.value.pop(name), f"{self.where}.{name}")
        elif default is ...:
            raise ConfigError(f"{self.where}.{name}: missing")
        elif default is not None:
            self.out[name] = default
        return self

    def done(self) -> dict[str, Any]:
        if self.value:
            raise ConfigError(f"{self.where}: unknown {', '.join(sorted(self.value))}")
        return self.out


def _text(least: int, most: int):
    def check(v, where):
        if not isinstance(v, str) or not least <= len(v) <= most:
            raise ConfigError(f"{where}: a text of {least} to {most} characters is needed")
        return v

    return check


def _match(pattern: re.Pattern):
    def check(v, where):
        if not isinstance(v, str) or not pattern.fullmatch(v):
            raise ConfigError(f"{where}: {v!r} does not fit {pattern.pattern}")
        return v

    return check


def _one_of(*values):
    def check(v, where):
        if v not in values or isinstance(v, bool) != isinstance(values[0], bool):
            raise ConfigError(f"{where}: one of {values} is needed")
        return v

    return check


def _whole(least: int, most: int):
    def check(v, where):
        if isinstance(v, bool) or not isinstance(v, (int, float)) or v != int(v) or not least <= v <= most:
            raise ConfigError(f"{where}: a whole number from {least} to {most} is needed")
        return int(v)

    return check


def _many(check, least: int = 0, most: int = 10**9, key=None):
    def each(v, where):
        if not isinstance(v, list) or not least <= len(v) <= most:
            raise ConfigError(f"{where}: a list of {least} or more is needed")
        made = [check(x, f"{where}[{i}]") for i, x in enumerate(v)]
        if key is not None:
            _unique([key(x) for x in made], where)
        return made

    return each


def _unique(values: list, where: str) -> None:
    seen = set()
    for v in values:
        if v in seen:
            raise ConfigError(f"{where}: duplicate {v}")
        seen.add(v)


def _bool(v, where):
    if not isinstance(v, bool):
        raise ConfigError(f"{where}: true or false is needed")
    return v


def _instant(v, where):
    instant(v)
    return v


def _scalar(v, where):
    if isinstance(v, str) and len(v) <= 500 or isinstance(v, (bool, int, float)):
        return v
    raise ConfigError(f"{where}: a text, number or truth value is needed")


def _number(v, where):
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        raise ConfigError(f"{where}: a number is needed")
    return v


def _rule_value(v, where):
    if isinstance(v, dict):
        return _Reader(v, where).take("min", _number, None).take("max", _number, None).done()
    return _many(_scalar, 0, 100)(v, where) if isinstance(v, list) else _scalar(v, where)


_id, _code = _match(_ID), _match(_CODE)


def _rule(v, where):
    return _Reader(v, where).take("ruleId", _id).take("field", _one_of(*FIELDS)).take("operator", _one_of(*OPERATORS)).take("value", _rule_value, None).take("required", _bool, True).take("weight", _whole(0, 100), 1).done()


def _rule_set(v, where):
    return _Reader(v, where).take("ruleSetId", _id).take("version", _text(1, 64)).take("mode", _one_of("all", "any")).take("rules", _many(_rule, 1, 100, lambda r: r["ruleId"])).done()


def _attributes(v, where):
    if not isinstance(v, dict):
        raise ConfigError(f"{where}: an object is needed")
    return {_text(1, 100)(k, where): _many(_scalar)(x, where) if isinstance(x, list) else _scalar(x, where) for k, x in v.items()}


def _target(v, where):
    return _Reader(v, where).take("targetAccountId", _id).take("organizationId", _id).take("priority", _whole(1, 5)).take("attributes", _attributes, {}).done()


def _profile(v, where):
    return _Reader(v, where).take("organizationId", _id).take("attributes", _attributes, {}).done()


def _alias(v, where):
    return _Reader(v, where).take("aliasId", _id).take("organizationAliasCandidateId", _id).take("organizationId", _id).take("sourceOrganizationId", _id).take("kind", _one_of("name", "domain", "crm_id")).take("value", _text(1, 500)).take("approvedReviewDecisionId", _id).done()


def _scoring(v, where):
    def weights(w, at):
        r = _Reader(w, at)
        for name in WEIGHTS:
            r.take(name, _whole(0, 100))
        return r.done()

    made = _Reader(v, where).take("weights", weights).take("personaMatchedThreshold", _whole(1, 100)).take("uncertainLowerBound", _whole(0, 99)).done()
    if made["uncertainLowerBound"] >= made["personaMatchedThreshold"]:
        raise ConfigError(f"{where}: uncertainLowerBound must be less than personaMatchedThreshold")
    if not sum(made["weights"].values()):
        raise ConfigError(f"{where}: the weights must not all be zero")
    return made


def _freshness(v, where):
    return _Reader(v, where).take("currentEmploymentMaxDays", _one_of(365)).take("reviewEmploymentMaxDays", _one_of(730)).take("relationshipMaxDays", _whole(1, 730)).done()


def _suppression(v, where):
    return _Reader(v, where).take("suppressionId", _id).take("kind", _one_of(*SUPPRESSION_KINDS)).take("value", _text(1, 500)).take("reasonCode", _code).take("effectiveAt", _instant).take("expiresAt", _instant, None).done()


def _exclusion(v, where):
    return _Reader(v, where).take("kind", _one_of(*SUPPRESSION_KINDS)).take("value", _text(1, 10**6)).take("reasonCode", _code).done()


def _review(v, where):
    return _Reader(v, where).take("uncertainPersona", _one_of("review_only_candidate")).take("staleEmployment", _one_of("block", "review_only")).take("unresolvedIdentity", _one_of("block")).take("unresolvedOrganization", _one_of("block")).take("bAndDRequireReview", _one_of(True)).take("reviewReasonCode", _code).done()


def read_config(value: Any) -> dict[str, Any]:
    """A checked configuration with its defaults filled in; raises :class:`ConfigError`."""
    made = (
        _Reader(value, "config").take("workspaceId", _id).take("configId", _id).take("version", _text(1, 64)).take("directContributorIds", _many(_id, 1, key=str))
        .take("icpRuleSet", _rule_set).take("stakeholderPersonaRuleSet", _rule_set).take("coachCandidateRuleSet", _rule_set, None)
        .take("targetAccounts", _many(_target, key=lambda x: x["targetAccountId"])).take("accountProfiles", _many(_profile, key=lambda x: x["organizationId"]))
        .take("approvedOrganizationAliases", _many(_alias, key=lambda x: x["aliasId"])).take("scoring", _scoring).take("freshness", _freshness)
        .take("suppressions", _many(_suppression, key=lambda x: x["suppressionId"])).take("exclusions", _many(_exclusion)).take("reviewPolicy", _review).done()
    )
    _unique([x["organizationId"] for x in made["targetAccounts"]], "config.targetAccounts")
    sets = [made[k] for k in ("icpRuleSet", "stakeholderPersonaRuleSet", "coachCandidateRuleSet") if k in made]
    _unique([s["ruleSetId"] for s in sets], "config rule sets")
    _unique([r["ruleId"] for s in sets for r in s["rules"]], "config rules")
    bound: dict[tuple, str] = {}
    for alias in made["approvedOrganizationAliases"]:
        key = alias["kind"], folded(alias["value"])
        if bound.setdefault(key, alias["organizationId"]) != alias["organizationId"]:
            raise ConfigError(f"config.approvedOrganizationAliases: contradictory {key}")
    return made


def read_policy(value: Any) -> dict[str, Any]:
    """A checked policy; raises :class:`ConfigError`."""
    return (
        _Reader(value, "policy").take("workspaceId", _id).take("policyId", _id).take("version", _text(1, 64)).take("effectiveAt", _instant).take("purposeId", _id)
        .take("allowedCategories", _many(_one_of(*CATEGORIES), 1)).take("directScope", _one_of(DIRECT_SCOPE)).take("brokerScope", _one_of(BROKER_SCOPE))
        .take("requireBrokerIndividualConsent", _bool).take("networkMode", _one_of("disabled")).take("externalMutations", _one_of(False)).done()
    )


def digest(value: dict[str, Any]) -> str:
    return sha256_hex(canonical_json(value))


def active_suppressions(config: dict[str, Any], clock: datetime) -> list[tuple[str, str, str]]:
    """(kind, folded value, reason code) of the configured suppressions and exclusions that hold at the clock."""
    found = [(x["kind"], x["value"].lower(), x["reasonCode"]) for x in config["suppressions"] if instant(x["effectiveAt"]) <= clock and ("expiresAt" not in x or clock < instant(x["expiresAt"]))]
    return found + [(x["kind"], x["value"].lower(), x["reasonCode"]) for x in config["exclusions"]]
