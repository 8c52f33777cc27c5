"""The command line: a workspace from its first consent and import to a run, its report, and withdrawal.

``python -m kinweft.cli COMMAND --help`` names each command's flags; ``import csv`` and ``import-csv`` are the same.  Errors are one code on standard error and the
exit status 1.  A store is a folder (:mod:`kinweft.sources.store`); its runs are in ``_runs`` below it.
"""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
from pathlib import Path
from typing import Any

from kinweft.config import ConfigError, read_config, read_policy
from kinweft.sources import artifacts


def _json(path: str) -> Any:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def _say(made: Any, as_json: bool) -> None:
    from kinweft.functions.scalars import terminal_safe

    print(json.dumps(made, ensure_ascii=False) if as_json else "\n".join(f"{k}: {terminal_safe(str(v))}" for k, v in made.items()))


def _session():
    from pyspark.sql import SparkSession

    from kinweft.session import ship

    made = SparkSession.builder.appName("kinweft").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return ship(made)


def _open(path: str):
    """(store, runs) of a folder."""
    from kinweft.operators.runs import Runs
    from kinweft.sources.store import Store

    if problem := artifacts.store_problem(path):
        raise ConfigError(problem)
    spark = _session()
    return Store(spark, f"file://{path}"), Runs(spark, f"file://{path}/_runs")


def validate(a: argparse.Namespace) -> dict[str, Any]:
    config, policy = read_config(_json(a.config)), read_policy(_json(a.policy))
    if config["workspaceId"] != policy["workspaceId"]:
        raise ConfigError("the policy is of another workspace")
    return {"valid": True, "workspace_id": config["workspaceId"], "config_id": config["configId"], "policy_id": policy["policyId"]}


def _row(path: str) -> dict[str, Any]:
    """An object of a file with its keys in snake case."""
    made = _json(path)
    if not isinstance(made, dict):
        raise ConfigError("OBJECT_EXPECTED")
    return {re.sub("[A-Z]", lambda m: "_" + m[0].lower(), k): v for k, v in made.items()}


def init(a: argparse.Namespace) -> dict[str, Any]:
    """Make a workspace."""
    from kinweft.operators import operations

    operations.create_workspace(_open(a.store)[0], a.workspace, a.name, a.owner, a.purpose, a.at)
    return {"workspace_id": a.workspace, "store": a.store}


def contributor_add(a: argparse.Namespace) -> dict[str, Any]:
    """Register a contributor from a JSON file."""
    from kinweft.operators import operations

    return {"contributor_id": operations.add_contributor(_open(a.store)[0], a.workspace, _row(a.file), a.actor, a.at)}


def consent_add(a: argparse.Namespace) -> dict[str, Any]:
    """Register a consent from a JSON file."""
    from kinweft.operators import operations

    return {"consent_record_id": operations.add_consent(_open(a.store)[0], a.workspace, _row(a.file), a.actor, a.at)}


def consent_withdraw(a: argparse.Namespace) -> dict[str, Any]:
    """Withdraw a consent and delete what rests on it."""
    from kinweft.operators import operations

    return operations.withdraw_consent(_open(a.store)[0], a.workspace, a.consent, a.actor, a.reason, a.at)


def import_csv(a: argparse.Namespace) -> dict[str, Any]:
    """Import a CSV file of contacts."""
    from kinweft.operators import operations
    from kinweft.operators.materialize import Request

    request = Request(a.workspace, a.contributor, a.consent, a.source_kind, a.mapping_id or "mapping_cli", a.mapping_version or "1", a.at, "")
    return operations.import_csv(_open(a.store)[0], request, _json(a.mapping), os.path.abspath(a.file), [os.path.abspath(a.import_root)], a.actor or "actor_operator")


def review_list(a: argparse.Namespace) -> dict[str, Any]:
    """The candidates for review."""
    from kinweft.operators import operations

    return {k: [r.asDict(recursive=True) for r in df.toLocalIterator()] for k, df in operations.reviews(_open(a.store)[0], a.workspace).items()}


def review_decide(a: argparse.Namespace) -> dict[str, Any]:
    """Approve or reject a candidate."""
    from kinweft.operators import operations

    return operations.decide(_open(a.store)[0], a.workspace, a.candidate, a.decision, a.actor, a.reason, a.at)


def suppress_add(a: argparse.Namespace) -> dict[str, Any]:
    """Suppress a person, organization, domain, source, snapshot, category or state."""
    from kinweft.operators import operations

    return {"suppression_rule_id": operations.add_suppression(_open(a.store)[0], a.workspace, a.kind, a.value, a.reason, a.actor, a.at, a.expires)}


def suppress_remove(a: argparse.Namespace) -> dict[str, Any]:
    """Remove a suppression rule."""
    from kinweft.operators import operations

    return {"suppression_rule_id": operations.remove_suppression(_open(a.store)[0], a.workspace, a.suppression, a.actor, a.reason, a.at)}


def migrate(a: argparse.Namespace) -> dict[str, Any]:
    """Bring an older store to the newest schema."""
    return {"migrations": _open(a.store)[0].migrate()}


def reset(a: argparse.Namespace) -> dict[str, Any]:
    if not a.yes:
        raise ConfigError("RESET_NEEDS_YES")
    return {"reset": artifacts.reset_store(a.store, a.allowed_root)}


def run(a: argparse.Namespace) -> dict[str, Any]:
    store, runs = _open(a.store)
    made, before = runs.once(store.tables(), _json(a.config), _json(a.policy), a.at)
    return {"audit_run_id": made.audit_run_id, "stored_before": before, "eligible": made.results.count(), "blocked": made.blocked.count(), "review_only": made.review_only.count()}


def inspect(a: argparse.Namespace) -> dict[str, Any]:
    """How many rows each table has, the completed runs, and where the audit chain breaks."""
    from kinweft.operators import governance

    store, runs = _open(a.store)
    broken = governance.first_break(store.table("audit_event")).collect()
    return {**{k: df.count() for k, df in store.tables().items()}, "runs": runs.listed(), "audit_breaks": [r.asDict() for r in broken if r["first_index"] is not None]}


def export(a: argparse.Namespace) -> dict[str, Any]:
    """Write one run's report, checked again at the display clock."""
    from kinweft.operators import display, operations

    if a.view == "reviewer" and not a.authorized_reviewer:
        raise ConfigError("REVIEWER_VIEW_NOT_AUTHORIZED")
    store, runs = _open(a.store)
    found, tables, config = runs.read(a.run), store.tables(), _json(a.config)
    made = display.report(found, tables, config, a.at, a.view)
    if a.format == "csv":
        from kinweft.config import instant

        purpose = tables["workspace"].where(tables["workspace"].workspace_id == made["workspace_id"]).first()["purpose_id"]
        seen = display.exportable(display.visible(found.results, tables, read_config(config), purpose, instant(a.at)), tables["consent"])
        text = display.to_csv(display.findings(seen, tables, a.view))
    else:
        text = display.to_json(made) if a.format == "json" else display.to_terminal(made) + "\n"
    artifacts.write_private(a.out, text, a.allowed_root, a.overwrite)
    operations.record_export(store, made["workspace_id"], a.run, a.format, a.view, a.out, a.actor or "actor_operator", a.at)
    return {"written": a.out, "findings": len(made["findings"])}


def demo(a: argparse.Namespace) -> dict[str, Any]:
    """Seed the demonstration workspace, run it and write its JSON report."""
    from kinweft.operators import display
    from kinweft.sources import demo as seed

    if os.path.exists(a.store):
        if not a.overwrite:
            raise ConfigError("STORE_EXISTS")
        artifacts.reset_store(a.store, os.path.dirname(a.store))
    store, runs = _open(a.store)
    store.commit({k: df for k, df in seed.seed(store.spark).items() if not df.isEmpty()})
    tables = store.tables()
    made, _ = runs.once(tables, seed.CONFIG, seed.POLICY, seed.CLOCK)
    report = display.report(made, tables, seed.CONFIG, seed.CLOCK)
    artifacts.write_private(f"{a.reports}/coverage.json", display.to_json(report), a.reports, a.overwrite)
    return {"audit_run_id": made.audit_run_id, **report["summary"]["categories"], "report": f"{a.reports}/coverage.json"}


def parser() -> argparse.ArgumentParser:
    flags = {
        init: ("store", "workspace", "name", "owner", "purpose", "at"), contributor_add: ("store", "workspace", "file", "actor", "at"), consent_add: ("store", "workspace", "file", "actor", "at"), consent_withdraw: ("store", "workspace", "consent", "actor", "reason", "at"),
        import_csv: ("store", "workspace", "contributor", "consent", "source-kind", "mapping", "file", "import-root", "at", "mapping-id?", "mapping-version?", "actor?"), review_list: ("store", "workspace"), review_decide: ("store", "workspace", "candidate", "decision", "actor", "reason", "at"),
        suppress_add: ("store", "workspace", "kind", "value", "reason", "actor", "at", "expires?"), suppress_remove: ("store", "workspace", "suppression", "actor", "reason", "at"), migrate: ("store",),
        validate: ("config", "policy"), reset: ("store", "allowed-root", "yes!"), run: ("store", "config", "policy", "at"), inspect: ("store",),
        export: ("store", "config", "run", "at", "out", "allowed-root?", "actor?", "overwrite!", "authorized-reviewer!"), demo: ("store", "reports", "overwrite!"),
    }
    made = argparse.ArgumentParser(prog="kinweft", description=__doc__.splitlines()[0])
    commands = made.add_subparsers(dest="command", required=True)
    for does, names in flags.items():
        p = commands.add_parser(does.__name__.replace("_", "-"), help=(does.__doc__ or "").strip() or None)
        p.set_defaults(does=does)
        p.add_argument("--json", action="store_true")
        for n in names:
            if n.endswith("!"):
                p.add_argument(f"--{n[:-1]}", action="store_true")
            else:
                p.add_argument(f"--{n.rstrip('?')}", required=not n.endswith("?"))
        if does is export:
            p.add_argument("--format", choices=("json", "csv", "terminal"), default="json")
            p.add_argument("--view", choices=("safe", "reviewer"), default="safe")
    return made


def main(argv: list[str] | None = None) -> int:
    words = list(sys.argv[1:] if argv is None else argv)
    if len(words) > 1 and f"{words[0]}-{words[1]}" in ("contributor-add", "consent-add", "consent-withdraw", "import-csv", "review-list", "review-decide", "suppress-add", "suppress-remove"):
        words[:2] = [f"{words[0]}-{words[1]}"]
    a = parser().parse_args(words)
    try:
        _say(a.does(a), a.json)
    except (ConfigError, OSError, json.JSONDecodeError) as e:
        # an error names a code or a file, never the content of one
        print(e if not isinstance(e, json.JSONDecodeError) else "JSON_INVALID", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
