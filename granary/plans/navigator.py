"""Aggregate navigation: which registered pre-aggregate may answer a request, or a leaf of one."""

from __future__ import annotations

from granary.model import Materialization, Model

FRESH = {None, "", "ALWAYS", "MANUAL", "SNAPSHOT"}
MERGES = {"SUM": "SUM", "COUNT": "SUM", "MIN": "MIN", "MAX": "MAX"}


def _mapped(m: Materialization) -> dict[tuple[str, str], tuple[str, str]]:
    return {(c.kind, c.name.upper()): (c.column, (c.policy or "NONE").upper()) for c in m.columns}


def _usable(m: Materialization) -> str | None:
    if m.status != "ACTIVE":
        return "INACTIVE"
    if m.type != "AGGREGATE":
        return "UNSUPPORTED_TYPE"
    if m.freshness not in FRESH:
        return "UNSUPPORTED_FRESHNESS_POLICY"
    return None


def select(model: Model, dimensions: list[str], filtered: list[str], metrics: list[str]) -> tuple[dict | None, list[dict]]:
    """The best materialization for a request on its whole, and why each other one isn't used."""
    found, notes = [], []
    needed = {d.upper() for d in dimensions + filtered}
    for k, m in enumerate(model.materializations.values()):
        mapped, why = _mapped(m), _usable(m)
        extra = [n for kind, n in mapped if kind == "DIMENSION" and n not in {d.upper() for d in dimensions}]
        if not why and any(("DIMENSION", d) not in mapped for d in needed):
            why = "MISSING_DIMENSION"
        if not why and any(("METRIC", x.upper()) not in mapped for x in metrics):
            why = "MISSING_METRIC"
        if not why:
            for x in metrics:
                policy, metric = mapped["METRIC", x.upper()][1], model.get("metrics", x)
                if policy not in ("DIRECT", "NONE", *MERGES):
                    why = "UNSUPPORTED_ROLLUP_POLICY"
                elif extra and policy != "SUM":
                    why = "ROLLUP_POLICY_UNSAFE"
                elif extra and metric.metric_type != "ADDITIVE":
                    why = "NON_ADDITIVE_ROLLUP"
                if why:
                    break
        if why:
            notes.append({"materialization": m.name, "reason": why})
        else:
            found.append((len(extra), k, m, mapped, bool(extra)))
    if not found:
        return None, notes
    _, _, m, mapped, rollup = min(found, key=lambda f: f[:2])
    policies = [mapped["METRIC", x.upper()][1] for x in metrics]
    return (
        {
            "materialization": m.name,
            "schema": m.schema,
            "object": m.object,
            "dimensions": {d: mapped["DIMENSION", d.upper()][0] for d in dict.fromkeys(dimensions + filtered)},
            "metrics": {x: mapped["METRIC", x.upper()] for x in metrics},
            "rollup": rollup,
            "grouped": rollup or any(p in MERGES for p in policies),
        },
        notes,
    )


def select_leaf(model: Model, dimensions: list[str], filtered: list[str], states: list[dict]) -> tuple[dict | None, list[dict]]:
    """A materialization that gives all states of a leaf; states merge, so roll-ups need SUM or COUNT states."""
    found, notes = [], []
    for k, m in enumerate(model.materializations.values()):
        mapped, why = _mapped(m), _usable(m)
        extra = [n for kind, n in mapped if kind == "DIMENSION" and n not in {d.upper() for d in dimensions}]
        if not why and any(("DIMENSION", d.upper()) not in mapped for d in dimensions + filtered):
            why = "MISSING_DIMENSION"
        for s in states if not why else []:
            if s["filter"]:
                why = "FILTERED_STATE_UNSUPPORTED"
            elif not s["whole"] or ("METRIC", s["metric"].upper()) not in mapped:
                why = "MISSING_STATE"
            elif mapped["METRIC", s["metric"].upper()][1] not in ("SUM", "COUNT", "NONE", "DIRECT"):
                why = "STATE_MERGE_UNSUPPORTED"
            elif extra and mapped["METRIC", s["metric"].upper()][1] not in ("SUM", "COUNT"):
                why = "ROLLUP_POLICY_UNSAFE"
            if why:
                break
        if why:
            notes.append({"materialization": m.name, "reason": why})
        else:
            found.append((len(extra), k, m, mapped))
    if not found:
        return None, notes
    _, _, m, mapped = min(found, key=lambda f: f[:2])
    return (
        {
            "materialization": m.name,
            "schema": m.schema,
            "object": m.object,
            "dimensions": {d: mapped["DIMENSION", d.upper()][0] for d in dict.fromkeys(dimensions + filtered)},
            "states": {s["column"]: mapped["METRIC", s["metric"].upper()][0] for s in states},
        },
        notes,
    )
