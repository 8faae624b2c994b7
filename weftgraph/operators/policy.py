"""Architecture policies: glob groups, rules on edges, drift between snapshots, and the change gate."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.model import CodeGraph
from weftgraph.operators.change import structural_edges
from weftgraph.operators.intelligence import strong_components

SEVERITIES = ("low", "medium", "high")


@dataclass(frozen=True)
class Group:
    id: str
    include: tuple[str, ...]
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    id: str
    source: str
    target: str
    action: str = "deny"
    kinds: tuple[str, ...] = ("imports",)
    severity: str = "medium"


@dataclass(frozen=True)
class Policy:
    groups: tuple[Group, ...] = ()
    rules: tuple[Rule, ...] = ()
    default_action: str = "allow"
    cycles: bool = False
    cycle_severity: str = "medium"


_KEYS = {"groups", "rules", "defaultCrossGroupAction", "cycles"}


def parse_policy(config: dict) -> Policy:
    """A policy from parsed JSON; unknown keys, unknown groups, double ids and conflicting rules are errors."""
    if unknown := set(config) - _KEYS:
        raise ValueError(f"unknown policy keys: {sorted(unknown)}")
    groups = tuple(Group(g["id"], tuple(g["include"]), tuple(g.get("exclude", ()))) for g in config.get("groups", ()))
    ids = [g.id for g in groups]
    if len(set(ids)) < len(ids):
        raise ValueError("group ids must differ")
    rules, seen = [], {}
    for r in config.get("rules", ()):
        if extra := set(r) - {"id", "from", "to", "action", "edgeKinds", "severity", "message"}:
            raise ValueError(f"unknown rule keys: {sorted(extra)}")
        rule = Rule(r["id"], r["from"], r["to"], r.get("action", "deny"), tuple(r.get("edgeKinds", ("imports",))), r.get("severity", "medium"))
        if rule.source not in ids or rule.target not in ids:
            raise ValueError(f"rule {rule.id} names an unknown group")
        if rule.action not in ("allow", "deny") or rule.severity not in SEVERITIES:
            raise ValueError(f"rule {rule.id} has an unknown action or severity")
        for kind in rule.kinds:
            if seen.setdefault((rule.source, rule.target, kind), rule.action) != rule.action:
                raise ValueError(f"rule {rule.id} conflicts with an earlier one")
        rules.append(rule)
    cycles = config.get("cycles", {})
    return Policy(groups, tuple(rules), config.get("defaultCrossGroupAction", "allow"), bool(cycles.get("enabled", False)), cycles.get("severity", "medium"))


def glob_regex(pattern: str) -> str:
    """`**/` any folders, `**` anything, `*` and `?` within a name."""
    tokens = re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", pattern)
    return "^" + "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, re.sub(r"([\\.^$|()\[\]{}+])", r"\\\1", t)) for t in tokens) + "$"


def membership(files: DataFrame, policy: Policy) -> DataFrame:
    """file, state (classified, ambiguous, unclassified), group. One pass: a column of matching groups, no join."""
    file = F.replace(F.col("file"), F.lit("\\"), F.lit("/"))
    hits = []
    for g in sorted(policy.groups, key=lambda g: g.id):
        inside = F.greatest(F.lit(False), *[file.rlike(glob_regex(p)) for p in g.include], F.lit(False))
        outside = F.greatest(F.lit(False), *[file.rlike(glob_regex(p)) for p in g.exclude], F.lit(False))
        hits.append(F.when(inside & ~outside, F.lit(g.id)))
    found = F.array_compact(F.array(*hits)) if hits else F.expr("cast(array() as array<string>)")
    rows = files.select("file").distinct().select("file", found.alias("groups"))
    state = F.when(F.size("groups") == 0, "unclassified").when(F.size("groups") > 1, "ambiguous").otherwise("classified")
    return rows.select("file", state.alias("state"), F.when(F.size("groups") == 1, F.col("groups")[0]).alias("group"))


def decide(edges: DataFrame, members: DataFrame, policy: Policy) -> DataFrame:
    """edges (with from_file, to_file, kind) plus action, rule_id, severity: the first matching rule in the policy's order decides."""
    m = members.select("file", "state", "group")
    rows = edges.join(m.select(F.col("file").alias("from_file"), F.col("state").alias("from_state"), F.col("group").alias("from_group")), "from_file").join(m.select(F.col("file").alias("to_file"), F.col("state").alias("to_state"), F.col("group").alias("to_group")), "to_file")
    fits = [(r, (F.col("from_group") == r.source) & (F.col("to_group") == r.target) & F.col("kind").isin(*r.kinds)) for r in policy.rules]
    pick = lambda value, other: _first([(c, F.lit(value(r))) for r, c in fits], other)
    ambiguous = (F.col("from_state") == "ambiguous") | (F.col("to_state") == "ambiguous")
    open_ = (F.col("from_state") != "classified") | (F.col("to_state") != "classified")
    action = F.when(ambiguous, "ambiguous").when(open_, "unclassified").otherwise(pick(lambda r: r.action, F.when(F.col("from_group") == F.col("to_group"), "allow").otherwise(F.lit(policy.default_action))))
    null = F.lit(None).cast("string")
    judged = ~(ambiguous | open_)
    return rows.withColumns({"action": action, "rule_id": F.when(judged, pick(lambda r: r.id, null)), "severity": F.when(judged, pick(lambda r: r.severity, F.lit("medium")))})


def _first(cases, other):
    out = other
    for condition, value in reversed(cases):
        out = F.when(condition, value).otherwise(out)
    return out


def cause(graph_changed, policy_changed):
    return F.when(graph_changed & policy_changed, "both").when(policy_changed, "policy_change").otherwise("code_change")


def architecture_drift(before: CodeGraph, after: CodeGraph, baseline: Policy, target: Policy, renames: DataFrame | None = None) -> DataFrame:
    """finding, status (introduced, resolved), cause, severity, rule_id, detail for edges that violate one side's policy only, and for import cycles.

    Both edge sets meet in one full outer join on identities that renames don't change; ambiguous ends give no finding.
    """
    key = ["kind", "from_key", "to_key", "from_file", "to_file"]
    old, new = structural_edges(before, renames).withColumn("was", F.lit(True)), structural_edges(after).withColumn("is", F.lit(True))
    edges = old.join(new, key, "full_outer").select(*key, F.coalesce("was", F.lit(False)).alias("was"), F.coalesce("is", F.lit(False)).alias("is"))
    files = edges.select(F.explode(F.array("from_file", "to_file")).alias("file"))
    first = decide(edges, membership(files, baseline), baseline).select(*key, "was", "is", F.col("action").alias("base_action"), F.col("severity").alias("base_severity"), F.col("rule_id").alias("base_rule"))
    rows = decide(first, membership(files, target), target)
    base_bad, target_bad = F.col("base_action") == "deny", F.col("action") == "deny"
    clear = (F.col("base_action") != "ambiguous") & (F.col("action") != "ambiguous")
    violated, now = F.col("was") & base_bad, F.col("is") & target_bad
    status = F.when(~violated & now, "introduced").when(violated & ~now, "resolved")
    found = rows.filter(clear).withColumn("status", status).filter("status is not null")
    edge_rows = found.select(
        F.lit("forbidden_dependency").alias("finding"), "status", cause(F.col("was") != F.col("is"), base_bad != target_bad).alias("cause"),
        F.when(F.col("status") == "introduced", F.col("severity")).otherwise(F.col("base_severity")).alias("severity"), F.when(F.col("status") == "introduced", F.col("rule_id")).otherwise(F.col("base_rule")).alias("rule_id"),
        F.concat_ws(" ", "from_key", "kind", "to_key").alias("detail"),
    )
    return edge_rows.union(cycle_drift(before, after, baseline, target, renames))


def _file_cycles(graph: CodeGraph, renames: DataFrame | None) -> DataFrame:
    edges = structural_edges(graph, renames).filter("kind = 'imports'").select(F.col("from_file").alias("src"), F.col("to_file").alias("dst"))
    parts = strong_components(edges)
    return parts.groupBy("component").agg(F.array_join(F.sort_array(F.collect_list("id")), " ").alias("detail")).select("detail")


def cycle_drift(before: CodeGraph, after: CodeGraph, baseline: Policy, target: Policy, renames: DataFrame | None = None) -> DataFrame:
    """Findings on cycles of file imports that are there, and enabled in the policy, on one side only."""
    old, new = _file_cycles(before, renames).withColumn("was", F.lit(True)), _file_cycles(after, None).withColumn("is", F.lit(True))
    rows = old.join(new, "detail", "full_outer").select("detail", F.coalesce("was", F.lit(False)).alias("was"), F.coalesce("is", F.lit(False)).alias("is"))
    then, now = F.col("was") & F.lit(baseline.cycles), F.col("is") & F.lit(target.cycles)
    rows = rows.filter(then != now).withColumn("status", F.when(now, "introduced").otherwise("resolved"))
    return rows.select(F.lit("dependency_cycle").alias("finding"), "status", cause(F.col("was") != F.col("is"), F.lit(baseline.cycles != target.cycles)).alias("cause"), F.when(F.col("status") == "introduced", F.lit(target.cycle_severity)).otherwise(F.lit(baseline.cycle_severity)).alias("severity"), F.lit(None).cast("string").alias("rule_id"), "detail")


@dataclass(frozen=True)
class GatePolicy:
    max_risk: str | None = None
    allow_unknown_risk: bool | None = None
    max_uncovered: int | None = None
    min_test_ratio: float | None = None
    require_authoritative: bool = False
    forbid_gaps: tuple[str, ...] = ()
    fail_severity: str | None = None
    causes: tuple[str, ...] = ("code_change", "policy_change", "both")
    kinds: tuple[str, ...] = field(default=("forbidden_dependency", "dependency_cycle"))


def change_gate(policy: GatePolicy, facts: DataFrame, gaps: DataFrame, findings: DataFrame) -> DataFrame:
    """id, status (pass, fail, warn, skipped), actual of each check that the policy asks for.

    facts: one row of risk, uncovered, affected, covered, authoritative. gaps: kind, count. findings: status, cause, severity, finding.
    """
    s = lambda c: c.cast("string")
    level = lambda c: F.when(c == "low", 0).when(c == "medium", 1).when(c == "high", 2)
    checks = []
    unknown = F.col("risk") == "unknown"
    passed = lambda c: F.when(c, "pass").otherwise("fail")
    check = lambda name, status, actual, when=F.lit(True): F.when(when, F.struct(F.lit(name).alias("id"), status.alias("status"), s(actual).alias("actual")))
    if policy.max_risk is not None or policy.allow_unknown_risk is not None:
        allowed = F.lit(bool(policy.allow_unknown_risk))
        checks.append(check("risk.allowUnknown", passed(allowed), F.col("risk"), unknown))
        if policy.max_risk is not None:
            checks.append(check("risk.maxAllowed", F.when(unknown, "skipped").otherwise(passed(level(F.col("risk")) <= SEVERITIES.index(policy.max_risk))), F.col("risk")))
        else:
            checks.append(check("risk.allowUnknown", F.lit("skipped"), F.col("risk"), ~unknown))
    if policy.max_uncovered is not None:
        checks.append(check("tests.maxUncoveredAffectedSymbols", passed(F.col("uncovered") <= policy.max_uncovered), F.col("uncovered")))
    if policy.min_test_ratio is not None:
        ratio = F.col("covered") / F.when(F.col("affected") > 0, F.col("affected"))
        checks.append(check("tests.minStructuralTestEvidenceRatio", F.when(F.col("affected") == 0, "skipped").otherwise(passed(ratio >= policy.min_test_ratio)), F.coalesce(F.round(ratio, 6), F.lit(0.0))))
    if policy.require_authoritative:
        checks.append(check("diagnostics.authoritativeNegativeResults", passed(F.col("authoritative")), F.col("authoritative")))
    forbidden = gaps.agg(F.count_if(F.col("kind").isin(*policy.forbid_gaps) if policy.forbid_gaps else F.lit(False)).alias("forbidden"))
    at = SEVERITIES.index(policy.fail_severity) if policy.fail_severity else 0
    meant = F.col("cause").isin(*policy.causes) & F.col("finding").isin(*policy.kinds)
    severe = level(F.col("severity")) >= at
    counts = findings.filter("status = 'introduced'").agg(F.count_if(meant).alias("relevant"), F.count_if(meant & severe).alias("failures"), F.count_if(~meant | ~severe).alias("observed"))
    if policy.forbid_gaps:
        checks.append(check("diagnostics.forbidGapKinds", passed(F.col("forbidden") == 0), F.col("forbidden")))
    if policy.fail_severity:
        status = F.when(F.col("failures") > 0, "fail").when(~F.col("authoritative"), "warn").otherwise("pass")
        checks.append(check("architecture.introducedSeverity", status, F.col("relevant")))
        checks.append(check("architecture.observations", F.lit("warn"), F.col("observed"), F.col("observed") > 0))
    row = facts.limit(1).crossJoin(forbidden).crossJoin(counts)  # one row each
    listed = F.array_compact(F.array(*checks)) if checks else F.expr("cast(array() as array<struct<id:string,status:string,actual:string>>)")
    return row.select(F.explode(listed).alias("c")).select("c.*")


def gate_summary(checks: DataFrame) -> DataFrame:
    """status, passed, failed, warnings, skipped."""
    n = lambda v: F.count_if(F.col("status") == v)
    return checks.agg(F.when(n("fail") > 0, "fail").otherwise("pass").alias("gate"), n("pass").alias("passed"), n("fail").alias("failed"), n("warn").alias("warnings"), n("skipped").alias("skipped"))
