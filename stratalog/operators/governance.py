"""Closed-world analyses: query plans and packs, schedules, audits of theorems, claims, obligations, tokens and locks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..language.ast import Program
from ..language.declarations import entity, node_of
from ..language.names import NAMESPACE
from ..plans.analysis import HINTS, order_literals
from .fixpoint import Closure
from .impact import cyclic_nodes
from .query import solve

# ---- query plans and packs


def cardinalities(facts: DataFrame) -> DataFrame:
    """relation, facts."""
    return facts.groupBy("relation").agg(F.count("*").alias("facts"))


def planner_hint(program: Program) -> str:
    """The hint of the first profile that gives one."""
    for d in program.declarations:
        if d.kind == "dsl_profile" and (v := d.get("planner_hint")) is not None:
            return v.token() or HINTS[2]
    return HINTS[2]


def plan_queries(program: Program, facts: DataFrame, hint: str | None = None) -> list[dict]:
    """For each query: hint, literals as written and as they would be joined, negative ones last."""
    hint = hint or planner_hint(program)
    sizes = {r["relation"]: r["facts"] for r in cardinalities(facts).collect()}  # one row a relation
    out = []
    for q in program.queries:
        order = order_literals(list(q.positive), hint, sizes)
        negative = [f"NOT {a.text()}" for a in q.negative]
        out.append({"query": q.name, "hint": hint, "before": [a.text() for a in q.positive] + negative, "after": [q.positive[i].text() for i in order] + negative, "cardinalities": [sizes.get(a.relation, 0) for a in q.positive]})
    return out


def check_packs(program: Program, facts: DataFrame, profile: str | None = None, **options) -> list[dict]:
    """Runs the queries of the selected packs: pack, query, status (pass, fail, missing_query, missing_pack), rows.

    A query must return rows if its pack lists it under ``must_return``.  With a
    profile only its pack is selected, else all packs.
    """
    packs = {entity(d): d for d in program.declarations if d.kind == "query_pack"}
    wanted = list(packs)
    if profile is not None:
        found = next((d for d in program.declarations if d.kind == "dsl_profile" and profile in (d.name, entity(d))), None)
        if found is None:
            raise KeyError(f"unknown profile {profile}")
        wanted = [n if "." in n else f"query_pack.{n}" for v in found.get("query_pack").members() if (n := v.token())]
    closed, queries, out = Closure(facts, program.all_rules(), **options), {q.name: q for q in program.queries}, []
    for name in wanted:
        if name not in packs:
            out.append({"pack": name, "query": None, "status": "missing_pack", "rows": 0})
            continue
        must = {v.token() for v in (packs[name].get("must_return").members() if packs[name].get("must_return") else [])}
        for v in packs[name].get("queries").members():
            query = queries.get(v.token())
            rows = solve(closed, query).count() if query else 0
            status = "missing_query" if query is None else "fail" if query.name in must and rows == 0 else "pass"
            out.append({"pack": name, "query": v.token(), "status": status, "rows": rows})
    return out


# ---- schedules

#: Statuses that satisfy a dependency, and those that can be scheduled.
ACCEPTED = ["verified", "reviewed", "proved"]
SELECTABLE = ["ready", "in_progress"]
TARGETS = "id string, module string, file string, declaration string, status string, priority bigint, dependencies array<string>"


def targets_of(program: Program) -> list[tuple]:
    out = []
    for d in program.declarations:
        if d.kind == "formalization_target":
            text = {k: (d.get(k).token() or "") for k in ("module", "file", "declaration", "status")}
            priority = d.get("priority").token()
            if not str(priority).isdigit():
                raise ValueError(f"{d.name}: priority must be a nonnegative integer")
            needs = [s.token() for s in d.get("dependencies").scalars()] if d.get("dependencies") else []
            out.append((d.name, *text.values(), int(priority), [n for n in needs if n]))
    return out


def target_problems(targets: DataFrame) -> DataFrame:
    """kind, detail: duplicate targets, missing dependencies, targets on dependency cycles."""
    double = targets.groupBy("id").count().where("count > 1").select(F.lit("duplicate").alias("kind"), F.col("id").alias("detail"))
    needs = targets.select("id", F.explode("dependencies").alias("needs"))
    gone = needs.join(targets.select(F.col("id").alias("needs")), "needs", "left_anti").select(F.lit("missing").alias("kind"), F.concat("id", F.lit("->"), "needs").alias("detail"))
    loops = cyclic_nodes(needs.select(F.col("id").alias("dependent"), F.col("needs").alias("dependency"))).select(F.lit("cycle").alias("kind"), F.col("node").alias("detail"))
    return double.unionByName(gone).unionByName(loops)


def schedule(targets: DataFrame) -> DataFrame:
    """Every target with ready and reasons; by priority, highest first, then id."""
    needs = targets.select("id", F.posexplode("dependencies").alias("at", "needs"))
    state = targets.select(F.col("id").alias("needs"), F.col("status").alias("have")).distinct()
    held = needs.join(state, "needs", "left")
    why = F.when(F.col("have").isNull(), F.concat(F.lit("missing:"), "needs")).when(~F.col("have").isin(ACCEPTED), F.concat(F.lit("dependency:"), "needs", F.lit(":"), "have"))
    blocked = held.withColumn("why", why).where("why is not null").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "why"))), lambda x: x["why"]).alias("blocking"))
    own = F.when(~F.col("status").isin(SELECTABLE), F.array(F.concat(F.lit("status:"), "status"))).otherwise(F.array().cast("array<string>"))
    rows = targets.join(blocked, "id", "left").withColumn("reasons", F.concat(own, F.coalesce("blocking", F.array().cast("array<string>"))))
    return rows.withColumn("ready", F.size("reasons") == 0).drop("blocking").orderBy(F.desc("priority"), "id")


def schedule_next(targets: DataFrame) -> DataFrame:
    """The ready target of highest priority, first by id: at most one row."""
    return schedule(targets).where("ready").orderBy(F.desc("priority"), "id").limit(1)


# ---- theorems, claims, obligations


def _r(name: str) -> str:
    return f"{NAMESPACE}.{name}"


def _objects(facts: DataFrame, relation: str, name: str) -> DataFrame:
    return facts.where(F.col("relation") == _r(relation)).groupBy("subject").agg(F.sort_array(F.collect_set("object")).alias(name))


def _of_kind(facts: DataFrame, kind: str) -> DataFrame:
    return facts.where((F.col("relation") == _r("kind")) & (F.col("object") == f"entity.{kind}")).select("subject").distinct()


def theorem_audit(facts: DataFrame) -> DataFrame:
    """Contract of every theorem: assumptions, lemmas, guarantees, evidence, criticality, nonvacuous, issues, ok."""
    none = F.array().cast("array<string>")
    proof = facts.where(F.col("relation").isin([_r(x) for x in ("proofToken", "validatedBy", "proves")])).groupBy("subject").agg(F.sort_array(F.collect_set("object")).alias("evidence"))
    level = facts.where((F.col("relation") == _r("criticality"))).groupBy("subject").agg(F.min("object").alias("criticality"))
    free = facts.where((F.col("relation") == _r("unconditional")) & (F.col("object") == "value.true")).select("subject").distinct().withColumn("unconditional", F.lit(True))
    rows = _of_kind(facts, "theorem")
    for part in (_objects(facts, "requiresAssumption", "assumptions"), _objects(facts, "requiresLemma", "lemmas"), _objects(facts, "ensures", "guarantees"), proof, level, free):
        rows = rows.join(part, "subject", "left")
    for relation, kind, name in (("requiresAssumption", "assumption", "missing_assumptions"), ("requiresLemma", "lemma", "missing_lemmas")):
        named = facts.where(F.col("relation") == _r(relation)).select("subject", "object")
        gone = named.join(_of_kind(facts, kind).withColumnRenamed("subject", "object"), "object", "left_anti")
        rows = rows.join(gone.groupBy("subject").agg(F.sort_array(F.collect_set("object")).alias(name)), "subject", "left")
    lists = ["assumptions", "lemmas", "guarantees", "evidence", "missing_assumptions", "missing_lemmas"]
    rows = rows.withColumns({n: F.coalesce(n, none) for n in lists} | {"criticality": F.coalesce(F.regexp_extract("criticality", r"(low|medium|high|critical)$", 1), F.lit("low")), "unconditional": F.coalesce("unconditional", F.lit(False))})
    rows = rows.withColumn("nonvacuous", (F.size("assumptions") > 0) | (F.size("lemmas") > 0) | F.col("unconditional"))
    each = lambda test, text: F.when(test, F.array(F.lit(text))).otherwise(none)
    issues = F.concat(
        each(~F.col("nonvacuous"), "vacuous-contract"), each(F.size("guarantees") == 0, "guarantee-missing"),
        F.transform("missing_assumptions", lambda x: F.concat(F.lit("missing-assumption:"), x)), F.transform("missing_lemmas", lambda x: F.concat(F.lit("missing-lemma:"), x)),
        each(F.col("criticality").isin("high", "critical") & (F.size("evidence") == 0), "proof-evidence-missing"),
    )
    return rows.withColumnRenamed("subject", "theorem").withColumn("issues", issues).withColumn("ok", F.size("issues") == 0)


#: Classes of evidence and the kinds that belong to them.
EVIDENCE = {"kernel": ["theorem", "proof"], "empirical": ["experiment", "dataset", "measurement"], "documentary": ["document", "paper", "source", "evidence"]}


def claim_audit(facts: DataFrame) -> DataFrame:
    """Every claim: supports (node, class), asserted_proved, issues, ok."""
    kinds = facts.where(F.col("relation") == _r("kind")).groupBy(F.col("subject").alias("object")).agg(F.collect_set("object").alias("kinds"))
    supports = facts.where(F.col("relation") == _r("supportedBy")).select("subject", "object").distinct().join(kinds, "object", "left")
    grade = F.when(F.col("kinds").isNull(), "unknown")
    for name, listed in EVIDENCE.items():
        grade = grade.when(F.arrays_overlap("kinds", F.array(*[F.lit(f"entity.{k}") for k in listed])), name)
    supports = supports.withColumn("class", grade.otherwise("graph")).groupBy("subject").agg(F.sort_array(F.collect_list(F.struct(F.col("object").alias("node"), "class"))).alias("supports"))
    proved = facts.where((F.col("relation") == _r("provedClaim")) & (F.col("object") == "value.true")).select("subject").distinct().withColumn("asserted_proved", F.lit(True))
    rows = _of_kind(facts, "claim").join(supports, "subject", "left").join(proved, "subject", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"supports": F.coalesce("supports", F.array().cast("array<struct<node:string,class:string>>")), "asserted_proved": F.coalesce("asserted_proved", F.lit(False))})
    issues = F.concat(
        F.when(F.size("supports") == 0, F.array(F.lit("support-missing"))).otherwise(none),
        F.transform(F.filter("supports", lambda s: s["class"] == "unknown"), lambda s: F.concat(F.lit("support-kind-missing:"), s["node"])),
        F.when(F.col("asserted_proved"), F.array(F.lit("external-claim-proof-boundary"))).otherwise(none),
    )
    return rows.withColumnRenamed("subject", "claim").withColumn("issues", issues).withColumn("ok", F.size("issues") == 0)


#: Proof tools that discharge obligations without evidence from outside.
NATIVE_TOOLS = ["lean4"]
OBLIGATIONS = "id string, relation string, statement string, tool string, status string, criticality string, evidence array<string>, waiver_reason string"


def obligations_of(program: Program) -> list[tuple]:
    out = []
    for d in program.declarations:
        if d.kind == "proof_obligation":
            first = lambda key, default=None: next((t for v in (d.get(key).members() if d.get(key) else []) if (t := v.token())), default)  # noqa: E731, B023
            seen = [t for key in ("evidence", "artifact_in", "artifact_out", "proof_token", "declaration") for v in (d.get(key).members() if d.get(key) else []) if (t := v.token()) and t.strip()]
            out.append((entity(d), first("relation"), first("statement"), first("tool"), first("status", "open"), first("criticality", "low"), list(dict.fromkeys(seen)), first("waiver_reason")))
    return out


def obligation_audit(obligations: DataFrame, known_relations: DataFrame) -> DataFrame:
    """verdict (satisfied, violated, blocked, waived) and reason of every obligation; ``known_relations`` has relation."""
    rows = obligations.join(known_relations.select("relation").distinct().withColumn("__known", F.lit(True)), "relation", "left")
    evident, waiver = F.size("evidence") > 0, F.length(F.trim(F.coalesce("waiver_reason", F.lit("")))) > 0
    is_ = lambda s: F.col("status") == s
    reason = (
        F.when(F.col("__known").isNull(), "unknown-relation").when(is_("failed"), None)
        .when(F.col("status").isin("open", "pending"), F.when(~F.col("tool").isin(NATIVE_TOOLS) & ~evident, "backend-unavailable-without-evidence").otherwise("obligation-not-discharged"))
        .when(is_("proved"), F.when(~evident, "proved-status-requires-evidence"))
        .when(is_("waived"), F.when(~waiver, "waiver-reason-missing").when(F.col("criticality") == "critical", "critical-obligation-cannot-be-waived"))
    )
    rows = rows.withColumn("reason", reason)
    verdict = F.when(F.col("reason").isNotNull(), "blocked").when(is_("failed"), "violated").when(is_("proved"), "satisfied").when(is_("waived"), "waived")
    return rows.withColumn("verdict", verdict).withColumn("relation_known", F.col("__known").isNotNull()).drop("__known")


def verdict_counts(audited: DataFrame) -> DataFrame:
    return audited.groupBy("verdict").agg(F.count("*").alias("n"))


# ---- proof tokens, locks, comparisons, profiles


def resolve_tokens(tokens: DataFrame, events: DataFrame) -> DataFrame:
    """The status of each proof token (id, declaration, module, kind, trust) among declaration events.

    Events have declaration, module, kind, trust, kernel_checked, uses_sorry, fingerprint.
    """
    found = events.groupBy("declaration").agg(F.count("*").alias("n"), F.min(F.struct("module", "kind", "trust", "kernel_checked", "uses_sorry", "fingerprint")).alias("e"))
    rows = tokens.join(found, "declaration", "left")
    status = (
        F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous")
        .when(F.col("module").isNotNull() & ~F.col("module").eqNullSafe(F.col("e.module")), "module_mismatch")
        .when(F.col("kind").isNotNull() & ~F.col("kind").eqNullSafe(F.col("e.kind")), "kind_mismatch")
        .when(~F.coalesce(F.col("e.kernel_checked"), F.lit(False)), "kernel_missing").when(F.coalesce(F.col("e.uses_sorry"), F.lit(False)), "uses_sorry")
        .when(F.col("trust").isNotNull() & ~F.col("trust").eqNullSafe(F.col("e.trust")), "trust_mismatch")
        .when(F.coalesce(F.col("e.fingerprint"), F.lit("")) == "", "fingerprint_missing").otherwise("resolved")
    )
    return rows.select("id", "declaration", status.alias("status"), F.col("e.fingerprint").alias("fingerprint"))


def compare_locks(locked: DataFrame, current: DataFrame, strict: bool = True) -> DataFrame:
    """token_id and status of locked against current statements (token_id, declaration, module, kind, fingerprint, resolved)."""
    a, b = locked.alias("a"), current.alias("b")
    rows = a.join(b, F.col("a.token_id") == F.col("b.token_id"), "full_outer")
    differs = lambda c: ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    status = (
        F.when(F.col("a.token_id").isNull(), "unexpected" if strict else "allowed").when(F.col("b.token_id").isNull(), "missing")
        .when(~F.coalesce(F.col("b.resolved"), F.lit(False)), "unresolved").when(differs("declaration"), "declaration_changed").when(differs("module"), "module_changed")
        .when(differs("kind"), "kind_changed").when(differs("fingerprint"), "fingerprint_changed").otherwise("unchanged")
    )
    return rows.select(F.coalesce("a.token_id", "b.token_id").alias("token_id"), status.alias("status"))


def compare_reports(left: DataFrame, right: DataFrame) -> DataFrame:
    """Lines (section, line) that only one of two reports has: side left or right."""
    key = ["section", "line"]
    return left.select(*key).exceptAll(right.select(*key)).withColumn("side", F.lit("left")).unionByName(right.select(*key).exceptAll(left.select(*key)).withColumn("side", F.lit("right")))


def type_errors(facts: DataFrame, signatures: DataFrame, kinds: DataFrame) -> DataFrame:
    """Facts whose ends are not of the kinds that a profile (relation, subject_kind, object_kind) allows; kinds: node, kind."""
    rows = facts.join(signatures, "relation")
    rows = rows.join(kinds.select(F.col("node").alias("subject"), F.col("kind").alias("have_subject")), "subject", "left").join(kinds.select(F.col("node").alias("object"), F.col("kind").alias("have_object")), "object", "left")
    bad = ~F.col("have_subject").eqNullSafe(F.col("subject_kind")) | ~F.col("have_object").eqNullSafe(F.col("object_kind"))
    return rows.where(bad).select("subject", "relation", "object", "subject_kind", "have_subject", "object_kind", "have_object")


def missing_references(references: DataFrame, declared: DataFrame) -> DataFrame:
    """References (declaration, key, options: names that would do) that no declared entity (column entity) satisfies."""
    met = references.select("declaration", "key", F.explode("options").alias("entity")).join(declared.select("entity").distinct(), "entity", "left_semi")
    return references.join(met.select("declaration", "key").distinct(), ["declaration", "key"], "left_anti")


# ---- scored choices


def weighted_scores(measurements: DataFrame, weights: dict[str, float], minimum_confidence: float, minimum_samples: int) -> DataFrame:
    """component, candidate, metric_count, covered_weight, score.

    A metric's value is the mean weighted by confidence and samples; it counts
    if its own confidence and samples suffice; a score is the weighted mean of
    the metrics that count.
    """
    w = F.col("confidence") * F.col("samples")
    by_metric = measurements.groupBy("component", "candidate", "metric").agg(F.sum(F.col("value") * w).alias("top"), F.sum(w).alias("w"), F.sum("samples").alias("samples"))
    by_metric = by_metric.where("w > 0").select("component", "candidate", "metric", (F.col("top") / F.col("w")).alias("value"), (F.col("w") / F.col("samples")).alias("confidence"), "samples")
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    accepted = by_metric.where((F.col("confidence") >= minimum_confidence) & (F.col("samples") >= minimum_samples)).withColumn("weight", table[F.col("metric")]).where("weight is not null")
    return accepted.groupBy("component", "candidate").agg(F.count("*").alias("metric_count"), F.sum("weight").alias("covered_weight"), (F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("score"))


def decide_candidates(scores: DataFrame, current: DataFrame, minimum_metrics: int, decision_margin: float) -> DataFrame:
    """Each component's status, recommended candidate, score and margin.

    ``current`` has component and current.  Statuses: insufficient_evidence,
    review_required, retain_current, candidate_change.
    """
    order = Window.partitionBy("component").orderBy(F.desc("score"), "candidate")
    ranked = scores.where(F.col("metric_count") >= minimum_metrics).where("score is not null").withColumns({"rank": F.row_number().over(order), "second": F.lead("score").over(order)}).where("rank = 1")
    rows = current.join(ranked, "component", "left").withColumn("margin", F.col("score") - F.coalesce("second", F.lit(0.0)))
    status = (
        F.when(F.col("candidate").isNull(), "insufficient_evidence").when(F.col("second").isNotNull() & (F.col("margin") < decision_margin), "review_required")
        .when(F.col("candidate") == F.col("current"), "retain_current").otherwise("candidate_change")
    )
    return rows.select("component", "current", status.alias("status"), F.col("candidate").alias("recommended"), "score", "margin")


def declaration_table(program: Program) -> list[tuple]:
    """(kind, entity, key, value) of each scalar of each declaration."""
    return [(d.kind, entity(d), k, node_of(s)) for d in program.declarations for k, v in d.attrs for s in v.scalars()]


# ---- bundles and attestations

#: Declaration kinds that make a unit one of a profile.
UNIT_KINDS = {"tm.det": "tm_atom", "lts": "lts_atom", "constraint": "policy"}


def check_bundle(sources: dict[str, str], profile: str = "auto", exactly_one: bool = False) -> list[dict]:
    """file, ok, profile and error of each source: it parses, and has at least (or exactly) one declaration of its profile's kind."""
    from ..language.names import SourceError
    from ..language.program import parse

    out = []
    for name, text in sorted(sources.items()):
        try:
            program = parse(text)
        except SourceError as e:
            out.append({"file": name, "ok": False, "profile": None, "error": str(e)})
            continue
        have = {p: sum(d.kind == k for d in program.declarations) for p, k in UNIT_KINDS.items()}
        own = next((p for p, n in have.items() if n), None) if profile == "auto" else profile
        n = have.get(own, 0)
        ok = n == 1 if exactly_one else n >= 1
        out.append({"file": name, "ok": ok, "profile": own, "error": None if ok else f"{n} units of profile {own or 'auto'}"})
    return out


def attest(expected: DataFrame, files: DataFrame) -> DataFrame:
    """path and status (ok, missing, changed, unlisted) of files (path, sha256) against a list of the same."""
    rows = expected.select("path", F.col("sha256").alias("want")).join(files.select("path", F.col("sha256").alias("have")), "path", "full_outer")
    status = F.when(F.col("want").isNull(), "unlisted").when(F.col("have").isNull(), "missing").when(F.col("want") == F.col("have"), "ok").otherwise("changed")
    return rows.select("path", status.alias("status"))
