"""Agents' actions: tokens, their life, postconditions and recovery, grants and leases.

Requests, checkpoints, executions and observations are rows; a check is a
column, so any number of requests is judged in one pass.  Checks fail closed:
a null counts as a failed check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REQUEST = (
    "token_id string, task_id string, agent_id string, module string, base_revision string, current_revision string, scope string, lease_id string, context_bundle_id string, now bigint, ttl_seconds bigint, "
    "lease_agent string, lease_module string, lease_scope string, lease_base_revision string, lease_active boolean, lease_expires_at bigint, action_type string, target string, required_postconditions array<string>, rollback_kind string, rollback_reference string, "
    "context_fresh boolean, context_complete boolean, no_critical_conflict boolean, authorized boolean, valid_lease boolean, preconditions_pass boolean, recovery_available boolean, store_integrity boolean"
)
#: Evidence columns and their failures, in order.
EVIDENCE = ["context_fresh", "context_complete", "no_critical_conflict", "authorized", "valid_lease", "preconditions_pass", "recovery_available", "store_integrity"]
IDENTITY = ["token_id", "task_id", "agent_id", "module", "base_revision", "current_revision", "scope", "lease_id"]


def _failures(checks: list[tuple[str, Column]]) -> Column:
    """Names of the checks that do not hold, in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks]))


def valid_digest(c: Column) -> Column:
    return c.rlike(r"^sha256:[0-9a-fA-F]{64}$")


def issue_tokens(requests: DataFrame) -> DataFrame:
    """``requests`` with failures, allowed and expires_at (the earlier of the token's and the lease's)."""
    c = F.col
    filled = lambda names: [F.length(F.coalesce(c(n), F.lit(""))) > 0 for n in names]
    every = lambda tests: F.forall(F.array(*tests), lambda t: t)
    checks = [(e.replace("_", "-"), c(e)) for e in EVIDENCE] + [
        ("context-stale", c("base_revision") == c("current_revision")),
        ("lease-mismatch", (c("lease_agent") == c("agent_id")) & (c("lease_module") == c("module")) & (c("lease_scope") == c("scope")) & (c("lease_base_revision") == c("base_revision"))),
        ("lease-inactive", c("lease_active")), ("lease-expired", c("now") < c("lease_expires_at")), ("invalid-token-ttl", c("ttl_seconds") > 0),
        ("invalid-context-bundle-id", valid_digest(c("context_bundle_id"))), ("invalid-identity", every(filled(IDENTITY))), ("invalid-action", every(filled(["action_type", "target"]))),
        ("missing-rollback", c("rollback_kind").isin("rollback", "compensation") & filled(["rollback_reference"])[0]),
    ]
    rows = requests.withColumn("failures", _failures(checks))
    allowed = F.size("failures") == 0
    return rows.withColumn("allowed", allowed).withColumn("expires_at", F.when(allowed, F.least(c("now") + c("ttl_seconds"), c("lease_expires_at"))))


def token_life(issued: DataFrame, checkpoints: DataFrame, executions: DataFrame) -> DataFrame:
    """token_id, state (denied, issued, checkpointed, consumed) and failure (the first check that stopped the token).

    Checkpoints: token_id, checkpoint_id, agent_id, current_revision,
    snapshot_digest, now.  Executions: token_id, action_id, checkpoint_id,
    current_revision, now, store_integrity, lease_agent, lease_module,
    lease_scope, lease_base_revision, lease_active, lease_expires_at, outputs
    (array of artifact, hash).  A token is used once: of several checkpoints or
    executions the earliest counts, by now and id, and the token's failure says
    so if there are more.
    """
    first = lambda df, id_: df.withColumns({"__n": F.row_number().over(Window.partitionBy("token_id").orderBy("now", id_)), "__all": F.count("*").over(Window.partitionBy("token_id"))}).where("__n = 1").drop("__n")
    t, k, x = issued.alias("t"), first(checkpoints, "checkpoint_id").alias("k"), first(executions, "action_id").alias("x")
    rows = t.join(k, F.col("t.token_id") == F.col("k.token_id"), "left").join(x, F.col("t.token_id") == F.col("x.token_id"), "left")
    c = F.col
    bound = _failures([
        ("agent-mismatch", c("k.agent_id") == c("t.agent_id")), ("context-stale", c("k.current_revision") == c("t.base_revision")), ("token-expired", c("k.now") < c("t.expires_at")),
        ("invalid-checkpoint-id", F.length("k.checkpoint_id") > 0), ("invalid-snapshot-digest", valid_digest(c("k.snapshot_digest"))),
    ])
    lease = (c("x.lease_agent") == c("t.agent_id")) & (c("x.lease_module") == c("t.module")) & (c("x.lease_scope") == c("t.scope")) & (c("x.lease_base_revision") == c("t.base_revision"))
    outputs = F.forall(F.coalesce("x.outputs", F.array().cast("array<struct<artifact:string,hash:string>>")), lambda o: (F.length(o["artifact"]) > 0) & valid_digest(o["hash"]))
    used = _failures([
        ("checkpoint-mismatch", c("x.checkpoint_id") == c("k.checkpoint_id")), ("context-stale", (c("x.current_revision") == c("t.base_revision")) & (c("k.current_revision") == c("t.base_revision"))),
        ("token-expired", c("x.now") < c("t.expires_at")), ("store-integrity", c("x.store_integrity")), ("lease-mismatch", lease), ("lease-inactive", c("x.lease_active")),
        ("lease-expired", c("x.now") < c("x.lease_expires_at")), ("invalid-action-id", F.length("x.action_id") > 0), ("invalid-observed-output", outputs),
    ])
    rows = rows.select(c("t.token_id").alias("token_id"), c("t.allowed").alias("allowed"), c("k.token_id").isNotNull().alias("has_k"), c("x.token_id").isNotNull().alias("has_x"), bound.alias("b"), used.alias("u"), c("t.failures").alias("failures"), (c("k.__all") > 1).alias("many_k"), (c("x.__all") > 1).alias("many_x"))
    checkpointed = c("allowed") & c("has_k") & (F.size("b") == 0)
    consumed = checkpointed & c("has_x") & (F.size("u") == 0)
    state = F.when(~c("allowed"), "denied").when(consumed, "consumed").when(checkpointed, "checkpointed").otherwise("issued")
    failure = (
        F.when(~c("allowed"), F.get("failures", F.lit(0))).when(c("has_k") & (F.size("b") > 0), F.get("b", F.lit(0))).when(c("has_x") & ~c("has_k"), "token-not-checkpointed")
        .when(c("has_x") & (F.size("u") > 0), F.get("u", F.lit(0))).when(c("many_k"), "token-not-issued").when(c("many_x"), "token-not-checkpointed")
    )
    return rows.select("token_id", state.alias("state"), failure.alias("failure"))


def recovery_audit(tokens: DataFrame, observed: DataFrame, recoveries: DataFrame) -> DataFrame:
    """The outcome of each token's action: lifecycle-invalid, verified, recovery-required, recovered, recovery-failed.

    Tokens: token_id, state, required_postconditions, rollback_kind,
    rollback_reference.  Observed: token_id, name, passed, evidence.
    Recoveries: token_id, kind, reference, completed, evidence (at most one).
    """
    none = F.array().cast("array<string>")
    by_name = observed.groupBy("token_id", "name").agg(F.count("*").alias("n"), F.min(F.struct(F.coalesce("passed", F.lit(False)).alias("passed"), F.coalesce("evidence", F.lit("")).alias("evidence"))).alias("v"))
    seen = by_name.groupBy("token_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("seen"), F.sort_array(F.collect_set(F.when(F.col("n") > 1, F.col("name")))).alias("duplicates"))
    rows = tokens.join(seen, "token_id", "left").join(recoveries.select("token_id", F.struct("kind", "reference", "completed", "evidence").alias("r")), "token_id", "left")
    empty = F.expr("cast(map() as map<string,struct<passed:boolean,evidence:string>>)")
    rows = rows.withColumns({"seen": F.coalesce("seen", empty), "duplicates": F.coalesce("duplicates", none), "required": F.coalesce("required_postconditions", none)})
    at = lambda n: F.try_element_at("seen", n)
    rows = rows.withColumns({
        "missing": F.filter("required", lambda n: at(n).isNull()),
        "failed": F.filter("required", lambda n: at(n).isNotNull() & ~F.coalesce(at(n)["passed"], F.lit(False))),
        "evidence_missing": F.filter("required", lambda n: F.coalesce(at(n)["passed"], F.lit(False)) & (F.coalesce(at(n)["evidence"], F.lit("")) == "")),
    })
    r = F.col("r")
    problems = _failures([("recovery-kind-mismatch", r["kind"] == F.col("rollback_kind")), ("recovery-reference-mismatch", r["reference"] == F.col("rollback_reference")), ("recovery-incomplete", r["completed"]), ("recovery-evidence-missing", F.length(r["evidence"]) > 0)])
    consumed = F.coalesce(F.col("state") == "consumed", F.lit(False))
    passed = consumed & (F.size("missing") + F.size("failed") + F.size("evidence_missing") + F.size("duplicates") == 0)
    issues = F.when(passed, F.when(r.isNotNull(), F.array(F.lit("unexpected-recovery"))).otherwise(none)).when(~consumed, F.array(F.lit("lifecycle-not-consumed"))).when(r.isNull(), F.array(F.lit("recovery-missing"))).otherwise(problems)
    rows = rows.withColumns({"passed": passed, "recovery_issues": issues})
    clean = F.size("recovery_issues") == 0
    outcome = F.when(F.col("passed"), F.when(clean, "verified").otherwise("recovery-failed")).when(~consumed, "lifecycle-invalid").when(r.isNull(), "recovery-required").when(clean, "recovered").otherwise("recovery-failed")
    rows = rows.withColumn("outcome", outcome)
    return rows.select("token_id", "missing", "failed", "evidence_missing", "duplicates", "recovery_issues", "outcome", (F.col("outcome") == "verified").alias("action_verified"), F.col("outcome").isin("verified", "recovered").alias("safe"))


def overlapping_leases(leases: DataFrame) -> DataFrame:
    """Active leases (lease_id, module, scope, starts_at, expires_at) that begin before an earlier one of their scope ends."""
    before = Window.partitionBy("module", "scope").orderBy("starts_at", "lease_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = leases.where("active").withColumn("__until", F.max("expires_at").over(before))
    return rows.where("starts_at < __until").drop("__until")


def may_execute(workflows: DataFrame) -> DataFrame:
    """``workflows`` with may_execute: token issued, checkpointed at the current revision, not yet consumed."""
    c = F.col
    test = c("token_issued") & c("checkpointed") & ~c("consumed") & (c("checkpoint_revision") == c("current_revision")) & c("store_integrity")
    return workflows.withColumn("may_execute", F.coalesce(test, F.lit(False)))


def recovery_of_facts(facts: DataFrame, request: str) -> dict:
    """The recovery audit of one request node from its facts: state, required, postconditionEvent and recoveryEvent."""
    from ..functions import facts as T
    from ..language.names import NAMESPACE

    own = facts.where(F.col("subject") == request)
    of = lambda name: own.where(F.col("relation") == f"{NAMESPACE}.{name}")
    a = F.col("attrs")
    state = of("tokenState").select(F.substring_index("object", ".", -1).alias("state"), T.typed(a, "rollback_kind", "text").alias("rollback_kind"), T.typed(a, "rollback_reference", "text").alias("rollback_reference"))
    required = of("requiresPostcondition").agg(F.sort_array(F.collect_set(F.regexp_replace("object", "^post\\.", ""))).alias("required_postconditions"))
    tokens = state.crossJoin(required).withColumn("token_id", F.lit(request))
    seen = of("postconditionEvent").select(F.lit(request).alias("token_id"), F.regexp_replace("object", "^post\\.", "").alias("name"), T.typed(a, "passed", "boolean").alias("passed"), T.typed(a, "evidence", "text").alias("evidence"))
    undone = of("recoveryEvent").select(F.lit(request).alias("token_id"), T.typed(a, "kind", "text").alias("kind"), T.typed(a, "reference", "text").alias("reference"), T.typed(a, "completed", "boolean").alias("completed"), T.typed(a, "evidence", "text").alias("evidence"))
    row = recovery_audit(tokens, seen, undone).first()
    if row is None:
        raise ValueError(f"{request} has no token state")
    return row.asDict()


def preflight(requests: DataFrame, grants: DataFrame, leases: DataFrame, checkpoints: DataFrame, heads: DataFrame) -> DataFrame:
    """``requests`` with failures and allowed, judged against what is stored.

    Requests: request_id, agent_id, module, base_revision, scope, lease_id,
    checkpoint_id, now, preconditions_pass, rollback_kind, rollback_reference.
    Grants: agent_id, scope.  Leases: lease_id, agent_id, module, scope,
    base_revision, expires_at, active.  Checkpoints: checkpoint_id, module,
    revision.  Heads: module, revision, store_integrity.
    """
    q = requests.alias("q")
    g = grants.select("agent_id", "scope").distinct().withColumn("granted", F.lit(True)).alias("g")
    rows = q.join(g, (F.col("q.agent_id") == F.col("g.agent_id")) & (F.col("q.scope") == F.col("g.scope")), "left")
    rows = rows.join(leases.alias("l"), F.col("q.lease_id") == F.col("l.lease_id"), "left").join(checkpoints.alias("k"), F.col("q.checkpoint_id") == F.col("k.checkpoint_id"), "left").join(heads.alias("h"), F.col("q.module") == F.col("h.module"), "left")
    c = F.col
    lease = (c("l.agent_id") == c("q.agent_id")) & (c("l.module") == c("q.module")) & (c("l.scope") == c("q.scope")) & (c("l.base_revision") == c("q.base_revision")) & c("l.active") & (c("l.expires_at") > c("q.now"))
    failures = _failures([
        ("store-replay-mismatch", c("h.store_integrity")), ("context-stale", c("q.base_revision") == c("h.revision")), ("unauthorized-scope", c("g.granted")), ("missing-lease", c("l.lease_id").isNotNull()),
        ("invalid-lease", c("l.lease_id").isNull() | F.coalesce(lease, F.lit(False))), ("missing-current-checkpoint", (c("k.module") == c("q.module")) & (c("k.revision") == c("q.base_revision"))), ("precondition-failed", c("q.preconditions_pass")),
        ("missing-rollback", c("q.rollback_kind").isin("rollback", "compensation") & (F.length(F.trim("q.rollback_reference")) > 0)),
    ])
    return rows.select("q.*", failures.alias("failures")).withColumn("allowed", F.size("failures") == 0)


def grant_lease(leases: DataFrame, lease: dict) -> DataFrame:
    """Leases with one more; raises if its scope has an active one that has not ended."""
    busy = leases.where((F.col("module") == lease["module"]) & (F.col("scope") == lease["scope"]) & F.col("active") & (F.col("expires_at") > lease["now"]))
    if not busy.isEmpty():
        raise ValueError("the scope already has an active lease")
    names = leases.columns
    row = {**lease, "expires_at": lease["now"] + lease["ttl_seconds"], "active": True}
    return leases.unionByName(leases.sparkSession.createDataFrame([tuple(row.get(n) for n in names)], leases.schema))
