"""Requests as dicts, answers as dicts: eight operations on a program's text, for services that embed the engine."""

from __future__ import annotations

import hashlib
from typing import Any

from pyspark.sql import SparkSession

from .functions import facts as T
from .language.ast import Atom
from .language.names import SourceError, relation_name, term
from .language.program import parse
from .operators import authorization, impact
from .operators.fixpoint import Closure
from .operators.query import solve
from .sources.exports import conformance

SCHEMA = "stratalog-exchange/1"
#: Operations and the number of their arguments; each requires the capability ``<operation>-v1``.
OPERATIONS = {"parse": 0, "compile": 1, "expand": 0, "conformance": 0, "query": 1, "authorize": 3, "impact": 1, "recovery-audit": 1}


def validate(request: dict) -> str | None:
    """Why a request cannot be handled, or None."""
    op = request.get("operation")
    capabilities = request.get("capabilities") or []
    checks = [
        (request.get("schema") == SCHEMA, f"unsupported exchange schema {request.get('schema')}"), (bool(request.get("request_id")), "request_id must be nonempty"), (isinstance(request.get("source"), str), "source must be text"),
        (request.get("source_sha256") in (None, "sha256:" + hashlib.sha256(str(request.get("source")).encode()).hexdigest()), "source_sha256 does not match the source"), (sorted(set(capabilities)) == list(capabilities), "capabilities must be sorted and unique"),
        (op in OPERATIONS, f"unsupported operation {op}"), (f"{op}-v1" in capabilities, f"operation {op} requires capability {op}-v1"), (len(request.get("arguments") or []) == OPERATIONS.get(op, -1), f"operation {op} requires {OPERATIONS.get(op)} arguments"),
    ]
    return next((message for ok, message in checks if not ok), None)


def handle(spark: SparkSession, request: dict) -> dict[str, Any]:
    """status (ok, invalid, rejected) with a result or an error."""
    out = {"schema": SCHEMA, "request_id": request.get("request_id"), "operation": request.get("operation")}
    if problem := validate(request):
        return out | {"status": "invalid", "error": problem}
    try:
        return out | {"status": "ok", "result": _run(spark, request["operation"], request["source"], request.get("arguments") or [])}
    except (SourceError, ValueError, KeyError) as e:
        return out | {"status": "rejected", "error": str(e)}


def _run(spark: SparkSession, op: str, source: str, arguments: list[str]) -> Any:
    program = parse(source)
    if op == "parse":
        return {"module": program.module, "tuples": len(program.tuples), "rules": len(program.rules), "queries": [q.name for q in program.queries], "declarations": len(program.declarations)}
    if op == "expand":
        return [{"macro": e.macro, "arguments": list(e.arguments), "emitted": list(e.emitted), "stack": list(e.stack)} for e in program.expansions]
    if op == "conformance":
        return conformance(program)
    facts = T.from_atoms(spark, program.facts())
    if op == "compile":
        return {"target": arguments[0], "facts": len(program.facts()), "rules": len(program.all_rules()), "closed": Closure(facts, program.all_rules()).all().count()}
    if op == "query":
        return [r.asDict() for r in solve(Closure(facts, program.all_rules()), program.query(arguments[0]), ordered=True).collect()]
    if op == "authorize":
        return authorization.decide_one(facts, program.all_rules(), Atom(term(arguments[0]), relation_name(arguments[1]), term(arguments[2])))
    closed = Closure(facts, program.all_rules()).all()
    if op == "impact":
        edges, node = impact.graph(closed), term(arguments[0])
        rows = impact.impact(edges, [node]).orderBy("rank").select("node", "distance", "kind").collect()
        return {"node": node, "known": impact.known(edges, node), "impacts": [r.asDict() for r in rows]}
    from .operators.actions import recovery_of_facts

    return recovery_of_facts(closed, term(arguments[0]))
