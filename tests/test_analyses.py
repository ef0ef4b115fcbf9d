import hashlib
import http.server
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from stratalog import exchange, library
from stratalog.functions import clocks, conditions
from stratalog.functions import facts as T
from stratalog.language.ast import Atom
from stratalog.language.builder import Builder
from stratalog.language.program import parse
from stratalog.operators import actions, causal, events, governance, revision
from stratalog.operators.fixpoint import Closure
from stratalog.operators.ordering import number_rows
from stratalog.sources import adapters, blocks, codecs, declared, embedded, exports, records
from stratalog.streaming import polling


def log(spark, rows):
    return spark.createDataFrame([(s, "rel.state", o, {}, "", r, f"e{r}", op) for s, o, r, op in rows], revision.LOG_SCHEMA)


def test_revisions(spark):
    rows = log(spark, [("a", "open", 1, "assert"), ("a", "open", 2, "retract"), ("a", "closed", 3, "assert")])
    names = lambda n: {r["object"] for r in revision.snapshot(rows, n).collect()}
    assert names(1) == {"open"} and names(2) == set() and names(3) == {"closed"} and names(None) == {"closed"}
    assert revision.latest_revision(rows).first()[0] == 3 and revision.latest_revision(rows.limit(0)).first()[0] == 0
    assert revision.problems(rows).count() == 0
    bad = rows.unionByName(log(spark, [("a", "open", 1, "retract"), ("b", "x", 4, "drop")]))
    edges = spark.createDataFrame([("e1", "e2"), ("e2", "e1"), ("e9", "e1")], "left string, right string")
    assert {r["kind"] for r in revision.problems(bad, edges).collect()} == {"duplicate_revision", "unknown_operation", "unknown_event", "cycle"}
    late = log(spark, [("a", "late", 0, "assert"), ("a", "open", 1, "assert")])
    assert revision.append(rows, late).count() == 4 and revision.rejected(rows, late).count() == 1
    assert {(r["change"], r["object"]) for r in revision.drift(rows, 1, 3).collect()} == {("added", "closed"), ("removed", "open")}
    assert revision.replay_differences(rows, revision.snapshot(rows)).count() == 0 and revision.preflight(rows, 3) == [] and revision.preflight(rows, 2) == ["context-stale"]


def test_publish(spark, tmp_path):
    new = spark.createDataFrame([("d", "a", "rel.p", "b", "")], "declaration string, subject string, relation string, object string, attrs_key string")
    ops = revision.diff(new.limit(0), new)
    path = f"{tmp_path}/log"
    assert revision.publish(spark, path, ops, 0) == 1 and revision.publish(spark, path, revision.diff(new, new.limit(0)), 1) == 2
    with pytest.raises(ValueError):
        revision.publish(spark, path, ops, 0)
    with pytest.raises(ValueError):
        revision.publish(spark, path, ops.withColumn("relation", F.lit("rel.provedClaim")), 2)
    assert revision.snapshot(spark.read.parquet(path)).count() == 0 and revision.snapshot(spark.read.parquet(path), 1).count() == 1
    assert revision.batch_revision(new).first()[0].startswith("sha256:")


def test_causality(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d")], "left string, right string")
    order = causal.before(edges)
    pairs = lambda df: {tuple(r) for r in df.select("left", "right").collect()}
    assert pairs(order) == {("a", "b"), ("b", "c"), ("a", "c"), ("a", "d")} == pairs(causal.before(edges, doubling=False))
    everyone = causal.events(edges)
    assert pairs(causal.concurrent(order, everyone.select(F.col("event").alias("left")).crossJoin(everyone.select(F.col("event").alias("right"))))) == {("b", "d"), ("d", "b"), ("c", "d"), ("d", "c")}
    with pytest.raises(ValueError):
        causal.add_edges(edges, spark.createDataFrame([("c", "a")], "left string, right string"))
    clocked = spark.createDataFrame([("a", {"x": 1}), ("b", {"x": 2}), ("c", {"x": 2, "y": 1}), ("d", {"y": 1}), ("z", {})], "event string, vector map<string,bigint>")
    assert pairs(causal.edges_of_vector_clocks(clocked)) == {("a", "b"), ("a", "c"), ("b", "c"), ("d", "c"), ("z", "a"), ("z", "b"), ("z", "c"), ("z", "d")}
    assert pairs(causal.inconsistent(order, clocked, "vector")) == {("a", "d")}
    row = spark.range(1).select(clocks.vector_concurrent(F.expr("map('x', 1)"), F.expr("map('x', 1)")).alias("same"), clocks.hybrid_before(F.expr("named_struct('wall', 1, 'logical', 2)"), F.expr("named_struct('wall', 1, 'logical', 3)")).alias("hlc")).first()
    assert row["same"] and row["hlc"]


def test_numbers(spark):
    rows = spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(7)
    got = [r["n"] for r in number_rows(rows, ["k"], "n", 5).orderBy("k").collect()]
    assert got == list(range(5, 1005)) and number_rows(rows.limit(0), ["k"], "n").count() == 0


def test_conditions(spark):
    df = spark.createDataFrame([(1.0, 2.0, True), (5.0, 2.0, False)], "a double, b double, c boolean")
    count = lambda t: df.where(conditions.column(t)).count()
    assert count("a > b -> c") == 1 and count("!(a + 1 * 2 >= 7) || c") == 1 and count("a - 1 - 1 = 3 && !c") == 1 and count("-a < 0") == 2 and count("c = (a < b)") == 2 and count("true -> false -> true") == 2
    for bad in ("a >", "a && b + 1", "(a > 1", "a $ b", "a > 1 b", "c > 1 && c"):
        with pytest.raises(conditions.ConditionError):
            conditions.column(bad)


def test_scheduling(spark):
    t = spark.createDataFrame([("limit", "m", "f", "d", "ready", 9, ["base"]), ("finite", "m", "f", "d", "ready", 5, ["done"]), ("done", "m", "f", "d", "proved", 1, []), ("base", "m", "f", "d", "draft", 1, ["finite"])], governance.TARGETS)
    got = {r["id"]: (r["ready"], r["reasons"]) for r in governance.schedule(t).collect()}
    assert got["limit"] == (False, ["dependency:base:draft"]) and got["finite"] == (True, []) and got["base"] == (False, ["status:draft", "dependency:finite:ready"]) and governance.schedule_next(t).first()["id"] == "finite"
    bad = t.unionByName(spark.createDataFrame([("base", "m", "f", "d", "ready", 1, ["gone", "limit"])], governance.TARGETS))
    assert {(r["kind"], r["detail"]) for r in governance.target_problems(bad).collect()} >= {("duplicate", "base"), ("missing", "base->gone"), ("cycle", "limit")}
    p = parse("FORMALIZATION_TARGET a [module=m, file=\"f\", declaration=d, status=ready, priority=3, dependencies=[b c]].")
    assert governance.targets_of(p) == [("a", "m", "f", "d", "ready", 3, ["b", "c"])]


def test_audits(spark):
    p = parse("theorem:t#kind@entity:theorem.\ntheorem:t#requires_assumption@assumption:a.\nassumption:a#kind@entity:assumption.\ntheorem:t#ensures@g.\ntheorem:u#kind@entity:theorem.\ntheorem:u#criticality@value:critical.\nclaim:c#kind@entity:claim.\nclaim:c#supported_by@theorem:t.\nclaim:c#supported_by@mystery:m.")
    facts = T.from_atoms(spark, p.facts())
    got = {r["theorem"]: r for r in governance.theorem_audit(facts).collect()}
    assert got["theorem.t"]["ok"] and got["theorem.u"]["issues"] == ["vacuous-contract", "guarantee-missing", "proof-evidence-missing"]
    claim = governance.claim_audit(facts).first()
    assert [tuple(s) for s in claim["supports"]] == [("mystery.m", "unknown"), ("theorem.t", "kernel")] and claim["issues"] == ["support-kind-missing:mystery.m"]
    o = parse('REFINES r [spec=a, impl=b].\nPROOF_OBLIGATION p [relation=r, statement="s", tool=z3, status=PROVED, evidence=[e]].')
    rows = spark.createDataFrame(governance.obligations_of(o), governance.OBLIGATIONS)
    assert governance.obligation_audit(rows, spark.createDataFrame([("r",)], "relation string")).first()["verdict"] == "satisfied"


def test_evaluation(spark):
    m = spark.createDataFrame([("x", "a", "speed", 0.9, 1.0, 10), ("x", "a", "speed", 0.3, 0.5, 10), ("x", "b", "speed", 0.5, 0.9, 20), ("x", "b", "cost", 0.5, 0.1, 20)], "component string, candidate string, metric string, value double, confidence double, samples bigint")
    s = governance.weighted_scores(m, {"speed": 0.7, "cost": 0.3}, 0.5, 5)
    assert {r["candidate"]: round(r["score"], 6) for r in s.collect()} == {"a": 0.7, "b": 0.5}
    now = spark.createDataFrame([("x", "b"), ("y", "b")], "component string, current string")
    assert {r["component"]: r["status"] for r in governance.decide_candidates(s, now, 1, 0.1).collect()} == {"x": "candidate_change", "y": "insufficient_evidence"}
    assert governance.decide_candidates(s, now, 1, 0.3).where("component = 'x'").first()["status"] == "review_required"


def test_token_checks_fail_closed(spark):
    row = spark.createDataFrame([(None,) * 30], actions.REQUEST)
    assert len(actions.issue_tokens(row).first()["failures"]) == 17


def test_event_hashes_tell_fields_apart(spark):
    rows = [("s", 1, "e", "t", "a", None, None), ("s", 1, "e", "t", None, "a", None), ("s", 1, "e", "t", "a\n", "", ""), ("s", 1, "e", "t", "a", "\n", ""), ("s", 1, "e", "t", "a", "", None), ("s", 1, "e", "t", "-", "1:a,", None)]
    found = set()
    for r in rows:
        batch = spark.createDataFrame([r], "stream string, order bigint, event_id string, event_type string, actor string, request_id string, payload string")
        one = events.chain(batch)
        assert events.verify_chain(one).first()["ok"]
        found.add(one.first()["event_sha256"])
    assert len(found) == len(rows)


def test_event_chain(spark):
    batch = spark.createDataFrame([("s", i, f"e{i}", "action-consumed", "a", "r", json.dumps({"workflow_id": "w"})) for i in range(5)], "stream string, order bigint, event_id string, event_type string, actor string, request_id string, payload string")
    first = events.chain(batch.where("order < 3"))
    more = events.append(first, batch.where("order >= 3"), "s", 3, "later")
    whole = first.unionByName(more)
    assert events.verify_chain(whole).first()["ok"] and [r["revision"] for r in events.read_range(whole, "s", 2, 4).collect()] == [2, 3, 4]
    with pytest.raises(ValueError):
        events.append(first, batch, "s", 1, "x")
    forged = whole.withColumn("payload", F.when(F.col("revision") == 2, "{}").otherwise(F.col("payload")))
    assert events.verify_chain(forged).first()["bad_payloads"] == 1 and not events.verify_chain(whole.where("revision <> 2")).first()["ok"]
    kept = events.receipts(whole)
    assert events.verify_receipts(whole, kept).count() == 0 and events.verify_receipts(whole.where("revision <> 5"), kept).first()["problem"] == "count"
    shots = spark.createDataFrame([("s", 1, "r", "x")], "stream string, revision bigint, reducer string, body string")
    assert events.keep_snapshot(shots, "s", 1, "r", "x").count() == 1 and events.keep_snapshot(shots, "s", 2, "r", "y").count() == 2
    with pytest.raises(ValueError):
        events.keep_snapshot(shots, "s", 1, "r", "z")
    assert events.workflow_projection(whole).first()["observation_count"] == 5


def test_codecs():
    rows = [{"a": 1, "b": "x y", "c": True, "d": 1.5}]
    for name in ("json", "edn", "csv", "yaml", "kv"):
        assert codecs.parse(name, codecs.emit(name, rows)) == rows, name
    assert codecs.parse_csv('A b,"q ""x"""\n1\n') == [{"a_b": 1, "q_x": ""}] and codecs.parse_csv("1,2\n", header=False) == [{"col_1": 1, "col_2": 2}]
    assert codecs.parse_yaml("- a: 1\n  b: x\n- a: 2\n") == [{"a": 1, "b": "x"}, {"a": 2}] and codecs.parse_edn('[{:a "x" :b [1 2]} {:a nil}]') == [{"a": "x", "b": [1, 2]}, {"a": None}]
    with pytest.raises(KeyError):
        codecs.parse("toml", "")


def test_files_and_records(spark, tmp_path):
    (tmp_path / "d.csv").write_text('Name,Value Of,ok\n"a ""b""",1.5,true\nc,x y,\n')
    found = adapters.read(spark, {"id": "f", "type": "file", "format": "csv", "path": f"{tmp_path}/d.csv"})
    assert sorted((json.loads(r["body"]) for r in found.collect()), key=str) == [{"name": 'a "b"', "value_of": 1.5, "ok": True}, {"name": "c", "value_of": "x y", "ok": ""}]
    (tmp_path / "d.yaml").write_text("- metric: cpu\n  value: 3\n  event_id: e 1\n- plain: yes it is\n")
    got = records.to_facts(adapters.read(spark, {"id": "f", "type": "file", "format": "yaml", "path": f"{tmp_path}/d.yaml"}), "datasource:f", 7)
    have = {(r["subject"], r["relation"], r["object"], r["attrs"].get("value"), r["event"]) for r in got.collect()}
    assert ("metric.cpu", "rel.observedFrom", "datasource.f", "i:3", "e_1") in have and ("datasource.f", "rel.plain", "value.yes_it_is", None, None) in have
    body = [{"event_id": "b", "before": ["a"], "vector_clock": {"x": 2}}, {"event_id": "a", "vector_clock": {"x": 1}}, {"metrics": {"m": 1.5, "n": True}}]
    rec = adapters.records(spark, body)
    assert {tuple(r) for r in records.edges(rec).collect()} == {("a", "b")}
    facts = records.ingest(rec, "datasource:f", 9, event="tick")
    assert {(r["subject"], r["attrs"]["value"]) for r in facts.where("relation = 'rel.observedFrom'").collect()} == {("metric.m", "d:1.5"), ("metric.n", "b:true")} and facts.where("relation = 'rel.vcComponent'").count() == 2
    assert {r["event"] for r in facts.collect()} == {"a", "b", "tick"}
    lines = adapters.read(spark, {"id": "l", "type": "file", "path": f"{tmp_path}/d.csv"})
    assert lines.count() == 3 and json.loads(lines.orderBy("record_no").first()["body"]) == {"line": "Name,Value Of,ok"}


def test_cucumber(spark, tmp_path):
    report = [{"name": "Login", "uri": "u", "elements": [{"name": "Ok", "type": "scenario", "steps": [{"name": "a", "keyword": "Given ", "result": {"status": "passed", "duration": 5}}, {"name": "b", "result": {"status": "FAILED"}}, {"name": "c"}]}, {"type": "background", "steps": [{"name": "x"}]}]}]
    (tmp_path / "r.json").write_text(json.dumps(report))
    found = adapters.read(spark, {"id": "c", "type": "cucumber", "path": f"{tmp_path}/r.json"})
    rows = sorted((json.loads(r["body"]) for r in found.collect()), key=lambda r: r["step_index"])
    assert [r["status"] for r in rows] == ["passed", "failed", "unknown"] and rows[0]["duration_ns"] == 5 and rows[1]["before"] == [rows[0]["event_id"]]
    assert records.explicit_edges(found).count() == 2 and records.edges(found).count() == 3


def test_commands_and_errors(spark):
    with pytest.raises(PermissionError):
        adapters.read(spark, {"id": "x", "type": "command", "command": "echo hi"})
    run = adapters.read(spark, {"id": "x", "type": "command", "command": "echo a=1", "format": "kv", "allow_commands": True})
    assert json.loads(run.first()["body"]) == {"a": 1}
    with pytest.raises(KeyError):
        adapters.read(spark, {"id": "x", "type": "socket"})
    adapters.register("mine", lambda s, spec: adapters.records(s, [{"n": spec["n"]}]))
    assert json.loads(adapters.read(spark, {"id": "m", "type": "mine", "n": 4}).first()["body"]) == {"n": 4}


@pytest.fixture
def service():
    class Handler(http.server.BaseHTTPRequestHandler):
        count = 0

        def do_GET(self):
            Handler.count += 1
            self.send_response(500 if "bad" in self.path else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"metric": "ticks", "value": Handler.count}).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_polling(spark, tmp_path, service):
    program = parse(f'DATASOURCE feed [type=rest, format=json, poll_mode=interval, poll_interval_ms=200, url="{service}/x"].')
    spec = adapters.declared(program)[0]
    assert spec["id"] == "datasource.feed"
    stats: list = []
    running = polling.start(spark, spec, f"{tmp_path}/log", f"{tmp_path}/check", stats=stats)
    until = time.time() + 40
    while len(stats) < 2 and time.time() < until:
        time.sleep(0.2)
    running.stop()
    assert [s["revision"] for s in stats[:2]] == [1, 2] and not any("error" in s for s in stats[:2])
    now = polling.current(spark, f"{tmp_path}/log").where("relation = 'rel.observedFrom'").first()
    assert int(now["attrs"]["value"][2:]) >= 2 and polling.current(spark, f"{tmp_path}/log", 1).where("relation = 'rel.observedFrom'").first()["attrs"]["value"] == "i:1"
    with pytest.raises(OSError):
        adapters.fetch({"url": f"{service}/bad"})
    once = polling.start(spark, {**spec, "poll_mode": "event"}, f"{tmp_path}/log2", f"{tmp_path}/check2", stats=stats)
    once.awaitTermination(40)
    assert polling.current(spark, f"{tmp_path}/log2").count() > 0
    spark.dataSource.register(adapters.RecordSource)
    assert json.loads(spark.read.format("records").option("url", f"{service}/y").load().first()["body"])["metric"] == "ticks"


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.jsonl").write_text(json.dumps({"metric": "m", "value": i}) + "\n\n")
        polling.stream_records(spark, f"{tmp_path}/in", "s", f"{tmp_path}/log", f"{tmp_path}/check").awaitTermination(60)
    assert polling.read_log(spark, f"{tmp_path}/log").select("revision").distinct().count() == 2
    assert polling.current(spark, f"{tmp_path}/log").where("relation = 'rel.observedFrom'").first()["attrs"]["value"] == "i:1"


def test_exports(spark, tmp_path):
    p = parse('a:1#p@b [k="x;y", n=2].\na:1#q@c.\nRULE r:\nIF ?x#p@?y AND NOT ?y#q@?x\nTHEN ?x#s@?y.\nQUERY w:\nFIND ?x WHERE ?x#s@?y.')
    facts = T.from_atoms(spark, p.facts())
    back = exports.facts_of_lines(exports.fact_lines(facts))
    whole = lambda df: sorted([*r[:4], sorted(r[4].items())] for r in df.select(*T.KEY, "attrs").collect())
    assert whole(back) == whole(facts)
    exports.write_relations(facts, f"{tmp_path}/rel")
    assert exports.read_relations(spark, f"{tmp_path}/rel").count() == 2
    text = exports.datalog(p.rules, p.queries)
    assert "rel_s(x, y) :- rel_p(x, y), !rel_q(y, x)." in text and ".output query_w" in text
    other = exports.conformance(parse('a:1#q@c.\na:1#p@b [n=2, k="x;y"].'))
    assert exports.compare_conformance(exports.conformance(p), other) == {"left": sorted(x for x in exports.conformance(p).splitlines() if x.startswith(("rule", "query"))), "right": []}
    assert json.loads(exports.snapshot_json(facts, "m"))["facts"][0]["attrs"] == {"k": "s:x;y", "n": "i:2"}
    assert exports.render(facts.select("subject"), "csv").splitlines()[0] == "subject"
    with pytest.raises(ValueError):
        exports.render_queries({"a": facts, "b": facts}, "csv")
    (tmp_path / "f.txt").write_text("x")
    files = exports.scan_files(spark, f"{tmp_path}/f.txt")
    assert files.first()["sha256"] == hashlib.sha256(b"x").hexdigest() and exports.aggregate_hash(files).first()["files"] == 1


def test_blocks_and_events(spark, tmp_path):
    atoms = {(a.subject, a.relation, a.object) for a in blocks.facts_of('terraform {\n required_providers {\n aws = { source = "hashicorp/aws" }\n }\n}\nresource "aws_s3_bucket" "logs" { # c\n bucket = "my-logs" // d\n tags = { a = "}" }\n acl = var.acl\n}\nvariable "acl" {}', "main.tf")}
    assert ("resource.aws_s3_bucket.logs", "rel.bucket", "value.my_logs") in atoms and ("resource.aws_s3_bucket.logs", "rel.provider", "provider.aws") in atoms and ("provider.aws", "rel.source", "value.hashicorp.aws") in atoms and ("resource.aws_s3_bucket.logs", "rel.references", "variable.acl") in atoms
    event = {"operation": "link", "declaration": "A.b", "module": "A", "kind": "theorem", "trust": "certified", "kernel_present": True, "uses_sorry": False, "proved_claim": False, "type_fingerprint": "f", "dependencies": ["A.c"], "claim": "k", "attachments": [{"trust": "elaboration_validated", "relation": "uses_it", "object": {"symbol": "x"}, "subject": {"integer": "3"}}]}
    batch = {"format": "v", "module": "A", "complete": True, "event_count": 1, "events": [event]}
    (tmp_path / "b.json").write_text(json.dumps(batch))
    got = {(r["subject"], r["relation"], r["object"]) for r in declared.to_facts(declared.read(spark, f"{tmp_path}/b.json")).collect()}
    assert len(got) == 12 and ("decl.A.b", "rel.dependsOn", "decl.A.c") in got and ("claim.k", "rel.formalizedBy", "decl.A.b") in got and ("x", "rel.usesIt", "n3") in got
    for change in ({"complete": False}, {"event_count": 2}, {"events": [{**event, "proved_claim": True}]}):
        with pytest.raises(declared.BatchError):
            declared.validate(json.dumps({**batch, **change}))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("# @rel one\n# self#covers@req:1.\n# @endrel\ndef run():\n    pass\n")
    old = embedded.scan(spark, f"{tmp_path}/src").cache()
    assert old.first()["text"] == "py:run#covers@req:1." and old.first()["declaration"] == "run"
    assert embedded.drift(old, old.withColumn("text", F.lit("x"))).first()["fields"] == ["text"] and embedded.drift(old, old).count() == 0


def test_builder_library_exchange(spark, tmp_path):
    kb = Builder("access").tuple("doc:plan", "viewer", "group:eng", userset="member").fact("group:eng", "member", "user:1", since=3).declare("service", "api", criticality="high")
    kb.rule("reads", ("?u", "reads", "?d"), [("?d", "viewer", "?u")], [("?u", "suspended", "value:true")]).query("who", ["?u"], [("?u", "reads", "doc:plan")])
    kb.profile("p", viewer=("doc", "user"))
    assert kb.profiles["p"].problems([Atom("x", "rel.viewer", "y")], {"y": "group"}) and not kb.profiles["p"].problems([Atom("x", "rel.viewer", "y")], {})
    with pytest.raises(ValueError):
        kb.rule("bad", ("?u", "suspended", "?d"), [("?u", "reads", "?d")])
    p = kb.program()
    facts = T.from_atoms(spark, p.facts())
    library.save(spark, f"{tmp_path}/lib", facts, p.all_rules(), "m1")
    library.save(spark, f"{tmp_path}/lib", facts, p.all_rules(), "m2")
    closed = library.closure_of(spark, f"{tmp_path}/lib", ["m1", "m2"])
    assert {r["subject"] for r in closed.relation("rel.reads").collect()} == {"user.u1", "group.eng"} and len(closed.rules) == 2
    source = "a#depends_on@b.\nb#uses@c.\nRULE r:\nIF ?x#depends_on@?y\nTHEN ?y#supports@?x.\nQUERY q:\nFIND ?x WHERE ?x#depends_on@?y."
    ask = lambda op, *args, **more: exchange.handle(spark, {"schema": exchange.SCHEMA, "request_id": "1", "operation": op, "source": source, "arguments": list(args), "capabilities": [f"{op}-v1"], **more})
    assert ask("parse")["result"]["rules"] == 1 and ask("query", "q")["result"] == [{"x": "a"}] and ask("impact", "c")["result"]["impacts"][0]["node"] == "b"
    assert ask("authorize", "b", "supports", "a")["result"]["source"] == "derived" and ask("compile", "x")["result"]["closed"] == 3 and ask("conformance")["status"] == "ok" and ask("expand")["result"] == []
    assert ask("query")["status"] == "invalid" and ask("query", "zz")["status"] == "rejected" and ask("parse", source="x")["status"] == "rejected" and ask("parse", capabilities=[])["status"] == "invalid"


def test_recovery_from_facts(spark):
    p = parse('req:1#token_state@state:consumed [rollback_kind="rollback", rollback_reference="r"].\nreq:1#requires_postcondition@post:a.\nreq:1#postcondition_event@post:a [passed=false, evidence="e"].\nreq:1#recovery_event@run:1 [kind="rollback", reference="r", completed=true, evidence="e"].')
    assert actions.recovery_of_facts(T.from_atoms(spark, p.facts()), "req.n1")["outcome"] == "recovered"


def test_packs_and_plans(spark):
    p = parse("a#p@b.\nQUERY found:\nFIND ?x WHERE ?x#p@?y.\nQUERY none:\nFIND ?x WHERE ?x#q@?y.\nQUERY_PACK base [queries=[found, none, gone], must_return=[found, none]].\nDSL_PROFILE main [query_pack=base, planner_hint=as_is].")
    facts = T.from_atoms(spark, p.facts())
    assert [(r["query"], r["status"], r["rows"]) for r in governance.check_packs(p, facts, "main")] == [("found", "pass", 1), ("none", "fail", 0), ("gone", "missing_query", 0)]
    assert governance.plan_queries(p, facts)[0]["hint"] == "as_is" and len(governance.plan_queries(p, facts)) == 2
    with pytest.raises(KeyError):
        governance.check_packs(p, facts, "nope")
    assert Closure(facts, []).all().count() == sum(r["facts"] for r in library.statistics(facts).collect()) == 10


def test_preflight_and_leases(spark):
    ask = spark.createDataFrame([("1", "a", "m", "r1", "s", "l1", "k1", 5, True, "rollback", "x"), ("2", "b", "m", "r0", "s", "l9", "k9", 5, None, "none", None)], "request_id string, agent_id string, module string, base_revision string, scope string, lease_id string, checkpoint_id string, now bigint, preconditions_pass boolean, rollback_kind string, rollback_reference string")
    leases = spark.createDataFrame([("l1", "a", "m", "s", "r1", 9, True)], "lease_id string, agent_id string, module string, scope string, base_revision string, expires_at bigint, active boolean")
    got = {r["request_id"]: r["failures"] for r in actions.preflight(ask, spark.createDataFrame([("a", "s")], "agent_id string, scope string"), leases, spark.createDataFrame([("k1", "m", "r1")], "checkpoint_id string, module string, revision string"), spark.createDataFrame([("m", "r1", True)], "module string, revision string, store_integrity boolean")).collect()}
    assert got == {"1": [], "2": ["context-stale", "unauthorized-scope", "missing-lease", "missing-current-checkpoint", "precondition-failed", "missing-rollback"]}
    more = {"lease_id": "l2", "agent_id": "a", "module": "m", "scope": "s", "base_revision": "r1", "ttl_seconds": 5}
    assert actions.grant_lease(leases, {**more, "now": 9}).count() == 2
    with pytest.raises(ValueError):
        actions.grant_lease(leases, {**more, "now": 8})


def test_rule_libraries(spark):
    from stratalog import rules
    from stratalog.operators.query import answer

    assert rules.names() == ["access", "breakage", "history"]
    p = parse("USE role(user:1, role:dev).\nUSE inherit(role:dev, role:base).\nUSE permit(role:base, read).\nUSE role(user:2, role:base).\nUSE suspend(user:2).\nUSE request(user:2, read).\nUSE request(user:1, read).", rules.library("access"))
    facts = T.from_atoms(spark, p.facts())
    assert [tuple(r) for r in answer(p, facts, "refusals").collect()] == [("user.u2", "read")] and [tuple(r) for r in answer(p, facts, "permissions").collect()] == [("user.u1", "read")]
    p = parse("USE rests_on(a, b).\nUSE rests_on(b, c).\nUSE rests_on(d, c).\nUSE broken(c).\nUSE backup(d, e).\nUSE version(t, v1).\nUSE version(t, v2).\nUSE replaced(v1, v2).", rules.library("breakage", "history"))
    facts = T.from_atoms(spark, p.facts())
    assert {tuple(r) for r in answer(p, facts, "affected").collect()} == {("a", "c"), ("b", "c")} and [tuple(r) for r in answer(p, facts, "current").collect()] == [("t", "v2")]


def test_plugins_bundles_attestations(spark):
    from stratalog.plugins import Extension, Registry

    r = Registry()
    assert r.add(Extension("a", "1", ("source",), lambda: {"source": 1})) and not r.add(Extension("a", "2", ("source",), lambda: {"source": 1}))
    assert not r.add(Extension("b", "1", ("magic",), dict)) and not r.add(Extension("c", "1", ("codec",), lambda: 1 / 0)) and r.of("source") == {"a": 1} and set(r.set_aside) == {"a", "b", "c"}
    lts = "LTS_ATOM d [states=#{a}, initial=a, transitions={[a x] [a]}]."
    got = {b["file"]: (b["ok"], b["profile"]) for b in governance.check_bundle({"x": lts, "y": "a#b@c.", "z": "bad"})}
    assert got == {"x": (True, "lts"), "y": (False, None), "z": (False, None)}
    frame = lambda rows: spark.createDataFrame(rows, "path string, sha256 string")
    assert {tuple(x) for x in governance.attest(frame([("a", "1"), ("b", "2"), ("c", "3")]), frame([("a", "1"), ("b", "9"), ("d", "4")])).collect()} == {("a", "ok"), ("b", "changed"), ("c", "missing"), ("d", "unlisted")}


def test_envelope(spark):
    from stratalog.sources import envelope

    rows = [("a\tb", "rel.x", "c\n;=d\\", {"k;=": "s:v\t1"}, 1, "e1", "assert"), ("a", "rel.x", "b", {}, 2, "e\t2", "retract")]
    log = spark.createDataFrame([(s, r, o, a, "", n, e, op) for s, r, o, a, n, e, op in rows], "subject string, relation string, object string, attrs map<string,string>, attrs_key string, revision bigint, event string, op string")
    log = log.withColumn("attrs_key", T.key_of(F.col("attrs")))
    edges = spark.createDataFrame([("e1", "e\t2")], "left string, right string")
    lines = envelope.lines_of(log, edges, "m").select("line")
    found, back = envelope.read(lines)
    key = lambda f: sorted((r["subject"], r["object"], str(r["attrs"]), r["revision"], r["event"], r["op"]) for r in f.collect())
    assert key(found) == key(log) and [tuple(r) for r in back.collect()] == [("e1", "e\t2")]
    for bad in ("record\tx\te\tassert\ta\tb\tc\t", "record\t1\te\tset\ta\tb\tc\t", "other\t1", "before\ta"):
        with pytest.raises(ValueError):
            envelope.read(lines.unionByName(spark.createDataFrame([(bad,)], "line string")))
    with pytest.raises(ValueError):
        envelope.read(lines.where("line not like 'revisions%'"))
    with pytest.raises(ValueError):
        envelope.read(lines.unionByName(lines))
