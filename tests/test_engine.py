import random

import pytest
from naive import closure as naive_closure
from naive import rows
from naive import solve as naive_solve

from stratalog.functions import facts as T
from stratalog.language.ast import Atom
from stratalog.language.program import parse
from stratalog.operators import authorization, impact, provenance
from stratalog.operators.fixpoint import Closure, RoundLimit, as_doubling, closure, closure_or_input, entails
from stratalog.operators.query import solve
from stratalog.plans.analysis import components

ACCESS = """
doc:plan#viewer@user:10.
doc:plan#viewer@user:11.
user:11#suspended@status:true.
doc:plan#viewer@group:eng#member.
group:eng#member@user:12 [since=2020].
group:eng#member@group:ops#member.
group:ops#member@user:13.
RULE active:
IF ?d#viewer@?u AND NOT ?u#suspended@status:true
THEN ?d#active@?u [by=?d].
QUERY who:
FIND ?u WHERE doc:plan#active@?u [by=?x].
QUERY dated:
FIND ?u WHERE ?g#member@?u [since=2020].
"""


def as_tuples(atoms):
    return {(a.subject, a.relation, a.object, tuple(sorted(a.attrs))) for a in atoms}


def test_program_against_naive(spark):
    p = parse(ACCESS)
    facts = T.from_atoms(spark, p.facts())
    closed = Closure(facts, p.all_rules())
    want = naive_closure(as_tuples(p.facts()), p.all_rules())
    assert rows(closed.all()) == want
    for q in p.queries:
        assert {tuple(r) for r in solve(closed, q).collect()} == naive_solve(want, q)


@pytest.mark.parametrize("seed", range(4))
def test_random_programs(spark, seed):
    rnd = random.Random(seed)
    nodes, base = [f"n{i}" for i in range(6)], ["e", "f"]
    lines = [f"{rnd.choice(nodes)}#{rnd.choice(base)}@{rnd.choice(nodes)}." for _ in range(14)]
    layers = [["p", "q"], ["r"], ["s"]]
    known = list(base)
    for layer in layers:
        for h in layer * 2:
            own = known + layer
            a, b = rnd.choice(own), rnd.choice(own)
            neg = f" AND NOT ?x#{rnd.choice(known)}@?z" if rnd.random() < 0.5 else ""
            lines.append(f"RULE k{len(lines)}:\nIF ?x#{a}@?y AND ?y#{b}@?z{neg}\nTHEN ?x#{h}@?z.")
        known += layer
    p = parse("\n".join(lines))
    facts = T.from_atoms(spark, p.facts())
    assert rows(closure(facts, p.all_rules())) == naive_closure(as_tuples(p.facts()), p.all_rules())


CHAIN = "RULE a:\nIF ?x#e@?y\nTHEN ?x#t@?y.\nRULE b:\nIF ?x#e@?y AND ?y#t@?z\nTHEN ?x#t@?z."


def test_doubling_and_limits(spark):
    p = parse(CHAIN)
    facts = T.from_atoms(spark, [Atom(f"n{i}", "rel.e", f"n{i + 1}") for i in range(12)])
    assert as_doubling(components(p.rules)[0]) != p.rules
    fast, slow = Closure(facts, p.rules), Closure(facts, p.rules, doubling=False)
    assert rows(fast.all()) == rows(slow.all()) and len(rows(fast.relation("rel.t"))) == 78
    assert sum(fast.rounds.values()) < sum(slow.rounds.values())
    with pytest.raises(RoundLimit):
        Closure(facts, p.rules, max_rounds=2, doubling=False)
    assert len(rows(Closure(facts, p.rules, max_rounds=2, truncate=True, doubling=False).relation("rel.t"))) == 12 + 11 + 10
    assert entails(facts, p.rules, Atom("n0", "rel.t", "n12")) and not entails(facts, p.rules, Atom("n12", "rel.t", "n0"))


def test_cycles_terminate_and_empty(spark):
    p = parse(CHAIN)
    facts = T.from_atoms(spark, [Atom("a", "rel.e", "b"), Atom("b", "rel.e", "a"), Atom("a", "rel.e", "b")])
    assert len(rows(Closure(facts, p.rules).relation("rel.t"))) == 4
    assert rows(closure(T.empty(spark), p.rules)) == set()
    bad = parse(CHAIN).rules + [r for r in parse("RULE n:\nIF ?x#u@?y AND NOT ?x#v@?y\nTHEN ?x#w@?y.").rules]
    from dataclasses import replace

    loop = [replace(bad[-1], head=Atom("?x", "rel.v", "?y"))]
    assert rows(closure_or_input(facts, loop)) == rows(facts)


def test_bag_and_products(spark):
    p = parse("a#p@b.\na#p@c.\nd#q@e.\nd#q@f.\nQUERY q:\nFIND ?x WHERE ?x#p@?y AND ?z#q@?w.\nQUERY n:\nFIND ?x WHERE ?x#p@?y AND NOT d#q@e.\nQUERY m:\nFIND ?x WHERE ?x#p@?y AND NOT d#q@zzz.")
    closed = Closure(T.from_atoms(spark, p.facts()), [])
    assert solve(closed, p.query("q"), distinct=False).count() == 4 and solve(closed, p.query("q")).count() == 1
    assert solve(closed, p.query("n")).count() == 0 and solve(closed, p.query("m")).count() == 1


def test_attribute_values(spark):
    p = parse('a#p@b [k=1, t="x;y=z", o=team:1].\nQUERY n:\nFIND ?v WHERE ?x#p@?y [o=?v].\nQUERY i:\nFIND ?v WHERE ?x#p@?y [k=?v].\nQUERY t:\nFIND ?x WHERE ?x#p@?y [t="x;y=z", k=1].\nQUERY u:\nFIND ?x WHERE ?x#p@?y [k=2].')
    facts = T.from_atoms(spark, p.facts())
    closed, loose = Closure(facts, []), Closure(facts, [], any_value=True)
    one = lambda c, n: [tuple(r) for r in solve(c, p.query(n)).collect()]
    assert one(closed, "n") == [("team.n1",)] and one(closed, "i") == [] and one(loose, "i") == [("i:1",)] and one(closed, "t") == [("a",)] and one(closed, "u") == []
    assert facts.select(T.key_of(facts.attrs).alias("k"), "attrs_key").where("k <> attrs_key").count() == 0


PROVENANCE = """
doc:readme#viewer@group:eng#member.
group:eng#member@user:1.
service:db#state@value:down.
a#parent@b.
b#parent@c.
c#parent@d.
RULE degraded:
IF ?s#state@value:down AND NOT service:cache#available@value:true
THEN ?s#degraded@value:true.
RULE base:
IF ?x#parent@?y
THEN ?x#ancestor@?y.
RULE step:
IF ?x#parent@?y AND ?y#ancestor@?z
THEN ?x#ancestor@?z.
QUERY up:
FIND ?z WHERE a#ancestor@?z.
"""


def test_provenance(spark):
    p = parse(PROVENANCE)
    facts = T.from_atoms(spark, p.facts())
    first = provenance.trace(facts, p.all_rules())
    again = provenance.trace(facts, p.all_rules())
    got = {(r["id"], r["subject"], r["relation"], r["object"]): r for r in first.collect()}
    assert got.keys() == {(r["id"], r["subject"], r["relation"], r["object"]) for r in again.collect()}
    assert sorted(k[0] for k in got) == list(range(len(got)))
    by = {k[1:]: r for k, r in got.items()}
    assert len(by["doc.readme", "rel.viewer", "user.u1"]["premise_ids"]) == 2
    down = by["service.db", "rel.degraded", "value.true"]
    assert len(down["premise_ids"]) == 1 and down["negative_checks"] == ["service.cache#rel.available@value.true"] and down["stratum"] == 1
    assert {r["z"] for r in provenance.query_witnesses(first, p.query("up")).collect()} == {"b", "c", "d"}
    target = Atom("a", "rel.ancestor", "d")
    assert provenance.explain_fact(first, target).first()["source"] == "rule"
    assert provenance.explain_fact(first, Atom("a", "rel.parent", "b")).first()["source"] == "base" and not provenance.explain_fact(first, Atom("d", "rel.parent", "a")).first()["present"]
    ids = first.where("subject = 'a' and relation = 'rel.ancestor' and object = 'd'").select("id")
    assert provenance.support(first, ids).count() == 5
    assert provenance.report(first).count() == len(got)


def test_authorization(spark):
    p = parse("doc:a#viewer@group:g#member.\ngroup:g#member@user:1.\ndoc:a#owner@user:2.\nRULE own:\nIF ?d#owner@?u\nTHEN ?d#viewer@?u.")
    facts = T.from_atoms(spark, p.facts())
    ask = lambda u, r="rel.viewer": authorization.decide_one(facts, p.all_rules(), Atom("doc.a", r, u))
    assert ask("user.u1")["source"] == "derived" and ask("user.u2")["candidate_rules"][0] == "own"
    assert ask("user.u2", "rel.owner")["source"] == "direct" and ask("user.u3")["decision"] == "deny"
    assert ask("user.u1")["base_facts"] == 3 and ask("user.u1")["closed_facts"] == 5


def test_impact(spark):
    p = parse("app.cli#uses@lean.normalize.\nlean.normalize#depends_on@lean.parse.\nProof.sound#validates@lean.normalize.\na#requires@b.\nb#requires@a.\nx#likes@y.")
    edges = impact.graph(T.from_atoms(spark, p.facts()))
    found = impact.impact(edges, ["lean.parse"]).orderBy("rank").collect()
    assert [(r["node"], r["distance"], r["kind"]) for r in found] == [("lean.normalize", 1, "direct"), ("Proof.sound", 2, "transitive"), ("app.cli", 2, "transitive")]
    assert {r["node"] for r in impact.cyclic_nodes(edges).collect()} == {"a", "b"}
    assert impact.impact(edges, ["nobody"]).count() == 0 and not impact.known(edges, "nobody") and impact.known(edges, "a")
    assert impact.outgoing(edges, "a").count() == 1 and impact.reverse(edges, "a").count() == 1
