"""The language: scans, joins, negation, rules, recursion, usersets, provenance, authorization."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts as T
from ..language.names import relation_name as rel
from ..language.program import parse
from ..operators import authorization, provenance
from ..operators.fixpoint import Closure
from ..operators.query import ad_hoc, answer, solve
from . import data

QUERIES: dict = {}
SQL: dict[str, str] = {}

IN_REGION = "select 'nation.n' || n_nationkey as s, 'region.n' || n_regionkey as o from nation"
IN_NATION = "select 'customer.n' || c_custkey as s, 'nation.n' || c_nationkey as o from customer union all select 'supplier.n' || s_suppkey, 'nation.n' || s_nationkey from supplier"
PLACED_BY = "select 'order.n' || o_orderkey as s, 'customer.n' || o_custkey as o from orders"
STATUS = "select 'order.n' || o_orderkey as s, 'value.' || o_orderstatus as o from orders"
CONTAINS = "select distinct 'order.n' || l_orderkey as s, 'part.n' || l_partkey as o, l_returnflag as flag, l_linenumber as line, 'supplier.n' || l_suppkey as sup from lineitem"
FOLLOWS = "select 'turn.n' || a.conv_id || '.n' || a.turn as s, 'turn.n' || a.conv_id || '.n' || (a.turn + 1) as o from (select distinct conv_id, turn from conversations) a join (select distinct conv_id, turn from conversations) b on a.conv_id = b.conv_id and b.turn = a.turn + 1"
BASE = f"with recursive in_region as ({IN_REGION}), in_nation as ({IN_NATION}), placed_by as ({PLACED_BY}), status as ({STATUS}), contains as ({CONTAINS}), follows as ({FOLLOWS})"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql if sql.lstrip().lower().startswith("with") else f"{BASE} {sql}"
        return f

    return add


def ask(name: str, program: str, sql: str, facts=data.everything, **options) -> None:
    """Registers a program with one query q over some facts."""
    parsed = parse(program)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return answer(parsed, facts(spark, sf_dir), "q", **options)

    query(name, sql)(run)


@query("scan_nation_facts", "select s as subject, o as object from in_region")
def scan_nation_facts(spark, sf_dir):
    return data.places(spark, sf_dir).where(F.col("relation") == rel("in_region")).select("subject", "object")


ask("const_match", "QUERY q:\nFIND ?n WHERE ?n#in_region@region:2.", "select s as n from in_region where o = 'region.n2'")
ask("two_hop_join", "QUERY q:\nFIND ?c WHERE ?c#in_nation@?n AND ?n#in_region@region:2.", "select distinct a.s as c from in_nation a join in_region b on a.o = b.s where b.o = 'region.n2'")
ask(
    "three_hop_join", "QUERY q:\nFIND ?o ?r WHERE ?o#placed_by@?c AND ?c#in_nation@?n AND ?n#in_region@?r.",
    "select distinct p.s as o, r.o as r from placed_by p join in_nation n on p.o = n.s join in_region r on n.o = r.s",
)


@query("repeated_var_atom", "select distinct 'supplier.n' || l_suppkey as s from lineitem where l_suppkey = l_partkey")
def repeated_var_atom(spark, sf_dir):
    i = data.table(spark, sf_dir, "lineitem")
    peers = T.relationalise(i, T.node("supplier", F.col("l_suppkey")), rel("peer"), T.node("supplier", F.col("l_partkey")))
    return answer(parse("QUERY q:\nFIND ?s WHERE ?s#peer@?s."), peers, "q")


ask("attr_subset_match", 'QUERY q:\nFIND ?o ?p WHERE ?o#contains@?p [returnflag="R"].', "select distinct s as o, o as p from contains where flag = 'R'")
ask("attr_integer_match", "QUERY q:\nFIND ?o ?p WHERE ?o#contains@?p [linenumber=1, returnflag=\"A\"].", "select distinct s as o, o as p from contains where flag = 'A' and line = 1")
ask(
    "attr_var_join", "QUERY q:\nFIND ?o ?s WHERE ?o#contains@?p [supplier=?s] AND ?s#in_nation@nation:3.",
    "select distinct c.s as o, c.sup as s from contains c join in_nation n on c.sup = n.s where n.o = 'nation.n3'",
)
ask("attr_var_binds_names_only", "QUERY q:\nFIND ?o ?x WHERE ?o#contains@?p [returnflag=?x].", "select s as o, o as x from contains where false")
ask("attr_var_any_value", "QUERY q:\nFIND ?x WHERE ?o#contains@?p [returnflag=?x].", "select distinct 's:' || flag as x from contains", any_value=True)

HAS_ORDER = "RULE buyer:\nIF ?o#placed_by@?c\nTHEN ?c#has_order@value:true.\n"
ask(
    "not_exists_orders", HAS_ORDER + "QUERY q:\nFIND ?c ?n WHERE ?c#in_nation@?n AND NOT ?c#has_order@value:true.",
    "select s as c, o as n from in_nation a where not exists (select 1 from placed_by p where p.o = a.s)",
)
ask(
    "variables_by_case", "QUERY q:\nFIND ?x ?X ?x.y ?x_y WHERE ?x#in_nation@?X AND ?X#in_region@?x.y AND ?x_y#in_region@?x.y.",
    'select distinct n.s as x, n.o as "X_2", r.o as x_y, p.s as x_y_2 from in_nation n join in_region r on n.o = r.s join in_region p on p.o = r.o',
)
ask("ground_not", "QUERY q:\nFIND ?n WHERE ?n#in_region@region:1 AND NOT region:9#closed@value:true.", "select s as n from in_region where o = 'region.n1'")
ask("ground_not_blocks", "QUERY q:\nFIND ?n WHERE ?n#in_region@region:1 AND NOT nation:1#in_region@region:1.", "select s as n from in_region where o = 'region.n1' and not exists (select 1 from in_region where s = 'nation.n1' and o = 'region.n1')")
ask(
    "neg_with_attr", 'QUERY q:\nFIND ?o ?p WHERE ?o#contains@?p [returnflag="N"] AND NOT ?o#contains@?p [returnflag="R"].',
    "select distinct s as o, o as p from contains a where flag = 'N' and not exists (select 1 from contains b where b.s = a.s and b.o = a.o and b.flag = 'R')",
)
ask(
    "multi_head_rule", "RULE both:\nIF ?o#placed_by@?c AND ?c#in_nation@?n\nTHEN ?n#sells@?o and ?o#origin@?n.\nQUERY q:\nFIND ?n ?o WHERE ?n#sells@?o AND ?o#origin@?n.",
    "select distinct n.o as n, p.s as o from placed_by p join in_nation n on p.o = n.s",
)
ask(
    "union_rules", "RULE a:\nIF ?x#in_nation@?y\nTHEN ?x#located@?y.\nRULE b:\nIF ?x#in_region@?y\nTHEN ?x#located@?y.\nQUERY q:\nFIND ?x ?y WHERE ?x#located@?y.",
    "select s as x, o as y from in_nation union select s, o from in_region",
)
ask(
    "strata_chain",
    HAS_ORDER + "RULE idle:\nIF ?c#in_nation@?n AND NOT ?c#has_order@value:true\nTHEN ?n#idle@?c.\nRULE busy:\nIF ?n#in_region@?r AND NOT ?n#all_busy@value:false\nTHEN ?n#quiet@?r.\nRULE any:\nIF ?n#idle@?c\nTHEN ?n#all_busy@value:false.\nQUERY q:\nFIND ?n ?c WHERE ?n#idle@?c AND NOT ?n#quiet@region:0.",
    "select distinct a.o as n, a.s as c from in_nation a where not exists (select 1 from placed_by p where p.o = a.s)",
)

LOCATED = "RULE direct:\nIF ?x#in_nation@?y\nTHEN ?x#located_in@?y.\nRULE region:\nIF ?x#in_region@?y\nTHEN ?x#located_in@?y.\nRULE far:\nIF ?x#located_in@?y AND ?y#located_in@?z\nTHEN ?x#located_in@?z.\n"
LOCATED_SQL = ", located as (select s, o from in_nation union select s, o from in_region union select l.s, r.o from located l join in_region r on l.o = r.s)"
ask("located_in_closure", LOCATED + "QUERY q:\nFIND ?x ?y WHERE ?x#located_in@?y.", f"{BASE}{LOCATED_SQL} select s as x, o as y from located", facts=data.places)
BEFORE = "RULE step:\nIF ?x#follows@?y\nTHEN ?x#before@?y.\nRULE far:\nIF ?x#follows@?y AND ?y#before@?z\nTHEN ?x#before@?z.\n"
BEFORE_SQL = ", before as (select s, o from follows union select b.s, f.o from before b join follows f on b.o = f.s)"
ask("turn_before_closure", BEFORE + "QUERY q:\nFIND ?x ?y WHERE ?x#before@?y.", f"{BASE}{BEFORE_SQL} select s as x, o as y from before", facts=data.turns)
ask("turn_before_linear", BEFORE + "QUERY q:\nFIND ?x ?y WHERE ?x#before@?y.", f"{BASE}{BEFORE_SQL} select s as x, o as y from before", facts=data.turns, doubling=False)
ask(
    "mutual_recursion", "RULE one:\nIF ?x#follows@?y\nTHEN ?x#odd@?y.\nRULE even:\nIF ?x#odd@?y AND ?y#follows@?z\nTHEN ?x#even@?z.\nRULE odd:\nIF ?x#even@?y AND ?y#follows@?z\nTHEN ?x#odd@?z.\nQUERY q:\nFIND ?x ?y WHERE ?x#even@?y.",
    f"{BASE}, walk as (select s, o, 1 as parity from follows union select w.s, f.o, 1 - parity from walk w join follows f on w.o = f.s) select distinct s as x, o as y from walk where parity = 0", facts=data.turns,
)
ask(
    "unreachable_after_closure", LOCATED + "QUERY q:\nFIND ?x WHERE ?x#in_nation@?n AND NOT ?x#located_in@region:1.",
    "select a.s as x from in_nation a join in_region r on a.o = r.s group by a.s having bool_and(r.o <> 'region.n1')", facts=data.places,
)


def _groups(spark, sf_dir):
    """Customers are members of their nation's group; usersets are in the program."""
    c = data.table(spark, sf_dir, "customer")
    return T.relationalise(c, T.node("group", F.col("c_nationkey")), rel("member"), T.node("customer", F.col("c_custkey")))


ask_userset = "doc:readme#viewer@group:1#member.\ndoc:plan#viewer@group:2#member.\nQUERY q:\nFIND ?d ?u WHERE ?d#viewer@?u.\n"
NESTED = "doc:readme#viewer@group:eng#member.\ngroup:eng#member@group:3#member.\nQUERY q:\nFIND ?u WHERE doc:readme#viewer@?u.\n"


def _with_own(spark, sf_dir, program):
    return T.from_atoms(spark, program.facts()).unionByName(_groups(spark, sf_dir))


@query(
    "userset_members", "select 'doc.readme' as d, 'customer.n' || c_custkey as u from customer where c_nationkey = 1 union select 'doc.plan', 'customer.n' || c_custkey from customer where c_nationkey = 2 union select 'doc.readme', 'group.n1' union select 'doc.plan', 'group.n2'",
)
def userset_members(spark, sf_dir):
    p = parse(ask_userset)
    return answer(p, _with_own(spark, sf_dir, p), "q")


@query("nested_userset", "select 'customer.n' || c_custkey as u from customer where c_nationkey = 3 union select 'group.eng' union select 'group.n3'")
def nested_userset(spark, sf_dir):
    p = parse(NESTED)
    return answer(p, _with_own(spark, sf_dir, p), "q")


BAG = parse("QUERY q:\nFIND ?n WHERE ?c#in_nation@?n AND ?o#placed_by@?c.")


@query("query_bag_counts", "select n.o as n, count(*)::bigint as bindings from placed_by p join in_nation n on p.o = n.s group by 1")
def query_bag_counts(spark, sf_dir):
    return answer(BAG, data.everything(spark, sf_dir), "q", distinct=False).groupBy("n").agg(F.count("*").alias("bindings"))


@query("query_distinct_sorted", "select distinct n.o as n from placed_by p join in_nation n on p.o = n.s order by 1")
def query_distinct_sorted(spark, sf_dir):
    return answer(BAG, data.everything(spark, sf_dir), "q", ordered=True)


# ---- provenance: nations and regions, numbered by text

ORIGIN = parse("RULE near:\nIF ?x#in_region@?r AND ?y#in_region@?r\nTHEN ?x#near@?y.\nRULE hub:\nIF ?x#near@nation:0 AND NOT ?x#in_region@region:1\nTHEN ?x#hub@value:true.\nQUERY q:\nFIND ?x WHERE ?x#near@nation:3 AND ?x#in_region@?r.")
IDS = ", base as (select s, o, row_number() over (order by s, o) - 1 as id from in_region)"


def _regions(spark, sf_dir):
    return data.places(spark, sf_dir).where(F.col("relation") == rel("in_region"))


@query(
    "first_origin",
    f"{BASE}{IDS} select a.s as subject, b.s as object, a.id::bigint as first_premise, b.id::bigint as second_premise, (25 + row_number() over (order by a.id, b.id) - 1)::bigint as id from base a join base b on a.o = b.o",
)
def first_origin(spark, sf_dir):
    found = provenance.trace(_regions(spark, sf_dir), ORIGIN.rules[:1])
    return found.where("rule = 'near'").select("subject", "object", F.get("premise_ids", F.lit(0)).alias("first_premise"), F.get("premise_ids", F.lit(1)).alias("second_premise"), "id")


@query(
    "query_witnesses",
    f"{BASE}{IDS}, near as (select a.s, b.s as o, 25 + row_number() over (order by a.id, b.id) - 1 as id from base a join base b on a.o = b.o) select n.s as x, (n.id || ',' || b.id) as premises from near n join base b on b.s = n.s where n.o = 'nation.n3'",
)
def query_witnesses(spark, sf_dir):
    found = provenance.trace(_regions(spark, sf_dir), ORIGIN.rules)
    return provenance.query_witnesses(found, ORIGIN.query("q")).select("x", F.concat_ws(",", "premise_ids").alias("premises"))


@query(
    "explain_fact",
    "select a.s as subject, b.s as object, (c.o is not null) as present, case when c.o is null then 'none' else 'rule' end as source from in_region a cross join (select s from in_region where s in ('nation.n0', 'nation.n1')) b left join (select x.s, y.s as o from in_region x join in_region y on x.o = y.o) c on c.s = a.s and c.o = b.s",
)
def explain_fact(spark, sf_dir):
    facts = _regions(spark, sf_dir)
    found = provenance.trace(facts, ORIGIN.rules)
    targets = facts.crossJoin(spark.createDataFrame([("nation.n0",), ("nation.n1",)], "o string")).select("subject", F.lit(rel("near")).alias("relation"), F.col("o").alias("object"), F.lit("").alias("attrs_key"))
    return provenance.explain(found, targets).select("subject", "object", "present", "source")


# ---- authorization

ACCESS = parse("RULE own:\nIF ?o#placed_by@?c\nTHEN ?o#viewer@?c.\nRULE country:\nIF ?o#placed_by@?c AND ?c#in_nation@?n AND NOT ?o#status@value:P\nTHEN ?o#viewer@?n.")


@query(
    "authorize_batch",
    """select subject, object, case when source = 'none' then 'deny' else 'allow' end as decision, source from (
        select 'order.n' || o_orderkey as subject, 'customer.n' || o_custkey as object, 'derived' as source from orders
        union all select 'order.n' || o_orderkey, 'nation.n' || (o_orderkey % 25),
            case when o_orderstatus <> 'P' and exists (select 1 from customer where c_custkey = o_custkey and c_nationkey = o_orderkey % 25) then 'derived' else 'none' end from orders)""",
)
def authorize_batch(spark, sf_dir):
    o = data.table(spark, sf_dir, "orders")
    ask_one = lambda who: o.select(T.node("order", F.col("o_orderkey")).alias("subject"), F.lit(rel("viewer")).alias("relation"), who.alias("object"), F.lit("").alias("attrs_key"))
    requests = ask_one(T.node("customer", F.col("o_custkey"))).unionByName(ask_one(T.node("nation", F.col("o_orderkey") % 25)))
    facts = data.places(spark, sf_dir).unionByName(data.orders(spark, sf_dir))
    return authorization.decide(facts, ACCESS.rules, requests, {rel("viewer")}).select("subject", "object", "decision", "source")


RBAC = parse("""
RULE granted:
IF ?u#has_role@?r AND ?r#grants@?p
THEN ?u#allowed@?p.
RULE blocked:
IF ?u#status@value:suspended
THEN ?u#blocked@value:true.
RULE final:
IF ?u#allowed@?p AND NOT ?u#blocked@value:true
THEN ?u#may@?p.
RULE denied:
IF ?u#wants@?p AND NOT ?u#may@?p
THEN ?u#denied@?p.
QUERY q:
FIND ?u ?p WHERE ?u#denied@?p.
""")


@query(
    "rbac_decisions",
    """with role as (select c_custkey as k, c_mktsegment as r, c_acctbal < 0 as suspended from customer),
        want as (select distinct o_custkey as k, o_orderpriority as p from orders)
    select 'customer.n' || w.k as u, 'perm.' || substr(w.p, 1, 1) || 'x' as p from want w left join role on role.k = w.k
    where not coalesce(not role.suspended and (ascii(role.r) + ascii(w.p)) % 2 = 0, false)""",
)
def rbac_decisions(spark, sf_dir):
    c, o = data.table(spark, sf_dir, "customer"), data.table(spark, sf_dir, "orders")
    user = T.node("customer", F.col("c_custkey"))
    permission = lambda col: F.concat(F.lit("perm."), F.substring(col, 1, 1), F.lit("x"))
    role = lambda col: F.concat(F.lit("role."), col)
    grants = c.select("c_mktsegment").distinct().crossJoin(o.select("o_orderpriority").distinct()).where("(ascii(c_mktsegment) + ascii(o_orderpriority)) % 2 = 0")
    facts = T.union([
        T.relationalise(c, user, rel("has_role"), role(F.col("c_mktsegment"))), T.relationalise(c.where("c_acctbal < 0"), user, rel("status"), F.lit("value.suspended")),
        T.relationalise(grants, role(F.col("c_mktsegment")), rel("grants"), permission(F.col("o_orderpriority"))), T.relationalise(o.select("o_custkey", "o_orderpriority").distinct(), T.node("customer", F.col("o_custkey")), rel("wants"), permission(F.col("o_orderpriority"))),
    ])
    return answer(RBAC, facts, "q")


SUPERSEDE = parse("RULE one:\nIF ?a#superseded_by@?b\nTHEN ?a#older_than@?b.\nRULE more:\nIF ?a#superseded_by@?b AND ?b#older_than@?c\nTHEN ?a#older_than@?c.\nRULE old:\nIF ?a#superseded_by@?b\nTHEN ?a#stale@value:true.\nQUERY q:\nFIND ?a ?c WHERE ?a#older_than@?c AND NOT ?c#stale@value:true.")


@query(
    "bitemporal_supersession",
    "with o as (select o_custkey, o_orderkey, last_value(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as latest from orders) select 'order.n' || o_orderkey as a, 'order.n' || latest as c from o where o_orderkey <> latest",
)
def bitemporal_supersession(spark, sf_dir):
    from pyspark.sql import Window

    o = data.table(spark, sf_dir, "orders").withColumn("next", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    facts = T.relationalise(o, T.node("order", F.col("o_orderkey")), rel("superseded_by"), T.node("order", F.col("next")))
    return answer(SUPERSEDE, facts, "q")


ELIGIBLE = parse("RULE candidate:\nIF ?s#in_nation@?n AND ?n#in_region@?r\nTHEN ?s#serves@?r.\nRULE rejected:\nIF ?s#balance@value:negative\nTHEN ?s#rejected@value:true.\nRULE ok:\nIF ?s#serves@?r AND NOT ?s#rejected@value:true\nTHEN ?s#eligible@?r.\nQUERY q:\nFIND ?s ?r WHERE ?s#eligible@?r.")


@query("provider_eligibility", "select 'supplier.n' || s_suppkey as s, 'region.n' || n_regionkey as r from supplier join nation on s_nationkey = n_nationkey where s_acctbal >= 0")
def provider_eligibility(spark, sf_dir):
    s = data.table(spark, sf_dir, "supplier")
    own = data.places(spark, sf_dir).where(~F.col("subject").startswith("customer."))
    return answer(ELIGIBLE, own.unionByName(T.relationalise(s.where("s_acctbal < 0"), T.node("supplier", F.col("s_suppkey")), rel("balance"), F.lit("value.negative"))), "q")


@query("closure_counts", f"{BASE}{LOCATED_SQL} select 'rel.locatedIn' as relation, count(*)::bigint as n from located union all select 'rel.inNation', count(*)::bigint from in_nation union all select 'rel.inRegion', count(*)::bigint from in_region")
def closure_counts(spark, sf_dir):
    return Closure(data.places(spark, sf_dir), parse(LOCATED).rules).all().groupBy("relation").agg(F.count("*").alias("n"))


@query("library_macro", "select distinct o.s as o, r.o as r from placed_by o join in_nation n on o.o = n.s join in_region r on n.o = r.s where r.o = 'region.n3'")
def library_macro(spark, sf_dir):
    library = "MACRO path(name, first, second):\nEMIT RULE {{name}}:\nIF ?x#{{first}}@?y AND ?y#{{second}}@?z\nTHEN ?x#{{name}}@?z.\nENDMACRO.\nMACRO both(a, b):\nEMIT USE path({{a}}, placed_by, in_nation).\nEMIT USE path({{b}}, {{a}}, in_region).\nENDMACRO."
    program = parse("USE both(from_nation, from_region).\nQUERY q:\nFIND ?o ?r WHERE ?o#from_region@?r AND region:3#is@?r.", [("paths", library)])
    facts = data.everything(spark, sf_dir).unionByName(T.from_atoms(spark, parse("region:3#is@region:3.").facts()))
    return answer(program, facts, "q")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursion and negation over stored and derived facts: customers without orders and every place that they are in."""
    program = parse(LOCATED + HAS_ORDER + "QUERY q:\nFIND ?c ?where WHERE ?c#in_nation@?n AND ?c#located_in@?where AND NOT ?c#has_order@value:true.")
    facts = data.places(spark, sf_dir).unionByName(data.orders(spark, sf_dir))
    return solve(Closure(facts, program.rules), program.query("q"))


QUERIES["idle_customers"] = flagship
SQL["idle_customers"] = f"{BASE}{LOCATED_SQL} select l.s as c, l.o as where_ from located l join in_nation n on n.s = l.s where not exists (select 1 from placed_by p where p.o = l.s)".replace("as where_", 'as "where"')


@query("wildcard_negation", "select s as c from in_nation a where not exists (select 1 from placed_by p where p.o = a.s)")
def wildcard_negation(spark, sf_dir):
    from ..language.ast import Query
    from ..language.program import parse_atom

    q = Query("q", ("?c",), (parse_atom("?c#in_nation@?n"),), (parse_atom("?o#placed_by@?c"),))  # ?o is bound nowhere: it stands for anything
    return solve(Closure(data.everything(spark, sf_dir), []), q)


@query("canonical_lines", "select 'fact' || chr(9) || s || chr(9) || 'rel.contains' || chr(9) || o || chr(9) || 'linenumber=i:' || line || ';returnflag=s:' || flag || ';supplier=n:' || sup as line from contains")
def canonical_lines(spark, sf_dir):
    from ..sources.exports import facts_of_lines, fact_lines

    lines = fact_lines(T.distinct(data.lines(spark, sf_dir)))
    back = facts_of_lines(lines)  # read again and written again
    return fact_lines(back)


@query("self_negation_broken", "select distinct s as x from in_nation a where not exists (select 1 from placed_by p where p.o = a.s) union select distinct o from placed_by")
def self_negation_broken(spark, sf_dir):
    from dataclasses import replace

    from ..plans.leniency import break_self_negation

    rules = parse("RULE buys:\nIF ?o#placed_by@?c\nTHEN ?c#class@value:buyer.\nRULE idle:\nIF ?c#in_nation@?n\nTHEN ?c#class@value:idle.\nQUERY q:\nFIND ?x WHERE ?x#class@value:buyer.").rules
    looped = [rules[0], replace(rules[1], negative=(rules[0].head,))]
    found = Closure(data.everything(spark, sf_dir), break_self_negation(looped)).relation(rel("class"))
    return found.select(F.col("subject").alias("x")).distinct()


@query("ad_hoc_sql", "select r.o as region, count(*)::bigint as n from in_nation n join in_region r on n.o = r.s where n.s like 'customer.%' group by 1")
def ad_hoc_sql(spark, sf_dir):
    program = parse("RULE home:\nIF ?c#in_nation@?n AND ?n#in_region@?r\nTHEN ?c#lives_in@?r.")
    closed = Closure(data.places(spark, sf_dir), program.all_rules())
    return ad_hoc(closed, "select object as region, count(*) as n from {rel_livesIn} where subject like 'customer.%' group by object", [rel("lives_in")])


# ---- a program of 84 rules


def _sieve(steps: int = 12) -> str:
    """Rules that take a mark's customers away step by step, each step negating what the step before it has found."""
    out = []
    for i in range(1, steps + 1):
        before = "in_nation" if i == 1 else f"kept{i - 1}"
        rules = [
            (f"?c#{before}@?n AND ?c#marked@mark:{i}", f"?c#gone{i}@value:yes"), (f"?c#{before}@?n AND NOT ?c#gone{i}@value:yes", f"?c#kept{i}@?n"),
            (f"?c#kept{i}@?n", f"?n#seen{i}@value:yes"), (f"?n#seen{i}@value:yes AND ?n#in_region@?r", f"?n#still{i}@?r"),
            (f"?c#gone{i}@value:yes AND ?c#in_nation@?n", f"?n#lost{i}@value:yes"), (f"?n#lost{i}@value:yes AND ?n#still{i}@?r", f"?n#both{i}@?r"),
            (f"?n#{f'both{i - 1}' if i > 1 else 'in_region'}@?r AND NOT ?n#lost{i}@value:yes", f"?n#spared{i}@?r"),
        ]
        out += [f"RULE step{i}_{k}:\nIF {when}\nTHEN {then}." for k, (when, then) in enumerate(rules)]
    return "\n".join(out)


@query(
    "eighty_rules",
    """select 'customer.n' || c.c_custkey as c, 'nation.n' || n.n_nationkey as n, 'region.n' || n.n_regionkey as r from customer c join nation n on c.c_nationkey = n.n_nationkey
    where c.c_custkey % 13 = 0 and exists (select 1 from customer d where d.c_nationkey = n.n_nationkey and d.c_custkey % 13 = 12)
    union all select 'customer.n' || c.c_custkey, 'spared', 'region.n' || n.n_regionkey from customer c join nation n on c.c_nationkey = n.n_nationkey
    where c.c_custkey % 13 = 0 and exists (select 1 from customer d where d.c_nationkey = n.n_nationkey and d.c_custkey % 13 = 11) and not exists (select 1 from customer d where d.c_nationkey = n.n_nationkey and d.c_custkey % 13 = 12)""",
)
def eighty_rules(spark, sf_dir):
    c, s = data.table(spark, sf_dir, "customer"), "c_custkey"
    marks = T.relationalise(c.where("c_custkey % 13 > 0"), T.node("customer", F.col(s)), rel("marked"), T.node("mark", F.col(s) % 13))
    program = parse(_sieve() + "\nQUERY both:\nFIND ?c ?n ?r WHERE ?c#kept12@?n AND ?n#both12@?r.\nQUERY spared:\nFIND ?c ?r WHERE ?c#kept12@?n AND ?n#spared12@?r.")
    places = data.places(spark, sf_dir).where("subject not like 'supplier.%'")
    closed = Closure(places.unionByName(marks), program.all_rules())
    spared = solve(closed, program.query("spared")).select("c", F.lit("spared").alias("n"), "r")
    return solve(closed, program.query("both")).unionByName(spared)
