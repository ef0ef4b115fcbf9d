"""A tiny evaluator of rules, fact by fact, to hold the engine against."""

from stratalog.language.ast import is_variable
from stratalog.plans.analysis import stratify


def match(atom, fact, env):
    s, r, o, attrs = fact
    if r != atom.relation:
        return None
    env = dict(env)
    pairs = [(atom.subject, s), (atom.object, o)]
    for k, v in atom.attrs:
        have = dict(attrs).get(k)
        if have is None:
            return None
        if is_variable(v):
            if not have.startswith("n:"):
                return None
            pairs.append((v, have[2:]))
        elif have != v:
            return None
    for p, v in pairs:
        if is_variable(p):
            if env.setdefault(p, v) != v:
                return None
        elif p != v:
            return None
    return env


def bindings(positive, negative, facts, against):
    envs = [{}]
    for a in positive:
        envs = [e2 for e in envs for f in facts if (e2 := match(a, f, e)) is not None]
    return [e for e in envs if not any(match(a, f, e) is not None for a in negative for f in against)]


def head(atom, env):
    v = lambda t: env[t] if is_variable(t) else t
    return (v(atom.subject), atom.relation, v(atom.object), tuple(sorted((k, "n:" + env[x] if is_variable(x) else x) for k, x in atom.attrs)))


def closure(facts, rules):
    facts = set(facts)
    strata = stratify(rules)
    for level in range(max(strata.values(), default=0) + 1):
        entry, size = set(facts), -1
        while len(facts) != size:
            size = len(facts)
            for r in rules:
                if strata[r.head.relation] == level:
                    facts |= {head(r.head, e) for e in bindings(r.positive, r.negative, facts, entry)}
    return facts


def solve(facts, query):
    return {tuple(e[v] for v in query.select) for e in bindings(query.positive, query.negative, facts, facts)}


def rows(frame):
    from stratalog.language.names import parse_attrs_key

    return {(r["subject"], r["relation"], r["object"], tuple(sorted(parse_attrs_key(r["attrs_key"]).items()))) for r in frame.collect()}
