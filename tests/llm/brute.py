"""Plain versions of the operators, for small tables."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import zip_longest

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return WORD.findall(text or "")


def corpus(n=60, seed=0):
    """Documents with copies, near copies, shared passages, empty and odd texts."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    say = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    passage, texts = say(45), []
    for i in range(n):
        t = say(rnd.randint(1, 120))
        if i % 5 == 1 and texts:
            t = rnd.choice(texts) or t
        elif i % 5 == 2:
            t = say(10) + "\n" + passage + ". " + say(15)
        elif i % 5 == 3 and texts:
            w = (rnd.choice(texts) or t).split(" ")
            w[rnd.randrange(len(w))] = "changed"
            t = " ".join(w)
        texts.append(t)
    texts[3], texts[4], texts[5] = None, "", " \t\n "
    texts += ["Été à l'Église " * 9, "x" * 5000 + " y", passage + " " + passage]
    return [(i * 3, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def repeats(rows, k=20):
    """doc_id -> (words, removed, kept digest)."""
    seen, out = {}, {}
    for doc, text in sorted((r[0], r[1]) for r in rows):
        w = words(text)
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            key = tuple(w[a : a + k])
            if seen.setdefault(key, (doc, a)) != (doc, a):
                gone[a : a + k] = [True] * k
        kept = [x for x, g in zip(w, gone) if not g]
        out[doc] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def simhash(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(prints, distance=4):
    """doc_id -> least doc_id reachable."""
    ids = sorted(prints)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


KINDS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")), ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")), ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def valid(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "card":
        doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return True


def spans(text):
    found = sorted((m.start(), rank, m.end(), kind) for rank, (kind, p) in enumerate(KINDS) for m in p.finditer(text or "") if valid(kind, m[0]))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)


def quality(text):
    w = words(text)
    at = {}
    for a in range(len(w) - 7):
        at.setdefault(tuple(w[a : a + 8]), []).append(a)
    cover = {i for v in at.values() if len(v) > 1 for a in v for i in range(a, a + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover))


def terms(rows, threshold=0.5, support=3, risk=0.05, belief=0.2):
    """Disclosing terms of documents (doc_id, text) that are one passage each: term -> level."""
    outside, held, prints = {}, {}, {}
    for i, text in rows:
        found = [(m.start(), m.end(), k, m[0].lower()) for k, p in KINDS for m in p.finditer(text or "") if valid(k, m[0])]
        if not found:
            continue
        covered = {j for a, b, _, _ in found for j in range(a, b)}
        clean = "".join(" " if j in covered else c for j, c in enumerate(text))
        outside[i] = set(re.findall(r"[^\W\d_]{3,}", clean.lower()))
        held[i] = set()
        for _, _, k, v in found:
            part = {"email": v.rpartition("@")[2], "ip": ".".join(v.split(".")[:2]), "card": re.sub("[^0-9]", "", v)[:4], "phone": re.sub(r"^(\+?[0-9]+).*", r"\1", v)}[k]
            held[i] |= {(1, k, v), (2, k, part), (3, k)}
        w = words(clean)
        prints[i] = min(hashlib.md5(" ".join(w[j : j + 3]).encode()).hexdigest() for j in range(max(1, len(w) - 2)))
    n = sum(1 for _, t in rows if t)
    first = {min(i for i in prints if prints[i] == p) for p in set(prints.values())}
    n_term = {}
    for _, text in rows:
        for t in set(re.findall(r"[^\W\d_]{3,}", (text or "").lower())):
            n_term[t] = n_term.get(t, 0) + 1
    count = lambda sets, keep: {x: sum(x in s for i, s in sets.items() if i in keep) for x in set().union(*sets.values())}
    n_entity = count(held, set(held))
    names = [e for e, k in count(held, first).items() if k >= support]
    known = [t for t, k in count(outside, first).items() if k >= support]
    both = {(e, t): sum(e in held[i] and t in outside[i] for i in first) for e in names for t in known}
    both = {p: k for p, k in both.items() if k}
    out = {}
    for (e, t), k in both.items():
        c = n_entity[e] / n
        m = c * n_term[t]
        if k < support or c == 1 or k <= m or k * math.log(k / m) - k + m < math.log(len(both) / risk):
            continue
        known = (k + c) / (n_term[t] + 1)
        if math.log(known / c) / -math.log(c) >= threshold and known >= belief:
            out[t] = max(out.get(t, 0), e[0])
    return out


SENTENCE = re.compile(r"[^.!?\n]{1,120}[.!?]{0,8}|[.!?]{1,8}")


def _sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def _leaves(text):
    return [hashlib.md5(x.encode()).hexdigest()[:14] + f"{len(x):02x}" for x in SENTENCE.findall(text)]


def merkle(text):
    sections = [s.split("\n") for s in text.split("\n\n")]
    root = _sha("r" + "".join(_sha("s" + "".join(_sha("p" + p) for p in s)) for s in sections))
    return root + "/" + "/".join(",".join(_sha("p" + p)[:16] + ":" + ".".join(_leaves(p)) for p in s) for s in sections)


def likeness(a, b):
    count = lambda t: Counter(SENTENCE.findall(t) + ["\n"] * t.count("\n"))
    both = sum(len(x) * n for x, n in (count(a) & count(b)).items())
    return 2 * both / (len(a) + len(b)) if a or b else 1.0


def edits(a, b):
    out = []
    for i, (s, t) in enumerate(zip_longest([s.split("\n") for s in a.split("\n\n")], [s.split("\n") for s in b.split("\n\n")])):
        for j, (p, q) in enumerate(zip_longest(s or [], t or [])):
            if p != q:
                out.append(f"{i}:{j}:{'right' if p is None else 'left' if q is None else 'changed'}")
    return ",".join(out)


def similar(texts, similarity=0.8):
    """doc_id -> least doc_id reachable over texts of at least this Jaccard similarity of 5-word shingle sets."""
    sets = {}
    for i, t in texts.items():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
    name = {i: i for i in sets}
    for i in sets:
        for j in sets:
            a, b = sets[i], sets[j]
            if j < i and name[i] != name[j] and (len(a & b) / len(a | b) if a | b else 1.0) >= similarity:
                low, high = sorted((name[i], name[j]))
                name = {k: low if v == high else v for k, v in name.items()}
    return name
