import hashlib
import random
import re
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratalog.llm import bpe, langid, merkle, packing, pii, quality, simhash, substring, toxicity, warc
from stratalog.llm.columns import running_max, running_sum

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def rows():
    return brute.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, brute.SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def same(frame, *columns):
    return {r[0]: tuple(r)[1:] for r in frame.select(*columns).collect()}


# ---- 1


def test_fingerprints(spark, rows, docs):
    got = {r["doc_id"]: r for r in merkle.compare_edits(docs).collect()}
    texts = [r[1] or "" for r in rows]
    for i, r in enumerate(rows):
        t, nxt = texts[i], texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[r[0]]["n_chars"] == len(t) and got[r[0]]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[r[0]]["near_next"] == pytest.approx(brute.likeness(t, nxt)) and got[r[0]]["near_edited"] == pytest.approx(brute.likeness(t, edited))
        assert got[r[0]]["fingerprint"] == brute.merkle(t) and got[r[0]]["edits"] == brute.edits(t, edited)
        assert (got[r[0]]["edited_fingerprint"] == got[r[0]]["fingerprint"]) == (edited == t)
    by_text = {}
    for i, r in enumerate(rows):
        by_text.setdefault(texts[i], set()).add(got[r[0]]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and len({min(v) for v in by_text.values()}) == len(by_text)


def test_fingerprint_cases(spark, none):
    assert merkle.compare_edits(none).count() == 0
    one = spark.createDataFrame([(None, "a b. c", 1, "x")], "doc_id bigint, text string, sections int, next_text string")
    assert merkle.compare_edits(one).first()["near_next"] == 1.0
    twice = spark.createDataFrame([(1, "a."), (1, "a."), (2, None), (None, "z")], "doc_id bigint, text string")
    assert merkle.with_next_text(twice, runs=2).count() == 4 and {(r[0], r[2]) for r in merkle.with_next_text(twice, runs=2).collect()} == {(None, "a."), (1, "a."), (1, ""), (2, "z")}
    pair = [("one.\ntwo.\n\nthree.", "one.\nTWO.\n\nthree.\nfour."), ("a.\na.\nb.", "a.\nb."), ("x", "x\n"), ("", "\n\n\n"), ("a. " * 5000, "a. " * 4000 + "b.\n\n"), ("one two " * 90_000, "one two " * 90_000 + "three")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pair)], "i int, a string, b string").select("i", merkle.tree("a").alias("a"), merkle.tree("b").alias("b"), F.length("a").alias("n"), F.length("b").alias("m"))
    near = merkle.likeness(merkle.leaves("a"), merkle.leaves("b"), merkle.breaks("a"), merkle.breaks("b"), F.col("n"), F.col("m"))
    for r in rows.select("i", near.alias("near"), merkle.differences("a", "b").alias("d")).collect():
        assert r["near"] == pytest.approx(brute.likeness(*pair[r["i"]])) and r["d"] == brute.edits(*pair[r["i"]])
    assert brute.edits(*pair[0]) == "0:1:changed,1:1:right" and brute.likeness(*pair[1]) < 1 and brute.likeness(*pair[2]) < 1
    long = spark.createDataFrame([(1, "A sentence. " * 40_000 + "\n\nend"), (2, "z" * 300_000)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["fingerprint"] for r in merkle.compare_edits(long).collect()} == {1: brute.merkle("A sentence. " * 40_000 + "\n\nend"), 2: brute.merkle("z" * 300_000)}
    clash = spark.createDataFrame([("a", 1, 2)], "text string, tree int, fingerprint int")
    assert merkle.trees(clash).first()["fingerprint"] == brute.merkle("a")


# ---- 2


def test_repeats(rows, docs):
    assert same(substring.remove_repeats(docs, digest=True), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.repeats(rows)


def test_repeats_over_the_limit(rows, docs):
    got = substring.remove_repeats(docs, digest=True, limit=60)  # every bucket goes into further rounds
    assert same(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute.repeats(rows)


def test_equal_hashes_are_told_apart(rows, docs, monkeypatch):
    count = np.array([3, 3])
    joined = b" ".join([b"a b c d e", b"a b c d f"])
    w = substring.Windows.of(count, joined, 3)
    w.key[:] = 7
    found = substring.find_repeats(np.array([1, 2]), np.array([0, 0]), np.array([0, 0]), w)
    assert found.tolist() == [False, False, False, True, True, False]


def test_repeat_cases(spark, none, rows, docs):
    assert substring.remove_repeats(none).count() == 0 and substring.remove_repeats(none, digest=True).count() == 0
    t = " ".join(f"w{i}" for i in range(30))
    odd = spark.createDataFrame([(1, t, "a", 0), (1, t, "b", 0), (2, t, "c", 0), (None, t + " end", "d", 0), (3, None, "e", 0)], "doc_id bigint, text string, windows string, `check` int")
    got = {r["windows"]: r["text"] for r in substring.remove_repeats(odd).collect()}
    assert got == {"a": "", "b": "", "c": "", "d": t + " end", "e": None}
    kept = {r["doc_id"]: r["text"] for r in substring.remove_repeats(docs).collect()}
    clean = [r for r in rows if brute.repeats(rows)[r[0]][1] == 0]
    assert clean and all(kept[r[0]] == r[1] for r in clean)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "cé", "x" * 3]), min_size=1, max_size=60), st.integers(1, 7))
def test_rolling_hash_and_minimum(words, k):
    h, begin, end = substring.hash_words(" ".join(words).encode())
    joined = " ".join(words).encode()
    assert [joined[a:b].decode() for a, b in zip(begin, end)] == words
    assert len({(w, int(x)) for w, x in zip(words, h)}) == len(set(words))
    if len(words) >= k:
        r = substring.rolling(h, k)
        assert len({(tuple(words[i : i + k]), int(r[i])) for i in range(len(r))}) == len({tuple(words[i : i + k]) for i in range(len(r))})
        assert substring.sliding_min(h, k).tolist() == [int(h[i : i + k].min()) for i in range(len(h) - k + 1)]


# ---- 3


def test_warc(spark, tmp_path):
    big, small = "<p>é" + "x" * 1200, "<p>small\r\n\r\nWARC/1.1"
    pages = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, small), (4, "u\nv", small), (5, "e", ""), (6, "n", None), (7, "http://b", "z" * 1000), (None, "m", big), (2, "again", big)]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id bigint, url string, html string, archive int")
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()), key=str)
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        revisit = html == big and i != 2
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0
    decided = lambda n: sorted((tuple(r) for r in warc.decide(df, broadcast_rows=n).collect()), key=str)
    assert decided(0) == decided(100)
    raw = warc.write_archives(warc.decide(df).coalesce(1), f"file://{tmp_path}/raw", most=500)
    assert raw.count() > 1
    whole = warc.read_archives(warc.normalise(raw.cache(), f"file://{tmp_path}/members").cache(), f"file://{tmp_path}", with_html=True)
    assert {r["html"] for r in whole.collect() if r["page_id"] == 3} == {small}


def test_cut_and_dense_streams(spark, tmp_path):
    import gzip
    import io
    import os

    records = [warc.record(i, "u", b"a" * 5_000_000, None, "2024-01-01T00:00:00Z") for i in range(2)]
    whole = zlib.compressobj(9, wbits=31)
    data = whole.compress(records[0]) + whole.flush(zlib.Z_FULL_FLUSH)
    cut = len(data)  # between two records
    data += whole.compress(records[1]) + whole.flush()
    pieces = list(warc.inflate(io.BytesIO(data)))
    assert b"".join(pieces) == b"".join(records) and max(map(len, pieces)) <= warc.PIECE
    assert b"".join(warc.inflate(io.BytesIO(gzip.compress(b"x") + gzip.compress(b"y" * 3_000_000)))) == b"x" + b"y" * 3_000_000
    with pytest.raises(ValueError):
        list(warc.inflate(io.BytesIO(data[:cut])))
    folder = f"file://{tmp_path}"
    names = []
    for name, content in (("whole", data), ("cut", data[:cut])):
        (tmp_path / name).write_bytes(content)
        names.append(os.path.join(str(tmp_path), name))
    rows = spark.createDataFrame([(names[0], 2)], "archive string, records bigint")
    assert warc.normalise(rows, f"{folder}/out").first()["records"] == 2
    for name, n in ((names[1], 2), (names[0], 3)):
        with pytest.raises(Exception, match="ends within a gzip member|records, not"):
            warc.normalise(spark.createDataFrame([(name, n)], "archive string, records bigint"), f"{folder}/bad").collect()


def test_warc_damage():
    good = warc.record(1, "u", b"abc", None, "2024-01-01T00:00:00Z")
    assert [len(x[1]) for x in warc.split_records(iter([good[:10], good[10:] + good]))] == [len(good)] * 2
    for bad in (good[:-20], b"HTTP/1.1 200\r\n\r\n", good + b"rest"):
        with pytest.raises(ValueError):
            list(warc.split_records(iter([bad])))


# ---- 4


def test_quality(spark, rows, docs):
    junk = [(900, "a b c d e f g h " * 20, None, "s", 1), (901, "## $$ %% && " * 30 + " ".join(f"w{i}" for i in range(100)), "en", "s", 1), (902, "line\nline\n\nline two\n", "en", "s", 1)]
    more = docs.unionByName(spark.createDataFrame(junk, brute.SCHEMA))
    got = same(quality.judge(more), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for r in rows + junk:
        want = brute.quality(r[1])
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert got[r[0]][:6] == (*want, failed) and not (failed and got[r[0]][6])
    assert not got[901][6] and sum(v[6] for v in got.values()) > 20
    assert quality.judge(more.limit(0)).count() == 0
    only = quality.judge(spark.createDataFrame([(1, "one two", "xx", "s", 1)], brute.SCHEMA)).first()
    assert only["language"] == quality.OTHER and only["kept"] is False


def test_divergence(spark):
    row = spark.range(1).select(quality.divergence(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("far"), quality.divergence(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.5), F.lit(0.5))).alias("near")).first()
    assert row["far"] == pytest.approx(1.0) and row["near"] == 0.0


# ---- 5


def labelled(n=240):
    rng = np.random.default_rng(1)
    vocabulary = ["w" + "".join(chr(97 + int(x)) for x in rng.integers(0, 26, 5)) for _ in range(300)]
    texts, toxic = [], []
    for i in range(n):
        words = rng.choice(vocabulary, 40).tolist()
        if i % 3 == 0:
            for j in rng.integers(0, 40, 3).tolist():
                words[j] = ["blurgh", "zorkling", "zorked"][j % 3]
        texts.append(" ".join(words).capitalize() + ".")
        toxic.append(int(i % 3 == 0))
    return texts, np.array(toxic)


def test_toxicity(spark, none):
    texts, y = labelled()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], brute.SCHEMA)
    labels = spark.createDataFrame([(i, int(v), 9) for i, v in enumerate(y)], "doc_id bigint, toxic int, text int")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(len(y)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i]["predicted"] == y[i] for i in held) and all(0 <= r["score"] <= 1 for r in got.values())
    hits = [texts[0][s["start"] : s["end"]].lower() for s in got[0]["spans"]]
    assert hits and all(h.startswith(("blurgh", "zork")) for h in hits)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (3, "12 !!")], "doc_id bigint, text string")
    found = [r["score"] for r in toxicity.score(odd, model).collect()]
    assert len(found) == 4 and len(set(found)) == 1 and found[0] < 0.5
    assert toxicity.score(none, model).count() == 0 and toxicity.drop_toxic(docs, model).count() == int((y == 0).sum())
    blank = toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, blank).collect()} == {0.0}


def test_marginals_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    s, trans = rng.normal(size=9), rng.normal(size=(2, 2))
    lengths = np.array([4, 1, 4])
    got = toxicity.marginal_logits(s, lengths, trans)
    at = 0
    for n in lengths:
        weights = {p: np.exp(sum(s[at + i] * p[i] for i in range(n)) + sum(trans[p[i], p[i + 1]] for i in range(n - 1))) for p in product((0, 1), repeat=int(n))}
        for i in range(n):
            on = sum(w for p, w in weights.items() if p[i])
            assert got[at + i] == pytest.approx(np.log(on / (sum(weights.values()) - on)))
        at += n


def tags_likelihood(theta, data, rows):
    """Log likelihood of the tags by enumeration."""
    from itertools import product

    n = len(data.names)
    number = {f: i for i, f in enumerate(data.names)}
    trans, total = theta[n + 1 :].reshape(2, 2), 0.0
    for words, tags in rows:
        s = [theta[n] + sum(theta[number[f]] for f in found if f in number) for found in toxicity.in_context(words)]
        weigh = lambda p: sum(s[i] * p[i] for i in range(len(p))) + sum(trans[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        total += weigh(tags) - np.log(sum(np.exp(weigh(p)) for p in product((0, 1), repeat=len(words))))
    return total


def test_gradient_by_enumeration():
    rows = [("you are a blurgh today".split(), [0, 0, 0, 1, 0]), ("a blurgh blurgh".split(), [0, 1, 1]), ("blurgh".split(), [0]), ("today you".split(), [0, 0])]
    data = toxicity.Labelled(rows, least=1)
    theta = np.random.default_rng(0).normal(size=len(data.names) + 5) * 0.3
    got = data.gradient(theta)
    for i in range(len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-5
        assert got[i] == pytest.approx((tags_likelihood(theta + step, data, rows) - tags_likelihood(theta - step, data, rows)) / 2e-5, abs=1e-4)


def test_context_counts_against():
    """A word that is toxic unless another one stands before it: the field tells, a list of telling words does not."""
    rnd = random.Random(0)
    vocabulary = [f"v{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    texts, y = [], []
    for i in range(900):
        w = [rnd.choice(vocabulary) for _ in range(12)]
        at = rnd.randrange(1, 11)
        if i % 2:
            w[at] = "zork"
        elif i % 8 == 0:
            w[at - 1 : at + 1] = ["harmless", "zork"]
        texts.append(" ".join(w) + ".")
        y.append(i % 2)
    y = np.array(y)
    signs = toxicity.telling(texts[:600], y[:600], purity=0.75)
    model = toxicity.fit(texts[:600], y[:600], purity=0.75)
    assert "zork" not in toxicity.telling(texts[:600], y[:600]) and "zork" in signs
    assert min(model.weights.values()) < 0 and model.weights["harmless<"] < 0
    look = toxicity.Scores(model)
    best = toxicity.greatest(toxicity.token_logits([toxicity.tokens_of(t) for t in texts[600:]], look))
    wrong = int(((model.slope * best + model.intercept >= 0) != y[600:]).sum())
    by_list = sum(("zork" in t) != v for t, v in zip(texts[600:], y[600:].tolist()))
    assert by_list > 20 and wrong < by_list / 4


def test_offsets_of_letters_that_grow():
    text = "İİ blurgh ok"
    tokens = toxicity.tokens_of(text)
    spans = toxicity.offending(text, np.array([5.0 if t == "blurgh" else -5.0 for t in tokens]))
    assert [text[s["start"] : s["end"]] for s in spans] == ["blurgh"]


# ---- 6


def test_packing(spark, rows, docs, library, none):
    got = packing.pack_documents(docs, PATH, capacity=64, with_ids=True).collect()
    by_doc, by_bin = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [0]
        parts = sorted(by_doc[r[0]], key=lambda p: p["piece"])
        assert [i for p in parts for i in p["ids"]] == ids and all(p["length"] == 64 for p in parts[:-1]) and [p["start"] for p in parts] == [64 * p["piece"] for p in parts]
        assert all(p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) for p in parts)
    for places in by_bin.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 64
    assert len(by_bin) <= 1.06 * sum(r["length"] for r in got) / 64 + 2
    assert packing.pack_documents(none, PATH).count() == 0


def test_the_bound_binds(spark):
    """With the query's parameters bins are closed for want of room, and sequences stay close to the least possible number."""
    rng = np.random.default_rng(0)
    rows = [(int(i), 0, 0, int(n), 0) for i, n in enumerate(np.clip(rng.lognormal(6.2, 0.8, 5000), 1, 2048))]
    items = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint").repartition(3)
    got = packing.pack(items, 2048, 2).collect()
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(got) == 5000 and all(sorted(b)[-1][0] + sorted(b)[-1][1] == sum(n for _, n in b) <= 2048 for b in bins.values())
    assert len(bins) <= 1.02 * sum(r[3] for r in rows) / 2048
    assert sorted(map(tuple, packing.pack(items.repartition(7), 2048, 2).collect())) == sorted(map(tuple, got))
    packer = packing.Packer(2048, 256)
    for at in range(0, 2500, 1024):
        for _, _, _, n, _ in sorted(rows[at : min(at + 1024, 2500)], key=lambda r: -r[3]):
            packer.put(n)
    assert packer.closed > 0 and packer.open <= 256


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(1, 5))
def test_packer(lengths, most):
    p, bins, opened = packing.Packer(20, most), {}, []
    for n in lengths:
        number, offset = p.put(n)
        assert offset == bins.get(number, 0)
        bins[number] = offset + n
        assert bins[number] <= 20 and p.open <= most and p.open == sum(map(len, p.bins))
        opened.append(number)
    assert p.made == len(bins)


# ---- 7


def test_personal_data(spark, none):
    texts = [
        "a.b@c.d_e@f.g x", "@x.y a@b a@b.c. me@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.0003.4 1.2.3", "card 4111 1111-1111 1111, 4111111111111112 and 12345678901234567890123", "call +1 (555) 010-9999 or +49-30-1234567.", None, "",
        "éè joe@x.org \U0001f600 +12345678901", "9" * 3000 + "@" + "8" * 3000 + ".com", "+1" + " " * 4000 + "2", "mark \x01 in a@b.co \x01", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
    ]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, spans int")
    got = {r["doc_id"]: r for r in pii.report(df).collect()}
    for i, t in enumerate(texts):
        assert got[i]["spans"] == brute.spans(t) and got[i]["base_sha256"] == hashlib.sha256(brute.spans(t).encode()).hexdigest()
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean[5] is None and clean[7] == "éè [EMAIL] \U0001f600 [PHONE]" and "4111" not in clean[3].split("and")[0].split(",")[0]
    assert pii.report(none).count() == 0 and pii.sanitise(df).columns == df.columns and pii.sanitise(df).agg(F.max("spans")).first()[0] == 0
    assert pii.find(df).where("size(spans) > 0").count() == sum(bool(brute.spans(t)) for t in texts)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="a1.@-+ ()5_%", max_size=40), min_size=1, max_size=8))
def test_patterns_find_what_plain_ones_find(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").select("doc_id", pii.listed(pii.base_spans("text")).alias("s"))
    assert {r["doc_id"]: r["s"] for r in df.collect()} == {i: brute.spans(t) for i, t in enumerate(texts)}


def revealing(seed=0):
    """Documents in which one word tells an address, one a provider, one any phone; copies, and texts without personal data."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    say = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    texts = [say(rnd.randint(5, 40)) for _ in range(400)]
    texts += [f"{say(9)} Wintermute wrote to boss@corp.example {say(9)}" for _ in range(6)]
    texts += [f"{say(9)} Provider {say(4)} user{i}@mail.example {say(3)}" for i in range(8)] + [f"{say(9)} someone{i}@else{i}.example {say(9)}" for i in range(150)]
    texts += [f"{say(6)} hotline {say(3)} +{10 + i} 555 0100 2{i}{i} {say(5)}" for i in range(9)] + [f"{say(6)} from 10.{i}.2.{i} {say(5)}" for i in range(8)]
    once = f"{say(12)} unrepeated rumour c@opied.example {say(12)}"
    return [(i, t) for i, t in enumerate([*texts, *[once] * 8, "only Wintermute here", None, ""])]


def test_disclosing_terms(spark):
    rows = revealing()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = brute.terms(rows)
    found = {r["term"]: r["label"] for r in pii.disclosing_terms(df).collect()}
    assert want["provider"] == 2 and want["hotline"] == 3 and want["wintermute"] == 2 and "rumour" not in want
    assert {t: 3 if x == pii.REMOVED else 2 if x in pii.KINDS else 1 for t, x in found.items()} == want
    got = {r["doc_id"]: r for r in pii.report(df).collect()}
    for i, text in rows:
        terms = [w for w in re.findall(r"[^\W\d_]{3,}", text or "") if w.lower() in want]
        assert got[i]["n_removed"] == sum(want[w.lower()] == 3 for w in terms) and got[i]["n_generalised"] == len(terms) - got[i]["n_removed"]
        assert got[i]["spans"].count("term:") == len(terms)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert all("Wintermute" not in (t or "") and "hotline" not in (t or "") for t in clean.values()) and {i for i, t in clean.items() if "[TERM]" in (t or "")} == {i for i, r in got.items() if r["n_removed"]}
    shuffled = sorted(map(tuple, pii.report(df, broadcast_rows=0).collect()))
    assert shuffled == sorted(tuple(r) for r in got.values())


def test_long_texts_and_overlaps(spark):
    """Running sums over several levels, and spans that overlap across blocks."""
    long = " ".join(f"w{i} user{i}@h{i}.example" if i % 3 else f"1.2.3.4@h{i}.example x 4111 1111 1111 1111" for i in range(2500))
    rows = [(1, long, 0), (2, "x" * 10_000 + " a@b.co " + "y" * 9000, 0), (None, "a@b.co", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, terms int")
    got = {r["doc_id"]: r for r in pii.report(df).collect()}
    assert all(got[i]["spans"] == brute.spans(t) for i, t, _ in rows)
    clean = {r["doc_id"]: r for r in pii.sanitise(df).collect()}
    assert clean[2]["text"] == "x" * 10_000 + " [EMAIL] " + "y" * 9000 and clean[None]["text"] == "[EMAIL]" and clean[None]["terms"] == 1
    assert "@" not in clean[1]["text"] and "4111" not in clean[1]["text"] and clean[1]["text"].startswith("[EMAIL] x [CARD] w1 [EMAIL] w2")
    sums = spark.range(1).select(F.expr(running_sum("transform(sequence(1, 40000), i -> cast(i % 7 as bigint))")).alias("s"), F.expr(running_max("transform(sequence(1, 3000), i -> cast(i * 37 % 1009 as bigint))")).alias("m")).first()
    values = [i * 37 % 1009 for i in range(1, 3001)]
    assert sums["s"] == [0, *np.cumsum([i % 7 for i in range(1, 40001)]).tolist()] and sums["m"] == [0, *np.maximum.accumulate(values).tolist()]


# ---- 8


def test_language(spark, none):
    rng = np.random.default_rng(0)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ei", "un", "ber"]}
    make = lambda x, n: " ".join("".join(rng.choice(syllables[x], 3)) for _ in range(n))
    rows = [(i, make(x, 12), x, "s", 0) for i in range(120) for x in [["aa", "bb"][i % 2]]]
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))), PIECES)
    odd = spark.createDataFrame([(900, None), (901, "12 €"), (902, "kalo" * 5000), (902, "中文 kalomi")], "doc_id bigint, text string")
    got = langid.predict(docs.select("doc_id", "text").unionByName(odd), model).collect()
    pred = {r["doc_id"]: r["lang_pred"] for r in got}
    assert len(got) == 124 and all(pred[r[0]] == r[2] for r in rows) and pred[900] == pred[901] == "und" and pred[902] == "aa"
    assert langid.predict(none, model).count() == 0 and langid.predict(docs, langid.fit({}, PIECES)).first()["lang_pred"] == "und"


def test_forward_sums_segmentations():
    model = langid.fit({"x": {"hello": 3, "yellow": 2}}, PIECES)
    pieces = langid.Pieces(PIECES)
    p = dict(zip(pieces.names, np.exp(model.log_p[:, 0])))

    def total(word):
        a = [1.0] + [0.0] * len(word)
        for e in range(1, len(word) + 1):
            a[e] = sum(a[s] * p.get(word[s:e], 0.0) for s in range(e)) + langid.STRAY * a[e - 1]
        return a[-1]

    got = pieces.lattice(["hello", "yellow", "q中"]).log_probabilities(np.exp(model.log_p))[:, 0]
    assert got == pytest.approx([np.log(total("▁" + w)) for w in ("hello", "yellow", "q中")])


def segmentations(word, pieces):
    """All ways to cut a word into pieces and strays (None), as lists of (piece, length)."""
    if not word:
        return [[]]
    out = [[None, *rest] for rest in segmentations(word[1:], pieces)]
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            out += [[word[:n], *rest] for rest in segmentations(word[n:], pieces)]
    return out


def brute_language(counts, rounds=4, smoothing=0.1):
    """Piece probabilities by enumeration of all segmentations of all words."""
    names = langid.Pieces(PIECES).names
    start = {n: 4.0 ** (len(n) - 12) for n in names}
    share = lambda x: (lambda whole: {k: v / whole for k, v in x.items()})(sum(x.values()))
    known, out = set(names), {}
    for language, words in counts.items():
        p = share(start)
        cuts = {w: segmentations("▁" + w, known) for w in words}
        for _ in range(rounds):
            used = dict.fromkeys(names, smoothing)
            for w, n in words.items():
                weights = [np.prod([langid.STRAY if x is None else p[x] for x in c]) for c in cuts[w]]
                for c, x in zip(cuts[w], weights):
                    for piece in c:
                        if piece is not None:
                            used[piece] += n * x / sum(weights)
            p = share(used)
        out[language] = (p, lambda w, p=p: np.log(sum(np.prod([langid.STRAY if x is None else p[x] for x in c]) for c in segmentations("▁" + w, known))))
    return out


def test_language_by_enumeration(spark):
    counts = {"xx": {"hello": 3, "yellow": 2, "low": 1}, "yy": {"hallo": 2, "gelb": 3, "well": 1}}
    want, model = brute_language(counts), langid.fit(counts, PIECES)
    names = langid.Pieces(PIECES).names
    for k, language in enumerate(model.languages):
        assert np.exp(model.log_p[:, k]) == pytest.approx(np.array([want[language][0][n] for n in names]), rel=1e-9)
    texts = ["hello low", "gelb", "Hallo, WELL!", "½ ② yellow", "zz q"]
    docs = spark.createDataFrame([*enumerate(texts), (9, "½ ² Ⅷ ①"), (10, "７ 3")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[a-z]+", text.lower())
        logs = [sum(want[x][1](w) for w in words) for x in model.languages]
        share = np.exp(np.array(logs) - max(logs))
        assert got[i]["lang_pred"] == model.languages[int(np.argmax(logs))] and got[i]["score"] == pytest.approx(1 / share.sum())
    assert got[9]["lang_pred"] == got[10]["lang_pred"] == "und"


def test_long_runs_of_letters_are_not_cut():
    model = langid.fit({"x": {"hello": 3, "yellow": 2}, "y": {"kalo": 3}}, PIECES)
    scorer = langid.Scorer(model)
    for word in ("hello" * 6, "helloyellow" * 2, "中" * 20):  # by either way
        assert scorer.pieces.log_probability(word, scorer.p) == pytest.approx(scorer.pieces.lattice([word]).log_probabilities(scorer.p)[0])
    run = "helloyellow" * 40
    p = scorer.p[:, 0].astype(object)
    a, place = [1] + [0] * (len(run) + 1), {n: i for i, n in enumerate(scorer.pieces.names)}
    from fractions import Fraction

    marked = "▁" + run
    for e in range(1, len(marked) + 1):
        a[e] = sum(a[s] * Fraction(float(p[place[marked[s:e]]])) for s in range(max(0, e - 40), e) if marked[s:e] in place) + Fraction(langid.STRAY) * a[e - 1]
        a[e] = Fraction(a[e].numerator >> max(0, a[e].denominator.bit_length() - 4000), max(1, a[e].denominator >> max(0, a[e].denominator.bit_length() - 4000)))
    exact = (a[-1].numerator.bit_length() - a[-1].denominator.bit_length()) * np.log(2)
    assert scorer.texts([[run]])[0][0] == pytest.approx(exact, abs=2)
    far = scorer.texts([["中" * 3000], ["中" * 3000 + "kalo" * 20], ["hello", run]])
    assert np.isfinite(far).all() and far[1][1] > far[1][0] and far[2] == pytest.approx(scorer.texts([["hello"]])[0] + scorer.texts([[run]])[0])


# ---- 9


def test_bpe(rows, docs, library, none):
    for r in bpe.encode(docs, PATH).collect():
        text = next(x[1] for x in rows if x[0] == r["doc_id"]) or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert bpe.encode(none, PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abcdefgst 'é́ΣA1.,!\n <|endoftext>", max_size=60) | st.just("<|endoftext|>a<|startoftext|>"))
def test_bpe_is_the_librarys(text):
    library = packing.ids_of(PATH).tokenizer
    want = bpe.pack(library.encode(text, add_special_tokens=False).ids)
    assert bpe.encoder(PATH).encode(text) == want and packing.ids_of(PATH).encode(text) == want
    ids = np.frombuffer(want, "<u4")
    assert bpe.encoder(PATH).v.decode(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


def test_other_tokenizer_files_are_refused(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        file = json.load(f)
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": {"type": "ByteLevel"}}):
        other = tmp_path / "other.json"
        other.write_text(json.dumps({**file, **change}))
        with pytest.raises(ValueError, match="not supported"):
            bpe.Vocabulary(str(other))
        with pytest.raises(ValueError, match="not supported"):
            packing.Ids(str(other))
    renamed = tmp_path / "renamed.json"
    renamed.write_text(json.dumps({**file, "added_tokens": [{**t, "content": t["content"].replace("<|", "[[").replace("|>", "]]")} for t in file["added_tokens"]]}))
    library = Tokenizer.from_file(str(renamed))
    for text in ("a [[endoftext]] b", "<|endoftext|>", "[[", "[[startoftext]][[endoftext]]"):
        want = bpe.pack(library.encode(text, add_special_tokens=False).ids)
        assert bpe.Encoder(bpe.Vocabulary(str(renamed))).encode(text) == want and packing.Ids(str(renamed)).encode(text) == want


# ---- 10


def test_simhash(spark, rows, docs, none):
    prints = {r[0]: brute.simhash(r[1]) for r in rows}
    want = brute.components(prints)
    got = same(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id")
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints} and len(set(want.values())) < len(prints)
    assert simhash.near_duplicates(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e", 1), (7, "a b c d e", 2), (7, "a b c d e", 3)], "doc_id bigint, text string, fp int")
    assert [r["component_id"] for r in simhash.near_duplicates(odd).collect()] == [7, 7, 7]


def test_large_groups_are_cut(monkeypatch):
    rng = np.random.default_rng(0)
    seeds = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fp = np.unique(np.concatenate([s ^ (np.uint64(1) << rng.integers(0, 64, 80, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 80, dtype=np.uint64)) for s in seeds]))
    monkeypatch.setattr(simhash, "PAIRWISE", 20)
    forest = simhash.Forest()
    simhash.link_group(fp, 4, forest)
    want = brute.components({int(x): int(x) for x in fp})
    groups = {}
    for x in fp.tolist():
        groups.setdefault(want[x], set()).add(forest.root(x))
    assert all(len(v) == 1 for v in groups.values()) and len({min(v) for v in groups.values()}) == len(groups)


def test_every_close_pair_shares_a_key():
    rng = np.random.default_rng(0)
    masks = simhash.masks(4, 7)
    for _ in range(500):
        flip = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(flip & m == 0 for m in masks)
