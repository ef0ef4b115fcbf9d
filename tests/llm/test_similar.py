import random

import brute

import corpus_pipeline
from stratalog.llm import simhash


def shingled(text):
    w = brute.words((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_similar_texts_against_brute_force(spark, tmp_path):
    """Copies with words replaced, at similarities from 0.7 to 0.95: most are over four bits apart."""
    rnd = random.Random(3)
    say = lambda k: [f"w{rnd.randrange(3000)}" for _ in range(k)]
    texts = [None, "", " \n", "two words", "Two  words"]
    for changes in (1, 2, 3, 4, 5, 6, 8):
        for _ in range(6):
            w = say(200)
            texts.append(" ".join(w))
            for at in rnd.sample(range(200), changes):
                w[at] = "changed"
            texts.append(" ".join(w))
    sets = {i: shingled(t) for i, t in enumerate(texts)}
    name = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8 and name[i] != name[j]:
                low, high = sorted((name[i], name[j]))
                name = {k: low if v == high else v for k, v in name.items()}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(docs).collect()}
    assert got == name and 20 < len(set(name.values())) < len(texts) - 20
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(name.values())
    assert simhash.similar_texts(docs.limit(0)).count() == 0


def test_no_link_is_missed(spark):
    """Pairs a little over the similarity, in short texts, which fingerprints tell badly; many texts that share a passage and are a little under it."""
    rnd = random.Random(8)
    say = lambda k: [f"w{rnd.randrange(5000)}" for _ in range(k)]
    texts = []
    for _ in range(150):
        w = say(14)
        texts += [" ".join(w), " ".join([*w[:-1], "changed"])]
    for changes in range(1, 7):
        for _ in range(10):
            w = say(150)
            texts.append(" ".join(w))
            for at in rnd.sample(range(150), changes):
                w[at] = "changed"
            texts.append(" ".join(w))
    passage = say(30)
    texts += [" ".join(passage + say(5)) for _ in range(90)] + [" ".join(passage + say(3)) for _ in range(3)]
    sets = [shingled(t) for t in texts]
    name = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if name[i] != name[j] and jaccard(sets[i], sets[j]) >= 0.8:
                low, high = sorted((name[i], name[j]))
                name = [low if v == high else v for v in name]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(docs).collect()}
    assert got == dict(enumerate(name)) and len(set(name)) < len(name) - 150
    few = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(docs, recall=0.01, broadcast_rows=0).collect()}
    assert few == got
