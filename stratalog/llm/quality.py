"""Quality rules by distribution divergence (operator 4).  DataFrame functions only.

Two histograms of a document, of its characters' classes and of its language's
commonest words, are compared with references by the Jensen-Shannon distance.
A language's references are the mean shares over all its documents that pass
the base rule and are long enough.  A document fails if a distance passes its
threshold; shorter documents than a distance's guard are not judged by it,
since a small sample strays far by chance.

The language is ``lang`` where there is a word list for it, else the one whose
list covers most of the document's words, else OTHER, which has no list and is
judged by characters only.  So there are at most one reference more than lists.

Defined results: a null or empty text has no words, fails the base rule and is
dropped; if no document makes a reference, only the base rule judges; repeated
rows are each returned; a distance that equals its threshold passes; an empty
table gives no rows; further columns, whatever their names, are left out by
``judge``.  A very long text makes arrays of as many elements as it has words,
and time goes with their sorting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .columns import let, total

OTHER = "other"
#: Common words of each language.
COMMON_WORDS = {
    "en": "the of and to a in is that for it was with on by as be this are at from".split(),
    "fr": "de la le et les des en un du une que est pour par qui dans pas sur au avec".split(),
    "de": "der die und in den von zu das mit sich des auf für ist nicht im dem ein eine als".split(),
    "es": "de la que el en y los se las del un con por no su una para es al lo".split(),
}
WORDS = 20
#: Classes of characters, told apart in this order; all others are one class more.
CLASSES = ["a-z", "A-Z", "0-9", r"\x20\x09-\x0D", "#*$%&|<>", r".,;:!?'\"()\-"]
SYMBOLS = CLASSES[4]
WINDOW = 8


def count_class(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("bigint")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows that are found twice or more in the array."""
    def cover(hashes: Column) -> Column:
        def places(ordered: Column) -> Column:
            def found(p: Column, j: Column) -> Column:
                twin = F.coalesce(F.get(ordered, j - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get(ordered, j + 1)["h"] == p["h"], F.lit(False))
                return F.when(twin, p["i"]).otherwise(F.lit(-1))

            return F.array_sort(F.filter(F.transform(ordered, found), lambda i: i >= 0))

        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.named_struct(F.lit("h"), h, F.lit("i"), i)))
        covered = let(let(ordered, places), lambda s: total(F.transform(s, lambda v, j: F.least(F.lit(window), F.coalesce(F.get(s, j + 1) - v, F.lit(window))))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(covered)

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) < window, F.lit(0).cast("bigint")).otherwise(let(hashes, cover))


def _places(words: Column, listed: list[str]) -> Column:
    """Place of each word in a list, counting from 1; 0 if it is not there."""
    known = F.array(*map(F.lit, listed))
    return F.transform(words, lambda w: F.array_position(known, F.lower(w)).cast("bigint"))


def common_counts(words: Column, language: Column) -> Column:
    """How often each common word of the language occurs, and the number of all other words; null without a list."""
    out = F.when(F.lit(False), F.array(F.lit(0).cast("bigint")))
    for name, listed in COMMON_WORDS.items():
        assert len(set(listed)) == WORDS
        place = F.array_remove(_places(words, listed), F.lit(0).cast("bigint"))

        def counts(p: Column) -> Column:
            each = F.transform(F.sequence(F.lit(1).cast("bigint"), F.lit(WORDS).cast("bigint")), lambda i: (F.size(p) - F.size(F.array_remove(p, i))).cast("bigint"))
            return F.concat(each, F.array((F.size(words) - F.size(p)).cast("bigint")))

        out = out.when(language == name, let(place, counts))
    return out


def guess(words: Column) -> Column:
    """The language whose list covers most words, OTHER if none covers any."""
    hits = [F.named_struct(F.lit("n"), F.size(F.array_remove(_places(words, listed), F.lit(0).cast("bigint"))), F.lit("k"), F.lit(-i)) for i, listed in enumerate(COMMON_WORDS.values())]
    names = F.array(*map(F.lit, COMMON_WORDS))
    return let(F.array_max(F.array(*hits)), lambda best: F.when(best["n"] > 0, F.get(names, -best["k"])).otherwise(OTHER))


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id, language, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(words: Column) -> Column:
        known = F.col("lang").isin(list(COMMON_WORDS))
        return let(F.when(known, F.col("lang")).otherwise(guess(words)), lambda language: F.named_struct(
            F.lit("language"), language,
            F.lit("n_words"), F.size(words).cast("bigint"),
            F.lit("n_repeat_words"), repeated_words(words),
            F.lit("common"), common_counts(words, language),
        ))

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        let(common.words_of(F.col("text")), of).alias("w"),
        F.length(text).cast("bigint").alias("n"),
        F.array(*[count_class(text, c) for c in CLASSES]).alias("c"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines"),
    )
    c = F.col("c")
    rows = rows.select(
        "doc_id", "w.language", "w.n_words", (F.col("n") - c[3]).alias("word_chars"), c[4].alias("n_symbols"), "n_dup_lines", "w.n_repeat_words",
        F.concat(c, F.array(F.col("n") - total(c))).alias("classes"), F.col("w.common").alias("common"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def shares(counts: Column) -> Column:
    return let(total(counts), lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two distributions, 0 to 1."""
    def term(x: Column, y: Column) -> Column:
        middle = (x + y) / 2
        return F.when(x > 0, x * F.log2(x / middle)).otherwise(F.lit(0.0)) + F.when(y > 0, y * F.log2(y / middle)).otherwise(F.lit(0.0))

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def references(rows: DataFrame, least_words: int) -> DataFrame:
    """language, class_ref, word_ref: mean shares over all documents that pass the base rule and have ``least_words``.

    One row for each language list and one for OTHER, at most.
    """
    good = rows.where(~F.col("base_failed") & (F.col("n_words") >= least_words)).select("language", shares(F.col("classes")).alias("c"), shares(F.col("common")).alias("w"))
    means = [F.avg(F.get("c", F.lit(i))) for i in range(len(CLASSES) + 1)], [F.avg(F.get("w", F.lit(i))) for i in range(WORDS + 1)]
    return good.groupBy("language").agg(F.array(*means[0]).alias("class_ref"), F.array(*means[1]).alias("word_ref"))


def judge(docs: DataFrame, class_limit: float = 0.22, word_limit: float = 0.31, class_guard: int = 60, word_guard: int = 150, reference_words: int = 100) -> DataFrame:
    """Base metrics, distances and the verdict (kept) of every document."""
    rows = common.materialise(metrics(docs), "quality")
    known = F.broadcast(references(rows, reference_words))  # at most five rows
    rows = rows.join(known, "language", "left")
    rows = rows.withColumns({
        "class_distance": F.when(F.col("n_words") >= class_guard, divergence(shares(F.col("classes")), F.col("class_ref"))),
        "word_distance": F.when((F.col("n_words") >= word_guard) & F.col("common").isNotNull(), divergence(shares(F.col("common")), F.col("word_ref"))),
    })
    far = F.coalesce(F.col("class_distance") > class_limit, F.lit(False)) | F.coalesce(F.col("word_distance") > word_limit, F.lit(False))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "language", "class_distance", "word_distance")


def oracle_sql(class_limit: float = 0.22, word_limit: float = 0.31, class_guard: int = 60, word_guard: int = 150, reference_words: int = 100) -> str:
    """``judge`` over ``documents`` for DuckDB, for documents whose ``lang`` has a word list."""
    n_classes, n_words = len(CLASSES) + 1, WORDS + 1
    counts = ", ".join("length(regexp_replace(t, '[^" + c.replace("'\\\"", "''\"") + "]+', '', 'g'))" for c in CLASSES)
    words = " ".join(f"when '{k}' then [{', '.join(repr(w) for w in v)}]" for k, v in COMMON_WORDS.items())
    mean = lambda name, n: "[" + ", ".join(f"avg({name}[{i}])" for i in range(1, n + 1)) + "]"
    term = lambda x, y: f"case when {x} > 0 then {x} * log2({x} / (({x} + {y}) / 2)) else 0 end"
    far = lambda p, q, n: "sqrt(greatest((" + " + ".join(f"{term(f'{p}[{i}]', f'{q}[{i}]')} + {term(f'{q}[{i}]', f'{p}[{i}]')}" for i in range(1, n + 1)) + ") / 2, 0))"
    return rf"""
with d as (select doc_id, lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as k from (select doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) as i from d)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as n from win) where n > 1),
cover as (select doc_id, count(distinct j) as n from (select doc_id, unnest(generate_series(i, i + {WINDOW - 1})) as j from twice) group by 1),
m as (
    select d.doc_id, lang, len(w) as n_words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines, coalesce(cover.n, 0) as n_repeat, [{counts}] as c0, length(t) as n,
        list_transform(case lang {words} else [] end, lambda x: len(list_filter(w, lambda y: lower(y) = x))) as h0
    from d left join cover on cover.doc_id = d.doc_id
), s as (
    select *, list_append(c0, n - list_sum(c0)) as c1, list_append(h0, n_words - list_sum(h0)) as h1, n_words < 20 or 100 * n_repeat > 30 * n_words as base_failed from m
), p as (
    select *, list_transform(c1, lambda x: case when n > 0 then x / n else 0 end) as c, list_transform(h1, lambda x: case when n_words > 0 then x / n_words else 0 end) as h from s
), r as (select lang, {mean('c', n_classes)} as rc, {mean('h', n_words)} as rh from p where not base_failed and n_words >= {reference_words} group by lang),
f as (select p.*, case when n_words >= {class_guard} then {far('c', 'rc', n_classes)} end as cd, case when n_words >= {word_guard} then {far('h', 'rh', n_words)} end as wd from p left join r using (lang))
select doc_id, n_words::bigint as n_words, (n - c0[4])::bigint as word_chars, c0[5]::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, n_repeat::bigint as n_repeat_words, base_failed,
    not base_failed and not coalesce(cd > {class_limit}, false) and not coalesce(wd > {word_limit}, false) as kept
from f
"""
