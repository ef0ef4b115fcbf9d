"""Document fingerprints: Merkle trees over paragraphs and sections (operator 1).  DataFrame functions only.

A text is cut at blank lines into sections, those at line feeds into paragraphs
and those into leaves, sentences of at most ``LEAF`` characters, without losing
a character.  A paragraph's digest is the SHA-256 of its text, a section's that
of its paragraphs' digests, the root's that of the sections' digests, each level
with a prefix of its own.  Equal roots mean equal texts, and where roots differ,
comparing sections and then paragraphs leads to the edits (``differences``).

The fingerprint is the tree in writing: the root, then section by section the
paragraphs' digests (shortened) with their leaves, each a hash that ends in its
length.  So two fingerprints tell how much text their trees share: twice the
characters in common leaves and line feeds by the characters of both (Dice).
Leaves and line feeds count as often as they occur.  Equal branches have equal
leaves, so passing over them and matching what is below the others, wherever it
stands, gives the same sum as matching all leaves, which is what is done.

Defined results: a null text is an empty one; two empty texts are alike, 1.0;
with one document, the next document is itself; rows that share a doc_id follow
each other by the hash of their texts; a null doc_id comes first; an empty table
gives no rows; further columns are kept by ``trees`` and left out by
``compare_edits``.  A very long text makes arrays of as many elements as it has
sentences; time is in proportion to them, and their sorting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .columns import bound, running_max

#: Most characters of a leaf before its end marks.
LEAF = 120
#: A sentence with its end marks, or end marks alone; line feeds are left to the paragraphs.
SENTENCE = rf"[^.!?\n]{{1,{LEAF}}}[.!?]{{0,8}}|[.!?]{{1,8}}"
#: Characters of a leaf's hash, and of a paragraph's digest in the fingerprint.
HASH, SHORT = 14, 16


# Arguments of the following are names of columns; the text of the expressions is parsed at once, which building columns call by call is not.


def tree(text: str) -> Column:
    """Array of sections, which are arrays of paragraphs: digest and leaves (a hash and the length, in hexadecimal)."""
    leaf = f"concat(substring(md5(cast(x as binary)), 1, {HASH}), lpad(lower(hex(length(x))), 2, '0'))"
    paragraph = rf"named_struct('digest', sha2(concat('p', p), 256), 'leaves', transform(regexp_extract_all(p, r'{SENTENCE}', 0), x -> {leaf}))"
    return F.expr(rf"transform(split(coalesce({text}, ''), '\n\n', -1), s -> transform(split(s, '\n', -1), p -> {paragraph}))")


def _section(paragraphs: str) -> str:
    return f"sha2(concat('s', array_join(transform({paragraphs}, p -> p.digest), '')), 256)"


def fingerprint(of: str) -> Column:
    """The root's digest and the tree in writing."""
    root = f"sha2(concat('r', array_join(transform({of}, s -> {_section('s')}), '')), 256)"
    written = f"array_join(transform({of}, s -> array_join(transform(s, p -> concat(substring(p.digest, 1, {SHORT}), ':', array_join(p.leaves, '.'))), ',')), '/')"
    return F.expr(f"concat({root}, '/', {written})")


def leaves(of: str) -> Column:
    """The tree's leaves, each with the number of equal ones before it."""
    start = running_max("transform(o, (x, i) -> case when i > 0 and x = get(o, i - 1) then 0L else cast(i as bigint) end)")
    numbered = bound("array_sort(a)", "o", bound(start, "m", "transform(o, (x, i) -> concat(x, i - get(m, i + 1)))"))
    return F.expr(bound(f"flatten(flatten(transform({of}, s -> transform(s, p -> p.leaves))))", "a", f"case when size(array_distinct(a)) = size(a) then transform(a, x -> concat(x, '0')) else {numbered} end"))


def breaks(of: str) -> Column:
    """Line feeds of the tree's text: one between paragraphs, two between sections."""
    return F.expr(f"aggregate({of}, -2L, (n, s) -> n + size(s) + 1)")


def weight(keys: Column) -> Column:
    """Characters in leaves."""
    return F.aggregate(keys, F.lit(0).cast("bigint"), lambda n, k: n + F.conv(F.substring(k, HASH + 1, 2), 16, 10).cast("bigint"))


def likeness(a: Column, b: Column, a_breaks: Column, b_breaks: Column, a_size: Column, b_size: Column) -> Column:
    both = weight(F.array_intersect(a, b)) + F.least(a_breaks, b_breaks)
    return F.when(a_size + b_size > 0, both * 2.0 / (a_size + b_size)).otherwise(F.lit(1.0))


def trees(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and tree, fingerprint; columns of these names are replaced."""
    return docs.withColumn("tree", tree(text)).withColumn("fingerprint", fingerprint("tree"))


def differences(a: str, b: str) -> Column:
    """Places where two trees differ, by their order: section:paragraph:kind, counting from 0, joined by commas.

    Kinds: changed, left, right (only there).  Equal sections are not entered.
    """
    kind = "case when l is null then 'right' when r is null then 'left' else 'changed' end"
    size = "greatest(coalesce(size(q), 0), coalesce(size(w), 0))"
    at = bound("get(q, j).digest", "l", bound("get(w, j).digest", "r", f"case when l <=> r then null else concat_ws(':', i, j, {kind}) end"))
    within = bound(f"get({a}, i)", "q", bound(f"get({b}, i)", "w", f"case when {_section('q')} <=> {_section('w')} then cast(array() as array<string>) else transform(sequence(0, {size} - 1), j -> {at}) end"))
    return F.expr(f"array_join(flatten(transform(sequence(0, greatest(size({a}), size({b})) - 1), i -> {within})), ',')")


def with_next_text(docs: DataFrame, runs: int | None = None) -> DataFrame:
    """doc_id, text and next_text: the text of the document with the next greater doc_id; after the last, of the first.

    The ids are cut into ``runs`` runs of about equal size at some of the ids
    themselves.  A row that opens a run is sent to the run before as well, so
    each run is finished on its own and texts are shuffled once.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    runs = runs or 4 * common.parallelism(docs.sparkSession)
    shares = [k / runs for k in range(1, runs)]
    cuts, low, nulls = slim.agg(F.percentile_approx("doc_id", shares, 10 * runs) if shares else F.array(), F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    cuts = sorted({c for c in cuts or [] if c > low})
    opening = F.lit(low).cast("bigint") if not nulls else F.lit(None).cast("bigint")  # of the whole table
    here = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    here = F.when(F.col("doc_id").isNull(), 0).otherwise(here)
    opens = F.col("doc_id").eqNullSafe(opening) | F.array_contains(F.lit(cuts).cast("array<bigint>"), F.coalesce("doc_id", F.lit(low))) if cuts else F.col("doc_id").eqNullSafe(opening)
    last = len(cuts)
    before = F.when(F.col("doc_id").eqNullSafe(opening), F.lit(last)).otherwise(here - 1)
    own, copy = F.struct(here.alias("run"), F.lit(0).alias("copy")), F.struct(before.alias("run"), F.lit(1).alias("copy"))
    dealt = slim.withColumn("__to", F.explode(F.when(opens, F.array(own, copy)).otherwise(F.array(own))))
    order = Window.partitionBy("__to.run").orderBy("__to.copy", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("__to.copy = 0").select("doc_id", "text", "next_text")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, how alike they and the next document's are, and where the edited text differs (``edits``).

    The edited text has the last floor(n / 2) of n characters replaced by the
    first as many of the next document's text.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next_text(docs).withColumn("edited", edited)
    rows = rows.select("doc_id", n.cast("bigint").alias("n"), F.length("edited").cast("bigint").alias("en"), F.length("next_text").cast("bigint").alias("xn"), F.sha2("edited", 256).alias("sha"), tree("text").alias("t"), tree("edited").alias("e"), tree("next_text").alias("x"))
    rows = rows.withColumns({f"{c}_leaves": leaves(c) for c in "tex"})
    near = lambda c, size: likeness(F.col("t_leaves"), F.col(f"{c}_leaves"), breaks("t"), breaks(c), F.col("n"), F.col(size))
    return rows.select(
        "doc_id", F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"), fingerprint("t").alias("fingerprint"), fingerprint("e").alias("edited_fingerprint"),
        near("e", "en").alias("near_edited"), near("x", "xn").alias("near_next"), differences("t", "e").alias("edits"),
    )


def oracle_sql() -> str:
    """``compare_edits`` over ``documents`` for DuckDB; it matches leaves by counting each one's occurrences."""
    leaf = f"substring(md5(x), 1, {HASH}) || printf('%02x', length(x))"
    of = lambda t: rf"list_transform(string_split({t}, E'\n\n'), lambda s: list_transform(string_split(s, E'\n'), lambda p: {{'digest': sha256('p' || p), 'leaves': list_transform(regexp_extract_all(p, '{SENTENCE}'), lambda x: {leaf})}}))"
    section = lambda s: f"sha256('s' || array_to_string(list_transform({s}, lambda p: p.digest), ''))"
    written = lambda t: f"sha256('r' || array_to_string(list_transform({t}, lambda s: {section('s')}), '')) || '/' || array_to_string(list_transform({t}, lambda s: array_to_string(list_transform(s, lambda p: substring(p.digest, 1, {SHORT}) || ':' || array_to_string(p.leaves, '.')), ',')), '/')"
    feeds = lambda t: rf"length({t}) - length(replace({t}, E'\n', ''))"
    counted = lambda c: f"select doc_id, x, count(*) as n from (select doc_id, unnest(flatten(flatten(list_transform({c}, lambda s: list_transform(s, lambda p: p.leaves))))) as x from l) group by all"
    near = lambda c, t: f"case when length(text) + length({t}) > 0 then (coalesce({c}.n, 0) + least({feeds('text')}, {feeds(t)})) * 2.0::double / (length(text) + length({t})) else 1.0::double end"
    both = lambda c: f"(select ta.doc_id, sum(least(ta.n, o.n) * ('0x' || substring(ta.x, {HASH + 1}, 2))::int)::bigint as n from ta join ({counted(c)}) o on o.doc_id = ta.doc_id and o.x = ta.x group by 1)"
    return f"""
with d as (
    select doc_id, coalesce(text, '') as text, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id), '') as nxt from documents
), f as (select *, substring(text, 1, length(text) - length(text) // 2) || substring(nxt, 1, length(text) // 2) as edited from d),
l as materialized (select *, {of('text')} as t, {of('edited')} as e, {of('nxt')} as x from f),
ta as materialized ({counted('t')}),
spot as (
    select doc_id, i, unnest(range(1, greatest(coalesce(len(a), 0), coalesce(len(b), 0)) + 1)) as j, a, b
    from (select doc_id, i, t[i] as a, e[i] as b from (select doc_id, t, e, unnest(range(1, greatest(len(t), len(e)) + 1)) as i from l)) where {section('a')} is distinct from {section('b')}
), edits as (
    select doc_id, string_agg((i - 1) || ':' || (j - 1) || ':' || case when a[j] is null then 'right' when b[j] is null then 'left' else 'changed' end, ',' order by i, j) as edits from spot where a[j].digest is distinct from b[j].digest group by 1
)
select l.doc_id, length(text)::bigint as n_chars, sha256(edited) as edited_sha256, {written('t')} as fingerprint, {written('e')} as edited_fingerprint,
    {near('ne', 'edited')} as near_edited, {near('nx', 'nxt')} as near_next, coalesce(edits, '') as edits
from l left join edits using (doc_id) left join {both('e')} ne on ne.doc_id = l.doc_id left join {both('x')} nx on nx.doc_id = l.doc_id
"""
