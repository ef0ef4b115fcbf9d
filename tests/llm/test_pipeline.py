import glob

import brute
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from stratalog.llm import common, toxicity
from stratalog.llm.catalog import WORD_BPE
from test_operators import labelled


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    texts, y = labelled(120)
    rows = [(1000 + i, t, "en", "s", 0) for i, t in enumerate(texts)]
    extra = [(r[0], r[1] and r[1] + " me@mail.example.com", *r[2:]) for r in brute.corpus(40)]
    spark.createDataFrame(extra + rows, brute.SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1000 + i, 1, int(v)) for i, v in enumerate(y)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, extra + rows


def test_stages_against_brute_force(spark, tables, tmp_path):
    folder, rows = tables
    docs, frames = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        frames.append(docs)
    columns = [c.split(" ")[0] for c in brute.SCHEMA.split(", ")]
    assert all(f.columns == columns for f in frames[:-1])
    clean, single, cut, hidden, packed = ({r[0]: r for r in f.collect()} if i < 4 else f.collect() for i, f in enumerate(frames))
    bad = {r[0] for r in rows if r[0] >= 1000 and (r[0] - 1000) % 3 == 0}
    assert not bad & clean.keys() and len(clean) > 0.9 * (len(rows) - len(bad))
    want = brute.similar({i: r[1] for i, r in clean.items()})
    assert single.keys() == set(want.values())
    for i, (n, gone, digest) in brute.repeats(list(single.values())).items():
        assert len(brute.words(cut[i][1])) == n - gone and (gone or cut[i][1] == single[i][1])
    assert all("@mail" not in (r[1] or "") for r in hidden.values()) and hidden.keys() == cut.keys()
    library = Tokenizer.from_file(WORD_BPE)
    total = {i: len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for i, r in hidden.items()}
    got = {}
    for r in packed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == total
    again = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, packed))


def test_odd_tables(spark, tmp_path):
    """An empty table; null columns, repeated rows and further columns with clashing names."""
    schema = brute.SCHEMA + ", node bigint, terms string, `__spans` int, windows int, `__doc` int, `__runs` int, row int"
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    empty = spark.createDataFrame([], schema)
    text = " ".join(f"word{i}" for i in range(40)) + " x@mail.example.com"
    rows = [(1, text, None, None, None, 1, "t", 2, 3, 4, 5, 6), (1, text, None, None, None, 1, "t", 2, 3, 4, 5, 6), (2, text, "en", "s", 9, 1, "t", 2, 3, 4, 5, 6), (3, *[None] * 11), (4, "", "en", "s", 0, 4, "", 0, 0, 0, 0, 0), (None, "alone here", "en", "s", 1, 5, "u", 6, 7, 8, 9, 10)]
    for docs, kept in ((empty, []), (spark.createDataFrame(rows, schema), [1, 1, 3, None])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == empty.columns, name
            path = f"{tmp_path}/{name}{len(kept)}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        found = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
        assert [r["doc_id"] for r in found] == kept and all("@" not in (r["text"] or "") for r in found)
        assert not kept or [tuple(r)[5:] for r in found] == [(1, "t", 2, 3, 4, 5, 6)] * 2 + [(None,) * 7, (5, "u", 6, 7, 8, 9, 10)]
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert packed.count() == len(kept)


def test_held_out_matches_crc32(spark):
    import zlib

    from pyspark.sql import functions as F

    got = {r["id"]: r["h"] for r in spark.range(200).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)} and np.mean(list(got.values())) > 0.1


def test_files_follow_the_input(spark, tables, tmp_path):
    """Stages of a small table write few files, however many partitions a shuffle has."""
    folder, before = tables[0], spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs, top = spark.read.parquet(f"{folder}/documents.parquet"), common.scratch(spark, "x").removeprefix("file:").rpartition("/")[0]
        old = set(glob.glob(f"{top}/*"))
        for name, stage in corpus_pipeline.STAGES[1:4]:
            stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        new = [*set(glob.glob(f"{top}/*")) - old, *glob.glob(f"{tmp_path}/*")]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(new) > 10
    assert max(len(glob.glob(f"{d}/part-*")) for d in new) <= common.TASKS


def test_freed_memory_is_given_back():
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    def run(batches):
        held = [np.ones(12_000) for _ in range(2000)]  # 192 MB in pieces below the size that has pages of its own
        top.append(held[-1])  # what lies above the freed pieces stays in use
        yield from batches

    top, begin = [], resident()
    assert list(common.released(run)(iter([1, 2]))) == [1, 2]
    assert len(top) == 1 and resident() - begin < 60
