"""Catalog queries read all rows of their tables: against plain versions."""

import datetime
import random
from itertools import product

import pytest

from stratalog.catalog import ORACLE_SQL, QUERIES


def collected(spark, folder, name):
    return sorted(map(tuple, QUERIES[name](spark, str(folder)).collect()))


def test_clocks_of_all_users(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rnd.randrange(9000)), rnd.choice([3, 30, 41, 500, 1100])) for i in range(200)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint").write.parquet(f"{tmp_path}/events.parquet")
    clock, hybrid, seen = {}, {}, {}
    for i, ts, user in rows:
        seen[user] = seen.get(user, 0) + 1
        clock[i] = (seen[user], i // 50 if i % 5 == 0 else 0)
        hybrid[i] = (int(ts.replace(tzinfo=datetime.timezone.utc).timestamp()) // 3600, i % 7)
    together = [(a[0], b[0]) for a, b in product(rows, rows) if a[2] == b[2] and a[0] != b[0]]
    less = lambda a, b: clock[a] != clock[b] and all(x <= y for x, y in zip(clock[a], clock[b]))
    assert collected(spark, tmp_path, "vector_before") == sorted((f"e{a}", f"e{b}") for a, b in together if less(a, b))
    assert collected(spark, tmp_path, "vector_concurrent") == [(sum(a < b and not less(a, b) and not less(b, a) for a, b in together),)]
    assert collected(spark, tmp_path, "hlc_before") == sorted((f"e{a}", f"e{b}") for a, b in together if hybrid[a] < hybrid[b])


def test_hybrid_clocks_round_seconds_as_sql_does(spark, tmp_path):
    """The last half second of an hour belongs to the next one; exact halves go to the even second; hours before 1970 are cut towards zero."""
    micros = [3599_499999, 3599_500000, 3600_500000, 3598_500000, 7199_500001, -500000, -1_500000, -3599_500000, -3600_000000, -7199_400000, 1704070799_778549, 1704070800_000000, 1704070799_400000]
    zero = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [(i, zero + datetime.timedelta(microseconds=m), 1) for i, m in enumerate(micros)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint").write.parquet(f"{tmp_path}/events.parquet")
    hybrid = [(int(round(m / 1e6) / 3600), i % 7) for i, m in enumerate(micros)]
    want = sorted((f"e{a}", f"e{b}") for a, b in product(range(len(micros)), repeat=2) if hybrid[a] < hybrid[b])
    assert collected(spark, tmp_path, "hlc_before") == want
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute(f"create view events as select event_id, ts at time zone 'UTC' as ts, user_id from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert sorted(db.execute(ORACLE_SQL["hlc_before"]).fetchall()) == want


def test_audit_diff_and_concurrency_of_whole_tables(spark, tmp_path):
    spark.createDataFrame([(k,) for k in range(1990, 2060)], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k, "FOP"[k % 3]) for k in range(1150, 1500)], "o_orderkey bigint, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    turns = [(c, t) for c in range(8, 24) for t in range(c % 4 + 1)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [a for a, _ in collected(spark, tmp_path, "theorem_audit")] == [f"theorem.n{k}" for k in range(1990, 2060)]
    want = []
    for k in range(1150, 1500):
        old = None if k % 11 == 0 else "FOP"[k % 3]
        new = None if k % 13 == 0 else "X" if k % 7 == 0 else "FOP"[k % 3]
        cause = "declaration_added" if old is None else "declaration_removed" if new is None else "declaration_changed"
        want += [(f"order.n{k}", op, cause, f"value.{v}") for op, v in (("assert", new), ("retract", old)) if old != new and v]
    assert collected(spark, tmp_path, "batch_diff") == sorted(want)
    name = lambda x: f"turn.n{x[0]}.n{x[1]}"
    pairs = [(name(a), name(b)) for a, b in product(turns, turns) if a[0] // 10 == b[0] // 10 and a[0] != b[0] and name(a) < name(b)]
    assert collected(spark, tmp_path, "causal_concurrent") == sorted(pairs)
