import glob
import os
import threading

import pytest

from musterline.cluster import scratch_path
from musterline.operators.claims import ClaimLedger
from musterline.operators.keyed_table import KeyedTable
from test_tables import event, events


@pytest.fixture
def queue(spark):
    stored = events(spark, *[event(f"e/{i:02d}", 0.5, captured=i) for i in range(30)])
    return stored, spark.createDataFrame([("s", "u")], "student_id string, university_id string")


def ids(claimed):
    return sorted(r.event_id for r in claimed.collect())


def test_claims_go_by_age_and_come_back_from_dead_workers(spark, queue):
    folder = scratch_path(spark, "claims")
    ledger = ClaimLedger(spark, folder)
    assert ids(ledger.claim(*queue, "a", 4)) == [f"e/{i:02d}" for i in range(4)]
    assert ids(ledger.claim(*queue, "b", 3)) == [f"e/{i:02d}" for i in range(4, 7)]
    assert ledger.complete(["e/00", "e/01"], "a") == ["e/00", "e/01"] and ledger.complete(["e/02"], "b") == []
    late = ClaimLedger(spark, folder, lease_seconds=-1)  # every claim in flight has outlived its lease
    assert ids(late.claim(*queue, "c", 3)) == ["e/02", "e/03", "e/04"]
    assert late.complete(["e/02"], "a") == [] and late.complete(["e/02", "e/03"], "c") == ["e/02", "e/03"]
    assert sorted(r.event_id for r in ledger.consumed().collect()) == ["e/00", "e/01", "e/02", "e/03"]
    ledger.release(["e/04"], "c")
    assert ids(ledger.claim(*queue, "d", 100))[0] == "e/04"


def test_workers_at_once_share_no_event(spark, queue):
    folder, got = scratch_path(spark, "claims"), {}

    def work(name):
        got[name] = ids(ClaimLedger(spark, folder).claim(*queue, name, 8))

    workers = [threading.Thread(target=work, args=(f"w{n}",)) for n in range(4)]
    for w in workers:
        w.start()
    for w in workers:
        w.join()
    everything = [e for own in got.values() for e in own]
    assert len(got) == 4 and len(everything) == len(set(everything)) == 30
    assert all(ClaimLedger(spark, folder)._holds(e, name) for name, own in got.items() for e in own)


def test_nothing_to_claim(spark, queue):
    ledger = ClaimLedger(spark, scratch_path(spark, "claims"))
    assert ids(ledger.claim(queue[0].limit(0), queue[1], "a", 5)) == [] and ledger.complete([], "a") == []


def test_upsert_leaves_files_of_other_keys_alone(spark):
    table = KeyedTable(spark, scratch_path(spark, "keyed"), ["k"], 16)
    table.create(spark.range(200).selectExpr("id as k", "'old' as v"))

    def files():
        return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{table.path}/*/*.parquet")}

    before = files()
    touched = table.upsert(spark.createDataFrame([(3, "new"), (7, "new"), (1000, "new")], "k bigint, v string"))
    after = files()
    same = {f for f in before if after.get(f) == before[f]}
    assert 1 <= len(touched) <= 3 and len(before) == 16 and len(same) == 16 - len(touched)
    assert all(int(f.split("_bucket=")[1].split("/")[0]) not in touched for f in same)
    rows = {r.k: r.v for r in table.read().collect()}
    assert len(rows) == 201 and {k for k, v in rows.items() if v == "new"} == {3, 7, 1000}
    assert table.upsert(table.read().limit(0)) == [] and table.read().count() == 201


def test_upsert_again_changes_nothing_and_double_keys_fail(spark):
    table = KeyedTable(spark, scratch_path(spark, "keyed"), ["k"], 4)
    table.create(spark.createDataFrame([(1, "a"), (None, "b")], "k bigint, v string"))
    new = spark.createDataFrame([(1, "c")], "k bigint, v string")
    table.upsert(new)
    table.upsert(new)
    assert sorted(table.read().collect(), key=str) == [(1, "c"), (None, "b")]
    with pytest.raises(Exception, match="duplicate key"):
        table.upsert(new.union(new))
    assert table.read().count() == 2
