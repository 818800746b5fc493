"""The registered state machine takes every request of the table, in streams of any length."""

from collections import Counter

import pyarrow.parquet as pq

from tidekeep.operators import migrate
from tidekeep.plans import catalog

SF = "/root/testdata/sf0.01"  # 10,000 events


def brute(requests):
    """Results of rows (cluster, seq, action, addr, epoch), written down from the contract."""
    out, states = [], {}
    for cluster, seq, action, addr, epoch in sorted(requests):
        s = states.setdefault(cluster, {"migrating": False, "epoch": 0, "pending": False, "owner": ""})
        right = s["owner"] == addr and s["epoch"] == epoch
        if action == "start" and s["migrating"]:
            result = "rejected"
        elif action == "start":
            s.update(migrating=True, epoch=s["epoch"] + 1, pending=False, owner=addr)
            result = "started"
        elif not s["migrating"]:
            result = "not migrating"
        elif action == "pending":
            s["pending"], result = True, "pending"
        elif not right:
            result = "wrong owner" if s["owner"] != addr else "wrong epoch"
        else:
            result = "finished, again" if s["pending"] else "finished"
            s.update(migrating=False, pending=False, owner="")
        out.append((cluster, seq, result, s["epoch"], s["migrating"], s["pending"], s["owner"]))
    return out


def rows(df):
    return sorted((r.cluster, r.seq, r.result, r.epoch, r.migrating, r.pending, r.owner) for r in df.collect())


def test_whole_table(spark):
    t = pq.read_table(f"{SF}/events.parquet", columns=["event_id", "user_id"]).to_pylist()
    action = {0: "start", 1: "finish", 2: "pending", 3: "finish"}
    asked = [(e["user_id"] % 20, e["event_id"], action[e["event_id"] % 4], "A" if e["event_id"] % 5 < 4 else "B", e["event_id"] % 3 + 1) for e in t]
    got = rows(catalog.QUERIES["rebalance_state_machine"](spark, SF))
    assert len(got) == len(t) == 10_000 and max(r[1] for r in got) >= 2000
    assert got == sorted(brute(asked))


def test_long_log(spark):
    asked = [(1, i, "start" if i % 3 == 0 else "pending" if i % 7 == 0 else "finish", "AB"[i % 11 == 0], i // 3 + 1 if i % 2 else i // 6 + 1) for i in range(30_000)]
    got = rows(migrate.state_machine(spark.createDataFrame(asked, "cluster int, seq long, action string, addr string, epoch long")))
    assert got == sorted(brute(asked)) and len(Counter(r[2] for r in got)) > 3
