"""The versioned store of states, and states against the messages that are there now."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from quillon.operators import resume as rs
from quillon.sources import states
from quillon.sources.state_store import Commit, Conflict, StateStore

from test_context import MESSAGE, COLUMNS, PART_FIELDS, compressed, ignored
from test_context import sessions as random_sessions


def state(session, tools=None, compaction=None, name=None, turn=()):
    prune = {"tools": tools or {}, "messages": {"byMessageId": {"m1": {"tokenCount": 1, "allBlockIds": [1], "activeBlockIds": [1]}}, "blocksById": {}, "activeBlockIds": [1], "activeByAnchorMessageId": {}, "nextBlockId": 2}}
    return {"sessionId": session, "sessionName": name, "prune": prune, "nudges": {"contextLimitAnchors": ["c"], "turnNudgeAnchors": list(turn), "iterationNudgeAnchors": []}, "stats": {"pruneTokenCounter": 1, "totalPruneTokens": 2}, "lastUpdated": None, "lastCompaction": compaction}


def frame(spark, *rows):
    return spark.createDataFrame(spark.sparkContext.parallelize([json.dumps(r) for r in rows]).map(lambda x: (x,)), "j string").select(F.from_json("j", states.STATE).alias("s")).select("s.*")


def names(df):
    return {r["sessionId"]: r["sessionName"] for r in df.collect()}


def test_saving_one_session_leaves_the_others(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "s"), 4)
    assert store.versions() == [] and store.load().count() == 0 and store.save(frame(spark).filter("false")) == 0
    assert store.save(frame(spark, *[state(f"s{i}", name="one") for i in range(10)])) == 1
    assert store.save(frame(spark, state("s3", name="two"), state("new", name="two"))) == 2
    assert names(store.load()) == {f"s{i}": "two" if i == 3 else "one" for i in range(10)} | {"new": "two"}
    assert names(store.load(["s3", "s4", "nobody"])) == {"s3": "two", "s4": "one"}
    assert names(store.load(version=1)) == {f"s{i}": "one" for i in range(10)}
    assert store.delete(["s3", "new"]) == 3 and set(names(store.load())) == {f"s{i}" for i in range(10) if i != 3}
    store.vacuum()
    assert store.versions() == [3] and len(names(store.load())) == 9
    again = StateStore(spark, str(tmp_path / "s"), 99)  # a store keeps its own number of buckets
    assert again.commit().buckets == 4 and again.save(frame(spark, state("s3", {"c": 5}, 7))) == 4
    r = again.load(["s3"]).first()
    assert (r["prune"]["tools"], r["lastCompaction"], len(r["lastUpdated"])) == ({"c": 5}, 7, 24)


def test_plain_files_of_other_sessions_stay(spark, tmp_path):
    for s in ("s1", "s2", "s1"):
        states.write(frame(spark, state(s, name=s)), str(tmp_path / "plain"))
    assert names(states.read(spark, str(tmp_path / "plain")).select("sessionId", "sessionName")) == {"s1": "s1", "s2": "s2"}


def test_a_writer_that_dies_before_its_commit_changes_nothing(spark, tmp_path, monkeypatch):
    store = StateStore(spark, str(tmp_path / "s"), 2)
    store.save(frame(spark, state("a", name="one"), state("b", name="one")))

    def die(self, commit):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(StateStore, "_publish", die)
        with pytest.raises(KeyboardInterrupt):
            store.save(frame(spark, state("a", name="two")))
    assert store.versions() == [1] and names(store.load()) == {"a": "one", "b": "one"}
    assert store.save(frame(spark, state("b", name="three"))) == 2
    store.vacuum()
    assert names(store.load()) == {"a": "one", "b": "three"}


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    """Threads that save other sessions, in the same few buckets; every one is there in the end."""
    path, failed = str(tmp_path / "s"), []

    def save(k):
        try:
            for i in range(2):
                StateStore(spark, path, 2).save(frame(spark, state(f"{k}-{i}", name=str(k))))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=save, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and names(StateStore(spark, path).load()) == {f"{k}-{i}": str(k) for k in range(4) for i in range(2)}
    assert StateStore(spark, path).versions() == list(range(1, 9))


def test_a_commit_between_reading_and_writing_is_merged(spark, tmp_path, monkeypatch):
    """The other writer commits the same bucket, then another one, while this one is about to."""
    path = str(tmp_path / "s")
    store, plain = StateStore(spark, path, 1), StateStore._publish
    store.save(frame(spark, state("a", name="one")))
    rest = ["b"]

    def late(self, commit):
        if rest:
            name = rest.pop()
            StateStore(spark, path).save(frame(spark, state(name, name="other")))
        return plain(self, commit)

    monkeypatch.setattr(StateStore, "_publish", late)
    assert store.save(frame(spark, state("a", name="two"))) == 3
    assert names(store.load()) == {"a": "two", "b": "other"}
    monkeypatch.setattr(StateStore, "_publish", lambda self, commit: False)
    with pytest.raises(Conflict):
        StateStore(spark, path).save(frame(spark, state("a", name="x")))


def test_states_meet_their_messages(spark):
    every, *_ = random_sessions(11, 30)
    m = spark.createDataFrame([tuple(r[c] if c != "parts" else [tuple(p[f] for f in PART_FIELDS) for p in r["parts"]] for c in COLUMNS) for rows in every.values() for r in rows], MESSAGE)
    rng = random.Random(1)
    saved = {s: state(str(s), {"c": 1}, rng.choice([None, 0, 5, 40, 10_000]), turn=["old"]) for s in every if s % 4}
    got = {r["sessionId"]: r for r in rs.resume(frame(spark, *saved.values()), m).collect()}
    for s, rows in every.items():
        if not any(r["role"] == "user" and not ignored(r) for r in rows):
            assert str(s) not in got
            continue
        r = got[str(s)]
        summaries = [x for x in rows if x["role"] == "assistant" and x["summary"]]
        last = summaries[-1]["created"] if summaries else 0
        anchors, pending = set(), None
        for x in reversed(rows):  # from the end to the last message that has compressed
            if x["role"] == "assistant" and compressed(x):
                break
            if x["role"] == "user" and not ignored(x):
                pending = x["message_id"]
            elif x["role"] == "assistant" and pending:
                anchors |= {str(x["message_id"]), str(pending)}
                pending = None
        stored = saved.get(s)
        cleared = stored is not None and stored["lastCompaction"] is not None and last > stored["lastCompaction"]
        assert (r["is_new"], r["cleared"], r["lastCompaction"]) == (stored is None, cleared, last)
        assert r["turn"] == sum(p["type"] == "step-start" for x in rows if x["created"] >= last for p in x["parts"])
        assert r["prune"]["tools"] == ({} if stored is None or cleared else {"c": 1}) and len(r["prune"]["messages"]["byMessageId"]) == (0 if stored is None or cleared else 1)
        assert set(r["nudges"]["turnNudgeAnchors"]) == (set() if cleared else anchors | ({"old"} if stored else set()))
        assert r["nudges"]["contextLimitAnchors"] == (["c"] if stored and not cleared else []) and tuple(r["stats"]) == ((1, 2) if stored else (0, 0))
