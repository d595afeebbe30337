"""Tables that change: concurrent writers, writers that fail half-way, compaction, retention; the memory and the saved prompts on top of them."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from promptloom.operators import memory
from promptloom.sources import library
from promptloom.sources.tablelog import SavedPrompts, TableLog

WRITES = "seq long, id string, preview string, vector array<double>, composite double, accepted boolean, decision string, n_findings int, token_reduction double"


def prompts(spark, *ids):
    return spark.createDataFrame([(i, f"title {i}", "text", None) for i in ids], "id string, title string, content string, saved_at timestamp")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_put_if_absent(spark, tmp_path):
    log = TableLog(spark, str(tmp_path / "t"), "id string")
    assert log.files.put_if_absent("log/x.json", b"one") and not log.files.put_if_absent("log/x.json", b"two")
    assert log.files.read("log/x.json") == b"one" and log.files.names("_aside") == [] and log.files.names("nowhere") == []


def test_concurrent_commits(spark, tmp_path):
    """Writers that commit at the same time all get in, each under a number of its own."""
    failed = []

    def write(who):
        try:
            log = TableLog(spark, str(tmp_path / "t"), "id string")
            for i in range(6):
                log.commit(lambda m, i=i: {**m, "notes": {**m["notes"], f"{who}-{i}": 1}})
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    last = TableLog(spark, str(tmp_path / "t"), "id string").last()
    assert not failed and last["number"] == 23 and len(last["notes"]) == 24


def test_saved_prompts(spark, tmp_path):
    store = SavedPrompts(spark, str(tmp_path / "saved"))
    assert store.all().count() == 0
    store.save(prompts(spark, "a", "b", "c"))
    store.save(prompts(spark, None))
    store.delete("b", "nobody")
    assert len(ids(store.all())) == 3 and "b" not in ids(store.all())
    store.save(prompts(spark, "b"))
    assert "b" in ids(store.all())  # saved again after it was deleted
    store.delete("b")
    store.save(prompts(spark, "d"), writer="job", batch=4)
    store.save(prompts(spark, "d"), writer="job", batch=4)
    before = ids(store.all())
    assert before.count("d") == 1 and "b" not in before and len(before) == 4
    store.compact()
    assert ids(store.all()) == before and len(store.log.last()["parts"]) == 1
    store.replace(lambda rows: rows.where("id <> 'a'"))  # reads what it replaces
    assert "a" not in ids(store.all()) and len(ids(store.all())) == 3


def test_saved_prompts_after_failed_writes(spark, tmp_path):
    """A change that fails while it writes, or dies before it commits, or leaves half a file aside: the table is as before."""
    store = SavedPrompts(spark, str(tmp_path / "saved"))
    store.save(prompts(spark, "a", "b"))
    fails = F.udf(lambda x: 1 / 0, "string")
    with pytest.raises(Exception, match="ZeroDivision|division"):
        store.replace(lambda rows: rows.withColumn("title", fails("title")))
    with pytest.raises(Exception, match="ZeroDivision|division"):
        store.save(prompts(spark, "c").withColumn("title", fails("title")))
    store.log.write_part(prompts(spark, "orphan"))
    (tmp_path / "saved" / "_aside").mkdir(exist_ok=True)
    (tmp_path / "saved" / "_aside" / "half").write_text('{"number": 7, "par')
    assert ids(store.all()) == ["a", "b"]
    store.delete("a")
    assert ids(store.all()) == ["b"]
    parts = len(list((tmp_path / "saved" / "data").iterdir()))
    assert store.log.vacuum(grace=3600) == 0  # may be about to be committed
    assert store.log.vacuum(grace=0) >= 2 and len(list((tmp_path / "saved" / "data").iterdir())) == 1 < parts
    assert ids(store.all()) == ["b"]


def test_readers_of_an_old_manifest(spark, tmp_path):
    """Who began to read before a compaction still finds its parts, until they are old enough to go."""
    store = SavedPrompts(spark, str(tmp_path / "saved"))
    store.save(prompts(spark, "a"))
    store.save(prompts(spark, "b"))
    reader = store.all()
    store.compact()
    store.delete("a")
    assert ids(reader) == ["a", "b"] and ids(store.all()) == ["b"]


def test_replace_may_read_its_table(spark, tmp_path):
    path = str(tmp_path / "saved")
    library.save(prompts(spark, "1", "2"), path)
    library.replace(library.without(spark.read.parquet(path), "1"), path)
    assert ids(spark.read.parquet(path)) == ["2"]


def entry_rows(rows):
    return [(seq, i, i, [1.0], float(c), True, "allow", 0, 0.0) for seq, i, c in rows]


def plain_memory(batches, cap):
    """What a list would hold: an id keeps its place, new ones go to the end, the oldest leave after each batch."""
    kept = {}
    for batch in batches:
        firsts, lasts = {}, {}
        for seq, i, c in sorted(batch):
            firsts.setdefault(i, seq)
            lasts[i] = c
        for i in sorted(firsts, key=firsts.get):
            kept[i] = lasts[i]
        while len(kept) > cap:
            kept.pop(next(iter(kept)))
    return kept


@pytest.mark.parametrize("compact_at", [1, 3, 100])
def test_memory_log(spark, tmp_path, monkeypatch, compact_at):
    """Whenever parts are merged, the memory is that of a list; ids of any size, order of arrival."""
    monkeypatch.setattr(memory, "COMPACT_AT", compact_at)
    rng = random.Random(compact_at)
    known = memory.TableBackend(spark, str(tmp_path / "m"), cap=5)
    batches = [[(rng.randrange(-(2**62), 2**62), f"h{rng.randrange(12)}", rng.randrange(100)) for _ in range(rng.randrange(1, 7))] for _ in range(7)]
    for n, batch in enumerate(batches):
        known.upsert(spark.createDataFrame(entry_rows(batch), WRITES), n)
        known.upsert(spark.createDataFrame(entry_rows(batch), WRITES), n)  # runs twice
        want = plain_memory(batches[: n + 1], 5)
        got = known.all().orderBy("place").collect()
        assert [(r["id"], r["composite"]) for r in got] == list(want.items())
    assert len(known.log.last()["parts"]) <= compact_at + 1
    known.upsert(spark.createDataFrame([], WRITES), 50)
    known.clear()
    assert known.size() == 0
    known.upsert(spark.createDataFrame(entry_rows([(4 * 10**18, "x", 1)]), WRITES))
    assert ids(known.all()) == ["x"]


def test_memory_with_two_writers(spark, tmp_path):
    """Both writers' entries are there, none under the other's place, however they meet."""
    path, failed = str(tmp_path / "m"), []

    def write(who):
        try:
            known = memory.TableBackend(spark, path)
            for i in range(3):
                known.upsert(spark.createDataFrame(entry_rows([(0, f"{who}{i}", i), (1, "both", i)]), WRITES), i, writer=who)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = memory.TableBackend(spark, path).all().collect()
    assert not failed and sorted(r["id"] for r in got) == ["a0", "a1", "a2", "b0", "b1", "b2", "both"]
    assert len({r["place"] for r in got}) == 7
    last = json.loads(sorted((tmp_path / "m" / "log").glob("*.json"))[-1].read_text())
    assert last["writers"] == {"a": 2, "b": 2} and last["number"] == 5


def test_front_matter_by_parts_repeats(spark):
    df = spark.createDataFrame([("---\ntags: a\nx: 1\ntags: b\n---\nBody",)], "raw string")
    r = library.front_matter_by_parts(df).first()
    assert r["meta"] == {"tags": "b", "x": "1"} and r["body"] == "Body"


def test_titles_in_a_readers_order(spark):
    titles = ["b", "A", "a", "É", "Z", "e", "ab", "Ä", None]
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    got = [r["title"] for r in library.by_title(df).collect()]
    assert got == [None, "a", "A", "Ä", "ab", "b", "e", "É", "Z"] != sorted(t for t in titles if t)
