"""Streams of edits and of captured responses with restarts, the ledger of model calls, and diffs of long texts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from promptloom.operators import compare, evaluate
from promptloom.sources import library
from promptloom.streaming import guard, live, sse

EDITS = "prompt_id long, ts timestamp, text string"


def run(stream, out, checkpoint):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def brute_settled(edits, quiet=120_000):
    by = {}
    for p, at, text in edits:
        by.setdefault(p, {})[at] = max(text, by.get(p, {}).get(at, ""))
    return sorted((p, at, e[at]) for p, e in by.items() for at in e if not any(at < x < at + quiet for x in e))


def test_debounce(spark, tmp_path):
    """Edits out of order over many batches, a restart between them, repeated times, edits that are too late."""
    rng = random.Random(4)
    edits = [(rng.randrange(4), rng.randrange(0, 30_000_000, 20_000), f"edit {i}") for i in range(400)]
    edits += [(9, t, f"x{t}") for t in (1_000_000, 1_119_999, 1_240_000, 1_360_000)]  # 119.999, 120.001 and 120 ms apart
    batches = [sorted(edits, key=lambda e: e[1] + rng.randrange(3_000_000))[i::1] for i in (0,)][0]
    cut = [batches[i : i + 70] for i in range(0, len(batches), 70)] + [[(5, 10**9, "far ahead")], [(0, 5_000_000, "too late"), (None, 5, "nobody")]]

    def write(i, rows):
        at = F.timestamp_micros(F.col("at"))
        df = spark.createDataFrame(rows, "prompt_id long, at long, text string").select("prompt_id", at.alias("ts"), "text")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def stream():
        s = spark.readStream.schema(EDITS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return live.debounce(s, late="5 seconds")

    for i, rows in enumerate(cut[:4]):
        write(i, rows)
    run(stream(), str(tmp_path / "out"), str(tmp_path / "cp"))
    for i, rows in enumerate(cut[4:], 4):
        write(i, rows)
    run(stream(), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).select("prompt_id", F.unix_micros("ts").alias("at"), "text").collect()
    assert sorted(tuple(r) for r in got) == brute_settled(edits)


def test_debounced_analysis(spark, tmp_path):
    rows = [(1, 0, "Summarize the re"), (1, 50_000, "Summarize the report"), (2, 10**9, "later")]
    spark.createDataFrame(rows, "prompt_id long, at long, text string").select("prompt_id", F.timestamp_micros("at").alias("ts"), "text").coalesce(1).write.parquet(str(tmp_path / "in"))
    stood = live.debounce(spark.readStream.schema(EDITS).parquet(str(tmp_path / "in")))
    guard.start(stood, str(tmp_path / "cp"), live.analysing_sink(str(tmp_path / "out"))).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["prompt_id"], r["task_type"]) for r in got] == [(1, "summarize")]


def payload(pieces):
    lines = ["event: x", "", ": note", "data: {oops"]
    lines += [f"data: {json.dumps({'choices': [{'delta': {'content': p}}]}, ensure_ascii=False)}" for p in pieces]
    return "\r\n".join([*lines, 'data: {"choices": []}', "data: [DONE]", ""]) + "\n"


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_sse_source(spark, tmp_path, chunk):
    """Captures cut anywhere, even within a character, that grow between two runs: each line once, the same text as of whole payloads."""
    rng = random.Random(chunk)
    texts = {f"r{i}.sse": ["".join(rng.choice("añ中😀 \n\"x") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 8))] for i in range(5)}
    whole = {name: payload(p).encode() for name, p in texts.items()}
    folder = tmp_path / "in"
    folder.mkdir()
    start = lambda: sse.deltas(sse.captures(spark, str(folder), chunk))
    done = dict.fromkeys(whole, 0)
    for share in (0.3, 0.8, 1.0):
        for name, raw in whole.items():
            upto = int(len(raw) * share)
            with (folder / name).open("ab") as f:
                f.write(raw[done[name] : upto])
            done[name] = upto
        run(start(), str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len({(r["stream"], r["at"]) for r in rows}) == len(rows)
    got = {n: "".join(r["text"] for r in sorted((r for r in rows if r["stream"] == n), key=lambda r: r["at"])) for n in whole}
    assert got == {n: "".join(p) for n, p in texts.items()}
    at_once = spark.createDataFrame([(n, raw.decode()) for n, raw in whole.items()], "stream string, payload string").select("stream", library.sse_text().alias("text"))
    assert got == {r["stream"]: r["text"] for r in at_once.collect()}


def test_sse_replay():
    """The same offsets give the same ranges; a file's range is cut into chunks."""
    reader = sse.CaptureReader("/nowhere", 10)
    ranges = [(r.name, r.start, r.end) for r in reader.partitions({"a": 5}, {"a": 27, "b": 3})]
    assert ranges == [("a", 5, 15), ("a", 15, 25), ("a", 25, 27), ("b", 0, 3)]
    assert reader.latestOffset() == {} == reader.initialOffset()


def test_call_ledger(spark, tmp_path):
    """Each distinct pair is asked once, over duplicates, a second run and new cells; failed calls are tried again and not kept."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def chat(model, prompt):
        import os
        import uuid

        with open(f"{calls}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{model}|{prompt}")
        if prompt == "bad" or prompt == "flaky" and sum(open(f"{calls}/{x}").read().endswith("flaky") for x in os.listdir(calls)) < 2:
            raise RuntimeError("no answer")
        return {"content": f"{model} says {prompt}", "prompt_tokens": None, "completion_tokens": 3, "latency_ms": 5.0}

    def asked():
        return sorted(f.read_text() for f in calls.iterdir())

    def grid(*prompts):
        rows = [(i, 0, m, "c", p) for i, p in enumerate(prompts) for m in ("a", "b")]
        return spark.createDataFrame(rows, "prompt_id long, idx int, model string, case_id string, prompt string")

    ledger = evaluate.CallLedger(spark, str(tmp_path / "ledger"))
    first = grid(*["same"] * 40, "one", None)
    got = ledger.outputs(first, chat, wait=0.01)
    assert got.count() == 82 and {r["content"] for r in got.where("prompt_id = 7").collect()} == {"a says same", "b says same"}
    assert asked() == ["a|one", "a|same", "b|one", "b|same"]
    assert set(got.columns) == {"prompt_id", "idx", "model", "case_id", "content", "prompt_tokens", "completion_tokens", "latency_ms"}
    again = evaluate.CallLedger(spark, str(tmp_path / "ledger")).outputs(grid("one", "same", "two"), chat, wait=0.01)
    assert again.count() == 6 and len(asked()) == 6
    bad = ledger.outputs(grid("bad", "flaky").where("model = 'a'"), chat, attempts=2, wait=0.01)
    assert [r["content"] for r in bad.collect()] == ["a says flaky"] and len(asked()) == 10
    ledger.outputs(grid("bad").where("model = 'a'"), chat, attempts=1)
    assert len(asked()) == 11 and ledger.answers().count() == 7


def table_diff(old, new):
    n, m = len(old), len(new)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if old[i] == new[j] else max(t[i + 1][j], t[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if old[i] == new[j]:
            out.append(("eq", old[i]))
            i, j = i + 1, j + 1
        elif t[i + 1][j] >= t[i][j + 1]:
            out.append(("del", old[i]))
            i += 1
        else:
            out.append(("ins", new[j]))
            j += 1
    return out + [("del", s) for s in old[i:]] + [("ins", s) for s in new[j:]]


def test_diff_is_the_tables(spark):
    rng = random.Random(1)
    for _ in range(400):
        old, new = ([rng.choice("abcde"[: rng.randrange(1, 6)]) for _ in range(rng.randrange(0, 30))] for _ in range(2))
        if rng.random() < 0.5:
            new = [x for x in old if rng.random() > 0.2] + new[:3]
        assert compare.diff_lines(old, new) == table_diff(old, new), (old, new)


def test_diff_of_long_texts():
    """Six thousand lines each way, whose whole table would take a hundred megabytes."""
    import tracemalloc

    rng = random.Random(2)
    old = [str(rng.randrange(5000)) for _ in range(6000)]
    new = [x for x in old if rng.random() > 0.3] + ["z"] * 50
    new[100:100] = old[:40]
    tracemalloc.start()
    ops = compare.diff_lines(old, new)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [t for o, t in ops if o != "ins"] == old and [t for o, t in ops if o != "del"] == new
    assert most < 30e6 < 4 * len(old) * len(new)
