"""Real candidates through the whole evaluation, against the same steps by hand."""

import hashlib
import re


from promptloom.operators import chain, evaluate, memory, optimize


def test_evaluation_of_real_candidates(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def chat(model, prompt):
        import uuid

        (calls / uuid.uuid4().hex).write_text(f"{model}|{prompt}")
        words = len(prompt.split())
        return {"content": '{"answer": 1}' if words % (2 if model == "a" else 3) else "sorry", "prompt_tokens": 10, "completion_tokens": 5, "latency_ms": 100.0}

    texts = [
        "Please could you summarize the very long report for the board, and make sure to cite all of the sources in it. Please do. You must never invent data.",
        "In order to help, translate this text for {reader}. Translate this text for {reader}. Keep all numbers. You must not change names, please.",
        "hi there", "hi there", None,
    ]
    prompts = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "prompt_id long, text string")
    models = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, 1.0)], "model string, prompt_usd double, completion_usd double")
    cases = spark.createDataFrame([("c0", "first"), ("c1", "the second input")], "case_id string, input string")
    checks = spark.createDataFrame([("c0", "json_valid", None, None), ("c1", "regex", "answer", None), ("c1", "regex", "(unclosed", None)], "case_id string, kind string, arg string, n long")
    ledger = evaluate.CallLedger(spark, str(tmp_path / "ledger"))
    graded, scored = chain.measured(prompts, models, cases, checks, chat, ledger)
    rows = scored.orderBy("prompt_id", "rank").collect()
    real = {(r["prompt_id"], r["idx"]): r for r in optimize.listed(optimize.judged(optimize.gathered(prompts))).where("text is not null").collect()}
    assert {(r["prompt_id"], r["idx"]) for r in rows} == set(real) and all(r["text"] == real[r["prompt_id"], r["idx"]]["text"] for r in rows)
    assert len({p for p, i in real if i > 0}) >= 2  # there are variants
    # every distinct prompt on the frontier once per model, though two of the prompts are the same
    frontier = [r for r in real.values() if r["on_frontier"]]
    hole = re.compile(r"\{[A-Za-z_]+\}")
    fill = lambda text, x: hole.sub(x, text, count=1) if hole.search(text) else f"{text}\n\nInput:\n{x}"
    wanted = {f"{m}|{fill(r['text'], x)}" for r in frontier for m in "ab" for x in ("first", "the second input")}
    asked = [f.read_text() for f in calls.iterdir()]
    assert set(asked) == wanted and len(asked) == len(wanted)
    for r in rows:
        cells = [len(fill(r["text"], x).split()) % (2 if m == "a" else 3) > 0 and c == "c0" for m in "ab" for c, x in (("c0", "first"), ("c1", "the second input"))]
        on = real[r["prompt_id"], r["idx"]]["on_frontier"]
        assert r["accuracy"] == (sum(cells) / 4 if on else 0)  # the case with a broken pattern never passes
    assert graded.count() == 4 * len(frontier)
    known = memory.TableBackend(spark, str(tmp_path / "memory"))
    chain.remember(scored, known)
    chain.remember(scored, known)
    won = {hashlib.sha256(r["text"].encode()).hexdigest(): r for r in rows if r["rank"] == 1}
    kept = {r["id"]: r for r in known.all().collect()}
    assert set(kept) == set(won) and all(kept[i]["accepted"] == (won[i]["accuracy"] >= memory.ACCEPT_ACCURACY) for i in won)
    again = chain.measured(prompts, models, cases, checks, chat, ledger, frontier_only=False)[0]
    assert again.count() == 4 * len(real) and len(list(calls.iterdir())) == len({f"{m}|{fill(r['text'], x)}" for r in real.values() for m in "ab" for x in ("first", "the second input")})
