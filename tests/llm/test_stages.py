"""Stages with extra columns named like everything that the operators use inside, and exact search over numbers of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from promptloom.llm import knn, licences

INNER = [
    "_gone", "_key", "_id", "_text", "_gone_id", "_gone_sha", "_sha", "_twice", "row", "rid", "sig", "top_rid", "stays", "n", "_s", "_h", "_row", "_t", "_b", "_n", "_r", "_o", "_c0",
    "_g0", "c0", "window", "key", "tie", "part", "ids", "digest", "row_id", "chars", "keep_id", "seen", "kept", "text_sha256", "text_key", "held_out", "score", "predicted", "node", "component",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    good = "It was a fair day and the people of the town went out to the fields to see what had grown there in the night number {}."
    texts = [good.format(i % 40) * (1 + i % 3) for i in range(90)] + ["x9 zz!! $$ 00" * (1 + i % 4) for i in range(40)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 90), 0) for i in range(130)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_clashing_names(spark, tables, stage):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    odd = docs.withColumns({c: F.concat(F.lit("x"), F.col("doc_id").cast("string")) for c in INNER})
    run = dict(corpus_pipeline.STAGES)[stage]
    plain, got = run(spark, docs, tables), run(spark, odd, tables)
    if stage == "pack":
        assert got.count() == plain.count() > 0
        return
    assert got.columns == odd.columns
    found = got.select("doc_id", "_gone", "row").collect()
    assert sorted(r["doc_id"] for r in found) == sorted(r["doc_id"] for r in plain.collect())
    assert all(r["_gone"] == r["row"] == f"x{r['doc_id']}" for r in found)


def brute(rows, queries, k=5, most=(1 << 63) - 1):
    whole = {i: [int(np.floor(x * 256)) for x in v] for i, v in rows}
    out = []
    for q in queries:
        met = sorted((-max(-most, min(most, sum(a * b for a, b in zip(whole[q], w, strict=True)))), i) for i, w in whole.items() if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(met)]
    return sorted(out)


@pytest.mark.parametrize("large", [1e5, 1e60, 1e154, 1e160, 1e300])
def test_knn_of_large_numbers(spark, large):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * (large if i % 7 == 0 else 1)).tolist()) for i in range(400)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = knn.top_k(data, data.where("vec_id % 50 = 0"))
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute(rows, [i for i, _ in rows if i % 50 == 0])


def test_licence_lines_and_directories(spark):
    """Identifier lines, notices that point to a file, and inheritance along the directories of URLs."""
    mit = "\n".join(licences.TEXTS["MIT"])
    code = "\nint main(void) { return 0; } " * 20
    rows = [
        (1, "https://a.org/x/LICENSE?v=1", mit), (2, "https://a.org/x/y/z.c#top", code), (3, "https://a.org/w.c", code), (4, "https://a.org/x/q.c", "// SPDX-License-Identifier: Apache-2.0" + code),
        (5, "https://a.org/x/r.c", "# SPDX-License-Identifier: GPL-2.0-or-later" + code), (6, "https://b.org/s.go", "// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file." + code),
        (7, "https://b.org/t.c", "// SPDX-License-Identifier: Unheard-Of-1.0" + code), (8, None, code),
    ]
    got = {r["doc_id"]: (r["licence"], r["basis"], r["from_dir"]) for r in licences.scan_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {
        1: ("MIT", "file", None), 2: ("MIT", "inherited", "a.org/x"), 3: (None, "none", None), 4: ("Apache-2.0", "header", None),
        5: ("GPL-2.0", "header", None), 6: ("BSD-3-Clause", "header", None), 7: (None, "none", None), 8: (None, "none", None),
    }
