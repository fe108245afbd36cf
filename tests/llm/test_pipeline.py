"""The pipeline over a small corpus with planted cases, stage by stage."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r, folder = random.Random(11), tmp_path_factory.mktemp("corpus")
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("ra", "lo", "ti", "nk", "s", "")]
    prose = lambda n: [r.choice(words) for _ in range(n)]
    passage, item, rows, labels, kind = prose(60), prose(36), [], [], {}

    def put(text, what):
        kind[len(rows)] = what
        rows.append((len(rows), text, "en", "src", len(text) if text else None))

    for _ in range(60):
        put(" ".join(prose(r.randint(80, 200))), "clean")
    for i in range(120):  # half of them to learn from, half planted
        body = prose(90)
        for _ in range(3):
            body.insert(r.randrange(90), r.choice(["vile", "rotten", "filthy"]))
        put(" ".join(body), "toxic")
    for i in range(10):
        copy = rows[i][1].split(" ")
        if i % 2:
            copy[r.randrange(len(copy))] = "edited"
        put(" ".join(copy), "copy")
    for _ in range(8):
        put(" ".join(prose(50) + passage + prose(50)), "passage")
    for i in range(6):
        parts = item if i % 2 else item[20:] + prose(30) + item[:20]
        put(" ".join(prose(60) + parts + prose(60)), "leak")
    put(None, "null")
    put("", "empty")
    rows.append(rows[3])
    for i, what in kind.items():
        if what in ("clean", "toxic"):
            labels.append((i, 1, int(what == "toxic")))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, " ".join(item)), (1, " ".join(prose(30)))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), kind, " ".join(passage)


def test_stages(spark, tables):
    folder, kind, passage = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.schema
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeated_passages", "leaks", "packing"]
    of = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    kinds = lambda *names: sorted(i for i, k in kind.items() if k in names)
    step = dict(corpus_pipeline.STAGES)

    clean = corpus_pipeline.staged(step["toxicity"](spark, docs, folder), "t1")
    assert clean.schema == columns
    left = of(clean)
    assert sum(i in left for i in kinds("toxic")) <= 6 and len(set(kinds("clean", "copy", "passage", "leak", "null")) - set(left)) <= 2
    kinds = lambda *names: sorted(i for i, k in kind.items() if k in names and i in left)

    single = corpus_pipeline.staged(step["near_copies"](spark, clean, folder), "t2")
    assert single.schema == columns and len(of(single)) == len(set(of(single)))
    assert set(of(single)) & set(kinds("copy")) == set() and set(kinds("clean", "passage", "leak")) <= set(of(single))

    cut = corpus_pipeline.staged(step["repeated_passages"](spark, single, folder), "t3")
    assert cut.schema == columns and of(cut) == of(single)
    held = [r.doc_id for r in cut.where(F.contains("text", F.lit(passage))).collect()]
    assert held == [min(kinds("passage"))]
    assert all(r.n_chars == len(r.text) for r in cut.collect() if r.text is not None)
    before = {r.doc_id: r.text for r in single.collect()}
    assert all(r.text == before[r.doc_id] for r in cut.collect() if kind[r.doc_id] == "clean")

    safe = corpus_pipeline.staged(step["leaks"](spark, cut, folder), "t4")
    assert safe.schema == columns and set(of(safe)) & set(kinds("leak")) <= set(kinds("leak")[1:]) and set(kinds("clean", "passage", "null")) <= set(of(safe))

    packed = step["packing"](spark, safe, folder).collect()
    assert {r.doc_id for r in packed} == set(of(safe))


def test_run_and_empty_tables(spark, tables, tmp_path):
    folder, kind, _ = tables
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {kind[r.doc_id] for r in rows} >= {"clean", "passage"} and all(r.doc_tokens >= 1 for r in rows)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
