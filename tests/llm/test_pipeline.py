"""The pipeline's stages against plain versions of what each decides. Near duplicates go by five words and similarity 0.8."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from samplewell.llm import bpe
from test_operators import brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append({r["doc_id"]: r for r in docs.collect()})
        assert k == 4 or docs.columns == corpus_pipeline.COLUMNS
    return out


def test_each_stage(spark, results):
    language, near, clean, masked, encoded = results
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(language) > 0.98 * len(docs)
    components = brute_components([(i, r["text"]) for i, r in language.items()], 5, 80)
    assert set(near) == {i for i, (_, c) in components.items() if c == i}
    items = [" ".join(re.findall(r"[^\W_]+", r["text"].lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {i for i, r in near.items() if any(x in " ".join(re.findall(r"[^\W_]+", r["text"].lower())) for x in items)}
    assert set(clean) == set(near) - holds and holds
    assert set(masked) == set(clean) and all(len(masked[i]["text"]) == len(clean[i]["text"]) for i in masked)
    changed = [i for i in masked if masked[i]["text"] != clean[i]["text"]]
    assert changed and all(re.search(r"AKIA|(?i:password|passwd|secret|token|api_?key)|[0-9a-f]{16}", clean[i]["text"]) or "*" in masked[i]["text"] for i in changed)
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(bpe.default_path())
    assert all(list(encoded[i]["ids"]) == lib.encode(masked[i]["text"], add_special_tokens=False).ids for i in masked)


def test_near_duplicates_of_five_words_at_four_fifths(spark):
    words = [f"w{i}" for i in range(100)]
    changed = [w if i not in (20, 60) else "other" for i, w in enumerate(words)]  # 5 words: 86 of 106; 3 words: 92 of 104, below 0.9
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words[::-1]))]
    rows = [(i, t, "en", f"s{i}", len(t)) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == {1, 3}


def test_odd_rows(spark, odd, none):
    rows = odd.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows, SF).count() <= rows.count() and stage(spark, none.select(*corpus_pipeline.COLUMNS), SF).count() == 0
    kept = sorted(str(r["doc_id"]) for r in corpus_pipeline.near_duplicates(spark, rows, SF).collect())
    assert kept == sorted(["1", "3", "4", "5", "6", "7", "8", "9", "10", "None"])  # 2, twice, and a row without an id copy 1; 10 differs in every place of a word; the row without id and text has nothing to be linked by


def test_rows_are_judged_and_not_ids(spark):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), " ".join(words[::-1])
    rows = [(1, a), (1, a), (2, a), (2, b), (None, b), (None, "token=Real9876543210ZyxwKey of nobody")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("1", a), ("2", b), ("None", rows[-1][1])]
    masked = [r["text"] for r in corpus_pipeline.secret_scan(spark, kept, SF).collect()]
    assert "*" * 27 + " of nobody" in masked and len(masked) == 3
    item = " ".join(next(t for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(t := r["text"].split()) > 10))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in ((1, a), (1, item), (None, item), (None, b))], docs.schema)
    assert sorted((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.benchmarks(spark, docs, SF).collect()) == [("1", a), ("None", b)]


def test_run_leaves_its_last_table_only(spark, tmp_path):
    import os

    from samplewell.llm import shared

    folder = shared.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    left = {x for x in set(os.listdir(folder)) - before if not x.startswith("rdd-")}  # checkpoints are the session's cleaner's
    assert len(left) == 1 and os.listdir(f"{folder}/{left.pop()}") == ["4-bpe_encoding"]
