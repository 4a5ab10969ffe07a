"""The pipeline, stage by stage, against plain versions of its steps."""

import hashlib
import subprocess
import sys

from conftest import ROOT, SF
from test_llm_operators import PATH, PATTERN, plain_classes, plain_print

import corpus_pipeline
from veilframe.llm import bpe, quality_gam
from veilframe.llm.positional_index import words as terms

SF1 = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    names = docs.columns
    good = corpus_pipeline.quality(spark, docs, SF1)
    model = quality_gam.train(docs, spark.read.parquet(f"{SF1}/labels.parquet"))
    rows = docs.collect()
    scores = model.score(quality_gam.features([r["text"].encode() for r in rows]))
    assert good.columns == names and {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r, s in zip(rows, scores) if s >= 0.7}
    lines = corpus_pipeline.line_dedup(spark, good, SF1)
    assert lines.columns == names and lines.count() == good.count()
    got = lines.collect()
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    once = corpus_pipeline.near_dedup(spark, lines, SF1)
    ids = [r["doc_id"] for r in got]
    want = {c for c in plain_classes(ids, [plain_print(r["text"]) for r in got])}
    assert once.columns == names and {r["doc_id"] for r in once.collect()} == want
    clean = corpus_pipeline.decontaminate(spark, once, SF1)
    windows = set()
    for r in spark.read.parquet(f"{SF1}/benchmark.parquet").collect():
        w = terms(r["text"].encode())
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))}
    kept = set()
    for r in once.collect():
        w = terms(r["text"].encode())
        hit = {i + k for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for k in range(n)}
        if not hit or 20 * len(hit) < len(w):
            kept.add(r["doc_id"])
    assert clean.columns == names and {r["doc_id"] for r in clean.collect()} == kept
    codec = bpe.Codec(PATH, PATTERN)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in corpus_pipeline.tokens(spark, clean, SF1).collect():
        assert r["decoded_sha256"] == hashlib.sha256(texts.pop(r["doc_id"]).encode()).hexdigest()
        assert r["n_tokens"] > 0
    assert not texts and codec


def test_run_has_the_rows_of_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def test_entry_works_without_the_text_operators():
    code = (
        "import sys; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and len(e.queries()) > 80 and set(e.oracle_sql()) <= set(e.queries())"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


CLASHES = "key string, r string, own string, score double, held_out int, n_tokens int, component_id int, `a.b` string"


def odd_folder(spark, tmp_path, rows, n_chars=True):
    """Documents with columns that clash with those of the operators, beside the given labels and benchmark."""
    schema = "doc_id long, text string, lang string, source string, " + ("n_chars long, " if n_chars else "") + CLASHES
    full = [(k, t, None, s, *([None] if n_chars else []), "x", "r", "o", 0.1, 2, 3, 4, "y") for k, t, s in rows]
    spark.createDataFrame(full, schema).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_odd_rows_run_through(spark, tmp_path):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").limit(60).collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = given + [(None, None, None), (900, None, "s"), (901, "", "s"), (901, "", "s"), (902, item, None), given[0], given[0], (903, given[1][1], "other"), (904, "word " * 20_000, "s")]
    folder = odd_folder(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, folder), name)
        assert docs.columns == names and docs.count() <= before.count(), name
    assert docs.where("doc_id = 902").count() == 0
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.collect())
    left = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(left[r["doc_id"]].encode()).hexdigest() for r in rows)


def test_an_empty_table_and_one_without_n_chars(spark, tmp_path):
    assert corpus_pipeline.run(spark, odd_folder(spark, tmp_path / "a", [])).count() == 0
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").limit(20).collect()]
    assert corpus_pipeline.run(spark, odd_folder(spark, tmp_path / "b", given, n_chars=False)).count() > 0
