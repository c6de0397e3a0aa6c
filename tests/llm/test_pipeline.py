"""Each stage against brute force over its own input, and the run against the stages."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tamis.llm import secrets, tables, token_ids
from tamis.llm.queries import TOKENIZER
from tamis.llm.tables import table
from tests.llm.test_contracts import check_packing, contamination, spans
from tests.llm.test_near_copies import kept

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, data, rows):
    inputs, docs = {}, table(spark, data, "documents")
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = {r["doc_id"]: r.asDict() for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, data).collect(), stage(spark, docs, data).schema)
    packed = [r.asDict() for r in docs.collect()]
    for found in list(inputs.values()):
        assert all(list(d) == COLUMNS for d in found.values())

    # language: clean prose stays, what goes has no letters or is far from all
    gone = inputs["language"].keys() - inputs["near_duplicates"].keys()
    assert len(gone) <= 0.02 * len(inputs["language"])

    first, _ = kept([(i, d["text"]) for i, d in inputs["near_duplicates"].items()])
    assert inputs["benchmarks"].keys() == first

    items = [(b["item_id"], b["text"]) for b in rows("benchmark")]
    found = contamination([(i, d["text"]) for i, d in inputs["benchmarks"].items()], items)
    assert inputs["secrets"].keys() == {r[0] for r in found if not r[-1]}

    assert inputs["packing"].keys() == inputs["secrets"].keys()
    for i, d in inputs["secrets"].items():
        after = inputs["packing"][i]
        assert not spans(after["text"], secrets.RULES) and after["n_chars"] == len(after["text"])
        if not spans(d["text"], secrets.RULES):
            assert after == d
    used, least = check_packing(packed, inputs["packing"].values())
    assert used <= least + 1


def test_run(spark, data):
    found = corpus_pipeline.run(spark, data)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert 0 < found.select("doc_id").distinct().count() < table(spark, data, "documents").count()


def test_empty_documents(spark, data, tmp_path):
    for name in ("documents", "benchmark"):
        table(spark, data, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_and_odd_rows(spark, data, rows):
    """What operators add takes no column of the documents away."""
    prose = [r for r in rows("documents") if r["n_chars"] > 500][:40]
    names = "doc_id long, text string, lang string, n_chars long, score double, rejected string, lang_pred string, n_words string, n_hit string, secrets string, contaminated string, row string"
    make = lambda i, t, lang: (i, t, lang, len(t or ""), 7.5, "r", "p", "mine", "h", "s", "c", "k")
    odd = [make(r["doc_id"], r["text"], r["lang"]) for r in prose] + [make(None, None, None), make(None, "", "en"), make(10**6, prose[0]["text"] + " token = abcdefgh", "en")]
    odd += [odd[3], make(None, odd[5][1], None)]
    docs = spark.createDataFrame(odd, names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, data)
        assert found.columns == docs.columns
        kept_rows = found.collect()
        assert kept_rows and all(r["score"] == 7.5 and r["n_words"] == "mine" and r["secrets"] == "s" for r in kept_rows)
        docs = spark.createDataFrame(kept_rows, names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() >= len(kept_rows)


def test_texts_reach_python_in_small_batches(spark, data):
    text = F.repeat(F.lit("some words "), 40_000)
    docs = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))
    dict(corpus_pipeline.STAGES)["benchmarks"](spark, docs, data)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]})

    found = docs.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in found) == 40
    assert max(r.size for r in found) < corpus_pipeline.BATCH_BYTES + (1 << 20)


def test_a_limit_of_the_session_stays(spark, data):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1234567")
    try:
        dict(corpus_pipeline.STAGES)["benchmarks"](spark, table(spark, data, "documents"), data)
        assert spark.conf.get(key) == "1234567"
    finally:
        spark.conf.set(key, before)


def test_a_worker_keeps_the_encoder_while_its_tasks_encode():
    def encodes():
        return token_ids.encoder(TOKENIZER)

    first = tables.begun(encodes)
    assert tables.begun(encodes) is first
    tables.begun(lambda: None)
    assert tables.begun(encodes) is not first
