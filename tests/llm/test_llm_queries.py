"""Every query of the subpackage against its SQL or by its row counts, and the pipeline's stages."""

import pytest

import corpus_pipeline
from finsieve.llm.queries import ORACLES, QUERIES
from finsieve.plans.checks import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    pytest.importorskip("duckdb")
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) is None


def test_one_query_each():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op1_language_id", "op3_toxicity", "op8_html_extraction"])
def test_a_row_each(spark, sf_dir, name):
    source = "pages" if name == "op8_html_extraction" else "documents"
    assert QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{source}.parquet").count()


def test_pipeline(spark):
    key = "3f9a6c01d2b84e7755aa10cd9be2f7013c4d5e6f"
    words = [f"the{i} and with" for i in range(30)]
    long = " ".join(words)
    rows = [
        (1, long, "en", "s", len(long)),
        (2, long.replace(" ", "  "), "en", "s", 0),
        (3, long + " end", None, "s", 0),
        (4, "12 34", "en", "s", 5),
        (5, None, None, None, None),
        (6, f'here is the token = "{key}" of it', "en", "s", 10),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, "")
        seen.append(sorted({r["doc_id"] for r in after.collect()}))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        docs = after
        if name == "secret scans":
            assert [r["text"] for r in after.filter("doc_id = 6").collect()] == ['here is the token = "[SECRET]" of it']
    assert seen == [[1, 2, 3, 6], [2, 3, 6], [2, 6], [2, 6], [2, 6]]


def test_pipeline_without_rows_and_with_clashing_names(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, _secrets string, _text_hash string"
    docs = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name != "exact dedup":
            assert stage(spark, docs, "").columns == docs.columns and stage(spark, docs, "").count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0
    key = "3f9a6c01d2b84e7755aa10cd9be2f7013c4d5e6f"
    rows = [(1, f'the token = "{key}" of it', "en", "s", 9, "a", "b", "c"), (None, None, None, None, None, "d", "e", "f")]
    after = corpus_pipeline.redact_secrets(spark, spark.createDataFrame(rows, schema), "").collect()
    assert sorted((tuple(r) for r in after), key=repr) == sorted([(1, 'the token = "[SECRET]" of it', "en", "s", 28, "a", "b", "c"), rows[1]], key=repr)
