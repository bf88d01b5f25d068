"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing names, for all ten operators and five stages."""

import corpus_pipeline
import pytest

from rxweave.llm import decontaminate, mixing, pii, quality, repeats, secrets, simhash, tokens, toxicity, warc

#: Some 2 million characters; with ten times as many the tests pass as well, but take minutes.
LONG = "one long text of many words and then some more " * 42_000
NAMES = "hit string, items string, sha string, hit_id string, facts string, rx_hash string, mix_copy string, own_hash string, copy string, path string, start long, prefix string, key string"
FIELDS = NAMES.count(",") + 1
BLANK = (None,) * FIELDS


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "a few words that stand here and there, ten or more of them", "s"), (1, "a few words that stand here and there, ten or more of them", "s"), (2, "a few words that stand here and there, ten or more of them", None)]
    rows += [(None, None, None), (None, "", "s"), (None, "some text without a number of its own", "t"), (5, " \n\t ", "t"), (6, LONG, "u")]
    return spark.createDataFrame([(*r, *BLANK) for r in rows], f"doc_id long, text string, source string, {NAMES}").repartition(4).cache()


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('edges')}"
    spark.createDataFrame([(1, 1, 0), (None, None, None), (6, 0, 0), (6, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "words that stand here and there ten or more of them"), (None, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def operators(spark, docs, folder):
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    model = toxicity.fit(toxicity.labelled_rows(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    yield "simhash", simhash.near_duplicates(docs), True
    yield "personal data", pii.personal_data(docs), True
    yield "quality", quality.clean_lines(quality.statistics(docs)), True
    yield "repeats", repeats.remove_repeats(docs).drop("kept"), True
    sized = mixing.sizes(docs, 1)
    yield "mixing", mixing.with_copies(sized, mixing.plan(sized)), True
    yield "toxicity", toxicity.scores(docs, model), True
    yield "contamination", decontaminate.contamination(docs, benchmark), True
    yield "tokens", tokens.tokenize(docs), True
    yield "secrets", secrets.scan(docs, secrets.train(secrets.labelled_findings(spark, 400)), "path"), False


def test_operators(spark, docs, folder):
    for name, found, every in operators(spark, docs, folder):
        rows = found.drop("clean_text", "text").collect()
        assert not every or len(rows) == docs.count(), name
    hit = {r.doc_id: r.contaminated for r in decontaminate.contamination(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert hit[1] and hit[2] and not hit[6]
    kept = decontaminate.contamination(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert kept.columns[: len(docs.columns)] == docs.columns and quality.statistics(docs).columns[: len(docs.columns)] == docs.columns


def test_empty_tables(spark, docs, folder):
    for name, found, _ in operators(spark, docs.limit(0), folder):
        assert found.count() == 0, name


def test_pages(spark, tmp_path):
    pages = spark.createDataFrame([(None, None, None, "x"), (1, None, "", None), (2, "u", LONG, "y"), (3, "u", LONG, "y"), (3, "u", LONG, "y")], "page_id long, url string, html string, sha1 string")
    got = warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/w")).collect()
    assert sorted((r.page_id or 0, r.record_type) for r in got) == [(0, "response"), (1, "response"), (2, "revisit"), (3, "response"), (3, "response")]


def test_stages(spark, docs, folder):
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, kept, folder)
        assert name == "token_ids" or after.columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        kept = after.cache()
        assert kept.count() > 0, name


def test_run(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and {r.doc_id for r in rows} <= {None, 1, 2, 5, 6}
