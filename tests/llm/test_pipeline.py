"""The pipeline's stages against plain definitions, each on what its predecessor kept."""

import zlib

import brute
import corpus_pipeline
from test_similar import components
from tokenizers import Tokenizer

from rxweave.llm import mixing, tokens, toxicity

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    clean = stages["toxicity"](spark, docs, DATA).cache()
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scores = toxicity.scores(docs, toxicity.fit(toxicity.labelled_rows(docs, labels)))
    assert clean.columns == columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in scores.collect() if r.score < 0.5}

    single = stages["near_duplicates"](spark, clean, DATA).cache()
    assert single.columns == columns
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(components({r.doc_id: r.text for r in clean.collect()}).values()))

    fresh = stages["decontamination"](spark, single, DATA).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    found = brute.contamination([(r.doc_id, r.text) for r in single.collect()], items)
    assert fresh.columns == columns
    assert sorted(r.doc_id for r in fresh.collect()) == sorted(k for k, v in found.items() if not v[-1])

    mixed = stages["mixing"](spark, fresh, DATA).cache()
    sized = mixing.sizes(fresh, mixing.SEED)
    copies = {r.doc_id: r.copies for r in mixing.with_copies(sized, mixing.plan(sized)).collect()}
    taken = sorted(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and taken == sorted(i for i, n in copies.items() for _ in range(n))

    plain, start = Tokenizer.from_file(tokens.vocabulary_path()), 0
    texts = {r.doc_id: r.text for r in fresh.collect()}
    got = sorted(stages["token_ids"](spark, mixed, DATA).collect(), key=lambda r: r.start)
    for r, i in zip(got, taken, strict=True):
        ids = [*plain.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        start += len(ids)
