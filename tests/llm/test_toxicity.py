"""What few rows show is learned whatever the number of rows, and 0.5 parts the classes on rows that were not learned from."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from rxweave.llm import toxicity


def test_rare_words_among_many_rows(spark):
    random.seed(2)
    filler = lambda n: " ".join(f"f{random.randrange(400)}" for _ in range(n))
    rows = [(i, filler(12), 0) for i in range(12_000)]
    rows += [(12_000 + i, f"{filler(6)} bad{i % 200} {filler(6)}", 1) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df)
    fresh = spark.createDataFrame([(i, f"{filler(6)} bad{i} {filler(6)}") for i in range(200)] + [(200 + i, filler(12)) for i in range(1000)], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.scores(fresh, model).collect()}
    found = sum(score[i] >= 0.5 for i in range(200))
    assert found >= 160 and sum(score[i] >= 0.5 for i in range(200, 1200)) <= 20


def test_calibration_parts_the_classes():
    random.seed(3)
    toxic = np.array([1] * 40 + [0] * 300)
    margin = np.where(toxic == 1, -6.0, -9.0) + np.array([random.uniform(-1, 1) for _ in toxic])
    scale, shift = toxicity.calibration(margin, toxic)
    assert scale > 0 and ((scale * margin + shift >= 0) == (toxic == 1)).all()


def test_memory_of_the_learning_task_does_not_grow_with_its_rows(tmp_path, monkeypatch):
    """Eight times the rows over the same words: the task holds what it holds for each word, not the features of all rows."""
    monkeypatch.setattr(toxicity, "ROUNDS", 1)
    monkeypatch.setattr(toxicity, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng, peaks = np.random.default_rng(4), []
    for rows in (500, 4000):
        texts = [" ".join(map(str, rng.integers(0, 300, 2500))) for _ in range(rows)]
        made = pa.RecordBatch.from_pydict({"text": texts, "toxic": pa.array([i % 2 for i in range(rows)], pa.int32()), "place": pa.array(range(rows), pa.int64())})
        files = list(toxicity._features(f"file://{tmp_path}/{rows}")(iter([made])))
        tracemalloc.start()
        list(toxicity._learn(iter(files)))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] - peaks[0] < 16e6
