"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, of their first letters, of neighbouring words and of words one or two
apart.  FTRL-proximal keeps a sum of gradients and of their squares for each hash: rates fall per coordinate, and the L1
term holds weights at exactly zero until evidence exceeds it, so the model is a short list of (hash, weight).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_folder, lean_memory, scratch, table, trim_memory
from .files import open_file, write_file
from .rolling import Rolling, mixed

BITS = 24
#: Labelled rows that a model is fitted on at most (as expected: rows are chosen by hash).
FIT_ROWS = 24_000
ROUNDS = 8
#: One in so many rows is kept for the calibration, if there are so many of each class among them.
FOLDS, LEAST_HELD = 5, 10
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.0
STEM = 5
#: Texts are joined up to so many bytes before they are cut into words together.
AT_ONCE = 1 << 20
#: Rows of a task that hashes features, rows of a file of features, and features or numbers that are looked at together.
ROWS_A_TASK, ROWS_A_FILE, COUNTED = 1000, 250, 1_000_000
#: Texts that are scored at a time.
TEXTS_AT_ONCE = 500
WORD_BYTE = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


class Hasher:
    """Distinct features of whole texts: (place of the text, hash), ordered by both."""

    def __init__(self):
        self.rolling = Rolling()

    def _one(self, texts: list[bytes], first: int) -> np.ndarray:
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        inside = WORD_BYTE[data].astype(np.int8)
        edges = np.diff(inside, prepend=np.int8(0))
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.rolling.load(data)
        of = self.rolling.of
        words = of(begin, end)
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1]))
        text = np.searchsorted(starts, begin, "right") - 1
        found = [(text, words), (text, mixed(of(begin, np.minimum(end, begin + STEM)) + np.uint64(7)))]
        for gap in (1, 2, 3):
            near = text[gap:] == text[:-gap]
            found.append((text[gap:][near], mixed(words[:-gap][near] * np.uint64(2 * gap + 1) + words[gap:][near])))
        both = [np.uint64(first) + t.astype(np.uint64) << np.uint64(BITS) | h >> np.uint64(64 - BITS) for t, h in found]
        return np.concatenate(both)

    def __call__(self, texts: list[str | None], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """keep: by hash, whether the feature is wanted."""
        out, i = [], 0
        encoded = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
        while i < len(encoded):
            j, size = i, 0
            while j < len(encoded) and (j == i or size + len(encoded[j]) <= AT_ONCE):
                size += len(encoded[j])
                j += 1
            both = self._one(encoded[i:j], i)
            if keep is not None:
                both = both[keep[both & np.uint64((1 << BITS) - 1)]]
            out.append(np.unique(both))
            i = j
        both = np.concatenate(out) if out else np.zeros(0, np.uint64)
        return (both >> np.uint64(BITS)).astype(np.int64), (both & np.uint64((1 << BITS) - 1)).astype(np.int64)


def ftrl_weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weight that the FTRL-proximal sums stand for."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _features(folder: str):
    """(first, no, path, records): files with the label, the place and the hashes of each row, the bias last; first is the place of the first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        hasher, part, no = Hasher(), TaskContext.get().partitionId(), 0
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_A_FILE):
                rows = batch.slice(i, ROWS_A_FILE)
                text, feature = hasher(rows.column(0).to_pylist())
                edge = np.searchsorted(text, np.arange(rows.num_rows + 1))
                with_bias = np.insert(feature.astype("<i4"), edge[1:], 1 << BITS)
                place = rows.column(2).to_numpy().astype("<i8")
                arrays = (rows.column(1).to_numpy().astype("<i4"), place, (np.diff(edge) + 1).astype("<i4"), with_bias)
                path = write_file(folder, f"features-{part:06d}-{no:04d}", [np.array([rows.num_rows], "<i8").tobytes(), *(x.tobytes() for x in arrays)])
                yield pa.RecordBatch.from_pydict({"first": place[:1], "no": [no], "path": [path], "records": [rows.num_rows]})
                no += 1
        trim_memory()

    return run


def _read(path: str, records: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(labels, places, edges, hashes) of a file's rows in order, COUNTED hashes or one row at a time."""
    with open_file(path) as f:
        (n,) = np.frombuffer(f.read(8), "<i8")
        if n != records:
            raise ValueError(f"{path} has {n} rows of {records}")
        labels, places, sizes = (np.frombuffer(f.read(int(n) * np.dtype(kind).itemsize), kind) for kind in ("<i4", "<i8", "<i4"))
        edge, i = np.concatenate(([0], sizes.cumsum(dtype=np.int64))), 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(edge, edge[i] + COUNTED, "right")) - 1)
            yield labels[i:j], places[i:j], edge[i : j + 1] - edge[i], np.frombuffer(f.read(4 * int(edge[j] - edge[i])), "<i4")
            i = j


def _numbered(times: np.ndarray) -> int:
    """Replace how often each hash occurs by its number, -1 for never, and return how many there are; hashes that occur most come first, within a factor of two."""
    many = 0
    for k in reversed(range(int(times.max(initial=0)).bit_length())):
        found = np.flatnonzero((times >= 1 << k) & (times < 2 << k))
        times[found] = np.arange(-1 - many, -1 - many - len(found), -1, dtype=np.int32)  # below zero until all are done
        many += len(found)
    np.invert(times, out=times)
    return many


def calibration(margin: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """(scale, shift) of the logistic curve through margins and labels, with Platt's targets, so that ends stay finite where margins part the classes."""
    unit, many = max(float(np.abs(margin).max()), 1e-9), toxic.sum()
    x = np.stack([margin / unit, np.ones(len(margin))])
    target = np.where(toxic == 1, (many + 1) / (many + 2), 1 / (len(toxic) - many + 2))
    loss = lambda c: float(np.sum(np.logaddexp(0, c @ x) - target * (c @ x)))
    c = np.array([0.0, np.log((many + 1) / (len(toxic) - many + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(c @ x, -30, 30)))
        slope = x @ (p - target)
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-9 * np.eye(2), slope)
        size = 1.0
        while size > 1e-6 and loss(c - size * step) > loss(c):
            size /= 2
        c = c - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(c[0]) / unit, float(c[1])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, weight) from all rows of one task, ROUNDS passes in the order of their places; hash 1 << BITS is the bias.

    What is held grows with the hashes that occur, 1 << BITS at most; the features of rows are read from their files in every pass.
    """
    trim_memory()
    files = sorted(r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    blocks = lambda: (block for _, _, path, records in files for block in _read(path, records))
    if not files:
        return
    # Hashes are numbered by how often they occur, so that what is read most lies together.
    number, labels, place = np.zeros((1 << BITS) + 1, np.int32), [], []
    for label, at, _, feature in blocks():
        found, times = np.unique(feature, return_counts=True)
        number[found] += times.astype(np.int32)
        labels.append(label)
        place.append(at)
    labels, place = np.concatenate(labels), np.concatenate(place)
    if (place[1:] < place[:-1]).any():
        raise ValueError("files of features are not in the order of their places")
    many = _numbered(number)
    fold = place % FOLDS == 0
    held = np.bincount(labels[fold], minlength=2)
    if min(held) < LEAST_HELD or min(np.bincount(labels[~fold], minlength=2)) == 0:
        fold[:] = False
    z, n = np.zeros(many), np.zeros(many)

    def rows(wanted: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """(features, label) of the rows that are wanted."""
        i = 0
        for label, _, edge, feature in blocks():
            feature, edge = number[feature], edge.tolist()
            for k in np.flatnonzero(wanted[i : i + len(label)]).tolist():
                yield feature[edge[k] : edge[k + 1]], float(label[k])
            i += len(label)

    for _ in range(ROUNDS):
        for x, y in rows(~fold):
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= L1, 0.0, (np.sign(zx) * L1 - zx) / ((BETA + root) / ALPHA + L2))
            g = 1 / (1 + np.exp(-min(max(w.sum(), -30.0), 30.0))) - y
            grown = nx + g * g
            z[x] = zx + (g - (np.sqrt(grown) - root) / ALPHA * w)
            n[x] = grown
    weight = z
    for i in range(0, many, COUNTED):
        weight[i : i + COUNTED] = ftrl_weight(z[i : i + COUNTED], n[i : i + COUNTED])
    if fold.any():
        scale, shift = calibration(np.array([weight[x].sum() for x, _ in rows(fold)]), labels[fold])
        if scale > 0:
            weight *= scale
            weight[number[1 << BITS]] += shift
    used = []
    for i in range(0, len(number), COUNTED):
        found = i + np.flatnonzero(number[i : i + COUNTED] >= 0)
        used.append(found[weight[number[found]] != 0])
    used = np.concatenate(used)
    model = pa.RecordBatch.from_arrays([pa.array(used), pa.array(weight[number[used]])], ["hash", "weight"])
    del number, z, n, weight
    trim_memory()
    yield model


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """(hashes, weights, bias) from rows (doc_id, text, toxic); about fit_rows of them, chosen by a hash of doc_id, are used.

    Rows are dealt by ranges of a hash, features are hashed in parallel and written to files in the shared folder; then one task, bounded by fit_rows, goes over all rows
    in the order of that hash, since sums of tasks that learn apart and are averaged leave out what few rows show.  A fold of one in FOLDS is not learned from: scale and bias are set on it, so
    that 0.5 parts the classes, if it has LEAST_HELD rows of each.  What comes to the driver is as short as L1 makes it.  Rows
    without a label are left out.
    """
    rows = labelled.filter("toxic in (0, 1)").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    total = rows.count()
    share = min(1.0, fit_rows / max(total, 1))
    place = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20))
    order = F.xxhash64(F.lit("order"), "doc_id", "text").alias("place")
    tasks = 1 + round(share * total) // ROWS_A_TASK
    part = F.shiftright((F.shiftright("place", 32) + F.lit(1 << 31)) * F.lit(tasks), 32).cast("int")  # places are hashes: as many rows in each part, parts in order
    chosen = rows.filter(place < F.lit(round(share * (1 << 20)))).select("text", "toxic", order)
    dealt = chosen.repartitionById(tasks, part).sortWithinPartitions("place", "toxic")
    folder = scratch(rows.sparkSession, "toxicity")
    files = cut(dealt.mapInArrow(_features(folder), "first long, no long, path string, records long"))
    found = files.repartition(1).mapInArrow(_learn, "hash long, weight double").toArrow()
    drop_folder(rows.sparkSession, folder)
    hashes, weights = (found.column(k).to_numpy() for k in range(2))
    used = hashes < 1 << BITS
    return hashes[used], weights[used], float(weights[~used].sum())


def _scores(model: tuple[np.ndarray, np.ndarray, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        keep, order = np.zeros(1 << BITS, bool), np.argsort(model[0])
        keep[model[0]] = True
        known, weight = model[0][order], model[1][order].astype(np.float32)
        hasher = Hasher()
        for whole in batches:
            for i in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(i, TEXTS_AT_ONCE)
                text, feature = hasher(batch.column(1).to_pylist(), keep)
                total = model[2] + np.bincount(text, weight[np.searchsorted(known, feature)], minlength=batch.num_rows)
                score = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score)], ["doc_id", "text_hash", "score"])

    return run


def scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, text_hash, score), one row per row of docs; null and empty texts score by the bias alone.  Other columns are not read."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(_scores(model), f"doc_id {dict(rows.dtypes)['doc_id']}, text_hash long, score double")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, text, toxic) to learn from: not held out, one label a doc_id (the largest).  Null doc_ids have no label."""
    marked = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(marked, "doc_id")


def drop_toxic(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], most: float = 0.5) -> DataFrame:
    """docs without rows that score most or more; every column and every other row stays."""
    kinds, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: deque[pa.RecordBatch] = deque()

        def texts() -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for i in range(0, whole.num_rows, TEXTS_AT_ONCE):
                    held.append(batch := whole.slice(i, TEXTS_AT_ONCE))
                    blank = pa.nulls(batch.num_rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([blank, batch.column(names.index("text")), blank], ["doc_id", "text", "text_hash"])

        for got in _scores(model)(texts()):
            yield held.popleft().filter(pa.array(got.column(2).to_numpy() < most))
        trim_memory()

    return docs.mapInArrow(run, kinds)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(labelled_rows(docs, table(spark, sf_dir, "labels")))
    return scores(docs, model).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
