"""Token-ID output: ids ranked by frequency, in a byte-aligned variable-length coding with separate control bytes.

Layout of a file: 8 bytes of magic, then the little-endian int64 values n_docs, n_ids and start (ids in all files before),
then doc_id, validity of doc_id and number of ids for each document, then the control bytes, then the data bytes.  A
control byte holds two bits for each of four ids, the number of their data bytes less one; the data bytes are the id's
frequency rank, low byte first.  So frequent ids take one byte, and a table with 256 rows turns control bytes into lengths.
The ranks stand in one file beside, which lists the ids by falling frequency.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop_folder, lean_memory, scratch, table, trim_memory
from .files import open_file, write_file

END_ID = 1
MAGIC = b"RXTOKV1\n"
#: Ids gathered before a file is closed.
FILE_IDS = 8_000_000
#: Words whose ids a worker remembers at most.
REMEMBERED = 1_000_000
SHARED = "rxweave encoder"
#: Texts that are taken from a batch at a time.
AT_ONCE = 256
#: Stems that are given to the tokenizer as one text.
STEMS_AT_ONCE = 10_000
#: Marks and symbols that may end a word; with Latin letters before, the tokenizer always cuts between the two.
TAIL = ".,;:!?*$%&#|"
LATIN = r"[A-Za-zÀ-ÖØ-öø-ÿ]+"
#: Lengths of the four ids of a control byte.
LENGTHS = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts, equal to those of the tokenizer for the whole text.

    The tokenizer drops white space and never merges across it, so words are encoded once and remembered.
    """

    def __init__(self, path: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.latin = Tokenizer.from_file(path), re.compile(LATIN).fullmatch
        # Stems are lower-case, composed and whole already: the same merges without the steps before them.
        self.merges = Tokenizer(self.tokenizer.model)  # one model for both: it is most of an encoder's memory
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        #: Little-endian unsigned 32-bit ids.
        self.words: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.remembered = REMEMBERED

    @classmethod
    def shared(cls, path: str, remembered: int = REMEMBERED) -> Encoder:
        """One a Python process: workers serve many tasks."""
        import sys

        key = f"{SHARED} {path}"
        if not hasattr(sys, key):
            setattr(sys, key, cls(path))
        found = getattr(sys, key)
        found.remembered = remembered
        return found

    @staticmethod
    def forget() -> None:
        """Give the memory of this process's encoders back, once all texts are tokenized, if they were told to remember little."""
        import sys

        lean = [k for k, e in vars(sys).items() if k.startswith(SHARED) and e.remembered < REMEMBERED]
        for key in lean:
            delattr(sys, key)
        if lean:
            trim_memory()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that the tokenizer never cuts before it merges: in a text of many, the last id of each is marked as one that ends a piece."""
        out: list[bytes] = []
        for i in range(0, len(pieces), STEMS_AT_ONCE):
            some = pieces[i : i + STEMS_AT_ONCE]
            ids = np.array(self.merges.encode(" ".join(some), add_special_tokens=False).ids, np.int64)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                raise ValueError("the tokenizer does not mark the end of a word once")
            data, edges = ids.astype("<u4").tobytes(), [0, *(4 * stops).tolist()]
            out += [data[b:e] for b, e in pairwise(edges)]
        return out

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words not seen before."""
        if len(self.stems) > self.remembered:
            self.stems.clear()
        cuts, other = [], []
        for w in new:
            word = w.decode("utf-8")
            stem = word.rstrip(TAIL)
            if self.latin(stem):
                cuts.append((w, stem.lower(), word[len(stem) :]))
            else:
                other.append(w)
        stems = list({s for _, s, t in cuts for s in (s, t) if s and s not in self.stems})
        known = self.stems
        known[""] = b""
        known |= zip(stems, self._parts(stems), strict=True)
        found = {w: known[stem] + known[tail] for w, stem, tail in cuts}
        return found | dict(zip(other, self._whole([w.decode("utf-8") for w in other]), strict=True))

    def __call__(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for i in range(0, len(texts), AT_ONCE):
            split = [(t or "").encode("utf-8").split() for t in texts[i : i + AT_ONCE]]
            known = self.words
            missing = [w for w in set().union(*split) if w not in known]
            found = self._learn(missing)
            if len(known) + len(found) > self.remembered:
                found |= {w: known[w] for w in set().union(*split) if w in known}
                known = self.words = {}
            known |= found
            for words in split:
                yield np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4")


def _raw(folder: str, path: str, remembered: int):
    """Tokenize a partition into raw files; a manifest row for each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if remembered < REMEMBERED:
            lean_memory()
        encode, part, seq = Encoder.shared(path, remembered), TaskContext.get().partitionId(), 0
        docs, valid, sizes, ids, n = [], [], [], [], 0

        def flush():
            nonlocal docs, valid, sizes, ids, n, seq
            every = np.concatenate(ids)
            width = 2 if every.max() < 1 << 16 else 4
            head = np.array([len(docs), n, width], "<i8").tobytes()
            packed = zstandard.ZstdCompressor(level=1).compress(every.astype(f"<u{width}").tobytes())
            parts = [head, np.array(docs, "<i8").tobytes(), np.array(valid, np.uint8).tobytes(), np.array(sizes, "<i8").tobytes(), packed]
            row = {"part": [part], "seq": [seq], "path": [write_file(folder, f"raw-{part:06d}-{seq:04d}", parts)], "docs": [len(docs)], "ids": [n]}
            docs, valid, sizes, ids, n, seq = [], [], [], [], 0, seq + 1
            return pa.RecordBatch.from_pydict(row)

        few = (batch.slice(i, AT_ONCE) for batch in batches for i in range(0, batch.num_rows, AT_ONCE))
        for batch in few:
            for doc, got in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                docs.append(doc or 0)
                valid.append(doc is not None)
                sizes.append(len(got) + 1)
                ids += [got, np.array([END_ID], np.uint32)]
                n += len(got) + 1
                if n >= FILE_IDS:
                    yield flush()
        if docs:
            yield flush()
        if remembered < REMEMBERED:
            trim_memory()

    return write


def _read_raw(path: str):
    with open_file(path) as f:
        data = f.read()
    docs, n, width = np.frombuffer(data, "<i8", 3)
    at = 24
    doc = np.frombuffer(data, "<i8", docs, at)
    valid = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    sizes = np.frombuffer(data, "<i8", docs, at + 9 * docs)
    ids = zstandard.ZstdDecompressor().decompress(memoryview(data)[at + 17 * int(docs) :], max_output_size=int(n * width))
    return doc, valid, sizes, np.frombuffer(ids, f"<u{width}", n)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    Encoder.forget()
    total = np.zeros(0, np.int64)
    for batch in batches:
        for path in batch.column(0).to_pylist():
            found = np.bincount(_read_raw(path)[3])
            if len(found) > len(total):
                found, total = total, found
            total[: len(found)] += found
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"id": pa.array(seen.astype(np.int64)), "n": pa.array(total[seen].astype(np.int64))})


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes)."""
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    as_bytes = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), as_bytes[np.arange(4) < size[:, None]].tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = LENGTHS[control].reshape(-1)[:n]
    end = np.cumsum(size, dtype=np.int64)
    begin = end - size
    ranks = data[begin].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(size > k)
        ranks[longer] |= data[begin[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def _encoded(folder: str, rank_of: np.ndarray):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Encoder.forget()
        for batch in batches:
            for row in batch.to_pylist():
                doc, valid, sizes, ids = _read_raw(row["path"])
                control, data = encode_ranks(rank_of[ids])
                head = np.array([len(doc), len(ids), row["start"], len(control)], "<i8").tobytes()
                parts = [MAGIC, head, doc.tobytes(), valid.tobytes(), sizes.tobytes(), control, data]
                yield pa.RecordBatch.from_pydict({"path": [write_file(folder, f"ids-{row['part']:06d}-{row['seq']:04d}", parts)]})

    return write


def read_file(path: str, id_of: np.ndarray):
    """(doc_id, validity, number of ids, ids, start) of a file."""
    with open_file(path) as f:
        data = f.read()
    if data[:8] != MAGIC:
        raise ValueError(f"not a token file: {path}")
    docs, n, start, controls = np.frombuffer(data, "<i8", 4, 8)
    doc = np.frombuffer(data, "<i8", docs, 40)
    valid = np.frombuffer(data, np.uint8, docs, 40 + 8 * docs)
    sizes = np.frombuffer(data, "<i8", docs, 40 + 9 * docs)
    control = np.frombuffer(data, np.uint8, controls, 40 + 17 * docs)
    ranks = decode_ranks(control, np.frombuffer(data, np.uint8, -1, 40 + 17 * docs + controls), n)
    return doc, valid, sizes, id_of[ranks], int(start)


def _digests(ranks_path: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Encoder.forget()
        with open_file(ranks_path) as f:
            id_of = np.frombuffer(f.read(), "<u4")
        for batch in batches:
            for path in batch.column(0).to_pylist():
                doc, valid, sizes, ids, start = read_file(path, id_of)
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[e - s : e].astype("<u4").tobytes()) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, mask=valid == 0), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return read


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """Write docs (doc_id, text) as token files into folder, in ascending doc_id order; a row (path, ranks_path) for each file.

    Null texts are empty and hold the end id alone; null doc_ids come first, equal doc_ids in order of their texts' hashes.
    Texts are dealt by ranges of doc_id, tokenized once and kept as raw files until the frequencies of all ids are known;
    only the counts, a row for each id of the vocabulary at most, reach the driver.  remembered: words whose ids a worker keeps at
    most, which sets its memory and nothing in the result.  Texts of any length are tokenized whole, repeated rows each for itself; an empty table
    gives no file.  Other columns are not read.
    """
    spark = docs.sparkSession
    raw_folder = scratch(spark, "raw-ids")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("h"))
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    raw = cut(dealt.mapInArrow(_raw(raw_folder, path or vocabulary_path(), remembered), "part long, seq long, path string, docs long, ids long"))
    files = _tasks(raw, "path")
    counted = files.select("path").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    by_rank = np.array([r.id for r in counted.orderBy(F.desc("n"), "id").select("id").collect()], np.uint32)
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    ranks_path = write_file(folder, "ranks", [by_rank.astype("<u4").tobytes()])
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = _tasks(raw.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))), "path")
    written = cut(starts.mapInArrow(_encoded(folder, rank_of), "path string"))
    drop_folder(spark, raw_folder)
    return written.withColumn("ranks_path", F.lit(ranks_path))


def _tasks(manifest: DataFrame, column: str) -> DataFrame:
    """A manifest of files dealt over tasks: rows are few and small, the work behind each is not."""
    spark = manifest.sparkSession
    return manifest.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), column)


def read_digests(written: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), one row per document of the files that write_tokens returned."""
    first = written.select("ranks_path").first()
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if first is None:
        return written.sparkSession.createDataFrame([], schema)
    return _tasks(written.select("path"), "path").mapInArrow(_digests(first.ranks_path), schema)


def tokenize(docs: DataFrame, path: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """Write docs as token files below the shared folder and read them back."""
    return read_digests(write_tokens(docs, scratch(docs.sparkSession, "ids"), path, remembered))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"))
