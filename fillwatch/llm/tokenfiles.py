"""Operator 11: token ids in Arrow's file format, as equal-length sequences and masks that can be read at random without a copy."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fillwatch.llm.common import materialise
from fillwatch.session import shared_dir

#: Ids of a sequence, sequences of a record batch, the id that ends a document.
LENGTH, SEQUENCES, END_ID = 2048, 256, 2
#: While a batch is gathered: what fills up the last sequence of a file, an id, the end id of a document.
PAD, TOKEN, END = 0, 1, 2
#: Bytes of text split at once, bytes of words that a worker remembers, rows of a batch of the index.
_PIECE, _REMEMBER, _DOCS = 1 << 20, 1 << 24, 4096
_SPACE, _LETTERS, _ALNUM, _STOPS = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"[a-z]+"), re.compile(rb"[a-z0-9]"), b".,;:!?"


class Encoder:
    """Ids of texts by a tokenizer file.

    by_word: the tokenizer lower-cases, drops white space, splits letters from punctuation and lets nothing reach over
    white space, so a text's ids are those of its words one after the other. Each worker asks the library once for each
    word that it remembers, without the punctuation behind it, and for plain letters goes to the library's model itself.
    """

    def __init__(self, path: str, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.size = 0

    def _ask(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        known, model, rest, ends = self.known, self.tokenizer.model, [], {}
        if not known:
            stops = [bytes([c]) for c in _STOPS]
            known.update(zip(stops, self._ask(stops), strict=True))
        for w in words:
            core = w.rstrip(_STOPS)
            if core != w and _ALNUM.fullmatch(core[-1:]) and w[len(core) :] in known:
                ends[w] = core
            else:
                core = w
            if core not in known:
                if _LETTERS.fullmatch(core):
                    known[core] = np.array([t.id for t in model.tokenize(core.decode())], self.dtype).tobytes()
                else:
                    rest.append(core)
        if rest:
            known.update(zip(rest, self._ask(rest), strict=True))
        for w, core in ends.items():
            known[w] = known[core] + known[w[len(core) :]]
        self.size += sum(map(len, words))

    def ids(self, text: bytes) -> bytes:
        if not self.by_word:
            return self._ask([text])[0]
        if b"<|" not in text:  # special tokens count as they stand
            text = text.lower()
        out = []
        at = 0
        while at < len(text):
            cut = _SPACE.search(text, at + _PIECE) if len(text) > at + _PIECE else None
            end = cut.start() if cut else len(text)
            words = text[at:end].split()  # bytes: at ASCII white space only
            if new := [w for w in set(words) if w not in self.known]:
                self._learn(new)
            out += map(self.known.__getitem__, words)
            if self.size > _REMEMBER:
                self.known, self.size = {}, 0
            at = end
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str, by_word: bool) -> Encoder:
    """One a worker, not one a task."""
    return Encoder(path, by_word)


def _schema(dtype: np.dtype, length: int) -> pa.Schema:
    """Ids, and as bits (from the lowest of each byte on) which of them aren't filling and which end a document."""
    if length % 8:
        raise ValueError("sequences must have a multiple of 8 ids")
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.uint8(), length // 8)), ("ends", pa.list_(pa.uint8(), length // 8))])


def bits(packed: np.ndarray) -> np.ndarray:
    """A mask as one number an id."""
    return np.unpackbits(packed, axis=-1, bitorder="little")


_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_MANIFEST = "shard int, ids_path string, docs_path string, n_docs long, n_tokens long, n_sequences long"


class _Writer:
    """One pair of files: sequences, and the documents that they hold. Both are written batch by batch."""

    def __init__(self, folder: str, dtype: np.dtype, length: int, end_id: int):
        fs, root = pa.fs.FileSystem.from_uri(folder)
        self.shard = TaskContext.get().partitionId()
        stem = f"part-{self.shard:05d}-{uuid.uuid4().hex}"  # another attempt at the task writes other files; only what the manifest names counts
        self.paths = f"{folder}/{stem}.ids.arrow", f"{folder}/{stem}.docs.arrow"
        self.sinks = [fs.open_output_stream(f"{root}/{stem}.{kind}.arrow") for kind in ("ids", "docs")]
        self.length, self.dtype, self.schema, self.end = length, dtype, _schema(dtype, length), np.array([end_id], dtype).tobytes()
        self.ids, self.docs = pa.ipc.new_file(self.sinks[0], self.schema), pa.ipc.new_file(self.sinks[1], _INDEX)
        self.buffer, self.marks, self.rows = bytearray(), bytearray(), []
        self.n_docs = self.n_tokens = self.n_sequences = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize + 1
        self.buffer += ids + self.end
        self.marks += bytes([TOKEN]) * (n - 1) + bytes([END])
        self.rows.append((doc_id, self.n_tokens, n))
        self.n_docs, self.n_tokens = self.n_docs + 1, self.n_tokens + n
        whole = SEQUENCES * self.length
        if len(self.marks) >= whole:
            self._put(len(self.marks) // whole * SEQUENCES)
        if len(self.rows) >= _DOCS:
            self._index()

    def _put(self, sequences: int) -> None:
        n = sequences * self.length
        ids, marks = np.frombuffer(bytes(self.buffer[: n * self.dtype.itemsize]), self.dtype), np.frombuffer(bytes(self.marks[:n]), np.uint8)
        del self.buffer[: n * self.dtype.itemsize], self.marks[:n]
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=t.type) for x, t in zip((ids, *(np.packbits(m, bitorder="little") for m in (marks != PAD, marks == END))), self.schema, strict=True)]
        batch = pa.RecordBatch.from_arrays(lists, schema=self.schema)
        for k in range(0, sequences, SEQUENCES):
            self.ids.write_batch(batch.slice(k, SEQUENCES))
        self.n_sequences += sequences

    def _index(self) -> None:
        self.docs.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.rows, strict=True)], schema=_INDEX))
        self.rows = []

    def close(self) -> tuple:
        if self.marks:
            short = -len(self.marks) % self.length
            self.buffer += bytes(short * self.dtype.itemsize)
            self.marks += bytes([PAD]) * short
            self._put(len(self.marks) // self.length)
        if self.rows:
            self._index()
        for x in (self.ids, self.docs, *self.sinks):
            x.close()
        return self.shard, *self.paths, self.n_docs, self.n_tokens, self.n_sequences


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, length: int = LENGTH, by_word: bool = True, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Writes the ids of all texts, each followed by end_id, in ascending order of ids, and returns the manifest: one row a pair of files.

    Rows are dealt to `shards` files by ranges of (id, hash of the text), so a shard's documents stand before the next
    one's; texts are shuffled once, and encoded where they are written. Sequences of `length` ids run over document
    borders; only a file's last one is filled up. A null id comes first; rows repeated with one id stand by the hashes of
    their texts; null texts are empty and give the end id alone; other columns are ignored; an empty table gives no files.
    tokenizer is a path that every executor can read. A lost task's files stay behind, but no manifest names them.
    """
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, writer = encoder(tokenizer, by_word), None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                writer = writer or _Writer(folder, known.dtype, length, end_id)
                writer.add(doc_id, known.ids(text.as_py()))
        if writer:
            types = [pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(writer.close(), types, strict=True)], names=[x.split()[0] for x in _MANIFEST.split(", ")])

    at = docs.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(docs.sparkSession._jsc.hadoopConfiguration()).mkdirs(at)
    dealt = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "t")
    return materialise(dealt.select("doc_id", F.col("t").cast("binary").alias("t")).mapInArrow(run, _MANIFEST), "manifest")


def _open(path: str) -> pa.ipc.RecordBatchFileReader:
    """Mapped into memory where the file is local, else read batch by batch."""
    fs, at = pa.fs.FileSystem.from_uri(path)
    return pa.ipc.open_file(pa.memory_map(at) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(at))


class TokenFile:
    """Random access to a shard: sequences and masks as views of the mapped file, documents by their place."""

    def __init__(self, ids_path: str, docs_path: str):
        self.ids, self.docs = _open(ids_path), _open(docs_path)
        self.length = self.ids.schema.field("ids").type.list_size

    def batch(self, k: int) -> tuple[np.ndarray, ...]:
        """Ids, mask and ends of record batch k, as tables of a row a sequence; see bits() for the masks."""
        b = self.ids.get_batch(k)
        return tuple(c.flatten().to_numpy(zero_copy_only=True).reshape(b.num_rows, -1) for c in b.columns)

    def sequence(self, i: int) -> tuple[np.ndarray, ...]:
        return tuple(x[i % SEQUENCES] for x in self.batch(i // SEQUENCES))

    def span(self, start: int, n: int) -> np.ndarray:
        """n ids from a place on."""
        first, last = start // self.length, (start + n - 1) // self.length
        return np.concatenate([self.sequence(i)[0] for i in range(first, last + 1)])[start - first * self.length :][:n]

    def document(self, i: int) -> tuple[int | None, np.ndarray]:
        """Id and token ids of the shard's document i."""
        row = self.docs.get_batch(i // _DOCS).slice(i % _DOCS, 1).to_pylist()[0]
        return row["doc_id"], self.span(row["start"], row["n_tokens"])


_READ = "shard int, doc_id long, start long, n_tokens long, ids_crc32 long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as the files have them: their borders by the masks, their ids by the sequences; both must agree with the index."""
    for shards in batches:
        for row in shards.to_pylist():
            f = TokenFile(row["ids_path"], row["docs_path"])
            index = (f.docs.get_batch(k) for k in range(f.docs.num_record_batches))
            ends, crcs, crc, at = [], [], 0, 0
            known = next(index, None)

            def put() -> pa.RecordBatch:
                n, last = np.diff(ends, prepend=start), np.array(ends)
                if not (np.array_equal(known.column("n_tokens").to_numpy(), n) and np.array_equal(known.column("start").to_numpy(), last - n)):
                    raise ValueError(f"{row['docs_path']} doesn't fit its sequences")
                cols = [pa.array(np.full(len(n), row["shard"], np.int32)), known.column("doc_id"), pa.array(last - n), pa.array(n), pa.array(crcs, pa.int64())]
                return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _READ.split(", ")])

            start = 0
            for k in range(f.ids.num_record_batches):
                ids, mask, last_ids = f.batch(k)
                wide, done = ids.ravel().astype("<u4"), 0
                for end in (np.flatnonzero(bits(last_ids)) + 1).tolist():
                    crcs.append(zlib.crc32(wide[done:end], crc))
                    ends.append(at + end)
                    crc, done = 0, end
                    if len(ends) == known.num_rows:
                        yield put()
                        start, ends, crcs, known = ends[-1], [], [], next(index, None)
                crc = zlib.crc32(wide[done : int(bits(mask).sum())], crc)
                at += len(wide)
            if ends or known is not None:
                raise ValueError(f"{row['docs_path']} names other documents than its sequences hold")


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files that a manifest names.

    start counts the ids of all documents before it, over all shards; ids_crc32 is of the ids as little-endian unsigned
    32-bit integers. One task reads a shard, batch by batch.
    """
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ahead = Window.partitionBy(F.lit(1)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    offsets = materialise(manifest.select("shard", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)).alias("ahead")), "offsets")
    read = manifest.select("shard", "ids_path", "docs_path").repartitionByRange(n, "shard").mapInArrow(_read, _READ)
    return read.join(F.broadcast(offsets), "shard").select("doc_id", (F.col("ahead") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return read_documents(write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), folder))
