"""Token ids in a binary format of byte planes.

Documents are laid out in ascending id order.  A file holds chunks; a chunk holds the ids of consecutive whole
documents, cut into blocks of ``BLOCK`` ids (the last is shorter).  A block is transposed: plane ``k`` has byte ``k``
of each id (or bit ``k`` of each, packed), so that bytes which vary little lie together, and every plane is compressed
by zstandard on its own.  The chunks are rows of a Parquet table, which gives Spark's commit protocol and any file
system; the chunk index is a second table with, for each chunk, its documents and the place of its first id among all
ids.

Texts: null and empty have only the end id.  Rows with equal or null document ids keep a place of their own; null comes
first and equal ids are ordered by a hash of the text.  A document longer than a chunk makes a chunk with many blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import PUNCTUATION, byte_letters, tokenizer_path
from .cluster import shared_dir
from .words import split_words, text_slices

BLOCK = 1 << 16
#: Ids after which a chunk is closed.
CHUNK = 1 << 20
BYTE_LETTERS = dict(enumerate(byte_letters()))
#: Letters before this one are older than any table of characters in use, and none of them composes with another.
OLD_LETTERS = "\u02b0"
#: Files whose chunks are numbered within one task.
INDEX_FILES = 1024
#: Bytes of text encoded at once: the more, the fewer words are looked up again.
ENCODE_BYTES = 8 << 20
#: Bytes of text for each file.
FILE_BYTES = 48 << 20
CHUNK_SCHEMA = "file int, chunk int, doc_ids array<bigint>, sizes array<bigint>, n_ids bigint, planes string, blocks array<struct<n: int, planes: array<binary>>>"


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids: 4 of bytes or 32 of bits."""
    four = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [four[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(four, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start`` to ``start + size`` of every span, one span behind the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Encoder:
    """Ids of words by the tokenizers library, once for each distinct piece of a slice.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its words in order.
    A word of letters below ``OLD_LETTERS``, perhaps with ASCII punctuation behind, needs no normaliser and is cut by eye;
    its distinct pieces go to the library's model in one call, whose ids tell by their suffix where a piece ends.  All
    other words, and all words of a file that doesn't lower-case, cut and end pieces that way, take the whole way.
    """

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.bare = Tokenizer(self.model)
        suffix = getattr(self.model, "end_of_word_suffix", None)
        self.by_eye = bool(suffix) and self.cuts_by_eye()
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if self.by_eye:
            for token, i in self.bare.get_vocab().items():
                self.ends[i] = token.endswith(suffix)

    def cuts_by_eye(self) -> bool:
        """Whether the file's own normaliser lower-cases and its splitter cuts letters from punctuation behind them."""
        word = "AbÀ" + PUNCTUATION
        normaliser, splitter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if normaliser is None or splitter is None or normaliser.normalize_str(word) != word.lower():
            return False
        return [p for p, _ in splitter.pre_tokenize_str(word.lower())] == [self.letters_of("AbÀ"), PUNCTUATION]

    @staticmethod
    def letters_of(core: str) -> str:
        """A word of letters, lower-cased, in the vocabulary's characters for its bytes; empty if that isn't certain."""
        lower = core.lower()
        plain = core.isalpha() and max(core) < OLD_LETTERS and lower.isalpha() and len(lower) == len(core)
        return lower.encode().decode("latin-1").translate(BYTE_LETTERS) if plain else ""

    def pieces(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in one array, and where each begins (one more than there are pieces)."""
        if not names:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        ids = np.array(self.bare.encode_batch_fast([names], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(names):  # a file in which other tokens end like that, too
            lists = [[t.id for t in self.model.tokenize(n)] for n in names]
            return np.array([i for x in lists for i in x], np.int32), np.cumsum([0, *map(len, lists)])
        return ids, np.append(0, ends)

    def words(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and where each begins (one more than there are words)."""
        n = len(vocabulary)
        cores = pc.utf8_rtrim(vocabulary, PUNCTUATION)
        plain = pc.string_is_ascii(cores)
        flags = lambda x: x.to_numpy(zero_copy_only=False)
        eye = flags(pc.and_(plain, pc.utf8_is_alpha(cores)))
        odd = ~flags(plain)
        lower = pc.ascii_lower(cores)
        if odd.any():
            seen = cores.filter(pa.array(odd)).dictionary_encode()
            made = pa.array([self.letters_of(c) for c in seen.dictionary.to_pylist()], lower.type).take(seen.indices)
            lower = pc.replace_with_mask(lower, pa.array(odd), made)
            eye[odd] = flags(pc.greater(pc.binary_length(made), 0))
        if not self.by_eye:
            eye[:] = False
        # what stands behind the letters, from the bytes of the words
        end = np.frombuffer(vocabulary.buffers()[1], np.int64)[vocabulary.offset : vocabulary.offset + n + 1][1:]
        behind = (pc.binary_length(vocabulary).to_numpy() - pc.binary_length(cores).to_numpy()).astype(np.int64)
        tailed = eye & (behind > 0)
        size = behind[tailed]
        data = np.frombuffer(vocabulary.buffers()[2] or b"", np.uint8)[spans(end[tailed] - size, size)]
        tails = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(data))
        coded = pa.concat_arrays([lower.filter(pa.array(eye)), tails]).dictionary_encode()
        ids, at = self.pieces(coded.dictionary.to_pylist())
        piece = coded.indices.to_numpy().astype(np.int64)
        whole = [x.ids for x in self.tokenizer.encode_batch_fast(vocabulary.filter(pa.array(~eye)).to_pylist(), add_special_tokens=False)]
        far = np.cumsum([0, *map(len, whole)]) + len(ids)
        ids = np.concatenate([ids, np.array([i for x in whole for i in x], np.int32)])
        # each word is one span of ids, perhaps with a second one behind
        starts, sizes = np.zeros((n, 2), np.int64), np.zeros((n, 2), np.int64)
        for where, column, first, after in ((eye, 0, at[piece[: eye.sum()]], at[piece[: eye.sum()] + 1]), (tailed, 1, at[piece[eye.sum() :]], at[piece[eye.sum() :] + 1]), (~eye, 0, far[:-1], far[1:])):
            starts[where, column], sizes[where, column] = first, after - first
        return ids[spans(starts.ravel(), sizes.ravel())], np.append(0, np.cumsum(sizes.sum(axis=1)))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a slice in one array, and the texts' offsets in it."""
        vocabulary, codes, offsets = split_words(column, lower=False)
        ids, at = self.words(vocabulary)
        start, size = at[codes], np.diff(at)[codes]
        return ids[spans(start, size)], np.append(0, np.cumsum(size))[offsets]


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, planes: str = "byte", file_bytes: int = FILE_BYTES) -> None:
    """Encodes ``docs`` (doc_id, text) and writes ``path/chunks`` and ``path/index``.

    One shuffle, of the texts, into ranges of doc_id.  Ranges come from Spark's sample of the ids, so they hold about
    ``file_bytes`` of text each; a range is encoded slice by slice.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or tokenizer_path()
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-total // file_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pack = encoder(tokenizer), zstandard.ZstdCompressor(level=3)
        keys, parts, held, number, file = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            blocks = [{"n": len(b), "planes": [pack.compress(p) for p in to_planes(b, planes)]} for b in (ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK))]
            row = {"file": file, "chunk": number, "doc_ids": list(keys), "sizes": [len(p) for p in parts], "n_ids": len(ids), "planes": planes, "blocks": blocks}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            file = batch.column("file")[0].as_py() if batch.num_rows else file
            for part in text_slices(batch, max_bytes=ENCODE_BYTES):
                flat, offsets = encode(part.column("text"))
                for key, i, j in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    keys.append(key)
                    parts.append(np.append(flat[i:j], end_id))
                    held += j - i + 1
                    if held >= CHUNK:
                        yield close()
                        keys, parts, held, number = [], [], 0, number + 1
        if parts:
            yield close()

    schema = pa.schema([("file", pa.int32()), ("chunk", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("planes", pa.string()), ("blocks", pa.list_(pa.struct([("n", pa.int32()), ("planes", pa.list_(pa.binary()))])))])
    # Spark samples what it sorts by: ids and hashes, never texts
    order = [F.asc_nulls_first("doc_id"), F.asc("hash"), F.asc("tie")]
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("tie"))
    ranged = keyed.repartitionByRange(int(files), *order).sortWithinPartitions(*order)
    chunks = ranged.select("doc_id", "text", F.spark_partition_id().alias("file")).mapInArrow(run, CHUNK_SCHEMA)
    chunks.write.option("compression", "none").parquet(f"{path}/chunks")
    narrow = spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks").select("file", "chunk", "n_ids", F.size("doc_ids").alias("n_docs"), F.get("doc_ids", F.lit(0)).alias("first_doc"), F.element_at("doc_ids", -1).alias("last_doc"))
    index_of(narrow).write.parquet(f"{path}/index")


def index_of(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``start``, how many ids stand before each: sums over runs of files, then within each run.

    One task sees the totals of the runs, a row for ``INDEX_FILES`` files; any other the chunks of one run.
    """
    runs = chunks.withColumn("run", F.floor(F.col("file") / INDEX_FILES))
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = runs.groupBy("run").agg(F.sum("n_ids").alias("n_ids")).select("run", before(Window.orderBy("run")).alias("base"))
    inside = runs.withColumn("start", before(Window.partitionBy("run").orderBy("file", "chunk")))
    return inside.join(totals, "run").withColumn("start", F.col("start") + F.col("base")).drop("run", "base")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks with the place of their first id, from the index."""
    index = spark.read.parquet(f"{path}/index").select("file", "chunk", "start")
    return spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks").join(index, ["file", "chunk"])


def documents_of(row: dict) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, start, ids) of the documents of a chunk."""
    unpack = zstandard.ZstdDecompressor()
    ids = np.concatenate([from_planes([unpack.decompress(p) for p in b["planes"]], b["n"]) for b in row["blocks"]])
    at = 0
    for key, n in zip(row["doc_ids"], row["sizes"], strict=True):
        yield key, row["start"] + at, ids[at : at + n]
        at += n


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                keys, starts, ids = zip(*documents_of(row), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    return read_chunks(spark, path).mapInArrow(run, "doc_id bigint, start bigint, ids array<bigint>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                out = [(key, start, len(ids), zlib.crc32(ids.tobytes())) for key, start, ids in documents_of(row)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_chunks(spark, path).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame) -> DataFrame:
    """Writes the token files of ``docs`` in the shared folder and digests what is read back."""
    import uuid

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path)
    return read_digests(spark, path)
