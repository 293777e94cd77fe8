"""Token files: independent zstandard frames, one per document, with a trailing seek table.

A file is, in order:

* a skippable index frame: version, id width, partition and sequence number, and the doc_ids;
* one zstandard frame per document holding its token ids, little-endian;
* a skippable seek table: for every frame its compressed size, its content size and the low 32 bits of
  the content's xxh64, then the frame count, a descriptor with the checksum flag and the magic number.

A reader finds a document's frame from the index and the table and decompresses only that frame. Any
zstandard tool can decompress a whole file. Files are written and committed by Spark's own writer, so a
lost executor or a second attempt leaves no half file, and any store that Spark reaches will do.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowguard.llm.common import new_folder, stage, worker_kept
from flowguard.operators.ordered import prefix_offsets

#: Magic numbers of skippable frames, the seek table and its descriptor.
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
END_ID = 2
FILE_BYTES = 16 * 1024 * 1024
CACHED_UNITS = 800_000
LEVEL = 3

#: All letters below U+0250; texts with anything above take the coarser units.
_L = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_ODD_SPACE = re.compile(r"[^\S\t\n\r ]")
_HIGH = re.compile("[\u0250-\U0010ffff]")
_COARSE = re.compile(r"[\t\n\r ]+[^\t\n\r ]*|[^\t\n\r ]+")
_FINE = re.compile(f" ?[{_L}]+(?:'+[{_L}]+)*|(?:(?! [{_L}])[^{_L}])+(?:(?<=['\t\n\r])[{_L}]+(?:'+[{_L}]+)*)?")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class Encoder:
    """Token ids of whole texts as packed little-endian integers.

    Byte-level BPE never merges across the end of a run of letters or the start of white space, so a text is
    encoded unit by unit and repeated units come from a bounded cache. A unit of letters (and a space before)
    goes straight to the library's BPE model, any other through its whole chain. Texts with white space
    other than tab, line feed, return and space are encoded in one piece.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.cache: dict[str, bytes] = {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype=self.dtype).tobytes() for e in found]

    def _units(self, units: list[str]) -> list[bytes]:
        width, letters, tokenize = self.dtype.itemsize, self.letters, self.model.tokenize
        simple = [(u[1:] if u[0] == " " else u).isalpha() for u in units]
        rest = iter(self._encode([u for u, s in zip(units, simple, strict=True) if not s]))
        return [
            b"".join([t.id.to_bytes(width, "little") for t in tokenize("".join([letters[b] for b in u.encode()]))]) if s else next(rest)
            for u, s in zip(units, simple, strict=True)
        ]

    def __call__(self, text: str) -> bytes:
        if _ODD_SPACE.search(text):
            return self._encode([text])[0]
        units = (_COARSE if _HIGH.search(text) or any(a in text for a in self.added) else _FINE).findall(text)
        cache = self.cache
        try:
            return b"".join(map(cache.__getitem__, units))
        except KeyError:
            new = list({u for u in units if u not in cache})
            if len(cache) + len(new) > CACHED_UNITS:
                cache.clear()
                new = list(set(units))
            cache.update(zip(new, self._units(new), strict=True))
            return b"".join(map(cache.__getitem__, units))


def _skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


def pack_file(partition: int, sequence: int, width: int, doc_ids: list[int | None], frames: list[tuple[bytes, int, int]]) -> bytes:
    """The bytes of one file; ``frames`` are (compressed, content size, checksum) in document order."""
    known = bytes(i is not None for i in doc_ids)
    head = struct.pack("<BBIQQ", 1, width, partition, sequence, len(doc_ids))
    index = _skippable(INDEX_MAGIC, head + known + np.array([i or 0 for i in doc_ids], dtype="<i8").tobytes())
    entries = [(len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)] + [(len(f), n, c) for f, n, c in frames]
    table = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IBI", len(entries), CHECKSUMS, FOOTER_MAGIC)
    return index + b"".join(f for f, _, _ in frames) + _skippable(TABLE_MAGIC, table)


class TokenFile:
    """Random access to a file's documents."""

    def __init__(self, data: bytes):
        count, flags, magic = struct.unpack_from("<IBI", data, len(data) - 9)
        if magic != FOOTER_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        start = len(data) - 9 - 12 * count
        if struct.unpack_from("<II", data, start - 8) != (TABLE_MAGIC, 12 * count + 9):
            raise ValueError("damaged seek table")
        self.data = data
        self.entries = np.frombuffer(data, dtype="<u4", count=3 * count, offset=start).reshape(count, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.entries[:, 0], dtype=np.int64)])
        _, self.width, self.partition, self.sequence, n = struct.unpack_from("<BBIQQ", data, 8)
        known = np.frombuffer(data, dtype=np.uint8, count=n, offset=30)
        ids = np.frombuffer(data, dtype="<i8", count=n, offset=30 + n)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self._reader = zstandard.ZstdDecompressor()

    def ids(self, position: int) -> np.ndarray:
        """Token ids of one document; raises ValueError if its checksum differs."""
        at, (size, content, check) = self.starts[position + 1], self.entries[position + 1]
        raw = self._reader.decompress(self.data[at : at + size], max_output_size=max(1, int(content)))
        if len(raw) != content or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"checksum of document {self.doc_ids[position]} differs")
        return np.frombuffer(raw, dtype=f"<u{self.width}")


def _file_rows(tokenizer: str, end_id: int, file_bytes: int):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, press = worker_kept(f"encoder {tokenizer}", lambda: Encoder(tokenizer)), zstandard.ZstdCompressor(level=LEVEL)
        end = np.array([end_id], dtype=encode.dtype).tobytes()
        partition, sequence = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        frames: list[tuple[bytes, int, int]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            # The writer ends every row with the separator byte: it is the last byte of the footer.
            blob = pack_file(partition, sequence, encode.dtype.itemsize, ids, frames)[:-1]
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["value"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = encode(text.as_py() or "") + end
                frame = press.compress(content)
                ids.append(doc_id)
                frames.append((frame, len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
                held += len(frame) + 21
                if held >= file_bytes:
                    yield flush()
                    ids, frames, held, sequence = [], [], 0, sequence + 1
        if ids:
            yield flush()

    return write


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES
) -> str:
    """Encode every whole text (null: empty) and write token files in ascending doc_id order (nulls first).

    Rows that share a doc_id follow each other ordered by a hash of the text. Only doc_id and text are read.
    """
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )
    rows = ordered.mapInArrow(_file_rows(tokenizer, end_id, file_bytes), "value binary")
    (
        rows.select(F.col("value").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .option("encoding", "ISO-8859-1")
        .option("lineSep", chr(FOOTER_MAGIC >> 24))
        .text(folder)
    )
    return folder


READ = "doc_id long, file_no long, position int, start_in_file long, n_tokens long, ids_crc32 long, ids array<long>"


def _document_rows(wanted: frozenset[int] | None, with_ids: bool):
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                file, before = TokenFile(value.as_py()), 0
                rows: list[tuple] = []
                for k, doc_id in enumerate(file.doc_ids):
                    n = int(file.entries[k + 1][1]) // file.width
                    if wanted is None or doc_id in wanted:
                        ids = file.ids(k)
                        crc = zlib.crc32(ids.astype("<u4").tobytes())
                        rows.append((doc_id, (file.partition << 32) + file.sequence, k, before, n, crc, ids.tolist() if with_ids else None))
                    before += n
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                    names = [c.split()[0] for c in READ.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return read


def read_token_files(spark: SparkSession, folder: str, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Documents of token files; with ``doc_ids`` only the frames of those documents are decompressed."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(_document_rows(None if doc_ids is None else frozenset(doc_ids), with_ids), READ)


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32, file_no, position."""
    found = stage(read_token_files(spark, folder, with_ids=False).drop("ids"), "token-rows")
    before = prefix_offsets(found.groupBy("file_no").agg(F.sum("n_tokens").alias("ids")), [], "file_no", ["ids"])
    return found.join(before, "file_no").select(
        "doc_id", (F.col("start_in_file") + F.col("ids_before")).alias("start"), "n_tokens", "ids_crc32", "file_no", "position"
    )


def write_and_index(docs: DataFrame, tokenizer: str) -> DataFrame:
    spark = docs.sparkSession
    return token_index(spark, write_token_files(docs, new_folder(spark, "token-files"), tokenizer))
