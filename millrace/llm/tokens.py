"""Token ids in bit-plane files.

A file holds the ids of documents in ascending doc_id order, cut into blocks of BLOCK ids. Each block is transposed into
byte planes (or bit planes), each plane is compressed with zstandard, and a chunk index at the end of the file tells where
each plane starts. What the file's documents are, and how many ids each has, is written in segments of SEGMENT documents
between the planes. Layout: magic, planes and segments, zstandard-compressed index, its length (8 bytes), magic.

A range shuffle gives each task a range of doc_ids, which it writes to files that roll over at FILE_IDS ids, so a writer holds
a block, a segment and a bounded index. The manifest of files is checkpointed, so a lost executor costs at most a rewrite
under other names, and readers only open what the manifest lists.

Whole texts are encoded by the tokenizers library, ENCODE_BYTES of them or one longer text at a time. Most of its time goes
into cutting a text into words, each an object of its own. A vocabulary in which no token crosses the end of a plain word, number
or run of marks gets the same ids from stretches of them, so the library's splitting step is then set to leave those together.

Edge cases: null text is empty and gives just the end id; null doc_ids come first; equal doc_ids are ordered by a hash of
their text, and rows that are repeated as a whole are written as often; an empty table writes no file and reads as no rows;
long texts are encoded whole; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, new_folder, row_batches, text_values
from millrace.llm.files import open_read, open_write

MAGIC = b"MRPLANE2"
BLOCK = 1 << 16
SEGMENT = 1 << 14
FILE_IDS = 1 << 26
END_ID = 2
ENCODE_BYTES = 1 << 17
# Fixed value: the library's own pattern of the ByteLevel step.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
# Each alternative is one or more whole matches of PATTERN wherever one may start, so a stretch starts and ends where PATTERN's
# matches do. The first one is the usual word with its marks, the others are for what precedes other characters.
STRETCH = rf"(?:(?> ?[{LETTERS}0-9{MARKS}]++(?=[ \n])| ?[{LETTERS}]++(?!\p{{L}})| ?[0-9]++(?!\p{{N}})| ?[{MARKS}]++(?![^\s\p{{L}}\p{{N}}])|\n(?=\S))){{1,100}}"
# An end of a match within a stretch, in a token's bytes; half a letter at a token's end is an escaped byte (two-byte letters start with C3 to C9).
_HEAD, _TAIL = f"{LETTERS}\udcc3-\udcc9", f"{LETTERS}\udc80-\udcbf"
_CROSSES = re.compile(rf"[{_TAIL}][0-9{MARKS} \n]|[0-9][{_HEAD}{MARKS} \n]|[{MARKS}][{_HEAD}0-9 \n]|\n[{_HEAD}0-9{MARKS}]")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if it can be seen, else the next one from U+0100 on."""
    seen = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*seen}))}


def takes_stretches(kind: dict) -> bool:
    """Whether a tokenizer (its JSON) gives a stretch the ids of its words: plain byte-level BPE, and no token in which a word ends.

    BPE merges two neighbours if their join is a token, lowest rank first. If no token holds the end of one word and the start of
    the next, no merge joins them, so merges in one word neither wait for nor change those in another.
    """
    model, step, alphabet = kind["model"], kind["pre_tokenizer"] or {}, byte_alphabet()
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    unset = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if model["type"] != "BPE" or any(model.get(x) for x in unset) or kind["normalizer"] or any(step.get(k) != v for k, v in plain.items()):
        return False
    made = "\0".join(t for t in model["vocab"] if len(t) > 1).translate(str.maketrans({c: chr(b) for c, b in alphabet.items()}))
    return not _CROSSES.search(made.encode("latin-1", "replace").decode("utf-8", "surrogateescape"))


class Encoder:
    """Ids of whole texts by the tokenizers library, as little-endian uint32 bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism here
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if takes_stretches(json.loads(self.tokenizer.to_str())):
            split = pre_tokenizers.Split(Regex(f"{STRETCH}|{PATTERN}"), "isolated")
            self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            stop, size = at + 1, len(texts[at])
            while stop < len(texts) and size + len(texts[stop]) <= ENCODE_BYTES:
                size += len(texts[stop])
                stop += 1
            for x in self.tokenizer.encode_batch_fast([t.decode() for t in texts[at:stop]], add_special_tokens=False):
                ids = array("I", x.ids)
                if sys.byteorder == "big":
                    ids.byteswap()
                yield ids.tobytes()
            at = stop


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, as loading a vocabulary takes a while."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def planes_of(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of one block of uint32 ids: 4 byte planes, or 32 bit planes."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    return [np.packbits((raw[:, k] >> b) & 1).tobytes() for k in range(4) for b in range(8)]


def ids_of(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        if bits:
            raw[:, k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n) << (k % 8)
        else:
            raw[:, k] = np.frombuffer(plane, np.uint8)
    return raw.reshape(-1).view("<u4")


def segment_bytes(docs: list[tuple[int | None, int]]) -> bytes:
    """Ids (0 for null), which of them are null, and numbers of token ids."""
    ids = np.array([d or 0 for d, _ in docs], "<i8")
    return ids.tobytes() + np.packbits([d is None for d, _ in docs]).tobytes() + np.array([n for _, n in docs], "<i8").tobytes()


def segment_of(data: bytes, n: int) -> list[tuple[int | None, int]]:
    ids, sizes = np.frombuffer(data[: 8 * n], "<i8"), np.frombuffer(data[-8 * n :], "<i8")
    nulls = np.unpackbits(np.frombuffer(data[8 * n : -8 * n], np.uint8), count=n)
    return [(None if z else d, k) for d, z, k in zip(ids.tolist(), nulls.tolist(), sizes.tolist(), strict=True)]


class PlaneWriter:
    """Streams documents' ids into one file; holds one block, one segment and the index."""

    def __init__(self, out, block: int = BLOCK, bits: bool = False, level: int = 3, segment: int = SEGMENT):
        self.out, self.block, self.bits, self.segment, self.press = out, block, bits, segment, zstandard.ZstdCompressor(level=level)
        self.held, self.n_held, self.at, self.chunks, self.docs, self.segments, self.n = [], 0, len(MAGIC), [], [], [], 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.held.append(ids)
        self.n_held += len(ids) // 4
        self.n += len(ids) // 4
        if self.n_held >= self.block:
            self._flush(False)
        if len(self.docs) >= self.segment:
            self._close_segment()

    def _put(self, raw: bytes) -> tuple[int, int]:
        data, at = self.press.compress(raw), self.at
        self.out.write(data)
        self.at += len(data)
        return at, len(data)

    def _close_segment(self) -> None:
        self.segments.append((len(self.docs), *self._put(segment_bytes(self.docs))))
        self.docs = []

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        stop = len(ids) if last else len(ids) // self.block * self.block
        for k in range(0, stop, self.block):
            part = ids[k : k + self.block]
            self.chunks.append((len(part), [self._put(plane) for plane in planes_of(part, self.bits)]))
        self.held, self.n_held = [ids[stop:].tobytes()], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        if self.docs:
            self._close_segment()
        index = self.press.compress(json.dumps({"block": self.block, "bits": self.bits, "chunks": self.chunks, "segments": self.segments}).encode())
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)


class PlaneReader:
    """Random access to a plane file: ``ids(i)`` for block i, ``documents()`` in order."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size, tail = source.tell(), len(MAGIC) + 8
        if size < tail:
            raise ValueError("not a plane file")
        source.seek(size - tail)
        (length,), magic = struct.unpack("<Q", source.read(8)), source.read(len(MAGIC))
        if magic != MAGIC:
            raise ValueError("not a plane file")
        source.seek(size - tail - length)
        self.press = zstandard.ZstdDecompressor()
        self.index = json.loads(self.press.decompress(source.read(length)))

    def _get(self, at: int, length: int) -> bytes:
        self.source.seek(at)
        return self.press.decompress(self.source.read(length))

    def ids(self, i: int) -> np.ndarray:
        n, where = self.index["chunks"][i]
        return ids_of([self._get(*x) for x in where], n, self.index["bits"])

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        held, block = np.zeros(0, "<u4"), 0
        for n_docs, at, length in self.index["segments"]:
            for doc_id, n in segment_of(self._get(at, length), n_docs):
                parts, have = [held], len(held)
                while have < n:
                    parts.append(self.ids(block))
                    have, block = have + len(parts[-1]), block + 1
                held = np.concatenate(parts) if len(parts) > 1 else held
                yield doc_id, held[:n]
                held = held[n:]


def _writer(vocabulary: str, folder: str, end_id: int, block: int, bits: bool, file_ids: int) -> Callable:
    schema = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, file, out, writer, path, n_docs = TaskContext.get().partitionId(), 0, None, None, "", 0
        encode, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()

        def closed() -> pa.RecordBatch:
            writer.close()
            out.close()
            return pa.RecordBatch.from_pydict({"part": [part], "file": [file], "path": [path], "n_docs": [n_docs], "n_ids": [writer.n]}, schema=schema)

        for batch in row_batches(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(text_values(batch.column(1))), strict=True):
                if writer is None:
                    path, n_docs = f"{folder}/part-{part:06d}-{file:04d}-{uuid.uuid4().hex}.planes", 0
                    out = open_write(path)
                    writer = PlaneWriter(out, block, bits)
                writer.add(doc_id, ids + end)
                n_docs += 1
                if writer.n >= file_ids:
                    yield closed()
                    writer, file = None, file + 1
        if writer is not None:
            yield closed()

    return write


def write_tokens(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", folder: str | None = None, end_id: int = END_ID, block: int = BLOCK, bits: bool = False, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes plane files; the manifest: part, file, path, n_docs, n_ids, base (ids in earlier files)."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    manifest = cut(ordered.mapInArrow(_writer(vocabulary, folder or new_folder(docs.sparkSession, "tokens"), end_id, block, bits, file_ids), "part int, file int, path string, n_docs long, n_ids long"))
    # a row for each file, so this window stays small
    before = F.sum("n_ids").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("base", F.coalesce(before, F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    schema = pa.schema([(x, pa.int64()) for x in names])
    for batch in row_batches(batches):
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with open_read(path) as source:
                rows, at = [], base
                for doc_id, ids in PlaneReader(source).documents():
                    rows.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)


def read_digests(manifest: DataFrame) -> DataFrame:
    """Read back from the files: doc_id, start, n_tokens, ids_crc32; a task for each file."""
    files = manifest.select("path", "base").repartition(max(1, manifest.count()), "path")
    return files.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
