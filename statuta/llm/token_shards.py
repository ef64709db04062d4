"""Token ids in sorted-string-table shards (operator 5).

Documents are range-partitioned by identifier, encoded, and written as one
immutable shard per partition:

* data blocks of about 64 KB: entries in key order, each a varint of the bytes
  shared with the key before it, a varint of the rest, a varint of the value's
  length, the rest of the key, the value; the first entry of a block shares none;
* a sparse index: the last key, offset and length of each block;
* a Bloom filter over all keys;
* a footer of fixed length with the place of both, the counts, a checksum and a mark.

Keys are the doc_id in an order-preserving form, the task's number and the number
of the row among those of the task with that id.  Values are token ids, each in
the smallest of 2 or 4 bytes that holds the vocabulary, little-endian.  A lookup
asks the filter for the doc_id, then searches the index by halves, then reads the
blocks that hold the id.

The number of ranges follows the size of the input, and a task begins a new shard
once the one at hand has ``SHARD_BYTES``.  Files are written through Arrow's file
systems into the shared folder under a name that no other attempt uses; only the
files of successful tasks enter the manifest, which has a row per shard.

Defined cases: null or empty text has the end id alone; a null doc_id sorts
before all others; rows that share a doc_id are kept apart, in the order of
their texts, and may reach over several shards; words of any length are encoded
whole.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix64, parts_for, table, tidy

END_ID = 1
BLOCK_BYTES = 64 * 1024
FOOTER = "<QQQQQQBBIQ"  # index at, length; filter at, length; entries; tokens; id bytes; hashes; crc of both; mark
MARK = 0x31424C5441544F4B
BITS_PER_KEY, HASHES = 10, 7
#: Bytes of a shard, about; words and their characters that a task caches at most.
SHARD_BYTES, CACHED, CACHED_CHARS = 64 << 20, 400_000, 12_000_000
#: Code points up to LAST are looked up one by one; of those above only common punctuation is.
LAST = 0x250
SPACE, LETTER, NUMBER, OTHER, ODD = range(5)
#: What the tokenizer's pattern takes for white space here, and its parts of words after an apostrophe.
SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0)
SHORTENED = ("s", "t", "m", "d", "re", "ve", "ll")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def character_table() -> tuple[np.ndarray, np.ndarray]:
    """The class and the lower case of each code point; ODD where the tokenizer must be asked.

    A letter is only classed if it is one by itself in NFC and its lower case is one letter.  Letters that
    combine with others stay ODD, as all that is not listed.
    """
    kind, low = np.full(0x2061, ODD, np.uint8), np.arange(0x2061, dtype=np.uint32)
    for c in [*range(LAST), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]:
        x = chr(c)
        y, name = x.lower(), unicodedata.category(x)
        if c in SPACES:
            kind[c], low[c] = SPACE, 0x20
        elif len(y) == 1 and ord(y) < LAST or y == x:
            low[c] = ord(y)
            kind[c] = LETTER if name[0] == "L" else NUMBER if name[0] == "N" else OTHER
    kind[-1] = ODD
    return kind, low


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Encodes texts word by word through a bounded cache; equal to encoding them whole.

    The tokenizer's own pattern never crosses white space, and parts letters, numbers and other marks.  Where a
    word has only characters whose class and lower case are sure, it is cut here as that pattern does; any other
    word, and one that may hold a special token, is given to the tokenizer as it stands.  Parts are looked up
    once per lot of texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        pieces = self.tok.get_vocab()
        self.width = 2 if len(pieces) <= 1 << 16 else 4
        self.kind, self.low = character_table()
        self.unsure = re.compile("[^" + "".join(re.escape(chr(c)) for c in np.flatnonzero(self.kind != ODD).tolist()) + "]")
        self.codes = byte_characters()
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}  # part of a text -> its list of ids
        self.flat, self.starts, self.chars = array("I"), array("q", [0]), 0

    def keep(self, parts: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        first, base = len(self.starts) - 1, len(self.flat)
        self.flat.frombytes(ids.astype(np.uint32).tobytes())
        self.starts.frombytes((ends + base).astype(np.int64).tobytes())
        self.place.update(zip(parts, range(first, first + len(parts)), strict=True))
        self.chars += sum(map(len, parts))

    def learn(self, parts: list[str]) -> None:
        """One part after the other through the tokenizer's model; whole words that could not be cut, through all of it."""
        model, codes = self.tok.model.tokenize, self.codes
        apart = [p for p in parts if "<|" in p or self.unsure.search(p)]
        for k in range(0, len(apart), 2000):
            some = apart[k : k + 2000]
            found = [e.ids for e in self.tok.encode_batch_fast(some, add_special_tokens=False)]
            self.keep(some, np.array([i for f in found for i in f], np.int64), np.cumsum([len(f) for f in found]))
        sure = [p for p in parts if p not in self.place] if apart else parts
        found = [[t.id for t in model(w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(codes))] for w in (p.lstrip(" ") for p in sure)]
        self.keep(sure, np.array([i for f in found for i in f], np.int64), np.cumsum([len(f) for f in found], dtype=np.int64))

    def cut(self, texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
        """The parts of all texts one after the other, each with the white space before it, and how many each text has."""
        texts = [(t or "") + "\n" for t in texts]
        whole, size = "".join(texts), np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(points, np.uint32(len(self.kind) - 1))
        kind, low = self.kind[at], self.low[at]
        odd = kind == ODD
        if "<|" in whole:
            odd[:-1] |= (points[:-1] == ord("<")) & (points[1:] == ord("|"))
        space = kind == SPACE
        opens = np.ones(len(kind) + 1, bool)  # of parts and of runs of white space
        opens[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        quotes = np.flatnonzero((points == 0x27) & opens[:-1])
        for word in SHORTENED:
            some = quotes[quotes + len(word) < len(low)]
            for k, c in enumerate(word, 1):
                some = some[low[some + k] == ord(c)]
            opens[some + 1] = False
            opens[some + 1 + len(word)] = True
        if odd.any():
            # All of a word with such a character is one part, as it stands.
            word = np.cumsum(np.r_[True, space[1:] != space[:-1]]) - 1
            own = np.zeros(int(word[-1]) + 1, bool)
            own[word[odd]] = True
            inside = own[word]
            opens[1:-1] = np.where(inside[1:] & inside[:-1], word[1:] != word[:-1], opens[1:-1])
            low = np.where(inside, points, low)
        # White space goes to the part behind it; each text's last is its own end.
        opens[1:-1] &= ~space[:-1]
        ends = np.cumsum(size)
        opens[ends] = opens[ends - 1] = opens[0] = True
        at = np.flatnonzero(opens)
        lowered = low.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        width = np.ones(len(low), np.int8)
        for edge in (0x7F, 0x7FF, 0xFFFF):
            width += low > edge
        offsets = np.r_[0, np.cumsum(width, dtype=np.int32)][at].astype(np.int32)
        counts = np.searchsorted(at, ends) - np.searchsorted(at, ends - size)
        return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(offsets), pa.py_buffer(lowered)), counts

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text.  The texts given at once are looked up at once, so there should not be too many."""
        if len(self.place) > CACHED or self.chars > CACHED_CHARS:
            self.clear()
        parts, counts = self.cut(texts)
        coded = parts.dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if missing := [p for p in known if p not in self.place]:
            self.learn(missing)
        at = np.fromiter(map(self.place.__getitem__, known), np.int64, len(known))[coded.indices.to_numpy()]
        starts, flat = np.frombuffer(self.starts, np.int64), np.frombuffer(self.flat, np.uint32) if len(self.flat) else np.zeros(0, np.uint32)
        first, size = starts[at], starts[at + 1] - starts[at]
        ends = np.cumsum(size)
        shift = np.repeat(first - (ends - size), size)
        shift += np.arange(len(shift))
        ids = flat[shift]
        del starts, flat  # the arrays can't grow while they are seen through these
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        for k in range(len(texts)):
            yield ids[bounds[k] : bounds[k + 1]]


class Block(NamedTuple):
    last: bytes
    at: int
    size: int


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def doc_key(doc_id: int | None, task: int = 0, row: int = 0) -> bytes:
    return (b"\0" if doc_id is None else b"\1" + (doc_id + 2**63).to_bytes(8, "big")) + task.to_bytes(4, "big") + row.to_bytes(4, "big")


def id_part(key: bytes) -> bytes:
    return key[:-8]


def key_doc(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:9], "big") - 2**63


def key_hashes(keys: list[bytes], bits: int) -> np.ndarray:
    """The filter's bit numbers, one row a key, by double hashing of what stands for the doc_id."""
    lo, hi = (np.array([f(id_part(k)) for k in keys], np.uint64) for f in (zlib.crc32, zlib.adler32))
    a, b = mix64(lo << np.uint64(32) | hi), mix64(hi << np.uint64(32) | lo) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (a[:, None] + b[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)


class ShardWriter:
    def __init__(self, file, width: int):
        self.file, self.width = file, width
        self.index: list[Block] = []
        self.keys: list[bytes] = []
        self.block, self.size, self.at, self.tokens, self.last = [], 0, 0, 0, b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        entry = varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.size += len(entry)
        self.last = key
        self.keys.append(key)
        self.tokens += len(ids)
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            self.file.write(b"".join(self.block))
            self.index.append(Block(self.last, self.at, self.size))
            self.at += self.size
            self.block, self.size = [], 0

    def finish(self) -> None:
        self.flush()
        index = b"".join(varint(len(b.last)) + b.last + varint(b.at) + varint(b.size) for b in self.index)
        bits = max(64, -(-len(self.keys) * BITS_PER_KEY // 8) * 8)
        flags = np.zeros(bits, bool)
        for k in range(0, len(self.keys), 10_000):
            flags[key_hashes(self.keys[k : k + 10_000], bits).astype(np.int64)] = True
        bloom = np.packbits(flags).tobytes()
        self.file.write(index + bloom)
        self.file.write(struct.pack(FOOTER, self.at, len(index), self.at + len(index), len(bloom), len(self.keys), self.tokens, self.width, HASHES, zlib.crc32(index + bloom), MARK))


class ShardReader:
    def __init__(self, uri: str):
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size, tail = self.file.size(), struct.calcsize(FOOTER)
        self.index_at, n_index, bloom_at, n_bloom, self.entries, self.tokens, self.width, _, crc, mark = struct.unpack(FOOTER, self.file.read_at(tail, size - tail))
        tables = self.file.read_at(n_index + n_bloom, self.index_at)
        if mark != MARK or zlib.crc32(tables) != crc or bloom_at != self.index_at + n_index:
            raise ValueError(f"{uri} is no whole shard")
        self.bloom = np.unpackbits(np.frombuffer(tables[n_index:], np.uint8))
        self.blocks, at = [], 0
        while at < n_index:
            n, at = read_varint(tables, at)
            last, at = tables[at : at + n], at + n
            start, at = read_varint(tables, at)
            length, at = read_varint(tables, at)
            self.blocks.append(Block(last, start, length))

    def entries_of(self, block: Block) -> Iterator[tuple[bytes, np.ndarray]]:
        data, at, key = self.file.read_at(block.size, block.at), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key, at = key[:shared] + data[at : at + rest], at + rest
            yield key, np.frombuffer(data, "<u2" if self.width == 2 else "<u4", size // self.width, at)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for block in self.blocks:
            yield from self.entries_of(block)

    def get(self, doc_id: int | None, row: int = 0) -> np.ndarray | None:
        """The ids of the shard's row number ``row`` with that doc_id, if it has one."""
        key = doc_key(doc_id)
        if not self.entries or not self.bloom[key_hashes([key], len(self.bloom)).astype(np.int64)].all():
            return None
        own = id_part(key)
        for k in range(bisect.bisect_left(self.blocks, key, key=lambda b: b.last), len(self.blocks)):
            for x, ids in self.entries_of(self.blocks[k]):
                if x >= key:
                    if id_part(x) != own:
                        return None
                    if row == 0:
                        return ids
                    row -= 1
        return None


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, shards: int | None = None, text: str = "text", doc_id: str = "doc_id", most: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards; a row per shard: file, docs, tokens, first and last key, in no order.  Runs when the result does."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    by_id = F.col("doc_id").asc_nulls_first()
    # An id with very many rows is split by how their texts begin.
    rows = rows.repartitionByRange(shards or parts_for(docs, mb=64), by_id, F.substring("text", 1, 32).asc_nulls_first()).sortWithinPartitions(by_id, F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = out = None
        task, before, row = TaskContext.get().partitionId(), (), 0

        def close() -> pa.RecordBatch:
            out.finish()
            out.file.close()
            return pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "docs": [len(out.keys)], "tokens": [out.tokens], "first": [out.keys[0]], "last": [out.keys[-1]]})

        for batch in batches:
            if words is None and batch.num_rows:
                words = WordEncoder(path)
                fs, place = pyarrow.fs.FileSystem.from_uri(folder)
                fs.create_dir(place, recursive=True)
            for part in lots(batch):
                for own, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist()), strict=True):
                    if out is None:
                        name = f"{uuid.uuid4().hex}.sst"
                        out = ShardWriter(fs.open_output_stream(f"{place}/{name}"), words.width)
                    row = row + 1 if before == (own,) else 0
                    before = (own,)
                    out.add(doc_key(own, task, row), np.append(ids, end_id))
                    if out.at + out.size >= most:
                        yield close()
                        out = None
        if out is not None:
            yield close()

    return rows.mapInArrow(tidy(run), "file string, docs long, tokens long, first binary, last binary")


def lots(batch: pa.RecordBatch, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text."""
    size = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(1)], np.int64)
    edges = np.flatnonzero(np.r_[True, np.diff(np.cumsum(size) // most) > 0, True]) if len(size) else np.zeros(1, np.int64)
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield batch.slice(i, j - i)


def read_shards(spark: SparkSession, manifest: list) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the files.  The manifest has a row per shard, so it is small."""
    order, start, rows = sorted(manifest, key=lambda r: bytes(r["first"])), 0, []
    for r in order:
        rows.append((r["file"], start))
        start += r["tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, at in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                out: list[tuple] = []
                for key, ids in ShardReader(file):
                    out.append((key_doc(key), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(out) == 5000:
                        yield batch_of(out)
                        out = []
                yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(rows, "file string, start long").repartition(max(1, len(rows)))
    return files.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "tokens") as scratch:
        shards = scratch.put(write_shards(table(spark, sf_dir, "documents"), scratch.path(), tokenizer_path()))
        return scratch.keep(read_shards(spark, shards.collect()))


QUERIES = {"op5_token_shards": op5_token_shards}
