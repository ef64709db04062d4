"""SentencePiece encoding and decoding over a relational lattice (operator 2).

Texts are cut into units that no piece reaches across.  The distinct units of
the whole corpus form a lattice: every substring of at most the longest piece's
length is exploded and equi-joined to the piece table (of checked size), the
edges are grouped by unit, and a higher-order ``aggregate`` folds them into a
segmentation.  For a unigram model the fold is Viterbi.  The public model here is
a BPE model, for which the best sum of scores is not what the library returns;
there the fold runs over the same edges and applies, again and again, the best
merge of two neighbours, leftmost first.

Texts are never shuffled.  Each task writes its documents to block files, as
numbers of distinct units, and sends the units themselves on, packed by the hash
part that they fall into.  A part's units are folded once each, and go back to
the blocks that asked for them, packed again.

Defined cases: null or empty texts have no ids; characters without a piece
become the pieces of their UTF-8 bytes; units of over ``LONG`` characters, for
which the fold's 64-bit masks are too short, are folded in Python over the same
pieces, for either kind of model; rows that share a doc_id are encoded each; null
ids are kept; other columns are ignored; round_trip is false for texts that hold
U+2581 themselves, since decoding makes spaces of them.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, parts_for, small_enough, table, tidy

#: The mark that stands for a space; characters of a unit for the fold, pieces of a model, and characters of a block, of what is cut at once and of a task's fold, about.
SPACE, LONG, MODEL, BLOCK_CHARS, LOT_CHARS, FOLD_CHARS = "▁", 58, 1_000_000, 12_000_000, 500_000, 150_000
#: A byte that no UTF-8 text has; it stands between packed units.
BETWEEN = b"\xff"


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_pieces(path: str) -> tuple[list[tuple[str, float, int]], int]:
    """(piece, score, id) of the ordinary pieces, and the id of byte 0."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [i for i in range(m.vocab_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    return [(m.id_to_piece(i), m.get_score(i), i) for i in ordinary], m.piece_to_id("<0x00>")


def joints_of(pieces: list[tuple[str, float, int]]) -> set[str]:
    return {p[k : k + 2] for p, _, _ in pieces for k in range(len(p) - 1)}


class Cutter:
    """Cuts texts into units: wherever two neighbouring characters stand together in no piece."""

    def __init__(self, joints: set[str]):
        self.joints, chars = joints, sorted({c for j in joints for c in j})
        self.kinds = len(chars) + 1
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in chars]] = np.arange(1, self.kinds)
        self.joined = np.zeros(self.kinds**2, bool)
        self.joined[[self.kind[ord(a)] * self.kinds + self.kind[ord(b)] for a, b in joints]] = True

    def chunks(self, text: str, most: int = LOT_CHARS) -> Iterator[str]:
        """The text with marks for spaces, in parts that end where no piece reaches across."""
        marked, start = SPACE + text.replace(" ", SPACE), 0
        while len(marked) - start > most:
            end = start + most
            while end < len(marked) and marked[end - 1 : end + 1] in self.joints:
                end += 1
            yield marked[start:end]
            start = end
        if start < len(marked):
            yield marked[start:]

    def cut(self, marked: list[str]) -> tuple[pa.StringArray, np.ndarray]:
        """The units of all texts one after the other, and how many each text has."""
        whole = "".join(marked)
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        ends = np.cumsum(size)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kind[points]
        opens = np.ones(len(points) + 1, bool)
        opens[1:-1] = ~self.joined[kind[:-1] * self.kinds + kind[1:]] if len(points) else True
        opens[ends] = True
        at = np.flatnonzero(opens)
        width = np.ones(len(points), np.int8)
        for edge in (0x7F, 0x7FF, 0xFFFF):
            width += points > edge
        offsets = np.r_[0, np.cumsum(width, dtype=np.int32)][at].astype(np.int32)
        counts = np.searchsorted(at, ends) - np.searchsorted(at, ends - size)
        return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(offsets), pa.py_buffer(whole.encode("utf-8", "surrogatepass"))), counts


class Block:
    """Documents as numbers of distinct units, to be written to one file."""

    def __init__(self, cutter: Cutter):
        self.cutter = cutter
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.marked: list[bool] = []
        self.lots: list[pa.DictionaryArray] = []
        self.waiting: list[str] = []
        self.owner: list[int] = []
        self.chars = self.pending = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        self.ids.append(doc_id)
        self.sizes.append(0)
        self.marked.append(bool(text) and SPACE in text)
        for chunk in self.cutter.chunks(text) if text else ():
            self.waiting.append(chunk)
            self.owner.append(len(self.ids) - 1)
            self.pending += len(chunk)
            if self.pending >= LOT_CHARS:
                self.cut()

    def cut(self) -> None:
        units, counts = self.cutter.cut(self.waiting)
        for k, n in zip(self.owner, counts.tolist(), strict=True):
            self.sizes[k] += n
        self.lots.append(units.dictionary_encode())
        self.chars += self.pending
        self.waiting, self.owner, self.pending = [], [], 0

    def numbered(self) -> tuple[np.ndarray, pa.StringArray]:
        """The number of every unit, in order, and the distinct units; the most frequent ones have the least numbers."""
        if self.waiting:
            self.cut()
        own = pa.chunked_array([x.dictionary for x in self.lots], pa.string()).combine_chunks().dictionary_encode()
        own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
        place, lo, at = own.indices.to_numpy(), 0, 0
        number = np.empty(sum(map(len, self.lots)), np.int32)
        while self.lots:  # each is let go as soon as it is copied
            x = self.lots.pop(0)
            np.take(place[lo : lo + len(x.dictionary)], x.indices.to_numpy(), out=number[at : at + len(x)])
            lo, at = lo + len(x.dictionary), at + len(x)
        order = np.argsort(-np.bincount(number, minlength=len(own.dictionary)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        for k in range(0, len(number), 1 << 20):
            number[k : k + (1 << 20)] = rank[number[k : k + (1 << 20)]]
        return number, own.dictionary.take(pa.array(order))


def unit_parts(units: pa.StringArray, parts: int) -> np.ndarray:
    """The hash part of each unit."""
    return np.fromiter(map(zlib.crc32, units.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.int64, len(units)) % parts


def planes(number: np.ndarray) -> Iterator[bytes]:
    """The bytes of like weight side by side, which compress better."""
    data = number.astype("<i4", copy=False).view(np.uint8).reshape(-1, 4)
    return (data[:, k].tobytes() for k in range(4))


def from_planes(columns: list[bytes]) -> np.ndarray:
    out = np.empty((len(columns[0]), 4), np.uint8)
    for k, c in enumerate(columns):
        out[:, k] = np.frombuffer(c, np.uint8)
    return out.reshape(-1).view("<i4")


def unit_blocks(docs: DataFrame, folder: str, joints: set[str], parts: int, chars: int = BLOCK_CHARS) -> DataFrame:
    """(block, part, units): the packed distinct units of each block of documents, by hash part; part -1, without units, stands for the block.

    The file of block b is ``folder``/b: the documents' ids, numbers of units and whether the mark is in the
    text; then the units' numbers, and the number of each unit in the order in which its parts list it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        cutter, fs, place = Cutter(joints), *pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(place, recursive=True)

        def flush(block: Block) -> pa.RecordBatch:
            name = uuid.uuid4().int >> 65
            number, units = block.numbered()
            part = unit_parts(units, parts)
            by_text = pc.sort_indices(units).to_numpy() if len(units) else np.zeros(0, np.int64)
            listed = by_text[np.argsort(part[by_text], kind="stable")]
            head = pa.RecordBatch.from_pydict({"doc_id": pa.array(block.ids, pa.int64()), "size": pa.array(block.sizes, pa.int64()), "marked": pa.array(block.marked, pa.bool_())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as out:
                out.write_batch(head)
            packed = [press(c) for c in chain([sink.getvalue().to_pybytes()], planes(number), planes(listed))]
            with fs.open_output_stream(f"{place}/{name}") as f:
                f.write(np.array([len(p) for p in packed], "<i8").tobytes() + b"".join(packed))
            edges = np.flatnonzero(np.r_[True, np.diff(part[listed]) != 0, True]) if len(listed) else np.zeros(1, np.int64)
            own = units.cast(pa.binary()).take(pa.array(listed)).to_numpy(zero_copy_only=False).tolist()
            lists = [press(BETWEEN.join(own[i:j])) for i, j in pairwise(edges.tolist())]
            asked = [-1, *part[listed][edges[:-1]].tolist()]
            return pa.RecordBatch.from_pydict({"block": pa.array([name] * len(asked), pa.int64()), "part": pa.array(asked, pa.int64()), "units": pa.array([b"", *lists], pa.binary())})

        block = Block(cutter)
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100)
                for own, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    block.add(own, text)
                    if block.chars >= chars:
                        yield flush(block)
                        block = Block(cutter)
        if block.ids:
            yield flush(block)

    return docs.mapInArrow(tidy(run), "block long, part long, units binary")


def read_block(uri: str) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """(doc_id, size, marked), the units' numbers, and the numbers in the order of the parts' lists."""
    import zstandard

    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    data = fs.open_input_file(path).read()
    at = np.r_[72, 72 + np.cumsum(np.frombuffer(data, "<i8", 9))].tolist()
    head, *columns = (zstandard.ZstdDecompressor().decompress(data[i:j]) for i, j in pairwise(at))
    del data
    return pa.ipc.open_stream(head).read_all().combine_chunks().to_batches()[0], from_planes(columns[:4]), from_planes(columns[4:])


def ragged(flat: np.ndarray, starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The lists number ``at`` one after the other; list k is flat[starts[k]:starts[k + 1]]."""
    first, size = starts[at], starts[at + 1] - starts[at]
    shift = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) if len(at) else np.zeros(0, np.int64)
    return flat[shift + np.arange(len(shift))]


def distinct_units(lists: DataFrame) -> DataFrame:
    """(unit, n): each unit of the packed lists once, with its part as n."""

    def run(rows: pa.Table) -> pa.Table:
        import zstandard

        units: set[bytes] = set()
        for x in rows.column("units").to_pylist():
            units.update(zstandard.ZstdDecompressor().decompress(x).split(BETWEEN))
        return pa.table({"unit": pa.array(list(units), pa.binary()).cast(pa.string()), "n": pa.array([rows.column("part")[0].as_py()] * len(units), pa.int64())})

    return lists.groupBy("part").applyInArrow(run, "unit string, n long")


def lattice(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """``units`` (unit, n) -> (unit, n, edges) with edges sorted by falling score, then place.

    An edge is a piece at place s (from 0) of length l; ``ends`` and ``inner`` have a bit for the places that
    bound it and those inside.  ``units`` should be partitioned by unit: then nothing is shuffled here.
    """
    if not small_enough(pieces, MODEL):
        raise ValueError(f"a model has at most {MODEL} pieces")
    at = units.select("unit", "n", F.explode(F.expr("sequence(0, length(unit) - 1)")).alias("s"))
    spans = at.select("unit", "n", "s", F.explode(F.expr(f"sequence(1, least({longest}, length(unit) - s))")).alias("l"))
    spans = spans.withColumn("piece", F.expr("substring(unit, s + 1, l)"))
    edge = F.expr("struct(-score AS cost, s, l, shiftleft(1L, s) | shiftleft(1L, s + l) AS ends, shiftleft(shiftleft(1L, l) - 2L, s) AS inner, id)")
    # The first character stays even without a piece, so that no unit is lost.
    met = spans.join(F.broadcast(pieces), "piece", "left").where("id IS NOT NULL OR (s = 0 AND l = 1)")
    return met.groupBy("unit", "n").agg(F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), edge))).alias("edges"))


#: Places that bound the segments, as bits, after all merges.  A merge whose ends are no longer places never comes back.
MERGED = """
aggregate(sequence(2, length(unit)), struct(shiftleft(1L, length(unit) + 1) - 1L AS mask, merges AS left), (a, k) ->
  element_at(transform(array(a.mask & ~coalesce(get(filter(a.left, e -> bit_count(a.mask & e.inner) = 1), 0).inner, 0L)), m ->
    struct(m AS mask, if(m = a.mask, slice(a.left, 1, 0), filter(a.left, e -> (m & e.ends) = e.ends AND (m & e.inner) <> 0L)) AS left)), 1), a -> a.mask)"""
#: The best path to every place: its cost, the place before and the piece; a character without a piece costs UNKNOWN and has piece -1.
VITERBI = """
aggregate(sequence(1, length(unit)), array(struct(0D AS cost, -1 AS s, -1 AS id)), (best, j) ->
  concat(best, array(coalesce(
    array_min(transform(filter(edges, e -> e.s + e.l = j AND best[e.s].cost IS NOT NULL), e -> struct(best[e.s].cost + e.cost AS cost, e.s AS s, e.id AS id))),
    struct(best[j - 1].cost + {unknown}D AS cost, j - 1 AS s, -1 AS id)))))"""
#: Bits of the places on the best path, found backwards.
PATH = """
aggregate(reverse(sequence(1, length(unit))), struct(shiftleft(1L, length(unit)) AS mask, length(unit) AS j), (a, k) ->
  if(k = a.j, struct(a.mask | shiftleft(1L, best[k].s) AS mask, best[k].s AS j), a), a -> a.mask)"""
#: The edges that the segments are.
CHOSEN = "sort_array(transform(filter(edges, e -> (mask & e.ends) = e.ends AND (mask & e.inner) = 0L), e -> struct(e.s AS s, e.id AS id)))"
#: The ids of the segments; one without a piece is a character that becomes its bytes.
IDS = """
CASE WHEN size(chosen) = bit_count(mask) - 1 THEN chosen.id ELSE
flatten(transform(filter(sequence(0, length(unit) - 1), i -> (shiftright(mask, i) & 1L) = 1L), i -> coalesce(
  get(transform(filter(chosen, e -> e.s = i), e -> array(e.id)), 0),
  transform(sequence(1, octet_length(substring(unit, i + 1, 1))), k ->
    {first} + cast(conv(substring(hex(encode(substring(unit, i + 1, 1), 'UTF-8')), 2 * k - 1, 2), 16, 10) AS int))))) END"""


def merge_long(unit: str, scores: dict[str, tuple[float, int]], first_byte: int) -> list[int]:
    """The same merges with a heap, for units too long for the bits of the fold."""
    n = len(unit)
    left, right, end = list(range(-1, n - 1)), [*range(1, n), -1], list(range(1, n + 1))
    heap: list[tuple[float, int, int, int]] = []

    def offer(a: int) -> None:
        if (b := right[a]) >= 0 and (known := scores.get(unit[a : end[b]])):
            heapq.heappush(heap, (-known[0], a, end[a], end[b]))

    for k in range(n):
        offer(k)
    while heap:
        _, a, middle, stop = heapq.heappop(heap)
        b = right[a]
        if end[a] != middle or b < 0 or end[b] != stop or end[a] == 0:
            continue
        end[a], right[a], end[b] = stop, right[b], 0
        if right[a] >= 0:
            left[right[a]] = a
        offer(a)
        if left[a] >= 0:
            offer(left[a])
    out, k = [], 0
    while 0 <= k < n:
        known = scores.get(unit[k : end[k]])
        out += [known[1]] if known else [first_byte + x for x in unit[k : end[k]].encode()]
        k = right[k]
    return out


def viterbi_long(unit: str, scores: dict[str, tuple[float, int]], first_byte: int, longest: int, unknown: float) -> list[int]:
    """The same best path, for units too long for the bits of the fold."""
    best: list[tuple[float, int, int]] = [(0.0, -1, -1)]
    for j in range(1, len(unit) + 1):
        known = [(best[i][0] - x[0], i, x[1]) for i in range(max(0, j - longest), j) if (x := scores.get(unit[i:j]))]
        best.append(min(known) if known else (best[j - 1][0] + unknown, j - 1, -1))
    out: list[list[int]] = []
    j = len(unit)
    while j:
        _, i, piece = best[j]
        out.append([piece] if piece >= 0 else [first_byte + x for x in unit[i:j].encode()])
        j = i
    return [x for part in reversed(out) for x in part]


def fold(edges: DataFrame, kind: str, first_byte: int, unknown: float = 20.0) -> DataFrame:
    """(unit, n, edges) -> (unit, n, ids).  ``kind`` is "bpe" or "unigram"."""
    if kind == "bpe":
        masked = edges.withColumn("merges", F.expr("filter(edges, e -> e.l > 1)")).withColumn("mask", F.expr(f"if(size(merges) = 0, shiftleft(1L, length(unit) + 1) - 1L, {MERGED})"))
    elif kind == "unigram":
        masked = edges.withColumn("best", F.expr(VITERBI.format(unknown=unknown))).withColumn("mask", F.expr(PATH))
    else:
        raise ValueError(f"no such kind of model: {kind}")
    return masked.withColumn("chosen", F.expr(CHOSEN)).select("unit", "n", F.expr(IDS.format(first=first_byte)).alias("ids"))


def encode_units(units: DataFrame, pieces: list[tuple[str, float, int]], first_byte: int, kind: str = "bpe", unknown: float = 20.0) -> DataFrame:
    """``units`` (unit, n) with distinct units, none empty -> (unit, n, ids).  n is a number that stays with its unit."""
    spark = units.sparkSession
    model = spark.createDataFrame(pieces, "piece string, score double, id int")
    longest = max(len(p) for p, _, _ in pieces)
    folded = fold(lattice(units.where(F.length("unit") <= LONG), model, longest), kind, first_byte, unknown)
    scores = {p: (s, i) for p, s, i in pieces}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, u in enumerate(batch.column(0).to_pylist()):
                ids = merge_long(u, scores, first_byte) if kind == "bpe" else viterbi_long(u, scores, first_byte, longest, unknown)
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, pa.array([ids], pa.list_(pa.int32()))], ["unit", "n", "ids"])

    return folded.unionByName(units.where(F.length("unit") > LONG).select("unit", "n").mapInArrow(tidy(run), "unit string, n long, ids array<int>"))


def fold_parts(units: DataFrame, parts: int) -> int:
    """A number of partitions for the fold, ``parts`` at least: it sorts the edges of all units of a task, many times their characters."""
    chars = units.where(F.length("unit") <= LONG).agg(F.sum(F.length("unit"))).first()[0] or 0
    return max(parts, -(-chars // FOLD_CHARS))


def spelt(units: pa.Array, ids: pa.ListArray, names: dict[int, str], first_byte: int) -> np.ndarray:
    """Whether the ids of each unit decode to it."""
    flat = ids.values.to_numpy(zero_copy_only=False)[ids.offsets[0].as_py() : ids.offsets[-1].as_py()]
    known = np.array([i in names for i in range(int(flat.max(initial=0)) + 1)], bool)
    text = pa.array([names.get(i, "") for i in range(len(known))], pa.string()).take(pa.array(flat))
    offsets = ids.offsets.to_numpy() - ids.offsets[0].as_py()
    same = pc.equal(pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), text), ""), units).to_numpy(zero_copy_only=False).astype(bool)
    for k in np.flatnonzero(~same).tolist():  # some are bytes
        same[k] = decode_bytes(flat[offsets[k] : offsets[k + 1]].tolist(), names, first_byte) == units[k].as_py().encode()
    return same


def answers(coded: DataFrame, lists: DataFrame, pieces: list[tuple[str, float, int]], first_byte: int) -> DataFrame:
    """(block, part, ids) per packed list: for its units in order the numbers of ids, whether they decode to the unit, and the ids."""
    names = {i: p for p, _, i in pieces}

    def run(known: pa.Table, asked: pa.Table) -> pa.Table:
        import zstandard

        out = []
        if asked.num_rows:
            ids, units = (known.column(c).combine_chunks() for c in ("ids", "unit"))
            flat, starts = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy().astype(np.int64)
            same = spelt(units, ids, names, first_byte)
            place = dict(zip(units.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), range(len(units)), strict=True))
            for x in asked.column("units").to_pylist():
                own = zstandard.ZstdDecompressor().decompress(x).split(BETWEEN)
                at = np.fromiter(map(place.__getitem__, own), np.int64, len(own))
                size = (starts[at + 1] - starts[at]).astype("<u4")
                out.append(zstandard.ZstdCompressor(level=3).compress(np.array([len(at)], "<u4").tobytes() + size.tobytes() + same[at].tobytes() + ragged(flat, starts, at).astype("<u4").tobytes()))
        return pa.table({"block": asked.column("block"), "part": asked.column("part"), "ids": pa.array(out, pa.binary())})

    return coded.groupBy("n").cogroup(lists.groupBy("part")).applyInArrow(run, "block long, part long, ids binary")


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of ids, whether they decode to the unit, ids."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    return np.frombuffer(data, "<u4", n, 4), np.frombuffer(data, bool, n, 4 + 4 * n), np.frombuffer(data, "<u4", -1, 4 + 5 * n) if len(data) > 4 + 5 * n else np.zeros(0, "<u4")


def decode_bytes(ids: list[int], pieces: dict[int, str], first_byte: int) -> bytes:
    return b"".join(pieces[i].encode() if i in pieces else bytes([i - first_byte]) for i in ids)


def decode(ids: list[int], pieces: dict[int, str], first_byte: int) -> str:
    """The text of ids; bytes that form no character become replacement characters."""
    text = decode_bytes(ids, pieces, first_byte).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


def encode_documents(docs: DataFrame, scratch: Scratch, path: str, kind: str = "bpe", text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip) per row, and ids where asked for.

    ids_crc32 is that of the ids as little-endian unsigned 32-bit integers; round_trip tells whether decoding
    gives the text back.
    """
    pieces, first_byte = read_pieces(path)
    folder, parts = scratch.path(), parts_for(docs)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    lists = scratch.put(unit_blocks(texts, folder, joints_of(pieces), parts))
    asked = lists.where("part >= 0")
    units = scratch.put(distinct_units(asked))
    scratch.sweep()
    coded = scratch.put(encode_units(units.repartition(fold_parts(units, parts), "unit"), pieces, first_byte, kind))
    scratch.sweep()
    scratch.drop(units)
    whole = lists.where("part < 0").select("block", "part", F.col("units").alias("ids")).unionByName(answers(coded, asked, pieces, first_byte))
    told = whole.repartition(parts, "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                head, number, listed = read_block(f"{folder}/{name}")
                found = [unpack(x) for x in own.values.field("ids").to_pylist()[1:]]
                size, same, flat = (np.concatenate([np.zeros(0, t), *(f[k] for f in found)]) for k, t in enumerate((np.int64, bool, "<u4")))
                # From the order of the lists to that of the numbers.
                starts = np.r_[0, np.cumsum(size)]
                order = np.empty(len(listed), np.int64)
                order[listed] = np.arange(len(listed))
                flat, size, same = ragged(flat, starts, order), size[order], same[order]
                starts = np.r_[0, np.cumsum(size)]
                sizes = head.column(1).to_numpy()
                ends = np.cumsum(sizes)
                for lo in range(0, len(sizes), 200):
                    hi = min(lo + 200, len(sizes))
                    some = number[ends[lo] - sizes[lo] : ends[hi - 1]]
                    ids, good = ragged(flat, starts, some), np.r_[0, np.cumsum(~same[some])]
                    bound = np.r_[0, ends[lo:hi] - ends[lo] + sizes[lo]]
                    at = np.r_[0, np.cumsum(size[some])][bound]
                    view = memoryview(ids).cast("B")
                    crc = [zlib.crc32(view[4 * i : 4 * j]) for i, j in pairwise(at.tolist())]
                    back = (np.diff(good[bound]) == 0) & ~head.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                    columns = [head.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array(back)]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_crc32", "round_trip", *(["ids"] if with_ids else [])])

    return told.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean" + (", ids array<int>" if with_ids else ""))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "pieces") as scratch:
        return scratch.keep(encode_documents(table(spark, sf_dir, "documents"), scratch, model_path()))


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
