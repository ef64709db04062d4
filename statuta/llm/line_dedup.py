"""Removal of lines that many documents repeat (operator 4).

Only 128-bit hashes of line keys leave the documents, with the positions of their
first lines.  They are range-partitioned by (hash, document) and sorted within
partitions by hash, document and position, so one pass over each partition sees every document of a hash in turn and keeps nothing but
the current run.  A hash that a third of all documents share spreads over many
partitions; each sends one partial run, and those are added up.  What comes
back to a document is the list of its hashes to drop, and the result is a
compressed bitmap of the lines to keep.

Defined cases: null or empty text is one empty line; rows that share a doc_id
count as one document, and each is cut by its own lines; a null doc_id counts
as one document below all others; repeated lines within the last document that
holds them all stay; other columns pass through untouched in ``drop_lines``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Scratch, fresh, table, tidy

MIN_CHARS, MIN_DOCS = 40, 5
STRIP = ASCII_SPACE.encode()


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """16 bytes that stand for the key of a line, or None where the key is too short.  bytes.lower changes A-Z only."""
    key = line.strip(STRIP).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def pack_bitmap(keep: list[bool]) -> bytes:
    """Bit k of the unpacked bytes, lowest first, is 1 where line k stays."""
    return zlib.compress(np.packbits(np.array(keep, dtype=bool), bitorder="little").tobytes(), 1)


def run_lengths(keep: list[bool]) -> str:
    """The bitmap as numbers of lines kept, dropped, kept and so on; the first is 0 where the first line goes."""
    edges = [k for k in range(1, len(keep)) if keep[k] != keep[k - 1]]
    lengths = [b - a for a, b in pairwise([0, *edges, len(keep)])]
    return ",".join(map(str, lengths if keep[0] else [0, *lengths]))


def kept_text(text: str | None, bitmap: bytes) -> str:
    lines = (text or "").split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines), bitorder="little")
    return "\n".join(x for x, k in zip(lines, bits, strict=True) if k)


def _keys(docs: DataFrame, text: str, doc_id: str, min_chars: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, keys, places = batch.column(0), [], [], []
            for row, value in enumerate(batch.column(1)):
                if value.is_valid:
                    own: dict[bytes, int] = {}
                    for at, x in enumerate(value.as_buffer().to_pybytes().split(b"\n")):
                        if k := line_key(x, min_chars):
                            own.setdefault(k, at)
                    keys.extend(own)
                    places.extend(own.values())
                    rows.extend([row] * len(own))
            h = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), ids.take(pa.array(rows, pa.int64())), pa.array(places, pa.int32())], ["h1", "h2", "doc_id", "pos"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(tidy(run), "h1 long, h2 long, doc_id long, pos int")


def _runs(min_docs: int):
    """Streams sorted (h1, h2, doc_id) into (h1, h2, documents, largest document) per run of a hash.

    Only the last row of a batch is carried to the next.  A run that touches an edge of its batch may
    go on beyond it, so it comes out as a part, whatever its length; inside, short runs are complete
    and of no interest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            null = batch.column(2).is_null().to_numpy(zero_copy_only=False)
            doc = batch.column(2).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            new_run = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            new_doc = new_run | np.r_[True, (doc[1:] != doc[:-1]) | (null[1:] != null[:-1])]
            new_doc[0] = before != (h1[0], h2[0], doc[0], null[0])
            before = h1[-1], h2[-1], doc[-1], null[-1]
            at = np.flatnonzero(new_run)
            counts, last = np.add.reduceat(new_doc.astype(np.int64), at), np.maximum.reduceat(doc, at)
            out = counts >= min_docs
            out[[0, -1]] = True
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (h1[at], h2[at], counts, last)], ["h1", "h2", "docs", "last"])

    return run


def repeated_lines(docs: DataFrame, scratch: Scratch, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, drop) per document that loses lines: the 16-byte hashes of the keys that it loses."""
    keys = scratch.put(_keys(docs, text, doc_id, min_chars))
    ranged = keys.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    runs = ranged.mapInArrow(_runs(min_docs), "h1 long, h2 long, docs long, last long")
    hot = scratch.put(runs.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("last").alias("last")).where(F.col("docs") >= min_docs).drop("docs"))
    lost = keys.join(hot, ["h1", "h2"]).where("doc_id is null or doc_id < last")
    return lost.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))


def _cut(docs: DataFrame, drops: DataFrame, text: str, doc_id: str, min_chars: int, whole: bool) -> DataFrame:
    """Each row with the kept text in place of ``text``, or else with its line counts, bitmap and digest in place of it."""
    names = docs.columns
    own, lost = fresh("id", names), fresh("drop", names)
    drops = drops.select(F.col("id").alias(own), F.col("drop").alias(lost))
    joined = docs.join(drops, F.col(doc_id).eqNullSafe(F.col(own)), "left").select(*names, lost)
    at = names.index(text)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    if not whole:
        names, kinds = [n for n in names if n != text], [k for n, k in zip(names, kinds, strict=True) if n != text]
    more_names = [] if whole else ["n_lines", "n_dropped", "keep_bitmap", "kept_sha256", "keep_runs"]
    kinds += [] if whole else ["n_lines long", "n_dropped long", "keep_bitmap binary", "kept_sha256 string", "keep_runs string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in (big.slice(k, 1000) for k in range(0, big.num_rows, 1000)):
                texts, counts, dropped, bitmaps, digests, runs = [], [], [], [], [], []
                for value, drop in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                    data = value.as_buffer().to_pybytes() if value.is_valid else b""
                    lines = data.split(b"\n")
                    lost = {d["h1"].to_bytes(8, "little", signed=True) + d["h2"].to_bytes(8, "little", signed=True) for d in drop.as_py() or ()}
                    keep = [line_key(x, min_chars) not in lost for x in lines] if lost else [True] * len(lines)
                    gone = len(keep) - sum(keep)
                    if gone:
                        data = b"\n".join(x for x, k in zip(lines, keep, strict=True) if k)
                    counts.append(len(lines))
                    dropped.append(gone)
                    if whole:
                        texts.append(data.decode("utf-8", "replace"))
                    else:
                        bitmaps.append(pack_bitmap(keep))
                        digests.append(hashlib.sha256(data).hexdigest())
                        runs.append(run_lengths(keep))
                columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns[:-1]) if whole or k != at]
                more = [] if whole else [pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(bitmaps, pa.binary()), pa.array(digests, pa.string()), pa.array(runs, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *more], [*names, *more_names])

    return joined.mapInArrow(tidy(run), ", ".join(kinds))


def keep_bitmaps(docs: DataFrame, scratch: Scratch, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, keep_bitmap, kept_sha256, keep_runs) per row; see ``kept_text`` for the way back to a text."""
    drops = repeated_lines(docs, scratch, text, doc_id, min_chars, min_docs)
    return _cut(docs.select(doc_id, text), drops, text, doc_id, min_chars, whole=False)


def drop_lines(docs: DataFrame, scratch: Scratch, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The same rows and columns, their texts without the repeated lines.  The list of lines to drop stays in the shared folder until it is swept."""
    drops = scratch.side(repeated_lines(docs, scratch, text, doc_id, min_chars, min_docs))
    return _cut(docs, drops, text, doc_id, min_chars, whole=True)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "lines") as scratch:
        # SQL knows no zlib; the run lengths say what the bitmaps say.
        return scratch.keep(keep_bitmaps(table(spark, sf_dir, "documents"), scratch).drop("keep_bitmap"))


SQL_LINES = r"""
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT keyed.doc_id, pos, line, coalesce(keyed.doc_id < hot.last, false) AS gone FROM keyed LEFT JOIN hot ON keyed.k = hot.k)"""
SQL = {
    "op4_line_dedup": f"""WITH docs AS (SELECT doc_id, text FROM documents), {SQL_LINES},
islands AS (SELECT doc_id, gone, min(pos) AS first, count(*) AS n FROM
  (SELECT doc_id, gone, pos, pos - row_number() OVER (PARTITION BY doc_id, gone ORDER BY pos) AS island FROM marked) GROUP BY doc_id, gone, island),
runs AS (SELECT doc_id, CASE WHEN arg_min(gone, first) THEN '0,' ELSE '' END || string_agg(CAST(n AS VARCHAR), ',' ORDER BY first) AS keep_runs FROM islands GROUP BY doc_id)
SELECT marked.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256, any_value(keep_runs) AS keep_runs
FROM marked JOIN runs ON marked.doc_id = runs.doc_id GROUP BY marked.doc_id"""
}
QUERIES = {"op4_line_dedup": op4_line_dedup}
