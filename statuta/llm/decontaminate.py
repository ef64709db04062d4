"""Benchmark decontamination by latent semantic retrieval (operator 3).

Passages are windows of 32 words, every 16 words, weighted by TF-IDF over the
benchmark's vocabulary; document frequencies come from all documents.  A
distributed randomised SVD of the benchmark's passages and of the windows of all
documents gives the latent space.  Every window of every document is
projected and compared by cosine with every benchmark passage, block by block.
Common words weigh little, so a window's other words may hide a copy of such an
item: places that share a run of ``SHORT`` words with an item are candidates too,
whatever their cosine.
Candidates are confirmed on the words around them: the longest common
subsequence with the item, and with the item's answer (its last sentence), which
finds paraphrases that keep the answer.

There is no shuffle of texts, and no limit on candidates.  The benchmark is
taken in blocks of at most ``ITEMS`` items and about ``CHARS`` characters, so what a task
holds has a bound, but for a single item that is longer.  For each block the texts
are divided into words once and written as numbers of the block's terms; frequencies,
the space and the search read those.

Defined cases: null or empty texts and items match nothing; items shorter than
``SHORT`` words match only if all their words follow each other; repeated items
each give their rows; rows that share a doc_id are searched each by its text
and give distinct rows; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Hashable, Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, table, tidy

BLOCK, SHORT, ITEMS, CHARS = 16, 8, 5_000, 2_000_000
#: What is laid out at once: documents, and words but for a single document that has more.
DOCS, WORDS = 200, 200_000
RANK, EXTRA, OWN = 128, 16, 4.0
COSINE = 0.45
#: Shares of an item's words in common order that tell a copy; a paraphrase, if the share of its answer is reached too.
COPY, PARAPHRASE, ANSWER = 0.8, 0.55, 0.8
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def answer_of(text: str) -> list[str]:
    """The last sentence of at least three words."""
    for part in reversed(re.split(r"[.!?\n]+", text)):
        if len(found := words_of(part)) >= 3:
            return found
    return words_of(text)


def common_subsequence(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Length of the longest common subsequence, by bit-parallel columns."""
    where: dict[Hashable, int] = {}
    for k, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if m := where.get(w):
            x = row & m
            row = (row + x | row - x) & full
    return len(a) - row.bit_count()


def run_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n terms from each place on; equal runs have equal ones."""
    weights = np.random.Generator(np.random.PCG64(8)).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for k in range(n):
        out += (ids[k : k + len(out)].astype(np.uint64) + np.uint64(1)) * weights[k]
    return out


def contains(a: list[int], b: list[int]) -> bool:
    return any(b[k : k + len(a)] == a for k in range(len(b) - len(a) + 1))


def code_of(none: int) -> str:
    """How terms are written; ``none`` stands for all words that are no term, and is the number of terms."""
    return "<u2" if none < 1 << 16 else "<u4"


def coded(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """(doc_id, ids) of ``docs`` (doc_id, text): the term of each word."""
    none = len(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (words_of(x.as_py()) for x in batch.column(1))
            ids = [np.fromiter(map(terms.get, w, repeat(none)), code_of(none), len(w)).tobytes() for w in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.mapInArrow(tidy(run), "doc_id long, ids binary")


def portions(column: pa.Array, none: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The documents of a column of ``coded``, some at a time, and the row of the first of them."""
    part, held, first = [], 0, 0
    for k, x in enumerate(column):
        ids = np.frombuffer(x.as_py(), code_of(none))
        if part and (len(part) == DOCS or held + len(ids) > WORDS):
            yield first, part
            part, held, first = [], 0, k
        part.append(ids)
        held += len(ids)
    if part:
        yield first, part


@dataclass
class Layout:
    """Documents in rows of ``BLOCK`` terms, padded with ``none``."""

    table: np.ndarray
    owner: np.ndarray  # the document of each row
    joined: np.ndarray  # whether the next row is of the same document
    ids: np.ndarray  # the term of each word, and its document, place and row
    doc: np.ndarray
    place: np.ndarray
    row: np.ndarray

    @classmethod
    def of(cls, docs: list[np.ndarray], none: int) -> Layout:
        size = np.array([len(d) for d in docs], np.int64)
        rows = -(-size // BLOCK)
        first_row, first_word = np.r_[0, np.cumsum(rows)], np.r_[0, np.cumsum(size)]
        ids = np.concatenate([np.zeros(0, np.int64), *docs]).astype(np.int64)
        doc = np.repeat(np.arange(len(docs)), size)
        place = np.arange(len(ids)) - first_word[doc]
        row = first_row[doc] + place // BLOCK
        table = np.full((int(first_row[-1]), BLOCK), none)
        table[row, place % BLOCK] = ids
        owner = np.repeat(np.arange(len(docs)), rows)
        return cls(table, owner, np.r_[owner[1:] == owner[:-1], np.zeros(min(1, len(owner)), bool)], ids, doc, place, row)

    def projected(self, project: np.ndarray) -> np.ndarray:
        """Of each window, a row and the next one of its document, the sum of its terms' rows in ``project``; that of ``none`` must be zero."""
        out = np.empty((len(self.table), project.shape[1]), np.float32)
        for lo in range(0, len(out), 1024):  # stays in the processor's cache
            part, table = out[lo : lo + 1024], self.table[lo : lo + 1024]
            np.take(project, table[:, 0], axis=0, out=part, mode="clip")
            for k in range(1, BLOCK):
                part += project[table[:, k]]
        out[:-1] += np.where(self.joined[:-1, None], out[1:], 0)
        return out

    def squares(self, idf: np.ndarray) -> np.ndarray:
        """The squared length of each window's TF-IDF row; zero for a last row that the window before it holds too."""
        none = len(idf)
        code = self.table.astype(code_of(none))
        both = np.hstack([code, np.where(self.joined[:, None], np.roll(code, -1, axis=0), code.dtype.type(none))])
        both.sort(axis=1)
        both = np.ascontiguousarray(both.T)
        weight = np.r_[idf**2, 0]
        run, out = np.ones(both.shape[1]), weight[both[0]]
        for k in range(1, len(both)):
            run = np.where(both[k] == both[k - 1], run + 1, 1)
            out += weight[both[k]] * (2 * run - 1)  # n * n is the sum of the first n odd numbers
        out[1:][self.joined[:-1] & ~self.joined[1:]] = 0
        return out

    def collected(self, rows: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
        """The terms, and for each the sum of ``rows`` over its words."""
        at = np.flatnonzero(self.ids < none)
        at = at[np.argsort(self.ids[at].astype(code_of(none)), kind="stable")]
        terms, first, n = np.unique(self.ids[at], return_index=True, return_counts=True)
        # A term's words in lines of 8, padded with a row of zeros: whole arrays are added, and few lines are left.
        lines = -(-n // 8)
        first_line = np.r_[0, np.cumsum(lines)]
        rank = np.arange(len(at)) - np.repeat(first, n)
        where = np.full((int(first_line[-1]), 8), len(rows))
        where[np.repeat(first_line[:-1], n) + rank // 8, rank % 8] = self.row[at]
        rows = np.vstack([rows, np.zeros((1, rows.shape[1]), rows.dtype)])
        sums = np.empty((len(where), rows.shape[1]), rows.dtype)
        for lo in range(0, len(where), 1024):
            part = sums[lo : lo + 1024]
            np.take(rows, where[lo : lo + 1024, 0], axis=0, out=part, mode="clip")
            for k in range(1, 8):
                part += rows[where[lo : lo + 1024, k]]
        return terms, np.add.reduceat(sums, first_line[:-1], axis=0) if len(terms) else sums


@dataclass
class Index:
    """One block of the benchmark: the projection of each of its terms, and its passages in the latent space."""

    project: np.ndarray  # a row a term, idf times its singular directions; the last is zero
    queries: np.ndarray  # a row a passage, of length 1
    item: np.ndarray  # the item of each passage
    least: np.ndarray  # the cosine that a window must have with each passage
    floor: np.ndarray  # windows lighter than this are divided by it instead of by their own length, for each passage
    ids: list
    words: list[list[int]]
    answers: list[list[int]]

    def __post_init__(self) -> None:
        self.counts = [Counter(w) for w in self.words]
        #: By length: hashes in order, and the item and place of each.
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in {min(SHORT, len(w)) for w in self.words}:
            own = [k for k, w in enumerate(self.words) if min(SHORT, len(w)) == n]
            hashes = [run_hashes(np.array(self.words[k]), n) for k in own]
            item, place = np.repeat(own, [len(h) for h in hashes]), np.concatenate([np.arange(len(h)) for h in hashes])
            order = np.argsort(keys := np.concatenate(hashes), kind="stable")
            self.runs[n] = keys[order], item[order], place[order]
        #: The first passage of each item.
        self.first = np.searchsorted(self.item, np.arange(len(self.words)))

    def shared_runs(self, laid: Layout) -> Iterator[tuple[int, int, int]]:
        """(document, item, word where the item would begin) of all runs that stand in an item too."""
        foreign = np.r_[0, np.cumsum(laid.ids == len(self.project) - 1)]
        for n, (keys, item, offset) in self.runs.items():
            hashes = run_hashes(laid.ids, n)
            # A run of an item has terms only.
            at = np.flatnonzero((foreign[n:] == foreign[:-n])[: len(hashes)] & (laid.doc[: len(hashes)] == laid.doc[n - 1 :]))
            lo, hi = np.searchsorted(keys, hashes[at], "left"), np.searchsorted(keys, hashes[at], "right")
            for j in np.flatnonzero(hi > lo).tolist():
                p = at[j]
                for k in range(int(lo[j]), int(hi[j])):
                    yield int(laid.doc[p]), int(item[k]), max(0, int(laid.place[p] - offset[k]))

    def candidates(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, float]]:
        """(document, item, first word, cosine) of all windows and passages that are near enough."""
        laid = Layout.of(docs, len(self.project) - 1)
        latent, owner = laid.projected(self.project), laid.owner
        opening = np.searchsorted(owner, np.arange(len(docs)))
        start = (np.arange(len(latent)) - opening[owner]) * BLOCK
        for lo in range(0, len(latent), 2048):
            part = latent[lo : lo + 2048]
            length = np.sqrt(np.einsum("ij,ij->i", part, part))
            near = (part / np.maximum(length, 1e-30)[:, None]) @ self.queries.T
            w, q = np.nonzero(near >= self.least)
            # The cosine with the floor in place of a smaller length.
            cosine = near[w, q] * length[w] / np.maximum(np.maximum(length[w], self.floor[q]), 1e-30)
            near_enough = np.flatnonzero(cosine >= self.least[q])
            w, q = w[near_enough] + lo, q[near_enough]
            yield from zip(owner[w].tolist(), self.item[q].tolist(), start[w].tolist(), cosine[near_enough].tolist(), strict=True)
        for d, i, at in dict.fromkeys(self.shared_runs(laid)):
            v, j = latent[opening[d] + at // BLOCK], self.first[i]
            yield d, i, at, float(v @ self.queries[j]) / max(float(np.sqrt(v @ v)), float(self.floor[j]), 1e-12)

    def leaks(self, docs: list[np.ndarray]) -> list[tuple[int, int, float, float, float]]:
        """(document, item, cosine, share, share of the answer) per confirmed pair, the best of its windows."""
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        tried: set[tuple[int, int, int]] = set()
        for d, i, at, cosine in self.candidates(docs):
            if (d, i, at) in tried:
                continue
            tried.add((d, i, at))
            words = self.words[i]
            region = docs[d][max(0, at - len(words)) : at + 2 * BLOCK + len(words)].tolist()
            counts = self.counts[i]
            if sum(map(counts.__getitem__, counts.keys() & set(region))) < PARAPHRASE * len(words):
                continue  # even all shared words in order would be too few
            share = common_subsequence(words, region) / len(words)
            if share < PARAPHRASE:
                continue
            answer = common_subsequence(self.answers[i], region) / len(self.answers[i])
            if not (share >= COPY or answer >= ANSWER) or len(words) < SHORT and not contains(words, region):
                continue
            best[d, i] = max(best.get((d, i), (0.0, 0.0, 0.0)), (share, answer, cosine))
        return [(d, i, c, s, a) for (d, i), (s, a, c) in best.items()]


def passages_of(words: list[int]) -> list[list[int]]:
    n = len(words)
    if n <= 2 * BLOCK:
        return [words]
    return [words[k : k + 2 * BLOCK] for k in sorted({*range(0, n - 2 * BLOCK, BLOCK), n - 2 * BLOCK})]


def document_frequencies(docs: DataFrame, none: int) -> np.ndarray:
    """Of each term, over all documents; the number of documents last.  A task sends one row per term that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(none + 1, np.int64)
        for batch in batches:
            for _, part in portions(batch.column(0), none):
                laid = Layout.of(part, none)
                term = np.unique(laid.doc * (none + 1) + laid.ids) % (none + 1)
                seen += np.bincount(term[term < none], minlength=none + 1)
                seen[-1] += len(part)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["term", "n"])

    out = np.zeros(none + 1, np.int64)
    for r in docs.select("ids").mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def multiplied(docs: list[np.ndarray], idf: np.ndarray, project: np.ndarray, total: np.ndarray) -> int:
    """Adds to ``total`` the product of the transposed rows of all windows, each of length 1, with the rows times a matrix,
    but for the factor ``idf``; ``project`` is ``idf`` times that matrix.  Returns the number of windows with a term."""
    laid = Layout.of(docs, len(idf))
    if not len(laid.table):
        return 0
    square = laid.squares(idf)
    live = square > 0
    rows = laid.projected(project) * np.divide(1, square, where=live, out=np.zeros_like(square))[:, None].astype(np.float32)
    # A word is in the window that begins with its row and in the one before.
    rows[1:] += np.where(laid.joined[:-1, None], rows[:-1].copy(), 0)
    terms, sums = laid.collected(rows, len(idf))
    total[terms] += sums
    return int(live.sum())


def gram_product(docs: DataFrame, idf: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, int]:
    """The product of A'A with ``basis`` and the number of rows of A, the normalised TF-IDF rows of all windows of ``docs`` (ids).

    Each task multiplies its rows by the thin matrix and back; its sums are added up by term, so
    the driver gets terms x width numbers whatever the number of rows.
    """
    none, width = basis.shape
    project = np.vstack([idf[:, None] * basis, np.zeros((1, width))]).astype(np.float32)
    kind = "k long, v binary"

    def as_batch(rows: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([v.tobytes() for v in rows.values()], pa.binary())], ["k", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((none, width))
        n = sum(multiplied(part, idf, project, total) for batch in batches for _, part in portions(batch.column(0), none))
        yield as_batch({none: np.array([n], float)} | {int(k): total[k] for k in np.flatnonzero(total.any(axis=1))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = np.frombuffer(v.as_py())
                sums[k] = sums[k] + row if k in sums else row
        yield as_batch(sums)

    out, n = np.zeros((none, width)), 0
    for r in docs.select("ids").mapInArrow(tidy(run), kind).repartition("k").mapInArrow(tidy(add), kind).collect():
        row = np.frombuffer(r["v"])
        if r["k"] == none:
            n = int(row[0])
        else:
            out[r["k"]] = row
    return idf[:, None] * out, n


def latent_space(docs: DataFrame, passages: list[np.ndarray], idf: np.ndarray, rank: int, seed: int = 3) -> np.ndarray:
    """Right singular directions (terms x rank) of the rows of all windows of ``docs`` and of ``passages``, by two products."""
    width = min(rank + EXTRA, len(idf))

    def product(basis: np.ndarray) -> np.ndarray:
        out, n = gram_product(docs, idf, basis)
        project, own = np.vstack([idf[:, None] * basis, np.zeros((1, width))]).astype(np.float32), np.zeros(basis.shape)
        for lo in range(0, len(passages), DOCS):
            multiplied(passages[lo : lo + DOCS], idf, project, own)
        # The benchmark's passages weigh OWN times as much as the documents as a whole: the space must tell them apart.
        return out + OWN * max(1, n) / len(passages) * idf[:, None] * own

    basis = np.linalg.qr(product(np.random.Generator(np.random.PCG64(seed)).standard_normal((len(idf), width))))[0]
    image = product(basis)
    # A'A is about image core^-1 image', which takes no third product.
    core = basis.T @ image
    basis, rest = np.linalg.qr(image)
    values, vectors = np.linalg.eigh(rest @ np.linalg.pinv((core + core.T) / 2, rcond=1e-6, hermitian=True) @ rest.T)
    keep = np.argsort(values)[::-1][: min(rank, int((values > 1e-6 * max(values.max(), 1e-30)).sum()))]
    return basis @ vectors[:, keep]


def build_index(docs: DataFrame, items: list[tuple], terms: dict[str, int], rank: int = RANK) -> Index:
    """``docs`` as ``coded`` gives them; ``items`` (id, text) of one block, each of a word at least."""
    words = [[terms[w] for w in words_of(t)] for _, t in items]
    df = document_frequencies(docs, len(terms))
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1e-3
    passages = [(k, p) for k, w in enumerate(words) for p in passages_of(w)]
    directions = latent_space(docs, [np.array(p) for _, p in passages], idf, rank)
    project = np.vstack([idf[:, None] * directions, np.zeros((1, directions.shape[1]))]).astype(np.float32)
    latent = np.stack([project[p].sum(0) for _, p in passages])
    length = np.sqrt((latent**2).sum(1))
    queries = latent / np.maximum(length, 1e-12)[:, None]
    # A short passage fills only a part of its window, so its cosine with it is lower.
    least = COSINE * np.sqrt(np.minimum(1, np.array([len(p) for _, p in passages]) / (2 * BLOCK))).astype(np.float32)
    # A light passage, of common words, must not ask for heavier windows than its own copy makes.
    floor = np.minimum(0.5 * float(np.median(length)), length).astype(np.float32)
    answers = [[terms[w] for w in answer_of(t)] for _, t in items]
    return Index(project, queries, np.array([k for k, _ in passages]), least, floor, [i for i, _ in items], words, answers)


def item_blocks(benchmark: DataFrame, size: int = ITEMS, chars: int = CHARS) -> Iterator[list[tuple]]:
    """The items, block by block, as they come; no more than one block is held."""
    block, held = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        if block and held + len(r["text"]) > chars:
            yield block
            block, held = [], 0
        block.append((r["item_id"], r["text"]))
        held += len(r["text"])
        if len(block) == size:
            yield block
            block, held = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, rank: int = RANK) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share) per document and item that it leaks."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"
    found = docs.sparkSession.createDataFrame([], kind)
    for block in item_blocks(benchmark):
        items = [(i, t) for i, t in block if words_of(t)]
        if not items:
            continue
        terms = {w: k for k, w in enumerate(sorted({x for _, t in items for x in words_of(t) + answer_of(t)}))}
        ids = scratch.put(coded(texts, terms))
        index = build_index(ids, items, terms, rank)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index, none: int = len(terms)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, part in portions(batch.column(1), none):
                    leaks = index.leaks(part)
                    own = batch.column(0).take(pa.array([first + x[0] for x in leaks], pa.int64()))
                    more = [pa.array([x[k] for x in leaks], pa.float64()) for k in (2, 3, 4)]
                    yield pa.RecordBatch.from_arrays([own, pa.array([index.ids[x[1]] for x in leaks], pa.int64()), *more], ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

        found = found.unionByName(scratch.put(ids.mapInArrow(tidy(run), kind)))
        scratch.drop(ids)
    return found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("cosine", "lcs_share", "answer_share")))


def drop_leaking(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows that leak no item, with their columns."""
    bad = scratch.side(find_leaks(docs, benchmark, scratch).select("doc_id").distinct())
    name = fresh("bad", docs.columns)
    return docs.join(bad.select(F.col("doc_id").alias(name)), F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "leaks") as scratch:
        return scratch.keep(find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), scratch))


QUERIES = {"op3_decontamination": op3_decontamination}
