"""Near-duplicate documents by min-max hashing (operator 7).

Each of 64 permutations gives two values, its minimum and its maximum over the
word shingles of a document, so 128 signature values cost 64 hash evaluations a
shingle.  They form 32 bands of four.  At a similarity of 0.75 a pair misses
all bands with probability 5e-6.

Documents with equal shingle sets become one class first.  Classes that share a
band are not paired off: each is compared with a pivot of the band, then those
that are still apart with three more, then only members of different components
for which two exact bounds leave room for a link: the Jaccard distance is a
metric, so |d(x, p) - d(y, p)| > 0.25 rules one out, and sets have no more in
common than the lesser counts of their shared shingles, part by part.  Sets too
few of whose shingles occur anywhere else have no link and go before all that.
Every comparison intersects the full shingle sets.  A band with a third of all classes is
combined before each shuffle, and its members are dealt to tasks of ``SPLIT`` rows.

Defined cases: null or empty texts and those without words have an empty set and
link with nothing; texts of fewer words than a shingle are one shingle; rows
that share a doc_id are one document: they are linked with each other, and what
links with one of them with all; a null doc_id links with nothing and is not kept;
other columns of the input are ignored.  In ``drop_near_duplicates`` the document
with the least doc_id of a group stays, and of its rows the one with the least text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, mix64, table, tidy
from .components import connected_components

WORDS, PERMUTATIONS, ROWS = 5, 64, 4
#: A link needs PERCENT * |A or B| <= 100 * |A and B|.
PERCENT = 75
PIVOTS, PARTS = 3, 64
#: Members of a band that are joined in one task, about.
SPLIT = 512


def shingle_hashes(data: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every shingle of every text, and where each text's begin; one more at the end.

    A shingle of fewer words (the whole of a short text) has a hash of its own kind.
    bytes.lower changes A-Z only and bytes.split parts at U+0020 and U+0009 to U+000D.
    """
    split = [x.lower().split() for x in data]
    n = np.array([len(x) for x in split], np.int64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for x in split for w in x), np.uint64, int(n.sum()))
    first = np.r_[0, np.cumsum(n)]
    counts = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    starts = np.r_[0, np.cumsum(counts)]
    with np.errstate(over="ignore"):
        total = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for k in range(words):
            total += mix64(h[k : len(h) - words + 1 + k] + np.uint64(k)) * np.uint64(2 * k + 1) if len(total) else total
        out = np.zeros(int(starts[-1]), np.uint64)
        full = np.flatnonzero(n >= words)
        shift = np.repeat(first[full] - starts[full], counts[full])
        where = np.arange(len(out)) if len(full) == len(n) else np.concatenate([np.arange(starts[k], starts[k + 1]) for k in full]) if len(full) else np.zeros(0, np.int64)
        out[where] = mix64(total[where + shift])
        for k in np.flatnonzero((n > 0) & (n < words)):
            value = np.uint64(0x9E3779B97F4A7C15) * np.uint64(n[k])
            for x in h[first[k] : first[k + 1]]:
                value = mix64(np.array([value * np.uint64(31) + x]))[0]
            out[starts[k]] = value
    return out, starts


def factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240607))
    return rng.integers(0, 2**31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n).astype(np.uint32)


def min_max(shingles: np.ndarray, starts: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """Signatures, a row per text with shingles: the minima of all permutations, then the maxima."""
    a, b = factors(permutations)
    out = np.empty((len(starts) - 1, 2 * permutations), np.uint32)
    out[:, :permutations], out[:, permutations:] = 0xFFFFFFFF, 0
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    # Blocks that stay in the processor's cache; a text may reach over several.
    for lo in range(0, len(x), 1 << 15):
        part = x[lo : lo + (1 << 15)]
        i, j = np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, lo + len(part), "left")
        at = np.maximum(starts[i:j] - lo, 0)
        for k in range(permutations):
            v = part * a[k] + b[k]
            np.minimum(out[i:j, k], np.minimum.reduceat(v, at), out=out[i:j, k])
            np.maximum(out[i:j, permutations + k], np.maximum.reduceat(v, at), out=out[i:j, permutations + k])
    return out


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key per band, which also tells the bands apart."""
    n, width = signatures.shape
    v = signatures.reshape(n, width // rows, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(width // rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (n, width // rows))
        for k in range(rows):
            key = mix64(key + v[:, :, k] * np.uint64(0xD6E8FEB86659FD93))
    return key.view(np.int64)


def _rows(texts: DataFrame, sets: bool) -> DataFrame:
    """(doc_id, n, f1, f2, bands) per row, or (doc_id, shingles) with the sorted set.  (f1, f2) stand for the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in (big.slice(k, 500) for k in range(0, big.num_rows, 500)):
                data = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1)]
                every, starts = shingle_hashes(data)
                own = [np.unique(every[i:j]) for i, j in zip(starts[:-1], starts[1:], strict=True)]
                n = np.array([len(x) for x in own], np.int64)
                flat, offsets = np.concatenate([*own, np.zeros(0, np.uint64)]), np.r_[0, np.cumsum(n)]
                if sets:
                    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "shingles"])
                    continue
                full = np.flatnonzero(n)
                signed = min_max(flat, np.r_[offsets[full], offsets[-1]]) if len(full) else np.zeros((0, 2 * PERMUTATIONS), np.uint32)
                keys, f = band_keys(signed), np.zeros((len(n), 2), np.uint64)
                if len(full):
                    f[full, 0] = np.add.reduceat(mix64(flat), offsets[full])
                    f[full, 1] = np.bitwise_xor.reduceat(mix64(flat + np.uint64(1)), offsets[full])
                size = np.zeros(len(n), np.int64)
                size[full] = keys.shape[1]
                bands = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(f[:, 0].view(np.int64)), pa.array(f[:, 1].view(np.int64)), bands], ["doc_id", "n", "f1", "f2", "bands"])

    return texts.mapInArrow(tidy(run), "doc_id long, shingles array<long>" if sets else "doc_id long, n long, f1 long, f2 long, bands array<long>")


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with both = |A and B| and either = |A or B|.  Many rows may share an a, few a b."""
    right = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = right.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    counted = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("both"), (F.size("sa") + F.size("sb")).alias("sum"))
    return counted.select("a", "b", "both", (F.col("sum") - F.col("both")).alias("either"))


def _room(x: str, y: str) -> Column:
    """Whether sets with n shingles, u of them in any other set, can be similar enough: the least of both u is all they can share."""
    return F.least(f"{x}.u", f"{y}.u") * (100 + PERCENT) >= (F.col(f"{x}.n") + F.col(f"{y}.n")) * PERCENT


def _linked() -> Column:
    return F.col("both") * 100 >= F.col("either") * PERCENT


def _owned_shingles(sets: DataFrame) -> DataFrame:
    """(rep, s): shingles that no other set has.  Only the least and the greatest owner of a shingle are kept, so none gathers all of them."""
    each = sets.select("doc_id", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    return each.where("rep = last").select("rep", "s")


def _shared_counts(sets: DataFrame, owned: DataFrame) -> DataFrame:
    """(rep, parts) per set: how many of the shingles that it shares with any other set fall into each of PARTS parts by hash.

    Two sets have at most the sum of the lesser counts in common, part by part.
    """
    lists = sets.join(owned.groupBy(F.col("rep").alias("doc_id")).agg(F.collect_list("s").alias("own")), "doc_id", "left").select("doc_id", "shingles", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in (big.slice(k, 1000) for k in range(0, big.num_rows, 1000)):
                parts = []
                for shingles, own in zip(batch.column(1), batch.column(2), strict=True):
                    every = shingles.values.to_numpy(zero_copy_only=False)
                    count = np.bincount(every % PARTS, minlength=PARTS)
                    if own.is_valid:
                        count -= np.bincount(own.values.to_numpy(zero_copy_only=False) % PARTS, minlength=PARTS)
                    parts.append(np.maximum(count, 0).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.int32()))], ["rep", "parts"])

    return lists.mapInArrow(tidy(run), "rep long, parts array<int>")


def _still_apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of bands that still hold several components, each with its component c."""
    named = members.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
    apart = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("salts").alias("salts")).where("lo <> hi")
    return named.join(_dealt(apart.select("key", "salts")), ["key", "salt"])


def _dealt(bands: DataFrame) -> DataFrame:
    """``bands`` (key, salts, ...) once for each of the tasks that a band's members are dealt to."""
    return bands.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked_classes(classes: DataFrame, texts: DataFrame, scratch: Scratch, known_links: DataFrame | None = None) -> DataFrame:
    """``classes`` (rep, n, bands) of distinct sets -> (node, component) of those with links; ``known_links`` (a, b) hold besides."""
    spread = classes.select("rep", "n", F.explode("bands").alias("key"))
    members = scratch.put(spread.join(spread.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key").select("key", "rep", "n", "size"))
    shown = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = scratch.put(_rows(texts.join(shown, "doc_id", "left_semi"), sets=True))
    # A set that shares too few shingles with all others together has no link: most chance neighbours and far-off copies go here.
    owned = scratch.put(_owned_shingles(sets))
    alone = owned.groupBy("rep").agg(F.count("*").alias("alone"))
    salts = F.ceil(F.col("size") / SPLIT).cast("int")
    shared = members.join(alone, "rep", "left").select("key", "rep", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("u"), salts.alias("salts"))
    dealt = F.pmod(F.xxhash64("rep", F.lit(11)), F.col("salts")).cast("int").alias("salt")
    members = scratch.put(shared.where(F.col("u") * 100 >= F.col("n") * PERCENT).select("key", dealt, "salts", F.struct("rep", "n", "u").alias("m"), "rep"))

    # One pivot a band.
    pivots = members.groupBy("key").agg(F.min("m").alias("p"), F.max("salts").alias("salts"))
    first = members.drop("salts").join(_dealt(pivots), ["key", "salt"]).where((F.col("rep") != F.col("p.rep")) & _room("m", "p"))
    known = scratch.put(_compare(first.select(F.col("p.rep").alias("a"), F.col("rep").alias("b")).distinct(), sets))
    links = known.where(_linked()).select("a", "b")
    if known_links is not None:
        links = links.unionByName(known_links)
    labels = connected_components(links, scratch)

    # Three more, where a band holds more than one component.
    apart = scratch.put(_still_apart(members, labels))
    pivots = apart.groupBy("key").agg(F.max("salts").alias("salts"), *(F.min(F.struct(F.xxhash64("rep", F.lit(k)).alias("order"), "m", "c")).alias(f"p{k}") for k in range(PIVOTS)))
    by_pivot = apart.drop("salts").join(_dealt(pivots), ["key", "salt"])
    tried = [
        by_pivot.where((F.col(f"p{k}.c") != F.col("c")) & _room("m", f"p{k}.m")).select(F.col(f"p{k}.m.rep").alias("a"), F.col("rep").alias("b")) for k in range(PIVOTS)
    ]
    pairs = _ordered(tried[0].unionByName(tried[1]).unionByName(tried[2]))
    more = scratch.put(_compare(pairs.join(_ordered(known), ["a", "b"], "left_anti"), sets))
    links = links.unionByName(more.where(_linked()).select("a", "b"))
    labels = connected_components(links, scratch)

    # What is left: members of different components of a band, unless the distances to a pivot rule a link out.
    every = known.unionByName(more)
    far = every.select("a", "b", (1 - F.col("both") / F.col("either")).alias("d"))
    far = scratch.put(far.unionByName(far.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).distinct())
    rest = _still_apart(apart.drop("c"), labels).drop("salts").join(_dealt(pivots.select("key", "salts", *(F.col(f"p{k}.m.rep").alias(f"q{k}") for k in range(PIVOTS)))), ["key", "salt"])
    for k in range(PIVOTS):
        to_pivot = far.select(F.col("a").alias("rep"), F.col("b").alias(f"q{k}"), F.col("d").alias(f"d{k}"))
        rest = rest.join(to_pivot, ["rep", f"q{k}"], "left").withColumn(f"d{k}", F.when(F.col("rep") == F.col(f"q{k}"), 0.0).otherwise(F.col(f"d{k}")))
    rest = rest.select("key", "rep", "m", "c", *(f"d{k}" for k in range(PIVOTS)))
    parts = _shared_counts(sets.join(rest.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), owned)
    rest = scratch.put(rest.join(parts, "rep"))
    x, y = rest.alias("x"), rest.alias("y")
    room = (F.col("x.m.rep") < F.col("y.m.rep")) & (F.col("x.c") != F.col("y.c")) & _room("x.m", "y.m")
    for k in range(PIVOTS):
        room &= F.coalesce(F.abs(F.col(f"x.d{k}") - F.col(f"y.d{k}")) <= 1 - PERCENT / 100 + 1e-9, F.lit(True))
    common = F.aggregate(F.zip_with("x.parts", "y.parts", lambda a, b: F.least(a, b)), F.lit(0), lambda a, b: a + b)
    room &= common * (100 + PERCENT) >= (F.col("x.m.n") + F.col("y.m.n")) * PERCENT
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & room).select(F.col("x.m.rep").alias("a"), F.col("y.m.rep").alias("b")).distinct()
    last = scratch.put(_compare(pairs.join(_ordered(every), ["a", "b"], "left_anti"), sets))
    return connected_components(links.unionByName(last.where(_linked()).select("a", "b")), scratch)


def near_duplicates(docs: DataFrame, scratch: Scratch, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = scratch.put(_rows(texts, sets=False))
    each = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"))
    if each.where("rows > 1").isEmpty():
        found = _components(rows, texts, scratch)
    else:
        # Every row gets a number of its own; numbers rise with doc_id, so the least of them is that of the least doc_id.
        numbered = texts.repartitionByRange(F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last()).withColumn("row", F.monotonically_increasing_id())
        numbered = scratch.put(numbered)
        real = numbered.where("doc_id is not null").select("doc_id", "row")
        first = real.groupBy("doc_id").agg(F.min("row").alias("b"), F.count("*").alias("rows")).where("rows > 1").select("doc_id", "b")
        same = scratch.put(real.join(first, "doc_id").select(F.col("row").alias("a"), "b").where("a <> b"))
        own = numbered.where("doc_id is not null").select(F.col("row").alias("doc_id"), "text")
        rows = scratch.put(_rows(own, sets=False))
        found = _components(rows, own, scratch, same).select(F.col("doc_id").alias("row"), "n", "component_id")
        least = real.select(F.col("row").alias("component_id"), F.col("doc_id").alias("least"))
        found = found.join(least, "component_id").join(real, "row").select("doc_id", "n", F.col("least").alias("component_id"))
        found = found.unionByName(_rows(texts.where("doc_id is null"), sets=False).select("doc_id", "n", F.lit(None).cast("long").alias("component_id")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _components(rows: DataFrame, texts: DataFrame, scratch: Scratch, same_document: DataFrame | None = None) -> DataFrame:
    """(doc_id, n, component_id) per row; no doc_id occurs twice, but for nulls.  ``same_document`` (a, b) are links of rows besides."""
    real = rows.where("n > 0 and doc_id is not null")
    same = scratch.put(real.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")))
    # The class representative is the row with the least doc_id; that row carries the bands.
    classes = real.withColumnRenamed("doc_id", "rep").join(same, ["f1", "f2", "rep"], "left_semi").select("rep", "n", "bands")
    if same_document is not None:
        # Rows without words are no class; they stand for themselves.
        own = real.join(same, ["f1", "f2"]).select("doc_id", "rep")
        for end in "ab":
            same_document = same_document.join(own.withColumnRenamed("doc_id", end), end, "left").withColumn(end, F.coalesce("rep", end)).drop("rep")
        same_document = scratch.put(same_document.where("a <> b").distinct())
    labels = linked_classes(classes, texts, scratch, same_document)
    named = same.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    found = rows.drop("bands").join(named, ["f1", "f2"], "left")
    if same_document is None:
        empty = F.col("doc_id")
    else:
        found = found.join(labels.select(F.col("node").alias("doc_id"), F.col("component").alias("of_row")), "doc_id", "left")
        empty = F.coalesce("of_row", "doc_id")
    return found.select("doc_id", "n", F.when((F.col("n") == 0) | F.col("doc_id").isNull(), empty).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row of each group of linked documents, with its columns; rows without a doc_id stay."""
    found = scratch.put(near_duplicates(docs, scratch))
    name = fresh("gone", docs.columns)
    gone = scratch.side(found.where("not kept and doc_id is not null").select(F.col("doc_id").alias(name)).distinct())
    out = docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return out
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = out.where("doc_id is not null").groupBy("doc_id").agg(F.min_by(every, F.coalesce("text", F.lit(""))).alias("row")).select("row.*")
    return out.where("doc_id is null").unionByName(one)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "near") as scratch:
        return scratch.keep(near_duplicates(table(spark, sf_dir, "documents"), scratch))


QUERIES = {"op7_minhash_near_dedup": op7_minhash_near_dedup}
