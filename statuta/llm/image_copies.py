"""Cropped and edited copies of images by local descriptors (operator 10).

An image becomes corners over a pyramid of scales, from its own size down to the
smallest that has any; corners keep ``APART`` pixels of their scale between
them, so their number follows the image's area, without a cap.  Each has an
orientation (from the centroid of its surroundings) and 256 binary tests on the
smoothed image, turned by it.

Descriptors meet in 16 Hamming tables, each keyed by another 16 of the bits: those
of the queries, in blocks of ``ASKED`` images, are joined by key with those of all
images, and pairs within ``SEED`` bits are matches.  Matches that agree on a rotation,
scale and shift fix it; then all of the query's corners are looked for where it
puts them, within ``NEAR`` bits.  Images are copies if so many are found that chance
would give less than ``FALSE`` such rows in the whole search: what is asked for
grows with the number of pairs of images, not the number of false rows.

Images with equal pixels are one class, so exact copies are compared once.  There
is no limit on candidates.  ``find_copies`` gives every link between a query and such a
class.  Where many images are copies of each other the links grow with the square of
their number, so the query returns a row per query and per image instead: its class
by connected components of the links, and the number of its links.

The tables at hand have no pictures.  The query draws each vector of
``embeddings`` as a sum of plane waves, one a number, and searches edited copies of
every hundredth (cropped, turned, dimmed, noisy or resized) among all.

Defined cases: null, empty or unreadable images have no descriptors and no
matches; images without corners too; repeated ids are matched each; other
columns are ignored.  Readable are PGM and PPM with 8 bits and PNG with 8 bits
and no interlacing.
"""

from __future__ import annotations

import functools
import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_enough, table, tidy
from .components import connected_components

#: Bits that a match may differ in, that a corner at its place may differ in, and the share of unlike corners that do no more (measured on noise and waves: 0.02).
SEED, NEAR, UNLIKE = 32, 80, 0.05
#: False rows to expect of one search.
FALSE = 1e-4
STEP, APART = 0.8, 4
PATCH, EDGE = 11, 12
#: The largest scale of a query and the step to the next: a query is described in more scales, so that one of them is near one of the image's.
ASKED_FIRST, ASKED_STEP = 1.34, 0.89
#: How far a corner may lie off, in pixels of its scale; differences of angles and of scales (as powers of 2).
SHIFT, ANGLE, GROW = 3.0, 0.4, 0.35
#: Query images that are sent to every task at once.
ASKED = 2_048
#: Links whose classes one task finds in memory.
AT_ONCE = 200_000


def read_image(data: bytes | None) -> np.ndarray | None:
    """Grey levels as height x width, or None."""
    try:
        if not data:
            return None
        if data[:2] in (b"P5", b"P6"):
            head, at = [], 2
            while len(head) < 3:
                while data[at : at + 1].isspace():
                    at += 1
                if data[at : at + 1] == b"#":
                    at = data.index(b"\n", at)
                    continue
                end = at
                while data[end : end + 1].isdigit():
                    end += 1
                head.append(int(data[at:end]))
                at = end
            w, h, top = head
            deep = 3 if data[:2] == b"P6" else 1
            if top > 255:
                return None
            x = np.frombuffer(data, np.uint8, w * h * deep, at + 1).reshape(h, w, deep)
        elif data[:8] == b"\x89PNG\r\n\x1a\n":
            at, packed, kind = 8, b"", None
            while at < len(data):
                size, name = struct.unpack_from(">I4s", data, at)
                body = data[at + 8 : at + 8 + size]
                at += 12 + size
                if name == b"IHDR":
                    w, h, bits, kind, _, _, laced = struct.unpack(">IIBBBBB", body)
                    if bits != 8 or laced or kind not in (0, 2, 4, 6):
                        return None
                elif name == b"IDAT":
                    packed += body
            deep = {0: 1, 2: 3, 4: 2, 6: 4}[kind]
            x = _unfilter(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * deep), deep).reshape(h, w, deep)
        else:
            return None
        deep = x.shape[2]
        grey = x[:, :, 0] if deep < 3 else x[:, :, :3] @ np.array([0.299, 0.587, 0.114])
        return np.ascontiguousarray(grey, np.float32) if grey.size else None
    except Exception:  # a broken file of whatever kind
        return None


def _unfilter(rows: np.ndarray, deep: int) -> np.ndarray:
    out = np.zeros((rows.shape[0], rows.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.int32)
    for y, row in enumerate(rows):
        kind, line = int(row[0]), row[1:].astype(np.int32)
        if kind == 2:
            line = line + above
        elif kind:
            for k in range(len(line)):
                a, b, c = (line[k - deep] if k >= deep else 0), above[k], (above[k - deep] if k >= deep else 0)
                if kind == 4:
                    p = a + b - c
                    near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[k] = (line[k] + (a if kind == 1 else (a + b) // 2 if kind == 3 else near)) & 255
        out[y] = above = line & 255
    return out


def write_image(grey: np.ndarray) -> bytes:
    x = np.clip(np.rint(grey), 0, 255).astype(np.uint8)
    return b"P5 %d %d 255\n" % (x.shape[1], x.shape[0]) + x.tobytes()


def resize(grey: np.ndarray, ratio: float) -> np.ndarray:
    """Bilinear."""
    h, w = (max(1, round(n * ratio)) for n in grey.shape)
    ys, xs = ((np.arange(n) + 0.5) / ratio - 0.5 for n in (h, w))
    y0, x0 = (np.clip(np.floor(v).astype(int), 0, n - 1) for v, n in zip((ys, xs), grey.shape, strict=True))
    y1, x1 = np.minimum(y0 + 1, grey.shape[0] - 1), np.minimum(x0 + 1, grey.shape[1] - 1)
    fy, fx = np.clip(ys - y0, 0, 1)[:, None], np.clip(xs - x0, 0, 1)[None]
    top = grey[y0][:, x0] * (1 - fx) + grey[y0][:, x1] * fx
    return (top * (1 - fy) + (grey[y1][:, x0] * (1 - fx) + grey[y1][:, x1] * fx) * fy).astype(np.float32)


@functools.cache
def edged(n: int, reach: int) -> np.ndarray:
    """Places 0 to n - 1 with the first and the last again, ``reach`` times each."""
    return np.clip(np.arange(-reach, n + reach), 0, n - 1)


def blur(x: np.ndarray, rounds: int = 1) -> np.ndarray:
    for _ in range(rounds):
        for axis in (0, 1):
            p = x.take(edged(x.shape[axis], 2), axis)
            cut = lambda k, p=p, axis=axis: p[k : k + x.shape[0]] if axis == 0 else p[:, k : k + x.shape[1]]
            x = (cut(0) + cut(4) + 4 * (cut(1) + cut(3)) + 6 * cut(2)) / 16
    return x


def candidate_tests(seed: int = 256, most: int = 2048) -> np.ndarray:
    """Pairs of points (dy, dx) around a corner, not too near to each other."""
    rng = np.random.Generator(np.random.PCG64(seed))
    p = rng.normal(0, PATCH / 1.6, (8 * most, 2, 2))
    return p[(np.hypot(p[..., 0], p[..., 1]) <= PATCH).all(1) & (np.hypot(*(p[:, 0] - p[:, 1]).T) > 2)][:most]


@functools.cache
def tests(images: int = 40) -> np.ndarray:
    """256 of the candidates that come out either way about as often and tell different things.

    They are chosen on smoothed noise, which has nothing of the pictures that are searched: by evenness, each
    correlated little with those before it.  Turned patches have a bright side, so tests picked at random would
    mostly say the same.
    """
    rng, candidates = np.random.Generator(np.random.PCG64(1)), candidate_tests()
    codes = [describe_image(noise(rng), candidates)[1] for _ in range(images)]
    bits = np.unpackbits(np.concatenate(codes), axis=1)[:, : len(candidates)].astype(np.float32)
    even = np.abs(bits.mean(0) - 0.5)
    centred = bits - bits.mean(0)
    centred /= np.maximum(np.sqrt((centred**2).sum(0)), 1e-9)
    alike = np.abs(centred.T @ centred)
    for limit in np.arange(0.1, 1.01, 0.05):
        chosen: list[int] = []
        worst = np.zeros(len(even))
        for k in np.argsort(even, kind="stable").tolist():
            if worst[k] < limit:
                chosen.append(k)
                worst = np.maximum(worst, alike[k])
                if len(chosen) == 256:
                    # In no order: tests side by side make one key, and should not be alike.
                    return candidates[rng.permutation(chosen)]
    return candidates[:256]


def noise(rng: np.random.Generator, size: int = 112, grain: int = 3) -> np.ndarray:
    """Smoothed noise as grey levels."""
    n = -(-size // grain)
    x = resize(blur(rng.normal(size=(n, n)).astype(np.float32)), grain)[:size, :size]
    return np.clip(128 + 45 * x / float(x.std()), 0, 255).astype(np.float32)


def highest(x: np.ndarray, reach: int) -> np.ndarray:
    """The greatest value within ``reach`` rows and columns."""
    for axis in (0, 1):
        p, n, wide = np.moveaxis(x.take(edged(x.shape[axis], reach), axis), axis, 0), x.shape[axis], 1
        while 2 * wide <= 2 * reach + 1:
            p, wide = np.maximum(p[:-wide], p[wide:]), 2 * wide
        rest = 2 * reach + 1 - wide
        x = np.moveaxis(np.maximum(p[:n], p[rest : rest + n]), 0, axis)
    return x


def describe_image(grey: np.ndarray, pairs: np.ndarray, first: float = 1.0, step: float = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(x, y, scale, angle) per corner, in pixels of the image, and its 32 bytes."""
    points, codes = [], []
    ys, xs = np.mgrid[-PATCH : PATCH + 1, -PATCH : PATCH + 1]
    disc, scale = np.hypot(ys, xs) <= PATCH, first
    while min(grey.shape) * scale > 2 * EDGE + 1:
        x = blur(resize(grey, scale) if scale != 1 else grey)
        h, w = x.shape
        gy, gx = np.gradient(x)
        a, b, c = blur(gx * gx, 2), blur(gy * gy, 2), blur(gx * gy, 2)
        harris = a * b - c * c - 0.05 * (a + b) ** 2
        peak = (harris >= highest(harris, APART)) & (harris > 1e-4 * max(float(harris.max()), 1e-9))
        py, px = (v + EDGE for v in np.nonzero(peak[EDGE : h - EDGE, EDGE : w - EDGE]))
        if len(py):
            patch = x[py[:, None, None] + ys, px[:, None, None] + xs] * disc
            angle = np.arctan2((patch * ys).sum((1, 2)), (patch * xs).sum((1, 2)))
            soft, cos, sin = blur(x, 2), np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
            dy, dx = pairs[None, :, :, 0], pairs[None, :, :, 1]
            ty = np.rint(py[:, None, None] + dy * cos + dx * sin).astype(int).clip(0, h - 1)
            tx = np.rint(px[:, None, None] + dx * cos - dy * sin).astype(int).clip(0, w - 1)
            v = soft[ty, tx]
            codes.append(np.packbits(v[:, :, 0] < v[:, :, 1], axis=1))
            points.append(np.stack([(px + 0.5) / scale - 0.5, (py + 0.5) / scale - 0.5, np.full(len(px), 1 / scale), angle], 1))
        scale *= step
    if not points:
        return np.zeros((0, 4)), np.zeros((0, 32), np.uint8)
    return np.concatenate(points), np.concatenate(codes)


def describe(images: DataFrame, image: str = "image", image_id: str = "image_id", first: float = 1.0, step: float = STEP) -> DataFrame:
    """(image_id, pixels, points, codes) per image; pixels is a digest of the image's grey levels.  All are null for an image without corners."""
    pairs = tests()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in (big.slice(k, 100) for k in range(0, big.num_rows, 100)):
                digests, all_points, all_codes = [], [], []
                for data in batch.column(1):
                    grey = read_image(data.as_py())
                    points, codes = describe_image(grey, pairs, first, step) if grey is not None else ((), ())
                    digests.append(hashlib.blake2b(np.array(grey.shape).tobytes() + grey.tobytes(), digest_size=16).hexdigest() if len(points) else None)
                    all_points.append(points.astype("<f4").tobytes() if len(points) else None)
                    all_codes.append(codes.tobytes() if len(points) else None)
                columns = [batch.column(0), pa.array(digests, pa.string()), pa.array(all_points, pa.binary()), pa.array(all_codes, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["image_id", "pixels", "points", "codes"])

    kind = "image_id long, pixels string, points binary, codes binary"
    return images.select(F.col(image_id).cast("long").alias("image_id"), F.col(image).cast("binary").alias("image")).mapInArrow(tidy(run), kind)


@dataclass
class Described:
    """The points and codes of some images, one after the other; those of image k are from first[k] to first[k + 1]."""

    points: np.ndarray
    codes: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, points: list[bytes], codes: list[bytes]) -> Described:
        sizes = [len(c) // 32 for c in codes]
        return cls(np.frombuffer(b"".join(points), "<f4").reshape(-1, 4), np.frombuffer(b"".join(codes), np.uint8).reshape(-1, 32), np.r_[0, np.cumsum(sizes, dtype=np.int64)])

    @property
    def image(self) -> np.ndarray:
        """The image of each point."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def own(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.first[k], self.first[k + 1])
        return self.points[at].astype(np.float64), self.codes[at]


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of bits in which codes differ; leading axes as they broadcast."""
    a, b = (np.ascontiguousarray(v).view(np.uint64) for v in (a, b))
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


class HammingTables:
    """16 tables of codes, each by another 16 bits: two codes within ``bits`` meet if they share one of these keys."""

    def __init__(self, codes: np.ndarray):
        self.codes, keys = codes, np.ascontiguousarray(codes).view("<u2")
        self.order = [np.argsort(keys[:, t], kind="stable").astype(np.int32) for t in range(keys.shape[1])]
        self.starts = [np.searchsorted(keys[o, t], np.arange((1 << 16) + 1)).astype(np.int32) for t, o in enumerate(self.order)]

    def join(self, codes: np.ndarray, bits: int, most: int = 1 << 20) -> np.ndarray:
        """(row of the tables, row of ``codes``) of all pairs that meet and differ in no more than ``bits``, each once."""
        keys, found = np.ascontiguousarray(codes).view("<u2"), [np.zeros(0, np.int64)]
        for t, (order, starts) in enumerate(zip(self.order, self.starts, strict=True)):
            first, n = starts[keys[:, t]].astype(np.int64), np.diff(starts)[keys[:, t]].astype(np.int64)
            total = np.r_[0, np.cumsum(n)]
            lo = 0
            while lo < len(n):  # in parts of about ``most`` pairs
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, "right")) - 1)
                b = np.repeat(np.arange(lo, hi), n[lo:hi])
                a = order[np.arange(total[hi] - total[lo]) + np.repeat(first[lo:hi] - (total[lo:hi] - total[lo]), n[lo:hi])]
                near = differing(self.codes[a], codes[b]) <= bits
                found.append(a[near].astype(np.int64) * len(codes) + b[near])
                lo = hi
        both = np.unique(np.concatenate(found))
        return np.stack(np.divmod(both, max(1, len(codes))), 1)


def agreeing(asked: Described, tables: HammingTables, known: Described, searched: float, bits: int = SEED) -> Iterator[tuple[int, int, int]]:
    """(query, image, corners found) of all pairs of images that are copies; ``searched`` is the number of pairs in the whole search."""
    pairs = tables.join(known.codes, bits)
    query, image = asked.image[pairs[:, 0]], known.image[pairs[:, 1]]
    pair = query * max(1, len(known.first) - 1) + image
    order = np.argsort(pair, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(pair[order]) != 0, True]) if len(pair) else np.zeros(1, np.int64)
    for k in np.flatnonzero(np.diff(edges) >= 2):
        own = order[edges[k] : edges[k + 1]]
        q, i = int(query[own[0]]), int(image[own[0]])
        if n := found_corners(*asked.own(q), *known.own(i), asked.points[pairs[own, 0]].astype(np.float64), known.points[pairs[own, 1]].astype(np.float64), searched):
            yield q, i, n


def query_blocks(asked: DataFrame, size: int = ASKED) -> Iterator[list]:
    """The described queries, block by block; no more than one block is held."""
    block = []
    for r in asked.select("image_id", "points", "codes").toLocalIterator():
        block.append(r)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def find_copies(queries: DataFrame, images: DataFrame, scratch: Scratch, bits: int = SEED) -> DataFrame:
    """(query_id, match_id, n_copies, inliers): for each query image the classes of images that hold a copy of it.

    match_id is the least id among images with those pixels, n_copies their number, inliers the corners found.
    """
    return linked(scratch.put(describe(images)), scratch.put(describe(queries, first=ASKED_FIRST, step=ASKED_STEP)), scratch, bits)


def linked(stored: DataFrame, asked: DataFrame, scratch: Scratch, bits: int = SEED) -> DataFrame:
    """The same for queries and images that are described already."""
    stored, asked = (x.where("pixels is not null") for x in (stored, asked))
    ids = stored.groupBy("pixels").agg(F.min("image_id").alias("match_id"), F.countDistinct("image_id").alias("n_copies"))
    # Images with equal pixels have the same points.
    known = scratch.put(stored.groupBy("pixels").agg(F.first("points").alias("points"), F.first("codes").alias("codes")))
    n_known, searched = known.count(), float(max(1, asked.count()))
    searched *= max(1, n_known)
    known = known.repartition(tasks_for(known, n_known))
    kind = "query_id long, pixels string, inliers long"
    found = stored.sparkSession.createDataFrame([], kind)
    for block in query_blocks(asked):
        numbers, wanted = [r["image_id"] for r in block], Described.of([bytes(r["points"]) for r in block], [bytes(r["codes"]) for r in block])

        def run(batches: Iterator[pa.RecordBatch], numbers: list = numbers, wanted: Described = wanted) -> Iterator[pa.RecordBatch]:
            tables = None
            for big in batches:
                for batch in (big.slice(k, 64) for k in range(0, big.num_rows, 64)):
                    tables = tables or HammingTables(wanted.codes)
                    pairs = list(agreeing(wanted, tables, Described.of(batch.column(1).to_pylist(), batch.column(2).to_pylist()), searched, bits))
                    pixels = batch.column(0).take(pa.array([k for _, k, _ in pairs], pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([numbers[q] for q, _, _ in pairs], pa.int64()), pixels, pa.array([n for *_, n in pairs], pa.int64())], ["query_id", "pixels", "inliers"])

        found = found.unionByName(scratch.put(known.mapInArrow(tidy(run), kind)))
    best = found.groupBy("query_id", "pixels").agg(F.max("inliers").alias("inliers"))
    return best.join(ids, "pixels").select("query_id", "match_id", "n_copies", "inliers")


def copy_classes(queries: DataFrame, images: DataFrame, scratch: Scratch) -> DataFrame:
    """(role, image_id, class_id, n_links, inliers): a row per query and a row per image.

    class_id is the least id of the images that links join it with, itself included if it is an image; null for a
    query without links.  n_links counts the links, equal images each; inliers is the most corners of any.
    """
    stored, asked = scratch.put(describe(images)), scratch.put(describe(queries, first=ASKED_FIRST, step=ASKED_STEP))
    links = scratch.put(linked(stored, asked, scratch))
    own = stored.where("pixels is not null").groupBy("pixels").agg(F.min("image_id").alias("rep"))
    members = stored.select("image_id", "pixels").join(own, "pixels").groupBy("image_id").agg(F.min("rep").alias("rep"))
    named = scratch.put(ends(links, scratch))
    rows = asked.select(F.lit("query").alias("role"), "image_id", F.col("image_id").alias("rep"))
    rows = rows.unionByName(stored.select("image_id").join(members, "image_id", "left").select(F.lit("image").alias("role"), "image_id", F.coalesce("rep", "image_id").alias("rep")))
    class_id = F.coalesce("class_id", F.when(F.col("role") == "image", F.col("rep"))).alias("class_id")
    return rows.join(named, ["role", "rep"], "left").select("role", "image_id", class_id, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "inliers")


def ends(links: DataFrame, scratch: Scratch, at_once: int = AT_ONCE) -> DataFrame:
    """(role, rep, class_id, n_links, inliers): for the ends of ``links`` the least match_id that links join them with, and their links.

    Up to ``at_once`` links are joined in memory by one task, more by joins of tables.
    """
    links = links.select("query_id", "match_id", "n_copies", "inliers").where("query_id is not null and match_id is not null")
    if small_enough(links, at_once):
        return links.coalesce(1).mapInArrow(tidy(ends_at_once), "role string, rep long, class_id long, n_links long, inliers long")
    side = lambda role, key, n: links.select(F.lit(role).alias("role"), F.col(key).alias("rep"), n.cast("long").alias("n"), "inliers")
    counts = side("query", "query_id", F.col("n_copies")).unionByName(side("image", "match_id", F.lit(1))).groupBy("role", "rep").agg(F.sum("n").alias("n_links"), F.max("inliers").alias("inliers"))
    # Even nodes are images, odd ones queries.
    node = lambda c, odd: (F.col(c).cast("decimal(20,0)") * 2 + odd).cast("decimal(22,0)")
    groups = connected_components(links.select(node("query_id", 1).alias("a"), node("match_id", 0).alias("b")), scratch)
    groups = scratch.put(groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct()))
    image, number = F.col("node") % 2 == 0, F.floor(F.col("node") / 2).cast("long")
    least = groups.where(image).groupBy("component").agg(F.min(number).alias("class_id"))
    named = groups.join(least, "component").select(F.when(image, "image").otherwise("query").alias("role"), number.alias("rep"), "class_id")
    return named.join(counts, ["role", "rep"])


def ends_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``ends`` of the links (query_id, match_id, n_copies, inliers) in ``batches``."""
    got = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
    if not got:
        return
    query_id, match_id, copies, inliers = (np.concatenate(x) for x in zip(*got, strict=True))
    (queries, q), (images, m) = (np.unique(x, return_inverse=True) for x in (query_id, match_id))
    least = np.arange(len(images))  # per image the place of a lesser one it is joined with, or its own
    while True:
        before, of_query = least.copy(), np.full(len(queries), len(images))
        np.minimum.at(of_query, q, before[m])
        np.minimum.at(least, m, of_query[q])
        # What an image points at is joined with all that the image is.
        np.minimum.at(least, before[m], of_query[q])
        least = least[least]
        if np.array_equal(least, before):
            break
    for role, rep, at, end, n in (("query", queries, of_query, q, copies), ("image", images, least, m, np.ones_like(copies))):
        n_links, most = np.zeros(len(rep), np.int64), np.zeros(len(rep), np.int64)
        np.add.at(n_links, end, n)
        np.maximum.at(most, end, inliers)
        columns = [pa.array([role] * len(rep), pa.string()), *(pa.array(c, pa.int64()) for c in (rep, images[at], n_links, most))]
        yield pa.RecordBatch.from_arrays(columns, ["role", "rep", "class_id", "n_links", "inliers"])


def tasks_for(rows: DataFrame, n: int, each: int = 1_000) -> int:
    """Tasks of about ``each`` images: work on them goes by their number, which bytes don't tell."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // each))


def seeds_agreeing(q: np.ndarray, i: np.ndarray, together: int = 64) -> np.ndarray:
    """Which matches (rows x, y, scale, angle on both sides) agree on the transform that most agree on.

    Each match in turn is the hypothesis; the others must have its turn and scale about, and land where it puts them.
    A hypothesis that half of the matches agree on ends the search.
    """
    turn, grow = i[:, 3] - q[:, 3], np.log2(i[:, 2] / q[:, 2])
    x, y = q[:, :2] @ (1, 1j), i[:, :2] @ (1, 1j)
    best = np.zeros(len(q), bool)
    for lo in range(0, len(q), together):
        k = np.arange(lo, min(lo + together, len(q)))[:, None]
        off = np.abs((turn - turn[k] + np.pi) % (2 * np.pi) - np.pi)
        step = x - x[k]
        away = np.abs(y - y[k] - 2 ** grow[k] * np.exp(1j * turn[k]) * step)
        # The turn and scale of one point are rough, so what they predict far away may be further off.
        fit = (off < ANGLE) & (np.abs(grow - grow[k]) < GROW) & (away < SHIFT * i[:, 2] + 0.15 * 2 ** grow[k] * np.abs(step))
        n = fit.sum(1)
        if n.max() > best.sum():
            best = fit[n.argmax()]
            if 2 * best.sum() >= len(q):
                break
    return best


def chance(m: int, k: int, p: float) -> float:
    """log10 of the probability of k or more of m, bounded from above."""
    if k <= 0 or p * m >= k:
        return 0.0
    return (math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) + k * math.log(p) + max(0.0, -math.log1p(-min(0.99, p * m / k)))) / math.log(10)


def found_corners(pq: np.ndarray, cq: np.ndarray, pi: np.ndarray, ci: np.ndarray, sq: np.ndarray, si: np.ndarray, searched: float) -> int:
    """The number of corners of the query found where a transform puts them, or 0 where chance explains it.

    ``sq`` and ``si`` are the matches' points on both sides.
    """
    fit = seeds_agreeing(sq, si)
    x, y = sq[fit, :2] @ (1, 1j), si[fit, :2] @ (1, 1j)
    best = 0
    for _ in range(3):
        spread = x - x.mean()
        if len(x) < 2 or (weight := float((np.abs(spread) ** 2).sum())) < 4:
            break
        alpha = (np.conj(spread) * (y - y.mean())).sum() / weight
        if not 0.1 < abs(alpha) < 10:
            break
        put = alpha * (pq[:, :2] @ (1, 1j) - x.mean()) + y.mean()
        away = np.abs(put[:, None] - (pi[:, :2] @ (1, 1j))[None])
        scale, turn = pq[:, 2] * abs(alpha), np.angle(alpha)
        off = np.abs((pi[None, :, 3] - pq[:, None, 3] - turn + np.pi) % (2 * np.pi) - np.pi)
        a, b = np.nonzero((away < SHIFT * pi[None, :, 2]) & (off < ANGLE) & (np.abs(np.log2(pi[None, :, 2] / scale[:, None])) < GROW))
        near = differing(cq[a], ci[b]) <= NEAR
        a, b = a[near], b[near]
        if not len(a):
            break
        # Trials: places of the query whose image could hold a corner.  What chance gives each: corners about there, of that turn and scale, by the share of unlike ones.
        lo, hi = pi[:, :2].min(0), pi[:, :2].max(0)
        inside = (put.real > lo[0] - 2) & (put.real < hi[0] + 2) & (put.imag > lo[1] - 2) & (put.imag < hi[1] + 2)
        grain = SHIFT / abs(alpha)
        m, k = places(pq[inside, :2], grain), min(places(pq[np.unique(a), :2], grain), places(pi[np.unique(b), :2], SHIFT))
        area = max(1.0, float(np.prod(hi - lo)))
        p = min(0.5, float((np.pi * (SHIFT * pi[:, 2]) ** 2).sum()) / area * (2 * ANGLE / (2 * np.pi)) * 0.6 * UNLIKE)
        # The transform was fitted to two of the corners, and each match could have been its start.
        if math.log10(searched * len(sq)) + chance(max(m, k) - 2, k - 2, p) < math.log10(FALSE):
            best = max(best, k)
        x, y = pq[a, :2] @ (1, 1j), pi[b, :2] @ (1, 1j)
    return best


def places(points: np.ndarray, apart: float) -> int:
    """The number of points (x, y), each farther than ``apart`` from those counted before it."""
    kept: list[tuple[float, float]] = []
    for x, y in points.tolist():
        if all((x - a) ** 2 + (y - b) ** 2 > apart * apart for a, b in kept):
            kept.append((x, y))
    return len(kept)


@functools.cache
def waves(numbers: int, size: int = 112, seed: int = 64) -> np.ndarray:
    """Pictures of plane waves of fixed random directions, lengths and phases, flattened; one for each number of a vector."""
    rng = np.random.Generator(np.random.PCG64(seed))
    turn, cycles, phase = (rng.uniform(lo, hi, numbers) for lo, hi in ((0, np.pi), (3, 14), (0, 2 * np.pi)))
    y, x = np.mgrid[:size, :size] / size
    return np.stack([np.cos(2 * np.pi * c * (x * np.cos(t) + y * np.sin(t)) + p) for t, c, p in zip(turn, cycles, phase, strict=True)]).reshape(numbers, -1).astype(np.float32)


def picture(vector: list[float]) -> np.ndarray:
    """The sum of the waves, weighted by the numbers of a vector, as grey levels."""
    v, pictures = np.nan_to_num(np.array(vector, np.float32)), waves(len(vector))
    size = round(pictures.shape[1] ** 0.5)
    return np.clip(128 + 64 * (v / max(1e-9, float(np.linalg.norm(v)))) @ pictures, 0, 255).reshape(size, size)


def edited(grey: np.ndarray, number: int) -> np.ndarray:
    """One of six edits of an image, by a number."""
    rng = np.random.Generator(np.random.PCG64(number))
    h, w = grey.shape
    dy, dx = int(rng.integers(0, h // 5)), int(rng.integers(0, w // 5))
    crop = grey[dy : dy + h * 4 // 5, dx : dx + w * 4 // 5]
    return [
        crop,
        np.rot90(crop),
        crop * 0.7 + 20,
        crop + rng.normal(0, 4, crop.shape),
        resize(crop, 0.75),
        blur(np.rot90(grey, 2)),
    ][number % 6].astype(np.float32)


def draw(vectors: DataFrame, edit: bool = False) -> DataFrame:
    """``vectors`` (vec_id, embedding) -> (image_id, image)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in (big.slice(k, 200) for k in range(0, big.num_rows, 200)):
                images = []
                for number, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    grey = None if not v or number is None else picture([x or 0.0 for x in v])
                    images.append(None if grey is None else write_image(edited(grey, number // 100) if edit else grey))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(images, pa.binary())], ["image_id", "image"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(tidy(run), "image_id long, image binary")


def op10_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 100 = 0")
    vectors, asked = (v.repartition(tasks_for(v, v.count())) for v in (vectors, asked))
    with Scratch(spark, "images") as scratch:
        return scratch.keep(copy_classes(draw(asked, edit=True), draw(vectors), scratch))


QUERIES = {"op10_image_copies": op10_image_copies}
