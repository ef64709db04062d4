import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from statuta.llm import image_copies as im
from statuta.llm.common import Scratch


def png(grey):
    h, w = grey.shape
    rows = b""
    above = np.zeros(w, np.uint8)
    for y, line in enumerate(grey.astype(np.uint8)):
        kind = y % 3
        left = np.r_[np.uint8(0), line[:-1]]
        rows += bytes([kind]) + (line if kind == 0 else line - left if kind == 1 else line - above).astype(np.uint8).tobytes()
        above = line
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_formats():
    grey = np.arange(35, dtype=np.float32).reshape(5, 7)
    for data in (im.write_image(grey), png(grey), b"P5\n# note\n7 5\n255\n" + grey.astype(np.uint8).tobytes()):
        assert np.array_equal(im.read_image(data), grey)
    for bad in (None, b"", b"P5 9 9 255\n", b"\x89PNG\r\n\x1a\nxx", b"GIF89a", png(grey)[:40]):
        assert im.read_image(bad) is None


def test_copies_are_found(spark):
    rng = np.random.default_rng(3)
    images = [im.picture(rng.normal(size=64).tolist()) for _ in range(60)]
    rows = [(k, im.write_image(x)) for k, x in enumerate(images)] + [(100, im.write_image(images[0])), (101, None), (102, b"junk"), (103, im.write_image(np.full((90, 90), 7.0))), (None, im.write_image(images[1]))]
    asked = [(k, im.write_image(im.edited(images[k], k))) for k in range(60)] + [(900, im.write_image(im.picture(rng.normal(size=64).tolist()))), (901, None)]
    kind = "image_id long, image binary, pixels string"
    with Scratch(spark, "t") as s:
        known, wanted = (spark.createDataFrame([(*r, "x") for r in x], kind) for x in (rows, asked))
        got = [tuple(r) for r in im.find_copies(wanted, known, s).select("query_id", "match_id", "n_copies").collect()]
        own = {q for q, m, _ in got if q == m}
        assert len(own) >= 0.9 * 60 and all(q == m for q, m, _ in got)
        assert (0, 0, 2) in got and not any(q >= 900 for q, _, _ in got)
        assert im.find_copies(wanted.where("false"), known, s).collect() == [] and im.find_copies(wanted, known.where("false"), s).collect() == []


def test_classes(spark):
    rng = np.random.default_rng(9)
    first, second, third = (im.picture(rng.normal(size=64).tolist()) for _ in "abc")
    near = np.clip(first + 2, 0, 255)
    rows = [(5, first), (6, first), (7, near), (8, second), (9, None), (11, third)]
    asked = [(5, im.edited(first, 0)), (8, im.edited(second, 2)), (40, im.picture(rng.normal(size=64).tolist())), (9, None)]
    kind = "image_id long, image binary, class_id string"
    known, wanted = (spark.createDataFrame([(k, None if x is None else im.write_image(x), "x") for k, x in part], kind) for part in (rows, asked))
    with Scratch(spark, "t") as s:
        got = {(r["role"], r["image_id"]): (r["class_id"], r["n_links"], r["inliers"] is not None) for r in im.copy_classes(wanted, known, s).collect()}
    assert got == {
        ("query", 5): (5, 3, True), ("query", 8): (8, 1, True), ("query", 40): (None, 0, False), ("query", 9): (None, 0, False), ("image", 5): (5, 1, True), ("image", 6): (5, 1, True),
        ("image", 7): (5, 1, True), ("image", 8): (8, 1, True), ("image", 9): (9, 0, False), ("image", 11): (11, 0, False),
    }


def test_ends_in_memory_and_by_tables(spark):
    rng = np.random.default_rng(4)
    path = (rng.permutation(300) - 40).tolist()
    chain = [(k, m) for k, pair in enumerate(zip(path, path[1:], strict=False)) for m in pair]
    big = 2**62
    links = chain + [(0, 5), (0, 5), (1000, big + 1), (1000, big), (-7, -900), (None, 3), (1001, None)]
    links += [(int(q), int(m)) for q, m in zip(rng.integers(2000, 2060, 60), rng.integers(2000, 2090, 60), strict=True)]
    group = {}
    for q, m in links:
        if q is not None and m is not None:
            both = group.get(("query", q), set()) | group.get(("image", m), set()) | {("query", q), ("image", m)}
            group |= dict.fromkeys(both, both)
    links = [(q, m, 1 + k % 3, 10 + k % 50) for k, (q, m) in enumerate(links)]
    whole = [r for r in links if None not in r]
    want = []
    for (role, rep), both in group.items():
        own = [r for r in whole if r[role == "image"] == rep]
        want.append((role, rep, min(n for kind, n in both if kind == "image"), sum(r[2] for r in own) if role == "query" else len(own), max(r[3] for r in own)))
    df = spark.createDataFrame(links, "query_id long, match_id long, n_copies long, inliers long").repartition(3)
    columns = ["role", "rep", "class_id", "n_links", "inliers"]
    with Scratch(spark, "t") as s:
        made = s.n
        got = sorted(tuple(r) for r in im.ends(df, s).select(columns).collect())
        assert s.n == made, "few links need no tables"
        assert got == sorted(want) == sorted(tuple(r) for r in im.ends(df, s, at_once=9).select(columns).collect())
        assert im.ends(df.where("false"), s).collect() == []


def test_few_links_write_few_tables(spark):
    """Each file of a table is a process for its rights (chmod), and each join a page of memory in every task."""
    rng = np.random.default_rng(9)
    first = im.picture(rng.normal(size=64).tolist())
    kind = "image_id long, image binary"
    known = spark.createDataFrame([(k, im.write_image(np.clip(first + k, 0, 255))) for k in range(4)], kind)
    wanted = spark.createDataFrame([(k, im.write_image(im.edited(first, k))) for k in range(3)], kind)
    with Scratch(spark, "t") as s:
        assert {r["class_id"] for r in im.copy_classes(wanted, known, s).collect()} == {0}
        assert s.n <= 6


def test_each_kind_of_edit_is_found(spark):
    rng = np.random.default_rng(5)
    images = [im.picture(rng.normal(size=64).tolist()) for _ in range(120)]
    schema = "image_id long, image binary"
    with Scratch(spark, "t") as s:
        known = spark.createDataFrame([(k, im.write_image(x)) for k, x in enumerate(images)], schema)
        wanted = spark.createDataFrame([(k, im.write_image(im.edited(x, k))) for k, x in enumerate(images)], schema)
        own = {r["query_id"] for r in im.find_copies(wanted, known, s).where("query_id = match_id").collect()}
    assert [kind for kind in range(6) if sum(k % 6 == kind for k in own) < 0.9 * 20] == []


def described(images, pairs, **how):
    found = [im.describe_image(x, pairs, **how) for x in images]
    return im.Described.of([p.astype("<f4").tobytes() for p, _ in found], [c.tobytes() for _, c in found])


def test_tables_against_brute_force():
    rng, pairs = np.random.default_rng(6), im.tests()
    images = [im.picture(rng.normal(size=64).tolist()) for _ in range(12)]
    known, asked = described(images, pairs), described([im.edited(x, k) for k, x in enumerate(images)], pairs, first=im.ASKED_FIRST, step=im.ASKED_STEP)
    bits = np.unpackbits(asked.codes, axis=1)[:, None] != np.unpackbits(known.codes, axis=1)[None]
    want = {(a, b) for a, b in np.argwhere(bits.sum(-1) <= im.SEED).tolist()}
    got = {tuple(x) for x in im.HammingTables(asked.codes).join(known.codes, im.SEED, most=1000).tolist()}
    assert got <= want and len(got) >= 0.9 * len(want) > 100
    assert im.HammingTables(asked.codes[:0]).join(known.codes, im.SEED).shape == (0, 2) and im.HammingTables(asked.codes).join(known.codes[:0], im.SEED).shape == (0, 2)


def test_larger_pictures():
    rng, pairs = np.random.default_rng(7), im.tests()
    halves, quarters, turned = [], [], []
    for _ in range(10):
        x = im.picture(rng.normal(size=64).tolist())
        large = im.resize(np.block([[x, x.T], [x[::-1], im.picture(rng.normal(size=64).tolist())]]), 1.0)
        a = np.deg2rad(33)
        y, z = np.mgrid[:150, :150] - 75.0
        z, y = np.cos(a) * z - np.sin(a) * y + 112, np.sin(a) * z + np.cos(a) * y + 112
        x0, y0 = np.floor(z).astype(int).clip(0, 222), np.floor(y).astype(int).clip(0, 222)
        fx, fy = z - x0, y - y0
        odd = (large[y0, x0] * (1 - fx) + large[y0, x0 + 1] * fx) * (1 - fy) + (large[y0 + 1, x0] * (1 - fx) + large[y0 + 1, x0 + 1] * fx) * fy
        known = described([large], pairs)
        for found, edit in ((halves, im.resize(large, 0.5)), (quarters, large[40:152, 60:172]), (turned, odd.astype(np.float32))):
            asked = described([edit], pairs, first=im.ASKED_FIRST, step=im.ASKED_STEP)
            found.append(bool(list(im.agreeing(asked, im.HammingTables(asked.codes), known, 1e8))))
    assert min(sum(halves), sum(quarters), sum(turned)) >= 9


def test_chance():
    rng = np.random.default_rng(1)
    for m, k, p in ((20, 3, 0.01), (40, 6, 0.02), (10, 2, 0.05)):
        seen = (rng.random((200_000, m)) < p).sum(1) >= k
        assert seen.mean() <= 10 ** im.chance(m, k, p) <= 2.5 * seen.mean() + 1e-4
    assert im.chance(10, 0, 0.1) == 0 == im.chance(10, 2, 0.5)


def test_seeds_agree():
    rng = np.random.default_rng(1)
    q = rng.uniform(0, 100, (12, 2))
    a, b = np.c_[q, np.ones(12), np.zeros(12)], np.c_[20 - q[:, 1], 5 + q[:, 0], np.ones(12), np.full(12, np.pi / 2)]
    noise = [np.c_[rng.uniform(0, 100, (10, 2)), np.ones(10), rng.uniform(-3, 3, 10)] for _ in "ab"]
    fit = im.seeds_agreeing(np.r_[a, noise[0]], np.r_[b, noise[1]])
    assert fit[:12].all() and fit[12:].sum() <= 2


def test_drawing(spark):
    df = spark.createDataFrame([(100, [0.1] * 64), (200, None), (None, [0.5]), (300, [None, 1.0])], "vec_id long, embedding array<float>")
    assert im.draw(df).where(F.col("image").isNotNull()).count() == 2 and im.draw(df, edit=True).count() == 4
