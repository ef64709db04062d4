"""Operators against brute force on small fixtures with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from statuta.llm import decontaminate, html_extract, line_dedup, near_dedup, personal_data, pieces, token_shards, toxicity, url_filters
from statuta.llm.common import Scratch
from statuta.llm.components import connected_components

SCHEMA = "doc_id long, text string"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


# --- components


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 1), (3, 3)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)] + [(50, 51)], [(9, 8), (8, 7), (1, 2), (2, 9), (None, 1)]])
def test_components(spark, edges):
    want = {}
    nodes = {n for e in edges for n in e if None not in e and e[0] != e[1]}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            x = todo.pop()
            for a, b in edges:
                for p, q in ((a, b), (b, a)):
                    if p == x and q is not None and q not in seen:
                        seen.add(q)
                        todo.append(q)
        want[n] = min(seen)
    with Scratch(spark, "t") as s:
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), s).collect()}
    assert got == {n: c for n, c in want.items() if n != c}


# --- pages

PAGES = [
    ("<html><head><title>T</title><style>p{}</style><script>var a='</p><p>no';</script></head><body><nav><a>Menu</a></nav><div class='ad'>Buy</div><article><h1>Head &amp; more</h1><p>One  \n two<br>three<p>Four <b>five</article><footer>&copy;</footer></body></html>", "Head & more\n\nOne two three\n\nFour five"),
    ("<body><header>Site</header><main><header><h1>Title</h1></header><p>Body text.</p><aside>Side</aside><p>Last.</p><section id='comments'><p>Nice!</p></section><form><p>Mail</p></form></main><div class='cookie-notice'>Accept</div>", "Title\n\nBody text.\n\nLast."),
    ("<div id=sidebar><p>x</p></div><p>" + "Long enough text of a page without an article. " * 5 + "</p><ul><li><a>a</a><li><a>b</a></ul>", ("Long enough text of a page without an article. " * 5).strip()),
    ("<article><p>a&nbsp;b &lt;c&gt; &#233; &eacute;</p><div hidden>no</div><p></p></article><article class='comment'><p>reply</p></article>", "a b <c> é é"),
    ("", ""),
    (None, ""),
    ("no markup at all", "no markup at all"),
    ("<article>" + "<p>word</p>" * 3000 + "</article>", "\n\n".join(["word"] * 3000)),
]


def test_main_text(spark):
    for html, want in PAGES:
        assert html_extract.main_text(html) == want
    df = spark.createDataFrame([(k, None, h, "x") for k, (h, _) in enumerate(PAGES)] * 2, "page_id long, url string, html string, text string")
    rows = html_extract.extract(df).collect()
    assert len(rows) == 2 * len(PAGES) and all((r["text"], r["n_chars"]) == (PAGES[r["page_id"]][1], len(PAGES[r["page_id"]][1])) for r in rows)
    assert html_extract.extract(df.where("false")).collect() == []


LONG_TEXT = "Long enough text of an article, with a number of words. " * 4
HARD_PAGES = [
    (f"<article><div class='social-history'><p>{LONG_TEXT}</p></div></article>", LONG_TEXT.strip()),
    (f"<div class='main ad-free'><p>{LONG_TEXT}</p></div>", LONG_TEXT.strip()),
    (f"<article><section class='legal'><p>{LONG_TEXT}</p></section><p>short end</p></article>", LONG_TEXT.strip() + "\n\nshort end"),
    (f"<article><p>{LONG_TEXT}</p><p class='notice'>Closed today</p><p>{LONG_TEXT}</p></article>", LONG_TEXT.strip() + "\n\n" + LONG_TEXT.strip()),
    ("<article><p>Press <button>Start</button> now.</p><p>a<script>x()</script>b <span hidden>c</span>d</p></article>", "Press now.\n\nab d"),
    (f"<article><p>{LONG_TEXT}</p><!-- never closed <p>no</p>", LONG_TEXT.strip()),
    (f"<article><p>{LONG_TEXT}<p never closed", LONG_TEXT.strip()),
    (f"<body class='page no-sidebar'><div class='page has-sidebar with-comments'><p>{LONG_TEXT}</p></div>", LONG_TEXT.strip()),
    (f"<form><div><p>{LONG_TEXT}</p><p>{LONG_TEXT}</p></div></form><p>x</p>", LONG_TEXT.strip() + "\n\n" + LONG_TEXT.strip() + "\n\nx"),
    (f"<div class='social'><article><p>{LONG_TEXT}</p></article></div><div class='sidebar'><p>{LONG_TEXT * 9}</p></div>", LONG_TEXT.strip()),
    (f"<main><p>{LONG_TEXT}</p><div class='ad'><p>{LONG_TEXT}</p></div><div id='comments'><article><p>{LONG_TEXT}</p></article></div></main>", None),
    ("<h1>A headline of twenty</h1><p>By some writer</p>" + "<p>" + "x" * 300 + "</p><p>" + "y" * 300 + "</p><p>The end.</p><ul>" + "<li><a>link</a></li>" * 9 + "</ul>", "A headline of twenty\n\nBy some writer\n\n" + "x" * 300 + "\n\n" + "y" * 300 + "\n\nThe end."),
]


def test_hard_pages():
    for html, want in HARD_PAGES:
        if want is not None:
            assert html_extract.main_text(html) == want, html


@pytest.mark.parametrize("html", ["<p " * 330_000, "<div>" * 60_000 + "</p>" * 60_000, "<article>" + "<div>" * 40_000 + "</ul>" * 40_000, "<b>" * 60_000 + "</i>" * 60_000, "<div>" + "<b>" * 40_000 + "<div></div>" * 40_000, "<!--" * 200_000, "<a href='" * 50_000, "</" * 200_000, "<![CDATA[" * 60_000, "&#" * 200_000, "<p " * 100_000 + ">", "<div class='ad'>" * 40_000 + "text " * 1000])
def test_malformed_pages_take_linear_time(html):
    import time

    began = time.process_time()
    html_extract.main_text(html)
    assert time.process_time() - began < 20


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_all_pages_against_patterns(spark):
    """The test tables' pages are regular enough to be read by patterns."""
    import html as entities

    for r in html_extract.op1_html_extraction(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"(?s)<article>(.*)</article>", r["html"] or "")
        parts = re.split(r"(?i)</?(?:p|h1|ul|li|div|article)\b[^>]*>", body[1] if body else "")
        texts = [re.sub(r"\s+", " ", entities.unescape(re.sub("<[^>]*>", "", re.sub("(?i)<br>", " ", p)))).strip() for p in parts]
        assert r["text"] == "\n\n".join(t for t in texts if t) and r["n_chars"] == len(r["text"])


def test_threshold_clusters():
    level = html_extract.smooth(np.array([0.0, 0, 90, 100, 80, 0, 0]), 1.0)
    assert level.argmax() == 3 and level[0] < level[2]
    links = [("Link", 8, 0)] * 6
    assert html_extract.choose([*links, ("x" * 300, 1, 0), ("y", 1, 0), ("z" * 300, 1, 0), *links]) == ["x" * 300, "y", "z" * 300]


def test_urls(spark):
    link = lambda to: f'<html><head><LINK href="{to}" rel="canonical"></head>'
    rows = [
        (1, "https://a.example.org/es/1", None), (2, "http://shop.net/x", link("https://a.example.org/es/1")), (3, "http://www.shop.net/x/", ""), (4, "http://m.shop.net/x.html?utm_source=q#t", "<p>"),
        (5, "http://free.net/a", link("/b")), (6, "http://free.net/b", link("http://b.com/de/z")), (7, "http://B.com/de/z", None), (8, "http://free.net/b?id=2", None), (9, None, None), (10, "nonsense", link("http://b.com/de/z")),
        (11, "http://b.com/fr/ok", link("http://mixed.net/")), (12, "http://c.com/de/", link("http://mixed.net")), (13, "http://mixed.net", '<meta http-equiv="refresh" content="0; url=http://c.com/de/">'), (None, "http://EXAMPLE.org?q", ""), (2, "http://shop.net/x", link("https://a.example.org/es/1")),
        (15, "http://notexample.org.net/de/", ""), (16, "http://xcom/de/", ""),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, verdict string")
    got = {(r["page_id"], r["rule"], r["verdict"]) for r in url_filters.judge_urls(df, url_filters.RULES, spellings=True).collect()}
    assert got == {
        (1, "example.org/es/", "block"), (2, None, "block"), (3, None, "block"), (4, None, "block"), (5, None, "block"), (6, None, "block"), (7, "com/de/", "block"), (8, None, "allow"), (9, None, "allow"), (10, None, "allow"),
        (11, "com/fr/", "allow"), (12, "com/de/", "block"), (13, None, "allow"), (None, None, "allow"), (15, None, "allow"), (16, None, "allow"),
    }
    # Without assumed redirects between spellings only links count.
    plain = {r["page_id"]: r["verdict"] for r in url_filters.judge_urls(df, url_filters.RULES).where("rule is null and page_id is not null").collect()}
    assert plain == {2: "block", 3: "allow", 4: "allow", 5: "block", 6: "block", 8: "allow", 9: "allow", 10: "allow", 13: "allow", 15: "allow", 16: "allow"}
    assert url_filters.judge_urls(df.where("false"), url_filters.RULES).collect() == []
    log = spark.createDataFrame([("http://free.net/b?id=2", "http://b.com/de/z")], "a string, b string")
    assert {r["verdict"] for r in url_filters.judge_urls(df, url_filters.RULES, log, spellings=True).where("page_id = 8").collect()} == {"block"}


@pytest.mark.parametrize("delay", ["0", "5", "0.5", " 10 ", ".5", ""])
def test_delayed_redirects(spark, delay):
    rows = [(1, "http://old.net/a", f'<meta http-equiv="refresh" content="{delay}; url=http://b.com/de/z">'), (2, "http://b.com/de/z", None), (3, "http://old.net/b", '<meta http-equiv="refresh" content="30">')]
    got = url_filters.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), url_filters.RULES).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {1: "block", 2: "block", 3: "allow"}


# --- lines


def test_lines(spark):
    rng = random.Random(4)
    common = [f"This line stands in many documents, number {k} of them all" for k in range(6)]
    rows = [(k, "\n".join(rng.choice([*common, "short", f"own line {k} that is long enough to have a key", "", " \t" + common[0].upper() + "  "]) for _ in range(rng.randint(1, 30)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, common[1] + "é" * 3), (104, "\n".join([common[2]] * 500)), (-5, common[3])]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {r[0]: r for r in c.sql(line_dedup.SQL["op4_line_dedup"] + " ORDER BY doc_id").fetchall()}
    with Scratch(spark, "t") as s:
        got = line_dedup.keep_bitmaps(docs_of(spark, rows), s).collect()
        assert {r["doc_id"]: (r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"], r["keep_runs"]) for r in got} == want
        texts = dict(rows)
        for r in got:
            assert hashlib.sha256(line_dedup.kept_text(texts[r["doc_id"]], bytes(r["keep_bitmap"])).encode()).hexdigest() == r["kept_sha256"]
        wide = docs_of(spark, [*rows, rows[0], (None, common[0]), (None, common[0])]).select("*", F.lit(1).alias("id"), F.lit(2).alias("drop"), F.lit("x").alias("n_lines"))
        out = line_dedup.drop_lines(wide, s)
        assert out.columns == wide.columns and out.count() == len(rows) + 3 and out.where("doc_id is null and text = ''").count() == 2
        assert line_dedup.keep_bitmaps(docs_of(spark, []), s).collect() == []


# --- near-duplicates


def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    edges = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = {i: i for i in sets}
    for _ in sets:
        for i, j in edges:
            root[i] = root[j] = min(root[i], root[j])
    return {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


def test_near(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([6, 40, 200]))]
        for _ in range(rng.choice([1, 3, 25])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                own[rng.randrange(len(own))] = rng.choice(words).upper() if rng.random() < 0.5 else rng.choice(words)
            rows.append((len(rows) * 3 + 5, rng.choice([" ", "\n", "  "]).join(own)))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "ONE  two"), (1005, "two one"), (1006, " ".join(words * 40)), (1007, " ".join(words * 40) + " end")]
    with Scratch(spark, "t") as s:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs_of(spark, rows), s).collect()}
        want = brute_near(rows)
        assert got == want
        wide = docs_of(spark, [*rows, rows[0], (None, "some words without a document id here")]).withColumn("gone", F.lit(1))
        kept = near_dedup.drop_near_duplicates(wide, s)
        assert kept.columns == wide.columns
        assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted([i for i, x in want.items() if x[2]] + [-1])
        assert near_dedup.near_duplicates(docs_of(spark, []), s).collect() == []


def brute_near_rows(rows):
    """As brute_near, where rows of one doc_id are one document."""
    alone = brute_near([(k, t) for k, (_, t) in enumerate(rows)])
    root = {k: alone[k][1] for k in alone}
    changed = True
    while changed:
        changed = False
        for k, (i, _) in enumerate(rows):
            for j, (o, _) in enumerate(rows):
                if (root[k] == root[j] or i == o) and root[k] != root[j]:
                    low, high = sorted((root[k], root[j]))
                    root = {x: low if r == high else r for x, r in root.items()}
                    changed = True
    return sorted((i, alone[k][0], min(rows[j][0] for j in root if root[j] == root[k])) for k, (i, _) in enumerate(rows))


def test_near_with_repeated_ids(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    bases = [[rng.choice(words) for _ in range(60)] for _ in range(8)]
    rows = []
    for k in range(40):
        own = list(rng.choice(bases))
        own[rng.randrange(60)] = rng.choice(words)
        rows.append((rng.randrange(25), " ".join(own)))
    rows += [(7, " ".join(bases[0])), (7, " ".join(bases[1])), (9, " ".join([*bases[1][:-1], "end"])), (30, ""), (30, " ".join(bases[2])), (31, ""), (31, None), (32, "")]
    with Scratch(spark, "t") as s:
        got = near_dedup.near_duplicates(docs_of(spark, [*rows, (None, "no id"), (None, None)]), s).collect()
        want = brute_near_rows(rows)
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == want
        assert [r["kept"] for r in got if r["doc_id"] is None] == [False, False]
        kept = near_dedup.drop_near_duplicates(docs_of(spark, [*rows, (None, "no id")]).withColumn("row", F.lit(1)), s).collect()
        least = {i for i, _, c in want if i == c}
        assert sorted((r["doc_id"], r["text"]) for r in kept if r["doc_id"] is not None) == sorted((i, min(t or "" for j, t in rows if i == j)) for i in least)


def test_min_max_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.r_[a[:860], rng.integers(0, 2**63, 140).astype(np.uint64)]
    s = near_dedup.min_max(np.r_[a, b], np.array([0, 1000, 2000]), 512)
    assert abs((s[0] == s[1]).mean() - 860 / 1140) < 0.06


# --- tokens


def texts_for_tokens():
    return ["", None, " ", "Hello, world!! it's  I'LL\n\tdon't", "ÉCOLE été ﬁ İstanbul ΣΑΣ", "a" * 5000, "x1y22 3.14 <|endoftext|>a <|startoftext|>", "naïve café é́ ́x", "日本語 テキスト mixed, words.", "foo### bar$$$ baz&&& *** | x|y", " nb sp\x1cctl\x85", "क़ ख ½ ² Ⅳ", "'s 't'S ''"]


def test_words_equal_whole_texts():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(token_shards.tokenizer_path()), token_shards.WordEncoder(token_shards.tokenizer_path())
    for text, ids in zip(texts_for_tokens(), enc.encode(texts_for_tokens()), strict=True):
        assert ids.tolist() == tok.encode(text or "", add_special_tokens=False).ids, text


def test_words_equal_whole_texts_at_random():
    from tokenizers import Tokenizer

    tok, enc, rng = Tokenizer.from_file(token_shards.tokenizer_path()), token_shards.WordEncoder(token_shards.tokenizer_path()), random.Random(10)
    atoms = [*"aBéÉİıΣςσßẞŉǰ'1²½Ⅳ٣.,!#_-<|>ªº×ſКあ日😀ﬁ𝒜Å", "\u0301", "\u0307", "\u0308", "'s", "'LL", "’", "“", "…", "–", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2009", "\u200b", "\u3000", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "ALİ,", "ANKARALİ.", "\xad", "i̇", "don't", "re", "ve", "\x00", "\ufeff"]
    for _ in range(50):
        texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 14))) for _ in range(200)]
        for text, ids in zip(texts, enc.encode(texts), strict=True):
            assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids, text
    word = "Wörter" * 60_000
    assert next(enc.encode([word])).tolist() == tok.encode(word, add_special_tokens=False).ids


def test_shards(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_shards.tokenizer_path())
    rows = [(k * 7 - 20, t) for k, t in enumerate(texts_for_tokens())] + [(10**12, "far"), (-(2**63), "least"), (None, "none"), (1, "twice"), (1, "again")]
    with Scratch(spark, "t") as s:
        manifest = token_shards.write_shards(docs_of(spark, rows), s.path(), token_shards.tokenizer_path(), shards=3)
        manifest = s.put(manifest).collect()
        got = sorted(token_shards.read_shards(spark, manifest).collect(), key=lambda r: r["start"])
        start = 0
        for (i, t), r in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), got, strict=True):
            ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
        readers = [token_shards.ShardReader(m["file"]) for m in manifest]
        for i, t in rows[:14]:
            assert i == 1 or sum(r.get(i) is not None for r in readers) == 1
        # Three rows have the id 1; they may be in several shards.
        assert all(r.get(123456) is None for r in readers) and sum(r.get(1, k) is not None for r in readers for k in range(4)) == 3
        small = s.put(token_shards.write_shards(docs_of(spark, rows), s.path(), token_shards.tokenizer_path(), shards=2, most=1)).collect()
        assert len(small) > len(manifest) and [r["ids_crc32"] for r in sorted(token_shards.read_shards(spark, small).collect(), key=lambda r: r["start"])] == [r["ids_crc32"] for r in got]
        assert token_shards.read_shards(spark, s.put(token_shards.write_shards(docs_of(spark, []), s.path(), token_shards.tokenizer_path())).collect()).collect() == []


def test_pieces(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    texts = ["", None, " ", "  two  spaces ", "Hello world, this is text.", "tab\tnewline\n\nend", "日本語 emoji 🎉 é", "▁ mark ▁▁x", "aaaaaaaa" * 40, "a" * 3000 + " b", "x" * 59 + "yz", "The the THE", "\x00\x01"]
    rows = list(enumerate(texts)) + [(3, "again"), (None, "no id")]
    with Scratch(spark, "t") as s:
        got = pieces.encode_documents(docs_of(spark, rows), s, pieces.model_path(), with_ids=True).collect()
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["ids"]) for r in got) == sorted((-1 if i is None else i, sp.encode(t or "")) for i, t in rows)
        assert {r["doc_id"] for r in got if not r["round_trip"]} == {7}  # holds the mark that stands for spaces
        table, first = pieces.read_pieces(pieces.model_path())
        names = {i: p for p, _, i in table}
        assert all(pieces.decode(r["ids"], names, first) == sp.decode(r["ids"]) for r in got)
        assert pieces.encode_documents(docs_of(spark, []), s, pieces.model_path()).collect() == []


def test_a_task_folds_a_bounded_number_of_characters(spark, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(pieces, "FOLD_CHARS", 2_000, raising=False)
    sp, rng, sizes, encode = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path()), random.Random(8), [], pieces.encode_units

    def counted(units, *args):
        sizes.extend(r["n"] for r in units.groupBy(F.spark_partition_id()).agg(F.sum(F.length("unit")).alias("n")).collect())
        return encode(units, *args)

    monkeypatch.setattr(pieces, "encode_units", counted)
    rows = [(k, " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 12))) for _ in range(50))) for k in range(60)]
    with Scratch(spark, "t") as s:
        got = pieces.encode_documents(docs_of(spark, rows), s, pieces.model_path(), with_ids=True).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {k: sp.encode(t) for k, t in rows}
    assert sum(sizes) > 20_000 and max(sizes) < 3_000


def test_viterbi(spark):
    rng = random.Random(2)
    letters = "abcd"
    made = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(40)} | {"a", "b", "c"}
    table = [(p, -rng.random() * 10 - len(p), k) for k, p in enumerate(sorted(made))]
    scores = {p: (s, i) for p, s, i in table}
    units = ["".join(rng.choice(letters) for _ in range(n)) for n in (1, 2, 5, 9, 14, 20, 30)]

    def best(u):
        paths = [(0.0, [])]
        for j in range(1, len(u) + 1):
            options = [(paths[i][0] - scores[u[i:j]][0], paths[i][1] + [scores[u[i:j]][1]]) for i in range(max(0, j - 4), j) if u[i:j] in scores]
            paths.append(min(options or [(paths[j - 1][0] + 20, [*paths[j - 1][1], *(1000 + b for b in u[j - 1].encode())])]))
        return paths[-1][1]

    df = spark.createDataFrame([(u, 1) for u in set(units)], "unit string, n long").repartition(2, "unit")
    got = {r["unit"]: r["ids"] for r in pieces.encode_units(df, table, 1000, "unigram").collect()}
    assert got == {u: best(u) for u in units}


def test_long_units_of_a_unigram_model(spark, monkeypatch):
    rng = random.Random(5)
    made = {"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))) for _ in range(40)} | {"▁", "a"}
    table = [(p, -rng.random() * 10 - len(p), k) for k, p in enumerate(sorted(made))]
    monkeypatch.setattr(pieces, "read_pieces", lambda path: (table, 1000))
    scores = {p: (s, i) for p, s, i in table}
    texts = ["", "ab", "ab" * 50 + "é", "b" * 200, "".join(rng.choice("abé") for _ in range(300)), "a b " * 40]
    with Scratch(spark, "t") as s:
        wide = docs_of(spark, list(enumerate(texts))).select("*", F.lit(1).alias("part"), F.lit("x").alias("units"), F.lit("x").alias("block"))
        got = {r["doc_id"]: r["ids"] for r in pieces.encode_documents(wide, s, "", kind="unigram", with_ids=True).collect()}
    for k, t in enumerate(texts):
        marked = "▁" + t.replace(" ", "▁") if t else ""
        assert got[k] == pieces.viterbi_long(marked, scores, 1000, 4, 20.0), t


def test_cutter_parts_long_texts_where_no_piece_reaches():
    table, _ = pieces.read_pieces(pieces.model_path())
    cutter = pieces.Cutter(pieces.joints_of(table))
    text = "Some words, and 1234 numbers; é日本 and so on " * 30
    whole, counts = cutter.cut(list(cutter.chunks(text)))
    parts, more = cutter.cut(list(cutter.chunks(text, most=50)))
    assert len(counts) == 1 and len(more) > 10 and whole.to_pylist() == parts.to_pylist() and "".join(whole.to_pylist()) == "▁" + text.replace(" ", "▁")


# --- benchmark leaks


def test_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 12))] for _ in "ab")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == t[-1][-1]


def test_leaks(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "bcdfghklm" for b in ("an", "el", "or", "ist", "und", "ek")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, f"{text(20)} marker{k} {text(10)}. Answer{k} is {text(5)}.") for k in range(12)] + [(50, None), (51, ""), (52, "tiny one")]
    rows = [(k, text(rng.choice([5, 60, 300]))) for k in range(60)]
    for k in range(12):
        rows.append((100 + k, f"{text(37)} {items[k][1]} {text(50)}"))
        rows.append((200 + k, f"{text(70)} {items[k][1].upper().replace(' ', ' ## ')} {text(20)}"))
        changed = items[k][1].split()
        for at in (1, 6, 11, 16):
            changed[at] = "other"
        rows.append((300 + k, f"{text(20)} {' '.join(changed)} {text(20)}"))
    rows += [(900, None), (901, ""), (902, "aaa " * 5000), (100, rows[-1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    with Scratch(spark, "t") as s:
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs_of(spark, rows), bench, s, rank=32).collect()}
        want = {(n + k, k) for k in range(12) for n in (100, 200, 300)} | {(100, 11)}
        assert got == want
        wide = docs_of(spark, rows).withColumn("bad", F.lit(0))
        kept = decontaminate.drop_leaking(wide, bench, s)
        assert kept.columns == wide.columns and {r["doc_id"] for r in kept.collect()} == set(range(60)) | {900, 901, 902}
        assert decontaminate.find_leaks(docs_of(spark, []), bench, s).collect() == [] and decontaminate.find_leaks(docs_of(spark, rows), bench.where("false"), s).collect() == []


def test_leaks_of_common_words(spark):
    rng = np.random.default_rng(8)
    weights = 1 / np.arange(1, 3001)
    text = lambda n, top=3000: " ".join(f"w{k}" for k in rng.choice(top, n, p=weights[:top] / weights[:top].sum()))
    items = [(k, text(40)) for k in range(60)] + [(100 + k, text(32, 12)) for k in range(8)] + [(200 + k, text(12, 12)) for k in range(8)]
    rows = [(k, text(200)) for k in range(300)] + [(1000 * at + k, f"{text(at)} {t} {text(60)}") for k, t in items for at in (48, 52, 56, 60)]
    with Scratch(spark, "t") as s:
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"), s, rank=32).collect()}
    assert {(1000 * at + k, k) for k, _ in items for at in (48, 52, 56, 60)} - got == set()


def space_of_all_windows(docs, items, rank):
    """The cosine of a text's first window with an item, in the space of all windows of all documents, by a dense decomposition."""
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    terms = {w: k for k, w in enumerate(sorted({w for t in items for w in split(t)}))}
    idf = np.array([np.log((1 + len(docs)) / (1 + sum(w in x for x in map(set, map(split, docs))))) + 1e-3 for w in terms])

    def row(words):
        return np.bincount([terms[w] for w in words if w in terms], minlength=len(terms)) * idf

    windows = [row(w[k : k + 32]) for w in map(split, docs) for k in range(0, max(1, len(w) - 16), 16)]
    a = np.array([x / np.linalg.norm(x) for x in windows if x.any()])
    b = np.array([x / np.linalg.norm(x) for x in (row(split(t)) for t in items)])
    vectors = np.linalg.eigh(a.T @ a + decontaminate.OWN * len(a) / len(b) * b.T @ b)[1][:, -rank:]

    def cosine(text, item):
        x, y = row(split(text)[:32]) @ vectors, row(split(item)) @ vectors
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y)

    return cosine


def test_the_latent_space_is_that_of_all_documents(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(40)]
    items = [" ".join(rng.sample(words, 20)) for _ in range(12)]
    # 4,500 texts of which each fifth hundred speaks of other words.
    docs = [" ".join(rng.choices(words[5 * (k // 500 % 8) :][:5] + ["other", "more"], k=rng.choice([6, 20, 48]))) for k in range(4_500)]
    docs += [" ".join(w for w in items[k].split() if rng.random() < 0.9) for k in range(12)]
    cosine = space_of_all_windows(docs, items, 24)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    with Scratch(spark, "t") as s:
        found = {(r["doc_id"], r["item_id"]): r["cosine"] for r in decontaminate.find_leaks(docs_of(spark, list(enumerate(docs))), bench, s, rank=24).collect()}
    assert {(4_500 + k, k) for k in range(12)} <= set(found)
    for k in range(12):
        assert abs(found[4_500 + k, k] - cosine(docs[4_500 + k], items[k])) < 1e-4


# --- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(t):
    digits = lambda m: re.sub(r"[^0-9]", "", m)
    ok = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 13 <= len(digits(m)) <= 19 and personal_data.luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15}
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t) if ok[k](m[0])]


def test_base_is_leftmost():
    rng = random.Random(11)
    parts = ["a", "b.c", "@", "@@", ".", "1", "255", "256", " ", "-", "+", "+1", "(", ")", "4539 1488 0343 6467", "x@y.com", "10.0.0.1", "%", "é", "\n", "0007"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert personal_data.find_base(t) == plain_base(t), t


def test_luhn():
    assert personal_data.luhn("4539148803436467") and not personal_data.luhn("4539148803436468") and personal_data.luhn("00")


@pytest.fixture(scope="module")
def tagger():
    texts = ["Some text about nothing much that goes on and on, with a number 1234 and a date 2024-05-06. " * 8, "Mail anne.b@example.com or call +1 (212) 555-1234 now, from 10.20.30.40 please. " * 4]
    x, y = personal_data.training_windows(texts)
    return personal_data.train(x, y, tags=5), x, y


def test_gradients():
    from statuta.llm import tagger as tg

    rng = np.random.default_rng(0)
    x, y = rng.integers(0, tg.CLASSES, (7, 3)).astype(np.uint8), rng.integers(0, 3, (7, 3))
    model = tg.train(x.T, y.T, 3, size=3, steps=2)
    _, grads = tg._gradients(model, x, y)
    for p, g in zip(model.parameters(), grads, strict=True):
        at = tuple(int(k) for k in np.unravel_index(int(np.abs(g).argmax()), g.shape))
        old, ends = p[at], []
        for d in (1e-5, -1e-5):
            p[at] = old + d
            ends.append(tg._gradients(model, x, y)[0])
        p[at] = old
        assert abs((ends[0] - ends[1]) / 2e-5 - g[at]) < 1e-6 + 1e-4 * abs(g[at])


def test_tagging_learns_and_windows_agree(tagger):
    model, x, y = tagger
    tags = np.stack(model.best_paths(list(model.emissions(x[:600].T).transpose(2, 0, 1)), np.ones(600, bool)))
    hit = (tags == y[:600]) & (y[:600] > 0)
    assert hit.sum() / (y[:600] > 0).sum() > 0.8 and ((tags > 0) & (y[:600] == 0)).mean() < 0.02
    table = personal_data.class_table()
    text = "plain words here and there, " * 60
    text = text[:1000] + " write to jane (at) example (dot) com soon, " + text[1000:]
    runs = next(model.tag([personal_data.classes_of(text, table)], core=100, context=32))
    assert personal_data.confirm(text, runs, []) == [("email", text.index("jane"), text.index(" soon"))]
    assert personal_data.confirm(text[:900], next(model.tag([personal_data.classes_of(text[:900], table)])), []) == []


def test_personal_data(spark, tagger):
    rows = [(0, None), (1, ""), (2, "Mail a.b@c.org, then 1.2.3.4; é +44 20 7946 0958."), (3, "x " * 40000 + "z@y.com"), (2, "nothing"), (None, "4539148803436467")]
    got = {(r["doc_id"], r["spans"]): r for r in personal_data.find_personal_data(docs_of(spark, rows).withColumn("spans", F.lit(1)), tagger[0]).collect()}
    assert len(got) == 6
    for i, t in rows:
        base = plain_base(t or "")
        r = next(r for (d, sp), r in got.items() if d == i and set(filter(None, personal_data.listed(base).split(","))) <= set(sp.split(",")) and r["base_sha256"] == hashlib.sha256(personal_data.listed(base).encode()).hexdigest())
        assert [r[f"n_{k}"] for k in personal_data.KINDS] == [sum(b[0] == k for b in base) for k in personal_data.KINDS]
    assert personal_data.find_personal_data(docs_of(spark, []), tagger[0]).collect() == []


def test_made_forms_are_confirmed():
    rng = np.random.default_rng(4)
    for _ in range(4000):
        tag, made = personal_data._make(rng, ["mail", "house", "river"])
        kind = personal_data.KINDS[tag - 1]
        if tag and (kind != "card" or personal_data.valid(kind, made)):
            for after in (" now", "."):
                assert personal_data.confirm(f"see {made}{after}", [(tag, 4, 4 + len(made))], []) == [(kind, 4, 4 + len(made))], made
    for kind, form in [("phone", x) for x in ("+49/123/456789", "01 23 45 67 89", "0033 1 23 45 67 89", "030 1234567", "0171/1234567", "(030) 1234567")] + [("ip", "10[.]20[.]30[.]40"), ("email", "name (at) host (dot) it"), ("email", "name [at] host.nl")]:
        assert personal_data.confirm(f"see {form}. Then", [(personal_data.KINDS.index(kind) + 1, 4, 4 + len(form))], []) == [(kind, 4, 4 + len(form))], form
    for kind, other in (("ip", "1.2.3.4.5"), ("phone", "01 23 45 67 89 10 11"), ("email", "look at example.html")):
        assert personal_data.confirm(f"see {other} now", [(personal_data.KINDS.index(kind) + 1, 4, 4 + len(other))], []) == [], other


# --- toxicity


def test_boosting_and_isotonic():
    from statuta.llm.boosting import fit_isotonic, fit_trees

    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    raw = fit_trees(x[:2000], y[:2000]).raw(x[2000:])
    assert ((raw > 0) == (y[2000:] > 0)).mean() > 0.95
    iso = fit_isotonic(raw, y[2000:])
    assert (np.diff(iso(np.sort(raw))) >= 0).all() and 0 <= iso(raw).min() <= iso(raw).max() <= 1
    assert fit_trees(x[:5], np.ones(5)).raw(x).shape == (3000,) and fit_isotonic(np.zeros(0), np.zeros(0))(raw).max() == 0


def test_toxicity(spark):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("ba", "ko", "lu", "mi", "se") for b in ("ran", "tel", "vor", "nis", "dap", "kem")]
    rows, marks = [], []
    for k in range(900):
        w = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["snarl", "Grubble", "vexing", "you", "gr@bble"]))
        rows.append((k, " ".join(w)))
        marks.append((k, int(toxic)))
    docs, labels = docs_of(spark, [*rows, (2000, None), (2001, ""), (None, "you snarl")]), spark.createDataFrame([*marks, (None, 1), (5000, None)], "doc_id long, toxic int")
    with Scratch(spark, "t") as s:
        model = toxicity.fit(docs, labels, s)
        got = toxicity.score(docs.withColumn("score", F.lit("x")), model, ["doc_id"]).collect()
        held = [(r["score"] >= 0.5, dict(marks)[r["doc_id"]]) for r in got if r["doc_id"] in dict(marks) and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
        assert sum(a == bool(b) for a, b in held) / len(held) > 0.97 and all(0 <= r["score"] <= 1 for r in got) and len(got) == 903
        wide = docs.withColumn("score", F.lit("x"))
        kept = toxicity.drop_toxic(wide, labels, s)
        assert kept.columns == wide.columns and 700 < kept.count() < 800 and kept.where("doc_id >= 2000").count() == 2
        for few in (labels.where("toxic = 0"), labels.where("false")):
            assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, few, s), ["doc_id"]).collect()} == {0.0}
        assert toxicity.score(docs_of(spark, []), model, ["doc_id"]).collect() == []
    spark.range(3).select(toxicity.fold(F.col("id"))).collect()


def test_long_words_count():
    words = ["x" * 80, "y" * 500_000, "plain"]
    lexicon = {toxicity.digest("x" * 80): 2.0, toxicity.digest("y" * 500_000): 3.0}
    rows = [toxicity.features(" ".join(w), toxicity.TokenTable(lexicon)) for w in ([*words, words[0]], ["plain"], [words[1] + "!!!"], ["!" * 300_000 + "1" * 300_000 + "a"])]
    strong = [r[toxicity.FEATURES.index("strong")] for r in rows]
    assert strong == [3, 0, 1, 0] and toxicity.plain("..." + words[1] + "9_") == words[1]
    look = toxicity.TokenTable(lexicon)
    toxicity.features(" ".join(words), look)
    assert max(map(len, look.place)) <= toxicity.LONG
