"""Personal data in texts (operator 8).

Two detectors.  The base finds plain e-mail addresses, IP addresses, payment
cards and phone numbers by pattern and checks.  The method is a character-level
bidirectional LSTM with CRF transitions, trained in numpy from labelled spans; it
reads every character of every text in overlapping windows, whose emissions are
put together and decoded over the whole text.  It adds spans that the base misses
(spelt-out addresses, unusual separators, national phone numbers).  Their bounds
are the decoder's, moved to the ends of words; what they hold must be valid data
of its kind once marks are written plainly, and none may overlap a base span, so
base spans always stay.

The labelled spans are base spans in a sample of at most ``SAMPLE`` documents,
drawn by a hash of doc_id, of each a stretch of ``STRETCH`` characters from
anywhere in it, and spans of varied forms set into pieces of them.

Defined cases: null or empty texts have no spans; rows that share a doc_id are
searched each, and the greatest of their texts is drawn; null ids are kept; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, tidy
from .tagger import Tagger, class_table, classes_of, train

KINDS = ("email", "ip", "card", "phone")
SAMPLE, STRETCH, WINDOWS, WIDTH = 400, 4_000, 2400, 96
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its first digit fails from every other, so only the first is tried.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    d = [int(x) for x in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def find_emails(text: str) -> Iterator[Span]:
    """From each @ back to the start of the name; a name whose @ has no domain fails from every start."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            last = m.end()
            yield "email", start, last
        at = text.find("@", max(at + 1, last))


def find_base(text: str) -> list[Span]:
    """By kind as listed, then by start."""
    out = list(find_emails(text))
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


#: How marks of addresses may be written, and letters that may stand within a number of a kind.
AT, DOT = re.compile(r"\s*[\[({<]\s*(?:@|at)\s*[\])}>]\s*|\s*@\s*|\s+at\s+", re.I), re.compile(r"\s*[\[({<]\s*(?:\.|dot)\s*[\])}>]\s*|\s*\.\s*|\s+dot\s+", re.I)
PLAIN_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}")
#: A whole address around a run that the decoder found; it has bounds, so no junk makes the search long.
_OPEN, _SHUT = r"\s{0,2}[\[({<]?\s?", r"\s?[\])}>]?\s{0,2}"
_AT = rf"{_OPEN}(?:@|\bat\b|\bAT\b){_SHUT}"
_SURE = r"(?:\.|\s{0,2}[\[({<]\s?(?:\.|dot|DOT)\s?[\])}>]\s{0,2}|\s{1,2}(?:dot|DOT)\s{1,2})"
_PART = "[A-Za-z0-9-]{1,63}"
WHOLE_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{{0,63}}+{_AT}{_PART}(?:{_SURE}{_PART}){{0,8}}{_SURE}[A-Za-z]{{2,24}}\b")
DIGITS = frozenset("0123456789")
CARD_MARKS, PHONE_MARKS = frozenset(" -./_"), frozenset(" -./()+")
OPENS = {")": "(", "]": "[", "}": "{", ">": "<"}


def valid(kind: str, found: str) -> bool:
    """Whether a text is data of a kind once its marks are written plainly."""
    digits = re.sub(r"[^0-9]", "", found)
    if kind == "email":
        # Words alone need both marks spelt out or in brackets, or the sign itself.
        sure = "@" in found or re.search(r"[\[({<]\s*at\s*[\])}>]", found, re.I) or re.search(r"\bat\b.*(?:\bdot\b|[\[({<]\s*\.)", found, re.I)
        return bool(sure) and PLAIN_EMAIL.fullmatch(DOT.sub(".", AT.sub("@", found))) is not None
    if kind == "ip":
        parts = DOT.sub(".", found).split(".")
        return len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", p) and small(p) for p in parts)
    if kind == "card":
        return CARD_MARKS.issuperset(re.sub("[0-9]", "", found)) and 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 2
    # Numbers without a country or trunk prefix need three groups or brackets; dates and long runs of groups are none.
    groups = re.findall("[0-9]+", found)
    known = found[0] in "+(" or groups[0][0] == "0" or len(groups) >= 3 if groups else False
    return known and PHONE_MARKS.issuperset(re.sub("[0-9]", "", found)) and 9 <= len(digits) <= 15 and len(groups) <= 6 and (len(groups) > 1 or found[0] == "+")


def settled(text: str, i: int, j: int, inside: frozenset[str]) -> tuple[int, int]:
    """A run moved to the beginning of a word and to the end of one, with the bracket that belongs to it."""
    while i < j and text[i] not in inside and text[i] not in "+(":
        i += 1
    while 0 < i < j and text[i - 1] in inside and text[i] in inside:
        i -= 1
    while j > i and not text[j - 1].isalnum():
        j -= 1
    while i < j < len(text) and text[j].isalnum():
        j += 1
    if i and text[i - 1] in "+(" and text[i : i + 1].isdigit():
        i -= 1
    while i < j and inside is LOCAL and text[i] in "._%+-(":
        i += 1
    if j < len(text) and text[j] in OPENS and text.count(OPENS[text[j]], i, j) > text.count(text[j], i, j):
        j += 1
    return i, j


def widened(text: str, i: int, j: int) -> tuple[int, int]:
    """A number's bounds with the groups of digits that follow each other beside it."""
    while i > 1 and (text[i - 1].isdigit() or text[i - 1] in "-./ " and text[i - 2].isdigit() or text[i - 1] in "+("):
        i -= 1
    while j + 1 < len(text) and (text[j].isdigit() or text[j] in "-./ " and text[j + 1].isdigit()):
        j += 1
    return i, j + (j + 1 == len(text) and text[j].isdigit())


def cut_off(text: str, i: int, j: int) -> bool:
    """Whether a number goes on beyond its bounds."""
    before, after = text[max(0, i - 2) : i], text[j : j + 2]
    return before[-1:].isalnum() or after[:1].isalnum() or len(before) == 2 and before[1] in "-./" and before[0].isdigit() or len(after) == 2 and after[0] in "-./" and after[1].isdigit()


def confirm(text: str, runs: list[tuple[int, int, int]], base: list[Span]) -> list[Span]:
    """The spans that decoded runs stand for: within the decoder's bounds, or in those of the whole number or address that it touched.

    A number that is not valid as what the decoder took it for may be as another kind.
    """
    out: list[Span] = []
    for tag, i, j in runs:
        options: list[Span] = []
        if KINDS[tag - 1] == "email":
            found = (m.span() for m in WHOLE_EMAIL.finditer(text, max(0, i - 64), min(len(text), j + 64)))
            options += [("email", s, e) for s, e in found if 4 * (min(e, j) - max(s, i)) >= e - s]
            options.append(("email", *settled(text, i, j, LOCAL)))
        own = settled(text, i, j, DIGITS)
        kinds = sorted(KINDS[1:], key=lambda k: k != KINDS[tag - 1])
        options += [(k, s, e) for s, e in (own, widened(text, *own)) if s < e and not cut_off(text, s, e) for k in kinds]
        for kind, s, e in options:
            if s < e and all(e <= a or s >= b for _, a, b in [*base, *out]) and valid(kind, text[s:e]):
                out.append((kind, s, e))
                break
    return out


def listed(spans: list[Span]) -> str:
    order = {k: n for n, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1])))


def _make(rng: np.random.Generator, words: list[str]) -> tuple[int, str]:
    """A span of some kind in some form, or (tag 0) something that only looks like one."""
    pick = lambda *a: a[int(rng.integers(len(a)))]
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: re.sub(r"[^a-z]", "", pick(*words).lower()) or "name"
    kind = int(rng.integers(0, 7))
    if kind == 0:
        at, dot = pick(("@", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", "."), ("{at}", "{dot}"), ("(at)", "."))
        return 1, f"{word()}{pick('', '.', '_', '')}{pick('', number(2))}{at}{word()}{dot}{pick('', f'{word()}{dot}')}{pick('com', 'org', 'net', 'de', 'fr', 'es', 'it', 'nl', 'ch', 'eu', 'example' + dot + 'com')}"
    if kind == 1:
        return 2, pick(".", "[.]", " . ", "(.)", " dot ").join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        d = number(int(pick(13, 15, 16, 16, 16, 19)))
        sep = pick("", " ", "-", ".", "/", "_", "  ")
        return 3, sep.join(d[k : k + 4] for k in range(0, len(d), 4))
    if kind in (3, 4):
        a, b, c = number(3), number(3), number(4)
        return 4, pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{pick('33', '44', '49')} {number(2)} {number(4)} {number(4)}", f"+{number(2)}/{number(3)}/{number(6)}", f"+{number(2)} {number(3)} {number(3)} {number(4)}", pick(" ", ".", "-").join([f"0{number(1)}", *(number(2) for _ in range(4))]), f"0033 {number(1)} {number(2)} {number(2)} {number(2)} {number(2)}", pick(f"0{number(2)} ", f"0{number(3)}/", f"(0{number(2)}) ") + number(7))
    return 0, pick(f"{number(4)}-{number(2)}-{number(2)}", f"{number(2)}:{number(2)}", f"{number(1)}.{number(1)}.{number(2)}", number(int(rng.integers(1, 9))), f"${number(1)},{number(3)}.{number(2)}", f"{number(2)}%", f"Version {number(1)}.{number(1)}", "at", "dot", f"({number(4)})", f"[{number(1)}]", f"{number(3)},{number(3)}", "+", "@")


def training_windows(texts: list[str], windows: int = WINDOWS, width: int = WIDTH, seed: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags of windows: a third of them as they stand in the texts, around base spans if there are any."""
    rng, table = np.random.Generator(np.random.PCG64(seed)), class_table()
    texts = [t for t in texts if len(t) > 20] or ["some text without anything of interest, again and again. " * 3]
    based = [(t, b) for t in texts if (b := find_base(t))]
    x, y = np.zeros((windows, width), np.uint8), np.zeros((windows, width), np.int64)
    for row in range(windows):
        own = based and row % 3 == 0
        text, spans = based[int(rng.integers(len(based)))] if own else (texts[int(rng.integers(len(texts)))], [])
        if own:
            _, s, _ = spans[int(rng.integers(len(spans)))]
            start = max(0, s - int(rng.integers(0, width // 2)))
        else:
            start = int(rng.integers(0, max(1, len(text) - width)))
        piece, tags = text[start : start + width], np.zeros(width, np.int64)
        for kind, a, b in spans if own else find_base(piece):
            tags[max(0, a - start if own else a) : max(0, b - start if own else b)] = KINDS.index(kind) + 1
        tags = tags[: len(piece)]
        if not own:
            words = piece.split() or ["x"]
            for _ in range(int(rng.integers(0, 3))):
                tag, made = _make(rng, words)
                gaps = [k for k, c in enumerate(piece) if c == " " and not tags[k]]
                at = gaps[int(rng.integers(len(gaps)))] + 1 if gaps else len(piece)
                piece = f"{piece[:at]}{made} {piece[at:]}"
                tags = np.r_[tags[:at], np.full(len(made), tag), 0, tags[at:]]
            piece, tags = piece[:width], tags[:width]
        codes = classes_of(piece, table)[:width]
        x[row, : len(codes)], y[row, : len(codes)] = codes, tags[: len(codes)]
    return x, y


def fit(docs: DataFrame, sample: int = SAMPLE) -> Tagger:
    """``docs`` (doc_id, text).  The sample is drawn by ids alone, so only its own texts are read to the end."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # A training window is short, so of each sampled text a stretch is enough; it may lie anywhere in the text.
    stretch = F.expr(f"substring(text, 1 + cast(pmod(xxhash64(doc_id, 1), greatest(length(text) - {STRETCH}, 1)) AS int), {STRETCH})")
    rows = docs.join(ids, "doc_id", "left_semi").where("text is not null").groupBy("doc_id").agg(F.max(stretch).alias("t")).orderBy("doc_id").collect()
    return train(*training_windows([r["t"] for r in rows]), tags=len(KINDS) + 1)


def find_personal_data(docs: DataFrame, model: Tagger, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, counts of base spans, base_sha256, spans, n_spans) per row, without a shuffle; n_spans is the number of all spans."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = class_table()
        for big in batches:
            for batch in parts(big):
                own = [x or "" for x in batch.column(1).to_pylist()]
                rows = []
                for t, runs in zip(own, model.tag([classes_of(t, classes) for t in own]), strict=True):
                    base = find_base(t)
                    counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                    more = confirm(t, runs, base)
                    rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed([*base, *more]), len(base) + len(more)))
                columns = [pa.array([r[k] for r in rows], pa.string() if k in (4, 5) else pa.int64()) for k in range(7)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    def parts(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
        """Slices of about ``most`` bytes of text."""
        size = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(1)], np.int64)
        part = np.cumsum(size) // most
        for k in np.unique(part):
            rows = np.flatnonzero(part == k)
            yield batch.slice(int(rows[0]), len(rows))

    return texts.mapInArrow(tidy(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_personal_data(docs, fit(docs))


QUERIES = {"op8_personal_data": op8_personal_data}
