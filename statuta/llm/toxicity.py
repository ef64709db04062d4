"""Toxicity scores (operator 6).

Gradient-boosted trees over dense features of the whole text: densities of a
learned lexicon, how near its words stand to second-person words, and rates of
capitals, punctuation and obfuscation.  Scores are calibrated by isotonic
regression on out-of-fold predictions.

Labels are used from a sample of at most ``SAMPLE`` labelled rows, drawn by a hash
of doc_id, so it doesn't depend on the order of the rows.  Half of the sample gives
the lexicon (words and beginnings of words with the odds that their document is
toxic), the other half the trees and the calibration.  Everything else covers
all rows.

Defined cases: null or empty texts get the score of a text without words; a null
doc_id counts as held out and teaches nothing; rows of labels with a null are
ignored; without two classes among the labels every score is the share of toxic
labels, or 0 without any; rows that share a doc_id are scored each by its text,
and the greatest of their texts teaches; words of any length count, those of over
``LONG`` characters by a digest in place of themselves; other columns are ignored
or, in ``drop_toxic``, kept.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Isotonic, Trees, fit_isotonic, fit_trees
from .common import Scratch, fresh, table, tidy

#: Labelled rows that the model is fitted on at most, entries of the lexicon at most, and characters of a word that stands for itself.
SAMPLE, LEXICON, LONG = 20_000, 4_000, 64
PREFIXES = (3, 4, 5, 6, 7)
#: Fixed list of second-person words.
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer ti tú tus vosotros usted ustedes".split())
#: Fixed substitutions that hide letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
EDGE = re.compile(r"[\W\d_]+")
INSIDE = re.compile(r"[^\W\d_][\d$@!*_.\-]+[^\W\d_]")
MARKS = re.compile(r"[\W_]+")
FEATURES = (
    "log_words", "letters_per_word", "strong", "strong_density", "log_odds", "odds_density", "odds_window", "top_odds", "second_odds", "kinds",
    "prefix_hits", "prefix_density", "near_second_person", "second_person_density", "capitals", "shouted", "exclaimed", "symbols", "obfuscated", "hidden_hits",
)
WINDOW = 40


def digest(word: str) -> str:
    """A short stand-in for a long word; no word has its first character."""
    return "\0" + hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=16).hexdigest()


def entries(word: str) -> list[str]:
    """What the lexicon may know a word by: itself, and its beginnings with a mark."""
    return [word if len(word) <= LONG else digest(word), *(word[:n] + "~" for n in PREFIXES if len(word) > n)]


def plain(token: str) -> str:
    """In lower case, without what are no letters at both ends."""
    for _ in "ab":
        if m := EDGE.match(token):
            token = token[m.end() :]
        token = token[::-1]
    return token.lower()


def unhidden(token: str) -> str:
    """The word that a token may hide behind look-alike characters or marks between letters; empty if it is plain."""
    return MARKS.sub("", token.lower().translate(LEET)) if INSIDE.search(token) else ""


class TokenTable:
    """Numbers per distinct token, looked up again and again: odds, strong, prefix hit, second person, obfuscated, hidden hit, kind."""

    WIDTH = 7
    CACHED = 150_000

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.number = {e: k + 1 for k, e in enumerate(lexicon)}
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, self.WIDTH), np.float32)

    def lookup(self, word: str) -> tuple[float, int, bool]:
        best, kind, by_prefix = 0.0, 0, False
        for k, e in enumerate(entries(word)) if word else ():
            if (v := self.lexicon.get(e, 0.0)) > best:
                best, kind, by_prefix = v, self.number[e], k > 0
        return best, kind, by_prefix

    def add(self, token: str, key: str) -> None:
        word = plain(token)
        odds, kind, by_prefix = self.lookup(word)
        hidden = unhidden(token)
        hidden_hit = 0.0
        if hidden and hidden != word:
            other = self.lookup(hidden)
            if other[0] > odds:
                odds, kind, by_prefix = other
                hidden_hit = 1.0
        k = len(self.place)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[k] = odds, odds > 0 and not by_prefix, by_prefix, word in SECOND_PERSON, bool(hidden), hidden_hit, kind
        self.place[key] = k

    def __call__(self, tokens: list[str]) -> np.ndarray:
        if len(self.place) > self.CACHED:
            self.clear()
        place = self.place
        if max(map(len, tokens)) > LONG:
            keys = [t if len(t) <= LONG else digest(t) for t in tokens]
            for t, key in zip(tokens, keys, strict=True):
                if key not in place:
                    self.add(t, key)
            tokens = keys
        for t in tokens:
            if t not in place:
                self.add(t, t)
        return self.rows[np.fromiter(map(place.__getitem__, tokens), np.int64, len(tokens))]


def features(text: str | None, look: TokenTable) -> np.ndarray:
    out = np.zeros(len(FEATURES), np.float64)
    tokens = (text or "").split()
    n = len(tokens)
    if not n:
        return out
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    upper = int(((data >= 65) & (data <= 90)).sum())
    letters = upper + int(((data >= 97) & (data <= 122)).sum()) + int((data >= 0xC3).sum())
    t = look(tokens)
    odds = t[:, 0].astype(np.float64)
    hit = np.flatnonzero(odds > 0)
    out[0], out[1] = np.log1p(n), letters / n
    out[2], out[3] = t[:, 1].sum(), t[:, 1].sum() / n
    out[4], out[5] = np.log1p(odds.sum()), odds.sum() / n
    if len(hit):
        total = np.r_[0, np.cumsum(odds)]
        out[6] = (total[np.minimum(hit + WINDOW, n)] - total[hit]).max()
        kinds, at = np.unique(t[hit, 6], return_index=True)
        each = np.sort(odds[hit][at])[::-1]
        out[7], out[8], out[9] = each[0], each[1] if len(each) > 1 else 0, len(kinds)
        second = np.flatnonzero(t[:, 3])
        if len(second):
            k = np.searchsorted(second, hit)
            gap = np.minimum(np.abs(second[np.minimum(k, len(second) - 1)] - hit), np.abs(hit - second[np.maximum(k - 1, 0)]))
            out[12] = np.exp(-gap / 5).sum()
    out[10], out[11] = t[:, 2].sum(), t[:, 2].sum() / n
    out[13] = t[:, 3].sum() / n
    out[14] = upper / max(1, letters)
    out[15] = min(1.0, max(0.0, upper / max(1, letters) - 0.5) * 2)
    out[16] = int((data == 33).sum()) / n
    out[17] = int(((data >= 33) & (data < 48) | (data > 57) & (data < 64) | (data > 90) & (data < 97) | (data > 122) & (data < 127)).sum()) / max(1, len(data))
    out[18], out[19] = t[:, 4].sum() / n, t[:, 5].sum()
    return out


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees
    scale: Isotonic

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(self.scale(self.trees.raw(rows)), 0, 1)


def _features(docs: DataFrame, lexicon: dict[str, float], keep: list[str]) -> DataFrame:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = TokenTable(lexicon)
        for batch in batches:
            rows = [features(x.as_py(), look) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], [*keep, "x"])

    return docs.select(*keep, "text").mapInArrow(tidy(run), f"{kinds}, x array<double>")


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> Model:
    """``docs`` (doc_id, text), ``labels`` (doc_id, toxic): only labels whose remainder is not 0 are read."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(fold(F.col("doc_id")) != 0).select("doc_id", F.col("toxic").cast("int"))
    drawn = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("draw", F.xxhash64("doc_id", F.lit(6))).orderBy("draw").limit(sample)
    sampled = docs.join(drawn, "doc_id").groupBy("doc_id", "toxic", F.pmod("draw", F.lit(2)).cast("int").alias("half")).agg(F.max("text").alias("text"))
    rows = scratch.put(sampled)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = {plain(t) for t in (text.as_py() or "").split()}
                seen[toxic].update({e for w in words if w for e in entries(w)})
                seen[toxic].update([""])
        for toxic, counter in enumerate(seen):
            for part in np.array_split(np.array(list(counter), object), 1 + len(counter) // 20_000):
                yield pa.RecordBatch.from_pydict({"entry": pa.array(part.tolist(), pa.string()), "toxic": pa.array([toxic] * len(part), pa.int32()), "n": pa.array([counter[e] for e in part], pa.int64())})

    counted = rows.where("half = 0").select("text", "toxic").mapInArrow(tidy(count), "entry string, toxic int, n long")
    per = counted.groupBy("entry").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    per = scratch.put(per.where("a >= 3 or entry = ''"))
    total = per.where("entry = ''").first()
    # The lower bound of the log odds ratio, from all entries; a beginning that tells no more than a longer one has no higher bound.
    rest = [F.lit(total[c] if total else 0) for c in "ab"]
    odds = [F.log((F.col(c) + 0.5) / (n - F.col(c) + 0.5)) for c, n in zip("ab", rest, strict=True)]
    low = odds[0] - odds[1] - 1.64 * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = per.where("entry <> ''").select("entry", low.alias("low")).where("low > 1").orderBy(F.desc("low"), F.desc(F.length("entry")), "entry").limit(LEXICON)
    lexicon = {r["entry"]: r["low"] for r in best.collect()}
    got = _features(rows.where("half = 1").select("doc_id", "toxic", "text"), lexicon, ["doc_id", "toxic"]).orderBy(F.xxhash64("doc_id")).collect()
    x, y = np.array([r["x"] for r in got]).reshape(-1, len(FEATURES)), np.array([r["toxic"] for r in got], np.float64)
    raw, part = np.zeros(len(y)), np.arange(len(y)) % 4
    for k in range(4):
        raw[part == k] = fit_trees(x[part != k], y[part != k]).raw(x[part == k])
    return Model(lexicon, fit_trees(x, y), fit_isotonic(raw, y))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", name: str = "score", below: float | None = None) -> DataFrame:
    """The columns ``keep``, then the score as ``name``; one row per document, without a shuffle.

    With ``below`` only the rows of lesser scores, without the score.
    """
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ([f"`{name}` double"] if below is None else [])
    sent = [F.col(f"`{c}`") for c in keep]
    at = keep.index(text) if text in keep else len(keep)
    if at == len(keep):
        sent.append(F.col(text).cast("string").alias(fresh("text", keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = TokenTable(model.lexicon)
        for big in batches:
            for batch in (big.slice(k, 500) for k in range(0, big.num_rows, 500)):
                found = model.scores(np.array([features(v.as_py(), look) for v in batch.column(at)]).reshape(-1, len(FEATURES)))
                columns = batch.columns[: len(keep)]
                if below is None:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(found)], [*keep, name])
                else:
                    yield pa.RecordBatch.from_arrays(columns, keep).filter(pa.array(found < below))

    return docs.select(*sent).mapInArrow(tidy(run), ", ".join(kinds))


def drop_toxic(docs: DataFrame, labels: DataFrame, scratch: Scratch, least: float = 0.5) -> DataFrame:
    """The rows whose score is below ``least``, with their columns."""
    model = fit(docs.select("doc_id", "text"), labels, scratch)
    return score(docs, model, docs.columns, below=least)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with Scratch(spark, "toxic") as scratch:
        model = fit(docs, table(spark, sf_dir, "labels"), scratch)
    found = score(docs, model, ["doc_id"])
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
