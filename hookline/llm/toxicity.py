"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Text is folded first (case, look-alike letters, digit and sign substitutions
inside words, invisible characters, single letters spaced out), so that one
lexicon entry meets its disguises. Lexicon entries are words and word
beginnings with a log-odds weight; exception phrases are pairs of words around
a hit that occur in harmless text, and a hit inside one does not count. The
score is a logistic function of the hits' weight, as a sum and per square root
of the text's length.

The lexicon, the exceptions and the four numbers of the logistic function are
fitted on at most ``FIT_ROWS`` labelled documents (a stated bound: rows are
taken in the order of a hash of their id). Scoring covers every whole text in
one narrow Arrow pass with a bounded lexicon; nothing is shuffled.

Edge cases: null and empty texts have no hits and get the score of the
intercept; labels that are null are not used; with no labelled row, or with
labels of one kind only, the lexicon is empty and scores are the smoothed
share of toxic rows; repeated rows get equal scores.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT_ROWS = 20_000
LEXICON_SIZE = 20_000
MIN_DOCS = 3
MIN_WEIGHT = 2.0
PREFIX_LENGTHS = (4, 5, 6, 7, 8)
CUT = 0.7

# Letters of other scripts that look like Latin ones, and signs
# and digits that stand for letters inside a word.
LOOK_ALIKE = str.maketrans("авекмнорстухіјѕһԁԛԝοανρτικ", "abekmhopctyxijshdqwoavptik")
STAND_INS = str.maketrans("0134578@$!|+", "oieastbasiit")
INVISIBLE = dict.fromkeys((0x00AD, 0x180E, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
WIDE = {c + 0xFEE0: chr(c) for c in range(0x21, 0x7F)}

FOREIGN = re.compile("[^\x00-\xffŒœŸ‘’“”–—]")
WORD = re.compile(r"[^\W_]+(?:[@$!|+'’*.\-_]+[^\W_]+)*|[@$]+[^\W_]+")
SPACED = re.compile(r"(?<!\w)(?:\w[ .\-_*]){3,}\w(?!\w)")
INNER = re.compile(r"['’*.\-_]+")
REPEAT = re.compile(r"(.)\1{2,}")
LETTER = re.compile(r"[^\W\d_]")


def fold_word(word: str) -> str:
    """One word without its disguise: 'l0$er' -> 'loser', 'm.o.r.o.n' -> 'moron'."""
    if word.isalpha():
        return REPEAT.sub(r"\1", word)
    if not LETTER.search(word):
        return word
    return REPEAT.sub(r"\1", INNER.sub("", word.translate(STAND_INS)))


def folded_words(text: str) -> list[str]:
    """The folded words of a whole text, in order."""
    text = text.lower()
    if FOREIGN.search(text):
        text = text.translate(INVISIBLE).translate(WIDE).translate(LOOK_ALIKE)
    text = SPACED.sub(lambda m: re.sub(r"\W|_", "", m[0]), text)
    return [fold_word(w) for w in WORD.findall(text)]


def features(words: list[str]) -> set[str]:
    """Words (with an end mark) and word beginnings."""
    out = set()
    for w in set(words):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in PREFIX_LENGTHS if len(w) > k)
    return out


@dataclass(frozen=True)
class Lexicon:
    """Weighted entries, exception phrases, and the score's four numbers."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    logistic: tuple[float, float, float, float] = (-4.0, 0.0, 0.0, 0.0)

    def key(self) -> tuple:
        return tuple(sorted(self.weights.items())), self.exceptions


@lru_cache(maxsize=4)
def automaton(entries: tuple, exceptions: tuple):
    import ahocorasick

    found = ahocorasick.Automaton()
    for text, weight in entries:
        found.add_word(text, (len(text), weight))
    for text in exceptions:
        found.add_word(text, (len(text), None))
    if len(found):
        found.make_automaton()
    return found


def hits(words: list[str], lexicon_key: tuple) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the words hit in " w1 w2 ... ", the weightiest entry of a word, less those in exceptions."""
    machine = automaton(*lexicon_key)
    if not len(machine):
        return []
    line = f" {' '.join(words)} "
    best: dict[int, tuple[int, float]] = {}
    spared = []
    for end, (size, weight) in machine.iter(line):
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        elif start not in best or weight > best[start][1]:
            best[start] = (end, weight)
    return [(a, b, w) for a, (b, w) in best.items() if not any(x <= a and b <= y for x, y in spared)]


def strength(words: list[str], lexicon_key: tuple) -> tuple[float, float, float]:
    """(log of the hits' weight, weight per root of the length, largest weight)."""
    w = [x[2] for x in hits(words, lexicon_key)]
    total = sum(w)
    return float(np.log1p(total)), total / float(np.sqrt(len(words) + 1)), max(w, default=0.0)


def held_out(doc_id: Column) -> Column:
    """Rows kept from fitting: crc32 of the id as text leaves 1 over 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out part."""
    known = (labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("toxic"))
             .where(F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
             .groupBy("id").agg(F.max("toxic").alias("toxic")))
    # bounded by FIT_ROWS ids, so it may be broadcast
    taken = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    # one row an id, its smallest text, so that a repeated id weighs no more than others
    found = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body")).join(F.broadcast(taken), "id")
    return found.groupBy("id", "toxic").agg(F.min("body").alias("body")).select(F.coalesce("body", F.lit("")).alias("body"), "toxic")


def feature_counts(sample: DataFrame) -> DataFrame:
    """(entry, n_toxic, n_other) over the sample; each partition counts first."""

    def count(batches):
        toxic, other = Counter(), Counter()
        for part in batches:
            for body, label in zip(part["body"], part["toxic"], strict=True):
                (toxic if label else other).update(features(folded_words(body)))
        names = [*toxic, *(k for k in other if k not in toxic)]
        for at in range(0, len(names), 50_000):
            some = names[at:at + 50_000]
            yield pd.DataFrame({"entry": some, "t": [toxic[k] for k in some], "o": [other[k] for k in some]})

    counted = sample.mapInPandas(count, "entry string, t long, o long")
    return counted.groupBy("entry").agg(F.sum("t").alias("n_toxic"), F.sum("o").alias("n_other"))


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton's method with a small ridge on all but the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    hold = np.eye(len(b)) * ridge
    hold[0, 0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + hold, x.T @ (y - p) - hold @ b)
        b += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit_lexicon(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
                rows: int = FIT_ROWS, size: int = LEXICON_SIZE, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learn entries, exception phrases and the score from labelled documents.

    ``exceptions`` adds phrases of one's own (plain text, folded here).
    """
    sample = labelled_sample(docs, labels, doc_id, text, label, rows)
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_t, n_o = totals.get(1, 0), totals.get(0, 0)
    own = tuple(sorted({f" {' '.join(folded_words(x))} " for x in exceptions}))
    if not n_t or not n_o:
        share = (n_t + 0.5) / (n_t + n_o + 10)
        return Lexicon({}, own, (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0))
    weight = F.log((F.col("n_toxic") + 0.5) / (n_t + 1.0)) - F.log((F.col("n_other") + 0.5) / (n_o + 1.0))
    kept = (feature_counts(sample).where(F.col("n_toxic") >= MIN_DOCS).withColumn("weight", weight)
            .where(F.col("weight") >= MIN_WEIGHT)
            .orderBy(F.desc("n_toxic"), "entry").limit(size).select("entry", "weight").collect())  # at most ``size``
    weights = {r["entry"]: round(float(r["weight"]), 6) for r in kept}
    first = Lexicon(weights, own)
    measured = sample_strengths(sample, first.key())
    spared = sorted({*own, *phrases(measured["near"], measured["toxic"])})
    second = Lexicon(weights, tuple(spared))
    if len(spared) > len(own):
        measured = sample_strengths(sample, second.key())
    x = np.array(measured[["total", "dense", "top"]], dtype=float)
    b = logistic_fit(x, np.array(measured["toxic"], dtype=float))
    return Lexicon(weights, tuple(spared), tuple(float(v) for v in b))


def sample_strengths(sample: DataFrame, lexicon_key: tuple) -> pd.DataFrame:
    """Hit strengths and the word pairs around hits, one row per sampled document (at most FIT_ROWS)."""

    def measure(batches):
        for part in batches:
            rows = []
            for body, label in zip(part["body"], part["toxic"], strict=True):
                words = folded_words(body)
                line = f" {' '.join(words)} "
                near = set()
                for a, b, _ in hits(words, lexicon_key):
                    end = line.find(" ", a + 1)
                    before = line.rfind(" ", 0, a)
                    after = line.find(" ", end + 1)
                    if before >= 0:
                        near.add(line[before:end + 1])
                    if after >= 0:
                        near.add(line[a:after + 1])
                rows.append((*strength(words, lexicon_key), int(label), sorted(near)[:50]))
            yield pd.DataFrame(rows, columns=["total", "dense", "top", "toxic", "near"])

    return sample.mapInPandas(measure, "total double, dense double, top double, toxic int, near array<string>").toPandas()


def phrases(near: pd.Series, toxic: pd.Series, least: int = 5, share: float = 0.9) -> list[str]:
    """Word pairs around hits that nearly only harmless documents hold."""
    good, bad = Counter(), Counter()
    for pairs, label in zip(near, toxic, strict=True):
        (bad if label else good).update(pairs)
    return [p for p, n in good.items() if n >= least and n >= share * (n + bad[p])]


def score_column(lexicon: Lexicon, text: Column) -> Column:
    """Score from 0 to 1 of a text column."""
    key, b = lexicon.key(), lexicon.logistic

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            x = strength(folded_words(t), key)
            z = b[0] + b[1] * x[0] + b[2] * x[1] + b[3] * x[2]
            out.append(1 / (1 + float(np.exp(-min(max(z, -30.0), 30.0)))))
        return pd.Series(out, dtype="float64")

    return score(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), score_column(lexicon, F.col(text)).alias("score"))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                       (F.col("score") >= cut).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs``, as they are, whose score is under ``cut``."""
    return docs.where(score_column(lexicon, F.col(text)) < cut)
