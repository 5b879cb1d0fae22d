"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Texts are folded first: compatibility forms, look-alike letters and digits that
stand for letters become plain letters. The lexicon (whole words and word
beginnings with their weights, and phrases in which they are harmless) is learned
from labelled texts; a score is the logistic of the matched weight, plain and
normalised by length.

Learning uses a sample of at most about ``FIT_ROWS`` labelled rows, taken by a hash
of their ids, and one text of each group of near copies in it, so that a
text that was copied often does not make its own words look toxic.
"""

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexmill.llm.shared import kept, slices, whole_text

#: Labelled rows used to fit, at most (about; a hash threshold picks them).
FIT_ROWS = 20_000
#: Terms of a lexicon and phrases of exceptions, at most; the strongest are kept.
MAX_TERMS, MAX_EXCEPTIONS = 2_000, 2_000
#: Lengths of word beginnings that may become terms.
STEMS = (4, 5, 6)
#: Texts that a term must occur in, and the least lower bound of its log odds.
MIN_TEXTS, MIN_LOG_ODDS = 8, 1.5
#: A word beginning is dropped if one longer term has this share of its texts.
OWED = 0.6
#: Accented words that a worker remembers without their accents, and the longest of them.
MEMO_WORDS, MEMO_CHARS = 50_000, 40

# Letters of other scripts that look like Latin ones, and what they look like.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q",
    "ԝ": "w", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ь": "b", "г": "r", "п": "n", "α": "a", "ο": "o",
    "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ε": "e", "η": "n", "ω": "w", "γ": "y", "σ": "o",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ⅼ": "l", "ℓ": "l",
}
# Digits and signs that stand for letters. 1, ! and | stand for i as well as l, so l is folded to i.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}

_INVISIBLE = "­​‌‍⁠﻿"
_FOLD = str.maketrans({**LOOK_ALIKES, **dict.fromkeys(_INVISIBLE)})
_FOLDED = re.compile(f"[{''.join(LOOK_ALIKES)}{_INVISIBLE}]")
_PLAIN = str.maketrans(SUBSTITUTES)
_SIGNS = re.compile(r"[@$!|](?=[^\W\d_])")
_TOKEN = re.compile(r"[^\W_]+")
_NUMBER = re.compile(r"^\d+$")


def fold(text: str) -> list[str]:
    """The folded words of a text. Numbers stay numbers; signs count as letters only before one."""
    low = text if text.isascii() else unicodedata.normalize("NFKC", text)
    low = low.lower()
    if not low.isascii() and _FOLDED.search(low):
        low = low.translate(_FOLD)
    low = _SIGNS.sub(lambda m: SUBSTITUTES[m[0]], low)
    # Inside words no signs are left, so that words of letters alone differ by their l only.
    tokens = _TOKEN.findall(low.replace("l", SUBSTITUTES["l"]))
    return [t if t.isalpha() or _NUMBER.match(t) else t.translate(_PLAIN) for t in tokens]


@lru_cache(maxsize=MEMO_WORDS)
def _bare(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def _unaccented(word: str) -> str:
    if word.isascii():
        return word
    return _bare(word) if len(word) <= MEMO_CHARS else _bare.__wrapped__(word)


def terms_of(words: list[str]) -> set[str]:
    """What a text offers as terms: its words (``=word``) and their beginnings.

    Words under three and over forty characters are no terms: the short ones occur
    everywhere, the long ones once.
    """
    out = set()
    for word in set(words):
        if 3 <= len(word) <= 40:
            out.add("=" + word)
            out.update(word[:n] for n in STEMS if len(word) > n)
    return out


@dataclass
class Lexicon:
    """Weighted terms, harmless phrases, and the coefficients of the score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    bias: float = -3.0
    slopes: tuple[float, float] = (1.0, 1.0)

    def matcher(self):
        return Matcher(self)


class Matcher:
    """Finds terms and exceptions in folded words with one automaton."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon, self.automaton = lexicon, ahocorasick.Automaton()
        patterns: dict[str, list[tuple[int, float | None, bool]]] = {}
        for term, weight in lexicon.weights.items():
            pattern = f" {term[1:]} " if term[0] == "=" else f" {term}"
            patterns.setdefault(pattern, []).append((len(pattern) - 1, weight, term[0] != "="))
        for phrase in lexicon.exceptions:
            patterns.setdefault(f" {phrase} ", []).append((len(phrase) + 1, None, False))
        for pattern, found in patterns.items():
            self.automaton.add_word(pattern, found)
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def hits(self, words: list[str]) -> dict[int, float]:
        """Place in the joined line of each matched word, and its largest weight."""
        if self.empty or not words:
            return {}
        line = " " + " ".join(words) + " "
        found = self._scan(line)
        if not line.isascii():
            plain = [_unaccented(w) for w in words]
            if plain != words:
                starts = np.cumsum([0, *[len(w) + 1 for w in words]]).tolist()
                back = dict(zip(np.cumsum([0, *[len(w) + 1 for w in plain]]).tolist(), starts, strict=True))
                for at, weight in self._scan(" " + " ".join(plain) + " ").items():
                    found[back[at]] = max(weight, found.get(back[at], weight))
        return found

    def _scan(self, line: str) -> dict[int, float]:
        found: dict[int, float] = {}
        harmless: list[tuple[int, int]] = []
        for end, values in self.automaton.iter(line):
            for back, weight, goes_on in values:
                if goes_on and line[end + 1] == " ":
                    continue
                if weight is None:
                    harmless.append((end - back, end))
                else:
                    at = end - back
                    found[at] = max(weight, found.get(at, weight))
        for a, b in harmless:
            for at in [x for x in found if a <= x < b]:
                del found[at]
        return found

    def features(self, text: str) -> tuple[float, float]:
        words = fold(text)
        total = sum(self.hits(words).values())
        return math.log1p(total), total / math.log2(len(words) + 2)

    def score(self, text: str) -> float:
        lexicon = self.lexicon
        a, b = self.features(text)
        z = lexicon.bias + lexicon.slopes[0] * a + lexicon.slopes[1] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _family(words: list[str]) -> int:
    """The smallest hash of the five-word runs: equal, as a rule, for near copies."""
    import xxhash

    if len(words) < 5:
        return xxhash.xxh64_intdigest(" ".join(words)) >> 1
    return min(xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(len(words) - 4)) >> 1


def _sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """text and label of labelled rows, at most about ``fit_rows`` of them, one per group of near copies and label."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    share = F.lit(2**31) * F.least(F.lit(1.0), F.lit(float(fit_rows)) / F.lit(max(1, known.count())))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < share)

    def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [_family(fold(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), batch.column("toxic"), pa.array(found, pa.int64())],
                ["doc_id", "text", "toxic", "family"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).join(
        F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))),
        "doc_id",
    )  # the sample's size is bounded
    named = rows.mapInArrow(families, "doc_id long, text string, toxic int, family long")
    return kept(named.dropDuplicates(["family", "toxic"]).select("text", "toxic"), "toxic-sample")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _log_odds(pos: Column, neg: Column, n_pos: int, n_neg: int) -> Column:
    return F.log((pos + 0.5) / (n_pos + 1.0)) - F.log((neg + 0.5) / (n_neg + 1.0))


def _counted(sample: DataFrame, offers) -> DataFrame:
    """term, pos, neg: texts of either label that offer a term; ``offers`` maps a text to a set."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg = Counter(), Counter()

        def out() -> pa.RecordBatch:
            names = sorted(pos.keys() | neg.keys())
            columns = [pa.array(names, pa.string()), pa.array([pos[t] for t in names], pa.int64()), pa.array([neg[t] for t in names], pa.int64())]
            pos.clear()
            neg.clear()
            return pa.RecordBatch.from_arrays(columns, ["term", "pos", "neg"])

        for batch in slices(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                (pos if toxic else neg).update(offers(text))
                if len(pos) + len(neg) > 200_000:
                    yield out()
        yield out()

    counted = sample.mapInArrow(compute, "term string, pos long, neg long")
    return counted.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Lexicon:
    """Learn a lexicon from the labelled rows that are not held out.

    Without labelled texts of both kinds the lexicon is empty and every score is
    the share of toxic labels (0 without any label).
    """
    sample = _sample(docs, labels, fit_rows)
    n_pos, n_neg = (int(x or 0) for x in sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    if not n_pos or not n_neg:
        share = min(max(n_pos / max(1, n_pos + n_neg), 1e-12), 1 - 1e-12)
        return Lexicon(bias=math.log(share / (1 - share)), slopes=(0.0, 0.0))
    odds = _log_odds(F.col("pos"), F.col("neg"), n_pos, n_neg)
    error = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    least = max(3, min(MIN_TEXTS, n_pos // 20))
    terms = (
        _counted(sample, lambda text: terms_of(fold(text)))
        .where(F.col("pos") >= least)
        .select("term", "pos", "neg", odds.alias("weight"), (odds - 1.96 * error).alias("sure"))
        .where(F.col("sure") > MIN_LOG_ODDS)
        .orderBy(F.desc("sure"), "term")
        .limit(MAX_TERMS)
    )
    found = terms.collect()  # at most MAX_TERMS
    texts = {r["term"]: r["pos"] for r in found}
    weights = {r["term"]: r["weight"] for r in found if not _speaks_for_another(r["term"], texts)}
    bare = Matcher(Lexicon(weights))
    phrases = _counted(sample, lambda text: _phrases(bare, text))
    harmless = (
        phrases.where((F.col("neg") >= 3) & (odds < 0)).orderBy(F.desc("neg"), "term").limit(MAX_EXCEPTIONS).select("term")
    )
    lexicon = Lexicon(weights, frozenset(r[0] for r in harmless.collect()))  # at most MAX_EXCEPTIONS
    lexicon.bias, *slopes = _logistic(sample, lexicon)
    lexicon.slopes = tuple(slopes)
    return lexicon


def _speaks_for_another(term: str, texts: dict[str, int]) -> bool:
    """Whether a word beginning owes most of its texts to one longer term, which then stands alone."""
    if term[0] == "=":
        return False
    longer = [n for t, n in texts.items() if t != term and t.lstrip("=").startswith(term) and len(t.lstrip("=")) > len(term)]
    return max(longer, default=0) >= OWED * texts[term]


def _phrases(matcher: Matcher, text: str) -> set[str]:
    """Pairs of words around each match."""
    words = fold(text)
    hits = matcher.hits(words)
    if not hits:
        return set()
    places = dict(zip(np.cumsum([0, *[len(w) + 1 for w in words]]).tolist(), range(len(words)), strict=False))
    out = set()
    for at in hits:
        i = places[at]
        out.update(" ".join(words[j : j + 2]) for j in (i - 1, i) if 0 <= j < len(words) - 1)
    return out


def _logistic(sample: DataFrame, lexicon: Lexicon) -> list[float]:
    """Bias and slopes of the score, by Newton steps with a small ridge, on the bounded sample's two features."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in slices(batches):
            found = [matcher.features(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("toxic")], ["a", "b", "toxic"])

    rows = sample.mapInArrow(compute, "a double, b double, toxic int").groupBy("a", "b", "toxic").count().collect()
    x = np.array([[1.0, r["a"], r["b"]] for r in rows])
    y, n = np.array([float(r["toxic"]) for r in rows]), np.array([float(r["count"]) for r in rows])
    w = np.zeros(3)
    ridge = np.diag([1e-3, 1e-2, 1e-2]) * max(1.0, n.sum() / 100)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (y - p)) - ridge @ w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, gradient)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Columns ``row`` (the input row), score and predicted. A null text scores as an empty one."""

    @F.arrow_udf("double")
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = lexicon.matcher()
        for part in parts:
            found: list[float] = []
            for texts in slices(iter([pa.record_batch([part], ["text"])])):
                found += [matcher.score(t) for t in texts.column(0).to_pylist()]
            yield pa.array(found, pa.float64())

    rows = docs.select(F.struct("*").alias("row"), scored(whole_text(text)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Whole texts are scored, empty ones too. Rows without an id are scored and not
    held out. Repeated rows come out repeated; a document with several labels
    counts as toxic if one is. An empty table gives an empty result.
    """
    lexicon = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), fit_rows)
    return score(docs.select("doc_id", "text"), lexicon).select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted"
    )


def without_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that are not predicted toxic, with the input's columns.

    Null and empty texts score as the lexicon's bias says and stay, unless toxic
    texts prevail in the labels. Null and repeated ids are documents like any other,
    and equal texts go or stay together. An empty table gives an empty result;
    without labels nothing goes.
    """
    lexicon = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), fit_rows)
    return score(docs, lexicon).where("predicted = 0").select("row.*")
