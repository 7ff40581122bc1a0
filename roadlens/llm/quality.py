"""Quality classification from weak labels.

Overlapping heuristics vote on each document: good, bad, or no opinion. Expectation-maximisation over the
counts of all vote patterns estimates how often each of them is right, without any given label. The posterior
of a document's pattern then labels a bounded sample, on which a linear scorer over hashed words is trained.
One of the heuristics knows word beginnings that mark texts labelled toxic, where there are such labels.
"""

from __future__ import annotations

import operator
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from roadlens.llm.common import BROADCAST_ROWS, by_position, ship, with_text_columns, write_out

WORD = re.compile(r"\w+")
MARKS = re.compile(r"[^\w\s]")
PLAIN_MARKS = frozenset(".,;:!?'\"()-")
#: Sampled documents that the scorer is trained on, of distinct texts, the first by their hash, and features that
#: they have at most together.
SAMPLE_DOCS = 10_000
SAMPLE_FEATURES = 4_000_000
#: Letters of a word's beginning (shorter words are taken whole), shares of a text's words (0: it occurs), and what a
#: beginning needs to mark toxic texts: labelled texts that reach the share, and how many of them are toxic.
PREFIX = 5
PREFIX_RATES = (0.0, 0.003, 0.006, 0.01, 0.015, 0.02, 0.03)
PREFIX_SUPPORT = 8
PREFIX_PRECISION = 0.9
BUCKETS = 1 << 16
EPOCHS = 4
EM_ROUNDS = 60
#: Chances of the votes bad, none and good, given a good and a bad document, before anything is seen, and the
#: prior's weight as a share of the documents.
PRIOR = ((0.002, 0.598, 0.4), (0.2, 0.75, 0.05))
PRIOR_WEIGHT = 0.1
#: Documents with a lower probability to be good are not kept.
THRESHOLD = 0.5

GOOD, NONE, BAD = 1, 0, -1

# Heuristics: each looks at the whole text's statistics and votes.

NAMES = ("prefixes", "marks", "capitals", "repeated_words", "repeated_lines", "short_lines", "word_length", "sentences")


class Analysis:
    """A text's words and marks with their counts, and the votes of the heuristics of NAMES on it."""

    def __init__(self, text: str, rules: dict[str, float] | None = None) -> None:
        words, lower = WORD.findall(text), WORD.findall(text.lower())
        marks = MARKS.findall(text)
        lines = [x for x in text.split("\n") if x.strip()]
        self.words, self.marks = Counter(lower), Counter(marks)
        count, n = len(words), max(1, len(words))
        odd = sum(c for m, c in self.marks.items() if m not in PLAIN_MARKS) / n
        capitals = sum(map(str.isupper, words)) / n
        doubled = sum(map(operator.eq, lower, lower[1:])) / n
        repeated = 1 - len(set(lines)) / max(1, len(lines))
        bars = self.marks["|"] / n
        length = sum(map(len, words)) / n
        stops = sum(self.marks[m] for m in ".?!") / n
        marked = bool(rules) and any(c / n >= rules[p] for p, c in prefix_counts(self.words, rules).items())
        plain = 3.5 <= length <= 9 and 0.03 <= stops <= 0.3 and odd < 0.05 and capitals < 0.1 and doubled < 0.05 and bars < 0.05 and not marked
        self.votes = [
            BAD if marked else NONE,
            BAD if odd > 0.2 else NONE,
            BAD if capitals > 0.3 else NONE,
            BAD if doubled > 0.2 else NONE,
            BAD if repeated > 0.3 and len(lines) >= 4 else NONE,
            BAD if bars > 0.2 else NONE,
            BAD if count >= 5 and not 2.5 <= length <= 12 else NONE,
            BAD if count >= 40 and stops < 0.01 else GOOD if plain else NONE,
        ]


def prefix_counts(words: Counter, wanted: dict[str, float] | None = None) -> Counter:
    """How many words begin with each prefix (of those wanted)."""
    found: Counter = Counter()
    for w, c in words.items():
        p = w[:PREFIX]
        if wanted is None or p in wanted:
            found[p] += c
    return found


REACHED = T.StructType([T.StructField("reached", T.ArrayType(T.StructType([T.StructField("prefix", T.StringType()), T.StructField("level", T.IntegerType())])))])


def _reached() -> Callable[[list], list[list]]:
    """Of each text the word beginnings with the greatest of PREFIX_RATES that they reach."""

    def of(text: str) -> list[dict]:
        words = Counter(WORD.findall(text.lower()))
        n = max(1, sum(words.values()))
        return [{"prefix": p, "level": bisect_right(PREFIX_RATES, c / n) - 1} for p, c in prefix_counts(words).items()]

    return lambda texts: [[of(t or "") for t in texts]]


def learn_prefixes(labelled: DataFrame) -> dict[str, float]:
    """Word beginnings that mark toxic texts of ``labelled`` (text, toxic: int), with the least share of a text's words
    from which they do.

    A beginning and share is taken if at least PREFIX_SUPPORT texts reach it, and at least PREFIX_PRECISION of
    them are toxic; of several shares of a beginning the least. All labelled texts are counted, where they are; the
    driver gets the beginnings that are taken.
    """
    rows = with_text_columns(labelled.select("text", "toxic"), "text", REACHED, _reached).select("toxic", F.explode("reached").alias("r"))
    counts = rows.groupBy("r.prefix", "r.level").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))
    # Who reaches a share reaches the smaller ones: a row for each of PREFIX_RATES a beginning at most.
    above = W.partitionBy("prefix").orderBy(F.desc("level"))
    # The same texts reach all shares down to the next one that a text has as its greatest.
    down = F.coalesce(F.lead("level").over(above) + 1, F.lit(0))
    summed = counts.select("prefix", down.alias("level"), F.sum("n").over(above).alias("n"), F.sum("bad").over(above).alias("bad"))
    taken = summed.filter((F.col("bad") >= PREFIX_SUPPORT) & (F.col("bad") >= PREFIX_PRECISION * F.col("n")))
    return {r["prefix"]: PREFIX_RATES[r["level"]] for r in taken.groupBy("prefix").agg(F.min("level").alias("level")).collect()}


def votes(text: str, rules: dict[str, float] | None = None) -> list[int]:
    return Analysis(text, rules).votes


def pattern_of(found: list[int]) -> int:
    """The votes as one number, base three."""
    code = 0
    for v in found:
        code = code * 3 + v + 1
    return code


def votes_of(code: int) -> list[int]:
    out = []
    for _ in NAMES:
        code, v = divmod(code, 3)
        out.append(v - 1)
    return out[::-1]


class LabelModel:
    """Share of good documents, and of each heuristic the chance of each vote given good or bad.

    A weak prior says what a heuristic is written for: it seldom votes against the truth. Without it, the
    likeliest two classes of a corpus may be short and long documents rather than good and bad ones.
    """

    def __init__(self, counts: dict[int, int], rounds: int = EM_ROUNDS) -> None:
        codes = sorted(counts)
        n = np.array([counts[c] for c in codes], float)
        seen = np.array([votes_of(c) for c in codes], np.int64).reshape(len(codes), len(NAMES)) + 1
        one_hot = np.eye(3)[seen] if len(codes) else np.zeros((0, len(NAMES), 3))
        prior = PRIOR_WEIGHT * max(1.0, n.sum()) * np.array(PRIOR)[:, None, :]
        self.share, self.chance = np.array([0.8, 0.2]), np.repeat(np.array(PRIOR)[:, None, :], len(NAMES), 1)
        good = self._posterior(seen)
        for _ in range(rounds):
            weight = np.stack([n * good, n * (1 - good)])
            self.share = (weight.sum(1) + 1) / (n.sum() + 2)
            self.chance = np.einsum("cp,phv->chv", weight, one_hot) + prior
            self.chance /= self.chance.sum(2, keepdims=True)
            new = self._posterior(seen)
            if not len(new) or np.abs(new - good).max() < 1e-6:
                break
            good = new

    def _posterior(self, seen: np.ndarray) -> np.ndarray:
        logs = np.log(self.share)[:, None] + np.log(self.chance)[:, np.arange(len(NAMES))[None, :], seen].sum(2)
        return 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))

    def good(self, codes: np.ndarray) -> np.ndarray:
        return self._posterior(np.array([votes_of(int(c)) for c in codes], np.int64).reshape(len(codes), len(NAMES)) + 1)

    def accuracies(self) -> dict[str, float]:
        """Of each heuristic the chance that a vote of it that isn't NONE is right."""
        right = self.share[0] * self.chance[0, :, 2] + self.share[1] * self.chance[1, :, 0]
        given = (self.share[:, None] * (self.chance[:, :, 0] + self.chance[:, :, 2])).sum(0)
        return dict(zip(NAMES, (right / given).tolist(), strict=True))


def features(found: Analysis) -> tuple[np.ndarray, np.ndarray]:
    """Hashed buckets and weights: the words and marks, to unit length together, and the heuristics' votes."""
    kinds = found.words + found.marks
    n = max(1, sum(kinds.values()))
    names = [*kinds, *(f"{name}={v}" for name, v in zip(NAMES, found.votes, strict=True))]
    at = np.array([zlib.crc32(w.encode()) % BUCKETS for w in names], np.int64)
    # A word that occurs at all tells much, and how often it does tells a little more.
    weight = 0.2 + np.minimum(1.0, 5 / n * np.fromiter(kinds.values(), float, len(kinds)))
    return at, np.r_[2 * weight / max(1e-9, np.sqrt((weight**2).sum())), np.ones(len(NAMES))]


def train(sample: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer, by adaptive gradient steps on soft labels."""
    w, g = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-3)
    rows = [(np.r_[at, BUCKETS].astype(np.int32), np.r_[weight, 1.0].astype(np.float32), label) for (at, weight), label in zip(sample, labels.tolist(), strict=True)]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, weight, label = rows[i]
            slope = (1 / (1 + np.exp(-np.clip(w[at] @ weight, -50, 50))) - label) * weight
            g[at] += slope**2
            w[at] -= 0.3 * slope / np.sqrt(g[at])
    return w


class Model(NamedTuple):
    rules: dict[str, float]
    labels: LabelModel
    weights: np.ndarray


#: The votes, and the features as 16-bit buckets and 16-bit floats: a few bytes a distinct word.
FEATURES = T.StructType([T.StructField("pattern", T.IntegerType()), T.StructField("at", T.BinaryType()), T.StructField("weight", T.BinaryType())])
SCORES = T.StructType([T.StructField("pattern", T.IntegerType()), T.StructField("p_good", T.DoubleType()), T.StructField("p_label", T.DoubleType())])


def _featurer(rules: dict[str, float]) -> Callable[[], Callable[[list], list[list]]]:
    def compute(texts: list) -> list[list]:
        found = [Analysis(t or "", rules) for t in texts]
        made = [features(a) for a in found]
        return [[pattern_of(a.votes) for a in found], [at.astype("<u2").tobytes() for at, _ in made], [w.astype("<f2").tobytes() for _, w in made]]

    return lambda: compute


def unpacked(at: bytes, weight: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(at, "<u2").astype(np.int64), np.frombuffer(weight, "<f2").astype(float)


def featured(docs: DataFrame, rules: dict[str, float]) -> DataFrame:
    """doc_id, h (hash of the text, null without one) and FEATURES of every document, written: texts are read once for
    the votes, the training and the scores."""
    rows = docs.select("doc_id", F.when(F.length("text") > 0, F.xxhash64("text")).alias("h"), F.col("text").cast("string").alias("text"))
    return write_out(with_text_columns(rows, "text", FEATURES, _featurer(rules)).drop("text"), "features")


def fit(found: DataFrame, rules: dict[str, float], sample_docs: int = SAMPLE_DOCS, sample_features: int = SAMPLE_FEATURES) -> Model:
    """The label model over the vote patterns of all documents, and the scorer, from a bounded sample of ``featured``.

    The patterns are 3 ** 8 at most. Sampled are distinct texts, the first by their hash; of a text's copies one.
    """
    labels = LabelModel({r["pattern"]: r["n"] for r in found.groupBy("pattern").agg(F.count("*").alias("n")).collect()})
    texts = found.filter(F.col("h").isNotNull())
    n = texts.select("h").distinct().count()
    share = min(1.0, (1.1 * sample_docs + 50.0) / n) if n else 1.0
    taken = texts.filter(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < share).groupBy("h").agg(*[F.first(c).alias(c) for c in FEATURES.names])
    # A few rows more than ``sample_docs``: one task sums their features up.
    order = W.orderBy("h")
    summed = taken.select("*", F.row_number().over(order).alias("nth"), F.sum(F.length("at") / 2).over(order).alias("so_far"))
    table = summed.filter((F.col("nth") <= sample_docs) & ((F.col("so_far") <= sample_features) | (F.col("nth") == 1))).orderBy("h").toArrow()
    rows = [unpacked(a.as_py(), w.as_py()) for a, w in zip(table["at"], table["weight"], strict=True)]
    return Model(rules, labels, train(rows, labels.good(table["pattern"].to_numpy())))


def rules_of(docs: DataFrame, labels: DataFrame | None) -> dict[str, float]:
    """The prefixes learned from ``labels`` (doc_id, toxic), which may name some documents toxic. Null labels count as
    none; a document with several labels is toxic if one says so; labels of no document are ignored; copies of a text
    count once (toxic, if one is labelled so).

    Only ids and hashes of texts meet the labels; texts are shuffled only to more of them than are broadcast.
    """
    if labels is None:
        return {}
    given = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("l_doc")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = docs.filter(F.length("text") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    met = texts.select("doc_id", "h").join(given, F.col("doc_id") == F.col("l_doc"))
    chosen = write_out(met.groupBy(F.col("h").alias("l_h")).agg(F.min("doc_id").alias("l_doc"), F.max("toxic").alias("toxic")), "labelled-texts")
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    return learn_prefixes(texts.join(chosen, (F.col("doc_id") == F.col("l_doc")) & (F.col("h") == F.col("l_h"))).select("text", "toxic"))


def learn(docs: DataFrame, labels: DataFrame | None = None, sample_docs: int = SAMPLE_DOCS) -> Model:
    """The prefixes, the label model over the vote patterns of all documents, and the scorer.

    The prefixes are one more heuristic, whose accuracy is estimated like that of the others. Null texts count as
    empty ones; empty texts vote but are not sampled; an empty table gives a model that knows nothing.
    """
    rules = rules_of(docs, labels)
    return fit(featured(docs, rules), rules, sample_docs)


def _scorer(model: Model) -> Callable[[list[int], list[tuple[np.ndarray, np.ndarray]]], list[list]]:
    w, labels = model.weights, model.labels

    def compute(codes: list[int], found: list[tuple[np.ndarray, np.ndarray]]) -> list[list]:
        scores = [float(1 / (1 + np.exp(-np.clip(w[at] @ weight + w[BUCKETS], -50, 50)))) for at, weight in found]
        return [codes, scores, labels.good(np.array(codes, np.int64)).tolist()]

    return compute


def _packed(model: Model) -> Callable[[], Model]:
    data = zlib.compress(model.weights.astype(np.float32).tobytes())
    return lambda: model._replace(weights=np.frombuffer(zlib.decompress(data), np.float32).astype(float))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with pattern (of votes), p_good (the scorer's) and p_label (the label model's probability).

    Null texts count as empty ones. Every row gives a row, repeated ones the same values; an empty table gives none;
    texts are read whole, however long; clashing columns are replaced.
    """
    unpack, rules = _packed(model), model.rules
    light = model._replace(weights=np.empty(0))

    def make() -> Callable[[list], list[list]]:
        compute, feature = _scorer(light._replace(weights=unpack().weights)), _featurer(rules)()

        def run(texts: list) -> list[list]:
            codes, at, weight = feature(texts)
            return compute(codes, [unpacked(a, w) for a, w in zip(at, weight, strict=True)])

        return run

    return with_text_columns(docs, text_col, SCORES, make)


def score_features(found: DataFrame, model: Model) -> DataFrame:
    """doc_id, pattern, p_good, p_label from ``featured``: what ``score`` gives, without the texts."""
    ship(found.sparkSession)
    unpack = _packed(model)
    out = T.StructType([T.StructField("doc_id", found.schema["doc_id"].dataType), *SCORES.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = _scorer(unpack())
        for batch in batches:
            rows = [unpacked(a.as_py(), w.as_py()) for a, w in zip(batch.column("at"), batch.column("weight"), strict=True)]
            codes, good, label = compute(batch.column("pattern").to_pylist(), rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codes, pa.int32()), pa.array(good, pa.float64()), pa.array(label, pa.float64())], names=out.names)

    return found.mapInArrow(run, out)


def keep_good(docs: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents the scorer takes for good, with the columns of ``docs``; nulls and repeats as in ``score``."""
    renamed, back, place = by_position(docs)
    return back(score(renamed, learn(docs, labels), place("text")).filter(F.col("p_good") >= threshold))


def op8(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """doc_id, p_good, p_label, kept of every document; nulls, empty and long texts, repeats and ties as in ``score``."""
    rules = rules_of(docs, labels)
    found = featured(docs, rules)
    scored = score_features(found, fit(found, rules))
    return scored.select("doc_id", "p_good", "p_label", (F.col("p_good") >= THRESHOLD).alias("kept"))
