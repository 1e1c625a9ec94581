"""Toxicity by weak supervision: many weak voters, a generative model of their votes, a linear classifier on its labels.

Voters are lexicons and patterns. Some lexicons are given; others are learned from labelled rows: words and word beginnings that
occur far more often in toxic texts, dealt to several lexicons. A voter fires on a text or does not. The label model
takes the counts of all vote patterns of the corpus and estimates by expectation and maximisation how often each voter fires
on toxic and on other texts, and from the joint counts which voters fire together more than that explains; such
voters share their weight. Its posteriors are the labels on which a logistic classifier over learned words, word
beginnings and votes is trained; the classifier gives the scores.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowkeeper.llm.common import MAX_CACHED_WORDS, rows_of
from rowkeeper.session import written

#: Plain insults in four languages, the lexicon that is there without any labelled row.
INSULTS = (
    "abschaum basura clown dégoûtant dégoûtante disgusting dreck dumm dummkopf erbärmlich escoria estúpida estúpido "
    "idiot idiota idiote imbécil imbécile inútil loser minable moron ordure patético pathetic pathétique scum stupid "
    "stupide trash trottel versager wertlos worthless"
).split()

SAMPLE_ROWS = 6_000  # labelled rows of each class that words and classifier are fitted on
MOST_FEATURES = 4_000
LEAST_RATIO = 10.0  # how much more often a word or beginning must occur in toxic rows of the sample
LEAST_EVIDENCE = 28.0  # its likelihood ratio statistic; among 100,000 words without meaning, about one in a hundred runs reaches it
BEGINNINGS = (4, 5, 6)  # letters
REPEATS = (1, 2, 3, 5)  # different words with a beginning, for which it counts as a feature each
LEXICONS = 4  # that the learned words, and likewise the beginnings, are dealt to
MOST_VOTERS = 14  # so vote patterns are at most 2**14
ROUNDS = 200
STEPS = 400
RIDGE = 1e-4

WORD = re.compile(r"[^\W\d_]+")
ADDRESSED = re.compile(r"\b(?:you|your|du|dein|ihr|tu|ton|vous|eres|usted)\b")


def beginnings_of(word: str) -> list[str]:
    return [word[:n] for n in BEGINNINGS if len(word) > n]


def features_of(words: set[str]) -> set[str]:
    """The words themselves, and their beginnings with the number of different words that have them, which no word looks like."""
    found = {w for w in words if len(w) > 2}
    for beginning, times in Counter(b for w in words for b in beginnings_of(w)).items():
        found.update(f"{beginning}*{n}" for n in REPEATS if times >= n)
    return found


def sample_rows(labelled: DataFrame, per_class: int) -> DataFrame:
    """``id`` and ``toxic`` of at most ``per_class`` rows of each class, those with the lowest hash of the id."""
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("id"), "id")
    ranked = labelled.select("id", "toxic").distinct().withColumn("at", F.row_number().over(order))
    return ranked.filter(F.col("at") <= per_class).drop("at")


def learned_features(texts: DataFrame, rows: dict[int, int], most: int) -> list[tuple[str, float]]:
    """Words and beginnings that tell toxic rows of the sample (``text``, ``toxic``), with their log ratio, strongest first."""

    def count(batches):
        found: dict[str, list[int]] = {}
        for texts, labels in rows_of(batches, "text", "toxic"):
            for text, label in zip(texts, labels):
                for feature in features_of(set(WORD.findall((text or "").lower()))):
                    found.setdefault(feature, [0, 0])[label] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), *[pa.array([c[i] for c in found.values()], pa.int64()) for i in (0, 1)]],
            ["feature", "clean", "toxic"],
        )

    summed = texts.mapInArrow(count, "feature string, clean bigint, toxic bigint").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    toxic_rows, clean_rows = float(rows.get(1, 0)), float(rows.get(0, 0))
    share = (F.col("toxic") + 0.5) / (toxic_rows + 1) / ((F.col("clean") + 0.5) / (clean_rows + 1))
    both, expected = F.col("toxic") + F.col("clean"), toxic_rows / max(toxic_rows + clean_rows, 1.0)

    def part(n: Column, p: float) -> Column:
        return F.when(n > 0, n * F.log(n / (both * p))).otherwise(F.lit(0.0))

    evidence = 2 * (part(F.col("toxic"), expected) + part(F.col("clean"), max(1 - expected, 1e-9)))
    found = summed.withColumn("ratio", share).withColumn("evidence", evidence)
    strong = found.filter((F.col("ratio") >= LEAST_RATIO) & (F.col("evidence") >= LEAST_EVIDENCE))
    # At most ``most`` rows.
    top = strong.orderBy(F.desc("evidence"), "feature").limit(most).collect()
    return [(r.feature, float(np.log(r.ratio))) for r in top]


class Voters:
    """Which learned features a text has, and which voters fire on it, as bits."""

    def __init__(self, features: list[str], insults: list[str]):
        self.at = {f: i for i, f in enumerate(features)}
        # Words are dealt to the first lexicons, beginnings to the others; a beginning stays in one, however often it counts.
        self.lexicon = [
            2 + xxhash.xxh3_64_intdigest(f.split("*")[0]) % LEXICONS + (LEXICONS if "*" in f else 0) for f in features
        ]
        self.beginnings = frozenset(f.split("*")[0] for f in features if "*" in f)
        self.insults = frozenset(insults)
        self.names = (
            ["given lexicon", "given lexicon, addressed to someone"] + [f"learned words {i}" for i in range(LEXICONS)]
            + [f"learned beginnings {i}" for i in range(LEXICONS)] + ["two words of any lexicon", "four words of any lexicon"]
        )
        assert len(self.names) <= MOST_VOTERS
        self.telling: dict[str, bool] = {}

    def tells(self, word: str) -> bool:
        """Whether any voter knows the word; most words are met often and told nothing by."""
        found = self.telling.get(word)
        if found is None:
            found = word in self.at or word in self.insults or any(b in self.beginnings for b in beginnings_of(word))
            if len(self.telling) >= MAX_CACHED_WORDS:
                self.telling.clear()
            self.telling[word] = found
        return found

    def of(self, text: str | None) -> tuple[list[int], int]:
        low = (text or "").lower()
        words = {w for w in set(WORD.findall(low)) if self.tells(w)}
        features = sorted(self.at[f] for f in features_of(words) if f in self.at)
        bits = 0
        for at in features:
            bits |= 1 << self.lexicon[at]
        if not words.isdisjoint(self.insults):
            bits |= 1
            if ADDRESSED.search(low):
                bits |= 2
        last = 2 + 2 * LEXICONS
        bits |= ((len(words) >= 2) << last) | ((len(words) >= 4) << (last + 1))
        return features, bits


@dataclass
class LabelModel:
    """Share of toxic texts, how often each voter fires on toxic and on other texts, and the weight it has beside the others."""

    share: float
    toxic: np.ndarray
    clean: np.ndarray
    correlations: np.ndarray
    weights: np.ndarray

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        fired = np.log(self.toxic / self.clean) * self.weights
        silent = np.log((1 - self.toxic) / (1 - self.clean)) * self.weights
        return np.log(self.share / (1 - self.share)) + votes @ (fired - silent) + silent.sum()

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(votes), -50, 50)))


def bits_to_votes(bits: np.ndarray, n: int) -> np.ndarray:
    return ((np.asarray(bits, np.int64)[:, None] >> np.arange(n)) & 1).astype(float)


def fit_label_model(bits: np.ndarray, counts: np.ndarray, n: int, seen: tuple[np.ndarray, np.ndarray] | None = None) -> LabelModel:
    """From the vote patterns of all texts and how often each occurs.

    ``seen`` has the patterns and labels of labelled rows, which only set where the search begins.
    """
    votes, weight = bits_to_votes(bits, n), np.asarray(counts, float)
    total = weight.sum()
    toxic, clean, share = np.full(n, 0.5), np.full(n, 0.02), 0.1
    if seen is not None and len(seen[0]):
        known, labels = bits_to_votes(seen[0], n), np.asarray(seen[1], float)
        toxic = (known.T @ labels + 1) / (labels.sum() + 2)
        clean = (known.T @ (1 - labels) + 0.05) / ((1 - labels).sum() + 1)
    model = LabelModel(share, toxic, np.minimum(clean, 0.95), np.zeros((n, n)), np.ones(n))
    if not total:
        return model
    for turn in range(ROUNDS):
        post = model.posterior(votes) * weight
        rest = weight - post
        model.share = float(np.clip((post.sum() + 1) / (total + 2), 1e-4, 0.9))
        model.toxic = np.clip((votes.T @ post + 1) / (post.sum() + 2), 1e-3, 1 - 1e-3)
        model.clean = np.clip((votes.T @ rest + 0.05) / (rest.sum() + 1), 1e-5, 1 - 1e-3)
        if turn % 20 == 19:
            # What two voters have in common beyond what the two classes explain.
            joint = (votes * weight[:, None]).T @ votes / total
            explained = model.share * np.outer(model.toxic, model.toxic) + (1 - model.share) * np.outer(model.clean, model.clean)
            within = np.sqrt(model.share * model.toxic * (1 - model.toxic) + (1 - model.share) * model.clean * (1 - model.clean))
            model.correlations = (joint - explained) / np.maximum(np.outer(within, within), 1e-12)
            np.fill_diagonal(model.correlations, 0)
            model.weights = 1 / (1 + np.clip(model.correlations, 0, 1).sum(axis=1))
    return model


@dataclass
class Classifier:
    """A linear classifier over learned features and votes."""

    bias: float
    features: np.ndarray
    votes: np.ndarray

    def score(self, features: list[int], votes: np.ndarray) -> float:
        z = self.bias + self.features[features].sum() + votes @ self.votes
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def train(model: LabelModel, n_features: int, rows: list[list[int]], bits: np.ndarray, weights: np.ndarray) -> Classifier:
    """Logistic regression on the posteriors of the rows, starting from the label model's own log odds."""
    n = len(model.weights)
    fired = np.log(model.toxic / model.clean) * model.weights
    silent = np.log((1 - model.toxic) / (1 - model.clean)) * model.weights
    found = Classifier(float(np.log(model.share / (1 - model.share)) + silent.sum()), np.zeros(n_features), fired - silent)
    if not len(rows):
        return found
    votes = bits_to_votes(bits, n)
    target = model.posterior(votes)
    row_of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.array([f for r in rows for f in r], np.int64)
    weights = weights / weights.sum()
    theta = np.concatenate([[found.bias], found.features, found.votes])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    start = theta.copy()
    for step in range(1, STEPS + 1):
        z = theta[0] + np.bincount(row_of, theta[1 + column], len(rows)) + votes @ theta[1 + n_features :]
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) * weights
        slope = np.concatenate([[error.sum()], np.bincount(column, error[row_of], n_features), error @ votes])
        slope += RIDGE * (theta - start)
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta = theta - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return Classifier(float(theta[0]), theta[1 : 1 + n_features], theta[1 + n_features :])


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", per_class: int = SAMPLE_ROWS, most_features: int = MOST_FEATURES,
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` and the fired voters as ``votes``, one row per input row.

    Labels are used only from rows that are not held out, a sample of at most ``per_class`` rows of each class; repeated labels
    of an id with different values, null labels and null ids are left out. Vote patterns are counted over all
    documents. A null text counts as empty and gets the score of a text on which no voter fires. Without labelled rows
    the given lexicon and the label model decide alone. An empty table gives no rows; other columns are ignored.

    Texts are read once for the sample and once for the votes, which are written to the shared folder. The driver gets the learned
    words (at most ``most_features``), the vote patterns (at most 2**MOST_VOTERS) and the features of the sample.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    agreed = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(
        F.col(id_col).cast("bigint").alias("id")
    ).agg(F.min(F.col(label_col).cast("int")).alias("toxic"), F.max(F.col(label_col).cast("int")).alias("most"))
    usable = agreed.filter((F.col("toxic") == F.col("most")) & ~held_out("id"))
    # Two classes of at most ``per_class`` rows.
    sample = written(sample_rows(usable, per_class), "sample")
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    population = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    sampled = rows.join(F.broadcast(sample), "id")
    learned = learned_features(sampled.select("text", "toxic"), sizes, most_features) if sizes.get(1) else []
    voters = Voters([f for f, _ in learned], INSULTS)

    def vote(batches):
        for ids, texts in rows_of(batches, "id", "text"):
            found = [voters.of(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array([f for f, _ in found], pa.list_(pa.int32())),
                    pa.array([b for _, b in found], pa.int32()),
                ],
                ["id", "features", "votes"],
            )

    voted = written(rows.mapInArrow(vote, "id bigint, features array<int>, votes int"), "votes")
    n = len(voters.names)
    patterns = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).toPandas()
    known = voted.join(F.broadcast(sample), "id").select("features", "votes", "toxic").collect()
    bits, classes = np.array([r.votes for r in known], np.int64), np.array([r.toxic for r in known], np.int64)
    model = fit_label_model(patterns["votes"].to_numpy(), patterns["n"].to_numpy(), n, (bits, classes))
    # The sample has its own mix of classes; its rows weigh as the classes do among all labelled rows.
    weights = np.array([population[c] / sizes[c] for c in classes.tolist()], float)
    classifier = train(model, len(learned), [list(r.features) for r in known], bits, weights)

    def score(batches):
        for ids, outs, features, bits in rows_of(batches, "id", "held_out", "features", "votes"):
            votes = bits_to_votes(np.array(bits, np.int64), n)
            scores = [classifier.score(f, v) for f, v in zip(features, votes)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(outs, pa.bool_()), pa.array(scores, pa.float64()),
                    pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(bits, pa.int32()),
                ],
                ["doc_id", "held_out", "score", "predicted", "votes"],
            )

    scored = voted.select("id", held_out("id").alias("held_out"), "features", "votes")
    return scored.mapInArrow(score, "doc_id bigint, held_out boolean, score double, predicted int, votes int")
