r"""Toxicity: class-conditional Kneser-Ney models of words' characters, compared by length-normalised log-likelihood.

Two models, toxic and ordinary, are estimated from labelled documents. Each gives a word's characters, one after the other, a probability
from its own n-gram counts of orders `order` down to `shared + 1`, by absolute discounting; what they discount goes to
Kneser-Ney continuation counts of the orders up to `shared`, which both classes have in common. So an expression too rare for counts
of its own is smoothed the same way on both sides, and an inflected or compounded form is known by its stem.

A word's evidence is the difference of its log-likelihoods. A document has five features: the evidence of all its words per
character, that of its strongest window of `window` words per character, of its strongest word and of its three strongest, so a long
document with one toxic passage isn't averaged away, and the logarithm of its length. A logistic regression on other labelled documents than the counts' makes a probability of them.

Bounded: at most `max_docs` documents of each class for the counts and as many for the regression (by hash of doc_id; a documented
sample). All words of the sample count, whole: executors count their n-grams, and the distinct n-grams come to the driver, packed. Every
document is scored, whole.

Defined cases: a null or empty text has no evidence and scores as such; a null doc_id has the fold of the empty text; labels
that are null or contradict each other count as toxic if one says so, else not, nulls not at all; without labels of both classes every score is the share of
toxic ones (0 without any); a repeated row is scored again; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import HashedWords, crc_fold, text_or_empty

MAX_CACHED = 400_000
FLUSH_GRAMS = 300_000
START, END = "\x02", "\x03"
N_FEATURES = 5
BATCH_CHARS = 400_000


class KneserNey:
    """log2 P(toxic side) - log2 P(ordinary side) of each character after what stands before it in its word."""

    def __init__(self, counts: list[dict[str, int]], order: int = 5, shared: int = 2, discount: float = 0.75):
        """counts: of each class, word_grams()."""
        self.order, self.shared, self.d = order, shared, discount
        # for each class: n-gram -> count and context -> (sum, types), contexts of shared..order-1 characters
        self.own: list[tuple[dict, dict]] = []
        # n-grams of k + 1 characters: each is one kind of a continuation
        kinds: list[set] = [set() for _ in range(shared + 1)]
        for c in counts:
            grams = {g: n for g, n in c.items() if len(g) > shared}
            for g in c:
                if len(g) <= shared + 1:
                    kinds[len(g) - 1].add(g)
            self.own.append((grams, self._contexts(grams)))
        # continuation counts: in how many kinds of contexts a character follows a shorter one
        self.back: list[tuple[dict, dict]] = []
        for k in range(shared):
            grams = defaultdict(int)
            for gram in kinds[k + 1]:
                grams[gram[1:]] += 1
            self.back.append((dict(grams), self._contexts(grams)))
        self.letters = len(self.back[0][0]) + 1

    @staticmethod
    def _contexts(grams: dict[str, int]) -> dict[str, tuple[int, int]]:
        out: dict[str, tuple[int, int]] = {}
        for g, n in grams.items():
            total, types = out.get(g[:-1], (0, 0))
            out[g[:-1]] = (total + n, types + 1)
        return out

    def _step(self, level: tuple[dict, dict], h: str, x: str, p: float) -> float:
        total, types = level[1].get(h, (0, 0))
        return (max(level[0].get(h + x, 0) - self.d, 0.0) + self.d * types * p) / total if total else p

    def evidence(self, h: str, x: str) -> float:
        """h: the order - 1 characters before x."""
        start = 1.0 / self.letters
        for k in range(self.shared):
            start = self._step(self.back[k], h[len(h) - k :], x, start)
        p = [start, start]
        for i, own in enumerate(self.own):
            for k in range(self.shared, self.order):
                p[i] = self._step(own, h[len(h) - k :], x, p[i])
        return float(np.log2(p[0]) - np.log2(p[1]))


def word_grams(words: Iterable[tuple[str, int]], order: int, grams: Counter) -> Iterator[Counter]:
    """Counts of the n-grams of 2 to `order` characters of counted words, in parts; `grams` is used again and has the last part."""
    for word, n in words:
        s = START * (order - 1) + word + END
        for i in range(order - 1, len(s)):
            for k in range(1, order):
                grams[s[i - k : i + 1]] += n
            if len(grams) >= FLUSH_GRAMS:
                yield grams
                grams.clear()


def _class_grams(words: DataFrame, order: int) -> list[dict[str, int]]:
    """Of counted words (toxic, w, n): the n-gram counts of the toxic class, then of the other."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[int, Counter] = {1: Counter(), 0: Counter()}
        frame = lambda c, g: pd.DataFrame({"toxic": c, "g": list(g), "n": list(g.values())})
        for b in batches:
            for c, grams in own.items():
                x = b[b["toxic"] == c]
                for part in word_grams(zip(x["w"], x["n"], strict=True), order, grams):
                    yield frame(c, part)
        for c, grams in own.items():
            if grams:
                yield frame(c, grams)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c, x in b.groupby("toxic"):  # no n-gram has a line end
                yield pd.DataFrame({"toxic": [c], "g": ["\n".join(x["g"])], "n": [x["n"].to_numpy(np.int64).tobytes()]})

    sums = words.mapInPandas(count, "toxic int, g string, n long").groupBy("toxic", "g").agg(F.sum("n").alias("n"))
    out: dict[int, dict[str, int]] = {1: {}, 0: {}}
    for r in sums.mapInPandas(pack, "toxic int, g string, n binary").collect():
        out[r["toxic"]].update(zip(r["g"].split("\n"), np.frombuffer(bytes(r["n"]), np.int64).tolist(), strict=True))
    return [out[1], out[0]]


class WordEvidence(dict):
    """A word's hash -> (evidence, characters), computed once; evidence of n-grams is kept too. Both are emptied when full."""

    def __init__(self, model: KneserNey):
        super().__init__()
        self.model, self.grams = model, {}

    def measure(self, word: str) -> tuple[float, float]:
        n = self.model.order
        s = START * (n - 1) + word.lower() + END
        grams, total = self.grams, 0.0
        for i in range(n - 1, len(s)):
            g = s[i - n + 1 : i + 1]
            e = grams.get(g)
            if e is None:
                if len(grams) >= MAX_CACHED:
                    grams.clear()
                e = grams[g] = self.model.evidence(g[:-1], g[-1])
            total += e
        return total, float(len(word) + 1)

    def of(self, made: list[HashedWords]) -> np.ndarray:
        """(evidence, characters) of all words of some texts, in order; each distinct word is looked up once."""
        h = np.concatenate([w.hashes for w in made])
        ends = np.cumsum([len(w.hashes) for w in made])
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        found = []
        for k, i in zip(distinct.tolist(), first.tolist(), strict=True):
            x = self.get(k)
            if x is None:
                d = int(np.searchsorted(ends, i, side="right"))
                if len(self) >= MAX_CACHED:
                    self.clear()
                x = self[k] = self.measure(made[d].word(i - int(ends[d]) + len(made[d].hashes)))
            found.append(x)
        return np.array(found, float).reshape(-1, 2)[back]


def text_features(texts: list[str], words: WordEvidence, window: int = 8) -> np.ndarray:
    """A row of features for each text."""
    out = np.zeros((len(texts), N_FEATURES))
    made: list[HashedWords] = []
    row = size = 0
    for i, t in enumerate(texts):
        made.append(HashedWords(t))
        size += len(t)
        if size >= BATCH_CHARS or i + 1 == len(texts):
            x = words.of(made)
            at = 0
            for w in made:
                n = len(w.hashes)
                if n:
                    out[row] = _features(x[at : at + n], window)
                at += n
                row += 1
            made, size = [], 0
    return out


def _features(x: np.ndarray, window: int) -> tuple[float, ...]:
    c = np.concatenate([np.zeros((1, 2)), np.cumsum(x, axis=0)])
    k = min(window, len(x))
    w = c[k:] - c[:-k]
    top = x[:, 0] if len(x) <= 3 else np.partition(x[:, 0], len(x) - 3)[-3:]
    return c[-1, 0] / c[-1, 1], (w[:, 0] / w[:, 1]).max(), top.max(), top.sum() / 3, np.log(len(x) + 1)


@dataclass(frozen=True)
class Model:
    evidence: KneserNey | None
    weights: tuple[float, ...]  # bias, then one a feature
    prior: float
    window: int = 8

    def score(self, f: np.ndarray) -> np.ndarray:
        if self.evidence is None:
            return np.full(len(f), self.prior)
        z = self.weights[0] + f @ np.array(self.weights[1:])
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Newton's method on standardised features; weights for the features as they are."""
    mean, dev = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / dev])
    w = np.zeros(a.shape[1])
    pull = np.full(len(w), ridge * len(x))
    pull[0] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + pull * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(pull + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    out = w.copy()
    out[1:] = w[1:] / dev
    out[0] = w[0] - (w[1:] * mean / dev).sum()
    return out


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 1, folds: int = 3, max_docs: int = 2000, window: int = 8, order: int = 5, **how) -> Model:
    spark = docs.sparkSession
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    rows = rows.withColumn("fold", crc_fold(F.col("doc_id"), folds)).where(F.col("fold") != held_out)
    shares = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = shares.get(1, 0) / max(1, sum(shares.values()))
    if len(shares) < 2:
        return Model(None, (), prior)
    # the first other fold counts, the last one calibrates
    count_fold = min(f for f in range(folds) if f != held_out)
    rows = rows.withColumn("part", (F.col("fold") == count_fold).cast("int"))
    chosen = None
    for toxic, part in ((1, 1), (0, 1), (1, 0), (0, 0)):  # each task passes on max_docs rows at most
        some = rows.where((F.col("toxic") == toxic) & (F.col("part") == part)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
        chosen = some if chosen is None else chosen.unionByName(some)
    # 4 * max_docs rows at most: a proven bound for the broadcast
    texts = docs.select("doc_id", text_or_empty().alias("_t")).join(F.broadcast(chosen.select("doc_id", "toxic", "part")), "doc_id")
    words = texts.where("part = 1").select("toxic", F.explode(F.regexp_extract_all(F.lower("_t"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    words = words.groupBy("toxic", "w").agg(F.count(F.lit(1)).alias("n"))
    model = KneserNey(_class_grams(words, order), order, **how)
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordEvidence(shared.value)
        for b in batches:
            f = text_features(b["_t"].tolist(), known, window)
            yield pd.DataFrame({"toxic": b["toxic"], **{f"f{i}": f[:, i] for i in range(N_FEATURES)}})

    seen = texts.where("part = 0").groupBy("doc_id").agg(F.first("_t").alias("_t"), F.first("toxic").alias("toxic")).select("toxic", "_t")
    data = np.array(sorted(tuple(r) for r in seen.mapInPandas(measure, "toxic int, " + ", ".join(f"f{i} double" for i in range(N_FEATURES))).collect()), float)
    y = data[:, 0] if len(data) else np.empty(0)
    if len(set(y)) < 2:
        return Model(None, (), prior)
    # the sample is balanced as the classes are capped: weights restore their shares
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    return Model(model, tuple(logistic(data[:, 1:], y, weight)), prior, window)


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of each row. The model is broadcast; its size follows the bounds of the sample."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        known = WordEvidence(m.evidence) if m.evidence else None
        for b in batches:
            f = text_features(b["_t"].tolist(), known, m.window) if known is not None else np.zeros((len(b), N_FEATURES))
            s = m.score(f)
            yield pd.DataFrame({"doc_id": b["_id"], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    kind = docs.schema["doc_id"].dataType
    rows = docs.select(F.col("doc_id").cast("string").alias("_id"), text_or_empty().alias("_t"))
    return rows.mapInPandas(run, "doc_id string, score double, predicted int").withColumn("doc_id", F.col("doc_id").cast(kind))
