r"""Language identification by error-correcting output codes over character n-grams.

Every language has a codeword of bits. For each bit a binary classifier tells the languages whose codeword has it from the others, by the mean
log ratio of hashed n-grams of 1 to `ORDERS` letters (words are lower-cased; what isn't a letter is a word's border). On
documents that were not counted, a bit's evidence is put on a logistic scale, and the bit gets a weight by how seldom it is wrong there. Decoding sums, for each
codeword, the weighted logistic losses of all bits against it, and takes the codeword of least loss: some wrong bits don't
matter as long as no other codeword comes nearer. A document is ambiguous when the two nearest codewords lie less than `MIN_GAP` of weighted distance
apart, or its bits' signs alone are as far from the nearest codeword as half the code's least distance.

Up to 7 languages have the exhaustive code (every way to part them in two); more get random codewords, of which the set with the largest least
distance among `TRIALS` drawn is kept; their length grows with the logarithm of the number of languages.

Bounded: at most `max_docs` documents of each language are learned from (a documented sample, by a hash of id and text), half of them for counts and half for
the scale. The sample is written to the shared folder. The model has `BUCKETS` rows and a column for each bit; languages are a closed set. Texts are read whole, in pieces that overlap by an n-gram.

Defined cases: a text that is null or has no letter is `und` with score 0, and so is every text when nothing could be learned; with one language
known it is that one with score 1; a null lang or text teaches nothing; a null doc_id has the fold of the empty text; repeated rows give repeated results;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.common import crc_fold, shared_dir, stored

UNKNOWN = "und"
ORDERS = 4
BITS = 15
BUCKETS = 1 << BITS
PIECE = 500_000
EXHAUSTIVE = 7
TRIALS = 200
MIN_GAP = 0.15
MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    """For each code point, is it a letter?"""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str) -> tuple[np.ndarray, int]:
    """The n-grams' buckets of a piece of text (borders count as one character), and its number of letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    n = int(letter.sum())
    if not n:
        return np.empty(0, np.int32), 0
    # runs of other characters are one border each; one stands before and after the piece
    solid = np.concatenate([[False], letter, [False]])
    keep = solid | np.concatenate([[True], solid[:-1]])
    x = np.where(solid, np.concatenate([[0], points, [0]]), 0).astype(np.uint64)[keep]
    single = (x + np.uint64(1)) * MIX
    single ^= single >> np.uint64(29)
    rolled, out = single, [(single * MIX)[x != 0]]
    for _ in range(1, ORDERS):
        rolled = rolled[:-1] * np.uint64(0xBF58476D1CE4E5B9) + single[len(single) - len(rolled) + 1 :]
        out.append((rolled ^ (rolled >> np.uint64(31))) * MIX)
    return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int32), n


def pieces(text: str) -> Iterator[str]:
    """A text in parts of about PIECE characters, cut where a character that is no letter stands, if one comes soon."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        near = next((i for i in range(end, end - 1000, -1) if not text[i].isalpha()), end)
        yield text[at:near]
        at = near
    yield text[at:]


def codewords(n: int, seed: int = 0) -> np.ndarray:
    """A row of -1 and 1 for each of n languages; no column is constant."""
    if n <= EXHAUSTIVE:
        parts = [p for k in range(1, n) for p in combinations(range(1, n), k)] if n > 1 else []
        return np.array([[1.0 if i in p else -1.0 for p in parts] for i in range(n)]).reshape(n, len(parts))
    rng, length = np.random.default_rng(seed), int(np.ceil(12 * np.log2(n)))
    best, most = None, -1
    for _ in range(TRIALS if n <= 500 else 5):
        code = rng.choice([-1.0, 1.0], (n, length))
        code[0, np.abs(code.sum(0)) == n] *= -1
        apart = least_distance(code)
        if apart > most:
            best, most = code, apart
    return best


def least_distance(code: np.ndarray) -> int:
    """In how many bits the two nearest codewords differ."""
    if len(code) < 2 or not code.shape[1]:
        return 0
    same = code @ code.T
    np.fill_diagonal(same, -code.shape[1])
    return int((code.shape[1] - same.max()) // 2)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits
    ratios: np.ndarray  # buckets x bits, log ratios
    scale: np.ndarray  # bits x 2: slope and bias of the logistic scale
    weight: np.ndarray  # of bits, 1 on average
    apart: int

    def evidence(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's summed log ratios over the root of their number, a column a bit; and its letters."""
        out, letters = np.zeros((len(texts), self.code.shape[1])), np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            total = 0
            for piece in pieces(text or ""):
                at, n = grams(piece)
                letters[i] += n
                total += len(at)
                if len(at) and self.code.shape[1]:
                    out[i] += self.ratios[at].sum(0) if len(at) < BUCKETS // 8 else np.bincount(at, minlength=BUCKETS) @ self.ratios
            out[i] /= np.sqrt(total + 20.0)
        return out, letters

    def losses(self, evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weighted logistic loss of each text against each codeword, and the bits' logits."""
        logit = evidence * self.scale[:, 0] + self.scale[:, 1]
        one = (self.code > 0).T.astype(float)
        return (np.logaddexp(0, -logit) * self.weight) @ one + (np.logaddexp(0, logit) * self.weight) @ (1 - one), logit

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, ambiguous) of each text."""
        evidence, letters = self.evidence(texts)
        known = (letters > 0) & (len(self.languages) > 0)
        if len(self.languages) < 2:
            return [self.languages[0] if k else UNKNOWN for k in known], known.astype(float), np.zeros(len(texts), bool)
        loss, logit = self.losses(evidence)
        # two codewords differ in at least `apart` bits: their losses count that often
        share = np.exp(-(loss - loss.min(1, keepdims=True)) / max(1, self.apart))
        share /= share.sum(1, keepdims=True)
        best = loss.argmin(1)
        two = np.sort(loss, axis=1)[:, :2]
        wrong = (np.sign(logit) * self.code[best] < 0).sum(1)
        unsure = ((two[:, 1] - two[:, 0]) / max(1, self.apart) < MIN_GAP) | (2 * wrong >= self.apart)
        score = np.where(known, share[np.arange(len(texts)), best], 0.0)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known, strict=True)], score, known & unsure


def _sample(docs: DataFrame, held_out: int, folds: int, max_docs: int) -> DataFrame:
    """(lang, text, at) of at most max_docs documents of each language, numbered by a hash from 1."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc_fold(F.col("doc_id"), folds) != held_out))
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("_h"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    # about 4 * max_docs of a language pass; the window takes the first of them, after a limit by task
    share = F.pmod(F.xxhash64("_h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = rows.join(F.broadcast(sizes), "lang").where(share * F.col("_n") <= 4 * max_docs)
    return some.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "text"))).where(F.col("at") <= max_docs).select("lang", "text", "at")


def fit(docs: DataFrame, held_out: int = 1, folds: int = 3, max_docs: int = 2000, smooth: float = 0.5) -> Model:
    """Learns from documents (doc_id, text, lang) outside one fold."""
    spark = docs.sparkSession
    sample = stored(_sample(docs, held_out, folds, max_docs), shared_dir(spark, "languages"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for piece in pieces(text):
                    own += np.bincount(grams(piece)[0], minlength=BUCKETS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "at": at, "n": own[at]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, x in b.groupby("lang"):
                yield pd.DataFrame({"lang": [lang], "at": [x["at"].to_numpy(np.int32).tobytes()], "n": [x["n"].to_numpy(np.int64).tobytes()]})

    # odd places count, so a language's only document does
    sums = sample.where("at % 2 = 1").select("lang", "text").mapInPandas(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for r in sums.mapInPandas(pack, "lang string, at binary, n binary").collect():  # BUCKETS numbers a language at most
        counts.setdefault(r["lang"], np.zeros(BUCKETS))[np.frombuffer(bytes(r["at"]), np.int32)] += np.frombuffer(bytes(r["n"]), np.int64)
    languages = tuple(sorted(counts))
    code = codewords(len(languages))
    bits = code.shape[1]
    if not bits:
        return Model(languages, code, np.zeros((BUCKETS, 0)), np.zeros((0, 2)), np.zeros(0), 0)
    shares = np.array([(counts[x] + smooth) / (counts[x].sum() + smooth * BUCKETS) for x in languages])
    ratios = np.empty((BUCKETS, bits))
    for b in range(bits):
        one = code[:, b] > 0
        ratios[:, b] = np.log(shares[one].mean(0)) - np.log(shares[~one].mean(0))
    raw = Model(languages, code, ratios, np.tile([1.0, 0.0], (bits, 1)), np.ones(bits), least_distance(code))
    shared = spark.sparkContext.broadcast(raw)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, letters = shared.value.evidence(b["text"].tolist())
            some = letters > 0
            yield pd.DataFrame({"lang": b["lang"][some].to_numpy(), "x": [row.tobytes() for row in x[some]]})

    seen = sorted((r["lang"], bytes(r["x"])) for r in sample.where("at % 2 = 0").select("lang", "text").mapInPandas(measure, "lang string, x binary").collect() if r["lang"] in counts)
    if not seen:
        return raw
    own = np.array([languages.index(lang) for lang, _ in seen])
    x = np.array([np.frombuffer(v) for _, v in seen])
    even = 1.0 / np.bincount(own, minlength=len(languages))[own]  # each language counts alike
    scale, weight = np.empty((bits, 2)), np.empty(bits)
    for b in range(bits):
        y = code[own, b] > 0
        scale[b] = _logistic(x[:, b], y, even)
        wrong = even[(x[:, b] * scale[b, 0] + scale[b, 1] > 0) != y].sum() / even.sum()
        weight[b] = np.log((1 - wrong + 1e-3) / (wrong + 1e-3)) if wrong < 0.5 else 1e-3
    return Model(languages, code, ratios, scale, weight / weight.mean(), raw.apart)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> tuple[float, float]:
    """Slope and bias by Newton's method; the slope isn't pulled to 0 but to 1 over the spread, and kept positive."""
    spread = float(np.sqrt((weight * x * x).sum() / weight.sum())) + 1e-9
    a = np.column_stack([x / spread, np.ones(len(x))])
    w, pull = np.array([1.0, 0.0]), ridge * weight.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + pull * (w - [1.0, 0.0])
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + pull * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(w[0], 0.1) / spread, float(w[1])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of each row. The model is broadcast: BUCKETS rows and a column for each bit."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lang, score, unsure = shared.value.predict(b["_t"].tolist())
            yield pd.DataFrame({"doc_id": b["_id"], "lang_pred": lang, "score": score, "ambiguous": unsure})

    rows = docs.select(F.col("doc_id").cast("string").alias("_id"), F.col("text").cast("string").alias("_t"))
    return rows.mapInPandas(run, "doc_id string, lang_pred string, score double, ambiguous boolean").withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]))
