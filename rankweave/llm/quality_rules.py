r"""Quality rules: text statistics and a learned decision list, in DataFrame operations only.

`text_stats` computes whole-text statistics natively. `learn_rules` is sequential covering: it grows a conjunction
of thresholds by information gain on two thirds of the labelled rows, prunes it on the last third, keeps it if
its precision there is at least `min_precision`, takes away what it covers and goes on. The result is an ordered list of
readable rules, emitted as one chained Spark `CASE WHEN` (`rules_column`); a text that no rule rejects is kept.

The labelled rows are a bounded sample (`max_labelled`, by hash of doc_id), so the fit's memory doesn't grow; all
other work covers every document and moves no row between executors.

Defined cases: a null or empty text has no words (it fails the base rule); a null doc_id stays; labels that are null or
repeated count once, at the lowest quality; without labels the list is empty and only the base rule rejects;
columns of docs may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import SPACES, text_or_empty

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Interpretable ratios of the statistics that the rules may test.
FEATURES = ["word_len", "symbol_ratio", "upper_ratio", "bang_ratio", "digit_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "words_per_line", "n_words"]


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _shifted(a: str, n: Column, by: int) -> Column:
    """Pairs up a[i] and a[i + by]; n: how many there are."""
    n = F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + by), n), lambda x, y: F.xxhash64(x, y))


def text_stats(docs: DataFrame) -> DataFrame:
    """docs and a struct `_stats` of the statistics; words are runs of characters that aren't spaces."""
    n = F.size("_wh")
    trimmed = F.btrim(F.col("_t"), F.lit(SPACES))
    out = (
        docs.withColumn("_t", text_or_empty())
        .withColumn("_wh", F.when(trimmed != "", F.transform(F.split(trimmed, r"[\x20\x09-\x0D]+", -1), lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))
        .withColumn("_lines", F.filter(F.split("_t", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
        .withColumn("_h2", _shifted("_wh", n - 1, 1))
        .withColumn("_h4", _shifted("_h2", n - 3, 2))
        .withColumn("_h8", _shifted("_h4", n - 7, 4))
        # where a window occurs twice: all windows in the order of their hash, so that equal ones are neighbours
        .withColumn("_s", F.when(F.size(F.array_distinct("_h8")) < F.size("_h8"), F.sort_array(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    )
    m = F.size("_s")
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    out = out.withColumn(
        "_m",
        F.when(
            F.col("_s").isNotNull(),
            F.zip_with(
                F.zip_with("_s", F.concat(F.slice("_s", F.lit(2), F.greatest(m - 1, F.lit(0))), none), lambda x, y: F.struct(x["h"].alias("h"), x["i"].alias("i"), F.coalesce(x["h"] == y["h"], F.lit(False)).alias("e"))),
                F.concat(none, F.slice("_s", F.lit(1), F.greatest(m - 1, F.lit(0)))),
                lambda x, y: F.when(x["e"] | F.coalesce(x["h"] == y["h"], F.lit(False)), x["i"]),
            ),
        ),
    ).withColumn("_p", F.sort_array(F.filter("_m", lambda x: x.isNotNull())))
    # each repeated window covers its words up to the next one's start, eight at most
    covered = F.aggregate(
        F.zip_with("_p", F.concat(F.slice("_p", F.lit(2), F.greatest(F.size("_p") - 1, F.lit(0))), F.array(F.element_at("_p", -1) + WINDOW)), lambda a, b: F.least(F.lit(WINDOW), b - a)),
        F.lit(0),
        lambda s, x: s + x,
    )
    text = F.col("_t")
    stats = F.struct(
        n.cast("long").alias("n_words"),
        (F.length(text) - _count(text, r"[\x20\x09-\x0D]")).cast("long").alias("word_chars"),
        _count(text, f"[{SYMBOLS}]").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_p").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_wh")).cast("long").alias("n_distinct"),
        _count(text, "[A-Z]").cast("long").alias("n_upper"),
        _count(text, "!").cast("long").alias("n_bang"),
        _count(text, "[0-9]").cast("long").alias("n_digits"),
    )
    # a generator of one row: what reads the statistics finds values, not expressions to compute again
    return out.select(*docs.columns, F.explode(F.array(stats)).alias("_stats"))


def features(stats: str = "_stats") -> dict[str, Column]:
    s = lambda name: F.col(f"{stats}.{name}").cast("double")
    per = lambda a, b: s(a) / F.greatest(s(b), F.lit(1.0))
    return {
        "word_len": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "upper_ratio": per("n_upper", "word_chars"),
        "bang_ratio": per("n_bang", "n_words"),
        "digit_ratio": per("n_digits", "word_chars"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
        "distinct_ratio": per("n_distinct", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
        "n_words": s("n_words"),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, ">=" or "<=", threshold) that rejects; held-out precision and how many rows it covered there."""

    tests: tuple[tuple[str, str, float], ...]
    precision: float = 0.0
    covered: int = 0

    def column(self, of: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, op, at in self.tests:
            out = out & (of[name] >= at if op == ">=" else of[name] <= at)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{name} {op} {at:.6g}" for name, op, at in self.tests)


def _holds(x: np.ndarray, tests) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, op, at in tests:
        v = x[:, FEATURES.index(name)]
        out &= v >= at if op == ">=" else v <= at
    return out


def _grow(x: np.ndarray, y: np.ndarray, max_tests: int, n_cuts: int) -> list[tuple[str, str, float]]:
    tests: list[tuple[str, str, float]] = []
    on = np.ones(len(x), bool)
    while len(tests) < max_tests and y[on].any() and not y[on].all():
        p0, n0 = y[on].sum(), (~y[on]).sum()
        best, gain = None, 1e-9
        for j, name in enumerate(FEATURES):
            v, t = x[on, j], y[on]
            values = np.unique(v)
            if len(values) < 2:
                continue
            cuts = np.unique(np.quantile(v[t], np.linspace(0, 1, n_cuts), method="nearest"))
            for op in (">=", "<="):
                for at in cuts:
                    hit = v >= at if op == ">=" else v <= at
                    p, n = t[hit].sum(), (~t[hit]).sum()
                    if p and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = (name, op, float(at)), g
        if best is None:
            break
        tests.append(best)
        on &= _holds(x, [best])
    return tests


def _worth(x: np.ndarray, y: np.ndarray, tests) -> tuple[float, int, int]:
    on = _holds(x, tests)
    p, n = int(y[on].sum()), int((~y[on]).sum())
    return ((p - n) / (p + n) if p + n else -1.0), p, n


def learn_rules(rows: list[tuple], max_rules: int = 8, max_tests: int = 3, min_precision: float = 0.95, min_covered: int = 3, n_cuts: int = 32) -> list[Rule]:
    """rows: (label, *FEATURES), label 0 for low quality. Every third row prunes, the others grow."""
    if not rows:
        return []
    rows = sorted(rows)
    data = np.array([r[1:] for r in rows], float)
    low = np.array([r[0] == 0 for r in rows])
    at = np.arange(len(rows)) % 3 == 2
    gx, gy, px, py = data[~at], low[~at], data[at], low[at]
    rules: list[Rule] = []
    while len(rules) < max_rules and gy.any() and not gy.all():
        tests = _grow(gx, gy, max_tests, n_cuts)
        if not tests:
            break
        while len(tests) > 1:
            shorter = max(([t for t in tests if t is not gone] for gone in tests), key=lambda t: _worth(px, py, t)[0])
            if _worth(px, py, shorter)[0] < _worth(px, py, tests)[0]:
                break
            tests = shorter
        _, p, n = _worth(px, py, tests)
        _, gp, gn = _worth(gx, gy, tests)
        if p + n < min_covered or p < min_precision * (p + n) or gp < min_precision * (gp + gn):
            break
        rules.append(Rule(tuple(tests), p / (p + n), p + n))
        gone, pgone = _holds(gx, tests), _holds(px, tests)
        gx, gy, px, py = gx[~gone], gy[~gone], px[~pgone], py[~pgone]
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, min_words: int = 20, max_repeat_percent: int = 30, **how) -> list[Rule]:
    """Learns from at most `max_labelled` labelled documents that pass the base rule."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # max_labelled rows of 12 bytes: a proven bound for the broadcast
    rows = text_stats(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    rows = rows.where(~base_failed(F.col("_stats"), min_words, max_repeat_percent))
    rows = rows.select("doc_id", F.struct("quality", *(c.alias(k) for k, c in features().items())).alias("f"))
    rows = rows.groupBy("doc_id").agg(F.min("f").alias("f")).select("f.*")  # a doc_id that is repeated counts once
    return learn_rules([tuple(r) for r in rows.collect()], **how)


def base_failed(stats: Column, min_words: int = 20, max_repeat_percent: int = 30) -> Column:
    return (stats["n_words"] < min_words) | (100 * stats["n_repeat_words"] > max_repeat_percent * stats["n_words"])


def rules_column(rules: list[Rule], stats: str = "_stats") -> Column:
    """The number of the first rule that holds, from 1; null where none does."""
    of, out = features(stats), None
    for i, rule in enumerate(rules):
        out = F.when(rule.column(of), F.lit(i + 1)) if out is None else out.when(rule.column(of), F.lit(i + 1))
    return F.lit(None).cast("int") if out is None else out


def judge_quality(docs: DataFrame, rules: list[Rule], min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """docs and a struct `_quality`: the statistics, base_failed, rule (which rejected it, or null) and kept. A column of that name is replaced."""
    names = docs.columns
    inner = docs.toDF(*(c if c == "text" else f"c{i}" for i, c in enumerate(names)))
    out = text_stats(inner)
    failed = base_failed(F.col("_stats"), min_words, max_repeat_percent)
    out = out.withColumn("_rule", rules_column(rules))
    quality = F.struct("_stats.*", failed.alias("base_failed"), F.col("_rule").alias("rule"), (~failed & F.col("_rule").isNull()).alias("kept"))
    return out.select(*(F.col("text" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(names) if c != "_quality"), quality.alias("_quality"))


def keep_good(docs: DataFrame, rules: list[Rule], **base) -> DataFrame:
    """The rows of docs that are kept, with its columns and no others."""
    names = docs.columns
    inner = docs.toDF(*(c if c == "text" else f"c{i}" for i, c in enumerate(names)))
    out = judge_quality(inner, rules, **base).where("_quality.kept")
    return out.select(*(F.col("text" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(names)))
