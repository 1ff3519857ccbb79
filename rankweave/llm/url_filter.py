"""URL filters: a trie over reversed host labels and path segments, with longest-match precedence.

Rules are (verdict, host, path). A rule fits its host and all subdomains when the url's path starts with the
rule's path as text. Of the rules that fit, the one with most host labels wins, then the one with the longest
path; a rule given twice keeps the verdict given last. Where no rule fits, `default` is the verdict.

The trie is built on the driver and broadcast. A list of more than `MAX_RULES` rules goes in parts of that size, one broadcast after the
other: each pass over the pages, stored in the shared folder, keeps the better of what is known and what the part's trie finds.

Defined cases: a null url, or one without ://, has empty host and path, and no rule fits it; ports and user
names stay part of the host as the contract's text rule has it; a null page_id is kept; repeated rows give repeated results; other columns
of pages are dropped by `judge_pages`, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import ASCII_LOWER, shared_dir, stored

MAX_RULES = 1_000_000


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[cut:]
    end = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:cut].translate(ASCII_LOWER), tail[:end]


class UrlTrie:
    """Host nodes: label -> node. A host node's path trie: segment -> node, and rules whose last, open segment is a prefix.

    A node's open segments stand by their length, the longest first, so a segment is looked up once a length, however many rules a node has.
    """

    __slots__ = ("hosts", "paths", "n_rules")

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.hosts: dict = {}
        self.n_rules = 0
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"a rule's verdict is allow or block, not {verdict!r}")
            self.n_rules += 1
            node = self.hosts
            for label in reversed(host.translate(ASCII_LOWER).split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})  # the path trie that hangs below this host
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            open_ = node.setdefault(None, {})
            if len(last) not in open_:
                node[None] = open_ = dict(sorted([*open_.items(), (len(last), {})], reverse=True))
            open_[len(last)][last] = (host.translate(ASCII_LOWER) + path, verdict)

    @staticmethod
    def _path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for i, segment in enumerate(segments):
            best = next((fits[start] for n, fits in node.get(None, {}).items() if n <= len(segment) and (start := segment[:n]) in fits), best)
            if i + 1 == len(segments) or segment not in node:  # the last segment is open: no rule may go past it
                break
            node = node[segment]
        return best

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest rule that fits, or two Nones."""
        return self.measured(host, path)[1:]

    def measured(self, host: str, path: str) -> tuple[int, str | None, str | None]:
        """And before them the number of its host's labels: of two rules with as many, the longer text has the longer path."""
        best, node = (0, None, None), self.hosts
        segments = path.split("/")
        for n, label in enumerate(reversed(host.split(".")) if host else (), 1):
            node = node.get(label)
            if node is None:
                break
            if None in node and (found := self._path(node[None], segments)):
                best = (n, *found)
        return best


def judge_pages(pages: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url", max_rules: int = MAX_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of pages."""
    spark, rules = pages.sparkSession, list(rules)
    kind = dict(pages.dtypes)[id_col]
    parts = [rules[i : i + max_rules] for i in range(0, len(rules), max_rules)] or [[]]
    # ids travel as text: pandas makes floats of whole numbers beside a null
    out = pages.select(F.col(f"`{id_col}`").cast("string").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    for i, part in enumerate(parts):
        out = _passed(out, spark.sparkContext.broadcast(UrlTrie(part)), first=i == 0)
        if i + 1 < len(parts):
            out = stored(out, shared_dir(spark, "urls"))
    return out.select(F.col("page_id").cast(kind).alias("page_id"), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _passed(pages: DataFrame, shared, first: bool) -> DataFrame:
    """pages with the best rule of what they carry and of one trie; of equal ones the later stands."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        for b in batches:
            parts = [split_url(u) for u in b["url"]]
            found = [trie.measured(h, p) for h, p in parts]
            if not first:
                known = [(n, None if r is None else str(r), v) for n, r, v in zip(b["labels"], b["rule"], b["verdict"], strict=True)]
                found = [f if (f[0], len(f[1] or "")) >= (k[0], len(k[1] or "")) else k for f, k in zip(found, known, strict=True)]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "host": [h for h, _ in parts], "path": [p for _, p in parts], "labels": [n for n, _, _ in found], "rule": [r for _, r, _ in found], "verdict": [v for _, _, v in found]}, dtype=object)

    return pages.mapInPandas(judge, "page_id string, url string, host string, path string, labels int, rule string, verdict string")
