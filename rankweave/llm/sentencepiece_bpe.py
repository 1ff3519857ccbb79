"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

For every prefix of a text there is one last token that its encoding ends in. The table is filled left to right: an
automaton over the vocabulary gives all tokens that end at a position; the one that counts is the one that may follow the last token
of the prefix before it, which a pair-compatibility test decides: two tokens may stand side by side when merging
their joined text gives the two again. Ids are then recovered backwards, from the whole text's last token to the prefix before it,
and so on.

Characters that no token holds are unknown: they are byte-fallback tokens (or the unknown id where the model has none).
A text is cut first wherever two neighbouring characters stand together in no token: no token can reach over the cut, so
parts are encoded on their own, and parts seen before are looked up in a cache of bounded size.

Merging in the pair test follows the library: the best score first, the leftmost of equals; its outcome is kept per pair.

Defined cases: a null or empty text is the end id alone and decodes to the empty text; ids out of range raise an error;
a null or repeated doc_id is kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MAX_CACHED = 400_000
MAX_CACHED_CHARS = 64
MAX_PAIRS = 2_000_000


class _Known(dict):
    """Ids of words (what stands between two spaces) with the mark before them; emptied when `MAX_CACHED` are kept."""

    def __init__(self, bpe: PrefixTableBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self.bpe._encode_part(MARK + word)
        if len(word) <= MAX_CACHED_CHARS:
            if len(self) >= MAX_CACHED:
                self.clear()
            self[word] = found
        return found


class PrefixTableBpe:
    def __init__(self, model_path: str):
        import sentencepiece

        # the library reads the model file; encoding and decoding are done here
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.eos, self.unk = sp.eos_id(), sp.unk_id()
        self.unk_surface = sp.decode([self.unk]) if self.unk >= 0 else ""
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_ids: dict[int, int] = {}
        self.out_bytes: list[bytes | None] = [None] * n  # of tokens that are single bytes
        self.control: set[int] = set()
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.out_bytes[i] = bytes([int(p[3:5], 16)])
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.control.add(i)
            else:
                self.ids[p] = i
                self.score[p] = sp.get_score(i)
        self.surface = ["" if i in self.control or b is not None else p.replace(MARK, " ") for i, (p, b) in enumerate(zip(self.pieces, self.out_bytes, strict=True))]
        # how the model prepares a text, found by asking the library
        self.dummy_prefix = sp.encode("a", out_type=str)[0].startswith(MARK)
        self._check_plain(sp)
        self.table = [b if b is not None else (self.unk_surface if i == self.unk else x).encode("utf-8") for i, (x, b) in enumerate(zip(self.surface, self.out_bytes, strict=True))]
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known = _Known(self)
        together = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        # MARK stands after no other character inside a token: texts are cut before it
        self.cut_before_mark = all(x == MARK * 2 for x in together if x[1] == MARK)
        self.part = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+") if self.cut_before_mark else None
        self.plain_words = self.cut_before_mark and self.dummy_prefix
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) == 1 or self._merge(p) == [p]:  # a token that merging never makes is in no encoding
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()

    @staticmethod
    def _check_plain(sp) -> None:
        if sp.encode("  a  b\tcéﬁ", out_type=str) and sp.decode(sp.encode(" a  ﬁé")) != " a  ﬁé":
            raise ValueError("the model normalizes texts; only models that take them as they are are supported")

    # merging, for the pair test: on one or two tokens' text, so a few dozen characters
    def _merge(self, text: str) -> list[str]:
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, pair: tuple[str, str]) -> bool:
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        found = self.pairs[pair] = self._merge(pair[0] + pair[1]) == [*pair]
        return found

    def _table(self, text: str) -> list[str]:
        """A text's tokens; a character that no token ends in stands alone."""
        last: list[str | None] = [None] * (len(text) + 1)
        pairs = self.pairs
        done = 0
        for end, token in self.automaton.iter(text):
            # matches come by end, the longest first
            while done < end:
                done += 1
                if last[done] is None:
                    last[done] = text[done - 1]
            end += 1
            if last[end] is None:
                start = end - len(token)
                if start:
                    pair = (last[start], token)
                    fits = pairs.get(pair)
                    if fits is None:
                        fits = self._may_follow(pair)
                    if not fits:
                        continue
                last[end] = token
                done = end
        for i in range(done + 1, len(text) + 1):
            last[i] = last[i] or text[i - 1]
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= len(last[at])
        out.reverse()
        return out

    def _ids_of(self, token: str) -> list[int]:
        i = self.ids.get(token)
        if i is not None:
            return [i]
        if self.byte_ids:
            return [self.byte_ids[b] for b in token.encode("utf-8")]
        return [self.unk]

    def _encode_part(self, part: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self._ids_of, self._table(part))))

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without begin and end ids."""
        if not text:
            return []
        if self.plain_words and MARK not in text and "  " not in text and text[0] != " ":
            return list(chain.from_iterable(map(self.known.__getitem__, text.split(" "))))
        text = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        return list(chain.from_iterable(map(self._encode_part, self.part.findall(text) if self.part else [text])))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control tokens vanish, the mark that the encoder puts first is taken off, bytes become characters."""
        surface = self.surface
        if not ids:
            return ""
        if min(ids) < 0 or max(ids) >= len(surface):
            raise IndexError("an id is out of range")
        raw_text = b"".join(map(self.table.__getitem__, ids))
        try:  # pieces are whole characters: all bytes together are sound just when each run of byte tokens is
            text = raw_text.decode("utf-8")
        except UnicodeDecodeError:
            return self._decode_unsound(ids)
        lead = next((i for i in ids if i not in self.control or i == self.unk), None)
        return text[1:] if self.dummy_prefix and lead is not None and surface[lead][:1] == " " else text

    def _decode_unsound(self, ids: list[int]) -> str:
        surface, raw = self.surface, self.out_bytes
        out: list[str] = []
        pending = bytearray()
        first = self.dummy_prefix
        for i in ids:
            b = raw[i]
            if b is not None:
                pending += b
                first = False
                continue
            if pending:
                out.append(_text_of(pending))
                pending = bytearray()
            if i in self.control:
                if i == self.unk:
                    out.append(self.unk_surface)
                    first = False
                continue
            s = surface[i]
            if first:
                s = s.removeprefix(" ")
                first = False
            out.append(s)
        if pending:
            out.append(_text_of(pending))
        return "".join(out)


def _text_of(raw: bytearray) -> str:
    """Bytes as UTF-8; each byte that is part of no character is one replacement character."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode("utf-8"))
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_LOADED: dict[str, PrefixTableBpe] = {}


def loaded(model_path: str) -> PrefixTableBpe:
    """One encoder a Python worker, with what it has cached."""
    if model_path not in _LOADED:
        _LOADED[model_path] = PrefixTableBpe(model_path)
    return _LOADED[model_path]


def encode_documents(docs: DataFrame, model_path: str, add_eos: bool = True, digests: bool = False) -> DataFrame:
    """(doc_id, ids, decoded) of each row, or n_tokens and the digests of both in their place: no ids then leave the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(model_path)
        text_of = [str(i) for i in range(len(bpe.pieces))]
        sha = hashlib.sha256
        for b in batches:
            rows = []
            for text in b["_t"].tolist():
                ids = bpe.encode(text)
                if add_eos:
                    ids.append(bpe.eos)
                back = bpe.decode(ids)
                rows.append((len(ids), sha(" ".join([text_of[i] for i in ids]).encode()).hexdigest(), sha(back.encode("utf-8", "surrogatepass")).hexdigest()) if digests else (ids, back))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])
            out.insert(0, "doc_id", b["_id"].values)
            yield out

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.col("doc_id").cast("string").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id string, ids array<int>, decoded string"
    return rows.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(kind))
