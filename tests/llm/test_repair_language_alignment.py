"""Conversation repair, language identification and token alignment against brute force."""

import hashlib
import heapq
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rankweave.llm import conversation_repair, language_id, queries, token_alignment

DATA = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def crowded(df):
    """df with columns of names that the operators use inside."""
    for c in ("key", "at", "sign", "copy", "kind", "salt", "n", "signature", "packet", "pair", "place", "_t", "_id", "_h"):
        df = df.withColumn(c, F.lit("extra"))
    return df


# --- conversation repair -------------------------------------------------------------------------------------------

def cheapest(rows):
    """Cheapest (cost, audit) of [(initial, fault)] by search over all edit strings in order of cost."""
    fits = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    heap, found = [(0, "", 0, "")], None
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if found and cost > found[0]:
            return found
        if i == len(rows) and last in ("", "a") and (found is None or audit < found[1]):
            found = cost, audit
        if cost > 3 * len(rows):
            continue
        for x in "ua":
            if (last, x) in fits:
                heapq.heappush(heap, (cost + 2, audit + "I", i, x))
        if i < len(rows):
            initial, fault = rows[i]
            late = int(fault == "truncated")
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last))
            if fault not in ("blank", "duplicate"):
                if (last, initial) in fits:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, initial))
                for x in "ua":
                    if (last, x) in fits:
                        heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, x))
    return found


def test_each_short_signature_gets_its_cheapest_repair():
    faults = ["", "truncated", "blank", "duplicate"]
    rng = random.Random(3)
    for n in range(7):
        for _ in range(1 if n == 0 else 40):
            rows = [(rng.choice("suao"), rng.choice(faults[:3] + [""] * 3)) for _ in range(n)]
            sign = "".join(conversation_repair.SIGNS[4 * faults.index(f) + "suao".index(r)] for r, f in rows)
            assert conversation_repair.solve(sign) == cheapest(rows), sign


def test_a_long_signature_needs_no_deep_recursion():
    assert conversation_repair.solve("ua" * 30_000) == (0, "K" * 60_000)
    assert conversation_repair.solve("u" * 3001)[0] == 2 * 1500 + 2


def damaged(rows):
    """The contract's damage, row by row, on (conv_id, turn, role, text)."""
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        lot = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        out += [(conv, turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    return out


def audited(rows):
    """The contract's columns of each conversation; rows of one turn must be alike."""
    own = defaultdict(list)
    for r in damaged(rows):
        own[r[0]].append(r[1:])
    out = []
    for conv in {r[0] for r in rows}:
        x = sorted(own[conv], key=lambda r: (r[0] is not None, r[0]))
        turns = [t for t, _, _ in x if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, role, text in x:
            solid = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in x]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest([(i if i in ("s", "u", "a") else "o", f) for i, f in zip(initials, faults)])
        lines, last, it = [], "", iter(x)
        for e in audit:
            turn = "a" if last == "u" else "u"
            if e == "I":
                lines.append({"u": "user:", "a": "assistant:"}[turn])
                last = turn
                continue
            _, role, text = next(it)
            if e == "R":
                role = {"u": "user", "a": "assistant"}[turn]
            if e != "D":
                lines.append(f"{role}:{text}")
                last = role[:1]
        n = Counter(faults)
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def made_up(seed, n=120):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(0, 7)):
            role = rng.choice(["system" if not turn else "tool", "user", "assistant", "user", "assistant", "ünder", "", None])
            text = rng.choice([f"words {rng.random()}.", "same.", "no end", None, "", " \n\t", "ends! \x0b", "x\x1c"])
            rows.append((conv, None if turn == 3 and rng.random() < 0.3 else turn, role, text))
    return rows


@pytest.mark.parametrize("salted", [False, True])
def test_conversations_get_the_contracts_figures(spark, monkeypatch, salted):
    monkeypatch.setattr(conversation_repair, "HOT_SHARE", 1000 if salted else 0)
    rows = made_up(7)
    df = crowded(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = conversation_repair.audit_conversations(conversation_repair.damage(df), df)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(audited(rows), key=repr)
    assert got.schema.simpleString().startswith("struct<conv_id:bigint,gaps:bigint,blank:bigint")


def test_conversations_of_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op11_conversation_repair"](spark, DATA)
    assert sorted(map(tuple, got.collect())) == sorted(audited(rows))


def test_repaired_rows_are_what_the_digest_is_of(spark):
    rows = made_up(8, 40)
    df = conversation_repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    texts = defaultdict(list)
    for r in sorted(conversation_repair.repair_conversations(df).collect(), key=lambda r: r["place"]):
        texts[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for r in conversation_repair.audit_conversations(df).collect():
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(texts[r["conv_id"]]).encode()).hexdigest()
        initials = "".join(x[0] for x in texts[r["conv_id"]])
        assert re.fullmatch("(s?(ua)+)?", initials)


def test_a_very_long_conversation_and_none(spark):
    n = 20_000
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"text {i}.") for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    [got] = conversation_repair.audit_conversations(df).collect()
    assert (got["audit"], got["gaps"]) == ("K" * n, 0)
    assert got["repaired_sha256"] == hashlib.sha256("\n".join(f"{r[2]}:{r[3]}" for r in rows).encode()).hexdigest()
    assert conversation_repair.audit_conversations(df.limit(0)).collect() == []
    assert conversation_repair.repair_conversations(df.limit(0)).collect() == []


# --- language identification ---------------------------------------------------------------------------------------

SOUNDS = {"xa": "ka ro mi tu", "xb": "ble thing er sh", "xc": "été oux lai que", "xd": "ung ich der sch", "xe": "zło czy prz ow", "xf": "ος και την μπ", "xg": "что ный ост пр", "xh": "mba nga kwa wa", "xi": "ää yö kko llä"}


def spoken(lang, rng, n):
    return " ".join("".join(rng.choice(SOUNDS[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def spoken_docs(spark, langs, seed=1, each=60):
    rng = random.Random(seed)
    rows = [(i, spoken(langs[i % len(langs)], rng, rng.randint(3, 60)), langs[i % len(langs)]) for i in range(each * len(langs))]
    return crowded(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


@pytest.mark.parametrize("n", [2, 4, 9])
def test_held_out_languages_are_told_apart(spark, n):
    docs = spoken_docs(spark, list(SOUNDS)[:n])
    model = language_id.fit(docs, held_out=1, folds=3)
    assert model.apart >= (1 if n == 2 else 2)
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    want = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i in want if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["lang_pred"] == want[i] for i in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_a_wrong_bit_is_corrected():
    """Decoding outvotes one flipped bit: codewords of four languages differ in four of seven bits."""
    code = language_id.codewords(4)
    assert code.shape == (4, 7) and language_id.least_distance(code) == 4
    m = language_id.Model(tuple("abcd"), code, np.zeros((language_id.BUCKETS, 7)), np.tile([1.0, 0.0], (7, 1)), np.ones(7), 4)
    for lang in range(4):
        for bit in range(7):
            x = 2.0 * code[lang].copy()
            x[bit] *= -1
            loss, _ = m.losses(x[None])
            assert loss[0].argmin() == lang
    big = language_id.codewords(40)
    assert len({tuple(r) for r in big}) == 40 and language_id.least_distance(big) >= 15
    assert not (np.abs(big.sum(0)) == 40).any()


def test_losses_are_the_weighted_sum_over_bits():
    rng = np.random.default_rng(0)
    code = language_id.codewords(5)
    m = language_id.Model(tuple("abcde"), code, np.zeros((1, 15)), rng.normal(1, 0.1, (15, 2)), rng.uniform(0.5, 1.5, 15), 8)
    x = rng.normal(0, 3, (6, 15))
    loss, logit = m.losses(x)
    for i in range(6):
        for k in range(5):
            assert loss[i, k] == pytest.approx(sum(w * np.log1p(np.exp(-c * z)) for w, c, z in zip(m.weight, code[k], logit[i])))


def test_ngrams_ignore_case_digits_and_the_cut_into_pieces(monkeypatch):
    same = lambda a, b: sorted(language_id.grams(a)[0]) == sorted(language_id.grams(b)[0])
    assert same("Ab cd", "aB, 12 CD!") and not same("ab cd", "abcd")
    assert language_id.grams("12 !?")[1] == 0
    text = "some words, and more of them. " * 200
    whole, _ = language_id.grams(text)
    monkeypatch.setattr(language_id, "PIECE", 100)
    parts = np.concatenate([language_id.grams(p)[0] for p in language_id.pieces(text)])
    assert "".join(language_id.pieces(text)) == text
    assert len(set(whole.tolist()) - set(parts.tolist())) <= 60  # only those over a border are counted otherwise


def test_texts_without_letters_or_models(spark):
    docs = spoken_docs(spark, ["xa", "xb"])
    odd = spark.createDataFrame([(None, "ka ro mi"), (1, None), (2, ""), (3, "12 .. 7"), (4, "karo " * 300_000), (4, "karo")], "doc_id long, text string")
    got = language_id.identify(odd, language_id.fit(docs)).collect()
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in got) == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "xa"), ("4", "xa"), ("None", "xa")]
    one = language_id.fit(docs.where("lang = 'xb'"))
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(odd, one).collect()} == {("und", 0.0), ("xb", 1.0)}
    none = language_id.fit(docs.limit(0))
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(odd, none).collect()} == {("und", 0.0)}
    assert language_id.identify(odd.limit(0), none).collect() == []


def test_the_sample_is_bounded(spark):
    docs = spoken_docs(spark, ["xa", "xb"], each=200).withColumn("doc_id", F.lit(None).cast("long"))
    docs = docs.unionByName(docs.where("lang = 'xa'").limit(1).withColumn("n", F.explode(F.array_repeat(F.lit("x"), 500))))
    n = {r["lang"]: r["count"] for r in language_id._sample(docs, 1, 3, 30).groupBy("lang").count().collect()}
    assert n.get("xa", 0) <= 30 and n.get("xb", 0) <= 30 and sum(n.values()) > 0


def test_ambiguous_texts_are_flagged(spark):
    docs = spoken_docs(spark, ["xa", "xb", "xc", "xd"])
    mixed = spark.createDataFrame([(1, "karo mitu roka mitu " * 9 + "schung ichder ungsch deric " * 9), (2, "karo mitu roka " * 20)], "doc_id long, text string")
    got = {r["doc_id"]: r["ambiguous"] for r in language_id.identify(mixed, language_id.fit(docs)).collect()}
    assert not got[2]


def test_languages_of_the_tables(spark):
    got = queries.QUERIES["op12_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.where("held_out").join(docs, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98


# --- token alignment -----------------------------------------------------------------------------------------------

def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    from rankweave.llm.packing import byte_alphabet

    a, b, alphabet = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_alphabet()
    a.encode_special_tokens = True
    docs = []
    for t in texts:
        ids = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        left = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids[0]]
        right = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        raw = (" " + t).encode() if t else b""
        if b"".join(left) != raw or b"".join(right) != raw:
            ids, left, right = ([], []), [], []
        groups, i, j = [], 0, 0
        while i < len(left):
            x, y = [i], [j]
            p, q = len(left[i]), len(right[j])
            while p != q:
                if p < q:
                    x.append(x[-1] + 1)
                    p += len(left[x[-1]])
                else:
                    y.append(y[-1] + 1)
                    q += len(right[y[-1]])
            groups.append(([ids[0][k] for k in x], [ids[1][k] for k in y]))
            i, j = x[-1] + 1, y[-1] + 1
        docs.append((ids, groups))
    holders = Counter(p for _, groups in docs for p in {(x, y) for g in groups for x in g[0] for y in g[1]})
    most = {}
    for (x, _), n in holders.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for ids, groups in docs:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((len(ids[0]), len(ids[1]), len(groups), len(links), sum(holders[p] == most[p[0]] for p in links), sum(holders[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


def odd_texts(seed):
    rng = random.Random(seed)
    own = [None, "", " ", "   ", "\n", "a\r\nb\r\r\n  c;\r\n};\r\n", "x ▁ y", "▁", "<|endoftext|> a</s><s><unk> <0x0A>", "a\0b", "日本語 テスト　全角 x", "😀👍🏽 ok", "\xa0a\xa0\xa0b", "  lead", "trail  ", "é é ﬁ", "ABC" * 50, "=" * 3000 + " " * 700 + "=-" * 900, "\x1c\x1d a", "it's we'll", "word " * 4000]
    bits = [*" \n\r\t;)abé{}😀日　\xa0.'1", "the ", "\r\n", "  ", "word;", "ing"]
    return own + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(150)]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_of_odd_texts(spark, monkeypatch, small):
    texts = odd_texts(5)
    if small:  # several packets, and every group by its distinct ids
        monkeypatch.setattr(token_alignment, "PACKET_CHARS", 2000)
        monkeypatch.setattr(token_alignment, "MANY_LINKS", 0)
        monkeypatch.setattr(token_alignment, "BLOCK", 1)
        v = token_alignment.loaded(A, B)
        x = token_alignment.align_texts(v, texts)
        doc, pair, n = x.pairs()
        monkeypatch.undo()
        for one, other in zip((doc, pair, n), token_alignment.align_texts(v, texts).pairs(), strict=True):
            assert (one == other).all()
        return
    df = crowded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    got = {r[0]: tuple(r)[1:] for r in token_alignment.align_documents(df, A, B, digests=True).collect()}
    assert [got[i] for i in range(len(texts))] == brute_alignment(texts)


def test_alignment_of_the_tables(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op13_token_alignment"](spark, DATA).collect()}
    assert [got[i] for i in texts] == brute_alignment(list(texts.values()))


def test_spans_and_ids_are_real_outputs(spark):
    texts = ["plain words here", "", None, "Ünïcode 😀 text"]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id string, text string")
    for r in token_alignment.align_documents(df, A, B).collect():
        assert len(r["cuts"]) == r["n_groups"] and len(r["a_ids"]) == r["n_a"] and len(r["b_ids"]) == r["n_b"]
        assert r["doc_id"] is None and r["cuts"] == sorted(r["cuts"])
    sizes = sorted(r["cuts"][-1] for r in token_alignment.align_documents(df, A, B).collect() if r["cuts"])
    assert sizes == sorted(len((" " + t).encode()) for t in texts if t)
    assert token_alignment.align_documents(df.limit(0), A, B).collect() == []
