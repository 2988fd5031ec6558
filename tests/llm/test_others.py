"""Operators 4, 6, 8 and 10."""

import hashlib
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ontoloom.llm.chat import format_conversations, read_back, text_under
from ontoloom.llm.decontamination import contamination
from ontoloom.llm.pseudonyms import Pseudonyms, _luhn, pseudonymised
from ontoloom.llm import decontamination
from ontoloom.llm.toxicity import CHANCE, Index, Numbers, isotonic, toxicity_scores, without_toxic, words_of


# --- 4 -----------------------------------------------------------------------------------------
def plain_contamination(docs, items):
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    out = {}
    for d, t in docs:
        w, hit, found = cut(t), set(), set()
        for i, b in items:
            b = cut(b)
            n = min(13, len(b))
            for j in range(len(b) - n + 1 if b else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == b[j : j + n]:
                        hit.update(range(p, p + n))
                        found.add(str(i))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def test_winnowing_misses_nothing(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("ab cd ef gh é 12 zz Yy".split())
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 3, 12, 13, 14, 30])))) for k in range(14)] + [(50, None), (51, "!!"), (52, "same same " * 10)]
    docs = []
    for k in range(40):
        text = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            b = items[rng.randrange(14)][1].split()
            at, low = rng.randint(0, len(text)), rng.randint(0, max(0, len(b) - 13))
            text[at:at] = b[low : low + rng.randint(11, 20)]
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(text)))
    docs += [(100, None), (101, ""), (102, "same " * 40), (103, "...")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("extra"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(d, b).collect()}
    assert got == plain_contamination(docs, items)
    assert contamination(d.limit(0), b).count() == 0
    assert {r.n_hit for r in contamination(d, b.limit(0)).collect()} == {0}


def test_hits_belong_to_texts(spark, monkeypatch):
    """Rows without doc_id, with one id and with one text, and a long text; once by broadcast, once by
    shuffles."""
    passage = " ".join(f"w{k}" for k in range(30))
    long = "x y " * 60_000 + passage
    docs = [(None, passage), (None, "clean text"), (5, "a b c"), (5, passage), (5, passage), (6, "w3 w4"), (7, long), (8, None)]
    items = [(1, passage), (2, "w3 w4"), (2, "clean")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"text_key": F.lit(1), "words": F.lit(2), "hash": F.lit(3)})
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("hashes", F.lit(1))
    for limit in (None, 0):
        if limit is not None:
            for name in ("BROADCAST_FINGERPRINTS", "BROADCAST_HITS"):
                monkeypatch.setattr(decontamination, name, limit)
        got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in contamination(d, b).collect())
        assert got == Counter([(None, 30, 30, 2, True), (None, 2, 1, 1, True), (5, 3, 0, 0, False), (5, 30, 30, 2, True), (5, 30, 30, 2, True), (6, 2, 2, 1, True), (7, 120_030, 30, 2, False), (8, 0, 0, 0, False)])


# --- 6 -----------------------------------------------------------------------------------------
def test_permutation_is_one_to_one():
    p = Pseudonyms(b"k")
    for n in (1, 2, 7, 10, 97, 1000):
        assert sorted(p.permute(x, n, "t") for x in range(n)) == list(range(n))


def test_formats_stay(spark):
    p = Pseudonyms(b"key")
    text = "card 4041894974608795 or 4041-8949-7460-8795, +1 (988) 555-2485, 10.0.0.1, born 1980-02-29, on 29/02/1980, mail a.b1@x.example.com, GB82 WEST 1234 5698 7654 32"
    new, kinds = p.replace(text)
    assert kinds == ["card", "card", "phone", "ip", "date", "date", "mail", "iban"]
    assert [c if not c.isalnum() else "x" for c in new[:50]] == [c if not c.isalnum() else "x" for c in text[:50]]
    a, b = re.search(r"card (\d+) or ([\d-]+)", new).groups()
    assert a == b.replace("-", "") and a != "4041894974608795" and _luhn(a[:-1]) == a[-1]
    iso, (d, m, y) = re.search(r"born ([\d-]+)", new)[1], re.search(r"on (\d+)/(\d+)/(\d+)", new).groups()
    assert iso == f"{y}-{m}-{d}"
    iban = re.search("GB.*", new)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban[4:8] == "WEST"
    assert p.replace(text) == (new, kinds) and Pseudonyms(b"other").replace(text)[0] != new
    for same in ("no values", "4041894974608796", "999.1.1.1", "2023-02-30", "", None, "000 000 0000", "111-111-1111", "1899-12-31"):
        assert p.replace(same) == (same, [])
    rows = [(1, text, 3), (2, None, 3), (3, "", 3), (1, text, 3)]
    out = pseudonymised(spark.createDataFrame(rows, "doc_id long, text string, n_values int"), b"key").collect()
    assert sorted((r.doc_id, r.n_values) for r in out) == [(1, 8), (1, 8), (2, 0), (3, 0)]
    assert pseudonymised(spark.createDataFrame([], "doc_id long, text string"), b"key").count() == 0


def test_back_with_the_key(spark):
    """Every value of every document comes back, and equal values have one pseudonym."""
    there, back = Pseudonyms(b"key"), Pseudonyms(b"key", back=True)
    for n in (1, 2, 7, 10, 97, 1000):
        assert [back.permute(there.permute(x, n, "t"), n, "t") for x in range(n)] == list(range(n))
    values = {
        "mail": ["a.b1@x.example.com", "Z9@q.org"], "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"], "ip": ["10.0.0.1", "255.255.255.255"],
        "iso": ["1980-02-29", "2099-12-31"], "day": ["29/02/1980", "01.01.1900"], "ssn": ["123-45-6789", "899-99-9999"],
        "card": ["4041894974608795", "3782 822463 10005"], "phone": ["+1 (988) 555-2485", "555.123.4567", "+4412345678"],
    }
    for kind, own in values.items():
        for v in own:
            new = there._replaced(kind, v)
            assert new is not None and back._replaced(kind, new) == v and (len(new) == len(v) or kind == "ip"), (kind, v, new)
    path = "/root/testdata/sf0.001/documents.parquet"
    pairs, shapes = {}, lambda t: re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", t)))
    n = 0
    for r in spark.read.parquet(path).collect() if os.path.exists(path) else []:
        text = r.text or ""
        new, kinds = there.replace(text)
        assert "ip" in kinds or shapes(new) == shapes(text)
        old, same = back.replace(new)
        assert (old, same) == (text, kinds)
        n += len(kinds)
        for a, b in zip(re.findall(r"[\w.+-]+@[\w.-]+|\d[\d -]{11,}\d", text), re.findall(r"[\w.+-]+@[\w.-]+|\d[\d -]{11,}\d", new)):
            assert pairs.setdefault(a, b) == b
    assert n or not os.path.exists(path)


def test_columns_and_long_texts_of_pseudonyms(spark):
    rows = [(1, "x " * 100_000 + "10.0.0.1", "k"), (1, "10.0.0.1", "k"), (None, "10.0.0.1", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kinds string").withColumn("row", F.lit(1))
    out = pseudonymised(df, b"key").collect()
    assert [r.n_values for r in out] == [1, 1, 1] and len({r.text.split()[-1] for r in out}) == 1 and out[0].row == 1


def test_neighbouring_numbers():
    """Values beside other numbers are found, and are what they are elsewhere."""
    p = Pseudonyms(b"key")
    cards = ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "378282246310005", "3782 822463 10005"]
    for card in cards:
        new = p.replace(card)[0]
        for before, after in (("", " 12/27"), ("", " 123"), ("12 ", ""), ("12-", ""), ("", "-123"), ("7 1234 ", " 99 2024")):
            assert p.replace(before + card + after) == (before + new + after, ["card"]), before + card + after
    # Some of these are valid as longer cards.
    for n in range(1000):
        assert p.replace(f"4111111111111111 {n:03d}") == (p.replace(cards[0])[0] + f" {n:03d}", ["card"])
        assert p.replace(f"{n:03d} 4111111111111111")[0] == f"{n:03d} " + p.replace(cards[0])[0]
    a, b = (p.replace(x)[0] for x in ("555-123-4567", "555-987-6543"))
    assert p.replace("555-123-4567 2024") == (f"{a} 2024", ["phone"])
    assert p.replace("555-123-4567 555-987-6543") == (f"{a} {b}", ["phone", "phone"])
    assert p.replace("2024 555-123-4567") == (f"2024 {a}", ["phone"])
    for iban in ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00"):
        new = p.replace(iban)[0]
        for after in (" 1234", " ABCD 12", " EUR"):
            assert p.replace(iban + after) == (new + after, ["iban"])
    assert p.replace("AB12 4111 1111 1111 1111") == ("AB12 " + p.replace(cards[1])[0], ["card"])
    assert p.replace("4111 1111-1111 1111 12")[1] == ["card"]
    long = "1 2 " * 20_000
    assert len(p.replace(long)[0]) == len(long)


# --- 8 -----------------------------------------------------------------------------------------
def test_chat_is_read_back(spark):
    odd = ["\\### Assistant: </turn> ok", "<+>", "\\h\\l\\b\\c", "</turn>\n", "", None, "plain", "a: b", "日本\n### user: x"]
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a: #<", None]), rng.choice(odd), 9) for c in range(25) for t in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "hi", 9), (3, None, "assistant", "first", 9), rows[0]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    out = format_conversations(df).select("conv_id", "formatted", read_back(F.col("formatted")).alias("t"), text_under(F.col("formatted"), F.col("loss_spans")).alias("loss"), "loss_spans")
    got = {r.conv_id: r for r in out.collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=key)
        assert [(t.role, t.text) for t in got[c].t] == [(r[2] or "", r[3] or "") for r in own]
        assert got[c].loss == "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c].formatted.count("</turn>") == sum(i == 0 or (own[i][2] or "") != (own[i - 1][2] or "") for i in range(len(own)))
    assert format_conversations(df.limit(0)).count() == 0


def test_long_conversation(spark):
    """Spans of many turns, merged and not, of a long text and of an empty one."""
    rows = [(1, k, "assistant" if k % 3 else "user", "x" * (k % 7)) for k in range(700)] + [(1, 700, "assistant", "#y" * 200_000)]
    out = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("loss_spans", text_under(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.size(read_back(F.col("formatted"))).alias("n")).first()
    own = [t for _, _, r, t in rows if r == "assistant"]
    assert out.loss == "".join(own) and out.n == 701 and len(out.loss_spans) == len(own)


# --- 10 ----------------------------------------------------------------------------------------
def test_index_is_exact():
    rng = np.random.default_rng(0)
    make = lambda: (lambda w: (np.sort(rng.choice(40, len(w), replace=False)), w / np.linalg.norm(w)))(rng.random(rng.integers(1, 6)))
    vectors = [make() for _ in range(500)]
    dense = np.zeros((500, 40))
    for e, (t, w) in enumerate(vectors):
        dense[e, t] = w
    queries, without = [make() for _ in range(90)], [int(x) for x in rng.integers(-1, 500, 90)]
    for share in (0.0, 0.08, 1.0):  # all words are rows, some, none
        index = Index(vectors, 40, k=7, block=16, share=share)
        for (t, w), own, (found, cosines) in zip(queries, without, index.nearest(queries, without)):
            cosine = dense[:, t] @ w
            want = sorted((-round(float(c), 12), e) for e, c in enumerate(cosine) if c > 0 and e != own)[:7]
            assert [e for _, e in want] == found.tolist() and np.allclose([-c for c, _ in want], cosines, atol=1e-11)


def test_numbers_are_the_words():
    rng = random.Random(12)
    words = {w: i for i, w in enumerate(["vile", "nasty", "éa", "ab", "日本"])}
    numbers, texts = Numbers(pa.array(list(words))), []
    for _ in range(300):
        text = "".join(rng.choice(["vile", "NAST", "y", "éa", "ab", " ", "\n", "1", "_", "-", "²", "日本"]) for _ in range(rng.randint(0, 12)))
        texts.append(text)
    for text, (found, times) in zip(texts, numbers.of(texts)):
        plain = Counter(re.findall(r"[^\W\d_]+", text.lower()))
        assert words_of(text) == plain
        assert dict(zip(found.tolist(), times.tolist())) == {words[w]: n for w, n in plain.items() if w in words}
    assert numbers.of(["", "?"])[1][0].tolist() == [] and Numbers(pa.array([], pa.string())).of(["vile"])[0][0].tolist() == []


def test_isotonic():
    x, y = isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert all(a <= b for a, b in zip(y, y[1:])) and 0 < y[0] and y[-1] < 1


def toxic_table(n=600):
    rng = random.Random(9)
    common = ["".join(rng.choice("abcdehil") for _ in range(4)) for _ in range(60)]
    rows, labels = [], []
    for k in range(n):
        words, toxic = [rng.choice(common) for _ in range(30)], k % 5 == 0
        if toxic:
            words[rng.randrange(30)] = "vile"
            words[rng.randrange(30)] = rng.choice(["nastyone", "nastytwo"])
        rows.append((k, " ".join(words), "x"))
        labels.append((k, int(toxic)))
    return rows, labels


def plain_scores(docs, labels, k):
    """The whole of it by sums over all examples."""
    n, df = len(docs), Counter(w for _, t, _ in docs for w in words_of(t or ""))
    df = Counter()
    for _, t, _ in docs:
        df.update(words_of(t or "").keys())
    known, examples = dict(labels), {}
    for d, t, _ in docs:
        if d in known:
            examples.setdefault(t or "", []).append(known[d])
    examples = {t: sum(y) / len(y) >= 0.5 for t, y in examples.items()}
    n1, counts = sum(examples.values()), {w: [0, 0] for t in examples for w in words_of(t)}
    sizes = (len(examples) - n1, n1)
    for t, y in examples.items():
        for w in words_of(t):
            counts[w][y] += 1

    def telling(w):
        out, has = 0.0, sum(counts[w])
        for own, size in zip(counts[w], sizes):
            for seen, all_ in ((own, has), (size - own, len(examples) - has)):
                out += 2 * seen * math.log(seen / (all_ * size / len(examples))) if seen else 0
        return out

    weight = {w: (math.log((1 + n) / (1 + df[w])) + 1) * (1 + max(0.0, telling(w) - CHANCE)) for w in counts}

    def vector(t):
        v = {w: (1 + math.log(c)) * weight[w] for w, c in words_of(t).items() if w in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors = {t: vector(t) for t in examples}
    lead = lambda t: max(((c, w) for w, c in words_of(t).items()), default=(0, ""))[1]
    order = sorted(examples, key=lambda t: (lead(t), examples[t], hashlib.sha256(t.encode()).digest()))

    def vote(t):
        v = vector(t)
        if not v:
            return None
        near = sorted((-round(sum(x * vectors[e].get(w, 0.0) for w, x in v.items()), 12), i) for i, e in enumerate(order) if e != t)[:k]
        near = [(c * c, examples[order[i]]) for c, i in near if c]
        return sum(p * y for p, y in near) / sum(p for p, _ in near)

    prior = (n1 + 0.5) / (len(examples) + 1)
    held = [t for t in order if vectors[t]]
    knots = isotonic(np.array([vote(t) for t in held]), np.array([float(examples[t]) for t in held]))
    bare = [examples[t] for t in order if not vectors[t]]
    base = (sum(bare) + prior) / (len(bare) + 1)
    return {d: base if (v := vote(t or "")) is None else float(np.interp(v, *knots)) for d, t, _ in docs}


def test_toxicity_by_brute_force(spark):
    docs, labels = toxic_table(260)
    docs += [(900, None, "x"), (901, "", "x"), (902, docs[3][1], "x"), (903, docs[5][1], "x"), (904, "unknown", "x"), (905, "vile " * 40_000, "x")]
    labels += [(901, 0), (903, 0)]
    known = [(d, y) for d, y in labels if d % 4 != 1]
    df = spark.createDataFrame(docs, "doc_id long, text string, row string").withColumns({"score": F.lit(1), "toxic": F.lit("?")}).repartition(5)
    got = {r.doc_id: r for r in toxicity_scores(df, spark.createDataFrame(known, "doc_id long, toxic int"), k=9).collect()}
    want = plain_scores(docs, known, 9)
    assert got.keys() == want.keys()
    assert all(abs(got[d].score - want[d]) < 1e-9 for d in want), [(d, got[d].score, want[d]) for d in want if abs(got[d].score - want[d]) > 1e-9][:5]
    assert all(len(r.evidence) == 3 for d, r in got.items() if d < 260)
    assert not any(e.doc_id == d for d, r in got.items() for e in r.evidence)


def test_toxicity_held_out(spark):
    rows, labels = toxic_table()
    rows += [(900, None, "x"), (901, "", "x"), (0, rows[0][1], "x"), (None, rows[0][1], "x"), (None, rows[1][1], "x"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _lost string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity_scores(df, known.where("doc_id < 400")).collect()
    got = {r.doc_id: r.score for r in found if r.doc_id is not None}
    assert len(found) == len(rows) and len(got) == 602 and all(0 <= s <= 1 for s in got.values())
    truth = dict(labels)
    right = [(got[k] >= 0.3) == bool(truth[k]) for k in range(400, 600)]
    assert sum(right) >= 196 and got[900] < 0.3 and got[901] < 0.3
    stay = without_toxic(df, known.where("doc_id < 400"))
    assert stay.columns == df.columns and stay.where("doc_id IN (900, 901)").count() == 2
    assert stay.where("doc_id IS NULL").count() == 2
    nothing = toxicity_scores(df, known.limit(0))
    assert {r.score for r in nothing.collect()} == {0.5}
    assert toxicity_scores(df.limit(0), known).count() == 0
