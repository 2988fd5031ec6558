"""Operators 2, 5 and 7 against the tokenizers library, round trips and plain packing."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from ontoloom.llm.packing import best_fit_decreasing, best_fit_packing, best_two_fit, cuts, packed_matrices
from ontoloom.llm.token_counts import prefix_token_counts, prefix_within, tokens_in_prefix
from ontoloom.llm.tokens import byte_bpe, longest_prefix, prefix_counter

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "b", " ", "  ", "\n", "'re", "'ll", "'", "'s", "é", "ß", "日", "½", "²", "1", "_", ".", "　", "\xa0", "<|endoftext|>", "the", "\t", "\x1c", "🙂", "٣", "ʰ", "́"]


def library(text):
    return byte_bpe(PATH).library.encode(text, add_special_tokens=False).ids


def test_ids_and_every_prefix():
    rng = random.Random(3)
    bpe, counter = byte_bpe(PATH), prefix_counter(PATH)
    for _ in range(600):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 12)))
        assert bpe.ids(text).tolist() == library(text), repr(text)
        counts = np.cumsum(counter.deltas(text))
        for n in range(1, len(text) + 1):
            assert counts[n - 1] == len(library(text[:n])), repr(text[:n])


def test_long_run_without_spaces():
    text = "a" * 20_000 + "!" * 500
    assert byte_bpe(PATH).ids(text).tolist() == library(text)
    assert prefix_counter(PATH).deltas(text).sum() == len(library(text))


ROWS = [(1, "Hello there, world", 5), (2, None, 5), (3, "", 6), (1, "Hello there, world", 5), (None, "x", 1), (4, "many words " * 3000, 2)]


def test_counts_as_table(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, n_tokens long")
    rows = prefix_token_counts(df, PATH).collect()
    assert len(rows) == len(ROWS)
    assert sorted((r.n_tokens, r.n_bytes) for r in rows) == sorted((len(library(t or "")), len((t or "").encode())) for _, t, _ in ROWS)
    assert prefix_token_counts(df.limit(0), PATH).count() == 0
    within = {(r.doc_id, r.n_points_within) for r in prefix_token_counts(df, PATH, keep_deltas=False, budget=3).collect()}
    assert within == {(d, max(n for n in range(min(len(t or ""), 60) + 1) if len(library((t or "")[:n])) <= 3)) for d, t, _ in ROWS}
    told = prefix_token_counts(df.where("doc_id = 4"), PATH).select(tokens_in_prefix("prefix_deltas", 17).alias("a"), prefix_within("prefix_deltas", 100).alias("b")).first()
    text = ROWS[-1][1]
    assert told.a == len(library(text[:17]))
    best = max(n for n in range(0, 1500) if len(library(text[:n])) <= 100)
    assert told.b == best == longest_prefix(prefix_counter(PATH).deltas(text), 100)


def plain_two_fit(items, capacity):
    """Best-two-fit one bin at a time over a list."""
    left, bins = sorted(items, reverse=True), []
    while left:
        own, room = [], capacity
        for x in left[:]:
            if x <= room:
                own.append(x)
                left.remove(x)
                room -= x
        if room and len(own) > 1:
            gap = room + own[-1]
            fit = [x for x in left if 6 * x >= capacity]
            pairs = [(a + b, b, a) for i, a in enumerate(fit) for b in fit[i + 1 :] if own[-1] < a + b <= gap]
            if pairs:
                _, b, a = max(pairs)
                left.append(own.pop())
                left.remove(a)
                left.remove(b)
                left.sort(reverse=True)
                own += [a, b]
        bins.append(own)
    return bins


def test_two_fit_like_one_at_a_time():
    rng = random.Random(5)
    for _ in range(200):
        cap = rng.choice([10, 17, 40])
        items = [rng.randint(1, cap) for _ in range(rng.randint(0, 40))]
        got = [b for items_, n in best_two_fit(Counter(items), cap) for b in [items_] * n]
        assert Counter(x for b in got for x in b) == Counter(items)
        assert all(sum(b) <= cap for b in got)
        assert len(got) == len(plain_two_fit(items, cap))
    with pytest.raises(ValueError):
        best_two_fit({11: 1}, 10)


def test_two_fit_of_many_takes_no_longer():
    assert sum(n for _, n in best_two_fit({700: 10**9, 200: 10**9, 100: 10**9}, 1000)) == 10**9


def test_best_fit_decreasing_like_a_list():
    rng = random.Random(7)
    for _ in range(200):
        cap = rng.choice([8, 33, 64])
        items = [rng.randint(1, cap) for _ in range(rng.randint(0, 50))]
        rooms, bins = [], []
        for k in sorted(range(len(items)), key=lambda k: -items[k]):
            fit = [(r, b) for b, r in enumerate(rooms) if r >= items[k]]
            if fit:
                least = min(r for r, _ in fit)
                b = next(b for r, b in fit if r == least)
                rooms[b] -= items[k]
            else:
                bins.append(0)
                rooms.append(cap - items[k])
        got = best_fit_decreasing(items, cap)
        assert sorted(k for b in got for k in b) == list(range(len(items)))
        assert sorted(cap - sum(items[k] for k in b) for b in got) == sorted(rooms)


def test_cuts():
    assert cuts(0, 4) == [(0, 0)] and cuts(4, 4) == [(0, 4)] and cuts(9, 4) == [(0, 1), (1, 4), (5, 4)] and cuts(8, 4) == [(0, 4), (4, 4)]


def test_packing_table(spark):
    rows = [(k, "word " * (k * 7 % 900), "x") for k in range(60)] + [(1000, None, "y"), (1001, "", "z"), (5, "word " * 35, "x"), (2000, "long text " * 4000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string").repartition(3)
    out = best_fit_packing(df, PATH, capacity=256).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, text, _ in rows:
        ids = np.array(library(text or "") + [2], "<u4")
        own = sorted((r.start, r.length, r.ids_crc32, r.piece) for r in by_doc[doc])
        copies = sum(d == doc for d, _, _ in rows)
        assert own == sorted((s, n, zlib.crc32(ids[s : s + n].tobytes()), k) for k, (s, n) in enumerate(cuts(len(ids), 256)) for _ in range(copies))
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
        assert sum(r.length for r in own) <= 256
    assert len(by_sequence) == len(plain_two_fit([r.length for r in out], 256))
    assert best_fit_packing(df.limit(0), PATH).count() == 0


def test_matrices_give_every_token_back(spark):
    rows = [(k, "some words here " * (k % 40), 1) for k in range(50)] + [(90, None, 1), (91, "a b " * 3000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int")
    out = packed_matrices(df, PATH, capacity=128, block_tokens=3000).collect()
    ids = defaultdict(dict)
    for r in out:
        row, places = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(row) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 128
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert places[a:b].tolist() == list(range(b - a))
            ids[d][s] = row[a:b].tolist()
        assert set(row[r.n_tokens :].tolist()) <= {50256}
    for doc, text, _ in rows:
        assert [t for s in sorted(ids[doc]) for t in ids[doc][s]] == library(text or "") + [50256]
    assert packed_matrices(df.limit(0), PATH).count() == 0


def test_repeated_rows_and_clashing_columns(spark):
    """Each row is a document of its own, whatever its id and whatever other columns are called."""
    df = spark.createDataFrame([(d, t) for d, t, _ in ROWS], "doc_id long, text string")
    more = df.selectExpr("*", "1 AS piece", "2 AS block", "3 AS length", "4 AS row", "5 AS sequence")
    for rows in (df, more):
        out = best_fit_packing(rows, PATH).collect()
        assert Counter(r.doc_id for r in out if r.piece == 0) == Counter(d for d, *_ in ROWS)
        assert sum(r.length for r in out) == sum(len(library(t or "")) + 1 for _, t, _ in ROWS)
        packed = packed_matrices(rows, PATH).collect()
        assert sum(r.n_tokens for r in packed) == sum(len(library(t or "")) + 1 for _, t, _ in ROWS)
    assert best_fit_packing(more.limit(0), PATH).count() == packed_matrices(more.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        packed_matrices(df, PATH, capacity=65_537)


def test_frequent_words_stay_remembered(monkeypatch):
    """A full table of chunks doesn't lose words that are met again and again."""
    from ontoloom.llm import tokens
    from ontoloom.llm.queries import BYTE_BPE

    monkeypatch.setattr(tokens, "CHUNKS", 40)
    counter, made = tokens.PrefixCounter(tokens.byte_bpe(BYTE_BPE)), []
    real = counter._piece_deltas
    monkeypatch.setattr(counter, "_piece_deltas", lambda piece: made.append(piece) or real(piece))
    plain = tokens.PrefixCounter(tokens.byte_bpe(BYTE_BPE))
    for k in range(60):
        text = "the frequent words" + "".join(f" rare{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}" for j in range(10)) + " frequent words"
        assert counter.deltas(text).tolist() == plain._ordinary(text).tolist()
    assert made.count(" frequent") == 1 and made.count(" words") == 1
