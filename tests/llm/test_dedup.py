"""Operators 3 and 9 against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ontoloom.llm import exact_dedup as module
from ontoloom.llm.components import components
from ontoloom.llm.exact_dedup import ExactDedup, exact_dedup, without_copies
from ontoloom.llm.simhash import fingerprint, near_pairs, simhash_components

TEXTS = [(1, "a b c", "x"), (2, "abc", "x"), (3, "a  bc\n", "y"), (4, None, "y"), (5, "", "z"), (6, " \t", "z"), (7, "other", None), (8, "é b", "q"), (9, "éb", "q"), (None, "lone", "q")]


def plain(rows):
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, d))
    out = []
    for text, own in groups.items():
        keep = min(own)[3]
        out += [(d, keep, len(own), d == keep, hashlib.sha256(text.encode()).hexdigest()) for *_, d in own]
    return sorted(out, key=str)


def frame(spark, rows, extra="digest"):
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra} string").repartition(3)


def told(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def test_exact(spark, tmp_path):
    df = frame(spark, TEXTS)
    assert told(exact_dedup(df)) == plain(TEXTS)
    df.write.parquet(str(tmp_path / "d"))
    assert told(exact_dedup(spark.read.parquet(str(tmp_path / "d")))) == plain(TEXTS)
    assert exact_dedup(df.limit(0)).count() == 0


def test_state_goes_on(spark):
    one, two = frame(spark, TEXTS[:5]), frame(spark, TEXTS[5:])
    first = ExactDedup(spark)
    first.add(one)
    again = ExactDedup(spark, first.folder)
    again.add(two)
    out = again.decide(one.union(two))
    got = told(out.withColumn("text_sha256", F.lower(F.hex("digest"))))
    assert got == plain(TEXTS)


def test_bytes_are_checked(spark):
    """With digests of one hexadecimal digit many texts clash, and are still told apart."""
    rng = random.Random(1)
    rows = [(k, rng.choice(["p q", "pq", "r", "s s", "t", "u", "v", "w", "x y", "z"]) * rng.randint(1, 3), "") for k in range(80)]
    short = exact_dedup(frame(spark, rows), digest=lambda t: F.substring(F.sha2(t, 256), 1, 1).cast("binary")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in short) == sorted(x[:4] for x in plain(rows))


LIMITS = ("BROADCAST_DIGESTS", "BROADCAST_GROUPS")


@pytest.mark.parametrize("heavy", [0.01, 0.5])
def test_without_broadcasts(spark, monkeypatch, heavy):
    """One text fills a third of the table: as a heavy group and as a light one."""
    for name in LIMITS if heavy < 0.1 else LIMITS[1:]:
        monkeypatch.setattr(module, name, 0)
    monkeypatch.setattr(module, "HEAVY", heavy)
    rng = random.Random(7)
    rows = [(k, "hot text" if k % 3 == 0 else f"t{rng.randrange(60)}" + " " * (k % 2), "") for k in range(300)]
    assert told(exact_dedup(frame(spark, rows))) == plain(rows)
    kept = without_copies(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted({k for _, k, *_ in plain(rows)})


def test_rows_alike_in_everything(spark):
    """Equal rows, columns of clashing names, a long text; with digests that clash too."""
    rows = [(1, "a b", "x")] * 5 + [(None, None, "x")] * 3 + [(2, "z " * 100_000, "y"), (3, "z" * 100_000, "y")]
    names = {c: F.lit(1) for c in ("_row", "_lost", "row", "digest", "kept", "call", "_id", "_sha")}
    df = frame(spark, rows, "file").withColumns(names)
    for digest in (module.sha256, lambda t: F.lit(b"0")):
        out = without_copies(df, digest)
        assert out.columns == df.columns
        assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "None"]
        got = exact_dedup(df, digest).collect()
        assert len(got) == 10 and sorted(str(r.doc_id) for r in got if r.kept) == ["1", "2", "None"]
        assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(1, 1, 5), (None, None, 3), (2, 2, 2), (3, 2, 2)}
    assert without_copies(df.limit(0)).columns == df.columns and without_copies(df.limit(0)).count() == 0


def test_rows_that_stay(spark):
    rows = [*TEXTS, (1, "a b c", "x"), (3, "a  bc\n", "other"), (20, "new", "n")]
    out = without_copies(frame(spark, rows, "kept"))
    assert out.columns == ["doc_id", "text", "kept"]
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(["3", "6", "7", "8", "9", "None", "20"])


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints():
    for t in (None, "", "One", "one two", "A b\tc d É e", "w " * 70_000, "a b c a b c"):
        assert fingerprint(t) == plain_fingerprint(t)


def test_pairs_and_components(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(12)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(25)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {frozenset((r.a, r.b)) for r in near_pairs(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {frozenset((a, b)) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert got == want
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert roots == {**{k: 0 for k in range(1, 41)}, 101: 100, 102: 100}


def test_simhash_table(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(200)]
    rows = []
    for k in range(12):
        text = [rng.choice(words) for _ in range(120)]
        for c in range(4):
            other = text[:]
            if c:
                other[rng.randrange(120)] = "new"
            rows.append((k * 10 + c, " ".join(other), "fp"))
    rows += [(500, None, ""), (501, " ", ""), (502, "", ""), (3, rows[3][1], "")]
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash_components(frame(spark, rows, "fp")).collect()}
    fp = {d: plain_fingerprint(t) for d, t, _ in rows}
    root = {d: d for d in fp}
    for _ in fp:
        for a in fp:
            for b in fp:
                if bin(fp[a] ^ fp[b]).count("1") <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    assert got == {d: (fp[d], root[d]) for d in fp}
    assert simhash_components(frame(spark, rows, "fp").limit(0)).count() == 0
