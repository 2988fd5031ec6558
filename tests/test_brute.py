"""Queries that SQL doesn't express, against plain Python over the whole smallest tables."""

import hashlib
import os
import re
import unicodedata
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from ontoloom.operators import assertion
from ontoloom.operators.lexical import SINGLE_WORDS
from ontoloom.operators.stats import allocate
from ontoloom.plans import ALL

SF = "/root/testdata/sf0.001"
QUERIES = {k: f for p in ALL for k, f in p.queries.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def normal(t):
    folded = unicodedata.normalize("NFKC", t).casefold()
    return " ".join("".join(c if c.isalnum() else " " for c in folded).split())


def stem(t):
    if len(t) > 6 and t.endswith("ies"):
        t = t[:-3] + "y"
    if len(t) > 7 and t.endswith(("ulty", "ity")):
        return t[:-1]
    if len(t) > 7 and t.endswith("ing"):
        t = t[:-3]
        return t[:-1] if len(t) > 3 and t[-1] == t[-2] else t
    if len(t) > 6 and t.endswith(("ed", "es")):
        return t[:-2]
    return t[:-1] if len(t) > 5 and t.endswith("s") else t


def test_normalize_unicode(spark):
    want = {r["doc_id"]: hashlib.sha256(normal(r["text"] or "").encode()).hexdigest() for r in rows("documents")}
    assert {r.doc_id: r.normalized_sha for r in QUERIES["normalize_unicode_phrases"](spark, SF).collect()} == want


def lexicons():
    exact, alike = defaultdict(set), defaultdict(set)
    for r in rows("benchmark"):
        words = normal(r["text"] or "").split()[: 2 + r["item_id"] % 11]
        if words and not (len(words) == 1 and (words[0] in SINGLE_WORDS or re.fullmatch("[A-Za-z]{1,3}", words[0]))):
            exact[tuple(words)].add(f"B:{r['item_id']}")
    for words, ids in exact.items():
        if len(words) <= 8:
            alike[len(words), tuple(sorted({stem(w) for w in words}))] |= ids
    return exact, alike


def test_longest_nonoverlap(spark):
    exact, alike = lexicons()
    want = []
    for r in rows("documents"):
        spans = [(normal(m[0]), *m.span()) for m in re.finditer(r"\w+(?:[’']\w+)?", r["text"] or "")]
        found = []
        for n in {len(k) for k in exact}:
            for i in range(len(spans) - n + 1):
                own = tuple(w for w, *_ in spans[i : i + n])
                if any(" " in w or not w for w in own):
                    continue
                ids, how = exact.get(own), "exact"
                if not ids:
                    ids, how = alike.get((n, tuple(sorted({stem(w) for w in own})))), "morphological"
                if ids:
                    found.append((-n, spans[i][1], how != "exact", sorted(ids), spans[i + n - 1][2], how))
        kept = []
        for m in sorted(found):
            if not any(m[1] < k[4] and m[4] > k[1] for k in kept):
                kept.append(m)
        want += [(r["doc_id"], m[1], m[4], -m[0], m[5], "|".join(m[3])) for m in kept]
    got = [(r.note_id, r.start, r.stop, r.n_tokens, r.evidence, r.ids) for r in QUERIES["longest_nonoverlap"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and len(want) > 2


def plain_assertion(text, start, stop):
    low = max((m.end() for m in re.finditer(r"[\n.!?;]", text[:start])), default=0)
    end = re.search(r"[\n.!?;]", text[stop:])
    raw = text[low : stop + end.start() if end else len(text)]
    low += len(raw) - len(raw.lstrip())
    sentence = raw.strip()
    cuts = [m.end() for m in re.finditer(r"(?i)[,;:]|\bbut\b|\bhowever\b|\balthough\b", sentence[: start - low])]
    before, inside, after = sentence[max(cuts, default=0) : start - low][-120:], sentence[start - low : stop - low], sentence[stop - low :][:80]
    section = None
    for line in text[:start].split("\n"):
        if m := re.match(r"[ \t]*([A-Za-z][A-Za-z /_-]{1,48}):[ \t]*$", line):
            section = m[1].strip()
    if section and re.search(assertion.FAMILY_SECTION, section):
        return "family_history"
    for status, pattern in assertion.CUES.items():
        if re.search(rf"(?i)\b(?:{pattern})\b", before) or re.search(rf"(?i)\b(?:{pattern})\b", inside):
            return status
    return next((s for s, p in assertion.AFTER.items() if re.search(p, after)), "affirmed")


def test_assertion_status(spark):
    texts = {(r["conv_id"], r["turn"]): r["text"] for r in rows("conversations")}
    got = QUERIES["assertion_status"](spark, SF).collect()
    assert len(got) == sum(bool(re.search(r"\w", t or "")) for t in texts.values())
    assert {(r.conv_id, r.turn, r.status) for r in got} == {(r.conv_id, r.turn, plain_assertion(texts[r.conv_id, r.turn], r.start, r.stop)) for r in got}


@pytest.mark.parametrize(
    "text,phrase,status",
    [
        ("She denies\nseizures since May.", "seizures", "affirmed"),
        ("No rash; ataxia persists.", "ataxia", "affirmed"),
        ("No rash; ataxia was ruled out!", "ataxia", "negated"),
        ("Watch for drooling", "drooling", "hypothetical"),
        ("Denies nausea, however tremor began", "tremor", "affirmed"),
        ("Maternal history:\nstroke at forty", "stroke", "family_history"),
        ("Plan:\nMother well. He might have gout", "gout", "uncertain"),
        ("Vertigo no longer present.", "Vertigo", "resolved"),
        ("Gait remains normal\n", "Gait", "normal"),
        ("without\n\nseizures", "seizures", "affirmed"),
    ],
)
def test_lines_and_cues(spark, text, phrase, status):
    at = text.index(phrase)
    assert plain_assertion(text, at, at + len(phrase)) == status
    row = assertion.with_assertion(spark.createDataFrame([(text, at, at + len(phrase))], "text string, start int, stop int")).first()
    assert row.status == status and "\n" not in row.sentence


def best_matching(left, right):
    """The size of a largest matching, by trying all."""

    def most(i, free):
        if i == len(left):
            return 0
        return max([most(i + 1, free)] + [1 + most(i + 1, free - {k}) for k in free if left[i] & right[k]])

    return most(0, frozenset(range(len(right))))


@pytest.mark.parametrize("name", ["group_matching_scores", "single_id_group_scores"])
def test_groups(spark, name):
    p, r = defaultdict(list), defaultdict(list)
    for x in sorted(rows("lineitem"), key=lambda x: x["l_linenumber"]):
        a, b = x["l_partkey"] % 7, x["l_suppkey"] % 7
        if x["l_quantity"] > 15:
            p[x["l_orderkey"]].append([a, b] if a != b else [a])
        if x["l_discount"] < 0.07:
            r[x["l_orderkey"]].append({b, a + 1})
    got = {x.case_id: (x.tp, x.fp, x.fn) for x in QUERIES[name](spark, SF).collect()}
    want = {}
    for c, right in r.items():
        left = [set(g) for g in p[c]] if name.startswith("group") else [{v} for v in {g[0] for g in p[c]}]
        tp = best_matching(left, right)
        want[c] = (tp, len(left) - tp, len(right) - tp)
    assert got == want


def test_greedy_assignment(spark):
    want = []
    for case in {x["l_orderkey"] for x in rows("lineitem")}:
        left, right = set(), set()
        for a, b in sorted({(x["l_linenumber"], x["l_partkey"] % 3) for x in rows_of(case)}):
            if a not in left and b not in right:
                left.add(a)
                right.add(b)
                want.append((case, a, b))
    assert sorted(map(tuple, QUERIES["greedy_assignment"](spark, SF).collect())) == sorted(want)


def rows_of(case, known={}):  # noqa: B006
    if not known:
        for x in rows("lineitem"):
            known.setdefault(x["l_orderkey"], []).append(x)
    return known[case]


def test_stratified_sample(spark):
    own = defaultdict(list)
    for x in rows("documents"):
        own[x["lang"]].append(x["doc_id"])
    unit = lambda d: int(hashlib.sha256(f"11/{d}".encode()).hexdigest()[:13], 16)
    take = allocate({k: len(v) for k, v in own.items()}, 60)
    want = {d for k, v in own.items() for d in sorted(v, key=lambda d: (unit(d), d))[: take[k]]}
    assert {x.doc_id for x in QUERIES["stratified_sample"](spark, SF).collect()} == want
