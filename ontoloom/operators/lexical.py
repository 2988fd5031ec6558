"""Dictionary recognition of phrases in texts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_phrase, normalized, signature, tokens
from ..sources.shared import ROWS, SMALL, stored

#: Slots of the tables of a lexicon's words and phrases that texts are looked up in first: a byte each.
_SLOTS = 1 << 17
#: Words of texts that a worker remembers; what a word of a run adds to the number of its stems.
_KNOWN, _STEP = 100_000, 7_919

#: Words that are no finding by themselves.
SINGLE_WORDS = (
    "all child adult male female finding history normal patient acute chronic episodic mild moderate onset recurrent severe "
    "transient bilateral left right unilateral"
).split()


def excluded(words: Column) -> Column:
    """One word that is in SINGLE_WORDS or an acronym of up to three letters."""
    one = F.get(words, 0)
    return (F.size(words) == 1) & (one.isin(SINGLE_WORDS) | one.rlike("^[A-Za-z]{1,3}$"))


def lexicon(phrases: DataFrame, most: int = 12) -> DataFrame:
    """From (concept_id, phrase, record_key): (key, n_tokens, ids, record_keys), usable phrases."""
    rows = phrases.withColumn("words", tokens(normalized(F.col("phrase"))))
    rows = rows.where(F.size("words").between(1, most) & ~excluded(F.col("words")))
    return rows.groupBy(F.array_join("words", " ").alias("key"), F.size("words").alias("n_tokens")).agg(
        F.array_sort(F.collect_set("concept_id")).alias("ids"), F.array_sort(F.collect_set("record_key")).alias("record_keys")
    )


def morphological_lexicon(exact: DataFrame, most: int = 8) -> DataFrame:
    """(signature, n_tokens, ids) of an exact lexicon's phrases."""
    rows = exact.where(F.col("n_tokens") <= most).select(signature(F.split("key", " ")).alias("signature"), "n_tokens", F.explode("ids").alias("id"))
    return rows.groupBy("signature", "n_tokens").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def _slots(values: DataFrame) -> bytes:
    """A byte for each slot that ``values`` (one column of numbers) have: _SLOTS numbers at most are
    collected, whatever the number of values."""
    out = bytearray(_SLOTS)
    for r in values.select((F.col(values.columns[0]).cast("long").bitwiseAND(F.lit(_SLOTS - 1))).cast("int").alias("s")).distinct().collect():
        out[r.s] = 1
    return bytes(out)


def _stem(t: str) -> str:
    """``functions.text.stem`` of one word."""
    if len(t) > 6 and t.endswith("ies"):
        t = t[:-3] + "y"
    n = len(t)
    if n > 7 and t.endswith(("ulty", "ity")):
        return t[:-1]
    if n > 7 and t.endswith("ing"):
        t = t[:-3]
        return t[:-1] if t[-1] == t[-2] else t
    if n > 6 and t.endswith(("ed", "es")):
        return t[:-2]
    return t[:-1] if n > 5 and t.endswith("s") else t


class _Words(dict):
    """Words of texts -> what the tables say of them, remembered for up to _KNOWN words: None where no phrase
    has the word, else (crc, or -1 if no phrase begins so; bytes to go on with; word; stem; number of
    the stem, or -1 if no phrase has it)."""

    def __init__(self, words: bytes, firsts: bytes, stems: bytes | None) -> None:
        self.words, self.firsts, self.stems = words, firsts, stems

    def __missing__(self, raw: str) -> tuple | None:
        folded = raw.lower() if raw.isascii() else unicodedata.normalize("NFKC", raw).casefold()
        own = folded if folded.isalnum() else " ".join("".join(c if c.isalnum() else " " for c in folded).split())
        out = None
        # A word with marks inside may normalise to several or none; such a word is in no phrase.
        if own and " " not in own:
            data = own.encode("utf-8", "replace")
            crc, like, stemmed = crc32(data), -1, ""
            if self.stems is not None:
                stemmed = _stem(own)
                number = crc32(stemmed.encode("utf-8", "replace"))
                like = number if self.stems[number & (_SLOTS - 1)] else -1
            if self.words[crc & (_SLOTS - 1)] or like >= 0:
                out = (crc if self.firsts[crc & (_SLOTS - 1)] else -1, b" " + data, own, stemmed, like)
        if len(self) >= _KNOWN:
            self.clear()
        self[raw] = out
        return out


def spans(notes: DataFrame, exact: DataFrame, morphological: DataFrame | None = None) -> DataFrame:
    """(note_id, key, signature, n_tokens, start, stop, phrase) of the runs of words that may be a phrase of
    ``exact`` or, by their stems, of ``morphological``: those whose slots are set in tables of the lexicons'
    words, beginnings and whole phrases.

    Texts go to Python in small batches. A text's words are looked up once each, and runs go on word by
    word only while a phrase begins so, so the work is in proportion to the words. What comes back is
    written to the shared folder."""
    most = exact.agg(F.max("n_tokens")).first()[0] or 1
    parts = F.split("key", " ")
    words = _slots(exact.select(F.explode(parts).alias("w")).select(F.crc32(F.col("w").cast("binary"))))
    beginnings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), " "))
    firsts = _slots(exact.select(F.explode(beginnings).alias("b")).select(F.crc32(F.col("b").cast("binary"))))
    keys = _slots(exact.select(F.crc32(F.col("key").cast("binary"))))
    stems = alike = None
    if morphological is not None:
        stems = _slots(morphological.select(F.explode("signature").alias("s")).select(F.crc32(F.col("s").cast("binary"))))
        alike = _slots(morphological.select(F.aggregate("signature", F.col("n_tokens").cast("long") * _STEP, lambda a, s: a + F.crc32(s.cast("binary")))))
    mask = _SLOTS - 1

    def runs(known: list[tuple | None]) -> list[tuple[int, int]]:
        out, size = [], len(known)
        for i, first in enumerate(known):
            if first is None:
                continue
            crc, _, _, _, like = first
            ends, n = set(), 1
            while crc >= 0:
                if keys[crc & mask]:
                    ends.add(n)
                if n == most or i + n >= size or (then := known[i + n]) is None:
                    break
                crc, n = crc32(then[1], crc), n + 1
                if not firsts[crc & mask]:
                    break
            if like >= 0:
                number, seen = 0, set()
                for n in range(1, min(most, size - i) + 1):
                    if (then := known[i + n - 1]) is None or (like := then[4]) < 0:
                        break
                    if then[3] not in seen:
                        seen.add(then[3])
                        number += like
                    if alike[(number + n * _STEP) & mask]:
                        ends.add(n)
            out += [(i, n) for n in sorted(ends)]
        return out

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, token = _Words(words, firsts, stems), re.compile(r"\w+(?:[’']\w+)?")
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                at, cols = [], ([], [], [], [], [], [])
                for row, text in enumerate(part.column(1)):
                    text = text.as_py() or ""
                    own = list(map(known.__getitem__, token.findall(text)))
                    if not (got := runs(own)):
                        continue
                    places = [m.span() for m in token.finditer(text)]
                    for i, n in got:
                        start, stop = places[i][0], places[i + n - 1][1]
                        signed = " ".join(sorted({x[3] for x in own[i : i + n]})) if stems is not None else ""
                        at.append(row)
                        for c, v in zip(cols, (" ".join(x[2] for x in own[i : i + n]), signed, n, start, stop, text[start:stop])):
                            c.append(v)
                types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                arrays = [part.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, t in zip(cols, types))]
                yield pa.RecordBatch.from_arrays(arrays, ["note_id", "key", "signature", "n_tokens", "start", "stop", "phrase"])

    schema = T.StructType([T.StructField("note_id", notes.schema["note_id"].dataType)]).add("key", "string").add("signature", "string")
    for name, kind in (("n_tokens", "integer"), ("start", "integer"), ("stop", "integer"), ("phrase", "string")):
        schema = schema.add(name, kind)
    return stored(notes.select("note_id", F.col("text").cast("string")).mapInArrow(find, schema), "runs", SMALL)


def mentions(notes: DataFrame, exact: DataFrame, morphological: DataFrame | None = None) -> DataFrame:
    """(note_id, start, stop, n_tokens, phrase, evidence, ids): exact hits, and hits by signature where a
    span has no exact one. Lexicons are written once and joined to the runs that are left, so where they are
    small nothing is shuffled."""
    exact = stored(exact, "lexicon")
    alike = stored(morphological, "signatures") if morphological is not None else None
    found = spans(notes, exact, alike).join(exact.select("key", "n_tokens", "ids"), ["key", "n_tokens"], "left" if alike is not None else "inner")
    out = ["note_id", "start", "stop", "n_tokens", "phrase"]
    if alike is None:
        return found.select(*out, F.lit("exact").alias("evidence"), "ids")
    found = found.join(alike.select(F.array_join("signature", " ").alias("signature"), "n_tokens", F.col("ids").alias("alike")), ["signature", "n_tokens"], "left")
    evidence = F.when(F.col("ids").isNotNull(), "exact").otherwise("morphological")
    return found.where("ids IS NOT NULL OR alike IS NOT NULL").select(*out, evidence.alias("evidence"), F.coalesce("ids", "alike").alias("ids"))


def longest_nonoverlapping(found: DataFrame) -> DataFrame:
    """Per note, greedily: more words first, then earlier, then exact; no two overlap. Mentions that
    overlap, directly or through others, are a cluster; clusters are folded apart, so a note with very
    many mentions is no long fold."""
    so_far = Window.partitionBy("note_id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    new = (F.col("start") >= F.coalesce(F.max("stop").over(so_far), F.lit(-1))).cast("int")
    cluster = F.sum("new").over(Window.partitionBy("note_id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0))
    rows = found.withColumn("new", new).withColumn("cluster", cluster)
    one = F.struct((-F.col("n_tokens")).alias("less"), "start", (F.col("evidence") != "exact").alias("inexact"), "ids", "stop", "n_tokens", "evidence")
    rows = rows.groupBy("note_id", "cluster").agg(F.array_sort(F.collect_set(one)).alias("all"))
    apart = lambda kept, m: ~F.exists(kept, lambda k: (m["start"] < k["stop"]) & (m["stop"] > k["start"]))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda kept, m: F.when(apart(kept, m), F.concat(kept, F.array(m))).otherwise(kept))
    return rows.select("note_id", F.explode(kept).alias("m")).select("note_id", "m.start", "m.stop", "m.n_tokens", "m.evidence", "m.ids")


def head_variant(phrase: Column) -> Column:
    """A phrase of several words that begins with one of SINGLE_WORDS, without all such words; null for
    others, and where less than three letters are left."""
    plain = lambda w: normalize_phrase(w).isin(SINGLE_WORDS)
    words = F.filter(F.split(F.trim(phrase), r"\s+"), lambda w: w != "")
    head = F.array_join(F.filter(words, lambda w: ~plain(w)), " ")
    return F.when((F.size(words) > 1) & plain(F.get(words, 0)) & (F.length(head) >= 3), head)


def probes(phrases: DataFrame, first: int = 256) -> DataFrame:
    """From (concept_id, phrase): the ``first`` phrases in normalised order, and the normal form of every
    phrase that several concepts have."""
    rows = phrases.withColumn("normalized", normalized(F.col("phrase")))
    head = rows.select("normalized", "phrase").distinct().orderBy("normalized", "phrase").limit(first).select("phrase")
    several = rows.groupBy("normalized").agg(F.count_distinct("concept_id").alias("n")).where("n > 1").select(F.col("normalized").alias("phrase"))
    return head.unionByName(several).distinct()


def merge_mentions(found: DataFrame) -> DataFrame:
    """Mentions of one span and normalised phrase become one with the union of methods and ids."""
    return found.groupBy("note_id", "start", "stop", normalize_phrase(F.col("phrase")).alias("phrase")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"), F.array_sort(F.collect_set("method")).alias("methods")
    )


def suppress_narrow(merged: DataFrame) -> DataFrame:
    """A span goes where a broader one of the note has it, and no other, inside. A broad span meets the
    spans that start in the steps of text it covers, so a note of very many is no square of them."""
    merged = stored(merged, "merged")
    step = lambda c: F.floor(F.col(c) / 128)
    a = merged.select("note_id", F.col("start").alias("broad"), F.col("stop").alias("broad_stop"), F.col("phrase").alias("wide"), F.explode(F.sequence(step("start"), step("stop"))).alias("step"))
    b = merged.select("note_id", "start", "stop", "phrase", step("start").alias("step"))
    inside = (F.col("broad") <= F.col("start")) & (F.col("broad_stop") >= F.col("stop")) & (F.col("broad_stop") - F.col("broad") > F.col("stop") - F.col("start")) & F.col("wide").contains(F.col("phrase"))
    pairs = a.join(b, ["note_id", "step"]).where(inside)
    alone = pairs.groupBy("note_id", "broad", "broad_stop").agg(F.count(F.lit(1)).alias("n"), F.first("start").alias("start"), F.first("stop").alias("stop")).where("n = 1")
    return merged.join(alone, ["note_id", "start", "stop"], "left_anti")
