"""Benchmark decontamination by winnowing, in Spark expressions only (operator 4).

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A hit is a
run of at least ``span`` consecutive words that a document shares with a benchmark item, or the
whole of an item that has fewer words, but some.

Of each text the hashes of its k-grams are winnowed: of any ``w`` consecutive ones the least is
kept. Every shared run of w + k - 1 words or more has a kept k-gram in both texts, and as
w + k - 1 is ``span`` no hit is missed. Kept hashes are joined; a match gives a document, an item
and how far apart they lie. Along that diagonal the words themselves are compared and each run of
equal words is extended to its ends, so hash collisions can't make hits.

Hits belong to texts: documents are told apart by the digest of their text, so rows without doc_id,
or with that of another, are rows like others, and copies are searched once for each task that has
them. Null and empty texts have no words and no hits; a text may have as many words as an array can
hold. Rows that repeat an item_id count as one item with several texts. Empty tables give no hits;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import lower_ascii, stored, text_key, text_or_empty

#: Benchmark fingerprints (24 bytes each) up to which they are broadcast.
BROADCAST_FINGERPRINTS = 500_000
#: Texts with hits, or rows of matches, up to which they (50 bytes each, or short lists) are broadcast.
BROADCAST_HITS = 100_000

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The low bits of a kept hash hold its place, the high bits the hash: the least of them is the
#: least hash, the first of equal ones. 31 bits hold the place of any array.
_PLACES = (1 << 31) - 1
#: First words of short items are looked up in so many slots before their grams are hashed.
_SLOTS = 1 << 16


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), _BETWEEN, -1), "")


def _gram(name: str, i: Column, k: int) -> Column:
    """Hash and place of the k-gram at ``i`` of an array of word hashes, as one long."""
    return F.xxhash64(F.lit(k), *[F.get(name, i + j) for j in range(k)]).bitwiseAND(~_PLACES).bitwiseOR(i.cast("long"))


def _grams(name: str, k: int, where=None) -> Column:
    """``_gram`` at every place, or at those for which ``where`` holds."""
    places = F.sequence(F.lit(0), F.size(name) - k)
    places = F.filter(places, where) if where else places
    return F.when(F.size(name) >= k, F.transform(places, lambda i: _gram(name, i, k))).otherwise(F.array().cast("array<long>"))


def _winnowed(name: str, w: int) -> Column:
    """The least of every w consecutive values; of fewer values, the least of all."""
    last = F.greatest(F.size(name) - w, F.lit(0))
    least = F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.array_min(F.slice(name, i, w)))
    return F.when(F.size(name) > 0, F.array_distinct(least)).otherwise(F.array().cast("array<long>"))


def _slot(word_hash: Column) -> Column:
    return F.pmod(word_hash, F.lit(_SLOTS)).cast("int")


def fingerprints(texts: DataFrame, key: str, k: int, w: int, short: list[int], first_words: bytes | None = None) -> DataFrame:
    """(key, hash, place) of the kept k-grams and of all grams of the lengths ``short``, in one pass;
    ``texts`` has key and ``hashes`` of its words. ``first_words`` has a byte for each slot of word
    hashes: grams are only made where it is set for their first word."""
    flagged = lambda i: F.substring(F.lit(first_words), _slot(F.get("hashes", i)) + 1, F.lit(1)) == F.lit(b"\x01")
    texts = texts.select(key, "hashes", _grams("hashes", k).alias("grams"))
    kept = F.concat(_winnowed("grams", w), *[_grams("hashes", n, flagged if first_words is not None else None) for n in short])
    rows = texts.select(key, F.explode(kept).alias("at"))
    return rows.select(key, F.col("at").bitwiseAND(~_PLACES).alias("hash"), F.col("at").bitwiseAND(_PLACES).cast("int").alias("place"))


def contaminated_words(docs: DataFrame, items: DataFrame, span: int = 13, k: int = 7) -> DataFrame:
    """Per text with hits: text_key, hits (item_id, start, stop): half-open runs of its words. Runs may
    overlap."""
    items = items.select("item_id", words(text_or_empty()).alias("words")).where(F.size("words") > 0).distinct()
    items = stored(items.select(F.xxhash64("item_id", F.to_json("words")).alias("item_row"), "item_id", "words"), "items")
    hashed = lambda x: F.transform(x, lambda v: F.xxhash64(v))
    # Items as long as a span are winnowed; of shorter ones the whole, as one gram. Lengths below span
    # and slots of their first words, _SLOTS at most, go to the driver.
    of_items = items.select("item_row", hashed("words").alias("hashes"))
    brief = of_items.where(F.size("hashes") < span)
    short = sorted(r[0] for r in brief.select(F.size("hashes")).distinct().collect())
    flags = bytearray(_SLOTS)
    for r in brief.select(_slot(F.get("hashes", 0))).distinct().collect():
        flags[r[0]] = 1
    marks = fingerprints(of_items.where(F.size("hashes") >= span), "item_row", k, span - k + 1, [])
    whole = brief.select("item_row", F.explode(F.concat(*[F.when(F.size("hashes") == n, _grams("hashes", n)).otherwise(F.array().cast("array<long>")) for n in short])).alias("at")) if short else None
    if whole is not None:
        marks = marks.unionByName(whole.select("item_row", F.col("at").bitwiseAND(~_PLACES).alias("hash"), F.col("at").bitwiseAND(_PLACES).cast("int").alias("place")))
    marks = stored(marks.withColumnRenamed("place", "item_place"), "marks")
    if marks.count() <= BROADCAST_FINGERPRINTS:
        marks = F.broadcast(marks)
    worded = docs.select(text_key().alias("text_key"), words(text_or_empty()).alias("words"))
    seen = fingerprints(worded.select("text_key", hashed("words").alias("hashes")), "text_key", k, span - k + 1, short, bytes(flags))
    matches = seen.join(marks, "hash").select("text_key", "item_row", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    matches = stored(matches, "matches")
    of_texts = stored(matches.select("text_key").distinct(), "hit-texts")
    if of_texts.count() <= BROADCAST_HITS:
        of_texts = F.broadcast(of_texts)
    # One row for each text, found in each task before it is shuffled.
    own_words = stored(worded.join(of_texts, "text_key", "left_semi").distinct(), "hit-words")
    if matches.count() <= BROADCAST_HITS:
        matches = F.broadcast(matches)
    both = own_words.join(matches, "text_key").join(items.select("item_row", "item_id", F.col("words").alias("item_words")), "item_row")
    n = F.size("item_words")
    # Of the item's places 0..n: where a run of equal words begins and where it has ended.
    equal = lambda j: F.coalesce((j >= 0) & (j < n) & (F.get("own", j) == F.get("item_words", j)), F.lit(False))
    low = F.greatest(F.col("shift"), F.lit(0))
    aligned = both.select(
        "text_key", "item_id", "shift", "item_words",
        # the text's words beside the item's, nulls where the text has none
        F.concat(F.array_repeat(F.lit(None).cast("string"), low - F.col("shift")), F.slice("words", low + 1, n - (low - F.col("shift")))).alias("own"),
    )
    places = F.sequence(F.lit(0), n)
    runs = aligned.select(
        "text_key", "item_id", "shift", n.alias("n"),
        F.filter(places, lambda j: equal(j) & ~equal(j - 1)).alias("starts"),
        F.filter(places, lambda j: ~equal(j) & equal(j - 1)).alias("stops"),
    )
    hits = runs.select("text_key", "item_id", "shift", "n", F.explode(F.arrays_zip("starts", "stops")).alias("run"))
    hits = hits.where(F.col("run.stops") - F.col("run.starts") >= F.least(F.col("n"), F.lit(span)))
    return hits.select("text_key", "item_id", (F.col("run.starts") + F.col("shift")).alias("start"), (F.col("run.stops") + F.col("shift")).alias("stop")).distinct()


def _by_text(docs: DataFrame, items: DataFrame, span: int, k: int) -> DataFrame:
    """text_key, n_hit and items of the texts with hits."""
    hits = stored(contaminated_words(docs, items, span, k), "hits")
    # The words of a run that no run beginning before it has covered.
    before = Window.partitionBy("text_key").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max("stop").over(before), F.lit(0))
    fresh = hits.select("text_key", F.greatest(F.col("stop") - F.greatest("start", covered), F.lit(0)).cast("long").alias("n"))
    n_hit = fresh.groupBy("text_key").agg(F.sum("n").alias("n_hit"))
    found = hits.select("text_key", F.col("item_id").cast("string").alias("item")).distinct().groupBy("text_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return stored(n_hit.join(found, "text_key").withColumnRenamed("text_key", "hit_key"), "hit-counts")


def contamination(docs: DataFrame, items: DataFrame, span: int = 13, k: int = 7, share: int = 20) -> DataFrame:
    """For every document: doc_id, n_words, n_hit (words inside hits), n_items, items_sha256 and
    contaminated: a ``share``-th or more of its words are hit."""
    by_text = _by_text(docs, items, span, k)
    if by_text.count() <= BROADCAST_HITS:
        by_text = F.broadcast(by_text)
    counted = docs.select("doc_id", text_key().alias("text_key"), F.size(words(text_or_empty())).cast("long").alias("n_words"))
    out = counted.join(by_text, F.col("text_key") == F.col("hit_key"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def leaking_texts(docs: DataFrame, items: DataFrame, span: int = 13, k: int = 7, share: int = 20) -> DataFrame:
    """``text_key`` (as _key) of the contaminated texts."""
    by_text = _by_text(docs, items, span, k)
    if by_text.count() <= BROADCAST_HITS:
        by_text = F.broadcast(by_text)
    counted = docs.select(text_key().alias("text_key"), F.size(words(text_or_empty())).cast("long").alias("n_words"))
    found = counted.join(by_text, F.col("text_key") == F.col("hit_key")).where(F.col("n_hit") * share >= F.col("n_words"))
    return found.select(F.col("text_key").alias("_key")).distinct()
