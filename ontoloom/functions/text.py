"""Text expressions: normalisation, keys, stems, tokens and sentences."""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

#: What UTF-8 looks like when it is read as a one-byte encoding.
MOJIBAKE = ("â€™", "â€œ", "â€\x9d", "â€“", "â€”", "Ã©", "Ã¨", "Ã±")

SPANS = T.ArrayType(T.StructType([T.StructField("id", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("text", T.StringType())]))


def normalize_phrase(text: Column) -> Column:
    """Lower case, everything but letters and numbers to one space, trimmed. Exact for texts that
    are already in compatibility form; ``normalize_unicode`` is for the rest."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


@pandas_udf(T.StringType())
def normalize_unicode(text: pd.Series) -> pd.Series:
    """The same after compatibility composition and full case folding."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        folded = unicodedata.normalize("NFKC", t).casefold()
        return " ".join("".join(c if c.isalnum() else " " for c in folded).split())

    return text.map(one)


def normalized(text: Column) -> Column:
    """``normalize_phrase`` for ASCII, else ``normalize_unicode``: only other texts go to Python."""
    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, normalize_phrase(text)).otherwise(normalize_unicode(F.when(~plain, text)))


@pandas_udf(T.ArrayType(T.StringType()))
def normalize_words(words: pd.Series) -> pd.Series:
    """``normalize_unicode`` of each word of a list; null lists stay null."""

    def one(t: str) -> str:
        folded = unicodedata.normalize("NFKC", t).casefold()
        return " ".join("".join(c if c.isalnum() else " " for c in folded).split())

    return words.map(lambda own: None if own is None else [one(w) for w in own])


def collapse_space(text: Column) -> Column:
    """Lower case with single spaces; punctuation stays."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def canonical_note(text: Column) -> Column:
    """Newlines unified, outer white space off; null where nothing is left."""
    unified = F.regexp_replace(text, r"\r\n?", "\n")
    stripped = F.regexp_replace(unified, r"^\s+|\s+$", "")
    return F.when(stripped != "", stripped)


def json_text(text: Column) -> Column:
    """A JSON string with only what must be escaped escaped."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, escaped in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


def record_key(*parts: Column) -> Column:
    """SHA-256 of the parts as a compact JSON array."""
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *map(json_text, parts)), F.lit("]")), 256)


def stem(token: Column) -> Column:
    """Suffixes off, by length: ies to y first, then the first of ulty, ity, ing (and a doubled
    letter before it), ed, es, s that applies."""
    t = F.when((F.length(token) > 6) & token.endswith("ies"), F.concat(token.substr(F.lit(1), F.length(token) - 3), F.lit("y"))).otherwise(token)
    n = F.length(t)
    off = lambda k: t.substr(F.lit(1), n - k)
    return (
        F.when((n > 7) & (t.endswith("ulty") | t.endswith("ity")), off(1))
        .when((n > 7) & t.endswith("ing"), F.regexp_replace(off(3), r"^(..+)(.)\2$", "$1$2"))
        .when((n > 6) & (t.endswith("ed") | t.endswith("es")), off(2))
        .when((n > 5) & t.endswith("s"), off(1))
        .otherwise(t)
    )


def signature(tokens: Column) -> Column:
    """The distinct stems of a phrase, in order."""
    return F.array_sort(F.array_distinct(F.transform(tokens, stem)))


def tokens(phrase: Column) -> Column:
    """Words of a normalised phrase; an empty one has none."""
    return F.filter(F.split(phrase, " "), lambda t: t != "")


def _spans(pattern: str, strip: bool):
    found = re.compile(pattern)

    @arrow_udf(SPANS)
    def spans(text: pa.Array) -> pa.Array:
        offsets, numbers, bodies = array("i", [0]), tuple(array("i") for _ in range(3)), []
        # A few texts at a time as Python objects; what stays of them is Arrow's.
        for low in range(0, len(text), 256):
            own = []
            for t in text.slice(low, 256):
                for k, m in enumerate(found.finditer(t.as_py() or "")):
                    start, stop, body = m.start(), m.end(), m[0]
                    if strip:
                        start += len(body) - len(body.lstrip())
                        body = body.strip()
                        stop = start + len(body)
                    if body:
                        own.append(body)
                        for c, v in zip(numbers, (k, start, stop)):
                            c.append(v)
                offsets.append(len(numbers[0]))
            bodies.append(pa.array(own, pa.string()))
        ints = [pa.array(np.frombuffer(c, np.int32)) if c else pa.array([], pa.int32()) for c in numbers]
        texts = pa.concat_arrays(bodies) if bodies else pa.array([], pa.string())
        return pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, np.int32)), pa.StructArray.from_arrays([*ints, texts], ["id", "start", "stop", "text"]))

    return spans


#: A word; an apostrophe inside it belongs to it. The classes are those of Python's \\w.
TOKEN = r"[\p{L}\p{N}_]+(?:[’'][\p{L}\p{N}_]+)?"
#: Words with code-point offsets.
token_spans = _spans(r"\w+(?:[’']\w+)?", strip=False)
#: Trimmed sentences with offsets; ids are those of the untrimmed pieces, so blanks leave gaps.
sentence_spans = _spans(r"[^\n.!?]+(?:[.!?]+|(?=\n)|$)", strip=True)


def is_valid_text(text: Column) -> Column:
    """No replacement character, no NUL and none of MOJIBAKE; valid UTF-8."""
    bad = reduce(or_, (text.contains(m) for m in ("\ufffd", "\x00", *MOJIBAKE)))
    return ~bad & F.is_valid_utf8(text)


def short_error(message: Column) -> Column:
    """One line of at most 300 characters."""
    return F.substring(F.regexp_replace(message, r"[\r\n]+", " "), 1, 300)


def expand_acronyms(text: Column, expansions: dict[str, str]) -> Column:
    """``POTS`` to ``POTS (its expansion)``: whole words of 2 to 8 capitals and digits."""
    table = F.create_map(*[F.lit(x) for kv in expansions.items() for x in kv])
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9]+|[^A-Za-z0-9]+)"), F.lit(1))
    one = lambda w: F.when(w.rlike("^[A-Z0-9]{2,8}$") & table[w].isNotNull(), F.concat(w, F.lit(" ("), table[w], F.lit(")"))).otherwise(w)
    return F.array_join(F.transform(words, one), "")


def swap_of(phrase: Column) -> Column:
    """``B of the A`` to ``A B``; others unchanged."""
    return F.regexp_replace(phrase, r"^(.+?)\s+of(?:\s+the)?\s+(.+)$", "$2 $1")
