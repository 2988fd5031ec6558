"""Placing extracted phrases in their text, and decisions from a pluggable provider."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions.fuzzy import ratio

#: The widest gap inside a coordinated phrase and the least fuzzy ratio.
GAP, LEAST = 120, 90.0
_WORD = re.compile(r"\w+(?:[-'’]\w+)*")
_SEGMENT = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
PLACED = T.ArrayType(T.StructType([T.StructField("phrase", T.StringType()), T.StructField("how", T.StringType()), T.StructField("segments", T.ArrayType(_SEGMENT))]))


def coordinated(phrase: str, note: str) -> list[tuple[int, int]] | None:
    """Segments of a phrase whose words are in the note in order but not side by side, within one
    sentence: "cutaneous neurofibromas" in "cutaneous and plexiform neurofibromas"."""
    words = [w.casefold() for w in _WORD.findall(phrase)]
    if len(words) < 2:
        return None
    source = [(m[0].casefold(), *m.span()) for m in _WORD.finditer(note)]
    for first, (word, start, stop) in enumerate(source):
        if word != words[0]:
            continue
        spans, at = [(start, stop)], first + 1
        for w in words[1:]:
            while at < len(source) and source[at][0] != w and source[at][1] - spans[-1][1] <= GAP:
                at += 1
            if at == len(source) or source[at][0] != w or source[at][1] - spans[-1][1] > GAP:
                break
            spans.append(source[at][1:])
            at += 1
        if len(spans) < len(words) or re.search(r"[\n.!?]", note[spans[0][0] : spans[-1][1]]):
            continue
        merged = [spans[0]]
        for a, b in spans[1:]:
            if note[merged[-1][1] : a].strip(" \t-/"):
                merged.append((a, b))
            else:
                merged[-1] = (merged[-1][0], b)
        if len(merged) > 1:
            return merged
    return None


def closest_window(phrase: str, note: str) -> tuple[float, int, int]:
    """(ratio, start, stop) of the window of the phrase's length that is most like it; of equal ones
    the first that begins with the same letter. Windows with less than half of the phrase's
    letters are passed over."""
    n, best = len(phrase), (0.0, False, 0, 0)
    for start in range(0, max(1, len(note) - n + 1)):
        window = note[start : start + n]
        if len(set(window) & set(phrase)) * 2 >= len(set(phrase)):
            got = (ratio(phrase, window), window[:1].casefold() == phrase[:1].casefold())
            if got > best[:2]:
                best = (*got, start, start + len(window))
    return best[0], best[2], best[3]


def place(note: str, phrases: list[str]) -> list[dict]:
    """The next unused literal occurrence of each phrase, else its coordinated segments, else a
    window of at least LEAST; phrases that are nowhere are left out."""
    out, used = [], set()
    for phrase in phrases:
        spans = [m.span() for m in re.finditer(re.escape(phrase), note, re.IGNORECASE)] if phrase else []
        if spans:
            segments, how = [next((s for s in spans if s not in used), spans[0])], "literal"
        elif found := coordinated(phrase, note):
            segments, how = found, "coordinated"
        else:
            score, a, b = closest_window(phrase, note)
            if score < LEAST:
                continue
            segments, how = [(a, b)], "fuzzy"
        if how != "coordinated":
            used.add(segments[0])
        text = phrase if how == "coordinated" else note[segments[0][0] : segments[0][1]]
        out.append({"phrase": text, "how": how, "segments": [{"start": a, "stop": b} for a, b in segments]})
    return out


_ARROW = pa.list_(pa.struct([("phrase", pa.string()), ("how", pa.string()), ("segments", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]))


@arrow_udf(PLACED)
def placed(note: pa.Array, phrases: pa.Array) -> pa.Array:
    parts = []
    # A few notes at a time as Python objects; what stays of them is Arrow's.
    for low in range(0, len(note), 256):
        rows = zip(note.slice(low, 256), phrases.slice(low, 256))
        parts.append(pa.array([place(n.as_py() or "", p.as_py() or []) for n, p in rows], _ARROW))
    return pa.concat_arrays(parts) if parts else pa.array([], _ARROW)


class TooLarge(Exception):
    """What a provider raises for a request it finds too large."""


def decide(items: DataFrame, connect: Callable[[], Callable[[list[dict]], list[dict]]], schema: str, batch: int = 8) -> DataFrame:
    """Ask a provider for decisions: one connection for each partition, ``batch`` items a request;
    a request that is too large is halved, an item too large alone has no decision."""

    def ask(client, rows: list[dict]) -> list[dict]:
        try:
            return client(rows)
        except TooLarge:
            half = len(rows) // 2
            return ask(client, rows[:half]) + ask(client, rows[half:]) if half else []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, names = connect(), [f.split()[0] for f in schema.split(", ")]
        for frame in frames:
            rows = frame.to_dict("records")
            out = [d for i in range(0, len(rows), batch) for d in ask(client, rows[i : i + batch])]
            yield pd.DataFrame(out, columns=names)

    return items.mapInPandas(run, schema)


def json_payload(raw: Column) -> Column:
    """The first JSON object or list of an answer, without the code fence around it."""
    bare = F.regexp_replace(raw, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1), F.lit(""))


def batch_decisions(raw: Column, one: str = "mention_id string, hpo_id string, verdict string, confidence string") -> Column:
    """array<struct>: decisions however they are wrapped: a list, ``decisions``, ``results``,
    ``decision`` (one or many), ``items``, a bare decision, or an object keyed by mention id."""
    text = json_payload(raw)
    listed = f"array<struct<{one.replace(' ', ':').replace(',:', ',')}>>"
    parse = lambda t: F.from_json(t, listed)
    field = lambda k: F.get_json_object(text, f"$.{k}")
    as_list = lambda t: F.when(t.startswith("["), parse(t)).when(t.startswith("{"), parse(F.concat(F.lit("["), t, F.lit("]"))))
    keyed = F.from_json(text, "map<string,string>")
    entries = F.filter(F.map_entries(keyed), lambda e: e["value"].startswith("{"))
    by_key = F.transform(entries, lambda e: F.struct(*[
        (F.coalesce(F.get_json_object(e["value"], f"$.{n}"), e["key"]) if n == "mention_id" else F.get_json_object(e["value"], f"$.{n}")).alias(n)
        for n in (x.split()[0] for x in one.split(", "))
    ]))
    bare = F.coalesce(field("hpo_id"), field("candidate_hpo_ids"), field("verdict")).isNotNull()
    return (
        F.when(text.startswith("["), parse(text))
        .when(field("decisions").isNotNull(), as_list(field("decisions")))
        .when(F.substring(F.ltrim(field("results")), 1, 1) == "[", as_list(field("results")))
        .when(field("decision").isNotNull(), as_list(field("decision")))
        .when(F.substring(F.ltrim(field("items")), 1, 1) == "[", as_list(field("items")))
        .when(bare, as_list(text))
        .otherwise(by_key)
    )
