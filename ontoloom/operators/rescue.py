"""Rewritten phrases for mentions that no candidate fits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import swap_of, tokens

#: Words and the nouns they become, and names that are never rewritten.
NOUNS = {
    "microspherophakic": "microspherophakia",
    "spherophakic": "spherophakia",
    "microphthalmic": "microphthalmia",
    "anophthalmic": "anophthalmia",
    "edematous": "edema",
    "glaucomatous": "glaucoma",
    "hypertrophic": "hypertrophy",
    "hypoplastic": "hypoplasia",
    "atrophic": "atrophy",
    "opacification": "opacity",
    "opacified": "opacity",
}
NEVER = ("marfan syndrome", "peutz-jeghers syndrome", "pjs", "ehlers-danlos syndrome", "turner syndrome", "down syndrome", "williams syndrome", "prader-willi syndrome", "angelman syndrome", "fragile x syndrome")


def eligible(normalized: Column, status: Column) -> Column:
    """Affirmed or normal, and no disease or syndrome."""
    return status.isin("affirmed", "normal") & ~normalized.isin(*NEVER) & ~normalized.contains("syndrome") & ~normalized.contains("disease")


def variants(normalized: Column, nouns: dict[str, str] | None = None) -> Column:
    """array<struct<phrase, how, level>> of a normalised phrase, at most two: its words as nouns (level
    2), and ``B A`` for ``A of the B`` (level 3); none that is the phrase itself or comes twice."""
    table = F.create_map(*[F.lit(x) for kv in (nouns or NOUNS).items() for x in kv])
    nouned = F.array_join(F.transform(tokens(normalized), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")
    parts = r"^(.+?)\s+of(?:\s+the)?\s+(.+)$"
    tail = F.filter(F.split(F.regexp_extract(normalized, parts, 2), " "), lambda w: (w != "crystalline") & (w != ""))
    swapped = F.when(normalized.rlike(parts), F.trim(F.concat_ws(" ", F.array_join(tail, " "), F.regexp_extract(normalized, parts, 1))))
    one = lambda phrase, how, level: F.struct(phrase.alias("phrase"), F.lit(how).alias("how"), F.lit(level).alias("level"))
    both = F.array(one(nouned, "allowlist_adjective_to_noun", 2), one(swapped, "syntactic_head_swap", 3))
    return F.filter(both, lambda v, k: v["phrase"].isNotNull() & (v["phrase"] != normalized) & ((k == 0) | (v["phrase"] != nouned)))


__all__ = ["NEVER", "NOUNS", "eligible", "swap_of", "variants"]
