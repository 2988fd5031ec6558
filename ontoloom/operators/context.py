"""Context of mentions: the sentences beside them, what is asked of a retriever, and what was missed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .assertion import context_reason

#: How much of a neighbour sentence is used, and the cues of sentences worth a second look.
ADJACENT = 280
LIST = r"(?i)[,;]|\b(?:and|with|including)\b"
MEASUREMENT = r"(?i)\b(?:high|low|raised|reduced|decreased|increased|elevated|abnormal)\b|\d+(?:\.\d+)?\s*(?:mg|g|mmol|µmol|cm|mm|kg|%|bpm|mmhg)\b"
STRUCTURE = (
    r"(?i)(?:^|\n)\s*(?:[-*•]|\d+[.)])\s+|\b(?:exam(?:ination)?|findings?|features?|phenotypes?|imaging|mri|ct|ultrasound|laboratory|labs?)\s*:|"
    r"\b(?:showed|shows|revealed|demonstrated|noted|observed|presented with)\b"
)


def overlaps(a: Column, b: Column) -> Column:
    """Of two structs (start, stop), half-open."""
    return (a["start"] < b["stop"]) & (a["stop"] > b["start"])


def sentence_index(sentences: Column, start: Column, stop: Column) -> Column:
    """Place (from 0) of the first sentence that the span overlaps; null if none does."""
    at = F.array_position(F.transform(sentences, lambda s: (s["start"] < stop) & (s["stop"] > start)), True)
    return F.when(at > 0, (at - 1).cast("int"))


def before(sentences: Column, index: Column) -> Column:
    """The end of the sentence before, null at the first."""
    text = F.when(index > 0, F.get(sentences, index - 1)["text"])
    return F.substring(text, F.greatest(F.lit(1), F.length(text) - ADJACENT + 1), F.lit(ADJACENT))


def after(sentences: Column, index: Column) -> Column:
    return F.substring(F.get(sentences, index + 1)["text"], 1, ADJACENT)


def retrieval_context(phrase: Column, phrase_words: Column, sentences: Column, index: Column) -> Column:
    """For phrases of up to three words: the phrase, the sentence before and its own; else null."""
    parts = [F.nullif(F.trim(c), F.lit("")) for c in (phrase, before(sentences, index), F.get(sentences, index)["text"])]
    return F.when((phrase_words <= 3) & index.isNotNull(), F.substring(F.concat_ws(" ", *parts), 1, 2 * ADJACENT))


def packet(status: Column, section: Column, sentence: Column, phrase_words: Column, candidates: Column, sentences: Column, index: Column) -> Column:
    """What a mapper is told of a mention: its section, subject, assertion and sentence, and the
    neighbour sentences where there is a reason for them. ``candidates``: array of structs with
    lexical_score and dense_score, best first."""
    gap = lambda k: F.abs(F.get(candidates, 0)[k] - F.get(candidates, 1)[k])
    reason = context_reason(sentence, phrase_words, F.size(candidates), gap("dense_score"), gap("lexical_score"), status)
    near = lambda c: F.when(reason.isNotNull(), c)
    return F.struct(
        section.alias("section"), F.when(status == "family_history", "relative").otherwise("patient").alias("subject"), status.alias("assertion"), sentence.alias("sentence"),
        near(before(sentences, index)).alias("preceding_sentence"), near(after(sentences, index)).alias("following_sentence"), reason.alias("extended_context_reason"),
    )


def coverage_target(sentence: Column, recognised: Column, first: Column) -> Column:
    """Whether a sentence (start, stop, text) needs a second look: a recogniser's span (array of
    structs) in it meets no span of the first pass, or its words suggest more than that pass has."""
    own = F.filter(first, lambda f: overlaps(sentence, f))
    missed = F.exists(recognised, lambda r: overlaps(sentence, r) & ~F.exists(first, lambda f: overlaps(r, f)))
    has, text = F.size(own) > 0, sentence["text"]
    return missed | (has & text.rlike(LIST)) | (~has & (text.rlike(MEASUREMENT) | text.rlike(STRUCTURE)))


def without_modifiers(ids: Column, modifiers: Column) -> Column:
    """(kept, modifiers): ids that stand for findings, and those that only modify one, in order."""
    return F.struct(F.array_sort(F.array_except(ids, modifiers)).alias("kept"), F.array_sort(F.array_intersect(ids, modifiers)).alias("modifiers"))


def bounded_candidate(candidate: Column, rank: Column) -> Column:
    """A candidate as a mapper sees it: the first four with a short definition, three synonyms and two
    parents, the others without."""
    near = rank <= 4
    none = F.array().cast("array<string>")
    short = lambda c, n: F.when(near, F.slice(F.coalesce(c, none), 1, n)).otherwise(none)
    return F.struct(
        candidate["hpo_id"].alias("hpo_id"), candidate["term"].alias("term"),
        F.when(near, F.substring(F.coalesce(candidate["definition"], F.lit("")), 1, 160)).otherwise("").alias("definition"),
        short(candidate["synonyms"], 3).alias("synonyms"), short(candidate["parents"], 2).alias("parents"),
    )


def candidate_row(hpo_id: Column, term: Column, score: Column, definition: Column, phrases: Column, parents: Column, ranks: dict[str, Column]) -> Column:
    """A candidate with what is known of it; ``ranks``: the rank in each lane, by the lane's name."""
    methods = F.array_compact(F.array(*[F.when(r.isNotNull(), F.lit(n)) for n, r in ranks.items()]))
    return F.struct(
        hpo_id.alias("hpo_id"), term.alias("term"), F.round(score, 8).alias("score"), F.nullif(F.substring(definition, 1, 500), F.lit("")).alias("definition"),
        F.slice(F.array_sort(F.array_distinct(phrases)), 1, 12).alias("synonyms"), parents.alias("parents"), methods.alias("source_methods"),
    )
