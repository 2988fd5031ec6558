"""Assertion status of mentions, as one ordered CASE over columns derived from the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The cue phrases of each status, and what ends a clause.
FAMILY_SECTION = r"(?i)\b(?:family|pedigree|maternal|paternal)\b"
CUES = {
    "family_history": r"family history|mother|father|maternal|paternal|parent|sibling|brother|sister|son|daughter",
    "hypothetical": r"at risk for|risk of|monitor for|watch for|if (?:the )?patient (?:develops|has)|in case of",
    "resolved": r"resolved|resolution of|no longer|previously present but|former(?:ly)?|remote history of",
    "uncertain": r"possible|possibly|suspected|suspicious for|may have|might have|could have|concern for|question of|rule out|r/o|differential(?: diagnosis)?",
    "negated": r"no|not|denies|denied|without|absence of|absent|negative for|free of|never had|no evidence of",
    "normal": r"normal|normally|unremarkable|within normal limits|intact",
}
AFTER = {
    "negated": r"(?i)^\s*(?:was|were|is|are|has been|have been)?\s*(?:not present|absent|negative|ruled out)\b",
    "normal": r"(?i)^\s*(?:was|were|is|are|appears?|remains?)?\s*(?:normal|unremarkable|within normal limits|intact)\b",
    "resolved": r"(?i)^\s*(?:has|have|had|was|were|is|are)?\s*(?:resolved|no longer present)\b",
}
CONTEXT = r"it|this|these|those|they|former|latter|respectively|however|therefore|subsequently|also|both"
_NEW_SUBJECT = (
    r"\band\b(?=\s+(?:(?:the|a|an|his|her|their|this)\s+)?(?:(?:abdominal|chest|cranial|cardiac|renal|thyroid|pelvic)\s+)?"
    r"(?:patient|proband|child|adult|examination|exam|imaging|ct|mri|ultrasound|sonography|radiograph|x-ray|scan|biopsy|"
    r"colonoscopy|endoscopy|echocardiogram|laboratory|labs?|bloodwork)\s+"
    r"(?:was|were|is|are|had|has|showed|revealed|demonstrated|identified|found|noted)\b)"
)
_CLAUSE = rf"(?is)^.*(?:[,;:]|\bbut\b|\bhowever\b|\balthough\b|{_NEW_SUBJECT})"
_HEADING = r"(?m)^[ \t]*([A-Za-z][A-Za-z /_-]{1,48}):[ \t]*$"


def section_at(text: Column, start: Column) -> Column:
    """The last heading (a line that ends with a colon) before ``start``; null if there is none."""
    head = F.substring(text, F.lit(1), start)
    return F.trim(F.try_element_at(F.regexp_extract_all(head, F.lit(_HEADING), F.lit(1)), F.lit(-1)))


def with_assertion(rows: DataFrame, text: str = "text", start: str = "start", stop: str = "stop") -> DataFrame:
    """Adds status, cue, sentence and section. Offsets are half-open, in code points."""
    head = F.substring(F.col(text), F.lit(1), F.col(start))
    tail = F.substring(F.col(text), F.col(stop) + 1, F.length(text))
    mention = F.substring(F.col(text), F.col(start) + 1, F.col(stop) - F.col(start))
    left = F.regexp_replace(F.regexp_extract(head, r"([^\n.!?;]*+)\z", 1), r"^(?U)\s+", "")
    right = F.regexp_replace(F.regexp_extract(tail, r"^([^\n.!?;]*)", 1), r"(?U)\s+\z", "")
    clause = F.regexp_replace(left, _CLAUSE, "")
    before = F.substring(clause, F.greatest(F.lit(1), F.length(clause) - 119), F.lit(120))
    rows = rows.withColumns({"_before": before, "_mention": mention, "_after": F.substring(right, 1, 80), "section": section_at(F.col(text), F.col(start)), "sentence": F.trim(F.concat(left, mention, right))})

    def last(pattern: str, where: str) -> Column:
        return F.try_element_at(F.regexp_extract_all(where, F.lit(rf"(?i)\b(?:{pattern})\b"), F.lit(0)), F.lit(-1))

    found: list[tuple[str, Column]] = [("family_history", F.when(F.col("section").rlike(FAMILY_SECTION), F.col("section")))]
    for status, pattern in CUES.items():
        found += [(status, last(pattern, "_before")), (status, last(pattern, "_mention"))]
    found += [(status, F.trim(F.nullif(F.regexp_extract("_after", pattern, 0), F.lit("")))) for status, pattern in AFTER.items()]
    ranked = F.coalesce(*[F.when(cue.isNotNull(), F.struct(F.lit(s).alias("status"), cue.alias("cue"))) for s, cue in found], F.struct(F.lit("affirmed").alias("status"), F.lit(None).cast("string").alias("cue")))
    rows = rows.withColumn("_found", ranked)
    return rows.withColumns({"status": F.col("_found.status"), "cue": F.col("_found.cue")}).drop("_found", "_before", "_mention", "_after")


def routing_category(status: Column, phrase: Column) -> Column:
    """Family History, Normal or Abnormal."""
    plain = phrase.rlike(r"(?i)\b(?:normal|unremarkable|within normal limits|intact)\b")
    return F.when(status == "family_history", "Family History").when(status.isin("normal", "negated") | plain, "Normal").otherwise("Abnormal")


def context_reason(sentence: Column, phrase_words: Column, n_candidates: Column, dense_gap: Column, lexical_gap: Column, status: Column) -> Column:
    """Why a mention needs its neighbour sentences; null if it doesn't."""
    cue = sentence.rlike(rf"(?i)\b(?:{CONTEXT})\b")
    return (
        F.when(cue, "context-cue")
        .when((phrase_words <= 2) & (n_candidates > 1), "short-ambiguous-phrase")
        .when((n_candidates > 1) & ((lexical_gap <= 3.0) | (dense_gap <= 0.02)), "close-candidate-scores")
        .when(status != "affirmed", "assertion-disambiguation")
    )
