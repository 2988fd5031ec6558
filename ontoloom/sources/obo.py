"""Ontology files (OBO) as DataFrames, by stanza."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_phrase, record_key

LABEL, SYNONYM, ADDON = "label", "synonym", "addon"


def _all(tag: str, pattern: str = r"(.*?)\s*$") -> Column:
    return F.regexp_extract_all("stanza", F.lit(rf"(?m)^{tag}:[ \t]*{pattern}"), F.lit(1))


def _one(tag: str, pattern: str = r"(.*?)\s*$") -> Column:
    return F.get(_all(tag, pattern), 0)


def terms(spark: SparkSession, path: str) -> DataFrame:
    """id, label, definition, synonyms (text, scope), parents, alternate_ids, obsolete, replaced_by
    and consider of every ``[Term]``. The text is cut at lines that open a stanza, so a large file
    is read as records, not as a whole."""
    records = spark.read.text(path, lineSep="\n[").select(F.regexp_replace("value", r"\r", "").alias("stanza"))
    records = records.where(F.col("stanza").rlike(r"^\[?Term\]"))
    quoted = r'"((?:[^"\\]|\\.)*)"'
    synonyms = F.regexp_extract_all("stanza", F.lit(rf"(?m)^synonym:[ \t]*{quoted}"), F.lit(1))
    scopes = F.regexp_extract_all("stanza", F.lit(rf"(?m)^synonym:[ \t]*{quoted}[ \t]*(EXACT|BROAD|NARROW|RELATED)?"), F.lit(2))
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r'\\"', '"'), r"\\\\", r"\\")
    pairs = F.arrays_zip(F.transform(synonyms, plain).alias("text"), F.transform(scopes, lambda s: F.coalesce(F.nullif(s, F.lit("")), F.lit("RELATED"))).alias("scope"))
    bare = r"([^\s!]+)"
    return records.select(
        _one("id", bare).alias("id"),
        _one("name").alias("label"),
        plain(_one("def", quoted)).alias("definition"),
        pairs.cast("array<struct<text:string,scope:string>>").alias("synonyms"),
        _all("is_a", bare).alias("parents"),
        _all("alt_id", bare).alias("alternate_ids"),
        F.coalesce(_one("is_obsolete") == "true", F.lit(False)).alias("obsolete"),
        _all("replaced_by", bare).alias("replaced_by"),
        _all("consider", bare).alias("consider"),
    ).where("id IS NOT NULL")


def data_version(spark: SparkSession, path: str) -> str | None:
    row = spark.read.text(path).where(F.col("value").startswith("data-version:")).select(F.regexp_extract("value", r":\s*(\S+)", 1).alias("v")).first()
    return row and row.v


def edges(terms_: DataFrame) -> DataFrame:
    return terms_.select(F.col("id").alias("child"), F.explode("parents").alias("parent"))


def loader_aliases(terms_: DataFrame) -> DataFrame:
    """(source_id, target_id): itself, alternate ids, and for obsolete terms the last replacement,
    one step."""
    target = F.when(F.col("obsolete") & (F.size("replaced_by") > 0), F.try_element_at("replaced_by", F.lit(-1))).otherwise(F.col("id"))
    return terms_.select(F.explode(F.array_union(F.array("id"), "alternate_ids")).alias("source_id"), target.alias("target_id")).distinct()


def snapshot_aliases(terms_: DataFrame) -> DataFrame:
    """The same, but obsolete terms go on only when they have exactly one replacement."""
    target = F.when(F.col("obsolete") & (F.size("replaced_by") == 1), F.get("replaced_by", 0)).otherwise(F.col("id"))
    return terms_.select(F.explode(F.array_union(F.array("id"), "alternate_ids")).alias("source_id"), target.alias("target_id")).distinct()


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    """Source ids with several targets: none in a sound ontology."""
    return aliases.groupBy("source_id").agg(F.count_distinct("target_id").alias("n")).where("n > 1")


def phrases(terms_: DataFrame) -> DataFrame:
    """concept_id, phrase, normalized, source, scope, record_key: the label, then synonyms in order
    of their normal form; of phrases alike but for case the first."""
    label = F.array(F.struct(F.col("label").alias("text"), F.lit("").alias("scope")))
    rows = terms_.where("label IS NOT NULL").select("id", F.posexplode(F.concat(label, "synonyms")).alias("k", "p"))
    rows = rows.select(F.col("id").alias("concept_id"), F.trim("p.text").alias("phrase"), F.when(F.col("k") == 0, 0).otherwise(1).alias("own"), F.when(F.col("k") == 0, "EXACT").otherwise(F.col("p.scope")).alias("scope"))
    rows = rows.withColumn("normalized", normalize_phrase(F.col("phrase"))).where("normalized <> ''")
    first = F.min_by(F.struct("phrase", "normalized", "own", "scope"), F.struct("own", "normalized", "scope", "phrase"))
    rows = rows.groupBy("concept_id", F.lower("phrase").alias("folded")).agg(first.alias("f")).select("concept_id", "f.*")
    source = F.when(F.col("own") == 0, LABEL).otherwise(SYNONYM)
    rows = rows.withColumn("source", source).drop("own")
    return rows.withColumn("record_key", record_key(*[F.col(c) for c in ("concept_id", "phrase", "normalized", "source", "scope")]))


def with_addons(own: DataFrame, addons: DataFrame, aliases: DataFrame) -> DataFrame:
    """Phrases with the add-on rows (HP_ID, info) that are new to their concept. Ids that the
    ontology doesn't know are an error."""
    rows = addons.select(F.trim("HP_ID").alias("source_id"), F.trim("info").alias("phrase")).join(aliases, "source_id", "left")
    checked = F.when(F.col("target_id").isNull(), F.raise_error(F.concat(F.lit("unknown id "), F.col("source_id")))).otherwise(F.col("target_id"))
    rows = rows.select(checked.cast("string").alias("concept_id"), "phrase").withColumns({"normalized": normalize_phrase(F.col("phrase")), "source": F.lit(ADDON), "scope": F.lit("RELATED")})
    rows = rows.where("normalized <> ''").dropDuplicates(["concept_id", "normalized"])
    rows = rows.alias("n").join(own.alias("o"), (F.col("n.concept_id") == F.col("o.concept_id")) & (F.lower("n.phrase") == F.lower("o.phrase")), "left_anti")
    rows = rows.withColumn("record_key", record_key(*[F.col(c) for c in ("concept_id", "phrase", "normalized", "source", "scope")]))
    return own.unionByName(rows.select(*own.columns))
