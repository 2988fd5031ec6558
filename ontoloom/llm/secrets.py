"""Secret scans with a random forest for false positives, in Spark expressions only (operator 1).

Two kinds of candidates are taken from the words of a text: runs of 16 or more of ``A-Z a-z 0-9 + /
_ -`` with a letter and a digit; and, whatever their length and characters, values assigned (``=`` or
``:``) to a name that speaks of a secret, in one word or in three. Features are the length, how often
the kind of character changes, how likely its letters follow each other in the words of a dictionary,
how much of it such words cover, what its path (the column ``source``) looks like, and the words beside
it. A random forest, trained from labelled findings, tells secrets from look-alikes. The trained trees
are written out as nested CASE expressions, so scoring is part of the scan's own stage.

Null and empty texts have no candidates. Repeated rows give repeated findings, extra columns are
ignored, a missing or null path counts as an empty one, an empty table gives an empty one. A word is
looked at as a whole, however long.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import text_or_empty

_RUN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
_NAME = r"(?i)(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api_?-?key|access_?-?key|credentials?|auth)[A-Za-z_]*"
#: What is assigned in one word with its name; a value in quotes, and one without.
_ASSIGNED = _NAME + r"""["']?(?:=>|:=|[=:])(.+)$"""
_QUOTED, _BARE = r"""^\(?["']([^"']+)["']""", r"""^["'(]*(.+?)["',;.)]*$"""
_SIGN = r"^(?:=>|:=|[=:])$"
#: Words of names and placeholders: what they cover of a candidate is not random.
DICTIONARY = (
    "access account address admin api application auth base branch build cache change changeme client cloud code commit config "
    "content count create credential data database date default demo dummy element email enter example fake field file group "
    "handler hash here index insert item key length list local manager model module name null number object option page param "
    "password path placeholder private profile project public query record release replace request response result sample secret "
    "server service session setting source status string system table test text thread time token type update user value version "
    "your"
).split()
PREFIXES = {"AKIA": "aws access key", "ghp_": "github token", "sk_live_": "stripe key", "xoxb-": "slack token", "AIza": "google api key", "glpat-": "gitlab token"}
_NEAR = {
    "near_secret": r"(?i)key|secret|token|passw|pwd|credential|auth|bearer|api",
    "near_fake": r"(?i)example|sample|dummy|fake|placeholder|changeme|your|xxxx|test",
    "near_hash": r"(?i)sha|md5|commit|checksum|digest|hash|revision|uuid|guid|etag",
}
_PATH = {"path_test": r"(?i)test|example|fixture|sample|mock|docs?(?:/|$)", "path_settings": r"(?i)\.env|config|settings|secret|deploy|prod"}
FEATURES = ["length", "runs", "transitions", "covered", "digits", "capitals", "marks", "hexadecimal", "known", "assigned", *_NEAR, *_PATH]


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, word_index, candidate, word, beside (the words around it), path, assigned."""
    words = F.split(text_or_empty(), r"\s+", -1)
    word = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    # The name may hold the sign ("token: x") or the sign may stand alone ("token = x").
    named = lambda i: word(i - 1).rlike(_NAME + r"""["']?(?:=>|:=|[=:])$""") | (word(i - 1).rlike(_SIGN) & word(i - 2).rlike(_NAME + r"""["']?$"""))
    wanted = lambda i: ((F.length(word(i)) >= 16) & word(i).rlike(_RUN)) | word(i).rlike(_ASSIGNED) | (named(i) & (word(i) != ""))
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), wanted)
    near = lambda i: F.array_join(F.slice("words", F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), " ")
    found = F.transform(at, lambda i: F.struct(i.alias("word_index"), word(i).alias("word"), F.concat_ws(" ", near(i), F.get("words", i + 1)).alias("beside"), named(i).alias("named")))
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    rows = docs.select("doc_id", where.alias("path"), words.alias("words")).select("doc_id", "path", F.explode(found).alias("f"))
    rows = rows.select("doc_id", "path", "f.*")
    runs = F.filter(F.regexp_extract_all("word", F.lit(f"({_RUN})"), F.lit(1)), lambda c: c.rlike("[0-9]") & c.rlike("[A-Za-z]"))
    inside = F.regexp_extract("word", _ASSIGNED, 1)
    told = F.when(F.col("named") & (inside == ""), F.col("word")).otherwise(inside)
    alone = F.coalesce(F.nullif(F.regexp_extract(told, _QUOTED, 1), F.lit("")), F.regexp_extract(told, _BARE, 1))
    # Of an assigned value that is such a run, or holds it, the value is the candidate.
    others = F.filter(runs, lambda c: ~F.contains(alone, c))
    pick = F.concat(F.transform(F.filter(F.array(alone), lambda c: c != ""), lambda c: F.struct(c.alias("candidate"), F.lit(True).alias("assigned"))), F.transform(others, lambda c: F.struct(c.alias("candidate"), F.lit(False).alias("assigned"))))
    return rows.withColumn("c", F.explode(pick)).select("doc_id", "path", "word_index", "word", "beside", "c.candidate", "c.assigned")


def _transitions(words: list[str]) -> list[float]:
    """ln of how likely a letter follows another in ``words``, for each of 26 x 26 pairs."""
    pairs = Counter(p for w in words for p in zip(w, w[1:]))
    first = Counter(a for a, _ in pairs.elements())
    letters = "abcdefghijklmnopqrstuvwxyz"
    return [math.log((pairs[a, b] + 0.5) / (first[a] + 13)) for a in letters for b in letters]


def with_features(rows: DataFrame, dictionary: list[str] | None = None) -> DataFrame:
    """Adds FEATURES as doubles. ``dictionary``: words (lower case, a to z) that names are made of."""
    dictionary = list(dictionary or DICTIONARY)
    value, n = F.col("candidate"), F.length("candidate")
    left = lambda pattern, of=value: F.length(F.regexp_replace(of, pattern, ""))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9]+", "."), "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    lower = F.lower(value)
    table = F.lit(_transitions(dictionary))
    letter = lambda i: F.ascii(F.substring(lower, i, F.lit(1))) - 97
    is_letter = lambda c: (c >= 0) & (c < 26)
    steps = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: is_letter(letter(i)) & is_letter(letter(i + 1)) & (i < n))
    likely = F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.get(table, letter(i) * 26 + letter(i + 1)))
    around = F.concat_ws(" ", "beside", F.regexp_extract("word", r"^(.*?)[=:]", 1))
    out = {
        "length": n,
        "runs": (F.length(kinds) - 1) / n,
        "transitions": F.when(F.size(steps) > 0, likely / F.size(steps)).otherwise(0.0),
        "covered": (n - left(f"(?i){'|'.join(sorted(dictionary, key=len, reverse=True))}")) / n,
        "digits": (n - left("[0-9]")) / n,
        "capitals": (n - left("[A-Z]")) / n,
        "marks": (n - left("[^A-Za-z0-9]")) / n,
        "hexadecimal": value.rlike("^(?:[0-9a-f-]+|[0-9A-F-]+)$"),
        "known": value.rlike(f"^(?:{'|'.join(PREFIXES)})"),
        "assigned": F.col("assigned"),
        **{k: around.rlike(p) for k, p in _NEAR.items()},
        **{k: F.col("path").rlike(p) for k, p in _PATH.items()},
    }
    return rows.withColumns({k: c.cast("double") for k, c in out.items()})


def labelled_findings(spark: SparkSession, n: int = 4_000, held_out: bool = False) -> DataFrame:
    """Made findings in the columns of ``candidates``, with their label (1: secret) and sort. The sorts
    to learn from and those that are ``held_out`` are different ones: other names, forms, lengths and
    words around. Real labelled findings take the same shape."""
    i = F.col("id")
    noise = lambda k: F.sha2(F.concat_ws("/", i.cast("string"), F.lit(f"{k}{'t' if held_out else ''}")), 256)
    letters = lambda k: F.regexp_replace(F.base64(F.unhex(noise(k))), "[+/=]", "x")
    capital = lambda k: F.upper(F.translate(letters(k), "0189", "2345"))
    pick = lambda k, of: F.get(F.array(*map(F.lit, of)), F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(of))).cast("int"))
    prose = lambda k: pick(k, ["the", "with", "and", "then", "of", "value", "in", "used"])
    hexes = lambda k, m: F.substring(noise(k), 1, m)
    cut = lambda c, low, wide: F.substring(c, F.lit(1), F.lit(low) + F.pmod(F.xxhash64(i, F.lit(99)), F.lit(wide)).cast("int"))
    either = lambda c: F.when(F.pmod(F.xxhash64(i, F.lit(98)), F.lit(3)) == 0, F.upper(c)).otherwise(c)
    uuid = F.concat_ws("-", hexes(1, 8), hexes(2, 4), hexes(3, 4), hexes(4, 4), hexes(5, 12))
    name = F.concat_ws("_", pick(1, DICTIONARY), pick(2, DICTIONARY), pick(3, DICTIONARY), F.pmod(i, F.lit(100)).cast("string"))
    strong = F.concat(cut(letters(1), 5, 4), pick(4, ["!", "#", "@", "&", "$"]), hexes(2, 3))
    # sort, label, candidate, word around it ({}), words before, assigned
    made = [
        ("aws key", 1, F.concat(F.lit("AKIA"), F.substring(capital(1), 1, 16)), "{}", prose(6), False),
        ("hexadecimal token", 1, either(hexes(1, 40)), '"{}"', F.concat(pick(6, ["token", "api_key", "secret", "auth_token"]), F.lit(" =")), True),
        ("hexadecimal password", 1, cut(noise(1), 12, 12), "password={}", prose(6), True),
        ("password", 1, strong, "password={}", prose(6), True),
        ("password apart", 1, strong, '"{}"', F.concat(pick(6, ["password", "db_password", "passwd"]), F.lit(" =")), True),
        ("secret key", 1, F.substring(letters(1), 1, 40), "{}", F.concat(pick(6, ["aws_secret_access_key", "secret", "client_secret"]), F.lit(" =")), True),
        ("known prefix", 1, F.concat(pick(7, ["ghp_", "sk_live_", "glpat-", "AIza"]), F.substring(letters(1), 1, 32)), "{}", prose(6), False),
        ("api key", 1, cut(letters(1), 18, 14), "api_key:{}", prose(6), True),
        ("commit", 0, either(hexes(1, 40)), "{}", pick(6, ["commit", "revision", "sha1", "git commit"]), False),
        ("checksum", 0, either(hexes(1, 32)), "{}", pick(6, ["md5", "checksum", "etag", "digest"]), False),
        ("digest", 0, noise(1), "sha256:{}", prose(6), False),
        ("uuid", 0, either(uuid), "{}", pick(6, ["id", "uuid", "request", "session"]), False),
        ("name", 0, name, "{}", prose(6), False),
        ("placeholder", 0, F.concat(pick(6, ["your_api_key_here_", "example_token_value_", "changeme_password_", "dummy_secret_key_"]), F.pmod(i, F.lit(1000)).cast("string")), "key={}", prose(7), True),
        ("short placeholder", 0, pick(6, ["changeme", "password", "example", "xxxxxxxx", "********", "your_password", "<password>", "secret"]), "password={}", prose(7), True),
        ("no value", 0, pick(6, ["null", "none", "true", "false", "required", "string", "0", "yes", "os.environ", "input()", "request.token", "config.get"]), "{}", pick(8, ["password =", "token:", "auth =", "secret ="]), True),
        ("example key", 0, F.concat(F.lit("AKIA"), F.substring(capital(1), 1, 9), F.lit("EXAMPLE")), "{}", prose(6), False),
        ("file", 0, F.concat(pick(6, ["2023", "2024"]), F.lit("-report-"), pick(7, DICTIONARY), F.lit("-final-v2")), "{}", prose(8), False),
    ]
    unseen = [
        ("slack token", 1, F.concat(F.lit("xoxb-"), F.pmod(F.xxhash64(i), F.lit(10**11)).cast("string"), F.lit("-"), F.substring(letters(1), 1, 24)), "{}", prose(6), False),
        ("bearer", 1, cut(letters(1), 28, 12), "{}", F.concat(prose(5), F.lit(" Bearer")), False),
        ("upper-case token", 1, F.upper(hexes(1, 32)), "AUTH_TOKEN={}", prose(6), True),
        ("pwd", 1, F.concat(pick(3, ["Win", "Blue", "Kx"]), cut(letters(1), 4, 4), pick(4, ["%", "?", "*"]), hexes(2, 2)), "pwd:{}", prose(6), True),
        ("passphrase apart", 1, F.concat(cut(letters(1), 7, 6), pick(4, ["!", "+"]), hexes(2, 4)), "'{}'", F.concat(pick(6, ["passphrase", "root_pwd"]), F.lit(" =")), True),
        ("credential", 1, F.substring(letters(1), 1, 36), "{}", F.concat(pick(6, ["credential", "access_key"]), F.lit(" =")), True),
        ("tree hash", 0, hexes(1, 40), "{}", pick(6, ["tree hash", "parent commit", "at revision"]), False),
        ("long digest", 0, F.concat(noise(1), noise(2)), "sha512:{}", prose(6), False),
        ("guid", 0, F.upper(uuid), "{}", pick(6, ["guid", "object guid"]), False),
        ("path", 0, F.concat_ws("/", pick(1, DICTIONARY), pick(2, DICTIONARY), pick(3, DICTIONARY), F.concat(F.lit("v"), F.pmod(i, F.lit(9)).cast("string"))), "{}", prose(6), False),
        ("class", 0, F.concat(F.initcap(pick(1, DICTIONARY)), F.initcap(pick(2, DICTIONARY)), F.initcap(pick(3, DICTIONARY)), F.lit("Test"), F.pmod(i, F.lit(90)).cast("string")), "{}", prose(6), False),
        ("sample value", 0, F.concat(pick(6, ["sample-access-key-", "fake_credential_", "test_token_"]), F.pmod(i, F.lit(100)).cast("string")), "token={}", prose(7), True),
        ("type", 0, pick(6, ["str", "bool", "text", "field", "default", "int", "session.token", "value"]), "{}", pick(8, ["passwd:", "api_key =", "credential ="]), True),
        ("dashed title", 0, F.concat_ws("-", pick(1, DICTIONARY), pick(2, DICTIONARY), pick(3, DICTIONARY), F.lit("2022"), F.lit("draft")), "{}", prose(8), False),
    ]
    made = unseen if held_out else made
    kind = F.pmod(i, F.lit(len(made)))
    choose = lambda values: reduce(lambda c, kv: c.when(kind == kv[0], kv[1]), enumerate(values), F.when(F.lit(False), values[0]))
    return spark.range(n).select(
        i.alias("doc_id"),
        choose([F.lit(x[0]) for x in made]).alias("sort"),
        choose([F.lit(x[1]) for x in made]).cast("double").alias("label"),
        choose([x[2] for x in made]).alias("candidate"),
        choose([F.concat(F.lit(x[3].split("{}")[0]), x[2], F.lit(x[3].split("{}")[1])) for x in made]).alias("word"),
        F.concat_ws(" ", prose(11), choose([x[4] for x in made]), prose(13)).alias("beside"),
        pick(14, ["", "src3", "src12", "app/main", "config/prod", "tests/data", "docs/example"]).alias("path"),
        choose([F.lit(x[5]) for x in made]).alias("assigned"),
        F.lit(0).alias("word_index"),
    )


def fit(findings: DataFrame, trees: int = 20, depth: int = 6, seed: int = 7) -> RandomForestClassificationModel:
    """``findings`` is a bounded table of labelled findings."""
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(findings)).select("label", "features")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="0.5").fit(data)


def as_expression(model: RandomForestClassificationModel) -> Column:
    """The forest as an expression over FEATURES: the probability that a candidate is a secret."""

    def expression(node) -> Column:
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return F.lit(float(stats[1] / sum(stats)))
        split = node.split()
        below = F.col(FEATURES[split.featureIndex()]) <= float(split.threshold())
        return F.when(below, expression(node.leftChild())).otherwise(expression(node.rightChild()))

    return sum((expression(t._call_java("rootNode")) for t in model.trees), F.lit(0.0)) / F.lit(float(len(model.trees)))


def train(findings: DataFrame, trees: int = 20, depth: int = 6, seed: int = 7) -> Column:
    return as_expression(fit(findings, trees, depth, seed))


def secrets(docs: DataFrame, forest: Column, threshold: float = 0.5, path: str = "source") -> DataFrame:
    """Every candidate: doc_id, word_index, kind, length, value_sha256, score, is_secret. The
    value itself is not repeated."""
    rows = with_features(candidates(docs, path)).withColumn("score", forest)
    kind = reduce(lambda c, kv: c.when(F.startswith("candidate", F.lit(kv[0])), kv[1]), PREFIXES.items(), F.when(F.lit(False), "")).otherwise("generic")
    return rows.select(
        "doc_id", "word_index", kind.alias("kind"), F.col("length").cast("int").alias("length"),
        F.sha2("candidate", 256).alias("value_sha256"), F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("is_secret"),
    )
