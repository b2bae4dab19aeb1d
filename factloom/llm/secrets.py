"""Secret findings, with false positives removed by a random forest.

Candidates are long runs of key characters, values assigned to a secret's name whatever their
length, passwords in addresses and dotted tokens; the name in name=value (up to 64 characters)
is no part of one.  A forest trained on labelled findings judges a candidate by its length, the
transitions between its characters, how much of it dictionary words cover, the path it stands in
and the words around it.  The forest alone decides.  DataFrame functions only; it is pyspark.ml's.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from factloom.llm.common import written

#: Labelled findings of each class that the forest is fitted on, in the order of a hash.
FIT_ROWS = 10_000
#: How often a word must stand alone in the texts to count as a dictionary word.
DICTIONARY_COUNT = 3
#: Names that values are kept secret under, and folders of made-up values.
SECRET_WORDS = [
    "apikey", "api_key", "auth", "bearer", "credential", "key", "passwd", "password", "pwd",
    "secret", "token",
]
#: A name that ends in such a word; _, - and a change of case begin one.
_NAME = r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?i:" + "|".join(SECRET_WORDS) + ")"
_ASSIGNED = r"""["'`]?[ \t]{0,3}[:=][ \t]{0,3}"""
_RUN = "[A-Za-z0-9+/_=-]"
#: The first that matches at a place: a quoted or bare value after a secret's name, a dotted
#: token, the value of an unspaced name=value, any other run of key characters.  What costs one
#: character to rule out comes first, as every place of a text is tried.
CANDIDATE = "(?:" + "|".join((
    rf"""(?<=["'`])(?<=[:=][ \t]{{0,3}}["'`])(?<={_NAME}{_ASSIGNED}["'`])(?:[^"'`\r\n]{{4,}}+(?=["'`])|[^"'`\s]{{4,}}+)""",
    rf"""(?<=[:=])(?<={_NAME}["'`]?[:=])(?![=:])[^\s"'`,;&<>(){{}}\[\]]{{4,}}""",
    rf"""(?<=[ \t])(?<=[:=][ \t]{{1,3}})(?<={_NAME}{_ASSIGNED})(?=[^\s"'`,;&<>(){{}}\[\]]*[^\sA-Za-z"'`,;&<>(){{}}\[\].:?])[^\s"'`,;&<>(){{}}\[\]]{{4,}}""",
    r"""(?<=:)(?<=://[^\s/:@"'`]{0,64}:)[^\s/@"'`]{4,}+(?=@\w)""",
    r"(?<![A-Za-z0-9+/_.@\\-])[A-Za-z0-9_-]{2,}+(?:\.[A-Za-z0-9_-]{5,}+(?=\.[A-Za-z0-9_-]{5}))*+\.[A-Za-z0-9_-]{16,}+",
    rf"(?<==)(?<=(?<!{_RUN})[A-Za-z0-9+/_-]{{1,64}}=)(?!=){_RUN}{{16,}}",
    rf"(?<!{_RUN})(?={_RUN}{{16}})(?![A-Za-z0-9+/_-]{{1,64}}=(?!=){_RUN}{{16}})(?![A-Za-z0-9+/_-]{{0,64}}{_NAME}=[^=\s]){_RUN}{{16,}}",
)) + ")"
#: What a text needs to hold a candidate at all, cheaper to look for.
_HOPE = rf"(?<!{_RUN}){_RUN}{{16}}|(?i:" + "|".join(SECRET_WORDS) + rf"){_ASSIGNED}|://"
#: Header and payload of a signed JSON token, whose braces are encoded.
JSON_TOKEN = r"^eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\."
#: Words before a digest or an identifier, which are random but no secrets.
DIGEST_WORDS = ["checksum", "commit", "digest", "etag", "hash", "id", "md5", "revision", "sha1", "sha256", "uuid"]
EXAMPLE_PATHS = ["doc", "example", "fixture", "mock", "sample", "test"]
FEATURES = [
    "n", "runs", "digits", "capitals", "marks", "entropy", "pairs", "coverage", "named", "assigned",
    "quoted", "in_path", "slashes", "example_path", "digest_word",
    "in_address",
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DIGITS, _MARKS = "0123456789", "+/_=-"
#: Letters, one digit and one mark stand for all characters in the transition table.
_SYMBOLS = 28


#: Each known finding, as SQL over hex, mix and word: its label and the text it stands in.
KNOWN_FINDINGS = [
    (1, "'use the api key sk-' || left(mix, 32) || ' here'"),
    (1, "'api_key = \"' || left(mix, 24) || '\"'"),
    (1, "'Authorization: Bearer ' || left(mix, 40)"),
    (1, "'password: \"' || left(mix, 8) || '!\"'"),
    (1, "'pwd=' || initcap(word) || left(hex, 2) || '!x'"),
    (1, "'password = \"' || repeat(word || ' ', 6) || left(hex, 4) || '\"'"),
    (1, "'token ' || left(hex, 40)"),
    (1, "'our token is ' || left(mix, 36) || '.'"),
    (1, "'deployed with AKIA' || upper(left(hex, 16)) || ' now'"),
    (1, "'postgres://admin:' || left(mix, 10) || '!x@host/base'"),
    (1, "'GITHUB_TOKEN=ghp_' || left(mix, 36)"),
    (1, "'log in with ' || left(mix, 38) || ' first'"),
    (1, "'sent eyJhbGciOiJIUzI1NiJ9.eyJ' || left(mix, 30) || '.' || right(mix, 38)"),
    (1, "left(mix, 40)"),
    (0, "'commit ' || left(hex, 40) || ' mends it'"),
    (0, "'sha256: ' || hex"),
    (0, "'md5 checksum ' || left(hex, 32)"),
    (0, "'revision ' || left(hex, 40)"),
    (0, "'uuid ' || regexp_replace(left(hex, 32), '^(.{8})(.{4})(.{4})(.{4})', '$1-$2-$3-$4-')"),
    (0, "'see folder/' || word || '/name' || left(hex, 4) || '/filename'"),
    (0, "'import company.package.' || word || '.' || initcap(word) || 'Configuration'"),
    (0, "'order number ' || left(translate(hex, 'abcdef', '012345'), 16)"),
    (0, "'token = \"' || word || '_' || word || '_value\"'"),
    (0, "'password: \"' || word || '\"'"),
    (0, "'api key YOUR_' || upper(word) || '_KEY_GOES_HERE'"),
    (0, "'the ' || word || word || word || word || ' ends'"),
    (0, "'then get' || initcap(word) || 'Configuration' || initcap(word) || ' runs'"),
    (0, "repeat(element_at(array('-', '=', '_'), 1 + nth % 3), 20 + nth)"),
]
#: Texts made of each known finding, and how many found ones each weighs in the fit.
KNOWN_TEXTS, KNOWN_WEIGHT = 16, 8.0
_WORDS = ["window", "customer", "garden", "invoice", "number", "station", "letter", "market"]


def known_findings(spark: SparkSession) -> DataFrame:
    """(doc_id, text, label): texts with one finding each whose label its form settles.

    Digits and letters come from SHA-256, so the rows are the same on every run.
    """
    digest = F.sha2(F.col("id").cast("string"), 256)
    rows = spark.range(len(KNOWN_FINDINGS) * KNOWN_TEXTS).select(
        F.col("id").alias("doc_id"),
        (F.col("id") % len(KNOWN_FINDINGS)).alias("form"),
        F.floor(F.col("id") / len(KNOWN_FINDINGS)).cast("int").alias("nth"),
        digest.alias("hex"),
        F.translate(F.base64(F.unhex(F.concat(digest, F.sha2(digest, 256)))), "+/=", "").alias("mix"),
        F.get(F.array(*map(F.lit, _WORDS)), (F.col("id") * 5 % len(_WORDS)).cast("int")).alias("word"),
    )
    # Cases beside each other, not within each other: the driver walks over every level of a plan.
    text, label = F, F
    for i, (known, made) in enumerate(KNOWN_FINDINGS):
        here = F.col("form") == i
        text, label = text.when(here, F.expr(made)), label.when(here, F.lit(float(known)))
    return rows.select("doc_id", text.alias("text"), label.alias("label"))


def _hits(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"({CANDIDATE})"), 1)
    return F.when(text.rlike(_HOPE), found).otherwise(F.array().cast("array<string>"))


def _gaps(text: Column) -> Column:
    return F.split(text, CANDIDATE, -1)


def candidates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str | None = "source",
) -> DataFrame:
    """(doc_id, text_hash, path, nth, start, value, before, after) of each candidate.

    nth counts the candidates of a text from 0; start is its first code point; before reaches
    past the candidate before it, after to the next one, at most 48 and 24 characters.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        (F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")).alias("path"),
        F.monotonically_increasing_id().alias("row"),
        _hits(text).alias("hits"),
        text.alias("text"),
    )
    # The row number keeps the filter above the hits, so that they are looked for once.
    rows = rows.where(F.size("hits") > 0).withColumn("gaps", _gaps(F.col("text"))).drop("text")
    found = rows.select(
        "doc_id", "text_hash", "path", "row",
        F.explode(
            F.transform(
                "hits",
                lambda h, i: F.struct(
                    i.alias("nth"),
                    h.alias("value"),
                    # The neighbouring candidate may be the name of this one.
                    F.right(
                        F.concat(
                            F.when(i > 0, F.get("hits", F.greatest(i - 1, F.lit(0)))).otherwise(""),
                            F.get("gaps", i),
                        ),
                        F.lit(48),
                    ).alias("before"),
                    F.left(F.get("gaps", i + 1), F.lit(24)).alias("after"),
                    F.length(F.get("gaps", i)).alias("gap"),
                ),
            )
        ).alias("hit"),
    )
    found = found.select("doc_id", "text_hash", "path", "row", "hit.*")
    so_far = Window.partitionBy("row").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.length("value")).over(so_far)
    return found.select(
        "doc_id", "text_hash", "path", "nth", (end - F.length("value")).alias("start"), "value",
        "before", "after",
    )


def _dictionary(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n): lower-case words that stand alone often enough, over all texts."""
    words = docs.select(F.explode(F.split(F.lower(text_col), r"[\s.,;:!?]+")).alias("word"))
    return (
        words.where(F.col("word").rlike("^[a-z]{3,}$"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= DICTIONARY_COUNT)
    )


def _symbol(char: Column) -> Column:
    code = F.ascii(char)
    return F.when(code.between(97, 122), code - 97).when(code == 48, 26).otherwise(27)


def _transitions(dictionary: DataFrame) -> list[float]:
    """log2 P(next | symbol) over dictionary words; at most 28 x 28 numbers."""
    pairs = dictionary.select(
        "n",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.length("word") - 1),
                lambda i: F.substring(F.col("word"), i, F.lit(2)),
            )
        ).alias("pair"),
    )
    counts = [1.0] * (_SYMBOLS * _SYMBOLS)
    for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 26 x 26 rows at most
        counts[(ord(r["pair"][0]) - 97) * _SYMBOLS + ord(r["pair"][1]) - 97] += r["n"]
    out = []
    for a in range(_SYMBOLS):
        row = counts[a * _SYMBOLS : (a + 1) * _SYMBOLS]
        out += [math.log2(c / sum(row)) for c in row]
    return out


def _coverage(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(value, coverage): the share of each value that dictionary words spell."""
    parts = F.regexp_extract_all("value", F.lit("([A-Z]?[a-z]{2,}|[A-Z]{3,})"), 1)
    values = found.select("value").distinct()
    spelled = values.select("value", F.explode(parts).alias("part"))
    spelled = spelled.select("value", F.lower("part").alias("word"))
    # Most words of the dictionary are no part of any candidate and need not be moved again.
    known = spelled.select("word").distinct().join(dictionary, "word", "left_semi")
    return (
        spelled.join(known, "word")
        .groupBy("value")
        .agg(F.sum(F.length("word")).alias("covered"))
        .select("value", "covered")
    )


def with_features(found: DataFrame, dictionary: DataFrame, transitions: list[float]) -> DataFrame:
    """Candidates with the columns of FEATURES."""
    # One literal: as an array of literals it would make the driver plan 784 of them wherever it stands.
    table = F.lit(np.array(transitions))
    kinds = F.translate(
        "value", _UPPER + _LOWER + _DIGITS + _MARKS, "u" * 26 + "l" * 26 + "d" * 10 + "s" * 5
    )
    plain = F.translate(F.lower("value"), _DIGITS + _MARKS, "0" * 10 + "-" * 5)
    share = lambda kind: F.length(F.translate("kinds", "ulds".replace(kind, ""), "")) / F.col("n")
    rows = found.join(_coverage(found, dictionary), "value", "left").select(
        "*",
        F.length("value").alias("n"),
        F.regexp_replace(kinds, "[^ulds]", "s").alias("kinds"),
        F.split(plain, "").alias("chars"),
        F.array_distinct(F.split("value", "")).alias("letters"),
    )
    entropy = F.aggregate(
        "letters",
        F.lit(0.0),
        lambda s, c: s
        - ((F.col("n") - F.length(F.replace("value", c, F.lit("")))) / F.col("n"))
        * F.log2((F.col("n") - F.length(F.replace("value", c, F.lit("")))) / F.col("n")),
    )
    pairs = F.aggregate(
        F.sequence(F.lit(0), F.col("n") - 2),
        F.lit(0.0),
        lambda s, i: s
        + F.get(table, (_symbol(F.get("chars", i)) * _SYMBOLS + _symbol(F.get("chars", i + 1))).cast("int")),
    )
    before = F.lower("before")
    address = before.rlike(r"//[^\s/:@]*:$") & F.col("after").rlike(r"^@\w")
    flags = {
        "named": F.col("before").rlike(_NAME + "[^A-Za-z]*$"),
        "assigned": before.rlike(r"""[=:]\s*["'`]?\s*$"""),
        "quoted": before.rlike(r"""["'`]$""") & F.col("after").rlike(r"""^["'`]"""),
        "in_path": ~address & (before.rlike(r"[./\\@]$") | F.col("after").rlike(r"^[./\\@]\w")),
        "in_address": address,
        "dotted": before.rlike(r"[A-Za-z0-9_-]\.$") | F.col("after").rlike(r"^\.[A-Za-z0-9_-]"),
        "digest_word": before.rlike(r"(?<![a-z0-9])(" + "|".join(DIGEST_WORDS) + r")[^a-z0-9]*$"),
        "example_path": F.lower("path").rlike("|".join(EXAMPLE_PATHS)),
    }
    return rows.select(
        "doc_id", "text_hash", "nth", "start", "value",
        F.col("n").cast("double").alias("n"),
        ((F.size(F.regexp_extract_all("kinds", F.lit("(l+|u+|d+|s+)"), 1)) - 1) / (F.col("n") - 1)).alias("runs"),
        share("d").alias("digits"),
        share("u").alias("capitals"),
        share("s").alias("marks"),
        entropy.alias("entropy"),
        (pairs / (F.col("n") - 1)).alias("pairs"),
        (F.coalesce("covered", F.lit(0)) / F.col("n")).alias("coverage"),
        (F.length("value") - F.length(F.translate("value", "/", ""))).cast("double").alias("slashes"),
        *(F.coalesce(c, F.lit(False)).cast("double").alias(n) for n, c in flags.items()),
    )


def _certain() -> Column:
    mix = (F.col("digits") > 0.1) & (F.col("digits") < 1) & (F.col("entropy") > 2.5)
    given = (F.col("named") == 1) & (F.col("assigned") == 1) & mix
    secret = (given | F.col("value").rlike(JSON_TOKEN)) & (F.col("example_path") == 0)
    clean = (F.col("named") == 0) & (
        (F.col("digits") == 0) | (F.col("digits") + F.col("marks") > 0.999) | (F.col("in_path") == 1)
    ) & ~(mix & ((F.col("dotted") == 1) | F.col("value").contains(".")))
    return F.when(secret, 1.0).when(clean, 0.0)


def certain_labels(features: DataFrame) -> DataFrame:
    """Findings whose label is beyond doubt, as training data: adds label, drops the rest.

    1: a mix of letters and digits assigned to a secret's name, or a JSON token, outside example
    paths.  0: letters only, or digits only, or a path, with no such name; no part of a dotted
    token that mixes letters and digits.
    """
    return features.withColumn("label", _certain()).where("label IS NOT NULL")


def _training_rows(labelled: DataFrame) -> DataFrame:
    order = [F.xxhash64("value", "start"), "value", "doc_id", "start"]
    return reduce(
        DataFrame.unionByName,
        (
            labelled.where(F.col("label") == label).orderBy(*order).limit(FIT_ROWS)
            .select("label", *FEATURES, F.lit(1.0).alias("weight"), "value")
            for label in (0.0, 1.0)
        ),
    )


def _cues_hidden(training: DataFrame) -> DataFrame:
    """Half of the values lose the words and signs around them, so that their form has to tell."""
    hidden = F.xxhash64("value") % 2 == 0
    cues = ("named", "assigned", "quoted")
    return training.withColumns({c: F.when(hidden, 0.0).otherwise(F.col(c)) for c in cues})


def secret_findings(
    docs: DataFrame,
    labels: DataFrame | None = None,
    threshold: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str | None = "source",
) -> DataFrame:
    """One row per candidate: doc_id, text_hash, nth, start, end, value, probability, is_secret.

    `labels` may give reviewed findings as (value, label); otherwise the candidates whose label
    is beyond doubt train the forest, half of them without the cues around them.  Known findings,
    texts made of common forms, train it in both cases.  No rule overrules the forest.  start and
    end are code points, end exclusive.

    Null and empty texts have no candidates; null doc_ids stay null; repeated rows give their
    findings each; very long texts are searched whole.  A null path is no example path.  Other
    columns are ignored; empty input gives no rows.
    """
    spark = docs.sparkSession
    found = written(candidates(docs, id_col, text_col, path_col), "secret-candidates")
    dictionary = written(_dictionary(docs, text_col), "secret-words")
    transitions = _transitions(dictionary)
    features = written(with_features(found, dictionary, transitions), "secret-features")
    if labels is None:
        training = _cues_hidden(_training_rows(certain_labels(features)))
    else:
        reviewed = labels.where("value IS NOT NULL AND label IS NOT NULL").groupBy("value").agg(
            F.max(F.col("label").cast("double")).alias("label")
        )
        training = _training_rows(features.join(reviewed, "value"))
    known = known_findings(spark)
    forms = with_features(candidates(known, path_col=None), dictionary, transitions)
    forms = forms.join(known.select("doc_id", "label"), "doc_id")
    forms = forms.select("label", *FEATURES, F.lit(KNOWN_WEIGHT).alias("weight"), "value")
    training = written(training.unionByName(forms), "secret-training")
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="vector")
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", weightCol="weight", numTrees=32, maxDepth=8,
        maxBins=64, seed=7, probabilityCol="odds", rawPredictionCol="votes",
        predictionCol="verdict", featureSubsetStrategy="onethird",
    )
    model = forest.fit(assembler.transform(training))
    judged = model.transform(assembler.transform(features))
    return judged.select(
        "doc_id", "text_hash", "nth", "start",
        (F.col("start") + F.length("value")).alias("end"), "value",
        vector_to_array("odds")[1].alias("probability"),
        (vector_to_array("odds")[1] >= threshold).alias("is_secret"),
    )


def redacted(
    docs: DataFrame,
    findings: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    mark: str = "[secret]",
) -> DataFrame:
    """The input rows with every secret of `findings` replaced by `mark`; other columns stay."""
    secret = (
        findings.where("is_secret")
        .groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
        .agg(F.collect_set("nth").alias("__nth"))
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = F.transform(
        "__hits", lambda h, i: F.when(F.array_contains("__nth", i), F.lit(mark)).otherwise(h)
    )
    whole = F.array_join(
        F.zip_with("__gaps", F.concat(kept, F.array(F.lit(""))), lambda g, h: F.concat(g, h)), ""
    )
    columns = [whole.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    joined = docs.join(
        secret, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash")), "left"
    )
    changed = (
        joined.where("__nth IS NOT NULL")
        .withColumns({"__hits": _hits(F.col(text_col)), "__gaps": _gaps(F.col(text_col))})
        .select(*columns)
    )
    return joined.where("__nth IS NULL").select(*docs.columns).unionByName(changed)
