"""Secret scans: candidates by pattern, false positives removed by a random forest; DataFrame functions only.

Candidates are all runs of key material of at least MIN_LENGTH characters in
words that hold a digit or a padding sign; the values of SHORTEST characters and
more that a secret's name and a sign of assignment stand before, in the word or
in the two words before it, whatever their characters; and the credentials in
addresses (//user:password@host). With each goes the key written before it and
the two words before and the one after. Features: length, digits, capitals,
hexadecimal digits, distinct characters, transitions between small letters,
capitals and digits and between vowels and consonants, the share of characters that dictionary words cover, separators, a
known prefix, what the neighbouring words and the key say for or against a
secret, and whether the path names tests or examples.

The forest (Spark's own, DataFrame API) learns from labelled findings with the
columns of ``candidates`` and ``label``. Where a caller has none,
``labelled`` makes some by a seeded rule. What is trained does not depend on the
documents.

Words are only looked at in texts that ``may_hold`` a candidate, a test of whole
texts that every text with a candidate passes.

Null and empty texts have no candidates; rows are scanned one by one, whole, and
repeated ones give repeated findings.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import unused
from driftline.llm.labelled import labelled_findings

MIN_LENGTH = 12
SHORTEST = 4
TREES = 20
DEPTH = 7
THRESHOLD = 0.5
MASK = "[SECRET]"
#: Words of English and of software that dictionary coverage counts.
DICTIONARY = tuple(
    "password secret token release version update change default example sample test demo image photo file docs report index page article notes"
    " january february march april june july august september october november december street north south east west user admin guest your here"
    " key value name number order item part section chapter model series build patch alpha beta final draft server client local host data base"
    " hello world root welcome login letter summer winter spring autumn monday friday http https www com org net html json yaml"
    " tion ing ment able ness the and for with that this from about after again before below between under other first second third last"
    " access account address application backup batch board cache center class cloud code common company config content copy country create"
    " date device download email error event export field folder form group home import input job library license link list load main manager"
    " media member message method module network note office open output owner package paper party people person phone picture place plan"
    " process product profile project public query record request resource result review school search service session setting simple site"
    " size source space staff start state station store study style system table target team template text time title tool total track type"
    " unit view water week word work year".split()
)
_FOR = r"(?i)pass|pwd|secret|token|api|auth|cred|bearer|private|access|key"
_AGAINST = r"(?i)sha|commit|hash|md5|digest|checksum|uuid|guid|isbn|phone|tel|card|order|invoice|version|build|example|sample|placeholder|dummy|rev|id$"
_PREFIX = r"^(AKIA|ASIA|ghp_|gho_|github_pat_|xox[abp]-|sk_live_|sk-|AIza|eyJ|glpat-|npm_)"
_PATH = r"(?i)test|spec|example|sample|fixture|mock|doc"
_CHANGE = r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"
_ALTERNATION = r"(?i)[aeiouy](?=[b-df-hj-np-tv-xz])|[b-df-hj-np-tv-xz](?=[aeiouy])"
FEATURES = ("length", "digits", "capitals", "hex", "distinct", "changes", "alternation", "coverage", "separators", "prefix", "speaks_for", "speaks_against", "assigned", "all_digits", "path_test")


_GAP = r"[\x20\x09-\x0D]+"


_KEYS = r"(?i:pass|pwd|secret|token|api|auth|cred|bearer|private|access|key)"
#: What follows a key's word in its name; possessive, as no regular expression here may step back over a long word.
_REST = r"[A-Za-z0-9_.-]*+"
_SIGN = r"[\"'`\]\\]*(?:[=:]+>?)"
_OPEN = r"[(\[{<\\]*"
#: A quoted value ends at its quote, another one where a list, a query string or a bracket goes on.
_VALUE = rf"(?:\"[^\"\\]{{{SHORTEST},}}|'[^'\\]{{{SHORTEST},}}|`[^`]{{{SHORTEST},}}|[^\"'`\\,;&<>()\[\]{{}}|]{{{SHORTEST},}})"
_ASSIGNED = rf"{_KEYS}{_REST}{_SIGN}{_OPEN}({_VALUE})"
_SPOKEN = rf"(?:{_KEYS}{_REST}[\"'`]* ?[=:]+>?[\"'`(\[{{<]*|\b(?i:bearer))$"
_LOGIN = r"://(?:[^/:@]*:)?([^/@]+)@"
_RUN = rf"[A-Za-z0-9+/_~.-]{{{MIN_LENGTH},}}={{0,2}}"


def may_hold(text: Column) -> Column:
    """Whether a text may hold a candidate: a run in a word with a digit or a padding sign, a secret's name and a sign of
    assignment anywhere, or an address with a user. Every text with a candidate passes."""
    run = text.rlike(r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D0-9=]*+[0-9=])[^\x20\x09-\x0D]*?" + rf"[A-Za-z0-9+/_~.-]{{{MIN_LENGTH}}}")
    told = (text.contains("=") | text.contains(":")) & text.rlike(_KEYS)
    return F.coalesce(run | told | text.contains("://") & text.contains("@") | text.rlike("(?i)bearer"), F.lit(False))


def _worth(word: Column) -> Column:
    """Whether a word may hold a candidate that no word before it tells."""
    run = (F.length(word) >= MIN_LENGTH) & word.rlike("[0-9=]") & word.rlike(_RUN)
    return run | word.rlike("[=:]") & (word.rlike(_ASSIGNED) | word.rlike(_LOGIN))


def _around(words: Column, i: Column) -> tuple[Column, Column]:
    """The two words before word i in one text, and whether they name a secret that word i is the value of."""
    before = F.concat_ws(" ", F.get(words, i - 2), F.get(words, i - 1))
    return before, F.get(words, i - 1).rlike("(?:[=:]>?[\"'`(\\[{<]*|(?i:bearer))$") & before.rlike(_SPOKEN)


def _places(words: Column) -> Column:
    """The numbers of the words that may hold candidates."""
    at = F.transform(words, lambda x, i: F.when(_worth(x) | (F.length(x) >= SHORTEST) & F.coalesce(_around(words, i)[1], F.lit(False)), i).otherwise(-1))
    return F.filter(at, lambda i: i >= 0)


def _literal(value: Column) -> Column:
    """A pattern that matches value alone."""
    return F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _values(word: Column, spoken: Column) -> Column:
    """The distinct values in a word; spoken: the words before name it."""
    bare = lambda v: F.regexp_replace(F.regexp_replace(v, "^[\"'`]", ""), r"\.+$", "")
    runs = F.regexp_extract_all(word, F.lit(f"({_RUN})"), F.lit(1))
    assigned = F.regexp_extract_all(word, F.lit(_ASSIGNED), F.lit(1))
    login = F.regexp_extract_all(word, F.lit(_LOGIN), F.lit(1))
    told = F.when(spoken, F.array(F.regexp_extract(word, rf"^{_OPEN}({_VALUE})", 1))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.concat(F.filter(runs, lambda v: word.rlike("[0-9=]")), assigned, login, told), bare))


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """(doc_id, word_at, value, key, before, after, path): word_at is the number of the word that holds the value."""
    text = F.col("text").cast("string")
    named = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    # The words come out of a generator, which nothing is merged into: they are split once a text. What a candidate needs
    # of them is taken before the candidates become rows, so that no row carries a text's words.
    some = docs.filter(may_hold(text))
    base = some.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(named, F.lit("")).alias("path"), F.explode(F.array(F.split(text, _GAP))).alias("w"))
    w = F.col("w")

    def around(i: Column) -> Column:
        before, spoken = _around(w, i)
        return F.struct(i.alias("word_at"), F.get(w, i).alias("word"), before.alias("before"), F.coalesce(F.get(w, i + 1), F.lit("")).alias("after"), F.coalesce(spoken, F.lit(False)).alias("spoken"))

    near = base.select("doc_id", "path", F.inline(F.transform(_places(w), around)))
    word, value = F.col("word"), F.col("value")
    found = near.withColumn("value", F.explode(_values(word, F.col("spoken")))).filter(F.length("value") >= SHORTEST)
    # The names right before the value, wherever it stands in the word, or else the one that the word begins with.
    names = F.array_join(F.regexp_extract_all(word, F.concat(F.lit(rf"(?<![A-Za-z0-9_.-])([A-Za-z]{_REST}){_SIGN}[^A-Za-z0-9+/_~.-]*"), _literal(value)), F.lit(1)), " ")
    login = F.when(F.rlike(word, F.concat(F.lit("://(?:[^/:@]*:)?"), _literal(value), F.lit("@"))), "password")
    first = F.regexp_extract(word, r"^[\"'`(<\[{]*([A-Za-z][A-Za-z0-9_.-]*)[\"'`]?[=:]", 1)
    key = F.concat_ws(" ", F.when(names != "", names).otherwise(first), login)
    return found.select("doc_id", "word_at", "value", F.trim(key).alias("key"), "before", "after", "path")


def features(found: DataFrame) -> DataFrame:
    """found with the columns of FEATURES, all doubles."""
    v = F.col("value")
    n = F.length(v).cast("double")
    without = lambda pattern: F.length(F.regexp_replace(v, pattern, ""))
    share = lambda pattern: 1 - without(pattern) / n
    said = F.concat_ws(" ", "before", "key")
    words = "(?i)" + "|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w)))
    return (
        found.withColumn("length", n)
        .withColumn("digits", share("[0-9]"))
        .withColumn("capitals", share("[A-Z]"))
        .withColumn("hex", share("[0-9a-f]"))
        .withColumn("distinct", F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(36.0)))
        .withColumn("changes", F.size(F.split(v, _CHANGE, -1)) / n)
        .withColumn("alternation", F.regexp_count(v, F.lit(_ALTERNATION)) / n)
        .withColumn("coverage", share(words))
        .withColumn("separators", share("[^A-Za-z0-9]"))
        .withColumn("prefix", v.rlike(_PREFIX).cast("double"))
        .withColumn("speaks_for", said.rlike(_FOR).cast("double"))
        .withColumn("speaks_against", F.concat_ws(" ", said, "after").rlike(_AGAINST).cast("double"))
        .withColumn("assigned", ((F.col("key") != "") | F.col("before").rlike("[=:]$")).cast("double"))
        .withColumn("all_digits", v.rlike("^[0-9.+/_-]+$").cast("double"))
        .withColumn("path_test", F.col("path").rlike(_PATH).cast("double"))
    )


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 9):
    """A fitted forest over FEATURES."""
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, rawPredictionCol="raw", probabilityCol="p", predictionCol="predicted")
    rows = features(labelled).select(F.col("label").cast("double").alias("label"), *FEATURES)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="x"), forest]).fit(rows)


def findings(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source") -> DataFrame:
    """candidates with score, the forest's probability of a secret."""
    model = train(labelled_findings(docs.sparkSession, DICTIONARY) if labelled is None else labelled)
    scored = model.transform(features(candidates(docs, path)))
    return scored.select("doc_id", "word_at", "value", "key", "before", "after", "path", vector_to_array("p")[1].alias("score"))


def secret_scan(docs: DataFrame) -> DataFrame:
    """The query's rows, one a candidate: doc_id, word_at, n_chars, value_sha256, score, is_secret. Values stay out of it."""
    return findings(docs).select("doc_id", "word_at", F.length("value").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), "score", (F.col("score") >= THRESHOLD).alias("is_secret"))


def mask(text: Column, values: Column) -> Column:
    """text with each of the values replaced by MASK, longer ones first so that none leaves a rest; values of fewer than
    MIN_LENGTH characters only where no letter or digit goes on, as they may be parts of other words."""
    whole = lambda v: F.concat(F.lit("(?<![A-Za-z0-9])"), _literal(v), F.lit("(?![A-Za-z0-9])"))
    longest = F.array_sort(values, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.aggregate(longest, text, lambda t, v: F.when(F.length(v) >= MIN_LENGTH, F.replace(t, v, F.lit(MASK))).otherwise(F.regexp_replace(t, whole(v), F.lit(MASK))))


def redacted(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """All rows of docs with the secrets of their texts masked and n_chars, where there is such a column, following.

    Rows are told apart by id and text, so repeated ids keep their own findings. Only rows that may have a candidate meet the
    findings; the others pass by, so most texts are never shuffled.
    """
    row, held = unused(docs, "row"), unused(docs, "secrets")
    may = may_hold(F.col("text").cast("string"))
    keyed = docs.filter(may).withColumn(row, F.xxhash64(F.col("doc_id").cast("string"), F.col("text")))
    source = [c for c in ("source",) if c in docs.columns]
    found = findings(keyed.select(F.col(row).alias("doc_id"), "text", *source), labelled).filter(F.col("score") >= THRESHOLD)
    # The distinct secrets of one text: no other row's data meets them.
    secrets = found.groupBy(F.col("doc_id").alias(row)).agg(F.collect_set("value").alias(held))
    out = keyed.join(secrets, row, "left")
    none = F.col(held).isNull()
    out = out.withColumn("text", F.when(none, F.col("text")).otherwise(mask(F.col("text"), F.col(held))))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(none, F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return out.select(docs.columns).unionByName(docs.filter(~may))
