"""Secret scans: candidates by shape and context, false positives removed by a random forest.

Candidates are

* runs of 16 or more letters, digits and ``+/_-`` (``least``), unless they hold no digit and are
  one plain word or words in lower case (``Donaudampfschifffahrt``, ``some-lower-case-slug``;
  ``plain=True`` takes them too);
* whatever is assigned to a name of credentials (``password=hunter2``, ``"token": "x!y"``), of any
  length and characters;
* words beside a name of credentials that are no plain word or number (``password hunter2``).

A random forest, trained from labelled findings, gives each the probability
that it is a secret. Its features are the candidate's length, its shares of and transitions
between kinds of characters, how much of it dictionary words cover, the path it was found under
and the words around it. The dictionary holds the most frequent words of the texts themselves,
2000 in letters of any alphabet.

Findings come as a table of reviewed candidates, whose labels may say what no feature spells out;
where there is none, a rule on shape and context stands in for it (:func:`known_secret`).

Everything runs as DataFrame expressions and MLlib's DataFrame estimators, in the JVM.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from transitlens.llm.tables import saved

LEAST = 16  # characters of a run that is a candidate by itself
_RUN = "[A-Za-z0-9+/_-]{%d,}"
CREDENTIAL = "(?:pass(?:word|wd|wort|phrase|code)|pwd|token|secret|credential|(?:api|access|auth|private|signing)[_-]?key)"
#: a name of credentials, a sign that assigns, and what is assigned (1), to the closing quote if it is quoted
_ASSIGNED = f"(?i){CREDENTIAL}[A-Za-z0-9_.-]*[\"'`\\])]*[=:]+>?(\"+[^\"]+|'+[^']+|`+[^`]+|[^\"'`][^\"`]*)"
#: a word that ends in such a name, so that what it names stands beside it
_NAMES = f"(?i){CREDENTIAL}[a-z0-9_.-]*[\"'`\\])]*[=:]*[\"'`]*$"
#: no digit, and no upper-case letter but the first
_PLAIN = "^[A-Z]?[^A-Z0-9]*$"
DICTIONARY = 2000  # words
NEIGHBOURS = 128  # hashed places for the words around
FINDINGS = 20_000  # labelled findings to train from
TREES, DEPTH, SEED = 24, 8, 7
_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_NUMERIC = (
    "f_length", "f_digits", "f_upper", "f_lower", "f_hex", "f_kinds", "f_turns", "f_sounds",
    "f_distinct", "f_words", "f_depth", "f_test", "f_assigned", "f_quoted", "f_named",
)


def _quoted(pattern: str) -> str:
    """A pattern as a literal in SQL."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def candidates(docs: DataFrame, least: int = LEAST, plain: bool = False) -> DataFrame:
    """doc_id, path, word_no, candidate, before, key, after, named: every candidate of every
    whole text, with the two words before it, what stands before it in its own word, the next,
    and whether a name of credentials beside it made it one or would have. Numbered in a word: runs, then other values.
    Runs have ``least`` characters or more; ``plain`` also takes those that look like plain words."""
    run = _RUN % least
    words = docs.select(
        "doc_id", "path", F.split("text", r"\s+").alias("words"), F.col("text").rlike(f"(?i){CREDENTIAL}").alias("names")
    )
    # what the words around say is only asked of texts that name credentials at all
    beside = (
        "(coalesce(get(words, i - 1) RLIKE names_, false) OR coalesce(get(words, i + 1) RLIKE names_, false) OR "
        "(coalesce(get(words, i - 1) RLIKE '^[=:]+>?$', false) AND coalesce(get(words, i - 2) RLIKE names_, false)))"
    ).replace("names_", _quoted(_NAMES))
    found = words.select(
        "doc_id",
        "path",
        F.explode(
            F.expr(
                "transform(filter(sequence(0, size(words) - 1), i -> "
                f"(octet_length(words[i]) >= {int(least)} AND words[i] RLIKE '{run}') "
                f"OR (names AND (words[i] RLIKE {_quoted(_ASSIGNED)} OR {beside}))), "
                "i -> struct(i AS word_no, words[i] AS word, get(words, i - 2) AS w2, get(words, i - 1) AS w1, "
                f"get(words, i + 1) AS after, names AND {beside} AS beside))"
            )
        ).alias("x"),
    ).select("doc_id", "path", "x.*")
    strip = lambda c: F.regexp_replace(c, r"""^[\s"'`(\[{<=:]+|[\s"'`)\]}>,;:.]+$""", "")
    runs = F.regexp_extract_all("word", F.lit(f"({run})"), F.lit(1))
    values = F.transform(F.regexp_extract_all("word", F.lit(_ASSIGNED), F.lit(1)), strip)
    assigned_before = F.coalesce(F.col("w1").rlike("[=:]>?[\"'`]*$"), F.lit(False))
    whole = strip(F.regexp_replace("word", r"""^[(\[{<]*(["'`])\1*(.+?)\1.*$""", "$2"))
    # a word that an assignment before it names counts whatever its shape, any other if it is no plain word or number
    plain_word = whole.rlike(_PLAIN) | whole.rlike(r"^[\d.,:/-]*$") | whole.rlike(_NAMES)
    near = F.col("beside") & (assigned_before | ~plain_word) & ~F.col("word").rlike(_ASSIGNED)
    values = F.concat(values, F.when(near, F.array(whole)).otherwise(F.array().cast("array<string>")))
    listed = F.concat(
        F.transform(runs, lambda c: F.struct(c.alias("candidate"), F.lit(False).alias("named"))),
        F.transform(
            F.filter(F.array_except(values, runs), lambda c: c != ""),
            lambda c: F.struct(c.alias("candidate"), F.lit(True).alias("named")),
        ),
    )
    shaped = F.col("candidate").rlike("[0-9]") | ~F.col("candidate").rlike(_PLAIN) | ~F.col("candidate").rlike("[a-z]")
    runs = found.withColumn("values", values).select("*", F.posexplode(listed).alias("run_no", "x")).select("*", "x.*")
    runs = runs.withColumn("named", F.col("named") | F.array_contains("values", F.col("candidate")))
    if not plain:
        runs = runs.where(F.col("named") | shaped)
    key = F.lower(F.regexp_extract("word", r"^[^A-Za-z0-9]*([A-Za-z][A-Za-z_-]*)[=:]", 1))
    bare = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}=:]", "")
    return runs.select(
        "doc_id", "path", "word_no", "run_no", "candidate", "word", "named",
        F.array(bare(F.col("w2")), bare(F.col("w1"))).alias("before"), key.alias("key"), bare(F.col("after")).alias("after"),
    )


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The most frequent words of 3 to 12 lower-case letters in all texts (at most ``size``, so
    some tens of KB), ties by the word."""
    found = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}])(\p{Ll}{3,12})(?![\p{L}\p{N}])"), F.lit(1))).alias("w"))
    top = found.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size)
    return [r.w for r in top.collect()]


def _any_of(words: list[str]) -> str:
    """A pattern for the longest of the words at a place, branched by first letter."""
    by: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (-len(w), w)):
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by.items())) or "(?!)"


def features(found: DataFrame, known: list[str]) -> DataFrame:
    """Adds the numeric features and the list of neighbouring words."""
    c = F.col("candidate")
    n = F.length(c).cast("double")
    share = lambda chars: (n - F.length(F.translate(c, chars, ""))) / n
    kinds = F.translate(c, _UPPER + _LOWER + _DIGIT + "+/_-", "U" * 26 + "l" * 26 + "9" * 10 + "....")
    sounds = F.regexp_replace(F.regexp_replace(F.lower(c), "[aeiouy]", "1"), "[b-z]", "2")
    runs = lambda x: F.length(F.regexp_replace(x, r"(.)\1+", "$1"))
    left = F.length(F.regexp_replace(F.lower(c), _any_of(known), ""))
    path = F.lower(F.coalesce("path", F.lit("")))
    return found.select(
        "*",
        n.alias("f_length"), share(_DIGIT).alias("f_digits"), share(_UPPER).alias("f_upper"), share(_LOWER).alias("f_lower"),
        share("0123456789abcdef").alias("f_hex"),
        F.length(F.array_join(F.array_distinct(F.split(kinds, "")), "")).cast("double").alias("f_kinds"),
        ((runs(kinds) - 1) / n).alias("f_turns"), ((runs(sounds) - 1) / n).alias("f_sounds"),
        (F.size(F.array_distinct(F.split(c, ""))) / n).alias("f_distinct"),
        ((n - left) / n).alias("f_words"),
        F.size(F.split(path, "[/\\\\]")).cast("double").alias("f_depth"),
        path.rlike("test|example|sample|mock|doc").cast("double").alias("f_test"),
        (F.col("word").rlike("[=:]") | F.element_at("before", -1).rlike("[=:]$")).cast("double").alias("f_assigned"),
        F.col("word").rlike("[\"'`]").cast("double").alias("f_quoted"),
        F.col("named").cast("double").alias("f_named"),
        F.filter(F.concat(F.col("before"), F.array("key", "after")), lambda w: w != "").alias("around"),
    )


def train(findings: DataFrame) -> PipelineModel:
    """A forest from findings with features and a double ``label`` (1: a secret)."""
    around = HashingTF(inputCol="around", outputCol="f_around", numFeatures=NEIGHBOURS, binary=True)
    joined = VectorAssembler(inputCols=[*_NUMERIC, "f_around"], outputCol="features")
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, maxBins=64,
        subsamplingRate=0.8, seed=SEED,
    )
    return Pipeline(stages=[around, joined, forest]).fit(findings)


def known_secret() -> Column:
    """A labelling rule where no reviewed findings are at hand: the shape of an access key id,
    or characters assigned to a name of credentials that are random-looking or, short of that,
    no plain word or number."""
    c = F.col("candidate")
    names = F.concat_ws(" ", F.array_join("before", " "), "key").rlike("password|passwd|token|secret|api_?key")
    random = c.rlike("^[0-9a-f]+$|[0-9].*[A-Za-z].*[0-9]")
    mixed = c.rlike("[A-Za-z]") & (c.rlike("[0-9]") | ~c.rlike(_PLAIN) | c.rlike("[a-z][!@#$%^&*?][A-Za-z]"))
    assigned = F.col("f_assigned") == 1
    return c.rlike("^AKIA[0-9A-Z]{16}$") | (assigned & ((names & random) | (F.col("named") & mixed)))


def scan(
    docs: DataFrame, path: Column | None = None, findings: DataFrame | None = None, learn_from: Column | None = None,
    rows: int = FINDINGS, least: int = LEAST, plain: bool = False,
) -> DataFrame:
    """doc_id, word_no, run_no, candidate, score (probability of a secret), is_secret (score
    >= 0.5): every candidate of every whole text.

    ``findings`` has candidate and label (1: a secret) of reviewed findings, of any number; of
    rows that contradict each other the larger label holds, rows with a null are left out.
    Without it, :func:`known_secret` labels the candidates. Labels are read for training alone; at
    most ``rows`` labelled candidates of documents that ``learn_from`` admits (a condition on
    doc_id and path) are learnt from, those with the smallest hash of place and candidate, at most
    half of them of either kind. Without findings of both kinds the rule itself decides (score 1
    or 0). ``least`` and ``plain`` as in :func:`candidates`. Null and empty texts have no
    candidates; repeated rows repeat their findings; other columns are ignored; an empty table
    gives no rows.
    """
    texts = docs.select("doc_id", "text", (F.lit("") if path is None else path).alias("path"))
    known = dictionary(texts)
    found = saved(features(candidates(texts, least, plain), known), "findings")
    allowed = found.where(F.lit(True) if learn_from is None else learn_from)
    if findings is None:
        marked = allowed.withColumn("label", known_secret().cast("double"))
    else:
        reviewed = findings.where("candidate IS NOT NULL AND label IS NOT NULL").groupBy("candidate").agg(
            F.max(F.col("label").cast("double")).alias("label")
        )
        # a table of its own, so that the join may split a candidate that comes up everywhere
        marked = allowed.join(saved(reviewed, "reviewed"), "candidate")
    marked = marked.withColumn("h", F.xxhash64("doc_id", "word_no", "run_no", "candidate"))
    halves = [marked.where(F.col("label") == y).orderBy("h", "candidate").limit(rows // 2) for y in (0.0, 1.0)]
    learnt = saved(halves[0].unionByName(halves[1]), "labelled")
    if learnt.select("label").distinct().count() < 2:
        scored = found.withColumn("score", known_secret().cast("double"))
    else:
        scored = train(learnt).transform(found).withColumn("score", vector_to_array("probability")[1])
    return scored.select(
        "doc_id", F.col("word_no").cast("int").alias("word_no"), F.col("run_no").cast("int").alias("run_no"), "candidate",
        "score", (F.col("score") >= 0.5).alias("is_secret"),
    )
