"""Secret scanning by a random forest over candidate tokens, in SQL functions only.

Every long token of letters, digits and a few signs is a candidate. The forest
sees its length, its changes of character class, how much of it words of the
dictionary cover, whether it stands in a path and which words stand before it.
It is trained from labelled findings and drops false positives.

Without labelled findings, tokens with the fixed form of a known credential
(``KNOWN``) are labelled 1, and tokens that are an address, a path, a plain number,
a spaced identifier or plain words (``HARMLESS``) 0; other tokens are not used for training.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.llm.frequent import most_frequent
from residuum.llm.quality_rules import let
from residuum.llm.spans import spans
from residuum.llm.trees import Ensemble, bounded, few_files, fit_forest
from residuum.storage import cut

#: Documents whose candidates train the forest, words of the dictionary, and votes from which a candidate is a secret.
TRAIN_DOCS = 20_000
DICTIONARY = 2_000
SECRET_FROM = 0.5
# Forms of candidates, of known credentials and of harmless tokens.
TOKEN = "(?:\\G|(?<![A-Za-z0-9+/_.@-]))[A-Za-z0-9+/_.@-]{14,}+=*+"
KNOWN = (
    "^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+"
    "|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$"
)
HARMLESS = "(?:@|^[0-9.+-]+$|^[A-Za-z]+[.,]?$|^(?:[A-Za-z]+[./_-])+[A-Za-z]*$|^[a-z]{2,}\\.[0-9]{1,3}$)"
NEIGHBOURS = "(?i)(token|secret|passw|pwd|api.?key|access.?key|private.?key|credential|auth|bearer)[^ \\n]{0,12} ?[:=]? ?[\"']?$"
FEATURES = (
    "length", "transitions", "digit_share", "upper_share", "distinct_share", "longest_letters", "covered", "in_path", "dots", "assigned", "quoted", "named",
)


def _features(text: Column, words: Column, span: Column) -> Column:
    def of(value: Column) -> Column:
        size = F.length(value)
        shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "\u0001"), "[A-Z]+", "\u0002"), "[0-9]+", "\u0003"), "[^\u0001-\u0003]+", "\u0004")
        letters = F.filter(F.split(F.lower(value), "[^a-z]+"), lambda w: F.length(w) >= 3)
        known = F.array_intersect(letters, words)
        chars = lambda a: F.aggregate(a, F.lit(0), lambda s, w: s + F.length(w))
        before = F.substring(text, F.greatest(span["start"] - 39, F.lit(1)), F.least(span["start"], F.lit(40)))
        flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
        return F.array(
            size.cast("double"), (F.length(shape) - 1) / size, F.length(F.regexp_replace(value, "[^0-9]", "")) / size,
            F.length(F.regexp_replace(value, "[^A-Z]", "")) / size, F.size(F.array_distinct(F.split(value, ""))) / size,
            F.coalesce(F.array_max(F.transform(letters, lambda w: F.length(w))), F.lit(0)).cast("double"), chars(known) / size,
            flag(value.contains("/") | before.rlike("(://|[\\w]/)[^ ]*$")), (size - F.length(F.replace(value, F.lit("."), F.lit("")))).cast("double"),
            flag(before.rlike("[=:] ?[\"']?$")), flag(before.rlike("[\"'`]$")), flag(before.rlike(NEIGHBOURS)),
        )

    return let(span["value"], of)


def _candidates(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with _text and _found: tokens with at least one digit or one change of case."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    found = F.when(F.col("_text").rlike("[A-Za-z0-9+/_.@-]{14}"), spans(F.col("_text"), TOKEN)).otherwise(empty)
    named = docs.withColumn("_text", text).withColumn("_found", found)
    return named.withColumn("_found", F.filter("_found", lambda s: s["value"].rlike("[0-9]|[a-z][A-Z]")))


def dictionary(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> list[str]:
    """The ``size`` most frequent words of three or more letters over all texts; of equal counts, some by a hash.

    Null and empty texts add nothing, repeated rows count each; an empty table gives no word. Other columns are ignored.
    """
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), "[^a-z]+")).alias("w")).where(F.length("w") >= 3)
    counts = cut(words.groupBy("w").agg(F.count("*").alias("n")), "dictionary")
    return sorted(r["w"] for r in most_frequent(counts, "n", size, split=True).collect())


def train(docs: DataFrame, words: list[str], findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", max_docs: int = TRAIN_DOCS) -> Ensemble:
    """The forest, from ``findings`` (value, y) where given, else from the fixed forms, in about ``max_docs`` texts.

    Null and empty texts have no candidate, repeated rows count each; with one label, or no row, the votes are constant.
    """
    some = _candidates(bounded(docs.select(id_col, text_col), id_col, max_docs), text_col)
    listed = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    rows = some.where(F.size("_found") > 0).select(F.explode(F.transform("_found", lambda s: F.struct(
        s["value"].alias("value"), _features(F.col("_text"), listed, s).alias("f")))).alias("c")).select("c.*")
    if findings is None:
        rows = rows.withColumn("y", F.when(F.col("value").rlike(KNOWN), 1.0).when(F.col("value").rlike(HARMLESS), 0.0)).where("y IS NOT NULL")
    else:
        rows = rows.join(findings.groupBy("value").agg(F.max("y").cast("double").alias("y")), "value")
    sample = few_files(rows.select("y", *[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(FEATURES)]), "findings")
    return fit_forest(sample, FEATURES, "y")


def scan(docs: DataFrame, model: Ensemble, words: list[str], text_col: str = "text") -> DataFrame:
    """``docs`` with findings: (start, end, value, score, secret) of every candidate of the whole text, in order.

    Places are code points, end exclusive. Null and empty texts have none; repeated
    rows have the same. A column named findings is replaced.
    """
    listed = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")

    def judged(s: Column) -> Column:
        score = let(_features(F.col("_text"), listed, s), lambda f: model.score(lambda i: F.get(f, F.lit(i))))
        return let(score, lambda v: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), v.alias("score"), (v >= SECRET_FROM).alias("secret")))

    found = _candidates(docs, text_col)
    return found.withColumn("findings", F.transform("_found", judged)).drop("_text", "_found")
