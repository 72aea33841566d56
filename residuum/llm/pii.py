"""Personal data by candidates, boosted trees and thresholds, in SQL functions only.

High-recall generators propose spans that may overlap: the four strict kinds and
looser forms of them. Strict forms that pass their checks are found in any case.
Every other candidate is scored by boosted trees on its format and on the
characters and words around it, and taken from the threshold at which training
candidates of its kind reach ``PRECISION``. Labels come from the checks: strict
forms that pass are examples, strict forms that fail are counter-examples
(``labelled`` gives others). What the checks decide by is no feature.

Patterns are written so that Java's matcher neither recurses nor rescans: runs
are possessive and a match starts at the start of its run (or where the last
match ended), which finds the same leftmost matches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.llm.quality_rules import let
from residuum.llm.spans import digits, luhn, overlaps, spans
from residuum.llm.trees import Ensemble, few_files, fit_boosted, thresholds
from residuum.storage import cut

KINDS = ("email", "ip", "card", "phone")
#: Documents whose candidates train the trees.
TRAIN_DOCS = 20_000
#: Precision from which candidates of a kind are taken.
PRECISION = 0.95

# The strict forms.
EMAIL = "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?:\\G|(?<![0-9]))[0-9]++(?:\\.[0-9]++){3}"
CARD = "[0-9](?:[ -]?[0-9])++"
PHONE = "\\+[0-9][ ().0-9-]+[0-9]"
# Looser forms that generate further candidates.
LOOSE = {
    "email": ["(?:\\G|(?<![\\w.%+-]))[\\w.%+-]++ ?(?:@|\\(at\\)|\\[at\\]) ?[\\w-]++(?: ?(?:\\.|\\(dot\\)|\\[dot\\]) ?[\\w-]++)++"],
    "phone": ["(?<![0-9+.])(?:\\([0-9]{3}\\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"],
    "ip": ["(?:\\G|(?<![0-9A-Fa-f:]))(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"],
}
CONTEXT = {
    "email": "(?i)(mail|contact|write to|kontakt|correo|courriel)",
    "ip": "(?i)(\\bip\\b|host|server|address|adresse)",
    "card": "(?i)(card|visa|credit|carte|karte|tarjeta)",
    "phone": "(?i)(phone|tel|call|mobile|fax|telefon)",
}
FEATURES = (
    "kind_no", "length", "digit_share", "letter_share", "n_separators", "n_groups", "longest_group", "has_plus", "has_paren", "digits",
 "before_letter", "before_digit", "after_letter", "after_digit", "context",
)


def _grouped(text: Column, kind: str) -> Column:
    pattern = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}[kind]
    hint = {"email": text.contains("@"), "ip": text.rlike("[0-9]\\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9]"), "phone": text.contains("+")}[kind]
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(hint, spans(text, pattern)).otherwise(empty)


def passes(kind: str, value: Column) -> Column:
    """The strict check of a match of ``kind``."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, "\\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return let(digits(value), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    return F.length(digits(value)).between(10, 15)


def candidates(text: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """Per kind the strict matches, and the matches of the looser forms."""
    strict = {k: _grouped(text, k) for k in KINDS}
    loose = {}
    for k, patterns in LOOSE.items():
        hint = {"email": text.contains("@") | text.rlike("[(\\[]at[)\\]]"), "phone": text.rlike("[0-9]{3}[ .-][0-9]{4}"), "ip": text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]")}[k]
        empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
        loose[k] = F.when(hint, F.concat(*[spans(text, p) for p in patterns])).otherwise(empty)
    return strict, loose


def features(text: Column, kind_no: Column, span: Column) -> Column:
    """Array of doubles in the order of ``FEATURES`` for one candidate."""

    def of(value: Column) -> Column:
        size = F.length(value)
        before = F.substring(text, F.greatest(span["start"] - 29, F.lit(1)), F.least(span["start"], F.lit(30)))
        after = F.substring(text, span["end"] + 1, F.lit(1))
        number = digits(value)
        groups = F.split(value, "[^0-9A-Za-z]+")
        chosen = F.element_at(F.array(*[F.lit(CONTEXT[k]) for k in KINDS]), kind_no)
        flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
        return F.array(
            kind_no.cast("double"), size.cast("double"), F.length(number) / size,
            F.length(F.regexp_replace(value, "[^\\p{L}]", "")) / size,
            F.length(F.regexp_replace(value, "[0-9\\p{L}]", "")).cast("double"), F.size(groups).cast("double"),
            F.array_max(F.transform(groups, lambda g: F.length(g))).cast("double"),
            flag(value.startswith("+")), flag(value.contains("(")), F.length(number).cast("double"),
            flag(before.rlike("\\p{L}$")), flag(before.rlike("[0-9]$")), flag(after.rlike("\\p{L}")), flag(after.rlike("[0-9]")),
            flag(F.regexp_like(before, chosen)),
        )

    return let(span["value"], of)


def _spotted(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with _text, _base (checked strict spans by start and kind) and _other (all other candidates)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.withColumn("_text", text)
    strict, loose = candidates(F.col("_text"))
    named = named.withColumns({f"_s_{k}": v for k, v in strict.items()} | {f"_l_{k}": v for k, v in loose.items()})

    def mark(spans_: Column, kind: str, is_strict: bool) -> Column:
        return F.transform(spans_, lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind) + 1).alias("kind_no"), s["end"].alias("end"), s["value"].alias("value"),
            F.lit(is_strict).alias("strict"), (passes(kind, s["value"]) if is_strict else F.lit(False)).alias("passed")))

    named = named.withColumn("_strict", F.concat(*[mark(F.col(f"_s_{k}"), k, True) for k in KINDS]))
    named = named.withColumn("_base", F.array_sort(F.filter("_strict", lambda s: s["passed"])))
    rest = F.concat(F.filter("_strict", lambda s: ~s["passed"]), *[mark(F.col(f"_l_{k}"), k, False) for k in LOOSE])
    named = named.withColumn("_rest", rest)
    free = F.when(F.size("_rest") == 0, F.col("_rest")).otherwise(
        F.filter("_rest", lambda s: ~F.exists(F.col("_base"), lambda b: overlaps(s, b))))
    return named.withColumn("_other", free).drop("_strict", "_rest", *[f"_s_{k}" for k in KINDS], *[f"_l_{k}" for k in LOOSE])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None,
          max_docs: int = TRAIN_DOCS, precision: float = PRECISION) -> tuple[Ensemble, dict[str, float]]:
    """Trees and thresholds from the candidates of all texts; about ``max_docs`` texts fit the trees, the thresholds cover all.

    ``labelled`` (kind_no, the features, y) replaces the labels made from the checks. Null and empty texts have no candidate,
    repeated rows count each; without candidates no kind adds spans.
    """
    sample = labelled
    if labelled is None:
        total = docs.count()
        part = F.pmod(F.xxhash64(F.col(id_col).cast("string"), text_col, F.lit(29)), F.lit(1_000_000)) * F.lit(float(total)) <= 1_000_000.0 * max_docs
        some = _spotted(docs.select(part.alias("drawn"), text_col), text_col)
        good = F.transform("_base", lambda s: F.struct(s["kind_no"].alias("kind_no"), features(F.col("_text"), s["kind_no"], s).alias("f"), F.lit(1.0).alias("y")))
        bad = F.transform(F.filter("_other", lambda s: s["strict"]), lambda s: F.struct(s["kind_no"].alias("kind_no"), features(F.col("_text"), s["kind_no"], s).alias("f"), F.lit(0.0).alias("y")))
        rows = some.where((F.size("_base") > 0) | (F.size("_other") > 0)).select("drawn", F.explode(F.concat(good, bad)).alias("c"))
        labelled = cut(rows.select("drawn", "c.kind_no", "c.y", *[F.get("c.f", F.lit(i)).alias(f) for i, f in enumerate(FEATURES) if f != "kind_no"]), "pii-train")
        sample = labelled.where("drawn").drop("drawn")
    model = fit_boosted(few_files(sample, "pii-sample"), FEATURES, "y")
    scored = labelled.select(
        F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind_no").cast("int")).alias("kind"), "y", model.score(lambda i: F.col(FEATURES[i])).alias("score")
    )
    return model, thresholds(scored, KINDS, precision)


def find(docs: DataFrame, model: Ensemble, limits: dict[str, float], text_col: str = "text") -> DataFrame:
    """``docs`` with base_spans and spans: arrays of (start, kind_no, end, kind) in order.

    Base spans are the strict forms that pass their checks, all of them, whatever
    overlaps; added spans overlap none of them. Null and empty texts have none;
    repeated rows have the same. Columns named base_spans or spans are replaced.
    """
    spotted = _spotted(docs, text_col)
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind_no"])
    limit = lambda s: F.element_at(F.array(*[F.lit(float(limits[k])) for k in KINDS]), s["kind_no"])
    taken = F.filter("_other", lambda s: let(features(F.col("_text"), s["kind_no"], s), lambda f: model.score(lambda i: F.get(f, F.lit(i)))) >= limit(s))
    shape = lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"), kind(s).alias("kind"))
    base = F.transform("_base", shape)
    more = F.when(F.size("_other") == 0, F.transform("_other", shape)).otherwise(F.transform(taken, shape))
    out = spotted.withColumn("base_spans", base).withColumn("_more", more)
    return out.withColumn("spans", F.array_sort(F.array_distinct(F.concat("base_spans", "_more")))).drop("_text", "_base", "_other", "_more")


def redact(found: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``found`` with each span of ``text_col`` replaced by its kind in brackets; spans that overlap become the first one's."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        joined = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.when(fresh, F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), joined.alias("out"))

    done = F.aggregate(spans_col, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size(spans_col) == 0, F.col(text_col)).otherwise(done))


def digest(spans_col: str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counts(spans_col: str, kinds: Sequence[str] = KINDS) -> list[Column]:
    def of(kind: str) -> Column:
        return F.size(F.filter(spans_col, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [of(kind) for kind in kinds]
