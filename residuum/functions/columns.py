"""Column expressions: coercion, identifiers, derived scores, text features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Residue classes and letter order of the composition vector.
COMPOSITION_CLASSES = ("DE", "KRH", "AILMFWVY", "STNQ", "FWYH", "C", "P")
COMPOSITION_LETTERS = "ACDEFGHIKLMNPQRSTVWY"

# Integer codes of sequence letters (0 = unknown or padding).
LETTER_CODES = {
    "A": 1, "C": 2, "B": 3, "E": 4, "D": 5, "G": 6, "F": 7, "I": 8, "H": 9,
    "K": 10, "M": 11, "L": 12, "O": 13, "N": 14, "Q": 15, "P": 16, "S": 17,
    "R": 18, "U": 19, "T": 20, "W": 21, "V": 22, "Y": 23, "X": 24, "Z": 25,
}

# Span size and stride of long sequences.
SPAN_SIZE, SPAN_STRIDE = 1024, 768


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """Double value with unparsable text, NaN and infinities turned to null."""
    value = col(c).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)  # NaN sorts above infinity


def or_null(df: DataFrame, name: str, dtype: str = "double") -> Column:
    """The column, or a typed null where the table does not carry it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def canonical_id(c: Column | str) -> Column:
    """Trimmed id text; null is '' and integral numbers lose their fraction."""
    text = F.trim(col(c).cast("string"))
    number = text.try_cast("double")
    integer = F.when(F.abs(number) < 9.0e18, number.try_cast("bigint"))
    return F.coalesce(F.when(integer.cast("double") == number, integer.cast("string")), text, F.lit(""))


def prefixed_id(c: Column | str, prefix: str = "pr_id=") -> Column:
    return canonical_id(F.regexp_replace(F.trim(col(c).cast("string")), f"^{prefix}", ""))


def clean_sequence(c: Column | str) -> Column:
    text = F.upper(F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), r"\s+", ""))
    return F.when(text == "NAN", "").otherwise(text)


def clip(c: Column, low: float, high: float) -> Column:
    """Null-keeping clamp (``greatest``/``least`` alone would skip nulls)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def sigmoid(c: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(col(c), -40.0, 40.0)))


def strict_max(*cols: Column) -> Column:
    """Row maximum that is null as soon as one side is null."""
    known = cols[0].isNotNull()
    for c in cols[1:]:
        known = known & c.isNotNull()
    return F.when(known, F.greatest(*cols))


def strict_min(*cols: Column) -> Column:
    known = cols[0].isNotNull()
    for c in cols[1:]:
        known = known & c.isNotNull()
    return F.when(known, F.least(*cols))


def error_risk(probability: Column, predicted: Column) -> Column:
    """Probability that the frozen class is wrong; a null class counts as negative."""
    p = clip(probability, 0.0, 1.0)
    return F.when(predicted >= 0.5, 1.0 - p).otherwise(p)


def base_columns(df: DataFrame) -> DataFrame:
    """Add the derived prediction columns that the table does not carry yet."""
    out = df.withColumn("label", finite(or_null(df, "label")))
    p = finite("p_base") if "p_base" in df.columns else sigmoid(finite(or_null(df, "s_base")))
    out = out.withColumn("p_base", p)
    pred = (
        finite("base_pred") if "base_pred" in df.columns
        else F.coalesce(F.col("p_base") >= 0.5, F.lit(False)).cast("double")
    )
    out = out.withColumn("base_pred", pred)
    correct = (
        finite("base_correct") if "base_correct" in df.columns
        else F.coalesce(F.col("base_pred") == F.col("label"), F.lit(False)).cast("double")
    )
    out = out.withColumn("base_correct", correct).withColumn("base_wrong", 1.0 - F.col("base_correct"))
    confidence = (
        finite("base_confidence") if "base_confidence" in df.columns
        else 2.0 * F.abs(F.col("p_base") - 0.5)
    )
    return out.withColumn("base_confidence", clip(confidence, 0.0, 1.0))


def exported_columns(df: DataFrame) -> DataFrame:
    """Uncertainty of the base channel and its distance to the prior channel."""
    out = df if "p_prior" in df.columns else df.withColumn("p_prior", sigmoid(finite(or_null(df, "s_prior"))))
    return out.withColumn("base_uncertainty", 1.0 - 2.0 * F.abs(F.col("p_base") - 0.5)).withColumn(
        "base_prior_conflict", F.abs(F.col("p_base") - F.col("p_prior"))
    )


def prior_columns(calibrated: Column, prior: Column, s_base: Column, s_prior: Column) -> dict[str, Column]:
    """Directional disagreement between the calibrated base and the prior."""
    gap, logit_gap = calibrated - prior, s_base - s_prior
    return {
        "prior_contradiction_logit": clip(logit_gap, 0.0, float("inf")),
        "prior_support_logit": clip(-logit_gap, 0.0, float("inf")),
        "prior_negative_evidence": 1.0 - prior,
        "prior_contradiction_probability": clip(gap, 0.0, float("inf")),
        "prior_support_probability": clip(-gap, 0.0, float("inf")),
    }


def support_columns(left: Column, right: Column, names: Sequence[str]) -> dict[str, Column]:
    """Minimum, imbalance and novelty of two counts; names in that order."""
    log_left, log_right = F.log1p(left), F.log1p(right)
    seen_left, seen_right = (left > 0).cast("double"), (right > 0).cast("double")
    values = (
        strict_min(log_left, log_right),
        F.abs(log_left - log_right),
        (1.0 - seen_left) * (1.0 - seen_right),
        F.abs(seen_left - seen_right),
    )
    return dict(zip(names, values))


def support_state(left_seen: Column, right_seen: Column) -> Column:
    return (
        F.when(left_seen & right_seen, "both_seen")
        .when(~left_seen & right_seen, "drug_unseen")
        .when(left_seen & ~right_seen, "target_unseen")
        .otherwise("both_unseen")
    )


def hit_columns(df: DataFrame) -> DataFrame:
    """Coverage of both sides and the support score of an alignment hit."""
    alen = finite("alignment_length")
    query_cover = F.try_divide(alen, finite("query_length"))
    target_cover = F.try_divide(alen, finite("target_length"))
    score = clip(finite("identity"), 0.0, 100.0) / 100.0 * clip(
        F.least(query_cover, target_cover), 0.0, 1.0
    )
    return df.withColumns(
        {"query_coverage": query_cover, "target_coverage": target_cover, "support_score": finite(score)}
    )


def hit_passes(identity: float = 30.0, coverage: float = 0.5, evalue: float = 1.0e-3) -> Column:
    return (
        (finite("identity") >= identity)
        & (F.col("query_coverage") >= coverage)
        & (finite("evalue") <= evalue)
    )


def sequence_composition(c: Column | str) -> Column:
    """Length, seven residue-class shares and twenty letter shares as one vector."""
    text = F.upper(F.trim(F.coalesce(col(c), F.lit(""))))
    length = F.length(text)
    share = lambda letters: (length - F.length(F.translate(text, letters, ""))) / F.greatest(length, F.lit(1))
    parts = [length.cast("double"), *[share(s) for s in COMPOSITION_CLASSES]]
    return F.array(*parts, *[share(s) for s in COMPOSITION_LETTERS])


def letter_encoding(c: Column | str, size: int = 1200) -> Column:
    """Fixed-length integer codes of a sequence, zero-padded."""
    codes = F.create_map(*[F.lit(v) for kv in LETTER_CODES.items() for v in kv])
    letters = F.filter(F.split(F.upper(F.substring(col(c), 1, size)), ""), lambda ch: ch != "")
    known = F.transform(letters, lambda ch: F.coalesce(F.try_element_at(codes, ch), F.lit(0)))
    return F.slice(F.concat(known, F.array_repeat(F.lit(0), size)), 1, size)


def main_component(c: Column | str) -> Column:
    """Largest dot-separated component of a text id with count, status and note."""
    text = F.trim(F.coalesce(col(c), F.lit("")))
    parts = F.filter(F.split(text, r"\."), lambda p: p != "")
    count = F.size(parts)
    by_size = F.transform(parts, lambda p: F.struct((-F.length(p)).alias("order"), p.alias("part")))
    status = F.when(text == "", "missing").when(count == 0, "invalid").otherwise("ok")
    note = (
        F.when(text == "", "empty_text")
        .when(count == 0, "no_components")
        .when(count == 1, "single_component")
        .otherwise(F.concat(F.lit("multi_component_selected_main_component;num_components="), count))
    )
    return F.struct(
        F.when(count > 0, F.array_min(by_size)["part"]).otherwise("").alias("selected"),
        count.alias("num_components"),
        status.alias("status"),
        note.alias("note"),
    )


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: it is bound as a lambda variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unit(vector: Column) -> Column:
    """Vector scaled to length one (lengths below 1e-6 are raised to it)."""
    norm = lambda v: F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1.0e-6))
    scaled = lambda v: bound(norm(v), lambda n: F.transform(v, lambda x: x / n))
    return bound(vector, scaled)


def pair_vector(left: Column, right: Column) -> Column:
    return unit(F.concat(unit(left), unit(right)))


def chunk_spans(length: Column, size: int = SPAN_SIZE, stride: int = SPAN_STRIDE) -> Column:
    """Overlapping (start, end) spans that cover a length; the last one ends at it."""
    last = F.ceil(F.greatest(length - size, F.lit(0)) / stride).cast("int")
    spans = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct((i * stride).alias("start"), F.least(i * stride + size, length).alias("end")),
    )
    tail = F.struct(F.greatest(length - size, F.lit(0)).alias("start"), length.alias("end"))
    return F.array_distinct(F.concat(spans, F.array(tail)))


def finite_vector(vector: Column, dims: int | None = None) -> Column:
    """Leading ``dims`` values as doubles; null if empty, short or not finite."""
    values = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if dims is None:
        return F.when((F.size(vector) > 0) & ~bad, values)
    head = F.slice(values, 1, dims)
    bad = F.exists(head, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(vector) >= dims) & ~bad, head)


def hex_draw(*parts: Column | str | int, digits: int = 7) -> Column:
    """Reproducible integer in [0, 16**digits) from the text of its arguments."""
    text = F.concat_ws("-", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")
