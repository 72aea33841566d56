"""URL filtering: allow and block rules first, then boosted trees on lexical features.

Features are lengths, depth, digit share, character entropy, parameter and host
label counts, and the block rate of the host's suffix and of the first path part
among labelled URLs (smoothed, in a fixed number of hash cells). The trees are
trained on a bounded sample of labelled URLs and applied as SQL expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.llm.quality_rules import let
from residuum.llm.trees import Ensemble, bounded, few_files, fit_boosted
from residuum.storage import cut

#: Labelled URLs used for training, and hash cells of each suffix statistic.
TRAIN_URLS = 20_000
CELLS = 512
#: Score from which a URL without rule is blocked.
BLOCK_FROM = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "length", "host_length", "path_length", "depth", "digit_share", "entropy", "n_parameters", "n_labels", "n_hyphens", "has_fragment",
    "has_extension", "secure", "suffix_rate", "part_rate",
)


@dataclass
class Rule:
    """``host`` covers itself and its subdomains; ``path`` is the beginning of the path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ``://``."""
    pattern = "(?s)://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def match(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Name of the longest rule that fits (ties by name), else null. The rules are a short list given by the caller."""
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.name))
            for r in sorted(rules, key=lambda r: (-len(r.name), r.name))]
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def _entropy(text: Column) -> Column:
    size = F.length(text)

    def part(letter: Column) -> Column:
        share = (size - F.length(F.replace(text, letter, F.lit("")))) / size
        return -share * F.log2(share)

    sums = F.aggregate(F.transform(F.array_distinct(F.split(text, "")), part), F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)))
    return F.when(size > 0, sums).otherwise(0.0)


def _cells(host: Column, path: Column) -> tuple[Column, Column]:
    suffix = F.element_at(F.split(host, "\\."), -1)
    first = F.regexp_extract(path, "^/([^/]*)", 1)
    return F.pmod(F.xxhash64(suffix), F.lit(CELLS)).cast("int"), F.pmod(F.xxhash64(first), F.lit(CELLS)).cast("int")


def lexical(urls: DataFrame, url_col: str) -> DataFrame:
    """``urls`` with _host, _path, the two cells and the lexical features in columns of the names above, prefixed by an underscore."""
    text = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host, path = parts(F.col(url_col))
    frame = urls.withColumns({"_host": host, "_path": path})
    host, path = F.col("_host"), F.col("_path")
    suffix, first = _cells(host, path)
    count = lambda c, x: (F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))).cast("double")
    query = F.regexp_extract(text, "\\?([^#]*)", 1)
    number = F.length(F.regexp_replace(text, "[^0-9]", ""))
    return frame.withColumns({
        "_suffix": suffix, "_part": first, "_length": F.length(text).cast("double"), "_host_length": F.length(host).cast("double"),
        "_path_length": F.length(path).cast("double"), "_depth": count(path, "/"),
        "_digit_share": F.when(F.length(text) > 0, number / F.length(text)).otherwise(0.0), "_entropy": let(text, _entropy),
        "_n_parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1), "_n_labels": count(host, ".") + 1,
        "_n_hyphens": count(host, "-"), "_has_fragment": text.contains("#").cast("double"),
        "_has_extension": path.rlike("\\.[A-Za-z0-9]{1,5}$").cast("double"), "_secure": text.startswith("https").cast("double"),
    })


@dataclass
class Model:
    trees: Ensemble
    suffix_rate: list[float]
    part_rate: list[float]

    def score(self) -> Column:
        def feature(i: int) -> Column:
            name = FEATURES[i]
            if name.endswith("_rate"):
                table = self.suffix_rate if name == "suffix_rate" else self.part_rate
                cell = F.col("_suffix" if name == "suffix_rate" else "_part")
                return F.get(F.array(*[F.lit(float(v)) for v in table]), cell)
            return F.col("_" + name)

        return self.trees.score(feature)


def train(labelled: DataFrame, url_col: str = "url", max_rows: int = TRAIN_URLS) -> Model:
    """Trees and suffix statistics from labelled URLs: columns ``url_col`` and y (1 blocks).

    The statistics cover all labelled URLs; about ``max_rows`` of them, all of a smaller table, fit the trees. With one label, or no
    row, the score is a constant (0.018 if there is nothing to block). Null URLs are empty; repeated rows count each.
    """
    rows = cut(lexical(labelled.where(F.col("y").isNotNull()), url_col), "urls")
    share = rows.agg(F.avg("y")).first()[0] or 0.0

    def rates(cell: str) -> list[float]:
        out = [share] * CELLS
        for r in rows.groupBy(cell).agg(((F.sum("y") + 5 * share) / (F.count("*") + 5)).alias("rate")).collect():  # CELLS rows at most
            out[r[0]] = r["rate"]
        return out

    model = Model(Ensemble([], True), rates("_suffix"), rates("_part"))
    lookup = lambda table, cell: F.get(F.array(*[F.lit(float(v)) for v in table]), F.col(cell))
    some = bounded(rows, url_col, max_rows)
    sample = some.select("y", *[F.col("_" + f).alias(f) for f in FEATURES if not f.endswith("_rate")],
                         lookup(model.suffix_rate, "_suffix").alias("suffix_rate"), lookup(model.part_rate, "_part").alias("part_rate"))
    model.trees = fit_boosted(few_files(sample, "url-sample"), FEATURES, "y")
    return model


def judge(urls: DataFrame, rules: Sequence[Rule], model: Model, url_col: str = "url") -> DataFrame:
    """``urls`` with host, path, rule, score and verdict.

    The longest rule that fits decides; without one, the trees block from
    ``BLOCK_FROM``. Null and malformed URLs have an empty host and path and are
    judged by the trees. Repeated rows are judged alike; columns with one of these
    names are replaced.
    """
    frame = lexical(urls, url_col)
    rule = match(F.col("_host"), F.col("_path"), rules)
    of_rule = F.coalesce(*[F.when(F.col("rule") == r.name, F.lit(r.verdict)) for r in rules], F.lit(None).cast("string"))
    return (
        frame.withColumns({"rule": rule, "score": model.score(), "host": F.col("_host"), "path": F.col("_path")})
        .withColumn("verdict", F.coalesce(of_rule, F.when(F.col("score") >= BLOCK_FROM, "block").otherwise("allow")))
        .drop("_host", "_path", "_suffix", "_part", *["_" + f for f in FEATURES])
    )
