"""URL verdicts: host and path rules first, then boosted trees on lexical features.

Suffix statistics are sums over all labelled URLs, for suffixes with enough labelled rows.
The trees are fitted on a documented number of labelled rows at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellshift.llm.common import ascii_lower, let
from cellshift.session import scratch_root, written

TRAIN_ROWS = 40_000
SUFFIX_ROWS = 20
MOST_RULES = 10_000
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_ratio", "entropy", "parameters", "fragment", "suffix_rows", "suffix_block_rate")


@dataclass(frozen=True)
class HostRule:
    """A verdict for a host with its subdomains and every path that starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


# Rules of the registered query, and words that mark hosts as labelled spam.
RULES = (HostRule("block", "net", "/"), HostRule("allow", "example.net", "/en/"), HostRule("block", "example.com", "/de/"), HostRule("allow", "org", "/fr/"))
SPAM_WORDS = ("casino", "pills", "bets", "adult", "ads-", "spam", "porn", "viagra", "lottery")


def parts(url: Column) -> Column:
    """(host, path) of a URL; both empty for null and where ``://`` is missing."""

    def cut(rest: Column) -> Column:
        return F.struct(
            ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)).alias("host"),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
        )

    at = F.instr(url, "://")
    return let(F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit("")), cut)


def best_rule(host: Column, path: Column, rules: Sequence[HostRule]) -> Column:
    """The longest rule that fits, as (name, verdict); null where none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"At most {MOST_RULES} rules fit one expression, got {len(rules)}")
    # Longest first, then by name, so the first fit wins.
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; one term per distinct character."""
    terms = F.transform(
        F.array_distinct(F.split(text, "")),
        lambda c: F.when(c == "", 0.0).otherwise(-F.log2((F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text)) * (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text)),
    )
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def host_labels(host: Column) -> Column:
    return F.filter(F.split(host, r"\."), lambda x: x != "")


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    labels = host_labels(host)
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")


def with_suffix(frame: DataFrame, url: str = "url") -> DataFrame:
    """Append the host suffix of a URL."""
    return frame.withColumn("suffix", let(parts(F.col(url)), lambda p: suffix_of(p["host"])))


def lexical(frame: DataFrame, url: str = "url") -> DataFrame:
    """Append host, path, suffix and the lexical features of a URL (null reads as empty)."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host, path = F.col("host"), F.col("path")
    labels = host_labels(host)
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    return (
        frame.withColumn("_parts", parts(F.col(url)))
        .withColumns({"host": F.col("_parts.host"), "path": F.col("_parts.path")})
        .drop("_parts")
        .withColumns(
            {
                "suffix": suffix_of(host),
                "url_length": F.length(text).cast("double"),
                "host_length": F.length(host).cast("double"),
                "path_length": F.length(path).cast("double"),
                "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
                "labels": F.size(labels).cast("double"),
                "hyphens": (F.length(host) - F.length(F.translate(host, "-", ""))).cast("double"),
                "digit_ratio": F.when(F.length(text) > 0, (F.length(text) - F.length(F.translate(text, "0123456789", ""))) / F.length(text)).otherwise(0.0),
                "entropy": let(host, _entropy),
                "parameters": F.when(query == "", 0.0).otherwise(1.0 + F.length(query) - F.length(F.translate(query, "&", ""))),
                "fragment": F.when(text.contains("#"), 1.0).otherwise(0.0),
            }
        )
    )


def suffix_table(labelled: DataFrame) -> DataFrame:
    """Labelled rows and blocked rows per host suffix, for suffixes with enough of them; ``n`` is a row's count."""
    sums = labelled.groupBy("suffix").agg(F.sum("n").alias("suffix_n"), F.sum(F.col("n") * F.col("label")).alias("suffix_blocked"))
    return sums.filter(F.col("suffix_n") >= SUFFIX_ROWS)


def with_suffix_statistics(frame: DataFrame, suffixes: DataFrame, own: Column | None = None) -> DataFrame:
    """Append log row count and smoothed block rate; ``own`` is the row's label, left out of its own rate."""
    joined = frame.join(suffixes, "suffix", "left")
    n, blocked = F.coalesce("suffix_n", F.lit(0)), F.coalesce("suffix_blocked", F.lit(0.0))
    if own is not None:
        n, blocked = F.greatest(n - 1, F.lit(0)), F.greatest(blocked - own, F.lit(0.0))
    return joined.withColumns({"suffix_rows": F.log1p(n.cast("double")), "suffix_block_rate": (blocked + 1.0) / (n + 10.0)}).drop("suffix_n", "suffix_blocked")


def fit_rows(counted: DataFrame, train_rows: int) -> DataFrame:
    """(url, label, n) with ``taken``, the rows that each stands for in the fit; those without any are left out."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    share = min(1.0, train_rows / max(1, total))
    # Systematic rounding: the expected total is share x rows, and a hot URL is neither whole nor absent.
    offset = F.pmod(F.xxhash64("url", "label"), F.lit(1 << 40)) / float(1 << 40)
    return counted.withColumn("taken", F.floor(F.col("n") * F.lit(share) + offset)).filter("taken > 0")


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS, seed: int = 7) -> tuple[GBTClassificationModel | None, DataFrame]:
    """Trees and suffix table from (url, label), label 1.0 being block.

    Suffixes are counted over all rows.  The fit takes about ``train_rows`` rows at most:
    a distinct (url, label) with n rows stands for its share of them, rounded up or down
    by hash, as one weighted row.  Classes are weighted to equal totals.  With one class
    only there is no model: nothing is blocked.
    """
    spark = labelled.sparkSession
    scratch_root(spark)
    rows = labelled.filter("label is not null").select("url", F.col("label").cast("double").alias("label"))
    counted = written(rows.groupBy("url", "label").agg(F.count(F.lit(1)).alias("n")), "url-counted")
    suffixes = written(suffix_table(with_suffix(counted)), "url-suffixes")
    taken = written(lexical(fit_rows(counted, train_rows)).coalesce(max(1, spark.sparkContext.defaultParallelism // 2)), "url-training")
    sizes = {row["label"]: row["count"] for row in taken.groupBy("label").agg(F.sum("taken").alias("count")).collect()}
    if len(sizes) < 2:
        return None, suffixes
    weight = F.when(F.col("label") == 1.0, 0.5 / sizes[1.0]).otherwise(0.5 / sizes[0.0]) * sum(sizes.values()) * F.col("taken")
    ready = _assembled(with_suffix_statistics(taken, suffixes, F.col("label"))).withColumn("weight", weight)
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxDepth=4, maxIter=15, stepSize=0.3, maxBins=32, seed=seed)
    return trees.fit(ready.select("features", "label", "weight")), suffixes


def _assembled(frame: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(frame)


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[HostRule] = RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Append host, path, rule and verdict (allow or block) to every row that has a ``url``.

    The longest fitting rule decides; otherwise the trees do.  A null URL, or one without
    ``://``, has empty host and path, fits no rule and is judged by its features like any
    other.  Extra columns pass through, except those named as the appended ones, which are
    replaced.  Repeated rows get equal verdicts.
    """
    model, suffixes = train(labelled, train_rows)
    plain = pages.select(F.struct(*pages.columns).alias("row"), F.col("url"))
    frame = with_suffix_statistics(lexical(plain), suffixes)
    fit = frame.withColumn("fit", best_rule(F.col("host"), F.col("path"), rules))
    judged = model.transform(_assembled(fit)) if model else fit.withColumn("prediction", F.lit(0.0))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("prediction") == 1.0, "block").otherwise("allow"))
    kept = [F.col("row")[c].alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return judged.select(*kept, "host", "path", F.col("fit.name").alias("rule"), verdict.alias("verdict"))


def labelled_urls(pages: DataFrame, rules: Sequence[HostRule] = RULES, spam_words: Sequence[str] = SPAM_WORDS) -> DataFrame:
    """Labelled URLs of a page table: hosts with a spam word are blocked, other allowed-by-rule URLs are not."""
    cut = pages.select("url", parts(F.col("url")).alias("p"))
    spam = F.lit(False)
    for word in spam_words:
        spam = spam | F.col("p.host").contains(word)
    rule = best_rule(F.col("p.host"), F.col("p.path"), rules)
    label = F.when(spam, 1.0).when(rule["verdict"] == "allow", 0.0)
    return cut.select("url", label.alias("label")).filter("url is not null and label is not null")
