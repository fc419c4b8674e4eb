"""Secret scanning over an incremental ledger of content-addressed texts.

A version of a file is addressed by the SHA-256 of its text.  The ledger holds one
row per scanned (blob, rule, rule version) with the spans found there, so a later
scan reads only blobs or rule versions it has not seen; findings are joined back
to every path that ever held the blob.  Everything is built-in expressions.

Spans come from two views of the same match list: the pieces between the matches
(split) and the matches themselves; running sums of their lengths are the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellshift.llm.common import let, text_of
from cellshift.session import scratch_path, written


@dataclass(frozen=True)
class Rule:
    """One kind of secret.

    ``pattern`` finds leftmost non-overlapping matches; a match stays when its
    ``group`` (0: all of it) has at least ``least`` characters.  ``hints`` are
    lower-case strings of which a text holds at least one wherever the pattern
    matches; texts without them are not matched.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()
    version: int = 1
    base: bool = False


# Patterns and lengths of the base kinds.  Where a kind's minimum
# length concerns its one trailing run, the length is part of the pattern: a
# shorter run holds no longer one.
RULES = (
    Rule(
        "assign",
        r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=12,
        hints=("password", "passwd", "secret", "token", "api_key", "apikey"),
        base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]{14,}", hints=("akia",), base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    # The key with its END line; where that is missing, the base64 lines that follow.
    Rule(
        "private_key",
        r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=:,\x20\x09-\x0D]*-----END [A-Z ]{0,40}PRIVATE KEY-----|[\x0A\x0D]*[A-Za-z0-9+/=]{16,}[A-Za-z0-9+/=\x0A\x0D]*)?",
        hints=("private key-----",),
        version=2,
    ),
    Rule("host_token", r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", hints=(".eyj",)),
)


def _matches(text: Column, rule: Rule) -> Column:
    """Matches of a rule in order: the gap before each, its length, and whether it stays."""

    def laid_out(pair: Column) -> Column:
        return F.transform(
            pair["found"],
            lambda match, i: F.struct(
                F.lit(rule.kind).alias("rule"),
                F.lit(rule.version).alias("rule_version"),
                i.alias("i"),
                F.length(pair["pieces"][i]).cast("bigint").alias("gap"),
                F.length(match).cast("bigint").alias("length"),
                (F.length(F.regexp_extract(match, rule.pattern, rule.group)) >= rule.least).alias("stays"),
            ),
        )

    pair = F.struct(F.split(text, rule.pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(rule.pattern), 0).alias("found"))
    return F.when(text.rlike(rule.pattern), let(pair, laid_out))


def blob_id(text: Column) -> Column:
    return F.sha2(text, 256)


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Findings (blob_id, rule, rule_version, start, end) of blobs (blob_id, text, todo).

    A rule that is not named in ``todo`` costs nothing; a text without any of the
    rule's hint strings is not matched against its pattern.  Offsets are running sums
    over one text's matches, so a text with very many matches stays linear.
    """
    lowered = F.col("lowered")

    def due(rule: Rule) -> Column:
        named = F.array_contains("todo", rule.kind)
        if not rule.hints:
            return named
        hinted = lowered.contains(rule.hints[0])
        for hint in rule.hints[1:]:
            hinted = hinted | lowered.contains(hint)
        return named & hinted

    empty = F.array().cast("array<struct<rule:string,rule_version:int,i:int,gap:bigint,length:bigint,stays:boolean>>")
    found = F.concat(*[F.coalesce(F.when(due(rule), _matches(F.col("text"), rule)), empty) for rule in rules])
    matches = (
        blobs.withColumn("lowered", F.lower("text"))
        .select("blob_id", F.explode(found).alias("m"))
        .select("blob_id", "m.*")
        .repartition("blob_id", "rule")
        .dropDuplicates(["blob_id", "rule", "i"])
    )
    end = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("blob_id", "rule").orderBy("i"))
    placed = matches.withColumn("end", end).filter("stays")
    return placed.select("blob_id", "rule", "rule_version", (F.col("end") - F.col("length")).alias("start"), "end")


def update_ledger(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES) -> None:
    """Scan every (blob, rule version) pair of ``versions`` (path, text) that the ledger lacks.

    The smallest path of a blob stands for it, so only (path, blob id) pairs are
    grouped, with partial sums, and a text moves once.  Findings are stored before
    the pairs are marked as scanned: a run that dies in between is scanned again,
    and readers of the findings take distinct rows.
    """
    spark = versions.sparkSession
    addressed = versions.select("path", blob_id(text_of()).alias("blob_id"), text_of().alias("text"))
    pair = "struct<rule:string,rule_version:int>"
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version")) for r in rules]).cast(f"array<{pair}>")
    blobs = addressed.groupBy("blob_id").agg(F.min("path").alias("path"))
    if _exists(spark, f"{ledger}/scanned"):
        known = spark.read.parquet(f"{ledger}/scanned").select("blob_id", F.explode("pairs").alias("pair"))
        known = known.groupBy("blob_id").agg(F.collect_set("pair").alias("known"))
        blobs = blobs.join(known, "blob_id", "left")
    else:
        blobs = blobs.withColumn("known", F.lit(None).cast(f"array<{pair}>"))
    missing = F.array_except(wanted, F.coalesce("known", F.array().cast(f"array<{pair}>")))
    unseen = written(blobs.select("blob_id", "path", missing.alias("pairs")).filter(F.size("pairs") > 0), "unseen-blobs")
    todo = unseen.select("blob_id", F.col("path").alias("first_path"), F.col("pairs.rule").alias("todo"))
    # The narrow side is hashed; texts are neither sorted nor broadcast.
    same = (addressed["blob_id"] == todo["blob_id"]) & addressed["path"].eqNullSafe(todo["first_path"])
    texts = addressed.join(todo.hint("shuffle_hash"), same).select(addressed["blob_id"], "text", "todo")
    scan_blobs(texts, rules).write.mode("append").parquet(f"{ledger}/findings")
    unseen.select("blob_id", "pairs").write.mode("append").parquet(f"{ledger}/scanned")


def findings_by_path(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per version row: (path, findings), findings ordered by start, then rule order.

    Findings are arrays of (start, end, rule); paths without any get an empty array.
    Only ledger rows of the given rule versions count.
    """
    spark = versions.sparkSession
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    current = F.lit(False)
    for rule in rules:
        current = current | ((F.col("rule") == rule.kind) & (F.col("rule_version") == rule.version))
    found = (
        spark.read.parquet(f"{ledger}/findings")
        .filter(current)
        .groupBy("blob_id")
        .agg(F.array_sort(F.collect_set(F.struct("start", order[F.col("rule")].alias("place"), "end", "rule"))).alias("findings"))
    )
    addressed = versions.select("path", blob_id(text_of()).alias("blob_id"))
    empty = F.array().cast("array<struct<start:bigint,place:int,end:bigint,rule:string>>")
    return addressed.join(found, "blob_id", "left").select("path", "blob_id", F.coalesce("findings", empty).alias("findings"))


def scan(versions: DataFrame, rules: Sequence[Rule] = RULES, ledger: str | None = None) -> DataFrame:
    """Findings of every path and version: update the ledger, then join back.

    Null texts count as empty and have no findings; null paths are kept.  Repeated
    rows give repeated rows.  Extra columns of ``versions`` are ignored.  Without a
    ledger a fresh one is made in the shared scratch folder.
    """
    versions = versions.select("path", "text")
    ledger = ledger or scratch_path(versions.sparkSession, "secret-ledger")
    update_ledger(versions, ledger, rules)
    return findings_by_path(versions, ledger, rules)


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES, mask: str = "[REDACTED]", length: str | None = None) -> DataFrame:
    """Rows with the text of every finding replaced; all columns and rows stay.

    Spans that overlap an earlier one leave one mask.  Texts without findings are
    untouched and null stays null; ``length`` names a column that follows the new text's
    length where the text changed.
    """
    columns = docs.columns
    found = scan(docs.select(F.col(key).alias("path"), F.col(text).alias("text")), rules)
    dirty = found.filter(F.size("findings") > 0).groupBy("blob_id").agg(F.first("findings").alias("findings"))
    rows = docs.select(F.struct(*columns).alias("_row"), blob_id(text_of(text)).alias("blob_id")).join(dirty, "blob_id", "left")
    value = F.col(f"_row.{text}")
    # Walk from the left: keep what lies between the end reached so far and the next span.
    walked = F.aggregate(
        F.col("findings"),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(
                (s["start"] >= acc["at"]),
                F.concat(acc["out"], value.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask)),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: F.concat(acc["out"], value.substr((acc["at"] + 1).cast("int"), F.length(value))),
    )
    clean = F.col("findings").isNull()
    done = rows.select("_row", F.when(clean, value).otherwise(walked).alias("_text"), clean.alias("_clean"))
    new = {text: F.col("_text")}
    if length in columns:
        new[length] = F.when(F.col("_clean"), F.col("_row")[length]).otherwise(F.length("_text").cast("bigint"))
    return done.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in columns])


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
