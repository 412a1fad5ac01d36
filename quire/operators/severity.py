"""Severity of changes: classification, verbosity filter, summary and priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.config import DEFAULT, EngineConfig
from quire.functions.topk import first_k

#: Severities by rank, and the largest rank that each verbosity shows.
NAMES = ["critical", "high", "medium", "low", "ignore"]
SHOWN = {"quiet": 1, "normal": 2, "verbose": 4}


def severity(kind: Column, reason: Column, confidence: Column, valid: Column) -> Column:
    """Rank 0 (critical) to 4 (ignore) by the first rule that applies; missing fields count as '', '', 1.0 and true."""
    k, r = F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(reason, F.lit("")))
    c, ok = F.coalesce(confidence, F.lit(1.0)), F.coalesce(valid, F.lit(True))
    has = lambda *words: r.rlike("|".join(words))
    return (
        F.when((k == "crossref") & ~ok, 0).when(has("unsupported claim", "missing evidence"), 0).when(has("broken reference", "section not found"), 0)
        .when(k == "llm_suggestion", 1).when(has("missing section", "incomplete"), 1).when((c < 0.8) & (k != "grammar"), 1)
        .when(has("terminology", "inconsistent"), 2).when(k == "style", 2).when(k.contains("spelling"), 2)
        .when(has("formatting") & ~has("space"), 3).when((k == "grammar") & has("double space", "whitespace"), 4).when(has("extra space", "spacing"), 4).otherwise(3)
    )


def classify(changes: DataFrame) -> DataFrame:
    """changes (type, reason, confidence, valid) with rank and severity."""
    rank = severity(F.col("type"), F.col("reason"), F.col("confidence"), F.col("valid"))
    return changes.withColumn("rank", rank).withColumn("severity_name", F.get(F.array(*[F.lit(n) for n in NAMES]), F.col("rank")))


def shown(classified: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """The changes that the verbosity shows; verbose lets ignorable ones pass, but they are in no bucket."""
    return classified.filter(F.col("rank") <= F.least(F.lit(SHOWN.get(config.verbosity, 2)), F.lit(3)))


def buckets(classified: DataFrame, config: EngineConfig = DEFAULT, *keys: str) -> DataFrame:
    """Counts by severity among the shown, and suppressed; then totals, actionable and signal to noise."""
    most = SHOWN.get(config.verbosity, 2)
    n = lambda i: F.count_if((F.col("rank") == i) & (F.lit(i) <= most))
    b = classified.groupBy(*keys).agg(*[n(i).alias(NAMES[i]) for i in range(4)], F.count_if(F.col("rank") > most).alias("suppressed"))
    total = F.col("critical") + F.col("high") + F.col("medium") + F.col("low") + F.col("suppressed")
    actionable = F.col("critical") + F.col("high")
    return b.withColumns({"total_changes": total, "actionable_changes": actionable, "signal_to_noise": actionable / F.greatest(F.lit(1), total)})


def summary(classified: DataFrame, key: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """key and the summary text: ten critical changes in full, the reasons of five high ones, then counts. Needs ord."""
    v, most = config.verbosity, SHOWN.get(config.verbosity, 2)
    reason = F.coalesce("reason", F.lit("Unknown issue"))
    part = lambda c, name: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f'\n      {name}: "'), c, F.lit('"'))).otherwise("")
    number = F.concat(F.lit("   "), F.col("_n").cast("string"), F.lit(". "), reason)
    full = F.concat(number, part(F.col("original"), "Original"), part(F.col("corrected"), "Corrected"))
    pick = lambda rank, k, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("rank") == rank) & (F.col("_n") <= k), F.struct("_n", text.alias("t"))))), lambda x: x["t"]), "\n")
    count = lambda cond: F.count_if(cond)
    medium = F.col("rank") == 2
    first = first_k(classified.filter("rank <= 2"), [key, "rank"], ["ord"], 10, "_n").groupBy(key).agg(pick(0, 10, full).alias("t0"), pick(1, 5, number).alias("t1"), pick(2, 10, number).alias("t2"))
    g = classified.groupBy(key).agg(
        *[count(F.col("rank") == i).alias(f"n{i}") for i in range(4)], count(F.col("rank") > most).alias("sup"),
        count(medium & F.coalesce(F.col("reason").contains("terminology"), F.lit(False))).alias("terms"), count(medium & F.coalesce(F.col("type").contains("style"), F.lit(False))).alias("styles"),
    ).join(first, key, "left").fillna("", ["t0", "t1", "t2"])
    s = lambda c: F.col(c).cast("string")
    more = lambda c, k: F.when(F.col(c) > k, F.concat(F.lit("\n   ... and "), (F.col(c) - k).cast("string"), F.lit(" more"))).otherwise("")
    parts = [F.when(F.col("n0") > 0, F.concat(F.lit("🔴 Critical Issues ("), s("n0"), F.lit("):\n"), "t0", more("n0", 10), F.lit("\n\n"))).otherwise("")]
    parts.append(F.when(F.col("n1") > 0, F.concat(F.lit("🟠 High Priority ("), s("n1"), F.lit("):\n"), "t1", more("n1", 5), F.lit("\n\n"))).otherwise(""))
    if v != "quiet":
        body = F.col("t2") if v == "verbose" else F.concat(F.lit("   - "), s("terms"), F.lit(" terminology inconsistencies\n   - "), s("styles"), F.lit(" style suggestions"))
        parts.append(F.when(F.col("n2") > 0, F.concat(F.lit("🟡 Medium Priority ("), s("n2"), F.lit("):\n"), body, F.lit("\n\n"))).otherwise(""))
    if v == "verbose":
        parts.append(F.when(F.col("n3") > 0, F.concat(F.lit("🟢 Low Priority ("), s("n3"), F.lit("): Minor formatting suggestions\n\n"))).otherwise(""))
    parts.append(F.when(F.col("sup") > 0, F.concat(F.lit("⚪ Suppressed: "), s("sup"), F.lit(" low-value changes (run with --verbose to see)\n\n"))).otherwise(""))
    actionable = F.col("n0") + F.col("n1") + (F.lit(0) if v == "quiet" else F.col("n2"))
    parts.append(F.when(actionable > 0, F.concat(F.lit("📊 Actionable Items: "), actionable.cast("string"))).otherwise("✅ No significant issues found!"))
    return g.select(key, F.concat(*parts).alias("summary"), actionable.alias("actionable"))


def prioritise(classified: DataFrame, config: EngineConfig = DEFAULT, key: str = "document_id") -> DataFrame:
    """Per key all critical changes, then high and medium ones in order of ord up to ``max_review_items`` in all."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("rank", "ord"))
    return shown(classified).withColumn("place", place).filter((F.col("rank") == 0) | (F.col("place") <= config.max_review_items))
