"""Table and figure checks, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.config import DEFAULT, EngineConfig
from quire.functions.text import strip
from quire.schemas import ISSUE

_NONE = "array<" + ISSUE + ">"


def _issue(kind: str, text: Column | str, severity: str, row: Column | None = None, col: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(
        F.lit(kind).alias("issue_type"), (F.lit(text) if isinstance(text, str) else text).alias("description"),
        (null if row is None else row).cast("int").alias("row"), (null if col is None else col).cast("int").alias("col"), F.lit(severity).alias("severity"),
    )


def _if(condition: Column, issue: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(issue)).otherwise(F.array().cast(_NONE))


def table_lines(content: Column) -> Column:
    """Stripped lines that start with a pipe."""
    return F.filter(F.transform(F.split(content, "\n"), strip), lambda x: x.startswith("|"))


def column_count(line: Column) -> Column:
    """Pipes without one outer pipe on either side, plus one."""
    inner = F.regexp_replace(F.regexp_replace(line, r"^\|", ""), r"\|$", "")
    return F.length(inner) - F.length(F.replace(inner, F.lit("|"), F.lit(""))) + 1


def structure_issues(lines: Column) -> Column:
    separator = F.get(lines, F.lit(1)).rlike(r"^\|\s*[-:]+\s*(\|\s*[-:]+\s*)*\|")
    expected = column_count(F.get(lines, F.lit(0)))
    wide = F.transform(lines, lambda x, i: _issue("inconsistent_columns", F.concat(F.lit("Row has "), column_count(x).cast("string"), F.lit(" columns, expected "), expected.cast("string")), "high", i))
    odd = F.filter(wide, lambda i: column_count(F.get(lines, i["row"])) != expected)
    full = F.concat(_if(~separator, _issue("formatting", "Table separator row is malformed", "high", F.lit(1))), odd)
    return F.when(F.size(lines) < 3, F.array(_issue("formatting", "Table has insufficient rows", "high"))).otherwise(full)


def empty_cells(lines: Column) -> Column:
    """From the third line on, cells between the first and last pipe that are blank."""

    def of_row(line: Column, i: Column) -> Column:
        parts = F.split(line, r"\|")
        cells = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda c, j: F.struct(strip(c).alias("c"), j.alias("j")))
        return F.when(i >= 2, F.transform(F.filter(cells, lambda c: c["c"] == ""), lambda c: _issue("missing_data", "Empty cell detected", "low", i, c["j"]))).otherwise(F.array().cast(_NONE))

    return F.flatten(F.transform(lines, of_row))


def spacing(lines: Column) -> Column:
    marked = F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.filter(marked, lambda m: m["x"].contains("  ")), lambda m: _issue("formatting", "Inconsistent spacing detected", "low", m["i"]))


def table_issues(content: Column, rows: Column) -> Column:
    """All issues of a rendered table, in rule order; ``rows`` is the row count that extraction saw (0 or null: unknown)."""
    lines = table_lines(content)
    found = F.size(lines) - 2
    mismatch = _issue("inconsistent_columns", F.concat(F.lit("Row count mismatch: found "), found.cast("string"), F.lit(", expected "), rows.cast("string")), "medium")
    full = F.concat(
        _if(~content.rlike(r"(?:Table|TABLE)\s+\d+[:\.]?\s*(.+)"), _issue("missing_data", "Table caption is missing", "medium")),
        structure_issues(lines), empty_cells(lines), spacing(lines), _if((rows > 0) & (found != rows), mismatch),
    )
    return F.when(F.size(lines) == 0, F.array(_issue("formatting", "No valid table found in content", "high"))).otherwise(full)


def figure_issues(content: Column, caption: Column, image_size: Column, image_index: Column, config: EngineConfig = DEFAULT) -> Column:
    """Issues of a figure: caption, image size, numbering."""
    number = F.when(content.rlike(r"\[Figure\s+\d+\]"), F.regexp_extract(content, r"\[Figure\s+(\d+)\]", 1).cast("int"))
    wrong = F.concat(F.lit("Figure numbering inconsistent: content says "), number.cast("string"), F.lit(", metadata indicates "), (image_index + 1).cast("string"))
    return F.concat(
        _if((F.coalesce(caption, F.lit("")) == "") & ~content.contains("Caption:"), _issue("missing_caption", "Figure caption is missing or not detected", "high")),
        _if(image_size < config.image_size_floor, _issue("low_resolution", "Figure may be low resolution (small file size)", "medium")),
        _if(number.isNull(), _issue("formatting", "Figure number not found in expected format", "medium")),
        _if((image_index >= 0) & (number != image_index + 1), _issue("formatting", wrong, "medium")),
    )


def chunk_confidence(issues: Column) -> Column:
    """1 less 0.2 for each high issue, 0.5 at least."""
    return F.greatest(F.lit(0.5), F.lit(1.0) - 0.2 * F.size(F.filter(issues, lambda i: i["severity"] == "high")))


def issue_changes(kind: str, issues: Column) -> Column:
    """Issues in the shape of changes, for the review record."""
    return F.transform(issues, lambda i: F.struct(F.lit(kind).alias("type"), i["description"].alias("description"), i["severity"].alias("severity"), i["row"].alias("row"), i["col"].alias("col")))


def summary(issues: Column) -> Column:
    """struct<status, total_issues, high, medium, low, by_type>: pass without issues, fail with a high one, else warning."""
    n = lambda s: F.size(F.filter(issues, lambda i: i["severity"] == s))
    kinds = F.array_sort(F.array_distinct(F.transform(issues, lambda i: i["issue_type"])))
    by_type = F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, F.size(F.filter(issues, lambda i: i["issue_type"] == k)))))
    status = F.when(F.size(issues) == 0, "pass").when(n("high") > 0, "fail").otherwise("warning")
    return F.struct(status.alias("status"), F.size(issues).alias("total_issues"), n("high").alias("high"), n("medium").alias("medium"), n("low").alias("low"), by_type.alias("by_type"))


def issue_rows(chunks: DataFrame, issues: Column) -> DataFrame:
    """One row per issue with its ordinal, beside all columns of ``chunks``."""
    return chunks.select("*", F.posexplode_outer(issues).alias("ordinal", "i")).filter("ordinal IS NOT NULL").select(*chunks.columns, "ordinal", "i.*")
