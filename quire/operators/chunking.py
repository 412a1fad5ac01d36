"""Chunking: long text chunks become several, split at paragraphs by size or by section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.config import DEFAULT, EngineConfig
from quire.functions.text import bind, strip

#: What starts a section heading.
HEADERS = [
    r"^\d+(?:\.\d+)*\s+[A-Z]", r"^\d+(?:\.\d+)*\s+[a-z]", r"^\s*\d+(?:\.\d+)*\s+\w+", r"^SECTION\s+\d+(?:\.\d+)*", r"^Section\s+\d+(?:\.\d+)*",
    r"^[A-Z][A-Z\s]{10,}$", r"^[A-Z][a-z\s]+:$",
]
HEADER = "|".join(f"(?:{p})" for p in HEADERS)
#: Pieces that a list takes before it is set aside whole, so that adding one does not copy all before it.
BLOCK = 256


def chunk_id(content: Column, page_no: Column, suffix: Column) -> Column:
    """Identifier from the first 100 characters, the 0-based page and a suffix."""
    tail = F.when(suffix != "", F.concat(F.lit("_"), suffix)).otherwise("")
    return F.concat(F.lit("chunk_"), page_no.cast("string"), F.lit("_"), F.substring(F.md5(F.concat(F.substring(content, 1, 100), page_no.cast("string"), suffix)), 1, 12), tail)


def _start() -> Column:
    """State of a split: the piece under way, the latest finished pieces, and full lists of earlier ones."""
    return F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"), F.array().cast("array<array<string>>").alias("full"))


def _next(a: Column, flush: Column, cur: Column) -> Column:
    """The state with ``cur`` under way; where ``flush`` holds the piece before is finished (never inside ``bind``, which would copy the state)."""
    piece, aside = F.array(strip(a["cur"])), F.size(a["out"]) >= BLOCK
    out = F.when(aside & flush, piece).when(flush, F.concat(a["out"], piece)).otherwise(a["out"])
    return F.struct(cur.alias("cur"), out.alias("out"), F.when(aside & flush, F.concat(a["full"], F.array(a["out"]))).otherwise(a["full"]).alias("full"))


def _finished(a: Column) -> Column:
    return F.flatten(F.concat(a["full"], F.array(a["out"])))


def _joined(a: Column, p: Column) -> Column:
    """The piece under way with one more paragraph."""
    return F.when(a["cur"] != "", F.concat(a["cur"], F.lit("\n\n"), p)).otherwise(p)


def fixed_pieces(text: Column, size: int, overlap: int) -> Column:
    """Stripped pieces: paragraphs are added until the next would pass ``size``; a new piece starts with the last ``overlap`` characters."""

    def add(a: Column, p: Column) -> Column:
        flush = (F.length(a["cur"]) + F.length(p) > size) & (a["cur"] != "")
        return _next(a, flush, F.when(flush, F.concat(F.right(a["cur"], F.lit(overlap)), F.lit("\n\n"), p)).otherwise(_joined(a, p)))

    def finish(a: Column) -> Column:
        return bind(strip(a["cur"]), lambda rest: F.when(rest != "", F.concat(_finished(a), F.array(rest))).otherwise(_finished(a)))

    return F.aggregate(F.split(text, "\n\n"), _start(), add, finish)


def segments(text: Column) -> Column:
    """array<struct<text, boundary>>: stripped paragraphs, and whether each looks like a heading."""
    short = lambda p: (F.length(p) < 60) & ~p.contains("\n") & p.rlike(r"^\p{Lu}") & ~p.endswith(".")
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")
    return F.transform(paragraphs, lambda p: F.struct(p.alias("text"), (p.rlike(HEADER) | short(p)).alias("boundary")))


def semantic_overlap(text: Column, overlap: int) -> Column:
    """The last two sentences, at most 400 characters; nothing for texts under 100."""
    s = F.split(text, r"[.!?]\s+")
    two = F.array_join(F.slice(s, -2, 2), ". ")
    most = min(2 * overlap, 400)
    return F.when(F.length(text) < 100, "").when(F.size(s) >= 2, F.when(F.length(two) > most, F.right(two, F.lit(most))).otherwise(two)).otherwise(F.right(text, F.lit(overlap)))


def semantic_pieces(text: Column, least: int, most: int, overlap: int) -> Column:
    """Stripped pieces: a heading starts a new one once ``least`` is reached, any paragraph where it would pass ``most``; a short rest joins the piece before."""

    def add(a: Column, s: Column) -> Column:
        n = F.length(a["cur"])
        flush = (a["cur"] != "") & ((s["boundary"] & (n >= least)) | (n + F.length(s["text"]) > most))
        again = bind(semantic_overlap(a["cur"], overlap), lambda carry: F.when(carry != "", F.concat(carry, F.lit("\n\n"), s["text"])).otherwise(s["text"]))
        return _next(a, flush, F.when(flush, again).otherwise(_joined(a, s["text"])))

    def end(a: Column, rest: Column, out: Column) -> Column:
        n = F.size(out)
        joined = F.concat(F.slice(out, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(out, F.greatest(n, F.lit(1))), F.lit("\n\n"), rest)))
        return F.when(rest == "", out).when((F.length(a["cur"]) >= least) | (n == 0), F.concat(out, F.array(rest))).otherwise(joined)

    def finish(a: Column) -> Column:
        return bind(strip(a["cur"]), lambda rest: bind(_finished(a), lambda out: end(a, rest, out)))

    return F.aggregate(segments(text), _start(), add, finish)


def split_chunks(chunks: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """chunks with long text chunks replaced by their pieces (sub_chunk counts them from 0; null for chunks left whole).

    Tables, figures and texts of at most ``chunk_size`` characters pass unchanged. A text without any piece stays whole.
    """
    content = F.col("content")
    if config.chunking_strategy == "semantic":
        pieces = semantic_pieces(content, config.min_chunk_size, config.max_chunk_size, config.overlap)
    else:
        pieces = fixed_pieces(content, config.chunk_size, config.overlap)
    long = (F.col("chunk_type") == "text") & (F.length(content) > config.chunk_size)
    df = chunks.withColumn("_p", F.when(long, pieces)).withColumn("_p", F.when(F.size("_p") > 0, F.col("_p")))
    # Neither the text nor its pieces go along with each piece.
    own = [c for c in chunks.columns if c != "content"]
    out = df.select(*own, F.col("_p").isNull().alias("_w"), F.posexplode_outer(F.coalesce("_p", F.array(content))).alias("_i", "content"))
    part = F.concat("chunk_id", F.lit("_sub_"), F.col("_i").cast("string"))
    named = out.withColumns({"chunk_id": F.when(F.col("_w"), F.col("chunk_id")).otherwise(part), "sub_chunk": F.when(~F.col("_w"), F.col("_i"))})
    return named.select(*[c for c in chunks.columns if c != "sub_chunk"], "sub_chunk")
