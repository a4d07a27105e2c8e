"""Phrase search over log lines, with snippets and context."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questlog.operators.scan import LINE_BLOCK

TOKEN = r"[\p{L}\p{N}\p{Co}\p{M}]+"
SNIPPET_TOKENS = 64

def _bare(ch: str) -> str:
    """A letter without its diacritics; letters that are composed otherwise stay."""
    first, *marks = unicodedata.normalize("NFD", ch)
    return first if marks and all(unicodedata.category(m)[0] == "M" for m in marks) else ch


# letter with diacritics -> the bare letter, for every letter of the basic plane that Unicode composes that way
_FOLD = {ch: _bare(ch) for ch in map(chr, range(0xC0, 0xD800)) if _bare(ch) != ch}


def fold(c: Column) -> Column:
    """Case-folded, without diacritics."""
    low = F.lower(c)
    keys = "".join(k for k in _FOLD if k == k.lower())
    return F.regexp_replace(F.translate(low, keys, "".join(_FOLD[k].lower() for k in keys)), r"\p{M}", "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(fold(c), F.lit(f"({TOKEN})"), F.lit(1))


def query_tokens(query: str) -> list[str]:
    bare = "".join(_FOLD.get(ch, ch) for ch in query.lower() if unicodedata.category(ch)[0] != "M")
    return re.findall(r"[^\W_]+", bare)


def index_lines(lines: DataFrame, with_tokens: bool = False) -> DataFrame:
    """Lines worth indexing; optionally with their tokens as one text, so a search need not split them again."""
    kept = lines.filter(F.trim("content") != "")
    if with_tokens:
        kept = kept.withColumn("token_text", _token_text(F.col("content")))
    return kept


def _token_text(c: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" "))


def is_speech(c: Column) -> Column:
    return c.ilike("* %") | c.ilike('%says, "%') | c.ilike("%says in %")


def matches(c: Column, query: str, token_text: Column | None = None) -> Column:
    """The query's tokens occur in the line as one phrase. A blank query matches nothing.

    A cheap substring test on the longest plain word runs before the line is tokenised.
    """
    words = query_tokens(query)
    if not words:
        return F.lit(False)
    hit = (token_text if token_text is not None else _token_text(c)).contains(" " + " ".join(words) + " ")
    return hit if token_text is not None else fold(c).contains(max(words, key=len)) & hit


def snippet(content: Column, query: str) -> Column:
    """The phrase in <mark>; cut to 64 tokens around the first hit, with '...' where cut."""
    words = query_tokens(query)
    letters = lambda w: "".join(
        "[" + re.escape(ch) + "".join(k for k, v in _FOLD.items() if v.lower() == ch and k == k.lower()) + "]" for ch in w)
    phrase = r"(?iu)(?<![\p{L}\p{N}])(" + r"[^\p{L}\p{N}]+".join(letters(w) for w in words) + r")(?![\p{L}\p{N}])"
    marked = F.regexp_replace(content, phrase, "<mark>$1</mark>")
    parts = F.split(marked, " ")
    at = F.coalesce(F.array_position(F.transform(parts, lambda p: p.contains("<mark>")), True), F.lit(1))
    start = F.greatest(F.lit(1), F.least((at - SNIPPET_TOKENS // 2).cast("int"), F.size(parts) - SNIPPET_TOKENS + 1))
    cut = F.array_join(F.slice(parts, start, F.lit(SNIPPET_TOKENS)), " ")
    return F.concat(F.when(start > 1, F.lit("...")).otherwise(""), cut,
                    F.when(start + SNIPPET_TOKENS - 1 < F.size(parts), F.lit("...")).otherwise(""))


def search(lines: DataFrame, characters: DataFrame | None, query: str, character: str | None = None, limit: int | None = None,
           include_speech: bool = False, before: int = 0, after: int = 0) -> DataFrame:
    """Hits in order of file and line, newest first, with their snippet and `before`/`after` context lines.

    Context is a join of the hits with the few line numbers around them, so only hits and their
    neighbours are shuffled, never whole files.
    """
    lines = index_lines(lines)
    text = F.col("content")
    hits = lines.filter(matches(text, query, F.col("token_text") if "token_text" in lines.columns else None))
    if character is not None:
        hits = hits.filter(F.col("character") == character)
    if not include_speech:
        hits = hits.filter(~is_speech(text))
    hits = hits.withColumn("snippet", snippet(text, query) if query_tokens(query) else F.lit(""))
    if characters is not None:
        known = characters.select("character", F.col("character").alias("_name"))
        hits = hits.join(known, "character", "left").withColumn("character_name", F.coalesce("_name", F.lit("Unknown"))).drop("_name")
    else:
        hits = hits.withColumn("character_name", F.coalesce("character", F.lit("Unknown")))
    hits = hits.orderBy(F.desc("path"), F.desc("line_no"))
    if limit is not None:
        hits = hits.limit(limit)
    return hits if before == 0 and after == 0 else with_context(hits, lines, before, after)


def with_context(hits: DataFrame, lines: DataFrame, before: int, after: int) -> DataFrame:
    around = hits.select("path", F.col("line_no").alias("_hit"), F.explode(F.sequence(
        F.col("line_no") - before, F.col("line_no") + after)).alias("line_no"))
    near = around.join(lines.select("path", "line_no", "content"), ["path", "line_no"])
    side = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("line_no", "content")))), lambda s: s["content"])
    context = near.groupBy("path", F.col("_hit").alias("line_no")).agg(
        side(F.col("line_no") < F.col("_hit")).alias("context_before"), side(F.col("line_no") > F.col("_hit")).alias("context_after"))
    return hits.join(context, ["path", "line_no"], "left")


def context_windows(lines: DataFrame, before: int, after: int) -> DataFrame:
    """Context of every line, for exports that need all of them: windows over blocks that overlap at their edges."""
    lines = index_lines(lines)
    block = F.floor(F.col("line_no") / LINE_BLOCK)
    edges = F.array_distinct(F.array(block, F.floor((F.col("line_no") - after) / LINE_BLOCK), F.floor((F.col("line_no") + before) / LINE_BLOCK)))
    copies = lines.withColumn("_own", block).withColumn("_block", F.explode(edges))
    w = Window.partitionBy("path", "_block").orderBy("line_no")
    out = copies.withColumn("context_before", F.collect_list("content").over(w.rangeBetween(-before, -1))).withColumn(
        "context_after", F.collect_list("content").over(w.rangeBetween(1, after)))
    return out.filter("_own = _block").drop("_own", "_block")


def counts(lines: DataFrame) -> DataFrame:
    return index_lines(lines).groupBy("path").agg(F.count("*").alias("lines"))
