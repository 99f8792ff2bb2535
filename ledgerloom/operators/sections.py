"""Sections of documents: building them from elements, values beside labels, and how strongly a section bears a category.

Elements are rows ``(doc_id, place, kind, text)``; ``kind`` is Title, Header, Table or anything else. Table cells are rows ``(doc_id, table_index, row, col, text)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from ledgerloom.functions.text import trimmed
from ledgerloom.session import ship


@F.pandas_udf(ArrayType(StringType()))
def _cut_bytes(text: pd.Series, most: pd.Series) -> pd.Series:
    """Each text in pieces of at most ``most`` bytes, each as long as it can be; null for null."""

    def pieces(raw: bytes, most: int) -> list[str]:
        out, at = [], 0
        while at < len(raw):
            end = min(at + most, len(raw))
            while end < len(raw) and raw[end] & 0xC0 == 0x80:  # within a code point
                end -= 1
            out.append(raw[at:end].decode())
            at = end
        return out

    return pd.Series([None if t is None else pieces(t.encode(), m) for t, m in zip(text, most, strict=True)])


def byte_pieces(text: Column, most: int) -> Column:
    """A text as an array of pieces of at most ``most`` UTF-8 bytes (4 at least), cut between code points; only longer texts leave the JVM."""
    long = F.when(F.octet_length(text) > most, text)
    return F.coalesce(_cut_bytes(long, F.lit(most)), F.array(text))


def build_sections(elements: DataFrame, most: int = 2048) -> DataFrame:
    """The elements' pieces ``(doc_id, place, piece, kind, text, section)``, sections counted from 0 in each document.

    Blank elements are left out. Longer elements are cut into pieces of ``most`` bytes between code points. A section begins at the first piece of
    a Title, and where the next piece would take it beyond ``most`` bytes. A piece that repeats an earlier one of its section (kind
    and trimmed text) is left out of the result, though its bytes count. Null kinds are NarrativeText, null places come first.

    A document is folded once over the sizes of its pieces; sections are numbered by the fold into one array of numbers, which is built
    by blocks, so the work grows with the document and not with its square.
    """
    ship(elements.sparkSession)
    clean = elements.select("doc_id", "place", F.coalesce("kind", F.lit("NarrativeText")).alias("kind"), trimmed(F.col("text").cast("string")).alias("text")).where(F.length("text") > 0)
    cut = clean.select("doc_id", "place", "kind", byte_pieces(F.col("text"), most).alias("pieces"))
    cut = cut.select("doc_id", "place", "kind", F.posexplode("pieces").alias("piece", "text"))
    title = (F.col("kind") == "Title") & (F.col("piece") == 0)
    order = Window.partitionBy("doc_id").orderBy("place", "piece")
    # between two titles only the bytes decide: runs from title to title are folded, and the sections of earlier runs are added up
    sized = cut.withColumns({"run": F.sum(title.cast("int")).over(order), "size": F.octet_length("text")})
    packed = sized.groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("place", "piece", "size"))).alias("x"))
    starts = packed.select("doc_id", "run", "x", _starts(F.transform("x", lambda x: x["size"]), most).alias("starts"))
    earlier = Window.partitionBy("doc_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("base", F.coalesce(F.sum(F.size("starts")).over(earlier), F.lit(0)))
    # a section is a slice of its run
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("x")))
    parts = starts.select("doc_id", "base", F.posexplode(F.zip_with("starts", ends, lambda a, b: F.slice("x", a + 1, b - a))).alias("nth", "rows"))
    numbered = parts.select("doc_id", (F.col("base") + F.col("nth")).cast("long").alias("section"), F.explode("rows").alias("r")).select("doc_id", "section", "r.place", "r.piece")
    placed = cut.withColumn("_at", F.coalesce("place", F.lit(-1))).join(numbered.select("doc_id", F.coalesce("place", F.lit(-1)).alias("_at"), "piece", "section"), ["doc_id", "_at", "piece"]).drop("_at")
    repeated = F.row_number().over(Window.partitionBy("doc_id", "section", "kind", trimmed(F.col("text"))).orderBy("place", "piece"))
    return placed.withColumn("_copy", repeated).where("_copy = 1").select("doc_id", "place", "piece", "kind", "text", "section")


def _starts(sizes: Column, most: int, block: int = 256) -> Column:
    """Where sections begin in a run of piece sizes, as indices: greedily, each as long as it fits.

    New indices go into a short list, and full lists into a list of lists, so that a long run does not copy all it has found at every step.
    """
    start = F.expr("named_struct('at', 0, 'used', 0L, 'few', array(0), 'blocks', cast(array() as array<array<int>>))")

    def step(state: Column, size: Column) -> Column:
        over = (state["used"] > 0) & (state["used"] + size > most)
        full = over & (F.size(state["few"]) >= block)
        few = F.when(full, F.array(state["at"])).when(over, F.array_append(state["few"], state["at"])).otherwise(state["few"])
        blocks = F.when(full, F.array_append(state["blocks"], state["few"])).otherwise(state["blocks"])
        return F.struct((state["at"] + 1).alias("at"), F.when(over, size.cast("long")).otherwise(state["used"] + size).alias("used"), few.alias("few"), blocks.alias("blocks"))

    return F.aggregate(sizes, start, step, lambda s: F.concat(F.flatten(s["blocks"]), s["few"]))


def adjacent_values(elements: DataFrame, cells: DataFrame, fields: Mapping[str, str], wanted: Mapping[str, str] = {}, unwanted: Mapping[str, str] = {}) -> DataFrame:
    """``(doc_id, field, place, source, label, value)``: the element right after a label, and the cell right of a label's cell in its row.

    ``fields`` gives each field the pattern its whole label matches (without regard to case; an outline number before it does not count).
    Blank values, values that are labels themselves, values without a field's ``wanted`` pattern or with its ``unwanted`` one are left
    out. ``source`` is ``line`` or ``cell``; the place of a cell is its row. Only direct neighbours count, so each label has one value at most.
    """
    outline = r"^(?:\(?[0-9]{1,3}[.)]|[ivxIVX]{1,5}[.)])\s*"
    following = Window.partitionBy("doc_id").orderBy("place")
    right = Window.partitionBy("doc_id", "table_index", "row").orderBy("col")
    lines = elements.select("doc_id", F.col("place").cast("long").alias("place"), F.lit("line").alias("source"), F.regexp_replace(trimmed(F.col("text")), outline, "").alias("label"), trimmed(F.lead("text").over(following)).alias("value"))
    beside = cells.select("doc_id", F.col("row").cast("long").alias("place"), F.lit("cell").alias("source"), trimmed(F.col("text")).alias("label"), F.when(F.lead("col").over(right) == F.col("col") + 1, trimmed(F.lead("text").over(right))).alias("value"))
    both = lines.unionByName(beside).where(F.length("value") > 0)
    matches = lambda c, pattern: F.coalesce(c.rlike(f"(?i)^(?:{pattern})$"), F.lit(False))
    has = lambda c, pattern: F.coalesce(c.rlike(pattern), F.lit(False))
    known = F.array_compact(F.array(*[F.when(matches(F.col("label"), p), f) for f, p in fields.items()]))
    any_label = F.lit(False)
    for pattern in fields.values():
        any_label = any_label | matches(F.col("value"), pattern)
    found = both.where(~any_label).select("doc_id", F.explode(known).alias("field"), "place", "source", "label", "value")
    for field, pattern in wanted.items():
        found = found.where((F.col("field") != field) | has(F.col("value"), pattern))
    for field, pattern in unwanted.items():
        found = found.where((F.col("field") != field) | ~has(F.col("value"), pattern))
    return found


def evidence_ranks(rows: DataFrame, categories: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``(doc_id, category, section, strength, heading, dedicated, hits, rank)`` of every section that names a category.

    ``rows`` are ``(doc_id, section, place, kind, text)``; ``categories`` gives each category the pattern of its label and that of its
    values. A section's strength is 0 where a row has the label and a value, or a row with the label is followed
    by one with a value but not the label, in this section or as the first row of the next; 1 where the label heads the section (Title or Header); 2 for
    a mere reference. The rank prefers strength, then a heading, then sections about this category alone, then more rows with the
    label, then sections without a table, then the earlier one.
    """
    order = Window.partitionBy("doc_id").orderBy("section", "place")
    heads = F.lower(F.coalesce("kind", F.lit(""))).isin("title", "header")
    table = F.lower(F.coalesce("kind", F.lit(""))) == "table"
    near = rows.select("doc_id", "section", heads.alias("head"), table.alias("table"), "text", F.lead("text").over(order).alias("next"))
    has = lambda c, pattern: F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    told = F.array(*[F.struct(F.lit(c).alias("category"), has("text", label).alias("hit"), (has("text", label) & (has("text", value) | (has("next", value) & ~has("next", label)))).alias("valued")) for c, (label, value) in categories.items()])
    flat = near.select("doc_id", "section", "head", "table", F.inline(told))
    per = flat.groupBy("doc_id", "section", "category").agg(F.count_if("hit").alias("hits"), F.bool_or("valued").alias("valued"), F.bool_or(F.col("hit") & F.col("head")).alias("heading"), F.bool_or("table").alias("table")).where("hits > 0")
    named = per.withColumn("dedicated", F.count("*").over(Window.partitionBy("doc_id", "section")) == 1)
    strength = F.when(F.col("valued"), 0).when(F.col("heading"), 1).otherwise(2)
    ranked = named.withColumn("strength", strength)
    best = Window.partitionBy("doc_id", "category").orderBy("strength", F.desc("heading"), F.desc("dedicated"), F.desc("hits"), "table", "section")
    return ranked.select("doc_id", "category", "section", "strength", "heading", "dedicated", "hits", F.row_number().over(best).alias("rank"))


def coverage(ranks: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """``(doc_id, missing)``: the wanted categories that no section of a document bears with a value, in the order given."""
    some = ranks.where("strength = 0").groupBy("doc_id").agg(F.collect_set("category").alias("_have"))  # at most one for each category
    docs = ranks.select("doc_id").distinct().join(some, "doc_id", "left")
    return docs.select("doc_id", F.array_except(F.array(*map(F.lit, wanted)), F.coalesce("_have", F.array().cast("array<string>"))).alias("missing"))
