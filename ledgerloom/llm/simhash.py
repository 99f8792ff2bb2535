"""SimHash near-duplicates: fingerprints from word shingles, linked through the pigeonring filter.

**Fingerprint.** A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of ``width`` words joined by a space (repeats
count; with fewer words the whole sequence is one shingle), XXH64 with seed 42; a bit is 1 when it is set in more than
half of the hashes. A null, empty or blank text has fingerprint zero, which links like any other.

**Pigeonring.** The 64 bits are a ring of ``segments`` parts. If two fingerprints differ in at most ``radius`` bits, some
part starts a chain in which, for every length ``l``, the first ``l`` parts together differ in at most
``l * radius / segments`` bits. While that budget is below 1 the parts must be equal, so those leading parts are an
equi-join key; the longer chains and then the full distance are checked on the pairs that meet. A key met by more than
``hot`` fingerprints is dealt on by the longest chain prefix with a budget of one bit: each of its fingerprints goes under its own
prefix, and under those one bit away beyond the key, where it meets the fingerprints whose own prefix that is. Only prefixes that are
crowded again leave the filter: their members are linked through the values one bit away from them (two fingerprints within two bits
share such a value), which is exact and needs rows in proportion to the members.

**Edge cases.** One output row for each input row; rows that repeat keep their own fingerprints and share a component. A null doc_id
takes part but names no component unless all its members are null. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.memory import task
from ledgerloom.operators.components import connected_components, label_rows
from ledgerloom.session import Scratch, materialise, ship

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SLICE = 1 << 15


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text; memory beside the text is bounded by ``_SLICE`` shingles."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split() if text else []
    if not words:
        return 0
    total = max(1, len(words) - width + 1)
    counts = np.zeros(64, np.int64)
    for begin in range(0, total, _SLICE):
        part = words[begin : min(begin + _SLICE, total) + width - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        hashes = np.fromiter((xxh64_intdigest(x, 42) for x in grams), np.uint64)
        # bits of 8 bytes at a time: counting per byte column keeps the unpacked block small
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _prints(texts: pa.Array, width: int) -> pa.Array:
    known: dict[bytes | None, int] = {}
    out = np.empty(len(texts), np.uint64)
    for i, x in enumerate(texts.cast(pa.large_binary())):
        x = x.as_py()
        if x not in known:
            known[x] = fingerprint(x, width)
        out[i] = known[x]
    return pa.array(out.view(np.int64))


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, fp)`` for every row, and the columns ``keep``; ``fp`` is the fingerprint's bit pattern as a signed long."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _prints(batch.columns[-1], width)], ["doc_id", *keep, "fp"])

    return own.mapInArrow(task(run), own.drop("text").schema.add("fp", "long"))


def _bounds(segments: int) -> list[tuple[int, int]]:
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _mask(bounds: list[tuple[int, int]]) -> int:
    value = sum(((1 << (hi - lo)) - 1) << lo for lo, hi in bounds)
    return value - (1 << 64) if value >> 63 else value


def _chain(difference: Column, start: int, segments: int, radius: int) -> Column:
    """Whether the chain that begins at part ``start`` stays within its proportional budget at every length."""
    parts = _bounds(segments)
    tests = []
    for length in range(1, segments + 1):
        inside = [parts[(start + i) % segments] for i in range(length)]
        tests.append(F.bit_count(difference.bitwiseAND(F.lit(_mask(inside)))) <= length * radius // segments)
    return reduce(Column.__and__, tests)


def links(prints: DataFrame, radius: int = 2, segments: int = 5, hot: int = 256, fp_col: str = "fp", scratch: Scratch | None = None) -> DataFrame:
    """Links ``(src, dst)`` between different fingerprints within ``radius`` bits, enough to join all that are connected.

    Below ``hot`` members a key, or a longer prefix, gives every link it finds; above it, a star per shared neighbour value. Every
    emitted pair is within ``radius`` bits.
    """
    if radius not in (1, 2) or segments <= radius:
        raise ValueError("radius must be 1 or 2 and segments more than that")
    scratch = scratch or Scratch(prints.sparkSession)
    exact = -(-segments // radius) - 1
    parts = _bounds(segments)
    values = prints.select(F.col(fp_col).alias("fp")).distinct()
    ring = [[parts[(s + i) % segments] for i in range(segments)] for s in range(segments)]
    keyed = values.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_mask(r[:exact]))) for r in ring])).alias("start", "key"))
    sizes = keyed.groupBy("start", "key").agg(F.count("*").alias("size")).where("size > 1")
    met = scratch.materialise(keyed.join(sizes, ["start", "key"]), "simhash-keys")
    one, two = met.where(F.col("size") <= hot).alias("a"), met.where(F.col("size") <= hot).alias("b")
    near = _within(F.col("a.start"), F.col("a.fp").bitwiseXOR(F.col("b.fp")), segments, radius)
    pairs = one.join(two, (F.col("a.start") == F.col("b.start")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & near)
    ordinary = pairs.select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
    crowded = met.where(F.col("size") > hot).select("start", "fp")
    if radius == 1:  # the leading parts leave one part: there is no longer prefix with a budget
        members = crowded.select("fp").distinct()
        spread = members.select("fp", F.explode(_one_bit_away(F.col("fp"))).alias("value"))
        starred = spread.join(members.select(F.col("fp").alias("value")), "value").where("fp > value").select(F.col("value").alias("src"), F.col("fp").alias("dst"))
        return ordinary.unionByName(starred).distinct()
    # the longest prefix whose budget is one bit, and the bits beyond the key in which it may lie
    longer = max(i for i in range(exact, segments + 1) if i * radius // segments == 1)
    prefix = F.element_at(F.array(*[F.lit(_mask(r[:longer])) for r in ring]), F.col("start") + 1)
    beyond = F.element_at(F.array(*[F.array(*[F.lit(_bit(b)) for lo, hi in r[exact:longer] for b in range(lo, hi)]) for r in ring]), F.col("start") + 1)
    own = crowded.withColumn("code", F.col("fp").bitwiseAND(prefix))
    visits = own.select("start", "fp", F.explode(F.transform(beyond, lambda x: F.col("code").bitwiseXOR(x))).alias("code"), F.lit(False).alias("home")).unionByName(own.withColumn("home", F.lit(True)))
    extent = visits.groupBy("start", "code").agg(F.count_if("home").alias("homes"), F.count("*").alias("all")).where("homes > 0 AND all > 1")
    dealt = scratch.materialise(visits.join(extent, ["start", "code"]), "simhash-prefixes")
    open_ = dealt.where(F.col("homes") <= hot)
    one, two = open_.where("home").alias("a"), open_.alias("b")
    near = _within(F.col("a.start"), F.col("a.fp").bitwiseXOR(F.col("b.fp")), segments, radius)
    met_again = one.join(two, (F.col("a.start") == F.col("b.start")) & (F.col("a.code") == F.col("b.code")) & (F.col("a.fp") != F.col("b.fp")) & near)
    dealt_on = met_again.select(F.least("a.fp", "b.fp").alias("src"), F.greatest("a.fp", "b.fp").alias("dst"))
    left = dealt.where(F.col("homes") > hot).select("fp").distinct()
    spread = left.select("fp", F.explode(F.concat(F.array("fp"), _one_bit_away(F.col("fp")))).alias("value"))
    centre = spread.groupBy("value").agg(F.min("fp").alias("src"), F.count("*").alias("n")).where("n > 1").select("value", "src")
    starred = spread.join(centre, "value").where("fp <> src").select("src", F.col("fp").alias("dst"))
    return ordinary.unionByName(dealt_on).unionByName(starred).distinct()


def _within(start: Column, difference: Column, segments: int, radius: int) -> Column:
    budget = reduce(Column.__or__, [(start == s) & _chain(difference, s, segments, radius) for s in range(segments)])
    return budget & (F.bit_count(difference) <= radius)


def _bit(b: int) -> int:
    return (1 << b) - (1 << 64) if b == 63 else 1 << b


def _one_bit_away(value: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))


def _classes(prints: DataFrame, first: Column, radius: int, segments: int, hot: int) -> DataFrame:
    """``(fp, members, first)`` of every fingerprint: how many rows have it, and the least ``first`` of its component."""
    classes = materialise(prints.groupBy("fp").agg(F.count("*").alias("members"), F.min(first).alias("first")), "simhash-classes")
    scratch = Scratch(prints.sparkSession)
    component = connected_components(links(classes, radius, segments, hot, scratch=scratch))
    scratch.clear()
    reach = classes.join(component.select(F.col("id").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = reach.groupBy("component").agg(F.min("first").alias("first"))
    return reach.drop("first").join(least, "component").select("fp", "members", "first")


def simhash_groups(docs: DataFrame, width: int = 3, radius: int = 2, segments: int = 5, hot: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: 16 lowercase hex digits and the smallest doc_id reachable by links.

    Documents with equal fingerprints meet in their smallest doc_id first, so copies are never paired with each other.
    """
    prints = materialise(fingerprints(docs, width, id_col, text_col), "simhash")
    classes = materialise(_classes(prints, F.col("doc_id"), radius, segments, hot), "simhash-labels")
    return label_rows(prints, classes, ["fp"], "members").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def first_of_groups(docs: DataFrame, width: int = 3, radius: int = 2, segments: int = 5, hot: int = 256) -> DataFrame:
    """One row of each group of ``docs``, with its columns: the smallest doc_id (nulls last), then the first in the read.

    It is decided row by row, so rows that share a doc_id but no text are separate documents. Rows are told apart by their place in
    the read, so ``docs`` must be a table of files (or otherwise give the same rows in the same order whenever it is read).
    """
    row = "_" * (1 + max(map(len, docs.columns)))
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    prints = materialise(fingerprints(numbered, width, keep=(row,)), "simhash")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col(row).alias("row"))
    kept = _classes(prints, first, radius, segments, hot).select(F.col("first.row").alias(row)).distinct()
    return numbered.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
