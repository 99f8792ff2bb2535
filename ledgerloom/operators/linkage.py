"""Record linkage: blocked similarity joins, duplicate edges and groups, containment and keyword matches."""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.deletions import pairs_of_lengths, subsequences
from ledgerloom.functions.grams import bitmap, gram_hashes, on_map
from ledgerloom.functions.ratio import matching_ratio
from ledgerloom.functions.text import similarity
from ledgerloom.operators.components import connected_components
from ledgerloom.session import materialise, ship, tasks


def star_edges(rows: DataFrame, id_col: str, key: Column) -> DataFrame:
    """Rows that share a key, each linked to the smallest id of the key: as many edges as rows, whatever the group."""
    keyed = rows.select(F.col(id_col).alias("dst"), key.alias("_key")).where("_key IS NOT NULL")
    centre = keyed.groupBy("_key").agg(F.min("dst").alias("src"))
    return keyed.join(centre, "_key").where("src <> dst").select("src", "dst")


def similar_names(names: DataFrame, name: str, threshold: float, within: Sequence[str] = (), metric: str = "edits", side: str | None = None) -> DataFrame:
    """Pairs ``(a, b)`` of different names, ``a < b``, that are ``threshold`` alike; with ``within``, only inside equal keys, which are
    returned as well. Both blockings lose nothing.

    With ``edits``, ``score`` is ``1 - edit distance / longer length``. With ``blocks``, ``score`` is the matching-blocks ratio ``2 M / T`` of a with
    b and ``back`` that of b with a, which may differ; a pair counts if either reaches the threshold. ``M`` characters in common order
    leave ``T - 2 M`` to insert or delete, so the edit distance is at most ``(1 - threshold) T``: from 0.75 on, names meet by what is left of
    them without a few characters, or, where that is too much, by parts as with edits; below by characters.

    With ``side`` (blocks only), a column that has 1, 2 or 3 for each name, pairs are made of a name of side 1 and one of side 2; 3 is both.
    """
    if metric == "edits":
        met = _meet_by_parts(names, name, threshold, within)
        return met.withColumn("score", similarity(F.col("a"), F.col("b"))).where(F.col("score") >= threshold)
    close = _close_names(names, name, threshold, within, side)
    return close.withColumns({"score": matching_ratio("a", "b"), "back": matching_ratio("b", "a")}).where(F.greatest("score", "back") >= threshold)


def _close_names(names: DataFrame, name: str, threshold: float, within: Sequence[str], side: str | None = None) -> DataFrame:
    """Pairs ``(a, b)`` that may reach a ratio of ``threshold``, by characters or deletions and edit distance."""
    ship(names.sparkSession)
    met = _meet_by_deletions(names, name, threshold, within, side) if threshold >= 0.75 else _meet_by_characters(names, name, threshold, within, side)
    total = F.length("a") + F.length("b")
    edits = F.floor((1 - threshold) * total + 1e-9).cast("int")
    # an edit distance is cheap and rules most pairs out before the ratio is computed; the bound differs by pair, so it is not a cutoff
    return met.where((F.abs(F.length("a") - F.length("b")) <= edits) & (F.levenshtein("a", "b") <= edits))


def _meet_by_deletions(names: DataFrame, name: str, threshold: float, within: Sequence[str], side: str | None = None) -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, that may reach a ratio of ``threshold``: names that share ``M`` characters in common order share a
    subsequence of that length, so they meet on its hash. That finds no pair only because many names begin or end alike.

    For each two lengths that occur, ``M`` is known, and each name leaves out the rest. Where the longer name leaves out more than the
    shorter, its subsequences are given only if a bitmap of fixed size says that a shorter name may have them, unless they are few. Lengths with too many
    subsequences meet by parts.
    """
    keys, spark = list(within), names.sparkSession
    distinct = names.select(*keys, F.col(name).alias("n"), (F.col(side) if side else F.lit(3)).alias("_side")).where(F.length("n") > 0).distinct()
    distinct = materialise(distinct.select(F.monotonically_increasing_id().alias("id"), *keys, "n", "_side"), "names")
    counts = {x["size"]: x["count"] for x in distinct.groupBy(F.length("n").alias("size")).count().collect()}
    few, other = pairs_of_lengths(sorted(counts), threshold)
    rows = distinct.select("id", "n", (F.xxhash64(*keys) if keys else F.lit(0).cast("long")).alias("salt"))
    equal, shorter, longer = {}, {}, {}
    for number, (a, b, m) in enumerate(few):
        for asked, n in ((equal, a),) if a == b else ((longer, a), (shorter, b)):
            asked.setdefault(n, []).append((m, number))

    def give(wanted, bits=None):
        left_out = {number: b - m for number, (_, b, m) in enumerate(few)}
        keep = None if bits is None else lambda hashes, kind: on_map(bits[left_out[kind]].value, hashes)

        def run(batches):
            for batch in batches:
                salt = batch.column(2).to_numpy().view(np.uint64)
                for row, hashes, kind in subsequences(batch.column(1), salt, wanted, keep):
                    kinds = pa.array(np.full(len(row), left_out[kind], np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(hashes.view(np.int64)), kinds], ["id", "hash", "left_out"])

        asked = rows.where(F.length("n").isin(*wanted)).repartition(tasks(spark))
        return asked.mapInArrow(run, "id long, hash long, left_out int")

    met = None
    if equal:
        twice = materialise(give(equal).select("id", "hash").distinct(), "subsequences")
        met = twice.withColumnRenamed("id", "x").join(twice.withColumnRenamed("id", "y"), "hash").where("x < y").select("x", "y")
    if shorter:
        left = materialise(give(shorter), "shorter-subsequences")
        bits = None
        if sum(counts[n] * comb(n, m) for n, asked in longer.items() for m, _ in asked) > 1_000_000:
            bits = {d: spark.sparkContext.broadcast(bitmap(left.where(F.col("left_out") == d), "hash")) for d in sorted({b - m for a, b, m in few if a != b})}
        right = materialise(give(longer, bits), "longer-subsequences")
        both = left.select(F.col("id").alias("x"), "hash").join(right.select(F.col("id").alias("y"), "hash"), "hash").select("x", "y")
        met = both if met is None else met.unionByName(both)
    end = lambda i, n, s: distinct.select(F.col("id").alias(i), *keys, F.col("n").alias(n), F.col("_side").alias(s))
    out = None
    if met is not None:
        both = met.distinct().join(end("x", "_x", "_s"), "x").join(end("y", "_y", "_t"), ["y", *keys]).where(F.col("_s").bitwiseOR(F.col("_t")) == 3)
        out = both.select(*keys, F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))
    if other or out is None:
        parts = _meet_by_parts(distinct.where(F.length("n").isin(*other)), "n", 2 * threshold - 1, within)
        if side:
            known = lambda n, s: distinct.select(*keys, F.col("n").alias(n), F.col("_side").alias(s))
            parts = parts.join(known("a", "_s"), [*keys, "a"]).join(known("b", "_t"), [*keys, "b"]).where(F.col("_s").bitwiseOR(F.col("_t")) == 3).select(*keys, "a", "b")
        out = parts if out is None else out.unionByName(parts).distinct()
    return out


def _meet_by_characters(names: DataFrame, name: str, threshold: float, within: Sequence[str], side: str | None = None) -> DataFrame:
    """Pairs ``(a, b)`` that may reach a ratio of ``threshold``, by their characters.

    ``M`` is at most the overlap of the two bags of characters, numbered as (character, how often so far). A name of length n needs
    ``n threshold / (2 - threshold)`` of them in common with any partner, so of its elements, rarest first, the others and one more must hold
    a common one. Elements are ordered by how many names have them; then lengths and full overlaps are checked.
    """
    keys = list(within)
    distinct = names.select(*keys, F.col(name).alias("n"), (F.col(side) if side else F.lit(3)).alias("_side")).where(F.length("n") > 0).distinct()
    letters = F.array_sort(F.regexp_extract_all("n", F.lit("(?s)(.)"), F.lit(1)))
    numbered = F.transform(letters, lambda c, i: F.concat(c, (i - F.array_position(letters, c)).cast("string")))  # equal characters are neighbours
    bags = materialise(distinct.withColumn("bag", numbered), "name-bags")
    single = bags.select(*keys, "n", "_side", F.explode("bag").alias("element"))
    uses = single.groupBy("element").agg(F.count("*").alias("uses"))
    ordered = single.join(uses, "element").groupBy(*keys, "n", "_side").agg(F.array_sort(F.collect_list(F.struct("uses", "element"))).alias("rare"))
    size = F.length("n")
    needed = F.ceil(size * (threshold / (2 - threshold)) - 1e-9).cast("int")
    prefix = ordered.select(*keys, "n", "_side", F.explode(F.slice("rare", F.lit(1), size - needed + 1)).alias("e")).select(*keys, "n", "_side", F.col("e.element").alias("element"))
    one = lambda n, s: prefix.where(F.col("_side").bitwiseAND(F.lit(s)) > 0).select(*keys, "element", F.col("n").alias(n))
    left, right = one("x", 1), one("y", 2)
    lx, ly = F.length("x"), F.length("y")
    met = left.join(right, [*keys, "element"]).where((F.col("x") != F.col("y") if side else F.col("x") < F.col("y")) & (2 * F.least(lx, ly) >= threshold * (lx + ly) - 1e-9))
    met = met.select(*keys, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    la, lb = F.length("a"), F.length("b")
    bag = lambda n, x: bags.select(F.col("n").alias(n), F.col("bag").alias(x)).distinct()
    return met.join(bag("a", "_x"), "a").join(bag("b", "_y"), "b").where(2 * F.size(F.array_intersect("_x", "_y")) >= threshold * (la + lb) - 1e-9).select(*keys, "a", "b")


def _meet_by_parts(names: DataFrame, name: str, threshold: float, within: Sequence[str]) -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, that hold all with ``1 - edit distance / longer length >= threshold``.

    With d edits allowed on the longer name, one of its d + 1 equal parts survives with as many edits before it, at
    most, as there are parts before it, and no more after it than parts after it. So part i is looked for only i places to either side
    of where it was, counted from the left, and d - i from the right. Names meet on (keys, part, length of the longer, place).
    A name has about (d + 1)^2 / 2 rows for each longer length that is possible.
    """
    keys = list(within)
    distinct = names.select(*keys, F.col(name).alias("n")).where(F.length("n") > 0).distinct()
    edits = lambda size: F.floor(size * (1 - threshold) + 1e-9).cast("int")
    size = F.length("n")
    cut = lambda i: F.floor(i * size / (edits(size) + 1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), edits(size)), lambda i: F.struct(size.alias("size"), cut(i).alias("place"), F.substring("n", cut(i) + 1, cut(i + 1) - cut(i)).alias("part")))
    longer = distinct.select(*keys, F.col("n").alias("long"), F.inline(parts))
    # every substring of the other name that may be such a part, for each longer length that is possible
    sizes = F.sequence(size, F.floor(size / F.lit(threshold) + 1e-9).cast("int"))
    wanted = distinct.select(*keys, "n", F.explode(sizes).alias("size")).withColumn("d", edits(F.col("size")))
    wanted = wanted.select(*keys, "n", "size", "d", F.explode(F.sequence(F.lit(0), F.col("d"))).alias("i"))
    at = F.floor(F.col("i") * F.col("size") / (F.col("d") + 1)).cast("int")
    width = F.floor((F.col("i") + 1) * F.col("size") / (F.col("d") + 1)).cast("int") - at
    drop = size - F.col("size")  # how much shorter the other name is
    wanted = wanted.withColumns({"lo": F.greatest(-F.col("i"), drop - F.col("d") + F.col("i")), "hi": F.least(F.col("i"), drop + F.col("d") - F.col("i"))}).where("lo <= hi")
    shifts = F.transform(F.sequence(F.col("lo"), F.col("hi")), lambda s: F.struct(F.col("size").alias("size"), at.alias("place"), F.when(at + s >= 0, F.substring("n", at + s + 1, width)).alias("part")))
    shorter = wanted.select(*keys, "n", F.inline(shifts)).where(F.length("part") > 0).distinct()
    met = longer.join(shorter, [*keys, "size", "place", "part"]).where("long <> n").select(*keys, F.least("long", "n").alias("a"), F.greatest("long", "n").alias("b")).distinct()
    return met


def related_names(asked: DataFrame, stock: DataFrame, name: str, threshold: float, metric: str = "blocks") -> DataFrame:
    """``(name, other, score)``: every different name of ``asked`` with those of ``stock`` that are ``threshold`` alike to it, itself included.

    Names of one table are not compared with each other.
    """
    one = lambda rows, s: rows.select(F.col(name).alias("name"), F.lit(s).alias("side")).where(F.length("name") > 0).distinct()
    tagged = materialise(one(asked, 1).unionByName(one(stock, 2)).groupBy("name").agg(F.sum("side").cast("int").alias("side")), "sided-names")
    if metric == "blocks":
        near = materialise(similar_names(tagged, "name", threshold, metric=metric, side="side"), "related-names")
        back = "back"
    else:
        near, back = similar_names(tagged, "name", threshold, metric=metric), "score"
    both = near.select(F.col("a").alias("name"), F.col("b").alias("other"), "score").unionByName(near.select(F.col("b").alias("name"), F.col("a").alias("other"), F.col(back).alias("score")))
    both = both.where(F.col("score") >= threshold).unionByName(tagged.where("side = 3").select("name", F.col("name").alias("other"), F.lit(1.0).alias("score")))
    end = lambda n, s: tagged.where(F.col("side").bitwiseAND(F.lit(s)) > 0).select(F.col("name").alias(n))
    return both.join(end("name", 1), "name", "left_semi").join(end("other", 2), "other", "left_semi").select("name", "other", "score")


def ratio_of(metric: str, rows: DataFrame):
    """How alike two columns are, by a metric's name."""
    if metric == "edits":
        return similarity
    ship(rows.sparkSession)
    return matching_ratio


def similar_rows(rows: DataFrame, id_col: str, name: str, threshold: float, metric: str = "edits") -> DataFrame:
    """Edges ``(src, dst)`` between the smallest ids of equal names and of similar names: enough for components.

    The matching-blocks ratio is that of the row with the smaller id with the other, so two names are linked if such a pair of rows reaches the threshold.
    """
    same = star_edges(rows.where(F.length(name) > 0), id_col, F.col(name))
    ends = rows.groupBy(name).agg(F.min(id_col).alias("id"), F.max(id_col).alias("last"))
    side = lambda n, i, z: ends.select(F.col(name).alias(n), F.col("id").alias(i), F.col("last").alias(z))
    met = _close_names(rows, name, threshold, ()) if metric == "blocks" else similar_names(rows, name, threshold, metric=metric)
    pairs = met.join(side("a", "src", "_last_a"), "a").join(side("b", "dst", "_last_b"), "b")
    if metric == "blocks":  # a ratio is computed only in the order that some two rows have, the second only if the first does not do
        pairs = pairs.withColumn("score", matching_ratio(F.when(F.col("src") < F.col("_last_b"), F.col("a")), F.col("b")))
        linked = F.coalesce(F.col("score") >= threshold, F.lit(False))
        pairs = pairs.withColumn("back", matching_ratio(F.when((F.col("dst") < F.col("_last_a")) & ~linked, F.col("b")), F.col("a")))
        pairs = pairs.where(linked | (F.col("back") >= threshold))
    return same.unionByName(pairs.select("src", "dst"))


def groups(edges: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Each id with the smallest id of its duplicate group; a single one is its own group."""
    found = connected_components(edges)
    return ids.join(found.withColumnRenamed("id", id_col), id_col, "left").withColumn("component", F.coalesce("component", id_col))


def link_score(number: Column, name_similarity: Column, customer: Column, date: Column, least: float = 0.55) -> Column:
    """A shared number weighs 0.45, a similar name 0.55 times its similarity, an equal customer 0.20, near dates 0.05; at most 1."""
    name = F.when(name_similarity >= least, 0.55 * name_similarity).otherwise(0.0)
    weigh = lambda flag, w: F.when(flag, F.lit(w)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), weigh(number, 0.45) + name + weigh(customer, 0.20) + weigh(date, 0.05))


def match_records(records: DataFrame, threshold: float = 0.68, days: int = 90, metric: str = "blocks") -> DataFrame:
    """Pairs ``(a, b, score)``, ``a < b``, of records (id, name, customer, numbers, day) that score ``threshold`` or more.

    At the default weights and threshold a pair needs a shared number, or an equal customer and names at least 0.78 alike, or names at
    least 0.92 alike with a contained customer (0.12 instead of 0.20) and near dates; each is a block with an equi-join, so nothing is lost.
    The blocks have no pair in common: a pair that shares a number is made at the smallest it shares, and only there. Within a number, names
    that are not alike need an equal customer too, unless the threshold is very low. Names are compared once for each two different ones,
    never for each pair of records.

    Names are compared by ``metric`` (see ``similar_names``), the record with the smaller id first; blank names are alike to nothing. A lower threshold than 0.61 would need other blocks and is refused.
    """
    if threshold < 0.61:
        raise ValueError("below 0.61 the blocks no longer hold every match")
    slack = 1e-6
    records = records.select("id", "name", "customer", F.array_distinct("numbers").alias("numbers"), "day")
    # only records with several numbers can share more than one
    brief = [F.col("id"), F.col("name"), F.col("customer"), F.col("day"), F.when(F.size("numbers") > 1, F.col("numbers")).alias("more")]
    side = lambda rows, s, keys: rows.select(*keys, *[F.col(c).alias(f"{s}_{c}") for c in rows.columns if c not in keys])

    def scored(pairs: DataFrame, shared: bool) -> DataFrame:
        """Pairs of rows l and r, ``forth`` and ``back`` their names' likeness in either order."""
        forward = F.col("l_id") < F.col("r_id")
        sim = F.when(forward, F.col("forth")).otherwise(F.col("back"))
        customer = F.when(F.col("l_customer") == F.col("r_customer"), 0.20).when(F.contains("l_customer", F.col("r_customer")) | F.contains("r_customer", F.col("l_customer")), 0.12).otherwise(0.0)
        near = F.coalesce(F.abs(F.date_diff("l_day", "r_day")) <= days, F.lit(False))
        score = F.least(F.lit(1.0), link_score(F.lit(shared), sim, F.lit(False), near) + customer)
        return pairs.select(F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b"), score.alias("score"), *[c for c in ("l_name", "r_name") if c in pairs.columns]).where(F.col("score") >= threshold)

    once = (F.col("l_name") < F.col("r_name")) | (F.col("l_id") < F.col("r_id"))  # either two names, in order, or two records of one
    # records with a number in common
    numbered = records.select(F.explode("numbers").alias("k"), *brief)
    named = records.where(F.length("name") > 0)
    together = numbered.where(F.length("name") > 0).select("k", "name").distinct()
    met = together.withColumnRenamed("name", "l_name").join(together.withColumnRenamed("name", "r_name"), "k").where("l_name < r_name").select("l_name", "r_name").distinct()
    if metric == "blocks":
        ship(records.sparkSession)
        alike = met.select("l_name", "r_name", matching_ratio("l_name", "r_name").alias("forth"), matching_ratio("r_name", "l_name").alias("back"))
    else:
        alike = met.select("l_name", "r_name", similarity(F.col("l_name"), F.col("r_name")).alias("forth")).withColumn("back", F.col("forth"))
    same = named.select(F.col("name").alias("l_name"), F.col("name").alias("r_name"), F.lit(1.0).alias("forth"), F.lit(1.0).alias("back")).distinct()
    alike = materialise(alike.where(F.greatest("forth", "back") >= 0.55).unionByName(same), "alike-names")
    first = F.col("l_more").isNull() | F.col("r_more").isNull() | (F.array_min(F.array_intersect("l_more", "r_more")) == F.col("k"))
    one, two = side(numbered, "l", ["k"]), side(numbered, "r", ["k"])
    by_name = scored(one.join(alike, "l_name").join(two, ["k", "r_name"]).where(once & first), True).select("a", "b", "score")
    keys = ["k", "customer"] if threshold > 0.45 + 0.12 + 0.05 + slack else ["k"]
    plain = side(numbered, "l", keys).join(side(numbered, "r", keys), keys).where("l_id < r_id").withColumns({"forth": F.lit(0.0), "back": F.lit(0.0)})
    if "customer" in keys:
        plain = plain.withColumns({"l_customer": F.col("customer"), "r_customer": F.col("customer")})
    known = alike.select("l_name", "r_name").unionByName(alike.where("l_name < r_name").select(F.col("r_name").alias("l_name"), F.col("l_name").alias("r_name")))
    plain = scored(plain.where(first), True).join(known, ["l_name", "r_name"], "left_anti").select("a", "b", "score")

    # records of one customer without one
    others = records.select(*brief, F.get("numbers", F.lit(0)).alias("number"))
    apart = F.when(F.col("l_more").isNull() & F.col("r_more").isNull(), ~F.coalesce(F.col("l_number") == F.col("r_number"), F.lit(False)))
    several = lambda s: F.coalesce(f"{s}_more", F.array(f"{s}_number"))
    apart = apart.otherwise(~F.coalesce(F.arrays_overlap(several("l"), several("r")), F.lit(False)))
    pairs = lambda df, *more: df.select(*more, F.col("a").alias("l_name"), F.col("b").alias("r_name"), F.col("score").alias("forth"), F.col("back" if metric == "blocks" else "score").alias("back"))
    equal = named.where("customer IS NOT NULL").select("customer", F.col("name").alias("l_name"), F.col("name").alias("r_name"), F.lit(1.0).alias("forth"), F.lit(1.0).alias("back")).distinct()
    inside = materialise(pairs(similar_names(records, "name", (threshold - 0.25) / 0.55 - slack, ["customer"], metric), "customer").unionByName(equal), "names-of-customers")
    one, two = side(others, "l", ["customer"]), side(others, "r", ["customer"])
    joined = one.join(inside, ["customer", "l_name"]).join(two, ["customer", "r_name"]).where(once & apart)
    by_customer = scored(joined.withColumns({"l_customer": F.col("customer"), "r_customer": F.col("customer")}), False).select("a", "b", "score")

    # records of customers of which one holds the other's name
    owners = materialise(records.where("customer IS NOT NULL").select("customer").distinct(), "customers")
    holds = contained(owners.select(F.col("customer").alias("l_customer")), "l_customer", "l_customer", owners.select(F.col("customer").alias("r_customer")), "r_customer", "r_customer", 1)
    blank = owners.where("customer <> ''").crossJoin(owners.where("customer = ''").withColumnRenamed("customer", "r_customer")).withColumnRenamed("customer", "l_customer")
    holds = holds.where("l_customer <> r_customer").unionByName(blank)
    holds = materialise(holds.unionByName(holds.select(F.col("r_customer").alias("l_customer"), F.col("l_customer").alias("r_customer"))), "related-customers")
    near_names = materialise(pairs(similar_names(records, "name", (threshold - 0.17) / 0.55 - slack, (), metric)).unionByName(same), "near-names")
    one, two = side(others, "l", []), side(others, "r", [])
    keys = ["r_name", "r_customer"]
    if threshold > 0.12 + 0.55 + slack:  # only near days reach it, so records meet in spans of days or in neighbouring ones
        span = lambda day: F.floor(F.unix_date(day) / (days + 1))
        one = one.withColumn("span", F.explode(F.array(*[span("l_day") + i for i in (-1, 0, 1)])))
        two, keys = two.withColumn("span", span("r_day")), [*keys, "span"]
    joined = one.join(holds, "l_customer").join(near_names, "l_name").join(two, keys).where(once & apart)
    by_owner = scored(joined, False).select("a", "b", "score")
    return by_name.unionByName(plain).unionByName(by_customer).unionByName(by_owner)


def top_k(rows: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= k)


def contained(texts: DataFrame, id_col: str, text: str, contexts: DataFrame, context_id: str, context: str, least: int = 12, probes: int = 4) -> DataFrame:
    """Pairs in which a context's text (``least`` characters or more) occurs in a text.

    Contexts of 12 characters or more are found by grams of 12 bytes, shorter ones by grams of 4, and those below 4 by single bytes.
    """
    size, out = F.length(context), None
    for low, high in ((12, None), (4, 12), (1, 4)):
        if high is None or least < high:
            some = contexts.where(size >= max(low, least))
            some = some if high is None else some.where(size < high)
            if high is None or some.limit(1).count():
                found = _contained(texts, id_col, text, some, context_id, context, low, probes)
                out = found if out is None else out.unionByName(found)
    return out


def _contained(texts: DataFrame, id_col: str, text: str, contexts: DataFrame, context_id: str, context: str, size: int, probes: int) -> DataFrame:
    """Pairs in which a context's text, of ``size`` bytes or more, occurs in a text.

    Each context offers ``probes`` grams of its bytes, drawn by hash from all of it. One pass over the texts finds where such grams occur (a
    bitmap of fixed size drops the others inside the task) and counts them. A context is looked up by its rarest gram alone, and not at
    all if one of its grams occurs nowhere; so contexts with one opening, and openings that many texts share, make no crowd. Every hit is
    compared in full.
    """
    spark = texts.sparkSession
    ship(spark)
    long = contexts.select(F.col(context_id), F.col(context).cast("string").alias("_context"))

    def offer(batches):
        for batch in batches:
            hashes, owner = gram_hashes(batch.column(1), size)
            order = np.lexsort((hashes, owner))
            hashes, owner = hashes[order], owner[order]
            fresh = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))[: len(hashes)]
            hashes, owner = hashes[fresh], owner[fresh]
            first = np.searchsorted(owner, owner)
            few = np.arange(len(owner)) - first < probes
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[few])), pa.array(hashes[few].view(np.int64))], [context_id, "_gram"])

    kind = dict(contexts.dtypes)[context_id]
    offered = materialise(long.select(context_id, "_context").mapInArrow(offer, f"`{context_id}` {kind}, _gram long"), "context-grams")
    shared = spark.sparkContext.broadcast(bitmap(offered, "_gram"))

    def find(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                hashes, owner = gram_hashes(part.column(1), size)
                hit = on_map(shared.value, hashes)
                both = np.unique(np.stack((owner[hit], hashes[hit].view(np.int64))), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(both[0])), pa.array(both[1])], [id_col, "_gram"])

    hits = texts.select(id_col, F.col(text).cast("string").alias("_text")).mapInArrow(find, f"`{id_col}` {dict(texts.dtypes)[id_col]}, _gram long")
    hits = materialise(hits.join(offered.select("_gram").distinct(), "_gram", "left_semi"), "gram-hits")
    counts = hits.groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = offered.join(counts, "_gram", "left").groupBy(context_id).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("m")).where("m.n > 0")
    met = hits.join(rarest.select(context_id, F.col("m._gram").alias("_gram")), "_gram").select(id_col, context_id)
    both = met.join(long, context_id).join(texts.select(id_col, F.col(text).alias("_text")), id_col)
    return both.where(F.contains("_text", F.col("_context"))).select(id_col, context_id).distinct()


def existing_matches(texts: DataFrame, id_col: str, text: str, contexts: DataFrame, context_id: str, context: str, least: int = 12) -> DataFrame:
    """Pairs of a text and a context that are equal, whatever their length, or of which one with ``least`` characters or more occurs in the other.

    Blank ones match nothing. Only texts no longer than the longest context are looked for in contexts.
    """
    left, right = texts.select(id_col, F.col(text).alias("_left")), contexts.select(context_id, F.col(context).alias("_right"))
    inside = contained(left, id_col, "_left", right, context_id, "_right", least)
    longest = right.agg(F.max(F.length("_right"))).scalar()
    around = contained(right, context_id, "_right", left.where(F.length("_left") <= longest), id_col, "_left", least).select(id_col, context_id)
    # longer equal texts contain each other
    short = lambda df, c: df.where((F.length(c) < least) & (F.length(F.trim(c)) > 0))
    same = short(left, "_left").join(short(right, "_right"), F.col("_left") == F.col("_right")).select(id_col, context_id)
    return inside.unionByName(around).unionByName(same).distinct()


def keyword_matches(text: Column, words: Sequence[str], mode: str = "any") -> Column:
    """Whether a text holds any, or all, of the words."""
    hits = [F.contains(F.lower(text), F.lit(w.lower())) for w in words]
    out = hits[0]
    for h in hits[1:]:
        out = (out & h) if mode == "all" else (out | h)
    return out
