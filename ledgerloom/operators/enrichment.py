"""Related records as donors: a record without winner or amount takes them from the first result record that is about the same project.

Whether a text is about a project is a matter of features of the project's name and customer that the text contains (letters and digits
only, in lower case): the name's first 16 characters; two of its distinctive words, or the only one; the customer together with the
name's first 12 characters. So every way to be related is a *demand* of one or two features. Features are found in the texts by one
containment join, a demand of two starts from its rarer feature, and demands and texts keep only their first two partners, so nothing grows
with the product of records and donors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import blank_to_null, name_tokens, title_key
from ledgerloom.operators.linkage import contained
from ledgerloom.session import Scratch

_PREFIX, _SHORT, _OWNER = 16, 12, 6


def demands(name: Column, customer: Column, weak: Sequence[str] = ()) -> Column:
    """An array of ``struct<f, g>``: what a text must contain to be about this name; ``f`` equals ``g`` where one feature is enough."""
    key, owner = F.coalesce(title_key(name), F.lit("")), F.coalesce(title_key(customer), F.lit(""))
    both = lambda f, g: F.struct(F.least(f, g).alias("f"), F.greatest(f, g).alias("g"))
    words = F.coalesce(F.transform(name_tokens(name, weak), lambda w: title_key(w)), F.array().cast("array<string>"))

    def by_words(w: Column) -> Column:
        pairs = F.flatten(F.transform(w, lambda x, i: F.transform(F.slice(w, i + 2, F.size(w)), lambda y: both(x, y))))
        return F.when(F.size(w) == 1, F.transform(w, lambda x: both(x, x))).otherwise(pairs)

    prefix = F.when(F.length(key) >= _PREFIX, F.array(both(F.left(key, F.lit(_PREFIX)), F.left(key, F.lit(_PREFIX)))))
    short = F.left(key, F.lit(_SHORT))
    owned = F.when(F.length(owner) >= _OWNER, F.array(F.when(short == "", both(owner, owner)).otherwise(both(owner, short))))
    none = F.array().cast("array<struct<f:string,g:string>>")
    return F.array_distinct(F.concat(F.coalesce(prefix, none), F.get(F.transform(F.array(words), by_words), F.lit(0)), F.coalesce(owned, none)))


def _met(asked: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """``(f, g, key)`` for the distinct demands ``(f, g)`` that a text ``key`` meets."""
    features = scratch.materialise(asked.select(F.explode(F.array("f", "g")).alias("feature")).distinct(), "features")
    hits = scratch.materialise(contained(texts, "key", "key", features, "feature", "feature", 1), "feature-hits")
    uses = hits.groupBy("feature").agg(F.count("*").alias("n"))
    one = asked.where("f = g").join(hits.select(F.col("feature").alias("f"), "key"), "f").select("f", "g", "key")
    side = lambda c: uses.select(F.col("feature").alias(c), F.col("n").alias(f"n_{c}"))
    two = asked.where("f <> g").join(side("f"), "f").join(side("g"), "g")  # features without a hit are gone
    rarer = F.col("n_f") <= F.col("n_g")
    two = two.select("f", "g", F.when(rarer, F.col("f")).otherwise(F.col("g")).alias("rare"), F.when(rarer, F.col("g")).otherwise(F.col("f")).alias("other"))
    some = two.join(hits.select(F.col("feature").alias("rare"), "key"), "rare").select("f", "g", "other", "key")
    return one.unionByName(some.join(hits.select(F.col("feature").alias("other"), "key"), ["other", "key"]).select("f", "g", "key"))


def _first_two(rows: DataFrame, keys: Sequence[str], scratch: Scratch) -> DataFrame:
    """Of each key the two smallest ``ordinal``: one may be the record that asks."""
    rows = scratch.materialise(rows.select(*keys, "ordinal").distinct(), "partners")
    first = rows.groupBy(*keys).agg(F.min("ordinal").alias("_first"))
    second = rows.join(first, list(keys)).where("ordinal > _first").groupBy(*keys).agg(F.min("ordinal").alias("ordinal"))
    return first.withColumnRenamed("_first", "ordinal").unionByName(second)


def enrich_from_results(records: DataFrame, result_types: Sequence[str], weak: Sequence[str] = ()) -> DataFrame:
    """``(record_id, donor_id, winner, amount, method)`` for every record: blanks filled from its donor, the first by ordinal.

    Records have record_id, ordinal (unique), name, customer, text (the rest of what is known, in words), doc_type, winner, amount. A donor is another
    record of one of ``result_types`` with a winner or an amount, such that its name, customer and text are about the record, or the
    record's name is about the donor's (its customer aside). Records that miss nothing ask for no donor. ``method`` is ``local`` where a donor was found.
    """
    scratch = Scratch(records.sparkSession)
    blank = lambda c: blank_to_null(F.col(c).cast("string")).isNull()
    rows = records.select("record_id", "ordinal", "name", "customer", "doc_type", "winner", "amount", title_key(F.concat_ws(" ", "name", "customer", "text")).alias("whole"), title_key(F.col("name")).alias("own"))
    rows = scratch.materialise(rows, "records")
    asking = rows.where(blank("winner") | blank("amount"))
    donors = rows.where(F.col("doc_type").isin(*result_types) & ~(blank("winner") & blank("amount")))

    wanted = scratch.materialise(asking.select("record_id", F.explode(demands(F.col("name"), F.col("customer"), weak)).alias("d")).select("record_id", "d.*"), "demands")
    met = _met(wanted.select("f", "g").distinct(), donors.select(F.col("whole").alias("key")).where("key <> ''").distinct(), scratch)
    ahead = _first_two(met.join(donors.select(F.col("whole").alias("key"), "ordinal"), "key"), ["f", "g"], scratch)
    forward = wanted.join(ahead, ["f", "g"]).select("record_id", F.col("ordinal").alias("_donor"))

    offered = donors.select("ordinal", F.explode(demands(F.col("name"), F.lit(None).cast("string"), weak)).alias("d")).select("ordinal", "d.*")
    offered = scratch.materialise(_first_two(offered, ["f", "g"], scratch), "offers")
    back = _met(offered.select("f", "g").distinct(), asking.select(F.col("own").alias("key")).where("key <> ''").distinct(), scratch)
    named = _first_two(back.join(offered, ["f", "g"]), ["key"], scratch)
    backward = asking.select("record_id", F.col("own").alias("key")).join(named, "key").select("record_id", F.col("ordinal").alias("_donor"))

    found = forward.unionByName(backward).join(asking.select("record_id", "ordinal"), "record_id").where(F.col("_donor") != F.col("ordinal"))
    found = found.groupBy("record_id").agg(F.min("_donor").alias("_donor"))
    giver = donors.select(F.col("ordinal").alias("_donor"), F.col("record_id").alias("donor_id"), F.col("winner").alias("_winner"), F.col("amount").alias("_amount"))
    out = rows.join(found.join(giver, "_donor"), "record_id", "left")
    fill = lambda c: F.when(blank(c), F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c)
    return out.select("record_id", "donor_id", fill("winner"), fill("amount"), F.when(F.col("donor_id").isNotNull(), "local").alias("method"))
