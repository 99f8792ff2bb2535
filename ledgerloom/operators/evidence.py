"""Which sections of a document serve as evidence, and whether recorded fields are borne out by them.

Arrays hold the sections of one document, or a bounded frame of them, never a group of documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def context_windows(sections: DataFrame, ahead: int = 12, tail: int = 3, budget: int = 4096) -> DataFrame:
    """Sections ``(doc_id, place, size, head, concrete, major)`` with ``related``, the places of their context, ascending.

    A section that is no head stands alone. A head looks at most ``ahead`` sections forward, up to a major heading, for the first concrete
    section; without one it stands alone. Otherwise sections up to the concrete one join while they fit the byte budget, the head's
    own bytes included; others are passed over. If the concrete one does not fit, only head and concrete section stay, or the head if
    even they are too large. Then up to ``tail`` more sections join, until a major heading or one that does not fit. Null flags count as false.
    """
    order = Window.partitionBy("doc_id").orderBy("place").rowsBetween(1, ahead + tail)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    step = F.struct(F.col("place").cast("long").alias("place"), F.col("size").cast("long").alias("size"), flag("concrete"), flag("major"))
    near = F.slice("_ahead", 1, ahead)
    rows = sections.withColumn("_ahead", F.collect_list(step).over(order))
    rows = rows.withColumn("_stop", F.array_min(F.transform(near, lambda x, i: F.when(x["major"], i))))
    rows = rows.withColumn("_goal", F.array_min(F.transform(near, lambda x, i: F.when(x["concrete"] & ~x["major"], i))))
    rows = rows.withColumn("_goal", F.when(F.coalesce(F.col("head"), F.lit(False)) & (F.col("_stop").isNull() | (F.col("_goal") < F.col("_stop"))), F.col("_goal")))
    own = F.struct(F.col("size").cast("long").alias("used"), F.array(F.col("place").cast("long")).alias("places"), F.lit(True).alias("open"))

    def pass_over(state: Column, x: Column) -> Column:
        fits = state["used"] + x["size"] <= budget
        return _joined(state, x, fits, fits)  # open: whether the last one, the concrete section, came in

    def until(state: Column, x: Column) -> Column:
        fits = state["open"] & ~x["major"] & (state["used"] + x["size"] <= budget)
        return _joined(state, x, fits, fits)

    rows = rows.withColumn("_way", F.aggregate(F.slice("_ahead", 1, F.col("_goal") + 1), own, pass_over))
    rows = rows.withColumn("_end", F.aggregate(F.slice("_ahead", F.col("_goal") + 2, F.lit(tail)), F.col("_way"), until))
    goal, place = F.get("_ahead", F.col("_goal")), F.col("place").cast("long")
    compact = F.when(F.col("size") + goal["size"] <= budget, F.array(place, goal["place"])).otherwise(F.array(place))
    related = F.when(F.col("_goal").isNull(), F.array(place)).when(F.col("_way")["open"], F.col("_end")["places"]).otherwise(compact)
    return rows.withColumn("related", related).drop("_ahead", "_stop", "_goal", "_way", "_end")


def _joined(state: Column, x: Column, fits: Column, is_open: Column) -> Column:
    used = F.when(fits, state["used"] + x["size"]).otherwise(state["used"])
    places = F.when(fits, F.array_append(state["places"], x["place"])).otherwise(state["places"])
    return F.struct(used.alias("used"), places.alias("places"), is_open.alias("open"))


def budgeted_sections(sections: Column, categories: Sequence[str], target: int = 18432, most: int = 24576) -> Column:
    """What fits of a document's sections ``array<struct<place, size, tabular, anchors, strong, weak>>``: ``struct<places, used, missing, rescued>``.

    The first section comes first if it fits. Then each category that no chosen section bears strongly takes the section that bears it
    best (strongly, then with most other open categories, then by rank) among those that fit. Then all sections by rank (tier, tables,
    anchors, place), passing over those that do not fit. A category that is still open though some section bears it strongly may use
    ``most`` bytes. ``missing`` has the categories that stayed open; ``rescued`` says whether the larger budget was used.
    """
    last = F.array_max(F.transform(sections, lambda x: x["place"]))

    def ranked(x: Column) -> Column:
        tier = F.when(x["tabular"] | (x["anchors"] > 0), 0).when((x["place"] == 0) | (x["place"] == last), 1).otherwise(2)
        return F.struct(tier.alias("tier"), (~x["tabular"]).alias("plain"), (-x["anchors"]).alias("anchors"), x["place"].cast("long").alias("place"), x["size"].cast("long").alias("size"), x["strong"].alias("strong"), x["weak"].alias("weak"))

    def take(state: Column, x: Column, fits: Column, rescue: Column | None = None) -> Column:
        fits = F.coalesce(fits, F.lit(False))
        return F.struct(
            F.when(fits, state["used"] + x["size"]).otherwise(state["used"]).alias("used"),
            F.when(fits, F.array_append(state["places"], x["place"])).otherwise(state["places"]).alias("places"),
            F.when(fits, F.array_union(state["covered"], x["strong"])).otherwise(state["covered"]).alias("covered"),
            (state["rescued"] | (fits if rescue is not None else F.lit(False))).alias("rescued"),
        )

    def reserve(order: Column, limit: int, rescue: bool):
        def one(state: Column, category: Column) -> Column:
            bears = lambda x: F.array_contains(x["strong"], category) | (F.lit(not rescue) & F.array_contains(x["weak"], category))
            open_now = F.filter(order, lambda x: bears(x) & ~F.array_contains(state["places"], x["place"]) & (state["used"] + x["size"] <= limit))
            more = lambda x: F.lit(0) if rescue else -F.size(F.array_except(x["strong"], state["covered"]))
            best = F.array_min(F.transform(open_now, lambda x: F.struct((~F.array_contains(x["strong"], category)).alias("weakly"), more(x).alias("more"), x.alias("section"))))
            needed = ~F.array_contains(state["covered"], category)
            # one evaluation of the search serves all fields of the new state
            return F.when(needed, F.get(F.transform(F.array(best), lambda b: take(state, b["section"], b.isNotNull(), F.lit(True) if rescue else None)), F.lit(0))).otherwise(state)

        return one

    wanted = F.array(*map(F.lit, categories))

    def choose(order: Column) -> Column:
        state = F.expr("named_struct('used', 0L, 'places', cast(array() as array<bigint>), 'covered', cast(array() as array<string>), 'rescued', false)")
        state = F.aggregate(F.filter(order, lambda x: x["place"] == 0), state, lambda s, x: take(s, x, s["used"] + x["size"] <= target))
        state = F.aggregate(wanted, state, reserve(order, target, False))
        state = F.aggregate(order, state, lambda s, x: take(s, x, ~F.array_contains(s["places"], x["place"]) & (s["used"] + x["size"] <= target)))
        state = F.aggregate(wanted, state, reserve(order, most, True))
        borne = F.flatten(F.transform(order, lambda x: x["strong"]))
        report = lambda s: F.struct(F.array_sort(s["places"]).alias("places"), s["used"].alias("used"), F.array_except(F.array_intersect(wanted, borne), s["covered"]).alias("missing"), s["rescued"].alias("rescued"))
        return F.get(F.transform(F.array(state), report), F.lit(0))

    # the ranked sections are bound to a variable, so that they are sorted once
    return F.get(F.transform(F.array(F.array_sort(F.transform(sections, lambda x: ranked(x)))), lambda o: choose(o)), F.lit(0))


def audit_fields(fields: DataFrame, sections: DataFrame, most: int = 16) -> DataFrame:
    """``(doc_id, field, issue)`` for recorded fields ``(doc_id, field, section, quote, value, label)`` against ``(doc_id, place, text)``.

    A field without a section, with one that does not exist, without a quote, or with a quote that is not in its section has that issue
    alone. Otherwise: the value is not in the quote; the label is not in the section; the section ends inside the quote's sentence; the value
    occurs in the section more than once. A document gives at most ``most`` issues, by field and then in this order.
    """
    known = sections.select("doc_id", F.col("place").alias("section"), "text", F.lit(True).alias("_known"))
    joined = fields.join(known, ["doc_id", "section"], "left")
    filled = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    within = lambda part, whole: F.coalesce(F.contains(F.col(whole), F.col(part)), F.lit(False))
    times = F.try_divide(F.length("text") - F.length(F.replace(F.col("text"), F.col("value"), F.lit(""))), F.length("value"))
    broken = (
        F.when(F.col("section").isNull(), "no reference").when(F.col("_known").isNull(), "no section").when(~filled("quote"), "no quote").when(~within("quote", "text"), "quote not in section")
    )
    found = F.array_compact(F.array(
        F.when(~filled("value") | ~within("value", "quote"), "value not in quote"),
        F.when(filled("label") & ~within("label", "text"), "no label"),
        F.when(F.endswith(F.col("text"), F.col("quote")) & ~F.rtrim(F.col("text")).rlike(r"[.!?]$"), "truncated"),
        F.when(filled("value") & (times > 1), "ambiguous"),
    ))
    issues = joined.select("doc_id", "field", F.posexplode(F.when(broken.isNotNull(), F.array(broken)).otherwise(found)).alias("_at", "issue"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("field", "_at"))
    return issues.withColumn("_place", place).where(F.col("_place") <= most).select("doc_id", "field", "issue")
