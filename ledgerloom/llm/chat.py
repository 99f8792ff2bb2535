"""Chat formatting by quotation linking: replies find their originals through the passages they quote.

1. A line's quote level is the number of leading ``>``. Neighbouring lines of one level form a passage; passages and single lines are
   normalised (marks dropped, lower case, white space collapsed) and hashed.
2. A quoted unit is joined to the latest earlier message of its conversation that wrote the same unit itself (level 0). That is an
   as-of lookup over one sorted union of both sides, so a line that many messages share gives no pairs.
3. A message replies to the original that its lowest quote level matches with most characters (then the latest). Following
   replies upwards by pointer doubling gives the thread (the first turn) and the depth.
4. Within a conversation messages are ordered by thread, then turn: every reply comes after its original, and threads are contiguous.
   Quotes and the attribution lines right before them are left out of the text, which is set in the chat template; ``quoted`` keeps
   them as they were, whether their originals were found or not.

Positions come from one sort by ranges of (conversation, thread, turn), which splits conversations and threads of any length, and from the
counts of its parts. DataFrame functions only.

**Edge cases.** A null text is empty; blank lines are no units. Messages that quote nothing known start their own thread. A null
conv_id forms no conversation: its rows are kept, unlinked, at position 0. A null turn comes first. Rows that repeat a turn share its links. A
null role is written ``unknown``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators.components import label_rows
from ledgerloom.session import materialise, tasks

# No pattern repeats a group, so very long runs of marks or blank lines need no stack.
_MARKS = r"^[ \t>]*>"
#: A line, at any level, that may introduce a quote; it does if the next line that is not blank is quoted.
_ATTRIBUTION = r"(?i)^[ \t>]*on\b.{1,200}\bwrote:[ \t]*$"
_PART_BITS = 33  # monotonically_increasing_id counts the rows of a part in so many bits


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", ""))


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n")


def _written(text: Column) -> Column:
    """The lines without attribution lines."""
    kind = lambda x: F.when(F.trim(F.translate(x, "\t", " ")) == "", "b").when(x.rlike(_MARKS), F.when(x.rlike(_ATTRIBUTION), "A").otherwise("q")).when(x.rlike(_ATTRIBUTION), "a").otherwise("t")
    # one letter for each line; an attribution line before blank lines and a quoted one becomes x
    kinds = lambda lines: F.regexp_extract_all(F.regexp_replace(F.array_join(F.transform(lines, kind), ""), "[aA](?=b*[qA])", "x"), F.lit("(.)"), F.lit(1))
    kept = lambda lines: F.transform(F.filter(F.arrays_zip(lines.alias("line"), kinds(lines).alias("kind")), lambda z: z["kind"] != "x"), lambda z: z["line"])
    # the lines are bound to a variable, so that they are split once
    marked = F.get(F.transform(F.array(_lines(text)), lambda lines: kept(lines)), F.lit(0))
    return F.when(F.contains(text, F.lit(">")), marked).otherwise(_lines(text))


def own_text(text: Column) -> Column:
    """The text without quoted lines and without the attribution lines before them."""
    kept = F.filter(_written(text), lambda x: _level(x) == 0)
    return F.regexp_replace(F.array_join(kept, "\n"), r"(?U)^\s+|\s+$", "")


def quoted_text(text: Column) -> Column:
    """The quoted lines as they stand in the text; null without any."""
    lines = F.filter(_lines(text), lambda x: _level(x) > 0)
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n"))


def _units(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, level, kind, hash, chars)`` of every passage and every line that is not blank."""
    lines = messages.select("row", "conv_id", "turn", F.posexplode(_written(F.col("text"))).alias("place", "line"))
    lines = lines.select("row", "conv_id", "turn", "place", _level(F.col("line")).alias("level"), _normal(F.regexp_replace("line", _MARKS, "")).alias("words")).where(F.col("words") != "")
    order = Window.partitionBy("row").orderBy("place")
    island = F.sum((F.coalesce(F.lag("level").over(order), F.lit(-1)) != F.col("level")).cast("int")).over(order)
    lines = lines.withColumn("island", island)
    passages = lines.groupBy("row", "conv_id", "turn", "level", "island").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "words"))), lambda x: x["words"]), " ").alias("words"), F.count("*").alias("n")).where("n > 1")
    both = lines.select("conv_id", "turn", "level", F.lit(0).alias("kind"), "words").unionByName(passages.select("conv_id", "turn", "level", F.lit(1).alias("kind"), "words"))
    return both.select("conv_id", "turn", "level", "kind", F.xxhash64("words").alias("hash"), F.length("words").alias("chars")).distinct()


def reply_links(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, reply_to)`` for the messages whose quotes are found; ``messages`` has row, conv_id, turn, text."""
    units = _units(messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()))
    quoted = units.where("level > 0")
    written = units.where("level = 0").join(quoted.select("conv_id", "kind", "hash").distinct(), ["conv_id", "kind", "hash"], "left_semi")
    meeting = quoted.select("conv_id", "kind", "hash", "turn", "level", "chars", F.lit(None).cast("long").alias("origin")).unionByName(written.select("conv_id", "kind", "hash", "turn", "level", "chars", F.col("turn").alias("origin")))
    earlier = Window.partitionBy("conv_id", "kind", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = meeting.withColumn("from", F.max("origin").over(earlier)).where("level > 0 AND `from` IS NOT NULL")
    weighed = found.groupBy("conv_id", "turn", "level", "from").agg(F.sum("chars").alias("chars"))
    return weighed.groupBy("conv_id", "turn").agg(F.max_by("from", F.struct(-F.col("level"), "chars", "from")).alias("reply_to"))


def _threads(links: DataFrame) -> DataFrame:
    """``(conv_id, turn, reply_to, thread, depth)``: the top of each chain of replies and its length."""
    current = materialise(links.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "threads")
    while current.where("thread IS NOT NULL").limit(1).count():
        above = current.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        joined = current.join(above, ["conv_id", "thread"], "left")
        if not joined.where("next IS NOT NULL").limit(1).count():
            break
        current = materialise(joined.select("conv_id", "turn", "reply_to", F.coalesce("next", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "threads")
    return current


def format_chats(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, reply_to, thread, depth, position, body, formatted, quoted)``, one row per message."""
    messages = materialise(conversations.select(F.monotonically_increasing_id().alias("row"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")), "messages")
    # only messages with a quote, and in their conversations, can take part in links
    quoting = messages.where(F.contains("text", F.lit(">"))).select("conv_id").distinct()
    linked = _threads(reply_links(messages.join(quoting, "conv_id", "left_semi")))
    full = messages.join(linked, ["conv_id", "turn"], "left").withColumns({"thread": F.coalesce("thread", "turn"), "depth": F.coalesce("depth", F.lit(0)), "body": own_text(F.col("text")), "quoted": quoted_text(F.col("text"))})
    order = ["conv_id", F.col("thread").asc_nulls_first(), F.col("turn").asc_nulls_first(), "row"]
    ranged = full.where("conv_id IS NOT NULL").drop("text").repartitionByRange(tasks(messages.sparkSession), *order).sortWithinPartitions(*order)
    ranged = materialise(ranged.withColumn("at", F.monotonically_increasing_id()), "chat-order")
    part, inside = F.shiftright("at", _PART_BITS).cast("int"), F.col("at").bitwiseAND(F.lit((1 << _PART_BITS) - 1))
    # one row for each part of the sort
    sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    counted = ranged.withColumn("part", part).join(F.broadcast(before), "part").withColumn("at", F.col("before") + inside)
    firsts = counted.groupBy("conv_id").agg(F.min("at").alias("first"), F.count("*").alias("members"))
    placed = label_rows(counted, firsts, ["conv_id"], "members")
    columns = ["conv_id", "turn", "role", "reply_to", "thread", "depth", "body", "quoted"]
    out = placed.select(*columns, (F.col("at") - F.col("first") + 1).alias("position")).unionByName(full.where("conv_id IS NULL").select(*columns, F.lit(0).cast("long").alias("position")))
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>\n"))
    return out.select("conv_id", "turn", "role", "reply_to", "thread", "depth", "position", "body", formatted.alias("formatted"), "quoted")


def chat_segments(chats: DataFrame, messages: int = 256) -> DataFrame:
    """``(conv_id, segment, text)``: conversations as template text, in segments of at most ``messages`` messages."""
    numbered = chats.where("conv_id IS NOT NULL").withColumn("segment", F.floor((F.col("position") - 1) / messages))
    return numbered.groupBy("conv_id", "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "formatted"))), lambda x: x["formatted"]), "").alias("text"))
