"""Spelling variants by an index of grams of variable length.

1. **Words** are runs of Latin letters, lower-cased in ASCII; a planted slip, decided by a checksum of document and run, deletes a letter
   now and then. Words with enough code points and occurrences are kept with their counts.
2. **Gram dictionary.** Grams of three letters and more are counted over the distinct words (written ``^word$``), length by length. A gram that
   occurs more than ``often`` times is pruned as a key and goes into the dictionary of frequent grams; only such grams are counted one
   letter longer. The gram at each place of a word is the shortest that is not frequent, up to a limit, so it depends on its own letters only.
3. **Affected grams.** One edit can only spoil the grams whose span contains it. The most grams over any one place of a word is its bound
   ``b``: two near words share all but ``b`` of the grams of each. Hence, with grams ordered by rarity, the first ``b + 1`` of one and of the
   other share a gram, and it stands as far from the beginning or as far from the end in both. Only those lists are merged, by an
   equi-join on a hash of gram and distance.
4. **Verify.** A merged pair counts if its edit distance is exactly one.

Words of ``m`` and ``m`` or ``m + 1`` letters are compared in class ``m``, whose grams have at most ``m - 1`` letters (``_LONGEST`` at most). So every
word has more grams than one edit can spoil, no word needs another way, and a list of grams that stay frequent at the limit holds words
that differ in few letters, so the alphabet bounds it.

A word's form is its most frequent near word if it is frequent enough; roots follow forms by pointer doubling, which ends because
counts at least double along forms.

**Edge cases.** A null text has no words; a null doc_id counts as empty in the checksum. Rows that repeat count each time. Runs of any length are
words. Where several near words are equally frequent the smallest in code-point order is the form. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import Scratch

_SHORTEST, _LONGEST = 3, 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, letters: int = 5, least: int = 3, slip: int = 97) -> DataFrame:
    """``(word, n)`` of the words of at least ``letters`` code points that occur ``least`` times."""
    # a slip only shortens a run, so shorter runs are no words
    runs = F.regexp_extract_all(F.translate(F.col("text").cast("string"), _UPPER, _LOWER), F.lit(f"[a-zÀ-ÿ]{{{letters},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    check = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    at = F.pmod(check, F.length("run")).cast("int")
    slipped = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = found.select(F.when(F.pmod(check, F.lit(slip)) == 0, slipped).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _gram(size: int) -> Column:
    """The gram of a place of ``^word$``; shorter at the end."""
    return F.substring(F.concat(F.lit("^"), "word", F.lit("$")), F.col("place"), F.lit(size))


def _places(words: DataFrame) -> DataFrame:
    """``(word, place)`` for every place of ``^word$``, from 1, with a gram of the shortest length."""
    return words.select("word", F.explode(F.sequence(F.lit(1), F.length("word") + 3 - _SHORTEST)).alias("place"))


def gram_dictionary(words: DataFrame, often: int, scratch: Scratch) -> list[DataFrame]:
    """``(gram, uses)`` of the frequent grams of each length from the shortest to one below the longest.

    Each table has at most one row for ``often`` places; joins broadcast it if Spark finds it small and shuffle it otherwise.
    """
    out, open_ = [], _places(words)
    for size in range(_SHORTEST, _LONGEST):
        whole = open_.select("word", "place", _gram(size).alias("gram")).where(F.length("gram") == size)
        out.append(scratch.materialise(whole.groupBy("gram").agg(F.count("*").cast("int").alias("uses")).where(F.col("uses") > often), "frequent-grams"))
        open_ = whole.join(out[-1].select("gram"), "gram", "left_semi").select("word", "place")
    return out


def _spoiled(sizes: Column) -> Column:
    """The most grams over one place, for grams of these sizes at the places 1, 2, 3, ...; those over a place begin at most
    ``_LONGEST - 1`` places before it."""
    over = F.transform(sizes, lambda _, i: F.size(F.filter(F.sequence(F.greatest(F.lit(0), i - _LONGEST + 1), i), lambda j: j + F.get(sizes, j) > i)))
    return F.array_max(over)


def _lists(words: DataFrame, dictionary: list[DataFrame], letters: int) -> DataFrame:
    """``(class, word, place, gram)`` of the grams whose lists are merged: of each word in each of its classes the rarest, one more
    than an edit can spoil."""
    rows = _places(words)
    for size, frequent in enumerate(dictionary, _SHORTEST):
        known = frequent.select(F.col("gram").alias(f"gram{size}"), F.col("uses").alias(f"uses{size}"))
        rows = rows.withColumn(f"gram{size}", _gram(size)).join(known, f"gram{size}", "left").drop(f"gram{size}")
    # the shortest length at which the gram is not frequent
    free = F.lit(_LONGEST)
    for size in reversed(range(_SHORTEST, _LONGEST)):
        free = F.when(F.col(f"uses{size}").isNull(), F.lit(size)).otherwise(free)
    uses = F.array(*[F.col(f"uses{size}") for size in range(_SHORTEST, _LONGEST)])

    def in_class(m: Column) -> Column:
        size = F.least(free, F.lit(_LONGEST), m - 1, F.length("word") + 3 - F.col("place"))
        return F.struct(size.alias("size"), F.coalesce(F.get(uses, size - _SHORTEST), F.lit(0)).alias("uses"))

    rows = rows.select("word", F.struct("place", in_class(F.length("word")).alias("own"), in_class(F.length("word") - 1).alias("below")).alias("x"))
    rows = rows.groupBy("word").agg(F.array_sort(F.collect_list("x")).alias("x"))

    def pick(side: str) -> Column:
        return F.transform("x", lambda x: F.struct(x["place"].alias("place"), x[side]["size"].alias("size"), x[side]["uses"].alias("uses")))

    size = F.length("word")
    classes = F.filter(F.array(F.struct(size.alias("class"), pick("own").alias("x")), F.struct((size - 1).alias("class"), pick("below").alias("x"))), lambda c: c["class"] >= letters)
    rows = rows.select("word", F.explode(classes).alias("c")).select("word", "c.class", "c.x")
    marked = F.concat(F.lit("^"), "word", F.lit("$"))
    ordered = F.array_sort(F.transform("x", lambda x: F.struct(x["uses"].alias("uses"), F.substring(marked, x["place"], x["size"]).alias("gram"), x["place"].alias("place"))))
    rarest = F.slice(ordered, F.lit(1), _spoiled(F.transform("x", lambda x: x["size"])) + 1)
    return rows.select("class", "word", F.explode(rarest).alias("g")).select("class", "word", "g.place", "g.gram")


def near_pairs(words: DataFrame, scratch: Scratch, letters: int = 5, often: int = 64) -> DataFrame:
    """``(a, b)``: every two words that differ by one inserted, deleted or replaced code point, once; all words have ``letters`` or more."""
    lists = _lists(words, gram_dictionary(words, often, scratch), letters)
    size = F.length("word")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("place").alias("far")), F.struct(F.lit(1).alias("side"), (size - F.col("place")).alias("far")))).alias("s")
    lists = lists.select("class", "word", "gram", sides).select(F.xxhash64("class", "gram", "s.side", "s.far").alias("key"), "word", "s.side", (size - F.col("class")).alias("more"))
    lists = scratch.materialise(lists, "gram-lists")
    # words of one length need the distance from the beginning only
    left = lists.where("more = 0").select("key", F.col("word").alias("a"))
    right = lists.where("more = 1 OR side = 0").select("key", F.col("word").alias("b"), "more")
    return left.join(right, "key").where(((F.col("more") == 1) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)).select("a", "b").distinct()


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``(word, root)`` for ``(word, form)``: the end of each chain of forms, by pointer doubling."""
    current = scratch.materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        above = current.select(F.col("word").alias("root"), F.col("root").alias("above"))
        joined = current.join(above, "root", "left")
        if not joined.where("above IS NOT NULL").limit(1).count():
            return current
        current = scratch.materialise(joined.select("word", F.coalesce("above", "root").alias("root")), "roots")


def spelling_variants(docs: DataFrame, letters: int = 5, least: int = 3, slip: int = 97, often: int = 64, factor: int = 2) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)``, one row per word."""
    scratch = Scratch(docs.sparkSession)
    words = scratch.materialise(word_counts(docs, letters, least, slip), "words")
    pairs = scratch.materialise(near_pairs(words, scratch, letters, often), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    form = F.when(-F.col("best.less") >= factor * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")))
    full = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("f")).select("word", "n", "n_near", "f.form", "f.form_n")
    full = scratch.materialise(full, "forms")
    roots = _roots(full.where("form IS NOT NULL"), scratch)
    return full.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def oracle() -> str:
    """DuckDB SQL: the checksum bit by bit from its polynomial, near words through single deletions, roots by recursion."""
    return r"""
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
found AS (SELECT doc_id, run, count(*) AS times, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM runs WHERE len(run) >= 5 GROUP BY ALL),
bytes AS (SELECT run, times, list_transform(string_split(rtrim(regexp_replace(hex(encode(s)), '(..)', '\1 ', 'g')), ' '), lambda b: ('0x' || b)::BIGINT) AS b FROM found),
sums AS (SELECT run, times, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295), 4294967295) AS h FROM bytes, bits),
slips AS (SELECT CASE WHEN h % 97 = 0 THEN run[:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, times FROM sums),
words AS (SELECT word, sum(times)::BIGINT AS n FROM slips WHERE len(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
cut AS (SELECT word, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, len(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cut a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT near.word, count(*) AS n_near, min({'less': -o.n, 'form': o.word}) AS m FROM near JOIN words o ON o.word = other GROUP BY near.word),
forms AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -m.less >= 2 * n THEN m.form END AS form, CASE WHEN -m.less >= 2 * n THEN -m.less END AS form_n FROM words LEFT JOIN best USING (word)),
way AS (SELECT word, word AS at, form AS next FROM forms UNION ALL SELECT way.word, forms.word, forms.form FROM way JOIN forms ON forms.word = way.next)
SELECT forms.word, n, n_near, form, form_n, way.at AS root FROM forms JOIN way ON way.word = forms.word AND way.next IS NULL"""
