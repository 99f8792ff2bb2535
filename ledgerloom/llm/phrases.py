"""Phrase collocations by sampling and negative borders (Toivonen's method), per language.

1. **Sample.** One document in ``share`` (by a hash of the row) proposes phrases: those that occur there ``min_count / share`` times less a
   margin. Only the proposals of each length below the longest are kept, as a filter of eight bits each, ``2 ** filter_bits`` bits at most, that is broadcast.
2. **Full pass.** Every word is counted, and every longer phrase whose two parts (without its last and without its first word) are
   proposed. That is the proposals together with their negative border, counted exactly in one pass. A filter has no false negatives, and a
   false positive only counts a phrase more; when the proposals outgrow the filter, it prunes less and the counts stay exact.
3. **Closing.** A frequent phrase that was not proposed is a failure of the border. Failures join the filter, and another full pass counts the
   phrases that only now can be frequent. This ends when a pass finds no failure, at the latest after as many passes as words in the longest phrase.
4. **Scores.** Every cut of a frequent phrase is scored by ``floor(1000000 a a / (l r))`` in decimals of 38 digits, and the lowest cut counts.
   Phrases inside a longer one of nearly the same frequency go. The best ``top`` of each language are numbered, first within salted parts.

Tasks count a slice of texts (a few megabytes, or one longer text) at a time, so what is exchanged are the slices' distinct phrases.

**Edge cases.** A null text is empty, a null lang is ``und`` (rows that say ``und`` are counted with them). Rows that repeat count each time.
Texts without words, and languages without a frequent phrase, give no rows; an empty table gives an empty result. Only ``text`` and ``lang``
are read; other columns, whatever their names, only matter to the choice of the sample if they are called doc_id.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.memory import release, task
from ledgerloom.llm.tokens import buffers
from ledgerloom.operators.components import label_rows
from ledgerloom.session import Scratch, ship

_SLICE_BYTES = 3 << 20
_SALTS = 64
_BREAK = np.isin(np.arange(256), list(b".,;:!?\n\v\f\r"))
_BLANK = np.isin(np.arange(256), list(b" \t"))


def _mix(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit number for each."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hash(lang: str, words) -> np.ndarray:
    seed = zlib.crc32(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _longer(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of its first words and that of its last word."""
    return _mix(hashes * np.uint64(0x9E3779B97F4A7C15) + word)


class _Filter:
    """Sets of phrases, one for each number of words, as bits at two places of a phrase's hash."""

    def __init__(self, levels: int, bits: int):
        self.bits, self.sets = bits, [np.zeros(1 << (bits - 6), np.uint64) for _ in range(levels)]

    def __getstate__(self):
        return self.bits, [zstandard.compress(x.tobytes(), 1) for x in self.sets]

    def __setstate__(self, state):
        self.bits, sets = state
        self.sets = [np.frombuffer(zstandard.decompress(x), np.uint64) for x in sets]

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << self.bits) - 1)
        return hashes & mask, (hashes >> np.uint64(32)) & mask

    def has(self, level: int, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for place in self.places(hashes):
            out &= (self.sets[level - 1][place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

    def with_phrases(self, phrases: DataFrame) -> _Filter:
        """This filter and ``(lang, words, phrase)`` too. The driver reads at most one row for each 64 bits."""
        own = self.places

        def run(batches):
            for _, level, hashes in _hashed(batches):
                for place in own(hashes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), level, np.int32)), pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))], ["level", "at", "bit"])

        found = phrases.select("lang", "words", "phrase").mapInArrow(task(run, rows=1 << 16), "level int, at long, bit long").groupBy("level", "at").agg(F.bit_or("bit").alias("bit")).toArrow()
        out = _Filter(len(self.sets), self.bits)
        out.sets = [x.copy() for x in self.sets]
        level, at, bit = (found[c].to_numpy() for c in ("level", "at", "bit"))
        for i, bits in enumerate(out.sets):
            mine = level == i + 1
            bits[at[mine]] |= bit[mine].view(np.uint64)
        return out


def _hashed(batches):
    """``(rows, number of words, hashes)`` for the rows ``(lang, words, phrase)`` of each batch, by language and number of words."""
    for batch in batches:
        table = pa.table(batch)
        for key in table.select(["lang", "words"]).group_by(["lang", "words"]).aggregate([]).to_pylist():
            rows = table.filter(pc.and_(pc.equal(table["lang"], key["lang"]), pc.equal(table["words"], key["words"])))
            parts = [p.split(" ") for p in rows["phrase"].to_pylist()]
            hashes = _word_hash(key["lang"], [p[0] for p in parts])
            for k in range(1, key["words"]):
                hashes = _longer(hashes, _word_hash(key["lang"], [p[k] for p in parts]))
            yield rows, key["words"], hashes


def _cut(texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """All words with A-Z lower-cased, how many each text has, and the number of each word's piece."""
    data, offsets = buffers(texts)
    data = data | ((data - np.uint8(65)) < 26).astype(np.uint8) << 5
    breaks = _BREAK[data]
    inside = ~(breaks | _BLANK[data])
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = np.zeros(len(data) + 1, np.int8)
    first[offsets] = 1
    first = first[:-1]
    begins |= inside & (first > 0)
    places = np.flatnonzero(begins)
    piece = np.cumsum(breaks + first, dtype=np.int32)[places] if len(data) else np.zeros(0, np.int32)
    letters = data[inside]
    edges = np.append(np.flatnonzero(begins[inside]), len(letters)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(edges), pa.py_buffer(letters)), np.diff(np.searchsorted(places, offsets)), piece


def _counted(texts: pa.LargeStringArray, langs: pa.Array, longest: int, old: _Filter | None, new: _Filter | None):
    """``(phrases, counts)`` of a slice, phrases as ``lang <tab> words``: those that ``new`` admits and ``old`` does not; without a
    filter every phrase is admitted, and the empty phrase counts all words of a language."""
    words, counts, piece = _cut(texts)
    if not len(words):
        return
    tongue = langs.dictionary_encode()
    names, lang = tongue.dictionary.to_pylist(), np.repeat(tongue.indices.to_numpy(), counts)
    if old is None:
        sums = np.bincount(lang, minlength=len(names))
        some = np.flatnonzero(sums)
        yield pa.array([names[i] + "\t" for i in some], pa.large_string()), sums[some]
    coded = words.dictionary_encode()
    # one number for each word of each language
    key, item = np.unique(lang.astype(np.int64) * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)
    item = item.astype(np.int32)
    spoken, letters = key // len(coded.dictionary), coded.dictionary.take(pa.array(key % len(coded.dictionary)))
    full = pc.binary_join_element_wise(pa.array(names, pa.large_string()).take(pa.array(spoken)), letters, pa.scalar("\t", pa.large_string()))
    hashes, tied = None, letters.to_pylist()
    if new is not None:
        hashes = np.empty(len(key), np.uint64)
        cuts = np.searchsorted(spoken, np.arange(len(names) + 1))
        for i, name in enumerate(names):
            hashes[cuts[i] : cuts[i + 1]] = _word_hash(name, tied[cuts[i] : cuts[i + 1]])
    del tied
    if old is None:
        yield full, np.bincount(item)
    size = len(key)
    # at every place: the number of the phrase of the present length that begins there, and whether each filter has it
    number, texts_of = item, full
    at = np.arange(len(item), dtype=np.int32)
    ok_new = np.ones(len(item), bool) if new is None else new.has(1, hashes)[item]
    ok_old = np.zeros(len(item), bool) if old is None else old.has(1, hashes)[item]
    present = hashes
    for k in range(2, longest + 1):
        # phrases begin at `at`; both parts must be there
        nearby = np.flatnonzero(np.diff(at) == 1)
        nearby = nearby[(piece[at[nearby]] == piece[at[nearby] + k - 1]) & ok_new[nearby] & ok_new[nearby + 1]]
        was = ok_old[nearby] & ok_old[nearby + 1]
        kinds, where, number, each = np.unique(number[nearby].astype(np.int64) * size + item[at[nearby] + k - 1], return_index=True, return_inverse=True, return_counts=True)
        number = number.astype(np.int32)
        if not len(kinds):
            return
        before = texts_of.take(pa.array(kinds // size))
        texts_of = pc.binary_join_element_wise(before, letters.take(pa.array(kinds % size)), pa.scalar(" ", pa.large_string()))
        fresh = ~was[where]
        if fresh.any():
            yield (texts_of, each) if fresh.all() else (texts_of.filter(pa.array(fresh)), each[fresh])
        at = at[nearby]
        if k < longest:
            if new is None:
                ok_new, ok_old = np.ones(len(at), bool), np.zeros(len(at), bool)
            else:
                present = _longer(present[kinds // size], hashes[kinds % size])
                ok_new = new.has(k, present)[number]
                ok_old = was & old.has(k, present)[number] if old is not None else np.zeros(len(at), bool)


def _count(docs: DataFrame, longest: int, old: _Filter | None, new: _Filter | None, least: int, held: list) -> DataFrame:
    """``(lang, words, phrase, n)`` of the phrases that occur at least ``least`` times; no words: all words of the language."""
    shared = docs.sparkSession.sparkContext.broadcast((old, new))
    held.append(shared)

    def run(batches):
        old, new = shared.value
        held, size = [], 0

        def counts():
            texts, langs = pa.concat_arrays([t for t, _ in held]), pa.concat_arrays([x for _, x in held])
            for phrases, n in _counted(texts, langs, longest, old, new):
                for begin in range(0, len(n), 1 << 15):
                    yield pa.RecordBatch.from_arrays([phrases.slice(begin, 1 << 15).cast(pa.string()), pa.array(n[begin : begin + (1 << 15)].astype(np.int64))], ["key", "n"])
            release()

        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            held.append((texts, batch.column("lang").cast(pa.string())))
            size += pc.sum(pc.binary_length(texts)).as_py() or 0
            if size >= _SLICE_BYTES:
                yield from counts()
                held, size = [], 0
        if held:
            yield from counts()

    found = docs.mapInArrow(task(run), "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    phrase = F.substring_index("key", "\t", -1)
    words = F.when(phrase == "", 0).otherwise(F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1)
    lang = F.substring(F.col("key"), F.lit(1), F.length("key") - F.length(phrase) - 1)
    return found.select(lang.alias("lang"), words.cast("int").alias("words"), phrase.alias("phrase"), "n")


def _missing(phrases: DataFrame, known: _Filter, longest: int, held: list) -> DataFrame:
    """The phrases shorter than the longest that the filter does not have: failures of the border."""
    shared = phrases.sparkSession.sparkContext.broadcast(known)
    held.append(shared)

    def run(batches):
        known = shared.value
        for rows, level, hashes in _hashed(batches):
            yield from rows.filter(pa.array(~known.has(level, hashes))).to_batches()

    return phrases.where(F.col("words").between(1, longest - 1)).select("lang", "words", "phrase").mapInArrow(task(run, rows=1 << 16), "lang string, words int, phrase string")


def frequent_phrases(docs: DataFrame, scratch: Scratch, min_count: int = 10, longest: int = 3, share: int = 4, filter_bits: int = 26) -> DataFrame:
    """``(lang, words, phrase, n)`` of every phrase of 1 to ``longest`` words that occurs ``min_count`` times, exactly; ``words`` 0 has all words."""
    ship(docs.sparkSession)
    key = [F.col("doc_id")] if "doc_id" in docs.columns else []
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(*key, "lang", "text").alias("chance"))
    sample = texts.where(F.pmod("chance", F.lit(share)) == 0).select("lang", "text")
    texts = texts.select("lang", "text")
    held: list = []  # broadcasts, dropped as soon as the table that needs them is written

    def written(table: DataFrame, name: str) -> DataFrame:
        out = scratch.materialise(table, name)
        while held:
            held.pop().destroy()
        return out

    proposed = written(_count(sample, longest - 1, None, None, max(1, int(0.8 * min_count / share)), held).where("words > 0").select("lang", "words", "phrase"), "proposed")
    # eight bits for each proposal, as far as the bound allows
    known = _Filter(longest - 1, min(filter_bits, max(16, (8 * proposed.count()).bit_length()))).with_phrases(proposed)
    found = fresh = written(_count(texts, longest, None, known, min_count, held), "phrases")
    while longest > 1:
        failed = written(_missing(fresh, known, longest, held), "border-failures")
        if not failed.limit(1).count():
            break
        wider = known.with_phrases(failed)
        fresh = written(_count(texts, longest, known, wider, min_count, held), "phrases")
        found, known = found.unionByName(fresh), wider
    return found


def _part(phrase: Column, begin: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), begin, length), " ")


def _with_count(rows: DataFrame, counts: DataFrame, part: str, name: str, scratch: Scratch) -> DataFrame:
    """The count of a part of each row; parts that many rows share are broadcast, and they are few."""
    uses = rows.groupBy("lang", part).agg(F.count("*").alias("uses"))
    classes = scratch.materialise(uses.join(counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part]), "parts")
    return label_rows(rows, classes, ["lang", part], "uses")


def collocations(docs: DataFrame, min_count: int = 10, longest: int = 3, contained: int = 50, top: int = 2000, share: int = 4, filter_bits: int = 26) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best ``top`` phrases of 2 to ``longest`` words of each language."""
    scratch = Scratch(docs.sparkSession)
    found = frequent_phrases(docs, scratch, min_count, longest, share, filter_bits)
    candidates = found.where("words >= 2").withColumnRenamed("n", "a")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = scratch.materialise(cuts.select("*", _part(F.col("phrase"), F.lit(1), F.col("k")).alias("first"), _part(F.col("phrase"), F.col("k") + 1, F.col("words") - F.col("k")).alias("rest")), "cuts")
    cuts = _with_count(_with_count(cuts, found, "first", "l", scratch), found, "rest", "r", scratch)
    whole = lambda c: F.col(c).cast("decimal(15,0)")  # noqa: E731  products of four stay within 38 digits
    score = F.expr("(1000000bd * a15 * a15) div (l15 * r15)")
    scored = cuts.withColumns({"a15": whole("a"), "l15": whole("l"), "r15": whole("r")}).withColumn("score", score)
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("m")).select("lang", "phrase", "m.*")
    spans = candidates.where("words >= 3").select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    spans = spans.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("begin"))
    around = spans.select("lang", _part(F.col("phrase"), F.col("begin"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = lowest.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < contained * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = found.where("words = 0").select("lang", F.col("n"))  # one row per language
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(min_count: int = 10, contained: int = 50, top: int = 2000) -> str:
    """DuckDB SQL for phrases of two and three words."""
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) v(k)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS n FROM g GROUP BY ALL),
total AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND n >= {min_count}),
cut AS (SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS first, array_to_string(ws[j + 1:k], ' ') AS rest FROM c, (VALUES (1), (2)) v(j) WHERE j < k),
scored AS (SELECT cut.lang, cut.phrase, a, j, x.n AS l, y.n AS r, (1000000::HUGEINT * a * a) // (x.n * y.n) AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first JOIN f y ON y.lang = cut.lang AND y.phrase = rest),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
around AS (SELECT lang, phrase, max(a) AS m FROM (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT low.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low LEFT JOIN around USING (lang, phrase) WHERE m IS NULL OR 100 * m < {contained} * a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, total.n::BIGINT AS n, score::BIGINT AS score FROM kept JOIN total USING (lang) WHERE rank <= {top}"""
