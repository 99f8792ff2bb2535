"""Spelling variants and phrase collocations against brute force and SQL."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import oracles, phrases, queries, spelling
from ledgerloom.session import Scratch
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
R = random.Random(17)


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_phrase_collocations"])
def test_same_rows_as_sql(spark, name):
    compare(spark, FOLDER, queries.queries()[name], oracles.oracle_sql()[name], connect(FOLDER))


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(rows, letters=5, least=3, slip=97, factor=2):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % slip == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= least}
    others = {w: [v for v in n if near(v, w)] for w in n}
    form = {}
    for w, vs in others.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= factor * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(others[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def variant_rows():
    """Chains of forms with doubling counts, ties, letters of two bytes, long runs, texts without words."""
    rows = [(i, t) for i, t in enumerate([None, "", " 12 ?! ", "abcd abcd abcd abcd", "x" * 4000 + " " + "x" * 3999, "x" * 4000 + " " + "x" * 3999, "x" * 4000 + " " + "x" * 3999])]
    words = {"garden": 40, "gardens": 19, "gardenss": 8, "gardensss": 3, "wörter": 12, "worter": 5, "wörtér": 3, "a×b÷cd": 6, "axb÷cd": 3, "tiesa": 9, "tiesb": 9, "tiesc": 4, "BANANA": 7, "banaana": 3, "bananan": 3, "éèêëà": 8, "éèêëa": 4}
    bag = [w for w, c in words.items() for _ in range(c)]
    R.shuffle(bag)
    rows += [(100 + i, " ".join(bag[i : i + 7])) for i in range(0, len(bag), 7)]
    return [*rows, (None, "garden Garden gardens"), (None, "garden Garden gardens")]


@pytest.mark.parametrize("often", [1, 64])
def test_variants(spark, often):
    rows = variant_rows()
    docs = spark.createDataFrame([(*r, "k", 1, "w") for r in rows], "doc_id long, text string, place string, n int, word string")
    got = [tuple(r) for r in spelling.spelling_variants(docs, often=often).select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert sorted(got) == brute_variants(rows)
    assert {r[0]: r[5] for r in got}["gardensss"] == "garden"
    assert spelling.spelling_variants(docs.where("false")).count() == 0


@pytest.mark.parametrize("often", [0, 2, 64])
@pytest.mark.parametrize("alphabet", ["ab", "abcdefghé"])
def test_no_near_pair_is_lost(spark, often, alphabet):
    r = random.Random(len(alphabet))
    words = {"".join(r.choice(alphabet) for _ in range(r.randrange(5, 14))) for _ in range(300)}
    for w in sorted(words)[:150]:  # and neighbours of every kind
        i = r.randrange(len(w))
        words |= {w[:i] + r.choice(alphabet) + w[i + 1 :], w[:i] + r.choice(alphabet) + w[i:], w + r.choice(alphabet), *([w[:i] + w[i + 1 :]] if len(w) > 5 else [])}
    table = spark.createDataFrame([(w,) for w in words], "word string")
    got = {frozenset(p) for p in spelling.near_pairs(table, Scratch(spark), often=often).collect()}
    names = sorted(words)
    assert got == {frozenset((a, b)) for i, a in enumerate(names) for b in names[:i] if near(a, b)}


def brute_phrases(rows, min_count=10, longest=3, contained=50, top=2000):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        around = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    around[p[i : i + k]] = max(around[p[i : i + k]], a)
        kept = []
        for p, a in candidates.items():
            if p in around and 100 * around[p] >= contained * a:
                continue
            score, _, left, right = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def phrase_rows(n=400):
    common, rare = ["the", "of", "and", "to"], [f"w{i}" for i in range(60)] + ["Éa", "él", "\0", "日本"]
    fixed = ["new york city", "ad hoc", "in vitro study of", "w1 w2 w3 w4"]
    rows = []
    for i in range(n):
        words = [R.choice(common) if R.random() < 0.5 else R.choice(rare) for _ in range(R.randrange(12))]
        for _ in range(R.randrange(3)):
            words.insert(R.randrange(len(words) + 1), R.choice(fixed))
        text = "".join(w + R.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!"]) for w in words)
        rows.append((text.upper() if i % 9 == 0 else text, ["en", "fr", None, "und", ""][i % 5]))
    return [*rows, (None, "en"), ("", None), (" .,; ", "de"), ("the the " * 3000, "en"), *[("once more with feeling", "fr")] * 12, ("rare words only here", "x")]


@pytest.mark.parametrize(("min_count", "longest", "share", "bits", "top"), [(10, 3, 4, 26, 2000), (10, 3, 1000, 26, 7), (5, 4, 40, 26, 50), (10, 3, 4, 6, 2000), (3, 2, 3, 20, 2000)])
def test_phrases(spark, min_count, longest, share, bits, top):
    """Also with samples that propose next to nothing, so that the border fails, and with filters that are full."""
    rows = phrase_rows()
    docs = spark.createDataFrame([(i, *r, 1, "k") for i, r in enumerate(rows)], "doc_id long, text string, lang string, n int, phrase string").repartition(3)
    got = phrases.collocations(docs, min_count, longest, top=top, share=share, filter_bits=bits).collect()
    assert sorted(map(tuple, got)) == brute_phrases(rows, min_count, longest, top=top)


def test_phrases_edges(spark):
    docs = spark.createDataFrame([(None, None)], "text string, lang string")
    assert phrases.collocations(docs).count() == phrases.collocations(docs.where("false")).count() == 0


def test_failures_of_the_border_are_found(spark):
    table = spark.createDataFrame([("en", 1, "a"), ("en", 2, "a b"), ("fr", 2, "a b"), ("fr", 1, "é"), ("en", 3, "a b c")], "lang string, words int, phrase string")
    known = phrases._Filter(2, 20).with_phrases(table.where("lang = 'en' AND words < 3"))
    assert sorted(map(tuple, phrases._missing(table, known, 3, []).collect())) == [("fr", 1, "é"), ("fr", 2, "a b")]
    assert sum(int(np.bitwise_count(x).sum()) for x in known.sets) == 4


def test_scores_pass_64_bits(spark):
    a = spark.range(1).select(F.lit(4_000_000_000_000).cast("decimal(15,0)").alias("a"))
    assert a.select(F.expr("(1000000bd * a * a) div (a * a)")).first()[0] == 1_000_000
