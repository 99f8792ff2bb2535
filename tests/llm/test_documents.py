"""Document operators against brute force, on a fixture with nulls, empties, copies, long texts and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ledgerloom.llm import langid, packing, pieces, simhash, suffix_dedup, token_store, tokens

R = random.Random(11)
SYLLABLES = ["the", "an", "ou", "er", "stion", "Ñe", "él", "üb", "ing", "and"]


def words(n, r=R):
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randrange(1, 4))) for _ in range(n)) + "."


SHARED = words(60)
TEXTS = [None, "", " \n ", "a", "It's, fine; isn't it?", "12 §§ 34", words(40), SHARED, words(30) + "\n" + SHARED + words(20), SHARED, words(3000), "abc" * 200, "x" * 350, "  two  spaces " + words(12), "<|endoftext|> in " + words(5), "日本語テキスト" * 30, words(200) + "\0" + words(9), "ΑΣ İ ẞ e\u0301 A\u030a " + words(4)]
TEXTS += [TEXTS[6], TEXTS[6] + " more", TEXTS[10][:9000] + "changed" + TEXTS[10][9000:]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, i, f"src{i}", "k") for i, t in enumerate(TEXTS)] + [(6, TEXTS[6], 1, None, "k"), (None, words(20), 0, "x", "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, `row` int, rest string, `key` string")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def nothing(docs):
    return docs.where("false")


def brute_fingerprint(text, width=3):
    from xxhash import xxh64_intdigest

    found = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    grams = [" ".join(found[i : i + width]) for i in range(max(1, len(found) - width + 1))]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(n, linked):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_simhash_groups(docs, rows):
    rows = [r for r in rows if r[0] is not None]
    prints = [brute_fingerprint(t) for _, t in rows]
    root = closure(len(rows), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    least = {g: min(rows[i][0] for i in range(len(rows)) if root[i] == g) for g in set(root)}
    want = sorted((rows[i][0], f"{prints[i]:016x}", least[root[i]]) for i in range(len(rows)))
    got = simhash.simhash_groups(docs).collect()
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == want
    assert len(got) == len(rows) + 1
    assert simhash.simhash_groups(nothing(docs)).count() == 0


@pytest.mark.parametrize("hot", [0, 4, 256])
@pytest.mark.parametrize("radius", [1, 2])
def test_simhash_links_have_the_components_of_all_pairs(spark, hot, radius):
    r = random.Random(2)
    centre = [r.getrandbits(64) for _ in range(12)]
    values = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randrange(5))) for c in centre for _ in range(25)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), radius, hot=hot).collect()
    at = {v: i for i, v in enumerate(signed)}
    near = lambda a, b: bin(values[a] ^ values[b]).count("1") <= radius
    pairs = {frozenset((at[x["src"]], at[x["dst"]])) for x in found}
    assert all(near(*p) for p in pairs)
    assert closure(len(values), lambda a, b: frozenset((a, b)) in pairs) == closure(len(values), near)


def brute_repeats(rows, n=100):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        body = (text or "").encode()
        cover = np.zeros(len(body) + 1, int)
        for i in range(len(body) - n + 1):
            part = body[i : i + n]
            if part in seen:
                cover[i] += 1
                cover[i + n] -= 1
            seen.add(part)
        gone = np.cumsum(cover)[:-1] > 0
        kept = bytes(np.frombuffer(body, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((doc, len(body), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1, 20_000])
def test_repeats(docs, rows, hot):
    from pyspark.sql import functions as F

    cut = suffix_dedup.cut_repeats(docs.select("doc_id", "text"), hot=hot)
    got = cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows)


def test_repeats_edges(spark, docs):
    assert suffix_dedup.repeats_table(nothing(docs)).count() == 0
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert [r["text"] for r in out.where("doc_id = 0").collect()] == [None]
    assert [r["text"] for r in out.where("doc_id = 27").collect()] == [""]  # a copy of an earlier text


@pytest.mark.parametrize("seed", range(4))
def test_interval_expansion_matches_sorting(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("ab") for _ in range(30)) for _ in range(4)]
    contents = ["".join(r.choice(base) for _ in range(8)).encode() for _ in range(9)]
    n = 24
    lengths = np.array([len(c) - n + 1 for c in contents])
    want, seen = [], set()
    for c in contents:
        for i in range(len(c) - n + 1):
            want.append(c[i : i + n] in seen)
            seen.add(c[i : i + n])
    assert suffix_dedup.repeated_starts(contents, lengths, n).tolist() == want


def encoded(text):
    return tokens.word_encoder(None).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_token_store_round_trip(spark, docs, rows):
    got = sorted(map(tuple, token_store.token_table(docs).collect()), key=lambda r: r[1])
    ids = [r[0] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:]) and len(ids) == len(rows)
    start = 0
    left = [(d, np.array([*encoded(t), 2], "<u4")) for d, t in rows]
    for doc, at, n, crc in got:
        assert at == start
        start += n
        match = next(i for i, (d, x) in enumerate(left) if d == doc and len(x) == n and zlib.crc32(x.tobytes()) == crc)
        left.pop(match)
    assert not left
    assert token_store.token_table(nothing(docs)).count() == 0


@pytest.mark.parametrize("begin", [0, 1, 5, 17])
def test_sliced_columns_encode_alike(begin):
    import pyarrow as pa

    texts = pa.array(TEXTS, pa.string()).slice(begin, 6)
    ids = [x for _, i, c in tokens.word_encoder(None).batches(texts) for x in np.split(i, np.cumsum(c)[:-1])]
    assert [x.tolist() for x in ids] == [encoded(t) for t in TEXTS[begin : begin + 6]]
    found = list(pieces.piece_codec(None).encode_column(texts))
    assert [x.tolist() for x in found] == [pieces.piece_codec(None).model.encode(t) if t else [] for t in TEXTS[begin : begin + 6]]


def test_ids_of_decomposed_letters_are_the_librarys():
    """Capitals before combining marks, which the tokenizer composes before it lower-cases."""
    import pyarrow as pa

    r, encoder = random.Random(8), tokens.word_encoder(None)
    parts = ["I", "A", "a", "i", "E", "s", " ", "1", ".", "'", "\u0338", "\u0307", "\u0300", "\u0301", "\u0345", "\u0591", "\u20d0", "é", "İ", "\u212a", "が", "\u0483", "ΐ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(9))) for _ in range(100_000)]
    want = [x.ids for x in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    for first, ids, counts in encoder.batches(pa.array(texts)):
        ends = np.cumsum(counts)
        for k, (a, b) in enumerate(zip(ends - counts, ends, strict=True)):
            assert ids[a:b].tolist() == want[first + k], ascii(texts[first + k])


def test_store_spreads_one_id_over_parts(spark):
    rows = [(7, f"text {i} " * 3) for i in range(400)] + [(1, "first"), (9, "last")]
    got = token_store.token_table(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(r["start"] for r in got)[1] == next(r["n_tokens"] for r in got if r["doc_id"] == 1)
    path = token_store.scratch_path(spark, "spread")
    token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path)
    assert spark.read.parquet(path).select("part").distinct().count() == 4
    assert sum(r["n_tokens"] for r in got) == max(r["start"] + r["n_tokens"] for r in got)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_token_blocks_round_trip(n):
    r = np.random.default_rng(n)
    ids = np.where(r.random(n) < 0.05, r.integers(0, 1 << 32, n), r.integers(300, 9000, n)).astype(np.uint32)
    body = token_store.encode_ids(ids)
    assert (token_store.decode_ids(body) == ids).all()
    assert (token_store.decode_ids(body, 1, 3) == ids[128:384]).all()
    assert n < 1000 or len(body) < 4 * n


def test_packing(docs, rows):
    got = packing.pack(docs, capacity=64).collect()
    want = []
    for d, t in rows:
        ids = np.array([*encoded(t), 1], "<u4")
        want += [(d, i, i * 64, len(ids[i * 64 : i * 64 + 64]), zlib.crc32(ids[i * 64 : i * 64 + 64].tobytes())) for i in range(-(-len(ids) // 64))]
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    # best-fit decreasing, one piece at a time
    rooms = []
    for length in sorted((w[3] for w in want), reverse=True):
        fit = min((x for x in rooms if x >= length), default=None)
        if fit is None:
            rooms.append(64 - length)
        else:
            rooms[rooms.index(fit)] -= length
    assert len(bins) == len(rooms)
    assert packing.pack(nothing(docs)).count() == 0


def test_best_fit_plan_is_that_of_single_steps():
    r = random.Random(1)
    for _ in range(30):
        counts = {r.randrange(1, 100): r.randrange(1, 40) for _ in range(12)}
        plan, total = packing.best_fit_decreasing(counts, 100)
        rooms = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fit = min((x for x in rooms if x >= length), default=None)
                if fit is None:
                    rooms.append(100 - length)
                else:
                    rooms[rooms.index(fit)] -= length
        assert total == len(rooms) and plan


def test_pieces_are_the_librarys(docs, rows):
    model = pieces.piece_codec(None).model
    got = {}
    for r in pieces.encode_pieces(docs).collect():
        got.setdefault(r["doc_id"], []).append(r["ids"])
    for d, t in rows:
        assert (model.encode(t) if t else []) in got[d]
    back = pieces.decode_pieces(pieces.encode_pieces(docs))
    assert sorted((r["doc_id"] or -1, r["text"]) for r in back.collect()) == sorted((d or -1, t or "") for d, t in rows)
    assert pieces.piece_table(nothing(docs)).count() == 0


def test_streaming_commits_do_not_change_the_path():
    codec = pieces.piece_codec(None)
    text = codec._normal(words(300).replace(" ", ""))
    assert codec.search(text) == codec.model.encode(text[1:])


def test_pieces_by_scores_reach_the_best_sum(tmp_path):
    import public_tokenizers
    import sentencepiece

    raw, out, at = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read(), b"", 0
    while at < len(raw):  # the same pieces as a model of the score kind
        begin = at
        tag, at = pieces._varint(raw, at)
        size, at = pieces._varint(raw, at)
        body = raw[at : at + size]
        if tag >> 3 == 2:
            assert b"\x18\x02" in body
            body = body.replace(b"\x18\x02", b"\x18\x01", 1)
        out += raw[begin:at] + body
        at += size
    (tmp_path / "m.model").write_bytes(out)
    model, codec = sentencepiece.SentencePieceProcessor(model_proto=out), pieces.PieceCodec(str(tmp_path / "m.model"))
    score = lambda ids: sum(model.get_score(i) for i in ids)

    def best(text):
        sums = [0.0]
        for at in range(1, len(text) + 1):
            sums.append(max(sums[a] + codec.pieces[text[a:at]][0] for a in range(at) if text[a:at] in codec.pieces))
        return sums[-1]

    assert codec.kind == 1
    for w in set(words(400).split()):
        found = codec.encode(w).tolist()
        assert codec.decode(found) == w
        assert score(found) == best("▁" + w) >= score(model.encode(w))  # the library adds in single precision


def test_language_id(spark):
    r = random.Random(4)
    alphabets = {"aa": ["ka", "lo", "mi", "nu"], "bb": ["tre", "ou", "que", "ée"], "cc": ["sch", "ung", "der", "ä"]}
    text = lambda s, n: " ".join("".join(r.choice(s) for _ in range(r.randrange(1, 4))) for _ in range(n))
    rows = [(i, text(alphabets[lang], r.randrange(3, 80)), lang, "s") for i, lang in enumerate(r.choice(list(alphabets)) for _ in range(400))]
    rows += [(900, None, "aa", "s"), (901, "", "bb", "s"), (902, "12 !?", "cc", "s"), (903, text(alphabets["aa"], 30_000), None, "s"), (None, text(alphabets["bb"], 9), "bb", "s"), (3, rows[3][1], rows[3][2], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    out = langid.language_table(docs)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(rows)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got if i is not None)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert got[None]["lang_pred"] == "bb" and not got[None]["held_out"]
    held = [i for i, _, _, _ in rows[:400] if got[i]["held_out"]]
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) > 0.97
    assert all(0 <= x["score"] <= 1 for x in got.values())
    full = langid.identify(docs, langid.fit(docs))
    assert full.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    bare = docs.select("doc_id", "text", docs["lang_pred"].alias("x")).selectExpr("*", "cast(null as string) lang")
    assert {r["lang_pred"] for r in langid.language_table(bare).collect()} == {"und"}
    assert langid.language_table(docs.where("false")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    r = random.Random(8)
    kinds = {"aa": ["ka", "lo", "mi", "nu"], "bb": ["tre", "ou", "que", "ée"]}
    text = lambda lang, n: " ".join("".join(r.choice(kinds[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))
    rows = [(i, text(lang, r.randrange(30, 120)), lang, "s", 0) for i, lang in enumerate(r.choice(list(kinds)) for _ in range(80))]
    copy, passage = rows[5][1], rows[7][1]
    rows += [(100, copy, "aa", "s", 0), (101, copy + " ", "aa", "s", 0), (102, text("aa", 50) + passage + text("aa", 50), "aa", "s", 0), (103, "12 34 !!", "aa", "s", 0), (104, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    one = P.language_id(spark, docs, "")
    assert {r["doc_id"] for r in one.collect()} == {r[0] for r in rows} - {103, 104}
    two = P.near_duplicates(spark, one, "")
    assert {r["doc_id"] for r in two.collect()} == {r[0] for r in rows} - {100, 101, 103, 104}
    three = P.repeated_passages(spark, two, "")
    cut = {r["doc_id"]: r for r in three.collect()}
    assert passage not in cut[102]["text"] and cut[7]["text"] == passage and cut[102]["n_chars"] == len(cut[102]["text"])
    assert one.columns == two.columns == three.columns == docs.columns
    final = P.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in final.collect()} == set(cut)
    assert [n for n, _ in P.STAGES] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]


def test_pipeline_decides_by_row_and_keeps_columns(spark):
    import corpus_pipeline as P

    r = random.Random(4)
    text = lambda: " ".join("".join(r.choice(["ka", "lo", "mi", "nu", "tre"]) for _ in range(r.randrange(1, 4))) for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a), (5, a), (5, b), (7, c), (7, d), (None, e), (None, e), (None, a), (9, e)]
    docs = spark.createDataFrame([(*x, "aa", 0.5, f"p{i}", i) for i, x in enumerate(rows)], "doc_id long, text string, lang string, score double, lang_pred string, _ int")
    kept = P.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((x["doc_id"], x["text"], x["score"]) for x in kept.collect()) == sorted([(1, a, 0.5), (5, b, 0.5), (7, c, 0.5), (7, d, 0.5), (9, e, 0.5)])
    one = P.language_id(spark, docs, "")
    assert one.columns == docs.columns and sorted(map(str, one.collect())) == sorted(map(str, docs.collect()))
    three = P.repeated_passages(spark, kept, "")
    assert three.columns == docs.columns and three.count() == 5 and P.pack_sequences(spark, three, "").count() == 5


def test_language_stage_keeps_mixed_texts_of_many_languages(spark):
    import corpus_pipeline as P

    r = random.Random(5)
    tongues = {f"l{i}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 4))) for _ in range(9)] for i in range(8)}
    text = lambda k, n: " ".join("".join(r.choice(tongues[k]) for _ in range(r.randrange(1, 4))) for _ in range(n))
    rows = [(i, text(f"l{i % 8}", 40), f"l{i % 8}") for i in range(400)] + [(1000, " ".join(text(k, 6) for k in tongues), None), (1001, "12 !!", None)]
    kept = {x["doc_id"] for x in P.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()}
    assert kept == {x[0] for x in rows} - {1001}


@pytest.mark.parametrize("hot", [1, 3, 20_000])
def test_repeats_over_many_slices(spark, docs, rows, hot):
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        cut = suffix_dedup.cut_repeats(docs.select("doc_id", "text"), hot=hot)
        got = cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows)


def test_long_repeats(spark):
    r = random.Random(3)
    copy = "".join(r.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, copy), (2, copy), (3, copy[:1499]), (4, "x" + copy[200:2500])]
    got = suffix_dedup.repeats_table(spark.createDataFrame(rows, "doc_id long, text string"), 1500).collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows, 1500)
    with pytest.raises(ValueError):
        suffix_dedup.repeats_table(spark.createDataFrame(rows, "doc_id long, text string"), 1 << 17)


@pytest.mark.parametrize("hot", [1, 2, 50])
def test_kinds_are_those_of_whole_keys(hot):
    r = random.Random(hot)
    rows = sorted((k, c, i, i) for i, (k, c) in enumerate((r.randrange(9), r.randrange(r.choice([1, 2, 9]))) for _ in range(300)))
    kinds, got, at = suffix_dedup._Kinds(hot), [], 0
    while at < len(rows):
        n = r.randrange(1, 12)
        got.append(kinds.add(*(np.array(x, np.int64) for x in zip(*rows[at : at + n], strict=True))))
        at += n
    got.append(kinds.finish())
    got = sorted((int(a), int(k), int(x)) for row, _, key, role in got for a, k, x in zip(row, key, role, strict=True))
    want, seen = [], set()
    for k, c, i, _ in rows:
        many = len({x[1] for x in rows if x[0] == k})
        if (k, c) in seen:
            want.append((i, k, suffix_dedup._FULL))
        elif many > 1:
            want.append((i, k, suffix_dedup._RECUT if many > hot else suffix_dedup._CUT))
        seen.add((k, c))
    assert got == sorted(want)


def test_pieces_window_is_bounded(monkeypatch):
    codec = pieces.piece_codec(None)
    text = "".join(random.Random(6).choice("etaoinshrdlu") for _ in range(4000))
    assert codec.search("▁" + text) == codec.model.encode(text)
    short = [codec.search(text[i : i + 5]) for i in range(50)]
    assert all("".join(codec.names[p] for p in x) == text[i : i + 5] for i, x in enumerate(short))


def test_other_tokenizer_rules_encode_whole_texts():
    import public_tokenizers
    import pyarrow as pa

    other = tokens.word_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert tokens.word_encoder(None).by_part and not other.by_part
    texts = [t or "" for t in TEXTS]
    got = [x for _, ids, counts in other.batches(pa.array(texts)) for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert [x.tolist() for x in got] == [other.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_crowded_prefixes_link_as_all_pairs_do(spark):
    r = random.Random(12)
    base = r.getrandbits(64)
    values = sorted({base ^ sum(1 << b for b in r.sample(range(20, 64), r.randrange(4))) for _ in range(500)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    for hot in (4, 60):
        pairs = {(x["src"], x["dst"]) for x in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2, hot=hot).collect()}
        at = {v: i for i, v in enumerate(signed)}
        near = lambda a, b: bin(values[a] ^ values[b]).count("1") <= 2
        linked = {frozenset((at[a], at[b])) for a, b in pairs}
        assert all(near(*p) for p in linked)
        assert closure(len(values), lambda a, b: frozenset((a, b)) in linked) == closure(len(values), near)


def test_language_scores_are_those_of_a_direct_kernel_and_ridge_solve(spark):
    import math

    r = random.Random(21)
    kinds = {"aa": ["ka", "lo", "mi", "nu"], "bb": ["tre", "ou", "que", "ée"], "cc": ["sch", "ung", "der", "ä"]}
    text = lambda lang: " ".join("".join(r.choice(kinds[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(3, 12)))
    rows = [(i, text(lang), lang) for i, lang in enumerate(r.choice(list(kinds)) for _ in range(150))]
    settings = langid.Settings(per_language=25, landmarks=6)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, settings)

    def grams(t, n):
        clean = " " + re.sub(r"[^\W\d_]+|.", lambda m: m[0] if m[0][0].isalpha() else " ", t.lower()).strip() + " "
        return {re.sub(" +", " ", clean)[i : i + n] for i in range(len(re.sub(" +", " ", clean)) - n + 1)}

    sets = {i: [grams(t, n) for n in settings.orders] for i, t, _ in rows}
    for i, t, _ in rows:  # the presence bits stand for these sets; from here on a gram is its slot, as grams of two texts may share one
        slots = [set(np.flatnonzero(x).tolist()) for x in langid.presence(t, settings)]
        assert [len(x) for x in slots] == [len(x) for x in sets[i]]
        sets[i] = slots
    kernel = lambda a, b: sum(len(x & y) / math.sqrt(len(x) * len(y)) for x, y in zip(sets[a], sets[b], strict=True)) / len(settings.orders)
    order = {x["doc_id"]: x["h"] for x in docs.selectExpr("doc_id", "xxhash64(doc_id) h").collect()}
    chosen = {c: sorted((i for i, _, lang in rows if lang == c and zlib.crc32(str(i).encode()) % 3 != 1), key=lambda i: (order[i], i))[: settings.per_language] for c in kinds}
    marks, sample = [i for c in kinds for i in chosen[c][: settings.landmarks]], [(i, c) for c in kinds for i in chosen[c]]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    features = lambda ids: np.hstack([np.array([[kernel(i, m) for m in marks] for i in ids]) @ root, np.ones((len(ids), 1))])
    x = features([i for i, _ in sample])
    y = np.array([[c == k for k in kinds] for _, c in sample], float)
    weight = np.array([1 / len(chosen[c]) for _, c in sample])
    solved = np.linalg.solve(x.T @ (x * weight[:, None]) + settings.ridge * weight.mean() * np.eye(x.shape[1]), x.T @ (y * weight[:, None]))
    direct = features([i for i, _, _ in rows]) @ solved
    folded = langid.scores(np.stack([langid.presence(t, settings) for _, t, _ in rows]), model)
    assert model.languages == tuple(kinds) and np.abs(direct - folded).max() < 1e-3
    got = {x["doc_id"]: x for x in langid.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == list(kinds)[d.argmax()] and abs(got[i]["score"] - min(1, max(0, d.max()))) < 1e-3 for (i, _, _), d in zip(rows, direct, strict=True))
