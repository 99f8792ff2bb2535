"""Byte-level BPE over whole texts through a table of distinct words.

1. **Split.** Texts are gathered into slices of a few megabytes and cut into words at places where the pre-tokenizer always cuts. A slice
   is stored as its distinct words and, for every word of its documents in order, the number of that word in the slice.
2. **Encode.** The slices' words meet by hash, in packets of one (slice, hash bucket) each, so the exchange carries every word once per
   slice and not once per occurrence. Each bucket is read as one sorted stream; each distinct word of the corpus lies in one bucket and is
   given to the tokenizer once.
3. **Join back.** The words' ids return to their slices, and a document's ids are those of its word numbers, by position.
4. **Decode.** Ids are joined to the table of pieces (one row for each id of the vocabulary, which bounds the broadcast), and the
   pieces of a document are concatenated by position.

Buckets are numbered so that each gets about ``_BUCKET_WORDS`` words whatever the input's size. A slice is bounded by ``_SLICE_BYTES``, or is
one longer document. Nothing is kept per document outside its slice.

**Edge cases.** A null or empty text has no ids and decodes to the empty text. Rows that repeat, or whose doc_id is null, are encoded
like any other. Special tokens in a text are encoded as the library does, as one id. Tokenizer files with other rules than those below are
followed too: their texts are not cut, and each distinct text is encoded once. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.memory import keep, task
from ledgerloom.llm.tokens import buffers, gather
from ledgerloom.session import scratch_path, ship, tasks

_SLICE_BYTES = 8 << 20
_BUCKET_WORDS = 200_000
_tokenizers: dict[str, ByteTokenizer] = {}
keep("bytes", _tokenizers.clear)

# The rules, as the tokenizer file states them, under which texts can be cut into words.
_RULE = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}

# Kinds of bytes: 0 other, 1 white space, 2 letter, 3 digit, 4 sign, 5 apostrophe, 6 control.
_KIND = np.zeros(256, np.uint8)
_KIND[:128] = 6
_KIND[list(b" \t\n\v\f\r")] = 1
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = 2
_KIND[list(b"0123456789")] = 3
_KIND[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = 4
_KIND[list(b"'")] = 5
#: Where the pre-tokenizer cuts between two such bytes, whatever stands around them.
_CUT = np.zeros((7, 7), bool)
_CUT[2:6, 1] = True
_CUT[2, 3:6] = True
_CUT[3, [2, 4, 5]] = True
_CUT[4, 2:4] = True


def byte_tokenizer(path: str | None) -> ByteTokenizer:
    """The tokenizer of this process for a file; by default the public 50k byte-level vocabulary."""
    path = path or _default()
    if path not in _tokenizers:
        _tokenizers[path] = ByteTokenizer(path)
    return _tokenizers[path]


def _default() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        rules = json.loads(self.library.to_str())
        before, added = rules.get("pre_tokenizer") or {}, rules.get("added_tokens") or []
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        self.cuttable = rules.get("normalizer") is None and all(before.get(k) == v for k, v in _RULE.items()) and plain and len(added) <= 1
        self.special = added[0]["content"].encode() if added else b""

    def words(self, texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
        """All words of the texts in order, and how many each text has."""
        data, offsets = buffers(texts)
        begins = np.zeros(len(data) + 1, bool)
        if self.cuttable and len(data):
            begins[1:-1] = _cuts(data)
            if self.special:
                self._keep_special(data, offsets, begins)
        begins[offsets] = True
        begins[len(data)] = False
        places = np.flatnonzero(begins).astype(np.int64)
        counts = np.diff(np.searchsorted(places, offsets))
        edges = np.append(places, len(data))
        return pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(edges), pa.py_buffer(data)), counts

    def _keep_special(self, data: np.ndarray, offsets: np.ndarray, begins: np.ndarray) -> None:
        """A special token within one text is a word of its own."""
        raw, size = data.tobytes(), len(self.special)
        at = raw.find(self.special)
        while at >= 0:
            text = np.searchsorted(offsets, at, "right")
            if at + size <= offsets[text]:
                begins[at + 1 : at + size] = False
                begins[[at, at + size]] = True
                at = raw.find(self.special, at + size)
            else:
                at = raw.find(self.special, int(offsets[text]))

    def encode(self, words: list[str]) -> list[bytes]:
        """The ids of each word as unsigned 32-bit integers."""
        return [array("I", x.ids).tobytes() for x in self.library.encode_batch_fast(words, add_special_tokens=False)]


def _cuts(data: np.ndarray) -> np.ndarray:
    """Whether there is a cut before each byte but the first."""
    kind = _KIND[data]
    cut = _CUT[kind[:-1], kind[1:]]
    # after a character of several bytes: before white space unless it may be white space itself, before the others only after Latin letters
    at = np.flatnonzero((kind[:-1] == 0) & np.isin(kind[1:], (1, 3, 4, 5))) + 1
    padded = np.concatenate((np.zeros(3, np.uint8), data))
    first, second, third, last = padded[at - 1], padded[at], padded[at + 1], padded[at + 2]
    two = (third >= 0xC3) & (third <= 0xDF)
    three = (second >= 0xE0) & (second <= 0xEE) & (second != 0xE1) & (second != 0xE2) & (third < 0xC0) & ~((second == 0xE3) & (third == 0x80) & (last == 0x80))
    four = (first >= 0xF0) & (second < 0xC0) & (third < 0xC0)
    letter = _latin(third, last)
    cut[at[np.where(kind[at] == 1, two | three | four, letter)] - 1] = True
    # a Latin letter of two bytes after a digit or a sign
    at = np.flatnonzero(((kind[:-1] == 3) | (kind[:-1] == 4)) & (data[1:] >= 0xC3)) + 1
    at = at[at + 1 < len(data)]
    cut[at[_latin(data[at], data[at + 1])] - 1] = True
    return cut


def _latin(lead: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Letters of two bytes, U+00C0 to U+027F but for the signs U+00D7 and U+00F7."""
    return (lead >= 0xC3) & (lead <= 0xC9) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)))


def _packed(numbers: np.ndarray) -> bytes:
    """Small numbers, byte plane by byte plane, compressed."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _row(schema: str, *values) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [c.split(" ") for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[t]) for v, (_, t) in zip(values, fields, strict=True)], [n for n, _ in fields])


_SLICE = "slice long, n_words int, doc_ids array<long>, counts binary, numbers binary, letters binary, lengths binary"
#: In packets ``numbers`` are differences, since they ascend.
_PACKET = "bucket int, slice long, numbers binary, letters binary, lengths binary"
_IDS = "slice long, numbers binary, ids binary, lengths binary"


def _cut_slices(docs: DataFrame, tokenizer: str | None) -> DataFrame:
    """One row per slice: its documents, their words by number, and its distinct words."""

    def run(batches):
        codec, part, made = byte_tokenizer(tokenizer), TaskContext.get().partitionId(), 0
        held, size = [], 0

        def cut():
            texts, docs_ = pa.concat_arrays([t for _, t in held]), pa.concat_arrays([d for d, _ in held])
            words, counts = codec.words(texts)
            coded = words.dictionary_encode()
            codes = coded.indices.to_numpy()
            # frequent words get small numbers
            order = np.argsort(-np.bincount(codes, minlength=len(coded.dictionary)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            distinct = coded.dictionary.take(pa.array(order))
            letters, _ = buffers(distinct)
            return _row(_SLICE, (part << 32) | made, len(order), docs_.to_pylist(), _packed(counts), _packed(rank[codes]), zstandard.compress(letters.tobytes(), 3), _packed(pc.binary_length(distinct).to_numpy()))

        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            ends = np.cumsum(pc.binary_length(texts).to_numpy())
            begin = 0
            while begin < len(texts):
                base = ends[begin - 1] if begin else 0
                stop = min(len(texts), max(int(np.searchsorted(ends, base + _SLICE_BYTES - size, "right")), begin + (not held)))
                if stop > begin:
                    held.append((batch.column("doc_id").slice(begin, stop - begin), texts.slice(begin, stop - begin)))
                    size += int(ends[stop - 1] - base)
                    begin = stop
                if begin < len(texts) or size >= _SLICE_BYTES:
                    yield cut()
                    held, size, made = [], 0, made + 1
        if held:
            yield cut()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task(run, "bytes"), _SLICE)


def _texts(letters: bytes, lengths: np.ndarray) -> pa.LargeStringArray:
    edges = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=edges[1:])
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(edges), pa.py_buffer(letters))


def _packets(slices: DataFrame, buckets: int) -> DataFrame:
    """The distinct words of each slice, dealt into packets by a hash of the word."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words = _texts(zstandard.decompress(row["letters"]), _unpacked(row["lengths"]))
                bucket = np.fromiter((zlib.crc32(w) % buckets for w in words.cast(pa.large_binary()).to_pylist()), np.int64, len(words))
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                for part in np.split(order, cuts) if len(order) else []:
                    own = words.take(pa.array(part))
                    yield _row(_PACKET, int(bucket[part[0]]), row["slice"], _packed(np.diff(part, prepend=0)), zstandard.compress(buffers(own)[0].tobytes(), 3), _packed(pc.binary_length(own).to_numpy()))

    return slices.select("slice", "letters", "lengths").mapInArrow(task(run, rows=1), _PACKET)


def _encode_packets(packets: DataFrame, tokenizer: str | None) -> DataFrame:
    """The ids of every packet's words; within a bucket, which is one sorted stream, each distinct word is encoded once."""

    def run(batches):
        codec, bucket, known = byte_tokenizer(tokenizer), None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    bucket, known = row["bucket"], {}
                words = _texts(zstandard.decompress(row["letters"]), _unpacked(row["lengths"])).to_pylist()
                fresh = [w for w in words if w not in known]
                known.update(zip(fresh, codec.encode(fresh), strict=True))
                ids = [known[w] for w in words]
                # most vocabularies fit 16 bits; the planes of high bytes are then empty and vanish when compressed
                yield _row(_IDS, row["slice"], row["numbers"], _packed(np.frombuffer(b"".join(ids), "<u4")), _packed(np.fromiter(map(len, ids), np.int64, len(ids)) // 4))

    return packets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(task(run, "bytes", 16), _IDS)


def _stored(slices: DataFrame) -> DataFrame:
    """The slices as files in buckets by slice, so that the joins that follow do not move them again."""
    spark = slices.sparkSession
    path = scratch_path(spark, "bpe-slices")
    name = f"slices_{path.rpartition('-')[2]}"
    slices.write.bucketBy(tasks(spark), "slice").option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay
    return table


def _encoded(docs: DataFrame, tokenizer: str | None, schema: str, value) -> DataFrame:
    """``value(ids, counts)`` gives the columns after doc_id for a slice's documents."""
    spark = docs.sparkSession
    ship(spark)
    slices = _stored(_cut_slices(docs, tokenizer))
    total = slices.agg(F.sum("n_words")).first()[0] or 0
    encoded = _encode_packets(_packets(slices, -(-total // _BUCKET_WORDS) or 1), tokenizer)
    # a slice has at most one packet per bucket, and all of them together are its own distinct words
    found = encoded.groupBy("slice").agg(F.collect_list(F.struct("numbers", "ids", "lengths")).alias("packets"))
    joined = slices.select("slice", "n_words", "doc_ids", "counts", "numbers").join(found, "slice", "left").select("n_words", "doc_ids", "counts", "numbers", "packets")
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                kinds = [b""] * row["n_words"]
                for packet in row["packets"] or []:
                    ids, lengths = _unpacked(packet["ids"]), _unpacked(packet["lengths"])
                    ends = (4 * np.cumsum(lengths.astype(np.int64))).tolist()
                    raw = ids.tobytes()
                    for number, a, b in zip(np.cumsum(_unpacked(packet["numbers"]).astype(np.int64)).tolist(), [0, *ends[:-1]], ends, strict=True):
                        kinds[number] = raw[a:b]
                counts = _unpacked(row["counts"]).astype(np.int64)
                ids, ends = gather(kinds, _unpacked(row["numbers"]).astype(np.int64), 4)
                edges = ends[np.append(0, np.cumsum(counts))]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), *value(ids, edges)], names)

    return joined.mapInArrow(task(run, "bytes", 1), schema)


def _lists(ids: np.ndarray, edges: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int64)))


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``(doc_id, ids)`` for every row."""
    return _encoded(docs, tokenizer, "doc_id long, ids array<long>", lambda ids, edges: (_lists(ids, edges),))


def pieces(spark: SparkSession, tokenizer: str | None = None) -> DataFrame:
    """``(id, piece)``: the bytes of every id of the vocabulary; special tokens stand for their own text."""
    codec = ByteTokenizer(tokenizer or _default())
    letters, byte_of = codec.library.get_vocab(with_added_tokens=True), _byte_letters()
    rows = [(i, bytearray(bytes(byte_of[c] for c in p) if all(c in byte_of for c in p) else p.encode())) for p, i in letters.items()]
    return spark.createDataFrame(rows, "id long, piece binary")


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as its own character, and the others, in order, as the characters from U+0100."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b <= 0xFF and b != 0xAD)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class _Pieces:
    """The id-to-piece table as a broadcast; ids outside the vocabulary have no piece."""

    def __init__(self, spark: SparkSession, tokenizer: str | None):
        found = {r["id"]: bytes(r["piece"]) for r in pieces(spark, tokenizer).collect()}  # one row per id of the vocabulary
        self.shared = spark.sparkContext.broadcast([found.get(i, b"") for i in range(max(found, default=-1) + 2)])

    def join(self, ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
        """The joined pieces of each text as UTF-8; bytes that are none are replaced, as the library does."""
        table = self.shared.value
        raw, ends = gather(table, np.where((ids >= 0) & (ids < len(table)), ids, len(table) - 1).astype(np.int64), 1)
        raw, cuts = raw.tobytes(), ends[edges].tolist()
        return [_valid(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _valid(raw: bytes) -> bytes:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()
    return raw


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; null ids give a null text, a null or unknown id has no piece."""
    ship(encoded.sparkSession)
    table = _Pieces(encoded.sparkSession, tokenizer)

    def run(batches):
        for batch in batches:
            lists = batch.column(1).cast(pa.list_(pa.int64()))
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            ids = pc.fill_null(lists.flatten(), -1).to_numpy()
            texts = table.join(ids, np.append(0, np.cumsum(counts)))
            none = lists.is_null().to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if n else t.decode() for n, t in zip(none, texts, strict=True)], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<long>").alias("ids")).mapInArrow(task(run), "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: digests of every text's ids and of the text decoded from them."""
    table = _Pieces(docs.sparkSession, tokenizer)

    def digests(ids: np.ndarray, edges: np.ndarray):
        raw, cuts = ids.astype("<u4").tobytes(), edges.tolist()
        own = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        back = [hashlib.sha256(x).hexdigest() for x in table.join(ids, edges)]
        return pa.array(np.diff(edges), pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string())

    return _encoded(docs, tokenizer, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digests)
