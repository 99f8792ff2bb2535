"""Token ids of whole texts, encoded part by part with a worker-wide memory.

The given vocabulary's rules never join across white space, nor a letter or digit with the ASCII sign after it (apostrophes
apart), so the ids of a text are those of its parts in order. A slice of texts is lower-cased (A-Z, which the vocabulary's own
normaliser does as well) and cut as one byte array, its distinct parts are found by Arrow, and only parts that the worker has not
met are sent to the tokenizer. Texts that hold the opening of a special token (``<|``) are encoded whole, and so are those with combining
marks and a capital A-Z right before what may be one (the vocabulary's normaliser composes before it lower-cases), and every text with a
tokenizer file of other rules.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerloom.llm.memory import keep

SLICE_ROWS = 4096
_SLICE_BYTES = 8 << 20
_MEMORY_PARTS = 250_000
_encoders: dict[str, WordEncoder] = {}
keep("words", _encoders.clear)

# The rules, as the tokenizer file states them, under which parts can be encoded on their own.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_WORD = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))
_SIGN = np.isin(np.arange(256), list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"))


def word_encoder(path: str | None) -> WordEncoder:
    """The encoder of this process for a tokenizer file; by default the public lower-case word vocabulary."""
    if not path:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _cuttable(rules: dict) -> bool:
    """Whether the ids of a text are those of its parts under the rules of a tokenizer file."""
    first = ((rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    split = first.get("type") == "Split" and first.get("pattern") == {"Regex": _SPLIT} and first.get("behavior") == "Removed" and first.get("invert") is True
    return rules.get("normalizer") == _NORMALIZER and split and not rules.get("truncation") and not rules.get("padding")


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_part = _cuttable(json.loads(self.tokenizer.to_str()))
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def parts(self, parts: list[str]) -> list[bytes]:
        """The ids of each of these distinct parts (without A-Z) as unsigned 32-bit integers. Of the parts met, those used since
        the last turnover are kept."""
        if len(self.memory) > _MEMORY_PARTS:
            self.older, self.memory = self.memory, {}
        memory, older = self.memory, self.older
        out = list(map(memory.get, parts))
        fresh = []
        for i in [i for i, x in enumerate(out) if x is None]:
            known = older.get(parts[i])
            if known is None:
                fresh.append(i)
            else:
                out[i] = memory[parts[i]] = known
        if fresh:
            for i, found in zip(fresh, self.tokenizer.encode_batch_fast([parts[i] for i in fresh], add_special_tokens=False), strict=True):
                out[i] = memory[parts[i]] = array("I", found.ids).tobytes()
        return out

    def batches(self, texts: pa.Array):
        """``(first, ids, counts)`` for runs of consecutive texts: the index of the first, all ids, and how many each has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = pc.binary_length(texts).to_numpy()
        group = (np.cumsum(size) - size) // _SLICE_BYTES
        cuts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(size)) if len(size) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield (int(a), *self._encode(texts.slice(a, b - a)))

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_part:
            pieces = self._whole(texts.to_pylist())
            return np.concatenate(pieces), np.array([len(x) for x in pieces], np.int64)
        odd = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False) | _composing(texts))
        whole = dict(zip(odd.tolist(), self._whole(texts.take(pa.array(odd)).to_pylist()), strict=True)) if len(odd) else {}
        if whole:
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            texts = pc.if_else(pa.array(mask), "", texts)
        letters, edges = cut(texts)
        coded = pa.LargeStringArray.from_buffers(len(edges[0]) - 1, pa.py_buffer(edges[0]), pa.py_buffer(letters)).dictionary_encode()
        kinds = self.parts(coded.dictionary.to_pylist())
        ids, ends = gather(kinds, coded.indices.to_numpy(), 4)
        at = ends[edges[1]]
        counts = np.diff(at)
        if whole:
            pieces = [whole.get(i, ids[at[i] : at[i + 1]]) for i in range(len(counts))]
            ids, counts = np.concatenate(pieces), np.array([len(x) for x in pieces], np.int64)
        return ids, counts


def gather(kinds: list[bytes], index: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The items of ``kinds`` (each of whole units of ``width`` bytes) in the order of ``index``, joined, and where each begins and ends."""
    length = np.fromiter(map(len, kinds), np.int64, len(kinds)) // width
    pool = np.frombuffer(b"".join(kinds), "<u4" if width == 4 else np.uint8)
    each = length[index]
    ends = np.zeros(len(each) + 1, np.int64)
    np.cumsum(each, out=ends[1:])
    # positions fit 32 bits unless one text alone is that long
    kind = np.int32 if ends[-1] < 1 << 30 and len(pool) < 1 << 30 else np.int64
    shift = ((np.cumsum(length) - length)[index] - ends[:-1]).astype(kind)
    return pool[np.repeat(shift, each) + np.arange(ends[-1], dtype=kind)], ends


def buffers(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and the offsets of each in them."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)), offsets - offsets[0]


def _composing(texts: pa.LargeStringArray) -> np.ndarray:
    """Whether a text has combining marks that a letter A-Z may be composed with: some of U+0300 to U+037F, and a character from there on
    right after such a letter."""
    data, offsets = buffers(texts)
    out = np.zeros(len(texts), bool)
    marks = (data == 0xCC) | (data == 0xCD)
    if marks.any():
        capital = np.flatnonzero(((data[:-1] - np.uint8(65)) < 26) & (data[1:] >= 0xCC))
        out[np.searchsorted(offsets, capital, "right") - 1] = True
        marked = np.zeros(len(texts), bool)
        marked[np.searchsorted(offsets, np.flatnonzero(marks), "right") - 1] = True
        out &= marked
    return out


def cut(texts: pa.LargeStringArray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The lower-cased bytes that are no white space, the offsets of the parts in them, and how many parts come before each text."""
    data, offsets = buffers(texts)
    data = data | ((data - np.uint8(65)) < 26).astype(np.uint8) << 5
    inside = ~_SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    begins = begins[:-1]
    begins[1:] |= ~inside[:-1]
    sign = np.flatnonzero(_SIGN[data[1:]]) + 1
    before = data[sign - 1]
    begins[sign[_WORD[before]]] = True
    # a letter of two bytes, U+00C0 to U+027F, but not U+00D7 and U+00F7 (signs) nor U+0130 (its lower case ends in a mark)
    sign = sign[(before >= 0x80) & (sign > 1)]
    lead, last = data[sign - 2], data[sign - 1]
    begins[sign[(lead >= 0xC3) & (lead <= 0xC9) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7))) & ~((lead == 0xC4) & (last == 0xB0))]] = True
    begins &= inside
    letters = data[inside]
    parts = np.append(np.flatnonzero(begins[inside]), len(letters)).astype(np.int64)
    before_text = np.searchsorted(np.flatnonzero(begins), offsets)
    return letters, (parts, before_text)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with ``end_id`` after each."""
    ends = np.cumsum(counts)
    return np.insert(ids, ends, np.uint32(end_id)).astype("<u4"), counts + 1
