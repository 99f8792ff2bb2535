"""SentencePiece encoding and decoding by a streaming Viterbi search over a model's pieces.

An automaton of all pieces reads a text once and names, at every position, the pieces that end there, longest first. For every position the
search keeps the last piece of the best segmentation that ends there and where that piece starts. Only positions within the longest piece can
still be continued, so it keeps that window; a position that has left the window and that no open path passes is dropped, and as soon as
all surviving back pointer paths pass one boundary the ids before it are committed and forgotten.

* With a model of the score kind (unigram) the best segmentation maximises the sum of scores; among equal sums the longer last piece wins.
* With a model of the merge kind (as the public 32k model is) a segmentation is the one that merging gives exactly when each two
  neighbours, merged on their own, stay these two pieces. So a step is admissible or not, each position has one admissible last
  piece, and the same search yields the library's ids. Which neighbours stay is found once for each pair and kept.

Between two characters that stand side by side in no piece every path has a boundary, so the search commits there whatever comes before
or after, as it does before white space in most models. Whole texts pass through it from one such boundary to the next; what a
stretch between two of them commits is remembered per worker (stretches of at most ``_REMEMBERED`` characters, those in use).

**Edge cases.** A null or empty text has no ids. A character without a piece becomes its byte pieces, or the unknown id where the model
has none. Decoding gives back the normalised text; a literal U+2581 becomes a space, as in the library.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.memory import keep, task
from ledgerloom.llm.tokens import gather
from ledgerloom.session import ship

_SPACE = "▁"
_SLICE_BYTES = 4 << 20
_REMEMBERED = 64
_MEMORY_STRETCHES = 300_000
_MEMORY_PAIRS = _MEMORY_STEPS = 1_000_000
_codecs: dict[str, PieceCodec] = {}
keep("pieces", _codecs.clear)
_SCORES, _MERGES = 1, 2  # the model kinds in the file format


def piece_codec(path: str | None) -> PieceCodec:
    """The codec of this process for a model file; by default the public 32k model."""
    if not path:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        model = self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.pieces = {names[i]: (model.get_score(i), i) for i in plain}
        self.longest = max(map(len, self.pieces))
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.unknown_score = min(s for s, _ in self.pieces.values()) - 10
        self.raw = [b"" if model.is_control(i) else bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else names[i].replace(_SPACE, " ").encode() for i in range(size)]
        self.raw[self.unknown] = " ⁇ ".encode()
        adjacent = sorted({p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)})
        letters = sorted(set("".join(adjacent)))
        place = {c: i + 1 for i, c in enumerate(letters)}
        self.letter_of = np.zeros(0x110000, np.int16)  # the number of each character that stands beside another in a piece; 0 for others
        self.letter_of[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        self.beside[[place[x[0]] for x in adjacent], [place[x[1]] for x in adjacent]] = True
        self.identity = model.normalize(" a\t\nＡ  b ") == f"{_SPACE}{_SPACE}a\t\nＡ{_SPACE}{_SPACE}b{_SPACE}"
        self.kind = _model_kind(model.serialized_model_proto())
        if self.kind not in (_SCORES, _MERGES):
            raise ValueError("the model must be of the score or the merge kind")
        self.names = {i: p for p, (_, i) in self.pieces.items()}
        self.steps, self.fail, self.ending = self._automaton()
        self.letters = set("".join(self.pieces))
        self.kept_steps = 0
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.stay: dict[int, bool] = {}

    def _automaton(self) -> tuple[list[dict[str, int]], list[int], list[tuple]]:
        """Steps of each state, the state of its longest proper suffix, and ``(length, id, score)`` of the pieces that end there."""
        steps, ending = [{}], [()]
        for piece, (score, i) in self.pieces.items():
            state = 0
            for c in piece:
                following = steps[state].get(c)
                if following is None:
                    following = steps[state][c] = len(steps)
                    steps.append({})
                    ending.append(())
                state = following
            ending[state] = ((len(piece), i, score),)
        fail = [0] * len(steps)
        level = list(steps[0].values())
        while level:
            below = []
            for state in level:
                ending[state] += ending[fail[state]]
                for c, child in steps[state].items():
                    at = fail[state]
                    while at and c not in steps[at]:
                        at = fail[at]
                    fail[child] = steps[at].get(c, 0)
                    below.append(child)
            level = below
        return steps, fail, ending

    def _step(self, state: int, c: str) -> int:
        """Where an unseen step leads: to the longest suffix that goes on with ``c``. It is kept."""
        if c not in self.letters:
            return 0
        at = state
        while at and c not in self.steps[at]:
            at = self.fail[at]
        following = self.steps[at].get(c, 0)
        if self.kept_steps < _MEMORY_STEPS:
            self.kept_steps += 1
            self.steps[state][c] = following
        return following

    def _merged(self, text: str) -> list[str]:
        """The pieces that merging alone makes of a short text: the best-scored pair first, the leftmost among equals."""
        parts, pieces, none = list(text), self.pieces, (-float("inf"), 0)
        value = [pieces.get(a + b, none)[0] for a, b in zip(parts, parts[1:], strict=False)]
        while value:
            best = max(value)
            if best == none[0]:
                break
            i = value.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del value[i]
            if i:
                value[i - 1] = pieces.get(parts[i - 1] + parts[i], none)[0]
            if i < len(value):
                value[i] = pieces.get(parts[i] + parts[i + 1], none)[0]
        return parts

    def _stays(self, before: int, piece: int) -> bool:
        """Whether ``piece`` may follow ``before`` (-1 at the start and after an unknown character)."""
        names = [self.names[piece]] if before < 0 else [self.names[before], self.names[piece]]
        if len(self.stay) >= _MEMORY_PAIRS:
            self.stay.clear()
        known = self.stay[(before << 32) + piece] = self._merged("".join(names)) == names
        return known

    def search(self, text: str) -> list[int]:
        """The ids of normalised text between two boundaries that every path passes."""
        steps, ending, stay, longest, merges = self.steps, self.ending, self.stay, self.longest, self.kind == _MERGES
        streams = len(text) > longest
        ids, base, state = [], 0, 0
        # for positions base, base + 1, ...: where the last piece starts, that piece, and the best sum
        origin, last, score = [0], [-1], [0.0]
        paths, through = [0], [0]  # how many open positions point there, and the sum of those positions
        for at, c in enumerate(text, 1):
            following = steps[state].get(c)
            state = self._step(state, c) if following is None else following
            start, piece, best = -1, -1, 0.0
            if merges:
                for length, i, _ in ending[state]:
                    before = last[at - length - base]
                    good = stay.get((before << 32) + i)
                    if good is None:
                        good = self._stays(before, i)
                    if good:
                        start, piece = at - length, i
                        break
            else:
                for length, i, value in ending[state]:
                    value += score[at - length - base]
                    if start < 0 or value > best:
                        start, piece, best = at - length, i, value
                if not ending[state] or ending[state][-1][0] > 1:
                    value = score[at - 1 - base] + self.unknown_score
                    if start < 0 or value > best:
                        start, piece, best = at - 1, -1, value
            if start < 0:
                start = at - 1
            origin.append(start)
            last.append(piece)
            score.append(best)
            if streams:
                paths.append(0)
                through.append(0)
                paths[start - base] += 1
                through[start - base] += at
                left = at - longest  # this position has left the window: the next piece starts after it
                if left >= base:
                    dead = left
                    while dead > base and not paths[dead - base]:
                        start = origin[dead - base]
                        paths[start - base] -= 1
                        through[start - base] -= dead
                        dead = start
                    meet = base
                    while meet <= left and paths[meet - base] == 1:
                        meet = through[meet - base]
                        self._commit(ids, text, origin[meet - base], meet, last[meet - base])
                    if meet > base:
                        for kept in (origin, last, score, paths, through):
                            del kept[: meet - base]
                        base = meet
        rest, at = [], len(text)
        while at > base:
            rest.append(at)
            at = origin[at - base]
        for at in reversed(rest):
            self._commit(ids, text, origin[at - base], at, last[at - base])
        return ids

    def _commit(self, ids: list[int], text: str, start: int, end: int, piece: int) -> None:
        if piece >= 0:
            ids.append(piece)
        elif self.byte_ids:
            ids += [self.byte_ids[b] for b in text[start:end].encode()]
        else:
            ids.append(self.unknown)

    def _stretches(self, stretches: list[str]) -> list[bytes]:
        """The ids of each of these distinct stretches as little-endian unsigned 32-bit integers, from memory where they are known."""
        if len(self.memory) > _MEMORY_STRETCHES:
            self.older, self.memory = self.memory, {}
        memory, older = self.memory, self.older
        out = list(map(memory.get, stretches))
        for i in [i for i, x in enumerate(out) if x is None]:
            text = stretches[i]
            out[i] = older.get(text)
            if out[i] is None:
                out[i] = array("I", self.search(text)).tobytes()
            if len(text) <= _REMEMBERED:
                memory[text] = out[i]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_texts([text])[0]

    def _normal(self, text: str | None) -> str:
        if not text:
            return ""
        return _SPACE + text.replace(" ", _SPACE) if self.identity else self.model.normalize(text)

    def encode_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some whole texts, and how many each has."""
        texts = [self._normal(x) for x in texts]
        ends = np.cumsum([len(x) for x in texts])
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        letter = self.letter_of[points]
        boundary = np.ones(len(points) + 1, bool)
        boundary[1:-1] = ~self.beside[letter[:-1], letter[1:]]
        boundary[ends] = True
        at = np.flatnonzero(boundary)
        size = np.ones(len(points), np.int8)
        for least in (0x80, 0x800, 0x10000):
            size += points >= least
        offsets = np.zeros(len(points) + 1, np.int64)
        np.cumsum(size, out=offsets[1:])
        coded = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(offsets[at]), pa.py_buffer(joined.encode())).dictionary_encode()
        ids, begins = gather(self._stretches(coded.dictionary.to_pylist()), coded.indices.to_numpy(), 4)
        return ids, np.diff(begins[np.searchsorted(at, np.append(0, ends))])

    def batches(self, texts: pa.Array):
        """``(first, ids, counts)`` for runs of consecutive texts: the index of the first, all ids, and how many each has."""
        texts = texts.cast(pa.large_string())
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
        group = (np.cumsum(size) - size) // _SLICE_BYTES
        cuts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(size)) if len(size) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield (int(a), *self.encode_texts(texts.slice(int(a), int(b - a)).to_pylist()))

    def encode_column(self, texts: pa.Array):
        """The ids of each text, in order."""
        for _, ids, counts in self.batches(texts):
            yield from np.split(ids, np.cumsum(counts)[:-1])

    def decode_texts(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 bytes of some texts from all their ids."""
        if not len(ids):
            return [b""] * len(counts)
        used, index = np.unique(ids, return_inverse=True)
        letters, ends = gather([self.raw[i] for i in used.tolist()], index, 1)
        ends = ends[np.append(0, np.cumsum(counts))]
        data = letters.tobytes()
        out = [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        try:
            data.decode()
        except UnicodeDecodeError:  # ids that end inside a character
            return [self._readable(x) for x in out]
        return [x[1:] if x[:1] == b" " else x for x in out]

    @staticmethod
    def _readable(raw: bytes) -> bytes:
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace").encode()

    def decode(self, ids) -> str:
        return self._readable(b"".join([self.raw[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])).decode()


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if data[at - 1] < 128:
            return value, at


def _fields(data: bytes):
    """``(number, value)`` of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _model_kind(proto: bytes) -> int:
    trainer = next((v for n, v in _fields(proto) if n == 2), b"")
    return next((v for n, v in _fields(trainer) if n == 3), _SCORES)


def encode_pieces(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``(doc_id, ids)`` for every row."""

    def lists(codec: PieceCodec, ids: np.ndarray, counts: np.ndarray):
        return (pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids.astype(np.int64))),)

    return _encode(docs, model, "doc_id long, ids array<long>", ["doc_id", "ids"], lists)


def decode_pieces(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; null ids give a null text."""
    ship(encoded.sparkSession)

    def run(batches):
        codec = piece_codec(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else codec.decode(x) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(task(run, "pieces"), "doc_id long, text string")


def piece_table(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_crc32, text_crc32)``: digests of every text's ids and of the text decoded from them."""

    def digest(codec: PieceCodec, ids: np.ndarray, counts: np.ndarray):
        ends = np.cumsum(counts).tolist()
        crc = [zlib.crc32(ids[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return pa.array(counts, pa.int64()), pa.array(crc, pa.int64()), pa.array([zlib.crc32(x) for x in codec.decode_texts(ids, counts)], pa.int64())

    return _encode(docs, model, "doc_id long, n_tokens long, ids_crc32 long, text_crc32 long", ["doc_id", "n_tokens", "ids_crc32", "text_crc32"], digest)


def _encode(docs: DataFrame, model: str | None, schema: str, names: list[str], value) -> DataFrame:
    ship(docs.sparkSession)

    def run(batches):
        codec = piece_codec(model)
        for batch in batches:
            for first, ids, counts in codec.batches(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(counts)), *value(codec, ids, counts)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task(run, "pieces"), schema)
