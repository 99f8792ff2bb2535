"""Removal of byte passages that occur earlier in the corpus, by suffix sorting of the places where passages can repeat.

A byte goes when it lies in a string of ``min_length`` bytes that also starts earlier (smaller doc_id, or the same document and
an earlier start). Strings are judged on the input and never cross documents.

1. **Runs.** Every start of a ``min_length`` string is keyed by the smallest ``anchor``-byte hash inside the string. Neighbouring
   starts with the same anchor form a run; equal strings always have equal keys, so they meet in one cell.
2. **Cells.** Runs whose whole content repeats keep one representative, the earliest; the others are removed as a whole. Within
   a slice of a task this happens before the shuffle, so a passage that a third of all documents share crosses it once per slice.
   Keys that only one content has need nothing more. The runs of a key that has more than ``hot`` different contents are cut into
   their single strings, each keyed by its own hash; equal ones again cross once per slice.
3. **Threshold-bounded interval expansion.** The representatives of a cell are suffix-sorted to ``min_length``; from the
   Burrows-Wheeler transform, intervals of equal prefixes are extended backwards breadth-first, level by level, which yields the
   common prefixes between neighbouring suffixes in increasing order. The expansion stops at ``min_length``: boundaries that were
   never reached lie between suffixes that share that much, and all but the earliest suffix of such a class are marked.
4. **Documents.** The marked byte ranges of each document are merged and cut out.

Texts cross one shuffle, by row, which steps 1, 3 and 4 read; the others move hashes, or the passages that can repeat. Both sides of a
cell are sorted by Spark, which spills, and streamed: a task holds some slices, at most ``hot`` hashes of one key, and one cell.

**What decides.** Step 2 takes two runs for equal when their anchors agree and the 64-bit hashes of their whole contents do; of the
representatives, step 3 compares the bytes themselves. Of the bytes removed from the given documents (sf0.1), 9 % are found only by step 3;
the others lie in runs whose whole content repeats.

**Edge cases.** Null texts are empty. Texts shorter than ``min_length`` bytes are kept whole. A null doc_id counts as smaller than
any other. Rows that share a doc_id are separate documents, in the order in which they are read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.memory import keep, task
from ledgerloom.session import ship, tasks

_CHUNK_BITS = 18
_CELL_BYTES = 1 << 20
_EMIT = 1 << 16
_LENGTH_BITS = 20
_MAX_LENGTH = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_FULL, _CUT, _RECUT = 0, 1, 2
_tables: dict[str, np.ndarray] = {}
keep("powers", _tables.clear)


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out, size = np.ones((1 << _CHUNK_BITS) + 1, np.uint64), 1
            while size < len(out):
                some = min(size, len(out) - size)
                out[size : size + some] = out[:some] * np.array([pow(base, size, 1 << 64)], np.uint64)
                size += some
            _tables[name] = out
    return _tables["up"], _tables["down"]


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32)) ^ np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    size = 1
    total = len(a)
    while size * 2 <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    rest = width - size
    return np.minimum(a[: total - width + 1], a[rest : rest + total - width + 1]) if rest else a


def _pieces(lengths: np.ndarray, min_length: int):
    """Groups of (text, offset, bytes) that fit one chunk; long texts are cut so that every start is in one piece."""
    room = (1 << _CHUNK_BITS) - 1
    group, used = [], 0
    for i, n in enumerate(lengths):
        offset = 0
        while n - offset >= min_length:
            some = min(int(n) - offset, room)
            if used + some > room:
                yield group
                group, used = [], 0
            group.append((i, offset, some))
            used += some
            if offset + some == n:
                break
            offset += some - min_length + 1
    if group:
        yield group


def find_runs(data: np.ndarray, offsets: np.ndarray, min_length: int, anchor: int, salt: int = 0):
    """``(text, start, length, key, content)`` arrays of all runs; ``length`` counts starts, ``content`` hashes the run's bytes."""
    up, down = _powers()
    found = []
    low = np.uint64((1 << _CHUNK_BITS) - 1)
    for group in _pieces(np.diff(offsets), min_length):
        text = np.concatenate([data[offsets[i] + o : offsets[i] + o + m] for i, o, m in group])
        n = len(text)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(text.astype(np.uint64) * up[:n] + up[:n], out=sums[1:])
        grams = _mix((sums[anchor:] - sums[:-anchor]) * down[: n - anchor + 1], salt)
        best = _sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), min_length - anchor + 1)
        sizes = np.array([m for _, _, m in group])
        begins = np.cumsum(sizes) - sizes
        usable = np.zeros(n + 1, np.int8)
        usable[begins] += 1
        np.subtract.at(usable, begins + sizes - min_length + 1, 1)
        usable = np.cumsum(usable[: len(best)]) > 0
        head = usable.copy()
        head[1:] &= (best[1:] != best[:-1]) | ~usable[:-1]
        start = np.flatnonzero(head)
        stop = usable.copy()
        stop[:-1] &= head[1:] | ~usable[1:]
        length = np.flatnonzero(stop) - start + 1
        key = grams[(best[start] & low).astype(np.int64)]
        end = start + length + min_length - 1
        content = _mix((sums[end] - sums[start]) * down[start] + length.astype(np.uint64), 0x51ED27)
        piece = np.searchsorted(begins, start, "right") - 1
        which = np.array([i for i, _, _ in group])[piece]
        found.append((which, start - begins[piece] + np.array([o for _, o, _ in group])[piece], length, key.view(np.int64), content.view(np.int64)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` (values below 512) sorted by their first ``depth`` symbols; 0 pads the end."""
    n = len(text)
    packed = np.zeros(n, np.uint64)
    padded = np.concatenate([text, np.zeros(7, text.dtype)]).astype(np.uint64)
    for j in range(7):
        packed = (packed << np.uint64(9)) | padded[j : j + n]
    order = np.argsort(packed)
    new = np.ones(n, bool)
    new[1:] = packed[order[1:]] != packed[order[:-1]]
    rank = np.empty(n, np.int64)
    sorted_so_far = 7
    while sorted_so_far < depth:
        heads = np.flatnonzero(new)
        head_of = np.repeat(heads, np.diff(np.append(heads, n)))
        rank[order] = head_of
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        step = min(sorted_so_far, depth - sorted_so_far)
        at = order[tied]
        after = at + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        pair = head_of[tied] * (n + 1) + second
        by = np.argsort(pair)
        order[tied] = at[by]
        pair = pair[by]
        new[tied[1:]] |= pair[1:] != pair[:-1]
        sorted_so_far += step
    return order


def shared_with_previous(text: np.ndarray, order: np.ndarray, min_length: int) -> np.ndarray:
    """For each suffix in ``order``: whether it shares ``min_length`` symbols with the one before it.

    Intervals of suffixes with a common prefix are extended to the left through the Burrows-Wheeler transform, all those of one
    length at a time. The right border of an interval of prefixes of ``level + 1`` symbols is a common prefix of ``level``
    symbols, unless a shorter one was found there; only intervals with a new border are extended further.
    """
    n = len(text)
    before = text[order - 1]
    by_symbol = np.argsort(before, kind="stable")
    to = np.empty(n, np.int64)
    to[by_symbol] = np.arange(n)
    same = before[by_symbol[1:]] == before[by_symbol[:-1]]
    last = np.full(n, n, np.int64)  # the next place with the same symbol
    last[by_symbol[:-1][same]] = by_symbol[1:][same]
    first = np.full(n, -1, np.int64)
    first[by_symbol[1:][same]] = by_symbol[:-1][same]
    unset = np.ones(n + 1, bool)
    unset[[0, n]] = False
    left = np.searchsorted(text[order], np.unique(text))
    right = np.append(left[1:], n) - 1
    unset[left] = False
    for _ in range(1, min_length):
        sizes = right - left + 1
        place = np.repeat(left - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        extendable = before[place] != 0
        new_right = np.sort(to[place[extendable & (last[place] > np.repeat(right, sizes))]])
        new_left = np.sort(to[place[extendable & (first[place] < np.repeat(left, sizes))]])
        fresh = unset[new_right + 1]
        left, right = new_left[fresh], new_right[fresh]
        if not len(left):
            break
        unset[right + 1] = False
    return unset[:n]


def repeated_starts(contents: list[bytes], lengths: np.ndarray, min_length: int) -> np.ndarray:
    """Marks, over the concatenated starts of all runs (earliest first), those whose string starts earlier in them."""
    sizes = np.array([len(x) for x in contents]) + 1
    ends = np.cumsum(sizes)
    text = np.zeros(ends[-1], np.uint16)
    body = np.ones(len(text), bool)
    body[ends - 1] = False
    text[body] = np.frombuffer(b"".join(contents), np.uint8).astype(np.uint16) + 1
    order = suffix_order(text, min_length)
    shared = shared_with_previous(text, order, min_length)
    heads = np.flatnonzero(~shared)
    earliest = np.repeat(np.minimum.reduceat(order, heads), np.diff(np.append(heads, len(order))))
    marked = np.zeros(len(text), bool)
    marked[order] = order > earliest
    starts = np.repeat(ends - sizes, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return marked[starts]


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _merge(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    return begin[heads], reach[np.append(heads[1:], len(begin)) - 1]


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column; nulls are empty."""
    values = [x.as_buffer() if x.is_valid else pa.py_buffer(b"") for x in column]
    offsets = np.zeros(len(values) + 1, np.int64)
    np.cumsum([x.size for x in values], out=offsets[1:])
    return (np.frombuffer(b"".join(values), np.uint8) if offsets[-1] else np.zeros(0, np.uint8)), offsets


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)


def _frame(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


class _Kinds:
    """What a key sorted before others has, in bounded memory: rows come sorted by key, content and age, slice by slice.

    Rows whose content came before are emitted as repeats at once. The first of each content waits until its key's number of
    contents is known: more than ``hot`` of them need not wait any longer.
    """

    def __init__(self, hot: int):
        self.hot = hot
        self.waiting = tuple(np.zeros(0, np.int64) for _ in range(4))
        self.last, self.gone = None, 0  # the last row's key and content; contents of its key that were emitted already

    def add(self, key: np.ndarray, content: np.ndarray, row: np.ndarray, place: np.ndarray):
        """``(row, place, key, role)`` arrays of what is known after these rows."""
        waited = len(self.waiting[0])
        key, content, row, place = (np.concatenate(x) for x in zip(self.waiting, (key, content, row, place), strict=True))
        new_key = np.append(True, key[1:] != key[:-1])
        new = new_key.copy()
        new[1:] |= content[1:] != content[:-1]
        if not waited and self.last:
            new[0] = self.last != (key[0], content[0])
        group = np.cumsum(new_key) - 1
        kinds = np.bincount(group, weights=new).astype(np.int64)
        if self.last and self.last[0] == key[0]:
            kinds[0] += self.gone
        ends = group == group[-1]
        over = kinds > self.hot
        known = new & np.where(ends, over[-1], kinds[group] > 1)
        wait = new & ends & ~over[-1]
        self.gone = int(kinds[-1]) if over[-1] else 0
        self.last = key[-1], content[-1]
        self.waiting = key[wait], content[wait], row[wait], place[wait]
        out = known | ~new
        return row[out], place[out], key[out], np.where(~new, _FULL, np.where(over[group], _RECUT, _CUT))[out]

    def finish(self):
        key, _, row, place = self.waiting
        some = len(key) > 1
        return (row, place, key, np.full(len(key), _CUT)) if some else tuple(x[:0] for x in (row, place, key, key))


def cut_repeats(docs: DataFrame, min_length: int = 100, anchor: int = 32, hot: int = 20_000, as_text: bool = False) -> DataFrame:
    """``docs`` rows as ``(doc_id, rest, n_bytes, n_removed, n_spans, kept)``; ``rest`` holds the other columns of ``docs``.

    ``kept`` is binary; ``as_text`` makes it a string, without the bytes that are left of a character which a cut halves.
    The three readers of ``base`` take all its columns, so that Spark plans its exchange once. ``min_length`` may be ``anchor`` to 65,536.
    """
    if not anchor <= min_length <= _MAX_LENGTH:
        raise ValueError(f"min_length must be between anchor and {_MAX_LENGTH}")
    ship(docs.sparkSession)
    parts = tasks(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.col("doc_id"))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("body"), rest.alias("rest")).repartition(parts, "row")

    def runs(batches):
        for batch in batches:
            data, offsets = _binary(batch.column("body"))
            which, start, length, key, content = find_runs(data, offsets, min_length, anchor)
            doc, row = _ids(batch.column("doc_id"))[which], batch.column("row").to_numpy()[which]
            order = np.lexsort((start, row, doc, content, key))
            repeat = np.zeros(len(order), bool)
            repeat[1:] = (key[order[1:]] == key[order[:-1]]) & (content[order[1:]] == content[order[:-1]])
            again = np.zeros(len(order), bool)
            again[order] = repeat
            key = np.where(again, _own_key(row), key)  # these only travel back to their document
            place = (start << (_LENGTH_BITS + 1)) | (length << 1) | again
            for i in range(0, len(key), _EMIT):
                s = slice(i, i + _EMIT)
                yield _frame({"key": key[s], "content": content[s], "doc_id": doc[s], "row": row[s], "place": place[s]})

    def match(batches):
        kinds = _Kinds(hot)

        def frames(row, place, key, role):
            for i in range(0, len(key), _EMIT):
                s = slice(i, i + _EMIT)
                yield _frame({"row": row[s], "place": place[s] >> 1, "key": key[s], "role": role[s].astype(np.int8)})

        for batch in batches:
            key, content, row, place = (batch.column(n).to_numpy() for n in ("key", "content", "row", "place"))
            again = (place & 1).astype(bool)
            yield from frames(row[again], place[again], key[again], np.full(again.sum(), _FULL))
            if not again.all():
                yield from frames(*kinds.add(*(x[~again] for x in (key, content, row, place))))
        yield from frames(*kinds.finish())

    def passages(batches):
        for batch in batches:
            rows, docs_, bodies, found = batch.column("row").to_numpy(), _ids(batch.column("doc_id")), batch.column("body"), batch.column("found")
            known: list[tuple[np.ndarray, ...]] = []
            out: dict[str, list] = {n: [] for n in ("key", "doc_id", "row", "begin", "end", "passage")}
            first: dict[bytes, int] = {}  # single strings of this slice, and where the earliest is in ``out``
            for i in range(batch.num_rows):
                runs_ = found[i].values
                place, key, role = (runs_.field(n).to_numpy() for n in ("place", "key", "role"))
                start, length = place >> _LENGTH_BITS, place & ((1 << _LENGTH_BITS) - 1)
                whole = role == _FULL
                if whole.any():
                    a, b = _merge(start[whole], (start + length + min_length - 1)[whole])
                    known.append((np.full(len(a), rows[i]), a, b))
                if whole.all():
                    continue
                body = bodies[i].as_py()
                for a, m, k, r in zip(start[~whole].tolist(), length[~whole].tolist(), key[~whole].tolist(), role[~whole].tolist(), strict=True):
                    if r == _CUT:
                        for n, v in zip(out, (k, docs_[i], rows[i], a, a + m, body[a : a + m + min_length - 1]), strict=True):
                            out[n].append(v)
                        continue
                    own = np.frombuffer(body[a : a + m + min_length - 1], np.uint8)
                    _, at, _, keys, _ = find_runs(own, np.array([0, len(own)]), min_length, min_length, 0x2545F491)
                    for x, k2 in zip((at + a).tolist(), keys.tolist(), strict=True):
                        string = body[x : x + min_length]
                        other = first.setdefault(string, len(out["key"]))
                        if other == len(out["key"]):
                            for n, v in zip(out, (k2, docs_[i], rows[i], x, x + 1, string), strict=True):
                                out[n].append(v)
                            continue
                        later, earlier = (docs_[i], rows[i], x), (out["doc_id"][other], out["row"][other], out["begin"][other])
                        if later < earlier:
                            later, earlier = earlier, later
                            out["doc_id"][other], out["row"][other], out["begin"][other], out["end"][other] = *earlier, earlier[2] + 1
                        known.append((np.array([later[1]]), np.array([later[2]]), np.array([later[2] + min_length])))
            if known:
                row, begin, end = (np.concatenate(x) for x in zip(*known, strict=True))
                yield _frame({"key": _own_key(row), "doc_id": row, "row": row, "begin": begin, "end": end, "passage": pa.nulls(len(row), pa.binary())})
            if out["key"]:
                yield _frame({n: pa.array(x, pa.binary() if n == "passage" else pa.int64()) for n, x in out.items()})

    def expand(batches):
        held, size = [], 0
        for batch in batches:
            known = batch.column("passage").is_null().to_numpy(zero_copy_only=False)
            if known.any():
                yield batch.filter(pa.array(known)).select(["row", "begin", "end"])
                batch = batch.filter(pa.array(~known))
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < _CELL_BYTES:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            at = int(np.flatnonzero(key == key[-1])[0])  # the last key may go on
            if at:
                yield from cells(table.slice(0, at))
            held = table.slice(at).combine_chunks().to_batches()
            size = sum(x.nbytes for x in held) if at else 0  # a long cell is joined up again only after as much more has come
        if held:
            yield from cells(pa.Table.from_batches(held))

    def cells(table):
        key, row, begin, end = (table.column(n).to_numpy() for n in ("key", "row", "begin", "end"))
        passage = table.column("passage").combine_chunks()
        for some in _by_cell(key, (end - begin) + min_length):
            length = end[some] - begin[some]
            marked = repeated_starts(passage.take(pa.array(some)).to_pylist(), length, min_length)
            base_of = np.cumsum(length) - length
            # a gap after each run keeps spans inside their run
            flags = np.zeros(len(marked) + len(some), bool)
            flags[np.arange(len(marked)) + np.repeat(np.arange(len(some)), length)] = marked
            a, b = _spans(flags)
            run = np.searchsorted(base_of + np.arange(len(some)), a, "right") - 1
            shift = begin[some][run] - base_of[run] - run
            yield _frame({"row": row[some][run], "begin": a + shift, "end": b + shift + min_length - 1})

    def finish(batches):
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept")}
            bodies, spans = batch.column("body"), batch.column("spans")
            for i in range(batch.num_rows):
                body = bodies[i].as_py() or b""
                removed = count = 0
                kept = body
                if spans[i].is_valid:
                    own = spans[i].values
                    begin, end = _merge(own.field("begin").to_numpy(), own.field("end").to_numpy())
                    removed, count = int((end - begin).sum()), len(begin)
                    kept = b"".join(body[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(body)], strict=True))
                if as_text:
                    kept = kept.decode("utf-8", "ignore")
                for n, x in zip(out, (len(body), removed, count, kept), strict=True):
                    out[n].append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rest"), *(pa.array(out[n], pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept"], pa.string() if as_text else pa.binary())], ["doc_id", "rest", *out])

    found = base.mapInArrow(task(runs, "powers"), "key long, content long, doc_id long, row long, place long").repartition(parts, "key").sortWithinPartitions("key", "content", "doc_id", "row", "place").select("key", "content", "row", "place").mapInArrow(task(match, rows=_EMIT), "row long, place long, key long, role byte")
    by_row = found.groupBy("row").agg(F.collect_list(F.struct("place", "key", "role")).alias("found"))
    cut = base.join(by_row.hint("shuffle_hash"), "row").select("row", "doc_id", "body", "rest", "found").mapInArrow(task(passages, "powers"), "key long, doc_id long, row long, begin long, end long, passage binary")
    marks = cut.repartition(parts, "key").sortWithinPartitions("key", "doc_id", "row", "begin").mapInArrow(task(expand), "row long, begin long, end long")
    spans = marks.groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    schema = T.StructType([base.schema["doc_id"], base.schema["rest"]]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "string" if as_text else "binary")
    return base.join(spans.hint("shuffle_hash"), "row", "left").select("row", "doc_id", "body", "rest", "spans").mapInArrow(task(finish), schema)


def _own_key(row: np.ndarray) -> np.ndarray:
    return row * 0x5851F42D + 7


def _by_cell(key: np.ndarray, cost: np.ndarray):
    """Index arrays of whole keys with about ``_CELL_BYTES`` each."""
    order = np.argsort(key, kind="stable")
    heads = np.flatnonzero(np.append(True, key[order[1:]] != key[order[:-1]]))
    total = np.add.reduceat(cost[order], heads)
    begin, used = 0, 0
    for i, x in enumerate(total):
        if used and used + x > _CELL_BYTES:
            yield order[heads[begin] : heads[i]]
            begin, used = i, 0
        used += x
    yield order[heads[begin] :]


def repeats_table(docs: DataFrame, min_length: int = 100) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row."""
    return cut_repeats(docs.select("doc_id", "text"), min_length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, min_length: int = 100) -> DataFrame:
    """``docs`` with repeated passages cut from ``text`` (null texts stay null) and ``n_chars`` counted anew where it exists.

    A cut may fall inside a character; the bytes that are left of it are dropped.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    null = "_" * (1 + max(map(len, docs.columns)))
    cut = cut_repeats(docs.select("*", F.col("text").isNull().alias(null)), min_length, as_text=True)
    out = cut.select("doc_id", *[F.col("rest").getField(c).alias(c) for c in others], F.when(~F.col("rest").getField(null), F.col("kept")).alias("text"))
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
