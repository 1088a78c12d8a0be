"""SentencePiece encoding and decoding for merge-type vocabularies (operator 12).

An agenda holds a text's adjacent pairs of symbols whose concatenation is a piece. The pair of the highest score is
merged, of equal ones the leftmost; its neighbours' pairs enter the agenda; when it is empty, the symbols are the
pieces, and a character that is none becomes its UTF-8 bytes' pieces.

No merge can join two characters that stand side by side in no piece, so texts fall into units at such places, proven
from the vocabulary alone, and a unit is encoded once a worker: a bounded table remembers it. The short new units of
an Arrow batch are merged side by side, one pop of each agenda at a time as array operations; long ones by a heap.

All new units of a batch are also encoded and decoded by the sentencepiece library, in one call, divided by a character
that is in no longer piece. Where it differs, its ids are taken and checked is false for the rows that hold the unit.

Only what the method covers is accepted, anything else is a ValueError: type BPE, byte fallback, identity
normalisation with a leading blank, blanks kept, no user-defined or unused pieces.

Defined results: null counts as empty; the empty text has the end id alone and decodes to the empty text; rows that
repeat are encoded each; strings of special pieces in a text are ordinary text; other columns are ignored; an
empty table gives an empty table. Whole texts are encoded, whatever their length.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, as_text, mapped, text_chunks

BLANK = 0x2581
#: Units of up to so many characters are merged side by side.
SHORT = 64
#: Units that a worker remembers before it starts afresh.
MEMORY = 400_000
#: Text bytes at once: more than elsewhere, since new units are merged together once a chunk.
CHUNK = 1 << 20
_PLACE = 7  # bits for a place in a short unit


def concatenated(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data[starts[i]:starts[i] + sizes[i]] for i in which, one after the other, and where each ends."""
    size = sizes[which]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.repeat(starts[which] - ends + size, size) + np.arange(total)], ends


class Pieces:
    """A sentencepiece model of merge type with its tables and the memory of units."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto.FromString(self.lib.serialized_model_proto())
        norm, trained = model.normalizer_spec, model.trainer_spec
        kinds = pb.ModelProto.SentencePiece
        odd = {p.type for p in model.pieces} - {kinds.NORMAL, kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE}
        if trained.model_type != pb.TrainerSpec.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix or odd:
            raise ValueError("not a merge-type vocabulary with byte fallback")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only identity normalisation with a leading blank is known")
        self.n = len(model.pieces)
        self.end = self.lib.eos_id()
        texts = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.bytes = np.zeros(256, np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
        self.rank = np.unique(np.asarray([p.score for p in model.pieces]), return_inverse=True)[1].astype(np.int64)
        self._symbols(texts)
        self._outputs(model, kinds)
        self._forget()

    def _symbols(self, texts: dict[str, int]) -> None:
        """Characters' symbols and classes, which classes may stand side by side, and the pairs that merge."""
        longer = [t for t in texts if len(t) > 1]
        inner = sorted(set("".join(longer)))
        self.extra = [c for c in inner if c not in texts]  # in pieces, yet none alone
        symbol = texts | {c: self.n + k for k, c in enumerate(self.extra)}
        self.char = -1 - np.arange(0x110000)  # negative: no symbol of any pair
        for t, i in symbol.items():
            if len(t) == 1:
                self.char[ord(t)] = i
        self.cls = np.zeros(0x110000, np.int32)
        for k, c in enumerate(inner):
            self.cls[ord(c)] = k + 1
        self.beside = np.zeros((len(inner) + 1,) * 2, bool)
        place = {c: k + 1 for k, c in enumerate(inner)}
        for t in longer:
            for a, b in zip(t, t[1:], strict=False):
                self.beside[place[a], place[b]] = True
        self.width = self.n + len(self.extra)
        pairs = {symbol[t[:j]] * self.width + symbol[t[j:]]: i for t, i in texts.items() for j in range(1, len(t)) if t[:j] in symbol and t[j:] in symbol}
        self.keys = np.asarray(sorted(pairs), np.int64)
        self.merged = np.asarray([pairs[k] for k in self.keys.tolist()], np.int64)
        self.pair_of = pairs
        self.divider = next(c for c in "\n\x00\x01\x02\x03" if not self.cls[ord(c)] and self.char[ord(c)] < 0)

    def _outputs(self, model, kinds) -> None:
        out = []
        for i, p in enumerate(model.pieces):
            out.append(bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else b"" if p.type == kinds.CONTROL else p.piece.replace(chr(BLANK), " ").encode() if p.type == kinds.NORMAL else self.lib.decode([i]).encode())
        self.out_size = np.asarray([len(x) for x in out], np.int64)
        self.out_start = np.cumsum(self.out_size) - self.out_size
        self.out = np.frombuffer(b"".join(out), np.uint8)

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.starts, self.sizes, self.agrees = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each two symbols make, or -1."""
        key = np.where((left >= 0) & (right >= 0), left * self.width + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def _side_by_side(self, sym: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of short units when their agendas are empty; each round pops the best pair of every unit."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        piece = np.full(len(sym), -1, np.int64)
        piece[:-1] = np.where(unit[:-1] == unit[1:], self._pair(sym[:-1], sym[1:]), -1)
        full = (1 << _PLACE) - 1
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            count = np.diff(np.append(first, len(sym)))
            place = np.arange(len(sym)) - np.repeat(first, count)
            best = np.maximum.reduceat(np.where(piece >= 0, (self.rank[piece] << _PLACE) + full - place, -1), first)
            going = best >= 0
            if not going.all():
                on = np.repeat(going, count)
                done.append((sym[~on], unit[~on]))
                sym, unit, piece = sym[on], unit[on], piece[on]
                first, best = (np.cumsum(count[going]) - count[going]), best[going]
            if not len(sym):
                break
            at = first + full - (best & full)
            sym[at] = piece[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, unit, piece = sym[keep], unit[keep], piece[keep]
            at = at - np.arange(len(at))
            for i in (at - 1, at):  # the pairs on both sides of the merged one
                i = i[(i >= 0) & (i + 1 < len(sym))]
                piece[i] = np.where(unit[i] == unit[i + 1], self._pair(sym[i], sym[i + 1]), -1)
            piece[-1] = -1
        if not done:
            return sym, unit
        sym, unit = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(unit, kind="stable")
        return sym[order], unit[order]

    def _by_heap(self, sym: list[int]) -> list[int]:
        """One long unit's symbols when its agenda is empty."""
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        gone, made = [False] * n, [0] * n
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, put) -> None:
            j = right[i]
            if j < n and sym[i] >= 0 and sym[j] >= 0:
                p = self.pair_of.get(sym[i] * self.width + sym[j])
                if p is not None:
                    put((-int(self.rank[p]), i, j, p, made[i] + made[j]))

        for i in range(n - 1):
            offer(i, agenda.append)
        heapify(agenda)
        while agenda:
            _, i, j, p, then = heappop(agenda)
            if gone[i] or gone[j] or right[i] != j or then != made[i] + made[j]:  # one of both was merged meanwhile
                continue
            sym[i], gone[j] = p, True
            made[i] += made[j] + 1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] < n:
                    offer(k, lambda x: heappush(agenda, x))
        return [s for s, g in zip(sym, gone, strict=True) if not g]

    def _encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units (UTF-32), one after the other, and their numbers."""
        sizes = np.asarray([len(u) >> 2 for u in units], np.int64)
        sym = self.char[np.frombuffer(b"".join(units), np.uint32)]
        ends = np.cumsum(sizes)
        short = np.repeat(sizes <= SHORT, sizes)
        unit = np.repeat(np.arange(len(units)), sizes)
        parts = [self._side_by_side(sym[short], unit[short])]
        for i in np.flatnonzero(sizes > SHORT).tolist():
            got = self._by_heap(sym[ends[i] - sizes[i] : ends[i]].tolist())
            parts.append((np.asarray(got, np.int64), np.full(len(got), i)))
        sym, unit = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(unit, kind="stable")
        sym, unit = sym[order], unit[order]
        rest = np.flatnonzero((sym < 0) | (sym >= self.n))  # characters that are no piece: their bytes
        if len(rest):
            chars = [chr(-1 - s) if s < 0 else self.extra[s - self.n] for s in sym[rest].tolist()]
            raw = [c.encode("utf-8") for c in chars]
            n = np.ones(len(sym), np.int64)
            n[rest] = [len(x) for x in raw]
            wide = np.repeat(sym, n)
            wide[np.repeat((sym < 0) | (sym >= self.n), n)] = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
            sym, unit = wide, np.repeat(unit, n)
        return sym, np.bincount(unit, minlength=len(units))

    def _checked(self, units: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids and sizes as the library has them, and which units agree."""
        blank, mark = int(self.char[BLANK]), int(self.bytes[ord(self.divider)])
        wall = self.divider.encode("utf-32-le")
        joined = (wall + wall.join(units)).decode("utf-32-le")
        ends = np.cumsum(sizes)
        mine = np.concatenate(([blank], np.insert(ids, ends - sizes, mark)))
        theirs = self.lib.encode_as_numpy(joined, num_threads=1)
        if np.array_equal(mine, theirs) and self.decode(mine) == self.lib.decode(theirs):
            return ids, sizes, np.ones(len(units), bool)
        each, good = [], np.zeros(len(units), bool)
        for i, t in enumerate(u.decode("utf-32-le") for u in units):
            each.append(np.asarray(self.lib.encode(self.divider + t, num_threads=1)[2:], np.int64))
            good[i] = np.array_equal(each[-1], ids[ends[i] - sizes[i] : ends[i]])
        return np.concatenate(each), np.asarray([len(x) for x in each], np.int64), good

    def _rows(self, units: list[bytes]) -> np.ndarray:
        """Places of units in the memory; new ones are encoded, checked and remembered."""
        if len(self.known) > MEMORY:
            self._forget()
        get = self.known.get
        row = np.fromiter((get(u, -1) for u in units), np.int64, len(units))
        fresh = np.flatnonzero(row < 0)
        if len(fresh):
            new = [units[i] for i in fresh.tolist()]
            ids, sizes, good = self._checked(new, *self._encode_units(new))
            starts = len(self.ids) + np.cumsum(sizes) - sizes
            row[fresh] = np.arange(len(self.sizes), len(self.sizes) + len(new))
            self.known.update(zip(new, row[fresh].tolist(), strict=True))
            self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
            self.starts, self.sizes, self.agrees = np.concatenate((self.starts, starts)), np.concatenate((self.sizes, sizes)), np.concatenate((self.agrees, good))
        return row

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts with an end id each, one after the other, where each text's end, and whether the library agrees."""
        lead = (t.buf & 0xC0) != 0x80
        chars = np.concatenate(([0], np.cumsum(lead)))
        cut = chars[t.starts]
        some = t.starts < t.ends
        cps = np.frombuffer(t.buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        cps = np.insert(cps, cut[some], BLANK)  # the leading blank of each text
        begin = cut[some] + np.arange(int(some.sum()))
        cps[cps == 0x20] = BLANK
        if not len(cps):
            return np.full(t.n, self.end, np.int32), np.arange(1, t.n + 1), np.ones(t.n, bool)
        cls = self.cls[cps]
        opens = np.ones(len(cps), bool)
        opens[1:] = ~self.beside[cls[:-1], cls[1:]]
        opens[begin] = True
        at = np.flatnonzero(opens)
        offsets = np.append(at, len(cps)).astype(np.int64) * 4
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(cps)]).dictionary_encode()
        row = self._rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        text = np.flatnonzero(some)[np.searchsorted(begin, at, side="right") - 1]
        ids, ends = concatenated(self.ids, self.starts, self.sizes, row)
        counts = np.bincount(text, weights=self.sizes[row], minlength=t.n).astype(np.int64)
        stops = np.cumsum(counts)
        agrees = np.bincount(text, weights=~self.agrees[row], minlength=t.n) == 0
        return np.insert(ids, stops, self.end).astype(np.int32), stops + np.arange(1, t.n + 1), agrees

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces one after the other without the leading blank; broken bytes become U+FFFD."""
        raw = concatenated(self.out, self.out_start, self.out_size, ids)[0].tobytes()
        return raw.removeprefix(b" ").decode("utf-8", "replace")

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        raw, at = concatenated(self.out, self.out_start, self.out_size, ids)
        stop = np.concatenate(([0], at))[ends].tolist()
        blob = raw.tobytes()
        return [blob[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b in zip([0, *stop[:-1]], stop, strict=True)]


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The model of this process."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, ids (with the end id), decoded, checked for each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    pieces(path)  # a model of another kind is an error of the driver, not of its tasks

    def run(batches):
        model = pieces(path)
        for batch, t in text_chunks(batches, "text", CHUNK):
            ids, ends, agrees = model.encode(t)
            offsets = np.concatenate(([0], ends)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(model.decode_all(ids, ends), pa.string()), pa.array(agrees)], ["id", "ids", "decoded", "checked"])

    rows = docs.select(F.col(id_col).alias("id"), as_text(F.col(text)).alias("text"))
    return mapped(rows, run, f"id {kind}, ids array<int>, decoded string, checked boolean").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """id, decoded for rows with a column of ids (null: none)."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        model = pieces(path)
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.decode_all(flat, ends), pa.string())], ["id", "decoded"])

    return mapped(rows.select(F.col(id_col).alias("id"), F.col(ids).cast("array<int>").alias("ids")), run, f"id {kind}, decoded string").withColumnRenamed("id", id_col)
