"""Token counts and token ids by a byte-level BPE vocabulary (operator 4; feeds operator 8).

Whole-token shortcut: a merge never crosses a pre-token, so a pre-token that the library encodes alone as one
token is that token wherever it stands. Which strings of the vocabulary are such is proven once, on the driver before
the job (each is encoded alone), and the proven table goes to the workers with the plan. Texts are cut into
pre-tokens by array operations on their characters' classes, pre-tokens are counted by hash, the proven ones are
looked up, and only the distinct rest goes through the library's merges; a bounded table remembers them.

A text goes to the library whole if it holds a special token's string or a character outside the ranges for
which the class table is proven (see CLASSES), and for vocabularies of another kind all texts do.

Defined results: null counts as empty; the empty text has no tokens; rows that repeat are counted each; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, as_text, mapped, text_chunks
from .rolling import U, Prefix

L, N, O, S, UNSURE = 0, 1, 2, 3, 4
#: Pre-tokens that a worker remembers before it starts afresh.
MEMORY = 500_000
#: Text bytes at once: more than elsewhere, since the table of words is merged with new ones once a chunk.
CHUNK = 1 << 20
#: The pre-token pattern for which the array form below is written (fixed value of the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Character ranges whose classes are proven against the library by a test over all of them.
CLASSES = ((0x0, 0x250), (0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20AD))


def _class_table() -> np.ndarray:
    table = np.full(0x2101, UNSURE, np.uint8)
    for lo, hi in CLASSES:
        for c in range(lo, hi):
            ch = chr(c)
            table[c] = L if regex.match(r"\p{L}", ch) else N if regex.match(r"\p{N}", ch) else S if regex.match(r"\p{White_Space}", ch) else O
    return table


_CLASS = _class_table()


def _characters(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Byte place and code point of each character (0x2100 stands for any from there on)."""
    b = t.buf
    at = np.flatnonzero((b & 0xC0) != 0x80)
    lead = b[at].astype(np.int32)
    code = lead.copy()
    padded = np.concatenate((b, np.zeros(3, np.uint8)))
    two = lead >= 0xC0
    if two.any():
        i = at[two]
        x, y, z = lead[two], padded[i + 1].astype(np.int32) & 0x3F, padded[i + 2].astype(np.int32) & 0x3F
        code[two] = np.where(x < 0xE0, ((x & 0x1F) << 6) | y, np.where(x < 0xF0, ((x & 0x0F) << 12) | (y << 6) | z, 0x2100))
    return at, np.minimum(code, 0x2100)


def pretoken_starts(at: np.ndarray, code: np.ndarray, t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Whether a pre-token starts at each character, and each character's class."""
    n = len(code)
    cls = _CLASS[code]
    if not n:
        return np.zeros(0, bool), cls
    opens = np.zeros(n + 1, bool)  # first character of a text
    opens[np.searchsorted(at, t.starts[t.starts < t.ends])] = True
    opens[n] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = UNSURE + 1, cls[:-1]
    before[opens[:n]] = UNSURE + 1
    blank = np.zeros(n, bool)  # a plain space stands before, in the same text
    blank[1:] = code[:-1] == 0x20
    blank[opens[:n]] = False
    start = (cls != before) & ~((cls != S) & blank)
    # the last blank of a run is apart if a character of the same text follows
    follows = np.zeros(n, bool)
    follows[:-1] = (cls[1:] != S) & ~opens[1:n]
    start |= (cls == S) & follows
    # contractions
    quote = np.flatnonzero((code == 0x27) & (before != O) & ~blank)
    if len(quote):
        far = np.concatenate((code, np.zeros(3, code.dtype)))
        end = np.concatenate((opens, np.ones(3, bool)))
        a, b = far[quote + 1], far[quote + 2]
        one = ~end[quote + 1] & np.isin(a, [ord(c) for c in "stmd"])
        two = ~end[quote + 1] & ~end[quote + 2] & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for at_, w in ((quote[one], 2), (quote[two], 3)):
            start[at_ + 1] = False
            nxt = at_ + w
            start[nxt[nxt < n]] = True
    return start, cls


class Vocabulary:
    """A tokenizer file with its proven whole tokens and a bounded memory of other pre-tokens."""

    def __init__(self, path: str, proven: tuple[np.ndarray, np.ndarray] | None = None):
        self.path = path
        if path.endswith(".model"):
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole: Callable = lambda texts: [np.asarray(x, np.uint32) for x in p.encode(texts, num_threads=1)]
            self.shortcut = False
            return
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives a task one core
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.whole = lambda texts: [np.asarray(e.ids, np.uint32) for e in self.lib.encode_batch(texts, add_special_tokens=False)]
        pre = self.lib.pre_tokenizer
        kind = type(pre).__name__ if pre is not None else ""
        self.shortcut = kind == "ByteLevel" and not pre.add_prefix_space and pre.use_regex and self.lib.normalizer is None
        if self.shortcut:
            self.special = [s.content.encode() for s in self.lib.get_added_tokens_decoder().values()]
            self.table = keys, ids = proven or self._prove()
            self.proven = len(keys)
            self.first = (keys, np.ones(len(keys), np.int64), np.arange(len(keys)), ids)
            self._set(*self.first)

    def _prove(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes (ascending) and ids of the vocabulary's strings that encode alone as one token."""
        strings = [self.lib.decoder.decode([piece]) for piece in self.lib.get_vocab(with_added_tokens=False)]
        strings = sorted({s for s in strings if s and "�" not in s and not any(x.decode() in s for x in self.special)})
        ids = [e.ids for e in self.lib.encode_batch(strings, add_special_tokens=False)]
        good = [(s.encode(), i[0]) for s, i in zip(strings, ids, strict=True) if len(i) == 1]
        keys = hashes([s for s, _ in good])
        order = np.argsort(keys)
        return keys[order], np.asarray([i for _, i in good], np.uint32)[order]

    def _set(self, keys, sizes, offsets, ids) -> None:
        self.keys, self.sizes, self.offsets, self.ids = keys, sizes, offsets, ids

    def lookup(self, keys: np.ndarray, word: Callable[[int], bytes]) -> np.ndarray:
        """Row of each (distinct) key in the table; unknown words are merged by the library and remembered."""
        if len(self.keys) > MEMORY:
            self._set(*self.first)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        new = np.flatnonzero(self.keys[at] != keys)
        if len(new):
            e = self.lib.encode([word(i).decode() for i in new], is_pretokenized=True, add_special_tokens=False)
            sizes = np.bincount(np.asarray(e.word_ids, np.int64), minlength=len(new))
            ids = np.concatenate((self.ids, np.asarray(e.ids, np.uint32)))
            offsets = len(self.ids) + np.cumsum(sizes) - sizes
            place = np.searchsorted(self.keys, keys[new])  # both are sorted: new rows are put in between
            self._set(np.insert(self.keys, place, keys[new]), np.insert(self.sizes, place, sizes), np.insert(self.offsets, place, offsets), ids)
            at = np.searchsorted(self.keys, keys)
        return at

    def encode(self, t: Texts, want_ids: bool) -> tuple[np.ndarray, list[np.ndarray] | None]:
        """Tokens of each text: their number, and their ids if wanted."""
        counts = np.zeros(t.n, np.int64)
        out: list = [np.zeros(0, np.uint32)] * t.n
        if not self.shortcut:
            out = self.whole([t.of(i).decode() for i in range(t.n)])
            return np.asarray([len(x) for x in out], np.int64), out
        at, code = _characters(t)
        start, cls = pretoken_starts(at, code, t)
        odd = np.unique(np.searchsorted(t.ends, at[cls == UNSURE], side="right"))
        blob = t.buf.tobytes()
        marked = {int(np.searchsorted(t.ends, m, side="right")) for s in self.special for m in _finds(blob, s)}
        hard = np.zeros(t.n, bool)
        hard[odd] = True
        hard[list(marked)] = True
        begin = at[start]
        if len(begin):
            stop = np.concatenate((begin[1:], [len(t.buf)]))
            doc = np.searchsorted(t.ends, begin, side="right")
            keys = Prefix(t.buf).of(begin, stop)
            if hard.any():
                easy = ~hard[doc]
                begin, stop, doc, keys = begin[easy], stop[easy], doc[easy], keys[easy]
        if len(begin):
            distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
            row = self.lookup(distinct, lambda i: t.buf[begin[first[i]] : stop[first[i]]].tobytes())[back]
            size = self.sizes[row]
            counts = np.bincount(doc, weights=size, minlength=t.n).astype(np.int64)
            if want_ids:
                ends = np.cumsum(size)
                ids = self.ids[np.repeat(self.offsets[row] - ends + size, size) + np.arange(ends[-1])]
                out = np.split(ids, np.cumsum(counts)[:-1])
        if hard.any():
            which = np.flatnonzero(hard)
            for i, x in zip(which, self.whole([t.of(i).decode() for i in which]), strict=True):
                counts[i] = len(x)
                out[i] = x
        return counts, out


def _finds(blob: bytes, s: bytes) -> Iterator[int]:
    i = blob.find(s)
    while i >= 0:
        yield i
        i = blob.find(s, i + 1)


def hashes(words: list[bytes]) -> np.ndarray:
    sizes = np.asarray([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    buf = np.frombuffer(b"".join(words), np.uint8)
    return Prefix(buf).of(ends - sizes, ends) if len(words) else np.zeros(0, U)


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str, proven: tuple[np.ndarray, np.ndarray] | None = None) -> Vocabulary:
    """The vocabulary of this process; a worker takes the driver's proof."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path, proven)
    return _loaded[path]


def proof(path: str) -> tuple[np.ndarray, np.ndarray] | None:
    v = vocabulary(path)
    return v.table if v.shortcut else None


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    proven = proof(path)

    def run(batches):
        v = vocabulary(path, proven)
        for batch, t in text_chunks(batches, "text", CHUNK):
            n, _ = v.encode(t, False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t.ends - t.starts), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("id"), as_text(F.col(text)).alias("text"))
    return mapped(rows, run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids and end_id, cut into pieces of capacity if longer (the first piece may be shorter).

    id, piece, start, length, ids_crc32 and, if wanted, ids.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    proven = proof(path)

    def run(batches):
        v = vocabulary(path, proven)
        for batch, t in text_chunks(batches, "text", CHUNK):
            counts, all_ids = v.encode(t, True)
            total = counts + 1
            pieces = -(-total // capacity)
            doc = np.repeat(np.arange(t.n), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = total - (pieces - 1) * capacity
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[doc], capacity)
            crc, kept = np.zeros(len(doc), np.int64), []
            ended = [np.append(ids, np.uint32(end_id)).astype("<u4") for ids in all_ids]
            for i, (d, s, n) in enumerate(zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)):
                part = ended[d][s : s + n]
                crc[i] = zlib.crc32(part.tobytes())
                if with_ids:
                    kept.append(part)
            cols = [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array([x.tolist() for x in kept], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    rows = docs.select(F.col(id_col).alias("id"), as_text(F.col(text)).alias("text"))
    return mapped(rows, run, schema).withColumnRenamed("id", id_col)
