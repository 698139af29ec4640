"""Packing token streams into fixed windows by order-preserving dynamic programming.

Documents are taken in the order of their partition and form one stream. Cuts may fall after a document (free),
after a sentence or, at a higher price, inside one. best[j] = penalty[j] + min over i within the window of best[i]
+ padding; the padding is linear in the positions, so the minimum is kept by a monotone queue in constant time per
cut. The stream is cut in stretches of STRETCH tokens; the last window of a stretch is left to the next one, so
memory is bounded and only the last sequence of a partition can be short.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeline.llm.tokens import _BYTE, NOT_SPACE, _powers, blocks, few_rows, mix

CAPACITY = 2048
#: Price in tokens of padding of a cut after a sentence and inside one; spacing of the cuts offered inside long ones.
SENTENCE, INSIDE, SPACING = 2, 8, 32
STRETCH = 1 << 18
END_ID = 1
#: A character that stands between chunks encoded together, and chunks in one call.
MARK, TOGETHER = "\x01", 200
#: Bytes that end a sentence.
STOPS = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
#: Bytes by class: 0 white space, 1 letters of any kind, 2 digits, 3 the rest.
CLASS = np.full(256, 3, np.uint8)
CLASS[~NOT_SPACE], CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]], CLASS[0x30:0x3A] = 0, 1, 2
#: The letters by which byte-level models name bytes: printable ones stand for themselves, the rest from 0x100 up.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_NAMES = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Pieces of text whose ids a worker remembers (about 60 bytes each).
MEMORY = 400_000

# How a tokenizers file must say that it drops white space, lower-cases and takes runs of letters, single
# digits and runs of other characters for themselves. Texts for a file that says otherwise are encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLITS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def splits_by_pieces(config: dict) -> bool:
    """Whether a tokenizers file does what PieceTokenizer relies on."""
    names = [t["content"] for t in config.get("added_tokens") or ()]
    model = config.get("model") or {}
    return (
        config.get("normalizer") == NORMALIZER and config.get("pre_tokenizer") == PRE_TOKENIZER and all(n.startswith("<|") and not any(map(str.isspace, n)) for n in names)
        and not any(config.get(k) for k in ("truncation", "padding")) and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "byte_fallback", "unk_token"))
    )


class _Numbers:
    """Numbers of 64-bit hashes: a table with open addresses, searched and filled for many at a time."""

    def __init__(self) -> None:
        self.used = 0
        self._grow(1 << 16)

    def _grow(self, size: int) -> None:
        self.hash, self.number, self.mask = np.zeros(size, np.uint64), np.full(size, -1, np.int64), np.uint64(size - 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each hash, or -1."""
        out, open_, slot = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), hashes & self.mask
        while len(open_):
            number = self.number[slot]
            hit = (number >= 0) & (self.hash[slot] == hashes[open_])
            out[open_[hit]] = number[hit]
            go = (number >= 0) & ~hit
            open_, slot = open_[go], (slot[go] + np.uint64(1)) & self.mask
        return out

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct hashes that are not in the table."""
        self.used += len(hashes)
        if 2 * self.used > len(self.hash):
            full = self.number >= 0
            hashes, numbers = np.concatenate((self.hash[full], hashes)), np.concatenate((self.number[full], numbers))
            self._grow(1 << (4 * self.used).bit_length())
        slot = hashes & self.mask
        while len(hashes):
            free = self.number[slot] < 0
            self.number[slot[free]] = numbers[free]
            got = self.number[slot] == numbers
            self.hash[slot[got]] = hashes[got]
            hashes, numbers, slot = hashes[~got], numbers[~got], (slot[~got] + np.uint64(1)) & self.mask


class PieceTokenizer:
    """Ids of texts through a tokenizers file; runs of letters, digits and other runs are encoded once each.

    What bytes can't tell (letters that change under lower-casing or normalisation, other scripts' marks, apostrophes,
    names of special tokens) is left to the library, a chunk between spaces at a time. A file that isn't made this way
    (`splits_by_pieces`) is used text by text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_pieces = splits_by_pieces(json.load(f))
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        """Piece 0 is the end of a text, piece 1 has no ids."""
        self.known, self.chunks = _Numbers(), {}
        self.count, self.at = np.array([1, 0], np.int64), np.array([0, 1], np.int64)
        self.left = np.zeros(2, bool)  # to the library
        self.ids = np.array([END_ID], np.uint32)

    def _piece(self, piece: bytes) -> list[int] | None:
        """Ids of a run of one class, None if the library must see its chunk."""
        if piece.isalpha():
            plain = piece.decode()
            if not piece.islower():
                return None
        elif piece.isascii():
            if b"'" in piece or b"<|" in piece or min(piece) < 0x21 or max(piece) > 0x7E:
                return None
            plain = piece.decode()
        else:
            text = piece.decode("utf-8", "replace")
            if not text.isalpha() or text != text.lower() or not is_normalized("NFC", text):
                return None
            plain = piece.decode("latin-1").translate(BYTE_NAMES)
        return [t.id for t in self.tokenizer.model.tokenize(plain)]

    def _by_library(self, chunks: list[str]) -> list[list[int]]:
        out: list = []
        for lo in range(0, len(chunks), TOGETHER):
            own = chunks[lo : lo + TOGETHER]
            if len(self.mark) == 1 and not any(MARK in c for c in own):
                # one call for all: the mark, itself a chunk of one id that no chunk holds, tells them apart
                ids, at = self.tokenizer.encode(f" {MARK} ".join([*own, MARK]), add_special_tokens=False).ids, 0
                for _ in own:
                    end = ids.index(self.mark[0], at)
                    out.append(ids[at:end])
                    at = end + 1
            else:
                out += [e.ids for e in self.tokenizer.encode_batch(own, add_special_tokens=False)]
        return out

    def _keep(self, new: list[list[int] | None]) -> np.ndarray:
        """Numbers of new pieces or chunks."""
        first = len(self.count)
        ids = [x or () for x in new]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        self.left = np.concatenate((self.left, np.fromiter((x is None for x in new), bool, len(new))))
        self.at = np.concatenate((self.at, len(self.ids) + np.cumsum(counts) - counts))
        self.count = np.concatenate((self.count, counts))
        self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum()))))
        return np.arange(first, first + len(new))

    def _whole(self, chunks: list[bytes]) -> np.ndarray:
        new = list(dict.fromkeys(c for c in chunks if c not in self.chunks))
        if new:
            numbers = self._keep(self._by_library([c.decode("utf-8", "surrogatepass") for c in new]))
            self.chunks.update(zip(new, numbers.tolist(), strict=True))
        return np.fromiter(map(self.chunks.__getitem__, chunks), np.int64, len(chunks))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by END_ID; first id of each text and the end; positions after a sentence."""
        if not self.by_pieces:
            return self._text_by_text(texts)
        if not any(b"<|" in t for t in texts):  # the names of special tokens tell case apart, nothing else does
            texts = [t.lower() for t in texts]
        if len(self.count) > MEMORY:
            self._clear()
        data = b" ".join(texts) + b" "
        raw = np.frombuffer(data, np.uint8)
        kind = CLASS[raw]
        before = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))
        start = np.flatnonzero((kind != 0) & ((kind != before) | (kind == 2)))
        head = before[start] == 0  # of a chunk
        inside = np.flatnonzero(kind != 0)
        first = np.searchsorted(inside, start)
        length = np.diff(first, append=len(inside))
        end = start + length
        hashes = mix(np.add.reduceat(_BYTE[raw[inside]] * _powers(int(length.max()))[np.arange(len(inside)) - np.repeat(first, length)], first) + length.astype(np.uint64)) if len(start) else np.empty(0, np.uint64)
        piece = self.known.find(hashes)
        missing = np.flatnonzero(piece < 0)
        if len(missing):
            names, where, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            spans = zip(start[missing[where]].tolist(), end[missing[where]].tolist(), strict=True)
            numbers = self._keep([self._piece(data[i:j]) for i, j in spans])
            self.known.add(names, numbers)
            piece[missing] = numbers[back]
        left = self.left[piece]
        if left.any():
            chunk = np.cumsum(head) - 1
            heads = np.flatnonzero(head)
            last = np.append(heads[1:], len(piece)) - 1
            wanted = np.unique(chunk[left])
            mine = np.zeros(len(heads), bool)
            mine[wanted] = True
            piece[mine[chunk]] = 1
            piece[heads[wanted]] = self._whole([data[i:j] for i, j in zip(start[heads[wanted]].tolist(), end[last[wanted]].tolist(), strict=True)])
        closes = np.append(head[1:], True) if len(head) else head
        stops = closes & (STOPS[raw[end - 1]] | (raw[np.minimum(end, len(raw) - 1)] == 10)) if len(end) else np.empty(0, bool)
        offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))
        at = np.searchsorted(start, offsets)
        piece, stops = np.insert(piece, at[1:], 0), np.insert(stops, at[1:], False)
        counts = self.count[piece]
        ends = np.cumsum(counts)
        ids = self.ids[np.repeat(self.at[piece] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.concatenate(([0], ends[at[1:] + np.arange(len(texts))])), ends[stops]

    def _text_by_text(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = [[*e.ids, END_ID] for e in self.tokenizer.encode_batch([t.decode("utf-8", "surrogatepass") for t in texts], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(own), np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int64), np.empty(0, np.int64)


def best_cuts(positions: list[int], penalties: list[int], capacity: int = CAPACITY, open_end: bool = False) -> list[int]:
    """Indexes of the cuts that minimise padding plus penalties, from position 0 to the last one.

    positions ascend, no two neighbours are further apart than capacity. With open_end the last cut may be any
    in the last window, whichever costs least.
    """
    value, came = [0] * (len(positions) + 1), [0] * (len(positions) + 1)
    at = [0, *positions]
    queue, head = [0], 0
    for j in range(1, len(at)):
        p = at[j]
        low = p - capacity
        while at[queue[head]] < low:
            head += 1
        i = queue[head]
        came[j] = i
        value[j] = v = value[i] + at[i] + capacity - p + penalties[j - 1]
        v += p
        while len(queue) > head and value[queue[-1]] + at[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    out, j = [], len(positions)
    if open_end:
        near = [i for i in range(len(at) - 1, 0, -1) if at[i] > at[-1] - capacity]
        j = min(near, key=value.__getitem__)
    while j:
        out.append(j - 1)
        j = came[j]
    return out[::-1]


class Packer:
    """Cuts one stream; add() and finish() yield (doc numbers, starts, sequence numbers, offsets, ids spans)."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity, self.sequence = capacity, 0
        self.ids = np.empty(0, np.uint32)
        self.doc_at = np.empty(0, np.int64)  # first token of each open document in self.ids; may be negative
        self.doc = np.empty(0, np.int64)
        self.soft = np.empty(0, np.int64)

    def add(self, ids: np.ndarray, bounds: np.ndarray, soft: np.ndarray, docs: np.ndarray) -> Iterator[tuple]:
        self.doc_at = np.concatenate((self.doc_at, bounds[:-1] + len(self.ids)))
        self.doc = np.concatenate((self.doc, docs))
        self.soft = np.concatenate((self.soft, soft + len(self.ids)))
        self.ids = np.concatenate((self.ids, ids))
        while len(self.ids) >= STRETCH:
            yield self._cut(False)

    def finish(self) -> Iterator[tuple]:
        while len(self.ids):
            yield self._cut(True)

    def _offers(self, end: int) -> tuple[np.ndarray, np.ndarray]:
        hard = self.doc_at[(self.doc_at > 0) & (self.doc_at < end)]
        soft = self.soft[(self.soft > 0) & (self.soft < end)]
        at = np.concatenate((hard, soft, [end]))
        cost = np.concatenate((np.zeros(len(hard), np.int64), np.full(len(soft), SENTENCE), [0]))
        order = np.lexsort((cost, at))
        at, cost = at[order], cost[order]
        first = np.concatenate(([True], at[1:] != at[:-1]))
        at, cost = at[first], cost[first]
        gaps = (np.diff(at, prepend=0) - 1) // SPACING
        wide = np.flatnonzero(gaps > 0)
        if len(wide):
            n = gaps[wide]
            inner = np.repeat(np.concatenate(([0], at))[wide], n) + SPACING * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + 1)
            at, cost = np.concatenate((at, inner)), np.concatenate((cost, np.full(len(inner), INSIDE)))
            order = np.argsort(at, kind="stable")
            at, cost = at[order], cost[order]
        return at, cost

    def _cut(self, last: bool) -> tuple:
        end = min(len(self.ids), STRETCH)
        at, cost = self._offers(end)
        more = not (last and end == len(self.ids))  # the rest of the stretch goes on with what follows
        cuts = at[best_cuts(at.tolist(), cost.tolist(), self.capacity, more)]
        if not more:
            tail = int(cuts[-1] - (cuts[-2] if len(cuts) > 1 else 0))
            powers = [1 << k for k in range(tail.bit_length() - 1, -1, -1) if tail >> k & 1]
            if tail < self.capacity and self.capacity - tail > INSIDE * (len(powers) - 1):  # a power of two needs no padding
                cuts = np.concatenate((cuts[:-1], cuts[-1] - tail + np.cumsum(powers)))
        done = int(cuts[-1])
        heads = np.concatenate(([0], cuts[:-1]))
        inner = self.doc_at[(self.doc_at > 0) & (self.doc_at < done)]
        begin = np.union1d(heads, inner)
        stop = np.concatenate((begin[1:], [done]))
        doc = np.searchsorted(self.doc_at, begin, "right") - 1
        seq = np.searchsorted(heads, begin, "right") - 1
        out = (self.doc[doc], begin - self.doc_at[doc], self.sequence + seq, begin - heads[seq], stop - begin, [self.ids[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)])
        self.sequence += len(cuts)
        left = int(np.searchsorted(self.doc_at, done, "right")) - 1
        self.ids, self.doc_at, self.doc, self.soft = self.ids[done:], self.doc_at[left:] - done, self.doc[left:], self.soft[self.soft > done] - done
        return out


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(path: str, with_ids: bool, capacity: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = PieceTokenizer(path), Packer(capacity)
        first = TaskContext.get().partitionId() << 33
        open_: dict[int, tuple] = {}  # number -> doc_id, tokens
        count = 0

        def piece(x: tuple) -> pa.RecordBatch:
            numbers = x[0].tolist()
            columns = [
                pa.array([open_[k][0] for k in numbers], pa.int64()), pa.array(x[1]), pa.array(x[4]), pa.array([zlib.crc32(v.astype("<u4", copy=False)) for v in x[5]], pa.int64()),
                pa.array([open_[k][1] for k in numbers], pa.int64()), pa.array(x[2] + first), pa.array(x[3]),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                at = np.concatenate(([0], np.cumsum(x[4]))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(x[5]).astype(np.int32))))
                names.append("ids")
            for k in [k for k in open_ if k < numbers[-1]]:
                del open_[k]
            return pa.record_batch(columns, names)

        for batch in few_rows(batches):
            docs, texts = batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for part in blocks(texts):
                ids, bounds, soft = tokenizer.encode(texts[part])
                numbers = np.arange(count, count + len(bounds) - 1)
                open_.update(zip(numbers.tolist(), zip(docs[part], np.diff(bounds).tolist(), strict=True), strict=True))
                count += len(numbers)
                yield from map(piece, packer.add(ids, bounds, soft, numbers))
        yield from map(piece, packer.finish())

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece of a row of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer is the path of a tokenizers file, on every executor. Texts (null: empty) get END_ID behind their ids,
    so each document has a piece. Sequences hold at most capacity ids. sequence_id has the partition in its upper
    bits. A file that is not made of pieces is used text by text. No shuffle: a partition's documents are packed in their order, so read the table from files for a result
    that a retried task repeats. Repeated rows are packed again; with_ids adds the ids; an empty table gives none.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_pack(tokenizer, with_ids, capacity), _PIECES + ", ids array<int>" * with_ids)
