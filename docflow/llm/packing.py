"""Packing documents into token sequences by minimum bin slack.

Tokens are made and packed in the same pass over the documents, so nothing is shuffled. Documents
longer than a window first give whole windows. For each further window the longest remaining
length is taken, and a bitset subset-sum over the multiset of the other lengths (counts split into
powers of two) finds the set that fills the window closest to capacity; walking the saved bitsets
backwards gives how many of each length it takes. If the window still has slack, a piece is cut to
fill it. What remains at the end of a partition is cut into sequences whose lengths are powers of
two, which need no padding.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import tidy

WINDOW, END_ID = 2048, 1
#: Windows' worth of tokens that a batch leaves for the next one to choose from.
LEAVE = 24
#: Chunks whose ids a worker keeps; the rest are encoded by their parts.
KEEP_CHUNKS, KEEP_CORES = 300_000, 500_000
#: Byte-level vocabularies write a byte as the character of that number if it prints, else as one
#: of those from 256 on, in order.
_PRINTS = {*range(33, 127), *range(161, 173), *range(174, 256)}
_LETTERS = {b: b if b in _PRINTS else 256 + sum(x not in _PRINTS for x in range(b)) for b in range(256)}
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Chunks(dict):
    """Ids, as little-endian uint32 bytes, of chunks between white space.

    The tokenizer's rules end a token at white space, and at each change between letters and
    other characters, so a chunk's ids follow from its parts'. Only chunks of Latin-1 letters
    between plain punctuation are put together so; all others go to the tokenizer whole.
    """

    PUNCTUATION = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {"": b""}

    def encode(self, chunk: str) -> bytes:
        ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def part(self, text: str) -> bytes:
        if (got := self.parts.get(text)) is None:
            got = self.word(text) if text.isalpha() else self.encode(text)
            if len(self.parts) < KEEP_CORES:
                self.parts[text] = got
        return got

    def word(self, text: str) -> bytes:
        """The ids of lower-case Latin-1 letters, which are one token's worth to the tokenizer's
        rules: straight from its model, without normalising and splitting again."""
        tokens = self.tokenizer.model.tokenize(text.encode().decode("latin-1").translate(_LETTERS))
        return b"".join([t.id.to_bytes(4, "little") for t in tokens])

    def __missing__(self, chunk: str) -> bytes:
        core = chunk.strip(self.PUNCTUATION)
        if core and core.isalpha() and max(core) <= "\xff":
            at = chunk.index(core)
            got = self.part(chunk[:at]) + self.part(core.lower()) + self.part(chunk[at + len(core) :])
        else:
            got = self.encode(chunk)
        if len(self) < KEEP_CHUNKS and len(chunk) < 40:
            self[chunk] = got
        return got

    def ids(self, text: str) -> bytes:
        """The ids of a text: its chunks' ids in order."""
        chunks = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.__getitem__, chunks))


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length reach the largest sum that is `room` at most."""
    goal, reach = 1 << room, 1
    mask = (goal << 1) - 1
    steps: list[tuple[int, int, int]] = []  # length, how many at once, the sums reached before
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, many = min(counts[length], room // length), 1
        while left:
            take = min(many, left)
            steps.append((length, take, reach))
            reach |= (reach << length * take) & mask
            left, many = left - take, many * 2
        if reach & goal:
            break
    at, used = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] += take
            at -= length * take
    return used


class Packer:
    """Holds pieces (document, start, length) by length and fills windows from them."""

    def __init__(self, window: int, first_sequence: int) -> None:
        self.window, self.sequence = window, first_sequence
        self.by_length: dict[int, list[tuple]] = defaultdict(list)
        self.counts: dict[int, int] = {}
        self.total = 0

    def put(self, piece: tuple) -> None:
        self.by_length[piece[2]].append(piece)
        self.counts[piece[2]] = self.counts.get(piece[2], 0) + 1
        self.total += piece[2]

    def take(self, length: int) -> tuple:
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length]
        self.total -= length
        return self.by_length[length].pop()

    def cut(self, length: int) -> tuple:
        """A piece of this length off the shortest piece that is longer; the rest goes back."""
        doc, start, whole = self.take(min(x for x in self.counts if x >= length))
        if whole > length:
            self.put((doc, start + length, whole - length))
        return doc, start, length

    def placed(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, start, length in pieces:
            yield doc, start, length, self.sequence, at
            at += length
        self.sequence += 1

    def add(self, doc: tuple, length: int) -> Iterator[tuple]:
        start = 0
        while length - start >= self.window:
            yield from self.placed([(doc, start, self.window)])
            start += self.window
        if length > start:
            self.put((doc, start, length - start))

    def pack(self, leave: int) -> Iterator[tuple]:
        """Fills windows until `leave` tokens or less remain, at least one window's worth staying."""
        while self.total >= self.window and self.total > leave:
            pieces = [self.take(max(self.counts))]
            room = self.window - pieces[0][2]
            for length, n in fill(self.counts, room).items():
                pieces += [self.take(length) for _ in range(n)]
                room -= length * n
            while room:  # nothing left fits whole
                longer = [x for x in self.counts if x >= room]
                piece = self.cut(room) if longer else self.take(max(self.counts))
                pieces.append(piece)
                room -= piece[2]
            yield from self.placed(pieces)

    def close(self) -> Iterator[tuple]:
        yield from self.pack(0)
        while self.total:
            room, pieces = 1 << (self.total.bit_length() - 1), []
            while room:
                longest = max(self.counts)
                piece = self.take(longest) if longest <= room else self.cut(room)
                pieces.append(piece)
                room -= piece[2]
            yield from self.placed(pieces)


def pack(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens,
    sequence_id, offset.

    A null text counts as empty; each document ends with `end_id`, so an empty one is a piece of
    one token. Repeated rows and null ids are documents of their own. An empty table gives no
    rows. Only the two named columns are read.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(tokenizer_path)
        packer = Packer(window, TaskContext.get().partitionId() << 33)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [{"long": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in SCHEMA.split(", ")]

        def rows(placed: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            out: list[list] = [[] for _ in names]
            held = 0
            for (key, ids), start, length, sequence, offset in placed:
                for column, v in zip(out, (key, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, sequence, offset), strict=True):
                    column.append(v)
                held += 4 * length
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)
                    out, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

        def placed(batch: pa.RecordBatch) -> Iterator[tuple]:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = chunks.ids(text.as_py() or "") + end
                yield from packer.add((key, ids), len(ids) // 4)
            yield from packer.pack(LEAVE * window)

        for batch in batches:
            yield from rows(placed(batch))
        yield from rows(packer.close())

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(tidy(run), SCHEMA)
