"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming decoder.

A token sequence is what the merges give exactly when each two neighbours are what the merges give for their joined
bytes. So the encoding of a prefix extends the encoding of a shorter one by one token. A state of the transducer is the
set of earlier positions where a token may have begun that is still growing, each with the token that ends there, and
the bytes since the first of them. A byte moves it on and tells the token that ends at the new position. A token is
emitted once all these positions agree on it; they lie no further back than the longest token. States and moves are
made when first met and kept, up to a bound.
"""

from __future__ import annotations

import base64
import gc
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merged(ranks: dict[bytes, int], piece: bytes) -> list[bytes]:
    """The merges by their definition: the lowest rank first, the leftmost of equals. Only for a few bytes."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], len(ranks) + 256), i) for i in range(len(parts) - 1))
        if parts[at] + parts[at + 1] not in ranks:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


BYTES = [bytes((i,)) for i in range(256)]


class Transducer:
    """Encodes pieces byte by byte. ``encode`` gives ranks; ``states`` are kept up to ``most``."""

    def __init__(self, ranks: dict[bytes, int], most: int = 120_000):
        self.ranks, self.most = ranks, most
        self.starts = {token[:n] for token in ranks for n in range(1, len(token))}
        self.longest = max(map(len, ranks), default=1)
        self.ends = {token: (rank.to_bytes(4, "little"), len(token)) for token, rank in ranks.items()}
        self.whole = {}
        self.fits = {}
        self.first = self.states = None
        self.forget()

    def forget(self) -> None:
        """Drop all states but the first; they are made again when needed."""
        # A state: bytes since the first live position; the live positions and the token that ends at each; its moves.
        self.first = (b"", ((0, None),), {})
        self.states = {self.first[:2]: self.first}
        if len(self.fits) > 2 * self.most:
            self.fits.clear()
        gc.collect()  # states refer to each other

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes ``token``; None for a byte, or a token that merges never make."""
        if token not in self.whole:
            parts = [token[i:i + 1] for i in range(len(token))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], len(self.ranks) + 256), i)
                               for i in range(len(parts) - 1))
                if parts[at] + parts[at + 1] not in self.ranks:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self.whole[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.whole[token]

    def fit(self, left: bytes | None, right: bytes) -> bool:
        """Whether ``right`` may follow ``left`` in an encoding.

        Undo the merges on both sides of the border, the later one first. If a merge across the border comes before the
        one just undone, the merges would have crossed it.
        """
        if len(right) > 1 and self.halves(right) is None:
            return False
        if left is None:
            return True
        key, ranks, answer = (left, right), self.ranks, True
        # When each side was last merged: (rank, 0 if left of the border). At the same rank the left pair merges first.
        before = (len(ranks) + 256, 2)
        while True:
            across = ranks.get(left + right)
            if across is not None and (across, 1) < before:
                answer = False
                break
            mine = (ranks[left], 0) if len(left) > 1 else (-1, 0)
            other = (ranks[right], 2) if len(right) > 1 else (-1, 2)
            if mine[0] < 0 and other[0] < 0:
                break
            if mine > other:
                left, before = self.halves(left)[1], mine
            else:
                right, before = self.halves(right)[0], other
        self.fits[key] = answer
        return answer

    def move(self, state: tuple, byte: int) -> tuple:
        """Determinise one move: the next state, and the id and length of the token that ends here."""
        pending, live, moves = state
        pending += BYTES[byte]
        ranks, starts, fits, on, end = self.ranks, self.starts, self.fits, [], None
        for at, left in live:
            token = pending[at:]
            if end is None and token in ranks:
                good = fits.get((left, token))
                if good is None:
                    good = self.fit(left, token)
                if good:
                    end = token
            if token in starts:
                on.append((at, left))
        if end is None:
            raise ValueError("the vocabulary has no token for a byte")
        on.append((len(pending), end))
        gone = on[0][0]
        key = (pending[gone:], tuple([(at - gone, left) for at, left in on]) if gone else tuple(on))
        known = self.states.get(key)
        if known is None:
            self.states[key] = known = (*key, {})
        moves[byte] = step = (known, self.ends[end])
        return step

    def encode(self, piece: bytes) -> bytes:
        """The ids of one piece as little-endian 32-bit integers. A piece that is itself a token stays whole."""
        if piece in self.ends:
            return self.ends[piece][0]
        if len(self.states) > self.most:
            self.forget()
        state, ends, out = self.first, [], []
        for byte in piece:
            step = state[2].get(byte) or self.move(state, byte)
            state, end = step
            ends.append(end)
            if len(ends) > 64 * self.longest:
                self.commit(state, ends, out)
        out.append(self.trace(ends, len(ends)))
        return b"".join(out)

    @staticmethod
    def trace(ends: list, at: int) -> bytes:
        """Back from a position, token by token."""
        out = []
        while at > 0:
            token, length = ends[at - 1]
            out.append(token)
            at -= length
        out.reverse()
        return b"".join(out)

    @staticmethod
    def commit(state: tuple, ends: list, out: list) -> int:
        """Emit the tokens that all live positions agree on; returns how many bytes they cover."""
        since = len(ends) - len(state[0])
        ways = []
        for at, _ in state[1]:
            at += since
            way = {at}
            while at > 0:
                at -= ends[at - 1][1]
                way.add(at)
            ways.append(way)
        shared = max(set.intersection(*ways))
        if shared > 0:
            out.append(Transducer.trace(ends, shared))
            del ends[:shared]
        return shared


class Packed(dict):
    """Text -> its ids as little-endian 32-bit integers; filled by ``make``, emptied when ``most`` are held."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, piece: str) -> bytes:
        packed = self.make(piece)
        if len(self) >= self.most:
            self.clear()
        if len(piece) <= 64:
            self[piece] = packed
        return packed


class Encoder:
    """Texts to packed ids: ``pattern`` cuts a text into pieces, the transducer encodes each.

    A text is first cut at single spaces between other characters, where no match of the pattern can reach across; what
    such a stretch becomes is kept, up to a bound, since most come again.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 500_000):
        import re

        import regex

        self.find, self.encode = regex.compile(pattern).findall, Transducer(ranks).encode
        self.pieces = Packed(lambda piece: self.encode(piece.encode()), most // 20)
        self.cut = re.compile(r" (?=\S)(?<=\S )").split
        self.later = Packed(self.stretch, most)

    def stretch(self, text: str) -> bytes:
        """A stretch that a space comes before."""
        if text.isalpha():  # a space and letters are one match
            return self.encode(b" " + text.encode())
        return self.whole(" " + text)

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def __call__(self, text: str) -> bytes:
        first, *others = self.cut(text)
        return self.whole(first) + b"".join(map(self.later.__getitem__, others))


class StreamDecoder:
    """Ids in, text out, as it arrives. A UTF-8 sequence cut by the end of a chunk waits for its other bytes.

    The machine's state is the unfinished sequence: none, or a lead byte with fewer continuation bytes than it asks for.
    Bytes that can't be UTF-8 become U+FFFD, one for each maximal part.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.waiting = tokens, b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a sequence that may yet become whole."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if 0x80 <= byte <= 0xBF:
                continue
            need = 2 if 0xC2 <= byte <= 0xDF else 3 if 0xE0 <= byte <= 0xEF else 4 if 0xF0 <= byte <= 0xF4 else 1
            if need <= back:
                return 0
            if back > 1:  # the second byte has a narrower range after some lead bytes
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
                if not low <= data[-back + 1] <= high:
                    return 0
            return back
        return 0

    def feed(self, ids) -> str:
        data = self.waiting + b"".join(map(self.tokens.__getitem__, ids))
        cut = len(data) - self.unfinished(data)
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    """Rank -> bytes."""
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


#: Ids decoded at a time: bounds what the decoder holds for a very long text.
CHUNK = 1 << 16


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode each text and decode it again.

    Adds ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` to the rows' own columns, and ``ids`` if asked; own columns
    of these names are replaced. The text column itself is not returned unless ``keep_ids``. A null text counts as
    empty: no tokens, digests of nothing. Repeated rows give repeated results; an empty table gives an empty one. One
    pass without a shuffle; a task holds one Arrow batch and a bounded table of pieces. The rank file is read once by
    the driver (its size doesn't depend on the data) and sent to the tasks.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    added = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    added += [("ids", "array<int>")] * keep_ids
    kept = [c for c in docs.columns if c not in dict(added) and (keep_ids or c != text)]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text"]
                       + [f"{n} {t}" for n, t in added])

    def run(batches):
        gc.disable()  # the tables are large and hold few cycles; forget() collects those
        try:
            yield from encoded(batches)
        finally:  # the worker may be used again
            gc.enable()
            gc.collect()

    def encoded(batches):
        encode, tokens = Encoder(ranks.value, pattern), token_bytes(ranks.value)
        for batch in batches:
            counts, digests, decoded, lists = [], [], [], []
            for value in batch.column("__text"):
                packed = encode(value.as_py())
                ids = np.frombuffer(packed, "<u4")
                stream, digest = StreamDecoder(tokens), hashlib.sha256()
                for at in range(0, len(ids), CHUNK):
                    digest.update(stream.feed(ids[at:at + CHUNK].tolist()).encode())
                digest.update(stream.finish().encode())
                counts.append(len(ids))
                digests.append(hashlib.sha256(packed).hexdigest())
                decoded.append(digest.hexdigest())
                if keep_ids:
                    lists.append(ids.astype("i4"))
            columns = [batch.column(c) for c in kept] + [pa.array(counts, pa.int64()), pa.array(digests, pa.string()),
                                                         pa.array(decoded, pa.string())]
            columns += [pa.array(lists, pa.list_(pa.int32()))] * keep_ids
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *[n for n, _ in added]])

    return source.mapInArrow(run, schema)
