"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each prefix of a piece of bytes there is exactly one token that its encoding can end with: the one suffix token that
may follow the last token of what stands before it; whether two tokens may stand side by side depends on these two alone.
An automaton names the tokens that end at each byte. An encoding is read off backwards. Appending bytes leaves all earlier entries as they
are; after an edit, entries are recomputed only until they agree with the old ones over the length of a longest token.

Encoder holds the ranks and the pair test, Prefixes one piece with append and edit, `encode` and `encode_texts` the
Spark side: texts are cut into pieces by the vocabulary's pattern, pieces' ids are remembered while a task runs (up to a
bound; beyond it they are worked out again), whole texts are encoded and decoded, and the ranks are read by path on each
executor.

Defined cases: a null text is encoded like an empty one, with no ids. Equal rows give equal results. Extra columns pass
through `encode` unless they clash with an output column, which wins.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import text_batches, tidy

_NEVER = 1 << 62
#: Pieces remembered in a task, and the longest of them.
REMEMBERED, REMEMBERED_BYTES = 600_000, 48


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pattern = regex.compile(pattern)
        self._split: dict[int, tuple[int, int] | None] = {}
        self._beside: dict[tuple[int, int], bool] = {}
        self._piece: dict[str, bytes] = {}
        self.suffixes = ahocorasick.Automaton()
        for raw, token in ranks.items():
            self.suffixes.add_word(raw.decode("latin-1"), (token, len(raw)))
        self.suffixes.make_automaton()

    @classmethod
    def from_tiktoken(cls, path: str, pattern: str) -> Encoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    # -- the pair test -------------------------------------------------------

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self._split:
            parts = [self.ranks[bytes([b])] for b in self.bytes_of[token]]
            while len(parts) > 2:
                best, at = _NEVER, -1
                for i in range(len(parts) - 1):
                    r = self.ranks.get(self.bytes_of[parts[i]] + self.bytes_of[parts[i + 1]], _NEVER)
                    if r < best:
                        best, at = r, i
                if at < 0 or best >= token:
                    break
                parts[at : at + 2] = [best]
            self._split[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._split[token]

    def beside(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens side by side.

        The pieces that touch the border while the two are built are the left token's right-hand parts and the right
        token's left-hand parts; each lives until its own merge into the next larger one. The border falls if some
        two that live together merge earlier than either of these merges; of equal merges, the one further left is first.
        """
        got = self._beside.get((left, right))
        if got is None:
            got = self._beside[left, right] = self._stay(left, right)
        return got

    def _stay(self, left: int, right: int) -> bool:
        x, x_ends, y, y_ends = left, _NEVER, right, _NEVER
        while True:
            merged = self.ranks.get(self.bytes_of[x] + self.bytes_of[y], _NEVER)
            if merged < x_ends and merged <= y_ends and merged != _NEVER:
                return False
            # go back in time: undo the later of the two tokens' own last merges
            hx, hy = self._halves(x), self._halves(y)
            if hx is None and hy is None:
                return True
            if hy is None or (hx is not None and x > y):
                x, x_ends = hx[1], x
            else:
                y, y_ends = hy[0], y

    # -- pieces and texts ----------------------------------------------------

    def piece(self, raw: bytes) -> list[int]:
        if raw in self.ranks:
            return [self.ranks[raw]]
        return Prefixes(self, raw).ids()

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def _packed(self, piece: str) -> bytes:
        got = self._piece.get(piece)
        if got is None:
            raw = piece.encode("utf-8", "surrogatepass")
            got = b"".join(i.to_bytes(4, "little") for i in self.piece(raw))
            if len(raw) <= REMEMBERED_BYTES:
                if len(self._piece) >= REMEMBERED:
                    self._piece.clear()
                self._piece[piece] = got
        return got

    def packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, found = self._piece, self.pattern.findall(text)
        try:
            return b"".join([known[p] for p in found])
        except KeyError:
            return b"".join([self._packed(p) for p in found])

    def encode(self, text: str) -> list[int]:
        return memoryview(self.packed(text)).cast("I").tolist()

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


class Prefixes:
    """Last tokens of all prefixes of one piece: last[i] ends the encoding of the first i + 1 bytes."""

    def __init__(self, encoder: Encoder, raw: bytes = b""):
        self.encoder, self.raw, self.last = encoder, bytearray(), []
        self.append(raw)

    def _fill(self, start: int, stop: int) -> None:
        """Entries start to stop - 1, from all before them."""
        e, last, done = self.encoder, self.last, start
        seen = max(0, start - e.longest + 1)
        beside, stay = e._beside.get, e.beside
        for end, (token, size) in e.suffixes.iter(self.raw[seen:stop].decode("latin-1")):
            end += seen
            if end < done:
                continue  # known, or found among the tokens that end here
            at = end - size
            if at < 0:
                # alone, it stands only if its own merges make it whole
                fits = size == 1 or e._halves(token) is not None
            else:
                pair = (last[at], token)
                fits = beside(pair)
                if fits is None:
                    fits = stay(*pair)
            if fits:
                last.append(token)
                done = end + 1
        if done != stop:
            raise ValueError(f"no token ends at byte {done} of {bytes(self.raw[:done + 1])!r}")

    def append(self, more: bytes) -> None:
        start = len(self.raw)
        self.raw += more
        self._fill(start, len(self.raw))

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes start to end; returns how many entries were computed anew."""
        old_last, shift = self.last, len(new) - (end - start)
        self.raw[start:end] = new
        self.last = old_last[:start]
        agree, done = 0, 0
        for at in range(start + 1, len(self.raw) + 1):
            self._fill(at - 1, at)
            token = self.last[-1]
            done += 1
            if at > start + len(new):
                agree = agree + 1 if old_last[at - 1 - shift] == token else 0
                if agree >= self.encoder.longest:
                    self.last += old_last[at - shift :]
                    break
        return done

    def ids(self) -> list[int]:
        out, end = [], len(self.raw)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.encoder.bytes_of[out[-1]])
        return out[::-1]


def encoder(path: str, pattern: str) -> Encoder:
    """An encoder for one task, or one batch: workers outlive tasks, so nothing is kept between them."""
    return Encoder.from_tiktoken(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with ids (array of int), the encoding of the whole text."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path, pattern)
        for texts in batches:
            yield texts.map(lambda t: e.encode(t or ""))

    return docs.withColumn("ids", ids(F.col(text)))


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """tokens with decoded (binary); null ids give empty bytes."""

    @F.pandas_udf("binary")
    def back(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path, pattern)
        for column in batches:
            yield column.map(lambda x: e.decode(x) if x is not None else b"")

    return tokens.withColumn("decoded", back(F.col(ids)))


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns with n_tokens and the digests of the ids and of the bytes that they decode to.

    Ids and decoded bytes live only inside the task, one text at a time.
    """
    text_batches(docs.sparkSession)
    source = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        bytes_of = e.bytes_of
        for batch in batches:
            n, ids, back = [], [], []
            for value in batch.column(batch.num_columns - 1):
                packed = e.packed(value.as_py() or "")
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded = b"".join([bytes_of[i] for i in memoryview(packed).cast("I").tolist()])
                back.append(hashlib.sha256(decoded).hexdigest())
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], [*batch.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"])
        del e, bytes_of
        tidy()

    return source.mapInArrow(run, f"{schema}, {DIGESTS}")
