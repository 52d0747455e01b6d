"""Byte-level BPE encoding and decoding with an Aho-Corasick automaton over Latin-1 strings.

Bytes are mapped to the 256 characters of Latin-1, so that pyahocorasick can hold the vocabulary. A piece is first
cut greedily into longest matches. Two neighbouring tokens are compatible if merging their joint bytes by rank gives
these two tokens again; the one sequence in which all neighbours are compatible is the result of the merges, so the
encoder steps back from a longest match to shorter ones until neighbours agree. Compatibility is memoised, and each
byte position is given up at most once, so the work is linear in the length of the piece.

Null and empty texts have no tokens. Repeated rows are encoded each. Columns other than the named ones are dropped.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourline.llm.common import written


#: Entries of each of the two generations of the memos (pieces, pairs); older ones are forgotten and made anew.
MEMO = 200_000
#: Longer pieces are encoded each time, so that the memos are bounded in bytes, too.
LONG_PIECE = 64
#: Texts of more characters are cut into pieces a batch at a time.
LONG, BATCH = 500_000, 100_000


class Memo(dict):
    """make(key), remembered for the keys in use: when full, the last generation but one is forgotten."""

    def __init__(self, make, size: int = MEMO, keeps=None):
        super().__init__()
        self.make, self.size, self.keeps, self.old = make, size, keeps, {}

    def __missing__(self, key):
        if self.keeps is not None and not self.keeps(key):
            return self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encoder and decoder of one rank file and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.rank = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.token = {v: k for k, v in self.rank.items()}
        self.decimal = {str(v): k for k, v in ranks.items()}
        self.split = regex.compile(pattern)
        self.find = ahocorasick.Automaton()
        self.halves: dict[int, tuple[int, int]] = {}  # the last merge of each token
        for s, i in self.rank.items():
            if len(s) == 1 or self.merged(s, last := []) == [i]:  # others are no result of merges
                self.find.add_word(s, i)
                if len(s) > 1:
                    self.halves[i] = tuple(last)
        self.find.make_automaton()
        self.length = {v: len(k) for k, v in self.rank.items()}
        self.fits = Memo(lambda ab: self.compatible(ab >> 32, ab & 0xFFFFFFFF))
        self.shorter = Memo(self._shorter)
        self.csv = Memo(lambda piece: ",".join(map(str, self.piece(piece.encode().decode("latin-1")))), keeps=lambda piece: len(piece) <= LONG_PIECE)

    def merged(self, s: str, last: list[int] | None = None) -> list[int]:
        """The merges by rank, done one by one; for the few bytes of one or two tokens. last: gets the two tokens of the last merge."""
        parts, rank, none = list(s), self.rank.get, 1 << 40
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            if last is not None:
                last[:] = self.rank[parts[i]], self.rank[parts[i + 1]]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], none)
        return [self.rank[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges of a and b run as if apart: with them undone last first, no merge across the border would come first.

        Equal ranks go from left to right, so a merge across is too late for the left token's merge of its rank, not for the right's.
        """
        halves, token, rank, none = self.halves, self.token, self.rank, 1 << 40
        before = none
        while True:
            if 2 * rank.get(token[a] + token[b], none) < before:
                return False
            left, right = halves.get(a), halves.get(b)
            if left is not None and (right is None or a > b):
                a, before = left[1], 2 * a
            elif right is not None:
                b, before = right[0], 2 * b + 1
            else:
                return True

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 if there is none."""
        s = self.token[token]
        return next((self.rank[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.find), -1)

    def piece(self, s: str) -> list[int]:
        if (whole := self.rank.get(s)) is not None:
            return [whole]
        out, fits = [i for _, i in self.find.iter_long(s)], self.fits
        for k in range(len(out) - 1):
            if not fits[out[k] << 32 | out[k + 1]]:
                return self.backtrack(s, out[: k + 1], out[k + 1])
        return out

    def backtrack(self, s: str, out: list[int], token: int) -> list[int]:
        """Completes the compatible tokens out, which token, the longest match after them, doesn't fit."""
        fits, shorter, length, find, end = self.fits, self.shorter, self.length, self.find.iter_long, len(s)
        dead: set[int] = set()  # positions that no sequence of compatible tokens goes on from
        pos, last = sum(length[i] for i in out), out[-1] if out else -1
        while pos < end:
            while token >= 0 and (pos + length[token] in dead or last >= 0 and not fits[last << 32 | token]):
                token = shorter[token]
            if token >= 0:
                out.append(last := token)
                pos += length[token]
                if pos < end:
                    token = next(find(s, pos))[1]
            else:
                dead.add(pos)
                pos -= length[last]
                token = shorter[out.pop()]
                last = out[-1] if out else -1
        return out

    def chunks(self, text: str) -> Iterator[list[str]]:
        """The ids of each piece, in decimals joined by commas; the pieces of a text in one or more lists."""
        if len(text) <= LONG:
            if text:
                yield list(map(self.csv.__getitem__, self.split.findall(text)))
            return
        pieces = (m.group() for m in self.split.finditer(text))
        while batch := list(islice(pieces, BATCH)):
            yield list(map(self.csv.__getitem__, batch))

    def encode(self, text: str) -> list[int]:
        return [int(x) for part in self.chunks(text) for x in ",".join(part).split(",")]

    def decode(self, decimals: list[str]) -> bytes:
        return b"".join(map(self.decimal.__getitem__, decimals))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of this Python worker, made once."""
    key = (path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(load_ranks(path), pattern)
    return _codecs[key]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id and ids array<int>."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern)
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "ids": [c.encode(t or "") for t in b["t"]]})

    return docs.select(id_col, F.col(text_col).alias("t")).mapInPandas(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: its id and the decoded bytes (binary)."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern)
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "decoded": [c.decode([str(i) for i in ids]) if ids is not None else b"" for ids in b["ids"]]})

    return encoded.select(id_col, F.col(ids_col).alias("ids")).mapInPandas(run, f"`{id_col}` {kind}, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each text, decodes the ids again and returns id, n_tokens, ids_sha256 and decoded_sha256."""
    kind = docs.schema[id_col].dataType.simpleString()

    def row(c: Codec, text: str) -> tuple[int, str, str]:
        n, ids, back = 0, hashlib.sha256(), hashlib.sha256()
        for part in c.chunks(text):
            joined = ",".join(part)
            ids.update(f",{joined}".encode() if n else joined.encode())
            back.update(c.decode(joined.split(",")))
            n += joined.count(",") + 1
        return n, ids.hexdigest(), back.hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern)
        for b in batches:
            out = pd.DataFrame([row(c, t or "") for t in b["t"]], columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, id_col, b[id_col].to_numpy())
            yield out

    return written(docs.select(id_col, F.col(text_col).alias("t")).mapInPandas(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"))
