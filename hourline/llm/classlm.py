"""Brown's class-based bigram model: words are put into classes by exchange, texts are scored by transitions between classes.

p(word | before) = p(class | class before) * p(word | class). Tokens are lower-cased words and an end of each text; the
first word follows an end. Each training word gives up ``d`` of its count in its class, d estimated from the
numbers of words met once and twice; what a class's words give up is the class's probability of the one unknown word. An unknown
word's class is hidden: the classes are summed over (a forward pass, by tables, since only runs of unknown words need it), so
a text's score is the log10 of its whole probability, and the probabilities of all words and the unknown one sum to 1.

1. Blocks. Each task turns texts into blocks of about ``BLOCK`` tokens: numbers of words within the block, and its
   distinct words as 64-bit fingerprints in ascending order (two of n words share one with probability n * n / 2 ** 65).
2. Counts. A block sends each of its distinct words once, with its count; words are dealt by ranges of fingerprints over parts,
   and the blocks over the cells of a part. Cells hold at most ``MERGED`` blocks' parts of their words and, where there are several, are
   merged into a word's whole, so no task gets more than a bounded share. The cells tell the blocks their words' places and counts once.
3. Exchange, ``rounds`` times. A block sends for each distinct word how often which class stands before and behind it. The sums
   over all blocks, with the counts of class pairs, give the first-order change of the corpus's log likelihood for
   each class the word could move to; the best is taken. Half of the words (by fingerprint) may move in a round, so that
   neighbours don't swap places for ever. New classes go back to the blocks by way of the cells. At the start the most
   frequent words have a class each and all others share the last. A class travels as a byte, whose highest bit tells the half.
4. Scores. Each block scores its texts by arrays.

All counts cover all training texts and all words. What comes to the driver is ``classes`` squared numbers a round and the
most frequent words, one a class. A null or empty text is an end alone. Texts of any length are read in slices, whole; a block has
one text at least. Rows of a null id are held out; repeated rows are learned and scored each. Without training texts all
scores are 0. Columns other than the named are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourline.llm.common import forget, slices, table, written

CLASSES, ROUNDS = 32, 6
#: Tokens of a block; blocks whose parts one cell merges; tokens of the corpus for each part of the words.
BLOCK, MERGED, SHARE = 1 << 20, 256, 1 << 20
#: Known words follow a run of unknown ones by the tables of this many steps at most; by then the classes' shares have settled.
STEPS = 32
#: The class of words without training counts.
NONE = 255
_END = b"\n"


#: A text of more bytes is cut before its words are; a block ends at so many bytes a token, too.
SLICE, WIDE = 1 << 20, 32


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, one after another, and how many each text has."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    owner = None
    if (pc.max(pc.binary_length(texts)).as_py() or 0) > SLICE:
        pieces = [list(slices(t.as_py(), SLICE)) for t in texts]
        owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        texts = pa.array([x for p in pieces for x in p], pa.binary())
        rows = len(pieces)
    low = pc.ascii_trim_whitespace(pc.ascii_lower(texts.view(pa.string())))
    full = pc.greater(pc.binary_length(low), 0)
    lists = pc.ascii_split_whitespace(low.filter(full))
    n = np.zeros(len(low), np.int64)
    n[full.to_numpy(zero_copy_only=False)] = pc.list_value_length(lists).to_numpy()
    return lists.flatten(), n if owner is None else np.bincount(owner, weights=n, minlength=rows).astype(np.int64)


def blocks(docs: DataFrame, learned: Column, id_col: str, text_col: str, size: int = BLOCK) -> DataFrame:
    """block, doc_ids, learned, lens, tokens, stop (the number of the end), keys (fingerprints of its words, ascending) and n (their counts in training texts)."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part, held, total = 0, TaskContext.get().partitionId(), [], 0

        def block() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            known, lens = (np.concatenate([h[i] for h in held]) for i in (1, 2))
            lens = (lens + 1).astype(np.int32)
            coded = pa.chunked_array([h[3] for h in held], pa.string()).dictionary_encode().chunks  # all by one dictionary
            words = coded[-1].dictionary.cast(pa.binary()).to_pylist() if coded else []
            keys = np.frombuffer(b"".join(map(xxhash.xxh64_digest, [*words, _END])), ">u8").astype(np.uint64)
            keys, at = np.unique(keys, return_inverse=True)
            tokens = np.full(lens.sum(), at[-1], np.int32)
            inner = np.ones(len(tokens), bool)
            inner[np.cumsum(lens) - 1] = False
            tokens[inner] = at.astype(np.int32)[np.concatenate([np.zeros(0, np.int32), *(c.indices.to_numpy() for c in coded)])]
            n = np.bincount(tokens[np.repeat(known, lens)], minlength=len(keys)).astype(np.int32)
            binary = [pa.array([x.tobytes()], pa.binary()) for x in (known, lens, tokens, keys, n)]
            whole = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([(part << 33) + made], pa.int64()), whole, pa.array([int(at[-1])], pa.int32()), *binary], ["block", "doc_ids", "stop", "learned", "lens", "tokens", "keys", "n"])

        for b in batches:
            ids, known = b.column(0), pc.fill_null(b.column(1), False).to_numpy(zero_copy_only=False)
            words, n = _split(b.column(2))
            weight = np.maximum(n + 1, pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy() // WIDE)
            ends, row = np.r_[0, np.cumsum(n)], 0
            while row < len(n):
                upto = min(row + int(np.searchsorted(np.cumsum(weight[row:]), size - total)) + 1, len(n))
                held.append((ids.slice(row, upto - row), known[row:upto], n[row:upto], words.slice(ends[row], ends[upto] - ends[row])))
                total += int(weight[row:upto].sum())
                row = upto
                if total >= size:
                    yield block()
                    made, held, total = made + 1, [], 0
        if held:
            yield block()

    out = docs.select(id_col, learned.alias("known"), text_col).mapInArrow(run, f"block long, doc_ids array<{kind.simpleString()}>, stop int, learned binary, lens binary, tokens binary, keys binary, n binary")
    return written(out, bucket="block")


def _of(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(raw, dtype=kind)


def _packed(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as a byte each; those of 255 and more stand as 255 and follow whole."""
    large = counts[counts >= 255]
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), large.astype(np.int64).tobytes()


def _unpacked(small: bytes, large: bytes) -> np.ndarray:
    counts = _of(small, np.uint8).astype(np.int64)
    if large:
        counts[counts == 255] = _of(large, np.int64)
    return counts


def _cut(counts: np.ndarray, edges: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Counts as packed, cut at the edges."""
    small, large = _packed(counts)
    far = np.r_[0, np.cumsum(counts >= 255)][edges] * 8
    return [small[a:b] for a, b in pairwise(edges.tolist())], [large[a:b] for a, b in pairwise(far.tolist())]


def _starts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return np.flatnonzero(new)


def _pairs(r) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of neighbouring words in a block's training texts; an end stands before each text."""
    lens, known, tokens = _of(r.lens, np.int32), _of(r.learned, bool), _of(r.tokens, np.int32)
    before = np.roll(tokens, 1)
    before[np.cumsum(lens) - lens] = r.stop
    own = np.repeat(known, lens)
    return before[own], tokens[own]


def _first(keys: np.ndarray, top: list[int], classes: int) -> np.ndarray:
    """The classes at the start."""
    out = np.full(len(keys), classes - 1, np.uint8)
    for k, x in enumerate(top):
        out[keys == np.uint64(x)] = k
    return out


def _bytes(keys: np.ndarray, cls: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Classes as they travel: NONE for words without training counts, else the highest bit tells the half that the word is in."""
    return np.where(total == 0, NONE, cls | (keys >> np.uint64(7) & np.uint64(1)).astype(np.uint8) << 7).astype(np.uint8)


def _plain(cls: np.ndarray) -> np.ndarray:
    """Classes without the bit of the half."""
    return np.where(cls == NONE, NONE, cls & 127).astype(np.uint8)


def _joined(column: pd.Series, kind) -> np.ndarray:
    return _of(b"".join(column), kind)


def entries(rows: DataFrame, parts: int, cells: int) -> DataFrame:
    """cell, block, keys and n: which words a block has in each part."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = np.array([-(-(p << 64) // parts) for p in range(1, parts)], dtype=np.uint64)
        for f in frames:
            for r in f.itertuples():
                to = np.r_[0, np.searchsorted(_of(r.keys, np.uint64), edges), len(r.keys) // 8].tolist()
                mine = (r.block ^ r.block >> 33) % cells
                out = [(p * cells + mine, r.block, r.keys[8 * a : 8 * b], r.n[4 * a : 4 * b]) for p, (a, b) in enumerate(pairwise(to)) if a < b]
                yield pd.DataFrame(out, columns=["cell", "block", "keys", "n"])

    return written(rows.select("block", "keys", "n").mapInPandas(run, "cell long, block long, keys binary, n binary"), bucket="cell")


def vocabulary(asked: DataFrame, cells: int, top: int) -> tuple[DataFrame, dict, list[int]]:
    """cell, words, total (their counts in all training texts) and places (among the words of the part); figures of the training words (tokens, words, once, twice), and the fingerprints of the most frequent ones."""

    def sums(f: pd.DataFrame, kind):
        keys, at = np.unique(_joined(f["keys"], np.uint64), return_inverse=True)
        return keys, at, np.bincount(at, weights=_joined(f["n"], kind), minlength=len(keys)).astype(np.int64)

    def inside(f: pd.DataFrame) -> pd.DataFrame:
        keys, _, n = sums(f, np.int32)
        cell = int(f["cell"].iloc[0])
        return pd.DataFrame([(cell // cells, cell, keys.tobytes(), n.tobytes())], columns=["part", "cell", "keys", "n"])

    def over(f: pd.DataFrame) -> pd.DataFrame:
        keys, at, n = sums(f, np.int64)
        met = n[n > 0]
        best = np.lexsort((keys.view(np.int64), -n))[:top]
        best = best[n[best] > 0]
        figures = [len(met), int((met == 1).sum()), int((met == 2).sum()), int(met.sum()), keys[best].view(np.int64).tolist(), n[best].tolist()]
        to = np.r_[0, np.cumsum([len(k) // 8 for k in f["keys"]])].tolist()
        out = [(c, k, n[at[a:b]].tobytes(), at[a:b].astype(np.int32).tobytes(), *(figures if a == 0 else [None] * 6)) for c, k, (a, b) in zip(f["cell"], f["keys"], pairwise(to))]
        return pd.DataFrame(out, columns=["cell", "words", "total", "places", "distinct", "once", "twice", "tokens", "best", "most"])

    merged = asked.select("cell", "keys", "n").groupBy("cell").applyInPandas(lambda f: inside(f), "part long, cell long, keys binary, n binary")
    told = written(merged.groupBy("part").applyInPandas(lambda f: over(f), "cell long, words binary, total binary, places binary, distinct long, once long, twice long, tokens long, best array<long>, most array<long>"), bucket="cell")
    figures = told.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("tokens", "tokens"), ("distinct", "words"), ("once", "once"), ("twice", "twice"))]).first().asDict()
    each = told.select(F.explode(F.arrays_zip("best", "most")).alias("w")).select("w.*")
    most = [r["best"] & (1 << 64) - 1 for r in each.orderBy(F.desc("most"), "best").limit(top).collect()]
    return told, figures, most


def places(asked: DataFrame, told: DataFrame, top: list[int], classes: int) -> tuple[DataFrame, DataFrame]:
    """cell, block and at (the places of a block's words among the cell's), and block, cells, sizes (words in each), at, total (count in all training texts) and cls (at the start) of each block's words."""

    def back(f: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        words, total = _joined(own["words"], np.uint64), _joined(own["total"], np.int64)
        cls = _bytes(words, _first(words, top, classes), total)
        out = []
        for r in f.itertuples():
            at = np.searchsorted(words, _of(r.keys, np.uint64))
            out.append((r.cell, r.block, at.astype(np.int32).tobytes(), total[at].tobytes(), cls[at].tobytes()))
        return pd.DataFrame(out, columns=["cell", "block", "at", "total", "cls"])

    def whole(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("cell")
        sizes = np.array([len(c) for c in f["cls"]], dtype=np.int32)
        return pd.DataFrame([(f["block"].iloc[0], f["cell"].to_numpy(np.int64).tobytes(), sizes.tobytes(), *(b"".join(f[c]) for c in ("at", "total", "cls")))], columns=["block", "cells", "sizes", "at", "total", "cls"])

    pairs = asked.select("cell", "block", "keys").groupBy("cell").cogroup(told.select("cell", "words", "total").groupBy("cell"))
    known = written(pairs.applyInPandas(lambda a, b: back(a, b), "cell long, block long, at binary, total binary, cls binary"), bucket="cell")
    of = known.groupBy("block").applyInPandas(lambda f: whole(f), "block long, cells binary, sizes binary, at binary, total binary, cls binary")
    return known, written(of, bucket="block")


def summed_pairs(found: DataFrame, classes: int) -> np.ndarray:
    """Counts of class pairs (pair, n), summed."""
    out = np.zeros(classes * classes, np.int64)
    for r in found.groupBy("pair").agg(F.sum("n").alias("n")).collect():  # classes squared rows
        out[r["pair"]] = r["n"]
    return out.reshape(classes, classes)


def _class_pairs(cls: np.ndarray, a: np.ndarray, b: np.ndarray, classes: int) -> np.ndarray:
    return np.bincount(cls[a].astype(np.int64) * classes + cls[b], minlength=classes * classes)


def transitions(rows: DataFrame, classes: int) -> np.ndarray:
    """How often each class follows each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(classes * classes, np.int64)
        for f in frames:
            for r in f.itertuples():
                n += _class_pairs(_of(r.cls, np.uint8) & 127, *_pairs(r), classes)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"pair": at, "n": n[at]})

    return summed_pairs(rows.select("learned", "lens", "tokens", "stop", "cls").mapInPandas(run, "pair long, n long"), classes)


def gains(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The change of the log likelihood to the first order for each word (row) and class it could be in; left and right: counts of classes before and behind it, n: of class pairs."""
    log, ends = np.log(n + 0.5), np.log(n.sum(axis=1) + 0.5 * len(n)) + np.log(n.sum(axis=0) + 0.5 * len(n))
    return left @ log + right @ log.T - left.sum(axis=1, keepdims=True) * ends


_SENT = "cell long, steps binary, far binary, cls binary, nnz binary, codes binary, counts binary, large binary"


def neighbours(rows: DataFrame, classes: int) -> DataFrame:
    """What blocks send to cells: places of words (as steps from one to the next), classes, and how many and which classes stand beside each, how often; counts as packed. pairs: a block's class pairs, once a block."""
    k = classes

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                cls = _of(r.cls, np.uint8) & 127
                a, b = _pairs(r)
                if len(cls) >= 1 << 23:
                    a, b = a.astype(np.int64), b.astype(np.int64)
                both = np.concatenate([b * 256 + cls[a], a * 256 + (cls[b] + k)])
                both.sort()
                first = _starts(both)
                u, counts = both[first], np.diff(first, append=len(both))
                nnz = np.bincount(u >> 8, minlength=len(cls)).astype(np.uint8)
                at, edges = _of(r.at, np.int32), np.r_[0, np.cumsum(_of(r.sizes, np.int32), dtype=np.int64)]
                steps = np.diff(at, prepend=0)
                steps[edges[:-1]] = at[edges[:-1]]
                to, codes, degrees = np.r_[0, np.cumsum(nnz, dtype=np.int64)][edges], (u & 255).astype(np.uint8).tobytes(), nnz.tobytes()
                (near, far), (small, large) = _cut(steps, edges), _cut(counts, to)
                out = {"cell": _of(r.cells, np.int64), "steps": near, "far": far, "cls": [r.cls[x:y] for x, y in pairwise(edges.tolist())], "nnz": [degrees[x:y] for x, y in pairwise(edges.tolist())], "codes": [codes[x:y] for x, y in pairwise(to.tolist())], "counts": small, "large": large}
                yield pd.DataFrame(out | {"pairs": [_class_pairs(cls, a, b, k).tobytes(), *[None] * (len(near) - 1)]})

    return written(rows.select("learned", "lens", "tokens", "stop", "cells", "sizes", "at", "cls").mapInPandas(send, f"{_SENT}, pairs binary"), bucket="cell")


def sent_pairs(sent: DataFrame, classes: int) -> np.ndarray:
    """How often each class follows each, from what blocks sent."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(classes * classes, np.int64)
        for f in frames:
            for x in f["pairs"]:
                n += _of(x, np.int64)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"pair": at, "n": n[at]})

    return summed_pairs(sent.select("pairs").where("pairs is not null").mapInPandas(run, "pair long, n long"), classes)


def exchange(sent: DataFrame, told: DataFrame, n: np.ndarray, turn: int, cells: int) -> DataFrame:
    """cell, cls of the words of each cell after a round, and types (how many words each class has in a part, once a part)."""
    k = len(n)

    def summed(f: pd.DataFrame, width: int | None = None):
        lens = np.array([len(x) for x in f["cls"]])
        starts = np.cumsum(lens) - lens
        steps = _unpacked(b"".join(f["steps"]), b"".join(f["far"]))
        at = np.cumsum(steps)
        at -= np.repeat(at[starts] - steps[starts], lens)
        cls = np.empty(int(at.max()) + 1, np.uint8)
        cls[at] = _joined(f["cls"], np.uint8)
        both = np.repeat(at * (2 * k), _joined(f["nnz"], np.uint8)) + _joined(f["codes"], np.uint8)
        table_ = np.bincount(both, weights=_unpacked(b"".join(f["counts"]), b"".join(f["large"])), minlength=len(cls) * 2 * k)  # whole numbers, exact below 2 ** 53
        return at, np.r_[starts, len(at)], cls, table_

    def inside(f: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        """The cell's words by their places in the part."""
        _, _, cls, table_ = summed(f)
        met = np.flatnonzero(table_)
        nnz = np.bincount(met // (2 * k), minlength=len(cls)).astype(np.uint8)
        steps, counts = _packed(np.diff(_joined(own["places"], np.int32), prepend=0)), _packed(table_[met].astype(np.int64))
        return pd.DataFrame([(int(f["cell"].iloc[0]), *steps, cls.tobytes(), nnz.tobytes(), (met % (2 * k)).astype(np.uint8).tobytes(), *counts)], columns=["cell", "steps", "far", "cls", "nnz", "codes", "counts", "large"])

    def over(f: pd.DataFrame) -> pd.DataFrame:
        at, edges, cls, table_ = summed(f)
        table_ = table_.reshape(-1, 2 * k)
        g, own = gains(table_[:, :k], table_[:, k:], n), np.arange(len(cls))
        none = cls == NONE  # met in texts held out alone, whose cells ask all the same
        now = np.where(none, 0, cls & 127)
        stay = ((cls >> 7) + turn) % 2 == 1
        best = np.where(stay | (g[own, now] >= g.max(axis=1) - 1e-9), now, g.argmax(axis=1)).astype(np.uint8)
        types = np.bincount(best[~none], minlength=k).tolist()
        best = np.where(none, NONE, best | cls & 128).astype(np.uint8)
        if cells == 1:
            out = [(int(f["cell"].iloc[0]), best.tobytes(), types)]
        else:
            out = [(c, best[at[a:b]].tobytes(), types if a == 0 else None) for c, (a, b) in zip(f["cell"], pairwise(edges.tolist()))]
        return pd.DataFrame(out, columns=["cell", "cls", "types"])

    parts = sent.drop("pairs")
    if cells == 1:
        parts = parts.groupBy("cell")
    else:
        merged = parts.groupBy("cell").cogroup(told.select("cell", "places").groupBy("cell")).applyInPandas(lambda a, b: inside(a, b), _SENT)
        parts = merged.groupBy(F.expr(f"cell div {cells}"))
    return written(parts.applyInPandas(lambda f: over(f), "cell long, cls binary, types array<long>"), bucket="cell")


def returned(known: DataFrame, said: DataFrame) -> DataFrame:
    """block and cls of each block's words."""

    def back(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        cls = _joined(own["cls"], np.uint8)
        return pd.DataFrame({"block": asked["block"], "cell": asked["cell"], "cls": [cls[_of(x, np.int32)].tobytes() for x in asked["at"]]})

    def whole(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": f["block"].iloc[:1], "cls": [b"".join(f.sort_values("cell")["cls"])]})

    # a cell's words are told once: in one row of said
    parts = known.select("cell", "block", "at").groupBy("cell").cogroup(said.select("cell", "cls").groupBy("cell")).applyInPandas(lambda a, b: back(a, b), "block long, cell long, cls binary")
    return written(parts.groupBy("block").applyInPandas(lambda f: whole(f), "block long, cls binary"), bucket="block")


class Model:
    """The numbers that scores need: transitions, what classes give up, and the tables for runs of unknown words."""

    def __init__(self, figures: dict, n: np.ndarray, types: np.ndarray, end: int):
        k = len(n)
        self.tokens, self.words, self.end = figures["tokens"], figures["words"], end
        self.d = (figures["once"] + 1) / (figures["once"] + 2 * figures["twice"] + 2)
        self.size = n.sum(axis=0).astype(float)
        share = self.size / max(self.size.sum(), 1)
        follow = (n + k * share) / (n.sum(axis=1, keepdims=True) + k)
        self.unknown = np.divide(self.d * types, self.size, out=np.zeros(k), where=self.size > 0)
        known, none = [], []
        with np.errstate(divide="ignore", invalid="ignore"):
            q = follow
            for _ in range(STEPS):
                hidden = q * self.unknown
                known.append(np.log10(q))
                none.append(np.log10(hidden.sum(axis=1)))
                q = hidden / hidden.sum(axis=1, keepdims=True) @ follow
        self.known, self.none = np.array(known), np.array(none)

    def score(self, tokens: np.ndarray, lens: np.ndarray, cls: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n_known, base_score and score of the texts of a block."""
        starts = np.cumsum(lens) - lens
        add = lambda x: np.add.reduceat(x, starts)
        c, count = cls[tokens], total[tokens]
        base = add(np.log10((count + 1.0) / (self.tokens + self.words + 1.0)))
        known, at = c != NONE, np.arange(len(tokens))
        if not self.tokens:
            return add(known.astype(np.int64)), base, np.zeros(len(lens))
        lead = np.maximum.accumulate(np.where(known, at, -1))
        lead = np.r_[-1, lead[:-1]]  # the last known word before each
        start = np.repeat(starts, lens)
        fresh_ = lead < start
        before = np.where(fresh_, self.end, c[lead])
        step = np.minimum(at - np.where(fresh_, start - 1, lead) - 1, STEPS - 1)
        size = np.where(known, self.size[np.where(known, c, 0)], 1.0)
        own = self.known[step, before, np.where(known, c, 0)] + np.log10(np.where(known, np.maximum(count - self.d, 1e-300) / size, 1.0))
        return add(known.astype(np.int64)), base, add(np.where(known, own, self.none[step, before]))


def scores(rows: DataFrame, model: Model, kind: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score and score of the texts of blocks with their classes and counts."""
    held = rows.sparkSession.sparkContext.broadcast(model)  # classes squared times STEPS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_ids")
            for i, r in enumerate(b.drop_columns(["doc_ids"]).to_pylist()):
                lens = _of(r["lens"], np.int32)
                known, base, score = held.value.score(_of(r["tokens"], np.int32), lens, _plain(_of(r["cls"], np.uint8)), _of(r["total"], np.int64))
                columns = [ids[i].values, pa.array(~_of(r["learned"], bool)), pa.array(lens.astype(np.int64)), pa.array(known), pa.array(base), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return rows.select("doc_ids", "learned", "lens", "tokens", "cls", "total").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def language_model(docs: DataFrame, learned: Column, classes: int = CLASSES, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK, merged: int = MERGED, share: int = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score and perplexity of every row of docs; 3 to 85 classes."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    texts = blocks(docs, learned, id_col, text_col, size)
    shape = texts.agg(F.count("*").alias("blocks"), F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0)).alias("bytes")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shape["bytes"] // (4 * share)))
    cells = max(-(-shape["blocks"] // merged), 1)
    asked = entries(texts, parts, cells)
    told, figures, top = vocabulary(asked, cells, classes - 1)
    known, place = places(asked, told, top, classes)
    forget(asked)
    placed, now = texts.join(place.drop("cls"), "block"), place.select("block", "cls")
    behind = []
    for turn in range(rounds):
        sent = neighbours(placed.join(now, "block"), classes)
        forget(*behind)
        said = exchange(sent, told, sent_pairs(sent, classes), turn, cells)
        forget(sent)
        now = returned(known, said)
        types = said.select(F.posexplode("types").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()  # a row a class
        forget(said)
        behind = [now]
    rows = placed.join(now, "block")
    n = transitions(rows, classes)
    of_end = [r["cls"] for r in rows.select(F.substring("cls", F.col("stop") + 1, F.lit(1)).alias("cls")).limit(1).collect()]
    sizes = np.zeros(classes)
    sizes[[r["k"] for r in types]] = [r["n"] for r in types]
    model = Model(figures, n, sizes, of_end[0][0] & 127 if of_end and of_end[0][0] != NONE else 0)
    out = written(scores(rows, model, kind))
    forget(texts, told, known, place, *behind)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(figures["tokens"]).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op11_class_lm(spark, sf_dir: str) -> DataFrame:
    learned = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(False))
    return language_model(table(spark, sf_dir, "documents"), learned)
