"""Removal of repeated passages by distributed suffix sorting over a difference cover.

Asked is, for every start of a ``length``-byte string, whether that string also starts anywhere else in the corpus. Only
the order of suffixes up to ``length`` bytes matters, so the sort stops there.

0. Anchors. Each window of ``length`` bytes elects the ``ANCHOR``-byte string in it whose first bytes hash lowest. Equal
   windows elect equal strings, so only windows around an anchor that is found twice or more can repeat. The pieces of
   text around such anchors are cut out once; equal pieces become one body, and a body of several places repeats as a
   whole. All that follows reads bodies, never texts.
1. Sample. Bodies are cut into phrases at places that depend on the next bytes alone; the fingerprint of a phrase is its
   symbol. Suffixes at phrases 1 and 2 modulo 3 are the sample: whatever two suffixes match, some shift of less than
   three phrases puts both into it. The triples of symbols at sampled suffixes are sorted, neighbours are compared, and
   a triple's name is its rank among the distinct ones. A triple unlike its neighbours ends whatever repeats.
2. Recursion. The names of the other sampled suffixes, of one residue and three phrases apart, make up a string in turn.
   Its suffixes are sorted up to the name that reaches ``length`` bytes, and equal neighbours repeat in at least those.
   As prefixes of ``length`` bytes are all that is asked, one recursion settles the order.
3. Remaining suffixes. Windows that start between sampled suffixes are merged in only where the sample leaves doubt: they
   lie around a repeated anchor, are not covered by repeats yet, and have a repeated triple in every three phrases. Around
   each of their anchors the bytes that such windows span are sorted in all bodies, and equal neighbours repeat. Of each
   run of equals the first, and what is unlike its neighbours, gives its windows, which are sorted and compared alike.
   The keys of these two sorts are two independent fingerprints of the bytes, of 64 bits each (64 and 32 for windows).

Symbols and fingerprints stand in for bytes, since any fixed order of the alphabet puts equal prefixes side by side.
Every sort is by ranges of (key, place), so a key that fills many rows is spread over many tasks; neighbours across the
edges of ranges are compared by two rows a range. Texts are handled in blocks of ``BLOCK`` bytes, whatever their length.
A null text has no bytes; repeated rows are texts of their own, so both copies of a row repeat. Rows keep apart by a row
number that is written down first, so ids may be null, repeated or absent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourline.llm.common import forget, fresh, local_table, table, written

LENGTH, ANCHOR, BLOCK = 200, 100, 1 << 18
#: Shorter texts are looked at together, up to about so many bytes.
JOINED = 1 << 15
#: One in so many places starts a phrase.
PHRASE = 24
#: Joins with tables of distinct hashes, which lie evenly, build a partition of those and don't sort the other side.
HASH = "shuffle_hash"
_U = np.uint64
_NONE = np.zeros(0, np.int64)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _tables:
        n = BLOCK + 4 * LENGTH
        with np.errstate(over="ignore"):
            _tables[base] = tuple(np.cumprod(np.full(n, x, dtype=np.uint64)) for x in (base, pow(base, -1, 1 << 64)))
    return _tables[base]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)


class Prints:
    """Fingerprints of any piece of a block of bytes."""

    def __init__(self, raw: np.ndarray, base: int = _BASES[0]):
        power, self.inverse = _powers(base)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + _U(1)) * power[: len(raw)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] ^ (end - start).astype(np.uint64))


def _eights(raw: np.ndarray) -> np.ndarray:
    """A hash of the eight bytes at each place that has eight."""
    n = len(raw) - 7
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, data = np.empty(n, np.uint64), raw.tobytes()
    for k in range(min(8, n)):
        out[k::8] = np.frombuffer(data, "<u8", count=len(out[k::8]), offset=k)
    return _mix(out)


def elected(raw: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> np.ndarray:
    """For each window of a block the place of its anchor; the first of equals."""
    w, n = length - anchor + 1, len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    m = len(raw) - anchor + 1
    v = (_eights(raw)[:m] >> _U(21) << _U(21)) | np.arange(m, dtype=np.uint64)
    v = np.pad(v, (0, -m % w), constant_values=_U(0xFFFFFFFFFFFFFFFF)).reshape(-1, w)
    ahead = np.minimum.accumulate(v, axis=1).ravel()
    back = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & _U((1 << 21) - 1)).astype(np.int64)


def _blocks(raw: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks that each window of the text lies in one of, by its start."""
    for at in range(0, max(len(raw) - length + 1, 0), BLOCK):
        yield at, raw[at : at + BLOCK + length - 1]


def _around(raw: np.ndarray, starts: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks that hold the windows of these starts and little else, each with its place and the starts inside it."""
    if len(starts):
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > 4 * length) + 1):
            for at in range(int(run[0]), int(run[-1]) + 1, BLOCK):
                p = run[np.searchsorted(run, at) : np.searchsorted(run, at + BLOCK)] - at
                if len(p):
                    yield at, raw[at : at + int(p[-1]) + length], p


def _bytes(text) -> np.ndarray:
    """The bytes of a text or of a body."""
    return np.frombuffer(text.encode() if isinstance(text, str) else text or b"", dtype=np.uint8)


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, sorted."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, s[1:] > e[:-1]]
    return s[new], e[np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1]]


def _inside(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A flag for each of n places: in one of the intervals."""
    if not len(starts):
        return np.zeros(n, bool)
    up, down = (np.bincount(np.clip(x, 0, n), minlength=n + 1) for x in (starts, ends))
    return np.cumsum((up - down)[:-1]) > 0


def _long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _frame(parts: list[tuple], names: str) -> pd.DataFrame:
    cols = names.split()
    return pd.DataFrame({c: np.concatenate([np.asarray(p[i]) for p in parts]) if parts else np.zeros(0, np.int64) for i, c in enumerate(cols)})


def _per_row(make, names: str):
    """A map over batches of rid, t and arrays of facts; make(rid, raw, *facts) yields tuples of equally long arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for b in batches:
                facts = [b[c] for c in b.columns if c not in ("rid", "t")]
                parts, held = [], 0
                for rid, t, *f in zip(b["rid"], b["t"], *facts):
                    for part in make(rid, _bytes(t), *(_NONE if x is None else x for x in f)):
                        parts.append(part)
                        held += len(part[0])
                    if held > 100_000:
                        yield _frame(parts, names)
                        parts, held = [], 0
                yield _frame(parts, names)

    return run


def _rid(rid: int, n: int) -> np.ndarray:
    return np.full(n, rid, np.int64)


def _whole_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by rid, cut where rid changes."""
    held, n, most = [], 0, 50_000
    for b in batches:
        held.append(b)
        n += len(b)
        if n < most:
            continue
        held = [pd.concat(held, ignore_index=True)]
        rid = held[0]["rid"].to_numpy()
        cut = int(np.searchsorted(rid, rid[-1]))
        if cut:
            yield held[0].iloc[:cut]
            held[0] = held[0].iloc[cut:]
        n = len(held[0])
        most = max(50_000, 2 * n)
    if n:
        yield pd.concat(held, ignore_index=True)


def _facts(rows: DataFrame, *cols: str) -> DataFrame:
    """rid and arrays of the columns of its rows, all in the same order; dealt out as rows, since few of a rid lie together."""
    return rows.repartition("rid").groupBy("rid").agg(*[F.collect_list(c).alias(c) for c in cols])


def _longs(names: str) -> str:
    return ", ".join(f"{c} long" for c in names.split())


def _phrases(raw: np.ndarray) -> np.ndarray:
    """Where phrases start."""
    return np.concatenate([np.flatnonzero(_eights(raw[i : i + BLOCK + 7]) % _U(PHRASE) == 0) + i for i in range(0, max(len(raw), 1), BLOCK)])


def neighbours(df: DataFrame, keys: list[str], place: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """Sorts a written table by keys and place over ranges and compares neighbours.

    Returns place and carry of every row with name (the rank of its keys among the distinct ones), twice (a neighbour has
    the same keys) and lead (it is the first of its keys). The driver gets two rows a range.
    """
    spark, cols = df.sparkSession, [*place, *carry]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.select(*keys, *cols).repartitionByRange(parts, *keys, *place).sortWithinPartitions(*keys, *place)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, rank, held, before, first = TaskContext.get().partitionId(), 0, None, False, True

        def out(rows: pd.DataFrame, ranks, twice, lead) -> pd.DataFrame:
            new = rows[cols].assign(part=np.int32(part), rank=ranks, twice=twice, lead=lead)
            new["edge"] = None
            return new

        key = lambda row: b"".join(bytes(x) if isinstance(x, (bytes, bytearray)) else np.int64(x).tobytes() for x in row)
        for b in batches:
            if not len(b):
                continue
            rows = b if held is None else pd.concat([held, b], ignore_index=True)
            same = np.ones(len(rows) - 1, bool)
            for c in keys:
                v = rows[c].to_numpy()
                same &= (v[1:] == v[:-1]).astype(bool)
            ranks = rank + np.r_[0, np.cumsum(~same)]
            back = np.r_[before, same]
            new = out(rows, ranks, back | np.r_[same, False], ~back).iloc[:-1]
            if first and len(new):
                new.iloc[0, new.columns.get_loc("edge")] = key(rows[keys].iloc[0])
                first = False
            if len(new):
                yield new
            held, rank, before = rows.iloc[-1:], int(ranks[-1]), bool(back[-1])
        if held is not None:
            new = out(held, np.array([rank]), np.array([before]), np.array([not before]))
            new["edge"] = [key(held[keys].iloc[0])]
            yield new

    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([f"{c} {kind[c]}" for c in cols] + ["part int, rank long, twice boolean, lead boolean, edge binary"])
    done = written(ordered.mapInPandas(run, schema))
    ends: dict[int, list] = {}
    for r in done.where("edge is not null").select("part", "rank", "edge").orderBy("part", "rank").collect():
        ends.setdefault(r["part"], []).append((r["rank"], bytes(r["edge"])))
    table_, total, last = [], 0, None
    for part, found in sorted(ends.items()):
        on = found[0][1] == last
        if on:
            table_[-1][4] = True
        table_.append([part, total - on, found[-1][0], on, False])
        total, last = total - on + found[-1][0] + 1, found[-1][1]
    edges = F.broadcast(local_table(spark, table_, "part int, base long, top long, on boolean, off boolean"))  # a row a range
    head, tail = (F.col("rank") == 0) & F.col("on"), (F.col("rank") == F.col("top")) & F.col("off")
    out = done.join(edges, "part").select(*cols, (F.col("base") + F.col("rank")).alias("name"), (F.col("twice") | head | tail).alias("twice"), (F.col("lead") & ~head).alias("lead"))
    out.scratch = done.scratch
    return out


def bodies(rows: DataFrame, length: int, anchor: int) -> tuple[DataFrame, DataFrame]:
    """Of texts (rid, t): the bodies (rid, t, n: of how many pieces, places: their repeated anchors) and the pieces (text, start, rid: of the body)."""

    def anchors_of(rid, raw):
        last = -1  # blocks share the last bytes of windows, so two of them can elect one place
        for at, block in _blocks(raw, length):
            p = elected(block, length, anchor)  # never falls from window to window
            p = p[np.r_[True, p[1:] != p[:-1]] & (p + at > last)]
            last = max(last, at + int(p.max(initial=0)))
            yield _rid(rid, len(p)), _long(Prints(block).of(p, p + anchor)), p + at

    def of_joined(rids: list[int], texts: list[bytes]) -> tuple:
        raw = np.frombuffer(b"".join(texts), np.uint8)
        end = np.cumsum([len(t) for t in texts])
        p, inside = elected(raw, length, anchor), np.ones(len(raw) - length + 1, bool)
        for e in end[:-1].tolist():  # no window lies in two texts
            inside[e - length + 1 : e] = False
        p = p[inside]
        p = p[np.r_[True, p[1:] != p[:-1]]]
        k = np.searchsorted(end, p, "right")
        return np.array(rids)[k], _long(Prints(raw).of(p, p + anchor)), p - np.r_[0, end][k]

    def anchors_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for b in batches:
                parts, rids, texts, held = [], [], [], 0
                for rid, t in zip(b["rid"], b["t"]):
                    t = t.encode()
                    if len(t) > JOINED:
                        parts += anchors_of(rid, _bytes(t))
                        continue
                    rids, texts, held = rids + [rid], texts + [t], held + len(t)
                    if held > JOINED:
                        parts.append(of_joined(rids, texts))
                        rids, texts, held = [], [], 0
                if texts:
                    parts.append(of_joined(rids, texts))
                yield _frame(parts, "rid h pos")

    def pieces_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            out, held = [], 0
            for rid, t, pos in zip(b["rid"], b["t"], b["pos"]):
                raw, pos = _bytes(t), np.sort(pos)
                s, e = _spans(np.maximum(pos + anchor - length, 0), np.minimum(pos + length, len(raw)))
                for lo, hi in zip(s.tolist(), e.tolist()):
                    for at in range(lo, hi - length + 1, BLOCK):  # pieces share less than a window
                        body = raw[at : min(at + BLOCK + length - 1, hi)].tobytes()
                        places = pos[np.searchsorted(pos, at) : np.searchsorted(pos, at + len(body) - anchor + 1)] - at
                        out.append((rid, at, hashlib.blake2b(body, digest_size=16).digest(), body, places))
                        held += len(body)
                if held > 1 << 22:
                    yield pd.DataFrame(out, columns=["text", "start", "g", "t", "places"])
                    out, held = [], 0
            yield pd.DataFrame(out, columns=["text", "start", "g", "t", "places"])

    long_ = rows.where(F.octet_length("t") >= length)
    anchors = written(long_.mapInPandas(anchors_in, _longs("rid h pos")))
    twice = written(anchors.groupBy("h").count().where("count > 1").select("h"))
    cand = written(anchors.join(twice.hint(HASH), "h").select("rid", "pos"))
    forget(anchors, twice)
    near = rows.join(_facts(cand, "pos").hint(HASH), "rid")
    pieces = written(near.mapInPandas(pieces_of, "text long, start long, g binary, t binary, places array<long>"))
    forget(cand)
    one = written(pieces.groupBy("g").agg(F.count("*").alias("n"), F.first("t").alias("t"), F.first("places").alias("places")))
    named = written(one.withColumn("rid", F.monotonically_increasing_id()), bucket="rid")
    where = written(pieces.join(named.select("g", "rid").hint(HASH), "g").select("text", "start", "rid"))
    forget(pieces, one)
    return named, where


def sampled(whole: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Of bodies: the repeated triples of the sample (rid, idx, pos, len, name) and the repeats of length bytes or more (rid, pos, len)."""

    def triples_of(rid, raw):
        b = _phrases(raw)
        n = len(b) - 3
        if n > 1:
            one = Prints(raw).of(b[:-1], b[1:])
            i = np.flatnonzero(np.arange(n) % 3)
            yield _rid(rid, len(i)), i, b[i], b[i + 3] - b[i], _long(one[i]), _long(one[i + 1]), _long(one[i + 2])

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _whole_rows(batches):
            rid, idx, size, name = (b[c].to_numpy() for c in ("rid", "idx", "len", "name"))
            n, after = len(rid), np.full(len(rid), -1)
            for k in (1, 2):  # between a place and the third after it lies one sampled place at most
                i = np.flatnonzero((rid[k:] == rid[:-k]) & (idx[k:] == idx[:-k] + 3))
                after[i] = i + k
            at, span, steps = np.arange(n), np.zeros(n, np.int64), []
            while len(go := np.flatnonzero((span < length) & (at >= 0))):
                step = np.full(n, -1)
                step[go] = name[at[go]]
                steps.append(step)
                span[go] += size[at[go]]
                at[go] = after[at[go]]
            ok = np.flatnonzero(span >= length)
            out = b.iloc[ok][["rid", "pos"]].assign(len=span[ok])
            string = np.stack(steps, axis=1)[ok] if len(ok) else np.zeros((0, 1), np.int64)
            out["key"] = [row[:k].tobytes() for row, k in zip(string.astype(">i8"), (string >= 0).sum(axis=1))]
            yield out

    names = "rid idx pos len t1 t2 t3"
    triples = written(whole.select("rid", "t").mapInPandas(_per_row(triples_of, names), _longs(names)))
    ranked = neighbours(triples, ["t1", "t2", "t3"], ["rid", "idx"], ("pos", "len"))
    forget(triples)
    named = ranked.where("twice").select("rid", "idx", "pos", "len", "name")
    named.scratch = ranked.scratch
    string = named.repartition("rid").sortWithinPartitions("rid", "idx")
    keyed = written(string.mapInPandas(prefixes, "rid long, pos long, len long, key binary"))
    ranked = neighbours(keyed, ["key"], ["rid", "pos"], ("len",))
    forget(keyed)
    sure = ranked.where("twice").select("rid", "pos", "len")
    sure.scratch = ranked.scratch
    return named, sure


def remaining(whole: DataFrame, named: DataFrame, sure: DataFrame, length: int, anchor: int) -> tuple[DataFrame, tuple]:
    """The repeats (rid, pos, len) of bodies among windows that the sample leaves in doubt, and the tables they are read from."""

    def doubtful(rid, raw, places, kind, pos, size):
        n = len(raw) - length + 1
        names, known = pos[kind == 1], kind == 2
        open_ = _inside(n, places + anchor - length, places + 1)
        s, e = _spans(pos[known], pos[known] + size[known])
        keep = e - s >= length
        open_ &= ~_inside(n, s[keep], e[keep] - length + 1)
        b = _phrases(raw) if open_.any() else pos[:0]
        if len(b) > 5:
            marked = np.zeros(len(raw), bool)
            marked[names] = True
            has = marked[b]
            i = np.flatnonzero(~(has[:-5] | has[1:-4] | has[2:-3]))
            least = b[i + 5] + 8 - length  # the window holds the bytes that the last phrase's end depends on, too
            no = least <= b[i]
            open_ &= ~_inside(n, least[no], b[i[no]] + 1)
        if open_.any():
            p = np.flatnonzero(open_)
            a = elected(raw, length, anchor)[p]
            marked = np.zeros(len(raw), bool)
            marked[places] = True
            again = marked[a]
            a, p = a[again], p[again]
            k = np.flatnonzero(np.r_[True, a[1:] != a[:-1]][: len(a)])  # an anchor's windows lie side by side
            u, most, least = a[k], (a - p)[k], (a - p)[np.r_[k, len(a)][1:] - 1]
            yield _long(Prints(raw).of(u, u + anchor)), least, most

    def anchors_of(rid, raw, places):
        yield _rid(rid, len(places)), _long(Prints(raw).of(places, places + anchor)), places

    def contexts_of(rid, raw, pos, least, most):
        start, end = np.maximum(pos - most, 0), np.minimum(pos - least + length, len(raw))
        k = np.flatnonzero(end - start >= length)
        pos, start, end = pos[k], start[k], end[k]
        yield _rid(rid, len(k)), start, end, _long(Prints(raw).of(start, end)), _long(Prints(raw, _BASES[1]).of(start, end) ^ _mix((pos - start).astype(np.uint64)))

    def windows_of(rid, raw, start, end):
        p = np.flatnonzero(_inside(len(raw) - length + 1, start, end - length + 1))
        yield _rid(rid, len(p)), p.astype(np.int32), _long(Prints(raw).of(p, p + length)), (Prints(raw, _BASES[1]).of(p, p + length) >> _U(32)).astype(np.uint32).view(np.int32)

    kinds = lambda df, kind: df.select("rid", F.lit(kind).cast("long").alias("kind"), "pos", "len")
    known = _facts(kinds(named, 1).unionByName(kinds(sure, 2)), "kind", "pos", "len").hint(HASH)
    asked = whole.where("n = 1").select("rid", "t", "places").join(known, "rid", "left")
    doubts = asked.mapInPandas(_per_row(doubtful, "h least most"), _longs("h least most"))
    doubts = written(doubts.groupBy("h").agg(F.min("least").alias("least"), F.max("most").alias("most")))
    places = written(whole.select("rid", "t", "places").mapInPandas(_per_row(anchors_of, "rid h pos"), _longs("rid h pos")))
    asked = written(places.join(doubts.hint(HASH), "h").select("rid", "pos", "least", "most"))
    forget(places, doubts)
    names = "rid start end c d"
    text = whole.select("rid", "t")
    contexts = written(text.join(_facts(asked, "pos", "least", "most").hint(HASH), "rid").mapInPandas(_per_row(contexts_of, names), _longs(names)))
    forget(asked)
    # where all the bytes around an anchor are found twice, so are their windows, and one of the places speaks for all
    ranked = neighbours(contexts, ["c", "d"], ["rid", "start"], ("end",))
    forget(contexts)
    first = ranked.where("lead").select("rid", "start", "end")
    names = "rid pos h g"
    windows = written(text.join(_facts(first, "start", "end").hint(HASH), "rid").mapInPandas(_per_row(windows_of, names), "rid long, pos int, h long, g int"))
    same = neighbours(windows, ["h", "g"], ["rid", "pos"])
    forget(windows)
    whole_ = ranked.where("twice").select("rid", F.col("start").alias("pos"), (F.col("end") - F.col("start")).alias("len"))
    more = same.where("twice").select("rid", F.col("pos").cast("long").alias("pos"), F.lit(length).cast("long").alias("len"))
    return whole_.unionByName(more), (ranked, same)


def repeats(rows: DataFrame, length: int = LENGTH, anchor: int | None = None) -> DataFrame:
    """Of texts (rid, t), dealt out by rid: rid, pos, len (arrays): the repeated pieces of texts that have any."""
    anchor = anchor or length // 2
    whole, where = bodies(rows, length, anchor)
    named, sure = sampled(whole, length)
    more, behind = remaining(whole, named, sure, length, anchor)

    def union(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rid, n, size, pos, len_ in zip(b["rid"], b["n"], b["size"], b["pos"], b["len"]):
                s, e = (np.array([0]), np.array([size])) if n > 1 else _spans(pos, pos + len_) if pos is not None else (_NONE, _NONE)
                out.append((rid, s, e - s))
            yield pd.DataFrame(out, columns=["rid", "pos", "len"])

    known = _facts(sure.unionByName(more), "pos", "len").hint(HASH)
    spans = whole.select("rid", "n", F.octet_length("t").cast("long").alias("size")).join(known, "rid", "left").where("n > 1 or pos is not null")
    spans = written(spans.mapInPandas(union, "rid long, pos array<long>, len array<long>"))
    forget(named, sure, *behind)
    placed = where.join(spans.hint(HASH), "rid").select(F.col("text").alias("rid"), F.transform("pos", lambda p: p + F.col("start")).alias("pos"), "len")
    found = placed.groupBy("rid").agg(F.flatten(F.collect_list("pos")).alias("pos"), F.flatten(F.collect_list("len")).alias("len"))
    found = written(found)
    forget(whole, where, spans)
    return found


def remove(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """docs' columns and n_bytes, n_removed, spans (array of start, end: removed bytes), kept (binary, the remaining bytes) and kept_text of every row.

    kept_text lacks characters of which a byte is gone. Columns of docs that have one of these names give way to the results.
    """
    rid = fresh(docs, "rid")
    rows = written(docs.withColumn(rid, F.monotonically_increasing_id()), bucket=rid)
    found = repeats(rows.select(F.col(rid).alias("rid"), F.col(text_col).alias("t")), length)
    text, spans = F.col("text"), "array<struct<start:long,end:long>>"

    def run(t: pd.Series, places: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        out = []
        for x, pos, size in zip(t, places, sizes):
            if x is None:
                out.append((0, [], None, None))
                continue
            raw = x.encode()
            s, e = _spans(pos, pos + size)
            edges = [0, *np.stack([s, e], 1).ravel().tolist(), len(raw)]
            kept = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2]))
            out.append((len(raw) - len(kept), [{"start": a, "end": z} for a, z in zip(s.tolist(), e.tolist())], kept, kept.decode("utf-8", "ignore")))
        return pd.DataFrame(out, columns=["n_removed", "spans", "kept", "kept_text"])

    results = ("n_bytes", "n_removed", "spans", "kept", "kept_text")
    own = [c for c in docs.columns if c.lower() not in results]
    packed = rows.select(F.col(rid).alias("rid"), F.struct(*own).alias("row"), F.col(text_col).alias("text"))
    joined = packed.join(found.hint(HASH), "rid", "left")
    # texts that nothing is cut from don't go to Python; a filter on the results must not run it twice
    cut = F.pandas_udf(run, f"n_removed long, spans {spans}, kept binary, kept_text string").asNondeterministic()
    joined = joined.withColumn("cut", cut(F.when(F.col("pos").isNotNull(), text), "pos", "len"))
    kept = F.coalesce("cut.kept", text.cast("binary"), F.lit(b""))
    out = joined.select("row.*", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), "cut.n_removed", "cut.spans", kept.alias("kept"), F.coalesce("cut.kept_text", text).alias("kept_text"))
    out.behind = rows, found  # the tables to forget once the result is written
    return out


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    cut = remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
