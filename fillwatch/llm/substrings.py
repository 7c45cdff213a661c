"""Operator 4: removal of repeated 50-byte strings by a logarithmic family of sampled suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwatch.llm.common import materialise, sized

#: Bytes of a match, of an anchor within it, and anchors to choose from in each window.
MATCH, ANCHOR = 50, 24
SPREAD = MATCH - ANCHOR + 1
#: Bytes of text in one batch of the index, and suffixes that a task's index holds before it is handed on.
BATCH_BYTES, INDEX_ROWS = 1 << 20, 1_500_000
#: Bytes by which suffixes are ordered: all that windows with one anchor can cover, unless that anchor recurs in them.
ORDERED = MATCH + SPREAD - 1
_COVERED = np.tri(ORDERED + 1, ORDERED, -1, np.uint8) * np.uint8(255)
NO_ID = (1 << 63) - 1
#: Different strings around one anchor, and their bytes, that one task compares; anchors with more are compared window by window over all tasks.
HOT, HOT_BYTES = 20_000, 1 << 25

_M = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_M), -1, 1 << 64))
_TABLE = np.random.default_rng(42).integers(0, 1 << 64, 256, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of any substring of a buffer, from prefix sums; equal strings have equal hashes wherever they stand."""

    def __init__(self, buf: np.ndarray):
        self.r = _TABLE[buf]
        n = len(buf) + 1
        self.down = np.full(n, _INV)
        self.down[0] = 1
        np.multiply.accumulate(self.down, out=self.down)
        up = np.full(n, _M)
        up[0] = 1
        np.multiply.accumulate(up, out=up)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(self.r * up[:-1], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


class Suffixes(NamedTuple):
    """Sampled suffixes: anchor, hash of the string around it, document, text number, place and count of its windows."""

    g: np.ndarray
    s: np.ndarray
    doc: np.ndarray
    sub: np.ndarray
    pos: np.ndarray
    run: np.ndarray

    def take(self, i: np.ndarray) -> Suffixes:
        return Suffixes(*(x[i] for x in self))


def join(parts: list[Suffixes]) -> Suffixes:
    return Suffixes(*(np.concatenate(x) for x in zip(*parts, strict=True)))


NONE = Suffixes(np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))


class Strings(NamedTuple):
    """What the windows of suffixes cover. order: ORDERED bytes, then length and hash, so that equal strings have equal values
    and, up to ORDERED bytes, different ones different values; tails: longer ones in whole, by row."""

    order: np.ndarray
    tails: dict[int, bytes]


def strings_of(buf: np.ndarray, a: np.ndarray, n: np.ndarray, s: np.ndarray) -> Strings:
    """The strings of n bytes at places a of a buffer, with their hashes s."""
    view = np.lib.stride_tricks.sliding_window_view(np.r_[buf, np.zeros(ORDERED, np.uint8)], ORDERED)
    order = np.empty((len(a), ORDERED + 12), np.uint8)
    np.bitwise_and(view[a], _COVERED[np.minimum(n, ORDERED)], out=order[:, :ORDERED])
    order[:, ORDERED : ORDERED + 4] = n.astype(">u4").view(np.uint8).reshape(-1, 4)
    order[:, ORDERED + 4 :] = s.astype(">u8").view(np.uint8).reshape(-1, 8)
    return Strings(order.view(f"S{ORDERED + 12}").ravel(), {i: buf[a[i] : a[i] + n[i]].tobytes() for i in np.flatnonzero(n > ORDERED).tolist()})


def sample(texts: list[bytes], docs: np.ndarray, subs: np.ndarray, first: np.ndarray | None = None) -> tuple[Suffixes, Strings]:
    """The sampled suffixes of some texts (first: places of their beginnings in the whole documents), and their strings.

    Every window of MATCH bytes picks its anchor of least hash, so equal windows pick equal anchors; neighbouring
    windows with one anchor make one suffix, known by the anchor and the string that the windows cover.
    """
    lens = np.array([len(t) for t in texts], np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    if len(buf) < MATCH or not (lens >= MATCH).any():
        return NONE, Strings(np.zeros(0, f"S{ORDERED + 12}"), {})
    h, starts = Hashes(buf), np.r_[0, np.cumsum(lens)[:-1]]
    x, part = h.r, {1: h.r}
    for k in (1, 2, 4, 8):
        x = x[:-k] * _M ** np.uint64(k) + x[k:]
        part[2 * k] = x
    low = mix(part[16][:-8] * _M ** np.uint64(8) + part[8][16:])
    low, width = low, 1
    while 2 * width <= SPREAD:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    low = np.minimum(low[: len(low) - (SPREAD - width)], low[SPREAD - width :])
    many = np.maximum(0, lens - MATCH + 1)
    owner = np.repeat(np.arange(len(texts)), many)
    place = np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(many)[:-1]], many)
    at = starts[owner] + place
    val = low[at]
    new = np.flatnonzero(np.r_[True, (val[1:] != val[:-1]) | (owner[1:] != owner[:-1])])
    run = np.diff(np.r_[new, len(at)])
    a, own = at[new], owner[new]
    s = h.of(a, a + run + MATCH - 1)
    found = Suffixes(val[new], s, docs[own], subs[own], place[new] + (0 if first is None else first[own]), run)
    return found, strings_of(buf, a, run + MATCH - 1, s)


class LogIndex:
    """A family of suffix arrays whose sizes grow geometrically.

    A new batch's suffixes are put in the order of their bytes and scanned against each level in that order: where a
    suffix of the batch meets one of a level with the same bytes, the windows of the larger document's are settled, as
    they all stand in a smaller document. What meets none becomes a level itself, and levels of about equal size merge.
    Hashes only spare the scan what can't be in a level; bytes decide.
    """

    def __init__(self):
        self.levels: list[tuple[np.ndarray, Suffixes]] = []  # without repeats, neither in a level nor among them
        self.more: list[Suffixes] = []  # again in the smallest document: they share its fate, which isn't known yet
        self.tails: dict[bytes, bytes] = {}
        self.seen = np.zeros(1 << 24, bool)  # by the upper bits of hashes: what may be in a level
        self.rows = 0

    def add(self, batch: Suffixes, strings: Strings) -> Suffixes:
        """Take in a batch; returns what is settled by it."""
        settled, key = [], strings.order
        order = np.lexsort((batch.doc, key))
        apart = [i for i, c in strings.tails.items() if self.tails.setdefault(bytes(key[i]), c) != c]
        if apart:  # long strings alike in all but their tails meet at the exchange
            self.more.append(batch.take(np.array(apart)))
            order = order[~np.isin(order, apart)]
        batch = batch.take(order)
        new = np.r_[True, batch.s[1:] != batch.s[:-1]][: len(order)]
        same = np.flatnonzero(~new)
        new[same] = key[order[same]] != key[order[same - 1]]
        least = batch.doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        settled.append(batch.take(batch.doc > least))
        self.more.append(batch.take(~new & (batch.doc == least)))
        order, batch = order[new], batch.take(new)
        bits, left = batch.s >> np.uint64(40), np.ones(len(order), bool)
        mine = np.flatnonzero(self.seen[bits])
        for k, there in self.levels:
            ask = key[order[mine]]
            at = np.minimum(np.searchsorted(k, ask), len(k) - 1)  # both in order: one pass through the level
            hit = k[at] == ask
            at, met, mine = at[hit], mine[hit], mine[~hit]
            now, old = batch.doc[met], there.doc[at]
            settled.append(batch.take(met[now > old]))
            self.more.append(batch.take(met[now == old]))
            at, less = at[now < old], met[now < old]
            settled.append(there.take(at))
            for x, y in zip(there, batch, strict=True):
                x[at] = y[less]
            left[met] = False
        key, batch = key[order[left]], batch.take(left)
        self.seen[bits[left]] = True
        if len(key):
            self.levels.append((key, batch))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            (k1, b1), (k2, b2) = self.levels[-2:]
            k = np.concatenate((k1, k2))
            order = np.argsort(k, kind="stable")  # two runs in order, which it merges
            self.levels[-2:] = [(k[order], join([b1, b2]).take(order))]
        self.rows = sum(len(k) for k, _ in self.levels) + sum(len(x.g) for x in self.more)
        return join(settled)

    def flush(self) -> Suffixes:
        rows = join([NONE, *(b for _, b in self.levels), *self.more])
        self.__init__()
        return rows


OPEN, SETTLED, MIXED = 0, 1, 2
#: A row of the exchange: anchor; string hash; place; document; text number, kind and window count in one.
_ROW = "g long, s long, pos int, doc long, r long"
_FOUND = "g long, doc long, sub int, pos long, run int, kind int"
_FOUND_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]


def _batch(x: Suffixes, kind: np.ndarray) -> pa.RecordBatch:
    """Rows for the exchange, in the order of the documents (which packs well)."""
    order = np.lexsort((x.pos, x.doc))
    x, kind = x.take(order), kind[order]
    s = np.where(kind == OPEN, x.s, np.uint64(0))
    r = x.sub << 34 | kind << 32 | x.run
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (x.g.view(np.int64), s.view(np.int64), x.pos.astype(np.int32), x.doc, r)], names=["g", "s", "pos", "doc", "r"])


def _open_rows(rows: Suffixes) -> pa.RecordBatch:
    """An index as rows: of an anchor with more than two strings, two stay to be compared, all others are known to be mixed.

    The two are of different documents where the anchor has such, so that _merge sees that others need their windows.
    """
    rows = rows.take(np.lexsort((rows.doc, rows.s, rows.g)))
    new_g = np.r_[True, rows.g[1:] != rows.g[:-1]][: len(rows.g)]
    new_s = (new_g | np.r_[True, rows.s[1:] != rows.s[:-1]][: len(rows.g)]).astype(np.int64)
    group = np.cumsum(new_g) - 1
    number = np.cumsum(new_s) - np.cumsum(new_s)[np.flatnonzero(new_g)][group] if len(group) else group
    at_g = np.flatnonzero(new_g)
    other = np.where((number > 0) & (rows.doc != rows.doc[at_g][group]), number, len(number))
    second = np.minimum.reduceat(other, at_g) if len(at_g) else at_g
    second = np.where(second == len(number), 1, second)[group]
    return _batch(rows, np.where((number > 0) & (number != second), MIXED, OPEN))


def _pieces(doc: int, sub: int, text: bytes) -> Iterator[tuple[bytes, int, int, int]]:
    """Long texts in slices that share MATCH - 1 bytes, so that every window is in one."""
    for a in range(0, max(1, len(text) - MATCH + 1), BATCH_BYTES):
        yield text[a : a + BATCH_BYTES + MATCH - 1], doc, sub, a


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, hold, size = LogIndex(), [], 0

    def put() -> Iterator[pa.RecordBatch]:
        nonlocal hold, size
        if hold:
            texts, docs, subs, first = zip(*hold, strict=True)
            found, strings = sample(list(texts), np.array(docs, np.int64), np.array(subs, np.int64), np.array(first, np.int64))
            hold, size = [], 0
            if len(found.g):
                settled = index.add(found, strings)
                if len(settled.g):
                    yield _batch(settled, np.full(len(settled.g), SETTLED))
            if index.rows > INDEX_ROWS:
                yield _open_rows(index.flush())

    for batch in batches:
        for doc, sub, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            for piece in _pieces(doc, sub, text.as_py()):
                if size and size + len(piece[0]) > BATCH_BYTES:
                    yield from put()
                hold.append(piece)
                size += len(piece[0])
    yield from put()
    yield _open_rows(index.flush())


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open rows in the order of (g, s): settle equal strings of all tasks, and find anchors with several strings. Other rows pass through."""
    rest: list[np.ndarray] | None = None

    def rows(g: np.ndarray, _: np.ndarray, pos: np.ndarray, doc: np.ndarray, r: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        cols = [np.where(kind == MIXED, g, 0), doc, r >> 34, pos, r & 0xFFFFFFFF, kind]
        return pa.RecordBatch.from_arrays([pa.array(x).cast(t) for x, t in zip(cols, _FOUND_TYPES, strict=True)], names=[x.split()[0] for x in _FOUND.split(", ")])

    def settle(c: list[np.ndarray]) -> pa.RecordBatch:
        g, s, _, doc, _ = c
        new_g = np.r_[True, g[1:] != g[:-1]]
        new_s = new_g | np.r_[True, s[1:] != s[:-1]]
        group, string = np.cumsum(new_g) - 1, np.cumsum(new_s) - 1
        at_g, at_s = np.flatnonzero(new_g), np.flatnonzero(new_s)
        strings = np.bincount(group, new_s, len(at_g))
        low, high = np.minimum.reduceat(doc, at_g), np.maximum.reduceat(doc, at_g)
        least = np.minimum.reduceat(doc, at_s)[string]
        kind = np.where(doc > least, SETTLED, np.where((strings[group] > 1) & (low < high)[group], MIXED, OPEN))
        keep = kind != OPEN
        return rows(*(x[keep] for x in c), kind[keep])

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        kind = cols[4] >> 32 & 3
        known = kind != OPEN
        if known.any():
            yield rows(*(x[known] for x in cols), kind[known])
            cols = [x[~known] for x in cols]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))  # the last anchor may go on
        if cut:
            yield settle([x[:cut] for x in cols])
        rest = [x[cut:] for x in cols]
    if rest is not None and len(rest[0]):
        yield settle(rest)


_CONTEXT = "g long, doc long, sub int, pos long, run int, c binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of the mixed places of each text: the bytes of their windows."""
    for batch in batches:
        for doc, sub, text, at in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
            g, code = at.values.field("g"), np.array(at.values.field("code").to_numpy(), np.int64)
            pos, run = code >> 31, code & ((1 << 31) - 1)
            c = [text[a:b] for a, b in zip(pos.tolist(), (pos + run + MATCH - 1).tolist(), strict=True)]
            n = len(pos)
            yield pa.RecordBatch.from_arrays([g, pa.array(np.full(n, doc)), pa.array(np.full(n, sub, np.int32)), pa.array(pos), pa.array(run.astype(np.int32)), pa.array(c, pa.binary())], names=[x.split()[0] for x in _CONTEXT.split(", ")])


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of rows with contexts: their bytes, where each window starts in them, and its row and number in the row."""
    run, c = batch.column(4).to_numpy().astype(np.int64), batch.column(5)
    c = c.cast(pa.large_binary())
    offsets = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
    buf = np.frombuffer(c.buffers()[2], np.uint8) if c.buffers()[2] is not None else np.zeros(0, np.uint8)
    owner = np.repeat(np.arange(len(run)), run)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(run) - run, run)
    return buf, offsets[:-1][owner] + k, owner, k


def first_docs(buf: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The smallest document of all windows with the same bytes, for each window. Hashes bring equal ones together, bytes decide."""
    h = Hashes(buf).of(at, at + MATCH)
    order = np.lexsort((doc, h))
    new = np.r_[True, h[order][1:] != h[order][:-1]]
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # of each window in order, the one with its hash in the smallest document
    view = np.lib.stride_tricks.sliding_window_view(buf, MATCH)
    for i in range(0, len(at), 1 << 18):
        if (view[at[order[i : i + (1 << 18)]]] != view[at[head[i : i + (1 << 18)]]]).any():  # two strings with one hash
            _, kind = np.unique(np.ascontiguousarray(view[at]).view(f"V{MATCH}").ravel(), return_inverse=True)
            least = np.full(kind.max() + 1, NO_ID)
            np.minimum.at(least, kind, doc)
            return least[kind]
    out = np.empty(len(at), np.int64)
    out[order] = doc[head]
    return out


_GONE = "doc long, sub int, pos long, run int"


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of g: the windows of each anchor that also stand in a smaller document, neighbours as one run."""

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, at, owner, k = _unpacked(batch)
        doc = batch.column(1).to_numpy()
        gone = doc[owner] > first_docs(buf, at, doc[owner])
        owner, k = owner[gone], k[gone]
        new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (k[1:] != k[:-1] + 1)][: len(k)])
        i = owner[new]
        cols = [doc[i], batch.column(2).to_numpy()[i], batch.column(3).to_numpy()[i] + k[new], np.diff(np.r_[new, len(k)]).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=[x.split()[0] for x in _GONE.split(", ")])

    rest: pa.RecordBatch | None = None
    for batch in batches:
        batch = batch.set_column(5, "c", batch.column(5).cast(pa.large_binary()))  # one chunk, however many bytes
        if rest is not None:
            (batch,) = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()
        g = batch.column(0).to_numpy()
        cut = int(np.searchsorted(g, g[-1], side="left")) if len(g) else 0  # the last anchor may go on
        if cut:
            yield settle(batch.slice(0, cut))
        rest = batch.slice(cut) if len(g) else rest
    if rest is not None and rest.num_rows:
        yield settle(rest)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of rows with contexts, with its bytes."""
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            buf, at, owner, k = _unpacked(part)
            w = [bytes(x) for x in np.lib.stride_tricks.sliding_window_view(buf, MATCH)[at]] if len(at) else []
            cols = [pa.array(w, pa.binary()), part.column(1).take(pa.array(owner)), part.column(2).take(pa.array(owner)), pa.array(part.column(3).to_numpy()[owner] + k)]
            yield pa.RecordBatch.from_arrays(cols, names=["w", "doc", "sub", "pos"])


_DIGEST = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def spans_of(n: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed byte runs; runs are coded as place * 2^31 + windows."""
    if not len(runs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    runs = np.sort(runs)
    a, b = runs >> 31, (runs >> 31) + (runs & ((1 << 31) - 1)) + MATCH - 1
    top = np.maximum.accumulate(b)
    new = np.r_[True, a[1:] > top[:-1]]
    return a[new], np.minimum(n, top[np.r_[np.flatnonzero(new)[1:] - 1, len(a) - 1]])


def cut(text: bytes, runs: np.ndarray) -> tuple[bytes, int]:
    """A text without its removed spans, and how many they are."""
    starts, ends = spans_of(len(text), runs)
    return b"".join(text[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(text)], strict=True)), len(starts)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            text = text.as_py()
            kept, n = cut(text, np.array(runs.values.to_numpy(), np.int64) if runs.is_valid else np.zeros(0, np.int64))
            rows.append((key, len(text), len(text) - len(kept), n, hashlib.sha256(kept).hexdigest()))
        types = [pa.int64()] * 4 + [pa.string()]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in _DIGEST.split(", ")])


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key: the id, the largest long for null; sub tells apart texts that stand under one id, where an id stands twice."""
    key, text = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    unique = docs.select(key.alias("key")).groupBy("key").count().where("count > 1").limit(1).count() == 0
    return docs.select(key.alias("key"), text.alias("t")).withColumn("sub", F.lit(0) if unique else F.pmod(F.xxhash64("t"), F.lit(1 << 29)).cast("int"))


def _code() -> Column:
    return F.col("pos") * F.lit(1 << 31) + F.col("run")


def repeated(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """(key, sub, runs) of rows (key, sub, t): the repeated windows of each text that has any, coded as place * 2^31 + windows in a row.

    Each task keeps a LogIndex over its texts; what it can't settle alone is compared by anchor over all tasks, two rows
    at most per anchor and task. Equal strings around an anchor settle all but the smallest document's. Only where one
    anchor has different strings, at the ends of matches, are their bytes brought together, by anchor, and compared
    window by window. An anchor with over `hot` such strings, or HOT_BYTES of them, isn't brought together: its windows are counted by Spark,
    which combines equal ones before they move.
    """
    open_rows = rows.where(F.length("t") >= MATCH).select("key", "sub", "t").mapInArrow(_index, _ROW)
    dealt = F.when(F.getbit("r", F.lit(32)) + F.getbit("r", F.lit(33)) == 0, F.col("g")).otherwise(F.xxhash64("doc", "pos"))
    found = materialise(open_rows.repartition(dealt).sortWithinPartitions("g", "s").mapInArrow(_merge, _FOUND), "found")
    mixed = found.where(F.col("kind") == MIXED)
    counts = mixed.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("run").cast("long") + (MATCH - 1)).alias("size"), F.min("doc").alias("low"), F.max("doc").alias("high"))
    many = materialise(counts.where(((F.col("n") > hot) | (F.col("size") > HOT_BYTES)) & (F.col("low") < F.col("high"))).select("g"), "hot")
    places = mixed.groupBy("doc", "sub").agg(F.collect_list(F.struct("g", _code().alias("code"))).alias("at"))
    texts = rows.select(F.col("key").alias("doc"), "sub", "t")
    near = texts.hint("merge").join(places, ["doc", "sub"]).select("doc", "sub", "t", "at").mapInArrow(_contexts, _CONTEXT)
    near = materialise(near.join(sized(many.withColumn("hot", F.lit(True))), "g", "left").select(*[x.split()[0] for x in _CONTEXT.split(", ")], F.coalesce("hot", F.lit(False)).alias("hot")), "contexts")
    cold = near.where("NOT hot").drop("hot").repartition("g").sortWithinPartitions("g").mapInArrow(_resolve, _GONE)
    again = [materialise(cold, "cold")]
    if many.limit(1).count():
        windows = materialise(near.where("hot").drop("hot").mapInArrow(_windows, "w binary, doc long, sub int, pos long"), "windows")
        seen = materialise(windows.groupBy("w").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("w", "low"), "seen")
        again.append(windows.hint("merge").join(seen, "w").where("doc > low").select("doc", "sub", "pos", F.lit(1).alias("run")))
    every = found.where(F.col("kind") == SETTLED).select("doc", "sub", "pos", "run")
    for part in again:
        every = every.union(part)
    return materialise(every.groupBy("doc", "sub").agg(F.collect_list(_code()).alias("runs")).select(F.col("doc").alias("key"), "sub", "runs"), "runs")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller id, as the input stands.
    Null texts are empty; texts below 50 bytes stay whole. A null id is larger than any other. Rows repeated with one id
    are one document's texts: they never match each other, and equal ones get equal results. Other columns are ignored;
    an empty table gives an empty result.
    """
    rows = _numbered(docs, id_col, text_col)
    runs = repeated(rows)
    out = rows.hint("merge").join(runs, ["key", "sub"], "left").select("key", "t", "runs").mapInArrow(_digest, _DIGEST)
    return out.select(F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
