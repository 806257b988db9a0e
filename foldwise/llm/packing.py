"""Best-fit packing of tokenised documents into sequences of fixed length.

Documents are tokenised where they lie and cut into pieces of at most the
sequence length. A piece that fills a sequence is one. For the others only
lengths matter, and there are fewer lengths than the sequence is long: their
histogram is packed by bin completion with branch and bound, which gives a list
of fillings with multiplicities. Each piece then finds its place by its number
among the pieces of its length, in parallel. The plan's size depends on the
sequence length alone, not on the data.

The search starts from whole best-fit decreasing packings as incumbents and ends
at a lower bound on the number of sequences or after a stated number of nodes;
either way its plan holds every piece and never needs more sequences than
best-fit decreasing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .base import text_batches, written
from .text import LOWER, SPACE, blocks, column_bytes, span_hashes, word_spans

SALTS = 64
#: Bytes of texts encoded at a time.
ENCODED = 1 << 20
_KIND = np.full(256, 3, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 2
_KIND[SPACE] = 0
_MARK = "\x01"


class WordEncoder:
    """Ids of whole texts from a tokenizer that drops white space, lower-cases
    and cuts at every change between letters and punctuation, so that a run of
    either can be encoded by itself. Runs are hashed many at a time; a run not
    met lately goes through the tokenizer, its ids are kept in a table of
    bounded size. ``encode`` equals encoding each text as a whole."""

    def __init__(self, path: str, slots: int = 1 << 21, pool: int = 1 << 24):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        mark = self.tok.encode(_MARK, add_special_tokens=False).ids
        if len(mark) != 1:
            raise ValueError("the tokenizer has no single id for the separator")
        self.mark, self.slots, self.limit = mark[0], slots, pool
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.at = np.zeros(self.slots, np.int64)
        self.count = np.zeros(self.slots, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _plain(self, run: bytes) -> list[int]:
        return self.tok.encode(run.decode("utf-8", "replace"), add_special_tokens=False).ids

    def _ids(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the runs and how many each has."""
        ids, counts = [], []
        for i in range(0, len(runs), 512):
            part = runs[i:i + 512]
            if any(_MARK.encode() in r for r in part):
                got = [self._plain(r) for r in part]
                ids += [np.array(g, np.uint32) for g in got]
                counts.append(np.array([len(g) for g in got]))
                continue
            text = f" {_MARK} ".join(r.decode("utf-8", "replace") for r in part)
            got = np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)
            marks = np.flatnonzero(got == self.mark)
            counts.append(np.diff(marks, prepend=-1, append=len(got)) - 1)
            ids.append(got[got != self.mark])
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (
            np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def encode(self, raw: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows i..j-1 one after the other, and each row's bounds."""
        low = LOWER[raw[offsets[i]:offsets[j]]]
        kind = _KIND[low]
        cuts = np.flatnonzero((kind[1:] ^ kind[:-1]) == 3) + 1  # 1 beside 2, never 0 beside 3
        cuts = cuts[(kind[cuts] != 0) & (kind[cuts - 1] != 0)]
        s, e, first = word_spans(low, offsets[i:j + 1] - offsets[i], cuts)
        h = span_hashes(low, s, e) | np.uint64(1)
        if self.used > self.limit:
            self.reset()
        slot = (h >> np.uint64(20)).astype(np.int64) & (self.slots - 1)
        hit = self.keys[slot] == h
        at, count = self.at[slot], self.count[slot]
        if not hit.all():
            miss = np.flatnonzero(~hit)
            new, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            body = low.tobytes()
            ids, n = self._ids([body[s[k]:e[k]] for k in miss[where]])
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool[:self.used],
                                            np.zeros(max(len(ids), self.used) + (1 << 16), np.uint32)])
            self.pool[self.used:self.used + len(ids)] = ids
            start = self.used + np.cumsum(n) - n
            self.used += len(ids)
            at[miss], count[miss] = start[back], n[back]
            put = (new >> np.uint64(20)).astype(np.int64) & (self.slots - 1)
            # of two new runs in one slot the same one must win in all three tables
            put, one = np.unique(put, return_index=True)
            self.keys[put], self.at[put], self.count[put] = new[one], start[one], n[one]
        ends = np.cumsum(count.astype(np.int64))
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(at - (ends - count), count) + np.arange(total)] if total else np.zeros(0, np.uint32)
        bounds = np.concatenate([[0], ends])[first] if len(ends) else np.zeros(j - i + 1, np.int64)
        return ids, bounds


class PlainEncoder:
    """Any tokenizer: each text is encoded as a whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True

    def encode(self, raw, offsets, i, j):
        texts = [raw[offsets[k]:offsets[k + 1]].tobytes().decode("utf-8", "replace") for k in range(i, j)]
        got = [self.tok.encode(t, add_special_tokens=False).ids for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int64)
        return np.array([x for g in got for x in g], np.uint32), bounds


def _pieces(path: str, capacity: int, end: int, words: bool, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()      # what this worker's earlier tasks left
        coder = (WordEncoder if words else PlainEncoder)(path)
        tail = np.array([end], np.uint32).tobytes()
        for batch in batches:
            raw, offs = column_bytes(batch.column(1))
            for i, j in blocks(offs, ENCODED):
                ids, bounds = coder.encode(raw, offs, i, j)
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for r in range(j - i):
                    a, b = int(bounds[r]), int(bounds[r + 1])
                    n = b - a + 1
                    for p, at in enumerate(range(0, n, capacity)):
                        size = min(capacity, n - at)
                        last = at + size == n
                        body = ids[a + at:a + at + size - last]
                        sum_ = zlib.crc32(body)
                        row.append(i + r)
                        piece.append(p)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(tail, sum_) if last else sum_)
                        if with_ids:
                            kept.append(np.append(body, np.uint32(end)).astype(np.int64) if last else body.astype(np.int64))
                cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = [batch.schema.names[0], "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
    return run


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: pieces above ``capacity - k`` share
    none with a piece of ``k`` or more, pieces above the half share none with
    each other, and what is left goes by size; the best ``k`` counts (0: size
    alone)."""
    sizes = np.zeros(capacity + 2, object)
    for x, c in histogram.items():
        sizes[x] += c
    number = np.concatenate([[0], np.cumsum(sizes)])          # number[x]: pieces below x
    weight = np.concatenate([[0], np.cumsum(sizes * np.arange(capacity + 2))])
    half = capacity // 2
    best = -(-weight[-1] // capacity)
    for k in [0, *(x for x in histogram if x <= half)]:
        alone = number[-1] - number[capacity - k + 1]         # longer than capacity - k
        pairs = number[capacity - k + 1] - number[half + 1]   # up to that, above the half
        room = pairs * capacity - (weight[capacity - k + 1] - weight[half + 1])
        small = weight[half + 1] - weight[k]                  # k to the half
        best = max(best, alone + pairs + max(0, -(-(small - room) // capacity)))
    return int(best)


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing on the histogram: equal sequences are kept as one
    filling and a number, so the work follows the lengths and not the pieces."""
    plan, rooms, open_ = [], [], {}

    def put(fill: list[int], times: int, room: int) -> None:
        if room == 0:
            plan.append((fill, times))
        else:
            if room not in open_:
                insort(rooms, room)
            open_.setdefault(room, []).append((fill, times))

    for x in sorted(histogram, reverse=True):
        left = histogram[x]
        while left:
            at = bisect_left(rooms, x)
            if at == len(rooms):
                room, fill, times = capacity, [], left
            else:
                room = rooms[at]
                fill, times = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            each = min(room // x, left)                       # best fit stays with a sequence it began
            used = min(times, left // each)
            put(fill + [x] * each, used, room - x * each)
            if fill and times > used:
                put(fill, times - used, room)
            left -= used * each
    return plan + [group for room in rooms for group in open_[room]]


def dominated(fill: list[int], waste: int, spare: int) -> bool:
    """Whether another filling takes the place of this one without loss: some
    spare length (a bit of ``spare`` each) fits where a part of the filling
    was, and holds that part; also when it just fits the room left."""
    sums, several = 1, 0                                      # bit s: some part sums to s
    for x in fill:
        several |= (sums ^ 1) << x | several << x
        sums |= sums << x
    reach, width = sums << 1, 1                               # s + 1 .. s + waste
    if waste == 0:
        reach = 0
    while width < waste:
        step = min(width, waste - width)
        reach |= reach << step
        width += step
    return bool((reach | several) & spare)


def best_filling(lengths: list[int], counts: dict[int, int], room: int, nodes: int = 2000) -> list[int]:
    """The filling of ``room`` that wastes least, found depth-first, largest
    lengths (``lengths`` descend) first, until no waste is left or ``nodes`` are
    visited; the first one is the best-fit filling."""
    return next(iter(fillings(lengths, counts, room, nodes, first=True)), [])


def fillings(lengths: list[int], counts: dict[int, int], room: int, nodes: int, first: bool = False,
             most: int = 16) -> list[list[int]]:
    """Undominated fillings of ``room``, least waste first, among those met in
    ``nodes`` steps; at most ``most`` of them. ``first``: only the best one. A
    length that fills the room by itself dominates all others."""
    fit = [x for x in lengths if x <= room and counts[x] > 0]
    if not fit:
        return [[]]
    if fit[0] == room:
        return [[room]]
    down = [-x for x in fit]
    spare = 0
    for x in fit:
        spare |= 1 << x
    found: list[tuple[int, tuple[int, ...]]] = []
    seen = set()
    least = room + 1
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    while stack and nodes:
        k, left, used = stack.pop()
        nodes -= 1
        k = max(k, bisect_left(down, -left))
        if k == len(fit):
            if (left < least if first else used not in seen):
                seen.add(used)
                least = min(least, left)
                found.append((left, used))
                if first and left == 0:
                    break
            continue
        x = fit[k]
        taken = 0
        for y in reversed(used):
            if y != x:
                break
            taken += 1
        stack.append((k + 1, left, used))
        if taken < counts[x]:
            stack.append((k, left - x, (*used, x)))
    found.sort(key=lambda f: (f[0], [-x for x in f[1]]))
    if first:
        return [list(used) for _, used in found[:1]]
    out = []
    for waste, used in found:
        own = spare
        for x, n in Counter(used).items():
            if n >= counts[x]:
                own &= ~(1 << x)
        if not dominated(list(used), waste, own):
            out.append(list(used))
            if len(out) == most:
                break
    return out


def sequences(plan: list[tuple[list[int], int]]) -> int:
    return sum(times for _, times in plan)


def completion_plan(histogram: dict[int, int], capacity: int, nodes: int = 2000,
                    branches: int = 2000) -> list[tuple[list[int], int]]:
    """Fillings and how often each is used, from the number of pieces of each
    length, by bin completion. A node takes the largest piece left and completes
    its sequence: first with the least waste, as often as the counts allow, then,
    when the search comes back, once with each undominated filling. A node goes
    no further when the sequences used, and those that the size of the rest
    needs, reach the incumbent (so waste beyond what the incumbent leaves ends a
    branch). Best-fit decreasing gives the first incumbent, and the rest below
    every alternative is packed by it too. The search ends at the lower bound,
    when nothing is left to try, or after ``branches`` alternatives; ``nodes``
    limits the steps within one sequence."""
    counts = {x: c for x, c in histogram.items() if c > 0 and 0 < x <= capacity}
    lengths = sorted(counts, reverse=True)
    best = best_fit_plan(counts, capacity)
    most, goal = sequences(best), lower_bound(counts, capacity)
    rest = sum(x * c for x, c in counts.items())
    path: list[tuple[list[int], int]] = []                    # (filling, times) taken so far
    ways: list[list[tuple[list[int], int]] | None] = []       # alternatives at each node; None: not made yet
    used = 0

    def take(fill: list[int], times: int, sign: int) -> None:
        nonlocal used, rest
        for x in fill:
            counts[x] -= sign * times
        used += sign * times
        rest -= sign * times * sum(fill)

    def completions(first: bool) -> list[tuple[list[int], int]]:
        order = [x for x in lengths if counts[x]]
        top = order[0]
        counts[top] -= 1
        if first:
            found = [best_filling(order, counts, capacity - top, nodes)]
        else:
            found = fillings(order, counts, capacity - top, nodes)
        counts[top] += 1
        if not first:
            return [([top, *f], 1) for f in reversed(found)]
        fill = [top, *found[0]]
        return [(fill, min(counts[x] // n for x, n in Counter(fill).items()))]

    fresh_node = True
    while most > goal:
        if fresh_node:
            if rest == 0 and used < most:
                best, most = list(path), used
            if rest and used - (-rest // capacity) < most:
                ways.append(None)
                step = completions(True)[0]
                path.append(step)
                take(*step, 1)
                continue
            fresh_node = False
        if not path:
            break
        last = path.pop()
        take(*last, -1)
        if ways[-1] is None:
            ways[-1] = [w for w in completions(False) if w != last]
        if not ways[-1] or branches == 0:
            ways.pop()
            if branches == 0:
                break
            continue
        branches -= 1
        step = ways[-1].pop()
        path.append(step)
        take(*step, 1)
        tail = best_fit_plan({x: c for x, c in counts.items() if c}, capacity)
        if used + sequences(tail) < most:
            best = path + tail
            most = sequences(best)
        fresh_node = True
    return best


def placement(plan: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first number, first sequence, offset) sorted by the first
    two: piece ``k`` of a length lies in the last row that starts at or before
    ``k``, in sequence ``first sequence + k - first number``."""
    used: dict[int, int] = {}
    rows, seq = [], 0
    for fill, times in plan:
        offset = 0
        for x in fill:
            rows.append((x, used.get(x, 0), seq, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        seq += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _place(table: np.ndarray) -> Callable:
    keys = (table[:, 0] << 44) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("_number").to_numpy()
            at = np.searchsorted(keys, (length << 44) + number, "right") - 1
            names = [c for c in batch.schema.names if c != "_number"]
            cols = [batch.column(c) for c in names]
            cols += [pa.array(table[at, 2] + number - table[at, 1]), pa.array(table[at, 3])]
            yield pa.RecordBatch.from_arrays(cols, [*names, "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer: str, ident: str = "doc_id", text: str = "text",
         capacity: int = 2048, end: int = 0, words: bool = True, with_ids: bool = False,
         nodes: int = 2000, branches: int = 2000) -> DataFrame:
    """Place of every piece of every document: ``ident``, piece, start, length,
    ids_crc32, sequence_id, offset, and with ``with_ids`` the ids.

    A document is its ids and then ``end``; null and empty texts are just
    ``end``. Only documents above ``capacity`` are cut, at its multiples. Rows
    that repeat, also with null identifiers, are packed one by one. An empty
    table gives an empty table; columns other than the two named are not read.
    ``tokenizer``: a file for the ``tokenizers`` library; ``words``: it cuts at
    white space and punctuation (see WordEncoder), else texts go whole.
    ``nodes`` and ``branches`` limit the search (see completion_plan); beyond
    them the best plan found stays, never worse than best-fit decreasing."""
    spark = docs.sparkSession
    ship_package(spark)
    src = docs.select(F.col(ident), F.col(text).cast("string"))
    kind = src.schema[ident].dataType.simpleString()
    schema = f"`{ident}` {kind}, piece int, start long, length long, ids_crc32 long"
    schema += ", ids array<long>" if with_ids else ""
    with text_batches(spark):
        pieces = written(src.mapInArrow(_pieces(tokenizer, capacity, end, words, with_ids), schema)
                         .withColumn("_row", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < capacity).withColumn(
        "_salt", F.expr(f"cast(pmod(xxhash64(_row, 3L), {SALTS}) as int)"))
    counts = written(short.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")), "counts")
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = placement(completion_plan(hist, capacity, nodes, branches))
    before = Window.partitionBy("length").orderBy("_salt")
    shift = counts.select("length", "_salt", (F.sum("_n").over(before) - F.col("_n")).alias("_shift"))
    own = Window.partitionBy("length", "_salt").orderBy("_row")
    # at most capacity * SALTS rows, whatever the data
    numbered = (short.withColumn("_own", F.row_number().over(own) - 1)
                .join(F.broadcast(shift), ["length", "_salt"])
                .withColumn("_number", F.col("_own") + F.col("_shift")))
    names = [ident, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    out_schema = schema + ", sequence_id long, offset long"
    placed = numbered.select(*names, F.col("_number").cast("long")).mapInArrow(_place(table), out_schema)
    full = pieces.where(F.col("length") == capacity).select(
        *names, (-F.col("_row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(placed)
