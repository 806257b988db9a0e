"""Conversation structure repair by a run-length dynamic programme.

Rows of a conversation become symbols (role initial, fault). What one symbol
costs from state to state is a 4 x 4 matrix in (min, +): the states say what
the repaired roles so far are (nothing, s, .. u, .. a). Equal consecutive
symbols are one run; a run of any length advances through binary powers of its
matrix, which are kept. Costs to go come from the end; the choices are then
unrolled from the start, a run by halves down to its rows.

Matrices of parts multiply, so a conversation may be dealt over any number of
range partitions: each gives its matrix, the products give the costs to go at
the ends of the parts, and each part is unrolled by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ship_package
from .base import crc32_text, partitions, written

BLANKS = "\t\n\x0b\x0c\r "
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
INF = float("inf")
#: States: nothing yet, a leading s, ends with u, ends with a.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Inserting, or writing, the next role: user except after a user.
NEXT = (USER, USER, ASSISTANT, USER)
ACCEPT = (0, INF, INF, 0)
#: Symbols: 0 must go; else 1 + 2 * role (s, u, a, other) + truncated.
GONE = 0
ROLES = {"s": 0, "u": 1, "a": 2}
#: Bytes of repaired text in one row of a part.
PIECE = 1 << 20


def _closed(v: tuple) -> tuple:
    """Costs to go when rows may be inserted first."""
    v = list(v)
    for _ in range(3):
        v = [min(v[s], INSERT + v[NEXT[s]]) for s in range(4)]
    return tuple(v)


def _moves(symbol: int) -> list[list[tuple[str, int, int]]]:
    """For each state the ways (letter, cost, next state) to take the symbol's row."""
    out = []
    for s in range(4):
        ways = [("D", DELETE, s)]
        if symbol != GONE:
            role, extra = divmod(symbol - 1, 2)
            kept = {0: SYSTEM if s == START else None, 1: USER if s != USER else None,
                    2: ASSISTANT if s == USER else None}.get(role)
            if kept is not None:
                ways.append(("K", KEEP + TRUNCATED * extra, kept))
            ways.append(("R", REROLE + TRUNCATED * extra, NEXT[s]))
        out.append(ways)
    return out


@cache
def power(symbol: int, k: int) -> tuple:
    """Cost matrix of 2**k rows of the symbol, rows inserted before each."""
    if k:
        half = power(symbol, k - 1)
        return tuple(tuple(min(half[s][m] + half[m][t] for m in range(4)) for t in range(4)) for s in range(4))
    columns = []
    for t in range(4):
        after = [0 if s == t else INF for s in range(4)]
        columns.append(_closed(tuple(min(c + after[n] for _, c, n in ways) for ways in _moves(symbol))))
    return tuple(tuple(columns[t][s] for t in range(4)) for s in range(4))


@cache
def _step(symbol: int, k: int, v: tuple) -> tuple:
    m = power(symbol, k)
    return tuple(min(m[s][t] + v[t] for t in range(4)) for s in range(4))


def advance(symbol: int, length: int, v: tuple) -> tuple:
    """Costs to go before a run, from those after it."""
    low = min(v)
    v, k = tuple(x - low for x in v), 0
    while length:
        if length & 1:
            v = _step(symbol, k, v)
            base = min(v)
            low, v = low + base, tuple(x - base for x in v)
        length >>= 1
        k += 1
    return tuple(x + low for x in v)


@cache
def _choice(symbol: int, v: tuple, state: int) -> tuple[str, int]:
    """The ASCII-least cheapest letters that take one row, and the state after."""
    letters, moves, low = "", _moves(symbol), min(v)
    v = tuple(x - low for x in v)
    before = _closed(tuple(min(c + v[n] for _, c, n in ways) for ways in moves))
    while True:
        ways = [(letter, n) for letter, c, n in moves[state] if c + v[n] == before[state]]
        if ways and ways[0][0] == "D":
            return letters + "D", ways[0][1]
        if INSERT + before[NEXT[state]] == before[state]:
            letters, state = letters + "I", NEXT[state]
            continue
        return letters + min(ways)[0], min(ways)[1]


def unroll(symbol: int, length: int, v: tuple, state: int, out: list[str]) -> int:
    """Append the letters of a run that ends with costs to go ``v``."""
    if length == 1:
        low = min(v)
        letters, state = _choice(symbol, tuple(x - low for x in v), state)
        out.append(letters)
        return state
    half = length // 2
    state = unroll(symbol, half, advance(symbol, length - half, v), state, out)
    return unroll(symbol, length - half, v, state, out)


def ending(state: int) -> str:
    """Letters that complete the roles after the last row."""
    n = 0
    while state not in (START, ASSISTANT):
        state, n = NEXT[state], n + 1
    return "I" * n


def runs_of(symbols: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Equal consecutive symbols as one run."""
    out: list[tuple[int, int]] = []
    for symbol, n in symbols:
        if n and out and out[-1][0] == symbol:
            out[-1] = (symbol, out[-1][1] + n)
        elif n:
            out.append((symbol, n))
    return out


def plan_runs(runs: list[tuple[int, int]], state: int, end: tuple) -> tuple[str, int, float]:
    """Audit letters of runs entered in ``state`` with costs to go ``end``
    after them, the state after, and the costs to go before."""
    after = [end]
    for symbol, n in reversed(runs):
        after.append(advance(symbol, n, after[-1]))
    cost, out = after.pop()[state], []
    for symbol, n in runs:
        state = unroll(symbol, n, after.pop(), state, out)
    return "".join(out), state, cost


def matrix_of(runs: list[tuple[int, int]]) -> list[float]:
    """The cost matrix of runs, a row a state, flat."""
    columns = []
    for t in range(4):
        v = tuple(0 if s == t else INF for s in range(4))
        for symbol, n in reversed(runs):
            v = advance(symbol, n, v) if min(v) < INF else v
        columns.append(v)
    return [float(columns[t][s]) for s in range(4) for t in range(4)]


def damaged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows (_conv, _turn, _role, _text, _n copies) after the damage that
    crc32('conv:turn') % 20 names; nulls read as one space."""
    space = F.lit(" ")

    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), space)

    kind = crc32_text(F.concat(spaced(conv), F.lit(":"), spaced(turn))) % 20
    return rows.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), spaced(role).alias("_role"),
                       spaced(text).alias("_text"), kind.alias("_kind")).where("_kind <> 0").select(
        "_conv", "_turn", F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("_role")).alias("_role"),
        F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.translate("_text", ".!?", ""))
        .otherwise(F.col("_text")).alias("_text"),
        F.when(F.col("_kind") == 3, 2).otherwise(1).alias("_n"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one with their number ``_n``; ``_seen`` says
    that an earlier turn has the role and text. The first turn of a text comes
    back part by part, so that one repeated in every turn is no hot key."""
    rows = rows.groupBy("_conv", "_turn", "_role", "_text").agg(F.sum("_n").alias("_n"))
    rows = written(rows.withColumns({"_sha": F.sha2(F.concat(F.length("_role").cast("string"), F.lit(":"), "_role", "_text"), 256),
                                     "_deal": F.expr("cast(pmod(xxhash64(_turn), 32) as int)")}), "turns")
    order = F.struct(F.col("_turn").isNotNull().alias("known"), F.col("_turn").alias("turn"))
    low = rows.groupBy("_conv", "_sha", "_deal").agg(F.min(order).alias("_first"))
    low = low.groupBy("_conv", "_sha").agg(F.min("_first").alias("_first"), F.collect_set("_deal").alias("_deals"))
    low = low.select(F.col("_conv").alias("_c"), F.col("_sha").alias("_s"), "_first",
                     F.explode("_deals").alias("_d"))
    met = rows.join(low, rows["_conv"].eqNullSafe(low["_c"]) & (rows["_sha"] == low["_s"])
                    & (rows["_deal"] == low["_d"]))
    body = F.rtrim(F.col("_text"), F.lit(BLANKS))
    return met.select("_conv", "_turn", "_role", "_text", "_n", (body == "").alias("_blank"),
                      (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("_cut"),
                      (order != F.col("_first")).alias("_seen"))


def _symbols(role: str, n: int, blank: bool, cut: bool, seen: bool) -> list[tuple[int, int]]:
    if blank or seen:
        return [(GONE, n)]
    return [(1 + 2 * ROLES.get(role[:1], 3) + cut, 1), (GONE, n - 1)]


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows that agree in the first ``width`` columns."""
    key, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if row[:width] != key:
                if held:
                    yield key, held
                key, held = row[:width], []
            held.append(row[width:])
    if held:
        yield key, held


def _runs(rows: list[tuple]) -> list[tuple[int, int]]:
    return runs_of([s for role, n, blank, cut, seen in rows for s in _symbols(role, n, blank, cut, seen)])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (conv, part), rows in _groups(batches, 2):
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([part], pa.int32()),
                                          pa.array([matrix_of(_runs(rows))], pa.list_(pa.float64()))],
                                         ["_conv", "_part", "matrix"])


def _ends(plan: dict) -> Callable:
    """For each part the state after it, by the state before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, part), rows in _groups(batches, 2):
            runs, end = _runs(rows), plan[conv, part]
            ends = [plan_runs(runs, s, end)[1] for s in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([part], pa.int32()),
                                              pa.array([ends], pa.list_(pa.int32()))], ["_conv", "_part", "ends"])
    return run


def _lines(rows: list[tuple], audit: str, state: int) -> Iterator[str]:
    """Repaired ``role:text`` lines of the letters ``audit``."""
    letters = iter(audit)
    for role, n, text in rows:
        while n:
            letter = next(letters)
            n -= letter != "I"
            if letter == "D":
                continue
            if letter == "K":
                state = SYSTEM if role[:1] == "s" and state == START else NEXT[state]
                yield f"{role}:{text}"
            else:
                state = NEXT[state]
                yield f"{'user' if state == USER else 'assistant'}:{text if letter == 'R' else ''}"
    for _ in letters:
        state = NEXT[state]
        yield f"{'user' if state == USER else 'assistant'}:"


NAMES = ["_piece", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "first", "last", "lines",
         "repaired", "sha"]
KINDS = [pa.int32(), *[pa.int64()] * 5, *[pa.string()] * 3, pa.int64(), pa.binary(), pa.string()]
PART = ("_piece int, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
        "first string, last string, lines long, repaired binary, sha string")


def _repaired(plan: dict, kind: pa.DataType) -> Callable:
    """Rows (_conv, _part, then PART). A conversation within one part is done:
    its row has the hash. One of several parts has rows of at most PIECE bytes
    of repaired lines, the part's counts in the first of them."""
    def rows_of(conv, part, rows):
        state, end = plan.get((conv, part), (START, None))
        last = end is None
        audit, after, cost = plan_runs(_runs([(r, n, b, c, seen) for r, _, n, b, c, seen in rows]), state,
                                       _closed(ACCEPT) if last else end)
        audit += ending(after) if last else ""
        cost -= 0 if last else end[after]                   # what this part itself costs
        blank = sum(n for _, _, n, b, _, _ in rows if b)
        twice = sum(n if seen else n - 1 for _, _, n, b, _, seen in rows if not b)
        cut = sum(1 for _, _, _, b, c, seen in rows if c and not b and not seen)
        initials = [r[0][:1] for r in rows]
        wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        wrong += sum(r[2] - 1 for r in rows)                 # a copy follows its like
        head = [blank, twice, cut, wrong, int(cost), audit, initials[0], initials[-1]]
        lines = _lines([(role, n, text) for role, text, n, _, _, _ in rows], audit, state)
        if (conv, part) not in plan:
            digest = hashlib.sha256()
            for k, line in enumerate(lines):
                digest.update((("\n" if k else "") + line).encode())
            yield [conv, part, 0, *head, 0, None, digest.hexdigest()]
            return
        piece, size, number = [], 0, 0
        for line in lines:
            piece.append(line)
            size += len(line)
            if size >= PIECE:
                yield [conv, part, number, *head, len(piece), "\n".join(piece).encode(), None]
                piece, size, number, head = [], 0, number + 1, [0, 0, 0, 0, 0, "", "", ""]
        if piece or not number:
            yield [conv, part, number, *head, len(piece), "\n".join(piece).encode(), None]

    kinds = [kind, pa.int32(), *KINDS]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                          ["_conv", "_part", *NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for (conv, part), rows in _groups(batches, 2):
            for row in rows_of(conv, part, rows):
                held.append(row)
                size += len(row[-2] or b"") + len(row[8]) + 200
                if size > 4 * PIECE:
                    yield batch(held)
                    held, size = [], 0
        if held:
            yield batch(held)
    return run


def _whole(kind: pa.DataType) -> Callable:
    """Join the pieces of conversations, in order, a piece at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, audit, digest, lines, last = (), [0] * 5, [], None, 0, None

        def answer():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(now), kind), *[pa.array([s], pa.int64()) for s in sums],
                 pa.array(["".join(audit)]), pa.array([digest.hexdigest()])],
                ["_conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                conv, piece, *counts, letters, first, end, n, data = row
                if (conv,) != now:
                    if now:
                        yield answer()
                    now, sums, audit, digest, lines, last = (conv,), [0] * 5, [], hashlib.sha256(), 0, None
                sums = [a + b for a, b in zip(sums, counts)]
                if piece == 0:                                # a part begins
                    sums[3] += last is not None and last + first not in ("su", "ua", "au")
                    last = end
                audit.append(letters)
                if n:
                    digest.update((b"\n" if lines else b"") + data)
                    lines += n
        if now:
            yield answer()
    return run


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           damage: bool = True) -> DataFrame:
    """One row a conversation: ``conv``, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256 of the cheapest edits that give the
    role initials ``(s?(ua)+)?``.

    Rows are taken by turn (null first), equal turns by role and text. Null
    role or text reads as one space, so it is never kept as a role and a null
    text is blank; a null ``conv`` is a conversation of its own. ``damage``
    first harms the rows as :func:`damaged` says. A conversation without rows
    after it has zeros, an empty audit and the hash of nothing. Repeated rows
    are duplicates; an empty table gives an empty table; other columns are not
    read.

    A conversation of any size is dealt over range partitions. Its audit is one
    cell, and the hash of its text reads that text in order, so the pieces of a
    conversation that spans partitions pass, one at a time, through one task."""
    spark = rows.sparkSession
    ship_package(spark)
    source = rows.select(*{conv, turn, role, text})
    kind = rows.schema[conv].dataType
    arrow, sql = to_arrow_type(kind), kind.simpleString()
    space = F.lit(" ")
    hurt = damaged(source, conv, turn, role, text) if damage else source.select(
        F.col(conv).alias("_conv"), F.col(turn).alias("_turn"),
        F.coalesce(F.col(role).cast("string"), space).alias("_role"),
        F.coalesce(F.col(text).cast("string"), space).alias("_text"), F.lit(1).alias("_n"))
    order = ["_conv", "_turn", "_role", "_text"]
    dealt = written(with_faults(hurt).repartitionByRange(max(1, partitions(spark)), *order)
                    .withColumn("_part", F.spark_partition_id()), "dealt")
    # at most one conversation goes on from a partition to the next
    span = dealt.groupBy("_conv").agg(F.min("_part").alias("a"), F.max("_part").alias("b")).where("a < b")
    span = span.select("_conv").withColumn("_spans", F.lit(True))
    marked = dealt.join(F.broadcast(span.withColumnRenamed("_conv", "_k")),
                        F.col("_conv").eqNullSafe(F.col("_k")), "left").drop("_k")
    lean = ["_conv", "_part", "_role", "_n", "_blank", "_cut", "_seen"]
    parted = marked.where("_spans").repartition("_part").sortWithinPartitions("_part", *order).select(*lean)
    plan = {}
    found = parted.mapInArrow(_matrices, f"_conv {sql}, _part int, matrix array<double>").collect()
    if found:
        after = {}
        by = {}
        for r in sorted(found, key=lambda r: r["_part"]):
            by.setdefault(r["_conv"], []).append((r["_part"], r["matrix"]))
        for c, parts in by.items():
            v = _closed(ACCEPT)
            for part, m in reversed(parts):
                after[c, part] = v
                v = tuple(min(m[4 * s + t] + v[t] for t in range(4)) for s in range(4))
        ends = {(r["_conv"], r["_part"]): r["ends"] for r in
                parted.mapInArrow(_ends(after), f"_conv {sql}, _part int, ends array<int>").collect()}
        for c, parts in by.items():
            state = START
            for k, (part, _) in enumerate(parts):
                plan[c, part] = (state, after[c, part] if k + 1 < len(parts) else None)
                state = ends[c, part][state]
    full = (dealt.repartition("_part").sortWithinPartitions("_part", *order)
            .select("_conv", "_part", "_role", "_text", "_n", "_blank", "_cut", "_seen"))
    done = written(full.mapInArrow(_repaired(plan, arrow), f"_conv {sql}, _part int, {PART}"), "repaired")
    pieces = (done.where("sha is null").repartition("_conv").sortWithinPartitions("_conv", "_part", "_piece")
              .select("_conv", *NAMES[:-1]))
    joined = pieces.mapInArrow(_whole(arrow), f"_conv {sql}, blank long, duplicate long, truncated long, "
                               "illegal long, cost long, audit string, sha string")
    whole = done.where("sha is not null").select(*joined.columns).unionByName(joined)
    turns = dealt.groupBy("_conv", "_turn").agg(F.lit(1).alias("x")).groupBy("_conv").agg(
        F.coalesce(F.max("_turn") - F.min("_turn") + 1 - F.count("_turn"), F.lit(0)).cast("long").alias("gaps"))
    ids = source.select(F.col(conv).alias("_id")).distinct()
    answer = (ids.join(whole, F.col("_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
              .join(turns.withColumnRenamed("_conv", "_c"), F.col("_id").eqNullSafe(F.col("_c")), "left"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c)
            for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return answer.select(F.col("_id").alias(conv), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))



def _crc_sql(text: str) -> str:
    """crc32 of an ASCII text, bit by bit."""
    step = "xor(x >> 1, (x & 1) * 3988292384)"
    byte = f"list_reduce(range(8), lambda x, i: {step}, xor(c, b))"
    codes = f"list_transform(string_split({text}, ''), lambda ch: unicode(ch)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: {byte}, 4294967295::BIGINT), 4294967295::BIGINT)"


REPAIR_SQL = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM raw WHERE kind <> 0),
numbered AS (
  SELECT conv_id, role, text, regexp_replace(text, '[ 	-]+$', '') AS body,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
         left(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy), 1)
           || left(role, 1) AS pair
  FROM hurt),
item AS (
  SELECT conv_id, i, role, text, left(role, 1) AS r, pair,
         CASE WHEN body = '' THEN 'blank' WHEN again > 1 THEN 'duplicate'
              WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM numbered),
-- states: 0 nothing, 1 s, 2 .. u, 3 .. a; before a row and at the end up to two rows are inserted
filled(state, ins, cost, letters, lines) AS (
  VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
         (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']),
         (3, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']),
         (1, 3, 6, 'II', ['user:', 'assistant:']), (2, 2, 6, 'II', ['assistant:', 'user:']),
         (3, 3, 6, 'II', ['user:', 'assistant:'])),
way(ins, letter, r, cost, state) AS (
  SELECT x::INTEGER, 'D', NULL::VARCHAR, 4, x::INTEGER FROM range(4) t(x)
  UNION ALL VALUES (0, 'K', 's', 0, 1), (0, 'K', 'u', 0, 2), (1, 'K', 'u', 0, 2), (3, 'K', 'u', 0, 2),
                   (2, 'K', 'a', 0, 3), (0, 'R', NULL, 3, 2), (1, 'R', NULL, 3, 2), (2, 'R', NULL, 3, 3),
                   (3, 'R', NULL, 3, 2)),
move AS (
  SELECT f.state AS s, w.r, w.letter, w.state AS t, f.cost + w.cost AS cost, f.letters || w.letter AS letters,
         f.lines FROM filled f JOIN way w ON w.ins = f.ins),
path AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS s,
         {{'cost': 0, 'letters': '', 'lines': []::VARCHAR[]}} AS best
  FROM (SELECT DISTINCT conv_id FROM hurt)
  UNION ALL
  SELECT p.conv_id, n.i, m.t,
         min({{'cost': (best.cost + m.cost + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 3 ELSE 0 END)::INTEGER,
               'letters': best.letters || m.letters,
               'lines': list_concat(best.lines, m.lines, CASE letter WHEN 'D' THEN []::VARCHAR[]
                          WHEN 'K' THEN [role || ':' || text]
                          ELSE [(CASE WHEN m.t = 2 THEN 'user:' ELSE 'assistant:' END) || text] END)}})
  FROM path p JOIN item n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.i = p.i + 1
  JOIN move m ON m.s = p.s AND (m.r IS NULL OR m.r = n.r)
             AND (m.letter = 'D' OR fault NOT IN ('blank', 'duplicate'))
  GROUP BY p.conv_id, n.i, m.t),
fin AS (
  SELECT p.conv_id, min({{'cost': best.cost + f.cost, 'letters': best.letters || f.letters,
                          'lines': list_concat(best.lines, f.lines)}}) AS best
  FROM path p JOIN filled f ON f.state = p.s AND f.ins IN (0, 3)
  WHERE p.i = (SELECT max(i) FROM item n WHERE n.conv_id IS NOT DISTINCT FROM p.conv_id) GROUP BY p.conv_id),
counts AS (
  SELECT conv_id, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM item GROUP BY conv_id),
gap AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM hurt GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.letters, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN gap g ON g.conv_id IS NOT DISTINCT FROM o.conv_id
"""
