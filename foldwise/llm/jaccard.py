"""Exact n-gram Jaccard join by a token-group matrix.

Every text is the set of its word shingles. Equal sets are one class. In a
global order that puts frequent tokens last, two classes that are similar
enough share a token among the first of each (the prefix). Classes that share
prefix tokens are partitioned into groups; a group stores the union of its
members' prefix tokens. How many of a query's prefix tokens lie in that union
bounds its overlap with every member, and only groups whose bound allows the
wanted similarity are opened: there the whole sets are compared. First classes
meet their own group; what is found similar becomes one component. Components
are the groups of the second pass, so that a large group of near copies is met
once by each of its tokens, not by each pair of its members. Components are
paired by tokens that can be the first shared one of similar sets; a token that
comes late in many sets makes no pairs of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .base import text_batches, written
from .components import components
from .shingles import CELLS, prefix, set_hash, shingle_sets
from .text import blocks, column_bytes

SALTS = 32
#: A group is opened in blocks of at most so many members or tokens.
MEMBERS, TOKENS = 512, 1_000_000
#: Sizes of one group differ by this factor at most; the second pass meets the others.
BAND = 1.1
#: Queries that meet one block in one task.
ASKERS = 1024
#: Up to so many identifiers are broadcast (16 bytes each), more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Tokens of different sets looked at together for local frequencies, and the
#: count that makes one worth telling: tokens of many sets are told by many
#: chunks. Any counts give right results, they only set the order.
CHUNK, LOCAL = 2_000_000, 2
#: Rows of a batch of tokens.
SENT = 16_384


def _chunk(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    tokens, df = np.unique(np.concatenate(found), return_counts=True)
    many = df >= LOCAL
    return tokens[many].astype(np.int64), df[many].astype(np.int64)


def _scan(size: int) -> Callable:
    """Rows of two kinds: a document with its set's size and class, or a token
    that is frequent among the documents looked at together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None
        found, held, seen = [], 0, set()

        def frequent(kind):
            tokens, df = _chunk(found)
            for i in range(0, len(tokens), SENT):
                some = tokens[i:i + SENT]
                none = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(some), kind), none, none, pa.array(some),
                                                  pa.array(df[i:i + SENT])], names)

        for batch in batches:
            kind = batch.column(0).type
            names = [batch.schema.names[0], "n", "cls", "token", "df"]
            raw, offs = column_bytes(batch.column(1))
            n, cls = [], []
            for i, j in blocks(offs):
                for s in shingle_sets(raw, offs, i, j, size):
                    n.append(len(s))
                    cls.append(set_hash(s) if len(s) else None)
                    if cls[-1] not in seen:
                        seen.add(cls[-1])
                        found.append(s)
                        held += len(s)
                if held >= CHUNK:
                    yield from frequent(kind)
                    found, held, seen = [], 0, set()
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()),
                                              pa.array(cls, pa.int64()), none, none], names)
        if found:
            yield from frequent(kind)
    return run


def _post(size: int, percent: int, level: np.ndarray, bits: int) -> Callable:
    """Prefix tokens of every class met in a block of texts, dealt to buckets by
    their leading bits: (bucket, the next 32 bits of each token, its class, its
    reach there)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = column_bytes(batch.column(0))
            for i, j in blocks(offs):
                seen, tokens, owner, reach = set(), [], [], []
                for s in shingle_sets(raw, offs, i, j, size):
                    if len(s) and (c := set_hash(s)) not in seen:
                        seen.add(c)
                        p, far = prefix(s, level, percent)
                        tokens.append(p)
                        reach.append(far.astype(np.int32))
                        owner.append(np.full(len(p), c, np.int64))
                if not tokens:
                    continue
                t, o = np.concatenate(tokens), np.concatenate(owner)
                bucket = (t >> np.uint64(64 - bits)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
                rest = ((t >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order]
                o, far = o[order], np.concatenate(reach)[order]
                full = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full.astype(np.int32)),
                     pa.array([rest[cut[b]:cut[b + 1]].tobytes() for b in full], pa.binary()),
                     pa.array([o[cut[b]:cut[b + 1]].tobytes() for b in full], pa.binary()),
                     pa.array([far[cut[b]:cut[b + 1]].tobytes() for b in full], pa.binary())],
                    ["bucket", "tokens", "owners", "reach"])
    return run


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket, the postings of tokens that two classes or more have."""
    t = np.frombuffer(b"".join(pdf["tokens"]), np.uint32)
    o = np.frombuffer(b"".join(pdf["owners"]), np.int64)
    far = np.frombuffer(b"".join(pdf["reach"]), np.int32)
    order = np.lexsort((-far, o, t))
    t, o, far = t[order], o[order], far[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (o[1:] != o[:-1])
    t, o, far = t[new], o[new], far[new]
    same = np.zeros(len(t) + 1, bool)
    same[1:-1] = t[1:] == t[:-1]
    keep = same[1:] | same[:-1]
    return pd.DataFrame({"tok": (np.int64(pdf["bucket"].iloc[0]) << 32) + t[keep].astype(np.int64),
                         "cls": o[keep], "reach": far[keep]})


def _sets(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = column_bytes(batch.column(0))
            cls, tokens = [], []
            for i, j in blocks(offs):
                for s in shingle_sets(raw, offs, i, j, size):
                    if len(s):
                        cls.append(set_hash(s))
                        tokens.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(tokens, pa.binary())],
                                             ["cls", "tokens"])
    return run


class Group:
    """Members' whole sets with the union of their tokens."""

    def __init__(self, sets: list[bytes]):
        parts = [np.frombuffer(s, np.uint64) for s in sets]
        self.size = np.array([len(p) for p in parts], np.int64)
        flat = np.concatenate(parts)
        order = np.argsort(flat, kind="stable")
        self.member = np.repeat(np.arange(len(parts)), self.size)[order]
        self.union, self.start = np.unique(flat[order], return_index=True)
        self.count = np.diff(self.start, append=len(flat))

    def similar(self, tokens: bytes, percent: int) -> np.ndarray:
        """Numbers of the members similar enough to a query set."""
        q = np.frombuffer(tokens, np.uint64)
        at = np.searchsorted(self.union, q)
        at = at[at < len(self.union)] if len(at) and at[-1] >= len(self.union) else at
        at = at[self.union[at] == q[:len(at)]]
        if 100 * len(at) < percent * len(q):          # the union's overlap bounds every member's
            return np.zeros(0, np.int64)
        n = self.count[at]
        flat = np.repeat(self.start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(self.member[flat], minlength=len(self.size))
        return np.flatnonzero(100 * both >= percent * (self.size + len(q) - both))


def _inside(percent: int) -> Callable:
    """Links within a block: each member's smallest similar component."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cls")
        cls, group = pdf["cls"].to_numpy(), Group(list(pdf["tokens"]))
        root = np.arange(len(cls))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for k, tokens in enumerate(pdf["tokens"]):
            for m in group.similar(tokens, percent):
                a, b = find(k), find(m)
                root[max(a, b)] = min(a, b)
        top = np.array([find(k) for k in range(len(cls))])
        return pd.DataFrame({"cls": cls, "comp": cls[top]})
    return run


def _across(percent: int) -> Callable:
    """Links between the components of queries and of a block's members."""
    def run(members: pd.DataFrame, askers: pd.DataFrame) -> pd.DataFrame:
        pairs = set()
        if len(members) and len(askers):
            group = Group(list(members["tokens"]))
            comp = members["comp"].iloc[0]
            for own, tokens in zip(askers["a_comp"], askers["a_tokens"]):
                if (own, comp) not in pairs and len(group.similar(tokens, percent)):
                    pairs.add((own, comp))
        return pd.DataFrame(sorted(pairs), columns=["a", "b"]).astype("int64")
    return run


def _fraction(percent: int) -> tuple[float, float]:
    return percent / 100, percent / (100 + percent)


def _may_qualify(m: Column, n: Column, least: Column, most: Column, percent: int) -> Column:
    """Whether ``m`` prefix tokens of a query of ``n`` tokens, found in a group
    of members of ``least`` to ``most`` tokens, leave room for a similar one.

    The overlap of similar sets of n and s tokens is t / (1 + t) * (n + s) at
    least; beyond the shared prefix tokens it can hold ceil(t * max(n, s)) - 1
    more. Rounded, the difference can be smaller inside a range of sizes than
    at its ends, so for more sizes than one it is bounded before rounding."""
    t, r = _fraction(percent)
    lo, hi = F.greatest(least, F.ceil(n * t - 1e-9)), F.least(most, F.floor(n / t + 1e-9))
    needed = F.when(lo == hi, _needed(n, lo, t, r)).otherwise(
        F.least(_needed_at_least(n, lo, t, r), _needed_at_least(n, hi, t, r)))
    return (lo <= hi) & (m >= F.greatest(F.lit(1), needed))


def _needed(a: Column, b: Column, t: float, r: float) -> Column:
    """Prefix tokens that similar sets of just ``a`` and ``b`` tokens share at least."""
    return F.ceil((a + b) * r - 1e-9) - F.ceil(F.greatest(a, b) * t - 1e-9) + 1


def _needed_at_least(a: Column, b: Column, t: float, r: float) -> Column:
    """No more than ``_needed``: ceil(x) - ceil(y) >= floor(x - y). Below the
    floor it is concave in the sizes, so over a range its least value is at an
    end, over a rectangle at a corner."""
    return F.floor((a + b) * r - F.greatest(a, b) * t + 1e-9) + 1


class _Join:
    def __init__(self, docs: DataFrame, ident: str, text: str, size: int, percent: int):
        self.docs = docs.select(F.col(ident).alias("_id"), F.col(text).cast("string").alias("_text"))
        self.size, self.percent = size, percent
        self.spark = docs.sparkSession
        ship_package(self.spark)

    def scan(self) -> None:
        kind = self.docs.schema["_id"].dataType.simpleString()
        with text_batches(self.spark):
            rows = written(self.docs.mapInArrow(_scan(self.size),
                                                f"_id {kind}, n long, cls long, token long, df long"), "scan")
        self.rows = rows.where("n is not null").select("_id", "n", "cls").withColumn(
            "_salt", F.expr(f"cast(pmod(xxhash64(_id), {SALTS}) as int)"))
        self.parts = self.rows.where("cls is not null").groupBy("cls", "_salt").agg(
            F.min("_id").alias("_id"), F.max("n").alias("n"))
        self.classes = written(self.parts.groupBy("cls").agg(F.min("_id").alias("_id"), F.max("n").alias("n")),
                               "classes")
        often = (rows.where("token is not null").groupBy("token").agg(F.sum("df").alias("df"))
                 .groupBy(F.col("token").bitwiseAND(CELLS - 1).alias("cell"))
                 .agg((F.floor(F.log2(F.max("df"))) + 1).cast("short").alias("level")).toArrow())
        self.level = np.zeros(CELLS, np.uint8)               # at most a row a cell
        self.level[often["cell"].to_numpy()] = often["level"].to_numpy()

    def postings(self) -> None:
        total = self.classes.agg(F.sum("n")).collect()[0][0] or 0
        bits = max(6, int(np.ceil(np.log2(total / 2_000_000 + 1))))
        bits = max(bits, (int(self.spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
        bits = min(bits, 30)
        post = self.docs.select("_text").mapInArrow(_post(self.size, self.percent, self.level, bits),
                                                    "bucket int, tokens binary, owners binary, reach binary")
        with text_batches(self.spark):
            self.shared = written(post.groupBy("bucket").applyInPandas(_shared, "tok long, cls long, reach int"),
                                  "shared")

    def groups(self) -> None:
        """Members (cls, n, g): a class joins the group of the smallest hash of
        its shared tokens among classes of about its size (a band of sizes, so
        that the bound is sharp), in blocks of bounded size."""
        first = self.shared.groupBy("cls").agg(F.min(F.xxhash64("tok")).alias("key"))
        band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(BAND))).cast("int")
        member = first.join(self.classes.select("cls", "n"), "cls").withColumn("key", F.xxhash64("key", band))
        size = member.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
        size = size.where("c > 1").select("key", _blocks())
        self.member = written(member.join(size, "key").select("cls", "n", _block("key").alias("g")), "members")

    def sets(self, need: DataFrame) -> DataFrame:
        """Whole sets of the classes in ``need``, from one text of each."""
        need = written(need.select("cls").distinct().join(self.classes.select("cls", "_id"), "cls"), "need")
        keys = need.select(F.xxhash64("_id").alias("_key")).distinct()
        keys = F.broadcast(keys) if need.count() <= BROADCAST_ROWS else keys
        docs = self.docs.withColumn("_key", F.xxhash64("_id")).join(keys, "_key", "left_semi").select("_text")
        found = docs.mapInArrow(_sets(self.size), "cls long, tokens binary")
        found = found.join(need.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])
        return written(found, "sets")

    def within(self) -> DataFrame:
        """(cls, comp) of the classes found similar to one of their own group."""
        own = self.shared.join(self.member, "cls")
        union = own.groupBy("g", "tok").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("g", "tok")
        span = self.member.groupBy("g").agg(F.min("n").alias("least"), F.max("n").alias("most"))
        open_ = (own.join(union, ["g", "tok"]).groupBy("cls", "n", "g").agg(F.count(F.lit(1)).alias("m"))
                 .join(span, "g").where(_may_qualify(F.col("m"), F.col("n"), F.col("least"), F.col("most"),
                                                     self.percent)).select("cls", "g"))
        open_ = written(open_, "open")
        held = self.sets(open_)
        found = open_.join(held, "cls").groupBy("g").applyInPandas(_inside(self.percent), "cls long, comp long")
        return written(found, "within")

    def components_that_meet(self, comp: DataFrame) -> DataFrame:
        """(own, other, single): pairs of components that may hold a link, by
        the overlap of their token unions; ``own`` has no more classes than
        ``other``, and ``single`` says that it has one. Pairs come
        from tokens that can be the first of a similar pair's, for the smaller
        set within its own size; then all their shared tokens are counted."""
        held = comp.groupBy("comp").agg(F.count(F.lit(1)).alias("c"))
        base = self.shared.join(self.classes.select("cls", "n"), "cls").join(comp, "cls")
        self.tokens = written(base, "tokens")
        union = self.tokens.groupBy("tok", "comp").agg(
            F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("reach").alias("reach"))
        many = union.groupBy("tok").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("tok")
        self.union = written(union.join(many, "tok").join(held, "comp"), "unions")
        a = self.union.select(F.col("comp").alias("own"), "tok", F.col("lo").alias("alo"), F.col("hi").alias("ahi"),
                              F.col("c").alias("ac"), F.col("reach").alias("areach"))
        b = self.union.select(F.col("comp").alias("other"), F.col("tok").alias("tok_"), F.col("lo").alias("blo"),
                              F.col("hi").alias("bhi"), F.col("c").alias("bc"), F.col("reach").alias("breach"))
        near = F.col("tok") == F.col("tok_")
        for lo, hi in (("alo", "bhi"), ("blo", "ahi")):      # sizes that can be similar
            near &= F.col(hi) >= F.ceil(F.col(lo) * (self.percent / 100) - 1e-9)
        x, y = (F.struct(F.col(n).alias("c"), F.col(i).alias("id")) for n, i in (("ac", "own"), ("bc", "other")))
        pairs = (a.where("areach >= alo").join(b, near & F.expr("own <> other and areach >= blo and breach >= alo"))
                 .select(F.least(x, y)["id"].alias("own_"), F.greatest(x, y)["id"].alias("other_")).distinct())
        pairs = written(pairs, "pairs")
        met = (pairs.join(a, F.col("own_") == F.col("own"))
               .join(b, near & (F.col("other_") == F.col("other"))))
        met = met.groupBy("own", "other", "ac").agg(
            F.count(F.lit(1)).alias("m"), *[(F.min if c.endswith("lo") else F.max)(c).alias(c)
                                            for c in ("alo", "ahi", "blo", "bhi")])
        return written(met.where(_may_link(self.percent)).select(
            "own", "other", (F.col("ac") == 1).alias("single")), "meetings")

    def queries_of(self, pairs: DataFrame) -> DataFrame:
        """(cls, own, other): of the pairs (own, other, was_own, was_other), the
        classes of the first whose overlap with the second's union allows a link."""
        pairs = pairs.select("own", "other", F.col("was_own").alias("comp"), "was_other")
        asked = self.tokens.join(pairs, "comp").join(
            self.union.select("tok", F.col("comp").alias("was_other"), "lo", "hi"), ["tok", "was_other"])
        return asked.groupBy("cls", "n", "own", "other", "was_other").agg(
            F.count(F.lit(1)).alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where(
            _may_qualify(F.col("m"), F.col("n"), F.col("lo"), F.col("hi"), self.percent)).select(
            "cls", "own", "other").distinct()

    def open(self, pairs: DataFrame, comp: DataFrame) -> DataFrame:
        """Links (a, b) between components, from queries ``pairs`` (cls, own,
        other): the members of each other component, in blocks, meet them."""
        target = pairs.select(F.col("other").alias("comp")).distinct()
        member = comp.join(target, "comp").join(self.classes.select("cls", "n"), "cls")
        size = member.groupBy("comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
        size = size.select("comp", _blocks())
        askers = pairs.groupBy(F.col("other").alias("comp")).agg(
            F.ceil(F.count(F.lit(1)) / ASKERS).cast("int").alias("turns"))
        size = written(size.join(askers, "comp"), "sizes")
        held = self.sets(pairs.select("cls").unionByName(member.select("cls")))
        member = (member.join(size, "comp").withColumn("block", _block("comp"))
                  .withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
                  .join(held, "cls").select("comp", "block", "turn", "tokens"))
        asker = (pairs.select("cls", "own", F.col("other").alias("comp")).join(size, "comp")
                 .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                 .withColumn("block", F.xxhash64("comp", "k"))
                 .withColumn("turn", F.pmod(F.xxhash64("cls"), F.col("turns")).cast("int"))
                 .select("cls", "own", "comp", "block", "turn")
                 .join(held, "cls").select("own", "block", "turn", "tokens")).toDF("a_comp", "a_block", "a_turn", "a_tokens")
        return member.groupBy("block", "turn").cogroup(asker.groupBy("a_block", "a_turn")).applyInPandas(
            _across(self.percent), "a long, b long")

    def run(self) -> DataFrame:
        """(cls, comp) for classes that share tokens with others."""
        self.scan()
        self.postings()
        self.groups()
        comp = written(self.shared.select("cls").distinct().join(self.within(), "cls", "left").select(
            "cls", F.coalesce("comp", "cls").alias("comp")), "components")
        pairs = self.components_that_meet(comp).withColumns({"was_own": F.col("own"), "was_other": F.col("other")})
        # one query for each pair first: most links show there, and a single class is then done
        for asked in (lambda p: p.select(F.col("own").alias("cls"), "own", "other"), self.queries_of):
            if pairs.isEmpty():
                break
            label = components(self.open(written(asked(pairs), "asked"), comp))
            if label is not None:
                rename = lambda df, c: (df.join(label.toDF(c, "_to"), c, "left")
                                        .withColumn(c, F.coalesce("_to", c)).drop("_to"))
                comp = written(rename(comp, "comp"), "components")
                pairs = rename(rename(pairs, "own"), "other")
            pairs = written(pairs.where("own <> other and not single"), "pairs")
        return comp


def _may_link(percent: int) -> Column:
    """Whether ``m`` shared tokens allow a link between sets of alo..ahi and of
    blo..bhi tokens: what is needed at least (see ``_needed_at_least``) is
    smallest at a corner of the sizes that count; where these reach the limit
    of similar sizes, one token is enough."""
    t, r = _fraction(percent)
    corners = [(F.col(a), F.col(b)) for a in ("alo", "ahi") for b in ("blo", "bhi")]
    exact = (F.col("alo") == F.col("ahi")) & (F.col("blo") == F.col("bhi"))
    needed = F.when(exact, _needed(F.col("alo"), F.col("blo"), t, r)).otherwise(
        F.least(*[_needed_at_least(a, b, t, r) for a, b in corners]))
    within = F.lit(True)
    for a, b in corners:
        within &= F.least(a, b) >= F.ceil(F.greatest(a, b) * t - 1e-9)
    meet = (F.col("ahi") >= F.ceil(F.col("blo") * t - 1e-9)) & (F.col("bhi") >= F.ceil(F.col("alo") * t - 1e-9))
    return meet & (F.col("m") >= F.greatest(F.lit(1), F.when(within, needed).otherwise(1)))


def _blocks() -> Column:
    return F.greatest(F.ceil(F.col("c") / MEMBERS), F.ceil(F.col("s") / TOKENS)).cast("int").alias("blocks")


def _block(key: str) -> Column:
    return F.xxhash64(F.col(key), F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))


def similarity_components(docs: DataFrame, ident: str = "doc_id", text: str = "text", size: int = 5,
                          percent: int = 75) -> DataFrame:
    """One row a document: ``ident``, n_shingles and component_id, the smallest
    identifier among the documents reachable by links. Two documents link when
    100 * intersection >= percent * union of their sets of ``size``-word
    shingles, words lower-cased A-Z.

    A text of fewer words is one shingle, a null, empty or blank text has an
    empty set and links with nothing (component_id is its own). Repeated rows
    are documents of their own; a null identifier is the smallest only if its
    component has no other; an empty table gives an empty table; columns other
    than the two named are not read. Sets are told apart by 64-bit hashes."""
    job = _Join(docs, ident, text, size, percent)
    comp = job.run()
    named = (job.classes.join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")))
    low = named.groupBy("comp").agg(F.min("_id").alias("component_id"))
    answer = named.select("cls", "comp").join(low, "comp").select("cls", "component_id")
    answer = job.parts.select("cls", "_salt").join(answer, "cls")
    # a large class is joined part by part; documents without words have none
    full = job.rows.where("cls is not null").join(answer, ["cls", "_salt"])
    none = job.rows.where("cls is null").withColumn("component_id", F.col("_id"))
    cols = [F.col("_id").alias(ident), F.col("n").alias("n_shingles"), "component_id"]
    return full.select(*cols).unionByName(none.select(*cols))
