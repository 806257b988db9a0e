"""Token counts of sections by offset-mapped attribution: a text is encoded
once as a whole, token spans follow from the tokens' byte lengths, and each
span is joined to the section intervals it meets."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

RULES = ("first", "largest", "share")
PART = 1 << 20
#: A blank between two marks that are not blank: a token never spans the place before it.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


class ByteTokenizer:
    """A byte-level BPE from a ``tiktoken`` rank file."""

    def __init__(self, path: str, pattern: str):
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def lengths(self, text: str) -> np.ndarray:
        """Byte length of each token of the whole text. A very long text goes
        through in parts that end where no token spans the cut."""
        parts, at = [], 0
        while len(text) - at > PART:
            m = _SAFE.search(text, at + PART)
            if not m:
                break
            parts.append(text[at:m.start()])
            at = m.start()
        parts.append(text[at:])
        got = [self.enc.encode_to_numpy(p, allowed_special=set(), disallowed_special=()) for p in parts if p]
        return self.sizes[np.concatenate(got).astype(np.int64)] if got else np.zeros(0, np.int64)


def attribute(sizes: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and how many cross its end. ``sizes``: byte
    lengths of the tokens; ``bounds``: section starts, with the text's end."""
    n = len(bounds) - 1
    end = np.cumsum(sizes)
    start = end - sizes
    a = np.searchsorted(bounds, start, "right") - 1
    b = np.searchsorted(bounds, end, "left") - 1
    crossing = np.bincount(a[a < b], minlength=n)
    if rule == "first":
        return np.bincount(a, minlength=n).astype(float), crossing
    tokens = np.bincount(a[a == b], minlength=n).astype(float)
    for k in np.flatnonzero(a < b):
        s = np.arange(a[k], b[k] + 1)
        part = np.minimum(bounds[s + 1], end[k]) - np.maximum(bounds[s], start[k])
        if rule == "share":
            tokens[s] += part / sizes[k]
        else:
            tokens[s[np.argmax(part)]] += 1
    return tokens, crossing


def _count(path: str, pattern: str, rule: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = ByteTokenizer(path, pattern)
        for batch in batches:
            got: list[list] = [[] for _ in range(7)]
            for r, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                raw = np.frombuffer(text.encode(), np.uint8)
                inner = np.flatnonzero(raw == 10) + 1
                bounds = np.concatenate([[0], inner, [len(raw)]])
                sizes = tok.lengths(text)
                tokens, crossing = attribute(sizes, bounds, rule)
                # characters before each bound: bytes that don't continue one
                heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[bounds]
                n = len(tokens)
                for col, v in zip(got, (np.full(n, r), np.arange(n), heads[:-1], np.diff(heads), tokens,
                                        crossing, np.full(n, len(sizes)))):
                    col.append(v)
                if sum(map(len, got[0])) >= 100_000:
                    yield _batch(batch, got)
                    got = [[] for _ in range(7)]
            if got[0]:
                yield _batch(batch, got)
    return run


def _batch(batch: pa.RecordBatch, got: list[list]) -> pa.RecordBatch:
    row, section, start, length, tokens, crossing, total = [np.concatenate(c) for c in got]
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(row)), pa.array(section.astype(np.int32)), pa.array(start.astype(np.int64)),
         pa.array(length.astype(np.int64)), pa.array(tokens), pa.array(crossing.astype(np.int64)),
         pa.array(total.astype(np.int64))],
        [batch.schema.names[0], "section", "start", "length", "tokens", "crossing", "doc_tokens"])


def section_tokens(docs: DataFrame, tokenizer: str, pattern: str, ident: str = "doc_id",
                   text: str = "text", rule: str = "first") -> DataFrame:
    """One row a section (a line with the line end after it): ``ident``,
    section (from 0), start and length (characters), tokens, crossing (tokens
    that reach over its end) and doc_tokens (of the whole text).

    A token that lies in several sections goes by ``rule`` to that of its
    first byte ("first"), to the one holding most of its bytes, ties to the
    earlier ("largest"), or to all by their share of its bytes ("share"); so a
    document's sections always add up to its tokens. Null and empty texts have
    one section without tokens, an empty table gives an empty table, repeated
    rows are counted alike; columns other than the two named are not read.
    ``tokenizer``: a ``tiktoken`` rank file with its split ``pattern``."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship_package(docs.sparkSession)
    src = docs.select(F.col(ident), F.col(text).cast("string"))
    kind = src.schema[ident].dataType.simpleString()
    return src.mapInArrow(_count(tokenizer, pattern, rule), f"`{ident}` {kind}, section int, start long, "
                          "length long, tokens double, crossing long, doc_tokens long")
