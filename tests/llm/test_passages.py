"""Repeated passages against brute force."""

import collections
import hashlib
import random
import re

from foldwise.llm.line_dedup import PASSAGE_WORDS, REACH, repeated_passages

SCHEMA = "doc_id long, text string, _row int, unit string, removed int, words string"


def _table():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(4000)] + ["Éa", "ß", "The,", "x'y"]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    passage = some(80)
    texts = [" ".join(some(rng.randint(1, 200))) for _ in range(30)]
    for k in range(6):          # the same words, in other lines and between other words
        w = some(40) + [x.upper() if k % 2 else x for x in passage] + some(30)
        texts.append("".join(x + rng.choice([" ", " ", "\n", "\t \x0b"]) for x in w))
    texts += [None, "", " \n\t", "one", texts[0], texts[0].upper(), " ".join(passage[:60] * 2), "  " + texts[1] + " \n",
              "a\x00b é" + " c" * 5000, " ".join(some(30_000))]
    rows = [(k, t, 1, "u", 0, "w") for k, t in enumerate(texts)]
    return rows + [rows[3], (None, texts[2], 1, "u", 0, "w"), (None, None, 1, "u", 0, "w")]


def _phrases(text):
    low = (text or "").encode().lower().decode()
    at, held, out = 0, [], []
    split = [w for w in re.split(r"[\x20\x09-\x0d]+", low) if w]
    h = [hashlib.md5(w.encode()).hexdigest()[:8] for w in split]
    for k, w in enumerate(split):
        a = low.index(w, at)
        at = a + len(w)
        held.append((w, a, at))
        least = all(h[k] <= x for x in h[max(0, k - REACH):k]) and all(h[k] <= x for x in h[k + 1:k + 1 + REACH])
        if least or k == len(split) - 1:
            out.append((tuple(x for x, _, _ in held), held[0][1], at))
            held = []
    return out


def _brute(rows):
    """Runs as (doc_id, start, length, words), and the words kept or removed in all."""
    places = collections.defaultdict(list)
    cut = [_phrases(r[1]) for r in rows]
    for i, units in enumerate(cut):
        for k, (w, _, _) in enumerate(units):
            places[w].append((rows[i][0] is None, rows[i][0] or 0, i, k))
    out = []
    for i, units in enumerate(cut):
        run = []
        for k, u in enumerate([*units, None]):
            if u is not None and len(places[u[0]]) > 1:
                run.append((k, u))
                continue
            n = sum(len(w) for _, (w, _, _) in run)
            if n >= PASSAGE_WORDS:
                gone = sum(len(w) for j, (w, _, _) in run if min(places[w])[2:] != (i, j))
                out.append((rows[i][0], run[0][1][1], run[-1][1][2] - run[0][1][1], n, gone, 2 * gone <= n))
            run = []
    return out


def test_passages(spark):
    rows = _table()
    found = repeated_passages(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    order = lambda t: (t[0] is None, t[0] or 0, *t[1:])
    assert sorted((tuple(r) for r in found), key=order) == sorted(_brute(rows), key=order)
    shared = {r.doc_id for r in found if r.doc_id is not None and 30 <= r.doc_id < 36}
    assert shared == set(range(30, 36))
    assert sum(r.kept for r in found if r.doc_id in shared) == 1


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repeated_passages(none).count() == 0
    assert repeated_passages(spark.createDataFrame([(1, None, 1, "", 0, "")], SCHEMA)).count() == 0


def test_only_repeated_units_become_rows(spark):
    from pyspark.sql import functions as F

    from foldwise.llm.line_dedup import _phrases as cut
    from foldwise.llm.line_dedup import _units_again
    texts = [" ".join(f"w{k}x{i}" for i in range(300)) for k in range(40)]
    rows = [(k, 2**53 + k if k else None, t) for k, t in enumerate([*texts, texts[7]])]
    src = spark.createDataFrame(rows, "_row long, doc_id long, _text string").repartition(5)
    found = _units_again(src, cut, 1)
    assert {r._row for r in found.select("_row").distinct().collect()} == {7, 40}
    assert found.groupBy("digest").count().where("count <> 2").count() == 0
    ids = {r.doc_id for r in found.select("doc_id").distinct().collect()}
    assert ids == {2**53 + 7, 2**53 + 40}
    assert found.agg(F.sum("words")).collect()[0][0] == 600
