"""Conversation repair, filter interaction audit and SimHash classes against
brute force, on tables with nulls, empty and very long texts, ties, repeated
rows, clashing column names and no rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from foldwise.llm import filter_audit, repair, simhash

TALK = "conv_id long, turn long, role string, text string, _conv long, _n int, audit string, sha string"


def _conversations():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "u", "", None, "Assistant"]
    texts = ["Fine.", "And then", "What?", "", " \t", None, "No! ", "a.b", "line\none."]
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, None if rng.random() < 0.1 else turn + rng.randint(0, 3),
                         rng.choice(roles[:3]) if rng.random() < 0.8 else rng.choice(roles),
                         rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
    for turn in range(900):                          # a conversation that holds most rows
        rows.append((77, turn // 3, ("user", "assistant")[turn % 2], f"reply {turn // 7}."))
    rows += [(77, 5, "user", "again.")] * 300 + [rows[0], rows[0], (500, 1, "system", "Alone."), (501, None, None, None)]
    return [(*r, 1, 2, "x", "y") for r in rows]


def _harm(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def _cheapest(rows):
    """Forward dynamic programme over whole (cost, letters, lines), a row at a time."""
    def inserted(best):
        for _ in range(4):
            for s, (c, a, t) in list(best.items()):
                n = {"": "u", "s": "u", "u": "a", "a": "u"}[s]
                new = (c + 3, a + "I", t + [{"u": "user:", "a": "assistant:"}[n]])
                best[n] = min(best.get(n, new), new)
        return best

    best = {"": (0, "", [])}
    for role, text, fault in rows:
        after = {}
        for s, (c, a, t) in inserted(best).items():
            n = {"": "u", "s": "u", "u": "a", "a": "u"}[s]
            ways = [(s, (c + 4, a + "D", t))]
            if fault not in ("blank", "duplicate"):
                c += 3 * (fault == "truncated")
                if role[:1] == n or (role[:1] == "s" and s == ""):
                    ways.append((role[:1], (c, a + "K", t + [f"{role}:{text}"])))
                ways.append((n, (c + 3, a + "R", t + [{"u": "user:", "a": "assistant:"}[n] + text])))
            for state, new in ways:
                after[state] = min(after.get(state, new), new)
        best = after
    best = inserted(best)
    return min(best[s] for s in ("", "a") if s in best)


def _repaired(rows):
    want = {}
    harmed = _harm(rows)
    for conv in {r[0] for r in rows}:
        items = sorted(harmed.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in items:
            body = text.rstrip("\t\n\x0b\x0c\r ")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else
                          "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in items]
        turns = [r[0] for r in items if r[0] is not None]
        cost, audit, lines = _cheapest([(r, t, f) for (_, r, t), f in zip(items, faults)])
        want[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                      *[faults.count(k) for k in ("blank", "duplicate", "truncated")],
                      sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                      cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return want


@pytest.mark.parametrize("parts", [1, 8])
def test_repair(spark, parts, monkeypatch):
    rows = _conversations()
    monkeypatch.setattr(repair, "PIECE", 300)
    monkeypatch.setattr(repair, "partitions", lambda _: parts)
    got = repair.repair(spark.createDataFrame(rows, TALK).repartition(3)).collect()
    assert len(got) == len({r[0] for r in rows})
    assert {r[0]: tuple(r[1:]) for r in got} == _repaired(rows)


def test_repair_no_rows(spark):
    got = repair.repair(spark.createDataFrame([], TALK))
    assert got.count() == 0 and got.columns[0] == "conv_id"


def test_repair_long_runs():
    rng = random.Random(2)
    for _ in range(60):
        runs = repair.runs_of([(rng.randrange(9), rng.choice([1, 1, 2, 7, 64, 301])) for _ in range(rng.randint(1, 6))])
        rows = [(s, 1) for s, n in runs for _ in range(n)]
        audit, state, cost = repair.plan_runs(runs, repair.START, repair._closed(repair.ACCEPT))
        names = [("x", "", "blank") if s == 0 else ("suao"[(s - 1) // 2], "t", ("", "truncated")[(s - 1) % 2])
                 for s, _ in rows]
        want = _cheapest(names)
        assert (cost, audit + repair.ending(state)) == want[:2]
        matrix = repair.matrix_of(runs)
        assert min(matrix[t] + repair._closed(repair.ACCEPT)[t] for t in range(4)) == cost


DOCS = "doc_id long, text string, lang string, _id long, _n long, part string, fp long, _salt int, label long"


def _texts():
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)] + ["The", "USA", "$5", "é"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 500))) for _ in range(60)]
    for k in range(25):
        w = texts[k].split()
        w[rng.randrange(len(w))] = "other"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), texts[1], None, "", " \n", "one two", "ONE  two", "a b c", "\x01",
              " ".join(rng.choice(words) for _ in range(120_000)), ("same word " * 150).strip()]
    rows = [(k, t, ("en", "de", None, "")[k % 4], 1, 2, "z", 3, 4, 5) for k, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, texts[0], "en", *rows[0][3:]), (None, None, None, *rows[0][3:])]


def test_filter_audit(spark):
    rows = _texts()
    marks = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 70, 3)] + [(0, 1, 1), (3, None, None), (None, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    good, toxic = {d for d, q, _ in marks if q == 1 and d is not None}, {d for d, _, t in marks if t == 1 and d is not None}
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    items = []
    for i, text, lang, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": i is not None and first[t] < i}
        items.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    want = {}
    for part in {x[0] for x in items}:
        here = [x[1:] for x in items if x[0] == part]
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = here
            for step, f in enumerate(order, 1):
                out = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(out)
                want[part, "".join(order), step] = [
                    len(left), len(out), sum(f in x[0] for x in here) - len(out), sum(x[0] == {f} for x in here),
                    sum(x[1] for x in out), sum(x[2] for x in out), f]
        for key, v in want.items():
            if key[0] == part:
                v[-1] = shapley[v[-1]]
    got = filter_audit.audit_filters(docs, labels).collect()
    assert {tuple(r[:3]): list(r[3:]) for r in got} == want and len(got) == len(want)


def test_filter_audit_no_rows(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(none, labels).count() == 0
    some = spark.createDataFrame(_texts()[:5], DOCS)
    got = filter_audit.audit_filters(some, labels).collect()
    assert len(got) == 600 * 3 and all(r["good_lost"] == r["toxic_lost"] == 0 for r in got)      # en, de, ''
    assert {tuple(r) for r in filter_audit.audit_filters(some).collect()} == {tuple(r) for r in got}


def _fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(fps):
    """The smallest number reachable from each fingerprint, all pairs compared."""
    label = list(range(len(fps)))
    grown = True
    while grown:
        grown = False
        for i, j in itertools.combinations(range(len(fps)), 2):
            if label[i] != label[j] and (fps[i] ^ fps[j]).bit_count() <= 2:
                label[i] = label[j] = min(label[i], label[j])
                grown = True
    return label


@pytest.mark.parametrize("group", [4096, 3])
def test_simhash(spark, group, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "PIECE", 1000)
    rows = _texts()
    got = simhash.near_copies(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    fps = [_fingerprint(r[1]) for r in rows]
    label = _classes(fps)
    low = {}
    for r, x in zip(rows, label):
        if r[0] is not None:
            low[x] = min(low.get(x, r[0]), r[0])
    want = collections.Counter((r[0], f"{f:016x}", low.get(x)) for r, f, x in zip(rows, fps, label))
    assert collections.Counter(tuple(r) for r in got) == want
    assert sum(low[x] != r[0] for r, x in zip(rows, label) if r[0] is not None) > 5


@pytest.mark.parametrize("split", simhash.SPLITS)
@pytest.mark.parametrize("group", [4096, 20])
def test_simhash_links(spark, split, group, monkeypatch):
    """Fingerprints in dense clusters: every way to split finds every link."""
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "SPLITS", (split,))
    rng = random.Random(split)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64) & ~0xFFFF                    # low bits hardly vary
        for _ in range(25):
            fps.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    fps = sorted(fps)
    table = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    at = {simhash._signed(f): k for k, f in enumerate(fps)}
    a, b = np.array([(at[r[0]], at[r[1]]) for r in simhash.Search(table).links().collect()]).T
    assert all((fps[i] ^ fps[j]).bit_count() < 64 for i, j in zip(a, b))
    got = simhash.join_labels(len(fps), a, b)
    want = _classes(fps)
    assert len(set(want)) < len(fps) - 20
    assert {(x, y) for x, y in zip(got.tolist(), want)} == {(x, x) for x in want}


def test_simhash_thresholds():
    """A partition with few keys is not looked at; thresholds always add up."""
    masks = [0xFFFF << 16 * k for k in range(4)]
    cells = np.full((4, simhash.CELLS), 2.0)
    cells[1] = 0
    cells[1, 7] = 2 * simhash.CELLS
    plan = simhash.Plan(masks, cells, [8000, 1, 8000, 8000])
    cost, chosen = plan.choose(np.array([[1, 7, 3, 4], [5, 7, 6, 8]]))
    assert chosen.tolist() == [[0, -1, 0, 0]] * 2 and (cost > 0).all()
    for m, widths in ((2, (32, 32)), (3, (22, 21, 21))):
        plan = simhash.Plan([(1 << w) - 1 for w in widths], np.full((m, simhash.CELLS), 1.0), [4096] * m)
        assert plan.choose(np.zeros((3, m), int))[1].sum(axis=1).tolist() == [3 - m] * 3


def test_simhash_no_rows(spark):
    assert simhash.near_copies(spark.createDataFrame([], DOCS)).count() == 0
