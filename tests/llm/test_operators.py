"""The pipeline operators against brute force, on tables with nulls, empty and
very long texts, ties, repeated rows, clashing column names and no rows."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foldwise.llm import (ann, exact_dedup, gru, jaccard, line_dedup, lm, mixing, packing, preference,
                          quality, queries, shingles, token_counts)

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _row long, _id long, "
          "n long, size long, _text string, _new double, _copy int")


def _lower(t):
    return (t or "").encode().lower().decode()


def _table():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)] + ["Éa", "ß", "the", "The,", "x'y"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(40)]
    for k in range(12):                                     # near copies, some linked through others
        w = texts[k].split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0].upper(), texts[1], texts[1], None, "", "  \n\t ", "one two", "ONE two", "a b c d",
              "line of five words here\nshort\nline of five words here\n" + texts[2],
              " ".join(rng.choice(words) for _ in range(60_000)), "<|endoftext|> \x01 y \x01"]
    rows = [(k, t, "en", None if k % 7 == 0 else f"s{k % 3}", None, 1, 2, 3, 4, "z", 0.5, 6)
            for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[0], *rows[0][2:]), (None, None, None, None, *rows[0][4:])]
    return rows


@pytest.fixture(scope="module")
def rows():
    return _table()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, rows, none):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[_lower(r[1])].append(r[0])
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter(r.text_sha256 for r in got)
    assert sorted(sizes.values()) == sorted(len(g) for g in groups.values())
    best = {g for v in groups.values() for g in [max((x for x in v if x is not None), default=None)]}
    assert {r.keep_id for r in got} == best and all(r.group_size == sizes[r.text_sha256] for r in got)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(_lower(r.text) for r in kept.collect()) == sorted(groups)
    low = exact_dedup.exact_dedup(docs, keep="min").collect()
    assert {r.keep_id for r in low} == {min((x for x in v if x is not None), default=None) for v in groups.values()}
    assert exact_dedup.exact_dedup(none).count() == exact_dedup.drop_copies(none).count() == 0


def test_mixing(docs, rows, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    total = sum(r.size for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size
    assert sum(v[0].target for v in by.values()) == pytest.approx(1.5 * total)
    for v in by.values():
        assert v[0].source_size == sum(r.size for r in v) and v[0].target <= 2 * v[0].source_size
        assert sum(r.taken for r in v) == int(np.floor(v[0].target + 0.5))
    assert mixing.mixed_rows(docs).columns == docs.columns
    assert mixing.mix(none).count() == mixing.mixed_rows(none).count() == 0


def test_preference(spark):
    schema = "id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"
    u, a, b = ("user", "hi"), ("assistant", "yes"), ("assistant", None)
    got = {r.id: r for r in preference.preference_format(spark.createDataFrame(
        [(1, [u, a], [u, b]), (2, [u, a], [u, a]), (3, None, None), (4, [u], [u, a]), (5, [u, a], None),
         (6, [(None, "<|im_end|>"), a], [a])], schema)).collect()}
    assert got[1].prompt_turns == 1 and got[1].status == "ok"
    assert got[1].prompt == "<|im_start|>user\nhi<|im_end|>\n"
    s = got[1].chosen_mask[0]
    assert got[1].chosen_text[s.start:s.end] == "yes<|im_end|>"
    assert [got[k].status for k in (2, 3, 4, 5)] == ["identical", "identical", "no_chosen", "no_rejected"]
    assert "unknown\n<| im_end|>" in got[6].chosen_text
    turns = spark.createDataFrame([(0, 0, "user", "q", "x"), (0, 1, "assistant", "a", "x"), (1, 0, "user", "z", "x"),
                                   (1, 1, "assistant", "b", "x"), (4, None, None, None, "x"), (None, 0, "user", "l", "x")],
                                  "conv_id long, turn long, role string, text string, chosen string")
    pairs = {r.conv_id: r for r in preference.reply_pairs(turns).collect()}
    assert sorted(pairs) == [0, 1, 4] and pairs[0].rejected[1].text == "b" and pairs[4].partner_id is None
    assert preference.reply_pairs(turns.limit(0)).count() == 0


def test_line_dedup(docs, rows, none):
    got = line_dedup.repeated_units(docs).collect()
    text = {r[0]: r[1] for r in rows}
    for r in got:
        if r.doc_id is None:                               # two rows have no identifier
            continue
        line, first = text[r.doc_id][r.start:r.start + r.length], text[r.first_id].split("\n")[r.first_unit]
        assert _lower(line).split() == _lower(first).split() and "\n" not in line
    lines = collections.Counter(tuple(_lower(x).split()) for r in rows for x in (r[1] or "").split("\n"))
    assert len(got) == sum(n - 1 for w, n in lines.items() if len(w) >= 5)
    clean = line_dedup.drop_repeated_units(docs)
    left = collections.Counter(tuple(_lower(x).split()) for r in clean.collect() for x in (r.text or "").split("\n"))
    assert all(n == 1 for w, n in left.items() if len(w) >= 5) and set(left) | {()} == set(lines) | {()}
    assert clean.columns == [*docs.columns, "removed_spans"] and clean.count() == len(rows)
    assert line_dedup.repeated_units(none).count() == line_dedup.drop_repeated_units(none).count() == 0


def test_token_counts(docs, rows, none):
    import public_tokenizers as P
    path = P.path("byte_bpe_50k.tiktoken")
    got = token_counts.section_tokens(docs, path, P.PATTERN).toPandas()
    assert len(got) == sum((r[1] or "").count("\n") + 1 for r in rows)
    whole = token_counts.ByteTokenizer(path, P.PATTERN)
    long = rows[[len(r[1] or "") for r in rows].index(max(len(r[1] or "") for r in rows))]
    assert got[got.doc_id == long[0]].tokens.sum() == len(whole.enc.encode_ordinary(long[1]))
    big = "word é " * 200_000
    assert len(whole.lengths(big)) == len(whole.enc.encode_ordinary(big))
    sizes, bounds = np.array([3, 4, 1, 6]), np.array([0, 5, 8, 14])
    assert token_counts.attribute(sizes, bounds, "first")[0].tolist() == [2, 1, 1]
    assert token_counts.attribute(sizes, bounds, "largest")[0].tolist() == [2, 1, 1]
    share, crossing = token_counts.attribute(sizes, bounds, "share")
    assert share.tolist() == [1.5, 1.5, 1] and crossing.tolist() == [1, 0, 0]
    assert token_counts.section_tokens(none, path, P.PATTERN).count() == 0


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer
    path = queries.word_tokenizer()
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    ids = {r[0]: [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows}
    got = packing.pack(docs, path, with_ids=True).toPandas()
    for r in got.dropna(subset="doc_id").itertuples():
        want = ids[r.doc_id][r.start:r.start + r.length]
        assert list(r.ids) == want and zlib.crc32(np.array(want, np.uint32).tobytes()) == r.ids_crc32
    assert (got.piece == 0).sum() == len(rows)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 2048 and (s.offset == s.length.cumsum() - s.length).all()
    assert got.sequence_id.nunique() == -(-got.length.sum() // 2048)
    assert packing.pack(none, path).count() == 0


def _best_fit(sizes, room):
    bins = []
    for x in sorted(sizes, reverse=True):
        fit = [k for k, left in enumerate(bins) if left >= x]
        if fit:
            bins[min(fit, key=lambda k: bins[k])] -= x
        else:
            bins.append(room - x)
    return len(bins)


def test_bin_completion_is_no_worse_than_best_fit():
    rng = random.Random(1)
    ours = theirs = 0
    for _ in range(40):
        sizes = collections.Counter(rng.randint(1, 40) for _ in range(80))
        plan = packing.completion_plan(dict(sizes), 40)
        used = collections.Counter(x for fill, n in plan for x in fill * n)
        assert used == sizes and all(sum(f) <= 40 for f, _ in plan)
        ours += sum(n for _, n in plan)
        theirs += _best_fit(sizes.elements(), 40)
    assert ours <= theirs


def test_bin_completion_case_by_case():
    rng = random.Random(7)
    met = 0
    for case in range(400):
        room = rng.choice([40, 100, 1000])
        sizes = collections.Counter(rng.randint(room // 10, room * 8 // 10) for _ in range(rng.randint(5, 40)))
        plan = packing.completion_plan(dict(sizes), room, branches=50)
        used = collections.Counter(x for fill, n in plan for x in fill * n)
        assert used == sizes and all(sum(f) <= room for f, _ in plan)
        bound, n = packing.lower_bound(sizes, room), packing.sequences(plan)
        plain = packing.best_fit_plan(dict(sizes), room)
        assert packing.sequences(plain) == _best_fit(sizes.elements(), room)
        assert bound <= n <= _best_fit(sizes.elements(), room)
        met += n == bound
    assert met > 300


def test_bin_completion_where_greedy_fillings_lose():
    sizes = [104, 124, 125, 139, 142, 144, 171, 183, 213, 228, 229, 238, 295, 381, 385, 422, 422, 435, 455, 463,
             469, 502, 507, 516, 576, 582, 585, 634, 653, 677, 679, 682, 696, 750, 787]
    assert packing.sequences(packing.completion_plan(collections.Counter(sizes), 1000)) == 15


def _fewest(sizes, room):
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] >= sizes[k] and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] - sizes[k], *bins[i + 1:]])
        place(k + 1, [*bins, room - sizes[k]])

    place(0, [])
    return best


def test_bin_completion_is_optimal_on_small_tables():
    rng = random.Random(3)
    better = 0
    for case in range(300):
        sizes = [rng.randint(2, 25) for _ in range(rng.randint(1, 10))]
        if case % 2:                                          # three full sequences, cut at random
            cuts = [sorted(rng.sample(range(1, 30), rng.randint(2, 3))) for _ in range(3)]
            sizes = [b - a for c in cuts for a, b in zip([0, *c], [*c, 30])]
        plan = packing.completion_plan(collections.Counter(sizes), 30)
        assert packing.sequences(plan) == _fewest(sorted(sizes, reverse=True), 30)
        better += _best_fit(sizes, 30) > packing.sequences(plan)
    assert better > 0
    assert packing.completion_plan({}, 20) == [] and packing.lower_bound({}, 20) == 0


def test_dominated_fillings():
    assert packing.dominated([3, 4], 0, 1 << 7)               # 7 holds both
    assert packing.dominated([3, 4], 1, 1 << 8) and not packing.dominated([3, 4], 0, 1 << 8)
    assert packing.dominated([6], 2, 1 << 2) and not packing.dominated([6], 2, 1 << 3)
    assert packing.dominated([6], 1, 1 << 7) and not packing.dominated([6], 0, 1 << 6)


def test_quality(spark, docs, rows, none):
    junk = [(1000 + k, f"A{k}!! B{k}!! C!! D{k}!!") for k in range(60)]
    good = [(2000 + k, f"the word{k} of a plain text number {k} here") for k in range(60)]
    table = spark.createDataFrame(junk + good, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 2000)) for i, _ in junk + good] + [(None, 1), (1001, None)],
                                   "doc_id long, quality int")
    w = quality.train(table, labels.where(~quality.held_out("doc_id")), params=quality.Ftrl(epochs=5))
    got = {r.doc_id: r.score for r in quality.score(table, w).collect()}
    assert all((got[i] >= 0.5) == (i >= 2000) for i in got)
    out = quality.score(docs, w, carry=docs.columns, output="s").collect()
    assert len(out) == len(rows) and all(0 <= r.s <= 1 for r in out)
    assert not quality.train(table, labels.limit(0)).any() and quality.score(none, w).count() == 0


def _components(texts, ids):
    sets = []
    for t in texts:
        w = _lower(t).encode().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                ra, rb = root[a], root[b]
                root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    low = {}
    for k, r in enumerate(root):
        low[r] = min((x for x in (low.get(r), ids[k]) if x is not None), default=None)
    return [(i, len(s), low[r]) for i, s, r in zip(ids, sets, root)]


def test_jaccard(docs, rows, none):
    got = jaccard.similarity_components(docs).collect()
    want = _components([r[1] for r in rows], [r[0] for r in rows])
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert jaccard.similarity_components(none).count() == 0


def test_jaccard_many_near_copies(spark):
    rng = random.Random(8)
    base = [f"t{k}" for k in range(120)]
    texts = []
    for _ in range(150):                     # pairs of all similarities around the limit
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(50)}"
        texts.append(" ".join(w[:rng.randint(80, 120)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, jaccard.similarity_components(df).collect()))
    assert got == sorted(_components(texts, list(range(len(texts)))))


def test_prefix_of_similar_sets_share_a_token_within_reach():
    rng = np.random.default_rng(3)
    level = rng.integers(0, 3, shingles.CELLS).astype(np.uint8)
    words = rng.integers(0, 2**64, 90, dtype=np.uint64)
    met = 0
    for p in (30, 60, 75, 90):
        sets = []
        for _ in range(120):
            own = words[rng.permutation(90)[:rng.integers(1, 90)]]
            sets += [np.unique(own), np.unique(own[:max(1, int(len(own) * rng.uniform(0.6, 1)))])]
        first = [shingles.prefix(s, level, p) for s in sets]
        for x, (px, far) in zip(sets, first):
            reach = dict(zip(px.tolist(), far.tolist()))
            for y, (py, other) in zip(sets, first):
                both = len(np.intersect1d(x, y))
                if 100 * both >= p * (len(x) + len(y) - both):
                    met += 1
                    assert any(reach.get(t, 0) >= len(y) and f >= len(x) for t, f in zip(py.tolist(), other.tolist()))
    assert met > 500


def test_jaccard_tokens_late_in_many_sets_make_no_pairs(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"t{k}" for k in range(120)]
    texts = []
    for k in range(400):                     # parts of one text, each too far from the others
        w = list(base)
        for at in range(rng.randrange(15), 120, 24):
            w[at] = f"own{k}_{at}"
        texts.append(" ".join(w))
    found, keep = {}, jaccard.written

    def written(df, name):
        found.setdefault(name, out := keep(df, name))
        return out
    monkeypatch.setattr(jaccard, "written", written)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    got = sorted(map(tuple, jaccard.similarity_components(df).collect()))
    assert got == sorted(_components(texts, list(range(len(texts)))))
    together = found["unions"].groupBy("tok").count().selectExpr("sum(count * (count - 1) / 2)").first()[0]
    assert together > 100 * len(texts) and found["pairs"].count() < 10 * len(texts)


def test_jaccard_needs_least_inside_a_range_of_sizes(spark):
    texts = []
    for k in range(20):     # 26 shingles against 26..28: both ends need 4 shared tokens, size 27 needs 3
        w = [f"p{k}_{i}" for i in range(27)]
        a, b = [*w, *[f"a{k}_{i}" for i in range(3)]], [*[f"b{k}_{i}" for i in range(4)], *w]
        long = [*[f"l{k}_{i}" for i in range(100)], *w, *[f"r{k}_{i}" for i in range(100)]]
        texts += [" ".join(x) for x in (a, b, [f"d{k}", *b], b[:-1], long)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, jaccard.similarity_components(df).collect()))
    assert got == sorted(_components(texts, list(range(len(texts)))))


def test_jaccard_bounds_against_all_sizes(spark):
    rows = [(p, n, lo, hi) for p in (60, 75, 90) for n in range(1, 90, 4) for lo in range(1, 120, 7)
            for hi in (lo, lo + 1, lo + 2, lo + 5)]
    df = spark.createDataFrame(rows, "p int, n long, lo long, hi long")
    for p in (60, 75, 90):
        up = lambda a, b: -(-a // b)
        need = lambda n, s: up((n + s) * p, 100 + p) - up(max(n, s) * p, 100) + 1
        asked = df.where(f"p = {p}").withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(12))))
        asked = asked.selectExpr("*", "n as alo", "n as ahi", "lo as blo", "hi as bhi")
        for rule in (jaccard._may_qualify(F.col("m"), F.col("n"), F.col("lo"), F.col("hi"), p), jaccard._may_link(p)):
            for r in asked.where(~rule).collect():
                assert all(r.m < need(r.n, s) for s in range(r.lo, r.hi + 1)
                           if 100 * min(r.n, s) >= p * max(r.n, s)), r


def test_language_model(docs, rows, none):
    train = docs.where(~lm.held_out(docs.doc_id))
    model = lm.fit(train)
    got = lm.score(docs, model).collect()
    assert len(got) == len(rows)
    text = {}
    counts = collections.Counter()
    for r in rows:
        text[r[0]] = [*_lower(r[1]).encode().split(), None]
        if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 10:
            counts.update([*_lower(r[1]).encode().split(), None])
    n, v = sum(counts.values()), len(counts)
    for r in got:
        assert r.train_tokens == n and np.isfinite(r.score) and r.score < 0
        if r.doc_id is not None:
            w = text[r.doc_id]
            assert r.n_tokens == len(w) and r.n_known == sum(counts[x] > 0 for x in w)
            assert r.base_score == pytest.approx(sum(np.log10((counts[x] + .1) / (n + .1 * (v + 1))) for x in w))
    assert lm.score(none, model).count() == 0
    assert [r.n_known for r in lm.score(docs, lm.fit(none)).collect()] == [0] * len(rows)


def test_language_model_trains_on_every_document(spark, monkeypatch):
    texts = [f"word{k} of text {k}" for k in range(200)] + ["a copied text"] * 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    learned = spark.sparkContext.accumulator(0)
    add_up = lm._add_up

    def counted(pdf):
        learned.add(int(pdf["n"].sum()))
        return add_up(pdf)
    monkeypatch.setattr(lm, "_add_up", counted)
    assert lm.fit(docs).n == learned.value


def test_language_model_deals_copies_to_many_shards(spark, monkeypatch):
    texts = [f"word{k} of text {k}" for k in range(200)] + ["a copied text"] * 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    shards = spark.sparkContext.accumulator(0)
    train_shard = lm._train_shard

    def counted(model):
        run = train_shard(model)

        def count(pdf):
            shards.add(int((pdf["_text"] == "a copied text").any()))
            return run(pdf)
        return count
    monkeypatch.setattr(lm, "_train_shard", counted)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 400)
    lm.fit(docs)
    assert shards.value > 10                # by text alone they are all in one


def test_recurrent_gradient_and_state():
    shape = gru.Shape(words=8, per_class=4, suffixes=3, hidden=4)
    rng = np.random.default_rng(0)
    flat = rng.normal(0, 0.5, shape.size())
    hs, cls = rng.normal(size=(30, 4)), rng.integers(0, shape.classes, 30)
    word = np.where(cls < shape.groups, cls * 4 + rng.integers(0, 4, 30), 0)
    _, grad, dh = gru.output(shape, shape.split(flat), hs, cls, word, back=True)
    for name, at in (("Wc", (1, 2)), ("Wi", (1, 2, 3)), ("bi", (5,)), ("bc", (0,))):
        up, down = flat.copy(), flat.copy()
        shape.split(up)[name][at] += 1e-5
        shape.split(down)[name][at] -= 1e-5
        num = (gru.output(shape, shape.split(up), hs, cls, word).sum()
               - gru.output(shape, shape.split(down), hs, cls, word).sum()) / 2e-5
        assert num == pytest.approx(grad[name][at], abs=1e-5)
    symbols = np.where(cls < shape.groups, word, shape.words + cls - shape.groups)
    first = np.array([0, 12, 12, 30])
    whole = gru.score(shape, flat.astype(np.float32), symbols, cls, first, window=100)
    assert np.allclose(whole, gru.score(shape, flat.astype(np.float32), symbols, cls, first, window=3), atol=1e-4)
    start = gru.start(shape, np.ones(shape.classes), np.ones(shape.words))
    better = start
    for _ in range(30):
        better = gru.train(shape, better, symbols, cls, first)
    assert gru.score(shape, better, symbols, cls, first).sum() > gru.score(shape, start, symbols, cls, first).sum()


def test_permutation_index(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[100:160] = x[100]                                    # copies: ties go to the smaller number
    table = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    bad = [(500, None, 1), (501, [0.0] * 8, 1), (502, [float("nan")] * 8, 1), (503, [None] * 8, 1), (504, [1.0], 1),
           (None, x[0].tolist(), 1), (505, [float("inf")] * 8, 1)]
    df = spark.createDataFrame(table + bad + table[:3], "vec_id long, embedding array<float>, score int")
    got = collections.defaultdict(list)
    for r in ann.search(ann.build_index(df), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert sorted(got) == list(range(0, 400, 20))
    d = x.astype(float)
    for q, near in got.items():
        s = d @ d[q]
        want = sorted((k for k in range(400) if k != q), key=lambda k: (-round(s[k], 9), k))[:20]
        assert near == want
    assert ann.search(ann.build_index(df.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


def test_permutation_index_recall_when_it_excludes(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 12)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for r in ann.search(ann.build_index(df), F.col("vec_id") % 50 == 0, share=0.2, least=20).collect():
        got[r.query_id].add(r.vec_id)
    d = x.astype(float)
    hits = 0
    for q in range(0, 1500, 50):
        s = d @ d[q]
        hits += len(got[q] & set(sorted((k for k in range(1500) if k != q), key=lambda k: -s[k])[:20]))
    print("recall", hits / 600)
    assert hits / 600 >= 0.8


def test_pipeline_stages(spark, docs):
    sf = "/root/testdata/sf0.001"
    got = docs
    for name, stage in corpus_pipeline.STAGES:
        for table in (got, docs.limit(0)):
            out = stage(spark, table, sf)
            assert name == "packing" or out.columns == docs.columns
            if table is got:
                kept = out
            else:
                assert out.count() == 0
        got = kept
    assert got.count() > 0


def test_recurrent_window_gradients():
    shape = gru.Shape(words=8, per_class=4, suffixes=3, hidden=4)
    rng = np.random.default_rng(2)
    symbols = rng.integers(0, shape.symbols, 30)
    begin, size = np.array([12, 0, 23]), np.array([11, 9, 4])
    flat = gru.start(shape, np.ones(shape.classes), np.ones(shape.words)) * 2
    pull = rng.normal(size=(24, 4)).astype(np.float32)

    def run(flat):
        w, h = gru._Window(shape, symbols, begin, size, 0, 30), np.zeros((3, 4), np.float32)
        w.forward(shape.split(flat), h)
        return w, h
    w, h = run(flat)
    assert w.live == [3] * 4 + [2] * 5 + [1] * 2 and np.allclose(h[2], w.hs[w.ends[3] - 1]) and np.allclose(h[0], w.hs[-1])
    before = np.zeros_like(w.hs)
    for lo, m, hi in zip([0, *w.ends], w.live[1:], w.ends[1:]):
        before[hi - m:hi] = w.hs[lo:lo + m]
    grad, gates = w.backward(shape.split(flat), before, pull[:len(w.hs)].copy())
    found = {"U": grad, "E": np.zeros_like(shape.split(flat)["E"])}
    np.add.at(found["E"], w.inputs, gates)
    for name, at in (("U", (1, 2)), ("U", (3, 9)), ("E", (w.inputs[0], 1)), ("E", (w.inputs[9], 10))):
        value = []
        for e in (1e-2, -1e-2):
            moved = flat.copy()
            shape.split(moved)[name][at] += e
            value.append(float((run(moved)[0].hs.astype(float) * pull[:len(w.hs)]).sum()))
        assert (value[0] - value[1]) / 2e-2 == pytest.approx(found[name][at], rel=2e-2, abs=2e-3)
