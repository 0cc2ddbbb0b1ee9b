"""The training-data operators against brute force, on awkward small tables."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilspark.llm import common, decontaminate, lattice, mixing, neardup, passages, quality, repetition, replytrees, textkit, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = ["alpha", "bravo", "charlie", "delta", "échô", "foxtrot", "golf", "hotel", "india", "ümlaut", "kilo", "lima"]


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def corpus(n=60, seed=1):
    """Nulls, empties, copies, near copies, repeated rows, long texts and shared passages."""
    rng = random.Random(seed)
    passage = " ".join(rng.choice(WORDS) for _ in range(45))
    docs = []
    for k in range(n):
        w = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.choice([0, 1, 2, 5, 30, 80]))]
        t = " ".join(w)
        if k % 5 == 0:
            t = f"{t}\n{passage}\t{t}"
        if k % 7 == 3 and docs:
            t = docs[rng.randrange(len(docs))][1]
        if k % 11 == 6 and docs[-1][1]:
            t = docs[-1][1].replace("alpha", "Zulu", 1) + " end"
        docs.append((k * 3 - 20, None if k % 13 == 12 else t))
    docs.append((10_000_000_000, " ".join(rng.choice(WORDS) for _ in range(6000))))
    return docs


def frame(spark, docs):
    """With extra columns whose names clash with outputs."""
    return spark.createDataFrame([(d, t, 7, "x", "own") for d, t in docs], "doc_id long, text string, n_words int, fp string, word string").repartition(3)


@pytest.fixture(scope="module")
def docs():
    return corpus()


EMPTY = "doc_id long, text string"


def test_words_do_not_cross_rows():
    import pyarrow as pa

    col = pa.array(["ab cd", None, "", " x\x0by ", "z"])
    for chunk in (1, 100):
        got = [w.text(np.arange(len(w))).to_pylist() for _, _, raw, at in textkit.pieces(col, chunk) for w in [textkit.Words(raw, at)]]
        assert sum(got, []) == ["ab", "cd", "x", "y", "z"]


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (3, 1), (7, 7), *((k, k + 1) for k in range(100, 140))]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10} | {k: 100 for k in range(100, 141)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repetition(spark, docs):
    def brute(t):
        w = split(t)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
        longest = 0
        for n in itertools.count(1):
            if n > len(w) or max(Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)).values()) < 2:
                break
            longest = n
        lines = [x for x in (t or "").split("\n") if split(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), longest

    more = [*docs, (1, "a b c d e f g h " * 9), (2, "x\nx\n \nx#\ny|\nx"), (3, " ".join("ab" * 40))]
    got = {(r.doc_id, r.text): r for r in repetition.judge(frame(spark, more)).collect()}
    for d, t in more:
        r = got[d, t]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.longest_repeat) == brute(t), (d, t)
    assert not got[1, "a b c d e f g h " * 9].kept
    kept = repetition.keep_good(frame(spark, more))
    assert kept.columns == frame(spark, more).columns and kept.where("n_words <> 7").count() == 0
    assert repetition.judge(spark.createDataFrame([], EMPTY)).count() == 0


def test_passages(spark, docs):
    def brute(docs):
        first, out = {}, {}
        for d, t in sorted(docs):
            w = split(t)
            for i in range(len(w) - 19):
                first.setdefault(tuple(w[i : i + 20]), (d, i))
        for d, t in docs:
            w = split(t)
            gone = {i + k for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] != (d, i) for k in range(20)}
            out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
        return out

    cases = [*docs, (-6, "a " * 70), (2**62, "a " * 70 + "b c d")]
    want = brute(cases)
    for hot, shard in ((2000, 20000), (2, 5)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in passages.remove_repeats(frame(spark, cases), hot=hot, shard=shard).collect()}
        assert got == want
    assert passages.remove_repeats(spark.createDataFrame([], EMPTY)).count() == 0
    twice = passages.remove_repeats(spark.createDataFrame([(1, "a b " * 30), (1, "a b " * 30), (None, "c")], EMPTY)).collect()
    assert len(twice) == 3 and len({r.text for r in twice if r.doc_id == 1}) == 1
    # ids 1 and 2 share 200 words; another row of id 2, and rows without an id, have words of their own
    shared, own, third, fourth = (" ".join(f"{x}{k}" for k in range(n)) for x, n in (("s", 200), ("o", 150), ("t", 150), ("u", 170)))
    got = {r.text: (r.doc_id, r.n_removed) for r in passages.remove_repeats(spark.createDataFrame([(1, shared), (2, shared), (2, own), (None, third), (None, fourth)], EMPTY), hot=3, shard=4).collect()}
    assert got == {shared: (1, 0), "": (2, 200), own: (2, 0), third: (None, 0), fourth: (None, 0)}
    with pytest.raises(TypeError):
        passages.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    with pytest.raises(ValueError):
        passages.remove_repeats(spark.createDataFrame([], EMPTY), window=80)


def test_neardup(spark, docs):
    def fingerprint(t):
        w = split((t or "").translate(LOW))
        shingles = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
        votes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in votes) > len(votes))

    fps = {d: fingerprint(t) for d, t in docs}
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    for bucket in (64, 1):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in neardup.near_duplicates(frame(spark, docs), bucket=bucket).collect()}
        assert got == {d: (f"{v:016x}", find(d)) for d, v in fps.items()}
    one = neardup.one_per_group(frame(spark, docs))
    assert {r.doc_id for r in one.collect()} == {d for d in fps if find(d) == d} and "fp" in one.columns
    assert neardup.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0
    # one row for each row, whatever its id; links of either text of id 7 count
    words = [" ".join(f"{x}{k}" for k in range(40)) for x in "abc"]
    rows = [(7, words[0]), (7, words[1]), (None, words[0]), (9, words[1]), (9, words[1]), (None, words[2]), (None, words[2]), (3, words[0])]
    df = spark.createDataFrame(rows, EMPTY)
    got = Counter((r.doc_id, r.component_id) for r in neardup.near_duplicates(df).collect())
    assert got == Counter({(7, 3): 1, (7, 7): 1, (None, 3): 1, (9, 7): 2, (None, None): 2, (3, 3): 1})
    assert sorted(map(str, neardup.one_per_group(df).collect())) == sorted(map(str, spark.createDataFrame([(3, words[0]), (7, words[1]), (None, words[2])], EMPTY).collect()))
    assert {r.component_id for r in neardup.near_duplicates(df.select(F.col("doc_id").cast("string").alias("doc_id"), "text")).collect()} == {"3", "7", None}


def test_golay_keys_cover_two_errors():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 1 << 23, 400)
    assert set((neardup.golay_keys(v) >= 0).sum(1)) <= {1, 6}
    f = rng.integers(0, 2**64, 300, dtype=np.uint64)
    g = f ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    keys = [set() for _ in range(600)]
    for r, k in zip(*neardup.composite_keys(np.concatenate([f, g])), strict=True):
        keys[r].add(k)
    assert all(keys[i] & keys[300 + i] for i in range(300))


def test_decontaminate(spark, docs):
    rng = random.Random(5)
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    base = [t for _, t in docs if t and len(t.split()) > 25]
    items = [(k, " ".join(base[k].split()[3:20]).upper()) for k in range(4)] + [(8, "alpha7,  bravo3!"), (9, None), (10, "..."), (11, "alpha7 bravo3"), (12, "never there at all " * 5)]
    texts = [*docs, (-1, "Alpha7 - bravo3 alpha7; bravo3"), (-2, base[0].replace(" ", " ... ")), (-3, " ".join(rng.choice(WORDS) for _ in range(20)))]
    want = {}
    for d, t in texts:
        w, hit, own = norm(t), set(), set()
        for k, x in items:
            x = norm(x)
            n = min(10, len(x))
            wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if x else set()
            for i in range(len(w) - n + 1) if x else ():
                if tuple(w[i : i + n]) in wins:
                    own.add(str(k))
                    hit |= set(range(i, i + n))
        want[d] = (len(w), len(hit), sorted(own))
    items_df = spark.createDataFrame(items, "item_id long, text string")
    for shard in (1_000_000, 20):
        found = decontaminate.find(frame(spark, texts), items_df, shard_words=shard).withColumn("n_hit", decontaminate.hit_words())
        assert {r.doc_id: (r.n_words, r.n_hit, r.hit_items) for r in found.collect()} == want
    done = {r.doc_id: r.text for r in decontaminate.clean(frame(spark, texts), items_df).collect()}
    for d, t in texts:
        n, hits, _ = want[d]
        assert (d in done) == (2 * hits <= n)
        if d in done and not hits:
            assert done[d] == t
    assert decontaminate.find(spark.createDataFrame([], EMPTY), items_df).count() == 0
    assert decontaminate.find(frame(spark, docs), items_df.limit(0)).where("size(hit_spans) > 0").count() == 0


def test_mixing(spark):
    rows = [(k, ["a", "a", "a", "b", None][k % 5], "w " * (k % 9)) for k in range(400)] + [(400, "c", "one two"), (401, "d", None), (402, "d", " ")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("epoch", F.lit("own"))
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len(split(t))
    total = sum(sizes.values())
    for more in ({"repeats": 2.0}, {"entropy": 1.7}, {"repeats": 3.0, "budget": 2 * total}):
        got = mixing.mix(df, block_tokens=60, **more).collect()
        budget = more.get("budget", total)
        weights = {r.source: r.weight for r in got}
        assert abs(sum(weights.values()) - 1) < 1e-6 and None in weights and "d" not in weights
        for s, w in weights.items():
            took = sum(len(split(r.text)) for r in got if r.source == s)
            assert w * budget - 1e-6 <= took < w * budget + 9, (s, w, took)
        if "entropy" in more:
            assert abs(-sum(w * math.log2(w) for w in weights.values()) - 1.7) < 1e-3
        else:
            assert max(w * budget / sizes[s] for s, w in weights.items()) <= more["repeats"] + 1e-6
        for epoch in {r.epoch for r in got}:
            ids = [r.doc_id for r in got if r.epoch == epoch]
            assert len(ids) == len(set(ids))
        # by brute force: blocks in the order of their position are those of a source until its budget is met, and each before the last is whole
        for s, w in weights.items():
            rows_of = sorted({(r.position, r.epoch, r.block) for r in got if r.source == s})
            size = {k: sum(len(split(r.text)) for r in got if r.source == s and (r.epoch, r.block) == k) for _, *k in rows_of for k in [tuple(k)]}
            before = 0
            for position, *k in rows_of:
                assert math.isclose(position, before / (w * budget), abs_tol=1e-9)
                before += size[tuple(k)]
            whole = {}
            for r in got:
                if r.source == s:
                    whole.setdefault(r.block, {}).setdefault(r.epoch, set()).add(r.doc_id)
            last = (rows_of[-1][1], rows_of[-1][2])
            for block, by in whole.items():
                full = [ids for e, ids in by.items() if (e, block) != last]
                assert all(x == full[0] for x in full)
    assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix(df, budget=0).count() == 0


def test_reply_trees(spark):
    s = "tree string, node long, parent long, role string, text string, score double"
    rows = [("t", 1, None, "user", "hi <|im_end|>", 0.0), ("t", 2, 1, "assistant", "a\\<|x", 1.0), ("t", 3, 1, "assistant", "b", 2.0), ("t", 4, 3, None, None, None), ("t", 5, 2, "user", "q", 0.5), ("t", 5, 2, "user", "q", 0.5), ("u", 1, 9, "assistant", "solo", 0.0), ("c", 1, 2, "user", "x", 1.0), ("c", 2, 1, "user", "y", 1.0), (None, 1, None, "user", "null", 0.0)]
    made = replytrees.conversations(spark.createDataFrame(rows, s), tree="tree", score=F.col("score"), top=2)
    got = {(r.tree, r.rank): r for r in made.select("*", replytrees.parsed(F.col("formatted")).alias("turns"), replytrees.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert set(got) == {("t", 1), ("t", 2), ("u", 1), (None, 1)}
    assert [tuple(x) for x in got["t", 1].turns] == [("user", "hi <|im_end|>"), ("assistant", "b"), ("", "")] and got["t", 1].loss == "b"
    assert [tuple(x) for x in got["t", 2].turns] == [("user", "hi <|im_end|>"), ("assistant", "a\\<|x"), ("user", "q")] and got["t", 2].loss == "a\\<|x"
    assert got["t", 1].formatted.count("<|im_end|>") == 3 and got["u", 1].loss == "solo"
    chain = [("z", k, k - 1 if k else None, "user", str(k), 0.0) for k in range(70)]
    long = replytrees.conversations(spark.createDataFrame(chain, s), tree="tree").select(replytrees.parsed(F.col("formatted")).alias("t")).first().t
    assert [x.text for x in long] == list(map(str, range(70)))
    assert replytrees.conversations(spark.createDataFrame([], s), tree="tree").count() == 0


VOCABULARY = [("▁", -3.0), ("▁al", -2.0), ("a", -3.0), ("l", -3.0), ("al", -2.5), ("pha", -2.0), ("ph", -4.0), *((c, -4.0) for c in "abcdefghijkmnopqrstuvwxyzô0123456789")]


def test_lattice_sums_all_segmentations():
    import pyarrow as pa

    lat = lattice.Lattice(VOCABULARY)
    price = dict(zip(lat.names, lat.weights, strict=False))

    def brute(word):
        if not word:
            return 1.0
        total = sum(math.exp(price[word[:n]]) * brute(word[n:]) for n in range(1, len(word) + 1) if word[:n] in price)
        if word[0] not in price:
            total += math.exp(lat.weights[-1]) * 256.0 ** -len(word[0].encode()) * brute(word[1:])
        return total

    words = ["alpha", "a", "ÿ", "al€pha", "lal", "x" * 300]
    assert np.allclose(lat.run(pa.array(words[:-1])), [math.log(brute("▁" + w)) for w in words[:-1]])
    # a distribution over strings: no set of them has more than one
    short = ["".join(x) for n in range(1, 4) for x in itertools.product("abcdefghijklmnopqrstuvwxyzô0123456789", repeat=n)]
    assert 0 < np.exp(lat.run(pa.array(short))).sum() < 1
    expect = np.zeros(len(lat.weights))
    assert np.isfinite(lat.run(pa.array(words), expect)).all() and expect.sum() > 0


def test_scores(spark, docs):
    got = lattice.score(frame(spark, docs), VOCABULARY, head=5).collect()
    full = lattice.score(frame(spark, docs), VOCABULARY).collect()
    key = lambda r: r.doc_id
    for a, b in zip(sorted(got, key=key), sorted(full, key=key), strict=True):
        assert (a.n_known, a.n_tokens) == (b.n_known, b.n_tokens) and math.isclose(a.score, b.score, rel_tol=1e-9) and math.isclose(a.base_score, b.base_score, rel_tol=1e-9)
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in docs}
    c = Counter()
    for d, t in docs:
        if not held[d]:
            c.update([*split((t or "").translate(LOW)), "\0"])
    n, v = sum(c.values()), len(c)
    import pyarrow as pa

    counts = Counter(c)
    del counts["\0"]
    n1, n2, ends = sum(x == 1 for x in counts.values()), sum(x == 2 for x in counts.values()), c["\0"]
    d = n1 / (n1 + 2 * n2)
    left = d * v / n
    lat = lattice.train_lattice(spark.createDataFrame([(w,) for w in counts], "word string"), VOCABULARY, 4)
    own = lattice.Lattice(VOCABULARY)
    every = sorted({w for _, t in docs for w in split((t or "").translate(LOW))})
    q, g = (dict(zip(every, x.run(pa.array(every)), strict=True)) for x in (lat, own))
    for r in full:
        w = split((dict(docs)[r.doc_id] or "").translate(LOW))
        want = math.log10((ends - d) / n + left * lattice.END) + sum(math.log10(max(c[t] - d, 0) / n + left * (1 - lattice.END) * math.exp(q[t])) for t in w)
        assert math.isclose(r.score, want, rel_tol=1e-6), (r.score, want)
        alone = math.log10(lattice.END) + sum(math.log10((1 - lattice.END) * math.exp(g[t])) for t in w)
        assert math.isclose(r.lattice_score, alone, rel_tol=1e-9) and r.lattice_tokens == sum(c[t] == 0 for t in w)
    for r in full:
        tokens = [*split((dict(docs)[r.doc_id] or "").translate(LOW)), "\0"]
        assert (r.held_out, r.train_tokens, r.n_known) == (held[r.doc_id], n, sum(c[t] > 0 for t in tokens))
        assert math.isclose(r.base_score, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens), rel_tol=1e-9) and r.score < 0
    assert lattice.score(spark.createDataFrame([], EMPTY), VOCABULARY).count() == 0
    none = lattice.score(frame(spark, docs[:3]), VOCABULARY, held=F.lit(True)).collect()
    assert all(math.isfinite(r.score) and r.train_tokens == 0 for r in none)


def labelled(spark, n=900):
    rng = random.Random(9)
    docs, labels = [], []
    for k in range(n):
        bad, rude = k % 3 == 0, k % 4 == 0
        w = [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(60)]
        if rude:
            w[rng.randrange(60)] = rng.choice(["vile", "nasty"])
        docs.append((k, " ".join(f"{x}!!" for x in w).upper() if bad else " ".join(w)))
        labels.append((k, int(not bad), int(rude)))
    docs += [(n, None), (n + 1, "")]
    return frame(spark, docs), spark.createDataFrame([*labels, (n, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_classifiers(spark):
    docs, labels = labelled(spark)
    good = quality.score(docs, labels).join(labels, "doc_id").where("held_out AND quality IS NOT NULL")
    assert good.count() > 200 and good.where("predicted <> quality").count() <= 5
    bad = labels.withColumn("low", 1 - F.col("quality"))
    rude = toxicity.score(docs, bad, ["low", "toxic"]).join(bad, "doc_id").where("held_out AND toxic IS NOT NULL")
    assert rude.where("(p_toxic >= 0.5) <> (toxic = 1)").count() <= 5
    assert quality.score(docs, labels.limit(0)).where("score <> 0.5").count() == 0
    assert toxicity.score(docs, bad.limit(0), ["low", "toxic"]).where("p_toxic > 0.01").count() == 0
    assert quality.score(docs.limit(0), labels).count() == 0 and quality.score(docs, labels).where("score IS NULL").count() == 0


def test_trees_against_a_naive_walk():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.1)).astype(float)
    trees = quality.fit(x, y)

    def walk(row):
        total = trees.base
        for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += value[node - len(feature)]
        return total

    assert len(trees.value) == quality.TREES and np.allclose(trees.raw(x[:200]), [walk(r) for r in x[:200]])
    assert ((trees.score(x) >= 0.5) == (y == 1)).mean() > 0.95


def test_chains_learn_from_out_of_fold_rows(monkeypatch):
    rng = np.random.default_rng(5)
    n = 400
    row, bucket = np.repeat(np.arange(n), 6), rng.integers(0, 50, 6 * n)
    labels = np.column_stack([rng.random(n) < 0.5, rng.random(n) < 0.3]).astype(float)
    seen, fit = [], toxicity.fit_link

    def watched(r, b, before, y):
        seen.append((before.copy(), y.copy()))
        return fit(r, b, before, y)

    monkeypatch.setattr(toxicity, "fit_link", watched)
    toxicity.fit_chain(row, bucket, labels)
    # the first model on all rows, one for each fold without it, then the second model
    assert len(seen) == toxicity.FOLDS + 2 and [len(y) for _, y in seen[1:-1]] == [n - n // toxicity.FOLDS] * toxicity.FOLDS
    before = seen[-1][0][:, 0]
    fold = np.arange(n) % toxicity.FOLDS
    for f in range(toxicity.FOLDS):
        keep = np.flatnonzero(fold != f)
        place = np.full(n, -1)
        place[keep] = np.arange(len(keep))
        used = place[row] >= 0
        link = fit(place[row[used]], bucket[used], np.zeros((len(keep), 0)), labels[keep, 0])
        assert np.allclose(before[fold == f], link.score(row, bucket, np.zeros((n, 0)))[fold == f])


def test_samples_are_the_same_each_time(spark):
    from veilspark.llm import labelled as drawing

    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    draw = lambda parts: sorted(r.doc_id for r in drawing.sample(docs.repartition(parts), labels.repartition(parts + 2), ["quality"], most=500).collect())
    first = draw(3)
    assert len(first) == 500 and first == draw(7)
    text_ids = docs.selectExpr("concat('d', doc_id) as doc_id", "text"), labels.selectExpr("concat('d', doc_id) as doc_id", "quality", "quality as toxic")
    assert quality.score(*text_ids).where("doc_id like 'd%'").count() == 3000
    assert toxicity.score(*text_ids, ["quality", "toxic"]).where("doc_id like 'd%'").count() == 3000


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() > 0 and (k == 4 or docs.columns == columns), name
    assert {"epoch", "weight"} <= set(docs.columns)
    rng = random.Random(3)
    prose = [" ".join(rng.choice(WORDS) + str(rng.randrange(900)) for _ in range(40)) for _ in range(3)]
    item = spark.read.parquet(f"{d}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, prose[0]), (2, prose[0]), (2, prose[1]), (2, prose[1]), (None, prose[1]), (None, prose[2]), (5, "a b " * 30), (6, None), (7, ""), (8, f"{prose[2]} {prose[0]}\n{item}")]
    small = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, source string, hit_spans int")
    texts = lambda df: sorted((r.doc_id or 0, r.text or "") for r in df.collect())
    stages = [stage for _, stage in corpus_pipeline.STAGES]
    good = stages[0](spark, small, d)
    assert texts(good) == sorted((i or 0, t) for i, t in rows if t and i != 5)
    lines = stages[1](spark, good, d)
    # equal lines: of rows without an id, which come first, then of the least id; all rows stay
    assert texts(lines) == sorted([(0, prose[1]), (0, prose[2]), (1, prose[0]), (2, ""), (2, ""), (2, ""), (8, f"{prose[2]} {prose[0]}\n{item}")])
    near = stages[2](spark, lines, d)
    assert texts(near) == sorted([(0, prose[1]), (0, prose[2]), (1, prose[0]), (2, ""), (8, f"{prose[2]} {prose[0]}\n{item}")])
    clean = stages[3](spark, near, d)
    left = dict(texts(clean))
    assert left[1] == prose[0] and (8 not in left or item not in left[8])
    assert sum(len(split(r.text)) for r in stages[4](spark, near.where("doc_id = 1"), d).collect()) == 40
    with_more = spark.createDataFrame([(1, None, "x", 3), (None, "a b " * 30, None, 4), (2, "", "x", 5)], "doc_id long, text string, source string, hit_spans int")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, with_more, d).collect() is not None, name
        assert stage(spark, with_more.limit(0), d).count() == 0, name
