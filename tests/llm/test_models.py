import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserlog.llm import language, neighbours, packing, pseudo_likelihood, toxicity
from tesserlog.llm.textops import ALNUM, BLANK_SPLIT, hash_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text, alnum):
    import re

    t = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+" if alnum else r"[^\x20\x09-\x0D]+", t)


def test_hash_words_equals_split():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab Cé\n\t-7Z ") for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", "x", " "]
    texts.append("word " * 700_000)  # longer than two segments
    texts.append("y" * 3_000_000)  # one word longer than a segment
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    for table, alnum in ((ALNUM, True), (BLANK_SPLIT, False)):
        h, counts, begin, size = hash_words(np.frombuffer(b"".join(raw), np.uint8), off, table, spans=True)
        ends = np.cumsum(counts)
        seen = {}
        for t, n, end in zip(texts, counts, ends):
            want = words_of(t, alnum)
            assert n == len(want)
            for w, x in zip(want[:2000], h[end - n : end][:2000].tolist()):
                assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)


def test_language_profiles(spark):
    rows = [(i, t * (i % 5 + 1), lang, "s", 1) for i, (t, lang) in enumerate([("the cat and the dog with them ", "en"), ("der hund und die katze mit ihnen ", "de")] * 20)]
    odd = [(100, None, "en", None, None), (101, "", "de", "s", 0), (102, "123 --", "en", "s", 1), (103, "the cat with", None, "s", 1), (103, "the cat with", None, "s", 1), (None, "und die katze", "de", "s", 1)]
    docs = spark.createDataFrame(rows + odd, SCHEMA).withColumn("__language", F.lit("clash")).withColumn("__LANGUAGE_", F.lit(1))
    profiles = language.learn_profiles(docs)
    found = language.predict_language(docs, profiles)
    assert found.columns == [*docs.columns, "__language__"]
    got = [(r["doc_id"], r[-1]["lang_pred"], r[-1]["score"]) for r in found.collect()]
    by = {i: (p, s) for i, p, s in got}
    assert len(got) == 46 and all(by[i][0] == lang for i, _, lang, _, _ in rows)
    assert by[100] == by[101] == by[102] == ("und", 0.0) and by[103][0] == "en" and by[None][0] == "de"
    assert all(0 <= s <= 1 for _, _, s in got)
    nothing = language.learn_profiles(docs.limit(0))
    assert nothing.predict("the") == ("und", 0.0)


def test_language_brute_force():
    text = "Ab ab bé, 12"
    codes, counts = language.gram_counts(text)
    mark = "_ab_ab_bé_"
    want = {}
    for n in (1, 2, 3):
        for i in range(len(mark) - n + 1):
            g = mark[i : i + n]
            if (n == 1 and g == "_") or (n == 3 and g[1] == "_"):
                continue
            want[g] = want.get(g, 0) + 1
    assert sorted(counts.tolist()) == sorted(want.values())
    long = language.gram_counts("the cat " * 400_000)
    assert long[1].sum() >= 8_000_000


def test_toxicity_learns_stems_and_reads_whole_texts():
    rng = random.Random(0)
    plain = ["water", "house", "green", "walking", "river", "stone", "light", "table", "paper", "music"]
    def doc(toxic, n=90):
        w = [rng.choice(plain) for _ in range(n)]
        if toxic:
            w[rng.randrange(n)] = "zorg" + rng.choice(["ly", "ing", "ed", "er", "ish"])
        return " ".join(w)
    labels = np.array([i % 3 == 0 for i in range(240)]).astype(int)
    model = toxicity.fit([doc(y) for y in labels], labels)
    long = " ".join(plain * 2000)
    tests = [doc(1), doc(0), long + " zorgness", long, "", "!!"]
    raw = [t.encode() for t in tests]
    s = model.scores(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert s[0] >= 0.3 and s[2] >= 0.3 and s[1] < 0.3 and s[3] < 0.3 and s[4] == s[5] == 0


def test_toxicity_gradients_and_fast_pass():
    rng = np.random.default_rng(0)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask, y = rng.normal(size=(5, 3, 4)), np.ones((5, 3)), np.array([1.0, 0, 1])
    mask[3:, 1] = 0
    flat = np.arange(15).reshape(5, 3)

    def loss():
        z = net.forward(net.project(x.reshape(-1, 4)), flat, mask)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    g = net.gradients(x, mask, y, np.ones(3))
    for k in net.p:
        i = tuple(0 for _ in net.p[k].shape)
        old, e = net.p[k][i], 1e-2
        net.p[k][i] = old + e
        up = loss()
        net.p[k][i] = old - e
        down = loss()
        net.p[k][i] = old
        assert g[k][i] == pytest.approx((up - down) / (2 * e), abs=2e-3)
    halved = net.project(x.reshape(-1, 4))
    want = net.forward(halved, flat, mask)
    for side in "fb":
        halved[side][:, : 2 * toxicity.STATES] *= 0.5
    net.p = {k: v.astype(np.float32) for k, v in net.p.items()}
    assert np.allclose(net.infer(halved, flat, mask), want, atol=1e-4)


def test_toxicity_one_class_and_nothing(spark):
    assert toxicity.fit([], np.array([], int)).scores(np.frombuffer(b"a b", np.uint8), np.array([0, 3]))[0] < 0.3
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b")], "doc_id long, text string")
    model = toxicity.learn(docs.withColumn("toxic", F.lit(None).cast("int")))
    assert [r["__toxic"] for r in toxicity.score_texts(docs, model).orderBy(F.desc_nulls_last("doc_id")).collect()][:2] == [0.0, 0.0]


def test_pseudo_likelihood_learns(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["red apple pie", "blue sea fish"]) for _ in range(200)), "en", "s", 1) for i in range(12)]
    odd = [(50, None, None, None, None), (51, "", "en", "s", 0), (52, "...", "en", "s", 0), (53, "pie red sea", "en", "s", 3), (53, "pie red sea", "en", "s", 3)]
    got = {r["doc_id"]: r for r in pseudo_likelihood.score_corpus(spark.createDataFrame(docs + odd, SCHEMA)).collect()}
    assert len(got) == 16 and got[0]["n_tokens"] == 600
    assert got[50]["n_tokens"] == got[51]["n_tokens"] == got[52]["n_tokens"] == 0 and got[51]["log_prob"] == 0 and got[51]["mean_log_prob"] is None
    assert got[0]["mean_log_prob"] > got[53]["mean_log_prob"]
    assert pseudo_likelihood.score_corpus(spark.createDataFrame([], SCHEMA)).count() == 0


def test_toxicity_windows_hold_every_short_passage():
    counts = np.array([0, 1, 31, 33, 48, 49, 200])
    begin, length, text = toxicity._windows(counts)
    starts = np.cumsum(counts) - counts
    for t, n in enumerate(counts):
        own = [(b - starts[t], b - starts[t] + k) for b, k in zip(begin[text == t], length[text == t])]
        assert all(any(a <= i and i + 16 <= b for a, b in own) for i in range(n - 15))


def test_toxicity_sample_passes_over_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: (texts, labels.tolist()))
    docs = spark.createDataFrame([(i, "x" * (900 if i in (3, 7) else 10) + str(i), i % 2) for i in range(20)], "doc_id long, text string, toxic int")
    texts, labels = toxicity.learn(docs, max_bytes=400)
    assert len(texts) == 18 and labels.count(1) == 8 and max(map(len, texts)) < 20
    texts, labels = toxicity.learn(docs.where("doc_id in (3, 7, 4)"), max_bytes=400)
    assert sorted(labels) == [0, 1]


@pytest.mark.parametrize("known,listed", [(pseudo_likelihood.KNOWN, pseudo_likelihood.LISTED), (200, 600), (300, 300), (0, 500), (0, 0)])
def test_pseudo_likelihood_brute_force(spark, monkeypatch, known, listed):
    """Every probability from plain counts and an explicit softmax; words beyond the list, repeated texts, shared windows, short texts."""
    monkeypatch.setattr(pseudo_likelihood, "KNOWN", known)
    monkeypatch.setattr(pseudo_likelihood, "LISTED", listed)
    nets, learn = [], pseudo_likelihood.learn_network
    monkeypatch.setattr(pseudo_likelihood, "learn_network", lambda *a: nets.append(learn(*a)) or nets[0])
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(1500)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (i + 3) for i in range(1500)], k=rng.randint(1, 60))) for _ in range(150)]
    texts += texts[:20] + [texts[3]] * 3 + [texts[5] + " " + texts[7], "w1490", "w1490", "w1491", "Unique! é", "", None]
    docs = spark.createDataFrame([(i, t, None, None, 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in pseudo_likelihood.score_corpus(docs).collect()}

    split = [words_of(t or "", True) for t in texts]
    count = Counter(w for d in split for w in d)
    one = lambda w: int(hash_words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), ALNUM)[0][0])
    h = {w: one(w) for w in count}
    signed = lambda w: h[w] - (1 << 64) * (h[w] >> 63)
    ranked = sorted(count, key=lambda w: (-count[w], signed(w)))
    named, bucket = {w: i for i, w in enumerate(ranked[: pseudo_likelihood.NAMED])}, {w: h[w] % pseudo_likelihood.HASHED for w in count}
    sym = lambda w: named.get(w, pseudo_likelihood.NAMED + bucket[w])
    tokens = Counter()
    for w in count:
        if w not in named:
            tokens[bucket[w]] += count[w]
    # the list goes down to a count, in steps, as far as it has room
    steps, least, held = {}, None, 0
    for w in count:
        if count[w] > 1:
            steps.setdefault(math.floor(math.log2(count[w]) * 8), []).append(count[w])
    for k in sorted(steps, reverse=True):
        held += len(steps[k])
        if held > min(known, listed) + len(named):
            break
        least = min(steps[k])
    far = {w for w in count if w not in named and (least is None or count[w] < least)}
    rare = Counter()
    for w in far:
        rare[bucket[w]] += count[w]
    window = lambda d, i: (bucket[d[i]], *[d[j] if 0 <= j < len(d) else None for j in (i - 2, i - 1, i + 1, i + 2)])
    seen = Counter((window(d, i), w) for d in split for i, w in enumerate(d) if w in far)
    every, kinds = Counter(), Counter()
    for (g, _), n in seen.items():
        every[g] += n
        kinds[g] += 1
    p = {k: v.astype(np.float64) for k, v in nets[0].p.items()}
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    used = 0
    for i, d in enumerate(split):
        want = 0.0
        for k, w in enumerate(d):
            around = [sym(d[j]) if 0 <= j < len(d) else pseudo_likelihood.SIZE for j in (k - 2, k - 1, k + 1, k + 2)]
            hidden = np.tanh(sum(p["e"][j][a] for j, a in enumerate(around)))
            c, m = divmod(sym(w), pseudo_likelihood.CLASS)
            want += np.log(soft(hidden @ p["wc"] + p["bc"])[c]) + np.log(soft(hidden @ p["wm"][c] + p["bm"][c])[m])
            if w in far:
                g = window(d, k)
                used += every[g] > 1
                want += np.log(((seen[g, w] - 1) * rare[bucket[w]] + kinds[g] * count[w]) / every[g] / (tokens[bucket[w]] + 1))
            elif w not in named:
                want += np.log(count[w] / (tokens[bucket[w]] + 1))
        assert got[i]["n_tokens"] == len(d) and got[i]["log_prob"] == pytest.approx(want, rel=1e-4, abs=1e-3)
    assert used > 20 or known


def test_pseudo_likelihood_beats_unigrams_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    learns, asks = docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0")
    asks = asks.join(learns.select("text").distinct(), "text", "left_anti").select("doc_id", "text")
    vocabulary, others = pseudo_likelihood.learn_vocabulary(learns.select("text"))
    got = pseudo_likelihood.score_documents(asks, vocabulary, others, pseudo_likelihood.learn_network(learns.select("text"), vocabulary)).toPandas()
    count = Counter(w for r in learns.collect() for w in words_of(r["text"] or "", True))
    total = sum(count.values())
    unigram = sum(math.log(max(1, count[w]) / (total + 1)) for r in asks.collect() for w in words_of(r["text"] or "", True))
    assert got["log_prob"].sum() / got["n_tokens"].sum() > unigram / got["n_tokens"].sum() + 0.3


def test_repeated_documents_are_scored_apart(spark, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "KNOWN", 0)  # every word beyond the named ones is rare
    rng = random.Random(9)
    made = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) if rng.random() < 0.3 else rng.choice(["the", "of", "and", "to"]) for _ in range(80))
    once, twice = [made() for _ in range(120)], [made() for _ in range(15)]
    frequent = [f"f{i}" for i in range(500)]  # these are the named words
    fill = [" ".join(rng.sample(frequent, 500)) for _ in range(6)]
    rows = [(i, t, None, None, 1) for i, t in enumerate(once + twice + twice + fill)]
    got = {r["doc_id"]: r["mean_log_prob"] for r in pseudo_likelihood.score_corpus(spark.createDataFrame(rows, SCHEMA)).collect()}
    high = sorted(got[i] for i in range(120))[108]  # of ten documents that occur once, nine score lower
    assert sum(got[i] > high for i in range(120, 150)) >= 24


def test_shares_of_a_bucket_sum_to_one():
    n = pseudo_likelihood.HASHED
    hashes, times = np.arange(7, 7 + 5 * n, n, dtype=np.int64), np.array([9, 5, 3, 2, 1])
    buckets = np.zeros(n, np.int64)
    buckets[7] = 20
    v = pseudo_likelihood.Vocabulary([], [], 20, buckets, hashes[:4], times[:4], 3)
    seen = hashes.view(np.uint64)
    share, far = v.shares(np.append(seen, seen[-1] + np.uint64(n)), np.full(6, pseudo_likelihood.NAMED + 7, np.int16))
    assert np.exp(share).sum() == pytest.approx(1) and far.tolist() == [False] * 4 + [True] * 2
    assert v.rare[7] == 3 and v.rare_at(seen, np.full(5, pseudo_likelihood.NAMED + 7)).tolist() == [3, 4]


def test_pseudo_likelihood_is_a_distribution_and_climbs():
    start = np.arange(1, pseudo_likelihood.SIZE + 1, dtype=float)
    net = pseudo_likelihood.Window(start / start.sum())
    rng = np.random.default_rng(0)
    around = rng.integers(0, pseudo_likelihood.SIZE, (2 * pseudo_likelihood.SIDE, 1)).astype(np.int16)
    every = np.arange(pseudo_likelihood.SIZE).astype(np.int16)
    p = np.exp(net.logs(every, np.repeat(around, len(every), 1)).astype(float))
    assert p.sum() == pytest.approx(1, abs=1e-3)
    target = rng.integers(0, 40, 4000).astype(np.int16)
    near = np.stack([target, target, target, target])  # given away by its surroundings
    before = net.logs(target, near).mean()
    for _ in range(20):
        net.learn(target, near, 0.1)
    assert net.logs(target, near).mean() > before + 1


def test_surroundings_stay_in_their_text():
    ids, counts = np.arange(1, 8).astype(np.int16), np.array([3, 0, 1, 3])
    pad = pseudo_likelihood._PAD
    got = pseudo_likelihood.surroundings(ids, counts).T.tolist()
    assert got[0] == [pad, pad, 2, 3] and got[1] == [pad, 1, 3, pad] and got[3] == [pad] * 4 and got[6] == [5, 6, pad, pad]


def test_packing_is_whole_and_fits(spark):
    rng = np.random.default_rng(0)
    for sizes in (rng.integers(1, 4097, 500), rng.integers(1, 60, 700), np.array([4096, 1]), np.array([], np.int64)):
        bins, at, cap = packing.pack(sizes.astype(np.int64))
        used = np.bincount(bins, sizes) if len(sizes) else []
        for b in range(len(used)):
            mine = np.flatnonzero(bins == b)
            o = mine[np.argsort(at[mine])]
            assert at[o[0]] == 0 and (at[o][1:] == np.cumsum(sizes[o])[:-1]).all()
            assert cap[mine[0]] == min(c for c in packing.CAPACITIES if c >= used[b])
    words = {1: "a " * 9000, 2: None, 3: "", 4: "one two", 5: " \n"}
    rows = [(i, t, "en", "s", 0) for i, t in words.items()] + [(4, "one two", "x", "y", 1), (None, "three", "x", "y", 1)]
    got = packing.pack_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r["n_words"] for r in got if r["doc_id"] == 1) == 9000 and sum(r["doc_id"] == 4 for r in got) == 2
    assert {r["doc_id"] for r in got} == {1, 4, None} and all(r["bin_offset"] + r["n_words"] <= r["capacity"] for r in got)
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_neighbours_recall_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(8, 16))
    x = (centre[rng.integers(0, 8, 1500)] + 0.5 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[200:260] = x[200]  # equal vectors: ties go to the smaller id
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] * 16, 0), (5060, [None] * 16, 0), (5080, [1.0], 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 1500, 20)) and all(len(v) == 20 for v in got.values())
    d = x.astype(np.float64)
    want = neighbours.nearest_exact(d, np.arange(1500), np.arange(0, 1500, 20))
    hits = np.mean([len({i for _, i, _ in got[q]} & set(w)) / 20 for q, w in want.items()])
    assert hits >= 0.9
    for q, v in got.items():
        v.sort()
        assert [(-s, i) for _, i, s in v] == sorted((-s, i) for _, i, s in v) and q not in [i for _, i, _ in v]
        assert all(s == pytest.approx(float(d[q] @ d[i]), abs=1e-12) for _, i, s in v)
    few = neighbours.nearest(df.where("vec_id in (0, 1, 2)"), F.col("id") % 20 == 0, 20).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]
    assert neighbours.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_neighbours_ties_and_repeated_ids(spark):
    """200 different vectors of one score, each id twice: ties go to the smaller id. In one part, where all rows are found."""
    rng = np.random.default_rng(2)
    side = rng.normal(size=(200, 7))
    ids = rng.permutation(np.arange(1, 201))
    rows = [(int(i), [1.0, *map(float, v)]) for i, v in zip(ids, side)]
    queries = [(1000, [1.0] + [0.0] * 7), (1000, [2.0] + [0.0] * 7), (1020, [1.0] + [0.0] * 7)]
    df = spark.createDataFrame(rows + queries, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("id") >= 1000, 20, parts=1).collect():
        got.setdefault((r["query_id"], r["rank"]), []).append((r["vec_id"], r["score"]))
    assert {r for q, r in got if q == 1000} == set(range(1, 21)) and all(len(v) == (2 if q == 1000 else 1) for (q, _), v in got.items())
    assert [sorted(got[1000, r]) for r in range(1, 21)] == [[(i, 1.0), (i, 2.0)] for i in range(1, 21)]
    assert [got[1020, r] for r in range(1, 21)] == [[(1000, 2.0)]] + [[(i, 1.0)] for i in range(1, 20)]
    twice = spark.createDataFrame([r for r in rows for _ in range(2)] + queries[2:], df.schema)
    found = neighbours.nearest(twice, F.col("id") == 1020, 20, parts=1).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [i for i in range(1, 11) for _ in range(2)]


def test_neighbours_beyond_the_sample(spark):
    """Recall of queries of which most were not in the sample, and sizes of the parts that all rows are indexed in."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(40, 24))
    x = centre[rng.integers(0, 40, 6000)] + 0.3 * rng.normal(size=(6000, 24))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 20 == 0, 20, parts=8, sample=1200).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = neighbours.nearest_exact(x, np.arange(6000), np.arange(0, 6000, 20))
    assert np.mean([len(got[q] & set(w)) / 20 for q, w in want.items()]) >= 0.9
    router, visits = neighbours.fit(x[:1200], 8, 20)
    size = np.bincount(router.home(x), minlength=8)
    assert size.max() <= 2.5 * size.mean() and visits < 8
    assert [neighbours.part_count(n) for n in (0, 255, 600, 10**4, 5 * 10**4, 10**9)] == [1, 2, 4, 16, 32, 128]


def test_neighbours_recall_on_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = neighbours.usable(table, "vec_id", "embedding").toPandas()
    x, ids = np.stack(rows["v"].to_numpy()), rows["id"].to_numpy()
    got = {}
    for r in neighbours.nearest(table, F.col("id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = neighbours.nearest_exact(x, ids, np.flatnonzero(ids % 20 == 0))
    assert len(got) == len(want) and np.mean([len(got[q] & set(w)) / 20 for q, w in want.items()]) >= 0.9


def test_parts_are_balanced():
    rng = np.random.default_rng(3)
    part = neighbours.balanced_parts(neighbours.neighbour_graph(rng.normal(size=(1000, 8)), 10), 8)
    assert np.bincount(part).max() - np.bincount(part).min() <= 3
