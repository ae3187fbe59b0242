"""Null, empty, very long, tied and repeated rows, empty tables and columns with clashing names, for every operator and stage."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tesserlog.llm import decontaminate, language, licenses, neighbours, ngram_join, packing, pseudo_likelihood, shards, threads, toxicity

CLASHING = ["id", "at", "t", "n", "row", "word", "bits", "h", "digest", "node", "comp", "keys", "kind", "sieve_word", "sieve_bits", "keep_id", "keep_text", "__toxic", "__LANGUAGE", "__places", "__lm", "__at", "shard", "piece", "n_words", "value", "known"]
PROSE = "The river and the stone were green in the light of the morning and they walked along it"
LONG = " ".join(f"{w}{i % 977}" for i, w in enumerate(PROSE.split() * 9000))
BENCH = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
ROWS = [
    (1, PROSE, "en"), (2, PROSE, "en"), (2, PROSE, "en"), (2, PROSE + " again and again until the end of the day came", "en"), (3, None, None), (4, "", "en"), (5, " \t\n", "de"),
    (6, LONG, "en"), (None, PROSE, "en"), (None, None, None), (7, "word", "en"), (7, "word", "en"), (8, "...", None), (9, BENCH, "de"), (10, PROSE.upper(), None), (-1, "\x00\x01 é 漢字", "de"),
]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASHING:
        df = df.withColumn(c, F.when(F.col("doc_id") % 2 == 0, F.lit("x")))
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([("b1", BENCH), ("b1", BENCH), (None, "word"), ("b2", None), ("b3", ""), ("b4", "--")], "item_id string, text string").withColumn("id", F.lit(1))


def same_rows(out, docs):
    """Every row came through, with its own columns first."""
    own = out.select(*docs.columns)
    assert out.count() == docs.count() and own.exceptAll(docs).count() == 0


def test_licenses(docs):
    got = licenses.scan_licenses(docs)
    assert got.count() == len(ROWS) and got.where("license is not null or notices <> ''").count() == 0
    assert got.where("digest is null").count() == sum(t is None for _, t, _ in ROWS)


def test_toxicity(docs):
    labelled = docs.withColumn("toxic", F.when(F.col("doc_id") == 7, 1).when(F.col("doc_id") == 3, 5).otherwise(0))
    model = toxicity.learn(labelled)
    out = toxicity.score_texts(docs, model)
    same_rows(out, docs)
    by = {(r["doc_id"], r["text"]): r[-1] for r in out.collect()}
    assert all(0 <= s <= 1 for s in by.values()) and by[3, None] == by[4, ""] == by[5, " \t\n"] == by[8, "..."] == 0
    assert by[1, PROSE] == pytest.approx(by[10, PROSE.upper()], abs=1e-6) and by[2, PROSE] == pytest.approx(by[None, PROSE], abs=1e-6)
    assert toxicity.score_texts(docs.limit(0), model).count() == 0
    nothing = toxicity.learn(labelled.limit(0))
    assert toxicity.score_texts(docs, nothing).where(F.col("`__toxic_`") >= 0.3).count() == 0


def test_toxicity_repeated_ids_are_learned_once(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: (texts, labels.tolist()))
    rows = [(1, "b" * (5 + i % 7), i % 2) for i in range(500)] + [(2, "cc", 0), (2, "aa", 0), (None, "toxic", 1), (3, None, 1), (4, "x", None)]
    texts, labels = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert sorted(zip(texts, labels)) in ([("aa", 0), ("bbbbb", 1)], [("bbbbb", 1), ("cc", 0)])


def test_language(docs):
    profiles = language.learn_profiles(docs)
    out = language.predict_language(docs, profiles)
    same_rows(out, docs)
    by = {(r["doc_id"], r["text"]): tuple(r[-1]) for r in out.collect()}
    assert {by[k] for k in ((3, None), (4, ""), (5, " \t\n"), (8, "..."), (None, None))} == {("und", 0.0)}
    assert by[1, PROSE][0] == by[6, LONG][0] == "en" and by[9, BENCH][0] == "de"
    assert language.predict_language(docs.limit(0), profiles).count() == 0


def test_language_ties_go_by_name():
    same = {"zz": [3 | 1 << 60, 5 | 1 << 60], "aa": [3 | 1 << 60, 5 | 1 << 60]}
    assert language.Profiles(same).predict("abc")[0] == "aa"


def test_language_distance_brute_force():
    """The out-of-place distance of every profile, from plain dictionaries."""
    learn = {"en": "the cat and the dog went to the house and the garden", "de": "der hund und die katze gingen in das haus und den garten", "es": "el perro y el gato van a la casa y al campo"}
    top = {k: language.top_grams(*language.gram_counts(t)).tolist() for k, t in learn.items()}
    profiles = language.Profiles(top)
    for text in ("the dog and a cat", "der garten", "la casa", "zzz qqq", "the der el", "Ä"):
        codes, counts = language.gram_counts(text)
        own = [c for _, c in sorted(zip((-counts).tolist(), codes.tolist()))][: language.PROFILE]
        want = {k: sum(abs(i - v.index(c)) if c in v else language.PROFILE for i, c in enumerate(own)) for k, v in top.items()}
        apart, most = profiles.distances(text)
        assert dict(zip(profiles.langs, apart.tolist())) == want and most == language.PROFILE * len(own)
        lang, score = profiles.predict(text)
        assert lang == min(sorted(want), key=want.get) and score == pytest.approx(max(0, 1 - want[lang] / most))


def test_language_floor_rejects_foreign_and_junk(spark):
    """The pipeline's floor, under profiles of the test documents."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    profiles = language.learn_profiles(docs)
    foreign = {
        "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
        "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
        "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах.", "zh": "人人生而自由在尊严和权利上一律平等",
        "keys": "asdf jkl fghjk lkjhgf sdfgh dsa ghjkl fdsa lkj hgfd sasd fghj kllk jhgf dsaa", "hex": " ".join(f"{i * 0x9E3779B97F4A7C15 % 2**64:016x}" for i in range(1, 40)), "none": "12 34 ... !!",
    }
    assert {k: profiles.predict(t)[1] for k, t in foreign.items() if profiles.predict(t)[1] >= corpus_pipeline.LEAST_LANGUAGE_SCORE} == {}
    found = language.predict_language(docs, profiles)
    assert found.where(F.col(found.columns[-1])["score"] < corpus_pipeline.LEAST_LANGUAGE_SCORE).count() == 0


def test_ngram_join(docs):
    got = ngram_join.ngram_components(docs, size=5, percent=80)
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert got.count() == len(ROWS) and set(by[1]) == {(14, 1)} and (14, 1) in by[2] and by[10] == [(14, 1)]
    assert by[3] == [(0, 3)] and by[4] == [(0, 4)] and by[7] == [(1, 7), (1, 7)] and {c for _, c in by[None]} == {None}
    kept = ngram_join.keep_one(docs, size=5, percent=80)
    assert kept.columns == docs.columns
    rows = sorted([(r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect()])
    want = [(1, PROSE), (2, ROWS[3][1]), (3, ""), (4, ""), (5, " \t\n"), (6, LONG), (7, "word"), (8, "..."), (9, BENCH), (-1, ROWS[-1][1])]
    assert rows == sorted([(False, i, t) for i, t in want] + [(True, 0, PROSE), (True, 0, "")])


def test_keep_one_is_by_row(spark):
    """2 has the text of 1, and another row of 2 a text of its own: that one stays, the copy goes."""
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "t u v w x y z"), (3, "t u v w x y z"), (4, "q"), (4, "q")]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), size=5, percent=80)
    assert sorted(map(tuple, kept.collect())) == [(1, "a b c d e f g"), (2, "t u v w x y z"), (4, "q")]


def test_keep_one_shuffles_few_texts(spark):
    """The join with the rows that stay is above the sieve, also in the optimized plan."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(9))) for i in range(200)] + [(900, " ".join(f"w0x{j}" for j in range(9)))]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), size=5, percent=80)
    assert "LeftSemi" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(200))


def test_ngram_hot_fingerprint(spark, monkeypatch):
    """Most rows share fingerprints: they never meet in one task, and no link is lost."""
    monkeypatch.setattr(ngram_join, "SHARE", 4)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base, f"end{i}"]) for i in range(300)] + [" ".join(f"x{i}y{j}" for j in range(30)) for i in range(40)]
    got = ngram_join.ngram_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), size=3, percent=90).collect()
    assert all(r["component_id"] == (0 if r["doc_id"] < 300 else r["doc_id"]) for r in got)


def test_decontamination(docs, bench):
    found = decontaminate.find_contamination(docs, bench)
    same_rows(found, docs)
    by = {(r["doc_id"], r["text"]): r for r in decontaminate.judged(found).collect()}
    assert by[9, BENCH]["contaminated"] and by[9, BENCH]["longest_match"] == 15 and by[9, BENCH]["longest_at"] == 0 and by[9, BENCH]["n_items"] == 1
    assert by[7, "word"]["n_hit"] == 1 and by[7, "word"]["n_items"] == 0 and by[7, "word"]["contaminated"]
    assert not by[3, None]["contaminated"] and by[3, None]["n_words"] == 0 and by[3, None]["longest_at"] is None
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(ROWS) - 3
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(ROWS)
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    for window in (1, 40):
        assert decontaminate.find_contamination(docs, bench, window=window).count() == len(ROWS)
    wide = decontaminate.judged(decontaminate.find_contamination(docs.where("doc_id = 6"), docs.where("doc_id = 6").select(F.lit("i").alias("item_id"), "text"), window=40)).first()
    assert wide["n_hit"] == wide["n_words"] == wide["longest_match"] == len(LONG.split())


def test_longest_matches_beyond_the_key_and_ties(spark):
    words = [f"w{i}" for i in range(90)]
    docs = spark.createDataFrame([(5, "x " + " ".join(words)), (4, " ".join(words[:80]) + " y"), (3, " ".join(words[:80]) + " z"), (None, " ".join(words[:80]))], "doc_id long, text string").coalesce(1)
    best = {r["suffix"]: (r["words"], r["doc_id"], r["doc_word"]) for r in decontaminate.longest_matches(docs, spark.createDataFrame([("i", " ".join(words))], "item_id string, text string")).collect()}
    assert best == {k: (90 - k, 5, k + 1) for k in range(90)}
    some = decontaminate.longest_matches(docs, spark.createDataFrame([("i", " ".join(words[:80]))], "item_id string, text string"), least=50)
    assert {r["suffix"]: (r["words"], r["doc_id"], r["doc_word"]) for r in some.collect()} == {k: (80 - k, 3, k) for k in range(31)}


def test_packing(docs):
    got = packing.pack_documents(docs).collect()
    per = {}
    for r in got:
        per[r["doc_id"]] = per.get(r["doc_id"], 0) + r["n_words"]
    assert per[6] == len(LONG.split()) and per[7] == 2 and per[None] == len(PROSE.split()) and not {3, 4, 5} & set(per)


def test_packing_spreads_one_id_and_long_texts(spark):
    one = spark.range(30_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))
    sizes = [r["count"] for r in packing.pack_documents(one, shard=5_000).groupBy("shard").count().collect()]
    assert len(sizes) == 6 and max(sizes) < 1.2 * min(sizes)
    long = spark.range(4).select("id", F.expr("repeat('w ', 40000)").alias("text"))
    sizes = [r["count"] for r in packing.pack_documents(long, "id", capacities=(8, 16), shard=2_000).groupBy("shard").count().collect()]
    assert len(sizes) == 5 and sum(sizes) == 10_000 and max(sizes) < 2_400


def test_packing_against_the_optimum():
    """Small cases: the cost of the best assignment by exhaustion; best fit may cost a fifth more at most. Ties in length keep their order."""
    import itertools
    import random

    import numpy as np

    capacities, price = (8, 12, 20), lambda c: packing.OVERHEAD + c + packing.QUADRATIC * c * c
    rng, total, least = random.Random(3), 0.0, 0.0
    for _ in range(40):
        n = [rng.randint(1, 20) for _ in range(rng.randint(1, 6))]
        bins, _, final = packing.pack(np.array(n, np.int64), capacities)
        cost = sum(price(c) for _, c in {(b, c) for b, c in zip(bins.tolist(), final.tolist())})
        ways = ([sum(x for x, b in zip(n, put) if b == k) for k in set(put)] for put in itertools.product(range(len(n)), repeat=len(n)))
        best = min(sum(price(min(c for c in capacities if c >= s)) for s in sums) for sums in ways if max(sums) <= 20)
        assert best - 1e-9 <= cost <= 1.5 * best
        total, least = total + cost, least + best
    assert total <= 1.1 * least
    bins, at, _ = packing.pack(np.array([5, 5, 5, 5], np.int64), (10,))
    assert bins.tolist() == [0, 0, 1, 1] and at.tolist() == [0, 5, 0, 5]


def test_pseudo_likelihood(docs):
    got = {}
    for r in pseudo_likelihood.score_corpus(docs.limit(100)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(ROWS) and got[6][0]["n_tokens"] == len(LONG.split())
    assert got[3][0]["n_tokens"] == got[4][0]["n_tokens"] == 0 and got[3][0]["mean_log_prob"] is None
    assert got[7][0]["log_prob"] == pytest.approx(got[7][1]["log_prob"]) and got[1][0]["log_prob"] == pytest.approx(got[10][0]["log_prob"])


def test_neighbours_extra_columns(spark):
    rows = [(i, [float(i % 3), 1.0], "x", 1) for i in range(12)] + [(None, [1.0, 1.0], "x", 1), (0, None, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, part string, row int")
    got = neighbours.nearest(df.withColumn("id", F.lit("clash")), F.col("id") == 0, 4).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0)]


def test_threads_clashes_and_a_common_passage(spark):
    """Every turn says and quotes the same: each replies to the one before it."""
    n = 2000
    rows = [(1, t, "user", "> ok\nok" if t else "ok") for t in range(n)] + [(None, None, None, None), (2, 0, "a", "x" * 400_000), (2, 1, "b", "> " + "x" * 400_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(1)).withColumn("hash", F.lit("h")).withColumn("body", F.lit(0))
    got = {(r["conv_id"], r["turn"]): r for r in threads.format_conversations(df).collect()}
    assert len(got) == len(rows) and all(got[1, t]["reply_to"] == t - 1 and got[1, t]["position"] == t + 1 for t in range(1, n))
    assert got[2, 1]["reply_to"] == 0 and got[None, None]["position"] is None


def test_shards(docs, spark, tmp_path):
    store = shards.shard_arrivals(docs, str(tmp_path / "s"))
    assert store.read().exceptAll(docs).count() == 0 and store.read().count() == len(ROWS) and store.read().columns == docs.columns


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, docs, tmp_path, k):
    """Documents with clashing columns; the benchmark and labels as in production."""
    d = "/root/testdata/sf0.001"
    spark.read.parquet(f"{d}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b1", BENCH)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, str(tmp_path))
    kept = {r["doc_id"] for r in out.collect()}
    gone = {"toxicity": set(), "language": {3, 4, 5, 8}, "near_copies": {10}, "decontamination": {9}, "packing": {3, 4, 5}}[name]
    assert kept <= {r[0] for r in ROWS} and not kept & gone and {1, 6} <= kept
    if k < 4:
        assert out.columns == docs.columns
    if name in ("near_copies", "decontamination"):
        assert kept == {r[0] for r in ROWS} - gone
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
