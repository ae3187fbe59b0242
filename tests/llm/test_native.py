import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import agree, tables
from pyspark.sql import functions as F

from tesserlog.llm import decontaminate, licenses, ngram_join, queries, shards, threads

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    agree(queries.QUERIES[name](spark, D), tables(D), queries.ORACLE_SQL[name])


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (1, 50)])
def test_ngram_components_brute_force(spark, size, percent):
    rng = random.Random(size)
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randint(0, 40)) for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 30, 120]))] for _ in range(40)]
    texts = []
    for b in base:
        for _ in range(rng.randint(1, 6)):
            w = list(b)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                w[rng.randrange(len(w))] = "new" + str(rng.randint(0, 9))
            texts.append(" ".join(w) if rng.random() < 0.8 else "\n".join(w).upper())
    texts += [None, "", " \t", base[0][0]]
    rows = [(3 * i, t, None, "s", 1) for i, t in enumerate(texts)] + [(0, texts[0], "x", "y", 2), (None, texts[1], "x", "y", 2)]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, SCHEMA), size=size, percent=percent).collect()
    assert len(got) == len(rows) and [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    sets = {}
    for i, t, *_ in rows[: len(texts)]:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), comp[r["doc_id"]])


def test_ngram_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROWS_PER_BLOCK", 7)
    rng = random.Random(1)
    base = [str(i) for i in range(60)]
    texts = [" ".join(base[:k] + [f"x{rng.randint(0, 99)}"] + base[k + 1 :]) for k in (rng.randrange(60) for _ in range(50))]
    docs = spark.createDataFrame([(i, t, None, None, 1) for i, t in enumerate(texts)], SCHEMA)
    assert {r["component_id"] for r in ngram_join.ngram_components(docs, size=1, percent=90).collect()} == {0}
    kept = ngram_join.keep_one(docs.union(docs), size=1, percent=90)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [0]
    assert ngram_join.ngram_components(docs.limit(0)).count() == 0


def test_decontamination_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["Alpha", "beta", "gam", "délta", "eps1"]) + str(rng.randint(0, 9))
    items = {1: " ".join(word() for _ in range(30)), 2: " ".join(word() for _ in range(13)), 3: "one two", 4: "solo", 5: "", 6: None, 7: "--", 10: " ".join(word() for _ in range(14))}
    docs = {i: " ".join(word() for _ in range(rng.randint(0, 300))) for i in range(60)}
    w1 = items[1].split()
    docs |= {100: "x " * 20 + " ".join(w1[3:16]).replace("a", "A") + " y", 101: "one, TWO!", 102: "solo " * 50, 103: None, 104: "", 105: " ".join(w1[:12]), 106: items[1] + " " + items[1], 107: items[10] + "\n" + items[2] + " z" * 2000}
    rows = [(i, t, None, "s", 1) for i, t in docs.items()] + [(100, docs[100], "a", "b", 2), (None, "solo", "a", "b", 2)]
    bench = spark.createDataFrame(list(items.items()) + [(4, "solo")], "item_id long, text string")
    df = spark.createDataFrame(rows, SCHEMA)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    win = {}
    for k, t in items.items():
        w = split(t)
        for i in range(len(w) - min(13, len(w)) + 1 if w else 0):
            win.setdefault(tuple(w[i : i + min(13, len(w))]), set()).add(str(k))
    for chunk in (10**9, 40):
        decontaminate.CHUNK_BYTES, held = chunk, decontaminate.CHUNK_BYTES
        got = decontaminate.judged(decontaminate.find_contamination(df, bench)).collect()
        decontaminate.CHUNK_BYTES = held
        assert len(got) == len(rows)
        for r in got:
            w, hit, names = split(r["text"]), set(), set()
            for n in {len(k) for k in win}:
                for i in range(len(w) - n + 1):
                    if (k := tuple(w[i : i + n])) in win:
                        hit |= set(range(i, i + n))
                        names |= win[k]
            sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(w))
    clean = decontaminate.decontaminate(df, bench)
    assert clean.columns == df.columns
    assert not {100, 101, 102, 106} & {r["doc_id"] for r in clean.collect()}
    best = {(r["item_id"], r["suffix"]): (r["words"], r["doc_id"], r["doc_word"]) for r in decontaminate.longest_matches(df, bench).collect()}
    assert best["1", 0] == (30, 106, 0) and best["2", 0] == (13, 107, 14)
    assert decontaminate.judged(decontaminate.find_contamination(df, bench.limit(0))).where("n_hit > 0").count() == 0
    assert decontaminate.find_contamination(df.limit(0), bench).count() == 0


def test_licenses(spark):
    mit = licenses.KNOWN[0][1]
    rows = [
        (1, "Copyright (c) 2020 Some One\n\n" + mit.replace("SOFTWARE IS", "software   is").replace("sublicense", "sub-license"), None, None, 1),
        (2, "Intro.\nReleased under the MIT Licence\nmore\nLicensed under the Apache License, version 2.0\nReleased under the MIT License.", "en", "s", 1),
        (3, "Released under the MIT License. Really.", "en", "s", 1), (4, None, None, None, None), (5, "", "en", "s", 0), (6, "© 2020", "en", "s", 0),
        (2, "again", "en", "s", 1), (None, "Released under the MIT License.", "en", "s", 1),
    ]
    got = [(r["doc_id"], r["license"], r["notices"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted([(1, "MIT", "MIT"), (2, None, "Apache-2.0,MIT"), (2, None, "Apache-2.0,MIT"), (3, None, ""), (4, None, ""), (5, None, ""), (6, None, ""), (None, "MIT", "")], key=str)
    assert licenses.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_licences_in_the_query(spark, tmp_path):
    """Whole texts as they are distributed: wrapped, with copyright lines, other spellings, other case."""
    import textwrap

    known = {}
    for k, t in licenses.KNOWN:
        if len(t) > 400:
            known.setdefault(k, t)
    assert {"MIT", "MIT-0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0", "Unlicense"} <= set(known)
    rows, want = [], {}
    for width in (45, 50, 76):
        for k, t in known.items():
            i = len(rows)
            rows.append((i, "Copyright (c) 2019-2024, Some One <a@b.c>\nCopyright © The Others\nAll rights reserved.\n\n" + textwrap.fill(t, width), "en", "s", 1))
            want[i] = k
    rows += [(1000, textwrap.fill(known["MIT"], 60) + "\nBut not on Sundays.", "en", "s", 1), (1001, "(c) You may do this\n" + known["ISC"], "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op1_license_scan(spark, str(tmp_path))
    assert {r["doc_id"]: r["license"] for r in out.collect()} == want | {1000: None, 1001: None}
    c = tables(D)
    c.sql(f"create or replace view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    agree(out, c, queries.ORACLE_SQL["op1_license_scan"])


def test_licences_from_a_folder(spark, tmp_path):
    (tmp_path / "X-1.0.txt").write_text("Do as\nyou like.\n")
    docs = spark.createDataFrame([(1, "DO AS YOU LIKE", None, None, 1), (2, licenses.KNOWN[0][1], None, None, 1)], SCHEMA)
    got = licenses.scan_licenses(docs, known=licenses.read_known(spark, str(tmp_path)).union(licenses.known_digests(spark)))
    assert {r["doc_id"]: r["license"] for r in got.collect()} == {1: "X-1.0", 2: "MIT"}


CHAT = [
    (1, 0, "user", "Hello there\nHow are you?"),
    (1, 1, "assistant", "> hello  THERE\n> How are you?\n\nFine."),
    (1, 2, "user", ">> Hello there\n>> How are you?\n> Fine.\nGood to hear"),
    (1, 3, "user", "A new matter"),
    (1, 4, "assistant", "> Good to hear\nyes\n> unknown words"),
    (1, 5, "user", "> A new matter\nwhich?"),
    (2, 0, "user", "> Hello there"), (2, 1, None, None), (2, 2, "user", ""), (None, 1, "user", "x"), (2, None, "user", "> x"),
    (3, 0, "user", "same"), (3, 0, "user", "same"), (3, 1, "user", "> same\nok"),
]


def test_quotations(spark, tmp_path):
    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")
    got = threads.format_conversations(df)
    by = {(r["conv_id"], r["turn"]): r for r in got.collect()}
    assert got.count() == len(CHAT)
    assert [by[1, t]["reply_to"] for t in range(6)] == [None, 0, 1, None, 2, 3]
    assert [by[1, t]["root_turn"] for t in range(6)] == [0, 0, 0, 3, 0, 3]
    assert [by[1, t]["position"] for t in range(6)] == [1, 2, 3, 5, 4, 6]
    assert by[1, 2]["body"] == "Good to hear" and (by[1, 2]["n_quoted"], by[1, 2]["n_linked"]) == (2, 2)
    assert (by[1, 4]["n_quoted"], by[1, 4]["n_linked"]) == (2, 1) and by[2, 0]["reply_to"] is None and by[3, 1]["reply_to"] == 0
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    c = tables(D)
    c.sql(f"create or replace view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    agree(got, c, queries.ORACLE_SQL["op2_quotation_threads"])
    segments = {(r["conv_id"], r["segment"]): [m["role"] for m in r["messages"]] for r in threads.transcripts(got.where("conv_id = 1"), size=4).collect()}
    assert len(segments[1, 0]) == 4 and len(segments[1, 1]) == 2
    assert threads.format_conversations(df.limit(0)).count() == 0


def test_shards(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f"text {i} " * (i % 50), None, "s", i) for i in range(400)] + [(1, "again", "x", "y", None), (None, "", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    store = shards.ShardStore(spark, str(tmp_path / "s"), target_bytes=1 << 20)
    for k in range(3):
        store.append(df.where(F.coalesce(F.col("doc_id") % 3, F.lit(0)) == k).repartition(3))
    before = store.manifest()
    assert before["version"] == 3 and len(before["shards"]) >= 9
    after = store.compact()
    assert after["version"] > 3 and len(after["shards"]) < 4 and not store.due(after)
    assert store.read(3).exceptAll(df).count() == 0 == df.exceptAll(store.read()).count() and store.read().count() == len(rows)
    assert store.vacuum() >= 9 and store.vacuum() == 0 and store.read().count() == len(rows)
    store.append(df.limit(0))
    assert store.read().count() == len(rows)
    assert shards.ShardStore(spark, str(tmp_path / "none")).version() == 0


def test_two_writers_get_two_versions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None, None, 1)], SCHEMA)
    a, b = (shards.ShardStore(spark, str(tmp_path / "s")) for _ in range(2))
    a.append(df)
    first, beaten = b.manifest, []

    def stale(version=None):
        if version is None and not beaten:
            beaten.append(1)
            old = first()
            a.append(df)  # takes the version that b is about to write
            return old
        return first(version)

    b.manifest = stale
    b.append(df)
    assert a.version() == 3 and a.read().count() == 3


def test_one_of_many_writers_gets_a_version(spark, tmp_path):
    """All read the same version, then commit at once: every commit is there, none has replaced another."""
    from concurrent.futures import ThreadPoolExecutor

    stores = [shards.ShardStore(spark, str(tmp_path / "s")) for _ in range(8)]
    with ThreadPoolExecutor(8) as pool:
        for f in [pool.submit(s._commit, lambda last, k=k: {"schema": None, "shards": last["shards"] + [{"path": str(k), "bytes": 1}]}) for k, s in enumerate(stores)]:
            f.result()
    assert stores[0].version() == 8 and sorted(s["path"] for s in stores[0].manifest()["shards"]) == [str(k) for k in range(8)]
    hidden, place = (stores[0]._path(str(tmp_path / "s" / n)) for n in ("hidden", "manifests/v0000000008.json"))
    stores[0]._fs.create(hidden, False).close()
    for link in (True, False):
        assert not stores[0]._claim(hidden, place, link) and len(stores[0].manifest()["shards"]) == 8
    assert stores[0]._claim(hidden, stores[0]._path(str(tmp_path / "s" / "moved")), False) and not stores[0]._fs.exists(hidden)


def test_quotations_of_parts(spark):
    rows = [
        (1, 0, "user", "First line\nsecond line\nthird line\nfourth line"),
        (1, 1, "user", "One paragraph\nof two lines.\n\nAnother one.\n\nThe last\nof three."),
        (1, 2, "a", "> first LINE\n> third line\nyes"),  # two of four lines
        (1, 3, "a", "> One paragraph of\n> two lines.\n>\n> The last\n> of three.\nyes"),  # two of three paragraphs, one wrapped anew
        (1, 4, "a", "> First line\n> Another one.\nno"),  # of two messages
        (1, 5, "user", "third line\nFirst line"),
        (1, 6, "a", "> First line\n> third line\nyes"),  # the later of two
        (1, 7, "a", "> Another one.\n>\n> The last\nyes"),  # a paragraph, and a line of one
        (1, 8, "a", "> later line\n> and more\n"), (1, 9, "user", "later line\nx\nand more"),  # not yet said
        (2, 1, "a", "> First line\n> third line"),  # another conversation
    ]
    got = {(r["conv_id"], r["turn"]): r for r in threads.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: r["reply_to"] for k, r in got.items() if r["n_quoted"]} == {(1, 2): 0, (1, 3): 1, (1, 4): None, (1, 6): 5, (1, 7): 1, (1, 8): None, (2, 1): None}
    assert all(r["n_quoted"] <= 1 and r["n_linked"] == (r["reply_to"] is not None) for r in got.values())
    assert got[1, 2]["root_turn"] == 0 and got[1, 7]["root_turn"] == 1


def test_ngram_fingerprints_are_counted_and_packed(monkeypatch):
    """Over many flushes and buckets: no table has a row for each fingerprint, a packed one takes 12 bytes, and pairs are those of whole fingerprints."""
    monkeypatch.setattr(ngram_join, "FLUSH", 1000)
    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 9999)}" for _ in range(rng.choice([2, 9, 150]))] for _ in range(30)]
    texts = [" ".join(b + [f"end{k}"] * (k > 0)) for i, b in enumerate(base) for k in range([1, 3, 12, 30][i % 4])] + [None, "", " ".join(base[0])]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array([0] * len(texts), pa.int64())], names=["id", "text", "t"])
    holders = {}
    for grams in ngram_join.shingle_sets(*ngram_join.hash_words(*ngram_join.text_buffers(batch.column(1)), ngram_join.BLANK_SPLIT), 5):
        for key in ngram_join.Bands(80).keys(grams).tolist() if len(grams) else []:
            holders.setdefault(key, set()).add(ngram_join.digest_of(grams))
    facts = pa.Table.from_batches(list(ngram_join._facts(5, 80)(iter([batch])))).to_pylist()
    assert sum(r["n"] for r in facts if r["kind"] == 1) == sum(map(len, holders.values())) > 10 * len(texts)
    assert sum(r["kind"] < 2 for r in facts) <= 2 * len(texts)
    hot = {k for k, nodes in holders.items() if len(nodes) > 20}
    packed = pa.Table.from_batches(list(ngram_join._packed(5, 80, 8, np.array(sorted(hot), np.uint64))(iter([batch])))).sort_by("bucket")
    sizes = {met: sum(len(nodes) for k, nodes in holders.items() if (k in hot) == met) for met in (True, False)}
    assert hot and sum(len(r["keys"]) + len(r["nodes"]) for r in packed.to_pylist()) == 16 * sizes[True] + 12 * sizes[False]
    got = pa.Table.from_batches(list(ngram_join._pair_stream(iter(packed.to_batches(max_chunksize=7))))).to_pylist()
    pairs = Counter((2 - 2 * (k & 1), *sorted(p)) for k, nodes in holders.items() if len(nodes) <= ngram_join.COMMON for p in itertools.combinations(nodes, 2))
    assert pairs and Counter((r["kind"], *sorted((r["u"], r["v"]))) for r in got if r["kind"] in (0, 2)) == pairs
    for kind, keys in ((1, {k for k, nodes in holders.items() if ngram_join.COMMON < len(nodes) <= 20}), (3, hot)):
        by = {}
        for r in got:
            if r["kind"] == kind:
                by.setdefault(r["u"], []).append(r["v"])
        assert keys and sorted(map(sorted, by.values())) == sorted(sorted(holders[k]) for k in keys)


@pytest.mark.parametrize("percent", [80, 90, 50])
def test_ngram_bands_lose_no_link(spark, monkeypatch, percent):
    """One group of many sizes in many small blocks: links within and between bands of size, at the bound itself too."""
    monkeypatch.setattr(ngram_join, "ROWS_PER_BLOCK", 5)
    rng = random.Random(percent)
    words = [f"w{i}" for i in range(240)]
    sizes = [rng.randint(3, 240) for _ in range(150)] + [100, 80, 64, 90, 81, 50, 25, 200, 160, 180]
    rows = [(i, " ".join(words[:n] + ([f"x{i}"] if rng.random() < 0.3 else []))) for i, n in enumerate(sizes)]
    members = spark.createDataFrame([(i, 1, i, len(t.split())) for i, t in rows], "node long, comp long, rep long, n long")
    dealt = {}
    for r in ngram_join._dealt(members, percent).collect():
        dealt.setdefault(r["task"], []).append(r)
    met = {frozenset((a["node"], b["node"])) for g in dealt.values() for a in g for b in g if a["node"] < b["node"] and (a["same"] or a["side"] != b["side"])}
    sets = {i: set(t.split()) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    assert links and all(frozenset(p) in met for p in links) and len(dealt) > 100
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), size=1, percent=percent).collect()}
    comp = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == comp
