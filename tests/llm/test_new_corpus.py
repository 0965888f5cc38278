"""Phrase mining, SimHash and prefix trie against brute force on small fixtures, with their edge cases."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as E
from tabscale.llm import common, phrases, prefix_trie, simhash
from tools.check_oracle import TABLES, compare

from ..conftest import SF_SMALL
from .test_corpus import odd_texts, rows_of


@pytest.fixture(scope="module")
def odd(spark):
    return rows_of(spark, odd_texts(), extra=True).cache()


@pytest.mark.parametrize("key", ["op11_phrase_collocations", "op13_prefix_trie"])
def test_oracle(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = E.queries()[key](spark, SF_SMALL)
    cur = con.execute(E.oracle_sql()[key])
    assert compare([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), [c[0] for c in cur.description]) is None


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    convs = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for df in (phrases.collocations(docs), simhash.near_duplicates(docs), simhash.deduplicate(docs),
               prefix_trie.trie(prefix_trie.paths(convs))):
        assert df.collect() == []


# ---------------------------------------------------------- components, helpers

def test_connected_components_of_many_stars(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 400), rng.choice([0, 1, 2, 401 + i % 7])) for i in range(900)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = common.connected_components(spark.createDataFrame(pairs + pairs[:50], "a long, b long"), "stars").collect()
    verts = {x for a, b in pairs if a != b for x in (a, b)}
    assert {r["v"]: r["label"] for r in got} == {x: find(x) for x in verts}


# ----------------------------------------------------------------------- phrases

def brute_phrases(rows, least, longest, inside, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(ws)
            for m in range(1, longest + 1):
                for i in range(len(ws) - m + 1):
                    f[lang, tuple(ws[i:i + m])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    bad = set()
    for (lang, ws), a in cand.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                k = (lang, ws[i:i + m])
                if 100 * a >= inside * cand[k]:
                    bad.add(k)
    out = collections.defaultdict(list)
    for (lang, ws), a in cand.items():
        if (lang, ws) in bad:
            continue
        cuts = [(10**6 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rs in out.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(rs)[:top]))


@pytest.mark.parametrize("longest,shards", [(2, 1), (3, 4), (4, 3)])
def test_collocations_equal_brute_force(spark, longest, shards):
    rng = random.Random(longest)
    words = ["New", "York", "city", "Hall", "né", "中文", "a", "of", "the", "x" * 40]
    rows = []
    for i in range(300):
        ws = [rng.choice(words[:4 + i % 7]) for _ in range(rng.randint(0, 30))]
        if i > 250:
            ws += ["rare", "pair", "here"]
        rows.append((i, rng.choice([" ", "  ", "\t", ". ", ", "]).join(ws), rng.choice(["en", "de", None, ""]), True, 3))
    rows += [(1000, None, "en", True, 1), (1001, "", None, True, 1), (1002, "!?;", "fr", True, 1), rows[5], rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, w1 boolean, cnt long").repartition(5)
    got = phrases.collocations(df, longest=longest, shards=shards, least=4, top=25)
    got = sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got.collect())
    assert got and got == brute_phrases([(r[2], r[1]) for r in rows], 4, longest, phrases.INSIDE, 25)


def test_phrases_that_reach_the_threshold_late(spark, monkeypatch):
    """A few slots, one row a task: every start is early or late, the counts stay whole."""
    monkeypatch.setattr(phrases, "FLUSH", 3)
    rows = [(i, "alpha beta gamma delta" if i % 3 else "beta gamma alpha", "en") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    got = phrases.collocations(df, shards=5)
    got = sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got.collect())
    assert got == brute_phrases([(r[2], r[1]) for r in rows], 10, 3, phrases.INSIDE, 2000)


def test_scores_beyond_64_bits(spark):
    text = "u v. " * 70_000 + "u w. " * 30
    got = phrases.collocations(spark.createDataFrame([(0, text, "en")], "doc_id long, text string, lang string")).collect()
    assert [(r["phrase"], r["a"], r["score"]) for r in got] == [
        ("u v", 70_000, 10**6 * 70_000**2 // (70_030 * 70_000)), ("u w", 30, 10**6 * 30 * 30 // (70_030 * 30))]


def test_colliding_words_start_again(spark, monkeypatch):
    """With one hash for all words under the first seed, the vocabulary finds them and the next seed is taken."""
    real, tried = phrases._count_words, []

    def count(shard, seed):
        tried.append(seed)
        out = real(shard, seed)
        return out.withColumn("word2", F.concat("word2", F.lit("x"))) if seed == 1 else out

    monkeypatch.setattr(phrases, "_count_words", count)
    df = spark.createDataFrame([(i, "one two three four", "en") for i in range(20)], "doc_id long, text string, lang string")
    got = {r["phrase"]: r["a"] for r in phrases.collocations(df).collect()}
    assert set(tried) == {1, 3} and got == {"one two three": 20, "two three four": 20}


def test_words_that_collide_across_shards_start_again(spark, monkeypatch):
    """Each shard agrees with itself; only the vocabulary of all shards shows two words of one hash."""
    real, tried = phrases._count_words, []

    def count(shard, seed):
        tried.append(seed)
        out = real(shard, seed)
        return out.withColumns({c: F.concat(c, F.lit(str(len(tried)))) for c in ("word", "word2")}) if seed == 1 else out

    monkeypatch.setattr(phrases, "_count_words", count)
    df = spark.createDataFrame([(i, "one two three four", "en") for i in range(20)], "doc_id long, text string, lang string")
    got = {r["phrase"]: r["a"] for r in phrases.collocations(df).collect()}
    assert tried == [1] * 4 + [3] * 4 and got == {"one two three": 20, "two three four": 20}


def test_counted_tables_are_deleted(spark, monkeypatch):
    """Texts, words and partial counts take disk only until a later table holds their counts; a collision leaves nothing."""
    real, made, most = phrases.materialise, [], []

    def keep(df, name, *folders):
        out = real(df, name, *folders)
        made.append((name, out._scratch))
        most.append({n for n, p in made if there(p)})
        return out

    def there(path):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)

    count = phrases._count_words
    monkeypatch.setattr(phrases, "materialise", keep)
    monkeypatch.setattr(phrases, "_count_words", lambda shard, seed: count(shard, seed).withColumn("word2", F.lit("x")) if seed == 1
                        else count(shard, seed))
    rows = [(i, f"alpha beta gamma delta w{i % 7}", "en") for i in range(200)]
    out = phrases.collocations(spark.createDataFrame(rows, "doc_id long, text string, lang string"), longest=4)
    left = {n for n, p in made if there(p)}
    assert [n for n, _ in made].count("phrases-texts") == 2
    assert not any("texts" in n or "words" in n or "seen" in n for n in left) and sum("vocabulary" in n for n in left) == 1
    assert sum(there(p) for _, p in made) == len(left) == 1 + 3 + 3   # vocabulary, a table a length, a level a length
    assert all(sum("seen" in n for n in x) <= 8 for x in most)
    got = sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in out.collect())
    assert got and got == brute_phrases([(r[2], r[1]) for r in rows], 10, 4, phrases.INSIDE, 2000)


def test_partial_counts_are_in_order_of_their_first_word():
    rng = np.random.default_rng(4)
    ids = [rng.integers(0, 1 << 63, 50, dtype=np.uint64)[rng.integers(0, 50, 4000)] for _ in range(2)]
    order = phrases.by_first_word(ids)
    assert sorted(order.tolist()) == list(range(4000))
    for cols in (ids[:1], ids):    # one run a first word, and one a phrase
        rows = np.stack([x[order] for x in cols], axis=1)
        assert 1 + (rows[1:] != rows[:-1]).any(axis=1).sum() == len(np.unique(rows, axis=0))


# ----------------------------------------------------------------------- simhash

def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = [w for w in re.split("[ \t\n\x0b\x0c\r]+", low) if w]
    sh = [" ".join(ws[i:i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps, distance):
    lab = list(range(len(fps)))

    def find(x):
        while lab[x] != x:
            x = lab[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                lab[b] = a
    return [find(i) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark, odd):
    texts = odd_texts()
    rng = random.Random(2)
    base = [rng.choice(["sun", "moon", "Star", "sky", "é"]) + str(rng.randint(0, 500)) for _ in range(900)]
    for _ in range(30):
        copy = list(base)
        copy[rng.randrange(900)] = "changed"
        texts.append(rng.choice([" ", "\n"]).join(copy))
    got = {r["_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(rows_of(spark, texts, extra=True)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    comp = brute_components(fps, 4)
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in range(len(texts))}
    assert len(set(comp)) < len(set(fps)) < len(texts)


def test_long_texts_are_cut_into_parts(monkeypatch):
    text = " ".join(f"Wort{i % 977}é" for i in range(4000))
    want = brute_fingerprint(text)
    monkeypatch.setattr(simhash, "_PART", 100)
    assert simhash.fingerprint(text.encode()) % (1 << 64) == want


@pytest.mark.parametrize("distance,block", [(4, 1024), (4, 5), (3, 7), (1, 4), (6, 1024)])
def test_fingerprint_components(spark, monkeypatch, distance, block):
    """Chains, balls around a centre and buckets cut into blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(distance * 10 + block)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(200):
        x = rng.choice(fps[:8] + fps[-20:])
        for b in rng.sample(range(64), rng.randint(1, distance + 3)):
            x ^= 1 << b
        fps.append(x)
    # many in one bucket of the first segments, far from each other otherwise
    low = fps[0] & ((1 << 22) - 1)
    fps += [rng.getrandbits(42) << 22 | low for _ in range(40)] + [0, (1 << 64) - 1, 1, 1 << 63]
    fps = list(dict.fromkeys(fps))
    comp = brute_components(fps, distance)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    got = {r["fp"]: r["label"] for r in simhash.components(spark.createDataFrame(signed * 2, "_fp long"), distance).collect()}
    assert len(got) == len(fps)
    pairs = {(comp[i], got[signed[i][0]]) for i in range(len(fps))}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_simhash_deduplicate_keeps_one_row_of_a_component(spark, odd):
    got = simhash.deduplicate(odd)
    assert got.columns == odd.columns
    fps = [brute_fingerprint(t) for t in odd_texts()]
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(brute_components(fps, 4)))
    same = spark.createDataFrame([(7, "a b"), (7, "c d e"), (None, "c d e"), (None, None)], "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in simhash.deduplicate(same).collect()]
    assert sorted(kept, key=str) == sorted([(7, "a b"), (7, "c d e"), (None, None)], key=str)


# ------------------------------------------------------------------- prefix trie

def brute_trie(rows, rebuilt=True):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, key, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9 if rebuilt else 0
        full[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    nodes = collections.defaultdict(list)
    for c, p in full.items():
        for d in range(len(p) + 1):
            nodes[tuple(p[:d])].append(c)
    kids = collections.defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(nodes, key=len, reverse=True):
        own_saved = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = own_saved + sum(saved[k] for k in kids[p])
        ends = ",".join(str(c) for c in sorted(c for c in nodes[p] if len(full[c]) == len(p)))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_rows,split_turns", [(10_000, 32), (3, 32), (2, 1), (1, 2)])
def test_trie_equals_brute_force(spark, monkeypatch, shard_rows, split_turns):
    monkeypatch.setattr(prefix_trie, "SPLIT_TURNS", split_turns)
    rng = random.Random(4)
    rows = []
    for c in [*range(60), 63, 64, 71, 500]:
        turns = rng.randint(0, 12)
        for t in range(turns):
            rows.append((c, None if t == 3 and c % 4 == 0 else t, rng.choice(["user", None]) if t > 4 else "user", rng.choice(["hé", "", None])))
    rows += [(200 + i, t, "user", f"same {t}") for i in range(40) for t in range(5)]       # a hot path
    rows += [(300 + 5 * i, 0, "system", "shared") for i in range(20)] + [(None, 0, "user", "lost")] + rows[:3]
    df = spark.createDataFrame([(*r, True, "x") for r in rows], "conv_id long, turn long, role string, text string, depth boolean, _path string")
    got = prefix_trie.trie(prefix_trie.branched(prefix_trie.paths(df.repartition(3))), shard_rows)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got.columns == names
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rows)
    plain = prefix_trie.trie(prefix_trie.paths(df), shard_rows)
    assert sorted((tuple(r) for r in plain.collect()), key=str) == brute_trie(rows, rebuilt=False)


def test_shared_turns():
    rng = random.Random(1)
    for _ in range(300):
        a = [bytes([rng.randint(0, 1)]) * 16 for _ in range(rng.randint(0, 9))]
        b = a[:rng.randint(0, 9)] + [bytes([rng.randint(0, 1)]) * 16 for _ in range(rng.randint(0, 4))]
        want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert prefix_trie._shared(b"".join(a), b"".join(b)) == want


def test_simhash_variants_are_not_broadcast(spark, monkeypatch):
    """64 rows of every fingerprint come from a table that Spark sizes as if each gave one."""
    from tabscale.llm import simhash
    seen, write = {}, simhash.materialise

    def noted(df, name, *folders):
        seen[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name, *folders)
    monkeypatch.setattr(simhash, "materialise", noted)
    prints = spark.createDataFrame([(0,), (1,), (3,), (1 << 40,), (-1,)], "_fp long")
    got = simhash.components(prints, 4)
    labels = {r["fp"]: r["label"] for r in got.collect()}
    assert len({labels[0], labels[1], labels[3], labels[1 << 40]}) == 1 and labels[-1] != labels[0]
    assert "SortMergeJoin" in seen["simhash-members"] and "Broadcast" not in seen["simhash-members"]
