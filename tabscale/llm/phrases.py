"""Phrase collocations by dynamic itemset counting.

The texts are dealt into ``shards`` and scanned in a cycle, one shard an
interval. Words are counted from the start. A longer phrase is counted from the
interval after both its subphrases, without its last and without its first word,
have been seen ``least`` times, and for one full cycle, so every count is whole
wherever it begins; lengths are thereby counted side by side.

Which phrases have reached the threshold, and when, is one byte a slot: a table
of hash slots holds the first interval in which a phrase of that slot reached
it, and a phrase starts after the later of its two slots. Two phrases in a slot
only start one of them early, which costs time and never changes a count. The
tables are broadcast, their size is fixed by the bytes of text and at most
``MAX_SLOTS``; no list of phrases leaves the executors. Words reach the
threshold by their whole count so far; longer phrases by what one task saw in
the interval, and by their whole counts when all of their length have completed.

A word is known by a 64-bit hash of language and letters. The vocabulary is
aggregated with its least and greatest string and language, so a collision is
found, and the work starts again with another seed. A phrase is the tuple of its
words, and each length joins the length below for the counts of its cuts.

Scratch tables are deleted as soon as a later one holds their counts. Partial
counts of phrases are written in the order of their first word, which the codecs
of files and shuffles shorten: most phrases begin with one of few words.

Defined cases: null text is empty; null language is ``und``; repeated rows count
each time; no word, or an empty table, gives an empty result; equal scores go by
count, then by phrase; extra columns play no part. One text is held whole by a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_chunks, discard, materialise, mix64, row_id, span_hashes, text_buffer

LEAST = 10
LONGEST = 3
SHARDS = 4
TOP = 2000
INSIDE = 50              # per cent of a phrase's occurrences inside one longer phrase that drop it
MAX_SLOTS = 1 << 25
FLUSH = 1 << 21          # phrase occurrences that a task counts at once
NEVER = 255              # slot that no phrase has reached

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)      # 0 letter of a word, 1 blank, 2 end of a piece
_KIND[[9, 32]] = 1
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of words, their rows, and whether the next word is in the same piece."""
    data = _LOWER[data]
    n, z = len(data), np.zeros(0, np.int64)
    if not n:
        return data, z, z, z, np.zeros(0, bool)
    kind = _KIND[data]
    word = kind == 0
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    word_before, word_after = np.zeros(n, bool), np.zeros(n, bool)
    word_before[1:], word_after[:-1] = word[:-1], word[1:]
    starts = np.flatnonzero(word & (~word_before | cut[:n]))
    ends = np.flatnonzero(word & (~word_after | cut[1:])) + 1
    piece = np.cumsum((kind == 2) | cut[:n], dtype=np.int32)[starts]
    same = np.zeros(len(starts), bool)
    same[:-1] = piece[1:] == piece[:-1]
    return data, starts, ends, np.searchsorted(offsets, starts, side="right") - 1, same


def _word_ids(data, starts, ends, row, langs, seed: int) -> np.ndarray:
    """64-bit ids of (language, word); ``langs``: hash of each row's language."""
    return mix64(span_hashes(data, starts, ends, seed) ^ langs[row])


def _lang_hashes(names: list[str], seed: int) -> dict[str, np.uint64]:
    raw = [x.encode() for x in names]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    h = span_hashes(np.frombuffer(b"".join(raw), np.uint8), off[:-1], off[1:], seed + 1)
    return dict(zip(names, h))


def _batch(rb, seed: int):
    """Per chunk of a batch (lang, text): language names, lower-cased bytes, starts, ends, rows, same-piece flags, ids."""
    names = ["und" if x is None else x for x in rb.column(0).to_pylist()]
    known = _lang_hashes(sorted(set(names)), seed)
    langs = np.array([known[x] for x in names], np.uint64)
    data, off = text_buffer(rb.column(1))
    for i, j in doc_chunks(off):
        low, s, e, row, same = words_of(data[off[i]:off[j]], off[i:j + 1] - off[i])
        yield names[i:j], low, s, e, row, same, _word_ids(low, s, e, row, langs[i:j], seed)


def slot_of(ids: list[np.ndarray]) -> np.ndarray:
    """Hash of a phrase from its word ids; ``_slot_column`` is the same in SQL."""
    h = ids[0]
    for w in ids[1:]:
        h = ((h >> np.uint64(5)) | (h << np.uint64(59))) ^ w
    return h


def by_first_word(ids: list[np.ndarray]) -> np.ndarray:
    """Order that has equal phrases side by side and phrases of one first word together, but for hash collisions."""
    half = np.uint64(32)
    return np.argsort((ids[0] >> half << half) | (mix64(slot_of(ids)) >> half))


def _slot_column(m: int):
    h = F.col("w1")
    for k in range(2, m + 1):
        h = F.shiftrightunsigned(h, 5).bitwiseOR(F.shiftleft(h, 59)).bitwiseXOR(F.col(f"w{k}"))
    return h


def _count_words(shard: DataFrame, seed: int) -> DataFrame:
    """(w1, cnt, lang, word) of a shard, with strings and languages as ranges to find collisions."""

    def flush(held):
        w, cnt = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        order = np.argsort(w, kind="stable")
        w, cnt = w[order], cnt[order]
        at = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        langs, words = (pa.concat_arrays([h[k] for h in held]).take(pa.array(order[at])) for k in (2, 3))
        return pa.RecordBatch.from_arrays([pa.array(w[at].view(np.int64)), pa.array(np.add.reduceat(cnt, at)), langs, words],
                                          names=["w1", "cnt", "lang", "word"])

    def run(batches):
        held, n = [], 0
        for rb in batches:
            for names, low, s, e, row, _, w in _batch(rb, seed):
                if not len(w):
                    continue
                u, at, cnt = np.unique(w, return_index=True, return_counts=True)
                a, b = s[at], e[at]
                off = np.concatenate([[0], np.cumsum(b - a)]).astype(np.int64)
                letters = low[np.repeat(a - off[:-1], b - a) + np.arange(off[-1])]
                words = pa.Array.from_buffers(pa.large_string(), len(u), [None, pa.py_buffer(off), pa.py_buffer(letters)])
                held.append((u, cnt.astype(np.int64), pa.array(names, pa.string()).take(pa.array(row[at])), words.cast(pa.string())))
                n += len(u)
                if n >= FLUSH // 2:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    # a task has counted its words: dealt out as they are, the strings are shuffled once, not as least and greatest
    rows = shard.mapInArrow(run, "w1 long, cnt long, lang string, word string").repartition("w1")
    return rows.groupBy("w1").agg(F.sum("cnt").alias("cnt"), F.min("lang").alias("lang"), F.max("lang").alias("lang2"),
                                  F.min("word").alias("word"), F.max("word").alias("word2"))


def _count_phrases(shard: DataFrame, seed: int, t: int, shards: int, lengths: list[int], longest: int, reached) -> DataFrame:
    """(m, s, w1.., cnt): what each task saw of phrases that are counted in interval t; s: the interval they start in.

    ``reached``: broadcast {m: slots}. Rows are partial counts; a phrase may come several times."""

    def run(batches):
        slots = reached.value
        held = {m: ([], 0) for m in lengths}

        def flush(m):
            parts, n = held[m]
            held[m] = ([], 0)
            if not n:
                return
            ids = [np.concatenate([p[k] for p in parts]) for k in range(m)]
            start = np.concatenate([p[m] for p in parts])
            order = by_first_word(ids)
            ids, start = [x[order] for x in ids], start[order]
            # phrases of one hash in turns only come in more parts
            new = np.zeros(len(start), bool)
            new[0] = True
            for x in ids:
                new[1:] |= x[1:] != x[:-1]
            at = np.flatnonzero(new)
            cnt = np.diff(np.concatenate([at, [len(start)]]))
            cols = [np.full(len(at), m, np.int8), start[at].astype(np.int16), *(x[at].view(np.int64) for x in ids),
                    *(np.zeros(len(at), np.int64) for _ in range(longest - m)), cnt.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=names)

        for rb in batches:
            for _, _, _, _, _, same, w in _batch(rb, seed):
                together = np.ones(len(w), bool)
                for m in range(2, max(lengths) + 1):
                    together[:max(len(w) - m + 2, 0)] &= same[m - 2:]
                    together[max(len(w) - m + 1, 0):] = False
                    if m not in lengths:
                        continue
                    at = np.flatnonzero(together)
                    table = slots[m - 1]
                    mask = np.uint64(len(table) - 1)
                    one = table[slot_of([w[at + k] for k in range(m - 1)]) & mask]
                    two = table[slot_of([w[at + k + 1] for k in range(m - 1)]) & mask]
                    start = np.maximum(one, two).astype(np.int16) + 1
                    on = (start <= t) & (t < start + shards)
                    at, start = at[on], start[on]
                    parts, n = held[m]
                    parts.append((*(w[at + k] for k in range(m)), start))
                    held[m] = (parts, n + len(at))
                    if held[m][1] >= FLUSH:
                        yield from flush(m)
        for m in lengths:
            yield from flush(m)

    names = ["m", "s", *(f"w{k + 1}" for k in range(longest)), "cnt"]
    kinds = ["byte", "short", *["long"] * longest, "long"]
    return shard.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def _mark(table: np.ndarray, phrases: DataFrame, m: int, t: int) -> None:
    """Enter the slots of the given phrases as reached in interval t, where no phrase was before."""
    slot = phrases.select(_slot_column(m).bitwiseAND(F.lit(len(table) - 1)).alias("x"))
    bits = slot.select(F.shiftright("x", 6).cast("int").alias("page"),
                       F.expr("shiftleft(1L, cast(x & 63 as int))").alias("bit")).groupBy("page").agg(F.bit_or("bit").alias("bits"))
    got = bits.toPandas()       # at most len(table) / 64 rows
    if len(got):
        page = np.unpackbits(got["bits"].to_numpy(np.int64).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = (got["page"].to_numpy(np.int64)[:, None] * 64 + np.arange(64))[page.astype(bool)]
        table[at] = np.minimum(table[at], t)


class Collision(Exception):
    """Two words, or two languages of a word, share a hash under this seed."""


def _counts(docs: DataFrame, lang_col: str, text_col: str, least: int, longest: int, shards: int, seed: int):
    """({m: phrases of m words with their whole counts, those of at least ``least``; m = 1: all words}, words a language)."""
    if shards * longest >= NEVER:
        raise ValueError("too many intervals")
    spark = docs.sparkSession
    dealt = materialise(docs.select((F.pmod(row_id(docs), F.lit(shards))).alias("shard"),
                                    F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")),
                        "phrases-texts", "shard")
    size = dealt.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    slots = min(MAX_SLOTS, 1 << max(16, math.ceil(math.log2(size / 128 + 1))))
    tables = {m: np.full(slots, NEVER, np.uint8) for m in range(1, longest)}
    keys = {m: [f"w{k + 1}" for k in range(m)] for m in range(1, longest + 1)}
    words, seen, state = [], {m: [] for m in range(2, longest + 1)}, {}

    def union(parts):
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    def whole(m):
        """Counts so far of all phrases of m words."""
        rows = [x.where(F.col("m") == m).select("s", *keys[m], "cnt") for x in seen[m]] + ([state[m]] if m in state else [])
        if not rows:
            return spark.createDataFrame([], "s short, " + ", ".join(f"{k} long" for k in keys[m]) + ", cnt long")
        return union(rows).groupBy(*keys[m]).agg(F.min("s").alias("s"), F.sum("cnt").alias("cnt"))

    def due(m, t):
        return any(v + 1 <= t <= v + shards for v in np.unique(tables[m - 1]).tolist() if v != NEVER)

    t, complete = 0, 0          # lengths up to ``complete`` are counted whole
    while complete < longest:
        shard = dealt.where(F.col("shard") == t % shards).select("lang", "text")
        lengths = [m for m in seen if due(m, t)]
        if lengths:
            shared = spark.sparkContext.broadcast(tables)
            got = materialise(_count_phrases(shard, seed, t, shards, lengths, longest, shared), f"phrases-seen-{t}")
            for m in lengths:
                seen[m].append(got)
                if m < longest:
                    _mark(tables[m], got.where((F.col("m") == m) & (F.col("cnt") >= least)), m, t)
        if t < shards:
            words.append(materialise(_count_words(shard, seed), f"phrases-words-{t}"))
            if t == shards - 1:
                clash = F.expr("lang <> lang2 or word <> word2").alias("clash")
                vocabulary = union(words).select("w1", "cnt", "lang", "word", clash).repartition("w1")
                clash = F.expr("max(clash) or min(lang) <> max(lang) or min(word) <> max(word)").alias("clash")
                vocabulary = materialise(vocabulary.groupBy("w1").agg(F.sum("cnt").alias("f"), F.min("lang").alias("lang"),
                                                                      F.min("word").alias("word"), clash), "phrases-vocabulary")
                for x in words:
                    discard(x)
                if vocabulary.where("clash").limit(1).count():
                    for x in (dealt, vocabulary, *{id(x): x for m in seen for x in seen[m]}.values()):
                        discard(x)
                    raise Collision
                so_far, complete = vocabulary.where(F.col("f") >= least), 1
            else:
                so_far = union([x.select("w1", "cnt") for x in words])
                so_far = so_far.groupBy("w1").agg(F.sum("cnt").alias("f")).where(F.col("f") >= least)
            if longest > 1:
                _mark(tables[1], so_far, 1, t)
        for m in seen:
            done = complete == m - 1 and not any(due(m, x) for x in range(t + 1, t + shards + 1))
            if done or seen[m] and t == (m - 1) * shards:
                now, old = whole(m), state.get(m)
                open_ = F.lit(False) if done else F.col("s") + shards > t + 1
                state[m] = materialise(now.where((F.col("cnt") >= least) | open_).select("s", *keys[m], "cnt"), f"phrases-{m}-{t}")
                held, seen[m] = seen[m], []
                for x in [x for x in held if not any(x is y for k in seen for y in seen[k])] + ([old] if old else []):
                    discard(x)
                if m < longest:
                    _mark(tables[m], state[m].where(F.col("cnt") >= least), m, t)
            if done:
                complete = m
        t += 1
    discard(dealt)
    for x in range(2, longest + 1):
        state[x] = state[x].select(*keys[x], F.col("cnt").alias("f"))
    state[1] = vocabulary.select("w1", "f", "lang", "word")
    return state, vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST,
                 shards: int = SHARDS, inside: int = INSIDE, top: int | None = TOP, seed: int = 1) -> DataFrame:
    """Phrases of 2 to ``longest`` words with their best-known cut: lang, rank, phrase, words, a, l, r, k, n, score."""
    while True:
        try:
            counts, total = _counts(docs, lang_col, text_col, least, longest, shards, seed)
            break
        except Collision:
            seed += 2
    none = F.expr("cast(array() as array<long>)")
    below = (counts[1].where(F.col("f") >= least)
             .select("w1", "f", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), none.alias("pre"), none.alias("suf")))
    found = []
    for m in range(2, longest + 1):
        left = below.select(*[f"w{k}" for k in range(1, m)], "lang", F.col("phrase").alias("lp"), F.col("pre").alias("lpre"),
                            F.col("f").alias("lf"))
        right = below.select(*[F.col(f"w{k}").alias(f"w{k + 1}") for k in range(1, m)], "last", F.col("suf").alias("rsuf"),
                             F.col("f").alias("rf"))
        keys = [f"w{k}" for k in range(1, m + 1)]
        here = counts[m].join(left, keys[:-1]).join(right, keys[1:]).select(
            *keys, "f", "lang", F.concat_ws(" ", "lp", "last").alias("phrase"), "last",
            F.concat("lpre", F.array("lf")).alias("pre"), F.concat(F.array("rf"), "rsuf").alias("suf"))
        below = materialise(here, f"phrases-level-{m}")
        found.append(below)
    kept = []
    for m, here in enumerate(found, 2):
        wide = lambda c: c.cast("decimal(20,0)")
        a, cuts = wide(F.col("f")), []
        for k in range(1, m):
            left, right = F.element_at("pre", k), F.element_at("suf", k)
            score = F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(20,0)"), wide(left) * wide(right))
            cuts.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
        out = here.withColumn("cut", F.array_min(F.array(*cuts)))
        if m < longest:
            keys = [f"w{k}" for k in range(1, m + 1)]
            longer = found[m - 1]
            ends = longer.select(*keys, "f").unionByName(longer.select(*[F.col(f"w{k + 1}").alias(f"w{k}") for k in range(1, m + 1)], "f"))
            ends = ends.groupBy(*keys).agg(F.max("f").alias("longer"))
            out = out.join(ends, keys, "left").where(F.coalesce(100 * F.col("longer") < inside * F.col("f"), F.lit(True)))
        kept.append(out.select("lang", "phrase", F.lit(m).alias("words"), F.col("f").alias("a"), "cut.l", "cut.r", "cut.k", "cut.score"))
    every = kept[0]
    for x in kept[1:]:
        every = every.unionByName(x)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = every.withColumn("rank", F.row_number().over(order).cast("long"))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "words", "a", "l", "r", "k", "n", "score")
