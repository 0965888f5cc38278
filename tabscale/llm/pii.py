"""Personal data and information-theoretic sanitisation, in DataFrame functions only.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers,
found by pattern, leftmost and non-overlapping per kind, and then tested (parts,
Luhn sum, number of digits). Their values are the protected entities.

The method adds terms that give an entity away. Protected entities are the single
values and, as most values are rare, each kind as a whole. Over the whole corpus it
counts in how many documents a term occurs (df_t), in how many an entity occurs
(df_e) and in how many both occur, wherever they stand (df_te); pointwise mutual
information log2(N df_te / (df_t df_e)) divided by -log2(df_te / N) says how
strongly the term reveals the entity (1: it occurs only there). From ``DISCLOSE``
on the term is generalised, from ``REMOVE`` on it is removed, at every place of
every document, with the entity or without it.

Every pair that occurs is scored. Chance hits are held down by the counts alone:
pairs with equal (df_e, df_t, df_te) count only where chance explains at most the
share ``CHANCE`` of them, as (entities with df_e) x (terms with df_t) x P(overlap
>= df_te) gives the number to expect if terms fell into documents independently
(P by Hoeffding's bound for the hypergeometric tail). One shared document is thus
evidence where such terms are few, and none where every text has words of its own.

All counts are aggregates with map-side combining. A pair can reach a level only
if its document frequencies are alike (``_alike``, exact), and entities, as terms,
that occur in the same documents are one class, so copies and words of a single
text are counted once with a number. Hot terms and entities are one row of a
written table and their joins are left to AQE's skew handling. Matches of one text
are put in order by a window over that text's own matches only.

Defined cases: a null text is empty; a text without personal data has no spans;
overlapping spans of different kinds all stay; term spans that touch a base span
are left out; repeated rows get equal spans; an empty table gives an empty
result; extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, row_id

CHANCE = 0.05     # share of pairs with equal counts that chance may explain
SLOTS = 1 << 19   # upper bound of the broadcast rows that keep other rows out of a shuffle
DISCLOSE = 0.8
REMOVE = 0.95
TERM = r"[\p{L}\p{N}]{4,}"

# The kinds in their order, a cheap test and the pattern of each. The look-behinds only
# skip places where no leftmost match can start; possessive loops keep long runs linear.
KINDS = (
    ("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?[0-9]){11}", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
KIND_NAMES = [k for k, _, _ in KINDS] + ["term"]


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    def step(acc, i):
        x = F.substring(d, -i, 1).cast("int")  # i-th digit from the right, from 1
        x = F.when(i % 2 == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)
        return acc + x
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        def small(p):
            p = F.regexp_replace(p, "^0+(?=[0-9])", "")
            return (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255)
        return F.forall(F.split(m, r"\."), small)
    n = F.length(_digits(m))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(12, 19), _luhn(_digits(m))).otherwise(F.lit(False))


def _matches(texts: DataFrame, pattern: str) -> DataFrame:
    """(_rid, m, start, end) of all matches: the pieces between matches give the places."""
    parts = texts.select("_rid", F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)).alias("m"),
                         F.transform(F.split("_text", pattern, -1), F.length).alias("gap"))
    rows = parts.where(F.size("m") > 0).select("_rid", F.posexplode(F.arrays_zip("m", "gap")).alias("pos", "x"))
    rows = rows.where("x.m is not null").select("_rid", "pos", F.col("x.m").alias("m"), F.col("x.gap").alias("gap"),
                                                F.length("x.m").alias("len"))
    upto = Window.partitionBy("_rid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(upto)
    return rows.select("_rid", "m", (end - F.col("len")).cast("long").alias("start"), end.cast("long").alias("end"))


def base_spans(texts: DataFrame) -> DataFrame:
    """(_rid, kind number, start, end, m) of the personal data in texts (_rid, _text)."""
    out = None
    for no, (kind, hint, pattern) in enumerate(KINDS):
        got = _matches(texts.where(F.col("_text").rlike(hint)), pattern).where(_valid(kind, F.col("m")))
        got = got.select("_rid", F.lit(no).alias("kind"), "start", "end", "m")
        out = got if out is None else out.unionByName(got)
    return out


def _value(kind: Column, m: Column) -> Column:
    """One spelling of an entity's value."""
    return F.concat(kind.cast("string"), F.lit(":"), F.when(kind.isin(2, 3), _digits(m)).otherwise(F.lower(m)))


def _alike(df_e: Column, df_t: Column, n: Column, disclose: float) -> Column:
    """False where no overlap could reach the level: at best df_te is the lesser count."""
    return F.log2(n / F.greatest(df_e, df_t)) >= (disclose - 1e-9) * F.log2(n / F.least(df_e, df_t))


def _log_chance(df_te: Column, df_e: Column, df_t: Column, n: Column) -> Column:
    """Bound on ln P(overlap >= df_te) of two independent sets of documents."""
    def bound(draws, other):
        a, b = df_te / draws, other / n
        rest = F.when(a < 1, (1 - a) * F.log((1 - a) / (1 - b))).otherwise(F.lit(0.0))
        return -draws * (a * F.log(a / b) + rest)
    return F.least(bound(df_e, df_t), bound(df_t, df_e))


def _likely(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key may be in ``wanted``: all that are, and few others while its hash slots are not full."""
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS))
    slots = F.broadcast(wanted.select(slot.alias("_slot")).distinct())
    return rows.withColumn("_slot", slot).join(slots, "_slot", "left_semi").drop("_slot")


def _terms(texts: DataFrame) -> DataFrame:
    """(_rid, term): the different terms of each text."""
    words = F.transform(F.regexp_extract_all("_text", F.lit(TERM), F.lit(0)), F.lower)
    return texts.select("_rid", F.explode(F.array_distinct(words)).alias("term"))


def _frequencies(held: DataFrame, key: str, a: str, b: str, df: str) -> DataFrame:
    """(key, df, a, b) from distinct (_rid, key): number of documents and a 128-bit mark of their set."""
    return held.groupBy(key).agg(F.count(F.lit(1)).alias(df), F.bit_xor(F.xxhash64("_rid")).alias(a),
                                 F.bit_xor(F.xxhash64("_rid", F.lit(1))).alias(b))


def disclosing_terms(texts: DataFrame, base: DataFrame, disclose: float = DISCLOSE, chance: float = CHANCE) -> DataFrame:
    """(term, level) of the terms whose disclosure of a value or kind reaches the threshold."""
    entity = F.explode(F.array(_value(F.col("kind"), F.col("m")), F.col("kind").cast("string")))
    ents = materialise(base.select("_rid", entity.alias("entity")).distinct(), "pii-entities")
    total = texts.agg(F.count(F.lit(1)).cast("double").alias("n"))  # one row
    total = F.broadcast(materialise(total, "pii-total"))
    of_e = materialise(_frequencies(ents, "entity", "e1", "e2", "df_e"), "pii-entity-counts")
    of_t = materialise(_frequencies(_terms(texts), "term", "t1", "t2", "df_t"), "pii-term-counts")

    # terms too frequent for even the most frequent entity are left out before they are shuffled
    top = of_e.agg(F.max("df_e").alias("top")).join(total)
    fit = (F.col("df_t") <= F.col("top")) | _alike(F.col("top"), F.col("df_t"), F.col("n"), disclose)
    few_t = of_t.join(F.broadcast(top)).where(fit).select("term", "t1", "t2", "df_t")
    held_e = ents.join(of_e, "entity").select("_rid", "e1", "e2", "df_e").distinct()
    held_t = _terms(_likely(texts, "_rid", ents)).join(few_t.hint("merge"), "term").select("_rid", "t1", "t2", "df_t").distinct()
    both = held_t.hint("merge").join(held_e, "_rid").join(total)
    both = both.where(_alike(F.col("df_e"), F.col("df_t"), F.col("n"), disclose))
    pairs = both.groupBy("e1", "e2", "t1", "t2", "df_e", "df_t", "n").agg(F.count(F.lit(1)).alias("df_te"))
    share = F.col("df_te") / F.col("n")
    pmi = F.log2(share * F.col("n") * F.col("n") / (F.col("df_t") * F.col("df_e")))
    level = F.when(F.col("df_te") >= F.col("n"), F.lit(0.0)).otherwise(pmi / -F.log2(share))
    pairs = pairs.withColumn("level", level).where(F.col("level") >= disclose)
    alike_e = of_e.groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("n_e"))
    alike_t = of_t.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n_t"))
    pairs = materialise(pairs.join(alike_e, ["e1", "e2"]).join(alike_t, ["t1", "t2"]), "pii-pairs")

    counts = pairs.groupBy("df_e", "df_t", "df_te", "n", "level").agg(F.sum(F.col("n_e") * F.col("n_t")).alias("seen"))
    counts = counts.join(of_e.groupBy("df_e").agg(F.count(F.lit(1)).alias("all_e")), "df_e")
    counts = counts.join(of_t.groupBy("df_t").agg(F.count(F.lit(1)).alias("all_t")), "df_t")
    expected = (F.log(F.col("all_e").cast("double")) + F.log(F.col("all_t").cast("double"))
                + _log_chance(F.col("df_te"), F.col("df_e"), F.col("df_t"), F.col("n")))
    real = counts.where(expected <= F.log(chance * F.col("seen"))).select("df_e", "df_t", "df_te")
    real = materialise(real, "pii-real")
    classes = pairs.join(real, ["df_e", "df_t", "df_te"]).groupBy("t1", "t2").agg(F.max("level").alias("level"))
    classes = materialise(classes, "pii-classes")
    return materialise(of_t.join(classes, ["t1", "t2"]).select("term", "level"), "pii-terms")


def term_spans(texts: DataFrame, base: DataFrame, disclose: float = DISCLOSE, chance: float = CHANCE) -> DataFrame:
    """(_rid, start, end, level) of every occurrence of a disclosing term; level from 0 to 1."""
    terms = disclosing_terms(texts, base, disclose, chance)
    hits = _likely(_terms(texts), "term", terms).join(terms.hint("merge"), "term").select("_rid", "term", "level")
    hits = materialise(hits, "pii-hits")
    marked = _likely(texts, "_rid", hits).hint("merge").join(hits.select("_rid").distinct(), "_rid")
    words = _likely(_matches(marked, TERM).withColumn("term", F.lower("m")), "term", terms)
    found = words.join(hits.hint("merge"), ["_rid", "term"]).select("_rid", "start", "end", "level")
    taken = base.select("_rid", F.col("start").alias("b0"), F.col("end").alias("b1"))
    return found.join(taken, (found["_rid"] == taken["_rid"]) & (F.col("start") < F.col("b1")) & (F.col("end") > F.col("b0")), "left_anti")


def _listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KIND_NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"),
                                                                   s["end"].cast("string"))), ",")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclose: float = DISCLOSE,
               chance: float = CHANCE) -> DataFrame:
    """One row per input row: _rid, _id, found: array of (start, kind number, end, level) in order of start."""
    rows = docs.select(row_id(docs).alias("_rid"), F.col(id_col).alias("_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    texts = rows.select("_rid", "_text")
    base = materialise(base_spans(texts), "pii-base")
    terms = term_spans(texts, base, disclose, chance)
    spans = base.select("_rid", "start", "kind", "end", F.lit(None).cast("double").alias("level")).unionByName(
        terms.select("_rid", "start", F.lit(len(KINDS)).alias("kind"), "end", "level"))
    per_text = spans.groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "level"))).alias("found"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,level:double>>")
    return rows.select("_rid", "_id").join(per_text, "_rid", "left").withColumn("found", F.coalesce("found", none))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per input row: _id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    got = find_spans(docs, id_col, text_col, **how)
    kinds = F.transform("found", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{k}")
              for n, (k, _, _) in enumerate(KINDS)]
    base = F.filter("found", lambda s: s["kind"] < len(KINDS))
    return got.select("_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE, **how) -> DataFrame:
    """One row per input row: _id and the text with its spans generalised to [KIND] or, for terms
    from the level ``remove`` on, removed. Overlapping spans are replaced by the first one's kind."""
    got = find_spans(docs, id_col, text_col, **how).select("_rid", "found")
    rows = docs.select(row_id(docs).alias("_rid"), F.col(id_col).alias("_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(got, "_rid")
    name = F.array(*[F.lit(k.upper()) for k in KIND_NAMES])

    def step(acc, s):
        gone = (s["level"].isNotNull()) & (s["level"] >= remove)
        put = F.when(gone, F.lit("")).otherwise(F.concat(F.lit("["), F.element_at(name, s["kind"] + 1), F.lit("]")))
        inside = s["start"] < acc["at"]
        text = F.when(inside, acc["text"]).otherwise(F.concat(
            acc["text"], F.substring(F.col("_text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), put))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), text.alias("text"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))
    done = F.aggregate("found", start, step)
    return rows.select("_id", done.alias("d"), "_text").select(
        "_id", F.concat("d.text", F.substring(F.col("_text"), (F.col("d.at") + 1).cast("int"), F.length("_text"))).alias("text"))
