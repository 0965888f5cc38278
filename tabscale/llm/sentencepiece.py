"""SentencePiece encoding and decoding by streaming Viterbi.

The vocabulary is a SentencePiece BPE model (read, never trained). Its encoding
is found as a path through the lattice of pieces: a piece ending at a boundary
survives when the path to its start ends in a piece that the merge rules would
leave next to it. Exactly one backpointer survives at each boundary, so the path
found is the model's own segmentation and ids equal the library's.

``StreamingEncoder`` reads characters one by one and keeps a window of the last
``max_piece`` boundaries; when the backpointers of all boundaries in the window
lead back to one boundary, the ids before it are committed and forgotten. On
Spark whole batches run at once: texts are cut at character pairs that occur in
no piece (no merge crosses them), equal units are encoded once, and the lattice
advances one column a round for all units; units longer than ``LONG`` characters
stream. Characters outside the vocabulary become byte pieces.

White space is kept as it is (one blank is put in front of a text, as the model
does); a literal U+2581 is encoded as bytes, so decoding is exact for every text.

Defined cases: null and empty texts have no ids and decode to ''; very long
texts and words are encoded whole; repeated rows get equal ids; an empty table
gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_table, mix64, powers, text_buffer

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LONG = 64               # longer units stream one by one
CHUNK_CHARS = 1 << 20   # characters encoded by one round of numpy calls
CACHE_UNITS = 1 << 20   # remembered units of a task
SPACE = "▁"


class Table:
    """Open-addressing hash table from nonzero uint64 keys to int32 for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(len(keys) + 1))) + 3)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == 0
            claim = todo[free]
            self.keys[slot[claim]] = keys[claim]  # of several for one slot the last stays
            won = self.keys[slot[claim]] == keys[claim]
            self.values[slot[claim[won]]] = values[claim[won]]
            todo = np.concatenate([todo[~free], claim[~won]])
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where the key is missing."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        todo = np.flatnonzero((found != keys) & (found != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found != 0)]
        return out


def merge_pieces(chars: list[str], rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Greedy best-rank, leftmost merging; also the last merge made."""
    parts, last = list(chars), None
    while len(parts) > 1:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank), default=None)
        if best is None:
            break
        i = best[1]
        last = (parts[i], parts[i + 1])
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts, last


class Vocabulary:
    """Lattice tables of a SentencePiece BPE model (bounded by its pieces)."""

    def __init__(self, path: str = MODEL):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.size = n
        text = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = np.full(256, sp.unk_id(), np.int32)
        self.raw: list[bytes] = []
        plain: dict[str, int] = {}
        for i, t in enumerate(text):
            if sp.is_byte(i):
                self.byte_id[int(t[3:5], 16)] = i
                self.raw.append(bytes([int(t[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                plain[t] = i
                self.raw.append(t.replace(SPACE, " ").encode())
        score = {t: sp.get_score(i) for t, i in plain.items()}
        levels = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        rank = {t: levels[s] for t, s in score.items()}
        single = [t for t in plain if len(t) == 1]
        self.max_piece = max(map(len, plain))
        self.rank = np.full(n + 1, -1, np.int64)       # single characters are there from the start
        self.left = np.full(n + 1, -1, np.int32)
        self.right = np.full(n + 1, -1, np.int32)
        self.piece: dict[str, int] = {t: plain[t] for t in single}
        for t, i in plain.items():
            if len(t) > 1:
                parts, last = merge_pieces(list(t), rank)
                if len(parts) == 1:  # a piece that merging never makes is never an answer
                    self.rank[i], self.left[i], self.right[i] = rank[t], plain[last[0]], plain[last[1]]
                    self.piece[t] = i
        # characters 1.. of the vocabulary; 0 stands for every other one
        chars = sorted({c for t in plain for c in t})
        self.char = {c: k + 1 for k, c in enumerate(chars)}
        self.lut = np.zeros(0x110000, np.uint16)
        for c, k in self.char.items():
            self.lut[ord(c)] = k
        self.lut[0x20], self.lut[ord(SPACE)] = self.char[SPACE], 0
        self.inside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for t in plain:
            for a, b in zip(t, t[1:]):
                self.inside[self.char[a], self.char[b]] = True
        pairs, ranks = [], []
        for t, i in plain.items():
            for k in range(1, len(t)):
                a, b = self.piece.get(t[:k]), self.piece.get(t[k:])
                if a is not None and b is not None:
                    pairs.append(a * (n + 1) + b + 1)
                    ranks.append(rank[t])
        self.pairs = Table(np.array(pairs, np.uint64), np.array(ranks, np.int32))
        codes = [np.array([self.char[c] for c in t], np.int64) for t in self.piece]
        flat = np.concatenate(codes)
        ends = np.cumsum([len(c) for c in codes])
        self.pieces = Table(char_spans(char_sums(flat), ends - [len(c) for c in codes], ends),
                            np.array(list(self.piece.values()), np.int32))
        self.raw_flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(r) for r in self.raw])])

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True where merging the text of pieces a and b gives a, b again: undo merges, the
        latest first, and ask whether a merge across the border would have come before."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            cross = self.pairs.get((x * (self.size + 1) + y + 1).astype(np.uint64))
            bad = (cross >= 0) & (cross < limit[live])
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            first = rx > ry
            limit[live] = np.where(first, rx, ry + 1)
            a[live] = np.where(first, self.right[x], x)
            b[live] = np.where(first, y, self.left[y])
        return ok


def char_sums(codes: np.ndarray) -> np.ndarray:
    p, _ = powers(len(codes) + 1)
    s = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix64(codes.astype(np.uint64) + byte_table(41)[0]) * p[:-1], out=s[1:])
    return s


def char_spans(sums: np.ndarray, starts, ends) -> np.ndarray:
    """Nonzero hash of each span of characters."""
    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    _, q = powers(len(sums))
    return mix64((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64)) | np.uint64(1)


class StreamingEncoder:
    """Encode a stream of vocabulary characters with a window of max_piece boundaries."""

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.window = vocab.max_piece
        self.memo: dict[tuple[int, int], bool] = {}
        self.text = ""                # characters after the committed boundary
        self.last: list[tuple[int, int]] = [(-1, 0)]  # (piece, length) ending at each boundary after it
        self.before = -1              # piece that ends at the committed boundary
        self.held = 0                 # most boundaries ever held

    def _fits(self, a: int, b: int) -> bool:
        if a < 0:
            return True
        got = self.memo.get((a, b))
        if got is None:
            got = self.memo[(a, b)] = bool(self.v.fits(np.array([a]), np.array([b]))[0])
        return got

    def push(self, char: str) -> list[int]:
        """Take one character; the ids that are settled by it."""
        self.text += char
        t = len(self.text)
        for size in range(1, min(self.window, t) + 1):
            piece = self.v.piece.get(self.text[t - size:])
            if piece is None:
                continue
            prev = self.last[t - size][0] if t > size else self.before
            if self._fits(prev, piece):
                self.last.append((piece, size))
                break
        self.held = max(self.held, len(self.last))
        return self._commit() if len(self.last) > 2 * self.window else []

    def _trace(self, at: int) -> list[int]:
        out = []
        while at > 0:
            piece, size = self.last[at]
            out.append(piece)
            at -= size
        return out[::-1]

    def _commit(self) -> list[int]:
        # follow all paths of the window back until they meet in one boundary
        paths = set(range(len(self.last) - self.window, len(self.last)))
        while len(paths) > 1:
            top = max(paths)
            paths.remove(top)
            paths.add(top - self.last[top][1])
        meet = paths.pop()
        if meet <= 0:
            return []
        ids = self._trace(meet)
        self.before = self.last[meet][0]
        self.text, self.last = self.text[meet:], [(-1, 0), *self.last[meet + 1:]]
        return ids

    def finish(self) -> list[int]:
        return self._trace(len(self.text))


def lattice(vocab: Vocabulary, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many units at once (sizes sorted, longest first): (flat ids, ids per unit)."""
    sums = char_sums(codes)
    base = np.concatenate([[0], np.cumsum(sizes + 1)])  # boundaries of each unit
    piece = np.full(int(base[-1]), -1, np.int64)
    step = np.zeros(int(base[-1]), np.int64)
    top = int(sizes[0]) if len(sizes) else 0
    for t in range(1, top + 1):
        todo = np.arange(int(np.searchsorted(-sizes, -t, side="right")))  # units of t characters and more
        for size in sorted(range(1, min(t, vocab.max_piece) + 1), key=lambda s: abs(s - 2.4)):
            if not len(todo):
                break
            end = starts[todo] + t
            got = vocab.pieces.get(char_spans(sums, end - size, end))
            have = np.flatnonzero(got >= 0)
            if not len(have):
                continue
            rows, new = todo[have], got[have]
            prev = piece[base[rows] + t - size]
            good = prev < 0
            if t > size:  # a boundary no path reaches leads nowhere
                good = np.zeros(len(rows), bool)
                reach = np.flatnonzero(prev >= 0)
                good[reach] = vocab.fits(prev[reach], new[reach])
            at = base[rows[good]] + t
            piece[at], step[at] = new[good], size
            keep = np.ones(len(todo), bool)
            keep[have[good]] = False
            todo = todo[keep]
    # trace back all units together
    at = sizes.astype(np.int64).copy()
    rows_, ids_ = [], []
    live = np.flatnonzero(at > 0)
    while len(live):
        b = base[live] + at[live]
        rows_.append(live)
        ids_.append(piece[b])
        at[live] -= step[b]
        live = live[(at[live] > 0) & (step[b] > 0)]
    if not rows_:
        return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
    depth = np.repeat(np.arange(len(rows_)), [len(r) for r in rows_])
    rows, ids = np.concatenate(rows_), np.concatenate(ids_)
    order = np.lexsort((-depth, rows))
    return ids[order].astype(np.int32), np.bincount(rows, minlength=len(sizes))


def gather(flat: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenation of flat[at[i] : at[i] + count[i]]."""
    total = int(count.sum())
    if not total:
        return flat[:0]
    first = np.cumsum(count) - count
    return flat[np.arange(total) + np.repeat(at - first, count)]


class Encoder:
    """Encode batches of texts; remembers the units it has seen."""

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, hashes, starts, sizes, codes, points) -> None:
        """Encode new units and add them to the store."""
        order = np.argsort(-sizes, kind="stable")
        starts, sizes, hashes = starts[order], sizes[order], hashes[order]
        flat: list[np.ndarray] = []
        counts = np.zeros(len(order), np.int64)
        n_long = int(np.searchsorted(-sizes, -LONG, side="left"))
        for i in range(n_long):
            enc, out = StreamingEncoder(self.v), []
            for c in points[starts[i]:starts[i] + sizes[i]].tolist():
                out += enc.push(SPACE if c == 32 else chr(c))
            out += enc.finish()
            flat.append(np.array(out, np.int32))
            counts[i] = len(out)
        known = codes[starts] > 0
        body = np.flatnonzero(known[n_long:]) + n_long
        ids, n = lattice(self.v, codes, starts[body], sizes[body])
        counts[body] = n
        at = np.zeros(len(order), np.int64)
        at[:n_long] = np.cumsum(counts[:n_long]) - counts[:n_long]
        at[body] = counts[:n_long].sum() + np.cumsum(n) - n
        flat.append(ids)
        size = sum(map(len, flat))
        for i in np.flatnonzero(~known):  # a character outside the vocabulary: its bytes
            out = self.v.byte_id[np.frombuffer(chr(points[starts[i]]).encode("utf-8", "replace"), np.uint8)]
            flat.append(out)
            at[i], counts[i] = size, len(out)
            size += len(out)
        at += len(self.ids)
        self.ids = np.concatenate([self.ids, *flat])
        merged = np.concatenate([self.known, hashes])
        order = np.argsort(merged, kind="stable")
        self.known, self.at, self.count = merged[order], np.concatenate([self.at, at])[order], np.concatenate([self.count, counts])[order]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text."""
        parts = [" " + t if t else "" for t in texts]
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        n = len(points)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        codes = self.v.lut[points]
        cut = np.ones(n + 1, bool)
        cut[1:n] = ~self.v.inside[codes[:-1], codes[1:]]
        cut[first] = True
        edge = np.flatnonzero(cut)
        starts, ends = edge[:-1], edge[1:]
        sums = char_sums(np.where(codes > 0, codes, points.astype(np.int64) + (1 << 20)))
        h = char_spans(sums, starts, ends)
        uniq, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > CACHE_UNITS:
            self._forget()
        place = np.searchsorted(self.known, uniq)
        fresh = np.ones(len(uniq), bool)
        inside = place < len(self.known)
        fresh[inside] = self.known[place[inside]] != uniq[inside]
        if fresh.any():
            w = where[fresh]
            self._learn(uniq[fresh], starts[w], ends[w] - starts[w], codes, points)
            place = np.searchsorted(self.known, uniq)
        unit = place[inverse]
        count = self.count[unit]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = gather(self.ids, self.at[unit], count)
        per_text = np.diff(total[np.searchsorted(starts, first)])
        return ids, per_text


def decode_flat(vocab: Vocabulary, ids: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts of flat ids, and their offsets."""
    size = vocab.raw_at[ids + 1] - vocab.raw_at[ids]
    data = gather(vocab.raw_flat, vocab.raw_at[ids], size)
    total = np.concatenate([[0], np.cumsum(size)])
    at = np.concatenate([[0], np.cumsum(per_text)])
    off = total[at]
    drop = off[:-1][per_text > 0]  # the blank put in front of a text
    keep = np.ones(len(data), bool)
    keep[drop] = False
    return data[keep], off - np.concatenate([[0], np.cumsum(per_text > 0)])


def _runs(texts: list, limit: int):
    """Slices of a list of texts of about ``limit`` characters."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row per input row: doc_id, ids, n_ids, exact (decoding the ids gives the text again)."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        vocab = shared.value
        enc = Encoder(vocab)
        for rb in batches:
            texts = rb.column(1).to_pylist()
            raw, off = text_buffer(rb.column(1))
            for i, j in _runs(texts, CHUNK_CHARS):
                ids, n = enc.encode(texts[i:j])
                data, at = decode_flat(vocab, ids, n)
                size = np.diff(at)
                exact = size == np.diff(off[i:j + 1])
                if exact.all():  # whole buffer at once, row by row only where it differs
                    same = np.array_equal(data, raw[off[i]:off[j]])
                if not exact.all() or not same:
                    exact = np.array([np.array_equal(data[at[k]:at[k + 1]], raw[off[i + k]:off[i + k + 1]]) for k in range(j - i)])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(i, j - i), lists, pa.array(n), pa.array(exact)],
                                                 names=["doc_id", "ids", "n_ids", "exact"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_ids long, exact boolean")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """One row per input row: doc_id and the text of its ids (null and empty ids give '')."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model))
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches):
        for rb in batches:
            lists = rb.column(1).to_pylist()
            n = np.array([len(x or ()) for x in lists], np.int64)
            ids = np.array([i for x in lists for i in x or ()], np.int64)
            data, at = decode_flat(shared.value, ids, n)
            text = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text string")
