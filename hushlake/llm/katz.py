"""Katz backoff language model with Good-Turing discounts, trained and evaluated as Spark jobs.

Words are hashed; a task turns its documents into blocks: the block's own vocabulary and its words as numbers
in it.  Everything that concerns the whole corpus is a table partitioned by ranges of 64-bit keys: a block sends the sorted
keys of its distinct words and word pairs with its counts, the range's task adds them up and sends each block the totals
in the block's own order.  Each distinct pair of a block so moves once, as some six bytes, however often it
occurs.  A second exchange does the same for histories, whose backoff weights need sums over all pairs that follow
them: the total of a pair is charged by one block only, its owner.

The model: P(w | h) is the discounted share d(c) * c / C(h) of a pair that was seen, and otherwise
alpha(h) * P(w).  alpha(h) makes the sum over all words, the unknown one included, exactly one.  P(w) is the
discounted share of w, and an unknown word has all that the discounts left over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .words import NON_SPACE, hashed_words, mix

#: Words of a block at most, besides one document; keys of a range.
BLOCK, RANGE = 3_000_000, 1_000_000
#: Counts up to this one are discounted.
CUT = 5
#: Hashes of the marks before the first word of a text and after its last.
BEGIN, END = np.uint64(0x1B5F7C3D9E2A4861), np.uint64(0x6C0D83F1A97E25B4)
BLOCKS = "block long, tokens long, ids array<{0}>, held array<boolean>, sizes array<long>, vocab binary, words binary"
SENT = "kind string, bucket int, block long, n int, keys binary, counts binary, disc binary, uni binary"
TOTALS = "kind string, block long, bucket int, n int, values binary, owned binary, weight binary, below binary, stats array<long>"


def _pack(x: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs, byte by byte, compressed."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    raw = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def _unpack(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=np.uint64)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(-1, n)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, : len(raw)] = raw.T
    return out.view("<u8").ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(data, n), dtype=np.uint64)


def _floats(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<f8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unfloats(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, n)
    return np.ascontiguousarray(raw.T).view("<f8").ravel().astype(np.float64)


class Block:
    """One block in memory: words as numbers in its vocabulary, texts end to end with their end marks."""

    def __init__(self, row: pd.Series):
        self.ids, self.held, self.sizes = row["ids"], np.asarray(row["held"], dtype=bool), np.asarray(row["sizes"], dtype=np.int64)
        self.number = int(row["block"])
        n_vocab = len(np.frombuffer(row["vocab"][:8], dtype="<u8")) and int(np.frombuffer(row["vocab"][:8], dtype="<u8")[0])
        self.vocab = _unpack_sorted(row["vocab"][8:], n_vocab)
        self.words = _unpack(row["words"], int(row["tokens"])).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.learned = np.repeat(~self.held, self.sizes)
        self.begin = n_vocab  # the begin mark's number; it is no word

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys, history, word, pair of each token, order): distinct pairs; ``order`` sorts them by key."""
        before = np.empty_like(self.words)
        before[1:] = self.words[:-1]
        before[self.starts] = self.begin
        codes, pair = np.unique(before * (self.begin + 1) + self.words, return_inverse=True)
        history, word = codes // (self.begin + 1), codes % (self.begin + 1)
        names = np.append(self.vocab, BEGIN)
        keys = mix(names[history] * np.uint64(0x9E3779B97F4A7C15) + mix(names[word]))
        return keys, history, word, pair, np.argsort(keys)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        ids, held, sizes, parts, total = [], [], [], [], 0
        names = ["block", "tokens", "ids", "held", "sizes", "vocab", "words"]

        def out(kind) -> pa.RecordBatch:
            vocab, words = np.unique(np.concatenate(parts), return_inverse=True)
            row = [number, total, ids, held, sizes, np.array([len(vocab)], "<u8").tobytes() + _pack_sorted(vocab), _pack(words)]
            kinds = [pa.int64(), pa.int64(), pa.list_(kind), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(row, kinds)], names)

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            keys, flags = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, hashes, offsets in hashed_words(batch.column(1).to_pylist(), NON_SPACE):
                for i in range(len(offsets) - 1):
                    words = hashes[offsets[i] : offsets[i + 1]]
                    ids.append(keys[first + i])
                    held.append(bool(flags[first + i]))
                    sizes.append(len(words) + 1)
                    parts += [words, np.array([END])]
                    total += len(words) + 1
                    if total >= size:
                        yield out(kind)
                        number, ids, held, sizes, parts, total = number + 1, [], [], [], [], 0
        if total:
            yield out(kind)

    return rows.mapInArrow(run, BLOCKS.format(id_type))


def _requests(kind: str, block: int, keys: np.ndarray, bits: int, counts: np.ndarray, disc=None, uni=None) -> Iterator[tuple]:
    """Rows of sorted keys, one for each range that has any."""
    buckets = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)
    cuts = np.searchsorted(buckets, np.arange((1 << bits) + 1)) if len(keys) > 1 << bits else None
    present = np.unique(buckets)
    for b in present.tolist():
        lo, hi = (cuts[b], cuts[b + 1]) if cuts is not None else np.searchsorted(buckets, [b, b + 1])
        yield (kind, b, block, int(hi - lo), _pack_sorted(keys[lo:hi]), _pack(counts[lo:hi]),
               None if disc is None else _floats(disc[lo:hi]), None if uni is None else _floats(uni[lo:hi]))


def _frame(rows, schema: str) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=[c.split()[0] for c in schema.split(", ")])


def _count(blocks: DataFrame, bits: int) -> DataFrame:
    """Every block's words and pairs with its own training counts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                b = Block(row)
                counts = np.bincount(b.words, b.learned, len(b.vocab)).astype(np.int64)
                yield _frame(_requests("word", b.number, b.vocab, bits, counts), SENT)
                keys, _, _, pair, order = b.pairs()
                counts = np.bincount(pair, b.learned, len(keys)).astype(np.int64)
                yield _frame(_requests("pair", b.number, keys[order], bits, counts[order]), SENT)

    return blocks.mapInPandas(run, SENT)


def _total(group: pd.DataFrame) -> pd.DataFrame:
    """Adds up one range: the totals for each block, and the range's statistics."""
    sizes = group["n"].to_numpy()
    keys = np.concatenate([_unpack_sorted(k, n) for k, n in zip(group["keys"], sizes)])
    distinct, where = np.unique(keys, return_inverse=True)
    counts = np.concatenate([_unpack(c, n) for c, n in zip(group["counts"], sizes)]).astype(np.float64)
    totals = np.bincount(where, counts, len(distinct)).astype(np.int64)
    owner = np.zeros(len(keys), dtype=bool)
    learned = np.flatnonzero(counts)
    owner[learned[np.unique(where[learned], return_index=True)[1]]] = True
    kind, bucket = group["kind"].iloc[0], int(group["bucket"].iloc[0])
    ends = np.cumsum(sizes)
    rows = [(kind, int(block), bucket, int(n), _pack(totals[where[end - n : end]]), np.packbits(owner[end - n : end]).tobytes(), None, None, None)
            for block, n, end in zip(group["block"], sizes, ends)]
    stats = [int(totals.sum()), int((totals > 0).sum()), *(int((totals == r).sum()) for r in range(1, CUT + 2))]
    return _frame([*rows, (kind, None, bucket, 0, None, None, None, None, stats)], TOTALS).astype({"block": "Int64"})


def _history(group: pd.DataFrame, unseen: float) -> pd.DataFrame:
    """Adds up one range of histories: the denominator and the log of the backoff weight, for each block."""
    sizes = group["n"].to_numpy()
    keys = np.concatenate([_unpack_sorted(k, n) for k, n in zip(group["keys"], sizes)])
    distinct, where = np.unique(keys, return_inverse=True)
    both = zip(group["counts"], sizes)
    seen = np.bincount(where, np.concatenate([_unpack(c, n) for c, n in both]).astype(np.float64), len(distinct))
    disc = np.bincount(where, np.concatenate([_unfloats(c, n) for c, n in zip(group["disc"], sizes)]), len(distinct))
    uni = np.bincount(where, np.concatenate([_unfloats(c, n) for c, n in zip(group["uni"], sizes)]), len(distinct))
    weight, below = backoff(seen, disc, uni, unseen)
    ends = np.cumsum(sizes)
    return _frame(
        [("history", int(block), int(group["bucket"].iloc[0]), int(n), None, None, _floats(weight[where[end - n : end]]), _floats(below[where[end - n : end]]), None)
         for block, n, end in zip(group["block"], sizes, ends)], TOTALS)


def backoff(seen: np.ndarray, disc: np.ndarray, uni: np.ndarray, unseen: float) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the backoff weights, and denominators, of histories.

    ``seen``: pairs counted; ``disc``: their discounted counts; ``uni``: P(w) of the words that follow.  A
    history whose pairs leave less than half a count gets a denominator that leaves it half a count.
    """
    below = np.maximum(seen, disc + 0.5)
    rest = np.maximum(1 - uni, unseen)
    weight = np.where(seen > 0, np.log10((1 - disc / below) / rest), 0.0)
    return weight, np.where(seen > 0, below, 1.0)


def slope(counts: np.ndarray) -> float:
    """Slope of the line through log counts of counts over log r, for r = 1, 2, ...; nan for fewer than two of them.

    As in simple Good-Turing, a count is first spread over the gap of empty ones around it.
    """
    r = np.flatnonzero(counts > 0) + 1.0
    if len(r) < 2:
        return float("nan")
    before, after = np.append(0.0, r[:-1]), np.append(r[1:], 2 * r[-1] - r[-2])
    x, y = np.log(r), np.log(2 * counts[r.astype(int) - 1] / (after - before))
    return float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())


def discounts(stats: list[int]) -> np.ndarray:
    """Good-Turing factors d(r), r from 0 to CUT + 1 (the last, 1, is for all larger counts).

    The counts of counts are smoothed by a log-linear fit first, always: groups of copies make them uneven.  Factors
    from the fit lie between 0 and 1 and grow with r whenever it falls more steeply than 1 / r.  Good-Turing has no
    answer to one that doesn't, or to fewer than two different counts: r - 1/2 of r is kept there.
    """
    b = slope(np.array(stats[2:], dtype=np.float64))
    r = np.arange(1, CUT + 1)
    if not b < -1 - 1e-6:
        return np.array([0.0, *(1 - 0.5 / r), 1.0])
    share = (CUT + 1) ** (1 + b)
    return np.array([0.0, *(((r + 1) / r) ** (1 + b) - share) / (1 - share), 1.0])


class Words:
    """P(w) from totals: discounted shares, and what is left for the unknown word."""

    def __init__(self, stats: list[int]):
        self.total, self.distinct = stats[0], stats[1]
        self.d = discounts(stats)
        spread = np.array([0, *stats[2 : 2 + CUT]], dtype=np.float64)
        low = np.arange(CUT + 1) * spread
        self.kept = float((self.d[: CUT + 1] * low).sum() + stats[0] - low.sum())
        self.below = max(float(self.total), self.kept + 0.5)
        self.unseen = 1 - self.kept / self.below

    def share(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.d[np.minimum(counts, CUT + 1)] * counts / self.below, self.unseen)


def _answers(answers: pd.DataFrame, kind: str, column: str, read) -> np.ndarray:
    own = answers[answers["kind"] == kind].sort_values("bucket")
    return np.concatenate([read(v, n) for v, n in zip(own[column], own["n"])] or [np.zeros(0)])


def _owners(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n).astype(bool)


def _histories(blocks: DataFrame, totals: DataFrame, words: Words, d: np.ndarray, bits: int) -> DataFrame:
    """Every block's histories, with the sums over the pairs that the block owns."""

    def run(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return _frame([], SENT)
        b = Block(own.iloc[0])
        share = words.share(_answers(answers, "word", "values", _unpack).astype(np.int64))
        _, history, word, _, order = b.pairs()
        count = _answers(answers, "pair", "values", _unpack).astype(np.int64)
        owned = _answers(answers, "pair", "owned", _owners).astype(bool)
        h, w, c = history[order][owned], word[order][owned], count[owned]
        n = b.begin + 1
        seen = np.bincount(h, c, n).astype(np.int64)
        disc = np.bincount(h, d[np.minimum(c, CUT + 1)] * c, n)
        uni = np.bincount(h, share[w], n)
        names = np.append(b.vocab, BEGIN)
        at = np.argsort(names)
        return _frame(_requests("history", b.number, names[at], bits, seen[at], disc[at], uni[at]), SENT)

    return blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInPandas(run, SENT)


def _scores(blocks: DataFrame, answers: DataFrame, words: Words, d: np.ndarray, id_type: str) -> DataFrame:
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return _frame([], schema)
        b = Block(own.iloc[0])
        single = _answers(answers, "word", "values", _unpack).astype(np.int64)
        _, history, word, pair, order = b.pairs()
        count = np.empty(len(order), dtype=np.int64)
        count[order] = _answers(answers, "pair", "values", _unpack).astype(np.int64)
        at = np.argsort(np.append(b.vocab, BEGIN))
        weight, below = np.empty(len(at)), np.empty(len(at))
        weight[at] = _answers(answers, "history", "weight", _unfloats)
        below[at] = _answers(answers, "history", "below", _unfloats)
        plain = np.log10(words.share(single))
        backed = weight[history] + plain[word]
        with np.errstate(divide="ignore"):
            direct = np.log10(d[np.minimum(count, CUT + 1)] * count / below[history])
        each = np.where(count > 0, direct, backed)[pair]
        base = np.log10((single + 1) / (words.total + words.distinct + 1))[b.words]
        known = (single > 0)[b.words]
        add = lambda x: np.add.reduceat(x, b.starts)
        return pd.DataFrame({
            "doc_id": list(b.ids), "held_out": b.held, "n_tokens": b.sizes, "n_known": add(known.astype(np.int64)),
            "train_tokens": words.total, "base_score": add(base), "score": add(each),
        })

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, schema)


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, keys: int = RANGE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are runs of anything but the six ASCII white space characters, A-Z in lower case, and one end mark a
    text; a null or empty text is the mark alone.  The model learns from all rows where ``held_out`` is not true
    and scores all rows; nothing is sampled.  score is log10 of the text's probability, base_score that
    of single tokens with one added to each count.  If nothing is learned every token is the unknown word.
    Repeated rows count and are scored each, null ids stay null, other columns are not read, an empty table gives no
    rows.  A text is one unit, so a block is as long as its longest text at least.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    blocks = stored(_blocks(rows, block), "blocks")
    tokens = blocks.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    bits = max(0, int(tokens // keys).bit_length())
    sent = _count(blocks, bits)
    totals = stored(sent.groupBy("kind", "bucket").applyInPandas(_total, TOTALS), "totals")
    stats = {
        r["kind"]: [r[f"s{i}"] for i in range(CUT + 3)]
        for r in totals.filter("block IS NULL").groupBy("kind").agg(*[F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(CUT + 3)]).collect()
    }
    nothing = [0] * (CUT + 3)
    words, d = Words(stats.get("word", nothing)), discounts(stats.get("pair", nothing))
    totals = totals.filter("block IS NOT NULL")
    unseen = words.unseen
    asked = _histories(blocks, totals, words, d, bits)
    weights = stored(asked.groupBy("kind", "bucket").applyInPandas(lambda g: _history(g, unseen), TOTALS), "weights")
    return _scores(blocks, totals.union(weights), words, d, rows.schema["id"].dataType.simpleString())
