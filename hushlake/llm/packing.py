"""Hierarchical multi-length packing of tokenised documents.

Each task tokenises and packs its own documents, so neither texts nor ids are shuffled.  Context tiers are
powers of two.  Within a task, documents of at least the longest window are cut into full windows; what is left
of them, and every shorter document, goes to the smallest tier that holds it.  Tiers are packed from the
longest down: a piece opens a window, the gap is filled with the longest pieces of shorter tiers that fit, and
the last gap by cutting the next shorter piece.  Windows are therefore full.  At the end of a task the few pieces left are
cut at powers of two, so no sequence needs padding.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.llm.common import trimmed

WINDOW = 4096
TIERS = (512, 1024, 2048, 4096)
#: Ids a task holds before it packs them: the bound of its memory besides one document.
POOL = 1 << 21
#: Tokens of a step group; all groups of a tier but a task's last hold as many sequences.
STEP_TOKENS = 1 << 15
END_ID = 2
#: Words whose ids a worker remembers; then it goes on with the half that it met first, which common words are in.
CACHED_WORDS = 300_000
#: Words of small letters that normalisation leaves as they are.
PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_TAIL = b".,!?;:$%&#*|)"


class WordTokenizer:
    """Ids of whole texts through a cache of words.

    For tokenizers that lower-case, drop white space and never join across it: the ids of a text are those of its
    words in turn.  Trailing signs are looked up apart from the word, since such a tokenizer splits them off.
    Texts with ``<|``, which may open a special token, are given to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.final[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [pa.array(e.ids, pa.uint32()).buffers()[1].to_pybytes()[: 4 * len(e.ids)] if e.ids else b"" for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone, encoded as one text: each ends with its only word-final token."""
        if not words:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (np.flatnonzero(self.final[ids]) + 1) * 4
        if len(ends) != len(words) or ends[-1] != 4 * len(ids):
            return self._ids(words)
        data, cuts = ids.tobytes(), [0, *ends.tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def learn(self, words: set[bytes]) -> None:
        split = {}
        for w in words:
            head = w.rstrip(_TAIL)
            split[w] = (head, w[len(head):]) if head and (head[-1:].isalnum() or head[-1] > 127) else (w, b"")
        parts = list({p for pair in split.values() for p in pair if p and p not in self.known})
        texts = [p.decode("utf-8", "surrogatepass") for p in parts]
        plain = [i for i, t in enumerate(texts) if PLAIN.fullmatch(t)]
        self.known.update(zip([parts[i] for i in plain], self._plain_ids([texts[i] for i in plain])))
        rest = [i for i, t in enumerate(texts) if not PLAIN.fullmatch(t)]
        self.known.update(zip([parts[i] for i in rest], self._ids([texts[i] for i in rest])))
        for w, (head, tail) in split.items():
            self.known[w] = self.known[head] + (self.known[tail] if tail else b"")

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        data = text.encode("utf-8", "surrogatepass")
        if b"<|" in data:
            return self._ids([text])[0]
        words = data.lower().split()
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            distinct = set(words)
            self.learn({w for w in distinct if w not in self.known})
            out = b"".join(map(self.known.__getitem__, words))
            if len(self.known) > CACHED_WORDS:
                self.known = dict(islice(self.known.items(), CACHED_WORDS // 2))
            return out


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


class Packer:
    """Packs pieces (document, start, ids) of one task; sequences come out as lists of pieces."""

    def __init__(self, window: int = WINDOW, tiers: tuple[int, ...] = TIERS):
        self.window, self.tiers = window, tiers
        self.pieces: list[tuple[int, int, int, bytes]] = []  # (length, number, ...) sorted by length
        self.lengths: list[int] = []
        self.held = 0
        self.store: dict[int, tuple[int, int, bytes]] = {}
        self.number = 0

    def add(self, doc: int, ids: bytes) -> Iterator[list[tuple[int, int, bytes]]]:
        """Gives out the document's full windows and keeps the rest."""
        n, at = len(ids) // 4, 0
        while n - at >= self.window:
            yield [(doc, at, ids[4 * at : 4 * (at + self.window)])]
            at += self.window
        if at < n:
            self._keep(doc, at, ids[4 * at :])

    def _keep(self, doc: int, start: int, ids: bytes) -> None:
        insort(self.pieces, (len(ids) // 4, self.number))
        self.store[self.number] = (doc, start, ids)
        self.number += 1
        self.held += len(ids) // 4

    def _take(self, at: int) -> tuple[int, int, bytes]:
        length, number = self.pieces.pop(at)
        self.held -= length
        return self.store.pop(number)

    def pack(self, last: bool) -> Iterator[list[tuple[int, int, bytes]]]:
        """Full windows, tier by tier from the longest; the rest stays, or is cut at powers of two if ``last``."""
        for tier in reversed(self.tiers):
            while self.pieces and (self.pieces[-1][0] > tier // 2 or tier == self.tiers[0]) and self.held >= tier:
                yield self._window(tier)
        while last and self.held:
            yield self._window(1 << (min(self.held, self.window).bit_length() - 1))

    def _window(self, size: int) -> list[tuple[int, int, bytes]]:
        """One full window of ``size`` ids; it asks for at least as many held."""
        out, gap = [], size
        while gap:
            at = bisect_right(self.pieces, (gap, self.number)) - 1
            if at >= 0 and (self.pieces[at][0] == gap or not out or gap > self.tiers[0] // 8):
                piece = self._take(at)
            else:  # the last gap, or only longer pieces: cut the next one in two
                at = min(bisect_left(self.pieces, (gap, -1)), len(self.pieces) - 1)
                doc, start, ids = self._take(at)
                cut = min(4 * gap, len(ids))
                if cut < len(ids):
                    self._keep(doc, start + cut // 4, ids[cut:])
                piece = (doc, start, ids[:cut])
            out.append(piece)
            gap -= len(piece[2]) // 4
        return out


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, step_tokens: int = STEP_TOKENS, pool: int = POOL, with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group[, ids].

    A document is its ids and then ``end_id``; a null or empty text is ``end_id`` alone.  Sequences are at
    most ``window`` ids long and gapless; each is full at a power of two.  tier is the sequence's length.
    step_group numbers groups of sequences of one tier with ``step_tokens`` ids in all, so that the steps of a
    training run carry equal loads; a task's last group of a tier may hold less.  Repeated rows are packed
    each for itself, null ids stay null, other columns are not read, an empty table gives no rows.  Texts are never cut
    before tokenising; a task holds ``pool`` ids and one document.  ``tokenizer`` is a file for the tokenizers
    library on every executor.
    """
    if list(tiers) != sorted(tiers) or tiers[-1] != window or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are ascending powers of two up to the window")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"] + ["ids"] * with_ids
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        end = int(end_id).to_bytes(4, "little")
        coder, packer = _tokenizer(tokenizer), Packer(window, tiers)
        sizes: dict[int, int] = {}
        ids_of: dict[int, object] = {}
        left: dict[int, int] = {}
        groups: dict[int, tuple[int, int]] = {}
        number, group = task << 40, task << 40
        out: list[list] = [[] for _ in names]

        def put(sequence: list[tuple[int, int, bytes]]) -> None:
            nonlocal number, group
            tier, offset = sum(len(p[2]) for p in sequence) // 4, 0
            at, n = groups.get(tier, (None, 0))
            if at is None or n >= max(1, step_tokens // tier):
                at, n, group = group, 0, group + 1
            groups[tier] = (at, n + 1)
            for doc, start, ids in sequence:
                length = len(ids) // 4
                row = (ids_of[doc], start, length, zlib.crc32(ids), sizes[doc], number, offset, tier, at, ids)
                for column, value in zip(out, row):
                    column.append(value)
                offset += length
                left[doc] -= length
                if not left[doc]:
                    del left[doc], sizes[doc], ids_of[doc]
            number += 1

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, types)], names)
            for c in out:
                c.clear()
            return batch

        types = [pa.null()] + [pa.int64()] * 6 + [pa.int32(), pa.int64()] + [pa.binary()] * with_ids
        doc = 0
        for batch in batches:
            types[0] = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = coder.encode(text.as_py()) + end
                ids_of[doc], sizes[doc], left[doc] = key, len(ids) // 4, len(ids) // 4
                for sequence in packer.add(doc, ids):
                    put(sequence)
                doc += 1
                if packer.held >= pool:
                    for sequence in packer.pack(last=False):
                        put(sequence)
                if len(out[0]) >= 4096:
                    yield flush()
        for sequence in packer.pack(last=True):
            put(sequence)
        if out[0]:
            yield flush()

    return rows.mapInArrow(trimmed(run), schema)
