"""Order-preserving packing of documents into training sequences.

Documents stay in the order of the input. Each input partition is one stream of tokens;
a dynamic program chooses where to end windows of at most ``size`` tokens. Ends are
document ends (free), sentence ends (a penalty) or, only where two such ends lie more than half a window
apart, so that it is hardly a sentence, tokens between them (a larger one). With f[j] the least cost of a stream cut at j::

    f[j] = penalty(j) + size - j + min(f[i] + i : j - size <= i < j)

The minimum slides over a monotone queue, so the program is linear in the candidates.
The rest of a stream, less than a window, may also end sequences at lengths that are powers of two, which need no padding;
a second program over its tokens chooses between such cuts, by the same penalties, and padding.

No shuffle: a task reads its split, holds about ``BLOCK`` tokens and emits pieces. A lost
task is repeated on the same rows in the same order and gives the same sequence ids.

Defined results: a null or empty text is the end id alone; repeated rows are packed each;
an empty table gives no rows; input columns other than the id and the text are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import exact_ids, tokens

BLOCK = 1 << 20
#: What a cut costs, in tokens of padding. Where tokens are candidates, they stand ``size / STEPS`` apart.
SENTENCE_PENALTY, TOKEN_PENALTY, STEPS = 3.0, 10.0, 128
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cuts(ends: np.ndarray, penalties: np.ndarray, size: int) -> list[int]:
    """The ends to cut at, the last one included, that minimise padding plus penalties.

    ``ends``: ascending places in the stream, no two further apart than ``size``, nor the
    first from 0. The last window is not charged for padding: its end is where the stream is continued.
    """
    best, back = [0.0], [-1]
    places = [0, *ends.tolist()]
    queue: deque[int] = deque([0])
    key = [0.0]
    for j, (place, penalty) in enumerate(zip(places[1:], penalties.tolist()), 1):
        while places[queue[0]] < place - size:
            queue.popleft()
        i = queue[0]
        best.append(key[i] + penalty + (size - place))
        back.append(i)
        key.append(best[j] + place)
        while queue and key[queue[-1]] > key[j]:
            queue.pop()
        queue.append(j)
    # Windows that reach the end: one without a charge for its padding.
    last = len(places) - 1
    i = min(range(bisect_left(places, places[last] - size), last), key=lambda k: (best[k], -k))
    chosen = [places[last]]
    while i > 0:
        chosen.append(places[i])
        i = back[i]
    return chosen[::-1]


def rest_cuts(ends: np.ndarray, penalties: np.ndarray, length: int, size: int) -> list[int]:
    """Ends, ``length`` included, of the rest's sequences: of lengths that are powers of two, or one that is padded."""
    cost = dict(zip(ends.tolist(), penalties.tolist())) | {length: 0.0}
    best, back = [0.0], [0]
    for j in range(1, length + 1):
        f, i = min((best[j - (1 << b)], j - (1 << b)) for b in range(j.bit_length()))
        best.append(f + cost.get(j, TOKEN_PENALTY))
        back.append(i)
    if best[length] >= size - length:
        return [length]
    chosen = [length]
    while back[chosen[-1]]:
        chosen.append(back[chosen[-1]])
    return chosen[::-1]


class Stream:
    """Pieces of one partition's documents, in order."""

    def __init__(self, size: int, first_id: int) -> None:
        self.size, self.sequence = size, first_id
        self.docs: list[tuple] = []  # id, id bytes, tokens already emitted
        self.ends: list[np.ndarray] = []
        self.penalties: list[np.ndarray] = []
        self.length = 0

    def add(self, doc_id: int | None, ids: bytes, sentence_ends: np.ndarray) -> None:
        n = len(ids) // 4
        places = sentence_ends[(sentence_ends > 0) & (sentence_ends < n)]
        # Tokens between ends that lie far apart; a place every few will do.
        step = max(1, self.size // STEPS)
        near = np.concatenate(([0], places, [n]))
        far = np.flatnonzero(np.diff(near) > self.size // 2)
        hard_places = np.concatenate([np.arange(near[i] + step, near[i + 1], step) for i in far]) if len(far) else near[:0]
        at = np.concatenate((places, hard_places, [n])).astype(np.int64)
        cost = np.concatenate((np.full(len(places), SENTENCE_PENALTY), np.full(len(hard_places), TOKEN_PENALTY), [0.0]))
        order = np.argsort(at, kind="stable")
        self.docs.append((doc_id, ids, 0))
        self.ends.append(at[order] + self.length)
        self.penalties.append(cost[order])
        self.length += n

    def flush(self, final: bool) -> list[tuple]:
        """Emit full windows; keep the last one for what follows, or end it."""
        if not self.length:
            return []
        chosen = cuts(np.concatenate(self.ends), np.concatenate(self.penalties), self.size)
        ends, penalties = np.concatenate(self.ends), np.concatenate(self.penalties)
        if final:
            chosen = chosen[:-1]
            at = chosen[-1] if chosen else 0
            later = ends > at
            chosen += [at + c for c in rest_cuts(ends[later] - at, penalties[later], self.length - at, self.size)]
        elif len(chosen) > 1:
            chosen = chosen[:-1]
        else:
            return []
        out, lo = [], 0
        doc, base = 0, 0  # base: the stream's place of docs[doc]'s first kept token
        for hi in chosen:
            at = lo
            while at < hi:
                doc_id, ids, gone = self.docs[doc]
                left = base + len(ids) // 4 - gone - at
                take = min(left, hi - at)
                start = gone + at - base
                out.append((doc_id, start, take, ids[4 * start : 4 * (start + take)], len(ids) // 4, self.sequence, at - lo))
                at += take
                if take == left:
                    doc, base = doc + 1, at
            self.sequence += 1
            lo = hi
        kept = self.docs[doc:]
        if kept:
            doc_id, ids, gone = kept[0]
            kept[0] = (doc_id, ids, gone + lo - base)
        later = ends > lo
        self.docs, self.ends, self.penalties = kept, [ends[later] - lo] if later.any() else [], [penalties[later]] if later.any() else []
        self.length -= lo
        return out


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokens.encoder(tokenizer, tokens.WORD_CHUNKS)
        stream = None
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def pieces(final: bool) -> pd.DataFrame:
            columns = list(zip(*stream.flush(final))) or [()] * len(names)
            return pd.DataFrame({k: exact_ids.column(c) if k == "doc_id" else list(c) for k, c in zip(names, columns)})

        for batch in batches:
            doc_ids, texts = exact_ids.listed(batch), batch["text"].tolist()
            if stream is None and texts:
                stream = Stream(size, int(batch["part"].iloc[0]) << 33)
            for doc_id, (words, ids) in zip(doc_ids, map(enc.encode, texts)):
                sizes = np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))) // 4
                ended = np.fromiter((w[-1] in ".!?…" for w in words), dtype=bool, count=len(words))
                stream.add(doc_id, b"".join(ids) + tail, sizes[ended])
                if stream.length >= BLOCK:
                    yield pieces(False)
        if stream is not None:
            yield pieces(True)

    return docs.select(
        *exact_ids.sent(),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.spark_partition_id().cast("long").alias("part")).mapInPandas(run, SCHEMA)
