"""Unigram token counts with forward scores shared along a trie of pre-tokens.

A text's pre-tokens are its words, each with the word mark before it. The
distinct new ones of a batch are visited in sorted order, which is the depth-first
order of their trie; the path from the root is a stack of forward scores (the best
segmentation of each prefix and its number of pieces), so that a prefix that
words share is scored once. The counts at the words' ends are kept for the
partition.

The public vocabularies have ranks, not probabilities: piece r has the score
-ln(r + OFFSET), Zipf's law with an offset.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ijvory.llm.common import slices

MARK = "▁"
OFFSET = 2.7
#: Counts kept at a time in a task; beyond it they are computed anew.
KEPT = 400_000


class Vocabulary:
    """Scores of pieces, and of single bytes for characters that no piece covers."""

    def __init__(self, pieces: dict[str, float], byte_score: float):
        if not all(pieces):
            raise ValueError("pieces are not empty")
        self.pieces, self.byte_score = pieces, byte_score
        self.longest = max(map(len, pieces), default=1)

    @classmethod
    def of_sentencepiece(cls, path: str) -> Vocabulary:
        """The normal pieces of a SentencePiece model file in the order of their ids."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(k) for k in range(m.get_piece_size()) if not (m.is_control(k) or m.is_unknown(k) or m.is_byte(k) or m.is_unused(k))]
        scores = {p: -math.log(r + OFFSET) for r, p in enumerate(names)}
        return cls(scores, -math.log(len(names) + OFFSET))

    def counts(self, words: list[str]) -> dict[str, int]:
        """Pieces in the best segmentation of each word; of equal scores the fewer pieces."""
        pieces, longest, unit = self.pieces, self.longest, self.byte_score
        out, before = {}, ""
        scores, sizes = [0.0], [0]
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del scores[shared + 1 :], sizes[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                # the last character on its own, as bytes if it is no piece
                c = word[end - 1]
                s = pieces.get(c)
                n = 1
                if s is None:
                    n = len(c.encode())
                    s = unit * n
                best, size = scores[end - 1] + s, sizes[end - 1] + n
                for start in range(max(0, end - longest), end - 1):
                    s = pieces.get(word[start:end])
                    if s is not None:
                        s += scores[start]
                        n = sizes[start] + 1
                        if s > best or s == best and n < size:
                            best, size = s, n
                scores.append(best)
                sizes.append(size)
            out[word] = sizes[len(word)]
            before = word
        return out


def token_counts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_tokens)`` for every row, over its whole text.

    Null and empty texts have no words and no tokens; repeated rows and null ids
    come out as they are; an empty table gives an empty one; other columns are
    not read. No shuffle: a task keeps the counts of KEPT words at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in (part for batch in batches for part in slices(batch)):
            texts = [(t or "").split() for t in b.column(1).to_pylist()]
            if len(known) > KEPT:
                known.clear()
            new = {w for ws in texts for w in ws} - known.keys()
            known.update((w[len(MARK) :], n) for w, n in shared.value.counts([MARK + w for w in new]).items())
            n_words = [len(ws) for ws in texts]
            n_tokens = [sum(map(known.__getitem__, ws)) for ws in texts]
            yield pa.record_batch([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    both = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return both.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
