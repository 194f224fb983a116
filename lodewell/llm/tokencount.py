"""Unigram token counts without tokens: Aho-Corasick matches and a Viterbi of score and count.

The vocabulary is a list of (piece, score). The exact tokenizer that is
counted is the Unigram model of the ``tokenizers`` library over that list with
byte fallback: the highest sum of scores wins (64-bit floats); between equal
sums into one position the piece with the earliest start wins; a character
without a piece of its own costs the least score minus ten and counts one
piece per byte. Text is taken as that library's Metaspace does: each space
becomes U+2581 and one stands before the text.

If no piece has U+2581 after another character (and none is needed for an
unknown U+2581), no piece crosses the start of a word, so a text's best path is the words' best paths end to end. Words are
then counted once each and remembered, at most ``MEMO`` in a worker; a word
that is not remembered is simply counted again.

Defined results: null and empty texts have 0 tokens; repeated rows are counted
one by one; a null doc_id stays null; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_batches, strings_of

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MEMO = 300_000

_counters: dict[str, UnigramCounter] = {}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the normal and byte pieces of a SentencePiece model, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]


class UnigramCounter:
    """Counts the pieces of the best segmentation."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in self.automaton for b in range(256))
        # Without byte fallback neighbouring unknown characters are one piece, so then a word must not begin with one.
        self.by_word = (self.bytes or SPACE in self.automaton) and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in vocabulary)
        self.memo: dict[str, tuple[int, float]] = {}

    def segment(self, text: str) -> tuple[int, float]:
        """(pieces, score) of a prepared stretch of text; the last stands for the empty one."""
        n = len(text)
        best: list = [0.0] + [None] * n
        count = [0] * (n + 1)
        lone = [False] * (n + 1)  # the best path ends in an unknown character
        at = 1
        for end, (length, score) in self.automaton.iter(text):
            while at <= end:  # the ends before this one have all their matches
                self._unknown(text, at, best, count, lone)
                at += 1
            start = end + 1 - length
            total = best[start] + score
            if best[end + 1] is None or total > best[end + 1]:
                best[end + 1], count[end + 1], lone[end + 1] = total, count[start] + 1, False
        while at <= n:
            self._unknown(text, at, best, count, lone)
            at += 1
        return count[n], best[n]

    def _unknown(self, text: str, at: int, best: list, count: list[int], lone: list[bool]) -> None:
        """Settle position ``at``: its last character alone, if it is no piece, is the match with the latest start."""
        char = text[at - 1]
        if char in self.automaton:
            return
        score = best[at - 1] + self.unknown
        if best[at] is None or score > best[at]:
            fused = lone[at - 1] and not self.bytes
            best[at], lone[at] = score, True
            count[at] = count[at - 1] + (len(char.encode()) if self.bytes else 0 if fused else 1)

    def count(self, text: str) -> tuple[int, float]:
        """(pieces, score) of a raw text."""
        if not text:
            return 0, 0.0
        if not self.by_word:
            return self.segment(SPACE + text.replace(" ", SPACE))
        parts = text.split(" ")
        if SPACE in text or "" in parts:
            chunks = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", SPACE + text.replace(" ", SPACE))
        else:
            chunks = [SPACE + p for p in parts]
        n, total, memo = 0, 0.0, self.memo
        for chunk in chunks:
            found = memo.get(chunk)
            if found is None:
                found = self.segment(chunk)
                if len(memo) < MEMO and len(chunk) < 64:
                    memo[chunk] = found
            n += found[0]
            total += found[1]
        return n, total


def counter(path: str) -> UnigramCounter:
    """One counter for each vocabulary file and worker process."""
    if path not in _counters:
        _counters[path] = UnigramCounter(read_vocabulary(path))
    return _counters[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_chars, n_tokens and the best path's score of every whole text."""
    path = vocabulary or vocabulary_path()

    def fn(batch: pa.RecordBatch) -> dict:
        count = counter(path).count
        texts = strings_of(batch, "text")
        found = [count(t) for t in texts]
        return {"doc_id": batch.column("doc_id"), "n_chars": [len(t) for t in texts], "n_tokens": [x[0] for x in found], "score": [x[1] for x in found]}

    return map_batches(id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")), fn, "doc_id long, n_chars long, n_tokens long, score double")
