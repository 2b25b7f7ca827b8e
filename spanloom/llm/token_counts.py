"""Token counts of a unigram tokenizer, without its tokens: a Viterbi pass that carries only scores and counts.

An Aho-Corasick automaton over the vocabulary gives all pieces that end at each character, longest first; dynamic
programming keeps, for each end, the best sum of piece scores and how many tokens that path has. Ties go to the path whose
last piece starts first, as in tokenizers that try starts from left to right and replace a path only by a better one. A
character that is no piece by itself may be unknown, at the least score less ten, and counts as its UTF-8 bytes (byte
fallback). Control and byte pieces match no text.

A space becomes U+2581, and one is put before the text. Where no piece has U+2581 behind another character, which
``Vocabulary`` checks, no piece reaches from a word over the space behind it; texts are then cut there and at line ends,
and the words' results are kept, up to a bound, for words that come again. Scores are summed as doubles; the counts of the
whole and of the parts agree exactly where scores are whole numbers, as those of the file that the query names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = "▁"
_CHUNK = re.compile(r"^[^ ]+| +[^ ]*")
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class Vocabulary:
    """Pieces with scores. ``remembered`` bounds the words whose results are kept."""

    def __init__(self, scores: dict[str, float], least: float, remembered: int = 300_000):
        import ahocorasick

        self.unknown, self.remembered = least - 10.0, remembered
        self.singles = {p for p in scores if len(p) == 1}
        self.whole = any("\n" in p or " " in p or GAP in p.lstrip(GAP) for p in scores)
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.led, self.bare = _Kept(self, GAP), _Kept(self, "")

    def best(self, text: str) -> tuple[int, float]:
        """Tokens and score of the best path through ``text`` as it stands."""
        n = len(text)
        score, count = [float("-inf")] * (n + 1), [0] * (n + 1)
        score[0] = 0.0
        at, singles = 0, self.singles  # positions up to ``at`` are final

        def settle(to: int) -> None:
            nonlocal at
            while at < to:
                if (c := text[at]) not in singles and (s := score[at] + self.unknown) > score[at + 1]:
                    score[at + 1], count[at + 1] = s, count[at] + len(c.encode("utf-8", "replace"))
                at += 1

        for last, (size, gain) in self.automaton.iter(text):
            if last > at:
                settle(last)
            start = last + 1 - size
            if (s := score[start] + gain) > score[last + 1]:
                score[last + 1], count[last + 1] = s, count[start] + 1
        settle(n)
        return count[n], score[n]

    def count(self, text: str) -> tuple[int, float]:
        """Tokens and score of a raw text; none of an empty one."""
        if not text:
            return 0, 0.0
        if self.whole:
            return self.best(GAP + text.replace(" ", GAP))
        total, led, bare = 0j, self.led, self.bare
        if len(led) > self.remembered or len(bare) > self.remembered:
            led.clear()
            bare.clear()
        text = text.replace(GAP, " ")  # both are the same to the pieces
        for k, line in enumerate(f" {text}".split("\n")):
            if k:
                total += self.line  # a line end is always a token of its own, unknown or a piece
            if "  " in line:
                total += sum(map(bare.__getitem__, [c.replace(" ", GAP) for c in _CHUNK.findall(line)]))
            else:
                first, *rest = line.split(" ")
                total += bare[first] + sum(map(led.__getitem__, rest))
        return int(total.real), total.imag

    @property
    def line(self) -> complex:
        if not hasattr(self, "_line"):
            self._line = complex(*self.best("\n"))
        return self._line


class _Kept(dict):
    """Word to count + score j, found when first asked for."""

    def __init__(self, vocabulary: Vocabulary, lead: str):
        super().__init__()
        self.vocabulary, self.lead = vocabulary, lead

    def __missing__(self, word: str) -> complex:
        out = complex(*self.vocabulary.best(self.lead + word))
        if len(word) < 64:
            self[word] = out
        return out


def read_model(path: str = DEFAULT_MODEL) -> tuple[dict[str, float], float]:
    """Matchable pieces with scores, and the least score, of a sentencepiece file. Read where the driver runs."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    plain = [k for k in every if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
    return {model.id_to_piece(k): float(model.get_score(k)) for k in plain}, float(min(model.get_score(k) for k in every))


def token_counts(docs: DataFrame, scores: dict[str, float], least: float) -> DataFrame:
    """(doc_id, n_tokens, score) of each row's whole text; 0 and 0 of an empty text and of null.

    The vocabulary, of a fixed size, goes to the executors once.
    """
    sent = docs.sparkSession.sparkContext.broadcast((scores, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(*sent.value)
        for batch in batches:
            found = [vocabulary.count(t) if t else (0, 0.0) for t in batch.column("text").to_pylist()]
            n, s = np.array(found, float).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(s)], names=["doc_id", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, score double")
