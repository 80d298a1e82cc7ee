"""Token counts under a unigram tokenizer, without making the tokens.

An Aho-Corasick automaton enumerates the vocabulary's pieces in a word by their
ends; dynamic programming carries the best score and the count of pieces to
each position, and nothing to trace back. The rules are those of the unigram
model of the ``tokenizers`` library behind a metaspace split: a later candidate
wins only if its score is greater, so of equal ones the longest piece does; a
character without a piece of its own may be unknown, at the least score less
ten; unknown characters next to each other fuse, and count as their bytes if
all byte pieces are there.

Words are counted once and remembered, up to a bound, in each Python worker.

Defined cases: null and empty texts have no tokens; repeated rows are counted
one by one; a text without spaces is one word, counted in time proportional to
its length times the longest piece; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the tokenizer: word mark, and what an unknown costs below the least score.
MARK = "▁"
UNKNOWN_COSTS = 10.0
#: Words remembered by a worker, and the longest that is.
REMEMBERED = 1 << 20
LONGEST = 64
_COUNTERS: dict[str, Counter] = {}


def load(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """(piece, score) of every entry of a sentencepiece model file, in order of id."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]


class Counter(dict):
    """Counts of words, made when first asked for; ``total`` counts texts."""

    def __init__(self, pieces: list[tuple[str, float]]):
        super().__init__()
        self.pieces = {p for p, _ in pieces}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_COSTS
        self.bytes = all(f"<0x{b:02X}>" in self.pieces for b in range(256))
        self.automaton = ahocorasick.Automaton()
        last = dict(pieces)  # of equal pieces the last holds
        for p, s in last.items():
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()

    def _run(self, word: str, start: int, end: int) -> int:
        """Tokens of the unknown characters ``word[start:end]``, fused."""
        run = word[start:end]
        return 1 if run in self.pieces or not self.bytes else len(run.encode())

    def count(self, word: str) -> int:
        """Tokens of one word, its mark included."""
        n = len(word)
        score: list[float | None] = [None] * (n + 1)
        count, fused = [0] * (n + 1), [-1] * (n + 1)  # fused: where the unknown run that ends here began
        score[0] = 0.0
        single, done = -1, 0

        def close(end: int, single: int) -> None:
            if single != end:
                s = score[end - 1] + self.unknown
                if score[end] is None or s > score[end]:
                    score[end], count[end] = s, count[end - 1]
                    fused[end] = fused[end - 1] if fused[end - 1] >= 0 else end - 1

        for at, (size, worth) in self.automaton.iter(word):
            end = at + 1
            while done + 1 < end:
                done += 1
                close(done, single)
            s = score[end - size] + worth
            if score[end] is None or s > score[end]:
                begin = end - size
                score[end], fused[end] = s, -1
                count[end] = count[begin] + 1 + (self._run(word, fused[begin], begin) if fused[begin] >= 0 else 0)
            if size == 1:
                single = end
        while done < n:
            done += 1
            close(done, single)
        return count[n] + (self._run(word, fused[n], n) if fused[n] >= 0 else 0)

    def __missing__(self, word: str) -> int:
        # A mark within begins a word of its own.
        n = sum(self.count(MARK + w) for w in word.split(MARK)) if MARK in word else self.count(MARK + word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n

    def total(self, text: str | None) -> int:
        """Tokens of a text."""
        if not text:
            return 0
        words = text.split(" ")
        if text[0] in (" ", MARK):  # the first mark is there already
            return sum(map(self.__getitem__, words[1:])) + (sum(map(self.__getitem__, words[0].split(MARK)[1:])) if words[0] else 0)
        return sum(map(self.__getitem__, words))


def counter(path: str = VOCABULARY) -> Counter:
    """The counter of a vocabulary file, made once in each Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(load(path))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per document: doc_id and n_tokens."""

    def scan(batches):
        c = counter(vocabulary)
        for batch in batches:
            n = [c.total(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id bigint, n_tokens bigint")
