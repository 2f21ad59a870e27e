"""Token counts under a unigram model, by dynamic programming shared over a trie of pre-tokens.

The pieces and scores come from a public SentencePiece model file (a parameter, never copied). A text's best
segmentation splits at pre-tokens (a run of blanks with the word after it, or a newline), because no piece
crosses their borders. A task keeps one trie over all its slices: each distinct pre-token is inserted once, every
node holds the forward score and token count of its prefix, computed once whichever words share it, and the count
of a whole word is kept at its terminal node. The pieces that end at a node are found by walking a trie of reversed
pieces backward along the path, as far as any piece goes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyaccord.llm.common import SLICE_ROWS

DEFAULT_MODEL = os.path.join("/opt/tokenizers", "piece_bpe_32k.model")
BLANK = "▁"
#: Bytes that a task's trie and counts may take, about; beyond, it starts afresh.
CACHE_BYTES = 256 << 20
#: About what a node takes, and a word's count beside its characters.
NODE_BYTES, WORD_BYTES = 180, 120
#: Characters of a pre-token that enters the trie; longer ones are scored by themselves.
LONGEST_WORD = 256
_PRE_TOKEN = re.compile(r"\n|[ ▁]*[^ ▁\n]+|[ ▁]+")


class Unigram:
    """Scores of pieces; `ends` is a trie of the reversed pieces, in which the empty key holds a piece's score."""

    def __init__(self, scores: dict[str, float], unknown: float):
        #: unknown: of a character that no piece covers, which costs one token for each UTF-8 byte.
        self.scores, self.unknown, self.longest = scores, unknown, max(map(len, scores))
        self.ends: dict = {}
        for piece, score in scores.items():
            node = self.ends
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score


def load_unigram(model_file: str = DEFAULT_MODEL) -> Unigram:
    """Pieces of a model file with their scores; the unknown score lies 10 below the least, as is usual for unigram models."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    scores = {sp.id_to_piece(i): float(sp.get_score(i)) for i in ids}
    if any(BLANK in p.lstrip(BLANK) for p in scores):
        raise ValueError("a piece crosses the border of a pre-token")
    return Unigram(scores, min(scores.values()) - 10)


class SharedTrie:
    """Forward scores by prefix. Of equally good segmentations the one whose last piece is shortest counts."""

    def __init__(self, model: Unigram, cache_bytes: int = CACHE_BYTES):
        self.model, self.cache_bytes = model, cache_bytes
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]  # of each node; node 0 is the empty prefix
        self.counts: dict[str, int] = {}
        self.held = 0

    def _step(self, word: str, end: int, best: list[float], tokens: list[int]) -> tuple[float, int]:
        """Score and tokens of word[:end] from those of its prefixes."""
        last, node, start = word[end - 1], self.model.ends, end
        score, n = best[-1] + self.model.unknown, tokens[-1] + (1 if last < "\x80" else len(last.encode()))
        for c in word[end - 1 :: -1]:
            node = node.get(c)
            if node is None:
                break
            start -= 1
            piece = node.get("")
            if piece is not None and best[start] + piece > score:
                score, n = best[start] + piece, tokens[start] + 1
        return score, n

    def add(self, words: set[str]) -> None:
        """Counts of words, which are inserted in order, so that each begins where it leaves the one before."""
        before, path, best, tokens = "", [0], [0.0], [0]
        child, all_best, all_tokens, counts, step = self.child, self.best, self.tokens, self.counts, self._step
        nodes, characters = len(all_best), 0
        for word in sorted(words):
            if len(word) > LONGEST_WORD:
                counts[word] = self._alone(word)
                characters += len(word)
                continue
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del path[shared + 1 :], best[shared + 1 :], tokens[shared + 1 :]
            at = path[-1]
            for end in range(shared + 1, len(word) + 1):
                key = at << 21 | ord(word[end - 1])
                at = child.get(key)
                if at is None:
                    score, n = step(word, end, best, tokens)
                    at = child[key] = len(all_best)
                    all_best.append(score)
                    all_tokens.append(n)
                else:
                    score, n = all_best[at], all_tokens[at]
                path.append(at)
                best.append(score)
                tokens.append(n)
            counts[word], before = tokens[-1], word
            characters += len(word)
        self.held += (len(all_best) - nodes) * NODE_BYTES + len(words) * WORD_BYTES + 4 * characters

    def _alone(self, word: str) -> int:
        best, tokens = [0.0], [0]
        for end in range(1, len(word) + 1):
            score, n = self._step(word, end, best, tokens)
            best.append(score)
            tokens.append(n)
        return tokens[-1]

    def count(self, texts: list[list[str]]) -> list[int]:
        """Tokens of each list of pre-tokens. A full cache starts afresh before new words come in."""
        words = set().union(*texts)
        fresh = words - self.counts.keys()
        if fresh and self.held > self.cache_bytes:
            self.clear()
            fresh = words
        self.add(fresh)
        return [sum(map(self.counts.__getitem__, t)) for t in texts]


def trie_counts(words: Iterable[str], model: Unigram) -> dict[str, int]:
    """Token count of each distinct word."""
    trie = SharedTrie(model)
    trie.add(set(words))
    return trie.counts


def pre_tokens(text: str | None) -> list[str]:
    """Of a text with the blank that is put before it; none of a null or empty text."""
    return _PRE_TOKEN.findall((" " + text).replace(" ", BLANK)) if text else []


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str = DEFAULT_MODEL, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """(id, n_pre_tokens, n_tokens), a row for each row; null and empty texts have none. No shuffle.

    The order of texts and the size of the cache change only what is computed again, never a count.
    """
    model = load_unigram(model_file)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = SharedTrie(model, cache_bytes)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                texts = [pre_tokens(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict({"id": batch.column(0), "n_pre_tokens": pa.array([len(t) for t in texts], pa.int64()), "n_tokens": pa.array(trie.count(texts), pa.int64())})

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "id long, n_pre_tokens long, n_tokens long")
