"""Token counts of a unigram tokenizer, by dynamic programming over a trie of the texts' distinct pre-tokens.

A pre-token is a run of anything but `[\\x09-\\x0D\\x20]`, behind the word mark of the vocabulary. The score of a
split is the sum of its pieces' log-probabilities; the best split counts, of equals the one with fewer
tokens. The best score of a prefix is the same in all pre-tokens that share it, so it is computed once, at
the prefix's trie node.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.blocks import Block, blocks, mix, prefix_hashes, runs, span_hashes
from tickloom.llm.frames import map_texts

MARK = "▁"
BLOCK_BYTES = 4 << 20
#: A worker's trie is begun anew beyond this many nodes; counts do not depend on it.
MAX_NODES = 800_000
#: Pre-tokens whose scores are remembered.
MAX_KNOWN = 1_000_000
#: Characters beyond which a pre-token gets no nodes.
LONG = 4096

IS_INK = np.ones(256, dtype=bool)
IS_INK[[9, 10, 11, 12, 13, 32]] = False


def load_pieces(path: str) -> dict[str, float]:
    """Log-probabilities of a sentencepiece vocabulary's pieces by Zipf's law over their ranks.

    The n-th piece has a probability in proportion to 1 / (n + 10). Control and byte pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [
        i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    total = sum(1 / (n + 10) for n in range(len(ids)))
    return {model.id_to_piece(i): -math.log((n + 10) * total) for n, i in enumerate(ids)}


_NO_PIECE = object()


class ForwardTrie:
    """Prefixes of the pre-tokens seen, each with its best score and the number of tokens of that split.

    A character that is no piece becomes one token per UTF-8 byte, each at `byte_score`.
    """

    def __init__(self, pieces: dict[str, float], byte_score: float | None = None) -> None:
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        # What pieces end in: the score of a piece, `_NO_PIECE` for what is only the end of one.
        self.tails: dict[str, object] = {p[k:]: _NO_PIECE for p in pieces for k in range(1, len(p))}
        self.tails.update(pieces)
        self.byte_score = min(pieces.values(), default=0.0) - 2.0 if byte_score is None else byte_score
        #: Score and number of tokens of pre-tokens, by their hash; they outlive the nodes.
        self.known: dict[int, tuple[float, int]] = {}
        self.clear()

    def clear(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.scores = [0.0]
        self.counts = [0]

    def add(self, token: str) -> tuple[float, int]:
        """Best score and number of tokens of a pre-token."""
        if len(token) > LONG:
            return self._long(token)
        node, path = 0, [0]
        for end, char in enumerate(token, 1):
            child = self.children.get((node, char))
            if child is None:
                child = self._new(token, end, path)
                self.children[node, char] = child
            node = child
            path.append(node)
        return self.scores[node], self.counts[node]

    def _long(self, token: str) -> tuple[float, int]:
        """The same without nodes: an end needs only the ends that a piece's length lies before it."""
        width = self.longest + 1
        scores, counts = [0.0] * width, [0] * width
        for end in range(1, len(token) + 1):
            path = [k % width for k in range(max(0, end - width), end)]
            found = self._best(token, end, path, scores, counts)
            scores[end % width], counts[end % width] = found
        return scores[len(token) % width], counts[len(token) % width]

    def _new(self, token: str, end: int, path: list[int]) -> int:
        best, count = self._best(token, end, path, self.scores, self.counts)
        self.scores.append(best)
        self.counts.append(count)
        return len(self.scores) - 1

    def _best(self, token: str, end: int, path: list[int], scores: list[float], counts: list[int]) -> tuple[float, int]:
        """Score and tokens of the best split up to `end`; those of the ends before it are at the places in `path`, the
        nearest last. Longer pieces are tried until what precedes `end` ends no piece."""
        tails = self.tails
        best, count, begin, back = -math.inf, 0, end, 0
        while begin > 0:
            begin -= 1
            back -= 1
            value = tails.get(token[begin:end])
            if value is None:
                break
            if value is not _NO_PIECE:
                at = path[back]
                score = scores[at] + value
                if score > best:
                    best, count = score, counts[at] + 1
                elif score == best and counts[at] + 1 < count:
                    count = counts[at] + 1
        if token[end - 1] not in self.pieces:
            at = path[-1]
            size = len(token[end - 1].encode("utf-8"))
            score, tokens = scores[at] + size * self.byte_score, counts[at] + size
            if score > best or score == best and tokens < count:
                best, count = score, tokens
        return best, count


def count_block(block: Block, trie: ForwardTrie) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens, tokens and score of each text of a block."""
    starts, ends = runs(IS_INK[block.data], block.offsets)
    sums, up = prefix_hashes(block.data)
    keys = mix(span_hashes(sums, up, starts, ends) + (ends - starts).astype(np.uint64))
    names, first, of = np.unique(keys, return_index=True, return_inverse=True)
    raw = block.data.tobytes()
    scores, counts = np.empty(len(first)), np.empty(len(first), np.int64)
    for i, (name, k) in enumerate(zip(names.tolist(), first)):
        found = trie.known.get(name)
        if found is None:
            if len(trie.scores) > MAX_NODES:
                trie.clear()
            if len(trie.known) > MAX_KNOWN:
                trie.known.clear()
            found = trie.known[name] = trie.add(MARK + raw[starts[k] : ends[k]].decode("utf-8"))
        scores[i], counts[i] = found
    text = np.searchsorted(block.offsets, starts, side="right") - 1
    n = len(block.offsets) - 1
    return (
        np.bincount(text, minlength=n),
        np.bincount(text, weights=counts[of], minlength=n).astype(np.int64),
        np.bincount(text, weights=scores[of], minlength=n),
    )


@lru_cache(maxsize=1)
def _trie(shared) -> ForwardTrie:
    return ForwardTrie(shared.value)


def count_tokens(
    docs: DataFrame, pieces: dict[str, float], text_col: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """`row`, n_pretokens, n_tokens and score (the best split's log-probability) of every text.

    Null and blank texts have no tokens and score 0. Every row is counted for itself. No rows give no rows.

    The vocabulary, whose size does not depend on the data, is broadcast. A task inserts the distinct
    pre-tokens of a few MB of text at a time into its trie, so there is no shuffle and memory is bounded: a pre-token of
    more than `LONG` characters is scored without nodes, one seen before is looked up by its hash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def function(texts: pa.Array) -> dict[str, pa.Array]:
        trie = _trie(shared)
        parts = [count_block(block, trie) for block in blocks(texts, BLOCK_BYTES)]
        columns = [np.concatenate(x) for x in zip(*parts)] or [np.zeros(0)] * 3
        return {
            "n_pretokens": pa.array(columns[0], pa.int64()),
            "n_tokens": pa.array(columns[1], pa.int64()),
            "score": pa.array(columns[2], pa.float64()),
        }

    return map_texts(docs, function, "n_pretokens long, n_tokens long, score double", text_col, carry)
