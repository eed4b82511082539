"""Token counts by greedy longest match, with one step a character: a trie with failure links and popped-token counts."""

from __future__ import annotations

from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from scourframe.llm import common

#: White space of Python's split() that the columnar split may see otherwise: such texts are split in Python.
SEPARATORS = "\x1c\x1d\x1e\x1f"
START, NONE = 0, -1


class Automaton:
    """The pieces that begin a word and those that continue one, as a trie in which a failed step knows where to go on.

    A node stands for what was read since the last piece that is certain. Where no edge fits, the failure link leads to the node of
    what is left after popping the longest pieces, and `pops` says how many pieces that are; NONE means that the word has no split.
    """

    def __init__(self, first: list[str], following: list[str]):
        self.edges: list[dict[str, int]] = [{}, {}]
        self.rest = 1
        piece = {node for node in (self.insert(START, x) for x in first if x)} | {node for node in (self.insert(self.rest, x) for x in following if x)}
        self.fail, self.pops = [NONE] * len(self.edges), [0] * len(self.edges)
        waiting = deque([START, self.rest])
        while waiting:
            parent = waiting.popleft()
            for char, node in self.edges[parent].items():
                waiting.append(node)
                if node in piece:
                    self.fail[node], self.pops[node] = self.rest, 1
                    continue
                at, popped = self.fail[parent], self.pops[parent]
                while at != NONE and char not in self.edges[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at != NONE:
                    self.fail[node], self.pops[node] = self.edges[at][char], popped

    def insert(self, node: int, piece: str) -> int:
        for char in piece:
            following = self.edges[node].get(char)
            if following is None:
                following = self.edges[node][char] = len(self.edges)
                self.edges.append({})
            node = following
        return node

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if it can't be split into pieces."""
        edges, fail, pops = self.edges, self.fail, self.pops
        node, found = START, 0
        for char in word:
            following = edges[node].get(char)
            while following is None:
                found += pops[node]
                node = fail[node]
                if node == NONE:
                    return 0
                following = edges[node].get(char)
            node = following
        while node != self.rest:
            found += pops[node]
            node = fail[node]
            if node == NONE:
                return 0
        return found


@lru_cache(maxsize=2)
def automaton(first: tuple[str, ...], following: tuple[str, ...]) -> Automaton:
    return Automaton(list(first), list(following))


def sentencepiece_vocabulary(path: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The ordinary pieces of a model file: those that begin with the mark of a word begin words, the others continue them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    mark = "▁"
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return tuple(x[1:] for x in pieces if x.startswith(mark) and len(x) > 1), tuple(x for x in pieces if not x.startswith(mark))


def token_counts(docs: DataFrame, first: tuple[str, ...], following: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How many word pieces each whole text has: id_col, `n_words`, `n_tokens`, `n_unknown`, a row for each row of `docs`.

    Words are what white space parts. A word is cut into the longest piece of `first` that begins it, then the longest pieces of
    `following`, and so on; a word for which this fails counts as one token and as one unknown word. Each task counts the
    distinct words of a block once, in time proportional to their characters, also in words of any length; no data is exchanged.

    Null and empty texts count zero. Null ids and repeated rows are rows like any other. An empty table gives no rows.
    """
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def count(batches):
        machine = automaton(first, following)
        for batch in batches:
            totals = []
            for _, block in common.blocks([x or "" for x in batch.column(1).to_pylist()]):
                words = pc.utf8_split_whitespace(pa.array([" ".join(x.split()) if any(c in x for c in SEPARATORS) else x for x in block], pa.large_string()))
                coded = words.flatten().dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                each = np.fromiter((machine.count(w) if w else -1 for w in distinct), np.int64, len(distinct))
                table = np.stack([each >= 0, np.where(each > 0, each, each == 0), each == 0], axis=1).astype(np.int64)
                ends = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(table[coded.indices.to_numpy()], axis=0)])
                totals.append(np.diff(ends[words.offsets.to_numpy()], axis=0))
            sums = np.concatenate(totals) if totals else np.zeros((0, 3), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(sums[:, i])) for i in range(3))], [id_col, "n_words", "n_tokens", "n_unknown"])

    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_words long, n_tokens long, n_unknown long")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """All documents by the pieces of a public model."""
    import public_tokenizers

    return token_counts(common.table(spark, sf_dir, "documents"), *sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
