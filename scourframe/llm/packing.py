"""Best-fit packing of tokenized documents into fixed-length sequences, by large-item matching."""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scourframe.llm import common

#: Entries of a generation of the tables of a Python worker, which keep two: those in use, and those that were in use before.
CACHED_WORDS = 200_000
#: White space to Python that is none to the tokenizer.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Rules of a vocabulary under which words of printable ASCII and of the letters of Latin-1 are split by PIECE after lower-casing, and
#: their bytes stand for themselves, or for the characters that BYTES has for them.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
#: A piece, or the space between two words.
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^ a-z0-9\u00df-\u00f6\u00f8-\u00ff]+| ")
PLAIN_WORD = "^[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
#: Bytes that are no printable character of Latin-1 have the characters from 256 on, in their order.
UNSEEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
BYTES = {c: "".join(chr(256 + UNSEEN.index(b)) if b in UNSEEN else chr(b) for b in chr(c).encode()) for c in range(0xDF, 0x100)}


class Runs:
    """Runs of ids, one after another."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        self.ids, self.lengths, self.starts = ids, counts, np.cumsum(counts) - counts

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the runs of these numbers, one after another, and how many each has."""
        counts = self.lengths[at]
        ends = np.cumsum(counts)
        return self.ids[np.repeat(self.starts[at] - (ends - counts), counts) + np.arange(ends[-1] if len(at) else 0)], counts


class Words(Runs):
    """Strings numbered as they come, with runs of ids."""

    def __init__(self):
        self.number = common.Numbers()
        self.starts, self.lengths, self.ids, self.filled = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def put(self, at: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """The runs of the strings of these numbers."""
        while len(self.number) > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.filled: self.filled + len(ids)] = ids
        self.lengths[at] = counts
        self.starts[at] = self.filled + np.cumsum(counts) - counts
        self.filled += len(ids)


class Generations:
    """Runs of ids of strings, in two generations: what is met moves to the younger one, and when that is full it becomes the elder one, so that
    only strings that were not met for a whole generation are forgotten and learned again. learn: strings to their ids, one after another, and how many each has."""

    def __init__(self, learn):
        self.learn, self.young, self.elder = learn, Words(), Words()

    def numbers(self, strings: list[str]) -> np.ndarray:
        """Numbers of the strings in the younger generation, which then has their ids."""
        if len(self.young.number) > CACHED_WORDS:
            self.young, self.elder = Words(), self.young
        n = len(self.young.number)
        at = np.fromiter(map(self.young.number.__getitem__, strings), np.int64, len(strings))
        new = list(islice(self.young.number, n, None))
        before = np.fromiter((self.elder.number.get(w, -1) for w in new), np.int64, len(new))
        known, unknown = np.flatnonzero(before >= 0), np.flatnonzero(before < 0)
        if len(known):
            self.young.put(n + known, *self.elder.of(before[known]))
        if len(unknown):
            self.young.put(n + unknown, *self.learn([new[i] for i in unknown.tolist()]))
        return at


class WordIds:
    """Ids of texts by a tokenizer that drops white space: each distinct word of a block of texts is split once. Words under plain rules are split into
    pieces by one pattern, and a worker keeps the ids of pieces; other words are normalised and split by the tokenizer, and it keeps the ids of words. Texts that
    hold an added token of the vocabulary are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: What a text that is encoded whole holds, as it stands or in lower case.
        self.whole, self.lower = [*SEPARATORS, *(token.content for token in added)], [token.content.lower() for token in added if token.normalized]
        self.pieces, self.words = Generations(self.learn_pieces), Generations(self.learn_words)
        rules = json.loads(Path(path).read_text(encoding="utf-8"))
        self.plain = (rules["normalizer"] or {}).get("normalizers") == NORMAL and (rules["pre_tokenizer"] or {}).get("pretokenizers") == SPLIT

    def learn_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokenize = self.tokenizer.model.tokenize
        own = [[token.id for token in tokenize(piece if piece.isascii() else piece.translate(BYTES))] if piece != " " else [] for piece in pieces]
        return np.fromiter(chain.from_iterable(own), np.int32), np.fromiter(map(len, own), np.int64, len(own))

    def learn_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces: dict[str, list[int]] = {}
        ids, counts = [], []
        for at in range(0, len(words), 2000):
            block = words[at: at + 2000]
            text = self.tokenizer.normalizer.normalize_str(" ".join(block))
            spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
            if len(spaces) != len(block) - 1:
                own = [self.tokenizer.encode(word, add_special_tokens=False).ids for word in block]
                of = range(len(block))
            else:
                found = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
                names = [piece for piece, _ in found]
                for piece in set(names).difference(pieces):
                    pieces[piece] = [token.id for token in self.tokenizer.model.tokenize(piece)]
                own = [pieces[name] for name in names]
                of = np.searchsorted(spaces, np.array([span[0] for _, span in found], np.int64))
            ids.append(np.fromiter(chain.from_iterable(own), np.int32))
            counts.append(np.bincount(of, weights=np.fromiter(map(len, own), float, len(own)), minlength=len(block)).astype(np.int64))
        return np.concatenate(ids), np.concatenate(counts)

    def learn_ascii(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of ASCII and of the letters of Latin-1, one after another, and how many each has."""
        at = self.pieces.numbers(PIECE.findall(" ".join(words).lower()))
        ids, counts = self.pieces.young.of(at)
        between = at == self.pieces.young.number[" "] if len(words) > 1 else np.zeros(len(at), bool)
        return ids, np.bincount(np.cumsum(between), weights=counts, minlength=len(words)).astype(np.int64)

    def of_other(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of any kind."""
        at = self.words.numbers(words)
        return self.words.young.of(at)

    def learned(self, words: pa.Array) -> Runs:
        """The ids of distinct words, numbered as they stand."""
        plain = pc.match_substring_regex(words, PLAIN_WORD).to_numpy(zero_copy_only=False) if self.plain else np.zeros(len(words), bool)
        place, ids, counts = np.empty(len(words), np.int64), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        kinds = np.flatnonzero(plain), np.flatnonzero(~plain)
        place[np.concatenate(kinds)] = np.arange(len(words))
        for own, ids_of in zip(kinds, (self.learn_ascii, self.of_other)):
            if len(own):
                for parts, part in zip((ids, counts), ids_of(words.take(pa.array(own)).to_numpy(zero_copy_only=False).tolist())):
                    parts.append(part)
        runs = Runs(np.concatenate(ids), np.concatenate(counts))
        runs.starts, runs.lengths = runs.starts[place], runs.lengths[place]
        return runs

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        odd = {i for i, text in enumerate(texts) if any(c in text for c in self.whole) or self.lower and any(c in text.lower() for c in self.lower)}
        words = pc.utf8_split_whitespace(pa.array([None if i in odd else text for i, text in enumerate(texts)], pa.large_string()))
        coded = words.flatten().dictionary_encode()
        known, at = self.learned(coded.dictionary), coded.indices.to_numpy()
        sizes = np.diff(words.offsets.to_numpy())
        begin = 0
        for i, size in enumerate(sizes):
            if i in odd:
                yield np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.int32)
                continue
            own, begin = at[begin: begin + size], begin + size
            yield known.of(own)[0]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each whole text, append `end_id`, and cut what is longer than `capacity` into pieces.

    Returns id_col, `piece` (from 0), `start` (ids of the document before it), `length`, `ids_crc32` and, if asked for, `ids`.
    A null or empty text has the end id alone. Other columns are not read.
    """
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def encode(batches):
        vocabulary = word_ids(tokenizer)
        for batch in batches:
            names, texts = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
            for at, block in common.blocks(texts, 2_000_000):
                rows = []
                for i, ids in enumerate(vocabulary.encode(block), at):
                    ids = np.append(ids, end_id).astype(np.int32)
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start: start + capacity]
                        rows.append((i, piece, start, len(part), common.crc32_of(part), part if with_ids else None))
                of, piece, start, length, crc, parts = zip(*rows)
                columns = [names.take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                columns += [pa.array(parts, pa.list_(pa.int32()))] * with_ids
                yield pa.RecordBatch.from_arrays(columns, [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(id_col, text_col).mapInArrow(encode, schema)


class Plan:
    """Where the pieces of each length go: runs of (first rank, sequence of the first, pieces a sequence, offset)."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.runs: dict[int, list[tuple[int, int, int, int]]] = {}
        self.used: dict[int, int] = {}
        self.gaps: list[int] = []
        self.open: dict[int, list[tuple[int, int]]] = {}
        left = {length: n for length, n in histogram.items() if n}
        if any(not 1 <= length <= capacity for length in left):
            raise ValueError(f"lengths must be 1 to {capacity}")
        self.match_large({x: n for x, n in left.items() if 3 * x > capacity})
        for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
            self.best_fit(length, left[length])

    def put(self, length: int, count: int, first: int, each: int, offset: int) -> None:
        self.runs.setdefault(length, []).append((self.used.get(length, 0), first, each, offset))
        self.used[length] = self.used.get(length, 0) + count

    def leave(self, gap: int, first: int, count: int) -> None:
        """Sequences first .. first + count - 1 have `gap` places free."""
        if gap and count:
            if gap not in self.open:
                bisect.insort(self.gaps, gap)
            self.open.setdefault(gap, []).append((first, count))

    def take(self, at: int) -> tuple[int, int, int]:
        gap = self.gaps[at]
        first, count = self.open[gap].pop()
        if not self.open[gap]:
            del self.open[gap], self.gaps[at]
        return gap, first, count

    def match_large(self, left: dict[int, int]) -> None:
        """Largest first, each with the largest partner that fits: at most two of these fit into a sequence."""
        order = sorted(left)
        while order:
            a = order[-1]
            fits = bisect.bisect_right(order, self.capacity - a) - 1
            b = order[fits] if fits >= 0 else None
            n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            if b == a and not n:  # a single one: its partner is the next smaller
                b = order[fits - 1] if fits else None
                n = 1
            first = self.sequences
            self.sequences += n
            self.put(a, n, first, 1, 0)
            left[a] -= n
            if b is not None:
                self.put(b, n, first, 1, a)
                left[b] -= n
            self.leave(self.capacity - a - (b or 0), first, n)
            order = [x for x in order if left[x]]

    def best_fit(self, length: int, n: int) -> None:
        """All pieces of a length at once: the tightest gaps first, each gap as often as it holds the length."""
        while n:
            at = bisect.bisect_left(self.gaps, length)
            if at < len(self.gaps):
                gap, first, count = self.take(at)
            else:
                gap, first = self.capacity, self.sequences
                count = -(-n // (gap // length))
                self.sequences += count
            each = gap // length
            whole = min(count, n // each)
            if whole:
                self.put(length, whole * each, first, each, self.capacity - gap)
                self.leave(gap - each * length, first, whole)
                n -= whole * each
            if n and whole < count:
                self.put(length, n, first + whole, n, self.capacity - gap)
                self.leave(gap - n * length, first + whole, 1)
                whole, n = whole + 1, 0
            self.leave(gap, first + whole, count - whole)


def pack(pieces: DataFrame, capacity: int = 2048, length_col: str = "length", order: list[str] | None = None) -> DataFrame:
    """Place pieces into sequences of at most `capacity`, adding `sequence_id` and `offset`.

    Pieces above a third of the capacity are matched greedily, two to a sequence at most; shorter ones go to the tightest gaps,
    longest first. Pieces of equal length are interchangeable, so the driver needs their counts only: `capacity` numbers at most,
    whatever the input, from which follow runs of ranks; a piece finds its place by its rank among the pieces of its length.
    Every length must lie between 1 and the capacity (else an error). An empty table gives no rows.
    """
    ranked = common.numbered(pieces, length_col, order or [length_col], "_nth")
    ranked = common.settled(ranked, "packing-ranks")
    counts = {row[0]: row[1] for row in ranked.groupBy(length_col).count().collect()}
    if None in counts:
        raise ValueError("a piece has no length")
    runs = {x: tuple(np.array(part, np.int64) for part in zip(*own)) for x, own in Plan(counts, capacity).runs.items()}

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for x, own in rank.groupby(length.to_numpy(), sort=False):
            begin, first, each, base = runs[x]
            at = own.index.to_numpy()
            of = np.searchsorted(begin, own.to_numpy(), side="right") - 1
            k = own.to_numpy() - begin[of]
            sequence[at], offset[at] = first[of] + k // each[of], base[of] + k % each[of] * x
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return ranked.withColumn("_place", place(length_col, "_nth")).select(*pieces.columns, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Encode, cut and pack `docs` (doc_id, text); see `token_pieces` and `pack`."""
    return pack(token_pieces(docs, tokenizer, capacity), capacity, order=["doc_id", "piece"])


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Contract: all documents in sequences of at most 2048 ids of the word tokenizer."""
    import public_tokenizers

    return pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)
