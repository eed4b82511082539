"""Spelling variants: words one edit apart, found by search schemes over full-text indexes of the delimited vocabulary."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scourframe.llm import common

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
SMALL = {c: c + 32 for c in range(65, 91)}
#: A run loses one letter if this number divides its checksum.
NOISE = 31
LEAST_LENGTH, LEAST_COUNT, LEAST_RATIO = 7, 2, 10
#: Words counted before they leave a task; words that an index holds on the average, and at most for one key.
COUNTED, SHARD, HOT = 200_000, 60_000, 150_000
#: Words searched at a time.
QUERIES = 8_000
#: What an entry of a shard is, beside the lengths -1, 0 and 1 for which a word is indexed (0: indexed and asked).
ASKED, HELD = 2, 3
#: Letters as numbers from 1, the delimiter as 0.
CODE = np.zeros(256, np.uint8)
CODE[97:123] = np.arange(1, 27)
CODE[0xC0:0x100] = np.arange(27, 91)
SIGMA = 91


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): the words of at least `least` letters of whole texts, counted.

    A run of letters in small ASCII letters loses its letter h % length where h, the checksum of id and run, is divisible by 31. Equal
    runs of a text give equal words, so each is looked at once a text, and counts leave a task folded. A null id counts as an
    empty one; a null text has no words.
    """
    def count(batches):
        held: Counter = Counter()

        def flushed():
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                if not text:
                    continue
                head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in Counter([w for w in LETTERS.findall(text) if len(w) >= least]).items():
                    word = run.lower() if run.isascii() else run.translate(SMALL)
                    h = zlib.crc32(word.encode(), head)
                    if h % NOISE == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least:
                            continue
                    held[word] += n
                if len(held) >= COUNTED:
                    yield flushed()
        if held:
            yield flushed()

    return docs.select(id_col, text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def suffixes(codes: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array of delimited words; suffixes that are equal up to their delimiter stand in the order of their words.

    Windows of nine letters are compared first, then twice as many in each round, for those that are still equal.
    """
    n, window = len(codes), 9
    padded = np.concatenate([codes, np.zeros(window, np.uint8)]).astype(np.int64)
    left = ends[owner] - np.arange(n)  # letters before the delimiter
    key = np.zeros(n, np.int64)
    for i in range(window):
        key = key << 7 | np.where(left > i, padded[i: i + n], 0)
    order = np.lexsort((owner, key))
    new = np.ones(n, bool)
    new[1:] = (key[order[1:]] != key[order[:-1]]) | (left[order[1:]] < window)
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new)
    while not new.all():
        # a suffix that is still equal to another reaches further than the window, so that the rank behind it exists
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        rows = order[at]
        group, behind = rank[rows], rank[np.minimum(rows + window, n - 1)]
        within = np.lexsort((behind, group))
        order[at] = rows[within]
        group, behind = group[within], behind[within]
        apart = np.ones(len(at), bool)
        apart[1:] = (group[1:] != group[:-1]) | (behind[1:] != behind[:-1])
        new[at] = apart
        rank[order] = np.cumsum(new)
        window *= 2
    return order


class Index:
    """Full-text index of delimited words that is searched by putting letters before a pattern.

    An interval [low, high) of suffix ranks stands for all places of a pattern; the place of a letter in the sorted suffixes is the
    number of smaller letters plus its number before a rank, which bit vectors with counts every 64 ranks give.
    """

    def __init__(self, words: list[bytes]):
        text = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        codes = CODE[text]
        self.ends = np.flatnonzero(codes == 0)
        owner = np.repeat(np.arange(len(words)), np.diff(self.ends, prepend=-1))
        order = suffixes(codes, owner, self.ends)
        self.size = len(codes)
        before = codes[order - 1]  # the delimiter before the first letter of a word
        self.before, self.owner = before, owner[order]
        self.starts = np.flatnonzero(before == 0)
        self.words = self.size // 64 + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=SIGMA))])[:SIGMA]
        self.bits = np.zeros((SIGMA, self.words), np.uint64)
        self.counts = np.zeros((SIGMA, self.words), np.int64)
        padded = np.full(self.words * 64, 255, np.uint8)
        padded[: self.size] = before
        for code in np.unique(before).tolist():
            self.bits[code] = np.packbits(padded == code, bitorder="little").view(np.uint64)
            each = np.bitwise_count(self.bits[code]).astype(np.int64)
            self.counts[code, 1:] = np.cumsum(each)[:-1]
        self.counts += self.first[:, None]
        self.bits, self.counts = self.bits.ravel(), self.counts.ravel()

    def stepped(self, code: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = code.astype(np.int64) * self.words + (rank >> 6)
        low = (np.uint64(1) << (rank & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[at] + np.bitwise_count(self.bits[at] & low)

    def extended(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.stepped(code, low), self.stepped(code, high)

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every letter that stands before some place of each interval: number of the interval, and letter."""
        width = high - low
        at = np.repeat(np.arange(len(low)), width)
        place = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(low, width)
        pairs = np.unique(at * SIGMA + self.before[place])
        pairs = pairs[pairs % SIGMA > 0]
        return pairs // SIGMA, pairs % SIGMA


def one_apart(index: Index, asked: list[bytes], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asked word, word of the index), as their numbers, exactly one edit apart whose last `exact` letters agree.

    `exact` says for each asked word how many letters from its end are matched before an error is allowed. Letters are put before
    the pattern, from a delimiter on. An edit in a run of equal letters has one place, the farthest one, so that no pair is met twice.
    """
    codes = CODE[np.frombuffer(b"\0".join(asked) + b"\0", np.uint8)]
    ends = np.flatnonzero(codes == 0)
    length = np.diff(ends, prepend=-1) - 1

    def letter(of: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The letter of asked word `of` at place `at` from its end; the delimiter where the word is over."""
        inside = at < length[of]
        return np.where(inside, codes[np.where(inside, ends[of] - 1 - at, 0)], 0)

    # exact part, and the whole word behind it: one interval for each place from `exact` to the length
    low, high = np.zeros(len(asked), np.int64), np.full(len(asked), len(index.ends), np.int64)
    states, live = [], np.arange(len(asked))
    for at in range(int(length.max()) + 1):
        ready = live[exact[live] <= at]
        states.append((ready, np.full(len(ready), at), low[ready], high[ready]))
        live = live[(length[live] > at) & (low[live] < high[live])]
        low[live], high[live] = index.extended(letter(live, np.full(len(live), at)), low[live], high[live])
    of, at, low, high = (np.concatenate(parts) for parts in zip(*states))
    own, following = letter(of, at), letter(of, at + 1)

    keys, back = np.unique(low * (index.size + 1) + high, return_inverse=True)
    parent, code = index.children(keys // (index.size + 1), keys % (index.size + 1))
    begin = np.searchsorted(parent, np.arange(len(keys) + 1))
    child_low, child_high = index.extended(code, (keys // (index.size + 1))[parent], (keys % (index.size + 1))[parent])
    many = (begin[1:] - begin[:-1])[back]
    state = np.repeat(np.arange(len(of)), many)
    child = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[back], many)
    other = code[child] != own[state]
    state, child = state[other], child[other]
    replaced = own[state] > 0
    gone = (own > 0) & (own != following)
    of, at, low, high = (
        np.concatenate([of[state[replaced]], of[state], of[gone]]), np.concatenate([at[state[replaced]] + 1, at[state], at[gone] + 1]),
        np.concatenate([child_low[child[replaced]], child_low[child], low[gone]]), np.concatenate([child_high[child[replaced]], child_high[child], high[gone]]))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while len(of):
        over = at == length[of]
        start, stop = index.stepped(np.zeros(over.sum(), np.uint8), low[over]), index.stepped(np.zeros(over.sum(), np.uint8), high[over])
        whole = start < stop  # words are distinct: one at most
        found.append((of[over][whole], index.owner[index.starts[start[whole]]]))
        of, at, low, high = of[~over], at[~over], low[~over], high[~over]
        low, high = index.extended(letter(of, at), low, high)
        stay = low < high
        of, at, low, high = of[stay], at[stay] + 1, low[stay], high[stay]
    return tuple(np.concatenate(parts) for parts in zip(*found))


def best_near(words: list[str], n: list[int], delta: list[int], backward: bool):
    """(word, n_near, best_n, best) for the asked words of one shard: near words of the shard that are indexed for the word's length.

    `backward` shards match the second half of a word exactly and extend over the first, the others the first half, on reversed words.
    Pairs that agree in the first half belong to the latter and are left out of the former.
    """
    distinct = sorted({w for w, d in zip(words, delta) if d != ASKED})
    number = {w: i for i, w in enumerate(distinct)}
    counts, indexed = np.zeros(len(distinct), np.int64), np.zeros((len(distinct), 3), bool)
    asked = sorted({w for w, d in zip(words, delta) if d in (0, ASKED)})
    for w, k, d in zip(words, n, delta):
        if d != ASKED:
            counts[number[w]] = k
            indexed[number[w], 1 if d == HELD else d + 1] = True
    if not distinct or not asked:
        return
    turn = 1 if backward else -1
    index = Index([w.encode("latin-1")[::turn] for w in distinct])
    length = np.array([len(w) for w in distinct])
    for at in range(0, len(asked), QUERIES):
        part = asked[at: at + QUERIES]
        half = np.array([len(w) // 2 for w in part])
        own = np.array([len(w) for w in part])
        query, near = one_apart(index, [w.encode("latin-1")[::turn] for w in part], own - half if backward else half)
        keep = indexed[near, own[query] - length[near] + 1]
        query, near = query[keep], near[keep]
        if backward:
            keep = np.array([part[q][: half[q]] != distinct[v][: half[q]] for q, v in zip(query.tolist(), near.tolist())], bool)
            query, near = query[keep], near[keep]
        order = np.lexsort((near, -counts[near], query))
        query, near = query[order], near[order]
        found, first, many = np.unique(query, return_index=True, return_counts=True)
        if len(found):
            top = near[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part[q] for q in found]), pa.array(many, pa.int64()), pa.array(counts[top], pa.int64()), pa.array([distinct[v] for v in top])],
                ["word", "n_near", "best_n", "best"])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): for each word with words one edit apart, their number, and the most frequent of them (ties to the
    smallest). `vocabulary` holds distinct words (word, n) of LEAST_LENGTH letters or more.

    One half of a word is free of the error. A word of L letters looks for words that share its first half, in a shard of that half and
    L, and for words that share its second half alike; a word can be found from L of its own length, one less and one more, and is
    indexed in three shards of each kind. Many halves share a shard. A half that too many words share is dealt to blocks, each
    block of asked words with each block of the index, so that no shard outgrows a task. Only counts and the best word leave a shard.
    """
    words = vocabulary.select("word", "n", F.length("word").alias("m"))
    entries = []
    for d in (-1, 0, 1):
        size = F.col("m") + d
        half = F.floor(size / 2).cast("int")
        first, second = F.substring("word", F.lit(1), half), F.expr(f"right(word, m + {d} - int(floor((m + {d}) / 2)))")
        for backward, part in ((False, first), (True, second)):
            entries.append(F.struct(F.lit(d).alias("delta"), F.lit(backward).alias("backward"), F.xxhash64(F.lit(backward), size, part).alias("half")))
    rows = words.select("word", "n", "m", F.explode(F.array(*entries)).alias("e")).select("word", "n", "m", "e.*")
    rows = rows.filter(F.col("m") + F.col("delta") >= LEAST_LENGTH)
    hot = rows.groupBy("half").agg(F.count("*").alias("size")).filter(F.col("size") > HOT)
    hot = common.settled(hot.select("half", F.ceil(F.col("size") / HOT).cast("int").alias("parts")), "hot-halves")
    shards = 2 * max(1, -(-vocabulary.count() * 3 // (2 * SHARD)))
    kind = F.col("backward").cast("string")
    calm = rows.join(hot, "half", "left_anti") if not hot.isEmpty() else rows
    dealt = calm.select(F.concat_ws("-", kind, F.pmod("half", F.lit(shards // 2))).alias("shard"), "word", "n", "delta", "backward")
    if not hot.isEmpty():
        warm = rows.join(hot, "half").withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cell = [F.concat_ws("-", kind, "half", *pair).alias("shard") for pair in (("own", "other"), ("other", "own"))]
        # in a block an entry is indexed only (delta -1 or 1), or split into an indexed (HELD) and an asked (ASKED) one
        held = warm.select(cell[0], "word", "n", "delta", "backward")
        dealt = dealt.unionByName(held.withColumn("delta", F.when(F.col("delta") == 0, HELD).otherwise(F.col("delta")))).unionByName(
            warm.filter("delta = 0").select(cell[1], "word", "n", F.lit(ASKED).alias("delta"), "backward"))

    def search(batches):
        for table in common.runs(batches):
            backward = table.column("backward")[0].as_py()
            yield from best_near(table.column("word").to_pylist(), table.column("n").to_pylist(), table.column("delta").to_pylist(), backward)

    found = dealt.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("top")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form) without cycles: the last form that is reached, by doubling."""
    current = common.settled(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = current.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        following = common.settled(joined, "roots")
        common.dropped(current)
        if following.filter("moved").isEmpty():
            return following.select("word", "root")
        current = following.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_count: int = LEAST_COUNT, ratio: int = LEAST_RATIO) -> DataFrame:
    """Words grouped with the spelling that they are a variant of.

    Returns word, form, root, n, n_near, form_n, a row for each word of at least LEAST_LENGTH letters and `least_count` occurrences: `form`
    is the most frequent word exactly one inserted, deleted or replaced letter away (ties to the smallest in code-point order), if it occurs at
    least `ratio` times as often, else null; `root` is reached by following forms (the word itself without one); `n_near` counts all
    words one letter away. Forms grow in frequency, so that they never run in a circle.

    Null and empty texts have no words; a null id counts as an empty one in the noise that `counted_words` describes; repeated rows count
    each; a text of any length is read whole, and a word may be of any length. An empty table gives no rows. Other columns are not read.
    """
    vocabulary = common.settled(counted_words(docs, id_col, text_col).filter(F.col("n") >= least_count), "vocabulary")
    near = near_words(vocabulary)
    formed = F.col("best_n") >= ratio * F.col("n")
    joined = vocabulary.join(near, "word", "left").select(
        "word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(formed, F.col("best_n")).alias("form_n"))
    joined = common.settled(joined, "forms")
    last = roots(joined.filter("form is not null"))
    return joined.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Contract: all documents, words of seven letters and two occurrences, forms ten times as frequent."""
    return spelling_variants(common.table(spark, sf_dir, "documents"))
