"""Packing and sharding against brute force and their contracts."""

import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from scourframe.llm import packing, sharding
from tests.llm.conftest import SF, TEXTS

WORDS = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids + [0]


def test_added_tokens_in_texts():
    texts = ["one <|endoftext|> two", "<|startoftext|>", "x<|endoftext|>y", "ONE <|EndOfText|> TWO", "one < | endoftext | > two", "plain"]
    assert [list(ids) + [0] for ids in packing.WordIds(WORDS).encode(texts)] == [ids_of(t) for t in texts]


def gapless(rows, group, place, size=None):
    by = defaultdict(list)
    for row in rows:
        by[row[group]].append((row[place], 1 if size is None else row[size]))
    for own in by.values():
        at = 0
        for begin, length in sorted(own):
            assert begin == at
            at += length
    return by


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_fits_and_is_tight(histogram):
    plan = packing.Plan(histogram, 64)
    bins, large = defaultdict(list), defaultdict(int)
    for length, runs in plan.runs.items():
        ends = [run[0] for run in runs[1:]] + [histogram[length]]
        for (begin, first, each, offset), end in zip(runs, ends):
            for rank in range(begin, end):
                k = rank - begin
                bins[first + k // each].append((offset + k % each * length, length))
                large[first + k // each] += 3 * length > 64
    assert sum(map(len, bins.values())) == sum(histogram.values())
    assert len(bins) == plan.sequences and max(large.values(), default=0) <= 2
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(x * n for x, n in histogram.items())
    assert plan.sequences <= 2 * total / 64 + 1


def test_plan_pairs_like_an_optimal_matching():
    assert packing.Plan({40: 2, 24: 2}, 64).sequences == 2
    assert packing.Plan({33: 3}, 64).sequences == 3
    assert packing.Plan({30: 3}, 64).sequences == 2
    assert packing.Plan({8: 16}, 64).sequences == 2


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(WORDS), packing.WordIds(WORDS)
    texts = [t or "" for _, t in TEXTS] + ["Σ ΟΔΟΣ İx \x1cé\x85y  ﬁ é", " lead", "가각1²٣ it's we'll"]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing_of_odd_rows(odd, none):
    rows = packing.pack_documents(odd, WORDS, 64).collect()
    gapless(rows, "sequence_id", "offset", "length")
    by = defaultdict(list)
    for row in rows:
        by[row.doc_id].append(row)
    for name, text in ((2, None), (3, ""), (5, TEXTS[4][1]), (10, TEXTS[11][1])):
        ids = ids_of(text)
        for piece in by[name]:
            assert piece.ids_crc32 == zlib.crc32(np.array(ids[piece.start: piece.start + piece.length], "<u4").tobytes())
        assert sum(p.length for p in by[name]) == len(ids) and len(by[name]) == math.ceil(len(ids) / 64)
    assert len(by[7]) == 2 and len(by[None]) == 2
    assert packing.pack_documents(none, WORDS, 64).count() == 0


def test_op6(spark):
    rows = packing.op6_best_fit_packing(spark, SF).collect()
    bins = gapless(rows, "sequence_id", "offset", "length")
    total = sum(row.length for row in rows)
    assert all(sum(x for _, x in own) <= 2048 for own in bins.values()) and len(bins) <= math.ceil(total / 2048) + 1
    texts = {row.doc_id: row.text for row in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by = defaultdict(list)
    for row in rows:
        by[row.doc_id].append(row)
    assert set(by) == set(texts)
    for name, own in by.items():
        assert sum(row.length for row in own) == len(ids_of(texts[name]))


def test_longest_first_equals_a_plain_loop():
    items = [(str(i), (i * 37) % 101 + 1) for i in range(200)]
    loads, to = [0] * 7, {}
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        to[name] = loads.index(min(loads))
        loads[to[name]] += size
    assert sharding.longest_first(items, 7) == to


def test_sharding_of_odd_rows(odd, none):
    rows = sharding.shard_groups(odd, 3).collect()
    assert len(rows) == len(TEXTS)
    gapless(rows, "shard", "slot")
    where = defaultdict(set)
    for row in rows:
        where[row.group_key].add(row.shard)
    assert all(len(own) == 1 for own in where.values())
    assert {row["size"] for row in rows if row.doc_id in (2, 3)} == {16}
    assert sharding.shard_groups(none, 3).count() == 0


def test_op7(spark):
    rows = sharding.op7_lpt_sharding(spark, SF).collect()
    texts = {row.doc_id: row.text or "" for row in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    gapless(rows, "shard", "slot")
    where, load = defaultdict(set), [0] * 40
    for row in rows:
        data = texts[row.doc_id].encode()
        assert (row["size"], row.text_crc32) == (len(data) + 16, zlib.crc32(data))
        where[texts[row.doc_id]].add(row.shard)
        load[row.shard] += row["size"]
    largest = max(len(t.encode()) + 16 for t in texts.values())
    assert all(len(own) == 1 for own in where.values()) and max(load) - min(load) <= largest


def test_ascii_words_are_split_as_by_the_vocabulary(monkeypatch):
    """The pattern is used, gives the ids of the library, and only for vocabularies of its rules."""
    from tokenizers import Tokenizer

    library, own, split = Tokenizer.from_file(WORDS), packing.WordIds(WORDS), []
    learn = own.learn_ascii
    monkeypatch.setattr(own, "learn_ascii", lambda words: split.extend(words) or learn(words))
    texts = ["it's we'LL I'd 're 'S'T''m x'srest a'b'c 12a3 $$'s", "A\x00B \x01 ~~! \x7f Ab", "", "''", "İ I'S KK ſ's été", "don't_stop_123 a1b2'll", "one"]
    assert [list(ids) for ids in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert "x'srest" in split and "ſ's" not in split and "A\x00B" not in split
    own = packing.WordIds(WORDS)
    own.plain = False
    assert [list(ids) for ids in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_are_encoded_once_for_all_blocks(monkeypatch):
    """Also when generations change, and in words of Latin-1 letters with any other character beside them."""
    from tokenizers import Tokenizer

    library, own, asked = Tokenizer.from_file(WORDS), packing.WordIds(WORDS), []
    learn = own.pieces.learn
    monkeypatch.setattr(own.pieces, "learn", lambda pieces: asked.extend(pieces) or learn(pieces))
    latin = "".join(map(chr, range(0x21, 0x180)))
    draw = np.random.default_rng(5)
    mixed = ["".join(draw.choice(list(latin + "   ''aéÜ"), 60)) for _ in range(300)]
    blocks = [["Été, l'ÉTÉ ÿÞßÆ!", "naïve"], ["été ÷ × ª l'été", "", "NAÏVE naïve"], mixed, [latin, " ".join(latin)], ["naïve"], mixed[:20]]
    want = [[library.encode(t, add_special_tokens=False).ids for t in block] for block in blocks]
    assert [[ids.tolist() for ids in own.encode(block)] for block in blocks] == want
    assert len(asked) == len(set(asked)) and {"été", "naïve"} <= set(asked)
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    own = packing.WordIds(WORDS)
    assert [[ids.tolist() for ids in own.encode(block)] for block in blocks] == want
