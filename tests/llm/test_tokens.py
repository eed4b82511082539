"""Byte-level BPE and token counts against the public libraries; quotation linking against SQL and by hand."""

import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from scourframe.llm import bytebpe, quotes, wordpiece
from tests.llm.conftest import SF, TEXTS

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.ranks_of(RANKS), special_tokens={})


def test_encoding_equals_the_library_and_decodes(spark, odd, none):
    draw, letters = random.Random(5), "aB's don't  \n\n\t\ré漢1²٣.,!\U0001F600\x1c\x85\xa0 ​\x00'll"
    extra = spark.createDataFrame([(100 + i, "".join(draw.choice(letters) for _ in range(draw.randint(0, 50)))) for i in range(400)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(extra)
    rows = bytebpe.decode(bytebpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    got = sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in rows)
    want = sorted((str(r.doc_id), LIBRARY.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect())
    assert got == want
    assert bytebpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_decoding_keeps_null_and_other_columns(spark):
    rows = spark.createDataFrame([(1, [10, 20], "x"), (2, None, "y"), (3, [], "z")], "doc_id long, ids array<int>, decoded string")
    got = {r.doc_id: r.decoded for r in bytebpe.decode(rows, RANKS).collect()}
    assert got == {1: LIBRARY.decode_bytes([10, 20]), 2: None, 3: b""}


def test_op3(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = bytebpe.op3_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def greedy(word, first, following):
    at, n, pieces = 0, 0, first
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 0
        at, n, pieces = end, n + 1, following
    return n


def test_automaton_equals_greedy_search():
    draw = random.Random(3)
    for _ in range(300):
        first = {"".join(draw.choice("abc") for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(1, 8))}
        following = {"".join(draw.choice("abc") for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(0, 8))}
        machine = wordpiece.Automaton(sorted(first), sorted(following))
        for _ in range(40):
            word = "".join(draw.choice("abc") for _ in range(draw.randint(1, 12)))
            assert machine.count(word) == greedy(word, first, following)


def test_counts_of_odd_rows(odd, none):
    first, following = wordpiece.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    rows = wordpiece.token_counts(odd, first, following).collect()
    one, more = set(first), set(following)
    assert len(rows) == len(TEXTS)
    want = []
    for i, text in TEXTS:
        words = (text or "").split()
        each = {w: greedy(w, one, more) for w in set(words)}
        want.append((str(i), len(words), sum(each[w] or 1 for w in words), sum(not each[w] for w in words)))
    assert sorted((str(r.doc_id), r.n_words, r.n_tokens, r.n_unknown) for r in rows) == sorted(want)
    assert wordpiece.token_counts(none, first, following).count() == 0


def test_op4(spark):
    first, following = (set(x) for x in wordpiece.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = wordpiece.op4_token_counts(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows[:60]:
        assert r.n_tokens == sum(greedy(w, first, following) or 1 for w in texts[r.doc_id].split())


def test_quotes_by_hand(spark):
    rows = [
        (1, 0, "Hello there.\nHow are you?", 7), (1, 1, "> hello   THERE.\n> How are you?\nFine.", 7), (1, 2, ">> Hello there.\n> Fine.\nGood to hear.", 7),
        (1, 3, "> How are you?\nTired.", 7), (1, 4, "> never said\nWhat?", 7), (2, 0, "> Fine.\nFrom elsewhere.", 7), (2, 1, None, 7), (2, 1, None, 7), (2, 2, "", 7),
        (None, 1, "lost", 7), (3, None, "lost too", 7), (4, 0, "> Later.\nFirst.", 7), (4, 1, "Later.", 7),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, text string, root int")
    got = {(r.conv_id, r.turn): (r.own_text, r.n_quotes, r.n_linked, r.n_foreign, r.reply_to, r.root, r.depth, r.position) for r in sorted(quotes.link_quotes(messages).collect(), key=lambda r: r.position is not None)}
    assert got[1, 0] == ("Hello there.\nHow are you?", 0, 0, 0, None, 0, 0, 0)
    assert got[1, 1] == ("Fine.", 1, 1, 0, 0, 0, 1, 1)
    assert got[1, 2] == ("Good to hear.", 2, 2, 0, 1, 0, 2, 3)
    assert got[1, 3] == ("Tired.", 1, 1, 0, 0, 0, 1, 2)
    assert got[1, 4] == ("What?", 1, 0, 0, None, 4, 0, 4)
    assert got[2, 0] == ("From elsewhere.", 1, 0, 1, None, 0, 0, 0)
    assert got[2, 1] == ("", 0, 0, 0, None, 1, 0, 1) and got[2, 2][7] == 2
    assert got[None, 1][7] is None and got[3, None][0] == "lost too"
    assert got[4, 0][4] is None
    assert len(got) == len(rows) - 1 and quotes.link_quotes(messages).count() == len(rows)
    assert quotes.link_quotes(messages.filter("false")).count() == 0


def test_a_long_thread_in_one_conversation(spark):
    n = 300
    chain = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") > 0, F.concat(F.lit("> text "), F.col("id") - 1, F.lit("\ntext "), F.col("id"))).otherwise("text 0").alias("text"))
    rows = quotes.link_quotes(chain, parts=7).collect()
    assert sorted((r.turn, r.depth, r.position, r.root) for r in rows) == [(i, i, i, 0) for i in range(n)]


def test_no_row_of_a_repeated_turn_is_lost(spark, tmp_path):
    """Six rows in, six out, as in the SQL; of the repeated turn the smallest text is quoted and linked."""
    import duckdb

    rows = [(1, 0, "Zebra here.", "user"), (1, 0, "Apple here.", "user"), (1, 1, "Answer.", "x"), (1, 1, "Answer.", "x"), (None, 3, "no conversation\n", "x"), (2, None, "no turn", "x"), (5, 0, None, "x"), (5, 0, "a", "x"), (5, 1, "> b", "x")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string, main string").write.parquet(f"{tmp_path}/conversations.parquet")
    columns = ["conv_id", "turn", "n_quotes", "n_linked", "reply_to", "root", "depth", "position", "own_md5"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({quotes.OP1_SQL}) WHERE conv_id IS DISTINCT FROM 5 OR turn = 0").fetchall()
    found = quotes.op1_quotation_linking(spark, str(tmp_path)).select(columns).collect()
    assert len(found) == len(rows)
    assert sorted((tuple(r) for r in found if r.conv_id != 5 or r.turn == 0), key=str) == sorted(want, key=str)
    assert {(r.turn, r.position) for r in found if r.conv_id == 1} == {(0, 0), (0, None), (1, 1), (1, None)}
    apple = hashlib.md5(b"Apple here.").hexdigest()
    assert [r.position for r in found if r.own_md5 == apple] == [0]
