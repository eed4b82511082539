"""Classifiers on held-out rows."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scourframe.llm import common, language, toxicity
from tests.llm.conftest import TEXTS

SMALL = "/root/testdata/sf0.01"


def test_op9_on_held_out_rows(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = language.op9_language_id(spark, SMALL).collect()
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_rows(spark, odd, none):
    model = language.fit_languages(odd)
    rows = language.identify(odd, model).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
        assert 0 <= r.score <= 1
    empty = language.fit_languages(none)
    assert {r.lang_pred for r in language.identify(odd, empty).collect()} == {"und"}
    assert language.identify(none, empty).count() == 0


def test_follow_the_leader_is_sparse_and_separates():
    draw = np.random.default_rng(1)
    examples = []
    for i in range(300):
        label = i % 2
        at = np.unique(np.append(draw.integers(100, 2000, 30), 5 + label))
        x = np.ones(len(at))
        examples.append((at, x / np.linalg.norm(x), label))
    weights, bias = language.learn_online(examples, 2)
    found = [int((x @ weights[at] + bias).argmax()) for at, x, _ in examples]
    assert np.mean([f == label for f, (*_, label) in zip(found, examples)]) > 0.97
    assert (weights == 0).mean() > 0.9


def test_counts_of_the_sample_come_short_and_whole(spark, monkeypatch):
    """What the driver gets is two bytes a bucket and as few a count as the text needs, and the model learned from it is that of the plain counts;
    also of texts that hold a run more than 255 and more than 65,535 times, or one letter."""
    texts = [(f"{a} {'xyz'[i % 3] * i} {b}", lang) for i in range(20) for a, b, lang in (("der", "und", "de"), ("the", "and", "en"))]
    texts += [("ab" * 300, "de"), ("c" * 70_000, "en"), ("z", "en")]
    docs = spark.createDataFrame([*texts, ("der 0 und", "de"), ("der 0 und", None), (None, "en"), ("12", "en")], "text string, lang string")
    came, kind = [], type(docs)
    monkeypatch.setattr(kind, "toArrow", lambda self, f=kind.toArrow: (came.append(f(self)), came[-1])[1])
    model = language.fit_languages(docs)
    hashes = dict(docs.filter("text is not null").select("text", F.xxhash64("text")).distinct().collect())
    distinct = sorted({*texts, ("der 0 und", "de")}, key=lambda row: (hashes[row[0]], row[1]))
    plain = [(at, model.values(at, n), model.languages.index(lang)) for text, lang in distinct if hashes[text] % 5 for at, n in [language.gram_counts(text)]]
    weights, bias = language.learn_online(plain, 2)
    assert model.languages == ["de", "en"] and (model.weights == weights).all() and (model.bias == bias).all()
    sample = next(table for table in came if "own" in table.column_names)
    grams = [language.gram_counts(text)[1] for text, _ in distinct]
    assert sum(map(len, sample.column("at").to_pylist())) == 2 * sum(map(len, grams))
    assert sum(map(len, sample.column("n").to_pylist())) == sum(len(n) * (1 if n.max() < 256 else 2 if n.max() < 65536 else 4) for n in grams)


def test_rounds_without_languages_are_not_written(spark, monkeypatch):
    rows = [(i, f"{'vile' if i % 4 == 0 else 'calm'} words of row {i}", "en" if i % 2 else None) for i in range(200)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    names, settled = [], common.settled
    monkeypatch.setattr(common, "settled", lambda df, name: (names.append(name), settled(df, name))[1])
    model = toxicity.fit_toxicity(docs, labels)
    assert toxicity.ROUNDS > 1 and names.count("toxicity-sums") == 1 and model.names == ["en"]
    assert [s >= toxicity.CUT for s in model.scores([text for _, text, _ in rows])] == [i % 4 == 0 for i in range(200)]


def test_temperature_softens_overconfidence():
    draw = np.random.default_rng(2)
    labels = draw.integers(0, 2, 400)
    logits = np.zeros((400, 2))
    logits[np.arange(400), np.where(draw.random(400) < 0.7, labels, 1 - labels)] = 8
    assert language.best_temperature(logits, labels) > 3


def test_op8_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = toxicity.op8_toxicity(spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    own = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    toxic, clean = [s for s, y in own if y], [s for s, y in own if not y]
    assert np.mean([t > c for t in toxic for c in clean]) > 0.75


def test_toxicity_of_odd_rows(spark, odd, none):
    words = ["calm", "river", "stone", "light", "paper", "green"]
    train = spark.createDataFrame([(i, " ".join([words[(i * 7 + j) % 6] for j in range(30)] + (["vile", "wretch"] if i % 4 == 0 else [])), "en", float(i)) for i in range(1000, 1400)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0), 5) for i in range(1000, 1400)] + [(None, 1, 1, 5), (1001, 0, None, 5)], "doc_id long, quality int, toxic int, text int")
    model = toxicity.fit_toxicity(train, labels)
    got = {r.doc_id: r.s for r in train.select("doc_id", toxicity.toxicity_of(model).alias("s")).collect()}
    assert all((s >= 0.7) == (i % 4 == 0) for i, s in got.items())
    rows = odd.select("text", toxicity.toxicity_of(model).alias("s")).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.s < 0.7 for r in rows)
    assert toxicity.fit_toxicity(train, labels.filter("toxic = 0")) is None
    assert toxicity.fit_toxicity(none, labels.filter("false")) is None
    assert [r.s for r in odd.limit(2).select(toxicity.toxicity_of(None).alias("s")).collect()] == [0.0, 0.0]
    assert none.select(toxicity.toxicity_of(model)).count() == 0


def test_held_out_rows_are_not_learned_from(spark):
    from scourframe.llm import common

    rows = spark.range(60).select("id", common.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def test_a_repeated_text_takes_no_place_from_others(spark):
    """300 different texts in each language, and one German text 20,000 times."""
    german, english = "der die das und nicht mit haus wald fluss gehen sehen schnell immer wieder".split(), "the and with house forest river walk see quick always again not this that".split()
    draw = np.random.default_rng(6)
    rows = [(lang, " ".join(draw.choice(words, 25))) for lang, words in (("de", german), ("en", english)) for _ in range(300)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    many = spark.range(20_000).selectExpr("'de' AS lang", f"'{' '.join(german)}' AS text")
    model = language.fit_languages(docs.unionByName(many), sample_per_language=200)
    found = language.identify(docs, model).collect()
    for lang in ("de", "en"):
        assert np.mean([r.lang_pred == lang for r in found if r.lang == lang]) >= 0.97


def test_language_scores_equal_plain_tf_idf(spark, odd):
    model = language.fit_languages(spark.read.parquet(f"{SMALL}/documents.parquet"), sample_per_language=40)
    texts = [t for _, t in TEXTS] + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(20).collect()]

    def bucket(code):
        one, two, three, full = 2654435761, 2246822519, 3266489917, 0xFFFFFFFF
        x = code[0] * one
        x = x if len(code) == 1 else (x + code[1]) * two if len(code) == 2 else (((x + code[1]) * two) + code[2]) * three
        x &= full
        return ((x ^ x >> 13) * one & full) >> 17

    for text in texts:
        name, score = model.predict(text)
        if not text or not any(c.isalpha() for c in text):
            assert name == "und"
            continue
        code = [ord(c) for c in text.lower()]
        counts = {}
        for n in (1, 2, 3):
            for i in range(len(code) - n + 1):
                at = bucket(code[i: i + n])
                counts[at] = counts.get(at, 0) + 1
        x = {at: (1 + np.log(n)) * float(model.idf[at]) for at, n in counts.items()}
        norm = sum(v * v for v in x.values()) ** 0.5
        logits = [(sum(v / norm * float(model.weights[at, k]) for at, v in x.items()) + float(model.bias[k])) / model.temperature for k in range(len(model.languages))]
        p = np.exp(np.array(logits) - max(logits))
        p /= p.sum()
        assert abs(p[model.languages.index(name)] - score) < 1e-3 and score >= p.max() - 1e-3


def test_toxicity_scores_equal_a_plain_convolution(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), sample_toxic=40, sample_clean=60)
    texts = [t for _, t in TEXTS if not t or len(t) < 1000] + [r.text for r in docs.limit(12).collect()]
    for text, score in zip(texts, model.scores(texts)):
        words = toxicity.words_of(text or "")
        vectors = [np.mean([model.embedding[row] for row in toxicity.word_rows(w)], axis=0) for w in words]
        pooled, padded = [], vectors + [np.zeros(toxicity.DIM)] * max(0, max(toxicity.WIDTHS) - len(vectors))
        for width, f in zip(toxicity.WIDTHS, model.filters):
            values = [np.concatenate(padded[i: i + width]) @ f for i in range(len(padded) - width + 1)]
            pooled += list(np.max(values, axis=0))
        logit = float(np.maximum(np.array(pooled) + model.offsets, 0) @ model.out + model.bias)
        likely = [sum(float(model.groups[toxicity.word_rows(w)[0], k]) for w in words) for k in range(len(model.names))]
        cut = model.cuts[int(np.argmax(likely)) if words else 0]
        assert abs(score - toxicity.squash(logit - cut + np.log(toxicity.CUT / (1 - toxicity.CUT)))) < 1e-3


def test_long_texts_are_learned_from(spark):
    """Toxic rows are told by the last words of texts of 30,000 words."""
    rows = [(i, "calm river " * 15_000 + ("vile wretch" if i % 2 else "green paper"), "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = toxicity.fit_toxicity(docs, docs.selectExpr("doc_id", "int(doc_id % 2) AS toxic"))
    assert [s >= toxicity.CUT for s in model.scores([r[1] for r in rows])] == [bool(i % 2) for i in range(60)]


def test_every_labelled_row_is_learned_from(spark):
    """9,000 rows, each with a word of its own, in several shards: all words are counted, and a rule that two rows show is learned."""
    rows = [(i, f"word{i}x calm river" + (" vile" if i % 3 == 0 else ""), "en") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = toxicity.fit_toxicity(docs, docs.selectExpr("doc_id", "int(doc_id % 3 = 0) AS toxic"))
    seen = {toxicity.word_rows(word)[0] for _, text, _ in rows for word in text.split()}
    assert set(np.flatnonzero(model.groups[:, 0] > model.groups[:, 0].min() + 1).tolist()) == seen
    assert [s >= toxicity.CUT for s in model.scores([text for _, text, _ in rows])] == [i % 3 == 0 for i in range(9000)]


def test_the_average_of_one_shard_is_its_own_model():
    import pyarrow as pa

    learner = toxicity.planted(np.random.default_rng(toxicity.SEED))
    texts = ["calm river stone", "vile wretch stone", "", "green paper"] * 3
    shard = pa.table({"doc_id": list(range(12)), "text": texts, "lang": ["en", None] * 6, "toxic": [int("vile" in t) for t in texts], "held": [i == 3 for i in range(12)]})
    sent = toxicity.shard_round(learner, (1.0, 1.0), 0)(shard).to_pylist()
    assert sum(r["much"] for r in sent if r["lang"] == "en") == sum(len(t.split()) for t in texts[::2])
    own = [r for r in sent if r["lang"] is None]
    sums = pa.table({"at": [r["at"] for r in own], "much": [r["much"] for r in own], "square": [r["square"] for r in own], **{f"row{i}": [r["row"][i] for r in own] for i in range(toxicity.DIM)}})
    plain, examples = learner.copy(), []
    for i in sorted(range(12), key=lambda i: (zlib.crc32(str(i).encode()), texts[i])):
        if i != 3:
            table = toxicity.Table()
            numbers = table.numbers(texts[i])
            examples.append((table.array().astype("<u2"), numbers, int("vile" in texts[i])))
    draw = np.random.default_rng(toxicity.SEED)
    toxicity.planted(draw)
    toxicity.train(plain, examples, (1.0, 1.0), draw.permutation(11))
    got = toxicity.averaged(learner, sums)
    assert np.allclose(got.model.embedding, plain.model.embedding, atol=1e-6) and not np.allclose(got.model.embedding, learner.model.embedding, atol=1e-4)
    assert np.allclose(got.small()[0], plain.small()[0], atol=1e-5) and np.allclose(got.small()[1], plain.small()[1], atol=1e-5)
    assert np.allclose(got.seen["e"], plain.seen["e"])


def test_only_texts_that_may_be_labelled_are_moved(spark, monkeypatch):
    """3,000 rows, 300 of them labelled: the join by id gets few others. Null and repeated ids, and labels without a text, change nothing."""
    rows = [(i, f"{'vile' if i % 2 else 'kind'} words of row {i}", "en") for i in range(3000)] + [(None, "without id", "en"), (10, "again", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i // 10 % 2) for i in range(0, 3000, 10)] + [(None, 1), (99_999, 1)], "doc_id long, toxic int")
    moved, bucketed = [], toxicity.bucketed

    def own(df, key, buckets):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "bitmap_construct_agg" in plan and "strategy=merge" in plan
        moved.append(sorted((r.doc_id, r.text, r.toxic) for r in df.collect()))
        return bucketed(df, key, buckets)

    monkeypatch.setattr(toxicity, "bucketed", own)
    assert toxicity.fit_toxicity(docs, labels) is not None
    assert moved == [sorted((i, text, i // 10 % 2) for i, text, _ in rows if i is not None and i % 10 == 0)]


def test_narrowed_keeps_every_key(spark):
    df = spark.range(20_000).selectExpr("IF(id % 7 = 0, null, id) AS k", "id AS _x")
    keys = spark.range(0, 20_000, 40).toDF("k")
    got = {r.k for r in common.narrowed(df, "k", keys).collect()}
    want = {k for k in range(0, 20_000, 40) if k % 7}
    assert want <= got and len(got - want) < 20_000 / 8
    assert common.narrowed(df, "k", keys).columns == ["k", "_x"]
    assert common.narrowed(df, "k", keys.filter("false")).count() == 0
    assert common.narrowed(df, "k", keys.selectExpr("string(k) AS k")).count() == 20_000


def test_rows_of_a_word_are_told_once_a_shard(monkeypatch):
    asked, word_rows = [], toxicity.word_rows
    monkeypatch.setattr(toxicity, "word_rows", lambda word: asked.append(word) or word_rows(word))
    shard = pa.table({"doc_id": [1, 2, 3], "text": ["a vile überword", "a kind überword", None], "lang": ["en"] * 3, "toxic": [1, 0, 0], "held": [False] * 3})
    toxicity.shard_round(toxicity.planted(np.random.default_rng(toxicity.SEED)), (1.0, 1.0), 0)(shard)
    assert sorted(asked) == ["a", "kind", "vile", "überword"]
    for word in ("überword", "vile", "é", "日本語です", "x" * 9):
        assert word_rows(word)[1:] == [zlib.crc32(word[:n].encode(), 2) % toxicity.BUCKETS for n in toxicity.PREFIXES]


def test_words_are_kept_from_block_to_block(monkeypatch):
    asked, word_rows = [], toxicity.word_rows
    model = toxicity.planted(np.random.default_rng(toxicity.SEED)).model
    blocks = [["a vile word", None], ["a kind word", ""], ["other words at last", "a vile word"]]
    plain = [model.scores(block) for block in blocks]
    monkeypatch.setattr(toxicity, "word_rows", lambda word: asked.append(word) or word_rows(word))
    scorer = toxicity.Scorer(model)
    assert [scorer.scores(block) for block in blocks] == plain and len(asked) == len(set(asked)) == 8
    monkeypatch.setattr(toxicity, "KNOWN", 2)
    scorer = toxicity.Scorer(model)
    assert [scorer.scores(block) for block in blocks] == plain
