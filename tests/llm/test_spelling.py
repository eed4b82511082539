"""Spelling variants against deletion neighbourhoods in plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from scourframe.llm import spelling
from tests.llm.conftest import SF, TEXTS

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(SMALL)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 31 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    cells = defaultdict(set)
    for w in words:
        for part in {w, *(w[:i] + w[i + 1:] for i in range(min(len(w), 40)))}:
            cells[part].add(w)
    near = defaultdict(set)
    for group in cells.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def got(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


@pytest.mark.parametrize("letters, most", [("ab", 9), ("abcé", 8), ("a", 60), ("abcdefgÿ", 10)])
def test_search_equals_comparison(letters, most):
    draw = random.Random(most)
    words = sorted({"".join(draw.choice(letters) for _ in range(draw.randint(2, most))) for _ in range(300)})
    coded = [w.encode("latin-1") for w in words]
    index = spelling.Index(coded)
    texts = [w + b"\0" for w in coded]
    places = [(word, at) for word in range(len(words)) for at in range(len(texts[word]))]
    order = sorted(places, key=lambda p: (texts[p[0]][p[1]:], p[0]))
    assert index.owner.tolist() == [word for word, _ in order]
    exact = np.array([len(w) // 2 for w in words])
    found = list(zip(*(x.tolist() for x in spelling.one_apart(index, coded, exact))))
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b) and (len(a) < 2 or a[len(a) - len(a) // 2:] == b[len(b) - len(a) // 2:])}
    assert len(found) == len(set(found)) and set(found) == want


def test_whole_operator(spark, odd, none, monkeypatch):
    draw = random.Random(8)
    stems = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(6, 12))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "abababababab", "x" * 3000, "x" * 2999, "Ünïcödewort", "×÷×÷×÷×÷"]
    texts = [(None, "Without Number without number")]
    for i in range(600):
        chosen = []
        for _ in range(60):
            w = stems[min(int(draw.expovariate(0.15)), len(stems) - 1)]
            if draw.random() < 0.15:
                at = draw.randrange(len(w))
                w = w[:at] + draw.choice(["", draw.choice("abcdeé"), w[at] + "b"]) + w[at + 1:]
            chosen.append(w.upper() if draw.random() < 0.1 and w.isascii() else w)
        texts.append((i, draw.choice([" ", ", ", "3"]).join(chosen)))
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    want = brute(TEXTS + texts)
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] and r[1] for r in want)
    assert got(spelling.spelling_variants(docs)) == want
    monkeypatch.setattr(spelling, "HOT", 7)  # every half in blocks
    monkeypatch.setattr(spelling, "SHARD", 20)
    monkeypatch.setattr(spelling, "QUERIES", 11)
    monkeypatch.setattr(spelling, "COUNTED", 50)
    assert got(spelling.spelling_variants(docs)) == want
    assert got(spelling.spelling_variants(odd)) == brute(TEXTS)
    assert spelling.spelling_variants(none).count() == 0


def test_op11(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(spelling.op11_spelling_variants(spark, SF)) == brute(texts)
