"""Language-model scores, aligned tokenizers and lexical search against brute force on small tables with every awkward row."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import backoff_lm, cross_tokenizer
from ledgerloom.llm.backoff_lm import score_texts
from ledgerloom.llm.common import vocabulary_path
from ledgerloom.llm.cross_tokenizer import Aligner, align_tokenizers, group_text, overlaps
from ledgerloom.llm.lexical_search import search

SCHEMA = "doc_id bigint, text string, n_tokens bigint, score double, key string, term string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [rng.choice("BCdfgh") + rng.choice("aeiouéñ") + rng.choice("lmnrst") + str(i % 7) for i in range(150)]
    some = lambda k: " ".join(rng.choice(words) for _ in range(k))
    texts = [some(rng.randint(3, 60)) + rng.choice([".", " !", "\n", "  \n b", ""]) for _ in range(60)]
    texts += [texts[3]] * 9 + [None, "", " ", "\n\n", "a", "A a", "▁ spelled otherwise", "<|endoftext|> <s> <0x41>", "日本語 ㎏ \U0001f600́", "x" * 3000, some(4000), "- + *"]
    made = [(i, t, 5, 0.5, "k", "t") for i, t in enumerate(texts)]
    return made + [made[0], made[3], (None, texts[4], 5, 0.5, "k", "t"), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("in") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def expected_scores(rows, order, prior):
    words = [[w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + [b""] for _, t, *_ in rows]
    test = [zlib.crc32(str("null" if i is None else i).encode()) % 7 == 2 for i, *_ in rows]
    counts = [Counter() for _ in range(order)]
    for ws, out in zip(words, test):
        full = [b"", *ws]
        for j in range(1, len(full)):
            for n in range(min(order, j + 1)):
                counts[n][tuple(full[j - n : j + 1])] += not out
    total, distinct = sum(counts[0].values()), sum(n > 0 for n in counts[0].values())

    def p(h, w):
        if not h:
            return (counts[0][(w,)] + 1) / (total + distinct + 1)
        return (counts[len(h)][(*h, w)] + prior * p(h[1:], w)) / (counts[len(h) - 1][h] + prior)

    for (i, *_), ws, out in zip(rows, words, test):
        full = [b"", *ws]
        score = sum(math.log10(p(tuple(full[max(0, j - order + 1) : j]), full[j])) for j in range(1, len(full)))
        yield i, out, len(ws), sum(counts[0][(w,)] > 0 for w in ws), total, sum(math.log10(p((), w)) for w in ws), score


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores(monkeypatch, docs, rows, order):
    monkeypatch.setattr(backoff_lm, "BLOCK", 500)
    monkeypatch.setattr(backoff_lm, "RANGE", 400)
    shape = lambda r: (str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 6), round(r[6], 6))
    found = sorted(map(shape, score_texts(docs, order=order, prior=7.0).collect()))
    assert found == sorted(map(shape, expected_scores(rows, order, 7.0)))


def test_scores_of_nothing(spark, docs):
    assert score_texts(docs.limit(0)).collect() == []
    alone = score_texts(docs.filter("doc_id < 5"), test=F.lit(True), keep=["doc_id", "key", "score"]).collect()
    assert len(alone) == 7 and all(r["score"] == 0 and r["n_known"] == 0 and r["key"] == "k" for r in alone)


def test_model_beats_single_words(spark):
    """Held-out texts of a language with word order: the histories must help."""
    rng = random.Random(8)
    after = {w: [f"w{rng.randrange(40)}" for _ in range(3)] for w in (f"w{i}" for i in range(40))}
    texts = []
    for i in range(300):
        w, out = "w0", []
        for _ in range(40):
            w = rng.choice(after[w])
            out.append(w)
        texts.append((i, " ".join(out)))
    got = score_texts(spark.createDataFrame(texts, "doc_id bigint, text string")).groupBy("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).filter("held_out").first()
    assert got["s"] > 0.75 * got["b"]


def plain_alignment(a_tokens, b_tokens):
    """(links, groups) from byte ranges, pair by pair."""
    spans = lambda tokens: [(sum(map(len, tokens[:i])), sum(map(len, tokens[: i + 1]))) for i in range(len(tokens))]
    a, b = spans(a_tokens), spans(b_tokens)
    links = [(i, j) for i, (s, e) in enumerate(a) for j, (u, v) in enumerate(b) if s < v and u < e]
    ends = sorted({e for _, e in a} & {e for _, e in b})
    return links, [([i for i, (_, e) in enumerate(a) if lo < e <= hi], [j for j, (_, e) in enumerate(b) if lo < e <= hi]) for lo, hi in zip([0, *ends], ends)]


def test_alignment(monkeypatch, docs, rows):
    monkeypatch.setattr(cross_tokenizer, "BLOCK", 700)
    monkeypatch.setattr(cross_tokenizer, "CHUNK", 2000)
    short = [r for r in rows if len(r[1] or "") < 2000]
    aligner = Aligner(vocabulary_path(cross_tokenizer.A_VOCABULARY), vocabulary_path(cross_tokenizer.B_VOCABULARY))
    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    made, held = [], Counter()
    for i, t, *_ in short:
        a, b = (library.encode(" " + t, add_special_tokens=False).ids, pieces.encode(t)) if t and "▁" not in t else ([], [])
        links, groups = plain_alignment([aligner.a.tokens[x] for x in a], [aligner.b.tokens[x] for x in b])
        links = [(a[x], b[y]) for x, y in links]
        shown = ";".join(",".join(str(a[x]) for x in g) + "|" + ",".join(str(b[y]) for y in h) for g, h in groups)
        held.update(set(links))
        made.append((i, len(a), len(b), len(groups), links, shown))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    want = [(i, a, b, g, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(s.encode()).hexdigest() if s else "") for i, a, b, g, links, s in made]
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = align_tokenizers(docs.filter("text is null or length(text) < 2000"), keep=["doc_id", "key", "n_a"])
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want))
    full = align_tokenizers(docs.filter("doc_id = 4"), full=True).first()
    assert hashlib.sha256(full["groups"].encode()).hexdigest() == full["groups_sha256"]
    assert align_tokenizers(docs.limit(0)).collect() == []


def test_segments_change_nothing():
    """Segments by themselves encode as whole texts do in both libraries."""
    aligner = Aligner(vocabulary_path(cross_tokenizer.A_VOCABULARY), vocabulary_path(cross_tokenizer.B_VOCABULARY))
    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    rng = random.Random(5)
    letters = "ab 1'\n\t▁<|>s0xé中😀\0\r \x1c\x85\xa0 　​"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += [" a" + chr(c) + " b" + chr(c) + "1  " + chr(c) + " \n" for c in range(0, 0x3000, 3)]
    for t, ids in zip(texts, aligner.encode(texts)):
        if t and "▁" not in t:
            assert ids[0].tolist() == library.encode(" " + t, add_special_tokens=False).ids and ids[1].tolist() == aligner.b_model.encode(t)
        else:
            assert ids is None


def test_overlaps_of_owners():
    a, b, cut = overlaps(np.array([0, 0, 1, 1, 1, 2]), np.array([0, 1, 1, 1, 1, 2]))
    assert (a.tolist(), b.tolist(), cut.tolist()) == ([0, 0, 1, 2], [0, 1, 1, 2], [True, False, False, True])
    side = cross_tokenizer.Side([b"x"] * 30)
    assert group_text(side, side, np.array([7, 8, 9]), np.array([1, 2, 13]), a, b, cut) == b"7,8|1,2;9|13"


def plain_search(rows, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, length = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in docs:
            m = 10 + 90 * n * n_docs // length
            found.append((sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t]), i))
        found = sorted((x for x in found if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(item, r, i, s) for r, (s, i) in enumerate(found, 1)]
    return out


@pytest.mark.parametrize("k", [1, 4, 10])
def test_search(spark, docs, rows, k):
    rng = random.Random(2)
    texts = [t for _, t, *_ in rows if t]
    items = [(i, " ".join(rng.choice(texts).split()[:12]) + " " + rng.choice(texts)[:60]) for i in range(25)]
    items += [(50, None), (51, ""), (52, "nowhere else"), (53, texts[3]), (53, texts[3]), (None, texts[7]), (54, "a A a"), (55, " ".join(texts[:9]))]
    got = search(docs, spark.createDataFrame(items, "item_id bigint, text string"), k)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_search([(i, t) for i, t, *_ in rows], items, k)))


def test_search_of_nothing(spark, docs):
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert search(docs.limit(0), items).collect() == [] and search(docs, items.limit(0)).collect() == []
