"""Parts of the operators without Spark, against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import bpe, order_minhash, pii, quality, secret_scan, sharding, suffix_dedup, token_counts
from ledgerloom.llm.alignment import edit_distance, similar
from ledgerloom.llm.common import tiktoken_ranks, vocabulary_path
from ledgerloom.llm.neighbour_graph import greedy_search
from ledgerloom.llm.suffix_sort import deep_shallow_sort
from ledgerloom.llm.tagger import Tagger


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(4000):
        k = rng.choice([2, 3, 6])
        a = [rng.randrange(k) for _ in range(rng.randint(0, 14))]
        b = [x for x in a if rng.random() < 0.85] + [9] * rng.randint(0, 2) if rng.random() < 0.5 else [rng.randrange(k) for _ in range(rng.randint(0, 14))]
        most = rng.randint(0, 12)
        assert edit_distance(a, b, most) == min(levenshtein(a, b), most + 1)
    assert not similar([], []) and similar("abcde", "abcdx") and not similar("abcd", "abcx")


def test_deep_shallow_sort():
    rng = random.Random(2)
    for _ in range(2000):
        letters = b"abc"[: rng.choice([1, 2, 3])]
        base = [bytes(rng.choice(letters) for _ in range(60)) for _ in range(2)]
        strings = [rng.choice(base)[: rng.randint(0, 60)] + bytes(rng.choice(letters) for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(1, 12))]
        order, shared = deep_shallow_sort(strings)
        assert [strings[i] for i in order] == sorted(strings)
        for n in range(1, len(order)):
            a, b = strings[order[n - 1]], strings[order[n]]
            same = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert shared[n] == same


def test_repeated_windows(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 50)  # texts in several pieces too
    rng = random.Random(4)
    for _ in range(400):
        length, gram = rng.choice([(12, 4), (20, 5), (9, 9), (30, 6)])
        letters = bytes(range(97, 97 + rng.choice([1, 2, 4, 26])))
        some = lambda a, b: bytes(rng.choice(letters) for _ in range(rng.randint(a, b)))
        passages = [some(5, 80) for _ in range(4)]
        texts = [b"".join(rng.choice(passages) if rng.random() < 0.5 else some(0, 20) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 7))]
        groups = defaultdict(list)
        for d, t in enumerate(texts):
            for h, p, f, last in zip(*(x.tolist() for x in suffix_dedup.anchors(t, length, gram))):
                groups[h].append((d, t[f:p], t[p : last + length], last - f + 1, p))
        spans = defaultdict(list)
        for group in groups.values():
            for (d, _, _, _, p), found in zip(group, suffix_dedup.repeated_windows([(x[1], x[2], x[3]) for x in group], length, gram)):
                spans[d] += [(p - hi, p - lo + length) for lo, hi in found]
        counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        for d, t in enumerate(texts):
            want = suffix_dedup.covered([(i, i + length) for i in range(len(t) - length + 1) if counts[t[i : i + length]] > 1])
            assert suffix_dedup.covered(spans[d]) == want


def test_bpe_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary_path(bpe.VOCABULARY)
    codec, library = bpe.Codec(path), tokenizers.Tokenizer.from_file(path)
    rng = random.Random(1)
    letters = "abcAB 's'TΣσςİıſK1２ \n\t\x1c\x85\xa0é́ßÄ中🙂՘"
    texts = ["", "x" * 5000, "ab" * 3000 + "!" * 500, "a<|endoftext|>b<|startoftext|>", "<|ENDOFTEXT|>"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        ids, shown = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert shown == library.decode(want, skip_special_tokens=False) == codec.decode(want)
    assert codec.encode(None) == (b"", "")


def test_longest_match():
    ranks = tiktoken_ranks(vocabulary_path(token_counts.VOCABULARY))
    automaton = token_counts.LongestMatch(ranks)
    longest = max(map(len, ranks))

    def brute(word):
        n = 0
        while word:
            size = next(k for k in range(min(longest, len(word)), 0, -1) if word[:k] in ranks)
            word, n = word[size:], n + 1
        return n

    rng, tokens = random.Random(5), list(ranks)
    for _ in range(2000):
        word = b"".join(rng.choice(tokens)[: rng.randint(1, 9)] for _ in range(rng.randint(1, 5)))
        assert automaton.count(word) == brute(word)
    assert automaton.count(b"") == 0


def test_sketches_follow_similarity():
    rng = random.Random(6)
    sketcher = order_minhash.Sketcher()
    words = [f"w{rng.randrange(400)}".encode() for _ in range(300)]
    hashes = lambda w: order_minhash.shingle_hashes(np.fromiter(map(sketcher.word_hash, w), np.uint64, len(w)))
    for extra in ([], words[:20], words[40:50] * 3):  # repeats elsewhere in a text don't change its other shingles
        other = words + extra
        a, b = hashes(words), hashes(other)
        assert len(set(a.tolist()) & set(b.tolist())) == len(a)
        agree = (sketcher.sketches(a) == sketcher.sketches(b)).mean()
        assert agree > (len(a) / len(b)) ** 2 - 0.2
    moved = words[150:] + words[:150]
    near, far = (sketcher.sketches(hashes(words)) == sketcher.sketches(hashes(x)) for x in (words[:295], moved))
    assert near.mean() > 0.85 and far.mean() < near.mean() - 0.2  # order counts
    assert sketcher.bands([]) is None and len(sketcher.bands([b"a"])) == order_minhash.BANDS


def test_secret_patterns():
    base = lambda t: [(secret_scan.KINDS[k], a, b) for a, k, b in secret_scan.base_spans(t)]
    assert base('PassWord: "abcdefgh"') == [("assign", 0, 19)]
    assert base("token=short secret = longenough1") == [("assign", 12, 32)]
    assert base("AKIA" + "A1" * 6 + " AKIA123") == [("access", 0, 16)]
    assert base("x" + "0f" * 16 + "g") == [("hex", 1, 33)]
    scanner = secret_scan.Scanner()
    kinds = lambda t: [secret_scan.KINDS[k] for _, k, _ in scanner.spans(t)]
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    hits = sum(kinds("key " + "".join(rng.choice(letters) for _ in range(40)) + " end") == ["random"] for _ in range(200))
    assert hits >= 190
    for clean in ("123e4567-e89b-12d3-a456-426614174000.", "com.example.project.module_name", "internationalisation_configuration", "2024-05-06.12.13.14.15.16", "getUserAccountSettingsFromServer", None, ""):
        assert kinds(clean) == []
    assert secret_scan.redacted("a token=abcdefghij b", scanner.spans("a token=abcdefghij b")) == "a [SECRET] b"


def test_personal_data_patterns():
    def brute(t):
        digits = lambda s: re.sub("[^0-9]", "", s)
        out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
        out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
        return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m.group())) <= 15]

    rng = random.Random(5)
    for _ in range(8000):
        t = "".join(rng.choice("a@.é-+1 0(29@.²") for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.3:
            t += rng.choice(("4111 1111 1111 1111", "10.20.30.40.50", "a@b.c@d.e")) + t
        assert pii.base_spans(t) == brute(t)


def test_tagger_gradients_and_accuracy():
    tagger = Tagger(3, embedding=4, hidden=3, seed=1)
    rng = np.random.default_rng(0)
    ids, tags = rng.integers(1, 50, (2, 6)), rng.integers(0, 3, (2, 6))
    _, grads = tagger.gradients(ids, tags)
    for name, g in grads.items():
        flat = tagger.params[name].reshape(-1)
        i = int(np.abs(g).argmax())
        old = flat[i]
        flat[i] = old + 0.01
        up = tagger.gradients(ids, tags)[0]
        flat[i] = old - 0.01
        down = tagger.gradients(ids, tags)[0]
        flat[i] = old
        assert abs((up - down) / 0.02 - g.reshape(-1)[i]) < 2e-2, name


def test_quality_counts():
    text = "one two three one two three four\n\none two three one two three four\n#a $b"
    n_words, word_chars, symbols, dups, repeats, failed, kept, *_ = quality.judge(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert (n_words, word_chars, symbols, dups) == (len(words), sum(map(len, words)), 2, 1)
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    assert repeats == len(marked) and failed and not kept
    assert quality.judge(None)[:5] == (0, 0, 0, 0, 0) and not quality.judge("")[6]
    rng = random.Random(2)
    clean = "\n".join(" ".join(f"word{rng.randrange(500)}" for _ in range(9)) + "." for _ in range(12))
    assert quality.judge(clean)[6] and quality.judge(clean)[-1] == clean
    assert quality.judge("a b \x1cc")[0] == 2


def test_greedy_search_finds_neighbours():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16))
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    near = np.argsort(-scores, axis=1)[:, :12]
    places, exact = greedy_search(x, near, x[:50], np.arange(50), 64, 11)
    hits = [len(set(np.argsort(-scores[i])[:10]) & set(places[i])) for i in range(50)]
    assert np.mean(hits) / 10 > 0.95
    assert np.allclose(exact, np.einsum("qd,qnd->qn", x[:50], x[places]))


def test_greedy_search_reaches_every_cluster():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(80, 32)), 20, axis=0) + 0.05 * rng.normal(size=(1600, 32))
    x = rng.permutation(x / np.linalg.norm(x, axis=1)[:, None])
    queries, x = x[:60], x[60:]
    near = np.argsort(-(x @ x.T), axis=1)[:, 1:13]
    places, _ = greedy_search(x, near, queries, np.full(60, -1), 64, 10)
    hits = [len(set(np.argsort(-(x @ q))[:10]) & set(found)) for q, found in zip(queries, places)]
    assert np.mean(hits) / 10 > 0.95


def test_secrets_of_one_case():
    scanner = secret_scan.Scanner()
    rng = random.Random(9)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for letters in (upper, upper.lower(), upper + "234567", upper.lower() + "0123456789"):
        hits = sum(bool(scanner.spans("key " + "".join(rng.choice(letters) for _ in range(32)) + " end")) for _ in range(200))
        assert hits >= 180
    assert scanner.spans("JBSWY3DPEHPK3PXPJBSWY3DPEHPK3PXP")
    for name in ("otorhinolaryngologist_praxis_verzeichnis", "XMLHttpRequestFactoryBean", "MAX_CONNECTION_RETRY_COUNT_TOTAL", "Donaudampfschifffahrtsgesellschaft"):
        assert not scanner.spans(name)


def test_secrets_inside_paths():
    scanner = secret_scan.Scanner()
    rng = random.Random(10)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for start, size, more in (("config/services/payments/production/credentials/primary/", 32, ""), ("storage.example.com/private/downloads/", 24, ""), ("cdn.example.net/assets/images/gallery/", 24, "/"), ("internationalisationconfiguration", 40, "")):
        hits = 0
        for _ in range(100):
            secret = "".join(rng.choice(letters + more) for _ in range(size - 1)) + "x"
            text = f"see {start}{secret} now"
            hits += "".join(text[a:b] for a, _, b in scanner.spans(text)).find(secret[4:-4]) >= 0
        assert hits >= 90, start
    for clean in ("config/services/payments/production/credentials/primary/index.html", "blog.example.com/2019/05/12/17/30/a-title-of-many-words", "static.example.com/assets/javascript/application/production/downloads/resources/" + hashlib.sha1(b"a").hexdigest() + "/app.js", "files/123e4567-e89b-12d3-a456-426614174000/download"):
        assert not [s for s in scanner.spans(clean) if s[1] == 3], clean


def test_quality_of_menus():
    menu = [f"Item {chr(97 + i % 26)}{i}" for i in range(60)]
    for page in ("\n".join(menu), "\n\n".join(menu)):
        assert quality.judge(page)[6] is False and quality.judge(page)[-1].strip() == ""
    for line in ("Home|About|News|Login", "Home · About · News · Login", "Home / About / News / Login"):
        assert quality.line_fails(line)
    assert not quality.line_fails("and/or his/her him/her are written so", heads=True) and not quality.line_fails("a heading", heads=True)
    rng = random.Random(3)
    prose = "\n".join(f"A heading\n{' '.join(f'word{rng.randrange(500)}' for _ in range(9))}." for _ in range(12))
    assert quality.judge(prose)[6] and quality.judge(prose)[-1] == prose


def test_quality_of_labelled_lines():
    navigation = ["Home", "Menu", "Home | About", "Skip to content", "Next page", "Back to top", "Home » Blog » Archive", "Page 3 of 10", "1 2 3 4 Next", "12 comments", "https://example.com/a?b=c", "Log in", "Startseite", "News / Sport / Weather"]
    boilerplate = ["(c) 2020 Acme Inc", "© 2019 Example Ltd.", "Copyright 2021 Acme.", "All rights reserved.", "Subscribe to our newsletter today!", "This site uses cookies, see our cookie policy.", "Please enable JavaScript to view this page.", "Posted by admin on May 3, 2014", "Powered by WordPress.", "Tous droits réservés.", "Read more..."]
    bare = ["Quick facts", "Blue widget deluxe edition", "*** $$$ ###", "12 / 34 / 56", "Buy!! now!! cheap!! cheap!! shoes!!", "The### best$$$ price*** of%%% all&&& time"]
    prose = ["It was late, and nobody had come home.", "She said: \"Go on.\"", "Yes.", "He asked about the menu and the price of the wine.", "See the next page of the report for details.", "the rain fell on the roof and on the street below", "Version 2.0 was released on May 3, 2014, after a long delay.", "A rate of 3/4 or 5/8 is usual here.", "¿Dónde está la casa?", "Wow! It works! He ran home!", "Her news about the account came as a shock."]
    for line in navigation:
        assert quality.navigation(line), line
    for line in boilerplate:
        assert quality.boilerplate(line), line
    for line in bare:
        assert quality.line_fails(line), line
    for line in prose:
        assert not quality.line_fails(line), line
    long = "He wrote that the privacy policy of the company had been changed without notice, " + "and that nobody had read it " * 5 + "at all."
    assert len(long) > 200 and not quality.line_fails(long)


def test_quality_rejects_what_loses_its_text():
    rng = random.Random(7)
    sentence = lambda n: " ".join(f"word{rng.randrange(900)}" for _ in range(n)) + "."
    junk = lambda: f"Copyright 2020 {sentence(11)}"
    for n_junk, kept in ((4, True), (40, False)):
        lines = [sentence(13) for _ in range(10)] + [junk() for _ in range(n_junk)]
        rng.shuffle(lines)
        made = quality.judge("\n".join(lines))
        clean = [x for x in lines if not x.startswith("Copyright")]
        assert not made[5] and made[6] is kept and made[8] == n_junk and made[-1] == "\n".join(clean)
        lost = sum(len("".join(x.split())) for x in lines if x not in clean)
        assert made[9] == lost and kept == (100 * lost <= 60 * made[1])
    text = "A heading\n\n" + sentence(12) + "\nTwo lines\nof a list\n" + sentence(12)
    assert quality.judge(text)[-1] == text.replace("\nTwo lines\nof a list", "")


def test_secrets_in_prose_and_code():
    import argparse
    import inspect
    import json.decoder
    import pydoc_data.topics

    scanner = secret_scan.Scanner()
    texts = [inspect.getsource(argparse), inspect.getsource(json.decoder), inspect.getsource(random), "\n".join(pydoc_data.topics.topics.values())]
    found = [t[a:b] for t in texts for a, k, b in scanner.spans(t) if k == 3]
    assert len(found) <= sum(map(len, texts)) / 50_000, found


def test_secrets_are_those_of_brute_force():
    scanner, rng = secret_scan.Scanner(), random.Random(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def brute(text):
        """Whole runs that the ratio alone decides; the words here have no separators."""
        out = []
        for m in re.finditer(r"[A-Za-z0-9+/_.-]{20,}", text):
            low = 100 * len(m.group()) <= 195 * len(scanner.encoding.encode_ordinary(m.group()))
            if low and not any(a <= m.start() and m.end() <= b for a, _, b in secret_scan.base_spans(text)):
                out.append(m.span())
        return out

    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 30)):
            secret = "".join(rng.choice(letters) for _ in range(rng.randint(22, 40)))
            parts.append(rng.choice([secret, f"password={secret}", "internationalisation", "a few words", hashlib.md5(secret.encode()).hexdigest(), "token: short"]))
        text = " ".join(parts)
        assert [(a, b) for a, k, b in scanner.spans(text) if k == 3 and b - a >= 22 and (a == 0 or text[a - 1] == " ") and (b == len(text) or text[b] == " ")] == brute(text)


def test_overlaps_are_found_in_linear_time():
    import time

    scanner = secret_scan.Scanner()
    text = "password=abcdefgh12345678 " * 20_000
    began = time.time()
    assert len(scanner.spans(text)) == 20_000 and time.time() - began < 20
    finder = pii.Finder(pii.Tagger(9).params)
    began = time.time()
    assert len(finder.spans(["a@b.cd " * 20_000])[0][0]) == 20_000 and time.time() - began < 60


def test_best_sequences_of_the_tagger():
    rng = np.random.default_rng(4)
    for _ in range(60):
        tagger = Tagger(3, embedding=2, hidden=2)
        tagger.params["trans"] = rng.normal(0, 1.5, (3, 3)).astype(np.float32)
        scores = rng.normal(0, 2, (6, 3)).astype(np.float32)
        trans = tagger.params["trans"]
        worth = {p: sum(scores[i, k] for i, k in enumerate(p)) + trans[0, p[0]] + sum(trans[a, b] for a, b in zip(p, p[1:])) + trans[p[-1], 0] for p in itertools.product(range(3), repeat=6)}
        best = max(worth, key=worth.get)
        assert tuple(tagger.decode(scores[None])[0]) == best
        open_ = tagger.open_places(scores)
        assert all(open_[i] for i, k in enumerate(best) if k)


@pytest.fixture(scope="module")
def finder():
    return pii.Finder(pii.train())


def test_stretches_change_nothing(finder):
    texts = [t for t, _ in pii.labelled(98, 60)] + ["word " * 60 + "call (212) 555 0187 now " + "word " * 90 + "x [at] y.com", "a" * 500 + "1" + "b" * 500, ""]
    near, all_ = finder.tagged(texts), finder.tagged(texts, everywhere=True)
    held = lambda t, spans: [s for s in spans if pii.plausible(s[0], t[s[1] : s[2]])]
    assert [held(t, x) for t, x in zip(texts, near)] == [held(t, x) for t, x in zip(texts, all_)]
    # A window's border shows nowhere: shifted texts have shifted spans.
    text = texts[-3]
    for shift in (1, 7, 16, 31, 32, 33):
        want = [(k, a + shift, b + shift) for k, a, b in held(text, finder.tagged([text])[0])]
        assert held("-" * shift + text, finder.tagged(["-" * shift + text])[0]) == want


def test_personal_data_planted_in_prose(finder):
    """The texts and the written forms are none of the generator's."""
    import pydoc_data.topics

    prose = [" ".join(t.split()) for t in pydoc_data.topics.topics.values() if len(t) > 2000]
    forms = {
        0: ("john.smith [at] research.example [dot] com", "m.oconnor(at)mail(dot)example(dot)org", "info [at] bakery-luigi.net", "sales (at) widgets.example.com"),
        1: ("192 . 168 . 10 . 44", "10[.]0[.]12[.]7", "172[.]16[.]254[.]1"),
        2: ("4556.7375.8689.9855", "5105 - 1051 - 0510 - 5100", "4012.8888.8888.1881"),
        3: ("(415) 555-2671", "020 7946 0958", "212-555-0147", "0049 89 636 48018", "650.555.0143"),
    }
    rng, right, there = random.Random(4), 0, 0
    for kind, form in ((k, f) for k, fs in forms.items() for f in fs for _ in range(12)):
        t = rng.choice(prose)
        at = t.index(" ", rng.randrange(100, len(t) - 500))
        text = f"{t[max(0, at - 400) : at]} {form}{rng.choice([' ', ', ', '. '])}{t[at + 1 : at + 300]}"
        a = text.index(form)
        right += (kind, a, a + len(form)) in finder.spans([text])[0][1]
        there += 1
    assert right / there >= 0.9
    base, every = zip(*finder.spans(prose))
    assert sum(map(len, every)) - sum(map(len, base)) <= 5  # false alarms in half a million characters


def test_places_between_splitters():
    rng = random.Random(3)
    for _ in range(300):
        some = lambda n: [tuple(rng.randrange(3) for _ in range(3)) for _ in range(n)]
        splitters, keys = sorted(set(some(rng.randint(0, 9)))), some(30)
        got = sharding.place_of([np.array([k[i] for k in keys]) for i in range(3)], [np.array([s[i] for s in splitters], np.int64) for i in range(3)])
        assert got.tolist() == [sum(s <= k for s in splitters) for k in keys]
