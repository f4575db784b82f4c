"""The operators' cores without Spark, against plain versions."""

import math
import random
import re

import numpy as np
import pytest

from loomspark.llm import capdedup, jaccard, langid, licenses, linehtml, mixing, packing, quality, shingles, warc


def test_sainte_lague_gives_highest_quotients():
    rng = random.Random(1)
    for _ in range(200):
        claims = [rng.randint(0, 50) for _ in range(rng.randint(1, 8))]
        seats = rng.randint(0, 40)
        caps = [rng.randint(0, 20) for _ in claims]
        got = mixing.sainte_lague(claims, seats, caps)
        plain = [0] * len(claims)
        for _ in range(seats if sum(claims) else 0):
            best = max((i for i, c in enumerate(claims) if c and plain[i] < caps[i]), key=lambda i: (claims[i] / (2 * plain[i] + 1), -i), default=None)
            if best is None:
                break
            plain[best] += 1
        assert sum(got) == sum(plain)
        assert sorted(c / (2 * k + 1) for c, k in zip(claims, got)) == pytest.approx(sorted(c / (2 * k + 1) for c, k in zip(claims, plain)))


def test_targets_are_reshared_until_none_is_above():
    out = mixing.targets([1, 100, 1000], [1, 1, 1])
    assert [float(x) for x in out] == [3, 300, 798]
    assert mixing.targets([0, 0], [1, 2]) == [0, 0] and mixing.targets([], []) == []


def test_automaton_finds_longest_matches():
    rng = random.Random(2)
    for _ in range(50):
        train = bytes(rng.choice(b"abc") for _ in range(30))
        text = bytes(rng.choice(b"abcd") for _ in range(40))
        n = i = 0
        while i < len(text):
            k = 0
            while i + k < len(text) and text[i : i + k + 1] in train:
                k += 1
            i += max(1, k)
            n += 1
        assert langid.phrases(text, langid.suffix_automaton(train)) == n


def test_texts_walk_abreast_as_each_alone():
    rng = random.Random(12)
    trains = [bytes(rng.choice(letters) for _ in range(400)) for letters in (b"abcd", b"cdef \xc3\xa9")]
    moves = [langid.suffix_automaton(t) for t in trains]
    texts = [bytes(rng.choice(b"abcdefg \xc3\xa9") for _ in range(rng.choice([0, 1, 5, 300, 1024, 1025, 5000]))) for _ in range(60)]
    got = langid.phrase_counts(texts, [langid.table(m) for m in moves])
    for text, row in zip(texts, got):
        assert list(row) == [sum(langid.phrases(text[i : i + langid.STRETCH], m) for i in range(0, len(text), langid.STRETCH)) for m in moves]


def test_language_of_odd_texts():
    model = (("a", "the cat sat on the mat"), ("b", "der hund lief im wald"))
    assert langid.classify([None, "", "12 !?", "\u00b2 3"], model) == [("und", 0.0)] * 4
    assert [x for x, _ in langid.classify(["the mat", "IM WALD", "the cat " * 100_000], model)] == ["a", "b", "a"]
    assert langid.classify(["x"], ()) == [("und", 0.0)] and langid.classify(["x"], model[:1]) == [("a", 1.0)] and langid.classify([], model) == []
    assert langid.classify(["the"], (("a", "the"), ("b", "the"))) == [("a", 0.0)]


def test_repeat_words_and_symbols_against_plain_counts():
    rng = random.Random(3)
    hasher = shingles.Hasher()
    texts = []
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", " ", "\n", "é#", " ", "*"]) for _ in range(rng.randint(0, 60)))
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        cover = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
        lines, dup = [], 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in lines
                lines.append(line)
        texts.append(text.encode())
        assert quality.base_counts(text.encode(), hasher.words(text.encode())) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover))


def test_word_hashes_of_many_texts():
    rng = random.Random(13)
    texts = ["".join(rng.choice(["a", "B", " ", "\n\t", "\u00e9", "\x1f", "\u00a0"]) for _ in range(rng.randint(0, 30))).encode() for _ in range(300)] + [b"x" * 100_000 + b" y"]
    name, hashes = {}, {}
    for text, mine in zip(texts, shingles.Hasher().each(texts)):
        words = text.lower().split()
        assert len(words) == len(mine)
        for w, h in zip(words, mine.tolist()):
            assert name.setdefault(h, w) == w and hashes.setdefault(w, h) == h
    alone = shingles.Hasher()
    for text, both in zip(texts, shingles.Hasher().shingles(texts, 2)):
        w = text.lower().split()
        assert len(both) == len({tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()) and list(both) == list(next(alone.shingles([text], 2)))


def test_kneser_ney_probabilities_sum_to_one():
    table = quality.plain_table(["abcabd", "abcaab", "bbca"])
    contexts = {}
    for h, c, total, weight, below in zip(table.h, table.c, table.total, table.weight, table.below):
        g = int(h) * pow(int(quality._MIX), -1, 1 << 64) % (1 << 64)
        contexts.setdefault(g >> 16, []).append((int(c), int(total), float(weight)))
        assert 0 < below < 1 and c <= total
    for rows in contexts.values():
        held = sum(c - table.cuts[min(c, 3)] for c, *_ in rows)
        assert held + rows[0][1] * rows[0][2] == pytest.approx(rows[0][1], rel=1e-5)


def test_a_text_is_scored_by_the_others():
    texts = ["abcabd abcabd", "abcaab", "bbca", "zzzz zzzz zzzz"]
    table = quality.plain_table(texts)
    for own in texts:
        # Counts of grams and contexts of the other texts alone, with this model's discounts, weights and lower orders.
        want = 0.0
        def grams(t):
            u = quality._units([t])
            return [int(x) for x in quality._grams(u)[u[3:] != 2]]

        others = [g for t in texts if t != own for g in grams(t)]
        for g in grams(own):
            at = int(np.flatnonzero(table.h == np.uint64(g) * quality._MIX)[0])
            c, total = others.count(g), sum(x >> 16 == g >> 16 for x in others)
            want += math.log((c - table.cuts[min(c, 3)]) / total + table.weight[at] * table.below[at] if total else table.below[at])
        assert quality._sums([own, "abc"], table)[0] == pytest.approx(want, rel=1e-5)
    assert quality._sums(["zzzz zzzz zzzz"], table)[0] < quality._sums(["abcabd abcabd"], table)[0]


def bands_of(rng, n):
    return np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))


def test_bands_bound_the_overlap_and_blocks_count_it():
    rng = random.Random(14)
    for n in (1, 3, 20, 300, 3000):
        pivot = bands_of(rng, n)
        rows = []
        for share in (0, 0.3, 0.6, 0.8, 0.9, 0.97, 1):
            rows.append(np.unique(np.concatenate([pivot[rng.randrange(2) :: 1][: int(share * n)], bands_of(rng, rng.randint(0, 1 + n // 5))])))
        rows = [r for r in rows if len(r)]
        true = [len(np.intersect1d(pivot, r)) for r in rows]
        most = jaccard.most_common([jaccard.band_sizes(pivot)] * len(rows), [jaccard.band_sizes(r) for r in rows])
        assert all(m >= t for m, t in zip(most, true))
        for percent in (50, 80, 90, 100):
            good = jaccard.overlaps(pivot, rows, percent)
            assert list(good) == [100 * t >= percent * (len(pivot) + len(r) - t) for t, r in zip(true, rows)]
    crowded = np.arange(1000, dtype=np.uint64)
    assert jaccard.most_common([jaccard.band_sizes(crowded)], [jaccard.band_sizes(crowded)])[0] == -1


def test_packing_keeps_every_document_once_and_is_tight():
    rng = random.Random(4)
    counts = {}
    for _ in range(3000):
        s = rng.randint(1, 1023)
        counts[s] = counts.get(s, 0) + 1
    best = packing.evolve([], counts, 1024, 6, 4, random.Random(0))[0]
    used = {}
    for p, m in best.items():
        assert sum(p) <= 1024 and m > 0
        for s in p:
            used[s] = used.get(s, 0) + m
    assert used == counts
    first = packing.best_fit({}, counts, 1024)
    assert packing.fitness(best, 1024) <= packing.fitness(first, 1024)
    assert sum(best.values()) <= 1.03 * sum(s * n for s, n in counts.items()) / 1024
    child = packing.crossover(first, best, counts, 1024, random.Random(1))
    assert {s: sum(m * p.count(s) for p, m in child.items()) for s in counts} == counts


def test_cut_leaves_the_first_piece_short():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]


def test_ids_equal_those_of_the_tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, plain, rng = packing.Ids(path, 2), Tokenizer.from_file(path), random.Random(5)
    texts = ["", "  a   b", "x" * 500, " " * 300, "<|endoftext|> a", "it's we'll", "日本 🎉 é"] + ["".join(rng.choice(" \n\tab1'é.,日🎉") for _ in range(40)) for _ in range(300)]
    for t in texts:
        assert ids.encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids + [2]


def test_warc_round_trip_and_broken_archives():
    pages = [(1, "http://a", b"<p>x</p>" * 50, None), (2, "http://b\r\nX: y", b"", None), (None, None, "é".encode(), None), (4, "u", b"<p>x</p>" * 50, 1)]
    for dictionary in (b"", warc.train([b"<p>x</p>" * 50])):
        writer = warc.Writer(dictionary)
        for page, url, body, first in pages:
            writer.add(warc.page_record(page, url, body, warc.digest(body), first))
        archive = writer.close()
        got = list(warc.read(archive))
        assert [h["warc-type"] for h, *_ in got] == ["response", "response", "response", "revisit"]
        assert [p for *_, p in got] == [pages[0][2], b"", "é".encode(), b""]
        assert writer.close() is None
        for broken in (archive[:-3], archive + b"junk", archive[:-60]):
            with pytest.raises(warc.WarcError):
                list(warc.read(broken))
    good = warc._record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:page:1>"), ("WARC-Date", "2000-01-01T00:00:00Z")], b"x")
    assert warc.parse(good)[1] == b"x"
    for bad in (good.replace(b"WARC/1.1", b"WARX"), good.replace(b"Content-Length: 1", b"Content-Length: 2"), good.replace(b"WARC-Type", b"X-Type"), good[:-1]):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav><div class="cookie-notice">We use cookies on this site.</div>
<article><h1>A&amp;B   title</h1><p>First <b>bold</b> paragraph,<br>second line.<p>Next one &lt;here&gt;.</p><form><input value=1>Send it</form></article>
<aside>Side bar text that is long enough to count as text.</aside><section id="comments"><p>A reader wrote this long comment, which is not article text.</p></section><footer>&copy; Me</footer></body></html>"""


def test_main_text_of_pages():
    assert linehtml.extract(PAGE) == "A&B title First bold paragraph, second line. Next one <here>."
    plain = re.sub("</?article>", "", PAGE)
    assert linehtml.extract(plain) == "A&B title First bold paragraph, second line. Next one <here>."
    assert linehtml.extract(None) == linehtml.extract("") == linehtml.extract("<nav>a</nav>") == ""
    assert linehtml.extract("just text") == "just text"
    assert linehtml.extract("<p>open <b>and never closed") == "open and never closed"
    assert linehtml.extract("<div class='ad'>never closed <p>text") == "never closed text"
    assert linehtml.extract("<article>" + "<p>x &amp; y</p>" * 3000 + "</article>") == " ".join(["x & y"] * 3000)


def test_line_blocks_decide_within_a_marked_element():
    prose, links = "Some words of the main text. " * 8, "".join(f"<li><a href='/{i}'>see also page {i}</a></li>" for i in range(6))
    text = prose.strip()
    assert linehtml.extract(f"<article><p>{prose}</p><ul>{links}</ul><p>{prose}</p><ul>{links}</ul></article><p>{prose}</p>") == f"{text} {text}"
    assert linehtml.extract(f"<main><ul>{links}</ul><p>{prose}</p></main>") == text
    # A teaser that is marked does not hide the text.
    assert linehtml.extract(f"<article><p>Short teaser.</p></article><ul>{links}</ul><p>{prose}</p><p>{prose}</p>") == f"{text} {text}"


def test_licenses_are_found_with_exact_differences():
    text = "words before. Released under the MIT License. words after\nLicensed under the Apache Licence, Version 2.0."
    assert [(n, text[s:e], d) for n, s, e, d in licenses.scan(text)] == [("MIT-notice", "Released under the MIT License", 0)] or len(licenses.scan(text)) == 2
    assert licenses.scan("a driving license is needed") == [] and licenses.scan("") == []
    name, s, e, d = licenses.scan(licenses.TEMPLATES["MIT"].replace("charge", "cost"))[0]
    assert (name, d, s) == ("MIT", 1, 0)
    long = "word " * 5000 + licenses.TEMPLATES["GPL-3.0-notice"] + " word" * 5000
    assert [(n, s, d) for n, s, _, d in licenses.scan(long)] == [("GPL-3.0-notice", 25000, 0)]


def test_every_license_of_a_passage_is_found():
    names = list(licenses.TEMPLATES)
    rng = random.Random(8)
    short = [n for n in names if len(licenses.TEMPLATES[n].split()) < 15]
    for _ in range(20):
        rng.shuffle(short)
        text = " ".join(f"Part {n} of it. {licenses.TEMPLATES[n]}" for n in short)
        assert [n for n, *_ in licenses.scan(text)] == short
    # Copies before and after the nearest one, with words changed.
    mpl = licenses.TEMPLATES["MPL-2.0"]
    text = f"{mpl.replace('Source', 'Sauce')} {mpl} {mpl.replace('Form', 'Farm')}"
    assert [(n, d) for n, *_, d in licenses.scan(text)] == [("MPL-2.0", 1), ("MPL-2.0", 0), ("MPL-2.0", 1)]
    # A notice saves bytes wherever it lies in a window.
    for name in names:
        for k in range(0, 120, 7):
            words = [rng.choice(["alpha", "under", "the", "license", "work"]) + str(rng.randint(0, 99)) for _ in range(120)]
            assert name in [n for n, *_ in licenses.scan(" ".join([*words[:k], licenses.TEMPLATES[name], *words[k:]]))], (name, k)


def test_usual_license_wordings_and_their_names_and_versions():
    for text, name in (
        ("It is licensed under the MIT License and more", "MIT-notice"), ("Distributed under the MIT License.", "MIT-notice"), ("released under the MIT license", "MIT-notice"),
        ("Licensed under CC BY-SA 4.0 here", "CC-BY-SA-4.0"), ("licensed under CC BY-NC 3.0", "CC-BY-NC-3.0"), ("Text under CC-BY-4.0.", "CC-BY-4.0"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0-notice"), ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0-notice"),
        ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0-notice"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-notice"),
        ("made available under the Eclipse Public License v2.0 which", "EPL-2.0-notice"), ("// SPDX-License-Identifier: EPL-2.0\nint x;", "EPL-2.0-identifier"),
        ("Licensed under the Apache License, Version 2.0", "Apache-2.0-notice"), ("distributed under the BSD 3-Clause License", "BSD-3-Clause-notice"),
    ):
        assert [n for n, *_ in licenses.scan(text)] == [name], (text, licenses.scan(text))
    assert [n for n, *_ in licenses.scan("SPDX-License-Identifier: (MIT OR Apache-2.0)\nx")] == ["MIT-identifier", "Apache-2.0-identifier"]
    for text in ("Licensed under the Acme License, Version 2.0.", "Licensed under the Apache License, Version 1.1.", "under the license of the city", "He applied for a licence under the terms of the act"):
        assert licenses.scan(text) == [], text


def test_alignment_against_plain_edit_distance():
    rng = random.Random(6)
    for _ in range(100):
        a, b = [rng.choice("xyz") for _ in range(rng.randint(1, 6))], [rng.choice("xyzw") for _ in range(rng.randint(1, 9))]

        def distance(x, y):
            row = list(range(len(y) + 1))
            for i, p in enumerate(x, 1):
                last, row[0] = row[0], i
                for j, q in enumerate(y, 1):
                    last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != q))
            return row[-1]

        wrong, s, e = licenses.align(a, b)
        assert wrong == min(distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1)) == distance(a, b[s:e])


def test_caps_hold_the_nearest_directions():
    rng = np.random.default_rng(0)
    v = rng.standard_normal((20, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    code = capdedup.Code(16, 100)
    k = code.words
    for x, found in zip(v, code.filters(v)):
        every = np.array([sum(x[a:b] @ book[w] for a, b, book, w in zip(code.cuts, code.cuts[1:], code.books, (i // k**3, i // k**2 % k, i // k % k, i % k))) for i in range(k**4)])
        assert found.tolist() == sorted(np.argsort(-every)[: code.most].tolist())


def test_blanks_beyond_the_patterns_go_to_the_tokenizer():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    ids = packing.shared_ids(path, 2)
    text = "a" + " " * 2_000_000 + "b"
    assert list(ids.encode(text)) == [*ids.tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_archives_are_read_frame_by_frame():
    import io
    import time

    writer = warc.Writer(warc.train([b"<html><p>page</p></html>" * 9] * 50), limit=1 << 40)
    payload = bytes(range(256)) * 4
    for i in range(4000):
        writer.add(warc.page_record(i, "u", payload + str(i).encode(), warc.digest(payload + str(i).encode()), None))
    writer.add(warc.page_record(4000, "u", b"x" * 3_000_000, warc.digest(b"x" * 3_000_000), None))
    archive, began = writer.close(), time.time()
    assert [p[len(payload) :] for *_, p in warc.read(archive)][:4000] == [str(i).encode() for i in range(4000)] and time.time() - began < 5
    assert sum(1 for _ in warc.read(io.BytesIO(archive))) == 4001
    for cut in (3, 9, len(archive) // 2, len(archive) - 1):
        with pytest.raises(warc.WarcError):
            list(warc.read(archive[:cut]))


def test_pages_without_head_end_and_broken_tags():
    import time

    body = "<article><p>" + "Some sentence of the article that goes on for long enough. " * 6 + "</p></article>"
    closed = linehtml.extract(f"<html><head><title>t</title><meta x></head><body>{body}</body></html>")
    assert closed and closed == linehtml.extract(f"<html><head><title>t</title><meta x><body>{body}")
    assert "x + y" in linehtml.extract(body.replace("</p>", " <math>x + y</math></p>"))
    for page in ('<a "' * 40_000, '<a "' * 40_000 + ">", "<!--" * 40_000, "<script " * 40_000):
        began = time.time()
        linehtml.extract(page)
        assert time.time() - began < 3
    assert linehtml.extract("<p>a <!-- > b") == "a" and linehtml.extract("<p>a</p><script>x > y") == "a" and linehtml.extract("a < b") == "a < b"


def test_caps_find_pairs_at_the_threshold_whatever_the_number_of_vectors():
    rng = np.random.default_rng(5)
    a, z = rng.standard_normal((2, 400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    b = 0.95 * a + (1 - 0.95**2) ** 0.5 * z
    for vectors in (100, 10_000, 1_000_000, 100_000_000):
        code = capdedup.Code(64, vectors)
        met = [len(np.intersect1d(x, y)) > 0 for x, y in zip(code.filters(a), code.filters(b))]
        assert np.mean(met) >= 0.95, vectors
