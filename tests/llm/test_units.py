"""Parts of the training-data operators against brute force, without Spark."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from leadspark.llm import decontaminate as D
from leadspark.llm import language as L
from leadspark.llm import licenses as S
from leadspark.llm import media as M
from leadspark.llm import ngram_join as N
from leadspark.llm import packing as P
from leadspark.llm import toxicity as X
from leadspark.llm.textnum import ALNUM, NON_SPACE, shingles, steps, word_hashes, words

TEXTS = ["", "a", "A b", "one two three four five", "One two  three\tfour\nfive six", "é ü-x 12", None, "x" * 50, " lead and trail ", "a\x1cb"]


def split(texts, member, limit=20):
    out = []
    for _, _, data, offs in steps(pa.array(texts), limit):
        s, e, at = words(data, offs, member)
        h = word_hashes(data, s, e)
        for r in range(len(at) - 1):
            out.append([(bytes(data[s[i] : e[i]]).decode(), h[i]) for i in range(at[r], at[r + 1])])
    return out


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


@pytest.mark.parametrize(("member", "pattern"), [(NON_SPACE, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")])
def test_words(member, pattern):
    found = split(TEXTS, member)
    assert [[w for w, _ in r] for r in found] == [re.findall(pattern, t or "") for t in TEXTS]
    by_hash = {}
    for r in found:
        for w, h in r:
            assert by_hash.setdefault(h, lower(w)) == lower(w)
    assert len(set(by_hash.values())) == len(by_hash)


def test_shingles():
    rows = ["", "a b", "a b c d e", "a b c d e f g", "b a", "x", "a b c d e"]
    for _, _, data, offs in steps(pa.array(rows)):
        s, e, at = words(data, offs, NON_SPACE)
        sh, sat = shingles(word_hashes(data, s, e), at)
    got = [sh[sat[i] : sat[i + 1]].tolist() for i in range(len(rows))]
    assert [len(g) for g in got] == [0, 1, 1, 3, 1, 1, 1] and got[2] == got[6] and got[2][0] == got[3][0] and got[1] != got[4] and len({x for g in got for x in g}) == 6


def random_sets(n, seed):
    rng = np.random.default_rng(seed)
    common = rng.integers(1, 2**63, 40, dtype=np.uint64) * np.uint64(2)
    out = []
    for _ in range(n):
        base = rng.integers(1, 2**63, rng.integers(1, 120), dtype=np.uint64)
        copies = [base[rng.random(len(base)) > p] for p in (0.0, 0.05, 0.1, 0.14)]
        out += [np.unique(np.concatenate([c, common[rng.random(40) > 0.4], rng.integers(1, 2**63, rng.integers(0, 4), dtype=np.uint64)])) for c in copies]
    many = rng.integers(1, 2**63, 150, dtype=np.uint64)  # a group of near copies that are all of frequent tokens
    out += [np.unique(np.concatenate([many[rng.random(150) > 0.06], rng.integers(1, 2**63, 5, dtype=np.uint64)])) for _ in range(40)]
    return [s for s in out if len(s)]


@pytest.mark.parametrize("frequent", [1e9, 30, 3])
def test_linked_sets_share_an_entry(frequent):
    sets = random_sets(25, 5)
    counts = np.zeros(1 << N.SKETCH_BITS, dtype=np.int64)
    for s in sets:
        np.add.at(counts, (s >> np.uint64(64 - N.SKETCH_BITS)).astype(np.int64), 1)
    entry = [dict(zip(*(x.tolist() for x in N.entries(s, N.grades(counts), int(N.grades(np.array([frequent]))[0]))[::2]), strict=True)) for s in sets]
    linked = 0
    for i, j in combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        n, m = len(sets[i]), len(sets[j])
        most = min(N.most_overlap(n, *(np.frombuffer(N.bitmap(x), np.uint8) for x in (sets[i], sets[j]))), N.most_overlap(m, *(np.frombuffer(N.bitmap(x), np.uint8) for x in (sets[j], sets[i]))))
        assert most >= both
        if N.links(n, m, both):
            linked += 1
            k = -(-3 * (n + m) // 7)
            assert any(entry[i][e] <= n - k + 1 and entry[j][e] <= m - k + 1 for e in entry[i].keys() & entry[j].keys())
    assert linked > 50


def test_size_classes():
    e = N._EDGES
    for n in range(1, 3000):
        a, b = (int(np.searchsorted(e, x, "right")) for x in (n, 4 * n // 3))
        assert b - a <= 1


def test_decontamination_against_every_window():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [text(n) for n in (3, 8, 15, 30, 30, 40)] + ["", "?!"]
    docs = ["", "w1", items[0], f"{text(20)} {items[3]} {text(9)}", f"{text(7)}, {items[2].upper()}! {text(30)}", items[4].replace("w", "W"), text(80)]
    for k in (0, 3, 10, 20):
        cut = items[5].split()
        cut[k] = "other"
        docs.append(" ".join([text(5), *cut, text(5)]))
    docs.append(" ".join([text(10), *items[4].split()[2:], text(10)]))
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    want = {}
    for d, t in enumerate(docs):
        w = tokens(t)
        for i, item in enumerate(items):
            g, m = grams(tokens(item)), len(tokens(item))
            if not m or not w or (m < 5 and m != len(w)):
                continue
            best = 0.0
            for s in range(max(1, len(w) - m + 1)):
                x = grams(w[s : s + m])
                best = max(best, sum((x & g).values()) / sum((x | g).values()))
            if best >= 0.75:
                want[d, i] = best
    index = D.Items(list(range(len(items))), items)
    found = {(r, i): s for r, i, s, _ in D.find(index, pa.array(docs), 0.75)}
    assert found == pytest.approx(want) and len(want) >= 7


def test_blocks_find_all_within_radius():
    rng = random.Random(4)
    texts = [" ".join(f"v{rng.randrange(400)}" for _ in range(20)) for _ in range(300)]
    index = D.Items(list(range(300)), texts)
    distance = lambda x: np.bitwise_count(index.prints ^ x).sum(axis=1)
    for r in range(0, 300, 7):
        bits = np.unpackbits(index.prints[r])
        bits[rng.sample(range(128), D.RADIUS)] ^= 1
        f = np.packbits(bits)
        assert {i for _, i in index.near(20, f[None, :])} == set(np.flatnonzero(distance(f) <= D.RADIUS)) and distance(f)[r] == D.RADIUS


def test_the_index_meets_few_items_and_finds_edited_ones():
    rng = random.Random(8)
    words = lambda n: [f"w{int(30 * rng.paretovariate(0.9)) % 3000}" for _ in range(n)]
    tokens = lambda w: np.array(D.word_hashes(np.frombuffer(" ".join(w).encode(), np.uint8), *(x for x in D.words(np.frombuffer(" ".join(w).encode(), np.uint8), np.array([0, len(" ".join(w).encode())]), D.ALNUM)[:2])))
    items = [words(40) for _ in range(400)]
    index = D.Items(list(range(400)), [" ".join(x) for x in items])
    some = tokens(words(4000))
    prints = D.fingerprints(some, np.arange(0, 3900), 40)
    assert index.agreeing(40, prints).mean() < 0.05
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    met = want = 0
    for r in range(400):
        w = list(items[r])
        if r % 2:  # a run of other words, the most that the similarity allows, or a few single ones
            at = rng.randrange(5, 30)
            w[at : at + 1] = words(1)
        else:
            at = rng.choice((0, 38))
            w[at : at + 2] = words(2)
        if D.weighted_similarity(grams(w), grams(items[r])) >= 0.75:
            want += 1
            met += any(i == r for _, i in index.near(40, D.fingerprints(tokens(w), np.zeros(1, np.int64), 40)))
    assert want > 300 and met >= 0.99 * want


def test_fingerprints_of_steps(monkeypatch):
    h = np.random.default_rng(3).integers(1, 2**63, 500, dtype=np.uint64)
    starts = np.sort(np.random.default_rng(4).choice(470, 200, replace=False))
    whole = D.fingerprints(h, starts, 30)
    monkeypatch.setattr(D, "STEP_WINDOWS", 17)
    assert (D.fingerprints(h, starts, 30) == whole).all()
    with np.errstate(over="ignore"):
        pairs = D.mix(h[:-1] * D._K[0] + h[1:])
    bits = [sum(1 if int(x) >> b & 1 else -1 for x in pairs[starts[5] : starts[5] + 29]) > 0 for b in range(64)]
    assert [bool(x) for x in np.unpackbits(whole[5, :8], bitorder="big").reshape(8, 8).reshape(-1)] == [bits[8 * k + 7 - j] for k in range(8) for j in range(8)]


@pytest.mark.parametrize("most", [8, 16, 100])
def test_plan_is_best_fit_decreasing(most):
    rng = random.Random(most)
    for _ in range(30):
        h = {rng.randint(1, most): rng.randint(1, 40) for _ in range(rng.randint(1, most // 2))}
        seqs, seen = {}, Counter()
        for length, lo, hi, first, per, base in P.plan(h, most):
            for r in range(lo, hi):
                seqs.setdefault(first + (r - lo) // per, []).append((base + (r - lo) % per * length, length))
                seen[length, r] += 1
        assert set(seen) == {(n, r) for n in h for r in range(h[n])} and set(seen.values()) == {1}
        for s in seqs.values():
            at = 0
            for o, n in sorted(s):
                assert o == at
                at += n
            assert at <= most
        bins = []
        for n in sorted(h, reverse=True):
            for _ in range(h[n]):
                fit = [i for i, b in enumerate(bins) if b >= n]
                if fit:
                    bins[min(fit, key=lambda i: bins[i])] -= n
                else:
                    bins.append(most - n)
        assert len(bins) == len(seqs)
    assert P.plan({}, most) == []


def test_ids_and_cuts():
    from tokenizers import Tokenizer

    ranks, js, pattern = P.vocabulary()
    encode, other = P.encoder(ranks, js, pattern), Tokenizer.from_file(js)
    for t in ["", "Hello  world", "é ü 漢字 🙂", "a<|endoftext|>b", "x" * 3000, "\n\n \t1234 'll", "Thntblere of then, edtioner"]:
        assert encode(t) == other.encode(t, add_special_tokens=False).ids
    assert P.cut(1, 4) == [(0, 1)] and P.cut(4, 4) == [(0, 4)] and P.cut(9, 4) == [(0, 1), (1, 4), (5, 4)] and P.cut(8, 4) == [(0, 4), (4, 4)]


def filtered_png(rows, kinds):
    """A PNG whose rows have the given filter types, made row by row."""
    lines, before = bytearray(), [0] * len(rows[0])
    for row, k in zip(rows, kinds, strict=True):
        out = []
        for i, v in enumerate(row):
            a, b, c = row[i - 1] if i else 0, before[i], before[i - 1] if i else 0
            p = a + b - c
            paeth = min([(abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)])[2]
            out.append((v - [0, a, b, (a + b) // 2, paeth][k]) % 256)
        lines += bytes([k, *out])
        before = row
    head = len(rows[0]).to_bytes(4, "big") + len(rows).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    data = zlib.compress(bytes(lines))
    return b"\x89PNG\r\n\x1a\n" + M._chunk(b"IHDR", head) + M._chunk(b"IDAT", data[:5]) + M._chunk(b"IDAT", data[5:]) + M._chunk(b"IEND", b"")


def test_png():
    rng = random.Random(1)
    rows = [[rng.randrange(256) for _ in range(9)] for _ in range(40)]
    kinds = [rng.randrange(5) for _ in rows]
    assert M.decode([filtered_png(rows, kinds)])[0].tolist() == rows
    for raw in (b"", b"a", b"x" * 64, bytes(range(256)) * 33):
        payload = M.pad(raw)
        assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(raw)
        png = M.encode(payload)
        assert M.decode([png])[0].tobytes() == payload
        bad = bytearray(png)
        bad[45] ^= 1
        with pytest.raises((ValueError, zlib.error)):
            M.decode([bytes(bad)])
    assert M.cosine_hash(np.zeros((1, 64), np.uint8)) == bytes(8) and len(M.cosine_hash(np.arange(6400, dtype=np.uint8).reshape(100, 64))) == 8


def test_images_of_a_batch_and_all_filters():
    rng = random.Random(2)
    images = [[[rng.randrange(256) for _ in range(9)] for _ in range(n)] for n in (1, 7, 40, 2, 19)]
    back = M.decode([filtered_png(x, [rng.randrange(5) for _ in x]) for x in images])
    assert [x.tolist() for x in back] == images and M.decode([]) == []
    text = " ".join(f"word{rng.randrange(500)} of lines" for _ in range(3000)).encode()
    ramp = bytes(range(0, 256, 4)) * 20 + bytes(range(64)) + bytes(3 * x % 256 for x in range(64)) * 2
    kinds = {int(k) for x in (text, ramp, bytes(640)) for k in M.filtered(M.encode(M.pad(x)))[:, 0]}
    assert kinds == {0, 1, 2, 3, 4}


def test_cosine_hash_against_the_formula():
    rng = np.random.default_rng(9)
    for h in (1, 5, 32, 33, 70, 100):
        samples = rng.integers(0, 256, (h, 64), dtype=np.uint8)
        cell = lambda i: range(i * h // 32, max((i + 1) * h // 32, i * h // 32 + 1))
        small = [[np.mean([float(samples[min(r, h - 1), 2 * c + d]) for r in cell(i) for d in (0, 1)]) for c in range(32)] for i in range(32)]
        low = []
        for u in range(8):
            for v in range(8):
                low.append(round(sum(small[i][j] * math.cos(math.pi / 32 * (i + 0.5) * u) * math.cos(math.pi / 32 * (j + 0.5) * v) for i in range(32) for j in range(32)), 6))
        middle = float(np.median(low[1:]))
        want = [k > 0 and abs(x - middle) > 1e-4 and x > middle for k, x in enumerate(low)]
        got = np.unpackbits(np.frombuffer(M.cosine_hash(samples), np.uint8)).astype(bool).tolist()
        assert all(a == b for a, b, x in zip(got, want, low, strict=True) if abs(x - middle) > 1e-4)


def test_license_templates():
    a = S.Automaton("licensed under the <<beginOptional>> gnu <<endOptional>> gpl <<var;name=v;original=3;match=2>> only")
    ok = lambda t: a.longest(S.hashes_of(t), 0) == len(S.hashes_of(t))
    assert ok("licensed under the gnu gpl only") and ok("Licensed under the GPL, v3 or only") and ok("licensed under the gpl only")
    assert not ok("licensed under gnu gpl only") and not ok("licensed under the gpl a b c only")
    scanner = S.Scanner(S.PHRASES, S.TEMPLATES)
    one = lambda t: scanner.scan(np.array(S.hashes_of(t), dtype=np.uint64))
    places, runs = one("x All rights reserved. Licensed under CC BY-NC 4.0. Released under the MIT License cc by")
    assert places == [(1, "reserved"), (6, "cc-by"), (16, "cc-by")] and {r[2] for r in runs} == {"cc-by-nc-4.0", "mit"}
    assert one("this work is licensed under the GNU General Public License, version 3")[1][0][2] == "gpl-3.0"
    with pytest.raises(ValueError):
        S.Automaton("<<beginOptional>> a")


def test_language_model():
    texts = {"en": ["the cat sat on the mat and the dog ran to the house"] * 30, "de": ["der hund und die katze sitzen auf dem dach und schlafen"] * 30}
    model = L.Identifier(texts)
    lang, score, rejected = model.predict(pa.array(["the dog and the cat", "die katze und der hund", "", None, "1234 !?", "漢字", "THE DOG"]))
    assert lang[:5] == ["en", "de", "und", "und", "und"] and lang[5] in ("en", "de") and lang[6] == "en"
    assert rejected[2:5].all() and not rejected[:2].any() and (score >= 0).all() and (score <= 1).all()
    assert L.Identifier({}).predict(pa.array(["x"]))[0] == ["und"]


def test_kneser_ney_sums_to_one():
    sym = np.array([ord(c) for c in " abracadabra abra cab"], dtype=np.uint32)
    model = L.KneserNey(sym, np.array([0]))
    letters = sorted({chr(c) for c in sym})
    for before in (" abr", " cab", "abra", "dabr"):
        total = 0.0
        for c in letters:
            s = np.array([ord(x) for x in before + c], dtype=np.uint32)
            grams = [L.gram_hashes(s, n)[-1:] for n in range(1, L.ORDER + 1)]
            ctx = [np.zeros(1, np.uint64)] + [L.gram_hashes(s, n)[-2:-1] for n in range(1, L.ORDER)]
            total += float(np.exp(model.log_probability(grams, ctx))[0])
        assert 0.8 < total < 1.05  # the rest is kept for symbols never seen


def test_toxicity_finds_misspellings():
    rng = random.Random(7)
    plain = [f"word{i}" for i in range(200)]
    clean = [" ".join(rng.choice(plain) for _ in range(rng.randint(5, 60))) for _ in range(300)]
    bad = []
    for _ in range(150):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        w.insert(rng.randrange(len(w)), "scoundrel" + rng.choice(["s", "ly", "ish", "x"]))
        bad.append(" ".join(w))
    model = X.train(clean + bad, [0] * 300 + [1] * 150)
    s = model.score(pa.array(["word1 word2 word3 word4 word6 word8 scoundrelzz word3 word9 word11", "word5 word9 word7", "", None, "word1 " * 3000 + "scoundrel " + "word2 " * 3000]))
    assert s[0] > 10 * s[1] and s[4] > 0.5 and s[1] < 0.3 and s[2] < 0.3 and s[3] < 0.3 and ((s >= 0) & (s <= 1)).all()
    assert 0 <= X.train(["a"], [0]).score(pa.array(["x"]))[0] <= 1 and X.train([], []).score(pa.array([""]))[0] == 0.5


def test_window_max():
    rng = np.random.default_rng(1)
    at = np.array([0, 0, 3, 40, 41, 80, 80])
    value = rng.normal(size=80)
    best, where = X.window_max(value, at)
    for r in range(6):
        v = value[at[r] : at[r + 1]]
        if len(v) <= X.WINDOW:
            assert best[r] == pytest.approx(v.sum() / X.WINDOW)
        else:
            means = [v[i : i + X.WINDOW].mean() for i in range(len(v) - X.WINDOW + 1)]
            assert best[r] == pytest.approx(max(means)) and where[r] == at[r] + int(np.argmax(means))


def test_tokens_stay_frequent_however_full_the_sketch_is():
    sets = random_sets(10, 6)
    counts = np.full(1 << N.SKETCH_BITS, 100_000, dtype=np.int64)  # far above 16 bits
    for s in sets:
        np.add.at(counts, (s >> np.uint64(64 - N.SKETCH_BITS)).astype(np.int64), 2000)
    grades, frequent = N.grades(counts), N.first_frequent(counts)
    made = [N.entries(s, grades, frequent) for s in sets]
    assert sum(hot.any() for _, hot, _ in made) >= 40  # the group of near copies at least
    for i, j in combinations(range(len(sets)), 2):
        n, m, both = len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j]))
        if N.links(n, m, both):
            assert np.intersect1d(made[i][0], made[j][0]).size


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components_in_one_task_and_in_many(spark, one_task):
    from leadspark.llm.graph import components

    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 140)] + [(7, None), (None, None), (5, 5), (200, 201), (201, 200), (203, 201)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), one_task).collect()}
    assert got == {i: 0 for i in range(31)} | {x: 100 for x in range(100, 140)} | {200: 200, 201: 200, 203: 200}
    assert components(spark.createDataFrame([], "a long, b long"), one_task).count() == 0


def brute_runs(template, tokens):
    """{end: first start} of the longest runs that a pattern of the template's words accepts, one for each start."""
    pattern = ""
    for k, part in enumerate(re.split(r"<<(.*?)>>", template)):
        if k % 2 == 0:
            pattern += "".join(f"{w} " for w in re.findall("[a-z0-9]+", part.lower()))
        else:
            pattern += {"beginOptional": "(?:", "endOptional": ")?"}.get(part) or r"(?:\S+ ){0,%s}" % part.rpartition("match=")[2]
    out = {}
    for i in range(len(tokens)):
        ends = [j for j in range(len(tokens), i, -1) if re.fullmatch(pattern, "".join(f"{w} " for w in tokens[i:j]))]
        if ends:
            out.setdefault(ends[0], i)
    return out


def test_templates_against_patterns():
    rng = random.Random(6)
    templates = [
        ("a", "x <<beginOptional>> y z <<endOptional>> <<var;name=n;original=o;match=3>> x y"),
        ("b", "<<var;name=n;original=o;match=12>> <<beginOptional>> z <<endOptional>> y y"),
        ("c", "<<beginOptional>> x <<var;name=n;original=o;match=2>> <<endOptional>> z x"),
    ]
    scanner = S.Scanner({}, templates)
    for _ in range(150):
        tokens = [rng.choice("xyzw") for _ in range(rng.randrange(25))]
        _, runs = scanner.scan(np.array(S.hashes_of(" ".join(tokens)), dtype=np.uint64))
        want = sorted((i, end, label) for label, t in templates for end, i in brute_runs(t, tokens).items())
        assert runs == want, tokens


def test_whole_licenses():
    scanner = S.Scanner(S.PHRASES, S.TEMPLATES)
    labels = lambda t: {x[2] for x in scanner.scan(np.array(S.hashes_of(t), dtype=np.uint64))[1]}
    plain = {}
    for label, template in S.LICENSES:
        text = re.sub(r"<<var;.*?original=(.*?);match=\d+>>", r"\1", re.sub(r"<<beginOptional>>.*?<<endOptional>>", "", template))
        plain.setdefault(label, text)
        assert label in labels(f"before it {text} after it"), label
        tokens = S.hashes_of(text)
        for cut in (tokens[:-1], tokens[:-3] + [1] + tokens[-2:]):  # a word of the end lacks, or is another one
            runs = scanner.scan(np.array(cut, dtype=np.uint64))[1]
            assert not any(x[2] == label and x[1] - x[0] > 12 for x in runs), label
    assert "bsd-3-clause" not in labels(plain["bsd-2-clause"]) and "bsd-2-clause" not in labels(plain["bsd-3-clause"])
    assert "mit" in labels(plain["mit"].replace("THE AUTHORS OR COPYRIGHT HOLDERS", "ACME INC")) and "mit" not in labels(plain["mit"].replace("FREE", "x").replace("free of charge", "for a fee"))
    with pytest.raises(ValueError):
        S.Scanner({}, [("none", "<<var;name=n;original=o;match=3>>")])
