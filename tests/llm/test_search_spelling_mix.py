"""Lexical search, spelling variants and source mixing against brute force, on hard rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from leadspark.llm import lexical, mixing, queries, spelling

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, source string, rank string, item long, word string, size string, sid string, n string"
ROWS = [
    (1, "Alpha beta gamma beta", "a"),
    (1, "Alpha beta gamma beta", "a"),
    (1, "other words under the same id", "a"),
    (None, "alpha alpha delta", None),
    (2, None, "b"),
    (3, "", "b"),
    (4, " \n\t", "b"),
    (5, "beta " * 30000 + "ende", "c"),
    (6, "ñandú Ñandú straße x1 漢字 beta", None),
    (7, "gamma", ""),
    (8, "beta gamma", "c"),
    (9, "gamma beta", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 1, "y", "z", "s", "n") for r in ROWS], KIND)


def low(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute_search(docs, items, k):
    texts = [Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t))) for _, t in docs]
    sizes = [sum(t.values()) for t in texts]
    n, total = sum(x > 0 for x in sizes), sum(sizes)
    df = Counter(w for t in texts for w in t)
    out = []
    for item_id, text in items:
        found = []
        for (doc_id, _), t, size in zip(docs, texts, sizes, strict=True):
            score = 0
            for w in set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(text))) & set(t):
                m = 100 - 50 + 50 * size * n // total
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * t[w] // (1000 * t[w] + 20 * m))
            if score:
                found.append((-score, doc_id is None, doc_id))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item_id, i + 1, d, -s) for i, (s, _, d) in enumerate(found[:k])]
    return sorted(out, key=repr)


def test_search_of_hard_rows(spark, docs):
    items = [(1, "BETA gamma"), (2, None), (3, ""), (4, "ñandú"), (None, "alpha beta"), (1, "unknown words the"), (1, "BETA gamma")]
    table = spark.createDataFrame([(*i, 1, "r") for i in items], "item_id long, text string, doc_id long, rank string")
    assert rows_of(lexical.search(docs, table, k=3)) == brute_search([r[:2] for r in ROWS], items, 3)
    assert lexical.search(docs.limit(0), table).count() == 0 == lexical.search(docs, table.limit(0)).count()


def test_search_by_tiers(spark):
    """Some items are proven by upper tiers, others fall through; many shards, ties, and terms that nearly all documents hold."""
    rng = random.Random(4)
    common, rare = [f"c{i}" for i in range(8)], [f"r{i}" for i in range(300)]
    docs = []
    for i in range(600):
        words = [rng.choice(common) for _ in range(rng.randrange(5, 60))] + rng.sample(rare, 3)
        if i % 5 == 0:
            words += [f"planted{j}" for j in range(12)]
        docs.append((i // 2, " ".join(words)))
    items = [(0, " ".join(f"planted{j}" for j in range(12)) + " c1"), (1, "c0 c1 c2 c3"), (2, "r5 r6 c7"), (3, "c4 " + " ".join(rare[:20]))]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    (terms,) = lexical.passes(spark.createDataFrame(items, "item_id long, text string"))
    lexical.small_batches(spark)
    for candidates in (4, 1000):
        found, proved = lexical._search(table, terms, 20, (1 / 2, 1 / 4, 1 / 16), candidates)
        assert 0 < sum(proved) < len(items)
        assert rows_of(found) == brute_search(docs, items, 20)


def test_bounds_hold_in_every_tier(spark):
    """No document's score lies outside its bounds, whatever tiers were read."""
    import pyarrow as pa

    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    (terms,) = lexical.passes(spark.read.parquet(f"{SF}/benchmark.parquet"))
    lexical.small_batches(spark)
    rows, residual = lexical.index(docs, spark.sparkContext.broadcast(terms), len(terms.known))
    table = pa.Table.from_pandas(rows.toPandas()).to_batches()
    for b in table:
        for r in range(b.num_rows):
            shards = [lexical.Shard(b, r, t) for t in range(len(lexical.TIERS) + 1)]
            for own in terms.of[:10]:
                exact, same = shards[-1].sums(own, residual[-1])
                assert (exact == same).all()
                for t, s in enumerate(shards):
                    lower, upper = s.sums(own, residual[t])
                    assert (lower <= exact).all() and (exact <= upper).all()


def edit_of_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_near_pairs():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(3, 7))) for _ in range(500)})
    got = []
    for length in range(2, 8):
        own = [w for w in words if len(w) in (length, length + 1)]
        for lo, hi in ((0, length // 2), (length // 2, length + 1)):
            x, y = spelling.near_pairs([w.encode("latin-1") for w in own], length, lo, hi)
            got += [(own[i], own[j]) for i, j in zip(x, y, strict=True)]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if a != b and edit_of_one(a, b)}


@pytest.mark.parametrize("n", [0, 1, 2, 7, 64, 100])
def test_wavelet_tree(n):
    rng = np.random.default_rng(n)
    values = rng.permutation(n)
    a, c = rng.integers(0, n + 1, 50), rng.integers(0, n + 1, 50)
    b, d = np.maximum(a, rng.integers(0, n + 1, 50)), np.maximum(c, rng.integers(0, n + 1, 50))
    query, found = spelling.WaveletTree(values).report(a, b, c, d)
    assert sorted(zip(query.tolist(), found.tolist(), strict=True)) == [(q, v) for q in range(50) for v in sorted(values[a[q] : b[q]]) if c[q] <= v < d[q]]


def brute_variants(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in counts if v != w and abs(len(v) - len(w)) <= 1 and edit_of_one(v, w)] for w in counts}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out, key=repr)


def spelled_texts():
    rng = random.Random(8)
    rows = []
    for base, n in (("abcdefgh", 300), ("straße", 60), ("aaaaaa", 90), ("x" * 3000, 12), ("ñandú", 40)):
        for i in range(n):
            w = base
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                at, c = rng.randrange(len(w)), rng.choice("abß")
                w = rng.choice((w[:at] + c + w[at + 1 :], w[:at] + w[at + 1 :], w[:at] + c + w[at:]))
            rows.append((i, f"{w.title() if i % 3 == 0 else w}, {w}! {w}"))
    return rows


@pytest.mark.parametrize("block", [spelling.BLOCK_LETTERS, 60])
def test_variants(spark, block, monkeypatch):
    monkeypatch.setattr(spelling, "FEW_WORDS", 8)
    rows = [r[:2] for r in ROWS] + spelled_texts()
    found = spelling.variants(spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, word string, n long"), block)
    assert rows_of(found) == brute_variants(rows)


def test_variants_of_hard_rows(spark, docs):
    assert rows_of(spelling.variants(docs)) == brute_variants([r[:2] for r in ROWS])
    assert spelling.variants(docs.limit(0)).count() == 0


def test_blocks_divide(spark, monkeypatch):
    """A large group is halved until its words share letters, and no pair is lost or seen twice."""
    monkeypatch.setattr(spelling, "FEW_WORDS", 3)
    words = [f"{a}{b}{c}zzz" for a in "abcd" for b in "abcd" for c in "abcd"]
    dealt = spelling.blocks(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), 40).collect()
    assert max(r["hi"] - r["lo"] for r in dealt) < 7
    groups = defaultdict(list)
    for r in dealt:
        groups[r["length"], r["lo"], r["hi"], r["key"]].append(r["word"])
    got = [(own[i], own[j]) for (length, lo, hi, _), own in groups.items() for i, j in zip(*spelling.near_pairs([w.encode() for w in own], length, lo, hi), strict=True)]
    assert sorted(got) == sorted((a, b) for a in words for b in words if a != b and edit_of_one(a, b))


def test_roots(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(20)] + [("v", "w3")], "word string, form string")
    assert {r["root"] for r in spelling.roots(chain).collect()} == {"w20"}


def brute_mix(rows, weights):
    """rows (doc_id, text, source, odds): samples by sorting."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows]
    own = defaultdict(int)
    for s, r in zip(size, rows, strict=True):
        own[r[2]] += s
    target, open_, left = {}, set(own), sum(own.values())
    while True:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * left > 3 * own[s] * total}
        if not over:
            break
        for s in over:
            target[s] = float(3 * own[s])
            left -= 3 * own[s]
        open_ -= over
    for s in open_:
        target[s] = weights[s] * (left / max(1, total))
    out = []
    for source in own:
        mine = []
        for i, (doc_id, text, s, odds) in enumerate(rows):
            if s == source:
                seed = f"{'' if doc_id is None else doc_id}:{hashlib.md5((text or '').encode()).hexdigest()}"
                u = (int(hashlib.md5(seed.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                q = u / (1 - u) / odds(size[i])
                mine.append((math.floor(q / (1 + q) * 2**52), i))
        whole = int(target[source] // own[source]) if own[source] else 0
        rest, chosen = target[source] - whole * own[source], set()
        for k in range(3):
            ranks = defaultdict(list)
            for rank, i in mine:
                if size[i] and i not in chosen and (not k or size[i] <= rest * (2 if k == 2 else 1)):
                    ranks[rank].append(i)
            if rest <= 0:
                break
            left = rest
            for rank in sorted(ranks):
                words = sum(size[i] for i in ranks[rank])
                if words <= left or k == 2 and words - left < left:
                    chosen |= set(ranks[rank])
                if words > left:
                    break
                left -= words
            rest = left
        for _, i in mine:
            copies = whole + (i in chosen)
            out.append((rows[i][0], size[i], source, own[source], target[source], copies, copies * size[i]))
    return sorted(out, key=repr)


def rounded(rows):
    return [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows]


def long_odds(size):
    return 1 + min(size, 1000) / 1000.0


def test_mix_of_hard_rows(spark, docs):
    weights = {"": 1, "a": 2, "b": 3, "c": 1, None: 2}
    found = mixing.mix(docs)
    assert found.columns == ["doc_id", "size", "source", "source_size", "target", "copies", "taken"]
    assert rounded(rows_of(found)) == rounded(brute_mix([(*r, long_odds) for r in ROWS], weights))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_with_capped_and_hot_sources(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else f"s{rng.randrange(12):02}" if i % 50 else rng.choice(("tiny1", "tiny2", None))
        rows.append((i, " ".join("w" for _ in range(rng.choice((0, 1, 3, 20, 90)))), source))
    names = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    weights = {s: 1 + i % 3 for i, s in enumerate(names)}
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    found = rows_of(mixing.mix(table))
    assert rounded(found) == rounded(brute_mix([(*r, long_odds) for r in rows], weights))
    taken, target, size = Counter(), {}, {}
    for _, n, source, own, want, copies, words in found:
        taken[source] += words
        target[source], size[source] = want, own
        assert copies <= 3 and words == copies * n
    assert any(target[s] == 3 * size[s] for s in target) and abs(sum(target.values()) - sum(size.values())) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 45 for s in target)
    own = {s: 7 if s == "tiny1" else 2 for s in names if s != "s03"}
    given = spark.createDataFrame([(*x, 1) for x in own.items()], "source string, weight long, target long")
    found = rows_of(mixing.mix(table, given, odds=mixing.F.lit(1.0)))
    assert rounded(found) == rounded(brute_mix([(*r, lambda size: 1.0) for r in rows], own | {"s03": 0}))


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_spelling_variants", "op13_source_mix"])
def test_queries_agree_with_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = ", ".join(sorted(df.columns))
    want = c.sql(f"select {cols} from ({queries.oracle_sql()[name]})").fetchall()
    assert rounded(rows_of(df.select(*sorted(df.columns)))) == rounded(sorted((tuple(r) for r in want), key=repr))
