"""Mixing, divergence audit and importance resampling against brute force, on a small table with every odd case in it."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netloom.llm import divergence, mixing, order, resampling

LOWER = {i: i + 32 for i in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, lang, source): nulls, empty and blank texts, one very long text, repeated rows and ids, ties in size."""
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["Éa", "ßü", "日本", "don't", "The", "the", "x1y"]
    out = []
    for i in range(240):
        size = rnd.choice([0, 1, 5, 19, 20, 20, 21, 60, 200])
        pick = vocabulary if i % 3 else vocabulary[:9]
        out.append((i, " ".join(rnd.choice(pick) for _ in range(size)), rnd.choice(["en", "en", "de", "xx"]), rnd.choice(["b", "b", "b", "a", "c", "é", "Z"])))
    out += [(None, None, None, None), (None, "alone", "en", None), (None, None, "en", "b"), (7, "other text of the same id", "en", "b"), (500, " \n\t", "de", "a"), (501, "only once here", "zz", ""), (502, "... 123", "zz", "q")]
    out += [out[9]] * 3 + [out[9][:3] + ("a",)]
    out.append((600, " ".join(rnd.choice(vocabulary) for _ in range(30_000)), "en", "b"))
    out.append((601, "ü" * 70_000 + " end", "en", "c"))
    return out + [out[-2]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """documents with extra columns whose names the operators use inside."""
    wide = [(*r, 1, "k", 2, 3, 4) for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, size long, key string, rank int, n long, weight long").repartition(5)


def water_filling(sizes, weights, total, most):
    """Targets by the rule as told: cut, share the excess again, until none is above."""
    target, free = {}, dict(weights)
    rest = Fraction(total)
    while free:
        share = {s: rest * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = Fraction(most * sizes[s])
            rest -= target[s]
            del free[s]
    return target


def test_mixing_hits_its_targets(spark, rows, docs):
    got = mixing.copies(docs).collect()
    n = lambda t: len(SPACED.findall(t or ""))
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((i, s, n(t)) for i, t, _, s in rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += n(t)
    named = sorted((s for s in sizes if s is not None)) + [None]
    want = water_filling(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(named)}, Fraction(3, 2) * sum(sizes.values()), 2)
    longest, taken = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source])) and 0 <= r.copies <= 2
        rate = r.target / r.source_size if r.source_size else 0
        assert math.floor(rate - 1e-6) <= r.copies <= math.ceil(rate)
        taken[r.source] += r.copies * r["size"]
        longest[r.source] = max(longest[r.source], r["size"])
    assert sum(want.values()) == Fraction(3, 2) * sum(sizes.values()) and any(want[s] == 2 * sizes[s] for s in sizes)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s]
    again = mixing.copies(docs.repartition(2)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))  # whatever the partitions


def test_mixing_is_the_prefix_sum_with_one_offset(docs):
    by = defaultdict(list)
    for r in mixing.copies(docs, seed=4).collect():
        by[r.source].append(r)
    for source, mine in by.items():
        mine.sort(key=lambda r: (r["size"], r.doc_id is not None, r.doc_id or 0))
        each = int(mine[0].target / mine[0].source_size * mixing.UNIT) if mine[0].source_size else 0
        start = int(hashlib.sha256(f"4:{source or ''}".encode()).hexdigest()[:6], 16)
        crossed = [((k + 1) * each + start) // mixing.UNIT - (k * each + start) // mixing.UNIT for k in range(len(mine))]
        group = lambda counts: Counter((r["size"], r.doc_id, c) for r, c in zip(mine, counts))  # noqa: B023, E731
        assert group(crossed) == group([r.copies for r in mine])


def test_mixing_targets_against_the_loop(spark):
    rnd = random.Random(2)
    for _ in range(6):
        sources = [(f"s{i}", rnd.choice([0, 1, 10, 1000, 10**6, 10**13]), rnd.randint(1, 9)) for i in range(rnd.randint(1, 12))]
        for percent, most in ((150, 2), (100, 1), (40, 3), (300, 2)):
            found = mixing.targets(spark.createDataFrame(sources, "source string, source_size long, weight long"), percent, most).collect()
            sizes, weights = {s: n for s, n, _ in sources}, {s: w for s, _, w in sources}
            want = water_filling(sizes, weights, Fraction(percent, 100) * sum(sizes.values()), most)
            assert {r.source: r.target for r in found} == pytest.approx({s: float(x) for s, x in want.items()}, rel=1e-12)


def test_mixed_rows_come_as_often_as_they_are_taken(spark, rows, docs):
    weights = spark.createDataFrame([("b", 1), ("a", 5), (None, 2)], "source string, weight long")
    taken = Counter()
    for r in mixing.copies(docs, weights).collect():
        taken[r.doc_id, r.source, r.text_hash] += r.copies
    mixed = mixing.mix(docs, weights)
    assert mixed.columns == docs.columns
    assert Counter((r.doc_id, r.source, r.h) for r in mixed.withColumn("h", F.xxhash64("text")).select("doc_id", "source", "h").collect()) == +taken
    nothing = docs.where("doc_id < 0")
    assert mixing.copies(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_mixing_runs_no_python(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_prefix_sums_of_a_hot_group(spark):
    rnd = random.Random(1)
    table = [(0 if rnd.random() < 0.7 else rnd.randint(1, 5), rnd.randint(0, 9), i, rnd.randint(0, 3)) for i in range(3000)]
    frame = spark.createDataFrame(table, "g int, x int, i int, v long").repartition(7)
    want, sums = {}, Counter()
    for g, x, i, v in sorted(table, key=lambda r: (r[0], -r[1], r[2])):
        sums[g] += v
        want[i] = sums[g]
    got = order.prefix_sums(frame, ["g"], [F.col("x").desc(), F.col("i")], "v", "upto").collect()
    assert {r.i: r.upto for r in got} == want
    spread = order.prefix_sums(frame, ["g"], [F.col("x").desc(), F.col("i")], "v", "upto").where("g = 0").select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread > 1


def audit_by_hand(rows, least, top):
    docs = [(lang or "", source or "", LETTERS.findall((text or "").translate(LOWER))) for _, text, lang, source in rows]
    seen, counts = Counter(), defaultdict(Counter)
    for lang, source, words in docs:
        seen.update((lang, w) for w in set(words))
        counts[lang, source].update(words)
    out = []
    for lang, source in counts:
        kept = sorted((w for (x, w), n in seen.items() if x == lang and n >= least), key=str.encode)
        total = lambda c: sum(c[w] for w in kept)  # noqa: B023, E731
        p = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (total(c) + 2 * len(kept)) for w in kept}  # noqa: B023, E731
        f = lambda a, b: (a - b) ** 2 // (a + b)
        mine = p(counts[lang, source])
        pairs = []
        for x, other in counts:
            if x == lang and other != source:
                q = p(counts[x, other])
                pairs.append((-sum(f(mine[w], q[w]) for w in kept), other.encode()))
        whole = p(sum((c for (x, _), c in counts.items() if x == lang), Counter()))
        terms = [(-f(mine[w], whole[w]), w.encode()) for w in kept if counts[lang, source][w] and mine[w] > whole[w]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            out += [(lang, source, part, item.decode(), -v, k) for k, (v, item) in enumerate(sorted(found)[:most], 1)]
    return out


def test_divergence_audit(spark, rows, docs, monkeypatch):
    want = audit_by_hand(rows, 10, 10)
    assert {r[2] for r in want} == {"pair", "term"} and any(r[0] == "zz" and r[4] == 0 for r in want)
    columns = ("lang", "source", "part", "item", "value", "rank")
    assert Counter(tuple(r[c] for c in columns) for r in divergence.audit(docs).collect()) == Counter(want)
    few = audit_by_hand(rows, 2, 3)
    assert Counter(tuple(r[c] for c in columns) for r in divergence.audit(docs, least_docs=2, top=3).collect()) == Counter(few)
    assert divergence.audit(docs.where("doc_id < 0")).count() == 0
    assert divergence.audit(docs.where("doc_id = 3")).where("part = 'pair'").count() == 0


def test_pieces_of_terms_follow_their_order():
    """Whole terms in runs of one language, with ids in UTF-8 order, however the batches are cut."""
    table = [(lang, term, s, n) for lang in ("a", "b") for term in sorted(["x", "y", "é", "日", "xa"], key=str.encode) for s, n in (("s", 3), ("t", 2))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*table)], names=["lang", "term", "source", "n"])
    for cells in (1, 3, 7, 10**6):
        old, divergence.CELLS = divergence.CELLS, cells
        try:
            pieces = list(divergence._pieces(iter([batch.slice(i, 3) for i in range(0, 20, 3)]), {"a": 2, "b": 3}))
        finally:
            divergence.CELLS = old
        assert all(len(names) <= {"a": 2, "b": 3}[lang] for lang, names, *_ in pieces)
        assert [(lang, names[i], s, int(n)) for lang, names, ids, of, counts in pieces for i, s, n in zip(ids, of, counts)] == table


def test_shares_are_exact_where_products_are_not():
    rnd = random.Random(3)
    count = [rnd.randint(0, 10**15) for _ in range(500)] + [0, 1, 2]
    total = 10**15 + 7
    assert divergence.share(np.array(count), total).tolist() == [10**9 * c // total for c in count]


def features_of(text, n):
    words = ALNUM.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def resample_by_hand(rows, target, n, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text, *_ in rows:
        s.update(map(bucket, features_of(text, n)[1]))
    for text in target:
        t.update(map(bucket, features_of(text, n)[1]))
    total, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets))))
    out = []
    for doc_id, text, *_ in rows:
        words, found = features_of(text, n)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = percent * len(able) // 100
    ranks = [(r, k if k <= drawn else None) for k, r in enumerate(able, 1)] + [(r, None) for r in out if r[4] < least]
    return Counter((*r[:4], k) for r, k in ranks)


@pytest.mark.parametrize("n,buckets,percent", [(1, 10_000, 10), (3, 50, 35)])
def test_importance_resampling(spark, rows, docs, n, buckets, percent):
    target = [None, "", "W1 w2 w3 don't", "日本 ßü the the the", "never seen"]
    bench = spark.createDataFrame([(i, t, "k") for i, t in enumerate(target)], "item_id long, text string, key string")
    want = resample_by_hand(rows, target, n, buckets, percent, 20)
    got = resampling.scores(docs, bench, n=n, buckets=buckets, percent=percent)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()) == want
    drawn = resampling.resample(docs, bench, n=n, buckets=buckets, percent=percent)
    assert drawn.columns == docs.columns and {r.doc_id for r in drawn.collect()} == {k[0] for k in want if k[4]}
    assert resampling.scores(docs.where("doc_id < 0"), bench).count() == 0
    assert resampling.scores(docs.limit(30), bench.where("item_id < 0")).count() == 30


@pytest.mark.parametrize("n,size", [(1, 10), (2, 40), (4, 300)])
def test_chunks_own_each_feature_once(n, size):
    rnd = random.Random(n)
    text = " ".join(rnd.choice(["a", "Bé", "c" * 80, "日本", "-", "x.y"]) for _ in range(400))
    found = []
    for chunk, owned, raw in resampling.split(pa.array([text]), n, size):
        f = resampling.Features(pa.array([raw.decode()]), np.array([owned]), n, 1 << 31)
        found += f.bucket.tolist()
    assert chunk > 3 and Counter(found) == Counter(zlib.crc32(x.encode()) % (1 << 31) for x in features_of(text, n)[1])
