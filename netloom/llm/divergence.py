"""How far each source's words are from those of the other sources and of its language.

Terms are coded as integers: the terms that a language keeps lie sorted over
range partitions; in a piece of them a term's id is its place (searchsorted),
ids follow the UTF-8 order, and counts of all sources over a piece are one
dense matrix (bincount).  Shares, divergences and ties are integer arithmetic
on those matrices; sums over pieces are left to Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T

LETTER = np.zeros(256, bool)
LETTER[ord("A") : ord("Z") + 1] = True
LETTER[ord("a") : ord("z") + 1] = True
LETTER[128:] = True

#: Text bytes after which a task sums up what it has counted.
FLUSH_BYTES = 16 << 20
#: Cells of one dense matrix, at most; a piece of terms is that over the number of sources.
CELLS = 1 << 19
#: Most groups of a language and source.  The result has a row for each two sources of a language; more groups than this are refused, not cut.
MOST_GROUPS = 50_000
BILLION = 1_000_000_000


def _counts(texts: pa.Array, group: np.ndarray) -> pa.Table:
    """(group, term, n, docs) of one slice: occurrences, and rows that have the term."""
    w = T.Words(texts, LETTER, lower=True)
    length = w.ends - w.starts
    at = np.concatenate([[0], np.cumsum(length)])
    own = np.zeros(len(w.data) + 1, np.int8)
    own[w.starts] += 1
    np.subtract.at(own, w.ends, 1)  # an end may be the next word's start
    packed = w.data[np.cumsum(own[:-1]).astype(bool)]
    terms = pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(packed)))
    coded = terms.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    k = max(1, len(coded.dictionary))
    of = group[w.row] * k + code
    key, n = np.unique(of, return_counts=True)
    seen = np.unique(w.row * k + code)
    docs = np.bincount(np.searchsorted(key, group[seen // k] * k + seen % k), minlength=len(key))
    return pa.table({"group": key // k, "term": coded.dictionary.take(pa.array(key % k)), "n": n.astype(np.int64), "docs": docs.astype(np.int64)})


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term.  Null lang, source and text are ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, int] = {}
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            whole = pa.concat_tables(held).group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
            names = list(groups)
            lang, source = (pa.array([g[i] for g in names], pa.string()) for i in (0, 1))
            of = whole.column("group").combine_chunks()
            out = pa.table({"lang": lang.take(of), "source": source.take(of), "term": whole.column("term").cast(pa.string()), "n": whole.column("n_sum"), "docs": whole.column("docs_sum")})
            yield from out.to_batches(max_chunksize=20_000)

        for batch in T.slices(batches):
            pairs = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            held.append(_counts(batch.column("text"), np.array([groups.setdefault(p, len(groups)) for p in pairs], np.int64)))
            size += batch.column("text").nbytes
            if size >= FLUSH_BYTES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    counted = documents.select(*blank, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, source, n, first) of terms in at least so many documents of their language, sorted over range partitions; `first` marks one row of each term."""
    ranged = counts.repartitionByRange("lang", "term")  # also clusters the windows: no further shuffle
    whole = Window.partitionBy("lang", "term")
    marked = ranged.withColumns({"_docs": F.sum("docs").over(whole), "first": F.row_number().over(whole.orderBy("source")) == 1})
    return marked.where(F.col("_docs") >= least_docs).select("lang", "term", "source", "n", "first").checkpoint()


def share(count: np.ndarray, total: int | np.ndarray) -> np.ndarray:
    """floor(10^9 * count / total), exact in 64 bits for totals up to 9 * 10^15: three digits at a time."""
    whole, rest = np.zeros_like(count), count
    for _ in range(3):
        rest = rest * 1000
        whole = whole * 1000 + rest // total
        rest = rest % total
    return whole


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _pieces(batches: Iterator[pa.RecordBatch], most_terms: dict[str, int]) -> Iterator[tuple[str, list[str], np.ndarray, list[str], np.ndarray]]:
    """(lang, sorted terms, id of each row's term, source of each row, n): runs of whole terms of one language."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def cut(last: bool) -> Iterator[tuple]:
        nonlocal held, rows
        table = pa.Table.from_batches(held).combine_chunks()
        lang, term = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term"))
        at = lang.indices.to_numpy().astype(np.int64) * max(1, len(term.dictionary)) + term.indices.to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))  # of terms
        ends = np.concatenate([starts[1:], [len(at)]])
        whole = len(starts) if last else len(starts) - 1
        a = 0
        langs = lang.indices.to_numpy()[starts]
        while a < whole:
            name = lang.dictionary[int(langs[a])].as_py()
            b = min(whole, a + most_terms[name], a + int(np.searchsorted(langs[a:whole] != langs[a], True)))
            lo, hi = starts[a], ends[b - 1]
            part = table.slice(lo, hi - lo)
            ids = np.searchsorted(starts[a:b], np.arange(lo, hi), "right") - 1
            yield name, term.dictionary.take(pa.array(term.indices.to_numpy()[starts[a:b]])).to_pylist(), ids, part.column("source").to_pylist(), part.column("n").to_numpy()
            a = b
        rest = table.slice(starts[whole] if whole < len(starts) else len(at))
        held, rows = rest.to_batches(), rest.num_rows

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= CELLS:
            yield from cut(False)
    if rows:
        yield from cut(True)


def audit(documents: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of a language and source that occurs.

    A group's share of a kept term is p = 1 + floor(10^9 (count + 2) / (N + 2 V)),
    N its occurrences of kept terms and V their number; the divergence of two
    shares is floor((p - q)^2 / (p + q)).  Part `pair`: the divergence from each
    other source of the language, summed over its kept terms.  Part `term`: the
    `top` terms of the group that it uses more than the language does.  Ranks
    run from 1, by value descending, then item by UTF-8.

    Null text, lang and source are ''.  Rows go by themselves, so repeated rows
    count again and ids are not looked at.  A group without terms has pairs but
    no terms; a language that keeps none has pairs of value 0; an empty table
    gives an empty table.  Extra columns are not looked at.
    """
    T.prepare(documents.sparkSession)
    kept = kept_terms(term_counts(documents), least_docs)
    occur = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("long")).alias("terms"))
    groups = occur.join(totals, ["lang", "source"], "left").na.fill(0, ["total", "terms"]).checkpoint()
    found = groups.orderBy("lang", "source").limit(MOST_GROUPS + 1).collect()
    if len(found) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups of language and source: the pairs of sources are more than can be listed")
    sources: dict[str, dict[str, int]] = {}
    total: dict[str, list[int]] = {}
    terms: dict[str, int] = {}
    for r in found:
        mine = sources.setdefault(r.lang, {})
        mine[r.source] = len(mine)
        total.setdefault(r.lang, []).append(r.total)
        terms[r.lang] = terms.get(r.lang, 0) + r.terms
    most_terms = {lang: max(16, CELLS // len(s)) for lang, s in sources.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[str, str], list[tuple[int, str]]] = {}

        def rows(lang: str, source: str, part: str, items: list[str], values: list[int]) -> pa.RecordBatch:
            n = len(items)
            return pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([source] * n), pa.array([part] * n), pa.array(items, pa.string()), pa.array(values, pa.int64())], names=["lang", "source", "part", "item", "value"])

        for lang, names, ids, of, n in _pieces(batches, most_terms):
            place, listed = sources[lang], list(sources[lang])
            s, v = len(listed), len(names)
            row = np.fromiter((place[x] for x in of), np.int64, len(of))
            count = np.bincount(row * v + ids, weights=n, minlength=s * v).astype(np.int64).reshape(s, v)
            below = np.array(total[lang], np.int64)[:, None] + 2 * terms[lang]
            p = 1 + share(count + 2, below)
            q = 1 + share(count.sum(0) + 2, np.int64(sum(total[lang]) + 2 * terms[lang]))
            for i, source in enumerate(listed):
                yield rows(lang, source, "pair", listed, gap(p[i], p).sum(1).tolist())
                far = np.flatnonzero((count[i] > 0) & (p[i] > q))
                value = gap(p[i, far], q[far])
                first = np.lexsort((far, -value))[:top]
                mine = best.get((lang, source), []) + [(int(value[j]), names[far[j]]) for j in first]
                best[lang, source] = sorted(mine, key=lambda x: (-x[0], x[1].encode()))[:top]
        for (lang, source), mine in best.items():
            if mine:
                yield rows(lang, source, "term", [t for _, t in mine], [x for x, _ in mine])

    made = kept.select("lang", "term", "source", "n").mapInArrow(run, "lang string, source string, part string, item string, value long").checkpoint()
    sums = made.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(other, "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left").na.fill(0, ["value"])
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    parts = [pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(ranked)), made.where("part = 'term'").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)]
    out = [p.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")) for p in parts]
    return out[0].unionByName(out[1])
