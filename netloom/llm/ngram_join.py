"""N-gram Jaccard join of a corpus with itself, by T-occurrence search.

A document is the set of its distinct word shingles.  Equal sets are one
*owner* (a 64-bit hash of the set) from the start, so exact copies of any
number cost one.  The rest goes through inverted lists:

1.  index   Every (shingle, owner) goes to a bucket of shingles, in binary
            blocks; lists with one owner go at once.  Shingles that over a
            hundredth of the owners of many places share (`hot`, found in the
            first pass) skip the lists and go last in the order by rarity.
2.  owners  What is left comes back by owner.  Two sets share only shared
            shingles, so an owner with under 75 % of them is linked with
            nothing, and shared shingles and set sizes are all that a check
            needs.
3.  search  An owner's necessary prefix in the order by rarity names its
            candidates.  It first meets the owner that leads most of its prefix
            lists (a star, not all pairs of a list), then, twice over, the
            lists that still hold several components are searched: with another
            leader, then for every pair between components that sizes and
            places allow.
4.  check   `t_occurrence` takes one query set and a block of sets: short
            inverted lists are heap-merged, long ones binary-probed
            (DivideSkip), and what reaches the overlap is a link.
5.  count   Links lie inside components, so each component's sets are dealt
            into parts of PART and every two parts are searched by
            `t_occurrence`: a row an owner and part, never one a pair.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .graph import components

#: Weight of DivideSkip's rule for how many lists count as long.
MU = 0.0085
#: Sets that one search holds at once.
BLOCK = 512
#: Sets of one part of a component, when links are counted.
PART = 256
#: A shingle is hot in a slice if so many of its owners, at least HOT_LEAST, have it.
HOT_SHARE, HOT_LEAST = 0.02, 8
#: Hot shingles and hot copies make at least this share of the corpus, so they are few.
GLOBAL_SHARE = 0.01
#: Entries of one index task, and of one flush of a mapper.
TASK_ENTRIES, FLUSH_ENTRIES = 4_000_000, 1_000_000


def _sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: set size and owner of each row; row and hash of each distinct shingle, in that order."""
    w = T.Words(batch.column("text"), T.NON_SPACE, lower=True)
    first, gram = w.shingles(k)
    row = w.row[first]
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        whole = np.array([T.shingle_hash([w.hash[[j]] for j in range(w.first[r], w.first[r + 1])])[0] for r in short], np.uint64)
        row, gram = np.concatenate([row, short]), np.concatenate([gram, whole])
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    row, gram = row[new], gram[new]
    size = np.bincount(row, minlength=batch.num_rows)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(gram) + 1, np.uint64)
        np.cumsum(T._mix(gram ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1:])
        at = np.concatenate([[0], np.cumsum(size)])
        owner = T._mix(sums[at[1:]] - sums[at[:-1]] + size.astype(np.uint64)).view(np.int64)
    return size, owner, row, gram


def _first_pass(k: int):
    """Of each document the set's size and owner; of each slice the shingles that many of its owners share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            size, owner, row, gram = _sets(batch, k)
            once = np.zeros(len(size), bool)
            once[np.unique(owner, return_index=True)[1]] = True
            once &= size > 0
            own = np.sort(gram[once[row]])
            edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])) if len(own) else np.zeros(1, np.int64)
            times = np.diff(edge)
            many = np.flatnonzero(times >= max(HOT_LEAST, HOT_SHARE * once.sum()))
            n, m = len(size), len(many)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column("doc_id").cast(pa.int64()), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([pa.array(size, pa.int64()), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([pa.array(owner, pa.int64(), mask=size == 0), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(own[edge[many]].view(np.int64), pa.int64())]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(times[many], pa.int64())]),
                ],
                names=["doc_id", "n_shingles", "owner", "gram", "times"],
            )

    return run


def _pack(owner: np.ndarray, gram: np.ndarray, df: np.ndarray | None = None) -> bytes:
    """Entries sorted by owner, as runs of up to 255: owners and lengths of the runs, then the shingles, and owners that have them (65535: at least so many)."""
    new = np.concatenate([[True], owner[1:] != owner[:-1]])
    edge = np.flatnonzero(new)
    runs = np.diff(np.append(edge, len(owner)))
    if runs.max() > 255:
        edge = np.flatnonzero((np.arange(len(owner)) - np.repeat(edge, runs)) % 255 == 0)
        runs = np.diff(np.append(edge, len(owner)))
    head = np.array([len(edge), len(owner)], np.uint32).tobytes()
    tail = b"" if df is None else np.minimum(df, 65535).astype(np.uint16).tobytes()
    return b"".join([head, owner[edge].tobytes(), runs.astype(np.uint8).tobytes(), gram.tobytes(), tail])


def _unpack(block: bytes, with_df: bool):
    runs, n = np.frombuffer(block, np.uint32, 2).tolist()
    at = 8
    owner = np.frombuffer(block, np.int64, runs, at)
    times = np.frombuffer(block, np.uint8, runs, at + 8 * runs)
    at += 9 * runs
    gram = np.frombuffer(block, np.uint64, n, at)
    df = np.frombuffer(block, np.uint16, n, at + 8 * n) if with_df else None
    return np.repeat(owner, times), gram, df


#: Kinds of blocks: entries on the way to their lists, entries on the way to their owners, sizes of owners.
LISTS, OWNERS, SIZES = range(3)


def _dealt(bucket: np.ndarray, kind: int, owner: np.ndarray, gram: np.ndarray, df: np.ndarray | None = None) -> pa.RecordBatch:
    """A block for each bucket; of SIZES, gram holds the sizes."""
    order = np.lexsort((owner, bucket))
    bucket, owner, gram = bucket[order], owner[order], gram[order]
    df = df[order] if df is not None else None
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() if len(bucket) else []
    ends = [*edge[1:], len(bucket)]
    blocks = [_pack(owner[a:b], gram[a:b], df[a:b] if df is not None else None) for a, b in zip(edge, ends)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[edge], pa.int32()), pa.array([kind] * len(edge), pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "kind", "block"])


def _by_owner(owner: np.ndarray, buckets: int) -> np.ndarray:
    return (owner.view(np.uint64) % np.uint64(buckets)).astype(np.int32)


def _index_pass(k: int, buckets: int, hot: np.ndarray, copied: dict[int, int]):
    """Blocks of (shingle, owner) by bucket of the shingle; those of hot shingles, and the owners' sizes, by bucket of the owner."""

    def flush(parts):
        owner, gram = (np.concatenate(x) for x in zip(*parts))
        is_hot = np.zeros(len(gram), bool)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, gram), len(hot) - 1)
            is_hot = hot[at] == gram
        cold = ~is_hot
        if cold.any():
            yield _dealt((gram[cold] % np.uint64(buckets)).astype(np.int32), LISTS, owner[cold], gram[cold])
        if is_hot.any():
            own = owner[is_hot]
            yield _dealt(_by_owner(own, buckets), OWNERS, own, gram[is_hot], np.full(len(own), 65535))
        edge = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        own = owner[edge]
        yield _dealt(_by_owner(own, buckets), SIZES, own, np.diff(np.append(edge, len(owner))).astype(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in T.slices(batches):
            size, owner, row, gram = _sets(batch, k)
            once = np.zeros(len(size), bool)
            once[np.unique(owner, return_index=True)[1]] = True
            if copied:
                ids = batch.column("doc_id").to_pylist()
                for r in np.flatnonzero(once):
                    if (lead := copied.get(int(owner[r]))) is not None:
                        same = np.flatnonzero(owner == owner[r])
                        once[r] = any(ids[x] == lead for x in same)
            take = once[row]
            parts.append((owner[row[take]], gram[take]))
            held += int(take.sum())
            if held >= FLUSH_ENTRIES:
                yield from flush(parts)
                parts, held = [], 0
        if held:
            yield from flush(parts)

    return run


def _lists(buckets: int):
    """Inverted lists of a task's shingles: entries of those with several owners, by bucket of the owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cold = []
        for batch in batches:
            passed = batch.column("kind").to_numpy() != LISTS
            if passed.any():
                yield batch.filter(pa.array(passed))
            cold += [_unpack(b, False)[:2] for b in batch.filter(pa.array(~passed)).column("block").to_pylist()]
        if not cold:
            return
        owner, gram = (np.concatenate(x) for x in zip(*cold))
        del cold
        ordered = np.sort(gram)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        seen = np.zeros(1 << 24, bool)
        seen[(twice >> np.uint64(40)).astype(np.int64)] = True
        keep = seen[(gram >> np.uint64(40)).astype(np.int64)]
        owner, gram = owner[keep], gram[keep]
        order = np.lexsort((owner, gram))
        owner, gram = owner[order], gram[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
        owner, gram = owner[new], gram[new]
        if not len(gram):
            return
        edge = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        df = np.diff(np.append(edge, len(gram)))
        df = np.repeat(df, df)
        keep = df > 1
        own, gram, df = owner[keep], gram[keep], df[keep]
        for a in range(0, len(own), FLUSH_ENTRIES):
            cut = slice(a, a + FLUSH_ENTRIES)
            yield _dealt(_by_owner(own[cut], buckets), OWNERS, own[cut], gram[cut], df[cut])

    return run


def _shared(num: int, den: int):
    """Of each owner its shared shingles from rare to frequent, if they can reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, sizes = [], []
        for batch in batches:
            for kind, block in zip(batch.column("kind").to_pylist(), batch.column("block").to_pylist()):
                (sizes if kind == SIZES else entries).append(_unpack(block, kind != SIZES))
        if not entries:
            return
        owner, gram, df = (np.concatenate(x) for x in zip(*entries))
        known, size = (np.concatenate(x) for x in zip(*(x[:2] for x in sizes)))
        order = np.lexsort((gram, df, owner))
        owner, gram = owner[order], gram[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
        owner, gram = owner[new], gram[new]
        edge = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        times = np.diff(np.append(edge, len(owner)))
        order = np.argsort(known)
        full = size[order[np.searchsorted(known, owner[edge], sorter=order)]].astype(np.int64)
        need = -(-num * full // den)
        good = times >= need
        keep = np.repeat(good, times)
        at = np.concatenate([[0], np.cumsum(times[good])])
        owners, full, prefix, gram = owner[edge][good], full[good], (times - need + 1)[good], gram[keep].view(np.int64)
        for a in range(0, len(owners), 2000):
            b = min(a + 2000, len(owners))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(owners[a:b], pa.int64()),
                    pa.array(full[a:b], pa.int64()),
                    pa.array(prefix[a:b], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(at[a : b + 1] - at[a], pa.int32()), pa.array(gram[at[a] : at[b]], pa.int64())),
                ],
                names=["owner", "n", "prefix", "grams"],
            )

    return run


def t_occurrence(query: np.ndarray, n_query: int, sets: list[tuple[int, int, np.ndarray]], num: int, den: int) -> list[int]:
    """Owners of `sets` (owner, size, shingles) whose overlap with the query reaches num/den of the union.

    `query` holds the query's shared shingles and n_query its full size.
    """
    if not sets or not len(query):
        return []
    need = np.array([-(-num * (n_query + n) // (num + den)) for _, n, _ in sets])
    ordered = np.sort(query)
    which = np.repeat(np.arange(len(sets)), [len(g) for _, _, g in sets])
    grams = np.concatenate([g for _, _, g in sets])
    at = np.minimum(np.searchsorted(ordered, grams), len(ordered) - 1)
    hit = ordered[at] == grams
    order = np.lexsort((which[hit], at[hit]))
    token, ids = at[hit][order], which[hit][order]
    edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else []
    lists = sorted(np.split(ids, edge[1:]) if len(edge) else [], key=len)
    least = int(need.min())
    if len(lists) < least:
        return []
    longest = len(lists[-1])
    n_long = min(least - 1, int(least / (MU * math.log2(longest + 1) + 1)), len(lists) - 1)
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    counts: dict[int, int] = {}
    last, run = -1, 0
    for i in heapq.merge(*[x.tolist() for x in short]):  # equal ids come together
        if i == last:
            run += 1
            continue
        if run >= least - n_long and last >= 0:
            counts[last] = run
        last, run = i, 1
    if run >= least - n_long and last >= 0:
        counts[last] = run
    if not counts:
        return []
    ids = np.fromiter(counts, np.int64, len(counts))
    total = np.fromiter(counts.values(), np.int64, len(counts))
    for x in long:
        at = np.minimum(np.searchsorted(x, ids), len(x) - 1)
        total += x[at] == ids
    return [sets[i][0] for i in ids[total >= need[ids]].tolist()]


def _searched(num: int, den: int):
    """Rows sorted by query, the query's own row first: links (a, b) that the search finds, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, block = None, []

        def found():
            got = t_occurrence(query[2], query[1], block, num, den) if query and block else []
            return [pa.RecordBatch.from_arrays([pa.array([query[0]] * len(got), pa.int64()), pa.array(got, pa.int64())], names=["a", "b"])] if got else []

        for batch in batches:
            lists = batch.column("grams")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i, (q, role, owner, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("query", "role", "owner", "n")))):
                grams = flat[at[i] : at[i + 1]]
                if role == 0:
                    yield from found()
                    query, block = (q, n, grams.copy()), []
                    continue
                block.append((owner, n, grams.copy()))
                if len(block) >= BLOCK:
                    yield from found()
                    block = []
        yield from found()

    return run


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (query, owner) those that are similar, as (a, b)."""
    salt = F.pmod(F.xxhash64("owner"), F.lit(64)).cast("int").alias("salt")
    pairs = pairs.select("query", "owner", salt)
    rows = pairs.join(sets, "owner").select("query", "salt", F.lit(1).alias("role"), "owner", "n", "grams")
    asks = pairs.select("query", "salt").distinct().withColumn("owner", F.col("query")).join(sets, "owner").select("query", "salt", F.lit(0).alias("role"), "owner", "n", "grams")
    return rows.unionByName(asks).repartition("query", "salt").sortWithinPartitions("query", "salt", "role").mapInArrow(_searched(num, den), "a long, b long").checkpoint()


def _counted(num: int, den: int):
    """Rows sorted by (component, i, j, part): of each owner the links between its part and the other, in blocks of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts = None, ([], [])

        def found():
            if group is None:
                return
            inside = group[1] == group[2]
            asking, asked = parts[0], parts[0] if inside else parts[1]
            links: dict[int, int] = {}
            for owner, n, grams in asking:
                got = [x for x in t_occurrence(grams, n, asked, num, den) if x != owner]
                links[owner] = links.get(owner, 0) + len(got)
                if not inside:
                    for x in got:
                        links[x] = links.get(x, 0) + 1
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(list(links), pa.int64()), pa.array(list(links.values()), pa.int64())], names=["owner", "links"])

        for batch in batches:
            lists = batch.column("grams")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for r, (component, i, j, part, owner, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("component", "i", "j", "part", "owner", "n")))):
                if group != (component, i, j):
                    yield from found()
                    group, parts = (component, i, j), ([], [])
                parts[part != i].append((owner, n, flat[at[r] : at[r + 1]].copy()))
        yield from found()

    return run


def _link_counts(sets: DataFrame, joined: DataFrame, num: int, den: int) -> DataFrame:
    """(owner, n_links): all links of each owner.  They lie inside its component, whose sets are dealt out and every two parts compared."""
    own = sets.join(joined.select(F.col("id").alias("owner"), "component"), "owner").select("component", "owner", "n", "grams")
    parts = joined.groupBy("component").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    own = own.join(parts, "component").withColumn("part", F.pmod(F.xxhash64("owner"), "parts").cast("int"))
    own = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = own.select("component", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "part", "owner", "n", "grams")
    counts = own.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "part").mapInArrow(_counted(num, den), "owner long, links long")
    return counts.groupBy("owner").agg(F.sum("links").alias("n_links")).where("n_links > 0").checkpoint()


def ngram_classes(documents: DataFrame, shingle: int = 5, num: int = 75, den: int = 100, count_links: bool = True) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id and, with count_links, n_links.

    Two documents link when den * |intersection| >= num * |union| of their
    shingle sets; component_id is the least doc_id reachable.  Documents of
    equal sets, such as repeated rows and equal texts, are one class, and
    n_links counts the other classes that the document's class links with.
    Null and empty texts have no shingles and link with nothing, not even with
    each other.  Other columns are ignored.  To count links, the sets of a
    component are compared in pairs, which is the square of its size in work;
    the components alone need no such thing.
    """
    return _classes(documents, shingle, num, den, every=count_links)


def _classes(documents: DataFrame, shingle: int, num: int, den: int, every: bool) -> DataFrame:
    """ngram_classes; without `every`, no n_links."""
    spark = T.prepare(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = texts.mapInArrow(_first_pass(shingle), "doc_id long, n_shingles long, owner long, gram long, times long").checkpoint()
    docs = first.where("gram is null").select("doc_id", "n_shingles", "owner")
    total, entries = docs.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    # both lists are shares of the corpus, so their lengths don't grow with it
    least = max(HOT_LEAST, GLOBAL_SHARE * total)
    hot = np.array([r.gram for r in first.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("n")).where(F.col("n") >= least).select("gram").collect()], np.int64)
    classes = docs.where("owner is not null").groupBy("owner").agg(F.min("doc_id").alias("lead"), F.count("*").alias("copies"), F.count_if(F.col("doc_id").isNull()).alias("lost")).checkpoint()
    copied = {r.owner: r.lead for r in classes.where((F.col("copies") >= least) & (F.col("lost") == 0)).collect()}

    tasks = T.pieces_of(spark, entries, TASK_ENTRIES)
    buckets = 4 * tasks
    block = "bucket int, kind int, block binary"
    indexed = texts.mapInArrow(_index_pass(shingle, buckets, np.sort(hot.view(np.uint64)), copied), block)
    shared = indexed.repartition(tasks, "bucket").mapInArrow(_lists(buckets), block)
    sets = shared.repartition(tasks, "bucket").mapInArrow(_shared(num, den), "owner long, n long, prefix int, grams array<long>").checkpoint()
    prefixes = sets.select("owner", "n", F.size("grams").alias("s"), F.posexplode(F.slice("grams", F.lit(1), F.col("prefix"))).alias("place", "gram")).checkpoint()
    # an owner nearly all of whose shingles are shared is nearest to what its near copies have in common
    central = F.max_by("owner", F.struct(F.col("s") / F.col("n"), "owner"))

    def led_by(prefixes: DataFrame, lead) -> DataFrame:
        """For each owner the leader, other than itself, of most of its lists."""
        leads = prefixes.groupBy("gram").agg(lead.alias("query")).checkpoint()
        votes = prefixes.join(leads, "gram").where("owner <> query").groupBy("owner", "query").agg(F.count("*").alias("votes"))
        return votes.groupBy("owner").agg(F.max_by("query", F.struct("votes", "query")).alias("query"))

    def still_open(links: DataFrame) -> DataFrame:
        """The lists that hold several components, with the component of each owner."""
        joined = components(links)
        own = prefixes.join(joined.withColumnRenamed("id", "owner"), "owner", "left").withColumn("component", F.coalesce("component", "owner"))
        mixed = own.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("gram")
        return own.join(mixed, "gram", "left_semi").checkpoint()

    def pairs_of(lists: DataFrame, wanted: str) -> DataFrame:
        """Pairs (query, owner) of the lists that are `wanted` and that sizes and places allow."""
        other = lists.select(*(F.col(c).alias(f"{c}2") for c in lists.columns))
        # if this is the first shingle that two sets share, the rest of either bounds what they can share
        need = F.ceil((F.col("n") + F.col("n2")) * num / (num + den))
        return (
            lists.join(other, F.col("gram") == F.col("gram2"))
            .where(wanted)
            .where(F.least(F.col("s") - F.col("place"), F.col("s2") - F.col("place2")) >= need)
            .select(F.col("owner").alias("query"), F.col("owner2").alias("owner"))
            .distinct()
        )

    links = _links(led_by(prefixes, central), sets, num, den)
    rest = still_open(links)
    if not rest.isEmpty():
        links = links.unionByName(_links(led_by(rest, F.min("owner")), sets, num, den))
        links = links.unionByName(_links(pairs_of(still_open(links), "owner < owner2 and component <> component2"), sets, num, den))
    joined = components(links).checkpoint()
    T.release(spark)
    degree = _link_counts(sets, joined, num, den) if every else joined.select(F.col("id").alias("owner"), F.lit(None).cast("long").alias("n_links")).where("false")
    named = classes.join(joined.withColumnRenamed("id", "owner"), "owner", "left").join(degree, "owner", "left")
    named = named.withColumn("component", F.coalesce("component", "owner")).select("owner", "lead", "component", "n_links")
    leads = named.groupBy("component").agg(F.min("lead").alias("component_id"))
    # an owner of many copies is one hot key of the last join, whose side of the rows may be split: the other has one row for each owner
    found = named.join(leads, "component").select("owner", "component_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")).checkpoint()
    return docs.join(found, "owner", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        *([F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")] if every else []),
    )


def one_of_each(documents: DataFrame, shingle: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One row of `documents`, all columns, of each class: that of the least doc_id, null last, or one of those equal in doc_id and text.

    Rows whose texts have no shingles all stay.
    """
    row = F.xxhash64("doc_id", F.xxhash64("text"))
    found = _classes(documents.select(row.alias("doc_id"), "text"), shingle, num, den, every=False).where("n_shingles > 0")
    found = found.groupBy(F.col("doc_id").alias("row"), "component_id").agg(F.count("*").alias("times"))
    ids = documents.select(row.alias("row"), F.col("doc_id").alias("id")).distinct()
    order = F.struct(F.col("id").isNull(), "id", "row")
    found = found.join(ids, "row").checkpoint()
    kept = found.groupBy("component_id").agg(F.min_by("row", order).alias("row")).select("row")
    several = found.join(kept, "row", "left_semi").where("times > 1").select("row").checkpoint()
    others = found.join(kept, "row", "left_anti").select("row").unionByName(several)
    rows = documents.withColumn("__row", row)
    single = rows.join(others, rows["__row"] == others["row"], "left_anti")
    once = rows.join(several, rows["__row"] == several["row"], "left_semi").dropDuplicates(["__row"])
    return single.unionByName(once).drop("__row")
