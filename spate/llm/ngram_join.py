"""N-gram Jaccard join by rare-first prefix filtering.

A document is the set of its five-word shingles, as 64-bit hashes.

1. Documents with equal sets form classes (128-bit signature, partial
   aggregate); from here on one representative stands for a class.
2. Shingle frequencies are counted over all documents into a fixed number of
   hash buckets.  (bucket frequency, hash) is one total order for all documents
   with rare shingles first; any total order keeps prefix filtering exact.
3. Two sets with Jaccard >= t share a shingle among the first
   n - ceil(t n) + 1 of each.  Prefix shingles are shuffled once; those of
   frequent buckets are salted.  A shingle without a second document is dropped.
4. Star phase: in each shingle's group every document is paired with the
   group's first and last document and the next six after itself: linear in the
   prefixes, whatever the group, and every pair of a group of up to three.
   Length and positional filters act on the pairs before they leave the group,
   a suffix filter on partition counts before any set is fetched, and each
   remaining pair is verified once.
5. Rest phase: pairs of documents that the verified links already connect need
   no check.  Shingle groups that still hold several components are reduced to
   (size, position, component) classes; class pairs pass length and positional
   filters first and only then are their documents paired, filtered and
   verified once.
6. Connected components of the links; every document gets its class's component.
7. Link counts: phases 4 and 5 verify a connecting subset of the links.  A
   component whose members are all linked by it is counted from it; the members
   of any other one are compared all with all, in pairs of blocks of about
   ``BLOCK_DOCS``, each one matrix product; counts leave a block, not pairs.

Null ids take part as copies or not at all: their rows are returned with their
size and, when an equal text has an id, its component, else null.  Documents
without words have size 0 and are their own component.  Repeated rows give
repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spate.llm.common import TextBatch, id_filter, maybe_in, mix64, slices, stage
from spate.llm.components import components

SHINGLE = 5
#: Similarity threshold as a fraction: 100 * intersection >= 75 * union.
NUMERATOR, DENOMINATOR = 3, 4
#: Frequency buckets (4 MB on the driver and in the broadcast, whatever the corpus).
BUCKETS = 1 << 20
#: Documents a salted group of a frequent shingle holds, about.
GROUP_DOCS = 2_000
#: Documents of its group that each document is paired with in the star phase.
HUBS = ("first", "last", "next1", "next2", "next3", "next4", "next5", "next6")
#: Documents of a component in a block of the link counts, about.
BLOCK_DOCS = 512
#: Shingles that one matrix product of a pair of blocks takes at a time.
BLOCK_SHINGLES = 4_096
#: Parts of a set that the suffix filter compares.
PARTS = 16


def shingle_sets(tb: TextBatch) -> tuple[list[np.ndarray], np.ndarray]:
    """Per document the sorted distinct shingle hashes."""
    w = tb.words(fold=True)
    gram, at = w.ngrams(SHINGLE)
    doc = w.doc[at]
    short = np.flatnonzero((w.per_doc > 0) & (w.per_doc < SHINGLE))
    off = np.searchsorted(doc, np.arange(tb.n + 1))
    sets = [np.unique(gram[off[i] : off[i + 1]]) for i in range(tb.n)]
    for i in short:  # fewer words than a shingle: the whole sequence is the only element
        a, b = w.doc_off[i], w.doc_off[i + 1]
        acc = np.uint64(0)
        with np.errstate(over="ignore"):
            for x in w.hash[a:b]:
                acc = acc * np.uint64(0x9E3779B97F4A7C15) + x
        sets[i] = mix64(np.array([acc ^ np.uint64(b - a)], dtype=np.uint64))
    return sets, np.array([len(s) for s in sets], dtype=np.int64)


def _signed(x) -> int:
    x = int(x)
    return x - (1 << 64) if x >= 1 << 63 else x


def summaries(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One pass: per document (id, n, sig1, sig2, parts), and per task its bucket counts (n = -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = np.zeros(BUCKETS, dtype=np.int64)
        names = ["id", "n", "sig1", "sig2", "parts", "block", "counts"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int64())]
        for batch in batches:
            for part in slices(batch, 1):
                sets, n = shingle_sets(TextBatch(part.column(1)))
                rows = []
                for i, s in zip(part.column(0).to_pylist(), sets):
                    parts = np.bincount((s >> np.uint64(60)).astype(np.int64), minlength=PARTS)
                    with np.errstate(over="ignore"):
                        one = mix64(np.array([np.add.reduce(mix64(s)), np.bitwise_xor.reduce(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))], dtype=np.uint64))
                    rows.append((i, len(s), _signed(one[0]), _signed(one[1]), parts.tolist(), None, None))
                if rows:
                    every = np.concatenate(sets)
                    freq += np.bincount((every & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        if freq.any():
            for first in range(0, BUCKETS, 1 << 17):
                blocks = np.arange(first >> 12, (first + (1 << 17)) >> 12, dtype=np.int32)
                counts = pa.ListArray.from_arrays(np.arange(0, (1 << 17) + 1, 1 << 12, dtype=np.int32), freq[first : first + (1 << 17)])
                none = [pa.nulls(len(blocks), t) for t in types[:5]]
                none[1] = pa.array(np.full(len(blocks), -1))
                yield pa.RecordBatch.from_arrays([*none, pa.array(blocks), counts], names)

    schema = "id long, n long, sig1 long, sig2 long, parts array<int>, block int, counts array<bigint>"
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def bucket_frequencies(summary: DataFrame) -> np.ndarray:
    """Sum the tasks' bucket counts in Spark; 256 blocks of fixed size reach the driver."""
    rows = summary.filter("n = -1").select("block", F.posexplode("counts").alias("k", "c"))
    total = rows.groupBy("block", "k").agg(F.sum("c").alias("c")).filter("c > 0")
    out = np.zeros(BUCKETS, dtype=np.int64)
    got = total.select((F.col("block") * (1 << 12) + F.col("k")).alias("i"), "c").toArrow()
    out[got.column("i").to_numpy()] = got.column("c").to_numpy()
    return out


def ceil_share(n):
    """ceil(t * n) for the threshold fraction."""
    return (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR


def prefixes(docs: DataFrame, doc_id: str, text: str, freq) -> DataFrame:
    """(token, salt, id, size, pos): the first n - ceil(t n) + 1 shingles in rare-first order."""
    typical = float(np.median(freq.value[freq.value > 0])) if (freq.value > 0).any() else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = freq.value
        for batch in batches:
            for part in slices(batch, 1):
                sets, n = shingle_sets(TextBatch(part.column(1)))
                ids = part.column(0).to_numpy(zero_copy_only=False)
                tok, pos = [], []
                length = np.where(n > 0, n - ceil_share(n) + 1, 0)
                for s, m in zip(sets, length):
                    rank = f[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]
                    tok.append(s[np.lexsort((s, rank))[:m]])
                    pos.append(np.arange(m, dtype=np.int32))
                token = np.concatenate(tok)
                at = np.repeat(np.arange(len(ids)), length)
                # A bucket far above the typical load holds a frequent shingle: spread its documents.
                many = np.maximum((f[(token & np.uint64(BUCKETS - 1)).astype(np.int64)] - 4 * typical) / GROUP_DOCS, 0).astype(np.int64) + 1
                salt = (mix64(ids[at].astype(np.int64).view(np.uint64)) % many.astype(np.uint64)).astype(np.int32)
                salt[many > 1] += 1  # 0: an unsalted shingle
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token.view(np.int64)), pa.array(salt), pa.array(ids[at]), pa.array(n[at].astype(np.int32)), pa.array(np.concatenate(pos))],
                    ["token", "salt", "id", "size", "pos"],
                )

    src = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return src.mapInArrow(run, "token long, salt int, id long, size int, pos int")


def least_overlap(a, b):
    """Least intersection of sets of sizes a and b that reaches the threshold: ceil(t / (1 + t) * (a + b))."""
    return F.ceil((a + b) * NUMERATOR / (NUMERATOR + DENOMINATOR))


def _fits(sa, pa_, sb, pb):
    """Length filter and positional filter (the token is the first common one at positions pa, pb)."""
    length = (sa * DENOMINATOR >= sb * NUMERATOR) & (sb * DENOMINATOR >= sa * NUMERATOR)
    reach = F.least(sa - pa_, sb - pb)  # this token and all that can follow it
    return length & (reach >= least_overlap(sa, sb))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, ta, tb) -> the pairs whose sets reach the threshold; a text that repeats in a slice is cut once."""

    def sets_of(ids, texts):
        _, first, place = np.unique(ids.to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
        sets, _ = shingle_sets(TextBatch(texts.take(pa.array(first))))
        return sets, place

    for batch in batches:
        for half in slices(batch, 2):
            for part in slices(half, 3):
                (sa, ia), (sb, ib) = sets_of(part.column(0), part.column(2)), sets_of(part.column(1), part.column(3))
                linked = []
                for i, j in zip(ia, ib):
                    common = len(np.intersect1d(sa[i], sb[j], assume_unique=True))
                    linked.append(common > 0 and common * DENOMINATOR >= (len(sa[i]) + len(sb[j]) - common) * NUMERATOR)
                keep = pa.array(linked, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["a", "b"])


class Verifier:
    """Fetches texts of candidate documents and checks each pair once.

    Texts travel, not sets: they take about half the room, and a pair's two
    sets are built where it is checked.
    """

    def __init__(self, docs: DataFrame, doc_id: str, text: str, parts: DataFrame):
        self.docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
        self.parts = parts

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a < b) whose sets reach the threshold."""
        pairs = stage(self._suffix(pairs), "join-pairs")
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        texts = self._texts(ids)
        both = (
            pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        )
        return both.select("a", "b", "ta", "tb").mapInArrow(_verified, "a long, b long")

    def _suffix(self, pairs: DataFrame) -> DataFrame:
        """Suffix filter: sets cut at fixed hash values can share at most the smaller part of each pair of parts."""
        p = self.parts
        rows = pairs.join(p.select(F.col("id").alias("a"), F.col("parts").alias("pa"), F.col("n").alias("na")), "a").join(
            p.select(F.col("id").alias("b"), F.col("parts").alias("pb"), F.col("n").alias("nb")), "b"
        )
        most = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
        return rows.filter(most >= least_overlap(F.col("na"), F.col("nb"))).select("a", "b")

    def _texts(self, ids: DataFrame) -> DataFrame:
        """(id, text) of the wanted documents: a fixed-size filter thins the scan, an exact join follows."""
        near = maybe_in(self.docs, "id", id_filter(ids, "id")).filter("__maybe").drop("__maybe")
        return near.join(ids, "id", "left_semi").dropDuplicates(["id"])


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct unordered pairs; duplicates are dropped before and after the shuffle."""
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def star_pairs(grouped: DataFrame) -> DataFrame:
    """Every document with the hubs of its shingle groups: the first, the last, and the next ones."""
    out = None
    for k, name in enumerate(HUBS):
        hub = F.col(name)
        fit = _fits(F.col("size"), F.col("pos"), hub["size"], hub["pos"]) & (F.col("id") != hub["id"])
        part = grouped.filter(fit if k < 2 else fit & (F.col("k") > 3)).select(F.col("id").alias("a"), hub["id"].alias("b"))
        out = part if out is None else out.unionByName(part)
    return out


def rest_pairs(grouped: DataFrame, label: DataFrame) -> DataFrame:
    """Candidate pairs of different components, by way of (size, position, component) classes."""
    big = grouped.filter("k > 3 or salt > 0")  # all pairs of smaller groups are star pairs
    x = big.select("token", "id", "size", "pos").join(label, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    mixed = x.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("token")
    x = stage(x.join(mixed, "token"), "join-mixed")
    cls = x.select("token", "size", "pos", "c").distinct()
    one, two = (cls.select("token", *(F.col(k).alias(f"{k}{s}") for k in ("size", "pos", "c"))) for s in "12")
    fit = _fits(F.col("size1"), F.col("pos1"), F.col("size2"), F.col("pos2"))
    pairs = one.join(two, "token").filter((F.col("c1") < F.col("c2")) & fit)
    left = x.select("token", F.col("size").alias("size1"), F.col("pos").alias("pos1"), F.col("c").alias("c1"), F.col("id").alias("a"))
    right = x.select("token", F.col("size").alias("size2"), F.col("pos").alias("pos2"), F.col("c").alias("c2"), F.col("id").alias("b"))
    return pairs.join(left, ["token", "size1", "pos1", "c1"]).join(right, ["token", "size2", "pos2", "c2"]).select("a", "b")


def _block_links(block: pa.Table) -> pa.Table:
    """Rows (side, id, text) of a pair of blocks -> (id, n_links): the links of each document across the pair.

    A block with itself has side 0 only.
    """
    sets = []
    for batch in block.select(["text"]).to_batches():
        for part in slices(batch, 0):
            sets += shingle_sets(TextBatch(part.column(0)))[0]
    ids, side = (block.column(k).to_numpy() for k in ("id", "side"))
    n = np.array([len(s) for s in sets], dtype=np.int64)
    shingle, col = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), n)
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    place = np.zeros(len(sets), dtype=np.int64)
    place[left] = np.arange(len(left))
    place[right] = np.arange(len(right))
    seen = [np.bincount(col[side[row] == k], minlength=len(shingle)) for k in (0, 1)]
    shared = np.flatnonzero((seen[0] > 0) & (seen[1] > 0) if side.any() else seen[0] > 1)
    at = np.full(len(shingle), -1, dtype=np.int64)
    at[shared] = np.arange(len(shared))
    col = at[col]
    common = np.zeros((len(left), len(right)), dtype=np.float64)
    for k in range(0, len(shared), BLOCK_SHINGLES):
        here = (col >= k) & (col < k + BLOCK_SHINGLES)
        part = []
        for who in (0, 1) if side.any() else (0,):
            mine = here & (side[row] == who)
            m = np.zeros((len(right) if who else len(left), BLOCK_SHINGLES), dtype=np.float32)
            m[place[row[mine]], col[mine] - k] = 1
            part.append(m)
        common += part[0] @ part[-1].T
    either = n[left][:, None] + n[right][None, :] - common
    linked = (common > 0) & (common * DENOMINATOR >= either * NUMERATOR)
    count = np.zeros(len(sets), dtype=np.int64)
    if side.any():
        count[right] = linked.sum(axis=0)
    else:
        np.fill_diagonal(linked, False)
    count[left] = linked.sum(axis=1)
    return pa.table({"id": pa.array(ids, pa.int64()), "n_links": pa.array(count)})


def link_counts(links: DataFrame, label: DataFrame, check: Verifier) -> DataFrame:
    """(id, n_links) over all pairs that reach the threshold; linked documents share a component."""
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id")))
    degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    degree = stage(label.join(degree, "id"), "join-degrees")
    size = degree.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n_links").alias("ends"))
    partial = stage(size.filter(F.col("ends") < F.col("m") * (F.col("m") - 1)).select("component", "m"), "join-partial")
    whole = degree.join(partial, "component", "left_anti").select("id", "n_links")
    blocks = F.ceil(F.col("m") / BLOCK_DOCS)
    rows = degree.join(partial, "component").select("component", "id", blocks.alias("blocks"))
    texts = check._texts(rows.select("id"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select(
        "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id"
    )
    counted = rows.join(texts, "id").groupBy("component", "i", "j").applyInArrow(_block_links, "id long, n_links long")
    return whole.unionByName(counted.groupBy("id").agg(F.sum("n_links").alias("n_links")))


def ngram_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", count_links: bool = True) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id and, unless not asked for, n_links (all links of its class)."""
    spark = docs.sparkSession
    summary = stage(summaries(docs, doc_id, text), "join-summary")
    freq = spark.sparkContext.broadcast(bucket_frequencies(summary))
    rows = summary.filter("n >= 0").select("id", "n", "sig1", "sig2", "parts")
    cls = rows.filter("n > 0").groupBy("sig1", "sig2", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    cls = stage(cls, "join-classes")
    # Copies that are not their class's representative are left out of the join.  Those whose id
    # may be one of them take the exact way through a join; all others pass the scan.
    copies = rows.filter("n > 0").join(cls.filter("copies > 1"), ["sig1", "sig2", "n"]).filter(~F.col("id").eqNullSafe(F.col("rep")))
    copies = stage(copies.filter("id is not null").select("id").distinct(), "join-copies")
    src = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null")
    marked = maybe_in(src, "id", id_filter(copies, "id"))
    alone = prefixes(marked.filter(~F.col("__maybe")), "id", "text", freq)
    unsure = marked.filter("__maybe").drop("__maybe").join(copies, "id", "left_anti")
    prefix = alone.unionByName(prefixes(unsure, "id", "text", freq))
    by = Window.partitionBy("token", "salt")
    order = by.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct("id", "size", "pos")
    step = by.orderBy("id")
    grouped = (
        prefix.withColumn("k", F.count(F.lit(1)).over(order))
        .withColumn("first", F.first(me).over(order))
        .withColumn("last", F.last(me).over(order))
        .withColumns({name: F.lead(me, k).over(step) for k, name in enumerate(HUBS[2:], start=1)})
        .filter("k > 1 or salt > 0")
    )
    grouped = stage(grouped, "join-groups")
    # Salted groups of one shingle meet through their first documents.
    hubs = grouped.filter("salt > 0").select("token", F.col("first.id").alias("lead")).distinct()
    least = hubs.groupBy("token").agg(F.min("lead").alias("least"))
    bridge = hubs.join(least, "token").select(F.col("lead").alias("a"), F.col("least").alias("b"))
    check = Verifier(docs.filter(F.col(doc_id).isNotNull()), doc_id, text, rows.filter("id is not null").dropDuplicates(["id"]))
    links = stage(check.links(_pairs(star_pairs(grouped).unionByName(bridge))), "join-links")
    label = stage(components(links), "join-labels")
    more = stage(check.links(_pairs(rest_pairs(grouped, label))), "join-links")
    links = links.unionByName(more)
    label = stage(components(links), "join-labels")
    known = cls.join(label.withColumnRenamed("id", "rep"), "rep", "left")
    if count_links:
        degree = stage(link_counts(links, label, check), "join-counts")
        known = known.join(degree.withColumnRenamed("id", "rep"), "rep", "left")
    else:
        known = known.withColumn("n_links", F.lit(None).cast("long"))
    known = known.select("sig1", "sig2", "n", F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = rows.join(known, ["sig1", "sig2", "n"], "left")
    out = out.select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )
    return out if count_links else out.drop("n_links")


def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the group's least id.

    Rows with a null id are no group's member and stay.  Texts do not move for
    rows that the fixed-size filter of dropped ids lets pass; the rest take an
    exact join.
    """
    got = stage(ngram_join(docs, doc_id, text, count_links=False), "join-result").filter(F.col(doc_id).isNotNull()).withColumnRenamed(doc_id, "__id")
    per = stage(
        got.groupBy("__id").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("component_id") == F.col("__id")).alias("stays")), "join-decisions"
    )
    odd = per.filter("rows > 1 or not stays").select("__id")
    marked = maybe_in(docs.withColumn("__id", F.col(doc_id).cast("long")), "__id", id_filter(odd, "__id"))
    clear = marked.filter("__id is null or not __maybe")
    unsure = marked.filter("__id is not null and __maybe").join(per.filter("stays").select("__id"), "__id", "left_semi").dropDuplicates(["__id"])
    return clear.select(*docs.columns).unionByName(unsure.select(*docs.columns))
