"""Near-duplicate classes of documents: every pair whose word-shingle sets have a Jaccard similarity of at least 0.75.

Method. One hash function orders all shingles. Each document retains the bottom k of its set, where k follows from the
set's size (a quarter, plus one): two sets with the asked similarity then share a retained value, so inverted lists
of the retained values generate every pair, without a chance of a miss. In that order, shingles that many documents
hold come after all others, so that a passage shared by unlike documents is retained only where it makes up
three quarters of a set. A union-sketch estimate of a pair drops hopeless ones, the exact similarity of the full sets
decides.

Scale. Equal sets are collapsed to one representative before any list is built. A list of a rare value has fewer than
``HOT`` members by construction. A list of a frequent value is never expanded into its pairs: its members first meet
two pivots, and afterwards only members that are still in another class than the list's largest meet the rest.

Null or empty texts have an empty set and are linked with nothing. Rows with a null id keep a null class and are
kept. Rows with the same id are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import bit_table, chunks, might_contain, shingle_sets, written

#: a shingle of at least so many documents is frequent
HOT = 32
#: bits of the table of frequent shingles that every task gets; a false hit only changes the order of retained values
HOT_BITS = 26
#: shingles that one counting group holds, about
GROUP_ROWS = 4_000_000
#: size of the sketches of the estimate, and the estimate under which a pair is dropped. A pair of similarity 0.75 falls below
#: with a chance under 1e-16 for sketches of this size (Chernoff bound); smaller sets are compared whole.
SKETCH, SKETCH_FLOOR = 256, 0.5


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [b"" if x is None else x for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _split(doc: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the n texts in the sorted text numbers."""
    return np.searchsorted(doc, np.arange(n + 1))


def frequent_shingles(docs: DataFrame, hot: int = HOT, bits: int = HOT_BITS) -> bytes:
    """A bit table over the top ``bits`` bits of shingle hashes, set where at least ``hot`` documents hold the shingle.

    Counts all documents. Tasks send sorted 32-bit remainders by hash range; a range is sized to fit a group, and
    returns its slice of the table, so that what reaches the driver has a fixed size.
    """
    spark = docs.sparkSession
    words = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 5
    spread = int(min(bits - 3, max(6, np.ceil(np.log2(max(1, words / GROUP_ROWS))))))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            for a, b in chunks(texts):
                h = np.sort(shingle_sets(texts[a:b])[1])
                at = np.searchsorted(h, np.arange(1 << spread, dtype=np.uint64) << np.uint64(64 - spread))
                rest = ((h << np.uint64(spread)) >> np.uint64(32)).astype(np.uint32)
                parts = [(i, x.view(np.uint8).reshape(-1, 4).T.tobytes()) for i, x in enumerate(np.split(rest, at[1:])) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], ["range", "packed"])

    def table(group: pa.Table) -> pa.Table:
        values = np.concatenate([np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel() for x in group.column("packed").to_pylist()])
        values.sort()
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        count = np.diff(np.append(first, len(values)))
        flags = np.zeros(1 << (bits - spread), bool)
        flags[values[first[count >= hot]] >> np.uint32(32 - bits + spread)] = True
        return pa.table({"range": group.column("range")[:1], "flags": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    slices = (
        docs.select("text").mapInArrow(ranges, "range int, packed binary")
        .groupBy("range").applyInArrow(table, "range int, flags binary")
    )
    width = (1 << (bits - spread)) // 8
    found = {r["range"]: bytes(r["flags"]) for r in slices.collect()}
    return b"".join(found.get(i, bytes(width)) for i in range(1 << spread))


def sketches(docs: DataFrame, frequent: bytes, share: tuple[int, int] = (75, 100), bits: int = HOT_BITS) -> DataFrame:
    """Per document: set size, 128-bit fingerprint of the set, and the retained values, rare and frequent ones apart."""
    flags = docs.sparkSession.sparkContext.broadcast(frequent)
    top, base = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_table = np.frombuffer(flags.value, np.uint8)
        for batch in batches:
            texts, ids = _texts(batch), batch.column("doc_id")
            for a, b in chunks(texts):
                doc, h = shingle_sets(texts[a:b])
                at = (h >> np.uint64(64 - bits)).astype(np.int64)
                hot = (hot_table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
                order = np.lexsort((h, hot, doc))
                bounds = _split(doc, b - a)
                n = np.diff(bounds)
                k = np.where(n > 0, n - (n * top + base - 1) // base + 1, 0)
                rank = np.arange(len(doc)) - np.repeat(bounds[:-1], n)
                keep = rank < np.repeat(k, n)
                kept_doc, kept, kept_hot = doc[keep], h[order][keep].view(np.int64), hot[order][keep]
                total = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(h, out=total[1:])
                odd = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(h * (h | np.uint64(1)) + (h >> np.uint64(7)), out=odd[1:])
                part = lambda m: pa.ListArray.from_arrays(pa.array(_split(kept_doc[m], b - a), pa.int32()), pa.array(kept[m]))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(n), *[pa.array((t[bounds[1:]] - t[bounds[:-1]]).view(np.int64)) for t in (total, odd)], part(~kept_hot), part(kept_hot)],
                    ["doc_id", "n_shingles", "f1", "f2", "rare", "frequent"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, f1 long, f2 long, rare array<long>, frequent array<long>"
    )


def _possible(overlap: Column) -> Column:
    """Whether sets of the sizes na and nb can be similar enough if they share at most ``overlap`` shingles."""
    return (F.col("a") < F.col("b")) & (100 * overlap >= 75 * (F.col("na") + F.col("nb") - overlap))


def _lists_to_pairs(postings: DataFrame) -> DataFrame:
    """Pairs of the (bounded) lists of rare values whose retained overlap allows the similarity.

    All values that two sets share up to the end of the shorter-reaching sketch are retained by both. So the sets share at most the
    counted values and what that sketch left out; if both sketches reach into frequent values, at most the counted and
    the smaller number of frequent ones.
    """
    lists = postings.groupBy("v").agg(F.array_sort(F.collect_set(F.struct("rep", "n", "h"))).alias("m")).filter(F.size("m") > 1)
    first = lists.select("m", F.posexplode("m").alias("i", "a"))
    pairs = first.select("a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))
    # by set, as an id may have several
    keys = [F.col(f"{x}.{c}").alias(to + x) for x in "ab" for c, to in (("rep", ""), ("n", "n"), ("h", "h"))]
    pairs = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("both"))
    left_out = [F.ceil(F.col(n) * 75 / 100) - 1 for n in ("na", "nb")]
    beyond = F.when((F.col("ha") > 0) & (F.col("hb") > 0), F.least("ha", "hb")).when(F.col("ha") > 0, left_out[1]).when(F.col("hb") > 0, left_out[0])
    bound = F.least("na", "nb", F.col("both") + F.coalesce(beyond, F.greatest(*left_out)))
    return pairs.filter(_possible(bound)).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that pass the sketch estimate and the exact similarity of their full sets."""
    # texts of other documents don't get past the scan, but for a few false hits of the bit table
    named = bit_table(pairs.select(F.explode(F.array("a", "b")).alias("id")).select(F.xxhash64("id").alias("h")))
    texts = docs.filter(F.col("doc_id").isNotNull() & might_contain(named, F.xxhash64("doc_id"))).select("doc_id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, own = _texts(batch), batch.column("doc_id")
            for a, b in chunks(texts):
                doc, h = shingle_sets(texts[a:b])
                bounds = _split(doc, b - a)
                packed = [h[bounds[i] : bounds[i + 1]].tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([own.slice(a, b - a), pa.array(packed, pa.binary())], ["doc_id", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            left, right = batch.column("sa"), batch.column("sb")
            for i in range(batch.num_rows):
                a, b = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                if len(a) > SKETCH and len(b) > SKETCH:
                    union = np.union1d(a[:SKETCH], b[:SKETCH])[:SKETCH]
                    both = len(np.intersect1d(np.intersect1d(union, a[:SKETCH], True), b[:SKETCH], True))
                    if both < SKETCH_FLOOR * SKETCH:
                        good.append(False)
                        continue
                both = len(np.intersect1d(a, b, True))
                good.append(100 * both >= 75 * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    full = texts.mapInArrow(sets, "doc_id long, s binary")
    both = (
        pairs.join(full.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
        .join(full.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    )
    return both.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long").distinct()


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, label): the smallest node reachable from every linked node. ``labels``: the classes of links already known.

    Each round, every class takes the smallest class it is linked with, chains of these are followed to their ends, and links are
    carried over to the classes; those inside a class go. So all links are joined in the first round only.
    """
    if labels is not None:
        links = _carried(links, labels)
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    while links.limit(1).count():
        down = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
        ends = links.select(F.col("a").alias("node")).distinct().join(down.select("node"), "node", "left_anti")
        step = written(down.unionByName(ends.withColumn("label", F.col("node"))), "labels")
        while True:
            ahead = step.select(F.col("node").alias("via"), F.col("label").alias("far"))
            jump = written(step.join(ahead, F.col("label") == F.col("via")).select("node", F.col("label").alias("old"), F.col("far").alias("label")), "labels")
            step = jump.select("node", "label")
            if not jump.filter("old <> label").limit(1).count():
                break
        labels = step if labels is None else written(_relabelled(labels, step), "labels")
        links = written(_carried(links, step).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("label"))  # no links, no rows
    return labels


def _carried(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The links between the classes of their ends."""
    for c in "ab":
        own = labels.select(F.col("node").alias(c), F.col("label").alias("own"))
        links = links.join(own, c, "left").withColumn(c, F.coalesce("own", c)).drop("own")
    return links


def _relabelled(labels: DataFrame, step: DataFrame) -> DataFrame:
    """All nodes with the class that a step gives their class; the step's own nodes too."""
    own = step.select(F.col("node").alias("label"), F.col("label").alias("now"))
    known = labels.join(own, "label", "left").select("node", F.coalesce("now", "label").alias("label"))
    return known.unionByName(step.join(labels.select("node"), "node", "left_anti"))


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of the lists that hold more than one class, with their class and the list's largest."""
    own = members.join(labels, F.col("rep") == F.col("node"), "left").select("v", "rep", "n", "h", F.coalesce("label", "rep").alias("class"))
    sizes = own.groupBy("v", "class").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("v").agg(F.max_by("class", F.struct("size", "class")).alias("main"), F.count(F.lit(1)).alias("classes")).filter("classes > 1").select("v", "main")
    return written(own.join(main, "v"), "mixed")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text, ...)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = written(sketches(docs, frequent_shingles(docs)), "sketches")
    real = table.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    keys = ["n_shingles", "f1", "f2"]
    classes = written(real.groupBy(*keys).agg(F.min("doc_id").alias("rep")), "classes")
    own = real.join(classes.select(F.col("rep").alias("doc_id"), *keys), ["doc_id", *keys], "left_semi")
    own = own.select(F.col("doc_id").alias("rep"), F.col("n_shingles").cast("int").alias("n"), "rare", "frequent")
    # h: how many frequent shingles a set has, if it retains any; then it retains all its rare ones
    own = own.withColumn("h", F.when(F.size("frequent") > 0, F.col("n") - F.size("rare")).otherwise(0))

    rare = own.select("rep", "n", "h", F.explode("rare").alias("v"))
    hot = written(own.filter("h > 0").select("rep", "n", "h", F.posexplode("frequent").alias("rank", "v")), "frequent")
    # every member of a frequent list meets two pivots, in the lists of its first few frequent values. Pairs that share a
    # rare value are found in its list; all others share frequent ones only
    ends = hot.groupBy("v").agg(F.min(F.struct("rep", "n", "h")).alias("low"), F.max(F.struct("h", "rep", "n")).alias("large"))
    star = hot.filter("rank < 4").join(ends, "v").select(
        F.struct("rep", "n", "h").alias("x"), F.explode(F.array(F.col("low"), F.struct("large.rep", "large.n", "large.h"))).alias("y")
    ).distinct()
    star = star.select(
        F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"),
        F.least("x.h", "y.h").alias("h"),
    ).filter(_possible(F.col("h"))).select("a", "b").distinct()
    pairs = written(_lists_to_pairs(rare).union(star).distinct(), "pairs")
    labels = components(verified(pairs, docs))

    # members of frequent lists that are still outside the list's largest class meet the list's other classes; a pair
    # counts in the list of its first common value only
    members = hot.select("v", "rep", "n", "h")
    mixed = _mixed(members, labels)
    # first the members richest in frequent values of each class and of the largest one: this joins most classes with few pairs
    best = F.max(F.struct("h", "rep", "n"))
    heads = mixed.groupBy("v", "main", "class").agg(best.alias("x"))
    chief = heads.filter("class = main").select("v", F.col("x").alias("y"))
    bridge = heads.filter("class <> main").join(chief, "v").select(
        F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"), F.least("x.h", "y.h").alias("h"),
    ).filter(_possible(F.col("h"))).select("a", "b").distinct()
    bridge = written(bridge.join(pairs, ["a", "b"], "left_anti"), "bridge")
    labels = components(verified(bridge, docs), labels)
    pairs = pairs.union(bridge)
    # the values themselves only for members of lists that still hold several classes
    mixed = _mixed(members, labels)
    frequent = own.filter("h > 0").select(F.col("rep").alias("node"), F.col("frequent").alias("f"))
    mixed = mixed.join(frequent, F.col("rep") == F.col("node")).drop("node")
    side = lambda df, x: df.select(F.col("v").alias("v" + x), *[F.col(c).alias(to + x) for c, to in (("rep", "r"), ("n", "n"), ("h", "h"), ("class", "c"), ("f", "f"))])
    bound = F.least("ha", "hb")
    can = (F.col("ca") != F.col("cb")) & (100 * bound >= 75 * (F.col("na") + F.col("nb") - bound)) & (F.col("va") == F.array_min(F.array_intersect("fa", "fb")))
    rest = side(mixed.filter("class <> main"), "a").join(side(mixed, "b"), (F.col("va") == F.col("vb")) & can)
    rest = rest.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
    rest = written(rest.join(pairs, ["a", "b"], "left_anti"), "rest")
    labels = components(verified(rest, docs), labels)

    found = table.select("doc_id", *keys).join(classes, keys, "left").join(labels, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("label", "rep")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
