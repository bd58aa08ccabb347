"""MinHash near-duplicates from fast similarity sketches.

A document's set holds its distinct 5-word shingles (all of a shorter
document's words make one).  In each round of sketching every element is hashed
to a bin and to a value; a bin keeps the least value of the first round that
reaches it.  After ``BINS`` rounds, later rounds put all elements into one bin
each, so every coordinate is filled; the share of equal coordinates
concentrates around the Jaccard similarity as with independent hashes.

Bands of ``ROWS`` coordinates make buckets: a pair at 0.75 shares none of the 32
with probability 6e-6.  No bucket's pairs are enumerated: documents with equal
sets become one class first; every bucket's members are compared with a few of
its members that stand in the most populous buckets (hubs); buckets whose
members then are one component are done.  What is left is compared across
components, without a cap, but for pairs that can't be linked since too many
shingles of one are nobody else's.  Links are confirmed on the full sets, taken from
whole texts.  A hub's members are dealt out in salted groups, each with a copy
of the hub's text.  Counts and choices made for buckets and hubs are stored
before they are joined back, so that both sides of each such join are plain
shuffles, which Spark splits where a key is skewed.

Defined cases: null, empty and blank texts have the empty set and are linked
with nothing; repeated rows with one doc_id count as one document; a null
doc_id is a component of its own and isn't kept; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.llm import common
from vaultlens.llm.common import NOT_BLANK, arrow_schema, batch, discard, picked, stored

SHINGLE = 5
BINS = 128
ROWS = 4
BANDS = BINS // ROWS
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Parts, by hash, in which a set's shingles are counted to bound intersections.
PARTS = 32
#: Members that share a task with one copy of their hub's text.
GROUP = 200
STEP = [np.uint64(pow(0x9FB21C651E98DF25, k + 1, 1 << 64)) for k in range(SHINGLE)]

STEP_ARRAY = np.array(STEP, np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    data = common.ascii_lower(data)
    starts, ends, doc = common.words(data, offsets, NOT_BLANK)
    word = common.span_hash(data, starts, ends)
    runs = np.zeros(max(0, len(word) - SHINGLE + 1), np.uint64)
    for k, m in enumerate(STEP):
        runs += word[k : k + len(runs)] * m
    runs = common.mix64(runs)
    at = np.searchsorted(doc, np.arange(len(offsets))).tolist()
    out = []
    for i, j in zip(at, at[1:], strict=False):
        if j - i >= SHINGLE:
            out.append(np.unique(runs[i : j - SHINGLE + 1]))
        else:
            whole = (word[i:j] * STEP_ARRAY[: j - i]).sum(dtype=np.uint64, keepdims=True) + np.array([j - i], np.uint64)
            out.append(common.mix64(whole) if j > i else runs[:0])
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """BINS coordinates for each set; the empty set's are the largest integer."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    out = np.full(n * BINS, np.iinfo(np.int64).max, np.int64)
    elements, row = (np.concatenate(sets) if n else np.zeros(0, np.uint64)), np.repeat(np.arange(n), size)
    for i in range(2 * BINS):
        if not len(elements):
            break
        h = common.mix64(elements ^ np.uint64((i + 1) * 0xD1342543DE82EF95 % (1 << 64)))
        value = (h >> np.uint64(16)).astype(np.int64) + (i << 48)
        place = row * BINS + ((h & np.uint64(BINS - 1)).astype(np.int64) if i < BINS else i - BINS)
        np.minimum.at(out, place, value)
        open_ = (out.reshape(n, BINS) == np.iinfo(np.int64).max).any(1) & (size > 0)
        on = open_[row]
        if not on.all():
            elements, row = elements[on], row[on]
    return out.reshape(n, BINS)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """BANDS bucket keys for each sketch."""
    parts = sketches.reshape(len(sketches), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * common.PRIME, parts.shape[:2]).copy()
    for k in range(ROWS):
        key = common.mix64((key ^ parts[:, :, k]) + np.uint64(k + 1))
    return key.astype(np.int64)


def agree(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets without repeats are linked."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    inter = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * inter >= PERCENT * (len(both) - inter) > 0


SKETCH = "doc_id long, n_shingles long, digest_a long, digest_b long, bands array<bigint>, parts array<int>"


def sketches(docs: DataFrame) -> DataFrame:
    """SKETCH for every row of docs (doc_id, text); the digests tell sets apart."""
    out = arrow_schema(SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in common.chunks(b.column("text")):
                sets = shingles(data, off)
                total = [np.array([s.sum() for s in sets], np.uint64), np.array([common.mix64(s + np.uint64(1)).sum() for s in sets], np.uint64)]
                keys = band_keys(sketch(sets))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                row = np.repeat(np.arange(len(sets)), size)
                part = np.bincount(row * PARTS + (np.concatenate(sets) % np.uint64(PARTS)).astype(np.int64), minlength=PARTS * len(sets)).astype(np.int32)
                parts = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * PARTS, pa.int32()), pa.array(part))
                lists = bands.cast(out.field("bands").type), parts.cast(out.field("parts").type)
                yield batch(out, b.column("doc_id").slice(i, j - i).cast(pa.int64()), size, *(t.astype(np.int64) for t in total), *lists)

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


def bucket_members(classes: DataFrame) -> DataFrame:
    """key, node, n_shingles, popularity: the members of buckets of two or more classes.

    popularity adds up the sizes of the node's buckets.
    """
    in_bucket = classes.select("node", "n_shingles", F.explode("bands").alias("key"))
    sizes = stored(in_bucket.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "bucket-sizes")
    members = stored(in_bucket.join(sizes, "key"), "buckets")
    popularity = members.groupBy("node").agg(F.sum("size").alias("popularity"))
    out = stored(members.drop("size").join(popularity, "node"), "members")
    discard(sizes, members)
    return out


def hub_pairs(members: DataFrame) -> DataFrame:
    """Distinct (hub, node) to confirm: each member with its bucket's most popular, longest and shortest popular member."""
    by = lambda *c: F.max(F.struct(*c, "node", "n_shingles"))
    hubs = members.groupBy("key").agg(by("popularity").alias("a"), by("popularity", F.xxhash64("node").alias("h")).alias("b"), F.min(F.struct("node", "n_shingles")).alias("c"))
    hubs = hubs.select("key", F.explode(F.array_distinct(F.array(*(F.struct(F.col(x)["node"].alias("hub"), F.col(x)["n_shingles"].alias("hub_n")) for x in "abc")))).alias("h")).select("key", "h.*")
    hubs = stored(hubs, "hubs")
    return alike_in_size(members.join(hubs, "key").where("node != hub"), "n_shingles", "hub_n").select("hub", "node").distinct()


def alike_in_size(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Sets whose sizes alone keep them below the limit are never linked."""
    return pairs.where(100 * F.least(a, b) >= PERCENT * F.greatest(a, b))


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (hub, node) that are linked, on the full sets of texts (node, text)."""
    groups = pairs.groupBy("hub").agg(F.count("*").alias("n"))
    groups = stored(groups.withColumn("salts", F.ceil(F.col("n") / GROUP).cast("int")), "hub-groups")
    nodes = pairs.join(groups, "hub").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    rows = nodes.join(texts, "node").select("hub", "salt", F.lit(1).alias("kind"), "node", "text")
    hubs = groups.withColumnRenamed("hub", "node").join(texts, "node").select(F.col("node").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "node", "text")
    both = rows.unionByName(hubs).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for b in batches:
            for i, j, data, off in common.chunks(b.column("text")):
                part = b.slice(i, j - i)
                hub, salt, kind, node = (part.column(c).to_pylist() for c in ("hub", "salt", "kind", "node"))
                linked = []
                for k, s in enumerate(shingles(data, off)):
                    if at != (hub[k], salt[k]):
                        at, own = (hub[k], salt[k]), []
                    if kind[k] == 0:
                        own.append(s)
                    elif any(agree(s, o) for o in own):
                        linked.append((hub[k], node[k]))
                x, y = zip(*linked, strict=True) if linked else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["hub", "node"])

    return both.mapInArrow(run, "hub long, node long")


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node that links reach) for the nodes of links (hub, node).

    Every node takes the least label of its neighbours, then its label's label,
    until nothing changes; labels are written to the shared folder in each round.
    """
    both = links.select(F.col("hub").alias("a"), F.col("node").alias("b"))
    both = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        far = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = labels.join(far, "component", "left").join(near, "node", "left")
        new = stored(new.select("node", F.col("component").alias("was"), F.least("component", "far", "near").alias("component")), "labels")
        discard(labels)
        if new.where("was != component").isEmpty():
            discard(both)
            return new.drop("was")
        labels = new.drop("was")


def own_shingles(texts: DataFrame) -> DataFrame:
    """node, own: how many of its shingles no other node of texts (node, text) has, for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in common.chunks(b.column("text"), 1 << 20):
                sets = shingles(data, off)
                node = np.repeat(b.column("node").to_numpy(zero_copy_only=False)[i:j], [len(s) for s in sets])
                flat = np.concatenate(sets)
                part = (flat % np.uint64(PARTS)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(flat.astype(np.int64)), pa.array(part)], ["node", "shingle", "part"])

    tokens = texts.mapInArrow(run, "node long, shingle long, part int")
    once = tokens.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last"), F.first("part").alias("part")).where("node = last")
    return once.groupBy("node").agg(F.array(*(F.count_if(F.col("part") == k).cast("int") for k in range(PARTS))).alias("own"))


def unresolved_pairs(left: DataFrame, alone: DataFrame) -> DataFrame:
    """Distinct (hub, node) of different components that share a bucket, but for those that can't be linked.

    A pair's intersection has none of the shingles that only one node has, and
    in each part no more than the fewer of the two: both bounds are exact.
    left: key, node, n_shingles, component, parts.
    """
    shared = F.zip_with("parts", F.coalesce("own", F.array_repeat(F.lit(0), PARTS)), lambda p, o: p - o)
    left = left.join(alone, "node", "left").withColumn("parts", shared).drop("own")
    left = left.withColumn("shared", F.aggregate("parts", F.lit(0), lambda a, p: a + p))
    left = stored(left.where(100 * F.col("shared") >= PERCENT * F.col("n_shingles")), "unresolved")
    other = left.select("key", *(F.col(c).alias("hub" if c == "node" else f"hub_{c}") for c in ("node", "n_shingles", "component", "shared", "parts")))

    def reaches(most):
        return 100 * most >= PERCENT * (F.col("n_shingles") + F.col("hub_n_shingles") - most)

    by_part = sum((F.least(F.get("parts", F.lit(k)), F.get("hub_parts", F.lit(k))) for k in range(PARTS)), F.lit(0))
    able = F.expr("hub < node and hub_component != component") & reaches(F.least("shared", "hub_shared")) & reaches(by_part)
    return left.join(other, (left["key"] == other["key"]) & able).select("hub", "node").distinct()


def link_classes(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, component for the classes (node, n_shingles, bands, parts) that are linked with another."""
    members = bucket_members(classes)
    texts = docs.select(F.col("doc_id").alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    texts = stored(texts.join(members.select("node").distinct().hint("merge"), "node", "left_semi"), "member-texts")
    tried = stored(hub_pairs(members), "hub-pairs")
    links = stored(confirm(tried, texts), "hub-links")
    found = components(links)
    placed = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
    split = stored(split, "split-buckets")
    left = placed.join(split, "key").select("key", "node", "n_shingles", "component").join(classes.select("node", "parts"), "node")
    left = stored(left, "unresolved")
    alone = own_shingles(texts.join(left.select("node").distinct(), "node", "left_semi"))
    pairs = unresolved_pairs(left, alone)
    known = tried.select(F.least("hub", "node").alias("hub"), F.greatest("hub", "node").alias("node"))
    pairs = stored(pairs.join(known, ["hub", "node"], "left_anti"), "cross-pairs")
    more = stored(confirm(pairs, texts), "cross-links")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    discard(members, texts, tried, links, split, left, pairs, more)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    docs = picked(docs, "doc_id", "text")
    made = stored(sketches(docs), "sketches")
    key = ["digest_a", "digest_b", "n_shingles"]
    classes = made.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("parts").alias("parts"))
    classes = stored(classes, "classes")
    found = link_classes(classes, docs)
    classes = classes.select(*key, "node").join(found, "node", "left").select(*key, F.coalesce("component", "node").alias("class_component"))
    out = made.drop("bands", "parts").join(classes, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
