"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of shingle multisets, banding, exact multiset overlap.

An element of weight w (a shingle and its count) owns the discretised weight axis (0, w]. The axis is split into dyadic
blocks [0,1), [1,2), [2,4), [4,8) ...; each block of an element is a Poisson process in time whose rate is the block's
length. A point's further bits say where in the block it lies (the binary refinement of the process), and points beyond w
are dropped: thus two documents see the same points up to the smaller weight. Each point falls into one of the
signature's slots, which keeps the earliest time; the chance that two slots agree is sum(min) / sum(max), the weighted
Jaccard similarity. Points later than every slot's time can't matter, so most processes end after one point.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.llm import spans
from docpipe.llm.common import bounded_batches, materialize, partitions, runs, slices, text_or_empty
from docpipe.llm.components import components

WORDS = 5
THRESHOLD = 0.8
BANDS = 26
ROWS = 5
SLOTS = BANDS * ROWS
#: Pairs of a bucket that differ in label are compared in full where so many of their slots agree: 5 standard errors below
#: the threshold, so that one pair in a million at the threshold is passed over. With 0 every such pair is compared.
ESTIMATE = 0.62
#: A bucket's nodes are compared in blocks of about so many rows, or bytes of text.
BLOCK, BLOCK_BYTES = 256, 1_000_000
#: Rounds in which a bucket is compared with one hub before what is left is compared in full.
HUB_ROUNDS = 1
LAST_ID = 2**63 - 1
STEP = np.uint64(0x9E3779B97F4A7C15)


def multisets(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, element and count of each document's distinct shingles, in order of both."""
    hashes, bounds = spans.shingles(texts, words)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(bounds))
    keys = np.sort((doc << np.uint64(44)) | (hashes >> np.uint64(20)))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    keys, counts = keys[first], np.diff(np.append(first, len(keys)))
    return (keys >> np.uint64(44)).astype(np.int64), keys & np.uint64((1 << 44) - 1), counts


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """n rows of `slots` times; a document without elements has infinities."""
    out = np.full(n * slots, np.inf)
    if not len(doc):
        return out.reshape(n, slots)
    units = []
    for level in range(int(weight.max()).bit_length() + 1):
        low, rate = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
        has = np.flatnonzero(weight > low) if level else np.arange(len(doc))
        if len(has):
            seed = spans.mix(element[has] * np.uint64(64) + np.uint64(level))
            units.append((doc[has], seed, np.full(len(has), float(rate)), weight[has] - low))
    of, seed, rate, room = (np.concatenate(x) for x in zip(*units, strict=True))
    time, drawn = np.zeros(len(of)), 0
    with np.errstate(over="ignore"):
        while len(of):
            k = int(np.clip(8192 // len(of), 1, 64))
            bits = spans.mix(seed[:, None] + (np.arange(drawn, drawn + k, dtype=np.uint64) + np.uint64(1)) * STEP)
            waits = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[:, None]
            # summed from the left, point by point: the same bits whatever else is in the batch
            times = np.cumsum(np.concatenate([time[:, None], waits], axis=1), axis=1)[:, 1:]
            more = spans.mix(bits ^ np.uint64(0x5851F42D4C957F2D))
            slot = (more >> np.uint64(32)) % np.uint64(slots)
            inside = (more & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * rate[:, None] < room[:, None]
            np.minimum.at(out, (of[:, None] * slots + slot.astype(np.int64))[inside], times[inside])
            latest = out.reshape(n, slots).max(axis=1)
            time, drawn = times[:, -1], drawn + k
            alive = time < latest[of]
            of, seed, rate, room, time = of[alive], seed[alive], rate[alive], room[alive], time[alive]
    return out.reshape(n, slots)


def similarity(a: str, b: str, words: int = WORDS) -> float:
    """sum(min) / sum(max) of the two multisets of shingles; 0 if either has no words."""
    doc, element, count = multisets([a, b], words)
    left, right = doc == 0, doc == 1
    if not left.any() or not right.any():
        return 0.0
    _, i, j = np.intersect1d(element[left], element[right], assume_unique=True, return_indices=True)
    shared = np.minimum(count[left][i], count[right][j]).sum()
    return float(shared / (count.sum() - shared))


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, md5 of the text, size, bands (a key for each band; none without words) and 16 bits of each slot."""

    def run(batches):
        for batch, texts in slices(batches, "text"):
            times = signatures(*multisets(texts), len(texts), bands * rows)
            bits = spans.mix(times.view(np.uint64))
            keys = np.zeros((len(texts), bands), np.uint64)
            for i in range(rows):
                keys = spans.mix(keys + bits[:, i::rows][:, :bands] + np.uint64(i + 1))
            keys = spans.mix(keys + np.arange(bands, dtype=np.uint64)).view(np.int64)
            some = np.isfinite(times[:, 0])
            lists = pa.array([list(k) if s else [] for k, s in zip(keys, some, strict=True)], pa.list_(pa.int64()))
            small = pa.array([x.tobytes() for x in (bits & np.uint64(0xFFFF)).astype("<u2")], pa.binary())
            data = [t.encode("utf-8", "surrogatepass") for t in texts]
            nodes, sizes = pa.array([hashlib.md5(x).hexdigest() for x in data], pa.string()), pa.array([len(x) for x in data], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), nodes, sizes, lists, small], ["doc_id", "md5", "size", "bands", "slots"])

    rows_in = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows_in.mapInArrow(run, "doc_id long, md5 string, size long, bands array<long>, slots binary")


class Bags:
    """The multisets of some texts, for overlaps of one with several others."""

    def __init__(self, texts: list[str]):
        whole, parts, sizes = [pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])], [], []
        for _, held in slices(whole, "text"):
            parts.append(multisets(held))
            sizes.append(np.bincount(parts[-1][0], minlength=len(held)))
        n = np.concatenate([np.zeros(0, np.int64), *sizes]).astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(n)])
        self.count = np.concatenate([np.zeros(0, np.int64), *(count for _, _, count in parts)])
        self.element = np.unique(np.concatenate([np.zeros(0, np.uint64), *(element for _, element, _ in parts)]), return_inverse=True)[1].astype(np.int32)
        total = np.concatenate([[0], np.cumsum(self.count)])
        self.total = total[self.bounds[1:]] - total[self.bounds[:-1]]
        self.held = np.zeros(int(self.element.max(initial=-1)) + 1, np.int64)

    def overlaps(self, one: int, others: np.ndarray, most: int = 500_000) -> np.ndarray:
        """sum(min) / sum(max) of one text's multiset and those of others; 0 if either has no words."""
        mine = slice(self.bounds[one], self.bounds[one + 1])
        self.held[self.element[mine]] = self.count[mine]
        n = self.bounds[others + 1] - self.bounds[others]
        shared = np.zeros(len(others), np.int64)
        for part in np.split(np.arange(len(others)), np.flatnonzero(np.diff(np.cumsum(n) // most)) + 1):
            m = n[part]
            at = np.repeat(self.bounds[others[part]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            least = np.minimum(self.held[self.element[at]], self.count[at])
            shared[part] = np.bincount(np.repeat(np.arange(len(part)), m), least, len(part))
        self.held[self.element[mine]] = 0
        both = self.total[one] + self.total[others] - shared
        return np.where((self.total[one] > 0) & (self.total[others] > 0), shared / np.maximum(both, 1), 0.0)


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs a, b whose texts (node, text) have at least that multiset overlap."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b").select("a", "b", "left", "right")

    def run(batches):
        for batch, left in slices(batches, "left"):
            for part, right in slices([batch.append_column("at", pa.array(range(len(left))))], "right"):
                at = part.column("at").to_pylist()
                place = {text: i for i, text in enumerate(dict.fromkeys([*(left[i] for i in at), *right]))}
                bags = Bags(list(place))
                keep = [bags.overlaps(place[left[i]], np.array([place[text]]))[0] >= threshold for i, text in zip(at, right, strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def first_shared(bands: np.ndarray, one: int, others: np.ndarray) -> np.ndarray:
    """The first band that a row shares with each of the others (which share one)."""
    return (bands[others] == bands[one]).argmax(axis=1)


def partners(group: pa.Table, estimate: float) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a pair of blocks, each with the rows that differ from it in label and agree with it to `estimate`.

    A pair that shares several bands is left to the bucket of the first.
    """
    label, node, mine = (group.column(name).to_numpy() for name in ("label", "node", "mine"))
    slots = np.frombuffer(b"".join(group.column("slots").to_pylist()), "<u2").reshape(len(label), -1)
    bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(label), -1)
    of = group.column("g")[0].as_py()
    one, two = np.flatnonzero(mine == of["i"]), np.flatnonzero(mine == of["j"])
    if not len(two) or (label == label[0]).all():
        return
    for x in one.tolist():
        near = two[label[two] != label[x]]
        if of["i"] == of["j"]:
            near = near[node[near] > node[x]]
        near = near[(slots[near] == slots[x]).mean(axis=1) >= estimate] if len(near) else near
        near = near[bands[near, first_shared(bands, x, near)] == of["key"]] if len(near) else near
        if len(near):
            yield x, near


def block_groups(members: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`members` (key, n, bytes, node, label, slots, bands) dealt to pairs of blocks: g (key, i, j) and mine, the row's block.

    Large buckets are cut into blocks; each pair of blocks is a group of its own, so no group grows with the bucket.
    """
    n = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / block_bytes)).cast("int")
    left = members.withColumn("mine", F.pmod(F.xxhash64("node"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    g = F.struct("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).alias("g")
    return left.select(g, "mine", "node", "label", "slots", "bands")


ROWS_OF = "g struct<key:bigint,i:int,j:int>, mine int, node long, label long, slots binary, bands array<long>"


def with_partners(groups: DataFrame, estimate: float = ESTIMATE) -> DataFrame:
    """The rows of `groups` that have a partner, or are one, in their group: at most all of them."""
    names = ["g", "mine", "node", "label", "slots", "bands"]

    def run(batches):
        for _, group in runs(batches, "g"):
            wanted = np.zeros(group.num_rows, bool)
            for x, near in partners(group, estimate):
                wanted[x] = wanted[near] = True
            if wanted.any():
                yield from group.filter(pa.array(wanted)).select(names).combine_chunks().to_batches()

    keyed = groups.repartition(partitions(groups.sparkSession), "g").sortWithinPartitions("g")
    return keyed.mapInArrow(run, ROWS_OF)


def group_links(rows: DataFrame, texts: DataFrame, threshold: float, estimate: float = ESTIMATE) -> DataFrame:
    """Links a, b between rows of a group that differ in label: a spanning forest of those with the overlap, so at most one
    for each row. All partners are compared in full, but for pairs that links of the group connect already.
    """

    def run(batches):
        for _, group in runs(batches, "g"):
            bags, node = Bags(group.column("text").to_pylist()), group.column("node").to_pylist()
            parent = dict.fromkeys(group.column("label").to_pylist())
            label, a, b = group.column("label").to_pylist(), [], []

            def root(x: int) -> int:
                while parent[x] is not None:  # noqa: B023
                    x = parent[x]  # noqa: B023
                return x

            for x, near in partners(group, estimate):
                near = np.array([y for y in near.tolist() if root(label[y]) != root(label[x])], np.int64)
                if not len(near):
                    continue
                for y in near[bags.overlaps(x, near) >= threshold].tolist():
                    one, two = root(label[x]), root(label[y])
                    if one != two:
                        parent[one] = two
                        a.append(min(node[x], node[y]))
                        b.append(max(node[x], node[y]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    keyed = rows.join(texts, "node").repartition(partitions(rows.sparkSession), "g").sortWithinPartitions("g")
    return keyed.mapInArrow(run, "a long, b long")


def hub_pairs(labelled: DataFrame, edges: DataFrame, seed: int) -> DataFrame:
    """Pairs a < b of each node with the hub of its bucket, if they differ in label.

    The hub is drawn by chance, the likelier the more links a node has; the same nodes are drawn in many buckets.
    """
    ends = edges.select("a").unionByName(edges.select(F.col("b").alias("a")))
    links = ends.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("links"))
    chance = (F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(1_000_003)) + 1) / F.lit(1_000_005.0)
    weight = F.pow(chance, 1 / (F.coalesce("links", F.lit(0)) + 1))
    hubs = materialize(labelled.join(links, "node", "left").groupBy("key").agg(F.max_by("node", weight).alias("hub"), F.max_by("label", weight).alias("hub_label")), "hubs")
    pairs = labelled.join(hubs, "key").where("label <> hub_label")
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` (node, label) with the classes joined that `links` (a, b) connect; only the links' own labels are searched."""
    one, two = (labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")) for end in ("a", "b"))
    between = links.join(one, "a").join(two, "b").where("a_label <> b_label").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
    joined = components(between).select(F.col("node").alias("label"), F.col("label").alias("joined"))
    return materialize(labels.join(joined, "label", "left").select("node", F.coalesce("joined", "label").alias("label")), "labels")


def labelled_nodes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, estimate: float = ESTIMATE) -> tuple[DataFrame, DataFrame]:
    """The sketches of `docs`, and md5, first (its smallest doc_id, LAST_ID if all are null), copies, label (of its class).

    Exact copies are one node (null texts count as empty; empty texts are copies of each other, wordless texts link to
    nothing else), numbered once the nodes are written. Nodes that share a band key are compared first with the smallest
    node of the bucket, then with hubs; buckets whose nodes still differ in class are compared in full, block by block. A
    link is a multiset overlap of at least `threshold`; classes are the connected components. Rows with a null doc_id take
    part. What a key's rows come to (its head, its hub, whether its labels differ) is aggregated before the shuffle and
    written, so that the joins back to the rows can be split where a key is hot.
    """
    bounded_batches(docs.sparkSession)
    sigs = materialize(sketches(docs, bands, rows), "sketches")
    one = [F.first(name).alias(name) for name in ("size", "bands", "slots")]
    nodes = sigs.groupBy("md5").agg(F.min(F.coalesce("doc_id", F.lit(LAST_ID))).alias("first"), F.count("*").alias("copies"), *one)
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keys = nodes.select("node", "size", F.explode("bands").alias("key"))
    heads = materialize(keys.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1"), "heads")
    members = materialize(keys.drop("size").join(heads, "key"), "members")
    shared = members.select("node").distinct()

    wanted = nodes.select("node", "md5", "first").join(shared, "node", "left_semi")
    texts = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST_ID)).alias("first"), text_or_empty().alias("text")).withColumn("md5", F.md5("text"))
    texts = materialize(texts.join(wanted, ["first", "md5"]).dropDuplicates(["node"]).select("node", "text"), "texts")

    tried = materialize(members.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    edges = materialize(verify(tried, texts, threshold), "verified")
    labels = materialize(texts.select("node").join(components(edges), "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")

    def mixed() -> DataFrame:
        """The members, with labels, of buckets in which labels differ."""
        labelled = members.drop("head").join(labels, "node")
        differ = materialize(labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key"), "differ")
        return materialize(labelled.join(differ, "key"), "mixed")

    rest = mixed()
    for seed in range(HUB_ROUNDS):
        pairs = materialize(hub_pairs(rest.select("key", "node", "label"), edges, seed).join(tried, ["a", "b"], "left_anti"), "pairs")
        more = materialize(verify(pairs, texts, threshold), "verified")
        if not more.isEmpty():
            tried, edges = tried.unionByName(pairs), edges.unionByName(more)
            labels = relabelled(labels, more)
            rest = mixed()
    found = with_partners(block_groups(rest.join(nodes.select("node", "slots", "bands"), "node")), estimate)
    more = materialize(group_links(found, texts, threshold, estimate), "verified")
    if not more.isEmpty():
        labels = relabelled(labels, more)
    return sigs, nodes.select("node", "md5", "first", "copies").join(labels, "node", "left").select("md5", "first", "copies", F.coalesce("label", "node").alias("label"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, estimate: float = ESTIMATE) -> DataFrame:
    """doc_id, text_md5, class_id (the smallest doc_id of the class) and class_size, a row per input row.

    Null texts count as empty, and empty texts are one class. A class of only rows with a null doc_id has a null class_id;
    ties and repeated rows are members like others. Empty tables give no rows; other columns are not read.
    """
    sigs, of_node = labelled_nodes(docs, threshold, bands, rows, estimate)
    classes = of_node.groupBy("label").agg(F.min("first").alias("class_first"), F.sum("copies").alias("class_size"))
    node_class = materialize(of_node.join(classes, "label").select("md5", "class_first", "class_size"), "node-classes")
    return sigs.select("doc_id", "md5").join(node_class, "md5").select("doc_id", F.col("md5").alias("text_md5"), F.expr(f"nullif(class_first, {LAST_ID})").alias("class_id"), "class_size")


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, estimate: float = ESTIMATE) -> DataFrame:
    """`docs` with one row of each class: that with the smallest doc_id (null as the largest), then the smallest md5 of the text.

    All columns stay, whatever their names; of repeated rows one stays, of null and empty texts one
    in all. Empty tables stay empty.
    """
    taken = {c.lower() for c in docs.columns}
    md5, key = (next(n for n in (f"{base}{'_' * i}" for i in range(len(taken) + 1)) if n not in taken) for base in ("__md5", "__id"))
    _, of_node = labelled_nodes(docs, threshold, estimate=estimate)
    kept = of_node.groupBy("label").agg(F.min(F.struct("first", "md5")).alias("k")).select(F.col("k.first").alias(key), F.col("k.md5").alias(md5))
    marked = docs.withColumns({md5: F.md5(text_or_empty()), key: F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST_ID))})
    return marked.join(kept, [key, md5], "left_semi").dropDuplicates([key, md5]).drop(key, md5)
