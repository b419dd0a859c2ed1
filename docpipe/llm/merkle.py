"""Merkle manifests of tables: mountain ranges by partition, merged where partitions meet, and a proof for every row.

Leaves are dealt by range, so a piece (a group's rows in one partition) is a stretch of a group's leaves with known
numbers. A piece keeps a stack of waiting nodes for each level. A block of `fanout` nodes that is full, or the last one of
its level, carries its hash a level up, as a counter does. What belongs to a block that begins or ends in another piece stays
open. Only open nodes, at most 2 * (fanout - 1) for each level of a piece, are merged between pieces, level by level; on the
way back each gets its path to the root, and pieces finish the paths of their leaves alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docpipe.llm.common import materialize, partitions

FANOUT = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: About how many leaves a piece holds at most.
PIECE = 500_000
STEPS = "array<struct<left: string, right: string>>"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(c: Column) -> Column:
    """A value as its byte count, a colon and itself; nulls as a dash."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(encoded, values)).cast("binary"), 256))


def level_size(total: Column, level: int, fanout: int) -> Column:
    """How many nodes a level has above `total` leaves."""
    width = F.lit(fanout**level)
    return F.floor((total + width - 1) / width) if level else total


def climb(leaves: list[str], start: int, total: int, fanout: int = FANOUT) -> Iterator[tuple[int, int, str, bool]]:
    """level, index, digest, open of the nodes that the leaves from number `start` of `total` make, but for leaves that are not open."""
    waiting: list[list[str]] = []
    after: list[int] = []  # the index behind the last waiting node
    sizes = [total]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // fanout))

    def listed(level: int, is_open: bool) -> Iterator[tuple[int, int, str, bool]]:
        block, waiting[level] = waiting[level], []
        if is_open or level:
            yield from ((level, after[level] - len(block) + i, digest, is_open) for i, digest in enumerate(block))

    for number, digest in enumerate(leaves, start):
        level, index = 0, number
        while True:
            if level == len(waiting):
                waiting.append([])
                after.append(0)
            waiting[level].append(digest)
            after[level] = index + 1
            if sizes[level] == 1 or ((index + 1) % fanout and index + 1 < sizes[level]):
                break
            block = waiting[level]
            begins_here = (after[level] - len(block)) % fanout == 0
            yield from listed(level, not begins_here)
            if not begins_here:
                break
            level, index, digest = level + 1, index // fanout, sha("".join(block))
    for level in range(len(waiting)):
        yield from listed(level, True)


def descend(leaves: list[str], level: int, above: list[tuple[str, str]], fanout: int = FANOUT) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """Each leaf of a node at `level` with its path: of every level up to the root what stands left and right of it."""
    levels = [leaves]
    for _ in range(level):
        levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])

    def below(at: int, index: int, path: list[tuple[str, str]]) -> Iterator[tuple[str, list[tuple[str, str]]]]:
        if at == 0:
            yield leaves[index], path
            return
        block = levels[at - 1][index * fanout : (index + 1) * fanout]
        for i in range(len(block)):
            yield from below(at - 1, index * fanout + i, [("".join(block[:i]), "".join(block[i + 1 :])), *path])

    yield from below(level, 0, above)


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its path lead to."""
    for left, right in path:
        leaf = sha(left + leaf + right)
    return leaf


@dataclass
class Tree:
    """A tree for each group of leaves (g, order columns, leaf, others), all written tables but for `open`."""

    placed: DataFrame  #: the leaves with part and at, their place in it
    nodes: DataFrame  #: g, part, level, idx, digest, open, total: what the pieces made
    merged: list[DataFrame]  #: by level, from 1: g, idx, digest, total, children (idx, digest, part)
    fanout: int

    def subroots(self) -> DataFrame:
        """g and digest of every group's top node."""
        tops = [self.nodes.where("open").where(level_size(F.col("total"), level, self.fanout) == 1).where(F.col("level") == level).select("g", "digest", "part", F.lit(level).alias("level")) for level in range(len(self.merged) + 1)]
        tops += [made.where(level_size(F.col("total"), level, self.fanout) == 1).select("g", "digest", F.lit(None).cast("int").alias("part"), F.lit(level).alias("level")) for level, made in enumerate(self.merged, 1)]
        out = tops[0]
        for top in tops[1:]:
            out = out.unionByName(top)
        return out

    def all_nodes(self) -> DataFrame:
        """g, level, idx, digest of every node above the leaves."""
        out = self.nodes.where("level > 0").select("g", "level", "idx", "digest")
        for level, made in enumerate(self.merged, 1):
            out = out.unionByName(made.select("g", F.lit(level).alias("level"), "idx", "digest"))
        return out

    def anchors(self, above: DataFrame) -> DataFrame:
        """The pieces' open nodes with their paths: g, part, level, idx, steps, subroot; above: g, steps and subroot of every top.

        Written level by level from the top, each with one join by group and parent.
        """
        tops = self.subroots().join(above, "g").select("g", "part", "level", F.lit(0).cast("long").alias("idx"), "steps", "subroot")
        held = materialize(tops, "tops")
        out = held
        at = held.where(F.col("level") == len(self.merged))
        for level in range(len(self.merged), 0, -1):
            paths = at.select("g", "idx", "steps", "subroot").join(self.merged[level - 1].select("g", "idx", "children"), ["g", "idx"])
            child = paths.select("g", "steps", "subroot", "children", F.posexplode("children").alias("i", "child"))
            left, right = (F.array_join(F.transform(F.slice("children", begin, length), lambda c: F.lower(F.hex(c["digest"]))), "") for begin, length in ((F.lit(1), F.col("i")), (F.col("i") + 2, F.greatest(F.size("children") - F.col("i") - 1, F.lit(0)))))
            step = F.array(F.struct(left.alias("left"), right.alias("right")))
            made = child.select("g", F.col("child.part").alias("part"), F.lit(level - 1).alias("level"), F.col("child.idx").alias("idx"), F.concat(step, "steps").alias("steps"), "subroot")
            made = materialize(made, "paths")
            out = out.unionByName(made)
            at = made.unionByName(held.where(F.col("level") == level - 1))
        return out.where("part is not null")


def build_tree(leaves: DataFrame, order: list[str], fanout: int = FANOUT, piece: int = PIECE) -> Tree:
    """The trees of leaves (g, the columns of `order`, leaf, others), a written table; groups may be of any number and size.

    Rows that are alike in `order` and leaf are interchangeable; they are dealt on by their place, so no group of them has to
    fit in a partition.
    """
    spark = leaves.sparkSession
    parts = max(partitions(spark), -(-leaves.count() // piece))
    keys = ["g", *order, "leaf", "__place"]
    dealt = leaves.withColumn("__place", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    in_part = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = materialize(dealt.withColumns({"part": F.spark_partition_id(), "at": in_part}).drop("__place"), "placed")
    by_part = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("g", "part").agg(F.count("*").alias("n"))
    pieces = materialize(counts.select("g", "part", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("g")).alias("total")), "pieces")

    def run(key: tuple, rows: pa.Table, piece: pa.Table) -> pa.Table:
        start, total = piece.column("start")[0].as_py(), piece.column("total")[0].as_py()
        digests = [x.hex() for x in rows.sort_by("at").column("leaf").to_pylist()]
        made = list(climb(digests, start, total, fanout))
        levels, indexes, hashes, is_open = zip(*made, strict=True)
        n = len(made)
        columns = [pa.array([key[0].as_py()] * n, pa.string()), pa.array([key[1].as_py()] * n, pa.int32()), pa.array(levels, pa.int32()), pa.array(indexes, pa.int64()), pa.array(map(bytes.fromhex, hashes), pa.binary()), pa.array(is_open, pa.bool_()), pa.array([total] * n, pa.int64())]
        return pa.table(columns, ["g", "part", "level", "idx", "digest", "open", "total"])

    grouped = placed.select("g", "part", "at", "leaf").groupBy("g", "part").cogroup(pieces.groupBy("g", "part"))
    nodes = materialize(grouped.applyInArrow(run, "g string, part int, level int, idx long, digest binary, open boolean, total long"), "nodes")
    most = pieces.agg(F.max("total")).first()[0] or 1
    merged: list[DataFrame] = []
    while most > fanout ** len(merged):
        level = len(merged)
        here = nodes.where("open").where(F.col("level") == level).select("g", "idx", "digest", "part", "total")
        if merged:
            here = here.unionByName(merged[-1].select("g", "idx", "digest", F.lit(None).cast("int").alias("part"), "total"))
        size = level_size(F.col("total"), level, fanout)
        blocks = here.where(size > 1).groupBy("g", F.floor(F.col("idx") / fanout).alias("up")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest", "part"))).alias("children"), F.max("total").alias("total"))
        due = F.least(F.lit(fanout), size - F.col("up") * fanout)
        digest = F.unhex(F.sha2(F.array_join(F.transform("children", lambda c: F.lower(F.hex(c["digest"]))), "").cast("binary"), 256))
        whole = F.when(F.size("children") == due, digest).otherwise(F.raise_error(F.lit("a block of the tree has not all of its nodes")))
        merged.append(materialize(blocks.select("g", F.col("up").alias("idx"), whole.alias("digest"), "total", "children"), "merged"))
    return Tree(placed, nodes, merged, fanout)


@dataclass
class Manifest:
    """The trees of a table's groups, and the tree of their tops."""

    groups: Tree
    tops: Tree

    def root(self) -> DataFrame:
        """The one root, as text; no row for an empty table."""
        return self.tops.subroots().select(F.lower(F.hex("digest")).alias("root"))

    def subroots(self) -> DataFrame:
        """lang and subroot of every group."""
        return self.groups.subroots().select(F.when(F.col("g") != "n", F.substring("g", 2, 1 << 30)).alias("lang"), F.lower(F.hex("digest")).alias("subroot"))

    def nodes(self) -> DataFrame:
        """lang, level (from 1), idx and digest of every inner node of the groups' trees."""
        return self.groups.all_nodes().select(F.when(F.col("g") != "n", F.substring("g", 2, 1 << 30)).alias("lang"), "level", "idx", F.lower(F.hex("digest")).alias("digest"))

    def proofs(self) -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; see `manifest`.

        Rows meet their pieces' open nodes by piece, so a task holds one piece's leaves and paths at a time.
        """
        fanout = self.groups.fanout
        none = F.expr(f"cast(array() as {STEPS})")
        root = F.lower(F.hex("digest"))
        first = self.tops.subroots().select("g", none.alias("steps"), root.alias("subroot"))
        top_paths = _leaf_paths(self.tops, first)  # a row for each group
        above = self.tops.placed.select(F.col("group").alias("g"), "part", "at", F.lower(F.hex("leaf")).alias("subroot")).join(top_paths, ["part", "at"]).select("g", F.col("steps"), F.struct("subroot", "root").alias("subroot"))
        anchors = self.groups.anchors(above).select("g", "part", "level", "idx", "steps", F.col("subroot.subroot").alias("subroot"), F.col("subroot.root").alias("root"))

        def run(rows: pa.Table, held: pa.Table) -> pa.Table:
            out: list[list] = [[] for _ in range(7)]
            rows = rows.sort_by("at")
            leaves = [x.hex() for x in rows.column("leaf").to_pylist()]
            ids, claims, at = rows.column("order").to_pylist(), rows.column("claim").to_pylist(), 0
            nodes = sorted(((a["idx"] * fanout ** a["level"], a) for a in held.to_pylist()), key=lambda x: x[0])
            begin = nodes[0][0]
            for number, (start, node) in enumerate(nodes):
                stop = nodes[number + 1][0] - begin if number + 1 < len(nodes) else len(leaves)
                part, above = leaves[start - begin : stop], [(s["left"], s["right"]) for s in node["steps"]]
                for leaf, path in descend(part, node["level"], above, fanout):
                    claim = claims[at]
                    to = folded(leaf if claim is None else claim.hex(), path)
                    values = (ids[at], leaf, node["subroot"], node["root"], sha("".join(left + right for left, right in path)), to, to == node["root"])
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                    at += 1
            kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            return pa.table([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

        rows = self.groups.placed.select("g", "part", "at", "order", "leaf", "claim")
        return rows.groupBy("g", "part").cogroup(anchors.groupBy("g", "part")).applyInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _leaf_paths(tree: Tree, above: DataFrame) -> DataFrame:
    """part, at, steps and root of every leaf of the tree over the groups' tops."""
    fanout = tree.fanout

    def run(rows: pa.Table, held: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        leaves, places, steps, at = [x.hex() for x in rows.column("leaf").to_pylist()], rows.column("at").to_pylist(), [], 0
        nodes = sorted(((a["idx"] * fanout ** a["level"], a) for a in held.to_pylist()), key=lambda x: x[0])
        begin = nodes[0][0]
        for number, (start, node) in enumerate(nodes):
            stop = nodes[number + 1][0] - begin if number + 1 < len(nodes) else len(leaves)
            for _, path in descend(leaves[start - begin : stop], node["level"], [(s["left"], s["right"]) for s in node["steps"]], fanout):
                steps.append([{"left": left, "right": right} for left, right in path])
        at = len(steps)
        kinds = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.table([pa.array([rows.column("part")[0].as_py()] * at, pa.int32()), pa.array(places, pa.int64()), pa.array(steps, kinds), pa.array([nodes[0][1]["subroot"]] * at, pa.string())], ["part", "at", "steps", "root"])

    return tree.placed.select("g", "part", "at", "leaf").groupBy("g", "part").cogroup(tree.anchors(above).groupBy("g", "part")).applyInArrow(run, f"part int, at long, steps {STEPS}, root string")


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, order: str = "doc_id", group: str = "lang", claim: dict[str, Column] | None = None, where: Column | None = None, fanout: int = FANOUT, piece: int = PIECE) -> Manifest:
    """Builds the trees of a table: a leaf for each row, over `columns`, by `order` (a whole number) within each `group`.

    claim: columns as somebody else holds them; `proofs` folds those rows' leaves (where `where` holds) in place of the true
    ones, and says whether they lead to the root. Null values count as such in a leaf; a null group comes first, and null
    ids first in their group; rows of one id are ordered by their leaves; rows alike are leaves of their own. Texts may be of
    any length. Empty tables have no root and no proofs; columns that are not named are not read, so their names can't clash.
    """
    values = [docs[c] for c in columns]
    claimed = [(claim or {}).get(c, docs[c]) for c in columns]
    g = F.when(docs[group].isNull(), "n").otherwise(F.concat(F.lit("v"), docs[group].cast("string")))
    other = F.when(where if where is not None else F.lit(False), leaf_hash(claimed)) if claim else F.lit(None).cast("binary")
    leaves = materialize(docs.select(g.alias("g"), docs[order].cast("long").alias("order"), leaf_hash(values).alias("leaf"), other.alias("claim")), "leaves")
    groups = build_tree(leaves, ["order"], fanout, piece)
    tops = materialize(groups.subroots().select(F.lit("t").alias("g"), F.col("g").alias("group"), F.col("digest").alias("leaf")), "subroots")
    return Manifest(groups, build_tree(tops, ["group"], fanout, piece))


def report(docs: DataFrame) -> DataFrame:
    """A proof for every row of `docs`, where texts of a third of the rows (crc32 of the id divisible by three) were tampered
    with: their capitals A to Z are small. Rows without an id are not tampered with; see `manifest` for the rest."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    small = F.translate(docs["text"], upper, upper.lower())
    where = F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return manifest(docs, claim={"text": small}, where=where).proofs()


def oracle(levels: int = 7, top_levels: int = 2) -> str:
    """The report in DuckDB SQL, with one query for each level of the trees: for up to 8 ** levels rows a language."""
    part = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end"
    leaf = lambda text: "sha256(" + " || ".join(part(text if c == "text" else c) for c in COLUMNS) + ")"
    one = "case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end"
    crc = f"xor(list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda s: ascii(s)::bigint), lambda x, b: list_reduce([xor(x, b)] || range(8), lambda c, i: {one})), 4294967295)"
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    up = lambda c: f"case when len({c}) > 1 then list_transform(range(0, len({c}), 8), lambda i: sha256(array_to_string({c}[i + 1 : i + 8], ''))) else {c} end"
    sql = f"""with d as (select doc_id, lang, {leaf('text')} as leaf, case when {crc} % 3 = 0 then {leaf(small)} else {leaf('text')} end as claim, row_number() over (partition by lang order by doc_id) - 1 as i from documents),
l0 as (select lang, list(leaf order by i) as l from d group by lang)"""
    for k in range(levels):
        sql += f", l{k + 1} as (select lang, {up('l')} as l from l{k})"
    sql += f", s as (select lang, l[1] as subroot, row_number() over (order by lang nulls first) - 1 as i from l{levels}), t0 as (select list(subroot order by i) as l from s)"
    for k in range(top_levels):
        sql += f", t{k + 1} as (select {up('l')} as l from t{k})"
    sql += ", f0 as (select d.doc_id, d.lang, leaf, claim as cur, '' as proof, d.i, subroot, s.i as top from d join s on d.lang is not distinct from s.lang)"
    for k in range(levels + top_levels):
        table, index = (f"l{k}", "i") if k < levels else (f"t{k - levels}", "top")
        join = f"join {table} on f.lang is not distinct from {table}.lang" if k < levels else f", {table}"
        sql += f""", g{k} as (select f.*, l[{index} // 8 * 8 + 1 : {index} // 8 * 8 + 8] as b, len(l) > 1 as more, {index} % 8 as p from f{k} f {join}),
f{k + 1} as (select doc_id, lang, leaf, case when more then sha256(array_to_string(b[1 : p] || [cur] || b[p + 2 :], '')) else cur end as cur, case when more then proof || array_to_string(b[1 : p] || b[p + 2 :], '') else proof end as proof,
  {"i // 8" if k < levels else "i"} as i, subroot, {"top" if k < levels else "top // 8"} as top from g{k})"""
    return sql + f" select doc_id, leaf, subroot, l[1] as root, sha256(proof) as proof_sha256, cur as folded_root, cur = l[1] as verified from f{levels + top_levels}, t{top_levels}"


ORACLE = oracle()
