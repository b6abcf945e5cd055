"""Merkle manifest of a dataset: a hash tree over the rows of each group, the groups' roots below one root, and a proof per row.

Trees are built by rolling ranks up: the digits of a row's rank are columns, and grouping by all but the lowest one nests
the nodes of a run into their parent, level by level, within blocks of `FANOUT ** LEVELS` rows. A block's struct then holds
all of its nodes, and its proofs come out of it by transforms and one explode. The roots of blocks are rows of the next round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagekit.llm.common import ranked, stored

#: Nodes of a run that become one node.
FANOUT = 2
#: Levels that one round rolls up; a block has at most FANOUT ** LEVELS rows.
LEVELS = 8
#: Documents whose decimal id's crc32 this divides are tampered with in the trial.
TAMPERED = 7

#: Siblings of one step of a proof: the digests before and after the node's own, each joined.
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for NULL, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def siblings(path: Column) -> Column:
    """All siblings of a proof, level by level and left to right, joined."""
    return F.array_join(F.flatten(F.transform(path, lambda step: F.array(step["left"], step["right"]))), "")


def _height(rows: Column) -> Column:
    """Levels above so many leaves: the least power of FANOUT that is no less."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.pow(F.lit(float(FANOUT)), k) < rows)).cast("long")


def _roll_up(nodes: DataFrame) -> DataFrame:
    """Blocks (tree, block, height, node) of nodes (tree, rank, height, hash, body).

    A node is a struct of its hash and its children, or at the lowest level the body. Levels above a tree's root pass it on.
    The rows of a block are brought together once; every grouping has tree and block among its keys and needs no further shuffle.
    """
    digits = [f"digit{i}" for i in range(LEVELS)]
    rows = nodes.select(
        "tree", F.expr(f"rank div {FANOUT ** LEVELS}").alias("block"), "height",
        *[F.expr(f"cast((rank div {FANOUT ** i}) % {FANOUT} as int)").alias(d) for i, d in enumerate(digits)],
        F.struct("hash", "body").alias("node"),
    ).repartition("tree", "block")
    for level, lowest in enumerate(digits):
        kept = ["tree", "block", "height", *digits[level + 1:]]
        runs = rows.groupBy(*kept).agg(F.expr(f"array_sort(collect_list(named_struct('place', {lowest}, 'node', node))) AS kids"))
        above = f"CASE WHEN height > {level} THEN sha2(array_join(kids.node.hash, ''), 256) ELSE kids[0].node.hash END"
        rows = runs.selectExpr(*kept, f"named_struct('hash', {above}, 'kids', kids) AS node")
    return rows


def _rounds(nodes: DataFrame, highest: int) -> list[DataFrame]:
    """The stored blocks of each round, the last one with a single block per tree."""
    rounds = []
    for _ in range(max(1, -(-highest // LEVELS))):
        blocks = stored(_roll_up(nodes), "tree-blocks")
        rounds.append(blocks)
        nodes = blocks.select(
            "tree", F.col("block").alias("rank"), F.greatest(F.col("height") - LEVELS, F.lit(0)).alias("height"),
            F.col("node.hash").alias("hash"), F.struct(F.col("block").alias("rank")).alias("body"))
    return rounds


def _frontier() -> Column:
    """All nodes that entered a block, each with its path to the block's root: its children's children and so on, from the top.

    A kid's step of the path holds its siblings' digests. A level above the tree's root hashed nothing and adds no step.
    """
    nodes = f"array(named_struct('node', node, 'path', cast(array() AS {PATH})))"
    for level in reversed(range(LEVELS)):
        sides = ", ".join(
            f"'{name}', array_join(transform(filter(p.node.kids, x -> x.place {order} k.place), x -> x.node.hash), '')"
            for name, order in (("left", "<"), ("right", ">")))
        path = f"CASE WHEN height > {level} THEN concat(array(named_struct({sides})), p.path) ELSE p.path END"
        nodes = f"flatten(transform({nodes}, p -> transform(p.node.kids, k -> named_struct('node', k.node, 'path', {path}))))"
    return F.expr(nodes)


def _proofs(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Every node that entered the blocks, with its path to the root: tree, node, path and the columns `carried` from above.

    above: tree, block, path, carried. A block meets the path of its root as the row sorted before it; nothing is joined.
    """
    both = above.select("tree", "block", F.lit(0).alias("kind"), F.struct("path", "carried").alias("top")).unionByName(
        blocks.select("tree", "block", F.lit(1).alias("kind"), "height", "node"), allowMissingColumns=True)
    top = F.first("top").over(Window.partitionBy("tree", "block").orderBy("kind"))
    met = both.withColumn("top", top).where("kind = 1")
    return met.select("tree", "top", F.explode(_frontier()).alias("out")).select(
        "tree", F.col("out.node").alias("node"), F.concat(F.col("out.path"), F.col("top.path")).alias("path"),
        F.col("top.carried").alias("carried"))


def merkle_proofs(leaves: DataFrame, tree: str, order: list[str], leaf: str) -> DataFrame:
    """The given columns with `subroot`, `root` and `path` (siblings on the way from the leaf to the root, see `fold`).

    Rows of a tree are its leaves in `order` (NULLs first, ties by leaf). While a tree has several nodes, each run of
    FANOUT consecutive ones becomes the sha256 of their digests' hexadecimal text; a last run may be shorter, even one node. What remains
    is the subroot, a lone leaf itself. The subroots in the order of their trees (NULL first, bytewise) give the root in the same way.
    Repeated rows are leaves of their own; a NULL tree is a tree; an empty table gives no rows. Given columns may have any names
    but `subroot`, `root` and `path`, which are replaced.

    Ranks come from a sort by ranges, so a tree may hold any share of the rows; a block never has more than FANOUT ** LEVELS.
    A proof has as many steps as the trees have levels.
    """
    names = [c for c in leaves.columns if c not in ("subroot", "root", "path")]
    rows = leaves.select(
        F.col(tree).alias("tree"), *[F.col(c).alias(f"order{i}") for i, c in enumerate(order)], F.col(leaf).alias("hash"),
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("body"))
    nodes, totals = ranked(rows, ["tree"], [*[f"order{i}" for i in range(len(order))], "hash"], "leaves")
    heights = totals.select(F.col("tree").alias("t"), _height(F.col("total")).alias("height"))
    highest = heights.agg(F.max("height")).first()[0] or 0
    nodes = nodes.join(heights, F.col("tree").eqNullSafe(F.col("t")))
    rounds = _rounds(nodes.select("tree", "rank", "height", "hash", "body"), highest)

    roots = rounds[-1].select(F.lit(0).alias("all"), F.col("tree").alias("name"), F.col("node.hash").alias("hash"))
    placed, total = ranked(roots, ["all"], ["name"], "subroots")
    count = (total.first() or {"total": 0})["total"]
    top_height = F.lit(max(count - 1, 0).bit_length() if FANOUT == 2 else next(k for k in range(63) if FANOUT ** k >= count))
    tops = _rounds(placed.select(
        F.col("all").alias("tree"), "rank", top_height.cast("long").alias("height"), "hash", F.struct("name", F.col("hash").alias("subroot")).alias("body"),
    ), max(count - 1, 0).bit_length())
    start = tops[-1].select(
        "tree", "block", F.array().cast(PATH).alias("path"),
        F.struct(F.lit(None).cast("string").alias("subroot"), F.col("node.hash").alias("root")).alias("carried"))
    above = _down(tops, start).select(
        F.col("node.body.name").alias("tree"), F.lit(0).cast("long").alias("block"), "path",
        F.struct(F.col("node.body.subroot").alias("subroot"), F.col("carried.root").alias("root")).alias("carried"))
    proofs = _down(rounds, above)
    return proofs.select(*[F.col("node.body")[c].alias(c) for c in names], "carried.subroot", "carried.root", "path")


def _down(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """Proofs of the nodes that entered the first round."""
    for blocks in reversed(rounds[1:]):
        above = _proofs(blocks, above).select("tree", F.col("node.body.rank").alias("block"), "path", "carried")
    return _proofs(rounds[0], above)


def document_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the leaf of each document, and `tampered`: the leaf after one was added to n_chars where the trial does so, else NULL."""
    def leaf(n_chars: Column) -> Column:
        return leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    hit = (F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0) & F.col("n_chars").isNotNull()
    more = F.col("n_chars").cast("decimal(20,0)") + F.lit(1).cast("decimal(20,0)")
    return docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), F.when(hit, leaf(more)).alias("tampered"))


def document_manifest(docs: DataFrame) -> DataFrame:
    """Every document's leaf, roots and the digest of its proof, and the root folded from its leaf after the trial's tampering.

    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. NULLs in any column are part of the leaf; NULL doc_ids
    are never tampered with. The texts are hashed where they are read and not moved.
    """
    leaves = stored(document_leaves(docs), "leaf-hashes")
    proofs = merkle_proofs(leaves, "lang", ["doc_id"], "leaf")
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    out = proofs.select(
        "doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
