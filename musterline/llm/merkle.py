"""Merkle manifest of a dataset: a digest for every row, a root for all, and proofs between them.

A tree hashes every ``FAN`` consecutive nodes of one key into a parent until one node is left. Nodes lie in rows;
the digest of a node of level k stands on the row of its first leaf. So its siblings stand a fixed number of rows
away, ``FAN**k`` for each place: lag and lead columns with these offsets, masked by the node's slot in its run and
by the length of the run, hold the siblings, and the rows of first children hash the parents. ``LEVELS`` levels are
done at once inside chunks of ``FAN**LEVELS`` rows, aligned so that no run crosses a chunk: one shuffle for all of
them, whatever share of the rows one key holds. The nodes that chunks end in are the rows of the next layer.
Proofs come down the same way: every row takes its ancestors' siblings inside the chunk from the rows before it,
and the chunk's own proof by a join on the chunk.

Positions of rows in their key come from a sort by ranges; one number per key and range is added up, so no key is
numbered in one task.

Defined results: a null field is hashed as ``-``, other values as their byte count, a colon and the value. Rows of
null source are one group, before all others. A null doc_id comes first in its group and is never tampered with;
rows of equal doc_id are ordered by their leaf. Repeated rows are leaves each. An empty table has no rows and no
root. Columns beside the five hashed ones play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from musterline.cluster import cut_lineage

FAN = 3
LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PART_SHIFT = 33  # the task's number in Spark's increasing ids stands above this bit
SIBLINGS = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' UTF-8 bytes, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    sized = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.when(text.isNull(), F.lit("-")).otherwise(sized)


def leaf_of(**changed: Column) -> Column:
    return digest(*[field(changed.get(c, F.col(c))) for c in FIELDS])


def placed(rows: DataFrame, order: list[Column], keys: tuple[str, ...] = ("tree",)) -> DataFrame:
    """``rows`` with ``pos`` (0, 1, ... per key in the given order) and ``many``, the rows of the key."""
    by = [F.col(k) for k in keys] + order
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = cut_lineage(ranged.withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_at", PART_SHIFT))
    parts = ranged.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    key = Window.partitionBy(*keys)
    earlier = key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *keys,
        "_part",
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(key).alias("many"),
    )
    found = ranged.join(parts, [*keys, "_part"]).withColumn("pos", F.col("_at") + F.col("_shift"))
    return found.drop("_at", "_part", "_shift")


def _levels(nodes: DataFrame, levels: int, siblings: bool) -> DataFrame:
    """``nodes`` (tree, pos, many, digest, ...) by chunks, with the digest of the highest level on each chunk's
    first row (``top``) and, if asked for, the ``path`` of every row inside its chunk."""
    nodes = nodes.withColumn("chunk", F.floor(F.col("pos") / F.lit(FAN**levels)))
    by_chunk = Window.partitionBy("tree", "chunk").orderBy("pos")
    pos, own = F.col("pos"), F.col("top")
    nodes = nodes.withColumn("top", F.col("digest"))
    for level in range(levels):
        step = FAN**level
        nodes = nodes.withColumns(
            {f"_lag{k}": F.lag("top", k * step).over(by_chunk) for k in range(1, FAN)}
            | {f"_lead{k}": F.lead("top", k * step).over(by_chunk) for k in range(1, FAN)}
        )
        many = F.ceil(F.col("many") / F.lit(step))
        number = F.floor(pos / F.lit(step))
        slot = number % FAN
        run = F.least(F.lit(FAN), many - (number - slot))
        none = F.lit("")
        before = F.concat(*[F.when(slot >= k, F.col(f"_lag{k}")).otherwise(none) for k in range(FAN - 1, 0, -1)])
        after = F.concat(*[F.when(slot + k < run, F.col(f"_lead{k}")).otherwise(none) for k in range(1, FAN)])
        open_ = (pos % step == 0) & (many > 1)
        columns = {}
        if siblings:
            columns[f"_s{level}"] = F.when(open_, F.struct(before.alias("before"), after.alias("after")))
        first_child = pos % (step * FAN) == 0
        columns["top"] = F.when(first_child, F.when(many > 1, digest(own, after)).otherwise(own))
        nodes = nodes.withColumns(columns).drop(*[f"_{n}{k}" for n in ("lag", "lead") for k in range(1, FAN)])
    if siblings:
        so_far = by_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        nodes = nodes.withColumns({f"_s{k}": F.last(f"_s{k}", ignorenulls=True).over(so_far) for k in range(levels)})
        path = F.array_compact(F.array(*[F.col(f"_s{k}") for k in range(levels)]))
        nodes = nodes.withColumn("path", path).drop(*[f"_s{k}" for k in range(levels)])
    return nodes


def layers(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """``nodes`` (tree, pos, many, digest), then one table for every ``levels`` levels; the last one has a row per tree."""
    widest = nodes.agg(F.max("many")).first()[0] or 0
    found = [nodes]
    while widest > 1:
        tops = _levels(found[-1].select("tree", "pos", "many", "digest"), levels, siblings=False)
        tops = tops.filter(F.col("pos") % FAN**levels == 0)
        many = F.ceil(F.col("many") / F.lit(FAN**levels)).cast("bigint")
        found.append(cut_lineage(tops.select("tree", F.col("chunk").alias("pos"), many.alias("many"), F.col("top").alias("digest"))))
        widest = -(-widest // FAN**levels)
    return found


def proofs(found: list[DataFrame], above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The rows of the lowest layer with ``path``, their ancestors' siblings up to the root, and the columns of
    ``above`` (tree, path, ...), which has a row per tree and whose paths go on from there."""
    down = found[-1].join(above, "tree")
    extra = [c for c in above.columns if c not in ("tree", "path")]
    for n, layer in enumerate(reversed(found[:-1])):
        if n:  # a layer between: small beside the rows below it
            down = cut_lineage(down)
        up = down.select("tree", F.col("pos").alias("chunk"), F.col("path").alias("_up"), *extra)
        rows = _levels(layer, levels, siblings=True).drop("top").join(up, ["tree", "chunk"])
        down = rows.withColumn("path", F.concat("path", "_up")).drop("_up", "chunk")
    return down


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, s: digest(s["before"], node, s["after"]))


def manifest(documents: DataFrame, altered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """(doc_id, source, leaf, altered_leaf, subroot, root, path) of every document.

    ``altered`` is a text to hash in place of ``text`` for ``altered_leaf``; null leaves the text as it is.
    """
    documents = documents.select(*FIELDS)
    other = F.when(altered.isNotNull(), leaf_of(text=altered)) if altered is not None else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))  # null first, then in the order of bytes
    leaves = cut_lineage(documents.select("doc_id", tree.alias("tree"), leaf_of().alias("digest"), other.alias("altered")))
    nodes = placed(leaves, [F.col("doc_id").asc_nulls_first(), F.col("digest")])
    sources = layers(nodes, levels)
    subroots = sources[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    tops = layers(placed(subroots, [F.col("name")]), levels)
    root = tops[-1].select("tree", F.col("digest").alias("root"), F.array().cast(SIBLINGS).alias("path"))
    above = proofs(tops, root, levels).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    rows = proofs(sources, cut_lineage(above), levels)
    source = F.when(F.col("tree") != "-", F.expr("substring(tree, 2)")).alias("source")
    leaf = F.col("digest").alias("leaf")
    return rows.select("doc_id", source, leaf, F.coalesce("altered", "digest").alias("altered_leaf"), "subroot", "root", "path")


def verified(documents: DataFrame, altered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """The manifest with the hash of every proof, and the root that the altered leaf gives by it."""
    rows = manifest(documents, altered, levels)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    rows = rows.withColumns({"proof_sha256": digest(siblings), "folded_root": folded(F.col("path"), F.col("altered_leaf"))})
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
