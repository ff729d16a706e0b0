"""Merkle manifest of a table: one tree per group, one tree over the groups' roots.

Leaf coordinates come from rank queries, without sorting the rows:

* per group, the ids are merged into compressed bitmaps: 64-bit words grouped into chunks
  of 4,096 ids, of which only the words with an id are kept, each with the number of rows
  before it in the chunk (its popcount directory);
* four more directories count the rows before a chunk inside 2^12 chunks, inside 2^24 ids'
  chunks and so on to the whole group, so that no window sees more than 65,536 rows;
* a row's coordinate is the sum of these counts and of the set bits below its own.

An id that occurs more than once (an exception the directory lists) is ordered by the
leaf's hash: rows are counted by the first four digits of the hash, then inside them.
Equal rows are one row with a count until the end.

Levels are reduced in blocks: a block holds the slots of ``FAN ** LEVELS`` consecutive
nodes as an array, keyed by coordinate, and makes that many levels of the tree at once.
So a tree of n leaves takes log(n) / log(729) exchanges, and a leaf's siblings are found
by the same blocks on the way down.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.llm.common import require, shared_folder, stored
from storelens.operators.ranking import asc, row_numbers

FAN, LEVELS = 3, 6
BLOCK = FAN ** LEVELS
#: The chunk, and the word, of a null id: below those of the smallest long.
_NULL_CHUNK, _NULL_WORD = -(1 << 52), -(1 << 58)
_POWERS = "array(" + ", ".join(f"{FAN ** k}L" for k in range(40)) + ")"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' concatenation."""
    return F.sha2(F.concat(*parts), 256)


def leaf_of(*columns: Column) -> Column:
    """The digest of column values: ``-`` for a null, else the byte count of the value as text, ``:`` and the value."""
    texts = [c.cast("string") for c in columns]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def coordinates(rows: DataFrame, kept: Sequence[str]) -> DataFrame:
    """``rows`` (_g group, _k id, _leaf, the columns ``kept``, _m copies; all different) as one row per copy,
    with _i, its place in the group from 0, and _n, the group's rows."""
    rows = rows.withColumns({"_c": F.expr(f"coalesce(shiftright(_k, 12), {_NULL_CHUNK}L)"), "_w": F.expr(f"coalesce(shiftright(_k, 6), {_NULL_WORD}L)"),
                             "_bit": F.expr("cast(coalesce(_k & 63, 0) as int)")})
    ids = rows.groupBy("_g", "_c", "_w", "_bit").agg(F.sum("_m").alias("_n"))
    words = ids.groupBy("_g", "_c", "_w").agg(
        F.expr("bit_or(shiftleft(1L, _bit))").alias("bits"), F.sum("_n").alias("rows"),
        F.collect_list(F.when(F.col("_n") > 1, F.struct(F.col("_bit").alias("bit"), (F.col("_n") - 1).alias("more")))).alias("more"))
    chunks = words.groupBy("_g", "_c").agg(F.array_sort(F.collect_list(F.struct(F.col("_w").alias("w"), "bits", "rows", "more"))).alias("_words"),
                                           F.sum("rows").alias("_rows"))
    before = "aggregate(slice(_words, 1, i), 0L, (n, y) -> n + y.rows)"
    chunks = chunks.select("_g", "_c", "_rows", F.expr(f"transform(_words, (x, i) -> named_struct('w', x.w, 'bits', x.bits, 'more', x.more, 'before', {before}))").alias("_words"))
    # rows before a chunk: inside its 4,096 chunks, those inside their 4,096 chunks, ... inside the group
    steps = [chunks.select("_g", F.col("_c").alias("_p0"), "_rows")]
    for k in range(1, 4):
        steps.append(steps[-1].groupBy("_g", F.expr(f"shiftright(_p{k - 1}, 12)").alias(f"_p{k}")).agg(F.sum("_rows").alias("_rows")))
    top = steps[3]
    upto = Window.partitionBy("_g").orderBy("_p3")
    placed = top.select("_g", "_p3", (F.sum("_rows").over(upto) - F.col("_rows")).alias("_before"), F.sum("_rows").over(Window.partitionBy("_g")).alias("_n"))
    for k in (2, 1, 0):
        up = f"_p{k + 1}"
        step = steps[k].withColumn(up, F.expr(f"shiftright(_p{k}, 12)"))
        upto = Window.partitionBy("_g", up).orderBy(f"_p{k}")
        step = step.withColumn("_own", F.sum("_rows").over(upto) - F.col("_rows"))
        placed = step.join(placed, ["_g", up]).select("_g", f"_p{k}", (F.col("_before") + F.col("_own")).alias("_before"), "_n")
    directory = chunks.select("_g", "_c", "_words").join(placed.withColumnRenamed("_p0", "_c"), ["_g", "_c"])

    word = F.expr("element_at(filter(_words, x -> x.w = _w), 1)")
    below = F.expr("case when _bit = 0 then 0 else bit_count(_word.bits & shiftrightunsigned(-1L, 64 - _bit)) end")
    more = F.expr("aggregate(filter(_word.more, x -> x.bit < _bit), 0L, (n, x) -> n + x.more)")
    ranked = rows.join(directory, ["_g", "_c"]).withColumn("_word", word).select(
        "_g", "_n", "_w", "_bit", "_k", "_leaf", *kept, "_m", (F.col("_before") + F.col("_word.before") + below + more).alias("_i"),
        F.expr("exists(_word.more, x -> x.bit = _bit)").alias("_again"))
    out = ["_g", "_n", "_i", "_k", "_leaf", *kept]
    once = ranked.where(~F.col("_again")).select(out)

    again = ranked.where("_again").withColumn("_h", F.substring("_leaf", 1, 4))
    heads = again.groupBy("_g", "_w", "_bit", "_h").agg(F.sum("_m").alias("_hm"))
    heads = heads.withColumn("_hb", F.sum("_hm").over(Window.partitionBy("_g", "_w", "_bit").orderBy("_h")) - F.col("_hm")).drop("_hm")
    inside = Window.partitionBy("_g", "_w", "_bit", "_h").orderBy("_leaf", *kept).rowsBetween(Window.unboundedPreceding, 0)
    again = again.withColumn("_lb", F.sum("_m").over(inside) - F.col("_m")).join(heads, ["_g", "_w", "_bit", "_h"])
    # two steps, since a row's copies may be more than an array holds
    again = again.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1, F.lit(10_000).cast("long"))))
    again = again.withColumn("_copy", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + 9_999, F.col("_m") - 1))))
    return once.unionByName(again.withColumn("_i", F.expr("_i + _hb + _lb + _copy")).select(out))


def _blocks(nodes: DataFrame, payload: Sequence[str]) -> DataFrame:
    """One row per block of ``nodes`` (_g, _i, _n, _node, payload): its slots in order, and the number of levels it makes."""
    slots = F.array_sort(F.collect_list(F.struct("_i", "_node", *payload)))
    return nodes.groupBy("_g", "_n", F.expr(f"_i div {BLOCK}").alias("_b")).agg(slots.alias("_slots")).withColumn(
        "_levels", F.expr(f"least({LEVELS}, size(filter({_POWERS}, p -> p < _n)))"))


def _with_levels(blocks: DataFrame) -> DataFrame:
    """_l0 ... _l6: the nodes of each level of a block (empty above its last one)."""
    out = blocks.withColumn("_l0", F.expr("transform(_slots, s -> s._node)"))
    for k in range(LEVELS):
        up = f"transform(filter(sequence(0, size(_l{k}) - 1), j -> j % {FAN} = 0), j -> sha2(array_join(slice(_l{k}, j + 1, {FAN}), ''), 256))"
        out = out.withColumn(f"_l{k + 1}", F.expr(f"case when _levels > {k} then {up} else array() end"))
    return out


def _reduced(nodes: DataFrame, payload: Sequence[str], most: int, folder: str, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The written blocks of every round, and each group's root: (_g, _node).  ``most``: rows of the largest group."""
    rounds = []
    while True:
        rounds.append(stored(_blocks(nodes, payload), folder, f"{name}{len(rounds)}"))
        levels = _with_levels(rounds[-1])
        node = F.expr(f"element_at(element_at(array({', '.join(f'_l{k}' for k in range(LEVELS + 1))}), _levels + 1), 1)")
        nodes, payload = levels.select("_g", F.col("_b").alias("_i"), F.expr(f"(_n + {BLOCK - 1}) div {BLOCK}").alias("_n"), node.alias("_node")), ()
        most = -(-most // BLOCK)
        if most <= 1:
            return rounds, nodes.select("_g", "_node")


def _paths(rounds: list[DataFrame], payload: Sequence[str], upper: DataFrame, carried: Sequence[str]) -> DataFrame:
    """From the groups' own paths (``upper``: _g, _path, carried) to a row per node of the lowest level: _g, _i, _node,
    payload, carried and _path, for each level from the node upwards the siblings on its left and on its right."""
    upper = upper.withColumn("_b", F.lit(0).cast("long"))
    slot = f"cast(s div element_at(array({', '.join(str(FAN ** k) for k in range(LEVELS))}), j + 1) as int)"
    level = "element_at(_all, j + 1)"
    for k in range(len(rounds) - 1, -1, -1):
        own = list(payload) if k == 0 else []
        blocks = _with_levels(rounds[k]).withColumn("_all", F.expr(f"array({', '.join(f'_l{j}' for j in range(LEVELS))})"))
        pair = (f"named_struct('left', array_join(slice({level}, {slot} - {slot} % {FAN} + 1, {slot} % {FAN}), ''), "
                f"'right', array_join(slice({level}, {slot} + 2, {FAN - 1} - {slot} % {FAN}), ''))")
        path = f"concat(transform(slice(sequence(0, {LEVELS - 1}), 1, _levels), j -> {pair}), _path)"
        fields = "".join(f", '{c}', x.{c}" for c in ["_i", "_node", *own])
        rows = blocks.join(upper, ["_g", "_b"]).select("_g", *carried, F.expr(f"inline(transform(_slots, (x, s) -> named_struct('_path', {path}{fields})))"))
        upper = rows.withColumnRenamed("_i", "_b").drop("_node") if k else rows
    return upper


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and its siblings make."""
    return F.aggregate(path, leaf, lambda node, p: digest(p["left"], node, p["right"]))


def manifest(docs: DataFrame, key: str, group: str, leaf: str, kept: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``group``, ``leaf``, the columns ``kept``, ``coordinate`` (the leaf's place
    among its group's, from 0), ``subroot`` (of the group's tree), ``root`` and ``path`` (array of (left, right): for each
    level from the leaf up to the root, the digests of the run's other nodes before it and after it, concatenated).

    ``key`` is an integer, ``leaf`` a hex digest; other columns of ``docs`` are left out.  In a group rows ascend by key;
    null keys come first, rows of equal key by leaf (then by the ``kept`` columns; equal rows share these places in any
    way).  A null group is a group, the first one; groups go by the bytes of their names.  Runs of three nodes make one
    node until one is left; a single leaf is its group's root, a single group's root the root.  An empty table has no
    rows and no root.  The outputs replace kept columns of their names.
    """
    require(docs, key, group, leaf, *kept)
    kept = [c for c in kept if c not in ("coordinate", "subroot", "root", "path")]
    folder = shared_folder(docs.sparkSession)
    names = [f"_x{i}" for i in range(len(kept))]
    # a name that sorts as the groups do: null first, then by bytes
    g = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    rows = docs.select(g.alias("_g"), F.col(f"`{key}`").cast("long").alias("_k"), F.col(f"`{leaf}`").alias("_leaf"),
                       *[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)])
    rows = stored(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_m")), folder, "rows")
    leaves = coordinates(rows, names).withColumnRenamed("_leaf", "_node")
    payload = ["_k", *names]
    sizes = rows.groupBy("_g").agg(F.sum("_m").alias("_n"))
    groups, most = sizes.agg(F.count(F.lit(1)), F.coalesce(F.max("_n"), F.lit(0))).first()
    lower, roots = _reduced(leaves, payload, most, folder, "leaves")
    roots = stored(roots, folder, "subroots")
    numbered = row_numbers(roots, [asc("_g")]).select(F.lit("").alias("_g"), (F.col("rn") - 1).alias("_i"), F.lit(groups).cast("long").alias("_n"), "_node", F.col("_g").alias("_sub"))
    higher, root = _reduced(numbered, ["_sub"], groups, folder, "groups")
    none = F.array().cast("array<struct<left:string,right:string>>")
    tops = _paths(higher, ["_sub"], root.select("_g", F.col("_node").alias("_root"), none.alias("_path")), ["_root"])
    tops = stored(tops.select(F.col("_sub").alias("_g"), F.col("_node").alias("_subroot"), "_root", "_path"), folder, "tops")
    out = _paths(lower, payload, tops, ["_subroot", "_root"])
    return out.select(F.col("_k").alias(key), F.when(F.col("_g") != "", F.expr("substring(_g, 2)")).alias(group), F.col("_node").alias(leaf),
                      *[F.col(n).alias(c) for c, n in zip(kept, names)], F.col("_i").alias("coordinate"),
                      F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.col("_path").alias("path"))
