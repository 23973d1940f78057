"""Near-duplicate documents: bottom-k sketches find candidates, whole shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens.llm.common import discard, materialise, text_of
from placelens.llm.components import components
from placelens.llm.shingles import Shingler, set_digest
from placelens.llm.tokens import byte_batches

# Retained values of a sketch, and those of them that are looked up.
SKETCH = 64
LISTED = 40
# Lists with up to so many members are paired outright once stars have linked what they can.
FEW_MEMBERS = 16
# Members of a longer list that meet in one task, and the retained values by which they are compared there.
BLOCK = 256
COMPARED = 256
# A pair at the threshold is given up by an estimate with this chance at most.
MISS_CHANCE = 1 / 3_000_000


def least_estimate(percent: int, values: int) -> float:
    """The estimate from so many values that a pair at the threshold falls below with `MISS_CHANCE` at most.

    Each value of the union is in both sets with the chance `percent`, so this is
    a quantile of the binomial; of a small union the values come without being
    put back, which strays less.
    """
    share, below = percent / 100, 0.0
    for both in range(values + 1):
        below += comb(values, both) * share**both * (1 - share) ** (values - both)
        if below > MISS_CHANCE:
            break
    return both / values


def text_id(text: Column) -> Column:
    """Tells the texts of one id apart."""
    return F.unhex(F.md5(text))


def sketch_documents(docs: DataFrame, id_column: str, text_column: str, words: int, size: int = SKETCH) -> DataFrame:
    """(doc_id, text_id, n_shingles, node, sketch) per row: node is a digest of the whole set (null if empty)."""
    kind = dict(docs.dtypes)[id_column]

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for start, end in byte_batches(texts, 4 << 20):
                sets = list(shingler.sets(texts[start:end]))
                columns = [
                    batch.column(0).slice(start, end - start),
                    batch.column(1).slice(start, end - start),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([s[:size] for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_id", "n_shingles", "node", "sketch"])

    text = text_of(F.col(text_column))
    chosen = docs.select(F.col(id_column).alias("doc_id"), text_id(text).alias("text_id"), text.alias("text"))
    return chosen.mapInArrow(sketched, f"doc_id {kind}, text_id binary, n_shingles long, node binary, sketch array<long>")


def _whole_sets(docs: DataFrame, id_column: str, text_column: str, words: int, wanted: DataFrame) -> DataFrame:
    """(node, shingles) for the wanted (node, doc_id, text_id); the digest is checked against the set."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            nodes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, end in byte_batches(texts, 4 << 20):
                sets = list(shingler.sets(texts[start:end]))
                right = [i for i, s in enumerate(sets) if set_digest(s) == nodes[start + i]]
                columns = [
                    pa.array([nodes[start + i] for i in right], pa.binary()),
                    pa.array([sets[i] for i in right], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["node", "shingles"])

    text = text_of(F.col(text_column))
    texts = docs.select(F.col(id_column).alias("doc_id"), text_id(text).alias("text_id"), text.alias("text"))
    same = texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["text_id"] == wanted["text_id"])
    joined = texts.join(wanted, same).select("node", "text")
    found = joined.mapInArrow(hashed, "node binary, shingles array<long>")
    return found.groupBy("node").agg(F.first("shingles").alias("shingles"))


def index_postings(nodes: DataFrame) -> DataFrame:
    """(value, node): inverted lists of retained values, three neighbours in hash order at a time.

    A single value says little, as common words meet by chance and boilerplate
    is everywhere, so its list would be long for nothing. Three neighbours in
    one sketch are neighbours in the other too unless a value of only one set
    falls between. Of sets at 0.85, a sketch of 40 values has no such three in
    common with a chance of 2e-8 (0.8: 1e-6); where whole sets are retained it
    always has, as 15 or 20 % of odd values cannot part the others so finely.
    Only sets of 4 and 5 values need two neighbours instead, which sets of up to
    6 have. Lists of one node lead nowhere and are not stored.
    """
    listed = F.slice("sketch", 1, LISTED)

    def runs(size: int) -> Column:
        firsts = F.slice(listed, 1, F.greatest(F.size(listed) - (size - 1), F.lit(0)))
        return F.transform(firsts, lambda v, i: F.xxhash64(v, *[F.get(listed, i + j) for j in range(1, size)]))

    few = F.when(F.col("n") <= 6, runs(2)).otherwise(F.array().cast("array<bigint>"))
    postings = nodes.select("node", F.explode(F.concat(runs(3), few)).alias("value"))
    counts = postings.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return postings.join(counts.select("value"), "value")


def _estimate(a: Column, b: Column) -> Column:
    """Resemblance from the bottom-k sketch of the union."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, F.least(F.size(a), F.size(b)))
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


class _Verifier:
    """Decides pairs of nodes: sizes, then the union-sketch estimate, then whole sets.

    `nodes` has (node, n, sketch, shingles).
    """

    def __init__(self, nodes: DataFrame, percent: int) -> None:
        self.nodes, self.percent = nodes, percent

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are linked, stored."""
        side = lambda end: self.nodes.select(
            F.col("node").alias(end),
            F.struct("n", "sketch", "shingles").alias(f"_{end}"),
        )
        joined = pairs.join(side("b"), "b").join(side("a"), "a")
        n_a, n_b = F.col("_a.n"), F.col("_b.n")
        sized = 100 * F.least(n_a, n_b) >= self.percent * F.greatest(n_a, n_b)
        # Complete sketches give the exact value, for which the bound is low enough too.
        likely = _estimate(F.col("_a.sketch"), F.col("_b.sketch")) >= least_estimate(self.percent, SKETCH)
        both = F.size(F.array_intersect("_a.shingles", "_b.shingles"))
        linked = 100 * both >= self.percent * (n_a + n_b - both)
        # The branches are tried one after the other, so whole sets meet only where the sketches allow it.
        decided = F.when(~sized, False).when(~likely, False).otherwise(linked)
        return materialise(joined.filter(decided).select("a", "b"))


def _star(index: DataFrame, *centres: Column) -> DataFrame:
    """Distinct pairs (a < b) of each list's centres with its other members."""
    found = index.groupBy("value").agg(F.array_distinct(F.array(*centres)).alias("centres"), F.count(F.lit(1)).alias("n"))
    spokes = index.join(found.filter("n > 1"), "value").select("node", F.explode("centres").alias("centre"))
    return spokes.filter("centre != node").select(
        F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")
    ).distinct()


def _overlaps(first: list[np.ndarray], second: list[np.ndarray], whole: int) -> np.ndarray:
    """Resemblance of each of the first sketches with each of the second; exact for sets below `whole` values."""
    values = np.unique(np.concatenate(first))
    ends = [np.array([np.iinfo(np.int64).max if len(x) < whole else x[-1] for x in side]) for side in (first, second)]
    table = []
    for side in (first, second):
        found = np.zeros((len(side), len(values)), dtype=np.float32)
        for i, x in enumerate(side):
            at = np.searchsorted(values, x)
            at[at == len(values)] = 0
            found[i, at[values[at] == x]] = 1
        table.append(found)
    both = table[0] @ table[1].T
    # Only values up to the lower end of the two sketches are known of both.
    of_first = np.array([np.searchsorted(x, np.minimum(ends[0][i], ends[1]), "right") for i, x in enumerate(first)])
    of_second = np.array([np.searchsorted(x, np.minimum(ends[1][j], ends[0]), "right") for j, x in enumerate(second)]).T
    return both / (of_first + of_second - both)


def compare_blocks(blocks: DataFrame, percent: int, compared: int = COMPARED) -> DataFrame:
    """Likely pairs (a, b) of different roots within (value, low, high), whose rows are of blocks `low` and `high`.

    Rows have node, root, block, `some` (the least values of the set) and
    `lists` (all long lists of the node). Tasks hold two blocks of a list at a
    time, and only likely pairs leave them, each from the first of the lists that
    both nodes are in.
    """
    share, least = percent / 100, least_estimate(percent, compared)

    def likely(key: tuple, table: pa.Table) -> pa.Table:
        nodes, roots = table["node"].to_pylist(), np.array(table["root"].to_pylist(), dtype=object)
        sets = [np.array(x, dtype=np.int64) for x in table["some"].to_pylist()]
        block, value, low, high = np.array(table["block"].to_pylist()), *[k.as_py() for k in key]
        lists = [set(x) for x in table["lists"].to_pylist()]
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        pairs = []
        if len(left) and len(right):
            alike = _overlaps([sets[i] for i in left], [sets[j] for j in right], compared)
            whole = np.array([len(x) < compared for x in sets])
            bound = np.where(whole[left][:, None] & whole[right][None, :], share - 1e-6, least)
            for i, j in zip(*np.nonzero(alike >= bound), strict=True):
                x, y = left[i], right[j]
                if roots[x] != roots[y] and (low != high or x < y) and min(lists[x] & lists[y]) == value:
                    pairs.append((min(nodes[x], nodes[y]), max(nodes[x], nodes[y])))
        ends = list(zip(*pairs, strict=True)) or [(), ()]
        return pa.table({"a": pa.array(ends[0], pa.binary()), "b": pa.array(ends[1], pa.binary())})

    return blocks.groupBy("value", "low", "high").applyInArrow(likely, "a binary, b binary").distinct()


def _mixed_lists(labelled: DataFrame) -> DataFrame:
    """(value, n): lists with members of several components, and their lengths."""
    lists = labelled.groupBy("value").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("n"))
    return lists.filter("x != y").select("value", "n")


def _rest_of_short_lists(rest: DataFrame) -> DataFrame:
    short = rest.filter(F.col("n") <= FEW_MEMBERS)
    other = short.select("value", F.col("node").alias("other"), F.col("root").alias("other_root"))
    pairs = short.join(other, "value").filter("root < other_root")
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _rest_of_long_lists(rest: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Likely pairs in the long lists, each split into bands of set sizes and these into blocks.

    A band ends where sizes are `percent` % of the next one's, so sets that link
    are in one band or in two neighbouring ones; only blocks of such bands meet.
    """
    band = F.floor(F.log("size") / log(100 / percent) + 1e-9).cast("int")
    some = nodes.select("node", F.col("n").alias("size"), F.slice("shingles", 1, COMPARED).alias("some"))
    long = rest.filter(F.col("n") > FEW_MEMBERS).drop("n").join(some, "node").withColumn("band", band).drop("size")
    long = materialise(long)
    # A node is in as many lists as it has listed values at most, a list in as many bands as there are sizes' magnitudes.
    lists = long.groupBy("node").agg(F.collect_set("value").alias("lists"))
    bands = long.groupBy("value", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    bands = bands.groupBy("value").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("bands"))
    placed = long.join(bands, "value").join(lists, "node")
    blocks = lambda b: F.coalesce(F.element_at("bands", b), F.lit(0))
    block = F.pmod(F.xxhash64("node", F.lit("block")), blocks(F.col("band"))).cast("bigint")
    number = lambda b, i: b.cast("bigint") * (1 << 32) + i
    placed = placed.withColumn("block", number(F.col("band"), block))

    def meeting(b: Column) -> Column:
        others = F.sequence(F.lit(0), F.greatest(blocks(b) - 1, F.lit(0)))
        met = F.transform(others, lambda i: number(b, i))
        pairs = F.transform(met, lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high")))
        return F.when(blocks(b) > 0, pairs).otherwise(F.array())

    near = F.concat(*[meeting(F.col("band") + step) for step in (-1, 0, 1)])
    met = placed.select("value", "node", "root", "block", "some", "lists", F.explode(near).alias("pair"))
    return compare_blocks(met.select("value", "node", "root", "block", "some", "lists", "pair.low", "pair.high"), percent)


def link_components(index: DataFrame, tested: DataFrame, verifier: _Verifier) -> DataFrame:
    """(node, root) of all linked nodes, without making the pairs within a list rows.

    Only components matter, so each list is first tested against two of its
    members (the pairs `tested`), which links most of what belongs together.
    Then, in the lists whose members are still in several components, members of
    different components are compared: in short lists outright, in longer ones
    block by block inside tasks, which only likely pairs leave. So no link
    between different components is missed.
    """
    links = verifier.links(tested)
    roots = components(links, "a", "b")
    labelled = index.join(roots, "node", "left").select("value", "node", F.coalesce("root", "node").alias("root"))
    labelled = materialise(labelled)
    rest = materialise(labelled.join(_mixed_lists(labelled), "value"))
    if rest.isEmpty():
        return roots
    new = _rest_of_short_lists(rest).unionByName(_rest_of_long_lists(rest, verifier.nodes, verifier.percent)).distinct()
    more = verifier.links(materialise(new.join(tested, ["a", "b"], "left_anti")))
    found = components(materialise(links.unionByName(more)), "a", "b")
    discard(labelled, rest)
    return found


def _first(*more: str) -> Column:
    """The least of some rows by id, a missing id last, then by the columns of `more`."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *more))


def _linked_rows(
    docs: DataFrame, id_column: str, text_column: str, words: int, percent: int
) -> tuple[DataFrame, DataFrame]:
    """The stored rows of `sketch_documents`, and (node, first) per node: the first row of what links reach from it."""
    rows = materialise(sketch_documents(docs, id_column, text_column, words))
    distinct = rows.filter("node IS NOT NULL").groupBy("node")
    firsts = distinct.agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), _first("text_id").alias("least"))
    nodes = materialise(firsts.select("node", "n", "sketch", "least.doc_id", "least.text_id"))
    index = materialise(index_postings(nodes))
    pairs = materialise(_star(index, F.min("node"), F.max("node")))
    near = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = materialise(nodes.join(near, "node", "left_semi"))
    sets = _whole_sets(docs, id_column, text_column, words, wanted.select("node", "doc_id", "text_id"))
    verifier = _Verifier(materialise(wanted.drop("doc_id", "text_id").join(sets, "node")), percent)
    discard(wanted)
    roots = link_components(index, pairs, verifier)
    discard(index, pairs, verifier.nodes)
    rooted = nodes.select("node", "doc_id", "text_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(_first("node", "text_id").alias("first"))
    return rows, rooted.select("node", "root").join(least, "root").select("node", "first")


def near_duplicates(
    docs: DataFrame, id_column: str, text_column: str, words: int = 5, percent: int = 80
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of `words`-word shingles have a
    resemblance of `percent` % or more; component_id is the least doc_id that
    links reach, and kept marks the document that has it. Equal sets are one
    node from the start, so copies are never paired. Candidates come from the
    inverted lists of retained values, estimates drop unlikely ones, and whole
    sets decide; a pair at the threshold is missed with a chance of 4.4e-7 at
    most (85 %; 80 %: 1.4e-6).

    A text without words (or null) has an empty set, no links and itself as
    component. Rows of one id and equal sets share a fate; rows of one id with
    different texts are separate documents that carry the same id, of which at
    most one set per component is kept, the one with the least digest. A null id
    never becomes a component's id unless nothing else is there. An empty table
    gives an empty one; other columns are not read.
    """
    rows, firsts = _linked_rows(docs, id_column, text_column, words, percent)
    found = rows.select("doc_id", "n_shingles", "node").join(firsts, "node", "left")
    alone = F.col("node").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    kept = alone | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node")))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def kept_documents(
    docs: DataFrame, id_column: str, text_column: str, words: int = 5, percent: int = 80
) -> DataFrame:
    """(doc_id, text_id) of one document per component of `near_duplicates`, and of all without words; no row twice.

    Of equal least ids, and where no row of a component has an id, digests decide.
    """
    rows, firsts = _linked_rows(docs, id_column, text_column, words, percent)
    chosen = firsts.filter(F.col("node") == F.col("first.node")).select("first.doc_id", "first.text_id")
    return chosen.unionByName(rows.filter("node IS NULL").select("doc_id", "text_id")).distinct()
