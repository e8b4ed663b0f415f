"""Near-duplicates by MinHash with tensored banding, verified on full shingle sets.

Two small collections of minhash tuples stand for a document, `first` of two
hashes each and `second` of three. A table key is a pair of one tuple of either
collection: 10 and 14 tuples, 62 minhashes, give 140 tables of five hashes each,
which would take 700. Two texts meet in a table exactly if they share a tuple
of either collection, so tuples that nobody shares are left out before pairing.

    distinct sets -> shared tuples -> table keys -> groups of likely copies by sketches -> exact links -> components

Sketches (one-permutation minhash, 256 bytes) only tell which documents are
brought together; links are confirmed on the sets. No step emits the pairs of a
group: stars and cells of bounded size yield at most one edge per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneflow.llm.base import fresh, rows_per_batch, ship_code, stored

FIRST, FIRST_HASHES = 10, 2
SECOND, SECOND_HASHES = 14, 3
BINS = 256
CELL_ROWS = 128
CELL_SHINGLES = 2_000_000
BATCH_ROWS = 1000
# A pair at the threshold falls below its sketch's bound by more standard errors than this about once in 300,000.
STANDARD_ERRORS = 4.5

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.random.default_rng(5).integers(1, 2**63, size=(2, FIRST * FIRST_HASHES + SECOND * SECOND_HASHES), dtype=np.uint64)
_FACTORS = _SALTS[0] | np.uint64(1)
_MASKS = _SALTS[1]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted 64-bit hashes of the distinct shingles of a text in UTF-8. Word hashes are kept in a bounded table."""

    def __init__(self, words: int, table_size: int = 100_000):
        self.words, self.table_size, self.known = words, table_size, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        # Of bytes, lower() changes A-Z alone and split() takes exactly the six blanks of ASCII.
        words = (text or b"").lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        known = self.known
        if len(known) > self.table_size:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        ids = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        size = min(self.words, len(words))
        h = np.full(len(words) - size + 1, size, dtype=np.uint64)
        for i in range(size):
            h = mix64(h * _MIX + ids[i : i + len(h)])
        return np.unique(h)


def minhash_tuples(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit value for each tuple of the two collections, the first collection leading."""
    least = np.empty(len(_FACTORS), dtype=np.uint64)
    for start in range(0, len(shingles), 65_536):
        part = shingles[start : start + 65_536]
        for i in range(len(_FACTORS)):
            low = ((part ^ _MASKS[i]) * _FACTORS[i]).min()
            least[i] = low if not start else min(least[i], low)
    cut = FIRST * FIRST_HASHES
    halves = []
    for values in (least[:cut].reshape(FIRST, FIRST_HASHES), least[cut:].reshape(SECOND, SECOND_HASHES)):
        h = np.zeros(len(values), dtype=np.uint64)
        for j in range(values.shape[1]):
            h = mix64(h * _MIX + values[:, j])
        halves.append(h)
    return np.concatenate(halves)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """For each of 256 bins a byte of the least hash in it, 0 if the bin is empty."""
    h = mix64(shingles + _MIX)
    h.sort()  # the upper byte is the bin, so each bin's least hash comes first
    bins = (h >> np.uint64(56)).astype(np.int64)
    firsts = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    found = np.zeros(BINS, dtype=np.uint8)
    found[bins[firsts]] = (mix64(h[firsts]) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return found


def likely(one: np.ndarray, many: np.ndarray, threshold: float) -> np.ndarray:
    """Which sketches may belong to a set whose similarity to that of `one` reaches the threshold."""
    equal = ((one == many) & (many != 0)).sum(axis=-1)
    used = np.maximum(1, ((one != 0) | (many != 0)).sum(axis=-1))
    bound = threshold - STANDARD_ERRORS * np.sqrt(threshold * (1 - threshold) / used)
    return equal / used >= bound


def sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(-1, BINS)


def described(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, digest of the set, tuples, sketch; no more than the first two for an empty set."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for batch in batches:
            out = []
            for text in batch["text"]:
                s = shingler(text)
                if len(s):
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    out.append((len(s), digest, minhash_tuples(s).view(np.int64), sketch(s).tobytes()))
                else:
                    out.append((0, None, None, None))
            frame = pd.DataFrame(out, columns=["n_shingles", "digest", "tuples", "sketch"])
            frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInPandas(
        describe, "doc_id long, n_shingles long, digest binary, tuples array<long>, sketch binary"
    )


def table_keys(nodes: DataFrame) -> DataFrame:
    """(key, node): the tables' keys of every node, of shared tuples only, and then of keys that two nodes have."""
    tuples = nodes.select("node", F.posexplode("tuples").alias("place", "tuple"))
    shared = tuples.groupBy("place", "tuple").count().where("count > 1").select("place", "tuple")
    kept = (
        tuples.join(shared, ["place", "tuple"]).groupBy("node")
        .agg(F.collect_list(F.struct("place", "tuple")).alias("t"))  # 24 at most
    )
    first = F.filter("t", lambda x: x["place"] < FIRST)
    second = F.filter("t", lambda x: x["place"] >= FIRST)
    keys = stored(
        kept.select("node", F.explode(first).alias("a"), "t")
        .select("node", "a", F.explode(second).alias("b"))
        .select("node", F.xxhash64("a.place", "a.tuple", "b.place", "b.tuple").alias("key")),
        "table-keys",
    )
    groups = keys.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    return stored(keys.join(groups.select("key", "least"), "key"), "tables")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): every node of the edges (a, b) with the smallest node that it is connected to.

    Each round, a node takes its smallest neighbour as its parent, parents are
    followed to their roots by doubling, and the edges are drawn anew between
    roots, so both grow with the logarithm of the component's size. Every table
    is written to the shared folder; none reaches the driver.
    """
    a, b = F.least("a", "b"), F.greatest("a", "b")
    live = stored(edges.select(a.alias("a"), b.alias("b")).where("a < b").distinct(), "edges")
    labels = None
    if live.isEmpty():
        return live.select(F.col("a").alias("node"), F.col("b").alias("label"))
    while labels is None or not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = stored(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("up")),
            "parents",
        )
        while True:
            above = parents.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = stored(parents.join(above, "up").select("node", "up", "top"), "parents")
            parents = jumped.select("node", F.col("top").alias("up"))
            if jumped.where("up <> top").isEmpty():
                break
        roots = parents.select(F.col("node").alias("label"), F.col("up").alias("root"))
        if labels is None:
            labels = roots.select(F.col("label").alias("node"), F.col("root").alias("label"))
        else:
            labels = stored(
                labels.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels"
            )
        ends = [roots.select(F.col("label").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab"]
        live = stored(
            live.join(ends[0], "a").join(ends[1], "b").where("a_root <> b_root")
            .select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(),
            "edges",
        )
    return labels


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """`labels` once the components that `edges` link are one; only the components are gone through, not their nodes.

    A node without a label is a component of its own.
    """
    tops = components(edges)
    if tops.isEmpty():
        return labels
    above = tops.select(F.col("node").alias("label"), F.col("label").alias("top"))
    known = labels.join(above, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return stored(known.unionByName(tops.join(labels.select("node"), "node", "left_anti")), "labels")


def labelled(rows: DataFrame, labels: DataFrame, out: str = "comp") -> DataFrame:
    """`rows` with the component of their node, the node itself where it has no edge."""
    known = labels.select("node", F.col("label").alias("_label"))
    return rows.join(known, "node", "left").withColumn(out, F.coalesce("_label", "node")).drop("_label")


def runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[dict[str, np.ndarray]]:
    """The runs of equal keys in sorted batches, across their borders, as columns."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        keys = columns[key]
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for start, end in zip(cuts, cuts[1:]):
            if held and held[-1][key][0] != keys[start]:
                yield {c: np.concatenate([h[c] for h in held]) for c in columns} if len(held) > 1 else held[0]
                held = []
            held.append({c: v[start:end] for c, v in columns.items()})
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in held[0]} if len(held) > 1 else held[0]


class Forest:
    """Union-find over the components that meet in one cell."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(p, p)
            x = p
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y

    def stars(self) -> list[tuple[int, int]]:
        """An edge from each component's least member to every other one."""
        return [(self.root(x), x) for x in list(self.up)]


EDGES = "a long, b long"


def edges_of(cells: DataFrame, compare) -> DataFrame:
    """The edges between components (`comp`) that `compare` finds in each cell, as stars; a cell's rows stand together
    in one partition, streamed."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[int, int]] = []
        for cell in runs(batches, "cell"):
            if (cell["comp"] != cell["comp"][0]).any():
                found += compare(cell)
            if len(found) > 10_000:
                yield pd.DataFrame(found, columns=["a", "b"])
                found = []
        yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return cells.repartition("cell").sortWithinPartitions("cell").mapInPandas(walk, EDGES)


def with_outside(rows: DataFrame, group: str) -> DataFrame:
    """`rows` with the `cell`s in which those `outside` meet all rows of their group.

    The group's rows stand in `blocks` blocks and those outside also in parts,
    all of bounded size; every part meets every block. Rows inside are copied
    once for each part, rows outside once for each block, so what is connected
    already costs one row each.
    """
    parts = rows.groupBy(F.col(group).alias("_group")).agg(
        F.ceil(F.count_if("outside") / F.lit(CELL_ROWS)).cast("int").alias("parts")
    )
    held = rows.join(parts, F.col(group) == F.col("_group")).where("parts > 0")
    block = F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int")
    part = F.pmod(F.xxhash64(F.lit("part"), "node"), F.col("parts")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    cell = lambda block_, part_: F.xxhash64(F.lit("cell"), group, block_, part_)
    at_home = held.withColumn("_part", every("parts")).withColumn("cell", cell(block, F.col("_part")))
    abroad = (
        held.where("outside").withColumn("_block", every("blocks")).where(F.col("_block") != block)
        .withColumn("cell", cell(F.col("_block"), part))
    )
    return at_home.drop("_part").unionByName(abroad.drop("_block"))


def likely_edges(threshold: float):
    """Compares sketches in a cell: the components that likely pairs join, as stars."""

    def compare(cell: dict[str, np.ndarray]) -> list[tuple[int, int]]:
        marks, sizes, forest = sketches(cell["sketch"]), cell["n"], Forest()
        for i in range(1, len(sizes)):
            fit = np.minimum(sizes[:i], sizes[i]) >= threshold * np.maximum(sizes[:i], sizes[i]) - 1e-9
            rows = np.flatnonzero(fit & (cell["comp"][:i] != cell["comp"][i]))
            if len(rows):
                for j in rows[likely(marks[i], marks[rows], threshold)]:
                    forest.join(int(cell["comp"][i]), int(cell["comp"][j]))
        return forest.stars()

    return compare


def exact_edges(percent: int):
    """Compares full sets in a cell by an inverted index: the components that links join, as stars."""

    def compare(cell: dict[str, np.ndarray]) -> list[tuple[int, int]]:
        sets = [np.frombuffer(s, dtype=np.uint64) for s in cell["shingles"]]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, place = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(place, kind="stable")
        postings = owner[order]
        starts = np.searchsorted(place[order], np.arange(place.max() + 2))
        forest, at = Forest(), np.concatenate(([0], np.cumsum(sizes)))
        comps = cell["comp"].tolist()
        for i in range(1, len(sets)):
            own = place[at[i] : at[i + 1]]
            low, count = starts[own], starts[own + 1] - starts[own]
            ends = np.cumsum(count)
            spots = np.arange(ends[-1]) - np.repeat(ends - count, count) + np.repeat(low, count)
            both = np.bincount(postings[spots], minlength=len(sets))[:i]
            for j in np.flatnonzero(100 * both >= percent * (sizes[:i] + sizes[i] - both)):
                forest.join(comps[i], comps[j])
        return forest.stars()

    return compare


def likely_groups(nodes: DataFrame, tables: DataFrame, threshold: float) -> DataFrame:
    """(node, label): components over all pairs that meet in a table and have likely sketches.

    First each node is held against the least node of each of its tables. Only
    tables whose nodes are still in several components go on, in cells: those
    outside the table's largest component are held against all of its nodes.
    """
    marks = nodes.select("node", F.col("n_shingles").alias("n"), "sketch")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                fit = likely(sketches(batch["sketch_a"]), sketches(batch["sketch_b"]), threshold)
                yield batch.loc[fit, ["a", "b"]]

    stars = tables.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    pairs = (
        stars.join(marks.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a")), "a")
        .join(marks.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b")), "b")
        .where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)
    )
    labels = components(pairs.select("a", "b", "sketch_a", "sketch_b").mapInPandas(check, EDGES))

    rows = labelled(tables.select("node", "key"), labels)
    by_comp = rows.groupBy("key", "comp").count()
    open_ = (
        by_comp.groupBy("key")
        .agg(
            F.ceil(F.sum("count") / F.lit(CELL_ROWS)).alias("blocks"), F.count("*").alias("comps"),
            F.max_by("comp", F.struct("count", "comp")).alias("main"),
        )
        .where("comps > 1").select("key", "blocks", "main")
    )
    apart = rows.join(open_, "key").withColumn("outside", F.col("comp") != F.col("main"))
    cells = with_outside(apart, "key").select("cell", "node", "comp").join(marks, "node")
    return merged(labels, edges_of(cells, likely_edges(threshold)))


def with_sets(docs: DataFrame, members: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """`members` (node, digest, ...) with the shingles of their texts, computed again for them alone."""

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler(t) for t in batch["text"]]
            same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d for s, d in zip(sets, batch["digest"])]
            out = batch.drop(columns=["text", "digest"])
            out["shingles"] = [s.tobytes() for s in sets]
            yield out[same]

    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("binary").alias("text"))
    joined = texts.join(members, "node")
    extra = [f"{f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("text", "digest")]
    return joined.mapInPandas(shingles, ", ".join([*extra, "shingles binary"]))


def linked(members: DataFrame, percent: int) -> DataFrame:
    """(node, label): components over the exact links within each likely group; a node without links may have no row.

    A group that fits a cell is compared whole. A larger one goes through three
    rounds of cells: its blocks by one hash, its blocks by another, and at last
    the members outside the group's largest component, in blocks, against every
    block. Together these cover every pair that is not connected already.
    """
    compare = exact_edges(percent)
    sizes = members.groupBy("group").agg(
        F.greatest(F.ceil(F.count("*") / F.lit(CELL_ROWS)), F.ceil(F.sum("n") / F.lit(CELL_SHINGLES))).alias("blocks")
    )
    rows = stored(members.join(sizes, "group"), "members")
    block = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "node"), F.col("blocks")).cast("int")
    cell = lambda salt: F.xxhash64(F.lit(salt), "group", block(salt))
    take = ["cell", "node", "comp", "shingles"]

    first = rows.withColumn("cell", cell("first")).withColumn("comp", F.col("node"))
    # Each node stands in one cell, so the cell's stars are its components.
    labels = stored(edges_of(first.select(*take), compare), "links").select(F.col("b").alias("node"), F.col("a").alias("label"))
    large = rows.where("blocks > 1")
    if large.isEmpty():
        return labels
    second = labelled(large, labels).withColumn("cell", cell("second"))
    labels = merged(labels, edges_of(second.select(*take), compare))

    held = labelled(large.select("node", "group", "blocks"), labels)
    main = (
        held.groupBy("group", "comp").count().groupBy("group").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
    )
    held = (
        held.join(main, "group").withColumn("outside", F.col("comp") != F.col("main"))
        .join(large.select("node", "shingles"), "node")
    )
    third = with_outside(held, "group").select(*take)
    return merged(labels, edges_of(third, compare))


def with_same_ids(labels: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """`labels` once the sets of each id are linked, too. A node bears the least id that its set has, another id of it
    may have further sets."""
    named = rows.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    several = named.groupBy("doc_id").agg(F.min("digest").alias("one"), F.max("digest").alias("other")).where("one <> other")
    own = named.join(several.select("doc_id"), "doc_id").join(nodes.select("digest", "node"), "digest")
    edges = stored(own.where("node <> doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct(), "id-links")
    if edges.isEmpty():
        return labels
    # An id that bears no node is a node here; what it is linked with decides its label.
    return components(edges.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    A document's set is its distinct shingles of `words` words; words are runs
    without blanks, A-Z in lower case. Fewer words make one shingle; no words,
    or a null text, an empty set that is linked with nothing. Documents whose
    sets' similarity is at least `percent` / 100 are linked; component_id is the
    smallest id reachable, kept is true for the document with that id.

    Rows with one id are one document as to links, each with its own set: what
    either is linked with is one component. Null ids are kept, with a null component. An empty table gives an empty result.
    A link at the very threshold is missed about once in 12,000 times, one at
    0.85 about once in a million; no bucket, group or candidate list has a cap.

    Equal sets are one node, found by a map-side aggregate, so a third of all
    rows being copies of one text costs no shuffle of them.
    """
    ship_code(docs.sparkSession)
    with rows_per_batch(docs.sparkSession, BATCH_ROWS):
        rows = stored(described(docs, words, id_col, text_col), "described")
        threshold = percent / 100
        nodes = stored(
            rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
                F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"),
                F.first("tuples").alias("tuples"), F.first("sketch").alias("sketch"),
            ),
            "nodes",
        )
        groups = likely_groups(nodes, table_keys(nodes), threshold)
        members = nodes.select("node", "digest", F.col("n_shingles").alias("n")).join(
            groups.select("node", F.col("label").alias("group")), "node"
        )
        labels = linked(with_sets(docs, members, words, id_col, text_col), percent)
        labels = with_same_ids(labels, rows, nodes)
        classes = labelled(nodes.select("digest", "node"), labels).select("digest", "comp")
    return (
        rows.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("comp", "doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class of linked texts, in the columns of `docs`: the one with the smallest id, a null id last.

    Rows are linked and kept one by one, whatever their ids: of repeated rows
    and of copies without an id one stays, and a row with a
    text of its own stays though another row of its id leaves. Texts without words all stay.
    Among rows of equal id a hash of the text decides, then the place.
    """
    row = fresh(docs, "_row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    classes = near_duplicates(rows, id_col=row, text_col=text_col, **options).select(
        F.col("doc_id").alias("node"), F.col("component_id").alias("comp")
    )
    given = F.col(id_col).cast("long")
    order = F.struct(given.isNull().alias("none"), given.alias("id"), F.xxhash64(text_col).alias("text"), F.col(row).alias("node"))
    ranked = rows.select(F.col(row).alias("node"), order.alias("order"))
    kept = classes.join(ranked, "node").groupBy("comp").agg(F.min("order").alias("order"))
    name = fresh(rows, "_kept")
    return rows.join(kept.select(F.col("order.node").alias(name)), F.col(row) == F.col(name), "left_semi").drop(row)
