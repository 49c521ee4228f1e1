"""N-gram Jaccard join by an LSH forest, with exact verification.

Texts are sets of five-word shingles (all words together where there are fewer) and
are linked at a Jaccard similarity of 0.8 or more. The steps:

1. Equal texts become one class; its member with the smallest doc_id represents it.
2. A representative has one short MinHash signature per tree. A tree is the sorted trie of
   these signatures; texts below one node share a prefix of the node's depth.
3. The join starts with the longest prefixes. Each round verifies all texts below
   the same node that no earlier round or tree has brought together, estimates the
   recall from the similarities found (each link weighs the inverse of its chance to
   be found so far), and shortens the prefixes by one while the estimate, or the
   chance of a link just at the threshold, is below the target.
4. Linked classes are joined to components by distributed label propagation.

A large node is cut into blocks by a hash, and pairs of blocks are verified in
separate tasks with matrix products, so no group meets in one task. A block pair
returns counts and a spanning forest, never all its pairs. A node whose members
equal those of an earlier tree's node is verified once.

Defined cases: null and empty texts have no words, are equal to each other and
linked to no other text; ties are broken by the smallest doc_id; rows that repeat
one doc_id with different texts are texts of their own with one id; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import vec
from lotwise.llm.common import written
from lotwise.operators.connected import components

SHINGLE = 5
THRESHOLD = 0.8
TREES = 12
DEPTH = 4  # MinHash values in a tree's signature, two bytes each
TARGET = 0.999  # estimated share of all links that must be found
AT_THRESHOLD = 0.998  # chance that a link just at the threshold must have
BLOCK = 1024  # texts of a node that one task compares with as many others
BLOCK_SHINGLES = 1 << 20  # shingles of such a block
COLUMNS = 4096  # shingles per matrix product
FILTER_BITS = 1 << 24  # of the fixed-size filter of candidate ids (2 MB)
BINS = 20  # similarities of links, from the threshold to 1
_WIDTH = 2 * DEPTH
_SEEDS = vec.mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(part: vec.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the texts of a slice with their rows, sorted by row."""
    words, hashes = vec.word_hashes(part)
    windows, first = vec.window_hashes(hashes, words.rows, SHINGLE)
    rows = words.rows[first]
    counts = np.bincount(words.rows, minlength=part.rows)
    for row in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        mine = hashes[words.rows == row]
        whole, _ = vec.window_hashes(mine, np.zeros(len(mine), np.int64), len(mine))
        windows, rows = np.concatenate([windows, whole]), np.concatenate([rows, [row]])
    order = np.lexsort([windows, rows])
    windows, rows = windows[order], rows[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (windows[1:] != windows[:-1]) | (rows[1:] != rows[:-1])
    return windows[keep], rows[keep]


def signatures(windows: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """TREES * DEPTH smallest hashes of each text's shingles, 16 bits of each; rows without shingles are zero."""
    out = np.zeros((n, TREES * DEPTH), ">u2")
    if len(windows):
        filled, start = np.unique(rows, return_index=True)
        for k, seed in enumerate(_SEEDS):
            mixed = windows * seed
            mixed ^= mixed >> np.uint64(32)
            out[filled, k] = vec.mix(np.minimum.reduceat(mixed, start)) & np.uint64(0xFFFF)
    return out


def chance(similarity, depth: int):
    """Probability that a pair of this similarity shares a prefix of the depth in some tree."""
    return 1 - (1 - np.asarray(similarity) ** depth) ** TREES


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the digest of the text, which copies share."""
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *more)
    return texts.withColumn("id", F.xxhash64(F.sha1(F.encode("text", "UTF-8"))))


def _each(texts: DataFrame, make, schema: str, wanted: np.ndarray | None = None) -> DataFrame:
    """Rows made of the shingles of different texts; a text is taken once per task, and once in all."""
    sent = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            ids = batch.column("id").to_numpy()
            if sent.value is not None:
                place = ids.view(np.uint64) % np.uint64(FILTER_BITS)
                maybe = sent.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1
                keep = maybe.astype(bool)
            else:
                keep = np.ones(len(ids), bool)
            for at in np.flatnonzero(keep).tolist():
                keep[at] = ids[at] not in done
                done.add(ids[at])
            batch = batch.filter(pa.array(keep))
            for part in vec.slices(batch.column("text")):
                windows, rows = shingles(part)
                edges = np.searchsorted(rows, np.arange(part.rows + 1))
                some = np.diff(edges) > 0
                chosen = batch.column("id").slice(part.first, part.rows).filter(pa.array(some))
                yield pa.record_batch([chosen, *make(windows, rows, edges, some)], [f.split()[0] for f in schema.split(", ")])

    one = texts.select("id", "text").mapInArrow(run, schema)
    return one.dropDuplicates(["id"])


def _signature_columns(windows, rows, edges, some) -> list[pa.Array]:
    marks = signatures(windows, rows, len(some))[some]
    return [pa.array([m.tobytes() for m in marks], pa.binary()), pa.array(np.diff(edges)[some])]


def _set_columns(windows, rows, edges, some) -> list[pa.Array]:
    return [pa.array([windows[a:b].tobytes() for a, b in zip(edges[:-1][some], edges[1:][some])], pa.binary())]


def _filter(ids: DataFrame) -> np.ndarray:
    """Bit array of fixed size that has the bit of every id, for a first choice before the exact join."""
    bit = F.col("id").bitwiseAND(FILTER_BITS - 1)  # a power of two: the remainder of the id
    words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 3).alias("byte"))
    got = words.agg(F.bit_or(F.expr("shiftleft(1, cast(bit & 7 as int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 3, np.uint8)
    out[got.column("byte").to_numpy()] = got.column("bits").to_numpy()
    return out


def _nodes(signed: DataFrame, depth: int) -> DataFrame:
    """Members of the trie nodes of a depth that a round has to verify: tree, node, blocks, id.

    A node below which all texts went the same way, one level down, has nothing new.
    """
    deeper = min(depth + 1, DEPTH)
    at = [
        F.struct(
            F.lit(tree).alias("tree"),
            F.substring("signature", tree * _WIDTH + 1, 2 * depth).alias("node"),
            F.substring("signature", tree * _WIDTH + 1, 2 * deeper).alias("child"),
        )
        for tree in range(TREES)
    ]
    members = signed.select("id", "size", F.explode(F.array(*at)).alias("at")).select("id", "size", "at.*")
    mixed = F.xxhash64("id", F.lit(1))
    nodes = members.groupBy("tree", "node").agg(
        F.count("*").alias("n"),
        F.sum("size").alias("size"),
        F.min("child").alias("low"),
        F.max("child").alias("high"),
        F.sum(F.shiftright(mixed, 24)).alias("sum"),
        F.bit_xor(mixed).alias("xor"),
    )
    nodes = nodes.filter("n > 1" if depth == DEPTH else "n > 1 AND low <> high")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_SHINGLES))
    blocks = F.least(blocks, "n").cast("int").alias("blocks")
    same = nodes.groupBy("n", "sum", "xor").agg(F.min(F.struct("tree", "node", blocks)).alias("one"))
    return written(members.drop("child", "size").join(same.select("one.*"), ["tree", "node"]), "lsh-nodes")


VERIFIED = "id long, root long, n long, bins array<long>"


def _verify(depth: int):
    """Compare two blocks of a node: link counts, a spanning forest and a histogram of the links."""

    def run(key, table):
        tree, low, high = (key[k].as_py() for k in (0, 2, 3))
        ids, block = table.column("id").to_numpy(), table.column("block").to_numpy()
        order = np.lexsort([ids, block])
        ids, block = ids[order], block[order]
        marks = table.column("signature").to_pylist()
        marks = np.array([np.frombuffer(marks[i], ">u2") for i in order]).reshape(len(ids), TREES, DEPTH)
        blobs = table.column("shingles").to_pylist()
        sets = [np.frombuffer(blobs[i], np.uint64) for i in order]
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        first, second, found = compare(sets, marks, left, right, tree, depth)
        counts = np.bincount(first, minlength=len(ids)) + np.bincount(second, minlength=len(ids))
        root = forest(len(ids), first, second)
        hit = np.flatnonzero(counts)
        place = np.minimum(((found - THRESHOLD) / (1 - THRESHOLD) * BINS).astype(int), BINS - 1)
        bins = [np.bincount(np.maximum(place, 0), minlength=BINS) if k == 0 else None for k in range(len(hit))]
        columns = [pa.array(ids[hit]), pa.array(ids[root[hit]]), pa.array(counts[hit])]
        return pa.table([*columns, pa.array(bins, pa.list_(pa.int64()))], ["id", "root", "n", "bins"])

    return run


def _same_prefix(marks: np.ndarray, left: np.ndarray, right: np.ndarray, tree: int, depth: int) -> np.ndarray:
    same = np.ones((len(left), len(right)), bool)
    for k in range(depth):
        same &= marks[left, tree, k][:, None] == marks[right, tree, k][None, :]
    return same


def compare(sets, marks, left, right, tree: int, depth: int):
    """Links between two blocks (or within one) that no earlier round or tree brought together."""
    same = len(left) == len(right) and (left == right).all()
    new = np.ones((len(left), len(right)), bool)
    if same:
        new = np.triu(new, 1)
    for t in range(TREES):
        if t < tree:
            new &= ~_same_prefix(marks, left, right, t, depth)
        elif depth < DEPTH:  # the round before had prefixes one longer
            new &= ~_same_prefix(marks, left, right, t, depth + 1)
    none = np.zeros(0, np.int64)
    if not new.any():
        return none, none, none.astype(np.float32)
    members = left if same else np.concatenate([left, right])
    sizes = np.array([len(sets[m]) for m in members])
    rows = np.repeat(np.arange(len(members)), sizes)
    _, column, often = np.unique(np.concatenate([sets[m] for m in members]), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    rows, (_, place) = rows[shared], np.unique(column[shared], return_inverse=True)
    order = np.argsort(place, kind="stable")
    rows, place = rows[order], place[order]
    overlap = np.zeros((len(left), len(right)), np.float64)
    for begin in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        a, b = np.searchsorted(place, [begin, begin + COLUMNS])
        dense = np.zeros((len(members), COLUMNS), np.float32)
        dense[rows[a:b], place[a:b] - begin] = 1
        overlap += dense[: len(left)] @ (dense if same else dense[len(left) :]).T
    size_left, size_right = (sizes, sizes) if same else (sizes[: len(left)], sizes[len(left) :])
    similarity = overlap / np.maximum(size_left[:, None] + size_right[None, :] - overlap, 1)
    x, y = np.nonzero(new & (similarity >= THRESHOLD))
    return left[x], right[y], similarity[x, y]


def forest(n: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Smallest member that each of n nodes is connected with."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[first], label[second])
        before = label.copy()
        np.minimum.at(label, first, least)
        np.minimum.at(label, second, least)
        label = label[label]
        if (label == before).all():
            return label


def _links(texts: DataFrame, signed: DataFrame, depth: int) -> DataFrame:
    """One round: id, root, n, bins, written."""
    members = _nodes(signed, depth)
    candidates = written(members.select("id").distinct(), "lsh-candidates")
    sets = _each(texts, _set_columns, "id long, shingles binary", _filter(candidates)).join(candidates, "id")
    full = written(sets.join(signed.drop("size"), "id"), "lsh-sets")
    members = members.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
    # A block meets every other and itself; the lower number stands first.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = members.select("tree", "node", "id", "block", other)
    pairs = pairs.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    groups = pairs.drop("other").join(full, "id").groupBy("tree", "node", "low", "high")
    return written(groups.applyInArrow(_verify(depth), VERIFIED), "lsh-links")


def estimated_recall(bins: list[int], depth: int) -> float:
    """Share of all links found, if each found link stands for the inverse of its chance."""
    middle = THRESHOLD + (np.arange(BINS) + 0.5) / BINS * (1 - THRESHOLD)
    found = np.array(bins, float)
    return float(found.sum() / (found / chance(middle, depth)).sum()) if found.sum() else 1.0


def _classes(texts: DataFrame, target: float) -> DataFrame:
    """Every different text: id, least, class_id, n_links, n_copies, first (whether it stands for its class)."""
    classes = texts.groupBy("id").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"))
    classes = written(classes, "text-classes")
    signed = written(_each(texts, _signature_columns, "id long, signature binary, size long"), "signatures")

    links, bins = None, [0] * BINS
    for depth in range(DEPTH, 0, -1):
        found = _links(texts, signed, depth)
        links = found if links is None else links.unionByName(found)
        more = found.select(F.posexplode("bins").alias("bin", "n")).groupBy("bin").agg(F.sum("n").alias("n")).collect()
        for row in more:
            bins[row["bin"]] += row["n"]
        if chance(THRESHOLD, depth) >= AT_THRESHOLD and estimated_recall(bins, depth) >= target:
            break

    links = written(links.select("id", "root", "n"), "links")
    counts = links.groupBy("id").agg(F.sum("n").alias("n_links"))
    named = (
        classes.join(counts, "id", "left")
        .join(components(links), "id", "left")
        .select(
            "id",
            "least",
            "n_copies",
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.coalesce("label", "id").alias("label"),
        )
    )
    named = written(named, "classes")
    first = named.groupBy("label").agg(F.min(F.struct("least", "id")).alias("first"))
    named = named.join(first, "label").select(
        "id",
        "least",
        F.col("first.least").alias("class_id"),
        "n_links",
        "n_copies",
        (F.col("first.id") == F.col("id")).alias("first"),
    )
    return written(named, "classes")


def join(docs: DataFrame, target: float = TARGET) -> DataFrame:
    """Near-duplicate classes: doc_id, class_id, n_links, n_copies for every document.

    ``n_links`` counts the other different texts linked to the document's text,
    ``n_copies`` the rows with an equal text; ``class_id`` is the smallest doc_id of
    the documents that links and copies connect.
    """
    texts = _texts(docs)
    named = _classes(texts, target).drop("least", "first")
    return texts.select("doc_id", "id").join(named, "id").drop("id")


def keep_one(docs: DataFrame, target: float = TARGET) -> DataFrame:
    """One document of each class, with all its columns.

    The smallest doc_id stays; of rows equal in doc_id and text, the one whose
    columns have the smallest hash.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = _texts(docs.select("doc_id", "text", whole), "doc").select("id", "doc_id", "doc")
    chosen = _classes(_texts(docs), target).filter("first").select("id", "least")
    rows = rows.join(chosen, "id").filter(F.col("doc_id").eqNullSafe(F.col("least")))
    return rows.groupBy("id").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc")).select("doc.*")
