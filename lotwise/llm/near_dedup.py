"""MinHash near-duplicate removal with sequential Bayesian verification.

Texts are sets of four-word shingles of their lower-cased words (all words together
where there are fewer) and are linked at a Jaccard similarity of 0.8 or more.

1. Documents with equal sets are one class, which its smallest doc_id represents and
   which has one MinHash signature.
2. Bands of the signature are bucket keys. Classes that share a bucket are candidates.
3. A candidate pair's signatures are compared batch by batch. After m of n values
   agree, the chance that its similarity is at least the threshold follows from the
   Beta posterior; a pair is dropped once this chance is below ``MISS``.
4. Survivors are verified on their full sets.

Only reachability is asked for, so a bucket doesn't need all its pairs. First every
member meets the ``LEADERS`` of its bucket. Members of a bucket that are not connected by
these links (as far as labels passed along them tell) meet in blocks: pure blocks hold members of one connected set and are not compared with
each other or within, mixed blocks hold the rest. A block pair is one task, returns a
spanning forest, and skips pairs that its own links have connected already. So a
large group of near copies costs one pair a member, and no group meets in one task.

Defined cases: null and empty texts have no shingles and are linked with nothing,
not even each other; a null doc_id is the largest; rows that repeat a doc_id with
another text are documents of their own with one id; ``kept`` is true for all rows
that bear their component's smallest doc_id; other columns are ignored; an empty
table gives no rows. Sets are held as 64-bit hashes of their shingles. Pairs just
at the threshold share a bucket with a chance of 0.9999, and are dropped by the
posterior bound with one of some 1e-5 in each batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import vec
from lotwise.llm.common import discard, written
from lotwise.operators.connected import components

SHINGLE = 4
PERCENT = 80  # least similarity of linked texts
BANDS = 24
BAND_VALUES = 5
VALUES = BANDS * BAND_VALUES  # of a signature, two bytes each
BATCH = 20  # values compared before each look at the posterior
MISS = 1e-5  # a pair is dropped when the chance that it is a link falls below
LEADERS = 2  # of a bucket, which meet all its members
JUMPS = 2  # along pointers, before buckets that are not connected go to blocks
FAN = 256  # members that one task verifies against a leader
BLOCK = 1024  # members of a block
SHINGLES = 1 << 20  # of a block, or of the members verified against a leader
FILTER_BITS = 1 << 24  # of the fixed-size filter of wanted documents (2 MB)
ROWS_AT_ONCE = 64  # of a block pair whose signatures are compared together
_SEEDS = vec.mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def shingle_sets(part: vec.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the texts of a slice and their rows, by row and hash."""
    part = vec.Slice(part.first, _LOWER[part.data], part.offsets)
    words, hashes = vec.word_hashes(part)
    shingles, first = vec.window_hashes(hashes, words.rows, SHINGLE)
    rows = words.rows[first]
    counts = np.bincount(words.rows, minlength=part.rows)
    few = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    begins = np.searchsorted(words.rows, few)
    whole = [vec.window_hashes(hashes[b : b + n], np.zeros(n, int), n)[0] for b, n in zip(begins, counts[few])]
    shingles, rows = np.concatenate([shingles, *whole]), np.concatenate([rows, few])
    order = np.lexsort([shingles, rows])
    shingles, rows = shingles[order], rows[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (shingles[1:] != shingles[:-1]) | (rows[1:] != rows[:-1])
    return shingles[keep], rows[keep]


def signatures(shingles: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Two bytes of the least value of each set under each seed."""
    out = np.empty((len(begins), VALUES), ">u2")
    for k, seed in enumerate(_SEEDS):
        out[:, k] = (vec.mix(np.minimum.reduceat(shingles * seed, begins)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _set_ids(shingles: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.add.reduceat(vec.mix(shingles), begins)
    crossed = np.bitwise_xor.reduceat(vec.mix(shingles + np.uint64(0x9E3779B97F4A7C15)), begins)
    return vec.mix(total + vec.mix(crossed + sizes.astype(np.uint64))).view(np.int64)


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, and for sets that are not empty their id and signature."""
    names = ["doc_id", "id", "n_shingles", "signature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch.column("text")):
                shingles, rows = shingle_sets(part)
                sizes = np.bincount(rows, minlength=part.rows)
                some = np.flatnonzero(sizes)
                ids, marks = np.zeros(part.rows, np.int64), [None] * part.rows
                if len(some):
                    begins = np.searchsorted(rows, some)
                    ids[some] = _set_ids(shingles, begins, sizes[some])
                    for at, mark in zip(some.tolist(), signatures(shingles, begins)):
                        marks[at] = mark.tobytes()
                columns = [pa.array(ids, mask=sizes == 0), pa.array(sizes), pa.array(marks, pa.binary())]
                yield pa.record_batch([batch.column("doc_id").slice(part.first, part.rows), *columns], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, id long, n_shingles long, signature binary")


def _bits(wanted: DataFrame) -> np.ndarray:
    """Bit array of fixed size with the bit of every ``least`` doc_id, a first choice before the exact join."""
    place = F.xxhash64("least").bitwiseAND(FILTER_BITS - 1)
    byte = wanted.select(F.shiftright(place, 3).alias("byte"), place.bitwiseAND(7).cast("int").alias("bit"))
    got = byte.groupBy("byte").agg(F.bit_or(F.expr("shiftleft(1, bit)")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 3, np.uint8)
    out[got.column("byte").to_numpy()] = got.column("bits").to_numpy()
    return out


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and sorted shingles of the wanted classes (id, least)."""
    sent = docs.sparkSession.sparkContext.broadcast(_bits(wanted))
    place = F.xxhash64(F.col("doc_id").cast("long")).bitwiseAND(FILTER_BITS - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("place").to_numpy()
            maybe = sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1
            for part in vec.slices(batch.column("text").filter(pa.array(maybe.astype(bool)))):
                shingles, rows = shingle_sets(part)
                sizes = np.bincount(rows, minlength=part.rows)
                sizes = sizes[sizes > 0]
                if not len(sizes):
                    continue
                edges = np.concatenate([[0], np.cumsum(sizes)])
                ids = _set_ids(shingles, edges[:-1], sizes)
                blobs = [shingles[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
                yield pa.record_batch([pa.array(ids), pa.array(blobs, pa.binary())], ["id", "shingles"])

    found = docs.select("text", place.alias("place")).mapInArrow(run, "id long, shingles binary")
    return found.dropDuplicates(["id"]).join(wanted.select("id"), "id", "left_semi")


def _array(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


@lru_cache(maxsize=1)
def least_matches() -> list[int]:
    """For each number of batches the fewest agreeing values that leave a pair alive.

    With a uniform prior the similarity given m of n agreements is Beta(m + 1, n - m + 1);
    its chance to be at least t is that of at most m successes in n + 1 trials of chance t.
    """
    t, out = PERCENT / 100, []
    for n in range(BATCH, VALUES + 1, BATCH):
        chance, m = 0.0, -1
        while chance < MISS:
            m += 1
            chance += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def _alive(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which rows of two signature tables stay candidates after all batches."""
    alive, agreed = np.arange(len(left)), np.zeros(len(left), np.int64)
    for k, least in enumerate(least_matches()):
        values = slice(k * BATCH, (k + 1) * BATCH)
        agreed = agreed + (left[alive, values] == right[alive, values]).sum(axis=1)
        keep = agreed >= least
        alive, agreed = alive[keep], agreed[keep]
    return alive


def _table(column: pa.Array) -> np.ndarray:
    """Signatures of a binary column as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(len(column), VALUES)


def _survivors(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that sequential comparison of their signatures does not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = _alive(_table(batch.column("of_a")), _table(batch.column("of_b")))
                yield batch.select(["a", "b"]).take(pa.array(keep))

    left = classes.select(F.col("id").alias("a"), F.col("signature").alias("of_a"))
    right = classes.select(F.col("id").alias("b"), F.col("signature").alias("of_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def _linked(common: np.ndarray, one: int, others: np.ndarray) -> np.ndarray:
    return 100 * common >= PERCENT * (one + others - common)


def _against_leader(key, table):
    """Members whose sets are linked with the leader's."""
    leader, ids = key[0].as_py(), table.column("id").to_numpy()
    blobs = table.column("shingles").to_pylist()
    own = next(_array(blobs[i]) for i in np.flatnonzero(ids == leader))
    others = np.flatnonzero(ids != leader)
    sets = [_array(blobs[i]) for i in others]
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    at = np.minimum(np.searchsorted(own, values), len(own) - 1)
    common = np.add.reduceat((own[at] == values).astype(np.int64), np.cumsum(sizes) - sizes)
    hit = ids[others[_linked(common, len(own), sizes)]]
    return pa.table([pa.array(hit), pa.array(np.full(len(hit), leader))], ["id", "root"])


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (id, root) among pairs (a, b), each found on the full sets."""
    named = classes.select("id", "least", "n_shingles")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = written(_sets(docs, named.join(ids, "id")), "dedup-sets")
    sized = pairs.join(named.select(F.col("id").alias("b"), "n_shingles"), "b")
    fans = sized.groupBy("a").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    fans = fans.select("a", F.ceil(F.greatest(F.col("n") / FAN, F.col("size") / SHINGLES)).cast("int").alias("fans"))
    dealt = pairs.join(fans, "a").select("a", "b", F.pmod(F.xxhash64("b", F.lit(3)), F.col("fans")).alias("fan"))
    members = dealt.select("a", "fan", F.col("b").alias("id"))
    leaders = dealt.select("a", "fan", F.col("a").alias("id")).distinct()
    groups = members.unionByName(leaders).join(sets, "id").groupBy("a", "fan")
    links = written(groups.applyInArrow(_against_leader, "id long, root long"), "dedup-links")
    discard(sets)
    return links


def _roots(n: int, label: np.ndarray) -> list[int]:
    """Union-find parents in which members of equal label are together."""
    _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
    return first[inverse].tolist() if n else []


def _between_blocks(key, table):
    """Links between two blocks of a bucket, or within a mixed one, as a spanning forest of their labels."""
    low, high = key[1].as_py(), key[2].as_py()
    ids, block = table.column("id").to_numpy(), table.column("block").to_numpy()
    order = np.lexsort([ids, block])
    ids, block = ids[order], block[order]
    label = table.column("label").to_numpy()[order]
    marks = _table(table.column("signature").take(pa.array(order)).combine_chunks())
    blobs = table.column("shingles").take(pa.array(order)).to_pylist()
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    parent, links = _roots(len(ids), label), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for begin in range(0, len(left), ROWS_AT_ONCE):
        some = left[begin : begin + ROWS_AT_ONCE]
        apart = label[some][:, None] != label[right][None, :]
        if low == high:
            apart &= some[:, None] < right[None, :]
        x, y = np.nonzero(apart)
        x, y = some[x], right[y]
        for at in _alive(_Rows(marks, x), _Rows(marks, y)).tolist():
            a, b = root(int(x[at])), root(int(y[at]))
            if a == b:
                continue
            one, other = _array(blobs[x[at]]), _array(blobs[y[at]])
            common = len(np.intersect1d(one, other, assume_unique=True))
            if _linked(common, len(one), len(other)):
                parent[a] = b
                links.append((label[x[at]], label[y[at]]))
    return pa.table([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["id", "root"])


class _Rows:
    """Rows of a signature table by number, taken only where they are compared."""

    def __init__(self, table: np.ndarray, rows: np.ndarray):
        self.table, self.rows = table, rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, at) -> np.ndarray:
        rows, values = at
        return self.table[:, values][self.rows[rows]]


def _in_blocks(docs: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """Linked labels (id, root) of members (key, id, label, n_shingles) that share a bucket."""
    sizes = members.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    need = F.greatest(F.col("n") / BLOCK, F.col("size") / SHINGLES)
    sizes = sizes.withColumn("pure", need >= 0.5).withColumn("pure_blocks", F.ceil(need).cast("int"))
    mixed = sizes.filter("NOT pure").groupBy("key").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    mixed = mixed.select("key", F.ceil(need).cast("int").alias("mixed_blocks"))
    dealt = members.join(sizes.select("key", "label", "pure", "pure_blocks"), ["key", "label"])
    dealt = dealt.join(mixed, "key", "left")
    part = F.xxhash64("id", F.lit(11))
    # A block's number tells the set it is pure in; mixed blocks are pure in none.
    block = F.when(
        F.col("pure"), F.xxhash64("label", F.pmod(part, F.col("pure_blocks")))
    ).otherwise(F.pmod(part, F.col("mixed_blocks")))
    owner = F.when(F.col("pure"), F.col("label"))
    dealt = written(dealt.select("key", "id", "label", block.alias("block"), owner.alias("owner")), "dedup-blocks")
    blocks = dealt.select("key", "block", "owner").distinct()
    other = blocks.select("key", F.col("block").alias("high"), F.col("owner").alias("high_owner"))
    pairs = blocks.withColumnRenamed("block", "low").join(other, "key")
    mixed_pair = F.col("owner").isNull() | F.col("high_owner").isNull()
    meet = F.when(mixed_pair, F.col("low") <= F.col("high")).otherwise(
        (F.col("low") < F.col("high")) & (F.col("owner") != F.col("high_owner"))
    )
    pairs = pairs.filter(meet).select("key", "low", "high")
    sides = F.explode(F.array_distinct(F.array("low", "high"))).alias("block")
    placed = pairs.select("key", "low", "high", sides).join(dealt.drop("owner"), ["key", "block"])
    wanted = classes.select("id", "least", "signature").join(dealt.select("id").distinct(), "id")
    full = written(_sets(docs, wanted).join(wanted.select("id", "signature"), "id"), "dedup-sets")
    groups = placed.join(full, "id").groupBy("key", "low", "high")
    links = written(groups.applyInArrow(_between_blocks, "id long, root long"), "dedup-links")
    discard(dealt, full)
    return links


def _buckets(classes: DataFrame) -> DataFrame:
    """Members (key, id) of all buckets of two or more classes; of buckets with equal members one."""
    width = 2 * BAND_VALUES
    keys = [F.xxhash64(F.substring("signature", band * width + 1, width), F.lit(band)) for band in range(BANDS)]
    members = classes.select("id", F.explode(F.array(*keys)).alias("key"))
    mixed = F.xxhash64("id", F.lit(5))
    buckets = members.groupBy("key").agg(
        F.count("*").alias("n"), F.sum(F.shiftright(mixed, 24)).alias("sum"), F.bit_xor(mixed).alias("xor")
    )
    buckets = buckets.filter("n > 1").groupBy("n", "sum", "xor").agg(F.min("key").alias("key"))
    return written(members.join(buckets.select("key"), "key"), "dedup-buckets")


def _star_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of every member b of a bucket with the bucket's leaders a; each pair once."""
    leaders = [F.min_by("id", F.xxhash64("id", F.lit(k))) for k in range(LEADERS)]
    leaders = members.groupBy("key").agg(F.array_distinct(F.array(*leaders)).alias("leaders"))
    pairs = members.join(leaders, "key").select("id", F.explode("leaders").alias("a")).filter("id <> a")
    pairs = pairs.select(F.least("a", "id").alias("x"), F.greatest("a", "id").alias("y"), "a")
    pairs = pairs.groupBy("x", "y").agg(F.min("a").alias("a"))
    return pairs.select("a", F.when(F.col("a") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("b"))


def _labels(links: DataFrame) -> DataFrame:
    """A label for both ends of every link: ids of one label are connected, though not all connected ids share one.

    Each id points to the first of itself and its neighbours in the order of the first
    leaders, and follows the pointers a few steps.
    """

    def ranked(column: str):
        return F.struct(F.xxhash64(column, F.lit(0)).alias("rank"), F.col(column).alias("id"))

    both = links.unionByName(links.select(F.col("root").alias("id"), F.col("id").alias("root")))
    first = both.groupBy("id").agg(F.min(ranked("root")).alias("first"))
    labels = written(first.select("id", F.least(ranked("id"), "first")["id"].alias("label")), "dedup-labels")
    for _ in range(JUMPS):
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        before, labels = labels, written(labels.join(up, "label").select("id", F.col("up").alias("label")), "dedup-labels")
        discard(before)
    return labels


def _components(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """id and label of the classes that links connect with others."""
    members = _buckets(classes)
    survivors = written(_survivors(_star_pairs(members), classes), "dedup-survivors")
    links = _verified(docs, survivors, classes)
    discard(survivors)
    labels = _labels(links)
    # From here on labels stand for the ids they connect.
    open_members = members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    apart = open_members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    open_members = written(open_members.join(apart.filter("low <> high").select("key"), "key"), "dedup-open")
    left, right = (labels.select(F.col("id").alias(end), F.col("label").alias(of)) for end, of in (("id", "u"), ("root", "v")))
    edges = links.join(left, "id").join(right, "root").select(F.col("u").alias("id"), F.col("v").alias("root"))
    edges = edges.filter("id <> root").distinct()
    if not open_members.isEmpty():
        open_members = open_members.join(classes.select("id", "n_shingles"), "id")
        edges = edges.unionByName(_in_blocks(docs, open_members, classes))
    whole = components(edges).select(F.col("id").alias("label"), F.col("label").alias("whole"))
    # Labels of block links may belong to ids that no star reached, and stand for themselves.
    ids = labels.unionByName(whole.select(F.col("label").alias("id"), F.col("label"))).distinct()
    return ids.join(whole, "label", "left").select("id", F.coalesce("whole", "label").alias("label"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document (doc_id, text)."""
    signed = written(_signed(docs), "dedup-signed")
    classes = signed.filter("id IS NOT NULL").groupBy("id")
    classes = classes.agg(
        F.min("doc_id").alias("least"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("signature").alias("signature"),
    )
    classes = written(classes, "dedup-classes")
    labels = _components(docs, classes)
    named = classes.select("id", "least").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = written(named, "dedup-labels")
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "label").select("id", "component_id", F.lit(True).alias("named"))
    # The join's only large keys are the ids of many copies; its other side has one row each.
    rows = signed.drop("signature").join(named, "id", "left")
    component = F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id"))
    rows = rows.select("doc_id", F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"), component.alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
