"""Alignment of two tokenizers over a corpus, with counts of the tokens that end together.

Tokenizer A is a byte-level BPE, B a SentencePiece model. Where tokens of both end at
the same byte, a group ends, and its last tokens are linked. How often each pair of
ids is linked in the corpus, and which pairs are their B id's most frequent, comes
back to the documents that hold the links.

Neither tokenizer joins anything across a single space that follows a character other
than a space and precedes one that is no white space, so texts are cut there and each
different piece of text is tokenized and aligned once in a task.

Counting is external. A task gathers links until a chunk is full, sorts them by B id,
A id and document, and spills one compressed run for each part of the B ids (a radix
of their hash): the pairs with their counts, and apart from these the documents of
each pair. The counts of a part are then added by k-way merges of its runs, at most
``FAN_IN`` at a time: a heap holds the last pair of every run's current block, and
what is not above the smallest of these is added up. The last merge of a part meets
its pairs B id by B id and so finds the maxima. Its totals go back to the runs of
the part, which give each document of a chunk its sums, and these meet chunk by chunk.
Runs hold a pair once, so a frequent id makes no part long: a merge handles no more
than the pairs there are, and a chunk's rows are as many as there are parts.

Defined cases: null and empty texts, and texts whose tokens do not give back a space
and the text, have no tokens and zeros; rows that repeat a doc_id, and nulls in it,
are documents of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from lotwise.llm import vec
from lotwise.llm.common import written

PARTS = 64  # that the B ids are dealt to
CHUNK = 1 << 21  # links of a chunk
KNOWN_BYTES = 1 << 26  # of aligned pieces that a task remembers
FAN_IN = 32  # runs merged at once
RUN_BLOCK = 1 << 15  # pairs of a compressed block
A_BITS = 32  # a pair is its B id above this many bits of A id

# A space may be cut off before a byte that begins no white space: not the ASCII
# ones, nor the first bytes of the wider ones.
_BEGINS = np.ones(256, bool)
_BEGINS[[0x20, *range(0x09, 0x0E), 0xC2, 0xE1, 0xE2, 0xE3]] = False

SPILLED = "chunk long, part int, blocks array<binary>, docs binary"
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable
    Latin-1 characters for themselves, the other bytes in order from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class Aligner:
    """Both tokenizers in one Python worker."""

    def __init__(self, a_path: str, b_path: str):
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        alphabet = byte_alphabet()
        size = self.a.get_vocab_size(with_added_tokens=True)
        shown = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(alphabet[c] for c in s) if all(c in alphabet for c in s) else s.encode() for s in shown]
        with open(b_path, "rb") as file:
            proto = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        # Pieces of text bring their own space.
        proto.normalizer_spec.add_dummy_prefix = False
        self.b = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.b_bytes = [
            bytes([int(p.piece[1:-1], 16)]) if p.type == p.BYTE else p.piece.replace("▁", " ").encode()
            for p in proto.pieces
        ]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side]) for side in (self.a_bytes, self.b_bytes))

    def align(self, pieces: list[bytes]) -> Aligned:
        """Groups of pieces of text, each with its space."""
        texts = [p.decode("utf-8", "replace") for p in pieces]
        ours = [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        theirs = self.b.encode(texts, num_threads=1)
        fits = np.ones(len(pieces), bool)
        whole = b"".join(pieces)
        if whole != _joined(self.a_bytes, ours) or whole != _joined(self.b_bytes, theirs):
            for k, piece in enumerate(pieces):
                fits[k] = piece == _joined(self.a_bytes, ours[k : k + 1]) == _joined(self.b_bytes, theirs[k : k + 1])
                if not fits[k]:
                    ours[k] = theirs[k] = []
        sizes = np.array([[len(x) for x in ours], [len(x) for x in theirs]], np.int64)
        a, b = (np.array([i for ids in side for i in ids], np.int64) for side in (ours, theirs))
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        # Tokens of either side that end a group, and the number of every token's group.
        last_a, last_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        n = np.add.reduceat(np.append(last_a, False), np.cumsum(sizes[0]) - sizes[0], dtype=np.int64)
        n[sizes[0] == 0] = 0
        pairs = b[last_b] << A_BITS | a[last_a]
        return Aligned(fits, sizes, n, pairs, _shown(a, b, last_a, last_b, group_a, group_b, sizes))


@dataclass
class Aligned:
    fits: np.ndarray  # whether the tokens give a piece back
    sizes: np.ndarray  # tokens of A and of B
    n_groups: np.ndarray
    pairs: np.ndarray  # of the last tokens of all groups
    groups: list[str]


def _joined(shown: list[bytes], ids: list[list[int]]) -> bytes:
    return b"".join([shown[i] for own in ids for i in own])


def _shown(a, b, last_a, last_b, group_a, group_b, sizes) -> list[str]:
    """Groups of every piece as text, written for all pieces at once: a group's tokens of A, then of B."""
    in_groups_a, in_groups_b = np.bincount(group_a), np.bincount(group_b)
    at_a = np.arange(len(a)) + (np.cumsum(in_groups_b) - in_groups_b)[group_a]
    at_b = np.arange(len(b)) + np.cumsum(in_groups_a)[group_b]
    ids, after = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
    ids[at_a], ids[at_b] = a, b
    after[at_a] = np.where(last_a, ord("|"), ord(","))
    after[at_b] = np.where(last_b, ord(";"), ord(","))
    digits = np.ones(len(ids), np.int64)
    most = int(ids.max(initial=0))
    while 10 ** int(digits.max(initial=1)) <= most:
        digits += ids >= 10 ** int(digits.max())
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - 1] = after
    for k in range(int(digits.max(initial=0))):
        some = digits > k
        out[ends[some] - 2 - k] = ord("0") + ids[some] // 10**k % 10
    text = out.tobytes().decode("ascii")
    tokens = np.cumsum(sizes.sum(axis=0))
    edges = np.concatenate([[0], ends])[np.concatenate([[0], tokens])].tolist()
    return [text[x : y - 1] if y > x else "" for x, y in zip(edges, edges[1:])]


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _spaced(part: vec.Slice) -> vec.Slice:
    """The slice with a space in front of every text."""
    data = np.full(len(part.data) + part.rows, 0x20, np.uint8)
    row = np.repeat(np.arange(part.rows), np.diff(part.offsets))
    data[np.arange(len(part.data)) + row + 1] = part.data
    return vec.Slice(part.first, data, part.offsets + np.arange(part.rows + 1))


def cuts(part: vec.Slice) -> np.ndarray:
    """Where the pieces of a slice of spaced texts begin; texts begin one too."""
    data, begins = part.data, np.zeros(len(part.data), bool)
    begins[1:-1] = (data[1:-1] == 0x20) & (data[:-2] != 0x20) & _BEGINS[data[2:]]
    begins[part.offsets[:-1]] = True
    return np.flatnonzero(begins)


class Known:
    """Pieces of text a task has aligned so far."""

    def __init__(self, tool: Aligner):
        self.tool = tool
        self.clear()

    def clear(self) -> None:
        self.number: dict[int, int] = {}
        self.groups: list[str] = []
        self.sizes = np.zeros((2, 0), np.int64)  # tokens of A and of B
        self.fits = np.zeros(0, bool)
        self.pairs = np.zeros(0, np.int64)
        self.ends = np.zeros(1, np.int64)  # of each piece's pairs
        self.size = 0

    def numbers(self, hashes: list[int]) -> np.ndarray:
        """Numbers of pieces by hash, -1 for unknown ones."""
        return np.array([self.number.get(h, -1) for h in hashes], np.int64)

    def learn(self, hashes: list[int], pieces: list[bytes]) -> None:
        found = self.tool.align(pieces)
        self.number |= zip(hashes, range(len(self.groups), len(self.groups) + len(hashes)))
        self.fits = np.append(self.fits, found.fits)
        self.sizes = np.append(self.sizes, found.sizes, axis=1)
        self.groups += found.groups
        self.pairs = np.append(self.pairs, found.pairs)
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(found.n_groups))
        self.size += sum(map(len, found.groups)) + 8 * len(found.pairs) + 250 * len(hashes)


class Chunk:
    """Documents of a chunk and their pieces, until it is spilled."""

    def __init__(self):
        self.ids: list[pa.Array] = []
        self.counts: list[np.ndarray] = []  # n_a, n_b, n_groups
        self.digests: list[str] = []
        self.docs: list[np.ndarray] = []  # document and pair of every link
        self.pairs: list[np.ndarray] = []
        self.links = 0

    def add(self, part: vec.Slice, doc_ids: pa.Array, known: Known) -> None:
        first = len(self.digests)
        full = np.flatnonzero(np.diff(part.offsets))
        spaced = _spaced(part)
        begins = cuts(spaced)
        ends = np.append(begins[1:], len(spaced.data))
        rows = np.searchsorted(spaced.offsets, begins, "right") - 1
        some = np.isin(rows, full)  # an empty text has not even its space
        begins, ends, rows = begins[some], ends[some], rows[some]
        hashes, at, inverse = np.unique(
            vec.span_hash(vec.byte_hash(spaced.data), begins, ends), return_index=True, return_inverse=True
        )
        kinds = known.numbers(hashes.tolist())
        new = np.flatnonzero(kinds < 0)
        if len(new):
            kinds[new] = np.arange(len(new)) + len(known.groups)
            texts = [spaced.data[a:b].tobytes() for a, b in zip(begins[at[new]].tolist(), ends[at[new]].tolist())]
            known.learn(hashes[new].tolist(), texts)
        kinds = kinds[inverse]
        bad = np.bincount(rows, weights=~known.fits[kinds], minlength=part.rows) > 0
        keep = ~bad[rows]
        kinds, rows = kinds[keep], rows[keep]
        edges = known.ends
        n = np.diff(edges)[kinds]
        # The pairs of every piece of every document, one after another.
        at = np.repeat(edges[kinds] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        self.docs.append(np.repeat(rows + first, n).astype(np.uint32))
        self.pairs.append(known.pairs[at])
        weights = [*known.sizes[:, kinds], n]
        self.counts.append(np.array([np.bincount(rows, w, part.rows) for w in weights]).astype(np.int64))
        shown, edge = known.groups, np.searchsorted(rows, np.arange(part.rows + 1)).tolist()
        kinds = kinds.tolist()
        for a, b in zip(edge, edge[1:]):
            joined = ";".join([shown[k] for k in kinds[a:b]])
            self.digests.append(hashlib.sha256(joined.encode()).hexdigest() if joined else "")
        self.ids.append(doc_ids)
        self.links += len(at)

    def spill(self, number: int) -> Iterator[pa.RecordBatch]:
        """A row of the documents (part -1), and one for every part that has links."""
        n_a, n_b, n_groups = np.concatenate(self.counts, axis=1)
        ids = pa.concat_arrays(self.ids)
        table = pa.table([ids, *map(pa.array, (n_a, n_b, n_groups)), pa.array(self.digests)], _DOCUMENT)
        yield _spilled(number, -1, [], _to_ipc(table))
        pairs, docs = np.concatenate(self.pairs), np.concatenate(self.docs)
        self.pairs, self.docs = [], []
        kinds, place = np.unique(pairs, return_inverse=True)
        # Side-major: pairs are in the order of B id and A id, documents within a pair.
        keys, n = np.unique(place.astype(np.uint64) << np.uint64(32) | docs, return_counts=True)
        place, docs = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        held = np.bincount(place, minlength=len(kinds))  # documents of each pair
        total = np.add.reduceat(n, np.cumsum(held) - held) if len(kinds) else held
        part = part_of(kinds)
        of_link = np.repeat(part, held)
        for p in np.unique(part).tolist():
            mine, rows = part == p, of_link == p
            body = [held[mine].astype(np.uint32), docs[rows], n[rows].astype(np.uint32)]
            yield _spilled(number, p, list(packed(kinds[mine], total[mine])), _to_binary(body))


_DOCUMENT = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]


def _spilled(chunk: int, part: int, blocks: list[bytes], docs: bytes) -> pa.RecordBatch:
    columns = [pa.array([chunk]), pa.array([part], pa.int32()), pa.array([blocks], pa.list_(pa.binary()))]
    return pa.record_batch([*columns, pa.array([docs], pa.binary())], ["chunk", "part", "blocks", "docs"])


def part_of(pairs: np.ndarray) -> np.ndarray:
    """Part that the B ids of pairs are dealt to."""
    return (vec.mix((pairs >> A_BITS).astype(np.uint64)) % np.uint64(PARTS)).astype(np.int64)


def _to_ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _to_binary(arrays: list[np.ndarray]) -> bytes:
    """Arrays of 4-byte numbers as one compressed run; the lengths of the first two come first."""
    head = np.array([len(arrays[0]), len(arrays[1])], np.uint32)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *(a.tobytes() for a in arrays)]))


def _from_binary(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    whole = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint32)
    first, second = (int(n) for n in whole[:2])
    return whole[2 : 2 + first], whole[2 + first : 2 + first + second], whole[2 + first + second :]


def packed(pairs: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
    """Sorted pairs with their counts as compressed blocks."""
    tool = zstandard.ZstdCompressor(level=1)
    for a in range(0, len(pairs), RUN_BLOCK):
        block = np.array([np.diff(pairs[a : a + RUN_BLOCK], prepend=0), counts[a : a + RUN_BLOCK]], np.int64)
        yield tool.compress(block.tobytes())


def unpacked(blocks: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    tool = zstandard.ZstdDecompressor()
    for blob in blocks:
        steps, counts = np.frombuffer(tool.decompress(blob), np.int64).reshape(2, -1)
        yield np.cumsum(steps), counts


def merged(runs: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs and summed counts of sorted runs, in order; one block of every run is held at a time."""
    readers = [unpacked(run) for run in runs]
    heap, block = [], {}

    def advance(r: int) -> None:
        block[r] = next(readers[r], None)
        if block[r] is not None:
            heapq.heappush(heap, (int(block[r][0][-1]), r))

    for r in range(len(readers)):
        advance(r)
    while heap:
        bound = heap[0][0]
        pairs, counts = [], []
        for r in [r for _, r in heap]:
            own, n = block[r]
            cut = int(np.searchsorted(own, bound, "right"))
            pairs.append(own[:cut])
            counts.append(n[:cut])
            block[r] = own[cut:], n[cut:]
        while heap and not len(block[heap[0][1]][0]):  # used up, as far as the bound
            advance(heapq.heappop(heap)[1])
        kinds, place = np.unique(np.concatenate(pairs), return_inverse=True)
        total = np.zeros(len(kinds), np.int64)
        np.add.at(total, place, np.concatenate(counts))
        yield kinds, total


def _merge_runs(key, table):
    """Some runs of a part as one."""
    runs = table.column("blocks").to_pylist()
    blocks = [b for pairs, counts in merged(runs) for b in packed(pairs, counts)]
    part = pa.array([key[0].as_py()], pa.int32())
    return pa.table([part, pa.array([blocks], pa.list_(pa.binary()))], ["part", "blocks"])


def _totals(key, table):
    """All runs of a part as one, in which the pairs that are their B id's most frequent have negative counts."""
    blocks, open_pairs, open_counts = [], np.zeros(0, np.int64), np.zeros(0, np.int64)

    def close(pairs: np.ndarray, counts: np.ndarray) -> None:
        if len(pairs):
            side = pairs >> A_BITS
            begins = np.flatnonzero(np.diff(side, prepend=-1))
            most = np.repeat(np.maximum.reduceat(counts, begins), np.diff(begins, append=len(side)))
            blocks.extend(packed(pairs, np.where(counts == most, -counts, counts)))

    for pairs, counts in merged(table.column("blocks").to_pylist()):
        pairs, counts = np.concatenate([open_pairs, pairs]), np.concatenate([open_counts, counts])
        # The last B id may go on in the next block.
        whole = int(np.searchsorted(pairs >> A_BITS, pairs[-1] >> A_BITS))
        close(pairs[:whole], counts[:whole])
        open_pairs, open_counts = pairs[whole:], counts[whole:]
    close(open_pairs, open_counts)
    part = pa.array([key[0].as_py()], pa.int32())
    return pa.table([part, pa.array([blocks], pa.list_(pa.binary()))], ["part", "totals"])


def totals(spilled: DataFrame) -> DataFrame:
    """part and its merged totals, by as many levels of merges as the chunks need."""
    runs = spilled.filter("part >= 0").select("part", "chunk", "blocks")
    batches = spilled.filter("part < 0").count()
    level = 0
    while (batches := -(-batches // FAN_IN)) > 1:
        batch = F.pmod(F.xxhash64("chunk", F.lit(level)), F.lit(batches)).alias("batch")
        runs = runs.select("part", batch, "blocks").groupBy("part", "batch")
        merge = lambda key, table: _merge_runs(key, table).append_column("chunk", pa.array([key[1].as_py()], pa.int64()))
        runs = runs.applyInArrow(merge, "part int, blocks array<binary>, chunk long")
        level += 1
    return written(runs.select("part", "blocks").groupBy("part").applyInArrow(_totals, "part int, totals array<binary>"), "pair-totals")


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the links of a run give its documents: numbers of best links and sums of counts."""
    part, known = None, None
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k] for name in batch.schema.names}
            if row["part"].as_py() != part:
                part = row["part"].as_py()
                known = [np.concatenate(x) for x in zip(*unpacked(row["totals"].as_py()))]
            pairs = np.concatenate([p for p, _ in unpacked(row["blocks"].as_py())])
            signed = known[1][np.searchsorted(known[0], pairs)]
            held, docs, n = _from_binary(row["docs"].as_py())
            signed, n = np.repeat(signed, held), n.astype(np.int64)
            some, place = np.unique(docs, return_inverse=True)
            sums = np.zeros((2, len(some)), np.int64)
            np.add.at(sums[0], place, n * (signed < 0))
            np.add.at(sums[1], place, n * np.abs(signed))
            table = pa.table([pa.array(some), *map(pa.array, sums)], ["doc", "n_best", "count_sum"])
            yield _spilled(row["chunk"].as_py(), part, [], _to_ipc(table))


def _documents(key, table):
    """Rows of a chunk's documents with the sums of all parts."""
    parts, blobs = table.column("part").to_pylist(), table.column("docs").to_pylist()
    read = lambda blob: pa.ipc.open_stream(blob).read_all()
    docs = read(blobs[parts.index(-1)])
    sums = np.zeros((2, docs.num_rows), np.int64)
    for part, blob in zip(parts, blobs):
        if part >= 0:
            some = read(blob)
            at = some.column("doc").to_numpy()
            sums[0][at] += some.column("n_best").to_numpy()
            sums[1][at] += some.column("count_sum").to_numpy()
    columns = [docs.column(name) for name in _DOCUMENT[:-1]] + [docs.column("n_groups"), *map(pa.array, sums)]
    return pa.table([*columns, docs.column("groups_sha256")], [f.split()[0] for f in RESULT.split(", ")])


def spill(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Runs of linked pairs and the documents of every chunk, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, chunk = Known(aligner(a_path, b_path)), Chunk()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in vec.slices(batch.column("text")):
                chunk.add(part, batch.column("doc_id").slice(part.first, part.rows), known)
                if known.size > KNOWN_BYTES:
                    known.clear()
                if chunk.links >= CHUNK:
                    yield from chunk.spill(number)
                    number, chunk = number + 1, Chunk()
        if chunk.ids:
            yield from chunk.spill(number)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(run, SPILLED), "pair-runs")


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Groups and links of every document (doc_id, text), and what their pairs count in the corpus."""
    spilled = spill(docs, a_path, b_path)
    runs = spilled.filter("part >= 0").join(totals(spilled), "part")
    runs = runs.select("chunk", "part", "blocks", "docs", "totals").mapInArrow(_contributions, SPILLED)
    sums = runs.unionByName(spilled.filter("part < 0")).select("chunk", "part", "docs")
    return sums.groupBy("chunk").applyInArrow(_documents, RESULT)

