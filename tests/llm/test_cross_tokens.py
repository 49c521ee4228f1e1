import hashlib
from collections import Counter

import cases
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lotwise.llm import cross_tokens, vec
from lotwise.llm.common import ready, table

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SPACES = ["\t", "\n", "\r", "\x85", "\xa0", " ", " ", " ", "　", "​", "﻿", "\x1f"]


@pytest.fixture(scope="module")
def tools():
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    return a, b


def ends(parts):
    return np.cumsum([len(p) for p in parts]).tolist()


def alone(tools, text):
    """Ids of both sides, groups as text and linked pairs (B id, A id) of one whole text."""
    a, b = tools
    alphabet = cross_tokens.byte_alphabet()
    ours = a.encode(" " + text, add_special_tokens=False).ids if text else []
    theirs = b.encode(text) if text else []
    left = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ours]
    right = []
    for i in theirs:
        piece = b.id_to_piece(i)
        right.append(bytes([int(piece[1:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    whole = (" " + (text or "")).encode()
    if b"".join(left) != whole or b"".join(right) != whole:
        return [], [], "", []
    at_a, at_b = ({e: k + 1 for k, e in enumerate(ends(x))} for x in (left, right))
    groups, pairs, i, j = [], [], 0, 0
    for e in sorted(set(at_a) & set(at_b)):
        groups.append(f"{','.join(map(str, ours[i : at_a[e]]))}|{','.join(map(str, theirs[j : at_b[e]]))}")
        i, j = at_a[e], at_b[e]
        pairs.append((theirs[j - 1], ours[i - 1]))
    return ours, theirs, ";".join(groups), pairs


def brute(tools, docs):
    found = [alone(tools, text) for _, text in docs]
    count = Counter(p for f in found for p in f[3])
    most = {}
    for (b, _), n in count.items():
        most[b] = max(most.get(b, 0), n)
    rows = []
    for (doc_id, _), (ours, theirs, groups, pairs) in zip(docs, found):
        best, total = sum(count[p] == most[p[0]] for p in pairs), sum(count[p] for p in pairs)
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        rows.append((doc_id, len(ours), len(theirs), len(pairs), len(pairs), best, total, digest))
    return sorted(rows, key=repr)


def ours(docs):
    return sorted(map(tuple, cross_tokens.align(docs, *PATHS).collect()), key=repr)


def test_real_documents_match_brute_force(spark, tools):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert ours(docs) == brute(tools, [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_small_chunks_and_many_merges(spark, tools, monkeypatch):
    """Every batch is a chunk, so that runs are merged in three levels; one pair is in all documents."""
    ready(spark)
    for name, value in (("CHUNK", 1), ("FAN_IN", 2), ("RUN_BLOCK", 3), ("KNOWN_BYTES", 1)):
        monkeypatch.setattr(cross_tokens, name, value)
    docs = [(k, f"the the the {cases.text_of(k % 7, k)}") for k in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert ours(frame) == brute(tools, docs)


def test_awkward_rows(spark, tools):
    docs = cases.awkward(spark)
    odd = ["<|endoftext|> and <s> <0x41>", "a ▁ b", "  two  spaces ", " ", "tab\tand 日本語 \U0001f600", "don't 'll we've"]
    odd += [f"x{s} y {s}z {s} {s}{s}end" for s in SPACES] + [f"{s}front" for s in SPACES]
    more = spark.createDataFrame([(100 + k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    assert ours(docs) == brute(tools, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert cross_tokens.align(cases.empty(spark), *PATHS).count() == 0


def test_cut_texts_have_the_tokens_of_whole_texts(tools):
    rng = np.random.default_rng(8)
    signs = [*"ab 'Z9.é日", " ", "  ", "’", *SPACES]
    texts = ["".join(rng.choice(signs, rng.integers(1, 30))) for _ in range(1500)]
    (part,) = vec.slices(vec.pa.array(texts))
    spaced = cross_tokens._spaced(part)
    begins = cross_tokens.cuts(spaced)
    tool = cross_tokens.Aligner(*PATHS)
    pieces = [spaced.data[a:b].tobytes() for a, b in zip(begins, np.append(begins[1:], len(spaced.data)))]
    found = tool.align(pieces)
    rows = np.searchsorted(spaced.offsets, begins, "right") - 1
    for row, text in enumerate(texts):
        mine = np.flatnonzero(rows == row)
        groups = ";".join(found.groups[k] for k in mine) if found.fits[mine].all() else ""
        assert groups == alone(tools, text)[2], repr(text)


def test_merging_runs():
    rng = np.random.default_rng(2)
    runs, want = [], Counter()
    for _ in range(9):
        pairs = np.unique(rng.integers(0, 10**6, 500) * 7)
        counts = rng.integers(1, 9, len(pairs))
        want.update(dict(zip(pairs.tolist(), counts.tolist())))
        runs.append([b for k in range(0, len(pairs), 40) for b in cross_tokens.packed(pairs[k : k + 40], counts[k : k + 40])])
    got = [np.concatenate(x) for x in zip(*cross_tokens.merged(runs))]
    assert dict(zip(got[0].tolist(), got[1].tolist())) == want and (np.diff(got[0]) > 0).all()
