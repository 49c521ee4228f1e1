import hashlib

import cases
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from lotwise.llm import pieces
from lotwise.llm.common import ready, table

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", "a ", " a  b ", "▁", "a▁ b", "日本語 テスト", "😀😀 x", "\n\n a\tb", "\x00a", "ﬁ Ａ ①", "<s> </s>",
       "é" * 500, "a" * 2000, " " * 50 + "x", "é ½ ¨"]


@pytest.fixture(scope="module")
def folding(tmp_path_factory):
    """The same pieces with a compiled character map that folds compatible characters and trims spaces."""
    proto = pb.ModelProto.FromString(open(PATH, "rb").read())
    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    proto.normalizer_spec.CopyFrom(pb.ModelProto.FromString(rule.serialized_model_proto()).normalizer_spec)
    path = tmp_path_factory.mktemp("model") / "folding.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


def texts_of(spark):
    return [r["text"] for r in table(spark, "/root/testdata/sf0.001", "documents").collect()] + ODD


def test_ids_and_spans_of_the_plain_model(spark):
    tool, library = pieces.Encoder(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = texts_of(spark)
    for text, got in zip(texts, tool.encode(texts)):
        assert got.ids == library.encode(text)
        raw = text.encode()
        assert all(a <= b for a, b in zip(got.starts, got.ends))
        assert list(got.starts[1:]) == list(got.ends[:-1])  # without gaps
        if raw:
            assert got.starts[0] == 0 and got.ends[-1] == len(raw)
        for piece, a, b in zip(got.ids, got.starts, got.ends):
            if not library.is_byte(piece) and "▁" not in text:
                shown = library.id_to_piece(piece).replace("▁", " ")
                assert raw[a:b].decode() in (shown, shown.removeprefix(" "))


def test_character_map_follows_longest_prefixes(spark, folding):
    tool, library = pieces.Encoder(folding), sentencepiece.SentencePieceProcessor(model_file=folding)
    texts = texts_of(spark)[-80:]
    for text, got in zip(texts, tool.encode(texts)):
        assert got.ids == library.encode(text)
    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    for text in ["ＡＢＣ ①  x", "ﬁne é", "½ km²", "x y"]:
        ours = tool.rules.normalise(text)
        normal, offsets = rule.normalize(text, with_offsets=True)
        assert ours.text == normal
        chars = [text.encode()[: int(a)].decode() for a in ours.starts]
        by_char, at = [], 0
        for c in ours.text:
            by_char.append(len(chars[at]))
            at += len(c.encode())
        assert by_char == list(offsets)[: len(by_char)]


def test_digests_match_the_library(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = pieces.digests(docs, PATH).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_awkward_rows(spark):
    ready(spark)
    docs = cases.awkward(spark)
    got = cases.by_id(pieces.encode(docs, PATH).collect())
    assert sum(map(len, got.values())) == docs.count()
    assert got[3][0]["ids"] == [] and got[3][0]["decoded"] == ""
    assert got[6][0]["decoded"] == cases.text_of(30_000, 3)
    assert got[1][0] == got[1][1] and got[1][0]["ids"] == got[2][0]["ids"]
    assert pieces.encode(cases.empty(spark), PATH).count() == 0
