import hashlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from kithline.llm import sentencepiece_rounds
from kithline.llm.sentencepiece_rounds import Encoder, Model, encode_pieces
from tests.llm.common import ROWS, documents

PIECES = public_tokenizers.path("piece_bpe_32k.model")
with open(PIECES, "rb") as _f:
    MODEL = Model(_f.read())
ENCODER, LIBRARY = Encoder(MODEL), sentencepiece.SentencePieceProcessor(model_file=PIECES)
ODD = ["", " ", "   ", "  a  b ", "\ta\n", "▁▁ a▁ b", "▁", "ÅÄ ﬁ Σας ΟΔΟΣ İ", "<s> </s> <unk> <0x41>", "it's '' 12½", "\x1c\x1d \x85 \xa0é", "\x00a\x00", "😀😀 漢字かな", "aaaaaaaaaaaaa", "ababababab"]


def _texts(ids, ends):
    data, stops = MODEL.decode(ids, ends)
    data = data.tobytes()
    return [data[a:b].decode() for a, b in zip(stops[:-1], stops[1:], strict=True)]


def _check(texts, encoder=ENCODER):
    ids, ends = encoder(texts)
    want = [[*LIBRARY.encode(t), 2] for t in texts]
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == want
    assert _texts(ids, ends) == [LIBRARY.decode(x) for x in want]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \t\nabtheing▁é.'1"), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=4))
def test_any_text(texts):
    _check(texts)


def test_every_piece_and_odd_texts():
    _check([LIBRARY.id_to_piece(i) for i in range(LIBRARY.vocab_size())])
    _check(ODD + [t or "" for _, t in ROWS])


def test_a_merge_that_makes_a_better_pair():
    """Texts of repeated pieces that are parts of pieces with better ranks, beside the symbols that complete those."""
    early = [i for i in range(MODEL.size) if MODEL.early[i]]
    assert early
    texts = []
    for i in early:
        p = LIBRARY.id_to_piece(i).strip("▁")
        whole = next((q for q in map(LIBRARY.id_to_piece, range(MODEL.size)) if p and p in q and q != p and LIBRARY.get_score(LIBRARY.piece_to_id(q)) >= LIBRARY.get_score(i)), p).strip("▁")
        texts += [p * 4, whole * 3, p + whole + p + p, whole + p * 3 + whole]
    _check(texts)


def test_long_words():
    _check(["the quick brown fox jumps over the lazy dog" * 5, "thequickbrownfox" * 200, "=" * 5001, "ab" * 4001])


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(sentencepiece_rounds, "CACHE_SIZE", 3)
    own = Encoder(MODEL)
    for text in ("a b c d e", "f", "g a", "x" * 100 + " y"):
        _check([text], own)
        assert len(own.known) <= 3


def test_documents(spark):
    rows = ROWS + [(100 + i, t) for i, t in enumerate(ODD)] + [(200, "long text without end " * 250_000)]
    got = sorted(((r.doc_id, r.n_tokens, hashlib.sha256(str(r.ids).encode()).hexdigest(), r.decoded) for r in encode_pieces(documents(spark, rows), PIECES).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = [*LIBRARY.encode(t or ""), 2]
        want.append((i, len(ids), hashlib.sha256(str(ids).encode()).hexdigest(), LIBRARY.decode(ids)))
    assert got == sorted(want, key=repr)
    assert encode_pieces(documents(spark, []), PIECES).collect() == []
