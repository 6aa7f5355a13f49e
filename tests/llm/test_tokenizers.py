import os
import random
import struct
import tempfile

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kithline.llm import bpe_lexicon, token_counts
from tests.llm.common import ROWS, documents, rows_of

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  a  b ", "\ta\n", "▁▁ a▁ b", "ÅÄ ﬁ Σας ΟΔΟΣ İ", "<|startoftext|>Hi <|endoftext|>", "<s> </s> <unk>", "it's we'll '' 12½", "\x1c\x1d \x85 \xa0é", "\x00a\x00", "😀😀"]


def _model():
    with open(PIECES, "rb") as f:
        return f.read()


_LENGTHS = token_counts.Lengths(_model(), {})
_LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\nabc▁é.'1"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_counts_of_any_text(text):
    assert _LENGTHS.count(text) == len(_LIBRARY.encode(text))


def test_counts(spark):
    rows = ROWS + [(100 + i, t) for i, t in enumerate(ODD)]
    want = sorted(((i, len((t or "").encode()), n := len(_LIBRARY.encode(t or "")), n > 4096) for i, t in rows), key=repr)
    assert rows_of(token_counts.token_counts(documents(spark, rows), PIECES), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(documents(spark, []), PIECES).collect() == []


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_SIZE", 3)
    own = token_counts.Lengths(_model(), {"the": 1})
    for w in "a b c d e f g".split():
        own[w]
    assert len(own) <= 4 + 1 and own["the"] == 1


def _library():
    t = Tokenizer.from_file(WORDS)
    t.no_padding()
    t.no_truncation()
    return t


with open(WORDS, "rb") as _f:
    _SPEC = _f.read()
def _file(data):
    handle, path = tempfile.mkstemp()
    with os.fdopen(handle, "wb") as f:
        f.write(data)
    return path


_LEXICON = bpe_lexicon.Lexicon(_SPEC, _file(bpe_lexicon.compile_lexicon(_SPEC, ["the", "of", "hello", "it", "'s", "!!", "é"])))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\nabcst'1½é<|>ΣÅ"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_codec_of_any_text(text):
    library = _library()
    ids = library.encode(text, add_special_tokens=False).ids
    assert _LEXICON.encode(text) == (struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False))


def test_codec(spark):
    library = _library()
    rows = ROWS + [(100 + i, t) for i, t in enumerate(ODD)]
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), bytearray(struct.pack(f"<{len(ids)}I", *ids)), library.decode(ids, skip_special_tokens=False)))
    assert rows_of(bpe_lexicon.encode(documents(spark, rows), WORDS), "doc_id", "n_tokens", "ids", "decoded") == sorted(want, key=repr)
    assert bpe_lexicon.encode(documents(spark, []), WORDS).collect() == []


def test_automaton_numbers_words_and_shares_suffixes():
    rng = random.Random(2)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(8))) + rng.choice((b"", b"tion", b"ing")) for _ in range(400)})
    table = bpe_lexicon.build_automaton(words)
    own = bpe_lexicon.Automaton(table)
    assert [own.number(w) for w in words] == list(range(len(words)))
    assert all(own.number(w + b"z") == -1 for w in words)
    states = struct.unpack_from("<i", table)[0]
    assert states < sum(map(len, words)) / 4
    assert bpe_lexicon.Automaton(bpe_lexicon.build_automaton([])).number(b"a") == -1


def test_rules_join_ids_and_labels_are_bytes():
    rng, rules, library = random.Random(7), _LEXICON.rules, _library()
    assert _LEXICON.automaton.labels == bytes(list(_LEXICON.automaton.arrays[2]))
    for _ in range(300):
        word = "".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(1, 90)))
        symbols = [rules.inner[b] for b in word.encode()[:-1]] + [rules.last[word.encode()[-1]]]
        want = library.encode(word, add_special_tokens=False).ids
        assert rules._merge_short(list(symbols)) == rules._merge_long(list(symbols)) == rules.merge(word) == want
