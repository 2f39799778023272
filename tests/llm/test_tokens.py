import random

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from rastermill.llm import token_counts, transducer, words

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "  a  b ", "a\nb", "\n\n a", "\t\x00a\xa0b▁c", "<s> </s> <unk> <0x0A>", "The tile's band isn't we'll I'm they've",
    "ÀÉÎ straße İstanbul ǅ ﬁ", "é Å ΑΣ ΣΑΣ 漢字かな 한글 \U0001f600\U0001f3fd", "x<|endoftext|>y <|startoftext|> <|end", "a1b22 ½² $$--!!",
    "　wide line\x85next\x1cfs", "word" * 5000, "1" * 3000, "a ́b", "ﬁ ǅ ẞ ẞ", "Å", "{\"id\": \"S2A_31UFS\"}\r\n",
]


def odd_texts(n=400):
    r = random.Random(4)
    pool = "aAbBéÉ ßİıΣς漢1２½'’\"-_.<|>\n\t\xa0▁́​\U0001f600endoftext  "
    return ["".join(r.choices(pool, k=r.randint(0, 40))) for _ in range(n)]


def test_token_counts(items, prose):
    texts = TEXTS + odd_texts() + [prose(1, 800), prose(1, 800), prose(2, 5000)]
    rows = [*enumerate(texts), (3, TEXTS[3]), (3, TEXTS[3]), (None, "a tile")]
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    expected = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 1000) for i, t in rows]
    for frequent in (0, 50, token_counts.FREQUENT):
        got = token_counts.count_tokens(items(rows, "json"), PIECES, limit=1000, frequent=frequent).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_pre_tokens_hold_every_character():
    for text in TEXTS[1:] + odd_texts():
        assert "".join(token_counts.pre_tokens(text)) == (("▁" + text.replace(" ", "▁")) if text else "")


def test_encoding_and_decoding(items, prose):
    texts = TEXTS + odd_texts() + [prose(1, 800), prose(2, 5000)]
    rows = [*enumerate(texts), (3, TEXTS[3]), (None, "a tile")]
    library = tokenizers.Tokenizer.from_file(WORDS)
    coded = [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    expected = [(i, ids, library.decode(ids, skip_special_tokens=False)) for (i, _), ids in zip(rows, coded)]
    for block in (None, transducer.compile_lexicon([], None), transducer.compile_lexicon(["band", "tile"], transducer.Vocabulary(WORDS).encode)):
        got = transducer.decode(transducer.encode(items(rows, "json"), WORDS, block=block), WORDS).collect()
        assert sorted(((r.id, list(r.ids), r.decoded) for r in got), key=repr) == sorted(expected, key=repr)
    at_once = transducer.encode(items(rows, "json"), WORDS, decoded="text").collect()
    assert sorted(((r.id, list(r.ids), r.text) for r in at_once), key=repr) == sorted(expected, key=repr)


def test_empty_tables(items):
    assert token_counts.count_tokens(items([], "json"), PIECES).collect() == []
    assert transducer.decode(transducer.encode(items([], "json"), WORDS), WORDS).collect() == []


def test_lexicon_is_minimal_and_exact():
    listed = ["band", "bands", "land", "lands", "sand", "tile", "tiles", "é", "a"]
    ids = {w: [k, k + 1][: 1 + k % 2] for k, w in enumerate(listed)}
    lexicon = transducer.Lexicon(transducer.compile_lexicon(listed, ids.__getitem__))
    asked = [*listed, "ban", "bandsx", "", "x", "è"]
    rows = lexicon.find([w.encode() for w in asked])
    found = [lexicon.ids[lexicon.starts[r] : lexicon.starts[r + 1]].tolist() if r >= 0 else None for r in rows]
    assert found == [ids.get(w) for w in asked]
    # right languages decide minimality: one state for each set of possible endings
    prefixes = {w.encode()[:k] for w in listed for k in range(len(w.encode()) + 1)}
    endings = {frozenset(w.encode()[len(p) :] for w in listed if w.encode().startswith(p)) for p in prefixes}
    assert len(lexicon.final) == len(endings)


@pytest.mark.parametrize("held", [5, 200_000])
def test_frequent_words(spark, held, monkeypatch):
    monkeypatch.setattr(words, "HELD", held)
    texts = [("b a b a a a",), ("b b a c d e f g h " + "long" * 20 + " " + "long" * 20,), (None,), ("c c",)]
    frame = spark.createDataFrame(texts, "t string").coalesce(1)
    found = lambda most: set(words.frequent_words(frame, "t", lambda: str.split, most))
    assert found(10) >= {"a", "b"} and found(1) == {"a"} and found(0) == set()


def test_words_of_any_length_merge_as_the_library_does():
    """Short words go pair by pair, long ones through a heap; both take the lowest rank, then the leftmost pair."""
    r = random.Random(8)
    library, vocabulary = tokenizers.Tokenizer.from_file(WORDS), transducer.Vocabulary(WORDS)
    sizes = [*range(1, 12), transducer.SHORT - 1, transducer.SHORT, transducer.SHORT + 1, 80]
    asked = ["".join(r.choices(letters, k=n)) for letters in ("aab", "etaoinshr", "éüßa") for n in sizes for _ in range(20)]
    assert [vocabulary.encode(w) for w in asked] == [library.encode(w, add_special_tokens=False).ids for w in asked]
    encoder = transducer._Encoder(WORDS, transducer.compile_lexicon(asked[::2], vocabulary.encode))
    assert encoder([" ".join(asked), "", asked[1]]).to_pylist() == [library.encode(t, add_special_tokens=False).ids for t in (" ".join(asked), "", asked[1])]
