"""Files of token ids: round trips against the tokenizer's own ids of whole texts."""

import random
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliant.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000])
@pytest.mark.parametrize("kind", ["<u2", "<u4"])
@pytest.mark.parametrize("bits", [True, False])
def test_planes(n, kind, bits):
    ids = np.random.default_rng(n).integers(0, 60_000, n).astype(kind)
    planes = tf.to_planes(ids, bits)
    assert (tf.from_planes(planes, n, ids.itemsize, bits) == ids).all()
    if bits:
        assert planes == [np.packbits((ids >> i) & 1, bitorder="little").tobytes() for i in range(8 * ids.itemsize)]


WORDS = ["a", "The", "it's", "ÄRGER", "é", "Σας", "ΟΔΟΣ", "́", "<|endoftext|>", "x<|startoftext|>y", "...", "12a3", "\x1c", " ", " ", "語", "🙂", "\x00", "'s", "İ", "n'T", "\x85", "word.", "Word,", "w.,", "é.", "1.", "<|ENDOFTEXT|>", "a<|endoftext|>."]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from(["", " ", "\n", "\t \r", "  "])), max_size=12), st.text(max_size=20))
def test_words_alone_give_the_ids_of_whole_texts(parts, rest):
    text = "".join(w + s for w, s in parts) + rest
    got = tf.Encoder(PATH, 2)(text.encode())
    assert np.frombuffer(got, "<u2").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


TOKENIZER = Tokenizer.from_file(PATH)


def test_long_words_and_forgotten_ones(monkeypatch):
    monkeypatch.setattr(tf, "WORDS_KEPT", 5)
    monkeypatch.setattr(tf, "PIECE_BYTES", 50)
    encoder = tf.Encoder(PATH, 4)
    rng = random.Random(2)
    for _ in range(30):
        text = " ".join("".join(rng.choice("abcé.") for _ in range(rng.choice([1, 3, 90]))) for _ in range(rng.randrange(40)))
        assert np.frombuffer(encoder(text.encode()), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
    assert b"".join(tf.pieces(text.encode(), 7)) == text.encode()


@pytest.mark.parametrize("bits", [True, False])
def test_files(spark, bits):
    rng = random.Random(3)
    texts = [None, "", " \n", "One two", "x" * 3000, " ".join(rng.choice(WORDS) for _ in range(20_000))]
    rows = [(i if i % 5 else None, rng.choice(texts[:4]) if i % 3 else f"t {i}", "x", 1) for i in range(200)] + [(7, "same" * 20, "x", 1)] * 90 + [(300 + i, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, n long").repartition(3)
    files = tf.write_ids(docs, PATH, 1, bits=bits, block=64, file_bytes=1200)
    listed = files.collect()
    assert len(listed) > 3 and sum(r["n_docs"] for r in listed) == len(rows)
    assert sum(r["n_docs"] > 120 for r in listed) == 0, "the group of equal rows must be split"
    got = tf.read_ids(files, docs.schema["doc_id"].dataType).orderBy("start").collect()
    at, keys = 0, [(r["id"] is None, r["id"] or 0) for r in got]
    assert keys == sorted(keys)
    want = {}
    for i, t, *_ in rows:
        ids = [*plain(t), 1]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    have = {}
    for r in got:
        assert (r["start"], r["ids_ok"]) == (at, True)
        at += r["n_tokens"]
        have.setdefault(r["id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    long = max(listed, key=lambda r: r["n_ids"])
    file = tf.IdFile(long["file"])
    whole = np.concatenate([file.block(i) for i in range(len(file.chunks))])
    for lo, hi in ((0, 5), (60, 70), (63, 64), (64, 128), (130, 130), (0, len(whole))):
        assert np.concatenate([np.zeros(0, int), *file.read(lo, hi)]).tolist() == whole[lo:hi].tolist()


def test_text_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "two"), ("ä", "one"), (None, "x"), ("a", None)], "doc_id string, text string")
    got = tf.read_ids(tf.write_ids(docs, PATH, 1), "string").orderBy("start").collect()
    assert [r["id"] for r in got] == ["a", "b", "ä", None]
    assert tf.read_ids(tf.write_ids(docs.limit(0), PATH, 1), "string").count() == 0


def bert():
    """A tokenizer of another kind: marks alone, no ends of words, special tokens in brackets, `_` within words."""
    from tokenizers import Regex, models, normalizers, pre_tokenizers

    letters = [chr(i) for i in range(33, 256) if chr(i).isprintable()]
    vocab = {t: i for i, t in enumerate(["[UNK]", "[MASK]", *letters, *("##" + c for c in letters), "foo", "##oo"])}
    out = Tokenizer(models.WordPiece(vocab, unk_token="[UNK]"))
    out.normalizer = normalizers.Lowercase()
    out.pre_tokenizer = pre_tokenizers.Split(Regex(r"\w+|[^\w\s]"), "removed", invert=True)
    out.add_special_tokens(["[MASK]", "[UNK]"])
    return out


MARKED = ["a", "Foo", "É", "ñ", "ß", "7", "12", "'", "'s", "'ll", "'LL", "n't", "_", ".", ",%%%", "=", "≠", "̸", "́", "×", "-", '"', "(", "[MASK]", "[mask]", "|>", "<|", "<|endoftext|>", "<|EndOfText|>", "\xa0", "\x1c", "語", "ﬁ", "İ", "ִי", "²"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(MARKED + [" ", "\n"]), max_size=14).map("".join), max_size=5))
def test_words_cut_at_marks_give_the_ids_of_whole_texts(texts):
    for path, whole in ((PATH, TOKENIZER), (OTHER, Tokenizer.from_file(OTHER))):
        got = ENCODERS[path].many([t.encode() for t in texts])
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


OTHER = f"{tempfile.mkdtemp()}/bert.json"
bert().save(OTHER)
ENCODERS = {path: tf.Encoder(path, 2) for path in (PATH, OTHER)}


def test_a_worker_encodes_a_word_once_whatever_marks_are_beside_it(monkeypatch):
    tf._encoder.cache_clear()
    asked = []

    class Counting:
        def __init__(self, real):
            self.real = real

        def __getattr__(self, name):
            return getattr(self.real, name)

        def encode_batch_fast(self, texts, **how):
            asked.append([w for t in texts for w in t.split()])
            return self.real.encode_batch_fast(texts, **how)

    real = tf._tokenizer
    monkeypatch.setattr(tf, "_tokenizer", lambda path: Counting(real(path)))
    words = [a + b + c for a in "klmno" for b in "aeiou" for c in "prst"]
    texts = [" ".join(left + w + right for w in words).encode() for left in ("", '"', "(") for right in ("", ".", ",%%%", '")', "&&&")]
    for text in texts:
        assert np.frombuffer(tf._encoder(PATH, 2, "a job").many([text])[0], "<u2").tolist() == TOKENIZER.encode(text.decode(), add_special_tokens=False).ids
    assert tf._encoder(PATH, 2, "a job") is not tf._encoder(PATH, 2, "the next")
    assert sorted(w for ws in asked for w in ws if w.isalpha()) == sorted(words)
    assert len(asked[0]) == len(words), "new words are encoded in one text"
    tf._encoder.cache_clear()
