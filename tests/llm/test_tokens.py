import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimlens.llm import bpe, counts, packing as K, pieces as S

MODEL, BYTES = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
ODD = ["", " ", "  a   b ", "▁x ▁", "<s> </s> <unk> <0x0A>", "\n\n\t a", "日本語 한국어 😀😀 x", "aaaaaaaaaaaa aaaa aaa aa"]
ODD += ["            deep", "é \x00 \x1c a", "� x", "x<|endoftext|> y", "it's  'll we'll", "word,» next", "don't.stop"]


def _texts(n):
    rng = random.Random(1)
    letters = "ab eéñ日😀▁ \n<0x>tionhers,.'1#"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_pieces_equal_the_library():
    ours, library = S.load(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in _texts(3000):
        ids = library.encode(text, add_eos=True)
        assert ours.encode(text) == ids
        assert ours.decode(ids) == library.decode(ids)


def test_no_long_word_is_kept():
    ours, library = S.Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in ("two  spaces " * 20_000, "long" * 30_000, "a " + "🦊" * 5_000, "short words only"):
        assert ours.encode(text) == library.encode(text, add_eos=True)
    kept = [k for table in (ours._words, ours._chunks) for part in (table.new, table.old) for k in part]
    assert kept and max(map(len, kept)) <= S.KEPT_LENGTH


def test_piece_tables(spark):
    rows = [(1, None), (2, ""), (3, "the  cat"), (3, "the  cat")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("ids", F.lit("clash"))
    tokens = S.token_ids(docs, MODEL)
    assert sorted((r.doc_id, len(r.ids)) for r in tokens.collect())[:2] == [(1, 1), (2, 1)]
    assert sorted(tuple(r) for r in S.decode_ids(tokens, MODEL).collect()) == [(1, ""), (2, ""), (3, "the  cat"), (3, "the  cat")]
    digests = S.encode_documents(docs, MODEL).collect()
    assert len({r.ids_sha256 for r in digests}) == 2 and len(digests) == 4
    assert S.encode_documents(docs.limit(0), MODEL).collect() == []


def _same_ids(texts):
    found = bpe.load(BYTES).tokens(pa.array(texts, pa.string()))
    ids, ptr = found.flat()
    want = [e.ids for e in Tokenizer.from_file(BYTES).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(ptr, ptr[1:])] == want
    assert found.counts().tolist() == [len(w) for w in want]


def test_merged_arrays_equal_the_library():
    _same_ids(_texts(3000))
    _same_ids([])
    _same_ids(["", None, ""])
    # The last character of a text and the first of the next do not touch.
    _same_ids(["it'", "s", "a ", " b", "<|endof", "text|>", "\n", "\n x", "'", "'s't"])


def test_white_space_marks_and_special_strings():
    rng = random.Random(4)
    some = ["a", "'", "'s", "'ll", "'RE", " ", "  ", "\n", "\t ", "1", "２", "²", "é", "中", "!", "<|endoftext|>", "\x85", "\xa0", "\u2028", "\u200b"]
    _same_ids(["".join(rng.choices(some, k=rng.randint(0, 12))) for _ in range(6000)])


def test_characters_newer_than_this_python():
    new = [chr(c) for c in (0x1C89, 0xA7CB, 0x10D40, 0x10D4A, 0x1FAE9, 0x378, 0xE0080)]
    _same_ids([f"{a}{b} {a}" for a in ["a", "1", "!", *new] for b in new])


def test_every_character_is_cut_as_the_library_does():
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    model = bpe.load(BYTES)
    for at in range(0, len(chars), 20_000):
        line = "".join(f"a{c}1{c}!\n" for c in chars[at : at + 20_000])
        starts, _ = model.pre_tokens(np.frombuffer(line.encode(), np.uint8), np.array([0, len(line.encode())]))
        spans = [span[0] for _, span in model.pre_tokenizer.pre_tokenize_str(line)]
        places = np.cumsum([0] + [len(c.encode()) for c in line])
        assert starts.tolist() == places[spans].tolist()


@pytest.mark.parametrize("long", [8, bpe.LONG])
def test_long_words(monkeypatch, long):
    monkeypatch.setattr(bpe, "LONG", long)
    rng = random.Random(5)
    words = ["a" * 5_001, " " * 3_000 + "x", "".join(rng.choices("abcdefghi", k=6_000)), "=" * 4_097, "é" * 2_000]
    _same_ids([*words, " ".join(words), *_texts(300)])


def test_equal_ranges_share_a_number():
    rng = random.Random(6)
    parts = [bytes(rng.choices([0, 1, 255], k=rng.randint(1, 20))) for _ in range(4000)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts])
    number, first = bpe.distinct_ranges(data, np.cumsum(size) - size, size)
    assert len(set(parts)) == len(first) and all(parts[first[n]] == p for n, p in zip(number, parts))


def test_token_counts(spark):
    long = "many words here " * 40_000
    rows = [(1, None, "x"), (2, "", "x"), (3, "it's a<|endoftext|>é", "x"), (3, "it's a<|endoftext|>é", "x"), (None, long, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in counts.token_counts(docs, BYTES).collect()))
    n = len(Tokenizer.from_file(BYTES).encode(long, add_special_tokens=False).ids)
    assert got == [(0, len(long), n, True), (1, 0, 0, False), (2, 0, 0, False), (3, 21, 5, False), (3, 21, 5, False)]
    at_limit = counts.token_counts(docs, BYTES, limit=5).where("doc_id = 3").collect()
    assert [r.over_limit for r in at_limit] == [False, False]
    assert counts.token_counts(docs.limit(0), BYTES).collect() == []
    assert [f.dataType.simpleString() for f in counts.token_counts(docs, BYTES).schema] == ["bigint", "bigint", "bigint", "boolean"]


def test_token_counts_of_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    library = Tokenizer.from_file(BYTES)
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in counts.token_counts(docs, BYTES).collect()} == want


@pytest.mark.parametrize("capacity,smallest", [(1024, 64), (32, 4)])
def test_packing_is_whole_and_gapless(spark, capacity, smallest):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "be", "gamma,", "x\n"]) for _ in range(rng.randint(0, 900)))) for i in range(60)]
    rows += [(60, None), (61, ""), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(2)
    got = K.pack(docs, BYTES, capacity=capacity, smallest_cut=smallest).toPandas()
    library = Tokenizer.from_file(BYTES)
    for doc, text in rows[1:-1]:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        mine = got[got.doc_id == doc].sort_values("start")
        assert [i for piece in mine.ids for i in piece] == ids
        assert mine.start.tolist() == np.cumsum([0, *mine.length])[:-1].tolist()
        assert (mine.doc_tokens == len(ids)).all()
        assert mine.ids_crc32.tolist() == [zlib.crc32(np.array(p, dtype="<u4").tobytes()) for p in mine.ids]
    for _, sequence in got.sort_values("offset").groupby("sequence_id"):
        assert sequence.offset.tolist() == np.cumsum([0, *sequence.length])[:-1].tolist()
        assert sequence.length.sum() <= capacity
    assert K.pack(docs.limit(0), BYTES).collect() == []
    # Two bins that are not full may be left by each of two workers.
    size = got.groupby("sequence_id").length.sum()
    assert (capacity - size).clip(lower=0).sum() <= 0.06 * size.sum() + 4 * capacity
