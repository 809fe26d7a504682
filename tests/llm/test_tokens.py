"""Encoding, counts and files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfspark.llm import encode, id_coder, token_counts, token_files
from shelfspark.llm.bpe import Vocabulary
from shelfspark.llm.encode import ids_of_pieces

from .conftest import ODD_TEXTS


@pytest.fixture(scope="module")
def vocabulary(tokenizer):
    return Vocabulary(tokenizer)


@pytest.fixture(scope="module")
def library(tokenizer):
    return Tokenizer.from_file(tokenizer)


def encoded(vocabulary, texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"])
    return [ids[a:b].tolist() for _, ids, bounds in ids_of_pieces(iter([batch]), 0, vocabulary)
            for a, b in zip(bounds, bounds[1:])]


def wanted(library, texts):
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_of_odd_texts(vocabulary, library):
    assert encoded(vocabulary, ODD_TEXTS) == wanted(library, ODD_TEXTS)


def test_ids_of_random_letters(vocabulary, library):
    draw = random.Random(3)
    texts = ["".join(draw.choice("abeinorst hlm'sé.,!1") for _ in range(60)) for _ in range(600)]
    assert encoded(vocabulary, texts) == wanted(library, texts)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"], max_codepoint=0x2FFF), max_size=40))
def test_ids_of_any_text(vocabulary, library, text):
    assert encoded(vocabulary, [text]) == wanted(library, [text])


def test_strings_that_fool_hashes_modulo_powers_of_two(spark, documents, tokenizer, vocabulary, library):
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    texts = [f"{one} and {other}", other, one, f"{other} {one}"]
    want = wanted(library, texts)
    assert encoded(vocabulary, texts) == want
    docs = documents(enumerate(texts))
    counts = token_counts.count_report(docs, tokenizer).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in counts) == [(i, len(x)) for i, x in enumerate(want)]
    files = token_files.file_report(docs, tokenizer).collect()
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in files) == [
        (i, zlib.crc32(np.array([*x, 1], "<u4").tobytes())) for i, x in enumerate(want)]


def test_words_that_share_a_hash_are_told_apart():
    from shelfspark.llm.spans import distinct_spans

    data = np.frombuffer(b"onetwoonesixtwo", np.uint8)
    starts = np.arange(0, 15, 3)
    codes, first = distinct_spans(data, starts, starts + 3, np.zeros(5, np.uint64))
    words = [data[s:s + 3].tobytes() for s in starts[first]]
    assert [words[c] for c in codes] == [b"one", b"two", b"one", b"six", b"two"]
    assert len(words) == 3


def test_long_words_are_counted(vocabulary):
    counter = token_counts.PrefixCounter(vocabulary)
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdefinrst") for _ in range(n)).encode() for n in (511, 512, 513, 3000)]
    words += [b"x" * 2000, b"ab" * 900, b"a"]
    assert counter.wholes(words) == [len(vocabulary.merged(w)) for w in words]


def test_compatible_pairs_are_those_that_stay_apart(vocabulary):
    draw = np.random.default_rng(1)
    inner = sorted(vocabulary.inner.items(), key=lambda x: x[1])
    first = [inner[k] for k in draw.integers(0, len(inner), 1500)]
    second = [inner[k] for k in draw.integers(0, len(inner), 1500)]
    told = vocabulary.compatible(np.array([i for _, i in first]), np.array([i for _, i in second]))
    for (a, i), (b, j), apart in zip(first, second, told):
        assert apart == (vocabulary.merged(a + b, False) == [i, j])


def test_prefix_table_is_exact_everywhere(vocabulary):
    counter = token_counts.PrefixCounter(vocabulary)
    for word in (b"international", b"thingsheredon", b"aaaaaaaaaaa", "éanouvique".encode()):
        open_, closed = counter.table(word, False), counter.table(word)
        for n in range(1, len(word) + 1):
            assert open_[n] == len(vocabulary.merged(word[:n], False))
        assert closed[-1] == len(vocabulary.merged(word))


def test_count_report(spark, odd, tokenizer, library):
    found = token_counts.count_report(odd, tokenizer, limit=20).collect()
    texts = [r["text"] for r in odd.collect()]
    assert len(found) == len(texts)
    counts = sorted((len((t or "").encode()), len(i), len(i) > 20) for t, i in zip(texts, wanted(library, texts)))
    assert sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found) == counts
    assert all(r["fit_tokens"] <= 20 and (r["fit_tokens"] == r["n_tokens"]) == (r["n_tokens"] <= 20)
               for r in found)


def test_prefix_counts_answer_budgets(spark, documents, tokenizer, library):
    docs = documents([(1, "the internationalisation of thingsheredon is done"), (2, None)])
    rows = token_counts.with_prefix_counts(docs, tokenizer)
    table = {r["doc_id"]: r["prefix_tokens"] for r in rows.collect()}
    words = "the internationalisation of thingsheredon is done".split()
    assert table[1] == [len(library.encode(" ".join(words[:n]), add_special_tokens=False).ids)
                        for n in range(len(words) + 1)]
    assert table[2] == [0]
    within = rows.select(token_counts.words_within("prefix_tokens", table[1][3]).alias("n"))
    assert sorted(r["n"] for r in within.collect()) == [0, 3]


def test_code_report_and_decoding(spark, odd, tokenizer, library):
    texts = [r["text"] for r in odd.collect()]
    ids = wanted(library, texts)
    want = sorted((len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(),
                   hashlib.sha256(library.decode(i, skip_special_tokens=False).encode()).hexdigest())
                  for i in ids)
    found = encode.code_report(odd, tokenizer).collect()
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == want
    back = encode.decode(encode.encode(odd, tokenizer, ids="codes"), tokenizer, "codes").collect()
    assert sorted(r["decoded"] for r in back) == sorted(
        library.decode(i, skip_special_tokens=False) for i in ids)
    assert {r["hits"] for r in back} == {"mine"}


def test_empty_tables(spark, documents, tokenizer):
    none = documents([])
    assert encode.code_report(none, tokenizer).count() == 0
    assert token_counts.count_report(none, tokenizer).count() == 0
    assert token_files.file_report(none, tokenizer).count() == 0


@pytest.mark.parametrize("size", [1, 2, 63, 900])
def test_coder_round_trip(size):
    draw = np.random.default_rng(size)
    blocks = [draw.integers(0, 49_408, size).astype(np.uint16), np.full(size, 7, np.uint16),
              np.arange(size, dtype=np.uint16), (draw.zipf(1.4, size) % 65_536).astype(np.uint16),
              np.tile(np.array([5, 65_535, 0], np.uint16), size)[:size], draw.integers(0, 9, 1).astype(np.uint16)]
    payloads = id_coder.encode_blocks(blocks)
    back = id_coder.decode_blocks(payloads, [len(b) for b in blocks])
    assert all((a == b).all() for a, b in zip(blocks, back))
    # A block is decoded without the others.
    assert (id_coder.decode_blocks(payloads[3:4], [size])[0] == blocks[3]).all()
    assert id_coder.encode_blocks(blocks[3:4]) == payloads[3:4]


@pytest.mark.parametrize("size", [1023, 1024, 1025, 5000, id_coder.BLOCK_IDS])
def test_coder_round_trip_of_several_lanes(size):
    draw = np.random.default_rng(size)
    blocks = [np.zeros(size, np.uint16), np.full(size, 65_535, np.uint16),
              draw.permutation(65_536)[:size].astype(np.uint16),
              (draw.zipf(1.3, size) % 65_536).astype(np.uint16), np.array([3], np.uint16)]
    payloads = id_coder.encode_blocks(blocks)
    back = id_coder.decode_blocks(payloads, [len(b) for b in blocks])
    assert all((a == b).all() for a, b in zip(blocks, back))
    assert [id_coder.encode_blocks([b])[0] for b in blocks] == payloads


def test_lanes_of_a_block_advance_together(monkeypatch):
    """A full block took a step for each of its ids before."""
    widths = []
    ask = id_coder.Model.ask
    monkeypatch.setattr(id_coder.Model, "ask", lambda self, n: (widths.append(n), ask(self, n))[1])
    block = (np.random.default_rng(5).zipf(1.3, id_coder.BLOCK_IDS) % 65_536).astype(np.uint16)
    payloads = id_coder.encode_blocks([block])
    assert len(widths) == id_coder.LANE_IDS <= len(block) // 16 and sum(widths) == len(block)
    assert (id_coder.decode_blocks(payloads, [len(block)])[0] == block).all()


def test_words_are_encoded_once_for_all_pieces(tokenizer, library, monkeypatch):
    with open(tokenizer, encoding="utf-8") as file:
        words = token_files.library_words(file.read())
    with open(tokenizer, encoding="utf-8") as file:
        assert token_files.library_words(file.read()) is words
    asked = []
    encode_words = words.encode
    monkeypatch.setattr(words, "encode", lambda new: (asked.extend(new), encode_words(new))[1])
    texts = ["once told wordstold", "told again, \U0001f600\U00010400x once <|endoftext|> don't ''s", "told once"]
    for _ in range(2):
        for text in texts:
            batch = pa.RecordBatch.from_arrays([pa.array([text])], ["t"])
            (_, ids, _), = ids_of_pieces(iter([batch]), 0, words=words)
            assert ids.tolist() == wanted(library, [text])[0]
    assert len(asked) == len(set(asked))


def test_words_are_forgotten_when_there_are_too_many(tokenizer, library, vocabulary, monkeypatch):
    from shelfspark.llm import bpe

    monkeypatch.setattr(bpe, "WORD_IDS", 3)
    words = bpe.WordIds(vocabulary.special, vocabulary.encode_words)
    texts = ["one two three four", "two five", "one five six", ""]
    batches = [pa.RecordBatch.from_arrays([pa.array([t])], ["t"]) for t in texts]
    found = [ids.tolist() for _, ids, _ in ids_of_pieces(iter(batches), 0, words=words)]
    assert found == wanted(library, texts)


@pytest.mark.parametrize("odd", [*ODD_TEXTS, "\U00010400\U00010401 ab\U0001d7d81", "é\U0001f468\u200d\U0001f469x"])
def test_library_words_give_the_ids_of_whole_texts(tokenizer, library, odd):
    with open(tokenizer, encoding="utf-8") as file:
        words = token_files.library_words(file.read())
    batch = pa.RecordBatch.from_arrays([pa.array([odd], pa.string())], ["t"])
    (_, ids, _), = ids_of_pieces(iter([batch]), 0, words=words)
    assert ids.tolist() == wanted(library, [odd])[0]


def test_predictable_ids_take_little_room():
    block = np.tile(np.arange(50, dtype=np.uint16) * 900, 40)
    assert len(id_coder.encode_blocks([block])[0]) < len(block) // 4


def test_no_blocks():
    assert id_coder.encode_blocks([]) == [] and id_coder.decode_blocks([], []) == []


def test_files_hold_the_corpus_in_order(spark, odd, tokenizer, library, monkeypatch):
    rows = odd.collect()
    # As the files order them: no id first, then by id; equal ids by text, which here agree.
    rows.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    found = {}
    for r in token_files.file_report(odd, tokenizer).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"], r["ids_crc32"]))
    start = 0
    for r, ids in zip(rows, wanted(library, [r["text"] for r in rows])):
        ids = [*ids, 1]
        entry = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        if r["doc_id"] is not None:
            assert entry in found[r["doc_id"]]
        start += len(ids)
    assert sum(map(len, found.values())) == len(rows)


def test_files_return_the_ids(spark, documents, tokenizer, library, tmp_path):
    texts = {3: "the end", 1: "a start", 2: " ".join(["many words here"] * 9000)}
    path = f"file://{tmp_path}/ids"
    token_files.write_ids(documents(texts.items()), tokenizer, path)
    assert spark.read.parquet(path).where("parts > 1").count() > 1
    for r in token_files.read_ids(spark, path).collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == [*library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1]


def test_damage_is_noticed(spark, documents, tokenizer, tmp_path):
    path = f"file://{tmp_path}/ids"
    token_files.write_ids(documents([(1, "some words in a row")]), tokenizer, path)
    from pyspark.sql import functions as F
    spark.read.parquet(path).withColumn("crc", F.col("crc") + 1).write.parquet(f"{path}-bad")
    with pytest.raises(Exception, match="damaged block"):
        token_files.read_ids(spark, f"{path}-bad").collect()
