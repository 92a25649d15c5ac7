"""Trainer and encoder against the public tokenizers package, and shapes."""

from __future__ import annotations

import dataclasses
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import tokens as T
from corpusmill.operators import bpe, encode
from corpusmill.operators import vocab as W
from corpusmill.sources import corpus as C
from corpusmill.sources import views as V

tokenizers = pytest.importorskip("tokenizers")

CODE = [
    "module top(input clk, output reg [7:0] out); always @(posedge clk) out <= out + 1; endmodule",
    "assign out = a & b; assign out2 = aaaa & bbb;", "wire café, naïve_1; assign café = 4'b01;",
    "", "aaa aaaa aaaaa abab ababab",
]


@pytest.fixture(scope="module")
def docs(corpus_of):
    return corpus_of({f"{i}.v": text for i, text in enumerate(CODE)})


@pytest.fixture(scope="module")
def prose(spark, sf_dir):
    return V.corpus(spark, sf_dir)


def public_bpe(texts, profile, size):
    tool = tokenizers.Tokenizer(tokenizers.models.BPE(unk_token=profile.unknown))
    tool.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    trainer = tokenizers.trainers.BpeTrainer(
        special_tokens=list(profile.specials), vocab_size=size, show_progress=False,
        min_frequency=profile.min_frequency,
    )
    tool.train_from_iterator(texts, trainer=trainer)
    return tool


def test_pre_tokens_equal_the_public_splitter(texts):
    public = tokenizers.pre_tokenizers.Whitespace()
    expected = [[word for word, _ in public.pre_tokenize_str(text)] for text in CODE]
    assert texts(T.pre_tokens, CODE) == expected


@pytest.mark.parametrize("name", ["mistral", "llama"])
def test_training_equals_the_public_trainer(prose, name):
    profile = bpe.PROFILES[name]
    ours = bpe.train(W.pre_token_counts(prose), profile, 220)
    texts = [row["content"] for row in prose.select("content").collect()]
    theirs = public_bpe(texts, profile, 220)
    assert ours.ids == theirs.get_vocab()
    merges = json.loads(theirs.to_str())["model"]["merges"]
    assert ours.merges == [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    encoded = {r["doc_id"]: r["input_ids"] for r in encode.encode_corpus(prose, ours).collect()}
    for row in prose.select("doc_id", "content").collect():
        assert encoded[row["doc_id"]] == theirs.encode(row["content"]).ids


def test_one_merge_per_round_gives_the_same_merges(docs):
    counts = W.pre_token_counts(docs)
    several = bpe.train(counts, bpe.PROFILES["gpt2"], 120)
    single = bpe.train(counts, bpe.PROFILES["gpt2"], 120, pairs_per_round=1)
    assert several.merges == single.merges and several.ids == single.ids


def one_merge_at_a_time(counts, profile, size, ids):
    """Byte-pair training by the definition; ``ids`` holds the first symbols."""
    def spelled(word):
        last = len(word) - 1
        return [("" if i == 0 else profile.prefix) + c + (profile.suffix if i == last else "") for i, c in enumerate(word)]

    words = [([ids[t] for t in spelled(w)], n) for w, n in counts]
    ids, merges = dict(ids), []
    names = list(ids)
    while len(ids) < size:
        pairs = {}
        for symbols, n in words:
            for pair in zip(symbols, symbols[1:], strict=False):
                pairs[pair] = pairs.get(pair, 0) + n
        pairs = {p: n for p, n in pairs.items() if n >= max(1, profile.min_frequency)}
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        token = names[best[0]] + names[best[1]].removeprefix(profile.prefix)
        if token not in ids:
            ids[token] = len(names)
            names.append(token)
        merges.append((names[best[0]], names[best[1]]))
        for symbols, _ in words:
            i = 0
            while i < len(symbols) - 1:
                if (symbols[i], symbols[i + 1]) == best:
                    symbols[i : i + 2] = [ids[token]]
                i += 1
    return ids, merges


@pytest.mark.parametrize("name", ["gpt2", "bert"])
def test_rounds_of_both_kinds_equal_one_merge_at_a_time(spark, name, monkeypatch):
    import random

    rng = random.Random(6)
    words = {"aaaa", "aaaaaaa", "abab", "ababababa", "bb", "a"}
    words |= {"".join(rng.choices("aab" if i % 2 else "abcdefg", k=rng.randint(1, 12))) for i in range(120)}
    counts = [(w, rng.choice([1, 1, 2, 3, 10])) for w in sorted(words)]
    table = spark.createDataFrame(counts, "word string, freq long")
    first = bpe.train(table, bpe.PROFILES[name], 1)
    assert not first.merges
    size = len(first.ids) + 45
    ids, merges = one_merge_at_a_time(counts, bpe.PROFILES[name], size, first.ids)
    for seen, places, pairs in ((8192, 10**9, 64), (8192, 0, 64), (8192, 60, 64), (4, 10**9, 64)):
        monkeypatch.setattr(bpe, "PAIRS_SEEN", seen)
        found = bpe.train(table, bpe.PROFILES[name], size, pairs_per_round=pairs, places_per_round=places)
        assert found.merges == merges and found.ids == ids, (seen, places, pairs)
        assert found.rounds < len(merges)


def test_rounds_depend_on_what_words_share_not_on_their_number(spark):
    import random

    rng = random.Random(4)
    parts = ["ing", "ter", "ion", "pre", "con", "ate", "lum", "or", "is"]
    words = {"".join(rng.choices(parts, k=rng.randint(2, 5))) for _ in range(600)}
    counts = [(w, rng.randint(1, 9)) for w in sorted(words)]
    table = spark.createDataFrame(counts, "word string, freq long")
    first = bpe.train(table, bpe.PROFILES["gpt2"], 1)
    size = len(first.ids) + 60
    found = bpe.train(table, bpe.PROFILES["gpt2"], size, places_per_round=150)
    ids, merges = one_merge_at_a_time(counts, bpe.PROFILES["gpt2"], size, first.ids)
    assert found.merges == merges and found.ids == ids
    assert found.rounds <= 7  # 13 when whole words were fetched


@pytest.mark.parametrize("name", ["gpt2", "bert"])
def test_encoding_equals_the_public_encoder(docs, name):
    profile = bpe.PROFILES[name]
    ours = bpe.train(W.pre_token_counts(docs), profile, 130)
    if profile.kind == "wordpiece":
        model = tokenizers.models.WordPiece(ours.ids, unk_token="[UNK]")
    else:
        model = tokenizers.models.BPE(
            ours.ids, ours.merges, unk_token="[UNK]", continuing_subword_prefix=profile.prefix,
            end_of_word_suffix=profile.suffix,
        )
    public = tokenizers.Tokenizer(model)
    public.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    encoded = encode.encode_corpus(docs, ours).orderBy("doc_id").collect()
    assert [row["input_ids"] for row in encoded] == [public.encode(text).ids for text in CODE]


def test_specials_come_first(docs):
    for name, profile in bpe.PROFILES.items():
        ids = bpe.train(W.pre_token_counts(docs), profile, 60).ids
        assert [ids[token] for token in profile.specials] == list(range(len(profile.specials))), name


def test_smoke_string_on_all_profiles(docs, corpus_of):
    line = corpus_of({"s": "assign out = a & b;"})
    for name, profile in bpe.PROFILES.items():
        tokenizer = bpe.train(W.pre_token_counts(docs), profile, 130)
        ids = encode.encode_corpus(line, tokenizer).first()["input_ids"]
        tokens = {i: token for token, i in tokenizer.ids.items()}
        text = "".join(
            tokens[i].removeprefix(profile.prefix).removesuffix(profile.suffix or "\0") for i in ids
        )
        assert text == "assignout=a&b;", name


def test_unknown_characters(docs, corpus_of):
    tokenizer = bpe.train(W.pre_token_counts(docs), bpe.PROFILES["mistral"], 60)
    ids = encode.encode_corpus(corpus_of({"s": "a€"}), tokenizer).first()["input_ids"]
    assert tokenizer.ids["[UNK]"] in ids


def test_round_trip_through_tables(spark, docs, tmp_path):
    tokenizer = bpe.train(W.pre_token_counts(docs), bpe.PROFILES["mistral"], 100)
    C.write_vocab(tokenizer.vocab(spark), tokenizer.merge_table(spark), str(tmp_path))
    vocab, merges = C.read_vocab(spark, str(tmp_path)), C.read_merges(spark, str(tmp_path))
    assert dict(vocab.collect()) == tokenizer.ids
    assert [(r["left"], r["right"]) for r in merges.orderBy("rank").collect()] == tokenizer.merges
    decoded = encode.decode_corpus(encode.encode_corpus(docs, tokenizer), vocab)
    for row in decoded.collect():
        assert row["text"].replace(" ", "") == "".join(CODE[row["doc_id"]].split())


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.integers(2, 50), max_size=600), min_size=5, max_size=10))
def test_padding_and_masks(spark, sequences):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sequences)], "doc_id long, input_ids array<int>")
    for side in ("left", "right"):
        for row in encode.model_inputs(rows, pad_id=1, side=side).collect():
            kept = sequences[row["doc_id"]][:512]
            fill = [1] * (512 - len(kept))
            assert row["input_ids"] == (fill + kept if side == "left" else kept + fill)
            assert row["labels"] == row["input_ids"]
            assert row["attention_mask"] == [int(i != 1) for i in row["input_ids"]]


def test_batch_longest_and_fallback_mask(spark):
    rows = spark.createDataFrame([(0, [5, 6]), (1, [7]), (2, [])], "doc_id long, input_ids array<int>")
    batched = W.longest_in_batch(rows, F.floor(F.col("doc_id") / 2).cast("long"))
    padded = batched.withColumn("ids", T.pad(F.col("input_ids"), F.col("batch_longest"), 1))
    found = padded.select("ids", T.all_ones(F.col("ids"))).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [([5, 6], [1, 1]), ([1, 7], [1, 1]), ([], [])]


def test_next_token_pairs(spark):
    rows = spark.createDataFrame([([1, 2, 3],), ([1],), ([],)], "ids array<int>")
    pairs = [r[0] for r in rows.select(T.next_token_pairs(F.col("ids"))).collect()]
    assert [[tuple(p) for p in row] for row in pairs] == [[(1, 2), (2, 3)], [], []]


def test_evaluation_of_a_full_vocabulary(docs):
    tokenizer = bpe.train(W.pre_token_counts(docs), bpe.PROFILES["gpt2"], 130)
    row = encode.evaluate_tokenizer(docs, tokenizer).first()
    assert (row["vocab_coverage"], row["oov_rate"]) == (1.0, 0.0)
    assert 0 < row["subword_fragmentation"] <= 1


def test_decoding_keeps_every_document_and_id(spark, docs):
    counts = W.pre_token_counts(docs)
    vocab = W.word_vocabulary(counts, ("[UNK]", "[PAD]"), 8)
    tokenizer = encode.word_tokenizer(vocab, ("[UNK]", "[PAD]"), 8)
    decoded = {r["doc_id"]: r["text"] for r in encode.decode_corpus(encode.encode_corpus(docs, tokenizer), vocab).collect()}
    assert decoded[3] == "" and len(decoded) == len(CODE)
    assert all(len(decoded[i].split()) == len(words) for i, words in enumerate(map(str.split, decoded.values())))
    lost = spark.createDataFrame([(0, [0, 99, 1]), (1, [])], "doc_id long, input_ids array<int>")
    rows = encode.decode_corpus(lost, tokenizer).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ["[UNK] [UNK] [PAD]", ""]


def test_encoding_moves_nothing(docs):
    tokenizer = bpe.train(W.pre_token_counts(docs), bpe.PROFILES["mistral"], 60)
    plan = encode.encode_corpus(docs, tokenizer)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_long_runs_and_word_limits(docs):
    tokenizer = bpe.train(W.pre_token_counts(docs), bpe.PROFILES["mistral"], 100)
    split = encode.splitter(tokenizer)
    assert "".join(split("a" * 50_000)) == "a" * 50_000
    wordpiece = bpe.train(W.pre_token_counts(docs), bpe.PROFILES["bert"], 100)
    assert encode.splitter(wordpiece)("a" * 101) == ["[UNK]"]
    wordpiece.profile = dataclasses.replace(wordpiece.profile, max_word_chars=None)
    assert encode.splitter(wordpiece)("a" * 101) != ["[UNK]"]


def test_shifted_labels(spark):
    rows = spark.createDataFrame([([1, 2, 3],), ([1],), ([],)], "ids array<int>")
    assert [r[0] for r in rows.select(T.shifted_labels(F.col("ids"))).collect()] == [[2, 3, -100], [-100], []]
