"""Alignment of two tokenizers against a plain version that encodes whole texts and counts pairs in a dictionary."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from graphtide.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        self.of = alignment.byte_level()

    def bytes_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, bytes(self.of[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, self.bytes_b(i)) for i in self.b.encode(text)]
        whole = (" " + text).encode()
        return (a, b) if b"".join(t for _, t in a) == whole == b"".join(t for _, t in b) else ([], [])

    def rows(self, docs):
        found, count = [], Counter()
        for doc, text in docs:
            a, b = self.tokens(text)
            ends_a, ends_b = np.cumsum([len(t) for _, t in a]), np.cumsum([len(t) for _, t in b])
            both = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
            at_a, at_b = {int(e): k for k, e in enumerate(ends_a)}, {int(e): k for k, e in enumerate(ends_b)}
            groups, i, j = [], 0, 0
            for e in both:
                groups.append(",".join(str(x) for x, _ in a[i : at_a[e] + 1]) + "|" + ",".join(str(x) for x, _ in b[j : at_b[e] + 1]))
                i, j = at_a[e] + 1, at_b[e] + 1
            links = [(a[at_a[e]][0], b[at_b[e]][0]) for e in both]
            count.update(links)
            found.append((str(doc), len(a), len(b), len(groups), links, ";".join(groups)))
        most = {}
        for (_, y), n in count.items():
            most[y] = max(most.get(y, 0), n)
        return sorted((doc, a, b, n, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), groups) for doc, a, b, n, links, groups in found)


@pytest.fixture(scope="module")
def plain():
    return Plain()


PARTS = ["the ", "word", " ", "  ", "\n", "\n\n", "\t", "é", "ß", "　", " ", "▁", "'s", "it's ", "don't", "123", " 45", "<s>", "<|endoftext|>", "𝒳", "日本語", "...", "!?", "\r\n", "​", "\x1c", "\x00", "Ġ", "ontion", "he in", "."]


def odd(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randrange(1, 25))) for _ in range(n)]


def test_word_by_word_is_the_whole_text(plain):
    both = alignment.Tokenizers(A, B)
    for text in odd(1, 1500):
        raw = np.frombuffer((" " + text).encode(), np.uint8)
        starts = alignment.word_starts(raw, np.array([0, len(raw)]))
        words = [raw[s:e].tobytes().decode() for s, e in zip(starts, [*starts[1:], len(raw)], strict=True)]
        assert "".join(words) == " " + text
        assert [i for e in both.a.encode_batch_fast(words, add_special_tokens=False) for i in e.ids] == plain.a.encode(" " + text, add_special_tokens=False).ids
        if "▁" not in text:  # which B takes for a blank, so it does not give such a text back
            assert [i for ids in both._pieces(words) for i in ids] == plain.b.encode(text), text


def rows_of(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in df.collect())


@pytest.mark.parametrize(("popular", "block", "words"), [(1 << 19, 1_000_000, 300_000), (1, 40, 50), (30, 7, 300_000)])
def test_equals_the_plain_version(spark, plain, popular, block, words):
    docs = [(i, t) for i, t in enumerate(odd(2, 150))] + [(5, "twice the word"), (5, "twice the word"), (None, "no id"), (900, None), (901, ""), (902, " "), (903, "the word " * 3000), (904, "a▁b")]
    df = spark.createDataFrame([(i, t, [1], "x") for i, t in docs], "doc_id long, text string, pairs array<int>, row string").repartition(3)
    assert rows_of(alignment.align(df, A, B, popular=popular, block_bytes=block, most_words=words)) == plain.rows(docs)


def test_digests_are_those_of_the_groups(spark, plain):
    docs = [(1, "some words to align"), (2, ""), (3, "other words to align, some twice")]
    got = {r.doc_id: r.groups for r in alignment.align(spark.createDataFrame(docs, "doc_id long, text string"), A, B, digest=True).collect()}
    assert got == {int(r[0]): hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "" for r in plain.rows(docs)}


def test_counts_are_merged_in_parts(spark):
    rows = spark.createDataFrame([([1, 2, 32_002], [3, 1, 5]), ([2, 32_001], [4, 3]), ([], [])] * 4, "pairs array<long>, counts array<long>").repartition(3)
    for held in (1, 1000):
        got = {(r.pair, r.n, r.best) for r in alignment.pair_counts(rows, 32_000, held).collect()}
        assert got == {(1, 12, True), (32_001, 12, True), (2, 20, True), (32_002, 20, True)}


def test_nothing_gives_nothing(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
