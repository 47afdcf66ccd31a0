"""Joins of many words at a time, and the bounded memory of both byte-pair coders."""
import random

import numpy as np
import pytest

from barweave.llm import bpe, joins, word_bpe


def words_of(rng, letters, longest, n):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def test_joins_equal_the_single_fold():
    ranks, pattern = bpe.default_ranks()
    coder, rng = bpe.Coder(ranks, pattern), random.Random(5)
    words = words_of(rng, "abeinrst é日🙂\n", 40, 6000) + [" ", "the", "x" * joins.LONGEST, "x" * (joins.LONGEST + 1), "ab" * 900]
    got = coder._folded(words)
    assert got == [",".join(map(str, bpe.fold(w.encode(), ranks))) for w in words]
    assert coder._decoded(got) == [w.encode() for w in words]


def test_joins_equal_the_rank_array():
    import public_tokenizers
    coder, rng = word_bpe.WordCoder(public_tokenizers.path(word_bpe.VOCABULARY)), random.Random(6)
    words = words_of(rng, "abeinrst é日🙂-", 40, 6000) + ["the", "x" * joins.LONGEST, "x" * (joins.LONGEST + 1), "ab" * 900]
    got = coder._coded([*words, ("<|endoftext|>",)])
    assert got == [np.array([coder.vocab[p] for p in coder.parts(w)], "<u4").tobytes() for w in words] + [np.array([coder.special["<|endoftext|>"]], "<u4").tobytes()]


def test_rank_files_that_cannot_be_joined_side_by_side():
    ranks = {b"a": 0, b"b": 1, b"ab": 1 << 40, b"abab": (1 << 40) + 1}
    coder = bpe.Coder(ranks, r"\S+")
    assert coder.joins is None and coder.encode("ababb ba") == [(1 << 40) + 1, 1, 1, 0]
    assert b"".join(coder.word_bytes(coder.word_ids("ababb"))) == b"ababb"


@pytest.mark.parametrize("keep", [1, 50, 300])
def test_a_full_memory_keeps_the_words_in_use(keep):
    made, memory = [], {}

    def make(keys):
        made.extend(keys)
        return [k.upper() for k in keys]

    for i in range(40):
        lists = [[f"common{j}" for j in range(20)], [f"rare{i}-{j}" for j in range(20)], [], ["long" * 9 + str(i)]]
        assert joins.looked_up(memory, lists, make, keep, 20) == [[k.upper() for k in keys] for keys in lists]
        assert len(memory) <= max(keep, 41) and not any(len(k) > 20 for k in memory)
    assert sum(k.startswith("common") for k in made) == 20 and len(made) == 20 + 40 * 20 + 40


def test_groups_are_whole_texts():
    texts = ["a" * 5, None, "b" * 30, "", "c"]
    groups = list(joins.grouped(texts, 10))
    assert groups == [["a" * 5, "", "b" * 30], ["", "c"]] and list(joins.grouped([])) == []
