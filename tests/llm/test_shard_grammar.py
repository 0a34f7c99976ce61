"""The grammar's counting: rare pairs are sifted out before they are sorted, and none that pays is lost."""

import numpy as np
import pytest

from seamline.llm import token_shards


@pytest.mark.parametrize("least", [2, 8])
def test_sifting_leaves_no_frequent_pair_out_and_most_rare_ones(least):
    r = np.random.default_rng(least)
    pairs = np.concatenate([r.integers(0, 2**40, 50_000), np.repeat(r.integers(0, 2**40, 500), least)]).astype(np.uint64)
    kept = token_shards.sifted(pairs, least)
    kinds, counts = np.unique(pairs, return_counts=True)
    assert kept[np.isin(pairs, kinds[counts >= least])].all()
    assert least == 2 or kept.mean() < 0.6


def test_the_grammar_is_the_same_with_and_without_sifting(monkeypatch):
    r = np.random.default_rng(3)
    for n in (1, 60, 900, 4000):
        tokens, lengths = r.integers(0, 12, n), np.diff(np.unique(np.r_[0, r.integers(0, n, 9), n]))
        made = []
        for places in (1, 1 << 30):
            monkeypatch.setattr(token_shards, "SIFTED_PLACES", places)
            made.append(token_shards.repair(tokens, lengths, 2))
        assert all(np.array_equal(a, b) for a, b in zip(*made))
        seq, _, rules, rounds, base = made[0]
        assert token_shards.expand(seq, rules, rounds, base).tolist() == tokens.tolist()
