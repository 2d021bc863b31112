"""The model of the labellers' votes against plain sums, and where it overrules a vote."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from splitlane.llm.weak_labels import ABSTAIN, BAD, GOOD, VoteModel, accuracies

G, B, A = GOOD, BAD, ABSTAIN
SHARED = [((G, G, G, G), 19_000), ((B, B, B, G), 1_000), ((B, G, G, G), 10), ((G, G, G, B), 800), ((G, B, G, A), 5)]


def fitted(rows, times=1):
    return VoteModel(np.array([p for p, _ in rows]), times * np.array([n for _, n in rows], float))


@pytest.mark.parametrize("times", [1, 10, 1000])
def test_a_lone_bad_vote_counts_by_how_its_labeller_is_supported(times):
    model = fitted(SHARED, times)
    clean, shared, lone, own_kind, _ = model.member[0]
    assert model.kinds == [0, 3]
    assert clean > 0.99 and shared < 0.01  # of all texts
    assert lone > 0.99  # labeller 0 calls it bad, but two others share its finds and do not
    assert own_kind < 0.1  # only labeller 3 sees this kind of junk


def test_fit_never_falls_and_posteriors_equal_plain_sums():
    model = fitted(SHARED)
    assert (np.diff(model.fits) > -1e-9 * abs(model.fits[-1])).all()
    for column, (pattern, _) in enumerate(SHARED):
        chance = [
            share * math.prod(table[k][v] for k, v in enumerate(pattern) if v != A)
            for share, table in zip(model.share.tolist(), model.table.tolist(), strict=True)
        ]
        assert np.allclose(np.array(chance) / sum(chance), model.member[:, column])


def test_rates_of_dealt_votes_are_found():
    rng = np.random.default_rng(3)
    share, wrong = np.array([0.9, 0.1]), np.array([[4e-4, 3e-4, 2e-4], [0.999, 0.9, 0.9]])
    kind = rng.choice(2, 1_000_000, p=share)
    bad = rng.random((len(kind), 3)) < wrong[kind]
    patterns = np.array(list(itertools.product((G, B), repeat=3)))
    counts = np.array([(bad == (p == B)).all(1).sum() for p in patterns], float)
    posterior = accuracies(patterns, counts)
    chance = np.array([[s * math.prod(np.where(p == B, w, 1 - w)) for s, w in zip(share, wrong, strict=True)] for p in patterns])
    true = chance[:, 0] / chance.sum(1)
    lone = [tuple(p) for p in patterns].index((G, B, G))
    assert true[lone] > 0.9 and posterior[lone] > 0.9  # a bad vote overruled, as it should be
    assert (abs(posterior - true) < 0.2).all()


def test_votes_without_bad_ones_and_without_good_ones():
    assert accuracies(np.array([[G, G], [A, A]]), np.array([5.0, 2.0])).tolist() == [1.0, 1.0]
    assert accuracies(np.array([[B, B]]), np.array([5.0]))[0] < 0.01
