"""Re-Pair goes on until no pair is frequent or no symbol is left."""

import numpy as np

from corvane.llm import token_output as out


def most_frequent(seq, ends):
    inner = np.setdiff1d(np.arange(len(seq) - 1), ends - 1)
    return np.unique(seq[inner].astype(np.int64) << 16 | seq[inner + 1], return_counts=True)[1].max(initial=0)


def test_no_frequent_pair_is_left():
    r = np.random.default_rng(3)
    ids = np.concatenate([np.tile(r.integers(0, 49408, 1024), 64), r.integers(0, 300, 30000), np.full(777, 9)])
    ends = np.unique(np.concatenate([r.integers(1, len(ids), 50), [len(ids)]]))
    seq, places, rules = out.repair(ids, ends, 49408)
    assert len(rules) < 65536 - 49408 and most_frequent(seq, places) < out.LEAST
    shard = out.Shard(out.pack(np.arange(len(ends)), ids, ends, 49408))
    assert shard.all().tolist() == ids.tolist()
    assert shard.document(20).tolist() == ids[ends[19] : ends[20]].tolist()


def test_pairs_of_one_slot_are_both_replaced():
    r, slots = np.random.default_rng(5), {}
    for a, x in r.permutation(40000).reshape(-1, 2).tolist():
        slot = ((a << 16 | x) * 2654435761 & 0xFFFFFFFF) >> 12
        if slot in slots:
            break
        slots[slot] = (a, x)
    b, y = slots[slot]
    # The more frequent pair is (a, x); only two symbols can be made, and the third pair is rarer.
    ids = np.concatenate([np.tile([a, x], 40), [50000], np.tile([b, y], 39), [50001], np.tile([50002, 50003], 20)])
    breaks = np.arange(2, 81, 2).tolist() + [81] + np.arange(83, 160, 2).tolist() + [160] + np.arange(162, 201, 2).tolist()
    _, _, rules = out.repair(ids, np.array(breaks), 65534)
    assert rules.tolist() == [[a, x], [b, y]]
