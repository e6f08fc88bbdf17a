"""keep_one where components share their smallest id, or have none."""

import random
from collections import Counter

import pytest
from test_corpus_ops import brute_components, brute_fingerprint, near_copies
from test_text_ops import docs_of

from ioloom.llm import simhash


def shared_ids(seed=3):
    rng = random.Random(seed)
    say = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(k))
    texts = [say(80) for _ in range(9)]
    rows = [(108, texts[0]), (108, texts[1]), (108, texts[1]), (109, texts[1])]
    rows += [(None, t) for t in texts[2:7]] + [(None, texts[3])] * 2 + [(200, texts[7]), (None, texts[7]), (None, texts[8]), (None, texts[8] + " end")]
    return rows


def brute_groups(rows):
    """The rows of each component of brute force."""
    # Positions as ids tell apart components that share a smallest id.
    groups = {}
    for row, c in zip(rows, brute_components(range(len(rows)), [brute_fingerprint(t) for _, t in rows]), strict=True):
        groups.setdefault(c, []).append(row)
    return list(groups.values())


@pytest.mark.parametrize("rows", [shared_ids(), shared_ids(5) + near_copies(6)])
def test_one_row_stays_of_each_component_whatever_its_ids(spark, rows):
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs_of(spark, rows)).collect()]
    groups = brute_groups(rows)
    assert len(kept) == len(groups)
    for group in groups:
        mine = [k for k in kept if k in group]
        known = [i for i, _ in group if i is not None]
        assert len(mine) == 1 and mine[0][0] == min(known, default=None)
    count = Counter(i for i, _ in kept)
    assert count[108] == 2 and count[None] >= 6
