"""A Python worker goes from stage to stage and keeps the words of one operator only."""

import random

from codecorpus.llm import common, jaccard, packing, quality

TEXTS = [" ".join(f"word{i * k % 977}" for k in range(50)) for i in range(40)]


def held():
    words = packing._words(None) if packing._words.cache_info().currsize else None
    return [len(quality._cache) + len(quality._cache.older), len(jaccard._cache) + len(jaccard._cache.older),
            len(words.cache) + len(words.older) if words else 0]


def fill(which):
    if which == 0:
        return [quality.features(t) for t in TEXTS]
    if which == 1:
        return [jaccard.shingles(t, 5).tolist() for t in TEXTS]
    return list(packing._words(None).ids([t.encode() for t in TEXTS]))


def test_a_worker_holds_the_words_of_one_operator():
    first = [fill(k) for k in range(3)]
    order = [0, 1, 2] * 3
    random.Random(3).shuffle(order)
    for k in order:
        assert fill(k) == first[k]
        assert [n > 0 for n in held()] == [j == k for j in range(3)]


def test_a_cache_goes_on_after_it_was_forgotten():
    made = []
    own = common.WordCache(lambda w: made.append(w) or w.upper(), 1 << 20, 100)
    other = common.WordCache(str.lower, 1 << 20, 100)
    own.bound()
    assert own["a"] == own["a"] == "A" and made == ["a"]
    other.bound()
    assert not own and not own.older and own.size == 0
    own.bound()
    assert own["a"] == "A" and made == ["a", "a"]
