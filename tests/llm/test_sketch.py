import numpy as np

from rowkeeper.llm import jaccard


def test_sketches_never_exclude_a_similar_pair():
    """The differing bits are no more than the differing elements, also between sketches of different lengths."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 100, 255, 257, 3_000):
        for m in (n, n + 1, n + n // 5, 2 * n + 1):
            pool = np.unique(rng.integers(0, 2**63, n + m + 5).astype(np.uint64))
            x, y = np.sort(pool[:n]), np.sort(pool[n // 3 : n // 3 + m])
            apart = len(np.setxor1d(x, y))
            bits = jaccard.sketches_differ(jaccard.sketch(x), jaccard.sketch(y))
            assert bits <= apart and bits % 2 == apart % 2
            assert bits > apart // 3 or apart < 8
            assert len(jaccard.sketch(x)) <= max(jaccard.BITS // 8, n / 2)
