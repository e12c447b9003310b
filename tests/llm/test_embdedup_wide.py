import numpy as np

from tideline.llm import embdedup

from .test_embdedup import brute


def wide(dim, shift):
    """Pairs just above the threshold, all vectors moved by ``shift`` along one direction."""
    rng, rows = np.random.default_rng(8), []
    for _ in range(60):
        base = rng.standard_normal(dim)
        base[0] += shift
        base /= np.sqrt(base @ base)
        other = rng.standard_normal(dim)
        other -= (other @ base) * base
        rows += [base, 0.981 * base + np.sqrt(1 - 0.981**2) * other / np.sqrt(other @ other)]
    return [(i, v.tolist(), 1) for i, v in enumerate(rows)]


def test_wide_and_off_centre_vectors_keep_their_pairs(spark):
    for dim, shift in ((768, 0.0), (64, 12.0)):
        rows = wide(dim, shift)
        got = embdedup.duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
        want = sum(w[1] for w in brute(rows))
        assert want >= 120 and 0.98 * want <= sum(r.n_links for r in got) <= want, dim
