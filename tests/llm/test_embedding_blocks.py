"""Keys of two and more projections lose no links against brute force."""

import numpy as np
import pytest

from keyloom.llm import embedding_dedup


@pytest.mark.parametrize("blocks", [2, 3])
def test_links_with_joined_projections(spark, blocks):
    rng = np.random.default_rng(5)
    a = rng.standard_normal((800, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    r = rng.standard_normal((800, 64))
    r -= (r * a).sum(1)[:, None] * a
    r /= np.linalg.norm(r, axis=1)[:, None]
    x = np.concatenate((a, 0.981 * a + np.sqrt(1 - 0.981**2) * r))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    want = ((x @ x.T >= 0.98).sum(1) - 1).tolist()
    got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_dedup(df, blocks=blocks).collect()}
    assert sum(want) >= 1600 and [got[i] for i in range(len(x))] == want
