import tracemalloc

import numpy as np
import pandas as pd

from routeloom.operators import retrieval


def test_scoring_a_block_holds_tiles_only():
    """Copies, zero vectors and ties; the scores of 500 queries against the block alone would take 240 MB."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60_000, 8)).round(1)
    vectors[1000:30_000] = vectors[7]
    vectors[50_000:50_100] = 0
    corpus = pd.DataFrame({"id": np.arange(60_000), "v": [v.tobytes() for v in vectors]})
    asked = np.r_[0:400, 50_000:50_100]
    queries = pd.DataFrame({"qid": asked, "v": corpus["v"].iloc[asked].to_numpy()})
    unpack = lambda cells: np.frombuffer(b"".join(cells)).reshape(len(cells), -1)
    tracemalloc.start()
    got = retrieval._best(queries, corpus, 3, True, unpack, unpack)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    unit = retrieval._normed(vectors)
    for qid, found in got.groupby("qid")["id"]:
        scores = np.rint(unit @ unit[qid] * retrieval.SCALE)
        scores[qid] = -np.inf
        assert set(found) == set(np.lexsort((np.arange(60_000), -scores))[:3])
    assert len(got) == 1500
