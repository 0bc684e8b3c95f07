"""The first step of a top-k pools its best candidates, not all of its cells."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from corpusloom.operators import scoring


class Caught(Exception):
    pass


class Corpus:
    def mapInArrow(self, run, schema):
        self.run = run
        raise Caught


def test_first_step_pools_few_candidates(monkeypatch):
    vectors = np.random.default_rng(2).integers(0, 9, (3000, 4)).astype(float)
    queries, k = vectors[:60], 5
    method = scoring.DenseMethod("raw", "embedding", queries, "l2")
    corpus = Corpus()
    with pytest.raises(Caught):
        scoring.top_k(corpus, "id", [method], pa.array(range(60)), T.StructField("query_id", T.LongType()), k)
    pools, sort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: pools.append(len(keys[0])) or sort(keys))
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(3000)), "embedding": pa.array(vectors.tolist())})
    (out,) = corpus.run(iter([batch]))
    monkeypatch.undo()
    found = sorted((r["query_id"], -r["score"], r["id"]) for r in out.to_pylist())
    want = []
    for q in range(60):
        far = ((vectors - queries[q]) ** 2).sum(axis=1)
        want += [(q, float(far[i]), int(i)) for i in np.lexsort((np.arange(3000), far))[:k]]
    assert found == sorted(want) and max(pools) < 3000 * 60 // 10
