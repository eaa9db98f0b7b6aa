"""Texts that are embedded next to their scoring."""

import numpy as np
import pyarrow as pa

import __spark_entry__ as entry
from quillfin.operators import maxsim
from tests.test_plans import SF


class Recorder:
    dim = 4

    def __init__(self) -> None:
        self.sizes: list[int] = []

    def embed_texts(self, texts: list[str]) -> list[np.ndarray]:
        self.sizes.append(sum(map(len, texts)))
        return [np.full((1, 4), len(t), np.float32) for t in texts]


def test_texts_of_a_large_batch_are_embedded_in_steps():
    texts = ["x" * (i % 700) for i in range(5_000)] + ["y" * (2 * maxsim._STEP_CHARS), None, "z"]
    names = pa.array([str(i) for i in range(len(texts))])
    batch = pa.RecordBatch.from_arrays([names, names, pa.array(texts)], names=["segment_id", "group_id", "text"])
    model = Recorder()
    made = list(maxsim._embedding(lambda batches: batches, model)([batch.slice(0, 0), batch]))
    assert [i for b in made for i in b.column("segment_id").to_pylist()] == names.to_pylist()
    assert [v[0][0] for b in made for v in b.column("vectors").to_pylist()] == [len(t or "") for t in texts]
    whole = [s for s in model.sizes if s <= maxsim._STEP_CHARS]
    assert len(model.sizes) - len(whole) == 1 and len(whole) > 5


def test_document_search_moves_no_vectors(spark):
    plan = entry.queries()["text_search_documents"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "vectors" not in plan
