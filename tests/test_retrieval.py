"""R2 and R4 as registered: the whole query set, against every row but the query's own."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as se
from oracle_harness import compare, duck
from ledgerframe.plans.registry_events import K

QUERIES, ORACLE = se.queries(), se.oracle_sql()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """110 vectors; 25 and 75 are near each other, as are 50 and 100. Ids repeat and are missing."""
    path = tmp_path_factory.mktemp("retrieval")
    pick = np.random.default_rng(3)
    vec = pick.normal(size=(110, 6))
    vec[75], vec[100] = vec[25] * 2 + 1e-3, vec[50] * 3 - 1e-3
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(vec)]
    rows += [(0, (vec[0] + s).tolist(), 1) for s in (0.5, -0.3, 0.1)] + [(25, (vec[25] - 0.2).tolist(), 1)]
    rows += [(None, vec[i].tolist(), 2) for i in (0, 0, 25, 25, 50, 50, 75)]
    ids, embedding, label = zip(*rows)
    vectors = {"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(embedding, pa.list_(pa.float32())),
               "label": pa.array(label, pa.int32())}
    pq.write_table(pa.table(vectors), path / "embeddings.parquet")
    texts = {"doc_id": range(110), "source": ["web"] * 110, "text": [f"text of {i}" for i in range(110)]}
    pq.write_table(pa.table({c: list(v) for c, v in texts.items()}), path / "documents.parquet")
    return str(path)


def test_every_25th_vector_is_asked_against_all_others(spark, folder):
    got = {}
    for r in QUERIES["R2_topk_exact"](spark, folder).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert sorted(got) == [0, 25, 50, 75, 100]
    assert all(len(docs) == K and q not in docs for q, docs in got.items())
    assert (got[75][0], got[50][0], got[100][0]) == (25, 100, 50)  # queries are candidates of each other


def test_repeated_and_missing_ids_push_no_candidate_out(spark, folder):
    ok, msg = compare(QUERIES["R2_topk_exact"](spark, folder), ORACLE["R2_topk_exact"], duck(folder))
    assert ok and msg == f"{5 * K} rows match", msg


def test_every_25th_vector_gets_the_texts_of_its_top_k(spark, folder):
    top = {}
    for r in QUERIES["R2_topk_exact"](spark, folder).orderBy("rank").collect():
        top.setdefault(r["query_id"], []).append(r["doc_id"])
    packed = {r["query_id"]: r["context"] for r in QUERIES["R4_context_pack"](spark, folder).collect()}
    assert sorted(packed) == [0, 25, 50, 75, 100]
    assert packed == {q: "\n\n".join(f"[web] document {d}\ntext of {d}" for d in docs) for q, docs in top.items()}
    ok, msg = compare(QUERIES["R4_context_pack"](spark, folder), ORACLE["R4_context_pack"], duck(folder))
    assert ok and msg == "5 rows match", msg
