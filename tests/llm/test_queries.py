"""Registered queries of the training-data operators: their columns, their SQL, and the classifier against plain formulas."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from normweave.llm import quality, registry
from tests.llm.test_operators import labelled

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op3_simhash": ["doc_id", "fingerprint", "component_id"],
    "op4_quality": ["doc_id", "held_out", "score", "predicted"],
    "op5_suffix_tree": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op6_fixity": ["page_id", "record_sha256", "length", "state", "offset", "ends", "copies_here", "copies_there"],
    "op7_mixing": ["doc_id", "source", "block", "release", "deadline", "slot", "position"],
    "op8_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op9_topk": ["query_id", "rank", "vec_id", "score"],
    "op10_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, name):
    got = registry.queries()[name](spark, SMALL)
    assert got.columns == COLUMNS[name]
    rows = got.collect()
    if "doc_id" in got.columns:
        assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    if name in registry.oracle_sql():
        db = duckdb.connect()
        for t in ("documents", "embeddings", "pages"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
        told = db.execute(registry.oracle_sql()[name])
        names = [d[0] for d in told.description]
        want = [tuple(dict(zip(names, r))[c] for c in got.columns) for r in told.fetchall()]
        assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))


def test_quality_is_a_ridge_on_cosines(spark):
    docs, labels = labelled(spark, 300)
    model = quality.fit(docs, labels)
    part = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(1000)) < int(1000 * quality.CALIBRATE)
    chosen = quality.labelled_sample(docs, labels, "quality", quality.FOLDS, quality.HELD, quality.SAMPLE)
    rows = chosen.select("doc_id", "text", "y", part.alias("part")).collect()
    x = np.array([quality.statistics(r.text) for r in rows])
    y, late = np.array([r.y for r in rows], float), np.array([r.part for r in rows])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-6))
    z = model.features(x[~late])
    ridge = quality.RIDGE * max(1.0, len(z)) * np.eye(z.shape[1]) / quality.COSINES
    assert np.allclose(model.raw(x), model.features(x) @ np.linalg.solve(z.T @ z + ridge, z.T @ y[~late]), atol=1e-6)
    at, to = plain_isotonic(model.raw(x[late]), y[late])
    assert np.allclose(model.at, at) and np.allclose(model.to, to)


def plain_isotonic(x, y):
    """Block means by the max-min formula, each drawn to 1/2 by one row."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    g = np.array([max(min(y[a : b + 1].mean() for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))])
    cut = np.flatnonzero(np.append(True, np.abs(np.diff(g)) > 1e-12))
    ends = np.append(cut[1:], len(g))
    return np.array([x[a:b].mean() for a, b in zip(cut, ends)]), np.maximum.accumulate(np.array([(y[a:b].sum() + 0.5) / (b - a + 1) for a, b in zip(cut, ends)]))


@pytest.mark.parametrize("seed", range(4))
def test_isotonic(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=60)
    y = (rng.random(60) < 1 / (1 + np.exp(-x))).astype(float)
    for got, want in zip(quality.isotonic(x, y), plain_isotonic(x, y)):
        assert np.allclose(got, want)
