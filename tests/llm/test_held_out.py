"""What the learned models know about documents that they have not seen, on the given tables."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import queries, toxicity
from plumbline.llm.tables import table

FOLDER = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


def auc(score, label):
    score, label = np.array(score, float), np.array(label, bool)
    ranks = np.empty(len(score))
    order = np.argsort(score, kind="stable")
    ranks[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        ranks[score == v] = ranks[score == v].mean()
    n = label.sum()
    return (ranks[label].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_toxicity(spark):
    docs, labels = table(spark, FOLDER, "documents").select("doc_id", "text"), table(spark, FOLDER, "labels").where("toxic is not null")
    apart = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    chain = toxicity.fit(docs, labels.where(~apart))
    rows = toxicity.score(docs.where(apart), chain).join(labels, "doc_id").select("p_toxic", "is_toxic", "toxic").collect()
    value = auc([r.p_toxic for r in rows], [r.toxic for r in rows])
    caught = np.mean([r.is_toxic for r in rows if r.toxic])
    wrong = np.mean([r.is_toxic for r in rows if not r.toxic])
    print(f"toxicity: AUC {value:.3f}, recall {caught:.3f}, of clean ones {wrong:.4f} ({len(rows)} rows)")
    assert value > 0.9 and caught > 0.8 and wrong < 0.02


def test_quality(spark):
    rows = queries.op8_quality_classifier(spark, FOLDER).where("held_out").join(table(spark, FOLDER, "labels"), "doc_id").select("score", "quality").collect()
    value = auc([r.score for r in rows], [r.quality for r in rows])
    print(f"quality: AUC {value:.3f} ({len(rows)} rows)")
    assert value > 0.9


def test_language_model(spark):
    got = queries.op3_lm_scoring(spark, FOLDER).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    print(f"language model: {got[0] / got[2]:.4f} a token, base {got[1] / got[2]:.4f}")
    assert got[0] > got[1] + 0.1 * got[2]
