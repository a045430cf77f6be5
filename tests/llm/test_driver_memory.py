"""What the driver must not hold itself."""

import os

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import common, langid, lines
from barloom.llm.common import materialize


def test_language_model_is_fitted_in_a_task(spark, monkeypatch):
    said = {"en": "the one and the other of them ", "es": "uno y otro de los demas ", "de": "der eine und die andere "}
    rows = [(i, said[lang] * (1 + i % 5), lang) for i, lang in enumerate([*said] * 20)] + [(60, None, "en"), (61, "the one", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = sorted((str(i), text, lang) for i, text, lang in rows if text and lang)
    got, want = langid.fit_sample(docs, F.col("doc_id")), langid.fit([r[1] for r in drawn], [r[2] for r in drawn])
    assert got.labels == want.labels and np.array_equal(got.weights, want.weights) and np.array_equal(got.transitions, want.transitions)
    assert langid.fit_sample(docs.limit(0), F.col("doc_id")).labels == []
    monkeypatch.setattr(langid, "fit", lambda texts, langs: os.getpid())
    assert langid.fit_sample(docs, F.col("doc_id")) != os.getpid()


def test_components_end_once_all_are_stars(spark, monkeypatch):
    """Links that are stars already need no round; a chain needs some and no further one that changes nothing."""
    written = []
    monkeypatch.setattr(common, "materialize", lambda df: written.append(1) or materialize(df))
    edges = lambda pairs: spark.createDataFrame(pairs, "src long, dst long")
    stars = common.connected_components(edges([(1, 2), (3, 1), (9, 8), (2, 2), (1, 2)]))
    assert {tuple(r) for r in stars.collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)} and len(written) == 1
    assert common.connected_components(edges([])).count() == 0
    chain = common.connected_components(edges([(i, i + 1) for i in range(40)] + [(50, 60), (55, 60), (50, 50)]))
    assert {tuple(r) for r in chain.collect()} == {(i, 0) for i in range(41)} | {(50, 50), (55, 50), (60, 50)}


def test_classes_merge_by_new_links(spark):
    links = lambda pairs: spark.createDataFrame(pairs, "src long, dst long")
    classes = common.connected_components(links([(1, 2), (3, 4), (7, 8)]))
    got = lines.merged(classes, [links([(2, 4)]), links([(9, 8), (5, 6)])])
    assert {tuple(r) for r in got.collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7), (9, 7), (5, 5), (6, 5)}
