"""Rows that share an id, and long runs of white space."""

import hashlib
import time

import numpy as np
import pytest

from barloom.llm import bpe, common, lines, neighbours, simhash, substrings, suffixes, urls


def test_repeated_ids_are_one_candidate_and_one_query(spark):
    same = [float(v) for v in range(1, 9)]
    rows = [(0, same)] * 5 + [(i, same) for i in range(1, 101)]
    found = neighbours.embedding_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).toPandas()
    for q in range(0, 101, 20):
        got = found[found.query_id == q].sort_values("rank")
        assert got["rank"].tolist() == list(range(1, 21)) and got.vec_id.tolist() == [i for i in range(101) if i != q][:20]


def test_repeated_ids_with_different_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 6))
    ids = np.concatenate([np.arange(500), rng.integers(0, 60, 400)])
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)]
    found = neighbours.embedding_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).toPandas()
    hit = 0
    for q in range(0, 500, 20):
        scores = {}
        for i, r in zip(ids, x, strict=True):
            if i != q:
                scores[i] = max(scores.get(i, -np.inf), max((r * y).sum() for y in x[ids == q]))
        got = found[found.query_id == q].sort_values("rank")
        assert got.vec_id.is_unique and len(got) == 20
        assert all(s == pytest.approx(scores[i], abs=1e-12) or s < scores[i] for i, s in zip(got.vec_id, got.score, strict=True))
        hit += len(set(sorted(scores, key=lambda i: (-scores[i], i))[:20]) & set(got.vec_id))
    assert hit / (25 * 20) >= 0.9


def test_runs_just_below_the_long_ones():
    rank_file, pattern = bpe.default_rank_file(), bpe.default_pattern()
    text = ("a" + " " * 9_999) * 150
    began = time.time()
    ids = bpe.encode_text(text, rank_file, pattern)
    assert time.time() - began < 3 and ids == bpe.encoding(rank_file, pattern).encode_ordinary(text)


def test_ids_of_very_long_white_space_by_pieces():
    """The library's matcher gives up on runs of a million; its own pieces, one by one, are the reference."""
    rank_file, pattern = bpe.default_rank_file(), bpe.default_pattern()
    enc = bpe.encoding(rank_file, pattern)
    for space, n in ((" ", 1_200_000), ("　", 1_100_000)):
        want = enc.encode_ordinary("a") + enc._encode_single_piece(space * (n - 1)) + enc.encode_ordinary(space + "b")
        assert bpe.encode_text("a" + space * n + "b", rank_file, pattern) == want


def _sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_rows_that_share_an_id_keep_their_own_text(spark):
    copy, own = " ".join(f"c{i}" for i in range(40)), [" ".join(f"own{k}x{i}" for i in range(60)) for k in range(3)]
    texts = [(None, own[0]), (None, own[1] + " " + copy), (7, own[2] + " " + copy), (7, own[2] + " " + copy), (8, None), (8, "")]
    table = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, doc string").repartition(1)
    words = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substrings.document_digests(table).collect())
    assert words == [(0, 0), (0, 0), (7, 40), (7, 100), (8, 0), (8, 0)]
    found = sorted((r["doc_id"] or 0, r["n_removed"], r["kept_sha256"]) for r in suffixes.document_digests(table).collect())
    assert [x[1] for x in found if x[0] == 0] == [0, 0] and sorted(x[2] for x in found if x[0] == 0) == sorted(_sha(t) for i, t in texts if i is None)
    assert {x[1] for x in found if x[0] == 7} == {len("x59 " + copy), len(own[2] + " " + copy)}
    out = sorted((r["doc_id"] or 0, r["n_lines"], r["n_removed"]) for r in lines.document_lines(table).collect())
    assert sum(r[2] for r in out) == 1 and len(out) == 6
    assert common.separate(table.limit(0), "doc_id", "text").count() == 0


def test_documents_of_their_own_keep_the_order_of_ids(spark):
    table = spark.createDataFrame([(5, "a"), (None, "b"), (5, "c"), (-3, "d"), (2**62, "e")], "doc_id long, text string").repartition(3)
    got = [(r["key"], r["text"]) for r in common.separate(table, "doc_id", "text").orderBy("doc").collect()]
    assert [k for k, _ in got] == [None, -3, 5, 5, 2**62] and {t for _, t in got} == set("abcde")
    unique = table.where("doc_id <> 5")
    assert {(r["doc"], r["key"]) for r in common.separate(unique, "doc_id", "text").collect()} == {(-3, -3), (2**62, 2**62)}


def test_urls_that_are_long_and_no_pages(spark):
    rows = [(1, "HTTP://" + "a." * 3000 + "Example.ORG/es/" + "x" * 100_000 + "?q"), (2, "x://org" + "/" * 50_000), (3, "x://" + "b" * 70_000), (4, None)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, rule string")
    got = {r["page_id"]: r for r in urls.page_verdicts(pages).collect()}
    assert (got[1]["rule"], got[1]["verdict"]) == ("example.org/es/", "block") and len(got[1]["path"]) == 100_004
    assert got[2]["rule"] == "org/" and got[3]["rule"] is None and len(got[3]["host"]) == 70_000 and got[4]["host"] == ""
    assert urls.page_verdicts(pages.limit(0)).count() == 0


def test_a_list_larger_than_its_filter(spark):
    rules = spark.createDataFrame([(f"h{i}.com", f"/{i % 7}/", "block") for i in range(3000)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(f"x://{'w.' if i % 2 else ''}h{i}.com/{i % 5}/y",) for i in range(4000)], "url string")
    got = {r["url"]: r["verdict"] for r in urls.judge(pages, rules, blocks=64).collect()}
    assert got == {f"x://{'w.' if i % 2 else ''}h{i}.com/{i % 5}/y": "block" if i < 3000 and i % 7 == i % 5 else "allow" for i in range(4000)}


def test_simhash_buckets_are_covered_until_they_are_small(spark):
    """Fingerprints that differ in the lowest bits alone share buckets of every mask at every level."""
    rng = np.random.default_rng(3)
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 20, 700), rng.integers(-(2**63), 2**63 - 1, 100)]))
    table = spark.createDataFrame([(int(f),) for f in fps], "fp long").repartition(3)
    label = {int(f): int(f) for f in fps}
    near = [(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if int((a ^ b).view(np.uint64)).bit_count() <= 3]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    for split_above in (4096, 20):
        found = simhash.connected_components(simhash.links(table, 3, split_above))
        got = {r["node"]: r["component"] for r in found.collect()}
        assert {f: got.get(f, f) for f in label} == label and len(near) > 100


def test_long_texts_with_planted_copies(spark):
    """Texts of a megabyte: the whole of each is compared."""
    rng = np.random.default_rng(9)
    draw = lambda n: " ".join(map(str, rng.integers(0, 10**9, n)))
    shared, a, b = draw(60), draw(90_000), draw(90_000)
    rows = [(1, a + " " + shared), (2, b + " " + shared), (3, shared)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substrings.document_digests(table).collect()}
    assert got == {1: 0, 2: 60, 3: 60}
    got = {r["doc_id"]: r for r in suffixes.document_digests(table).collect()}
    assert got[1]["n_removed"] == 0 and got[3]["n_removed"] == len(shared) and len(shared) <= got[2]["n_removed"] <= len(shared) + 20
    assert [got[i]["n_bytes"] for i in (1, 2, 3)] == [len(t) for _, t in rows]
