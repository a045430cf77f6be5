"""Operators 1, 4, 5 and 6 against brute force, with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import lines, simhash, substrings, suffixes

WORDS = [f"w{i}" for i in range(40)]


def corpus(seed, n=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 90))) for _ in range(n // 3)]
    texts = list(base)
    for _ in range(n - len(base) - 6):
        a, b = rng.choice(base), rng.choice(base)
        texts.append(rng.choice([a, a + "\n" + b, a[: len(a) // 2] + " ~ " + b, b.upper(), "é" + a]))
    texts += ["", None, " \t\n", base[0], "x" * 3000, "é" * 400]
    return [(i, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, n_words string, kept int").repartition(5)


def brute_words(rows, k=20):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            if seen.setdefault(key, (i, j)) != (i, j):
                gone[j : j + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def brute_bytes(rows, k=100):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - k + 1):
            if seen.setdefault(b[j : j + k], (i, j)) != (i, j):
                gone[j : j + k] = b"\1" * k
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_match_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r[0]: tuple(r)[1:] for r in substrings.document_digests(frame(spark, rows)).collect()}
    assert got == brute_words(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_suffixes_match_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r[0]: tuple(r)[1:] for r in suffixes.document_digests(frame(spark, rows)).collect()}
    assert got == brute_bytes(rows)


def test_suffixes_with_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_SHARE", 10**9)
    rng = random.Random(5)
    common = "".join(rng.choice("abcdefgh ") for _ in range(130))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(40)) + common + "".join(rng.choice("abcdefgh ") for _ in range(40))) for i in range(1200)]
    got = {r[0]: tuple(r)[1:] for r in suffixes.document_digests(frame(spark, rows)).collect()}
    assert got == brute_bytes(rows)


@pytest.mark.parametrize("op", [substrings.document_digests, suffixes.document_digests, simhash.document_components, lines.document_lines])
def test_empty_table(spark, op):
    assert op(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_that_share_an_id_and_null_ids(spark):
    text = " ".join(WORDS)
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substrings.document_digests(rows).collect())
    assert got == [(-1, 0), (1, 40), (1, 40), (2, 40)]
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in suffixes.document_digests(rows).collect())
    assert got == [(-1, 0), (1, len(text)), (1, len(text)), (2, len(text))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(s):
    assert suffixes.suffix_array(np.asarray(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_array_of_large_symbols():
    s = np.random.default_rng(0).integers(1, 1 << 40, 60)
    s = np.concatenate([s, s])
    assert suffixes.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_covering_masks_miss_no_pair():
    rng = np.random.default_rng(1)
    for free in (-1, 0x0F0F0F0F0F0F0F0F):
        made = np.asarray(simhash.masks(3, free), np.int64).view(np.uint64)
        places = [b for b in range(64) if free >> b & 1]
        for _ in range(3000):
            difference = np.uint64(sum(1 << int(b) for b in rng.choice(places, 3, replace=False)))
            assert any(difference & m == 0 for m in made)


@pytest.mark.parametrize("split_above", [4096, 3])
def test_simhash_links_match_brute_force(spark, split_above):
    rng = np.random.default_rng(2)
    fps = list(rng.integers(-(2**63), 2**63 - 1, 60))
    for f in fps[:20]:
        for _ in range(6):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            fps.append(int(np.int64(np.uint64(np.int64(f).astype(np.uint64) ^ np.uint64(sum(1 << int(b) for b in flips))).astype(np.int64))))
    fps = sorted({int(f) for f in fps})
    bits = np.asarray(fps, np.int64).view(np.uint64)
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= 3):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = simhash.connected_components(simhash.links(table, 3, split_above))
    got = {r["node"]: r["component"] for r in found.collect()}
    assert {f: got.get(f, f) for f in fps} == {f: fps[root(i)] for i, f in enumerate(fps)}


def test_simhash_of_documents(spark):
    rows = spark.createDataFrame([(5, "a b c d"), (3, "A B C D"), (9, None), (8, " "), (None, "z"), (4, "z")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.document_components(rows).collect()}
    assert got[5]["component_id"] == 3 and got[9]["fingerprint"] == "0" * 16 and got[9]["component_id"] == 8
    assert got[None]["component_id"] is None and got[4]["component_id"] is None


def line_shingles(line):
    low = line.strip(" ").lower()
    return frozenset(low[i : i + 10] for i in range(max(1, len(low) - 9)))


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute_lines(rows):
    """Removed line numbers by document: exact Jaccard of all pairs of lines, components, first line kept."""
    kept = [(i, n, line_shingles(x)) for i, t in sorted(rows, key=lambda r: r[0]) for n, x in enumerate((t or "").split("\n")) if re.search(r"[^ \t\n\x0b\f\r]", x)]
    sets = sorted({s for _, _, s in kept}, key=sorted)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= 0.8:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    index, seen, gone = {s: i for i, s in enumerate(sets)}, set(), {i: [] for i, _ in rows}
    for i, n, s in kept:
        c = root(index[s])
        if c in seen:
            gone[i].append(n)
        seen.add(c)
    return gone


def removed_lines(out):
    return {r["doc_id"]: [int(x) for x in r["removed"].split(",") if x] for r in out.collect()}


def test_lines_match_brute_force(spark):
    """Short, long and repetitive lines, some with a word or a letter changed; nothing more goes, and nearly all found pairs."""
    rng = random.Random(8)
    made = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    base = [[rng.choice(made) for _ in range(rng.randint(1, 60))] for _ in range(40)] + [["-" * 30], ["ab"] * 100, ["x"]]
    rows = []
    for i in range(120):
        some = []
        for _ in range(rng.randint(0, 6)):
            words = list(rng.choice(base))
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = rng.choice(made)
            some.append(rng.choice(["", "  "]) + " ".join(words))
        rows.append((i, "\n".join(some)))
    rows += [(190, None), (191, ""), (192, "\n\n"), (193, "A b\na b"), (194, "-" * 400), (195, "ab " * 300)]
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, removed string").repartition(4)
    got = removed_lines(lines.document_lines(table))
    want = brute_lines(rows)
    pairs = {(i, n) for i in want for n in want[i]}
    found = {(i, n) for i in got for n in got[i]}
    assert found <= pairs
    assert len(found) >= 0.97 * len(pairs)
    out = {r["doc_id"]: r["text"] for r in lines.dedup(table).collect()}
    for i, t in rows:
        assert out[i] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in got[i]))


@pytest.mark.parametrize("n_words", [3, 5, 6, 8, 10, 12, 20, 40, 150])
def test_line_bands_find_similar_lines_of_every_length(spark, n_words):
    """Pairs with a Jaccard similarity from 0.80 to 0.90: 0.95 of them and more share a band."""
    rng = random.Random(n_words)
    rows = []
    while len(rows) < 300:
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 12))) for _ in range(n_words)]
        a = " ".join(words)
        b = list(a)
        for _ in range(rng.randint(1, 1 + len(a) // 90)):
            b[rng.randrange(len(b))] = rng.choice("klmn")
        b = "".join(b) + rng.choice(["", "", " " + "k" * rng.randint(1, max(1, len(a) // 12))])
        if 0.8 <= jaccard(line_shingles(a), line_shingles(b)) <= 0.9:
            rows.append((len(rows), a, b))
    table = spark.createDataFrame(rows, "i long, a string, b string")
    sides = [lines.signatures(table.select(lines.F.col("i").alias("lid"), lines.F.col("i").alias("lid2"), lines._wide(lines.F.col(c)).alias("wide"))).withColumnRenamed("keys", c) for c in "ab"]
    met = sides[0].join(sides[1], "lid").where(lines.F.arrays_overlap("a", "b")).count()
    assert met >= 0.95 * len(rows)


def line_keys(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "lid long, low string")
    table = table.select("lid", lines.F.col("lid").alias("lid2"), lines._wide(lines.F.col("low")).alias("wide"))
    return [set(r["keys"]) for r in lines.signatures(table).orderBy("lid").collect()]


def test_unlike_lines_share_no_band(spark):
    """Lines that fill about half their bins do not meet for the bins that are empty in all of them."""
    rng = random.Random(31)
    texts = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randint(28, 60))) for _ in range(400)]
    held = [k for keys in line_keys(spark, texts) for k in keys]
    assert len(held) == len(set(held))


def test_signatures_of_words_find_long_and_repetitive_lines(spark):
    rng = random.Random(32)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 12))) for _ in range(5000)]
    for n in (28, 36, 48, 90):
        base = [[rng.choice(words) for _ in range(n)] for _ in range(150)]
        near = [x[: len(x) // 2] + ["k" * 5] + x[len(x) // 2 + 1 :] + ["l"] * (n // 30) for x in base]
        keys = line_keys(spark, [" ".join(x) for x in base + near])
        assert sum(bool(a & b) for a, b in zip(keys[:150], keys[150:], strict=True)) >= 0.95 * 150
    once = line_keys(spark, ["ab cd ef " * 5, "ab cd ef " * 200, "\u4e00\u4e8c\u4e09" * 20, "\u4e00\u4e8c\u4e09" * 900])
    assert once[0] & once[1] and once[2] & once[3]


def test_line_blocks_compare_members_of_one_band(spark, monkeypatch):
    texts = ["abcdefghijklmno", "abcdefghijklmnop", "qwertyuiopasdfgh", "qwertyuiopasdfghj", "unlike the others"]
    table = spark.createDataFrame(list(enumerate(texts)), "lid long, low string").select("lid", lines._wide(lines.F.col("low")).alias("wide"))
    members = spark.createDataFrame([(7, i, i, len(texts)) for i in range(len(texts))], "band long, lid long, class long, size long")
    for block in (1, 64):
        monkeypatch.setattr(lines, "BLOCK", block)
        found = {tuple(sorted(map(int, r))) for r in lines.block_links(members, table, 0.8, 10).collect()}
        assert found == {(0, 1), (2, 3)}


def test_lines_of_one_hot_band_are_banded_again(spark, monkeypatch):
    """Many lines around one passage: with small limits they go through rounds, blocks and a second signature."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    passage = " ".join(word() for _ in range(30))
    texts = [passage + " " + " ".join(word() for _ in range(20)) for _ in range(60)]
    texts += [x + " z" for x in texts[:20]]
    rows = list(enumerate(texts))
    monkeypatch.setattr(lines, "MOST", 4)
    got = removed_lines(lines.document_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    want = brute_lines(rows)
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)


def test_short_fuzzy_lines_are_found(spark):
    rng = random.Random(9)
    rows = []
    for i in range(0, 600, 2):
        words = ["".join(rng.choice("abcdefghij") for _ in range(12)) for _ in range(rng.randint(5, 20))]
        rows += [(i, " ".join(words)), (i + 1, " ".join([*words, "something"]))]  # ten characters more
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["n_removed"] for r in lines.document_lines(table).collect()}
    assert all(got[i] == 0 for i in range(0, 600, 2))
    assert sum(got[i] for i in range(1, 600, 2)) >= 0.97 * 300


def test_lines_of_empty_tables_clashing_columns_null_ids_and_long_lines(spark):
    kind = "doc_id long, text string, n_lines string, doc long, low string, band int"
    assert lines.dedup(spark.createDataFrame([], kind)).count() == 0
    long = " ".join(f"word{i}" for i in range(20_000))
    rows = [(None, "alpha beta gamma\nsome line", "q", 1, "l", 2), (None, "other\nsome line", "q", 1, "l", 2), (5, long, "q", 1, "l", 2), (6, long + " end", "q", 1, "l", 2), (6, "some line", "q", 1, "l", 2)]
    out = lines.dedup(spark.createDataFrame(rows, kind))
    assert {"doc", "low", "band"} <= set(out.columns)
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"][:40]) for r in out.collect()))
    # the null rows are one document: line 1 of both is its line 1, and stays
    assert got == [(False, 0, "alpha beta gamma\nsome line"), (False, 0, "other\nsome line"), (True, 5, long[:40]), (True, 6, ""), (True, 6, "")]


def test_registered_query_takes_every_line_that_is_not_blank(spark, tmp_path):
    from barloom.llm import queries

    rng = random.Random(10)
    long = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(200))
    near = long[:150] + "\u4e00" + long[151:]
    url = "https://example.com/" + "".join(rng.choice("abcdefghij") for _ in range(60))
    texts = ["Share\nRead more\n\n" + long, "read MORE\n\n" + near, " \n" + url + "\nShare", url + "\nReader\n\u3000", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_lines"], r["removed"]) for r in queries.QUERIES["op4_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {0: (4, ""), 1: (3, "0,2"), 2: (3, "2"), 3: (3, "0"), 4: (0, "")}


def test_fingerprints_match_brute_force(spark):
    """Each fingerprint bit by the definition, over words, shingles and XXH64 of the plain library."""
    import xxhash

    def brute(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        if not w:
            return 0
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    texts = [None, "", " \t", "One", "one TWO", "a b c", "a b c a b c a b c", "É é ß x", "x y z w", "w " * 5000] + [t for _, t in corpus(3)]
    table = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.document_components(table).collect()}
    assert got == {i: f"{brute(t):016x}" for i, t in enumerate(texts)}


def test_components_of_repeated_ids_and_long_texts(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, long), (1, "entirely different words here"), (2, long), (3, long + " end")]
    out = simhash.document_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 4 and len({r["component_id"] for r in out if r["doc_id"] != 1}) == 1


def test_hot_minimisers_take_another_way_to_the_same_result(spark, monkeypatch):
    """One phrase in many contexts: with every frequent gram hot, windows travel elsewhere and nothing else changes."""
    rng = random.Random(21)
    phrase = " ".join(f"p{i}" for i in range(8))
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(20)) + " " + phrase + " " + " ".join(rng.choice(WORDS) for _ in range(20))) for i in range(60)]
    rows += [(i + 100, t) for i, t in rows[:10]]
    table = frame(spark, rows)
    plain = sorted(map(tuple, substrings.document_digests(table).collect()))
    monkeypatch.setattr(substrings, "HOT", 0.01)
    docs = table.select(substrings.F.col("doc_id").alias("doc"), "text")
    assert len(substrings.hot_minimisers(docs, 20, 6, 32)) > 0
    assert sorted(map(tuple, substrings.document_digests(table).collect())) == plain
    assert substrings.document_digests(table.limit(0)).count() == 0


def test_every_pair_of_a_large_band_is_decided(spark, monkeypatch):
    """Bands cut into blocks lose no pair: none is left to a second signature. Two lines at the threshold itself are linked too."""
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    base = [word() for _ in range(40)]
    texts = []
    for _ in range(90):
        words = [word() if rng.random() < 0.06 else w for w in base]
        texts.append(" ".join(words))
    texts += ["a" * 8 + "".join(chr(0x4E00 + i) for i in range(n)) for n in (19, 17)] + ["".join(chr(0x5000 + i) for i in range(n)) for n in (54, 45)]
    table = spark.createDataFrame(list(enumerate(texts)), "lid long, low string").select("lid", lines._wide(lines.F.col("low")).alias("wide"))
    members = spark.createDataFrame([(b, i, i, len(texts)) for i in range(len(texts)) for b in (7, 8)], "band long, lid long, class long, size long")
    want = {(a, b) for b in range(len(texts)) for a in range(b) if jaccard(line_shingles(texts[a]), line_shingles(texts[b])) >= 0.8}
    assert len(want) > 100 and (92, 93) in want
    monkeypatch.setattr(lines, "MOST", 4)
    for block in (3, 1000):
        monkeypatch.setattr(lines, "BLOCK", block)
        found = [tuple(sorted(map(int, r))) for r in lines.block_links(members, table, 0.8, 10).collect()]
        assert set(found) == want and len(found) == len(want)


def test_pairs_of_a_family_stay_few(spark, monkeypatch):
    """A large group of lines around one: what is compared by shingles does not grow with the square of the group."""
    rng = random.Random(42)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    base, n = [word() for _ in range(60)], 400
    texts = [" ".join(base)] * 3 + [" ".join(word() if rng.random() < 0.09 else w for w in base) for _ in range(n)]
    compared, similar = [], lines.similar
    monkeypatch.setattr(lines, "similar", lambda pairs, *more: compared.append(pairs.count()) or similar(pairs, *more))
    got = removed_lines(lines.document_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    want = brute_lines(list(enumerate(texts)))
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    # once with the line of most copies, once what the bitmaps leave
    assert len(compared) == 2 and sum(compared) < n * n / 10
