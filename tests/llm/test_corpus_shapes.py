"""Operators 11, 12 and 13 against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from barloom.llm import collocations, packing, whitening


def whitening_by_hand(x, components=32):
    v = np.cov(x.T, bias=True)
    values, unit = np.linalg.eigh(v)
    values, unit = values[::-1], unit[:, ::-1]
    k = min(components, int((values > 1e-9 * values[0]).sum()))
    return (x - x.mean(axis=0)) @ unit[:, :k] / np.sqrt(values[:k]), values[:k] / np.trace(v)


def check_whitened(found, ids, c):
    x = np.floor(64 * c) + 1_000_000
    z, explained = whitening_by_hand(x)
    k, n = z.shape[1], len(x)
    got = found[found.vec_id.isin(ids)].sort_values(["vec_id", "component"])
    assert len(got) == n * k and (got.n == n).all() and (got.identity_error <= 1e-9).all()
    mine = got.whitened.to_numpy().reshape(n, k)
    order = np.argsort(ids)
    sign = np.sign((mine * z[order]).sum(axis=0))
    assert np.abs(mine - sign * z[order]).max() < 1e-6
    assert np.allclose(got.explained.to_numpy().reshape(n, k)[0], explained, rtol=1e-9)
    whole = x.astype(np.int64).tolist()
    sums = [sum(column) for column in zip(*whole, strict=True)]
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in whole]
    for i, g in got.groupby("vec_id"):
        want = exact[list(ids).index(i)]
        assert {int(d) for d in g.deviation_exact} == {want}
        assert g.deviation.isna().all() if want >= 1 << 63 else {int(d) for d in g.deviation} == {want}


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(1)
    c = rng.normal(size=(300, 40)) @ np.diag(np.linspace(0.1, 9, 40)) + 5000
    short = rng.normal(size=(50, 3))
    rows = [(i, [float(v) for v in r], "clash") for i, r in enumerate(c)] + [(1000 + i, [float(v) for v in r], "") for i, r in enumerate(short)]
    rows += [(5000, None, ""), (5001, [], ""), (5002, [float("nan")] * 40, ""), (5003, [1.0, None, 2.0], ""), (5004, [float("inf")] * 40, ""), (5005, [4.0] * 7, "")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string").repartition(5)
    found = whitening.whiten(table).toPandas()
    check_whitened(found, np.arange(300), c)
    check_whitened(found, np.arange(1000, 1050), short)
    assert found.vec_id.max() < 5000
    assert whitening.whiten(table.limit(0)).count() == 0


def test_whitening_of_dependent_hot_repeated_and_far_rows(spark):
    rng = np.random.default_rng(2)
    c = rng.normal(size=(200, 6))
    c[:, 4] = c[:, 0]  # no direction of its own
    c[:, 5] = 3.0
    c[60:140] = c[60]
    c[:, 1] += 1e9
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(c)], "vec_id long, embedding array<double>").repartition(7)
    check_whitened(whitening.whiten(table).toPandas(), np.arange(200), c)
    ids = spark.createDataFrame([(None, [1.0, 2.0]), (None, [2.0, 1.0]), (3, [0.0, 0.5]), (3, [0.0, 0.5])], "vec_id long, embedding array<float>")
    found = whitening.whiten(ids).toPandas()
    assert found.vec_id.isna().sum() == 4 and (found.n == 4).all() and len(found) == 8
    far = spark.createDataFrame([(i, [1e18 * i, 1e300 if i else -1e300]) for i in range(4)], "vec_id long, embedding array<double>")
    assert whitening.whiten(far).count() >= 4


def test_jacobi_and_cholesky():
    rng = np.random.default_rng(3)
    for d in (1, 2, 5, 33):
        a = rng.normal(size=(d, d)) * np.logspace(0, -6, d)[:, None]
        v = a @ a.T
        left = whitening.pivoted_cholesky(v)
        assert np.allclose(left @ left.T, v, atol=1e-13 * v.max())
        values, unit = whitening.one_sided_jacobi(left)
        assert np.allclose(unit.T @ unit, np.eye(unit.shape[1]), atol=1e-12)
        assert np.allclose(values[:3], np.linalg.eigvalsh(v)[::-1][:3], rtol=1e-10)
    seen = [tuple(sorted(x)) for n in (7,) for p, q in whitening.rounds(n) for x in zip(p.tolist(), q.tolist(), strict=True)]
    assert sorted(seen) == [(i, j) for i in range(7) for j in range(i + 1, 7)]


def collocations_by_hand(rows, least, top=2000):
    f = defaultdict(Counter)
    for lang, text in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            for k in range(1, 6):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        n = sum(a for p, a in count.items() if len(p) == 1)
        phrases = {p: a for p, a in count.items() if a >= least and len(p) > 1}
        found = []
        for p, a in phrases.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in phrases.items()):
                continue
            score, k = min((1000 * a * n // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def sample_texts():
    rng = random.Random(5)
    words = ["a", "b", "New", "york", "ä", " x", "c\x1cd", "<s>", "the"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r"]) for _ in range(rng.randint(0, 80)))
        rows.append((rng.choice(["en", "de", None, "und"]), text if i % 15 else rng.choice([None, "", " \t "])))
    return rows + [("en", "one two three four five six " * 700)]


@pytest.mark.parametrize("bounds", [{}, {"most_words": 3}, {"most_phrases": 5}])
def test_collocations_against_brute_force(spark, bounds):
    rows = sample_texts()
    table = spark.createDataFrame([(*r, "clash") for r in rows], "lang string, text string, phrase string").repartition(4)
    found = sorted(map(tuple, collocations.collocations(table, least=9, **bounds).collect()))
    assert found == collocations_by_hand(rows, 9) and len(found) > 30


def test_collocations_cut_blocks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 37)
    monkeypatch.setattr(collocations, "BLOCK_IDS", 50)
    monkeypatch.setattr(collocations, "FLUSH_CODES", 20)
    monkeypatch.setattr(collocations, "FLUSH_WORDS", 5)
    rows = sample_texts()
    want = Counter(x for text in (t for _, t in rows) for part in collocations.tokens(text) for x in part)
    assert want == Counter(x for _, t in rows for x in (t or "").encode().translate(collocations.FOLD).replace(b",", b" , ").split())
    table = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert sorted(map(tuple, collocations.collocations(table, least=9, top=4).collect())) == collocations_by_hand(rows, 9, 4)
    assert collocations.collocations(table.limit(0)).count() == 0


def test_trie_finds_what_was_put_in():
    rng = np.random.default_rng(7)
    rows = np.unique(np.concatenate([np.stack([rng.zipf(1.4, 30_000) % 900 + 1, rng.zipf(1.2, 30_000) % 900 + 1], axis=1), np.stack([np.full(900, 4), np.arange(1, 901)], axis=1)]), axis=0).astype(np.int32)
    longer = np.unique(np.concatenate([rows[:3000], rng.integers(1, 901, (3000, 1))], axis=1), axis=0).astype(np.int32)
    trie = collocations.Trie(900, [rows, longer])
    for level in (rows, longer):
        states = level[:, 0].astype(np.int64)
        for i in range(1, level.shape[1]):
            states = collocations.step(trie.arrays(), states, level[:, i])
        assert (states > 900).all() and len(np.unique(states)) == len(level)
    pairs = set(map(tuple, rows.tolist()))
    other = rng.integers(1, 901, (20_000, 2))
    got = collocations.step(trie.arrays(), other[:, 0], other[:, 1]) > 0
    assert got.tolist() == [tuple(p) in pairs for p in other.tolist()]


def test_packing_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_tokenizer())
    rng = random.Random(2)
    texts = [None, "", " \n\t ", "NAÏVE café x\x1cy <|endoftext|> it's", "hot", "hot", "a b " * 30_000, "x" * 30_000, "é " * 4095]
    texts += [" ".join(rng.choice(["alpha", "Beta", "çok", "42", "!?"]) for _ in range(rng.randint(0, 900))) for _ in range(150)]
    rows = [(i, t, 7) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    found = packing.pack(table, group_docs=64).toPandas()
    want = {i: np.asarray([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in enumerate(texts)}
    assert found.length.sum() == sum(map(len, want.values()))
    for i, g in found.groupby("doc_id"):
        at = 0
        for r in g.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(want[i]) and r.ids_crc32 == zlib.crc32(want[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(want[i])
    ordered = found.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    sizes = found.groupby("sequence_id").length.sum()
    assert sizes.max() <= 4096 and all(s & (s - 1) == 0 for s in sizes)
    assert (sizes < 4096).sum() <= 12 * 4
    same = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c d"), (1, "c d")], "doc_id long, text string")
    assert packing.pack(same).agg({"length": "sum"}).first()[0] == 10
    assert packing.pack(table.limit(0)).count() == 0


def test_packing_in_slices_and_with_little_kept(monkeypatch):
    enc = packing.Encoder(packing.default_tokenizer())
    texts = [" ".join(f"Word{(i * k) % 97}, \u0301 <|startoftext|>x {i} é\n" for i in range(60 * k)) for k in range(1, 20)] + [None, "", "J\u030cx Σ", "<|endoftext|>"]
    monkeypatch.setattr(packing, "SLICE_CHARS", 3000)
    monkeypatch.setattr(packing, "MOST_KEPT", 10)
    for _ in range(2):
        for text, ids in zip(texts, enc.encode(texts), strict=True):
            assert ids == np.asarray(enc.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_first_fit_decreasing_takes_the_first_room():
    rng = random.Random(9)
    for n in (1, 2, 3, 50, 200):
        sizes = sorted((rng.randint(1, 100) for _ in range(n)), reverse=True)
        bins, room = [], []
        for i, size in enumerate(sizes):
            at = next((k for k, r in enumerate(room) if r >= size), len(room))
            if at == len(room):
                bins.append([])
                room.append(100)
            bins[at].append(i)
            room[at] -= size
        assert packing.first_fit(sizes, 100) == bins
        full = packing.fill_up([[(i, 0, sizes[i]) for i in b] for b in bins], 100)
        loads = [sum(p[2] for p in s) for s in full]
        assert sum(loads) == sum(sizes) and all(x == 100 or x & (x - 1) == 0 for x in loads)
        cut = defaultdict(list)
        for s in full:
            for item, start, length in s:
                cut[item].append((start, length))
        for item, parts in cut.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at and length > 0
                at += length
            assert at == sizes[item]


def test_lines_of_a_family_in_the_pipeline_are_decided_in_two_comparisons(spark, monkeypatch):
    """The second stage on lines around one: linked ones go, all others stay, whatever the size of the family."""
    import corpus_pipeline
    from barloom.llm import lines

    rng = random.Random(51)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    base = [word() for _ in range(50)]
    # one other word links to the base, a word in three to nothing
    near = [" ".join(word() if i == n % 50 else w for i, w in enumerate(base)) for n in range(60)]
    far = [" ".join(word() if rng.random() < 0.33 else w for w in base) for _ in range(60)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([" ".join(base), *near, *far])]
    asked, similar = [], lines.similar
    monkeypatch.setattr(lines, "similar", lambda *a: asked.append(1) or similar(*a))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.line_dedup(spark, table, "").collect()
    assert sorted(r["doc_id"] for r in out) == [0, *range(61, 121)] and {r["doc_id"]: r["text"] for r in out}[100] == rows[100][1]
    assert len(asked) == 2
