"""SimHash, whitening and token alignment against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from fundlens.llm import queries, simhash, token_align, vocabulary, whitening

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


# ---- SimHash ------------------------------------------------------------------------------


def brute_fingerprint(text, k=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(monkeypatch):
    r = random.Random(1)
    texts = [None, "", " \n", "a", "A b", "A  b\tC", "Ä Ö \x85 ü" * 9, "x y " * 300, "  ".join(r.choice(["ab", "CD", "e", "longer" * 9]) for _ in range(800))]
    for piece in (1 << 20, 40, 1):
        monkeypatch.setattr(simhash, "PIECE", piece)
        for t in texts:
            assert simhash.fingerprint(None if t is None else t.encode()) == brute_fingerprint(t)


def near_codes(r, n=300):
    """Codes with many near ones: a few bits flipped in some centres, and unrelated codes."""
    centres = [r.getrandbits(64) for _ in range(3)] + [0, 2**64 - 1, 1 << 63]
    codes = {c ^ sum({1 << r.randrange(64) for _ in range(r.randrange(5))}) for c in centres for _ in range(n // 6)}
    return sorted(codes | {r.getrandbits(64) for _ in range(n // 4)})


def test_gray_index_finds_every_pair():
    codes = np.array(near_codes(random.Random(2)), np.uint64)
    rank = codes.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    codes = codes[np.argsort(rank)]
    starts = np.array([0, 1, 90, 91, len(codes)])
    group = np.repeat(np.arange(4), np.diff(starts))
    for distance in (0, 1, 2, 5):
        got = [(a, b) for i, j in simhash.GrayIndex(codes, starts).links(distance) for a, b in zip(i.tolist(), j.tolist())]
        want = {(a, b) for a in range(len(codes)) for b in range(a + 1, len(codes)) if group[a] == group[b] and int(codes[a] ^ codes[b]).bit_count() <= distance}
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("group", [4096, 4])
def test_fingerprint_links(spark, group, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", group)  # small groups are dealt again to the last level
    codes = near_codes(random.Random(3))
    ids = list(range(len(codes)))
    df = spark.createDataFrame([(c - 2**64 if c >> 63 else c, i) for i, c in enumerate(codes)], "fp long, node long")
    pairs = [(r.a, r.b) for r in simhash.fingerprint_links(df).collect()]
    assert all((codes[a] ^ codes[b]).bit_count() <= 64 for a, b in pairs)
    linked = set(pairs) | {(b, a) for a, b in pairs}
    assert components(ids, lambda a, b: (a, b) in linked) == components(ids, lambda a, b: (codes[a] ^ codes[b]).bit_count() <= 2)


def test_simhash_documents(spark):
    r = random.Random(4)
    base = [[f"v{r.randrange(9999)}" for _ in range(r.choice((5, 60, 3000)))] for _ in range(12)]
    rows = [(10 * i + j, " ".join(["other" if r.random() < 0.003 * j else x for x in b])) for i, b in enumerate(base) for j in range(4)]
    rows += [(900, None), (901, ""), (902, "\n"), (903, "ONE"), (904, "one"), (None, "one"), (0, rows[0][1]), (905, "x " * 200_000)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, fp int, `a.b` int")
    got = simhash.near_duplicates(df).collect()
    fp = {i: brute_fingerprint(t) for i, t in rows if i is not None}
    want = components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert Counter(x.doc_id for x in got) == Counter(i for i, _ in rows)
    for x in got:
        assert x.fingerprint == f"{fp[904 if x.doc_id is None else x.doc_id]:016x}" and x.component_id == want.get(x.doc_id)
    assert want[901] == 900 and want[904] == 903 and len(set(want.values())) < len(want) - 10
    assert simhash.near_duplicates(df.limit(0)).count() == 0


# ---- whitening ----------------------------------------------------------------------------


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_spectrum_of_blocks(d):
    r = np.random.default_rng(d)
    for trial in range(9):
        whole, parts = [], [whitening.Spectrum.empty(d) for _ in range(3)]
        for n in (1, 2, d, 150):
            x = np.floor(256 * r.normal(size=(n, d)) * 10.0 ** r.integers(-2, 3, size=d))
            if trial % 3 == 1:
                x[:, : d // 2 + 1] = 5  # dimensions without variance
            if trial % 3 == 2:
                x = np.repeat(x[:1], n, 0) * (np.arange(n) % 2)[:, None]  # rank one
            parts[n % 3].add_rows(x)
            whole.append(x)
        total = whitening.Spectrum.empty(d)
        for p in parts:
            total.add(whitening.Spectrum.read(p.write()))
        x = np.concatenate(whole)
        scatter = (x - x.mean(0)).T @ (x - x.mean(0))
        found = total.vectors @ np.diag(total.values) @ total.vectors.T
        assert total.rows == len(x) and np.allclose(total.mean, x.mean(0))
        assert np.abs(found - scatter).max() <= 1e-9 * max(1, np.abs(scatter).max())  # the last pass refines it
        assert np.abs(total.vectors.T @ total.vectors - np.eye(d)).max() < 1e-10


def test_secular_roots_against_eigenvalues():
    r = np.random.default_rng(5)
    poles, z2 = np.sort(r.normal(size=12)), r.random(12)
    nearest, offset = whitening.secular_roots(poles, z2, 2.5)
    want = np.linalg.eigvalsh(np.diag(poles) + 2.5 * np.outer(np.sqrt(z2), np.sqrt(z2)))
    assert np.allclose(poles[nearest] + offset, want, atol=1e-12)


def brute_whitening(rows, k=4):
    x = {i: np.floor(256 * np.array(v, np.float64)).astype(np.int64) for i, v in rows}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("source", ["table", "made"])
def test_whitening(spark, source, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)  # a deep tree
    monkeypatch.setattr(whitening, "BLOCK", 37)
    if source == "table":
        df = spark.read.parquet(f"{SF}/embeddings.parquet")
        rows = [(r.vec_id, r.embedding) for r in df.collect()]
        got = queries.QUERIES["op12_whitening"](spark, SF).collect()
    else:
        r = random.Random(6)
        rows = [(i, [r.gauss(0, s) for s in (3, 1, 0.5, 0.2, 0.1)]) for i in range(200)]
        rows += [(500 + i, rows[0][1]) for i in range(300)]  # copies count once
        odd = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0]), (903, [float("nan")] * 5), (904, [float("inf")] * 5), (905, [1e30] * 5), (906, [1.0])]
        df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, x string").repartition(7)
        got = whitening.whiten_embeddings(df).collect()
    x, n, sums, values, vectors = brute_whitening(rows)
    by = {(g.vec_id, g.component): g for g in got}
    assert len(by) == len(got) == 4 * len(rows)
    for c in range(4):
        z = {i: (v - sums / n) @ vectors[:, c] / np.sqrt(values[c]) for i, v in x.items()}
        sign = np.sign(sum(z[i] * by[i, c + 1].whitened for i in z))
        for i in z:
            g = by[i, c + 1]
            assert abs(sign * g.whitened - z[i]) < 1e-9 and g.n == n and g.deviation == int(((n * x[i] - sums) ** 2).sum())
            assert abs(g.explained - values[c] / values.sum()) < 1e-12 and 0 <= g.identity_error < 1e-9


def test_whitening_of_few_vectors(spark):
    table = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten_embeddings(table([])).count() == 0
    assert whitening.whiten_embeddings(table([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    flat = whitening.whiten_embeddings(table([(1, [1.0, 2.0]), (2, [2.0, 2.0]), (None, [3.0, 2.0])])).collect()
    assert [r.component for r in flat] == [1, 1, 1] and {r.vec_id for r in flat} == {1, 2, None} and flat[0].explained == pytest.approx(1)
    large = whitening.whiten_embeddings(table([(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [0.0, 0.5])])).collect()
    assert {r.vec_id: r.deviation is None for r in large} == {1: True, 2: True, 3: False}


# ---- token alignment ----------------------------------------------------------------------


def brute_alignment(text, a_model, b_model):
    """(A ids, B ids, groups) with the libraries alone."""
    if not text:
        return [], [], []
    letters = {chr(b) if c is None else c: b for c, b in vocabulary._byte_letters().items()}
    a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
    a_bytes = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b_model.id_to_piece, b)]
    whole = b" " + text.encode()
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return [], [], []
    a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
    groups, i, j = [], 0, 0
    for end in sorted(set(a_ends) & set(b_ends)):
        k, m = a_ends.index(end) + 1, b_ends.index(end) + 1
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    return a, b, groups


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(token_align.BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=token_align.PIECE_BPE)


ODD = [
    None, "", " ", "a", "▁x", "<|endoftext|> <s></s> hi", "é́ 日本語 🙂🙂 ​\x00\x1c\x85 a", "  two  spaces \n\n\t x", "ᏣᎳᎩ Ａ１ ①½ �", " " * 9000 + "x" * 9000,
    "ﬁ Å Ⅷ", "\r\n a\r\n", "a\t" + "　" * 5000 + "'s ok" + " \n" * 3000 + " z", "the same the same the same",
]


def test_gallop():
    r = random.Random(7)
    ends = np.array(sorted(r.sample(range(10_000), 900)))
    wanted = np.array([r.randrange(-5, 10_010) for _ in range(2000)])
    start = np.array([r.randrange(900) for _ in wanted])
    assert (token_align.gallop(ends, wanted, start) == np.searchsorted(ends, wanted)).all()


@pytest.mark.parametrize("heavy", [1 << 20, 50])
def test_alignment(spark, models, heavy, monkeypatch):
    monkeypatch.setattr(token_align, "HEAVY", heavy)  # most pairs are joined, not broadcast
    monkeypatch.setattr(token_align, "SLICE_CHARS", 3000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [*rows, *((-i, t) for i, t in enumerate(ODD, 1)), (-1, None), (None, "no id"), rows[0]]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, row int, `a.b` int")
    found = [brute_alignment(t, *models) for _, t in rows]
    count = Counter((a[-1], b[-1]) for *_, groups in found for a, b in groups)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    want = Counter()
    for (i, _), (a, b, groups) in zip(rows, found):
        links = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        want[i, len(a), len(b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), digest] += 1
    got = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in token_align.align_corpus(df).collect())
    assert got == want
    assert token_align.align_corpus(df.limit(0)).count() == 0


def test_token_groups(spark, models):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    rows = {r.doc_id: r for r in token_align.token_groups(df).collect()}
    for i, text in enumerate(ODD):
        a, b, groups = brute_alignment(text, *models)
        assert (rows[i].a_ids, rows[i].b_ids) == (a, b)
        assert rows[i].a_ends == np.cumsum([len(x) for x, _ in groups]).tolist() and rows[i].b_ends == np.cumsum([len(y) for _, y in groups]).tolist()
