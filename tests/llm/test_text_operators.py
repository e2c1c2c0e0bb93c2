"""Operators 1, 2, 5, 6, 8 against brute force, the tokenizers library and round trips."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from quarrylight.llm import bpe, fingerprints, packing, quality, token_counts
from quarrylight.llm.queries import QUERIES

from .fixtures import documents, empty, rows

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_bpe_matches_the_library_on_odd_text(library):
    ours, fast, r = bpe.Encoder(PATH), bpe.LibraryIds(PATH), random.Random(2)
    pool = ["<|startoftext|>", "<|endoftext|>", "<|", "'s", "'ll", "'RE", "İ", "Σ", "ΑΣ ", "\x1c", "\x85", "\xa0", "é", "e\u0301", "ﬁ", "१", "漢字", "😀", "\u200b", "the ", "ing", "123", "!!", "\n", "ſ", "ß", "aaaa", "haha", "\ufeff"]
    texts = ["", " ", "a" * 3000]
    for _ in range(4000):
        texts.append("".join(r.choice(pool) if r.random() < 0.6 else chr(r.choice([r.randrange(32, 0x250), r.randrange(32, 0xD800), r.randrange(0xE000, 0x1FB00)])) for _ in range(r.randrange(14))))
    for t, quick in zip(texts, fast.encode_all(texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        got = ours.encode(t)
        assert list(array("I", got)) == want, ascii(t)
        assert quick == got
        assert ours.decode(got) == library.decode(want, skip_special_tokens=False)


def test_bpe_query_over_awkward_rows(spark, library):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(documents(spark), PATH).collect())
    want = []
    for d, t, *_ in rows():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d is None, d or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode_documents(empty(spark), PATH).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_fingerprints_follow_the_order_of_ids(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = fingerprints.fingerprint_documents(documents(spark)).collect()
        assert fingerprints.fingerprint_documents(empty(spark)).count() == 0
        alone = fingerprints.fingerprint_documents(documents(spark).where("doc_id = 21")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(((d is not None, d or 0, t or ""), d, t or "") for d, t, *_ in rows())
    texts = [t for _, _, t in order]
    want = []
    for (_, d, t), following in zip(order, texts[1:] + texts[:1], strict=True):
        k = len(t) // 2
        e = t[: len(t) - k] + following[:k]
        a, b, c = (fingerprints.fingerprints([x.encode()])[0] for x in (t, e, following))
        want.append((str(d), len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.render(a), fingerprints.render(b), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    assert sorted((str(r[0]), *r[1:]) for r in found) == sorted(want)
    assert len(alone) == 1 and alone[0].near_next == 1.0


def plain_chunks(text):
    """Byte by byte: the hash of the last 16 bytes, a strict test up to the target length, a loose one after it."""
    chunks, begin = [], 0
    for i in range(len(text)):
        h = sum(int(fingerprints.GEAR[text[i - j]]) << j for j in range(min(16, i + 1))) & 0xFFFF
        size = i + 1 - begin
        zero_bits = 6 if size < fingerprints.TARGET else 4
        if size == fingerprints.LARGEST or (size >= fingerprints.SMALLEST and h >> (16 - zero_bits) == 0):
            chunks.append(text[begin : i + 1])
            begin = i + 1
    return chunks + ([text[begin:]] if begin < len(text) else [])


def test_chunks_and_weights_against_a_plain_chunker():
    r = random.Random(9)
    texts = [(t or "").encode() for _, t, *_ in rows()] + [bytes(r.randrange(256) for _ in range(n)) for n in (1, 7, 8, 31, 129, 5000)]
    for text, cuts, weights in zip(texts, fingerprints.boundaries(texts), fingerprints.fingerprints(texts), strict=True):
        chunks = plain_chunks(text)
        assert cuts == np.cumsum([len(c) for c in chunks]).tolist()
        want = {}
        for c in chunks:
            want[xxhash.xxh3_64_intdigest(c)] = want.get(xxhash.xxh3_64_intdigest(c), 0) + len(c)
        assert dict(weights) == want


def test_ridge_and_scores_against_plain_numpy(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    known = {}
    for r in labels.collect():
        known.setdefault(r.doc_id, set()).add(r.quality)
    fitted = [(r.doc_id, r.text or "", *known[r.doc_id]) for r in docs.collect() if known.get(r.doc_id) in ({0}, {1})]
    x = quality.statistics(pa.array([t for _, t, _ in fitted]))
    y, fold = np.array([float(q) for *_, q in fitted]), np.array([quality.fold_of(d, quality.FOLDS) for d, *_ in fitted])
    z = np.clip((x - x.mean(0)) / np.maximum(x.std(0), 1e-6), -8, 8)
    p = np.hstack([np.ones((len(z), 1)), z, np.sqrt(2 / quality.FEATURES) * np.cos(z @ model.waves + model.shift)])
    ridge = quality.RIDGE * np.eye(p.shape[1])
    ridge[0, 0] = 1e-6
    solve = lambda rows: np.linalg.solve(p[rows].T @ p[rows] + ridge, p[rows].T @ y[rows])
    assert np.allclose(model.weights, solve(np.ones(len(y), bool)), atol=1e-6)
    apart = np.zeros(len(y))
    for k in range(quality.FOLDS):
        apart[fold == k] = p[fold == k] @ solve(fold != k)
    got = {r.doc_id: r.score for r in quality.score_documents(docs, model).collect()}
    # isotonic regression by its min-max formula, over mean values of ranges in order of the held-out raw scores
    order = np.argsort(apart, kind="stable")
    sums = np.concatenate([[0], np.cumsum(y[order])])
    n = len(y)
    fit = [max(min((sums[b] - sums[a]) / (b - a) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)]
    raw = p @ model.weights
    want = np.clip(np.interp(raw, apart[order], fit), 0, 1)
    assert np.abs(np.array([got[d] for d, *_ in fitted]) - want).max() < 1e-4


def test_fingerprints_resist_shifts():
    r = random.Random(4)
    text = bytes(r.randrange(97, 123) for _ in range(20000))
    one, two = fingerprints.fingerprints([text, b"shifted " + text])
    assert fingerprints.likeness(one, two) > 0.99 and sum(one.values()) == len(text)
    assert fingerprints.parse(fingerprints.render(one)) == one
    cuts = fingerprints.boundaries([text])[0]
    sizes = np.diff([0, *cuts])
    assert sizes.max() <= fingerprints.LARGEST and sizes[:-1].min() >= fingerprints.SMALLEST
    other = bytes(r.randrange(97, 123) for _ in range(20000))
    assert fingerprints.likeness(one, fingerprints.fingerprints([other])[0]) == 0
    assert fingerprints.fingerprints([b"", text])[1] == one and not fingerprints.fingerprints([b""])[0]


def test_packing_puts_every_id_in_one_piece(spark, library):
    found = packing.pack_documents(documents(spark).coalesce(1), PATH, capacity=64, keep_ids=True).collect()
    want = sorted((str(d), tuple(library.encode(t or "", add_special_tokens=False).ids + [1])) for d, t, *_ in rows())
    by_sequence = {}
    for p in found:
        assert p.ids_crc32 == zlib.crc32(p.ids) and len(p.ids) == 4 * p.length
        by_sequence.setdefault(p.sequence_id, []).append(p)
    used = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64
        used += at
    assert len(by_sequence) * 64 - used < 64
    ids = sorted(x for p in found for x in array("I", p.ids))
    assert ids == sorted(x for _, w in want for x in w)
    # documents whose id is theirs alone can be put together again
    single = [d for d in {w[0] for w in want} if sum(x[0] == d for x in want) == 1]
    for d in single:
        pieces = sorted((p for p in found if str(p.doc_id) == d), key=lambda p: p.start)
        assert tuple(x for p in pieces for x in array("I", p.ids)) == next(w for k, w in want if k == d)
    assert packing.pack_documents(empty(spark), PATH).count() == 0


def test_pack_balances_cost():
    r = random.Random(5)
    lengths = [r.randrange(1, 3000) for _ in range(400)]
    pieces = packing.pack(lengths)
    cost = {}
    for _, _, n, s, _ in pieces:
        cost[s] = cost.get(s, 0) + n + n * n / 1024
    assert sum(p[2] for p in pieces) == sum(lengths)
    assert (max(p[3] for p in pieces) + 1) * 2048 - sum(lengths) < 2048


def test_token_totals_are_idempotent(spark, tmp_path, library):
    store = token_counts.TokenTotals(spark, f"file://{tmp_path}/t")
    assert store.totals().count() == 0
    counts = token_counts.count_tokens(documents(spark), PATH, "v1")
    length = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)

    def total(kept):
        out = {}
        for version, (d, t, lang, source, *_) in kept:
            n = out.setdefault((source, lang, version), [0, 0])
            n[0] += 1
            n[1] += length(t)
        return {k: tuple(v) for k, v in out.items()}

    def now():
        return {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in store.totals().collect()}

    assert store.apply("a", counts) and not store.apply("a", counts)
    assert now() == total([("v1", r) for r in rows()])
    gone = spark.createDataFrame([(21,), (30,), (None,), (999,)], "doc_id long")
    changed = documents(spark).where("doc_id in (6, 7, 24)")
    assert store.apply("b", token_counts.count_tokens(changed, PATH, "v2"), gone) and not store.apply("b", counts, gone)
    keep = [("v2" if r[0] in (6, 7, 24) else "v1", r) for r in rows() if r[0] not in (21, 30)]
    assert now() == total(keep)
    assert token_counts.TokenTotals(spark, store.root).totals().count() == len(total(keep))
    assert store.apply("c", None, spark.createDataFrame([(r[0],) for r in rows()], "doc_id long"))
    assert now() == total([x for x in keep if x[1][0] is None])


def test_token_count_query(spark, sf, library):
    found = QUERIES["op6_token_counts"](spark, sf).collect()
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    toxic = {r.doc_id for r in labels if r.toxic == 1}
    poor = {r.doc_id for r in labels if r.quality == 0} - toxic
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if r.doc_id in toxic:
            continue
        words = r.doc_id in poor
        size = len((r.text or "").encode().split()) if words else len(library.encode(r.text or "", add_special_tokens=False).ids)
        total = want.setdefault((r.source, r.lang, "words" if words else "word_bpe_49k"), [0, 0])
        total[0] += 1
        total[1] += size
    assert {(r.source, r.lang, r.tokenizer_version): [r.n_docs, r.n_tokens] for r in found} == want


def test_batch_ids_of_any_form(spark, tmp_path):
    store = token_counts.TokenTotals(spark, f"file://{tmp_path}/t")
    row = lambda d: spark.createDataFrame([(d, "s", "en", "v", 2)], "doc_id long, source string, lang string, tokenizer_version string, n_tokens long")
    ids = ["2024/01", "2024", "a@b", "..", "ü %2F", "2024%2F01"]
    for i, name in enumerate(ids):
        assert store.apply(name, row(i)) and not store.apply(name, row(i))
    assert set(store.batches()) == set(ids) and [tuple(r)[-2:] for r in store.totals().collect()] == [(len(ids), 2 * len(ids))]
    with pytest.raises(ValueError, match="id"):
        store.apply("", row(1))


def test_token_counts_of_empty_tables(spark, tmp_path):
    store = token_counts.TokenTotals(spark, f"file://{tmp_path}/t")
    assert store.apply("none", token_counts.count_tokens(empty(spark), PATH, "v"), empty(spark).select("doc_id"))
    assert store.totals().count() == 0 and store.state().count() == 0


def test_isotonic_is_the_monotone_least_squares_fit():
    knots, levels = quality.isotonic(np.array([3.0, 1, 2, 4, 5]), np.array([0.0, 0, 1, 1, 1]))
    assert np.allclose(np.interp([1, 2, 3, 4, 5], knots, levels), [0, 0.5, 0.5, 1, 1]) and (np.diff(levels) >= 0).all()


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    x, waves, shift = rng.normal(size=(30, 5)), rng.normal(0, 0.5, (5, 20000)), rng.uniform(0, 2 * np.pi, 20000)
    f = quality.fourier(x, waves, shift)[:, 6:]
    want = np.exp(-0.125 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(f @ f.T - want).max() < 0.05


def test_quality_on_held_out_labels(spark):
    import duckdb

    sf = "/root/testdata/sf0.1"
    scored = QUERIES["op2_quality_classifier"](spark, sf).toPandas()  # noqa: F841
    held, right, low, caught = duckdb.sql(
        f"select count(*), avg((predicted = quality)::int), sum((quality = 0)::int), sum((quality = 0 and predicted = 0)::int) from scored join '{sf}/labels.parquet' using (doc_id) where held_out"
    ).fetchall()[0]
    assert held > 500 and right > 0.9 and caught / low > 0.5


def test_quality_over_awkward_rows(spark):
    labels = spark.createDataFrame([(21, 1), (21, 1), (24, 0), (30, 1), (27, 0), (45, 0), (48, 0), (None, 1), (3, None), (36, 0), (36, 1), (888, 1)], "doc_id long, quality int")
    model = quality.fit(documents(spark), labels)
    out = quality.score_documents(documents(spark), model).collect()
    assert len(out) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in out)
    nothing = quality.fit(empty(spark), labels)
    assert {r.score for r in quality.score_documents(documents(spark), nothing).collect()} == {0.5}
    assert {r.score for r in quality.score_documents(documents(spark), quality.fit(documents(spark), labels.where("quality = 1"))).collect()} == {1.0}
    assert quality.score_documents(empty(spark), model).count() == 0
