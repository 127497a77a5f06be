import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideflow.llm import suffix_dedup as sd


def brute_kept(texts, length):
    """The bytes that are left of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = {k for i in range(len(d) - length + 1) if seen[d[i : i + length]] > 1 for k in range(i, i + length)}
        out.append(bytes(b for k, b in enumerate(d) if k not in gone))
    return out


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def sample(rng, length):
    words = ["".join(rng.choice(list("abcé"), rng.integers(1, 6))) for _ in range(12)]
    passage = [" ".join(rng.choice(words, rng.integers(4, 40))) for _ in range(5)]
    texts = [None, "", "a", "ab" * (2 * length), "é" * length, " " * (3 * length)]
    for _ in range(40):
        parts = [" ".join(rng.choice(words, rng.integers(1, 60)))]
        for p in rng.choice(passage, rng.integers(0, 3)):
            cut = rng.integers(0, max(1, len(p) // 2))
            parts += [p[cut:], " ".join(rng.choice(words, rng.integers(0, 12)))]
        texts.append("".join(parts))
    return texts + texts[6:9]


@pytest.mark.parametrize("seed,bucket", [(1, 16000), (2, 40), (3, 2), (4, 1)])
def test_against_every_window(spark, seed, bucket):
    rng = np.random.default_rng(seed)
    settings = sd.Settings(length=24, token=8, bucket=bucket)
    texts = sample(rng, settings.length)
    ids = [None, *range(1, len(texts))]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids, texts)], "doc_id long, text string, token string, start string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.report(docs, settings).collect()}
    assert got == dict(zip(ids, brute(texts, settings.length)))
    assert sum(x[1] for x in got.values()) > 0


def test_repeated_rows_and_removal(spark):
    rng = np.random.default_rng(5)
    settings = sd.Settings(length=24, token=8)
    texts = sample(rng, 24)
    rows = [(i, t, 0, f"s{i}") for i, t in enumerate(texts)] + [(7, texts[7], 0, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, source string")
    want = brute([r[1] for r in rows], 24)
    got = sd.report(docs, settings).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in got) == sorted((r[0], w[1], w[3]) for r, w in zip(rows, want))
    left = sd.removed(docs, settings)
    assert left.columns == docs.columns and left.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    for row in left.collect():
        if row.text is not None:
            assert row.n_chars == len(row.text)
    clashing = docs.withColumns({n: F.lit("x") for n in ("own", "text_hash", "__z", "spans", "__text", "__null")})
    assert sd.removed(clashing, settings).columns == clashing.columns
    assert sorted((r.doc_id, r.text or "", r.own) for r in sd.removed(clashing, settings).collect()) == sorted((r.doc_id, r.text or "", "x") for r in left.collect())


@pytest.mark.parametrize("length,token", [(400, 64), (100, 16), (61, 32)])
def test_other_lengths(spark, length, token):
    rng = np.random.default_rng(9)
    texts = sample(rng, length)
    long = "".join(rng.choice(list("abcdefgh"), 500))
    texts += [long + "1" * 90, "2" * 77 + long, long[50:480]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.report(docs, sd.Settings(length, token, bucket=50)).collect()}
    assert got == dict(enumerate(brute(texts, length))) and got[len(texts) - 1][1] > 0


def test_documents_at_the_contract_length(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in rows], brute([r.text for r in rows], 200)))
    for bucket in (16_000, 25):
        got = sd.report(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), sd.Settings(bucket=bucket)).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_a_crowded_token_is_divided():
    """One passage with other words round it in each text: each context once, buckets of bounded size, classes compared across them."""
    rng = np.random.default_rng(3)
    passage = "".join(rng.choice(list("abcdefgh"), 30))
    texts = ["".join(rng.choice(list("xyz"), 30)) + passage + "".join(rng.choice(list("uvw"), 30)) for _ in range(60)]
    texts[7] = texts[50][:40] + texts[7][40:]
    data = [t.encode() for t in texts]
    settings = sd.Settings(length=24, token=8)
    cut = []
    for _, _, parts in sd.pieces(data, settings):
        part, start, count, away, _ = sd.anchors_of(parts, settings)
        cut += [(parts[p][a : a + k + 23], w) for p, a, k, w in zip(part, start, count, away)]
    cut = sorted(set(cut), key=lambda c: (c[0][c[1] :], c[0][: c[1]][::-1]))

    same = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    halves = [(c[w : w + 8], c[:w][::-1]) for c, w in cut]
    reach = np.array([max((same(b, d) for k, (t, d) in enumerate(halves) if k != i and t == token), default=0) for i, (token, b) in enumerate(halves)])

    def ranges(size):
        found, classes, most = {}, {}, 0
        for at in range(0, len(cut), size):
            rows = cut[at : at + size]
            most = max(most, len(rows))
            low, high, (owner, window, alone) = sd.solve([c for c, _ in rows], np.array([w for _, w in rows]), reach[at : at + size], np.zeros(len(rows), bool), settings, True, True)
            for k, (a, b) in enumerate(zip(low, high)):
                if b >= 0:
                    found.setdefault(at + k, set()).update((a, b))
            for i, w in zip(owner.tolist(), window.tolist()):
                classes.setdefault((rows[i][0][w : w + 24], rows[i][1] - w), []).append((at + i, w))
        for members in classes.values():
            for i, w in members if len(members) > 1 else ():
                found.setdefault(i, set()).add(w)
        return {i: (int(min(x)), int(max(x))) for i, x in found.items()}, most

    whole, most = ranges(len(cut))
    assert most == len(cut)
    for size in (200, 20, 3):
        assert ranges(size) == (whole, min(size, len(cut)))


def test_reaches(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(4)), k, bytes(rng.choice([97, 98], rng.integers(0, 12)).astype(np.uint8))) for k in range(400)]
    df = spark.createDataFrame([(t, k, len(b), False, bytearray(b), bytearray(b)) for t, k, b in rows], "token long, context long, away int, again boolean, data binary, before binary")
    got = {r.context: r for r in sd.reaches(df, sd.Settings(length=24, token=8)).collect()}
    assert len(got) == 400
    same = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    exact = 0
    for t, k, b in rows:
        want = max(same(b, c) for u, j, c in rows if j != k and u == t)
        assert want <= got[k].reach <= len(b) and bytes(got[k].data) == b
        exact += want == got[k].reach
    assert exact >= 400 - 2 * 4


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    strings = [bytes(rng.choice([97, 98, 255], rng.integers(0, 30)).astype(np.uint8)) for _ in range(500)]
    words, run = sd.padded_words(strings, 30), rng.integers(0, 3, 500)
    order = sd.multikey_quicksort(words, run)
    keys = [(int(run[i]), strings[i].ljust(32, b"\0")) for i in order]
    assert keys == sorted(keys)
    common = sd.shared_with_last(words, order)
    for (_, a), (_, b), n in zip(keys, keys[1:], common[1:]):
        assert n == next((k for k in range(32) if a[k] != b[k]), 32)


def test_settings_that_cannot_work_are_refused():
    for bad in ({"token": 48}, {"length": 10, "token": 16}):
        with pytest.raises(ValueError):
            sd.Settings(**bad)


def test_repeats_of_one_row_give_its_spans_once(spark):
    docs = spark.createDataFrame([(None, "ab" * 200)] * 50 + [(0, "ab" * 200)], "doc_id long, text string")
    spans = sd.covers(docs).collect()
    assert len(spans) == 2 and max(len(r.spans) for r in spans) < 300
    assert all(r.n_removed == 400 for r in sd.report(docs).collect())


def test_long_text_in_parts():
    settings = sd.Settings(length=24, token=8)
    text = bytes(np.random.default_rng(0).integers(97, 101, 5000, dtype=np.uint8))
    whole = [x for _, _, parts in sd.pieces([text], settings) for x in zip(*map(list, sd.anchors_of(parts, settings)))]
    places = []
    for _, offsets, parts in sd.pieces([text], settings, most=700):
        for p, start, count, away, token in zip(*map(list, sd.anchors_of(parts, settings))):
            places += [(offsets[p] + start + k, offsets[p] + start + away) for k in range(count)]
    assert sorted(places) == sorted((s + k, s + a) for _, s, c, a, _ in whole for k in range(c))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sd.report(docs).count() == 0
    assert sd.removed(docs).count() == 0
