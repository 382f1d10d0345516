"""Embedding near-dedup (2), SimHash (8) and winnowing (10) against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vantage.llm import mixing, simhash, winnowing
from vantage.llm.common import components
from vantage.llm.vector_dedup import vector_components


def groups(n, links):
    lab = list(range(n))
    for a, b in links:
        x, y = lab[a], lab[b]
        if x != y:
            lab = [min(x, y) if v in (x, y) else v for v in lab]
    return lab


@pytest.mark.parametrize("small", [0, 10**6])
def test_components(spark, small):
    r = random.Random(1)
    n = 120
    links = [(r.randrange(n), r.randrange(n)) for _ in range(90)] + [(i, i + 1) for i in range(60, 90)]
    got = {x.node: x.comp for x in components(spark.createDataFrame(links, "a bigint, b bigint"), small).collect()}
    want = groups(n, links)
    seen = {v for a, b in links if a != b for v in (a, b)}
    assert set(got) == seen
    by = {}
    for v in seen:
        by.setdefault(want[v], set()).add(got[v])
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)


# --- embeddings

def brute_vectors(rows, t):
    ok = [k for k, (i, v, _) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for a in range(len(ok)):
        for b in range(a + 1, len(ok)):
            x, y = (np.asarray(rows[ok[k]][1], np.float32).astype(float) for k in (a, b))
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= t:
                links.append((ok[a], ok[b]))
    lab = groups(len(rows), links)
    out = []
    for k, (i, _, _) in enumerate(rows):
        comp = min((rows[m][0] for m in range(len(rows)) if lab[m] == lab[k] and rows[m][0] is not None), default=None)
        out.append((i, sum(k in x for x in links), comp, i is not None and i == comp))
    return sorted(out, key=str)


@pytest.mark.parametrize("dim,block,tile", [(12, 4, 7), (10, 3, 1000), (64, 16, 40)])
def test_vectors_equal_brute_force(spark, dim, block, tile):
    rng = np.random.default_rng(dim)
    base = rng.standard_normal((12, dim))
    rows = []
    for k in range(160):
        v = base[k % 12] if k % 3 else base[0]
        noise = rng.standard_normal(dim) * (0.45 * np.linalg.norm(v) / np.sqrt(dim)) * rng.random()
        rows.append([1000 - k, (v + noise).tolist(), 1])
    rows += [[5, rows[0][1], 1], [6, rows[0][1], 2], [6, rows[0][1], 2], [7, [2 * x for x in rows[3][1]], 1], [8, None, 1], [9, [0.0] * dim, 1],
             [10, [float("nan")] * dim, 1], [11, [None] + [1.0] * (dim - 1), 1], [12, [float("inf")] + [1.0] * (dim - 1), 1], [13, [1.0] * (dim + 1), 1],
             [None, rows[0][1], 1], [14, [], 1]]
    df = spark.createDataFrame([tuple(x) for x in rows], "vec_id bigint, embedding array<float>, cid int")
    got = vector_components(df, threshold=0.9, block_dim=block, tile_rows=tile).collect()
    assert sorted(map(tuple, got), key=str) == brute_vectors(rows, 0.9)
    assert any(x.n_links > 3 for x in got)


def test_no_vectors(spark):
    assert vector_components(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


# --- SimHash

def brute_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    r = random.Random(5)
    for _ in range(60):
        t = "".join(r.choice("aB é\t\nİ.,z ") for _ in range(r.randrange(80)))
        assert simhash.simhash_text(t) & (1 << 64) - 1 == brute_fingerprint(t), repr(t)


@pytest.mark.parametrize("bits,segments,bucket", [(2, 2, 64), (2, 2, 2), (3, 4, 64), (5, 2, 10**6), (1, 4, 1), (0, 1, 64)])
def test_links_equal_brute_force(spark, bits, segments, bucket):
    if bits == 5 and bucket < 10**6:
        pytest.skip("whole balls of five bits are not for a test")
    r = random.Random(bits)
    base = [r.getrandbits(64) for _ in range(6)]
    fps = {b ^ sum(1 << x for x in r.sample(range(64), r.randrange(5))) for b in base for _ in range(25)} | {0, 1, 3, (1 << 64) - 1}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), bits, segments, bucket).distinct().collect()
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
    assert {tuple(x) for x in got} == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bucket", [2, 64])
def test_no_table_of_a_row_per_document_is_broadcast(spark, bucket):
    r = random.Random(4)
    fps = [r.getrandbits(31) << 32 | r.getrandbits(2) for _ in range(40)] + [7 << 32 | k for k in range(5)]
    fps = spark.createDataFrame([(f,) for f in fps], "fp bigint").distinct()
    assert "Broadcast" not in plan_of(simhash.near_links(fps, bucket=bucket))
    docs = spark.createDataFrame([(k, f"{k % 7} a few words {k % 11}", "en", f"src{k % 3}", 9) for k in range(60)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for df in (simhash.simhash_components(docs), simhash.drop_near_duplicates(docs), mixing.mix(docs)):
        assert "Broadcast" not in plan_of(df) and df.count()


def test_simhash_rows(spark, sf_small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    rows = docs + [(900_001, docs[3][1]), (900_002, None), (900_003, ""), (900_003, ""), (900_004, " \n"), (None, docs[5][1])]
    df = spark.createDataFrame([(*x, "a", 1) for x in rows], "doc_id bigint, text string, fp string, component int")
    got = sorted(map(tuple, simhash.simhash_components(df).collect()), key=str)
    fps = [brute_fingerprint(t) for _, t in rows]
    lab = groups(len(rows), [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if (fps[a] ^ fps[b]).bit_count() <= 2])
    want = [(i, f"{fps[k]:016x}", min(rows[m][0] for m in range(len(rows)) if lab[m] == lab[k] and rows[m][0] is not None)) for k, (i, _) in enumerate(rows)]
    assert got == sorted(want, key=str)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({w[2] for w in want})
    assert simhash.simhash_components(df.where("false")).count() == 0 == simhash.drop_near_duplicates(df.where("false")).count()


# --- winnowing

def brute_winnow(grams, w):
    if not grams:
        return []
    if len(grams) < w:
        m = min(grams)
        return [(m, max(i for i, g in enumerate(grams) if g == m))]
    out = {}
    for a in range(len(grams) - w + 1):
        m = min(grams[a:a + w])
        out[m, max(i for i in range(a, a + w) if grams[i] == m)] = None
    return list(out)


def test_winnowing_windows(spark):
    """Windows and rightmost ties, on the operator's own gram hashes (one gram per word: k = 1)."""
    r = random.Random(2)
    rows = [(k, " ".join(r.choice("abcd") for _ in range(n))) for k, n in enumerate([0, 1, 2, 3, 4, 5, 9, 40, 41])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    single = {w: winnowing.fingerprints(spark.createDataFrame([(0, w)], "doc_id bigint, text string"), k=1, w=1).first().kept[0].hash for w in "abcd"}
    for w in (1, 3, 4, 5):
        got = {x.doc_id: [(y.hash & 0xFFFFFFFF, y.position) for y in x.kept] for x in winnowing.fingerprints(df, k=1, w=w).collect()}
        for i, t in rows:
            assert got[i] == brute_winnow([single[x] & 0xFFFFFFFF for x in t.split()], w), (w, t)


def test_winnowing_guarantee(spark):
    """A shared passage of w + k - 1 words gives a common hash, wherever it stands."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    k, w = winnowing.K, winnowing.W
    rows = []
    for n in range(30):
        passage = [word() for _ in range(w + k - 1)]
        for side in range(2):
            rows.append((2 * n + side, " \n".join([word() for _ in range(r.randrange(40))] + passage + [word() for _ in range(r.randrange(40))])))
    got = {x.doc_id: {y.hash for y in x.kept} for x in winnowing.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[2 * n] & got[2 * n + 1] for n in range(30))


@pytest.mark.parametrize("run_rows", [1, 3, 1024])
def test_edited_texts(spark, run_rows):
    r = random.Random(4)
    rows = [(i, "".join(r.choice("ab é😀\n") for _ in range(r.randrange(60)))) for i in r.sample(range(-50, 10**6), 25)]
    rows += [(77, None), (78, ""), (rows[0][0], "twin"), (None, "no id"), (None, "no id")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, t string, run int")
    src = df.select(F.col("doc_id").alias("id"), F.coalesce(df["text"], F.lit("")).alias("t"))
    order = sorted([(i, t or "") for i, t in rows], key=lambda x: (x[0] is None, -(x[0] or 0), x[1].encode()))
    nxt = sorted([(i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)], key=str)
    assert sorted(map(tuple, winnowing.with_next_text(src, run_rows).collect()), key=str) == nxt
    got = sorted([(x.doc_id, x.n_chars, x.edited_sha256) for x in winnowing.edited_fingerprints(df, run_rows=run_rows).collect()], key=str)
    want = [(i, len(t), hashlib.sha256((t[:len(t) - len(t) // 2] + n[:len(t) // 2]).encode()).hexdigest()) for i, t, n in nxt]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("clumps", [[0, 10**15], [-(1 << 63), (1 << 63) - 400], [5, 7 * 10**6, 7 * 10**6 + 900, 10**9]])
def test_next_text_of_clumped_ids(spark, clumps):
    rows = [(c + i, f"{c} {i}") for c in clumps for i in range(0, 300, 1 + len(clumps) % 2)] + [(None, "b"), (None, "a")]
    src = spark.createDataFrame(rows, "id bigint, t string")
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    nxt = {(*x, order[(k + 1) % len(order)][1]) for k, x in enumerate(order)}
    got = winnowing.with_next_text(src, 8)
    assert set(map(tuple, got.collect())) == nxt and got.count() == len(rows)
    assert set(map(tuple, winnowing.with_next_text(src, 4096).collect())) == nxt
    runs = winnowing.with_runs(src, 8)[0].where("id is not null").groupBy("run").count()
    assert runs.agg(F.max("count")).first()[0] <= 32


def test_winnowing_likeness(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    got = winnowing.edited_fingerprints(docs).collect()
    assert len(got) == docs.count()
    text = {r.doc_id: r.text for r in docs.collect()}
    by = {}
    for x in got:
        by.setdefault(text[x.doc_id], set()).add(x.fingerprint)
        assert 0 <= x.near_next <= 1 and 0 <= x.near_edited <= 1
    assert all(len(v) == 1 for v in by.values())
    long = [x for x in got if x.n_chars > 2000]
    assert sum(x.near_edited > 0.2 for x in long) > 0.95 * len(long) and sum(x.near_next < 0.1 for x in long) > 0.8 * len(long)
    plan = winnowing.edited_fingerprints(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def units(text):
    import regex

    letter = r"[[\p{L}\p{M}\p{N}]--[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]]"
    return regex.findall(rf"(?V1)(?<!{letter}){letter}{{1,16}}+(?!{letter})|[^\s\p{{Z}}]", text.lower())


def brute_winnowing(text, k, w):
    """Kept (hash, position) pairs from the units by the definition of the rolling hash: unit hashes rotated by their distance to the gram's end, xored."""
    mask = (1 << 64) - 1
    rotl = lambda x, n: ((x << n % 64) | (x >> (64 - n % 64))) & mask if n % 64 else x
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = [xxhash.xxh64_intdigest(u.encode(), seed=42) for u in units(text)]
    long_hash = lambda v: xxhash.xxh64_intdigest((signed(v) & mask).to_bytes(8, "little"), seed=42)
    if len(h) >= k:
        grams = []
        for a in range(len(h) - k + 1):
            g = 0
            for i in range(k):
                g ^= rotl(h[a + i], k - 1 - i)
            grams.append(long_hash(g) >> 32)
        return brute_winnow(grams, w), grams
    return None, None


SCRIPTS = {
    "prose": "the quick brown fox jumps over the lazy dog and runs from there to another place while nobody looks at it again ".split(),
    "chinese": list("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜金生丽水玉出昆冈剑号巨阙珠称夜光果珍李柰菜重芥姜"),
    "thai": list("กขคฆงจฉชซฌญฎฏฐฑฒณดตถทธนบปผฝพฟภมยรลวศษสหฬอฮ"),
    "code": list("abcdefghijklmnopqrstuvwxyz0123456789(){}[];=+.,"),
    "encoded": list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}


@pytest.mark.parametrize("script", sorted(SCRIPTS))
def test_half_kept_texts_are_alike_in_every_script(spark, script):
    r = random.Random(script)
    sep = " " if script == "prose" else ""
    text = lambda n: sep.join(r.choice(SCRIPTS[script]) for _ in range(n))
    rows = [(k, text(r.randrange(60, 900) if script == "prose" else r.randrange(210, 4000))) for k in range(20)]
    shared = text(400)
    rows += [(100, text(150) + sep + shared), (99, shared + sep + text(170))]
    got = {x.doc_id: x for x in winnowing.edited_fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(x.near_edited > 0.3 for x in got.values()), {i: x.near_edited for i, x in got.items()}
    assert all(got[k].near_next < 0.2 for k in range(1, 20)) and got[100].near_next > 0.5


def test_fingerprint_and_likeness_equal_brute_force(spark):
    r = random.Random(11)
    pieces = ["word", "Straße", "été", "ÉTÉ", "naïve", "你好", "世界", "กขค", "x" * 16, "y" * 17, "z" * 40, "a1b2", "--", "(", "😀", "\u00a0", "\u3000", "\n", "e\u0301"]
    rows = [(k, "".join(r.choice(pieces) + r.choice(["", " ", ", "]) for _ in range(n))) for k, n in enumerate([0, 1, 3, 5, 8, 9, 30, 200, 201])]
    rows.append((50, "long words only " * 1200))
    k, w = winnowing.K, winnowing.W
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {x.doc_id: [(y.hash & 0xFFFFFFFF, y.position) for y in x.kept] for x in winnowing.fingerprints(df).collect()}
    order = sorted(rows, reverse=True)
    out = {x.doc_id: x for x in winnowing.edited_fingerprints(df).collect()}
    sets = {}
    for i, t in rows:
        want, grams = brute_winnowing(t, k, w)
        if want is None:
            assert len(kept[i]) == (1 if units(t) else 0)
            continue
        # the stored hash is the upper half of the gram's hash
        assert [(h & 0xFFFFFFFF, p) for h, p in want] == kept[i]
        sets[i] = {h for h, _ in want}
    for n, (i, t) in enumerate(order):
        _, nt = order[(n + 1) % len(order)]
        edited, _ = brute_winnowing(t[:len(t) - len(t) // 2] + nt[:len(t) // 2], k, w)
        nxt, _ = brute_winnowing(nt, k, w)
        for other, value in ((edited, out[i].near_edited), (nxt, out[i].near_next)):
            if i in sets and other is not None:
                b = {h for h, _ in other}
                assert value == pytest.approx(2 * len(sets[i] & b) / (len(sets[i]) + len(b)))


def test_winnowing_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    assert winnowing.edited_fingerprints(df.where("false")).count() == 0
    assert winnowing.edited_fingerprints(df).first().near_next == 1.0
