import base64
import glob
import hashlib
import os
import random
import zlib
from collections import Counter
from math import log10

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from verdigraph.llm import audio, bpe, brown, hnsw, linededup, mixing, quality, queries, simhash, similar, sstable, toxicity
from verdigraph.llm.components import components, forest

P = pytest.importorskip("public_tokenizers")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and long texts, ties, repeated rows.
ODD = [
    (1, "alpha beta gamma delta epsilon\nsame long line here", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", "en", "b", 4),
    (5, "alpha beta gamma delta epsilon\nsame long line here", "en", "b", 1), (5, "alpha beta gamma delta epsilon\nsame long line here", "en", "b", 1), (6, "x" * 5000, "en", "", 5000),
    (7, "Ünïcode 漢字 words\n" * 300, "de", "c", 1), (None, "no identifier SAME LONG LINE here\nsame long line here ", "en", "a", 1), (-8, "  SAME LONG LINE HERE\x0b", "en", None, 1), (9, "one two", "en", "a", 7),
]


def odd(spark, rows=ODD):
    """With a further column whose name an operator might use itself."""
    return spark.createDataFrame(rows, DOC).withColumns({"row": F.lit(1), "_lost": F.lit(2), "k": F.lit(3), "w": F.lit(4)})


def saved(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def brute_components(links, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    random.seed(5)
    links = [(random.randrange(400), random.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(200)]
    nodes = {n for x in links for n in x}
    want = brute_components(links, nodes)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in nodes} == want
    a, b = np.array([x for x in links if max(x) < 400]).T
    assert {n: int(c) for n, c in enumerate(forest(a, b, 400)) if n in nodes} == {n: c for n, c in want.items() if n < 400}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def test_brown(spark, tmp_path, monkeypatch):
    random.seed(6)
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(random.choice((a, b)[i % 2] if random.random() < 0.9 else a + b) for _ in range(60)), "x", "s", 0) for i in range(300)]
    rows += ODD
    sf = saved(spark, tmp_path, documents=odd(spark, rows))
    monkeypatch.setattr(brown, "CHUNK_BYTES", 9000)
    got = brown.op1_brown_class_lm(spark, sf).collect()
    c = Counter()
    for i, text, *_ in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            c.update((text or "").encode().lower().split())
            c[None] += 1
    n, v = sum(c.values()), len(c)
    want = []
    for i, text, *_ in rows:
        w = [*(text or "").encode().lower().split(), None]
        want.append((i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(w), sum(c[x] > 0 for x in w), n, round(sum(log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)))
    assert sorted((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(want)
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 20 and r["doc_id"] < 300 and r["doc_id"] > 9]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.1 * sum(r["n_tokens"] for r in held)


def brute_scores(rows):
    """The model over whole texts in plain Python: rows of (doc_id, text)."""
    texts = [(i, (t or "").encode().lower().split()) for i, t in rows]
    train = [w for i, w in texts if i is not None and zlib.crc32(str(i).encode()) % 10]
    total = Counter(x for w in train for x in w)
    c = brown.class_count(len(total))
    end = c + 1
    core = sorted(total, key=lambda x: (-total[x], xxhash.xxh3_128_digest(x)))[: brown.core_size(len(total))]
    number = {x: i for i, x in enumerate(core)}

    def pairs(state, size):
        n = np.zeros((size, size))
        for w in train:
            s = [size - 1, *(state.get(x) for x in w), size - 1]
            for x, y in zip(s, s[1:]):
                if x is not None and y is not None:
                    n[x, y] += 1
        return n

    of = brown.exchange(bigrams := pairs(number, len(core) + 1), c)
    known = {x: int(of[i]) for x, i in number.items()}
    seen = brown.core_pairs(bigrams, of, c)
    for last in (False, True):
        fit = brown.affinity(seen, c)
        score = {x: np.zeros(c) for x in total if x not in number}
        has = set()
        for w in train:
            s = [end, *(known.get(x) for x in w), end]
            for k, x in enumerate(w):
                for state, row in ((s[k], 0), (s[k + 2], c + 2)):
                    if x in score and state is not None:
                        score[x] += fit[row + state]
                        has.add(x)
        known = {x: int(of[number[x]]) if x in number else int(np.argmax(score[x])) if x in has else c for x in total if x in number or x in has or last}
        seen = pairs(known, c + 2)
    sums = np.zeros((2, c + 2))
    for x, n in total.items():
        sums[:, known[x]] += n, 1
    m = brown.Model(c, len(train), sums)
    m.fit(seen)
    out = []
    for _, w in texts:
        at, score = end, 0.0
        for x in [*w, None]:
            n = len(train) if x is None else total[x]
            to = end if x is None else known.get(x)
            if n:
                score += m.step[at, to] + log10((n + brown.ADD) / m.below[to])
                at = to
            else:
                score += m.lost[at]
        out.append(score)
    return out


def test_brown_against_a_plain_scorer(spark, tmp_path, monkeypatch):
    """And equal scores, to the last bit, however rows are dealt to files."""
    random.seed(20)
    some = [f"w{min(int(random.expovariate(0.004)), 3000)}" for _ in range(3000)]
    rows = [(i, " ".join(some[(i * 37 + k * (1 + i % 3)) % 3000] for k in range(i % 70)), "x", "s", 0) for i in range(400)] + ODD
    monkeypatch.setattr(brown, "CORE", 100)
    want = sorted(zip((str(r[0]) for r in rows), (round(x, 6) for x in brute_scores([(r[0], r[1]) for r in rows]))))
    seen = []
    for size, files in ((9000, 1), (1 << 20, 7)):
        monkeypatch.setattr(brown, "CHUNK_BYTES", size)
        df = odd(spark, rows).repartition(files)
        got = brown.op1_brown_class_lm(spark, saved(spark, tmp_path / str(files), documents=df)).collect()
        assert sorted((str(r["doc_id"]), round(r["score"], 6)) for r in got) == want
        seen.append(sorted(map(str, got)))
    assert seen[0] == seen[1]


def test_words_far_from_a_capped_core_have_a_class(spark, monkeypatch):
    """A run of words that occur once: those in its middle see no neighbour with a class in two rounds."""
    monkeypatch.setattr(brown, "CORE", 10)
    rows = [(i, " ".join(f"c{(i + k) % 70}" for k in range(50)), True, False) for i in range(200)] + [(900, " ".join(f"once{k}" for k in range(40)), True, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean, held_out boolean")
    got, model = brown.score_texts(docs)
    assert got.count() == len(rows)
    classes = brown.class_count(110)
    assert model.types[classes] == 0 and model.types[:classes].sum() == 110


def test_many_small_rows_go_in_few_batches():
    rows = [(i, 7, b"x" * 10, b"", 0, 0) for i in range(1100)]
    got = list(brown._sent(brown.ANSWER, rows))
    assert [b.num_rows for b in got] == [512, 512, 76] and [r for b in got for r in b.column(0).to_pylist()] == list(range(1100))
    assert len(list(brown._sent(brown.ANSWER, [(0, 0, bytes(brown.SENT_BYTES), b"", 0, 0)] * 2))) == 2


def test_exchange_finds_classes():
    random.seed(7)
    n = np.zeros((41, 41))
    for _ in range(20000):
        side = random.random() < 0.5
        x, y = random.randrange(20) + 20 * side, random.randrange(20) + 20 * side
        n[x, y] += 1
    of = brown.exchange(n, 2)[:-1]
    assert len(set(of[:20])) == len(set(of[20:])) == 1 and of[0] != of[20]


def test_emissions_and_steps_are_probabilities():
    sums = np.zeros((2, 10))
    sums[:, 0], sums[:, 1] = (10, 4), (5, 2)
    m = brown.Model(8, 3, sums)
    pairs = np.zeros((10, 10))
    pairs[0, 1], pairs[m.end, 0] = 4, 3
    m.fit(pairs)
    assert np.allclose((10**m.step).sum(axis=1), 1)
    assert np.isclose((10 + 4 * brown.ADD + brown.ADD) / m.below[0], 1)


def test_brown_without_training(spark, tmp_path):
    sf = saved(spark, tmp_path, documents=odd(spark, [(None, "a b", "x", "s", 1)]))
    r = brown.op1_brown_class_lm(spark, sf).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)
    assert brown.op1_brown_class_lm(spark, saved(spark, tmp_path / "e", documents=odd(spark, []))).count() == 0


# 2


def test_marginals_against_all_paths():
    import itertools

    rng = np.random.default_rng(1)
    e, a, s, first = rng.normal(size=(12, 2)), rng.normal(size=(2, 2)), rng.normal(size=2), np.array([0, 4, 5])
    p, joint, z = toxicity.marginals(e, first, a, s)
    want, logs = np.zeros((12, 2)), 0.0
    for lo, hi in ((0, 4), (4, 5), (5, 12)):
        w = {path: np.exp(s[path[0]] + sum(e[lo + k][c] for k, c in enumerate(path)) + sum(a[x][y] for x, y in zip(path, path[1:]))) for path in itertools.product((0, 1), repeat=hi - lo)}
        total = sum(w.values())
        logs += np.log(total)
        for path, x in w.items():
            for k, c in enumerate(path):
                want[lo + k, c] += x / total
    assert np.allclose(p, want) and np.isclose(z, logs) and np.allclose(joint[[1, 2, 3]].sum(axis=(1, 2)), 1)


def toxic_rows(n, seed):
    random.seed(seed)
    words, bad = [f"w{i}" for i in range(300)], ["grrr", "zonk", "blarg"]
    rows = []
    for i in range(n):
        w = [random.choice(words) for _ in range(40)]
        toxic = i % 6 == 0
        for _ in range(3 if toxic else 0):
            w.insert(random.randrange(len(w)), random.choice(bad) + random.choice(("", ".", "!")))
        rows.append((i, " ".join(w).capitalize(), "en", "s", 0, toxic))
    return rows


def test_toxicity(spark, tmp_path):
    rows = toxic_rows(600, 8)
    docs = odd(spark, [r[:5] for r in rows] + [(10_000 + (i or 0), *r[1:]) for i, r in enumerate(ODD)])
    labels = spark.createDataFrame([(r[0], 1, int(r[5])) for r in rows] + [(10_001, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.op2_crf_toxicity(spark, saved(spark, tmp_path, documents=docs, labels=labels)).collect()}
    for r in rows:
        g = got[r[0]]
        assert g["held_out"] == (zlib.crc32(str(r[0]).encode()) % 3 == 1) and g["predicted"] == int(r[5]) and 0 <= g["score"] <= 1
    spans = eval(got[0]["spans"])
    assert {rows[0][1][a:b].lower() for a, b in spans} <= {"grrr", "zonk", "blarg"} and len(spans) == 3
    none = toxicity.op2_crf_toxicity(spark, saved(spark, tmp_path / "n", documents=odd(spark), labels=labels.limit(0)))
    assert none.count() == len(ODD) and none.where("predicted = 1").count() == 0


def test_scores_against_a_plain_field(spark):
    """Every document's score by forward and backward sums over single tokens, from the learned weights."""
    from math import exp, log, log1p

    rows = toxic_rows(120, 23) + [(1000, None, "", "", 0, False), (1001, "", "", "", 0, False), (1002, "zonk", "", "", 0, True), (1003, "grrr zonk " * 700 + "w1 " * 3000, "", "", 0, True)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("_score", F.lit("x"))
    field = toxicity.fit([((r[1] or "").encode(), int(r[5])) for r in rows if r[0] % 3])
    got = {r["doc_id"]: r for r in toxicity.tagged(docs, "text", field).collect()}
    both = lambda x, y: max(x, y) + log1p(exp(-abs(x - y)))
    for r in rows:
        ids = [field.index.get(w, 0) for w in toxicity.words((r[1] or "").encode())]
        around = [0, *ids, 0]
        e = [(0.0, float(field.bias + field.w[0][i] + field.w[1][a] + field.w[2][b])) for a, i, b in zip(around, ids, around[2:])]
        forward = []
        for k, x in enumerate(e):
            forward.append([(field.s[c] if not k else both(*(forward[-1][d] + field.a[d][c] for d in (0, 1)))) + x[c] for c in (0, 1)])
        backward = [[0.0, 0.0]]
        for x in reversed(e[1:]):
            backward.append([both(*(field.a[c][d] + x[d] + backward[-1][d] for d in (0, 1))) for c in (0, 1)])
        p = [1 / (1 + exp(f[0] + b[0] - f[1] - b[1])) for f, b in zip(forward, reversed(backward))]
        top = [*sorted(p, reverse=True), 0.0, 0.0]
        z = sum(c * x for c, x in zip(field.curve, (1.0, log1p(sum(p)), top[0], top[1])))
        assert abs(got[r[0]]["_score"] - 1 / (1 + exp(-z))) < 1e-6, r[0]
        assert len(got[r[0]]["_spans"]) == sum(x > toxicity.SPAN for x in p)


# 3


def test_wav_and_features(spark, tmp_path):
    for n in (0, 1, 191, 192, 193, 5000):
        text = bytes(random.Random(n).randrange(256) for _ in range(n))
        payload = audio.payload_of(text)
        assert len(payload) % 192 == 0 and len(payload) >= 192 and payload.rstrip(b" ") == text.rstrip(b" ")
        assert audio.read_wav(audio.wav(payload)) == (payload, audio.RATE)
    got = {r["doc_id"]: r for r in audio.op3_audio_features(spark, saved(spark, tmp_path, documents=odd(spark))).collect()}
    for i, text, *_ in ODD:
        t = (text or "").encode()
        p = audio.payload_of(t)
        g = got[i]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"], g["media_bytes"]) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(p) + 44)
    assert got[2]["feature"] == got[3]["feature"] and got[1]["feature"] == got[5]["feature"] != got[9]["feature"]


def test_resampling_keeps_a_tone():
    t = np.arange(8000) / 8000
    y = audio.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32))
    want = np.sin(2 * np.pi * 440 * np.arange(6000) / 6000)
    err = min(np.abs(y[200 + k : -200 + k] - want[200:-200]).max() for k in range(-20, 20))
    assert len(y) == 6000 and np.abs(np.fft.rfft(y)).argmax() == 440 and err < 0.5


def test_features_against_plain_sums():
    """Resampling as a convolution of the stuffed signal, log-mel energies as sums over frequencies, segments by a loop."""
    rng = np.random.default_rng(21)
    text = bytes(rng.integers(0, 256, 3000).tolist()) + b"\x80" * 2500 + b"\x00\xff" * 700
    samples, blocks, spans, found = audio.Features()(audio.wav(audio.payload_of(text)))
    x = (np.frombuffer(samples, np.uint8).astype(float) - 128) / 128
    stuffed = np.zeros(len(x) * audio.UP)
    stuffed[:: audio.UP] = x
    h = audio._lowpass().T.ravel().astype(float)
    whole = np.convolve(stuffed, h)
    y = np.array([whole[m * audio.DOWN + audio.UP * (audio.TAPS - 1 - audio.TAPS // 2)] for m in range(len(x) * audio.UP // audio.DOWN)])
    assert np.allclose(audio.resample(x.astype(np.float32)), y, atol=1e-5)
    rate, n, mel, level = audio.RATE * audio.UP / audio.DOWN, audio.FRAME, [], []
    window = [0.5 - 0.5 * np.cos(2 * np.pi * k / (n - 1)) for k in range(n)]
    to_mel = lambda f: 2595 * log10(1 + f / 700)
    edges = [700 * (10 ** (to_mel(rate / 2) * k / (audio.MELS + 1) / 2595) - 1) for k in range(audio.MELS + 2)]
    for at in range(0, len(y) - n + 1, audio.HOP):
        frame = y[at : at + n]
        power = [abs(sum(v * w * np.exp(-2j * np.pi * k * t / n) for t, (v, w) in enumerate(zip(frame, window)))) ** 2 for k in range(n // 2 + 1)] if at % (audio.HOP * 8) == 0 else None
        level.append(np.sqrt((frame * frame).mean()))
        mel.append(power and [log10(audio.FLOOR + sum(p * max(0.0, min((k * rate / n - a) / (b - a), (c - k * rate / n) / (c - b))) for k, p in enumerate(power))) for a, b, c in zip(edges, edges[1:], edges[2:])])
    flat = blocks.reshape(-1, audio.MELS)
    assert sum(s[2] for s in spans) == len(mel) and all(np.allclose(flat[i], m, atol=1e-3) for i, m in enumerate(mel) if m)
    want, start = [], None
    for i, v in enumerate([*level, -1]):
        if start is None and v >= audio.ON:
            start = i
        elif start is not None and v < audio.OFF:
            want.append((start, i))
            start = None
    assert found == want and want
    back, same = audio.read_tensors(audio.tensor_stream(blocks, spans))
    assert same == spans and np.abs(back - blocks).max() < 0.01


def test_segments_and_tensors():
    assert audio.segments(np.array([0, 0.3, 0.4, 0.3, 0.26, 0.2, 0.3, 0.5]), 0.35, 0.25) == [(2, 5), (7, 8)]
    assert audio.segments(np.array([0.3, 0.3])) == []
    blocks, spans = audio.tensors(np.zeros((70, audio.MELS), np.float32), 6000)
    assert blocks.shape == (2, 64, 32) and [s[2] for s in spans] == [64, 6] and spans[1][0] == 1024
    import pyarrow as pa

    t = pa.ipc.open_stream(audio.tensor_stream(blocks, spans)).read_all()
    assert t.schema.field("tensor").type.shape == [64, 32] and t.num_rows == 2


# 4


def test_hnsw(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARDS", 1)  # large enough that its graph is asked
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 16))
    v = np.concatenate([base, base[:60] + rng.normal(size=(60, 16)) * 0.15, np.repeat(base[:1], 150, 0) + rng.normal(size=(150, 16)) * 0.05])
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v.astype(np.float32))]
    special = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, []), (905, rows[5][1][:8]), (None, rows[0][1]), (7, rows[7][1]), (906, [float("inf")] * 16), (907, [1e30 * c for c in rows[9][1]])]
    df = spark.createDataFrame(rows + special, "vec_id long, embedding array<float>").withColumn("shard", F.lit("x"))
    got = hnsw.near_duplicates(df, "vec_id", "embedding").collect()
    assert len(got) == len(rows) + len(special)
    all_ = {**{i: np.array(x) for i, x in rows}, 907: np.array(special[-1][1])}
    ids = sorted(all_)
    x = np.stack([all_[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    comp = brute_components([(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))], ids)
    by = {r["vec_id"]: r for r in got}
    exact = sum(by[i]["n_links"] == n for i, n in zip(ids, near.sum(axis=1)))
    assert exact == len(ids) and all(by[i]["component_id"] == comp[i] and by[i]["kept"] == (comp[i] == i) for i in ids)
    assert all(r["audit_recall"] >= 0.99 for r in got)
    for i in (900, 901, 902, 903, 904, 905, 906):
        assert (by[i]["n_links"], by[i]["component_id"], by[i]["kept"]) == (0, i, True)
    assert (by[None]["n_links"], by[None]["component_id"], by[None]["kept"]) == (0, None, False)
    assert hnsw.op4_hnsw_near_dedup(spark, saved(spark, tmp_path / "e", embeddings=df.limit(0))).count() == 0


def test_hnsw_meets_few_cells(spark, monkeypatch):
    """Every vector meets few others, not all: what is compared doesn't grow with the square of the input. Dense and loose groups, some larger
    than a block, repeats and pairs near the limit come out as by comparing all."""
    monkeypatch.setattr(hnsw, "CELL_ROWS", 32)
    monkeypatch.setattr(hnsw, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(2200, 32))
    dense, loose = np.repeat(base[:1], 450, 0) + rng.normal(size=(450, 32)) * 0.02, np.repeat(base[1:2], 250, 0) + rng.normal(size=(250, 32)) * 0.25
    v = np.concatenate([base, dense, loose, base[100:300] + rng.normal(size=(200, 32)) * 0.4, base[300:400], np.repeat(base[2:3], 150, 0)]).astype(np.float32)
    x = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    comp = brute_components([(int(a), int(b)) for a, b in zip(*np.nonzero(near))], list(range(len(v))))
    met, compared = [], hnsw._compared

    def spy(routed, paths, sizes, width, *more):
        cells = np.array([r["cells"][:width] for r in routed.select("cells").collect()])
        own, all_ = np.bincount(cells[:, 0], minlength=cells.max() + 1), np.bincount(cells[cells >= 0])
        met.append(int((own * all_).sum()))
        return compared(routed, paths, sizes, width, *more)

    monkeypatch.setattr(hnsw, "_compared", spy)
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in hnsw.near_duplicates(df, "vec_id", "embedding").collect()}
    assert len(got) == len(v) and all((got[i]["n_links"], got[i]["component_id"]) == (near[i].sum(), comp[i]) for i in range(len(v)))
    assert met[0] < len(v) ** 2 / 4
    monkeypatch.setattr(hnsw, "AUDIT_ROWS", (300, 600))  # a share of the rows tells how many cells are needed
    got = {r["vec_id"]: r for r in hnsw.near_duplicates(df, "vec_id", "embedding").collect()}
    links = np.array([got[i]["n_links"] for i in range(len(v))])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.98 * near.sum() and got[0]["audit_recall"] >= 0.99


def test_hnsw_with_one_cell(spark, monkeypatch):
    """Where no number of cells finds enough, all are compared, in blocks."""
    monkeypatch.setattr(hnsw, "BLOCK_ROWS", 100)
    monkeypatch.setattr(hnsw, "recalls", lambda told: np.zeros(hnsw.CELLS))
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 8))
    v = np.concatenate([base, np.repeat(base[:1], 200, 0) + rng.normal(size=(200, 8)) * 0.01])
    x = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    comp = brute_components([(int(a), int(b)) for a, b in zip(*np.nonzero(near))], list(range(len(v))))
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in hnsw.near_duplicates(df, "vec_id", "embedding").collect()}
    assert all((got[i]["n_links"], got[i]["component_id"]) == (near[i].sum(), comp[i]) for i in range(len(v)))


def test_graph_recall():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph(x)
    ids, _ = g.search(x[:100], 48)
    top = np.argsort(-(x[:100] @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(i[:5]) & set(t)) / 5 for i, t in zip(ids, top)]) >= 0.9
    assert len(g.layers) > 1


def test_audit_counts_links_of_sparse_queries_only():
    """A dense third is answered exactly and must not pay for links that the graph misses elsewhere."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24))
    x[2::3] = x[2] + rng.normal(size=(1000, 24)) * 0.01
    x[1::3] = x[0::3] + rng.normal(size=(1000, 24)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    class Blind(hnsw.Graph):
        """Finds only the dense group, and a row itself."""

        def search(self, q, beam):
            ids = np.full((len(q), beam), -1)
            ids[:, 0] = np.arange(len(q))
            ids[2::3] = np.arange(2, 3 * beam, 3)
            return ids, np.where(ids >= 0, 1.0, -2.0)

    g = Blind(x.astype(np.float32), [])
    a, b, whole, links, missed = hnsw.found_links(g, x, x, g.x, 0.9, True)
    got = set(zip(a.tolist(), b.tolist()))
    assert all((i, i + 1) in got or i in set(whole.tolist()) for i in range(0, 3000, 3))


# 5


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_simhash(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(simhash, "POSTING", 40)
    random.seed(9)
    base = [f"w{random.randrange(50)}" for _ in range(400)]
    rows = list(ODD)
    for i in range(150):
        w = list(base)
        for _ in range(random.randrange(6)):
            w[random.randrange(400)] = "q"
        rows.append((100 + i, " ".join(w), "x", "s", 0))
    got = simhash.op5_simhash_near_dedup(spark, saved(spark, tmp_path, documents=odd(spark, rows))).collect()
    fps = {i: brute_fingerprint(t) for i, t, *_ in rows if i is not None}
    ids = list(fps)
    comp = brute_components([(a, b) for k, a in enumerate(ids) for b in ids[:k] if (fps[a] ^ fps[b]).bit_count() <= 2], ids)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["fingerprint"], r["component_id"]) == (f"{fps[r['doc_id']]:016x}", comp[r["doc_id"]])
    assert simhash.op5_simhash_near_dedup(spark, saved(spark, tmp_path / "e", documents=odd(spark, []))).count() == 0


def test_hot_keys_are_joined_alike(spark, tmp_path, monkeypatch):
    from verdigraph.llm import common

    rows = spark.createDataFrame([(i % 7 if i % 3 else 100, i) for i in range(300)], "k int, x int")
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("m"))
    want = sorted(map(tuple, rows.join(facts.drop("n"), "k").collect()))
    monkeypatch.setattr(common, "MANY", 10)
    monkeypatch.setattr(common, "SENT_KEYS", 5)
    assert sorted(map(tuple, common.hot_join(rows, facts, "k", 300).collect())) == want
    links = [(random.randrange(40), random.randrange(40)) for _ in range(25)] + [(0, i) for i in range(50, 90)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for p in links for x in p}
    assert {n: got.get(n, n) for n in nodes} == brute_components(links, nodes)


def test_counts_of_shared_bytes():
    """Against all pairs; the count keeps every pair of two differing bits and drops pairs that are far apart."""
    rng = np.random.default_rng(22)
    fp = rng.integers(0, 4, (300, 8)).astype(np.uint8).view("<u8").ravel()
    run = np.sort(rng.integers(0, 9, 300))
    own = np.zeros((300, 8), bool)
    own[:, 2:4] = True
    by = fp.view(np.uint8).reshape(-1, 8)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if run[i] == run[j] and 2 + sum(by[i, p] == by[j, p] for p in range(8) if not own[i, p]) >= 6 and any(by[i, p] == by[j, p] for p in range(8) if not own[i, p])}
    got = set(zip(*(x.tolist() for x in simhash.tallied(fp, run, own, 6))))
    assert got == want and 0 < len(got) < 300
    with pytest.raises(ValueError):
        simhash.runs_of(4)


def test_postings_reach_every_near_pair(spark):
    random.seed(10)
    pairs, entries = [], []
    for i in range(0, 400, 2):
        a = random.getrandbits(64)
        b = a
        for _ in range(random.randrange(1, 3)):
            b ^= 1 << random.randrange(64)
        pairs.append((i, i + 1))
        entries += [(a, i), (b, i + 1)]
    signed = [(x - (1 << 64) if x >> 63 else x, n) for x, n in entries]
    got = {(max(r), min(r)) for r in simhash.links(spark.createDataFrame(signed, "fp long, node long")).collect()}
    assert {(b, a) for a, b in pairs} <= got


def test_similar_documents(spark):
    random.seed(11)
    words = [f"v{i}" for i in range(2000)]
    rows, near, far = [], [], []
    for i in range(60):
        w = [random.choice(words) for _ in range(300)]
        rows.append((i * 10, " ".join(w)))
        x = list(w)
        for _ in range(3):
            x[random.randrange(300)] = "new"
        rows.append((i * 10 + 1, " ".join(x)))
        rows.append((i * 10 + 2, " ".join(random.choice(words) for _ in range(300))))
    rows += [(5000, rows[0][1]), (None, "x"), (None, "x"), (6000, None), (6001, "")]
    got = {r["doc_id"]: r["component_id"] for r in similar.groups(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert sum(got[i * 10 + 1] == i * 10 for i in range(60)) >= 57 and all(got[i * 10 + 2] == i * 10 + 2 for i in range(60)) and got[5000] == 0 and got[6001] == 6000
    kept = similar.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert len(kept) == len(set(got.values())) + 2


def test_repeated_identifiers_keep_their_texts(spark):
    rows = [(1, "one text of five words here", 1), (1, "another text that is not alike", 2), (1, "one text of five words here", 3), (2, "a third one of its own", 4), (3, "one text of five words here", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _lost int").withColumn("r", F.lit(1))
    assert sorted((r["doc_id"], r["_lost"]) for r in similar.one_of_each(docs, "doc_id", "text").collect()) == [(1, 1), (1, 2), (2, 4)]


def test_similar_documents_at_the_threshold(spark):
    def text(i, own, size):
        return " ".join([*(f"a{i}_{k}" for k in range(size)), *(f"{own}{i}_{k}" for k in range(34))])

    # a shared run of 304 words is 300 of 368 shingles (0.815); one of 244 is 240 of 308 (0.779)
    rows = [(i * 2 + k, text(i, own, 304 if i < 200 else 244)) for i in range(400) for k, own in enumerate("xy")]
    got = {r["doc_id"]: r["component_id"] for r in similar.groups(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert sum(got[i * 2 + 1] == i * 2 for i in range(200)) >= 199
    assert all(got[i * 2 + 1] == i * 2 + 1 for i in range(200, 400))


def test_near_fingerprints_are_candidates(spark, monkeypatch):
    """Without least hashes, the byte-position index alone finds pairs of at most two differing bits; the exact similarity decides."""
    monkeypatch.setattr(similar, "least", lambda h: np.zeros(0, np.int64))
    w = [f"n{i}" for i in range(3000)]
    rows = [(1, " ".join(w)), (2, " ".join([*w, "more"])), (3, " ".join(f"o{i}" for i in range(3000)))]
    fps = [int.from_bytes(similar.wide(np.unique(simhash.hashes(t.encode(), similar.WORDS, similar.SEED)))[:8], "little") for _, t in rows]
    assert (fps[0] ^ fps[1]).bit_count() <= 2 < (fps[0] ^ fps[2]).bit_count()
    got = {r["doc_id"]: r["component_id"] for r in similar.groups(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    entries = spark.createDataFrame([(i, bytes([b, *[255] * 63])) for i, b in enumerate((0, 3, 15, 255))], "node long, fp binary")  # 0-3-15 is a chain
    posted = similar.by_bits(entries).collect()
    assert sorted(r["node"] for r in posted) == [0, 1, 2] and len({r["key"] for r in posted}) == 1


def test_all_pairs_of_a_long_posting(spark, monkeypatch):
    monkeypatch.setattr(similar, "POSTING", 20)
    sets = [(i, np.arange(i * 100, i * 100 + 50, dtype="<u8")) for i in range(90)]
    for i in range(0, 30):  # pairs far from the posting's first entry
        sets.append((100 + i, np.arange((60 + i) * 100 + 5, (60 + i) * 100 + 50, dtype="<u8")))
    posted = spark.createDataFrame([(7, i) for i, _ in sets], "key long, node long")
    found = similar.links(posted, lambda nodes: spark.createDataFrame([(i, h.tobytes()) for i, h in sets], "node long, h binary").join(nodes, "node"))
    assert {tuple(r) for r in found.collect()} == {(100 + i, 60 + i) for i in range(30)}


# 6


def test_line_dedup(spark, tmp_path):
    random.seed(12)
    pool = [f"a line of the pool {i}" for i in range(15)] + ["short", "a line of the pool 1 ", "  A LINE OF THE POOL 2", "ünïcödé!!"]
    rows = [(i, "\n".join(random.choice(pool) for _ in range(random.randrange(12))), "x", "s", 0) for i in range(20, 120)] + [r for r in ODD if r[0] not in (5, None)]
    sf = saved(spark, tmp_path, documents=odd(spark, rows))
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in linededup.op6_line_dedup(spark, sf).collect())
    holders = {}
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            k = line.strip(" \t\n\x0b\x0c\r")
            holders.setdefault("".join(c.lower() if c.isascii() else c for c in k), set()).add(i)
    want = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        keys = ["".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r")) for x in lines]
        keep = [x for x, k in zip(lines, keys) if not (len(k) >= 10 and len(holders[k]) > 1 and min(holders[k]) != i)]
        want.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    assert got == sorted(want)
    kept = linededup.kept_text(linededup.keep_bitmaps(odd(spark)))
    assert kept.count() == len(ODD) and {"row", "_lost", "k", "w"} <= set(kept.columns) and kept.where("doc_id IS NULL").first()["text"].startswith("no identifier")
    assert linededup.keep_bitmaps(odd(spark, [])).count() == 0


def test_null_and_greatest_identifier_are_two_documents(spark):
    top = (1 << 63) - 1
    docs = spark.createDataFrame([(None, "a line that two documents hold"), (top, "a line that two documents hold"), (top - 1, "own line of this one")], "doc_id long, text string")
    assert {r["doc_id"]: r["_dropped"] for r in linededup.keep_bitmaps(docs).collect()} == {None: 1, top: 0, top - 1: 0}


def test_runs_cut_by_parts(spark):
    """One line in all documents, over more parts than a run would fill."""
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("the very same line\nand another one!").alias("text"))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = {r["doc_id"]: r["_dropped"] for r in linededup.keep_bitmaps(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {i: 0 if i == 0 else 2 for i in range(500)}


# 7


def test_water_filling(spark):
    random.seed(13)
    for sizes, weights in (([100, 1, 50, 0, 7], (3, 1, 2)), ([5], (3, 1, 2)), ([1, 1, 1000], (1, 100, 1))):
        rows = [(f"s{i}", n, weights[i % 3]) for i, n in enumerate(sizes)]
        budget = 1.5 * sum(sizes)
        got = {r["s"]: r["target"] for r in mixing.water_fill(spark.createDataFrame(rows, "s string, source_size long, weight int"), budget, 2.0).collect()}
        left, open_, want = budget, {s: (n, w) for s, n, w in rows}, {}
        while open_:
            total = sum(w for _, w in open_.values())
            full = [s for s, (n, w) in open_.items() if left * w / total > 2 * n]
            if not full:
                want |= {s: left * w / total for s, (n, w) in open_.items()}
                break
            for s in full:
                want[s] = 2.0 * open_[s][0]
            left -= sum(want[s] for s in full)
            open_ = {s: x for s, x in open_.items() if s not in full}
        assert all(abs(got[s] - want[s]) < 1e-6 for s in want) and set(got) == set(want)


def test_mixing(spark, tmp_path):
    random.seed(14)
    rows = [(1000 + i, "w " * random.randrange(40), "x", random.choice(("a", "b", "c", "d", None, "")), 0) for i in range(400)] + ODD
    sf = saved(spark, tmp_path, documents=odd(spark, rows))
    got = mixing.op7_mixing_target_weights(spark, sf).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.op7_mixing_target_weights(spark, sf).collect())) and len(got) == len(rows)
    source = {i: s for i, _, _, s, _ in rows}
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault((source[r["doc_id"]], r["source_size"], r["target"]), []).append(r)
    assert len(by) == len({s for _, _, _, s, _ in rows})
    for (_, total, target), some in by.items():
        assert sum(r["size"] for r in some) == total and abs(sum(r["taken"] for r in some) - target) <= max(r["size"] for r in some) / 2 + 1e-6
    assert abs(sum(t for _, _, t in by) - 1.5 * sum(r["size"] for r in got)) < 1e-6
    assert mixing.op7_mixing_target_weights(spark, saved(spark, tmp_path / "e", documents=odd(spark, []))).count() == 0


def test_null_identifiers_are_rows_of_their_own(spark, tmp_path, monkeypatch):
    rows = [(None, f"t{i} " * (i % 5 + 1), "x", "s", 0) for i in range(300)] + [(i, "w " * 10, "x", f"t{i % 3}", 0) for i in range(30)]
    sf = saved(spark, tmp_path, documents=odd(spark, rows))
    got = mixing.op7_mixing_target_weights(spark, sf).collect()
    some = [r for r in got if r["doc_id"] is None]
    assert len(some) == 300 and abs(sum(r["taken"] for r in some) - some[0]["target"]) <= 5
    monkeypatch.setattr(mixing, "SENT", 0)
    assert sorted(map(str, mixing.op7_mixing_target_weights(spark, sf).collect())) == sorted(map(str, got))


def test_no_python_on_the_mixing_path(spark, tmp_path):
    sf = saved(spark, tmp_path, documents=odd(spark))
    plan = mixing.op7_mixing_target_weights(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# 8


def test_bpe(spark, tmp_path):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(15)
    rows = ODD + [(1000 + i, "".join(random.choice("aabcde x.,-\n'sé漢0") for _ in range(random.randrange(80))), "x", "s", 0) for i in range(300)]
    rows += [(2000, "ab" * 1500 + "<|endoftext|>", "x", "s", 0), (2001, "".join(random.choice("abcdefg") for _ in range(900)), "x", "s", 0), (2002, "=" * 3000, "x", "s", 0)]
    got = sorted(((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op8_byte_bpe(spark, saved(spark, tmp_path, documents=odd(spark, rows))).collect()))
    want = []
    for i, text, *_ in rows:
        ids = enc.encode_ordinary(text or "")
        want.append((i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.op8_byte_bpe(spark, saved(spark, tmp_path / "e", documents=odd(spark, []))).count() == 0


def test_texts_are_compared_in_the_worker(spark):
    docs = odd(spark)
    out = bpe.encoded(docs, "text", P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, ["doc_id"], compared=True)
    assert out.columns == ["doc_id", "ids", "round_trip"] and all(r["round_trip"] for r in out.collect()) and out.count() == len(ODD)


def test_a_closed_coder_is_loaded_again():
    import regex

    path, cut = P.path("byte_bpe_multi_50k.tiktoken"), regex.compile(P.PATTERN)
    one = bpe.coder(path)
    want = one([b"some words of it"], cut)
    bpe.close(path)
    bpe.close(path)  # not open
    assert path not in bpe._open and not one.ids_of
    assert bpe.coder(path) is not one and bpe.coder(path)([b"some words of it"], cut) == want
    bpe.close(path)


def test_bpe_of_long_pieces():
    """Against tiktoken; the time grows with the length, not with its square."""
    import time

    import regex
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder, cut = bpe.DuckBPE(path), regex.compile(P.PATTERN)
    random.seed(19)
    letters = lambda some, n: "".join(random.choice(some) for _ in range(n))
    took = {}
    for text in (letters("abcdefghijklmnopqrstuvwxyz", 100_000), letters("abcdefghijklmnopqrstuvwxyz", 200_000), "=" * 50_000, " " * 50_000 + "x", "ab" * 20_000, letters("ab", 9000), letters("日本語漢字", 9000), "-=" * 3000 + "_" * 5000):
        t = time.time()
        ids, back = coder([text.encode()], cut)[0]
        took[len(text)] = time.time() - t
        assert ids == np.array(enc.encode_ordinary(text), "<u4").tobytes() and back == text.encode()
    assert took[200_000] < 4 * took[100_000] + 1 and took[200_000] < 30


# 9


def test_quality(spark, tmp_path):
    random.seed(16)
    words = [f"{random.choice('abcdefgh')}{random.choice('aeiou')}{random.choice('klmnrst')}" for _ in range(300)]
    rows, good = [], {}
    for i in range(400):
        w = [random.choice(words) for _ in range(60)]
        kind = i % 8
        if kind == 0:
            w = [x + "%%%" for x in w]
        elif kind == 1:
            w = [x.upper() + "!!" for x in w]
        elif kind == 2:
            w = [x for y in w[:6] for x in [y] * 10]
        else:
            w = [x + random.choice(("", "", "", ".", ",")) for x in w]
        good[i] = kind > 2
        rows.append((i, " ".join(w), "x", "s", 0))
    got = {r["doc_id"]: r for r in quality.op9_quality_classifier(spark, saved(spark, tmp_path, documents=odd(spark, rows + [(10_000 + k, *r[1:]) for k, r in enumerate(ODD)]))).collect()}
    assert sum(got[i]["keep"] == g for i, g in good.items()) >= 390 and sum((got[i]["label_posterior"] > 0.5) == g for i, g in good.items()) >= 390
    assert len(got) == 400 + len(ODD)
    assert quality.op9_quality_classifier(spark, saved(spark, tmp_path / "e", documents=odd(spark, []))).count() == 0


def test_quality_against_plain_sums(spark, monkeypatch):
    """Label model and scorer by loops over documents and trigrams."""
    from math import exp, log

    monkeypatch.setattr(quality, "ROUNDS", 8)
    random.seed(24)
    some = [f"{random.choice('bcdf')}{random.choice('aeiou')}{random.choice('lmnr')}" for _ in range(60)]
    texts = []
    for i in range(60):
        w = [random.choice(some) + random.choice(("", "", ".", ",")) for _ in range(20)]
        texts.append((i, " ".join(x + "%" for x in w) if i % 5 == 0 else " ".join(w).upper() + "!!" * 9 if i % 5 == 1 else " ".join(w)))
    texts += [(100, None), (101, "ab"), (102, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model, scorer, _ = quality.fitted(docs, "doc_id", "text")
    got = {r["doc_id"]: r for r in quality.scored(docs, "text", model, scorer).collect()}
    raw = [(t or "").encode() for _, t in texts]
    votes = [quality.votes(quality.measured(t)) for t in raw]
    good = [0.05 if 0 in v else 0.95 if 1 in v else 0.5 for v in votes]
    k = len(votes[0])
    for _ in range(50):
        share = sum(good) / len(good)
        p = [[[0.5] * 3 for _ in range(k)] for _ in (0, 1)]
        for v, g in zip(votes, good):
            for c, weight in ((0, 1 - g), (1, g)):
                for i, x in enumerate(v):
                    p[c][i][x] += weight
        p = [[[x / sum(row) for x in row] for row in rows] for rows in p]
        good = [1 / (1 + exp(-(sum(log(p[1][i][x]) - log(p[0][i][x]) for i, x in enumerate(v)) + log(share / (1 - share))))) for v in votes]
    assert all(abs(got[i]["_posterior"] - g) < 1e-9 for (i, _), g in zip(texts, good))
    assert np.allclose(model.accuracies()["signs"], (p[0][0][0] / (1 - p[0][0][2]), p[1][0][1] / (1 - p[1][0][2])))
    grams = [[((t[i] << 16 | t[i + 1] << 8 | t[i + 2]) * 2654435761 % (1 << 32)) >> 16 for i in range(len(t) - 2)] for t in raw]
    extra = [quality.dense(t) for t in raw]
    w, sq, d, dq, bias, bq = Counter(), Counter(), [0.0, 0.0], [0.0, 0.0], 0.0, 0.0
    score = lambda i: 1 / (1 + exp(-(8 * sum(w[x] for x in grams[i]) / max(1, len(grams[i])) + sum(a * b for a, b in zip(d, extra[i])) + bias)))
    for _ in range(8):
        g = [y - score(i) for i, y in enumerate(good)]
        grad = Counter()
        for i, own in enumerate(grams):
            for x in own:
                grad[x] += g[i] * 8 / len(own)
        for x in {*grad, *w}:
            step = grad[x] - 0.01 * w[x]
            sq[x] += step * step
            w[x] += 0.5 * step / (sq[x] + 1e-8) ** 0.5
        for j in (0, 1):
            step = sum(a * e[j] for a, e in zip(g, extra))
            dq[j] += step * step
            d[j] += 0.5 * step / (dq[j] + 1e-8) ** 0.5
        bq += sum(g) ** 2
        bias += 0.5 * sum(g) / (bq + 1e-8) ** 0.5
    assert all(abs(got[i]["_score"] - score(at)) < 1e-6 for at, (i, _) in enumerate(texts))


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(4)
    y = rng.random(20000) < 0.7
    votes = np.stack([np.where(rng.random(20000) < 0.3, quality.NONE, np.where(rng.random(20000) < acc, y, ~y)) for acc in (0.95, 0.9, 0.85, 0.8)], axis=1).astype(int)
    m = quality.LabelModel(list(Counter(map(tuple, votes.tolist())).items()))
    told = [m.p[1, i, 1] / (m.p[1, i, 1] + m.p[1, i, 0]) for i in range(4)]
    assert abs(m.share - 0.7) < 0.06 and np.abs(np.array(told) - [0.95, 0.9, 0.85, 0.8]).max() < 0.06


def test_samples_pass_over_long_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1000)
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 1000)
    ids = [r[0] for r in spark.range(40).orderBy(F.xxhash64("id"), "id").collect()]  # in the order of the samples
    rows = [(k, "word " * (400 if at in (0, 5) else 120 if at in (1, 3) else 4)) for at, k in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in ids], "doc_id long, toxic int")
    assert len(toxicity.sample(docs, labels, "doc_id", "text", "toxic")) == 21
    seen = []
    monkeypatch.setattr(quality.Scorer, "fit", lambda self, texts, y: seen.extend(texts))
    quality.fitted(docs, "doc_id", "text")
    assert len(seen) == 21 and sum(map(len, seen)) == 1000


# 10


def test_shards(spark, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    random.seed(17)
    rows = ODD + [(1000 + i, "".join(random.choice("aáßİıKΣςσ.,'s!0 \n\t\x0b\x85　한") for _ in range(40)), "x", "s", 0) for i in range(400)]
    rows += [(2000, "Hello <|endoftext|> World", "x", "s", 0), (2001, "<|STARTOFTEXT|>a<|startoftext|>b <|endoftext|", "x", "s", 0), (2002, "<|endoftext|>" * 3, "x", "s", 0), (2003, "zz", "x", "s", 0), (2003, "b" * 9, "x", "s", 0)]
    got = sorted(((r["start"], r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in sstable.op10_sstable_token_shards(spark, saved(spark, tmp_path, documents=odd(spark, rows))).collect()))
    want, start = [], 0
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1] or ""), r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((start, i is None, i or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert sstable.op10_sstable_token_shards(spark, saved(spark, tmp_path / "e", documents=odd(spark, []))).count() == 0


def test_other_tokenizer_files_go_to_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    told = json.load(open(path, encoding="utf-8"))
    assert sstable.lowers_and_drops_blanks(told)
    told["normalizer"]["normalizers"].pop()
    assert not sstable.lowers_and_drops_blanks(told)
    json.dump(told, open(other := str(tmp_path / "t.json"), "w"))
    texts = ["Hello World, IT'S here", "", "a <|endoftext|> B"]
    assert sstable.WordEncoder(other, 2)(texts) == [np.array(Tokenizer.from_file(other).encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]


def test_shard_lookup(tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 200)
    path = str(tmp_path / "x.sst")
    ids = sorted(random.Random(18).sample(range(-500, 500), 300) + [7, 7, 7])
    with sstable.opened(f"file://{path}", True) as out:
        w = sstable.ShardWriter(out, 2)
        w.add(sstable.key_of(None), b"\1\0")
        for i in ids:
            w.add(sstable.key_of(i), np.arange(abs(i) % 9, dtype="<u2").tobytes())
        size = w.close()
    assert size == os.path.getsize(path)
    with sstable.opened(f"file://{path}") as f:
        r = sstable.ShardReader(f)
        assert r.blocks > 5 and r.entries == 304 and [sstable.id_of(k) for k, _ in r] == [None, *ids]
        for i in range(-510, 510):
            assert len(r.lookup(i)) == ids.count(i)
        assert r.lookup(None) == [b"\1\0"] and len(r.lookup(7)) == ids.count(7)
    data = bytearray(open(path, "rb").read())
    data[3] ^= 1
    open(path, "wb").write(data)
    with sstable.opened(f"file://{path}") as f, pytest.raises(ValueError):
        list(sstable.ShardReader(f))


# queries


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    db = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, SF).select(*names)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


#: Names that operators use inside.
FURTHER = ("_lost", "_time", "_times", "_size", "_dropped", "_lines", "_keep", "_score", "_predicted", "_source", "_digest", "r", "k", "row", "component_id")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C

    rows = toxic_rows(600, 8)
    docs = [r[:5] for r in rows] + [(5000, rows[1][1], "en", "s", 0), (5001, rows[1][1].replace("w1 ", "w2 ", 1), "en", "t", 0), (5002, "a shared boiler plate line\nown text of this one here", "en", "t", 0), (5003, "a shared boiler plate line\nother words are in this one", "en", None, 0)]
    plain = spark.createDataFrame(docs, DOC).withColumns({c: F.col("doc_id") * 10 + i for i, c in enumerate(FURTHER)})
    sf = saved(spark, tmp_path, documents=plain, labels=spark.createDataFrame([(r[0], 1, int(r[5])) for r in rows], "doc_id long, quality int, toxic int"))
    step = plain
    kept = []
    for name, stage in C.STAGES:
        before = step
        step = stage(spark, step, sf)
        step.write.parquet(f"{tmp_path}/{name}.parquet")
        step = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        kept.append(step.count())
        if name != C.STAGES[-1][0]:
            assert step.columns == before.columns
            assert all(r[c] == r["doc_id"] * 10 + i for r in step.collect() for i, c in enumerate(FURTHER))
    ids = lambda k: {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/{C.STAGES[k][0]}.parquet").collect()}
    assert ids(0) == {d[0] for d in docs} - {r[0] for r in rows if r[5]}
    lines = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/{C.STAGES[1][0]}.parquet").collect()}
    assert lines[5003] == "other words are in this one" and lines[5000] == "" and lines[5002].count("\n") == 1
    assert 5001 not in ids(2) and {5002, 5003} <= ids(2)
    assert all(r["round_trip"] for r in step.collect())
    assert C.run(spark, sf).count() == kept[-1]
    empty = plain.limit(0)
    for _, stage in C.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0


def test_pieces_are_kept_for_a_stage_and_go_with_it():
    import public_tokenizers
    import regex

    from verdigraph.llm import bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    one = bpe.coder(path, 7)
    one([b"unheardofwords anotherone"], regex.compile(public_tokenizers.PATTERN))
    assert bpe.coder(path, 7) is one and len(one.ids_of) == 2  # the next task of the stage finds them
    assert not bpe.coder(path, 8).ids_of
    bpe._open.clear()
