"""Whole scores, spans, bins and stages against plain recomputations."""
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from arbor.llm import langid, packing, quality, secrets, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_votes(docs, labels):
    """Every cosine with every labelled vector; of equals the earlier example."""
    m = quality.fit(docs, labels)
    texts = [r.text or "" for r in docs.collect()]
    counts = quality.Counter().counts(texts)
    got = m.score(counts)
    for i, t in enumerate(texts):
        if not counts[i].any():
            assert got[i] == m.prior
            continue
        z = m.latent(m.scaled(counts[i:i + 1]))
        sim = (z @ m.known.T)[0]
        near = sorted(range(len(sim)), key=lambda k: (-sim[k], k))[:quality.NEIGHBOURS]
        w = [max(0.0, float(sim[k])) ** quality.POWER * float(m.weight[k]) for k in near]
        assert got[i] == pytest.approx(sum(a * m.y[k] for a, k in zip(w, near)) / sum(w), abs=1e-4)


def test_quality_ties_go_to_the_earlier_example(monkeypatch):
    """Texts of the same words in another order have equal vectors."""
    monkeypatch.setattr(quality, "NEIGHBOURS", 2)
    texts = ["one two three", "three two one", "two one three", "other words here"]
    m = quality.Model(texts, [1, 0, 0, 0])
    m.weight = np.ones(4, np.float32)
    assert m.score(quality.Counter().counts(["one three two"]))[0] == pytest.approx(0.5, abs=1e-5)


def plain_grams(text):
    t = "".join(c if c.isalpha() else "\0" for c in text.lower())
    return {t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def test_langid_kernel_and_ridge(docs):
    """The kernel over sets of strings, its Nystroem features and the ridge's solution."""
    rows = [(r.text, r.lang) for r in docs.where("text is not null and lang is not null").limit(60).collect()]
    texts, langs = [t for t, _ in rows], [x for _, x in rows]
    m = langid.Model(texts, langs, landmarks=12)
    names = sorted(set(langs))
    by = {n: [i for i, x in enumerate(langs) if x == n] for n in names}
    marks = [by[n][k] for k in range(60) for n in names if k < len(by[n])][:max(12, len(names))]
    sets = [plain_grams(t) for t in texts]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    k = np.array([[kernel(a, sets[j]) for j in marks] for a in sets])
    w, v = np.linalg.eigh(k[marks])
    x = np.column_stack([k @ v @ np.diag(np.maximum(w, 1e-6) ** -.5) @ v.T, np.ones(len(texts))])
    y = np.array([[1.0 if a == n else -1.0 for n in names] for a in langs])
    beta = np.linalg.solve(x.T @ x + langid.RIDGE * len(texts) * np.eye(x.shape[1]), x.T @ y)
    assert np.allclose(m.margins(texts)[0], x @ beta, atol=2e-3)


def test_langid_scripts_and_many_languages(spark):
    rng = random.Random(2)
    ideographs = [chr(0x4E00 + i) for i in range(600)]
    rows = [(i, "".join(rng.choice(ideographs[:300] if i % 2 else ideographs[300:]) for _ in range(120)), "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df, langid.fit(df)).where("held_out").toPandas().merge(df.toPandas(), on="doc_id")
    assert len(got) > 50 and (got.lang == got.lang_pred).mean() > 0.95
    letters = [chr(c) for c in range(0x3400, 0x3400 + 5000)]
    rows = [(i, " ".join("".join(rng.choice(letters[10 * (i % 500):10 * (i % 500) + 10]) for _ in range(4)) for _ in range(12)), f"l{i % 500}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.fit(df)
    got = langid.identify(df, m).where("held_out").toPandas().merge(df.toPandas(), on="doc_id")
    assert len(m.names) == 500 and (got.lang == got.lang_pred).mean() > 0.95


def test_toxicity_whole_score(docs, labels):
    """Weights, every cosine, the neighbours and the vote from dictionaries."""
    m = toxicity.fit(docs, labels)
    by = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = [(i, by[i], int(y)) for i, y in zip(m.example, m.y)]
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    n = [sum(y == k for _, _, y in rows) for k in (0, 1)]
    counts = Counter(r.toxic for r in labels.collect() if r.doc_id is not None and __import__("zlib").crc32(str(r.doc_id).encode()) % 5 != 0)
    total = counts[0] + counts[1]
    before, df = [defaultdict(set), defaultdict(set)], Counter()
    for _, t, y in rows:
        prev, met = None, set()
        for w in words(t):
            if w not in met:
                before[y][w].add(prev)
                df[w] += counts[y] / n[y]
                met.add(w)
            prev = w
    def weight(w):
        if w not in df:
            return math.log(1 + total) * toxicity.FLOOR
        a, c = len(before[1][w]), len(before[0][w])
        odds = math.log((a + .5) / (n[1] + 1)) - math.log((c + .5) / (n[0] + 1))
        return math.log((1 + total) / (1 + df[w])) * (toxicity.FLOOR + max(0, abs(odds) - toxicity.CERTAIN * math.sqrt(1 / (a + .5) + 1 / (c + .5))))

    def vector(t):
        v = {w: (1 + math.log(c)) * weight(w) for w, c in Counter(words(t)).items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / size for w, x in v.items()}

    known = [vector(t) for _, t, _ in rows]
    for t in list(by.values())[:80] + ["", "...", "qqqq zzzz"]:
        q = vector(t)
        cos = [sum(x * k.get(w, 0) for w, x in q.items()) for k in known]
        near = [k for k in sorted(range(len(rows)), key=lambda k: (-cos[k], k))[:toxicity.NEIGHBOURS] if cos[k] > 0]
        share = [counts[k] / n[k] / max(counts[j] / n[j] for j in (0, 1)) for k in (0, 1)]
        w = [cos[k] ** 2 * share[rows[k][2]] for k in near]
        base = counts[1] / total
        want = (sum(a * rows[k][2] for a, k in zip(w, near)) + toxicity.PRIOR * base) / (sum(w) + toxicity.PRIOR)
        got, evidence = m.score(t)
        assert got == pytest.approx(want, abs=1e-9)
        assert bool(evidence) == bool(near)


def test_secret_spans(docs):
    """All spans of the scan, the Markov ones included, by plain loops."""
    ratios = secrets.train(docs)
    got = {r.doc_id: r.spans for r in secrets.report(docs, ratios).collect()}
    flags = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    for r in docs.collect():
        t = r.text or ""
        base = [(m.start(), 0, m.end()) for m in re.finditer(flags, t, re.A) if len(m[2]) >= 8]
        base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]{12,}", t)] + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]{32,}", t)]
        spans = list(base)
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", t):
            if any(a < m.end() and b > m.start() for a, _, b in base):
                continue
            llr = sum(ratios[(ord(x) - 33) * secrets.STATES + ord(y) - 33] for x, y in zip(m[0], m[0][1:]))
            if llr >= secrets.LEAST_TOTAL and llr >= secrets.LEAST_MEAN * len(m[0]):
                spans.append((m.start(), 3, m.end()))
        assert got[r.doc_id] == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_packing_query(docs):
    """Each shard's bins by a search of all open bins for every piece."""
    capacity = 4096
    got = pd.DataFrame([r.asDict() for r in packing.pack(docs, capacity, shard_rows=40).collect()])
    text = {r.doc_id: (r.text or "", r.source) for r in docs.collect()}
    got["shard"] = got.bin_id // (1 << 32)
    from xxhash import xxh64_intdigest  # any injective name of a text will do for clusters

    for _, g in got.groupby("shard"):
        last = g.sort_values("piece").groupby("doc_id").tail(1)
        assert (last.length == [len(text[i][0].encode()) - p * capacity for i, p in zip(last.doc_id, last.piece)]).all()
        groups = defaultdict(lambda: defaultdict(int))
        bins: dict[int, list] = {}
        # ties of length follow the text's own length, then the id
        order = sorted(last.itertuples(), key=lambda r: (-r.length, -len(text[r.doc_id][0].encode()), r.doc_id))
        for r in order:
            body, source = text[r.doc_id]
            name = xxh64_intdigest(body.encode())
            fit = [(left, b) for b, (left, s, c) in bins.items() if left >= r.length and (source is None or source not in s) and name not in c]
            b = min(fit)[1] if fit else len(bins)
            left, s, c = bins.setdefault(b, [capacity, set(), set()])
            groups[b][r.doc_id] = capacity - left
            bins[b][0] -= r.length
            s.add(source)
            c.add(name)
            assert (r.bin_id % (1 << 32), r.bin_offset) == (b, capacity - left)


corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, docs, labels):
    """Every stage on its own input, rows and texts by plain recomputation."""
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda d: sorted((r.doc_id, r.text) for r in d.collect())
    model = toxicity.fit(docs, labels)
    assert rows(stages["toxicity"](spark, docs, SF)) == sorted((r.doc_id, r.text) for r in docs.collect() if model.score(r.text or "")[0] < 0.5)

    pairs = [(r.doc_id, r.text or "") for r in docs.collect()]
    groups = similar_groups([t for _, t in pairs])
    least = {}
    for (d, t), g in zip(pairs, groups):
        least[g] = min(least.get(g, (d, t)), (d, t))
    assert rows(stages["simhash"](spark, docs, SF)) == sorted(least.values())

    want = []
    seen = Counter(hash(t.encode()[i:i + 200]) for _, t in pairs for i in range(len(t.encode()) - 199))
    for d, t in pairs:
        raw = t.encode()
        gone = np.zeros(len(raw) + 1, np.int64)
        for i in range(len(raw) - 199):
            if seen[hash(raw[i:i + 200])] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        out, at = [], 0
        for c in t:  # a character goes if all its bytes do
            size = len(c.encode())
            if not gone[at:at + size].all():
                out.append(c)
            at += size
        want.append((d, "".join(out)))
    assert rows(stages["suffix_array"](spark, docs, SF)) == sorted(want)

    spans = {r.doc_id: r.spans for r in secrets.report(docs, secrets.train(docs)).collect()}
    masked = []
    for d, t in pairs:
        out, pos = [], 0
        for _, a, b in (s.split(":") for s in spans[d].split(",") if s):
            if int(a) >= pos:
                out += [t[pos:int(a)], secrets.MASK]
            pos = max(pos, int(b))
        masked.append((d, "".join(out) + t[pos:]))
    assert rows(stages["secrets"](spark, docs, SF)) == sorted(masked)


def similar_groups(texts):
    """Groups by links of a Jaccard similarity of 0.8 or more over five-word shingles."""
    def shingles(t):
        w = t.encode().lower().split()
        return {b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= 0.8 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def test_similar_texts_are_found(spark):
    """Copies with a word changed in forty, twenty or twelve; crowded cells and groups."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    texts = []
    for k in range(120):
        base = [word() for _ in range(rng.randint(30, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            every = rng.choice((40, 25, 12))
            texts.append(" ".join(word() if rng.random() < 1 / every else w for w in base))
    want = similar_groups(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "name long, text string")
    for sizes in ({}, {"cell_rows": 5, "group_rows": 2}):
        comp = {r.name: r.component for r in simhash.similar_groups(df, **sizes).collect()}
        got = [comp.get(i, i) for i in range(len(texts))]
        linked = lambda g: {(i, j) for i in range(len(g)) for j in range(i) if g[i] == g[j]}
        assert linked(got) <= linked(want) and len(linked(got)) >= 0.95 * len(linked(want)) > 20
