import re
import zlib

import numpy as np

from tidemark.llm import quality


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    even = labels.where("doc_id % 2 = 0")
    got = {r.doc_id: r for r in quality.classify(docs, quality.fit(docs, even)).collect()}
    assert len(got) == docs.count()
    rest = [(got[r.doc_id], r.quality) for r in labels.where("doc_id % 2 = 1").collect()]
    good, bad = [r for r, q in rest if q == 1], [r for r, q in rest if q == 0]
    order = np.mean([g.score > b.score for g in good for b in bad])
    print(order, np.mean([r.keep for r in good]), np.mean([not r.keep for r in bad]))
    assert order > 0.97 and np.mean([r.keep for r in good]) > 0.95
    assert np.mean([not r.keep for r in bad]) > 0.8
    assert all(0 <= v <= 1 for r in got.values() for v in (r.p_content, r.p_meta, r.score))


def test_odd_rows(spark, make, folder):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (1, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = make("fine text here", "bad $$$ ### text", "other", None, "", " \n", "fine text here")
    rows = {r.doc_id: r for r in quality.op5_quality(spark, folder(documents=docs, labels=labels)).collect()}
    assert not any(rows[i].keep or rows[i].score for i in (3, 4, 5))
    assert rows[0].score == rows[6].score
    none = {r.doc_id: r for r in quality.op5_quality(spark, folder(documents=docs, labels=labels.limit(0))).collect()}
    assert none[0].keep and none[0].score == 0.5 and not none[3].keep
    assert quality.op5_quality(spark, folder(documents=docs.limit(0), labels=labels)).count() == 0


def plain_views(t, source, lang):
    """Both views of a document, character by character and word by word."""
    raw = t.encode()
    words = re.findall(rb"[^\x09-\x0d\x20]+", raw)
    content = np.zeros(quality.CONTENT)
    for w in words:
        half = quality.CONTENT // 2
        content[zlib.crc32(w) % half] += 1
        content[half + zlib.crc32(w[-3:], 1) % half] += 1
    content = np.sqrt(content / max(1, len(words)))
    kind = lambda b: 7 if b >= 128 else 0 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 2 if 48 <= b <= 57 else 4 if b == 10 else 3 if b in b" \t\r\v\f" else 5 if b in b".,;:'\"-()?" else 6
    kinds, size = [kind(b) for b in raw], max(1, len(raw))
    ends = [i for i, b in enumerate(raw) if b == 10]
    closed = [raw[max(i - 1, 0)] in b".!?" for i in ends]
    lines = [np.log1p(len(t)), np.log1p(len(ends)), np.log1p(size / (len(ends) + 1)), np.mean(closed) if closed else 1.0]
    meta = [kinds.count(k) / size for k in range(8)] + lines + [sum(a == b == 6 for a, b in zip(kinds, kinds[1:])) / size, sum(map(len, words)) / max(1, len(words)), len(set(words)) / max(1, len(words)), np.log1p(len(words))]
    one = np.zeros(quality.SOURCES + quality.LANGS)
    one[zlib.crc32(source.encode()) % quality.SOURCES] = 1
    one[quality.SOURCES + zlib.crc32(lang.encode()) % quality.LANGS] = 1
    return content, np.concatenate([meta, one])


def plain_logistic(x, y, weight):
    """The same descent as the operator's, on standard scores, in double precision."""
    mean, dev = x.mean(0), x.std(0)
    z = np.where(dev > 0, (x - mean) / np.maximum(dev, 1e-3), 0)
    weight = weight / weight.sum()
    theta = np.zeros(x.shape[1] + 1)
    theta[-1] = np.log(((weight * y).sum() + 1e-3) / ((weight * (1 - y)).sum() + 1e-3))
    m = v = np.zeros_like(theta)
    for t in range(1, 81):
        g = weight * (1 / (1 + np.exp(-np.clip(z @ theta[:-1] + theta[-1], -30, 30))) - y)
        grad = np.append(z.T @ g + 1e-3 * theta[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.05 / (1 + t / 60) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return lambda q: np.where(dev > 0, (q - mean) / np.maximum(dev, 1e-3), 0) @ theta[:-1] + theta[-1]


def plain_co_training(views, y):
    fitted, pool = [i for i in range(len(y)) if y[i] >= 0], [i for i in range(len(y)) if y[i] < 0]
    prior = np.mean([y[i] for i in fitted])
    guesses = [{}, {}]
    for k in range(quality.ROUNDS + 1):
        scores = []
        for v in (0, 1):
            rows = fitted + sorted(guesses[v])
            label = np.array([y[i] for i in fitted] + [guesses[v][i] for i in sorted(guesses[v])], float)
            share = label.mean()
            weight = np.where(label == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)) * np.array([1.0] * len(fitted) + [0.5] * len(guesses[v]))
            scores.append(plain_logistic(views[v][rows], label, weight))
        if k < quality.ROUNDS:
            for v in (0, 1):
                s = scores[v](views[v][pool])
                order = sorted(range(len(pool)), key=lambda i: (s[i], i))
                most = max(2, int(quality.SHARE * len(pool)))
                bad = max(1, round(most * (1 - prior)))
                guesses[1 - v].update({pool[i]: 0 for i in order[:bad] if s[i] < -1})
                guesses[1 - v].update({pool[i]: 1 for i in order[::-1][: most - bad] if s[i] > 1})
    return scores, guesses


def test_co_training_matches_a_plain_one(spark):
    """All documents of a small table are in the sample: the same labels, pool and hold-out, worked out plainly."""
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    label = {}
    for r in labels.where("doc_id is not null and quality is not null").collect():
        label[r.doc_id] = min(label.get(r.doc_id, 1), r.quality)
    rows = sorted((r.doc_id, r.text or "", r.source, r.lang) for r in docs.collect())
    y = np.array([label.get(i, -1) for i, *_ in rows])
    views = [np.array(v) for v in zip(*(plain_views(t, s, lang) for _, t, s, lang in rows))]
    scores, guesses = plain_co_training(views, y)
    assert all(y[i] < 0 for g in guesses for i in g) and any(guesses)
    got = {r.doc_id: r for r in quality.classify(docs, model).collect()}
    (a, c), (a2, c2) = model.shape
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    p = sigmoid(a * scores[0](views[0]) + c), sigmoid(a2 * scores[1](views[1]) + c2)
    assert max(abs(got[i].p_content - p[0][k]) for k, (i, *_) in enumerate(rows)) < 0.02
    assert max(abs(got[i].p_meta - p[1][k]) for k, (i, *_) in enumerate(rows)) < 0.02


def test_labelled_documents_are_not_in_the_pool(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    seen = {}
    monkeypatch.setattr(quality.Model, "co_train", lambda self, x, y, fold: seen.update(y=y) or self)
    quality.fit(docs.selectExpr("cast(doc_id as int) as doc_id", "text", "source", "lang"), labels)
    known = {r.doc_id for r in labels.where("quality is not null").collect()}
    held = [r.doc_id for r in docs.collect()]
    assert (seen["y"] >= 0).sum() == sum(i in known for i in held)
    assert (seen["y"] < 0).sum() == sum(i not in known for i in held)
