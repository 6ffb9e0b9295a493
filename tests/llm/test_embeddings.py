import numpy as np

from tablesmith.llm import embeddings


def brute(rows):
    ids = [r[0] for r in rows]
    v = []
    for _, e in rows:
        good = e is not None and len(e) and None not in e and np.isfinite(e).all() and np.any(e)
        x = np.array(e, float) / np.abs(np.array(e, float)).max() if good else None
        v.append(x / np.sqrt((x * x).sum()) if good else None)
    near = [[j for j in range(len(v)) if j != i and v[i] is not None and v[j] is not None and len(v[i]) == len(v[j])
             and v[i] @ v[j] >= 0.95] for i in range(len(v))]
    out = []
    for i in range(len(v)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(ids[j] for j in seen)
        out.append((ids[i], len(near[i]), least, least == ids[i]))
    return sorted(out)


def got(spark, rows):
    df = spark.createDataFrame([(i, e, "x", 3) for i, e in rows], "vec_id long, embedding array<double>, id string, w int")
    return sorted(tuple(r) for r in embeddings.near_vectors(df).collect())


def test_chains_copies_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 9)  # the large-bucket way on small buckets
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 24))
    rows = [base[k % 30] + rng.normal(size=24) * s for k, s in enumerate(rng.uniform(0, 0.25, 300))]
    rows += [base[0]] * 40 + [base[1] * 1e300, base[2] * 1e-300, -base[3], np.zeros(24), base[5][:8], base[5][:8] * 2]
    rows = [x.tolist() for x in rows] + [None, [], [None] * 24, [float("nan")] * 24, [float("inf")] + [0.0] * 23, [3.0], [1.0]]
    rows = list(enumerate(rows))
    rows.append(rows[0])
    assert got(spark, rows) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_vectors(df).collect() == []


def test_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    a = embeddings._unit([x.tobytes() for x in rng.normal(size=(3000, 64))])
    z = rng.normal(size=a.shape)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95 ** 2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    met = [set(x) & set(y) for x, y in zip(embeddings.bucket_keys(a).tolist(), embeddings.bucket_keys(b).tolist())]
    assert np.mean([bool(m) for m in met]) > 0.99
    apart = [set(x) & set(y) for x, y in zip(embeddings.bucket_keys(a).tolist(), embeddings.bucket_keys(a[1:]).tolist())]
    assert np.mean([bool(m) for m in apart]) < 0.01
