import numpy as np

from sysweave.llm import quality, weak


def test_reliabilities_are_found(rng):
    """Votes drawn with known reliabilities give these back, and most labels."""
    draw = np.random.default_rng(3)
    truth = draw.random(20_000) < 0.3
    right = [(0.9, 0.1), (0.7, 0.2), (0.6, 0.05), (0.8, 0.4)]
    votes = np.stack(
        [np.where(draw.random(len(truth)) < np.where(truth, a, b), 1, -1) for a, b in right], 1
    )
    votes[draw.random(votes.shape) < 0.1] = 0
    table, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, prior, found = weak.reliabilities(table, counts, np.zeros(len(table), int), rounds=2000)
    assert abs(prior[0] - 0.3) < 0.05
    assert np.abs(found - np.array(right)).max() < 0.08
    assert ((p[at.ravel()] > 0.5) == truth).mean() > 0.88


def test_many_patterns_of_votes(spark):
    """Posteriors reach the sample whatever the number of patterns; labels do not replace them."""
    draw = np.random.default_rng(4)
    rows = [(i, [int(v) for v in draw.integers(-1, 2, 9)], (None, 0.0, 1.0)[i % 3]) for i in range(9000)]
    votes = spark.createDataFrame(rows, "doc_id long, quality array<int>, known_quality double")
    p = dict(quality.posteriors(votes, "quality"))
    assert len(p) > 5000
    sample = quality.sample_of(votes, "quality", list(p.items()), 300).collect()
    known = {i: k is not None for i, _, k in rows}
    for good in (True, False):
        for given in (True, False):
            assert sum((r["label"] >= 0.5) == good and known[r["doc_id"]] == given for r in sample) == (225 if given else 75)
    of = {i: p[",".join(map(str, v)) + "," + ("-" if k is None else str(int(k)))] for i, v, k in rows}
    assert all(of[r["doc_id"]] == r["label"] and 0 < r["label"] < 1 for r in sample)


def plain_posterior(table, counts, label, start, rounds=100):
    """EM over patterns, vote by vote."""
    prior, right = 0.5, [list(start) for _ in table[0]]
    for _ in range(rounds):
        p = []
        for votes, known in zip(table, label, strict=True):
            if known:
                p.append(quality.KNOWN if known > 0 else 1 - quality.KNOWN)
                continue
            one, two = prior, 1 - prior
            for v, (a, b) in zip(votes, right, strict=True):
                if v:
                    one, two = one * (a if v > 0 else 1 - a), two * (b if v > 0 else 1 - b)
            p.append(one / (one + two))
        prior = (sum(c * x for c, x in zip(counts, p, strict=True)) + 1) / (sum(counts) + 2)
        for j in range(len(right)):
            for side, of in ((0, lambda x: x), (1, lambda x: 1 - x)):
                cast = [(v[j], c * of(x)) for v, c, x in zip(table, counts, p, strict=True) if v[j]]
                right[j][side] = (sum(w for v, w in cast if v > 0) + 4 * start[side]) / (sum(w for _, w in cast) + 4)
    return p


def test_posteriors_against_vote_by_vote(spark):
    draw = np.random.default_rng(5)
    rows = [(i, [int(v) for v in draw.integers(-1, 2, 3)], (None, 0.0, 1.0, None)[int(draw.integers(0, 4))]) for i in range(400)]
    votes = spark.createDataFrame(rows, "doc_id long, quality array<int>, known_quality double")
    got = dict(quality.posteriors(votes, "quality"))
    seen = {}
    for _, v, k in rows:
        if any(v) or k is not None:
            seen[tuple(v), k] = seen.get((tuple(v), k), 0) + 1
    label = [0 if k is None else 1 if k else -1 for _, k in seen]
    want = plain_posterior([v for v, _ in seen], list(seen.values()), label, quality.START["quality"])
    for (v, k), x in zip(seen, want, strict=True):
        name = ",".join(map(str, v)) + "," + ("-" if k is None else str(int(k)))
        assert abs(got[name] - x) < 1e-4


def accuracy(spark, sf_dir, labels):
    judged = quality.judge(quality.read(spark, sf_dir, "documents"), labels)
    known = quality.read(spark, sf_dir, "labels").withColumnRenamed("quality", "good")
    return judged.join(known, "doc_id").where("n_words >= 20").collect()


def test_without_labels(spark):
    rows = accuracy(spark, "/root/testdata/sf0.01", None)
    clean = [r["kept"] for r in rows if r["good"] and not r["toxic"]]
    junk = [r["kept"] for r in rows if not r["good"]]
    assert np.mean(clean) > 0.98 and np.mean(junk) < 0.1


def test_labels_of_others_help(spark):
    """Half of the labels are given; the other half is held out."""
    sf_dir = "/root/testdata/sf0.1"
    labels = quality.read(spark, sf_dir, "labels").where("doc_id % 2 = 0")
    rows = [r for r in accuracy(spark, sf_dir, labels) if r["doc_id"] % 2]
    assert np.mean([r["kept"] for r in rows if r["good"] and not r["toxic"]]) > 0.98
    assert np.mean([r["kept"] for r in rows if not r["good"]]) < 0.05
    assert np.mean([r["kept"] for r in rows if r["toxic"]]) < 0.25


def test_odd_documents(spark, odd_documents):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    for given in (None, labels, labels.limit(0)):
        got = quality.judge(odd_documents, given).collect()
        assert len(got) == odd_documents.count()
        assert not any(r["kept"] for r in got if r["doc_id"] in (1, 2, 3))
    assert quality.judge(odd_documents.limit(0), labels).collect() == []
    kept = quality.good_documents(odd_documents, labels)
    assert kept.columns == odd_documents.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["kept"]} | {None} & {
        r["doc_id"] for r in kept.collect()
    }
