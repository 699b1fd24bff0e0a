import collections

from sysweave.llm import neardup


def plain(rows, k, percent=80):
    """{doc_id: (set size, component)} by counting common shingles."""
    sets = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        n = min(k, len(w))
        sets[doc] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()
    holders, parent = collections.defaultdict(list), {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for doc in sorted(sets):
        common = collections.Counter(o for s in sets[doc] for o in holders[s])
        for other, n in common.items():
            if 100 * n >= percent * (len(sets[doc]) + len(sets[other]) - n):
                a, b = sorted((root(doc), root(other)))
                parent[b] = a
        for s in sets[doc]:
            holders[s].append(doc)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
    return words


def made(rng):
    """Chains of edits, groups around the threshold, copies, short texts."""
    rows = []
    for g in range(8):
        words = [f"g{g}x{i}" for i in range(60)]
        for j in range(50):
            new = edited(rng, words, rng.randint(0, 5))
            words = new if j % 3 == 0 else words
            rows.append(" ".join(new).upper() if j % 7 == 0 else "\n ".join(new))
    rows += [None, "", " \n", " a", "a", "A", "b c", "b  C", "b c d"] + rows[:30]
    return list(enumerate(rows))


def test_against_counting(spark, rng):
    rows = made(rng)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for k in (2, 5):
        want = plain(rows, k)
        got = neardup.near_duplicates(df, k).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_large_buckets_are_split(spark, rng, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rows = made(rng)[:250]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = neardup.near_duplicates(df, 2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain(rows, 2)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(40)] + [(200, 199), (7, 7), (5, 4)]
    got = neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {i: 0 for i in range(41)} | {n: 100 for n in (100, 199, *range(200, 240))}
    assert {r["node"]: r["component"] for r in got} == want
    assert len(got) == len(want)


def test_odd_documents(spark, odd_documents):
    got = neardup.near_duplicates(odd_documents).collect()
    assert len(got) == odd_documents.count()
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["component_id"] == i and by[i]["n_shingles"] == 0 for i in (1, 2, 3))
    assert [r["kept"] for r in got if r["doc_id"] == 5] == [True, True]
    assert by[None]["component_id"] is None and by[None]["kept"]
    same = spark.createDataFrame([(None, "a b"), (3, "a b")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(same).collect()} == {(None, 3), (3, 3)}
    assert neardup.near_duplicates(odd_documents.limit(0)).collect() == []


def test_given_documents(spark):
    rows = [tuple(r) for r in neardup.read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    got = neardup.op5_neardup(spark, "/root/testdata/sf0.01").collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain(rows, 2)


def test_the_last_round_names_every_pair_of_a_large_bucket(spark, monkeypatch):
    """Nodes that agree in all minima but are linked with nothing yet: no cap leaves a pair out."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    same = bytes(neardup.ROWS * neardup.BANDS)
    for component in (lambda n: n, lambda n: n % 3, lambda n: 0 if n < 35 else n):
        rows = [(n, component(n), same) for n in range(40)]
        nodes = spark.createDataFrame(rows, "node long, component long, minima binary")
        got = neardup.candidates(nodes, 80, neardup.ROUNDS[-1], 0).collect()
        want = {(a, b) for a in range(40) for b in range(a + 1, 40) if component(a) != component(b)}
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_near_copies_that_are_not_linked_make_no_rows(spark, rng):
    """A cell gives fewer links than it has nodes, however many pairs of it may be linked or are."""
    words = [f"w{i}" for i in range(100)]
    rows = [(n, " ".join(edited(rng, words, rng.choice([1, 2, 8, 9])))) for n in range(120)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = neardup.sets_of(texts, 2).selectExpr("doc_id node", "doc_id component", "minima", "n_shingles")
    pairs = neardup.candidates(sets, 80, None, 0).count()
    found = [tuple(r) for r in neardup.links(sets, texts, 2, 80, 0).collect()]
    want = plain(rows, 2)
    assert pairs > 20 * len(rows) and len(found) < 10 * len(rows)
    got = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(found, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n, _ in rows} == {n: c for n, (_, c) in want.items()}


def test_sets_too_large_for_a_tile_are_compared_in_halves(spark, rng, monkeypatch):
    monkeypatch.setattr(neardup, "HELD", 300)
    rows = made(rng)[:250]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = neardup.near_duplicates(df, 2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain(rows, 2)
    block = [(n, n, bytes(neardup.ROWS * neardup.BANDS), 200) for n in range(6)]
    earlier = neardup.longer(neardup.WIDE, 0)[0][:0]
    tiles = neardup.tiles_in(block, 80, earlier)
    held = {t: {n for u, n, _ in tiles if u == t} for t, _, _ in tiles}
    assert all(200 * len(h) <= 2 * (neardup.HELD + 200) for h in held.values())
    assert all(any({a, b} <= h for h in held.values()) for a in range(6) for b in range(a))


def test_a_group_in_many_bands_is_gone_through_once(spark, rng, monkeypatch):
    """Near copies that are not linked agree in most bands: no table has a row for each of them."""
    words = [f"w{i}" for i in range(200)]
    rows = [(n, " ".join(edited(rng, words, rng.choice([3, 20, 22])))) for n in range(120)]
    counts, written = [], neardup.cut

    def cut(df, *a):
        df = written(df, *a)
        if df.columns[:1] == ["key"] and "node" in df.columns and "lead" not in df.columns:
            counts.append(df.count())
        return df

    monkeypatch.setattr(neardup, "cut", cut)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = neardup.near_duplicates(df, 2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain(rows, 2)
    assert counts and sum(counts) < 12 * len(rows)


def test_groups_too_large_to_be_taken_whole_get_longer_bands(spark, rng, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = made(rng)[:250]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for most in (0, 2):
        monkeypatch.setattr(neardup, "CELLS", most)
        got = neardup.near_duplicates(df, 2).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain(rows, 2)
