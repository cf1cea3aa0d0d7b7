"""Line dedup, SimHash, vectors: against brute force on small tables."""

import itertools
import pathlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from emulon.llm import itq, lines, postings, simhash, vectors
from emulon.llm.components import components
from emulon.runtime import shared_dir


def groups(n, linked):
    """Smallest member of each item's component."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(3)
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(500, i) for i in range(501, 560)]
    mixed = [tuple(map(int, rng.integers(0, 90, 2))) for _ in range(60)]
    links = path + star + mixed + [(7, 7), (3, 88), (88, 3)]
    want = dict(enumerate(groups(600, links)))
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(want[n] == r for n, r in got.items())
    assert {n for a, b in links if a != b for n in (a, b)} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def line_words(line):
    return frozenset(re.split(r"[ \t\n\x0b\f\r]+", line.lower())) - {""}


def brute_lines(rows):
    """Rows of (key, text) to the texts that are left."""
    order = [(2**63 - 1 if k is None else k, n, line_words(c)) for k, t in rows if t is not None for n, c in enumerate(t.split("\n"))]
    first = {}
    for k, n, words in sorted(order, key=lambda x: x[:2]):
        first.setdefault(words, (k, n))

    def goes(k, n, words):
        if not words:
            return False
        if (k, n) != first[words]:
            return True
        return any(at < (k, n) and 5 * len(w & words) >= 4 * len(w | words) for w, at in first.items() if w)

    out = []
    for k, t in rows:
        key = 2**63 - 1 if k is None else k
        out.append((k, None if t is None else "\n".join(
            c for n, c in enumerate(t.split("\n")) if not goes(key, n, line_words(c)))))
    return out


def test_line_dedup(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(60):
        picked = []
        for _ in range(int(rng.integers(1, 8))):
            if texts and rng.random() < 0.4:
                line = str(rng.choice(texts[int(rng.integers(len(texts)))].split("\n"))).split(" ")
                if len(line) > 1 and rng.random() < 0.7:
                    line[int(rng.integers(len(line)))] = str(rng.choice(words)).upper()
            else:
                line = list(rng.choice(words, int(rng.integers(1, 25))))
            picked.append(" ".join(line))
        texts.append("\n".join(picked))
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "\n \n"), (None, texts[3]), (903, "hot line here\n" * 50)]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, words string, size int")
    got = lines.dedup_lines(docs)
    assert got.columns[:4] == docs.columns
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=key) == sorted(brute_lines(rows), key=key)
    plans = got._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plans)


def test_no_row_holds_the_table_of_rarities(spark, monkeypatch):
    plans, write = [], lines.cut_lineage
    monkeypatch.setattr(lines, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    lines.later_matches(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    with_table = [p for p in plans if "scalar-subquery" in p and "prefix" in p]
    assert with_table and not any("rarity#" in p for p in with_table)


def test_steps_on_the_way_go(spark):
    docs = spark.createDataFrame([(i, f"one two three four five six seven eight nine word{i}") for i in range(20)], "doc_id long, text string")
    steps = pathlib.Path(shared_dir(spark).removeprefix("file:")) / "emulon"
    before = set(steps.glob("step-*"))
    going = lines.later_matches(docs)
    assert len(set(steps.glob("step-*")) - before) == 1  # the result
    assert going.count() == 19
    assert [r["doc_id"] for r in lines.dedup_lines(docs).where("text <> ''").collect()] == [0]
    assert lines.cut_lineage(docs).count() == 20  # steps written later stay


def test_line_dedup_of_odd_documents(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = lines.dedup_lines(odd_docs)
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=key) == sorted(brute_lines(rows), key=key)
    assert lines.dedup_lines(no_docs).count() == 0


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("which", ["small_docs", "odd_docs", "no_docs"])
def test_simhash(request, which):
    docs = request.getfixturevalue(which)
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    near = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (rows[i][1] ^ rows[j][1]).bit_count() <= 4]
    root = groups(len(rows), near)
    least = {}
    for (key, _), r in zip(rows, root):
        least[r] = min(least.get(r, 2**63), 2**63 if key is None else key)
    want = sorted((str(k), f"{f:016x}", least[r]) for (k, f), r in zip(rows, root))
    got = simhash.near_duplicates(docs, shingle=4, max_bits=4).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], 2**63 if r["component_id"] is None else r["component_id"]) for r in got) == want
    stay = simhash.keep_one(docs, shingle=4, max_bits=4)
    assert stay.columns == docs.columns
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted(set(least.values()))


@pytest.mark.parametrize("shard", [50, 100_000])
def test_points_are_linked_exactly(spark, shard):
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2)
    near = bits.copy()
    for _ in range(5):
        near ^= np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)
    hot = bits[0] ^ np.array([sum(1 << int(b) for b in rng.choice(64, 3)) for _ in range(500)], dtype=np.uint64)
    every = np.unique(np.concatenate([bits, near, hot]))
    linked = [(int(i), int(j)) for i in range(len(every)) for j in np.flatnonzero(np.bitwise_count(every[i + 1 :] ^ every[i]) <= 4) + i + 1]
    want = groups(len(every), linked)
    df = spark.createDataFrame([(int(b),) for b in every.view(np.int64)], "bits long")
    got = {r["bits"]: r["root"] for r in simhash.link_points(df, 4, shard).collect()}
    names = [got.get(int(b), int(b)) for b in every.view(np.int64)]
    assert len(set(zip(names, want))) == len(set(names)) == len(set(want))


def vector_table(spark, n=300, size=16):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((n, size))
    v[60:90] = v[30:60] + 0.1 * rng.standard_normal((30, size))
    v[90:110] = v[0] + 0.12 * rng.standard_normal((20, size))
    v[110:120] = v[5]
    v[120] = 3 * v[6]
    rows = [(i, v[i].tolist(), i % 3) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [0.0] * size, 1), (n + 2, [float("nan")] + [1.0] * (size - 1), 1), (n + 3, [None] + [1.0] * (size - 1), 1),
             (n + 4, v[7].tolist(), None), (n + 5, [float("inf")] * size, 2), (n + 6, [1.0, 2.0], 1), (n + 7, [1.0, 2.1], 1), (n + 8, [], 1),
             (5, v[5].tolist(), 2)]
    return spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, label int, node string, part int"), rows


def is_good(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_vector_near_duplicates(spark):
    table, rows = vector_table(spark)
    good = [is_good(v) and label is not None for _, v, label in rows]
    linked = []
    for i, j in itertools.combinations(range(len(rows)), 2):
        (_, a, la), (_, b, lb) = rows[i], rows[j]
        if good[i] and good[j] and la == lb and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
            linked.append((i, j))
    root = groups(len(rows), linked)
    least = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}
    want = sorted((rows[i][0], sum(i in p for p in linked), least[root[i]]) for i in range(len(rows)))
    got = itq.near_duplicates(table, part=16).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert itq.near_duplicates(table.limit(0)).count() == 0


def test_links_of_vectors_of_64_components(spark):
    """Here codes decide who meets: planted copies around the threshold, a group of many, and a crowd of strangers."""
    rng = np.random.default_rng(11)
    v = rng.standard_normal((900, 64))
    v[300:450] = v[:150] + rng.standard_normal((150, 64)) * rng.uniform(0.05, 0.36, (150, 1))
    v[450:520] = v[200] + 0.15 * rng.standard_normal((70, 64))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = [(i, j) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.93, 1)))]
    root = groups(900, linked)
    table = spark.createDataFrame([(i, v[i].tolist(), 1) for i in range(900)], "vec_id long, embedding array<double>, label int")
    got = itq.near_duplicates(table, part=64).collect()
    assert len(linked) > 2000 and {r["vec_id"]: r["component_id"] for r in got} == dict(enumerate(root))
    found = {r["vec_id"]: r["n_links"] for r in got}
    want = np.bincount(np.array(linked).ravel(), minlength=900)
    assert all(found[i] <= want[i] for i in range(900)) and sum(found.values()) >= 0.99 * want.sum()


def test_the_rotation_needs_no_matrix_of_the_samples_size():
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    itq.learn_rotation(np.random.default_rng(1).standard_normal((20_000, 64)), turns=2)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # kilobytes


def test_recall_of_codes():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((4000, 64))
    y = x + rng.standard_normal(x.shape) * np.sqrt(1 / 0.935**2 - 1)  # cosines about the threshold
    rotation = itq.learn_rotation(x[:2000])
    a, b = itq.encode(x, rotation), itq.encode(y, rotation)
    near = (x * y).sum(axis=1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1) >= 0.93
    apart = np.bitwise_count((itq._substrings(a, 4) ^ itq._substrings(b, 4)).astype(np.uint64))
    found = (apart.min(axis=1) <= 2) & (np.bitwise_count(a ^ b) <= 20)
    assert found[near].mean() > 0.97


def test_nearest_neighbours(spark):
    table, rows = vector_table(spark, n=1200)
    size = 16
    good = [(k, np.array(v)) for k, v, _ in rows if is_good(v) and len(v) == size]
    got = postings.search(table, F.col("vec_id") % 20 == 0, k=10, list_rows=40, part=64).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries = [(k, v) for k, v in good if k % 20 == 0]
    assert set(found) == {k for k, _ in queries}
    hits = 0
    for k, q in queries:
        by_key = {}
        for other, v in good:
            if other != k:
                by_key[other] = min(by_key.get(other, np.inf), float(np.sqrt(((v - q) ** 2).sum())))
        want = sorted((d, o) for o, d in by_key.items())[:10]
        mine = sorted(found[k])
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(s == pytest.approx(by_key[v], rel=1e-12) for _, v, s in mine)
        assert [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        hits += len({o for _, o in want} & {v for _, v, _ in mine})
    assert hits / (10 * len(queries)) >= 0.9
    assert postings.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = postings.search(table.where("vec_id < 5"), F.col("vec_id") % 2 == 0).collect()
    assert sorted((r["query_id"], r["rank"]) for r in few) == [(q, r) for q in (0, 2, 4) for r in (1, 2, 3, 4)]


def test_neighbours_behind_copies_and_in_small_lists(spark):
    rng = np.random.default_rng(3)
    cloud = rng.standard_normal((1200, 8))
    far = np.concatenate([500 * rng.standard_normal(8) + 0.01 * rng.standard_normal((4, 8)) for _ in range(8)])
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([cloud, far]))]
    rows += [(1, (cloud[0] + 1e-4).tolist())] * 30  # the nearest key of row 0, over and over
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in postings.search(table, (F.col("vec_id") == 0) | (F.col("vec_id") >= 1200), k=10, list_rows=40, part=64).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(found) == {0, *range(1200, 1232)} and 1 in found[0]
    assert all(len(v) == len(set(v)) == 10 for v in found.values())
    for q in range(1200, 1232):
        group = 1200 + (q - 1200) // 4 * 4
        assert set(range(group, group + 4)) - {q} <= set(found[q])


def test_sample_counts_distinct_vectors(spark):
    table = spark.createDataFrame([([float(i % 50 + 1), 1.0],) for i in range(5000)], "v array<double>")
    assert len(vectors.sample(table, "v", 50)) == 50


def test_few_lists_are_read_where_the_vectors_allow_it(spark):
    """Clusters: a small share of the lists for a recall of 0.95; lanes and zones of any size give the same rows."""
    rng = np.random.default_rng(8)
    x = np.repeat(rng.standard_normal((60, 24)), 50, axis=0) + 0.15 * rng.standard_normal((3000, 24))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = postings.build(x, len(x), 40, 10, 0.97, 0.1, 4, 8)
    who, read = index.probes(x[::20])
    assert len(index.centroids) == 75 and len(who) < 0.15 * 75 * 150 and len(set(zip(who, read))) == len(who)
    got = [sorted(map(tuple, postings.search(table, F.col("vec_id") % 20 == 0, list_rows=40, **how).collect()))
           for how in ({}, {"lane": 7, "part": 30}, {"part": 200})]
    assert got[0] == got[1] == got[2] and len(got[0]) == 1500
    d = ((x[::20, None, :] - x[None]) ** 2).sum(axis=2)
    d[np.arange(150), np.arange(0, 3000, 20)] = np.inf
    want = {(20 * q, int(i)) for q, row in enumerate(d) for i in np.argsort(row)[:10]}
    assert len(want & {(r[0], r[2]) for r in got[0]}) >= 0.95 * 1500
    first, count = postings.zones_of(np.array([5, 90, 3, 4, 30, 31]), np.array([0, 2, 3, 1, 4, 5]), 40)
    assert first.tolist() == [0, 1, 0, 0, 4, 5] and count.tolist() == [1, 3, 1, 1, 1, 1]


def test_a_walk_in_the_graph_finds_the_near_centroids():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 6))
    index = postings.build(x, len(x), 16, 10, 0.9, 0.1, 4, 24)
    names, distance = index.near(x[:200], 16)
    true = np.sqrt(((x[:200, None, :] - index.centroids[None]) ** 2).sum(axis=2))
    assert len(index.centroids) == 250 and np.allclose(np.take_along_axis(true, names, 1), distance, atol=1e-6)
    assert np.mean([len(set(a) & set(b)) / 16 for a, b in zip(names, np.argsort(true, axis=1)[:, :16])]) > 0.98


def join_rows(plan):
    """Rows that each join of an executed plan made."""
    if "AdaptiveSparkPlan" in plan.nodeName():
        return join_rows(plan.executedPlan())
    if "QueryStage" in plan.nodeName():
        return join_rows(plan.plan())
    own = [plan.metrics().get("numOutputRows").get().value()] if "Join" in plan.nodeName() else []
    return own + [n for i in range(plan.children().size()) for n in join_rows(plan.children().apply(i))]


def test_near_copies_do_not_meet_one_another(spark, monkeypatch):
    common = [f"word{i}" for i in range(30)]
    rows = [(i, " ".join([*common[: i % 30], f"own{i}", *common[i % 30 + 1 :]]) if i else " ".join(common)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made, write = [], lines.cut_lineage

    def counted(df):
        df.collect()
        made.extend(join_rows(df._jdf.queryExecution().executedPlan()))
        return write(df)

    monkeypatch.setattr(lines, "cut_lineage", counted)
    kept = lines.dedup_lines(docs).where("text <> ''").collect()
    assert [r["doc_id"] for r in kept] == [0]
    assert made and max(made) < 10 * len(rows)  # all pairs are 79,800


def test_copies_unlike_the_first_do_not_list_all_pairs(spark, monkeypatch):
    rng, rows = np.random.default_rng(9), []
    for i in range(400):
        words = [f"word{j}" for j in range(60)]
        for j in rng.choice(60, int(rng.integers(0, 12)) if i else 7, replace=False):
            words[j] = f"own{i}x{j}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made, write = [], lines.cut_lineage

    def counted(df):
        df.collect()
        made.extend(join_rows(df._jdf.queryExecution().executedPlan()))
        return write(df)

    monkeypatch.setattr(lines, "cut_lineage", counted)
    kept = lines.dedup_lines(docs).where("text <> ''").collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted(r for r in brute_lines(rows) if r[1])
    assert made and max(made) < 50 * len(rows)  # before: 489,362


def test_what_the_line_join_no_longer_needs_goes_early(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"one two three four five six seven eight nine word{i}") for i in range(20)], "doc_id long, text string")
    steps = pathlib.Path(shared_dir(spark).removeprefix("file:")) / "emulon"
    before, seen, meetings = set(steps.glob("step-*")), [], lines._meetings
    monkeypatch.setattr(lines, "_meetings", lambda sets, *a: seen.extend(
        c for p in set(steps.glob("step-*")) - before for c in spark.read.parquet(f"file:{p}").columns) or meetings(sets, *a))
    assert lines.later_matches(docs).count() == 19
    assert seen.count("prefix") == 1  # of sets, no longer of lines


@pytest.mark.parametrize("similarity", [0.5, 0.7, 0.8, 0.9])
def test_lines_of_many_sizes_and_similarities(spark, similarity):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(250):
        if rows and rng.random() < 0.7:
            words = rows[int(rng.integers(len(rows)))][1].split(" ")
            for _ in range(int(rng.integers(0, 4))):
                at = int(rng.integers(len(words) + 1))
                words = [words[:at] + words[at + 1 :] or words, words[:at] + [f"n{rng.integers(30)}"] + words[at:]][int(rng.integers(2))]
        else:
            words = [f"n{w}" for w in rng.integers(0, 30, int(rng.integers(1, 30)))]
        rows.append((i, " ".join(words)))
    sets = [line_words(t) for _, t in rows]
    close = lambda a, b: len(a & b) >= similarity * len(a | b) - 1e-9
    want = {i for i in range(len(sets)) if any(close(sets[j], sets[i]) for j in range(i))}
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), similarity=similarity)
    assert {r["doc_id"] for r in got.collect() if r["__gone"]} == want
