"""Similarity joins, graphs and order statistics against brute force on small data."""

import difflib
import math
import collections
import random

import pytest
from pyspark.sql import functions as F

from fundlens.operators import anomalies, complaints, components, entities, geography, names, pairing, photos, retrieval


def test_salted_join_equals_plain_join(spark):
    rows = [("hot", i) for i in range(60)] + [(f"k{i % 7}", i) for i in range(30)]
    a = spark.createDataFrame(rows, "k string, x int")
    b = spark.createDataFrame(rows, "k string, y int")
    plain = sorted(tuple(r) for r in a.join(b, "k").where("x < y").collect())
    salted = pairing.salted_join(a, b, ["k"], F.col("x") < F.col("y"), rows_per_block=8)
    assert sorted((r.k, r.x, r.y) for r in salted.collect()) == plain


def test_order_statistic(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice([rng.randrange(10**9), 5, 7 << 20])) for g in "abc" for _ in range(rng.randrange(5, 60))]
    df = spark.createDataFrame(rows, "g string, v long")
    got = {r.g: (r.n, r.value) for r in pairing.order_statistic(df, ["g"], F.col("v"), F.expr("n div 2 + 1")).collect()}
    for g in "abc":
        values = sorted(v for h, v in rows if h == g)
        assert got[g] == (len(values), values[len(values) // 2])


def test_sequential_number(spark):
    ids = random.Random(2).sample(range(10_000), 300)
    df = spark.createDataFrame([(i,) for i in ids], "i long")
    out = pairing.sequential_number(df, [F.shiftright("i", 6)], F.col("i"), "n").orderBy("i").collect()
    assert [r.n for r in out] == list(range(1, 301))


@pytest.mark.parametrize("threshold", [0.75, 0.85, 0.92])
def test_similar_names(spark, threshold):
    rng = random.Random(3)
    words = ["jai", "shri", "construction", "builders", "infra", "traders", "works", "co", "a", "ab", "road", "xyz"]
    pool = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(120)}
    pool |= {p[: rng.randrange(1, len(p) + 1)] for p in list(pool)} | {p.replace("o", "", 1) for p in list(pool)}
    pool = sorted(p for p in pool if p)
    df = spark.createDataFrame([(p,) for p in pool], "name string")
    got = {(r.name_a, r.name_b) for r in names.similar_names(df, None, threshold).collect()}
    want = {
        (a, b) for i, a in enumerate(pool) for b in pool[i + 1 :]
        if difflib.SequenceMatcher(None, a, b).ratio() >= threshold
    }
    assert got == want


def test_place_mapping(spark):
    refs = ["Maharashtra", "Tamil Nadu", "Uttar Pradesh", "Jammu And Kashmir", "Karnataka", "Andhra Pradesh"]
    raw = ["Maharastra", "J & K", "Karnataka", "Atlantis Wonder City", " tamil nadu", "UP", "Utter Pradesh", "delhi", "Andhra Pradsh"]
    r = spark.createDataFrame([(x,) for x in raw], "name string")
    f = spark.createDataFrame([(x,) for x in refs], "name string")
    got = {x.raw: x.canonical for x in geography.place_mapping(r, f).collect()}
    assert got == {
        "Maharastra": "Maharashtra", "J & K": "Jammu And Kashmir", "Karnataka": "Karnataka",
        "Atlantis Wonder City": None, " tamil nadu": "Tamil Nadu", "UP": "Uttar Pradesh",
        "Utter Pradesh": "Uttar Pradesh", "delhi": "NCT of Delhi", "Andhra Pradsh": "Andhra Pradesh",
    }
    for x in ("Maharastra", "Utter Pradesh", "Andhra Pradsh"):
        assert got[x] == difflib.get_close_matches(x, refs, n=1, cutoff=0.8)[0]


def test_match_references(spark):
    """Several columns at once give what one after the other gives."""
    refs = spark.createDataFrame([("state", "Kerala"), ("state", "Assam"), ("district", "Kottayam"), ("district", "Nagaon")], "kind string, name string")
    rows = [("kerala", "Kotayam", "nagaon"), (" Assam ", None, ""), (None, "Nagaon", "Kottayam"), ("Nowhere at all", "Kerala", "Kotayam"), ("kerala", "Kotayam", "nagaon")]
    df = spark.createDataFrame(rows, "state string, first string, second string")
    columns = {"state": "state", "first": "district", "second": "district"}
    want = df
    for column, kind in columns.items():
        want = geography.match_reference(want, column, refs.where(f"kind = '{kind}'").select("name"))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(geography.match_references(df, columns, refs).collect(), key=key) == sorted(want.collect(), key=key)
    assert geography.match_references(df, {}, refs).columns == df.columns



def components_of(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)]
    edges += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(500, 500)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components.connected_components(df, "a", "b").collect()}
    assert got == components_of(edges)


def test_resolve_entities(spark):
    rows = [
        ("PA1", "Alpha Roads", "ABCDE1234F", None), ("PA2", "Zeta Hydraulics", "abcde-1234f", None),
        ("PA3", "Beta Bridges", None, None), ("PA4", "Omega Electricals", "BAD", None),
        ("PA5", "Jai Construction Corporation", None, None), ("PA6", "Jai Construction Pvt Ltd", None, None),
        ("PA7", "Pvt Ltd", None, None), ("PA8", "pvt ltd", None, None),
    ]
    v = spark.createDataFrame(rows, "vendor_id string, vendor_name string, pan string, gstin string")
    got = {r.vendor_id: r.canonical_id for r in entities.resolve_entities(v).collect()}
    assert got == {"PA1": "PA1", "PA2": "PA1", "PA3": "PA3", "PA4": "PA4", "PA5": "PA5", "PA6": "PA5", "PA7": "PA7", "PA8": "PA7"}


@pytest.mark.parametrize("minimum", [1, 2, 3])
def test_cooccurrence(spark, minimum):
    rng = random.Random(5)
    rows = [(f"p{i}", f"v{rng.randrange(25)}", "hot" if rng.random() < 0.4 else f"o{rng.randrange(12)}") for i in range(300)]
    a = spark.createDataFrame(rows, "project_id string, entity_id string, official_id string")
    got = {
        (r.entity_a, r.entity_b): (r.shared_officials, r.project_count, round(r.cooccurrence_score, 4))
        for r in entities.cooccurrence_edges(a, minimum, rows_per_block=4).collect()
    }
    count, total = {}, {}
    for _, v, o in rows:
        count[v, o] = count.get((v, o), 0) + 1
        total[v] = total.get(v, 0) + 1
    officials = {o for _, _, o in rows}
    want = {}
    vendors = sorted(total)
    for i, x in enumerate(vendors):
        for y in vendors[i + 1 :]:
            shared = [o for o in officials if (x, o) in count and (y, o) in count]
            n = sum(min(count[x, o], count[y, o]) for o in shared)
            if shared and n >= minimum:
                expected = total[x] * total[y] / (len(rows) * len(officials))
                want[x, y] = (len(shared), n, round(min(1.0, n / max(expected, 0.01)), 4))
    assert got == want


def test_collusion_cluster(spark):
    rows = [("p1", "A", "x"), ("p2", "A", "x"), ("p3", "B", "x"), ("p4", "B", "x"), ("p5", "C", "y"), ("p6", "D", "z")]
    a = spark.createDataFrame(rows, "project_id string, entity_id string, official_id string")
    edges = entities.cooccurrence_edges(a)
    members = entities.collusion_members(edges, 0.7)
    row = entities.collusion_clusters(edges, members, a, 0.7).collect()
    assert [(r.cluster_id, r.entity_count, r.official_count, r.edge_count, r.risk_score) for r in row] == [("A", 2, 1, 1, 1.0)]


@pytest.mark.parametrize("limit", [3, 6, 10])
def test_near_hashes(spark, limit):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(25)]
    prints = [h ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 12))) for h in base for _ in range(4)]
    prints += [base[0]] * 3 + [0, 1, (1 << 64) - 1]
    rows = [(i, f"{h:016x}") for i, h in enumerate(prints)]
    df = spark.createDataFrame(rows, "image_id long, phash string")
    got = sorted((r.image_a, r.image_b, r.distance) for r in photos.duplicate_photo_pairs(df, limit).collect())
    want = sorted(
        (i, j, bin(prints[i] ^ prints[j]).count("1"))
        for i in range(len(prints)) for j in range(i + 1, len(prints))
        if bin(prints[i] ^ prints[j]).count("1") <= limit
    )
    assert got == want
    rows = photos.duplicate_photo_groups(df, limit).collect()
    assert all(r.image_a < r.image_b for r in rows)
    copies = collections.Counter(r.image_a for r in rows if r.distance == 0)
    assert copies == collections.Counter(prints.index(h) for h in prints) - collections.Counter({prints.index(h) for h in prints})
    # A star of n - 1 rows stands for n (n - 1) / 2 pairs, a near pair of fingerprints for image_pairs.
    assert sum(r.image_pairs for r in rows if r.distance) + sum(n * (n + 1) // 2 for n in copies.values()) == len(want)


@pytest.mark.parametrize("size", [100, 10**6, 10**8, 10**10])
@pytest.mark.parametrize("limit", [0, 3, 7, 10])
def test_near_hashes_by_plan(spark, limit, size):
    """Plans made for any number of fingerprints find the same pairs."""
    rng = random.Random(limit)
    base = [rng.getrandbits(64) for _ in range(8)]
    prints = sorted({h ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, limit + 2))) for h in base for _ in range(4)} | {0, 1, (1 << 64) - 1})
    df = spark.createDataFrame([(i, f"{h:016x}") for i, h in enumerate(prints)], "image_id long, phash string")
    plan = photos.band_plan(size, limit)
    near = photos.near_hashes(photos.hash_groups(df), limit, plan)
    got = sorted((r.bits_a % 2**64, r.bits_b % 2**64) for r in near.collect())
    got = sorted((min(x), max(x)) for x in got)
    want = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= limit]
    assert got == sorted(want)


def test_band_plan_grows_with_rows():
    """Each fingerprint is compared with a falling share of the others, in bounded rows."""
    for limit in (3, 7, 10):
        plans = [photos.band_plan(n, limit) for n in (10**4, 10**6, 10**8, 10**10)]
        shares = [p.candidate_share() for p in plans]
        assert shares == sorted(shares, reverse=True) and shares[-1] < shares[0] / 20
        assert all(max(p.rows()) <= photos.MOST_ROWS for p in plans)
    assert photos.band_plan(10**9, 3) == photos.BandPlan(6, 3, 0, 0)


def test_near_duplicate_works(spark):
    """Groups and members equal those of all pairs, connected; amounts lie round the steps' edges."""
    rng = random.Random(21)
    rows = []
    for i in range(900):
        amount = rng.choice([None, rng.randrange(0, 40) * 100_000 + rng.choice([-1, 0, 1, 49_999]) + rng.choice([0.0, 0.01, 0.99]), float(rng.randrange(0, 4_000_000))])
        rows.append((f"W{i:03d}", rng.choice(["Pune", "Agra", None]), "Road", rng.choice(["Road  repair", "road-repair", "Well", None]), amount, rng.choice(["V1", "V2", "V3", None])))
    df = spark.createDataFrame(rows, "unique_work_number string, nodal_district string, work_category string, work_name string, amount double, vendor_id string")
    df = df.withColumn("sanction_amount", F.col("amount").cast("decimal(18,2)")).drop("amount")
    for tolerance in (5_000, 20_000):
        like = collections.defaultdict(list)
        for number, place, kind, name, amount, vendor in rows:
            if place and name and amount is not None:
                like[place, kind, name.lower().replace("  ", " ").replace("-", " ")].append((round(amount * 100), number, vendor))
        want = {}
        for key, group in like.items():
            left = set(group)
            while left:
                todo = [left.pop()]
                part = []
                while todo:
                    x = todo.pop()
                    part.append(x)
                    near = {y for y in left if abs(x[0] - y[0]) <= tolerance * 100}
                    left -= near
                    todo += near
                if len({v for _, _, v in part} - {None}) >= 2:
                    want[min(n for _, n, _ in part)] = (key, sorted(n for _, n, _ in part), min(part)[0] / 100, max(part)[0] / 100)
        groups = {r.first_work: r for r in anomalies.near_duplicate_works(df, tolerance).collect()}
        assert {k: ((r.nodal_district, r.work_category, r.title), r.works, r.lowest_amount, r.highest_amount) for k, r in groups.items()} == {k: (a, len(m), lo, hi) for k, (a, m, lo, hi) in want.items()}
        members = collections.defaultdict(list)
        for r in anomalies.near_duplicate_members(df, tolerance).collect():
            members[r.group_id].append(r.unique_work_number)
        assert {k: sorted(v) for k, v in members.items()} == {k: m for k, (_, m, _, _) in want.items()}
        assert len(want) > 5


def test_hash_pairs_example(spark):
    df = spark.createDataFrame([("a", "817a7e2a7e2a7e80"), ("b", "817a7e2a7e2a7e80"), ("c", "12345678abcdef00")], "image_id string, phash string")
    assert [(r.image_a, r.image_b, r.distance) for r in photos.duplicate_photo_pairs(df, 10).collect()] == [("a", "b", 0)]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8])
def test_cosine_pairs(spark, threshold):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(25)] + ["common"] * 10
    texts = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(2, 9))) for _ in range(80)})
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    vectors = complaints.tfidf(complaints.distinct_texts(docs, "id", "text"))
    got = {(r.rep_a, r.rep_b) for r in complaints.cosine_pairs(vectors, threshold).collect()}
    n = len(texts)
    tf = [{w: t.split().count(w) for w in t.split()} for t in texts]
    df = {w: sum(w in f for f in tf) for f in tf for w in f}
    vec = [{w: c * (math.log((1 + n) / (1 + df[w])) + 1) for w, c in f.items()} for f in tf]
    norm = [math.sqrt(sum(x * x for x in v.values())) for v in vec]
    want = {
        (i, j) for i in range(n) for j in range(i + 1, n)
        if sum(x * vec[j].get(w, 0) for w, x in vec[i].items()) / norm[i] / norm[j] >= threshold - 1e-9
    }
    assert got == want


def test_clusters_of_copies(spark):
    rows = [(1, "pothole on main road"), (2, "pothole on main road"), (3, "main road pothole"), (4, "no water supply"), (5, "the"), (6, "the")]
    docs = spark.createDataFrame(rows, "id long, text string")
    got = sorted((r.doc_id, r.cluster_id, r.size) for r in complaints.cluster_complaints(docs, threshold=0.8).collect())
    assert got == [(1, 1, 3), (2, 1, 3), (3, 1, 3)]


@pytest.mark.parametrize("lat,lon", [(18, 73), (-64, 179.996)])
def test_double_funding(spark, lat, lon):
    rng = random.Random(8)
    place = lambda: (lat + rng.random() / 100, (lon + rng.random() / 100 + 180) % 360 - 180)
    titles = ["cc road ward five", "cc road ward six", "community hall repair", "school building"]
    a = [(f"a{i}", rng.choice(titles), *place()) for i in range(60)]
    b = [(f"b{i}", rng.choice(titles), "S", *place()) for i in range(60)]
    left = spark.createDataFrame(a, "site_id string, title string, lat double, lon double")
    right = spark.createDataFrame(b, "site_id string, title string, scheme string, lat double, lon double")
    got = {(r.work_id, r.other_id) for r in anomalies.double_funding_pairs(left, right, 250, 0.82).collect()}

    def metres(p, q):
        la, lb = math.radians(p[2]), math.radians(q[3])
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(q[4] - p[3]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    want = {(p[0], q[0]) for p in a for q in b if p[1] == q[1] and metres(p, q) <= 250}
    assert want and got == want
    # Some pairs lie across the date line.
    assert lon < 170 or any(left_lon * right_lon < 0 for left_lon, right_lon in ((a[int(x[1:])][3], b[int(y[1:])][4]) for x, y in want))


@pytest.mark.parametrize("blocked", [False, True])
def test_top_k_vectors(spark, monkeypatch, blocked):
    if blocked:
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
        monkeypatch.setattr(retrieval, "CHUNK_BLOCK", 20)
    rng = random.Random(9)
    vec = lambda: [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]
    chunks, queries = [(i, vec()) for i in range(90)], [(f"q{i}", vec()) for i in range(8)]
    c = spark.createDataFrame(chunks, "chunk_id long, embedding array<float>")
    q = spark.createDataFrame(queries, "query_id string, embedding array<float>")
    got = {}
    for r in retrieval.top_k_vectors(c, q, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for name, v in queries:
        order = sorted(chunks, key=lambda x: (-sum(a * b for a, b in zip(v, x[1])), x[0]))
        assert got[name] == [i for i, _ in order[:5]]


@pytest.mark.parametrize("min_score,min_shared", [(0.7, 2), (1.0, 2), (0.05, 3)])
def test_strong_edges(spark, min_score, min_shared):
    """Entities of very different size, a few officials with most of the work, and small rings."""
    rng = random.Random(11)
    rows = [(f"e{int(rng.paretovariate(0.7)) % 60:02d}", f"o{int(rng.paretovariate(0.5)) % 90}") for _ in range(3000)]
    rows += [(f"r{i}{j}", f"ring{i}") for i in range(5) for j in range(3) for _ in range(4)]
    df = spark.createDataFrame([(f"p{i}", e, o) for i, (e, o) in enumerate(rows)], "project_id string, entity_id string, official_id string")
    share, p = collections.Counter(rows), collections.Counter(e for e, _ in rows)
    by = collections.defaultdict(dict)
    for (e, o), n in share.items():
        by[e][o] = n
    scale = len(rows) * len({o for _, o in rows})
    want = {}
    for a in by:
        for b in by:
            common = by[a].keys() & by[b].keys() if a < b else ()
            count = sum(min(by[a][o], by[b][o]) for o in common)
            score = round(min(1.0, count / max(p[a] * p[b] / scale, 0.01)), 4)
            if count >= min_shared and score >= min_score:
                want[a, b] = (len(common), count, score)
    got = {(r.entity_a, r.entity_b): (r.shared_officials, r.project_count, r.cooccurrence_score) for r in entities.strong_edges(df, min_score, min_shared, rows_per_block=50).collect()}
    assert got == want and want
