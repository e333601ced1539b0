import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from llm_data import ODD, SMALL, documents  # noqa: F401

from moneytrail.llm import simhash


def plain_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for i in range(64):
            bits[i] += h >> i & 1
    return sum(1 << i for i in range(64) if bits[i] * 2 > len(shingles))


def brute(rows, width=3, radius=3):
    """Fingerprint and smallest reachable id of each row, over all pairs."""
    fps = [plain_fingerprint(t, width) for _, t in rows]
    codes = np.array(fps, dtype=np.uint64)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1:] ^ codes[i]) <= radius):
            parent[find(i + 1 + int(j))] = find(i)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[find(i)].append(doc_id)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return sorted(((r[0], f"{fps[i]:016x}", least[find(i)]) for i, r in enumerate(rows)), key=str)


def result(df, **options):
    found = simhash.near_duplicates(df, **options).select("doc_id", simhash.hex_digits("fp"), "component_id")
    return sorted(map(tuple, found.collect()), key=str)


def test_fingerprints():
    texts = ["", None, " \t", "One", "ÄB ab", "a b c d e f g " * 30, "\x0ba\x0cb\rc\x1cd e", "x" * 1000 + " y", "漢字 " * 7]
    for t in texts:
        assert simhash.fingerprint(t) % 2**64 == plain_fingerprint(t)
    assert simhash._squeezed(" A\t\nb  c ") == b"a b c"


def test_long_texts_are_walked_in_stretches(monkeypatch):
    text = " ".join(random.Random(1).choices("abcdefgh", k=500))
    monkeypatch.setattr(simhash, "HASHES", 7)
    assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text)


@pytest.mark.parametrize("folder", [SMALL, SMALL.replace("0.001", "0.01")])
def test_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(documents):
    assert result(documents(*ODD)) == brute([(r[0], r[1]) for r in ODD])
    assert result(documents((1, "x")).limit(0)) == []


@pytest.mark.parametrize("group", [4, 2048])
def test_no_link_is_lost_in_crowded_keys(spark, group):
    """Fingerprints around a few centres, far more under one key than are compared at once."""
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(150)})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    for radius, agree in ((3, 2), (4, 3)):
        links = [(r.a % 2**64, r.b % 2**64) for r in simhash.links_within(df, radius, agree, group).collect()]
        assert all((a ^ b).bit_count() <= radius for a, b in links)

        def classes(pairs):
            parent = {f: f for f in fps}

            def find(i):
                while parent[i] != i:
                    i = parent[i]
                return i

            for a, b in pairs:
                parent[find(a)] = find(b)
            return len({find(f) for f in fps})

        close = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= radius]
        assert classes(links) == classes(close)


def test_least_forest_prefers_close_links():
    codes = np.array([0b0, 0b1, 0b111, 0b11], dtype=np.uint64)
    assert {frozenset(x) for x in simhash.forest(codes, 3)} == {frozenset((0, 1)), frozenset((1, 3)), frozenset((3, 7))}


def test_components_of_chains(spark):
    from moneytrail.llm.components import components
    chain = [(i, i + 1) for i in range(0, 200) if i % 67] + [(500, 3), (600, 601), (601, 600), (7, 7)]
    found = dict(map(tuple, components(spark.createDataFrame(chain, "a bigint, b bigint"), "a", "b").collect()))
    assert found[500] == 1 and found[66] == 1 and found[67] == 1 or found[66] == 1
    assert found[601] == 600 and 7 not in found or found[7] == 1
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").collect() == []


def variant(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_one_of_each(documents):
    rng = random.Random(4)
    bases = [[f"w{rng.randrange(3000)}" for _ in range(300)] for _ in range(12)]
    rows = [(i, " ".join(b)) for i, b in enumerate(bases)]
    rows += [(100 + i, " ".join(b)) for i, b in enumerate(bases[:6])]  # copies
    rows += [(200 + i, variant(b, rng, 2)) for i, b in enumerate(bases)]  # near copies
    rows += [(300 + i, variant(b, rng, 150)) for i, b in enumerate(bases[:4])]  # other texts
    rows += [(5, " ".join(bases[5])), (400, None), (401, ""), (None, " "), (None, "quite another text without an id")]
    df = documents(*rows)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())
    assert ids == sorted([*range(12), *range(300, 304), 400, -1])
    assert simhash.one_of_each(df.limit(0)).collect() == []


def test_similar_texts_joined_by_a_third_are_found(documents, monkeypatch):
    from pyspark.sql import functions as F
    words = " ".join(f"w{i}" for i in range(60))
    code = F.when(F.col("text").startswith("a "), 0).when(F.col("text").startswith("b "), 0b1111111).otherwise(0b111).cast("bigint")
    monkeypatch.setattr(simhash, "fingerprint_column", lambda *_: code)
    df = documents((1, f"a {words}"), (2, f"b {words}"), (3, " ".join(f"x{i}" for i in range(60))))
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == {1, 3}


@pytest.mark.parametrize("group", [6, 2048])
def test_links_of_similar_texts_connect_what_all_pairs_connect(spark, group):
    rng = random.Random(8)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(12)})
    sets = {f - 2**64 if f >= 2**63 else f: set(range(k := rng.choice([0, 20, 40]), k + 30 + rng.randint(0, 8))) for f in fps}
    held = spark.createDataFrame([(f, sorted(x)) for f, x in sets.items()], "fp bigint, set array<bigint>")
    proposed = simhash.links_within(held.select("fp"), 7, 3, group).distinct()
    sure = simhash.similar_links(held, proposed, 0.8)
    found = [tuple(r) for r in sure.unionByName(simhash.missed_links(held, proposed, sure, 0.8, 7, 3, group)).collect()]
    close = [(a, b) for a in sets for b in sets if a < b and ((a ^ b) % 2**64).bit_count() <= 7 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]

    def classes(pairs):
        at = {f: f for f in sets}
        for a, b in [*pairs] * len(sets):
            at[a] = at[b] = min(at[a], at[b])
        return at

    assert classes(found) == classes(close) and classes(close) != classes([tuple(r) for r in sure.collect()])


def test_near_copies_without_ids_and_with_repeated_ids(documents):
    rng = random.Random(6)
    one, other = ([f"w{rng.randrange(3000)}" for _ in range(300)] for _ in range(2))
    near = variant(one, rng, 1)
    assert simhash.one_of_each(documents((None, " ".join(one)), (None, near))).count() == 1
    kept = simhash.one_of_each(documents((1, " ".join(one)), (1, " ".join(other)), (2, near)))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 1]


def test_one_of_each_by_distance_alone(spark, documents):
    """One document of each component of the query stays, whatever the texts share; no component is lost."""
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {r.component_id for r in simhash.near_duplicates(df).collect()}
    kept = simhash.one_of_each(df, simhash.SHINGLE, simhash.RADIUS, simhash.AGREE, similarity=None)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want) and kept.columns == df.columns
    # texts without a word are one component, and two texts share an id
    assert simhash.one_of_each(documents(*ODD), simhash.SHINGLE, simhash.RADIUS, simhash.AGREE, similarity=None).count() == 8
