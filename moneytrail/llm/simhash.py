"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into BLOCKS parts. Two that differ in at most ``radius`` bits agree in at least BLOCKS - radius parts,
so they meet under a key made of such a set of parts; there, their distance is verified. Work is on distinct
fingerprints only, so exact copies cost nothing. A key's fingerprints are compared as one array and yield a spanning
forest of their links, never all pairs; a key with more than GROUP of them is dealt to pairs of slices of bounded size.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moneytrail.llm.components import components
from moneytrail.llm.helpers import SPACE, fresh, let
from moneytrail.scratch import materialize

SHINGLE = 3
RADIUS = 3
#: Parts that a pair within the radius agrees in at least; more parts make longer keys, and more of them.
AGREE = 2
#: Fingerprints compared at once.
GROUP = 2048
#: Pairs compared at once.
CELLS = 1 << 22
#: Shingles hashed at once.
HASHES = 65_536
SEED = 42
BITS = 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the word shingles of a text, repeats included; 0 without a word.

    A-Z are lowered; words are split at ASCII white space and joined by one space. Bytes are walked by the places of the
    spaces, so a long text needs no list of its words.
    """
    joined = b" ".join((text or "").encode().lower().split()) if len(text or "") < 1_000_000 else _squeezed(text)
    if not joined:
        return 0
    raw = np.frombuffer(joined, dtype=np.uint8)
    spaces = np.flatnonzero(raw == 32)
    n = len(spaces) + 2 - shingle
    if n <= 1:
        return _signed(xxhash.xxh64_intdigest(joined, SEED))
    starts = np.concatenate(([0], spaces + 1))
    ends = np.append(spaces, len(joined))[shingle - 1:]
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, HASHES):
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[at:min(n, at + HASHES)].tolist(), ends[at:at + HASHES].tolist())),
            dtype=np.uint64,
        )
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((counts * 2 > n).astype(np.uint8), bitorder="little").view(np.int64)[0])


def _signed(value: int) -> int:
    return value - 2**BITS if value >= 2 ** (BITS - 1) else value


def _squeezed(text: str) -> bytes:
    """White space of a very long text as single spaces, without a list of all words."""
    raw = np.frombuffer(text.encode().lower(), dtype=np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    raw = np.where(blank, np.uint8(32), raw)
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    return raw[keep].tobytes().strip(b" ")


def fingerprint_column(text: str | Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("bigint")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return fingerprints(text)


def known_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))


def marked(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Stored (doc_id, text_hash, fp) of every row, and (fp, first, shown) of every distinct fingerprint.

    first is its smallest doc_id, shown the smallest (id_, text_hash) of its rows, with an id_ that is never null.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprint_column("text", shingle).alias("fp"))
    rows = materialize(rows, "fingerprints")
    return rows, materialize(rows.groupBy("fp").agg(
        F.min("doc_id").alias("first"), F.min(F.struct(known_id().alias("id_"), "text_hash")).alias("shown")
    ), "distinct-fingerprints")


def block_keys(radius: int, agree: int) -> list[int]:
    """Bit masks of every set of ``agree`` parts out of ``radius + agree``."""
    cuts = [BITS * i // (radius + agree) for i in range(radius + agree + 1)]
    parts = [(1 << high) - (1 << low) for low, high in zip(cuts, cuts[1:])]
    return [_signed(sum(chosen)) for chosen in combinations(parts, agree)]


def forest(codes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a least spanning forest, by Hamming distance, of the fingerprints that are within ``radius`` of each other."""
    links, at = [], 0
    rest = np.arange(1, len(codes))
    nearest, distance = np.zeros(len(rest), dtype=np.int64), np.full(len(rest), BITS + 1)
    while len(rest):
        apart = np.bitwise_count(codes[rest] ^ codes[at])
        closer = apart < distance
        nearest[closer], distance[closer] = at, apart[closer]
        best = int(np.argmin(distance))
        at = int(rest[best])
        if distance[best] <= radius:
            links.append((int(codes[at].view(np.int64)), int(codes[nearest[best]].view(np.int64))))
        rest, nearest, distance = (np.delete(x, best) for x in (rest, nearest, distance))
    return links


def close_groups(groups: list[np.ndarray], radius: int) -> Iterator[np.ndarray]:
    """Of each group the fingerprints that have another within ``radius``, if any; groups of one size are compared together."""
    by_size: dict[int, list[np.ndarray]] = {}
    for g in groups:
        by_size.setdefault(len(g), []).append(g)
    for size, same in by_size.items():
        at_once = max(1, CELLS // (size * size))
        for at in range(0, len(same), at_once):
            codes = np.stack(same[at:at + at_once]).astype(np.int64).view(np.uint64)
            near = np.bitwise_count(codes[:, :, None] ^ codes[:, None, :]) <= radius
            linked = near.sum(axis=2) > 1
            for i in np.flatnonzero(linked.any(axis=1)):
                yield codes[i][linked[i]]


MEETING = ["part", "key", "low", "high"]


def meetings(fps: DataFrame, radius: int, agree: int, group: int, held: str = "fp") -> DataFrame:
    """Groups (part, key, low, high) in which all pairs of ``fps`` within ``radius`` bits meet, with an array of their ``held``."""
    masks = F.array(*map(F.lit, block_keys(radius, agree)))
    keyed = fps.select("fp", F.col(held).alias("held"), F.posexplode(masks).alias("part", "mask")).select(
        "fp", "held", "part", F.col("fp").bitwiseAND(F.col("mask")).alias("key")
    )
    crowded = keyed.groupBy("part", "key").count().where(F.col("count") > group).select(
        "part", "key", F.ceil(F.col("count") / (group // 2)).cast("int").alias("slices")
    )
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    other = F.explode(F.when(F.col("slices") > 1, F.filter(F.sequence(F.lit(0), F.col("slices") - 1), lambda s: s != F.col("own"))).otherwise(F.array(F.lit(0))))
    dealt = (
        keyed.join(crowded, ["part", "key"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
        .withColumn("own", own).select("held", "part", "key", "own", other.alias("other"))
    )
    return (
        dealt.groupBy("part", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
        .agg(F.collect_list("held").alias("held")).where(F.size("held") > 1)
    )


def links_within(fps: DataFrame, radius: int = RADIUS, agree: int = AGREE, group: int = GROUP) -> DataFrame:
    """Links (a, b) between distinct fingerprints of column ``fp`` that connect all pairs within ``radius`` bits."""
    met = meetings(fps, radius, agree, group).select(F.col("held").alias("fps"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [link for codes in close_groups(batch["fps"].to_list(), radius) for link in forest(codes, radius)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return met.mapInPandas(verify, "a bigint, b bigint")


def classes(rows: DataFrame, links: DataFrame, distinct: DataFrame) -> DataFrame:
    """Add component_id, the smallest doc_id that ``links`` between fingerprints reach, and component_root, their smallest fp."""
    roots = components(links, "a", "b").withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("parent", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.join(named, "root").select("fp", "component_id", F.col("root").alias("component_root")), "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, agree: int = AGREE) -> DataFrame:
    """Fingerprint and near-duplicate component of every document: doc_id, fp, component_id.

    ``docs`` has doc_id and text; other columns are ignored. One row per input row. Documents link if their fingerprints
    differ in at most ``radius`` bits, and component_id is the smallest doc_id that links reach, nulls aside: it is null
    if no document of the component has an id. Null, empty and blank texts have fingerprint zero and link like any other.
    """
    rows, distinct = marked(docs, shingle)
    found = links_within(distinct.select("fp"), radius, agree)
    return classes(rows, found, distinct).select("doc_id", "fp", "component_id")


def shingle_set(text: Column, width: int) -> Column:
    """Distinct hashes of the word shingles of a text; of fewer words than ``width`` all are one shingle."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")
    return let(words, lambda ws: F.when(F.size(ws) >= width, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size(ws) - width + 1), lambda i: F.xxhash64(F.array_join(F.slice(ws, i, width), " "))
    ))).when(F.size(ws) > 0, F.array(F.xxhash64(F.array_join(ws, " ")))).otherwise(F.array().cast("array<bigint>")))


def shingle_sets(docs: DataFrame, distinct: DataFrame, links: DataFrame, width: int) -> DataFrame:
    """Stored (fp, set) of the linked fingerprints: the shingles of its text.

    The text of a fingerprint is that of one of its rows, found by id and text; only texts of linked fingerprints are read and cut into shingles.
    """
    ends = links.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    shown = ends.join(distinct, "fp").select("fp", "shown.*")
    return materialize(
        docs.select(known_id().alias("id_"), F.xxhash64("text").alias("text_hash"), "text").join(shown, ["id_", "text_hash"]).groupBy("fp").agg(F.min("text").alias("text"))
        .select("fp", shingle_set(F.col("text"), width).alias("set")),
        "shingle-sets",
    )


def similar_links(sets: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """Of the links between fingerprints those whose texts have a Jaccard similarity of ``similarity`` or more."""
    pairs = links.join(sets.select(F.col("fp").alias("a"), F.col("set").alias("one")), "a").join(
        sets.select(F.col("fp").alias("b"), F.col("set").alias("other")), "b"
    )
    shared = F.size(F.array_intersect("one", "other"))
    return pairs.where(shared >= similarity * (F.size("one") + F.size("other") - shared)).select("a", "b")


def candidates(codes: np.ndarray, roots: np.ndarray, masks: np.ndarray, part: int, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each place the later places within ``radius`` bits that have another root and meet under no earlier part, and their distances."""
    for i in range(len(codes) - 1):
        differ = codes[i + 1:] ^ codes[i]
        apart = np.bitwise_count(differ)
        at = np.flatnonzero((apart <= radius) & (roots[i + 1:] != roots[i]))
        at = at[~((differ[at, None] & masks[:part]) == 0).any(axis=1)]
        if len(at):
            yield i, at + i + 1, apart[at]


def missed_links(sets: DataFrame, proposed: DataFrame, held: DataFrame, similarity: float, radius: int, agree: int, group: int = GROUP) -> DataFrame:
    """Links that, with the ``held`` ones, connect all pairs of similar texts within ``radius`` bits.

    A forest by distance may join two similar texts through one that is similar to neither. Fingerprints that the proposed
    links connect and the held ones do not meet once more: each pair of them is tested under the first key it shares, unless
    links of its group connect it already. A group gives a spanning forest of similar texts, never all pairs.
    """
    masks = np.array(block_keys(radius, agree), dtype=np.int64).view(np.uint64)
    near, same = (components(x, "a", "b").withColumnRenamed("node", "fp").withColumnRenamed("parent", n) for x, n in ((proposed, "near"), (held, "root")))
    ends = proposed.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    ends = ends.join(near, "fp", "left").join(same, "fp", "left").select("fp", F.coalesce("near", "fp").alias("near"), F.coalesce("root", "fp").alias("root"))
    ends = materialize(ends, "linked-fingerprints")
    split = ends.groupBy("near").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("near")
    unsettled = ends.join(split, "near").select("fp", F.struct("fp", "root").alias("held"))

    def open_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                fps, roots = (np.array([h[c] for h in r.held], dtype=np.int64) for c in ("fp", "root"))
                meet = np.zeros(len(fps), dtype=bool)
                for i, others, _ in candidates(fps.view(np.uint64), roots, masks, r.part, radius):
                    meet[i], meet[others] = True, True
                if meet.any():
                    yield pd.DataFrame({"part": r.part, "key": r.key, "low": r.low, "high": r.high, "fp": fps[meet], "root": roots[meet]})

    def tested(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("fp")
        fps, roots, texts = rows["fp"].to_numpy(np.int64), rows["root"].to_numpy(np.int64), [set(s) for s in rows["set"]]
        pairs = [(d, i, j) for i, js, ds in candidates(fps.view(np.uint64), roots, masks, int(rows["part"].iloc[0]), radius) for j, d in zip(js.tolist(), ds.tolist())]
        parent = {r: r for r in roots.tolist()}

        def find(r: int) -> int:
            while parent[r] != r:
                parent[r] = parent[parent[r]]
                r = parent[r]
            return r

        links = []
        for _, i, j in sorted(pairs):
            one, other = find(int(roots[i])), find(int(roots[j]))
            if one != other:
                shared = len(texts[i] & texts[j])
                if shared >= similarity * (len(texts[i]) + len(texts[j]) - shared):
                    parent[one] = other
                    links.append((fps[i], fps[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    members = meetings(unsettled, radius, agree, group, "held").mapInPandas(
        open_pairs, "part int, key bigint, low int, high int, fp bigint, root bigint"
    )
    return members.join(sets, "fp").groupBy(*MEETING).applyInPandas(tested, "a bigint, b bigint")


def one_of_each(
    docs: DataFrame, shingle: int = 2, radius: int = 7, agree: int = 3, width: int = 5, similarity: float | None = 0.8
) -> DataFrame:
    """Documents without near duplicates, with all their columns: of each component the row with the smallest doc_id stays.

    Fingerprints over ``shingle`` words within ``radius`` bits link if the ``width``-word shingles of their texts have a Jaccard
    similarity of ``similarity`` or more: first those of a least spanning forest for each key are tested, then, where some of
    them do not hold, all pairs within the radius that are still apart. Without a ``similarity`` the distance alone links. Documents with
    the same fingerprint are copies, texts without a word among them. Rows without doc_id take part like others but stay
    only if their component has no id at all. Of rows of a component with the same id the one with the smallest hash of its
    text stays, of equal texts one with the smallest source. Extra columns of any name are kept.
    """
    rows, distinct = marked(docs, shingle)
    proposed = materialize(links_within(distinct.select("fp"), radius, agree).distinct(), "proposed-links")
    links = proposed
    if similarity is not None:
        sets = shingle_sets(docs, distinct, proposed, width)
        held = materialize(similar_links(sets, proposed, similarity), "similar-links")
        links = held.unionByName(materialize(missed_links(sets, proposed, held, similarity, radius, agree), "missed-links"))
    known = known_id()
    at, code, nth = (fresh(docs, n) for n in ("id_", "text_hash_", "nth_"))
    # a component is named by its smallest id, or, if it has none, by null: then its fingerprints tell components apart
    named = classes(rows, links, distinct).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stays = named.groupBy("component_root").agg(F.min(F.struct(known.alias(at), F.col("text_hash").alias(code))).alias("one")).select("one.*")
    first = Window.partitionBy(at, code).orderBy("source")
    return (
        docs.withColumn(at, known).withColumn(code, F.xxhash64("text")).join(stays.distinct(), [at, code])
        .withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).select(*docs.columns)
    )


def hex_digits(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
