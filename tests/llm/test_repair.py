import hashlib
import itertools
import random
import re
import zlib

import pytest
from llm_data import SMALL
from pyspark.sql import functions as F

from moneytrail.llm import queries, repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, fault string, copy int, part string, said int, audit string"
SHAPE = re.compile(r"(s?(ua)+)?\Z")
WORD = re.compile(r"[^\x20\x09-\x0D]")


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z") for r in rows], SCHEMA)


def rows_of(turns):
    """(initial, must go, truncated) and fault of the ordered turns (turn, role, text) of a conversation."""
    seen, out = set(), []
    for _, role, text in turns:
        fault = None
        if not WORD.search(text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif text.strip(" \t\n\x0b\x0c\r")[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        out.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated", fault))
    return out


def enumerated(rows, most=2):
    """The cheapest (cost, audit) among all edits with up to ``most`` insertions at a place."""
    best = None
    runs = [r for k in range(most + 1) for r in itertools.product("ua", repeat=k)]
    choices = []
    for initial, must, cut, *_ in rows:
        more = 3 if cut else 0
        own = [(4, "D", "")]
        if not must:
            own += [(more, "K", initial), (3 + more, "R", "u"), (3 + more, "R", "a")]
        choices.append(own)
    for picked in itertools.product(*choices):
        for put in itertools.product(runs, repeat=len(rows) + 1):
            shape = "".join(put[0]) + "".join(p[2] + "".join(after) for p, after in zip(picked, put[1:]))
            if SHAPE.match(shape):
                cost = sum(p[0] for p in picked) + 3 * sum(map(len, put))
                audit = "I" * len(put[0]) + "".join(p[1] + "I" * len(after) for p, after in zip(picked, put[1:]))
                best = min(best or (cost, audit), (cost, audit))
    return best


def forward(rows):
    """The same by walking from the first row to the last; one insertion at a time, until nothing gets cheaper."""
    step = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("3", "u"): "2", ("2", "a"): "3"}

    def grown(cells):
        for _ in range(4):
            for (p, role), q in step.items():
                if role != "s" and p in cells:
                    cell = (cells[p][0] + 3, cells[p][1] + "I")
                    cells[q] = min(cells.get(q, cell), cell)
        return cells

    cells = grown({"0": (0, "")})
    for initial, must, cut, *_ in rows:
        new = {}

        def offer(q, p, cost, letter):
            cell = (cells[p][0] + cost, cells[p][1] + letter)
            new[q] = min(new.get(q, cell), cell)

        for p in list(cells):
            offer(p, p, 4, "D")
            for (at, role), q in step.items():
                if at == p and not must:
                    if role == initial:
                        offer(q, p, 3 * cut, "K")
                    if role != "s":
                        offer(q, p, 3 + 3 * cut, "R")
        cells = grown(new)
    return min(cells[p] for p in "03" if p in cells)


def tables(rows):
    return [repair.LEAVES[i if i in ("s", "u", "a") else "-", must, cut] for i, must, cut, *_ in rows]


KINDS = [(i, must, cut) for i in "suat" for must, cut in ((False, False), (False, True), (True, False))]


def test_against_all_edits():
    for n in range(4):
        picked = itertools.product(KINDS, repeat=n)
        for rows in picked if n < 2 else random.Random(n).sample(list(picked), 40 if n == 2 else 6):
            assert repair.cheapest(repair.parse(tables(rows))) == enumerated(rows) == forward(rows)


def test_long_rows_against_a_walk():
    rng = random.Random(1)
    for n in (5, 17, 64, 700):
        rows = [rng.choice(KINDS) for _ in range(n)]
        assert repair.cheapest(repair.parse(tables(rows))) == forward(rows)


def test_every_split_gives_the_same_cells():
    """The full table of all spans and all splits, bottom-up by span length, has in each split the same cells."""
    rng = random.Random(2)
    for _ in range(20):
        rows = [rng.choice(KINDS) for _ in range(8)]
        chart = {(i, i + 1): t for i, t in enumerate(tables(rows))}
        for length in range(2, len(rows) + 1):
            for i in range(len(rows) - length + 1):
                splits = [repair.combine(chart[i, k], chart[k, i + length]) for k in range(i + 1, i + length)]
                assert all(s == splits[0] for s in splits)
                chart[i, i + length] = splits[0]
        assert chart[0, len(rows)] == repair.parse(tables(rows))


def test_audits_of_equal_cost_are_no_beginnings_of_each_other():
    rng = random.Random(3)
    for _ in range(50):
        table = repair.parse(tables([rng.choice(KINDS) for _ in range(6)]))
        cells = list(table.values())
        assert not any(a[0] == b[0] and a[1] != b[1] and b[1].startswith(a[1]) for a in cells for b in cells)


def plain(rows):
    """What the operator returns, by a walk over each conversation: numbers, audit and repaired turns."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2][:64], hashlib.sha256(t[2].encode()).hexdigest()))
        found = rows_of(turns)
        known = [t for t, *_ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [f[0] for f in found]
        cost, audit = forward(found)
        out[conv] = (
            gaps, *[sum(f[3] == k for f in found) for k in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
        ), edited(audit, turns)
    return out


def edited(audit, turns):
    out, at = [], 0
    for letter in audit:
        _, role, text = (None, None, "") if letter == "I" else turns[at]
        at += letter != "I"
        if letter == "D":
            continue
        before = out[-1][0][:1] if out else ""
        out.append((role if letter == "K" else "assistant" if before == "u" else "user", text))
    return out


def result(given):
    fixed = repair.Repair(given)
    numbers = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in fixed.summary().collect()}
    turns = {c: [] for c in numbers}
    for r in sorted(fixed.turns().collect(), key=lambda r: r.place):
        turns[r.conv_id].append((r.role, r.text))
    digests = {r.conv_id: r.sha256 for r in fixed.digests().collect()}
    want = {c: hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest() for c, said in turns.items()}
    assert digests == want
    return {c: (numbers[c], turns[c]) for c in numbers}


def made(rng, convs, most):
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Hi.", "Hi", "", " ", "Why?", "é𝒳!\n ", "long " * 40 + "a.", "long " * 40 + "b.", None]
    return [
        (c if c else None, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts))
        for c in range(convs) for _ in range(rng.randrange(1, most))
    ]


def test_made_conversations(spark):
    rows = made(random.Random(4), 60, 12)
    assert result(table(spark, rows)) == plain(rows)


def test_conversation_over_all_ranges(spark):
    """One conversation holds most rows, with one turn and one text over and over; its parts are parsed by many tasks."""
    rng = random.Random(5)
    rows = made(rng, 20, 5) + [(7, t, "user" if t % 2 else "assistant", f"Text {t % 900}.") for t in range(3000)] + [(7, 5, "user", "Text 5.")] * 500
    assert result(table(spark, rows)) == plain(rows)


def test_few_and_no_rows(spark):
    rows = [(1, 0, "user", "x" * 500_000 + "."), (2, None, None, None)]
    got = result(table(spark, rows))
    assert got == plain(rows) and got[2] == ((0, 1, 0, 0, 0, 4, "D"), [])
    assert result(table(spark, rows).limit(0)) == {}


def test_damage(spark):
    rows = [(c, t, r, "Yes! No? So. " + str(t)) for c in [None, *range(40)] for t, r in [(None, "system"), (0, None), (1, "assistant")]]
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, {1: "", 2: re.sub("[.!?]", "", x)}.get(kind, x)
        want += [(c, t, "user" if kind == 4 else r, x)] * {0: 0, 3: 2}.get(kind, 1)
    got = [tuple(r) for r in queries.damaged(table(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) != len(rows)


@pytest.mark.parametrize("folder", [SMALL, SMALL.replace("0.001", "0.01")])
def test_query(spark, folder):
    given = spark.read.parquet(f"{folder}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in queries.damaged(given).collect()]
    want = plain(rows)
    got = {r.conv_id: tuple(r)[1:] for r in queries.op12_repair(spark, folder).collect()}
    assert set(got) == {r.conv_id for r in given.select("conv_id").distinct().collect()}
    for conv, row in got.items():
        numbers, said = want.get(conv, ((0, 0, 0, 0, 0, 0, ""), []))
        assert row == (*numbers, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())


def test_sql_orders_as_the_operator(spark):
    """Rows are told apart by the same order whatever the partitions."""
    rows = made(random.Random(6), 30, 10)
    assert result(table(spark, rows).repartition(7, F.col("text"))) == result(table(spark, rows).coalesce(1))
