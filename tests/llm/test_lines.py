import random
import re
from collections import Counter, defaultdict

import pytest
from llm_data import ODD, SMALL, documents  # noqa: F401

from moneytrail.llm import lines


def split(line):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", line) if w]


def brute(rows, depth=3, min_docs=5, constant=0.7, copy=0.5):
    """The tree walked line by line; texts without the lines of recurring templates, with the number of those."""
    docs = {(i, t) for i, t in rows if t is not None}
    parsed, leaves = {}, defaultdict(Counter)
    for d in docs:
        for no, line in enumerate(d[1].split("\n")):
            ws = tuple("<*>" if re.search("[0-9]", w) else w for w in split(line))
            if len(ws) > depth:
                parsed[d, no] = ws
    leaf = {ws: (len(ws), ws[:depth]) for ws in parsed.values()}
    for d, ws in {(d, ws) for (d, _), ws in parsed.items()}:
        leaves[leaf[ws]][ws] += 1
    template = {}
    for key, variants in leaves.items():
        held = Counter()
        for ws, n in variants.items():
            for at, w in enumerate(ws):
                held[at, w] += n
        for ws in variants:
            shape = tuple(w if w != "<*>" and held[at, w] >= min_docs else "<*>" for at, w in enumerate(ws))
            if sum(w != "<*>" for w in shape) >= constant * len(ws) and sum(variants.values()) >= min_docs:
                template[ws] = (key, shape)

    def recurring(pairs):
        return {t for t, n in Counter(t for t, _ in set(pairs)).items() if n >= min_docs}

    again = recurring((template[ws], d) for (d, _), ws in parsed.items() if ws in template)
    covered = Counter()
    for (d, _), ws in parsed.items():
        if template.get(ws) in again:
            covered[d] += len(ws)
    pages = {d for d, n in covered.items() if n < copy * len(split(d[1]))}
    gone = recurring((template[ws], d) for (d, _), ws in parsed.items() if template.get(ws) in again and d in pages)
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        all_lines = t.split("\n")
        stay = [line for no, line in enumerate(all_lines) if template.get(parsed.get(((i, t), no))) not in gone]
        out.append((i, "\n".join(stay), len(all_lines), len(all_lines) - len(stay)))
    return sorted(out, key=str)


def result(df, **options):
    found, n_lines, n_dropped = lines.drop_recurring(df, **options)
    return sorted(((r.doc_id, r.text, r[n_lines], r[n_dropped]) for r in found.collect()), key=str)


@pytest.mark.parametrize("folder", [SMALL, SMALL.replace("0.001", "0.01")])
def test_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert result(docs.select("doc_id", "text")) == want
    assert any(r[3] for r in want)


def prose(rng, n=12):
    return "\n".join(" ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(8)) for _ in range(n))


def test_templates_with_fields_go_and_copies_stay(documents):
    rng = random.Random(3)
    rows = []
    for i in range(12):
        noise = [f"Posted by user{i} on 2024-01-{i + 10} in news", f"Read the full story about item {chr(97 + i) * 4} on our site today", "All rights reserved by us."]
        body = prose(rng).split("\n")
        for j, line in enumerate(noise):
            body.insert(rng.randrange(len(body)) if j else 0, line)
        rows.append((i, "\n".join(body)))
    copy = prose(rng)
    rows += [(100 + i, copy) for i in range(20)]
    rows += [(200 + i, copy.replace(copy.split()[i], "edited", 1)) for i in range(20)]
    got = {r[0]: r for r in result(documents(*rows))}
    assert all(got[i][3] == 3 for i in range(12))
    assert all(got[i][1] == copy and got[i][3] == 0 for i in range(100, 120))
    assert all(got[i][3] == 0 for i in range(200, 220))
    assert sorted(got.values(), key=str) == brute(rows)


def test_odd_rows(documents):
    line = "this very line recurs everywhere"
    rows = [(r[0], r[1]) for r in ODD] + [(50 + i, f"{line}\n" + " ".join(chr(97 + i) * n for n in range(3, 12)) + "\n\n") for i in range(6)] + [(70, line), (70, line), (None, line), (71, "")]
    df = documents(*rows)
    assert result(df) == brute(rows)
    assert lines.drop_recurring(df)[0].columns[:len(df.columns)] == df.columns
    assert result(df.limit(0)) == []
    assert {r[1] for r in result(df) if r[0] == 70} == {""}


def test_long_words_without_digits_are_quick(documents):
    assert result(documents((1, "a" * 300_000 + " b c d e"))) == [(1, "a" * 300_000 + " b c d e", 1, 0)]


def test_short_lines_go_when_asked(documents):
    rng = random.Random(9)
    rows = [(i, f"{prose(rng)}\nAll rights reserved.\n\nPage {i}\nOnly w{chr(97 + i)}") for i in range(8)]
    got = {r[0]: r[1] for r in result(documents(*rows), short=True)}
    assert all(got[i] == t.replace("All rights reserved.\n", "") for i, t in rows)
    assert {r[3] for r in result(documents(*rows))} == {0}


def test_a_passage_of_many_short_documents_goes_and_copies_stay(documents):
    rng = random.Random(10)
    passage, copy = " ".join(f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)), prose(rng)
    rows = [(i, f"{prose(rng, 6)}\n{passage}") for i in range(30)]
    rows += [(100 + i, copy) for i in range(20)] + [(200 + i, copy.replace(copy.split()[4 * i], "edited", 1)) for i in range(20)]
    got = {r[0]: r for r in result(documents(*rows), copies_once=True)}
    assert all(got[i][1] == rows[i][1].split("\n" + passage)[0] for i in range(30))
    assert all(got[i][3] == 0 for i in got if i >= 100)
    assert not any(r[3] for r in result(documents(*rows)))
