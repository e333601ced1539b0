import hashlib
import random
import re

import pytest
from llm_data import ODD, SMALL, documents  # noqa: F401

from moneytrail.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def keep(kind, match):
    number = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(number) <= 19 and luhn(number)
    return kind != "phone" or 8 <= len(number) <= 15


def brute(text):
    found = {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if keep(k, m.group())] for k, p in PLAIN.items()}
    joined = ",".join(f"{k}:{a}:{b}" for k, spans in found.items() for a, b in spans)
    return [len(v) for v in found.values()], hashlib.sha256(joined.encode()).hexdigest(), joined


HARD = [
    "a@b.c_x@d.e a@b@c.d x..y@z.co.uk. q@r q@-.- é@x.yz a.b@c.d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.0.0.1 1.2.3 99999999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 5500 0000 0000 0004 1 2", "+1 (045) 555-3286 +12 +1---2 +44 20 7946 0958. +1234567890123456 ++49 (0)30-123456-",
    "𝒳𝒴 mail: a@b.cd 𝒵 10.0.0.1 ü +49 30 1234567", "1" * 3000, "a" * 20000 + " " + "b." * 4000 + "@x.y" + ".z" * 4000, ("t@u.vw 1.2.3.4 " * 700),
    "4111 1111 1111 1111\n4111 1111 1111 1111", "+1 234\n567 8901",
]


@pytest.mark.parametrize("texts", [HARD, [r[1] for r in ODD]])
def test_base_spans(documents, texts):
    got = {r.doc_id: r for r in pii.digest(pii.find(documents(*enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        counts, digest, joined = brute(text)
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == counts, text[:80]
        assert got[i].base_sha256 == digest
        assert got[i].spans.startswith(joined)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.digest(pii.find(docs)).collect():
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == brute(texts[r.doc_id])[:2]


def test_checksums_and_context(documents):
    rows = pii.find(documents(
        (1, "iban GB82 WEST 1234 5698 7654 32 ok"), (2, "GB82WEST12345698765433"), (3, "ssn 123-45-6789"), (4, "number 123-45-6789"),
        (5, "DE89370400440532013000"), (6, "my credit card 4111111111111111"), (7, "4111111111111111"), (8, "4111111111111112"),
    )).orderBy("doc_id").collect()
    assert [[s.value for s in r.pii_iban] for r in rows][:2] == [["GB82 WEST 1234 5698 7654 32"], []]
    assert [len(r.pii_ssn) for r in rows][2:4] == [1, 0]
    assert rows[4].pii_iban[0].start == 0 and rows[4].pii_iban[0].end == 22
    assert rows[5].pii_card[0].score > rows[6].pii_card[0].score and rows[7].pii_card == []


def test_empty(documents):
    assert pii.digest(pii.find(documents((1, "x")).limit(0))).collect() == []


def account(country, length, rng):
    """An account number with right check digits, in groups of four."""
    rest = "".join(rng.choice("0123456789" if i % 3 else "0123456789ABCXYZ") for i in range(length - 4))
    number = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    plain = f"{country}{98 - number % 97:02d}{rest}"
    return " ".join(plain[i:i + 4] for i in range(0, length, 4))


def test_account_numbers_among_other_capitals(documents):
    rng = random.Random(1)
    made = [account(c, n, rng) for n, countries in pii.IBAN_LENGTHS.items() for c in countries.split()]
    texts = [
        "DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "GB82 WEST 1234 5698 7654 32 Ref 123", "de89370400440532013000 x", "gb82 west 1234 5698 7654 32",
        "DE89 3704 0044 0532 0130 001", "XDE89370400440532013000", "DE89 3704 0044 0532 0130 01", "ZZ89 3704 0044 0532 0130 00", "DE89\n3704 0044 0532 0130 00",
        *[f"to {m} ABC 12 now" for m in made],
    ]
    want = [["DE89 3704 0044 0532 0130 00"], ["GB82 WEST 1234 5698 7654 32"], ["de89370400440532013000"], ["gb82 west 1234 5698 7654 32"], [], [], [], [], [], *[[m] for m in made]]
    rows = pii.find(documents(*enumerate(texts))).orderBy("doc_id").collect()
    assert [[s.value for s in r.pii_iban] for r in rows] == want


def test_secrets_and_scores(documents):
    rows = pii.digest(pii.find(documents(
        (1, 'x token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" y'), (2, "the token: of appreciation"), (3, "api_key=AB12cd34EF56gh78"),
        (4, "password: correcthorsebattery"), (5, "call 4111111111111111 or a@b.cd"), (6, "tokens = " + "a1" * 9),
    ))).orderBy("doc_id").collect()
    assert [r.spans for r in rows][:4] == ["secret:2:51", "", "secret:0:24", ""]
    assert rows[0].scores == "0.7" and rows[4].scores == "0.9,0.8" and rows[5].spans == "" and rows[1].scores == ""


def test_catch_rate_of_planted_kinds(spark):
    """Every email, address, card, phone and secret that plain forms show in the documents has a span."""
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    spans = {r.doc_id: r.spans for r in pii.digest(pii.find(docs)).collect()}
    planted = {"email": r"[a-z.0-9]+@mail", "secret": r"token = \"[0-9a-f]{40}", "phone": r"\+[0-9]+ \([0-9]{3}\) 555-[0-9]{4}"}
    for kind, form in planted.items():
        has = [r.doc_id for r in docs.collect() if re.search(form, r.text or "")]
        assert has and all(f"{kind}:" in spans[i] for i in has), kind
