import re

import pytest

from postmill.llm import surrogates
from postmill.llm.queries import op8_pii_surrogates

LOOK = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\bAKIA[A-Z0-9]{16}\b"
                  r"|(?<=password=)\w+|(?<=token = \")\w+|\b\d{1,3}(?:\.\d{1,3}){3}\b")


def run(spark, docs, key="k"):
    df = spark.createDataFrame([(d, t, 1, "e") for d, t in docs], "doc_id long, text string, found int, entity string")
    return [r["__text"] for r in sorted(surrogates.replaced(df, key).collect(), key=lambda r: r.doc_id)]


def luhn(number):
    digits = [int(c) for c in number[::-1]]
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0


def test_query_replaces_every_entity_and_nothing_else(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_pii_surrogates(spark, sf).collect()
    assert len(rows) == len(docs) and any(r.entities for r in rows)
    pairs = {}
    for r in rows:
        old, new = docs[r.doc_id], r.text
        for value in LOOK.findall(old):
            assert value not in new
        if not r.entities:
            assert old == new
            continue
        assert LOOK.sub("#", old) == LOOK.sub("#", new)
        for a, b in zip(LOOK.findall(old), LOOK.findall(new)):
            assert pairs.setdefault(a, b) == b
    assert len(set(pairs.values())) == len(pairs) and not set(pairs) & set(pairs.values())


def test_forms_genders_and_scripts(spark):
    new = run(spark, [
        (1, "Mrs. Anna Berg met Mr Paul Berg; Mr. Berg left. Dr Jón Áb came."), (2, "+1 (499) 555-6503 or +1 499 555 6503"),
        (3, "card 4041 8949 7460 8795 and 4041894974608795."), (4, "Frau Мария Иванова"), (5, "DE89 3704 0044 0532 0130 00, 078-05-1120"),
        (6, "password=e9b9ed9cc9 token: \"1beb58b8af68854f\""), (7, "at 42.144.35.254. License 2.0. v1.2.3.4.5"), (8, "A.B@Mail.Example.org a.b@mail.example.org"),
    ])
    a = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr (\w+) (\w+); Mr\. (\w+) left\. Dr (\w+) (\w+) came\.", new[0])
    assert a[2] == a[4] == a[5] != "Berg" and a[1].endswith(surrogates.ENDINGS["female"]) and a[3].endswith(surrogates.ENDINGS["male"])
    one, two = new[1].split(" or ")
    assert re.sub(r"\D", "", one) == re.sub(r"\D", "", two) and re.fullmatch(r"\+\d \(\d{3}\) \d{3}-\d{4}", one)
    cards = re.fullmatch(r"card ([\d ]{19}) and (\d{16})\.", new[2])
    assert cards[1].replace(" ", "") == cards[2] and luhn(cards[2]) and cards[2] != "4041894974608795"
    assert re.fullmatch(r"Frau [А-Я][а-я]{4} [А-Я][а-я]{6}", new[3]) and new[3] != "Frau Мария Иванова"
    assert re.fullmatch(r"DE\d\d( \d{4}){4} \d\d, \d{3}-\d\d-\d{4}", new[4])
    assert re.fullmatch(r'password=[0-9a-f]{10} token: "[0-9a-f]{16}"', new[5])
    assert re.fullmatch(r"at 2[45]\d(\.\d+){3}\. License 2\.0\. v1\.2\.3\.4\.5", new[6])
    assert len(set(new[7].split())) == 1 and new[7].split()[0].endswith("@example.org")


def test_collisions_are_drawn_again(spark):
    docs = [(k, f"x {k // 26 % 26 + 10}a@b.com {chr(97 + k % 26)}@b.com") for k in range(300)]
    new = run(spark, docs)
    pairs = {}
    for (_, old), text in zip(docs, new):
        for a, b in zip(old.split()[1:], text.split()[1:]):
            assert pairs.setdefault(a, b) == b
    assert len(set(pairs.values())) == len(pairs)


def test_edge_texts(spark):
    docs = [(1, None), (2, ""), (3, "a@b.com"), (4, "no entity"), (5, "a" * 60_000), (6, ("c@d.org " * 3000)), (6, "c@d.org " * 3000), (7, "1" * 30_000)]
    new = run(spark, docs)
    assert new[:2] == [None, ""] and new[3:5] == ["no entity", "a" * 60_000] and new[7] == "1" * 30_000
    assert new[5] == new[6] and len(set(new[5].split())) == 1 and new[2] != "a@b.com"
    assert run(spark, docs) == new != run(spark, docs, "other key")
    df = spark.createDataFrame([], "doc_id long, text string")
    assert surrogates.replaced(df, "k").collect() == []


def test_bare_mentions_of_a_name_found_get_its_surrogate(spark):
    new = run(spark, [
        (1, "Mr Paul Berg called. Paul Berg left, Berg said; Berg's Bergen and ex-Berg."), (2, "Dr Anna Berg or Mrs Anna Berg"),
        (3, "Paul stays where no title is."), (4, "Mr Paul met Paul"),
    ])
    a = re.fullmatch(r"Mr (\w+) (\w+) called\. (\w+) (\w+) left, (\w+) said; (\w+)'s Bergen and ex-(\w+)\.", new[0])
    assert a[1] == a[3] != "Paul" and a[2] == a[4] == a[5] == a[6] == a[7] != "Berg" and a[1].endswith(surrogates.ENDINGS["male"])
    b = re.fullmatch(r"Dr (\w+) (\w+) or Mrs (\w+) (\w+)", new[1])
    assert b[1] == b[3] and b[2] == b[4] == a[2] and b[1].endswith(surrogates.ENDINGS["female"])
    assert new[2] == "Paul stays where no title is." and new[3] == f"Mr {a[1]} met {a[1]}"
    df = spark.createDataFrame([(1, "Mr Paul Berg: Paul Berg")], "doc_id long, text string")
    assert [r["__entities"] for r in surrogates.replaced(df, "k").collect()] == [3]


def test_secrets_whole_spaced_phones_and_long_addresses(spark):
    new = run(spark, [
        (1, "password=hunter2, password=Tr0ub4dor&3 end"), (2, "secret: 'two words, & 1' {\"token\": \"ab\\\"cd\"} api_key=\u5bc6\u78bc9."),
        (3, "call 555 123 4567 or (555) 123-4567 or 06 12 34 56 78."), (4, "at fe80::1, FE80:0:0:0:0:0:0:1 and 2a00:1450:4001:81b::200e."),
        (5, "at 12:30:45, x[::2], std::abs, ::ffff:42.144.35.254 and password=****"),
    ])
    a = re.fullmatch(r"password=([a-z]{6}\d), password=(\w{9})&(\d) end", new[0])
    assert a[1] != "hunter2" and a[2] != "Tr0ub4dor"
    b = re.fullmatch(r"secret: '([a-z]{3}) ([a-z]{5}), & (\d)' \{\"token\": \"(\w\w\\\"\w\w)\"\} api_key=([a-z]{2}\d)\.", new[1])
    assert b[1] != "two" and b[2] != "words" and b[4] != "ab\\\"cd"
    c = re.fullmatch(r"call (\d{3} \d{3} \d{4}) or (\(\d{3}\) \d{3}-\d{4}) or (\d\d(?: \d\d){4})\.", new[2])
    assert c[1] != "555 123 4567" and re.sub(r"\D", "", c[1]) == re.sub(r"\D", "", c[2]) and c[3] != "06 12 34 56 78"
    d = re.fullmatch(r"at (2001:0db8(?::[0-9a-f]{4}){6}), (2001:0db8(?::[0-9a-f]{4}){6}) and (2001:0db8(?::[0-9a-f]{4}){6})\.", new[3])
    assert d[1] == d[2] != d[3]
    assert re.fullmatch(r"at 12:30:45, x\[::2\], std::abs, ::ffff:2[45]\d(\.\d+){3} and password=\*\*\*\*", new[4])
