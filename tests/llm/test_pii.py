import datetime
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from innsight.llm import pii


def value_of(spark, values, key="k"):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    made = df.select("v", pii.pseudonymise_value(F.lit(key), F.col("v")).alias("p"))
    return dict(map(tuple, made.collect()))


def luhn(number):
    digits = [int(c) for c in reversed(re.sub(r"\D", "", number))]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10


def iban(text):
    turned = text.replace(" ", "")
    turned = turned[4:] + turned[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97


def test_digits_are_permuted_one_to_one(spark):
    for n in (2, 3, 4):
        df = spark.range(10**n).select(F.lpad(F.col("id").cast("string"), n, "0").alias("d"))
        made = [r[0] for r in df.select(pii.permute_digits(F.lit("k"), "test", F.col("d"))).collect()]
        assert len(set(made)) == 10**n and all(re.fullmatch(rf"\d{{{n}}}", m) for m in made)
        assert sum(int(m) == i for i, m in enumerate(made)) < 10 + 10**n // 50


def test_days_are_permuted_one_to_one(spark):
    df = spark.range(pii.DAYS[0] * pii.DAYS[1]).select(
        F.date_format(F.date_add(F.lit(pii.FIRST_DAY).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d")
    )
    made = df.select(pii.pseudonymise_value(F.lit("k"), F.col("d")).alias("p"))
    assert made.distinct().count() == pii.DAYS[0] * pii.DAYS[1]


def test_formats_and_validity_stay(spark):
    cards = ["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "4845168114407329", "378282246310005"]
    got = value_of(spark, cards)
    for card in cards:
        assert got[card] != card and luhn(got[card]) == luhn(card)
        assert re.sub(r"\d", "0", got[card]) == re.sub(r"\d", "0", card)
    assert re.sub(r"\D", "", got[cards[0]]) == re.sub(r"\D", "", got[cards[1]])

    ibans = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "DE00370400440532013000"]
    got = value_of(spark, ibans)
    for text in ibans[:2]:
        assert got[text] != text and iban(got[text]) == 1
        assert re.sub(r"\d", "0", got[text]) == re.sub(r"\d", "0", text)
    assert got[ibans[2]] == ibans[2]  # no valid number

    dates = ["2024-02-29", "29.02.2024", "2023/12/31", "2023-02-30", "1850-01-01"]
    got = value_of(spark, dates)
    assert datetime.date.fromisoformat(got[dates[0]]) == datetime.datetime.strptime(got[dates[1]], "%d.%m.%Y").date()
    assert got[dates[0]] != dates[0] and re.fullmatch(r"\d{4}/\d\d/\d\d", got[dates[2]])
    assert got[dates[3]] == dates[3] and got[dates[4]] == dates[4]

    phones = ["+1 (017) 555-7713", "(017) 555-7713", "017-555-7713", "+49 030.555.7713"]
    got = value_of(spark, phones)
    digits = {p: re.sub(r"\D", "", got[p])[-10:] for p in phones}
    assert len({digits[p] for p in phones[:3]}) == 1
    assert got[phones[0]].startswith("+1 (") and got[phones[3]].startswith("+49 ")

    got = value_of(spark, ["10.0.0.1", "256.1.1.1", "078-05-1120", "a.b@c.example.org"])
    assert re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", got["10.0.0.1"]) and got["10.0.0.1"] != "10.0.0.1"
    assert all(int(x) < 256 for x in got["10.0.0.1"].split(".")) and got["256.1.1.1"] == "256.1.1.1"
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", got["078-05-1120"])
    assert re.fullmatch(r"u[0-9a-f]{16}@m[0-9a-f]{8}\.example\.com", got["a.b@c.example.org"])


def test_equal_values_stay_linked_and_keys_differ(frame):
    docs = frame([(1, "card 4111111111111111, again 4111111111111111."), (2, "4111111111111111 10.0.0.1")], clash=("n_pii", "kind", "__found", "matched", "GAPS", "new"))
    rows = {r["doc_id"]: r for r in pii.pseudonymise(docs, "one").collect()}
    found = re.findall(r"\d{16}", rows[1]["text"]) + re.findall(r"\d{16}", rows[2]["text"])
    assert len(set(found)) == 1 and found[0] != "4111111111111111"
    assert rows[1]["text"] == f"card {found[0]}, again {found[0]}." and rows[1]["n_pii"] == 2
    assert rows[2]["n_account"] == 1 and rows[2]["n_ipv4"] == 1
    other = pii.pseudonymise(docs, "two").collect()[0]["text"]
    assert other != rows[1]["text"]


@pytest.mark.parametrize(
    "text",
    ["version 1.2.3 of 12345", "id 123456789012", "1.2.3.4.5", "2024-13-45", "x4111111111111111", "a@b", "", "1" * 40],
)
def test_other_text_stays(frame, text):
    assert pii.pseudonymise(frame([(1, text)]), "k").first()["text"] == text


def test_awkward_rows(frame, awkward):
    rows = pii.pseudonymise(frame(awkward + [(9, "7" * 16 + " " + "8@9.example.com ")]), "k").collect()
    assert len(rows) == len(awkward) + 1
    before = sorted(map(str, (t for _, t in awkward)))
    assert sorted(str(r["text"]) for r in rows if r["n_pii"] == 0) == before
    assert pii.pseudonymise(frame([]), "k").count() == 0


def test_query_runs_no_python(spark, contract, documents):
    df = contract.queries()["op2_pii"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    got = {r["doc_id"]: r for r in df.collect()}
    for doc_id, text in documents:
        mails = re.findall(pii.MAIL.replace("++", "+").replace("}+", "}"), text or "")
        assert got[doc_id]["n_mail"] == len(mails)
        assert not any(m in got[doc_id]["text"] for m in mails)


SCANS = {
    "mail": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ipv4": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])",
    "date": r"(?<!\d)(?:19|20)\d\d-(?:0\d|1[0-2])-(?:[0-2]\d|3[01])(?!\d)",
    "card": r"(?<![\w+-])\d{16}(?![\w-])",
    "phone": r"\+\d{1,2} \(\d{3}\) \d{3}-\d{4}",
    "social": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
}


def test_table_scanned_by_other_patterns(spark, contract):
    """What an independent scan finds in the texts is replaced, at its place and in its
    format, and equal values stay equal over all documents."""
    folder = "/root/testdata/sf0.01"
    before = dict(duckdb.connect().execute(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall())
    after = {r["doc_id"]: r["text"] for r in contract.queries()["op2_pii"](spark, folder).select("doc_id", "text").collect()}
    assert before.keys() == after.keys()
    pseudonyms, seen = {}, Counter()
    for doc_id, text in before.items():
        for kind, pattern in SCANS.items():
            old, new = (re.findall(pattern, t or "") for t in (text, after[doc_id]))
            assert len(old) == len(new), (doc_id, kind)
            for a, b in zip(old, new):
                seen[kind] += 1
                assert pseudonyms.setdefault((kind, a), b) == b
                if kind == "card":
                    assert luhn(a) == luhn(b)
                elif kind == "date":
                    datetime.date.fromisoformat(b)
                elif kind == "ipv4":
                    assert all(int(x) < 256 for x in b.split("."))
    assert sum(n > 0 for n in seen.values()) >= 3 and sum(seen.values()) > 50
    # one to one, and almost nothing maps to itself
    assert len(set((k, b) for (k, _), b in pseudonyms.items())) == len(pseudonyms)
    assert sum(a == b for (_, a), b in pseudonyms.items()) <= len(pseudonyms) // 50
