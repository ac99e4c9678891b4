"""Surrogates against what they promise: the same entity everywhere the same, different ones different, formats kept."""

import ipaddress
import re

from tessella.llm import surrogates as S

KEY = b"k"


def replaced(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in S.with_surrogates(docs, KEY).collect()}


def test_addresses_of_both_versions(spark):
    got = replaced(spark, ["from 2001:db8::1 to 192.168.0.1", "2001:0DB8:0:0:0:0:0:1!", "std::vector a::b :: 12:30:45 fe80::1", None, ""])
    a, b = got[0].text.split(" ")[1], got[1].text[:-1].lower()
    assert a == b != "2001:db8::1" and ipaddress.IPv6Address(a) and "192.168.0.1" not in got[0].text
    assert got[2].text.startswith("std::vector a::b :: 12:30:45 ") and not got[2].text.endswith("fe80::1")
    assert got[0].spans == "ip6:5:16,ip:20:31" and got[3].text is None and got[4].text == ""


def test_plain_replacement_and_distinctness(spark):
    texts = [f"Dr. Jane Smith{i} wrote to user{i}@mail.example, +49 30 1234{i:04d} and card 4111 1111 1111 {i:04d}. Smith{i} said Jane agreed." for i in range(40)]
    texts = [t.replace("Smith", "Smi" + chr(97 + i % 26) + chr(97 + i // 26)) for i, t in enumerate(texts)]
    texts = [re.sub(r"(Smi[a-z]{2})\d+", r"\1", t) for t in texts]
    got = replaced(spark, texts + texts[:5])
    back = {}
    for i, t in enumerate(texts + texts[:5]):
        want, at = "", 0
        for a, b, kind, canonical in S.entities(t):
            new = S.surrogate(KEY, kind, canonical)
            want += t[at:a] + S._dressed(t[a:b], kind, new)
            at = b
            shape = "digits" if kind in ("card", "number", "phone", "ssn") else "name" if kind == "family" or kind.startswith("given") else kind
            assert back.setdefault((shape, new.lower()), (kind, canonical)) == (kind, canonical) and new.lower() != canonical
        assert got[i].text == want + t[at:] and got[i].n_entities == len(S.entities(t)) >= 5
        assert "Jane" not in got[i].text and "Smi" not in got[i].text and "@mail.example" not in got[i].text
    assert replaced(spark, texts)[3].text == got[3].text


def test_repeats_empty_table_and_long_text(spark):
    docs = spark.createDataFrame([(1, "mail a1@b.example now", "x"), (1, "mail a1@b.example now", "x"), (None, "x " * 50_000 + "a1@b.example", "y")], "doc_id long, text string, spans string")
    rows = S.with_surrogates(docs, KEY).collect()
    assert len(rows) == 3 and len({r.text.split(" ")[1] for r in rows if r.doc_id == 1}) == 1
    assert next(r for r in rows if r.doc_id is None).text.split(" ")[-1] == next(r for r in rows if r.doc_id == 1).text.split(" ")[1]
    assert S.with_surrogates(docs.limit(0), KEY).count() == 0


def test_what_is_found_by_hand():
    text = "IBAN DE89 3704 0044 0532 0130 00, ssn 123-45-6789, born 12.03.1980, on 2023-01-02 10 people; call +49 30 1234567 or (030) 555-1234 or 0800 123 45 67; DE88 3704 0044 0532 0130 00; 10.1.2.3 8.8.8.8; 000-12-3456"
    got = [(text[a:b], k, c) for a, b, k, c in S.entities(text)]
    assert got == [
        ("DE89 3704 0044 0532 0130 00", "iban", "DE89370400440532013000"), ("123-45-6789", "ssn", "123456789"), ("+49 30 1234567", "phone", "+49301234567"), ("(030) 555-1234", "phone", "0305551234"), ("0800 123 45 67", "phone", "08001234567"),
        ("88 3704 0044 0532 0130", "number", "883704004405320130"), ("10.1.2.3", "ip", "10.1.2.3"), ("8.8.8.8", "ip", "8.8.8.8"), ("000-12-3456", "phone", "000123456"),
    ]


def test_surrogates_keep_country_range_and_checks(spark):
    text = "GB82 WEST 1234 5698 7654 32 and DE89370400440532013000 or +49 30 1234567, +1 (212) 555-0101, +353 1 2345678; 192.168.7.9 127.0.0.1 172.20.1.1 8.8.8.8; 123-45-6789"
    new = replaced(spark, [text])[0].text
    old, now = (re.findall(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{2,4})+", t) for t in (text, new))
    for a, b in zip(old, now, strict=True):
        assert a != b and a[:2] == b[:2] and [c.isdigit() for c in a] == [c.isdigit() for c in b]
        plain = b.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert re.search(r"\+49 \d\d \d{7},", new) and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4},", new) and re.search(r"\+353 \d \d{7};", new)
    assert "30 1234567" not in new and "1 2345678" not in new and "555-0101" not in new
    addresses = re.findall(r"(?:\d+\.){3}\d+", new)
    assert [ipaddress.ip_address(a).is_private for a in addresses] == [True, True, True, False] and addresses[0].startswith("192.168.") and addresses[1].startswith("127.")
    assert S.SSN.search(new.split("; ")[-1]) and "123-45-6789" not in new
    # Ranges permute, so different addresses stay different.
    few = {S.surrogate(KEY, "ip", f"192.168.{i >> 8}.{i & 255}") for i in range(2000)}
    assert len(few) == 2000


def test_many_numbers_in_one_text():
    text = " ".join(f"{i:09d}-{i % 97:02d}" for i in range(20_000))
    assert len(S.entities(text)) <= 20_000
