import itertools
import random

import pyarrow.parquet as pq
import pytest

from vellum.llm import pii

SF = "/root/testdata/sf0.01"
KEY = "test"


@pytest.mark.parametrize("text,kind,value", [
    ("write to Anna.B@Example.co.uk, now", "email", "anna.b@example.co.uk"),
    ("call +1 (555) 012-3456!", "phone", "15550123456"), ("call 555-012-3456", "phone", "5550123456"),
    ("at 10.0.0.255.", "ipv4", "10.0.0.255"), ("card 4111 1111 1111 1111", "card", "4111111111111111"),
    ("ssn 123-45-6789", "ssn", "123456789"), ("iban DE89 3704 0044 0532 0130 00.", "iban", "DE89370400440532013000"),
    ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962"),
    ("Herr Schmidt kam", "surname", "schmidt"), ("with Maria", None, None), ("Anna Кузнецова", "surname", "кузнецова"),
    ("9807915762804490 is no card", None, None), ("999.1.1.1 and 1.2.3", None, None), ("x = abcdefghijklmnopqrst", None, None)])
def test_detection(text, kind, value):
    found = [(k, v) for _, _, k, v in pii.find(text)]
    assert (found == []) if kind is None else ((kind, value) in found)
    new, spans = pii.rewrite(KEY, text, {})
    assert (new == text) == (kind is None)
    for k, a, b in spans:
        assert [(x[2], x[0], x[1]) for x in pii.find(new) if x[0] == a] == [(k, a, b)]


def test_permutations_are_one_to_one():
    for sizes in ([7], [3, 4], [2, 5, 3]):
        every = list(itertools.product(*map(range, sizes)))
        assert sorted(tuple(pii.permute("k", "t", list(v), sizes)) for v in every) == every
    rng = random.Random(1)
    for kind, draw in (("ipv4", lambda: ".".join(str(rng.randrange(256)) for _ in range(4))),
                       ("card", lambda: next(x for b in [rng.randrange(10 ** 14)] for x in (f"4{b:014d}{c}" for c in range(10)) if pii.luhn(x) == 0)),
                       ("ssn", lambda: f"{rng.randrange(1, 600):03d}{rng.randrange(1, 100):02d}{rng.randrange(1, 10 ** 4):04d}"),
                       ("surname", lambda: "".join(rng.choice("abcdeiou") for _ in range(6)))):
        values = {draw() for _ in range(3000)}
        new = {v: pii.surrogate(KEY, kind, v) for v in values}
        assert len(set(new.values())) == len(values)
        if kind == "card":
            assert all(pii.luhn(x) == 0 and x[0] == "4" for x in new.values())


def test_gender_script_and_format():
    for (script, gender), names in pii.GIVEN.items():
        new = [pii.surrogate(KEY, "given", n) for n in names]
        assert sorted(new) == sorted(names) and all(a != b for a, b in zip(names, new))
    text, _ = pii.rewrite(KEY, "Frau Anna Müller und Anna MÜLLER; Господин Иванов", {})
    a, b = text.split(";")[0].split(" und ")
    assert a.split()[1] in pii.GIVEN["latin", "f"] + pii.GIVEN["cyrillic", "f"] and a.split()[1] == b.split()[0]
    assert a.split()[2].upper() == b.split()[1] and len(a.split()[2]) == 6
    assert all("а" <= c <= "я" for c in text.split()[-1].lower())
    new, _ = pii.rewrite(KEY, "+1 (555) 012-3456 or +1 555 012 3456", {})
    x, y = new.split(" or ")
    assert [c for c in x if c.isdigit()] == [c for c in y if c.isdigit()] and x[2:4] == " (" and x[-5] == "-"


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    rows = pii.op10_pii(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    originals = {(k, v) for t in docs.values() for _, _, k, v in pii.find(t)}
    mapping = {}
    for r in rows:
        before = pii.find(docs[r.doc_id])
        assert r.n_entities == len(before) == len(r.entities)
        if not before:
            assert r.text == docs[r.doc_id]
        for (a, b, k, v), e in zip(before, r.entities):
            shown, new = docs[r.doc_id][a:b], r.text[e.start:e.end]
            assert e.type == k and shown != new
            canonical = next(y[3] for y in pii.find(r.text) if y[0] == e.start) if k != "given" else new
            assert mapping.setdefault((k, v), canonical) == canonical
            assert (k, canonical) not in originals or k == "given"
    assert len(originals) > 50 and len(set((k, x) for (k, _), x in mapping.items())) == len(mapping)


def test_collisions_get_another_surrogate(make, monkeypatch):
    ips = [f"10.0.{i}.{j}" for i in range(4) for j in range(5)]
    other = [pii.surrogate(KEY, "ipv4", x) for x in ips[:8]]  # real values that are first surrogates
    docs = make([(i, f"from {x} and again {x}") for i, x in enumerate(ips + other)] + [(99, None), (98, ""), (None, ips[0])])
    for limit in (pii.BROADCAST, 2):
        monkeypatch.setattr(pii, "BROADCAST", limit)
        out = {r.doc_id: r for r in pii.replace_pii(docs, KEY).collect()}
        new = {}
        for i, x in enumerate(ips + other):
            a, b = (p for p in out[i].text.split() if p[0].isdigit())
            assert a == b and a not in ips + other
            new[x] = a
        assert len(set(new.values())) == len(ips + other)
        assert out[None].text == new[ips[0]] and out[99].text is None and out[98].text == ""
    assert pii.replace_pii(docs.limit(0), KEY).count() == 0


def test_used_up_formats_get_longer_surrogates(make):
    short = [a + b for a in "aeiouy" for b in "bcdfghjklmnpqrstvwxz"]  # every surname of this format
    odd = ["Šč", "Մխ", "Ћђ"]
    docs = make([(i, f"Herr {x.title()} kam. Mail {x[0]}@{x[1]}.de") for i, x in enumerate(short)] + [(900 + i, f"Frau {x} kam") for i, x in enumerate(odd)])
    out = {r.doc_id: r.text.split() for r in pii.replace_pii(docs, KEY).collect()}
    names, mails = [out[i][1].lower() for i in out], [out[i][4] for i in range(len(short))]
    assert len(set(names)) == len(short) + len(odd) and not set(names) & {*short, *(x.lower() for x in odd)}
    assert len(set(mails)) == len(short) and not set(mails) & {f"{x[0]}@{x[1]}.de" for x in short}
    assert all(pii.EMAIL.fullmatch(x) for x in mails) and all(out[i][1].istitle() for i in out)
    assert all("Ա" <= c <= "և" for c in out[901][1])


@pytest.mark.parametrize("kind,values", [
    ("ipv4", [f"192.168.100.{i}" for i in range(101, 121)]), ("phone", [f"555-123-45{i}" for i in range(60, 80)]),
    ("phone", [f"555 123 45{i}" for i in range(60, 80)]), ("ssn", [f"123-45-67{i}" for i in range(60, 80)]),
    ("card", ["4111 1111 1111 1111", "5500 0000 0000 0004", "4012888888881881"] * 5), ("email", ["a" * n + "@example.com" for n in (63, 64, 65, 700)]),
    ("email", ["анна@example.com"])])
def test_lists_of_values_on_one_line(kind, values):
    text = " ".join(values)
    assert [text[a:b] for a, b, k, _ in pii.find(text) if k == kind] == values
    new, _ = pii.rewrite(KEY, text, {})
    assert not any(v in new for v in values)


@pytest.mark.parametrize("n", [16, 512, 513, 5000, 40_000])
def test_secrets_of_any_length(n):
    value = ("aB3dE5gH" * n)[:n]
    new, spans = pii.rewrite(KEY, f'key = "{value}" end', {})
    assert [k for k, _, _ in spans] == ["secret"] and value[-16:] not in new and len(new) == n + 12
    other, _ = pii.rewrite(KEY, f'key = "{value[:-1]}z" end', {})
    assert other != new


def test_numbers_in_words_stay():
    assert pii.find("v1.2.3.4 x555-123-4567 555-123-4567abc 4111111111111111abc") == []


def test_names_at_their_other_places():
    text = "John Smith said so. Smith left, John stayed; SMITH's friend, smith by trade, met Smithson. Mary-Smith"
    found = [(text[a:b], k) for a, b, k, _ in pii.find(text)]
    assert found == [("John", "given"), ("Smith", "surname"), ("Smith", "surname"), ("John", "given"), ("SMITH", "surname"), ("Smith", "surname")]
    new, _ = pii.rewrite(KEY, text, {})
    assert "Smith " not in new and "John" not in new and "SMITH" not in new and "smith by" in new and "Smithson" in new
    assert new.split()[1] == new.split()[4]


@pytest.mark.parametrize("text,names", [("John F. Kennedy", ["John", "Kennedy"]), ("Mr. J. Smith", ["Smith"]), ("Dr. J.R.R. Tolkien", ["Tolkien"]),
                                        ("Mary J Blige", ["Mary", "Blige"]), ("Prof. Anna B. C. Meyer", ["Anna", "Meyer"])])
def test_initials_between(text, names):
    assert [text[a:b] for a, b, _, _ in pii.find(text)] == names
