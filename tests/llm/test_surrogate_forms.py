"""Surrogates of numbers that are written in different ways, and clashes of numbers with a country code."""

import re

from meridian.llm import pii


def digits(text):
    return re.sub(r"\D", "", text)


def test_one_number_has_one_surrogate_however_it_is_written():
    forms = ["+1 555 123 4567", "+15551234567", "+1 (555) 123-4567", "+1.555.123.4567"]
    assert len({digits(pii.surrogate("phone", f, b"k")) for f in forms}) == 1
    for f in ("+33 123 456 789", "+7 912 345 6789", "+353 123 456 789"):
        code = f.split()[0]
        assert pii.surrogate("phone", f, b"k").startswith(code + " ") and digits(pii.surrogate("phone", f, b"k")) == digits(pii.surrogate("phone", "+" + digits(f), b"k"))


def test_clash_of_a_number_with_country_code_is_found(spark):
    number = "+1 (017) 555-7713"
    clash = pii.surrogate("phone", number, b"meridian")
    rows = [(1, f"call {number} now"), (2, f"call {clash} now"), (3, f"call +{digits(number)} now")]
    out = {r["doc_id"]: digits(r["text"]) for r in pii.anonymise(spark.createDataFrame(rows, "doc_id long, text string"), b"meridian").collect()}
    assert out[1] == out[3] != out[2]
    assert not {out[1], out[2]} & {digits(number), digits(clash)}


def test_short_addresses_and_numbers_of_other_countries_are_found():
    for kind, value in [("ipv6", "2001:db8::1"), ("ipv6", "fe80::1ff:fe23:4567:890a"), ("phone", "+33 1 23 45 67 89"), ("phone", "01 23 45 67 89"), ("phone", "+49 30 123456"), ("phone", "+34 912 34 56 78")]:
        assert [(x[2], f"x {value} y"[x[0] : x[1]]) for x in pii.detect(f"x {value} y")] == [(kind, value)]
        assert value not in pii.replace(f"x {value} y", b"k", {})[0]
    assert pii.detect("std::vector a::b at 12:30:45 on 2024-01-02") == []
    assert len({pii.surrogate("ipv6", v, b"k") for v in ("2001:db8::1", "2001:DB8:0:0:0:0:0:1")}) == 1


def test_many_exceptions_are_joined(spark):
    names = [f"{x}{y}" for x in "ABCDEFGHIJKLMNOPRSTUVWXYZ" for y in "aeiou"]
    rows = [(i, f"Mr {n} came.", i) for i, n in enumerate(names)] + [(7, None, 0), (8, "", 0), (9, "no one", 0), (None, "Mr Aa came.", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_ip long")
    few, many = pii.anonymise(df, b"k"), pii.anonymise(df, b"k", most_exceptions=0)
    assert few.schema == many.schema and sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def texts(spark, rows, key=b"k"):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return [r["text"] for r in pii.anonymise(df, key).orderBy("doc_id").collect()]


def test_a_person_keeps_one_name(spark):
    rows = ["Mr John Smith called. Smith said hi. John Smith left.", "Mr. Smith and Dr Smith", "Dr Maria del Carmen Ruiz wrote. MARIA came.", "Smith is a trade here", "Prof J. R. Łukasz-Sørensen Weiß-Ærø"]
    one, two, three, four, five = texts(spark, rows)
    first, last = re.fullmatch(r"Mr (\w+) (\w+) called\. (?:\w+) said hi\. (?:\w+ \w+) left\.", one).groups()
    assert one == f"Mr {first} {last} called. {last} said hi. {first} {last} left." and "Smith" not in one and "John" not in one
    assert two == f"Mr. {last} and Dr {last}" and four == rows[3]
    maria, carmen, ruiz, shout = re.fullmatch(r"Dr (\w+) del (\w+) (\w+) wrote\. (\w+) came\.", three).groups()
    assert not {"Maria", "Carmen", "Ruiz"} & {maria, carmen, ruiz} and maria.endswith("a") and shout == "MARIA"
    assert not re.search("[ŁłØøÆæß]", five) and re.fullmatch(r"Prof [A-Z]\. [A-Z]\. [A-Z][a-z]+-[A-Z][a-z]+ [A-Z][a-z]+-[A-Z][a-z]+", five)


def brute(rows, key):
    """Surrogates drawn one by one, without Spark: first draws in order, then whatever collides is drawn again."""
    found = {(k, pii.canonical(k, t[a:z])) for t in rows if t for a, z, k in pii.detect(t) if k != "initial"}
    turn = dict.fromkeys(found, 0)
    while True:
        made = {e: pii.canonical(e[0], pii.surrogate(e[0], e[1], key, n)) for e, n in turn.items()}
        owner = {}
        for e in found:
            spot = (e[0], made[e])
            owner[spot] = min(owner.get(spot, (turn[e], e[1])), (turn[e], e[1]))
        bad = [e for e in found if (e[0], made[e]) in found or owner[e[0], made[e]] != (turn[e], e[1])]
        if not bad:
            break
        for e in bad:
            turn[e] += 1
    return [pii.replace(t, key, turn)[0] for t in rows]


def test_surrogates_equal_those_of_brute_force(spark):
    rows = [f"Mr {x}{y} met Mrs {y.upper()}{x.lower()}e at 10.0.{i}.{j}, +1 (2{i:02d}) 555-01{j:02d}" for i, x in enumerate("ABCDEFGH") for j, y in enumerate("aeiou")] + [None, "", "plain " * 20_000 + "Mr Abe", "a@b.cd A@B.CD"]
    assert texts(spark, rows) == brute(rows, b"k")


def test_odd_rows_and_taken_names(spark):
    schema = "doc_id long, text string, n_email string, N_EMAIL_ int, kind int"
    empty = pii.anonymise(spark.createDataFrame([], schema), b"k")
    assert empty.count() == 0 and "n_email__" in empty.columns
    rows = [(None, "Mr Bo Xu", "x", 1, 2), (None, "Mr Bo Xu", "x", 1, 2), (1, None, None, None, None)]
    got = pii.anonymise(spark.createDataFrame(rows, schema), b"k").collect()
    assert len({r["text"] for r in got}) == 2 and {r["n_email"] for r in got} == {"x", None}
