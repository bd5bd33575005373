import hashlib
import re

import pytest

from tests.llm.helpers import docs
from trendspark.llm import personal

# fixed values: base patterns and their order
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TEXTS = [
    None, "", "no data", "a@b.co@d.com, x.y+z@sub.host-1.org.", "a@b.c_x@d.e", "@x.y a@b a@.c", "é1.2.3.4.5.6.7.8 \U0001f600 9.9.9.9",
    "256.1.1.1 0255.001.2.3 1.2.3", "4111 1111 1111 1111 and 4111111111111112", "+1 (826) 555-4081 190.137.223.204",
    "+49-30 123456 +1 2", "7536784127813050 4845168114407329", "card: 4111-1111-1111-1111\n+12 345 678 901",
    "\x01a@b.cd\x01 +44 20 7946 0958\x01", "+1234567890123456", "0000000000000000", "mail me (at) host (dot) com",
    "a@b.co", "a@b.co", " ".join(f"10.0.{i % 256}.{i % 7}" for i in range(300)),
]


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in found.split(".")),
            "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base_spans(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS.items())
             for m in re.finditer(p, text or "") if passes(k, m.group())]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def test_base_spans_against_brute_force(spark):
    table = docs(spark, TEXTS).withColumnRenamed("lang", "base").withColumnRenamed("source", "spans")
    for r in personal.span_digests(table).collect():
        want = base_spans(TEXTS[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), TEXTS[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in want) for k in PATTERNS]
        assert set(want) <= set(r.spans.split(",")) | ({""} if not want else set())


def test_trees_add_what_patterns_run_over(spark):
    many = [f"call +1 ({200 + i}) 555-{1000 + i} now or 10.1.{i}.7 ok" for i in range(120)]
    many += ["tel +1 (826) 555-4081 190.137.223.204 end", "order 12345 67890 and 99 999"]
    found = {r.doc_id: r for r in personal.span_digests(docs(spark, many)).collect()}
    assert "phone:4:21" in found[120].spans and "ip:22:37" in found[120].spans
    assert found[121].spans == ""


def test_redaction_and_empty_table(spark):
    got = {r.doc_id: r.text for r in personal.redacted(docs(spark, ["x a@b.co y 1.2.3.4", None, "é a@b.co"])).collect()}
    assert got == {0: "x [email] y [ip]", 1: "", 2: "é [email]"}
    assert personal.span_digests(docs(spark, [])).count() == 0


@pytest.mark.parametrize("share", [0.01, 0.1, 0.6])
def test_forms_no_base_pattern_matches(spark, share):
    """National numbers and spelled-out addresses are found whatever their share."""
    n = 600
    odd = round(n * share)
    many = [f"call ({200 + i % 700}) 555-{1000 + i} or mail a{i} (at) host{i} (dot) com now" for i in range(odd)]
    many += [f"call +1 ({200 + i % 700}) 555-{1000 + i} or mail a{i}@host{i}.com now" for i in range(odd, n)]
    many += [f"lot {10 + i} {100 + i} {200 + i} of it" for i in range(60)]
    found = {r.doc_id: r for r in personal.span_digests(docs(spark, many)).collect()}
    for i in range(odd):
        number, address = f"({200 + i % 700}) 555-{1000 + i}", f"a{i} (at) host{i} (dot) com"
        at = [(k, many[i].index(x), many[i].index(x) + len(x)) for k, x in (("phone", number), ("email", address))]
        assert found[i].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in at), many[i]
    assert all(found[i].spans == "" for i in range(n, n + 60))


def test_very_long_runs(spark):
    """Patterns that repeat a group would recurse once a repetition; most texts here are a megabyte."""
    n = 1_000_000
    address = "a@b" + ".c" * (n // 2)
    texts = {"1" * n: [], "1 " * (n // 2): [], "1-" * (n // 2) + "x": [], address: [f"email:0:{len(address)}"], "a" * n: [],
             "a@" + "b" * n: [], "+" + "1" * n: [], "+1" + " (" * (n // 2): [], "." * n: [],
             "x (at) y" + "(dot)z" * (n // 6): [], "1" + ".1" * 2_000: None, "a.b@c_d.e@f.g " * 400: None}
    found = {r.doc_id: r for r in personal.span_digests(docs(spark, list(texts))).collect()}
    for i, (text, want) in enumerate(texts.items()):
        want = base_spans(text) if want is None else want
        assert found[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text[:20]
