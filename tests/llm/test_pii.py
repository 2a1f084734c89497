"""PII: the anchors against plain pattern searches."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from pathlake.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), "email", m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), "ip", m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), "card", m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), "phone", m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda x: (x[0], pii.ORDER[x[1]]))


def base(text):
    return [x for x in pii.find(text) if x[1] in pii.BASE]


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet="aZ09@.+-_% ()1é\n", max_size=40))
def test_equals_pattern_search(text):
    assert base(text) == brute(text)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "4111 1111-1111 1111", "a.b@c.de", "@", "1.2.3.4", "256.1.1.1", "0.0.0.0000255", "+1 (076) 555-8046", " ", ".", "7", "--", "+", "é", "x@y@z.w.v", "12"]), max_size=9))
def test_equals_pattern_search_on_pieces(parts):
    assert base("".join(parts)) == brute("".join(parts))


def test_added_kinds():
    text = 'see https://a.example/x?y=1). IBAN: DE89 3704 0044 0532 0130 00, token = "a084c530da0e77a3dafc1ad8c55a414de4243423"'
    assert [(k, text[s:e]) for s, k, e in pii.find(text)] == [
        ("url", "https://a.example/x?y=1"),
        ("account", "DE89 3704 0044 0532 0130 00"),
        ("secret", "a084c530da0e77a3dafc1ad8c55a414de4243423"),
    ]
    assert pii.mask("mail a@b.cd now") == "mail <email> now"


def test_long_text_is_linear():
    for unit in ("a", "1", "1.", "+1", "a@", "9 "):
        text = unit * 200_000
        assert base(text[:3000]) == brute(text[:3000])
        pii.find(text)


def test_table(spark, documents):
    texts = [None, "", "x a@b.cd y", "x a@b.cd y", "é +1 (076) 555-8046"]
    got = {r["doc_id"]: r for r in pii.digest_columns(pii.spans(documents(texts))).collect()}
    assert len(got) == 5
    for i, t in enumerate(texts):
        said = ",".join(f"{k}:{s}:{e}" for s, k, e in brute(t or ""))
        assert got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[i]["spans"] == said
    assert (got[2]["n_email"], got[4]["n_phone"], got[0]["n_card"]) == (1, 1, 0)
    assert pii.spans(documents([])).count() == 0
