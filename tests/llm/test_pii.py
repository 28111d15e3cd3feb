import hashlib
import re
import time

import numpy as np
import pytest

from lectern.llm import pii

PLAIN = "Mail a.b+c@x-y.example.com, 10.0.0.256 and 192.168.1.20; +1 (499) 555-6503 card 4111 1111 1111 1111 or 4111 1111 1111 1112 +12"
DISGUISED = [
    ("write john.doe (at) mail [dot] example dot com now", "email", "john.doe (at) mail [dot] example dot com"),
    ("jane at mail dot example dot com", "email", "jane at mail dot example dot com"),
    ("see j＠mаil.com!", "email", "j＠mаil.com"),
    ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
    ("card 4111 1111 1111 one one one one ok", "card", "4111 1111 1111 one one one one"),
    ("ip one nine two dot one six eight dot one dot two five end", "ip", "one nine two dot one six eight dot one dot two five"),
    ("\U0001f600 ４１１１ 1111-1111 1111", "card", "４１１１ 1111-1111 1111"),
]


def test_base():
    assert [(k, PLAIN[i:j]) for k, i, j in pii.base_spans(PLAIN)] == [("email", "a.b+c@x-y.example.com"), ("ip", "192.168.1.20"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (499) 555-6503")]


@pytest.mark.parametrize("text,kind,span", DISGUISED)
def test_disguised(text, kind, span):
    base = pii.base_spans(text)
    assert [(k, text[i:j]) for k, i, j in pii.added_spans(text, base)] == [(kind, span)]


@pytest.mark.parametrize("text", ["we met at one two three dot four", "look at the dot on the i", "nine lives, one cat", "at one point two or three", "été à la plage", "the@ of@ and."])
def test_clean(text):
    assert pii.base_spans(text) == pii.added_spans(text, []) == []


def test_operator(spark):
    rows = [(i, t, "x", None) for i, (t, *_) in enumerate(DISGUISED)] + [(50, PLAIN, "x", None), (51, None, None, None), (52, "", None, None), (50, PLAIN, "x", None), (None, PLAIN, None, None), (53, "w " * 50_000 + PLAIN, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string, n_ip string")
    got = pii.find_pii(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    base = "email:5:26,ip:43:55,card:80:99,phone:57:74"
    assert by[50].spans == base and by[50].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert (by[50].n_email, by[50].n_ip, by[50].n_card, by[50].n_phone, by[50].n_added) == (1, 1, 1, 1, 0)
    assert by[51].spans == by[52].spans == "" and by[51].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[53].n_card == 1 and by[0].n_added == 1
    assert pii.find_pii(df.limit(0)).count() == 0
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[0] == "write [email] now" and clean[51] is None and "4111" in clean[50]


@pytest.mark.parametrize("text,kind", [("192 dot 168 dot 1 dot 10", "ip"), ("john at example.com", "email"), ("plus 49 170 1234567", "phone"), ("4111 1111 1111 one 111", "card")])
@pytest.mark.parametrize("around", ["", "some more words of a long document, without any trigger\n" * 200])
def test_disguised_without_another_trigger(text, kind, around):
    whole = f"{around}{text}\n{around}"
    assert [(k, whole[i:j]) for k, i, j in pii.added_spans(whole, pii.base_spans(whole))] == [(kind, text)]


def plain_spans(text):
    """The base spans by the patterns as they are written down, kind by kind."""
    out = []
    for kind, pattern in pii.PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(int(p) for p in m[0].split(".")) > 255:
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_equals_the_patterns():
    rng = np.random.default_rng(8)
    pools = ["ab1.@-%+ ", "0123456789. ", "1234 -", "+12 ().-3", "a1.@ +-4é", "@..a"]
    for k in range(6000):
        text = "".join(rng.choice(list(pools[k % len(pools)]), int(rng.integers(0, 60))))
        assert pii.base_spans(text) == plain_spans(text), text
    cards = ["4111 1111 1111 1111", "4111-1111-1111-1111-1", "378282246310005", "6011000990139424", "5555 5555  5555 4444"]
    for k in range(500):
        text = " ".join(rng.choice([*cards, "10.0.0.1", "1.2.3.4.5.6.7.8.9", "0000010.1.1.255", "256.1.1.1", "x@y.z", "+1 (499) 555-6503", "7", "word"], 6))
        assert pii.base_spans(text) == plain_spans(text), text


def test_base_equals_the_patterns_on_documents(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    found = [pii.base_spans(t or "") for t in texts]
    assert found == [plain_spans(t or "") for t in texts] and sum(map(len, found)) > 50


@pytest.mark.parametrize("text", [" " * 10**6, "7" * 10**6, "." * 10**6, "a" * 10**6, "a" * 500_000 + " @ " + "b" * 500_000, "1." * 500_000, "a@" * 300_000, "one " * 200_000, "at dot " * 100_000, "(" * 10**6, "( " * 300_000, "_" * 10**6, "1 " * 400_000, "+1" * 300_000, "é" * 10**6, "one-" * 200_000 + "x", "a.b " * 200_000, "@ dot " * 100_000, "а" * 500_000 + "." * 500_000], ids=lambda t: t[:8])
def test_long_runs_take_no_time(text):
    began = time.time()
    pii.added_spans(text, pii.base_spans(text))
    assert time.time() - began < 6


def test_a_long_number_is_no_address(spark):
    df = spark.createDataFrame([(1, "5" * 5000 + ".1.1.1"), (2, "0" * 5000 + "1.1.1.1 and 10.0.0.7")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert got[1].n_ip == 0 and got[2].n_ip == 2
    assert {r.doc_id: r.text for r in pii.redact(df).collect()}[2] == "[ip] and [ip]"


def test_planted_disguises_are_found_and_clean_text_is_left_alone(spark):
    rng = np.random.default_rng(12)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(400).collect()]
    digit = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    spell = lambda s: " ".join(digit[int(c)] if c.isdigit() else {"+": "plus", ".": "dot"}[c] for c in s)
    found = wrong = 0
    for k, t in enumerate(texts):
        words = (t or "").split(" ")[:200]
        clean = " ".join(words)
        wrong += bool(pii.added_spans(clean, pii.base_spans(clean)))
        kind, hidden = [("email", "kim.lee (at) mail (dot) example (dot) org"), ("email", "kim at post dot example dot com"), ("ip", spell("192.168.4.31")), ("phone", spell("+4915112345678")), ("card", "４１１１ 1111 1111 1111"), ("email", "kіm@example.оrg")][k % 6]
        at = int(rng.integers(0, len(words) + 1))
        whole = " ".join([*words[:at], "|", hidden, "|", *words[at:]])
        found += (kind, whole.index(hidden), whole.index(hidden) + len(hidden)) in pii.added_spans(whole, pii.base_spans(whole))
    assert found == len(texts) and wrong <= 2
