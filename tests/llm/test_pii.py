import random
import re

from ridgeline.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    def digits(s):
        return [int(c) for c in s if c.isdigit()]

    def luhn(d):
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0

    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15],
    }


def test_plain_equals_brute_force():
    rnd = random.Random(2)
    for alphabet in ("a1.@- +", "0123 -", "129.", "+1(2) .-a", "ab@.é "):
        for _ in range(3000):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
            assert pii.plain(text) == brute(text), text
    for text in ("4111 1111 1111 1111", "x@y.z@w.v", "1.2.3.4.5.6.7.8", "+1 (988) 555-2485 or 4943-3394-9042-9605", "a" * 200_000, "1" * 200_000, "a@" * 50_000, "+1" * 50_000):
        assert pii.plain(text) == (brute(text) if len(text) < 1000 else {k: [] for k in pii.KINDS}), text[:50]


def extra(text):
    base, every = pii.find(text)
    assert all(set(base[k]) <= set(every[k]) for k in pii.KINDS)
    return {k: [text[a:b] for a, b in every[k] if (a, b) not in base[k]] for k in pii.KINDS if len(every[k]) > len(base[k])}


def test_disguises():
    assert extra("write to jo.smith [at] mail [dot] example [dot] com today") == {"email": ["jo.smith [at] mail [dot] example [dot] com"]}
    assert extra("write to jo.smith at example dot com today") == {"email": ["jo.smith at example dot com"]}
    assert extra("mail jo (at) example.org now") == {"email": ["jo (at) example.org"]}
    assert extra("jо@exаmple.com") == {"email": ["jо@exаmple.com"]}
    assert extra("ｊｏ＠mail．com") == {"email": ["ｊｏ＠mail．com"]}
    assert extra("call plus one nine eight eight five five five two four eight five now") == {"phone": ["plus one nine eight eight five five five two four eight five"]}
    assert extra("card four one one one 1111 1111 one one one one ok") == {"card": ["four one one one 1111 1111 one one one one"]}
    assert extra("at one nine two dot one six eight dot one dot seven yes") == {"ip": ["one nine two dot one six eight dot one dot seven"]}
    assert extra("ip ١٢.1.2.٣ here") == {"ip": ["١٢.1.2.٣"]}
    assert extra("jo​@mail.c​om") .get("email")


def test_prose_is_left_alone():
    for text in ("That at the reor, one two three were at home. Les deux un une", "at one dot", "", "meet me at noon dot", "un deux trois quatre"):
        assert extra(text) == {}
    assert pii.find(None) == pii.find("")


def test_redact():
    text = "mail a@b.cd or +1 (988) 555-2485, 4111111111111111."
    spans = pii.find(text)[1]
    assert pii.redact(text, spans) == "mail [EMAIL] or [PHONE], [CARD]."
    assert pii.redact(None, {}) is None and pii.redact("", {}) == ""


def test_rows(spark):
    df = spark.createDataFrame([(1, "a@b.cd", "s"), (1, "a@b.cd", "s"), (2, None, None), (None, "", "t")], "doc_id long, text string, spans string")
    got = sorted(map(tuple, pii.detect(df, "doc_id", "text").collect()), key=str)
    assert got == sorted([(1, 1, 0, 0, 0, "email:0:6", "email:0:6")] * 2 + [(2, 0, 0, 0, 0, "", ""), (None, 0, 0, 0, 0, "", "")], key=str)
    out = pii.redacted(df, "text").collect()
    assert out[0].text == "[EMAIL]" and out[0].spans == "s" and len(out) == 4
    assert pii.detect(df.limit(0), "doc_id", "text").count() == 0


def test_query_equals_brute_force(spark):
    import hashlib

    from ridgeline.llm.queries import op8_pii

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op8_pii(spark, sf).collect():
        want = brute(texts[r.doc_id])
        line = pii.listed(want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(want[k]) for k in pii.KINDS)
        assert r.spans == line  # nothing in this table is disguised


def test_disguises_without_other_hints():
    assert extra("call +49 1 seven 0 five 5 eight 2 one 9") == {"phone": ["+49 1 seven 0 five 5 eight 2 one 9"]}
    assert extra("plus 49 170 1234567") == extra("x\nplus 49 170 1234567\n") == {"phone": ["plus 49 170 1234567"]}
    assert extra("call plus 49 one 70 12 three 4567 now") == {"phone": ["plus 49 one 70 12 three 4567"]}
    assert extra("host 192 dot 168 dot 1 dot 10 is up") == {"ip": ["192 dot 168 dot 1 dot 10"]}
    assert extra("host 192 dot one six 8 dot 1.10") == {"ip": ["192 dot one six 8 dot 1.10"]}
    assert extra("ip ๑๒.1.2.๓ or ১২.1.2.৩") == {"ip": ["๑๒.1.2.๓", "১২.1.2.৩"]}
    assert extra("ip ①.1.2.⓪ here") == {"ip": ["①.1.2.⓪"]}
    assert extra("card 4111 1111 one 111 1111 1111") == {} and extra("card 4111 1111 1111 111 one") == {"card": ["4111 1111 1111 111 one"]}
    assert extra("300 dot 168 dot 1 dot 10, chapter 2 dot 3, five plus 4") == {}


def test_half_disguised_addresses_are_found_whole():
    for text, want in (
        ("write jo@example dot com now", "jo@example dot com"),
        ("jo dot smith@example.com", "jo dot smith@example.com"),
        ("mail: jo at example.com", "jo at example.com"),
        ("ask jo.smith at example.com", "jo.smith at example.com"),
        ("jo\u2024smith@ex.com", "jo\u2024smith@ex.com"),
        ("jo\ufe6bexample.com", "jo\ufe6bexample.com"),
        ("JO@Example DOT co DOT uk", "JO@Example DOT co DOT uk"),
    ):
        spans = pii.find(text)[1]["email"]
        assert any(text[a:b] == want for a, b in spans), text
    for text in ("look at example.com today", "we met at noon. dot dot dot", "the polka dot dress @ home"):
        assert not pii.find(text)[1]["email"], text


def test_digits_of_other_scripts():
    for text in ("ip \u09e7\u09e8.1.2.\u09e9 x", "ip \u0e51\u0e52.1.2.\u0e53 x", "plus 1 988 555 2485"):
        base, every = pii.find(text)
        assert not any(base.values()) and sum(map(len, every.values())) == 1, text


def test_joints_tabs_and_spaced_signs():
    """Each disguise is one span of the whole; prose and code of the same shape have none."""
    for s in ("jo @ example . com", "jo -at- example -dot- com", "jo_at_example_dot_com", "jo-at-example-dot-com", "jo*at*ex.com", "jo_at_example.com", "jo\tat\texample dot com", "jo at\nexample dot com", "jo@example . org"):
        base, every = pii.find(f"so {s} it is")
        assert ("so " + s + " it is")[slice(*every["email"][-1])] == s, s
    for s in ("mail me: jo at example.com", "write an e-mail to us: jo at example.com", "contact is jo at example.com"):
        assert [s[a:b] for a, b in pii.find(s)[1]["email"]] == ["jo at example.com"], s
    for s in ("value_at_index_dot_product", "look at example.com", "score @ home . We went", "state-of-the-art-at-home", "see a_at_b.py", "mail was sent to all at example.com yesterday", "5 @ 3 . 2", "I was at home. dot com"):
        assert pii.find(s)[1]["email"] == [], s
