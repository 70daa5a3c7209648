import hashlib
import random
import re

from pyspark.sql import functions as F

from rxlake.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def base(t):
    t = t or ""
    n = lambda m: re.sub("[^0-9]", "", m)
    return [("email", m) for m in EMAIL.finditer(t)] + \
        [("ip", m) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))] + \
        [("card", m) for m in CARD.finditer(t) if 13 <= len(n(m[0])) <= 19 and luhn(n(m[0]))] + \
        [("phone", m) for m in PHONE.finditer(t) if 9 <= len(n(m[0])) <= 15]


def listed(t):
    return [f"{k}:{m.start()}:{m.end()}" for k, m in base(t)]


def texts():
    rnd = random.Random(3)
    parts = ["a", ".", "@", "b.c", "x@y.z", "1.2.3.4", "300.1.1.1", "0001.2.3.255.7", "+", "+49 (0) 171 555-1234 ", "4111 1111-1111 1111",
             "4111111111111112", " ", "é", "𝒳", "-", "_", "%", "1", "23", "\n", "+1 22", "a@b.c_d@e.f", "9" * 25, "(", ")"]
    out = ["".join(rnd.choice(parts) for _ in range(rnd.choice([3, 10, 40, 400]))) for _ in range(250)]
    out += ["a" * 100_000 + "@x.y", "1" * 50_000, "1 " * 50_000, "1.1." * 30_000, "a@b.c " * 5_000, "+1" * 20_000, None, "", "   "]
    return list(enumerate(out))


def test_base_equals_brute_force(spark):
    docs = texts()
    docs += docs[:3] + [(None, "q@r.s")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, spans string, rid int")
    got = sorted((r.doc_id or -1, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in P.report(df).collect())
    want = []
    for i, t in docs:
        b = [k for k, _ in base(t)]
        want.append((i or -1, *(b.count(k) for k in P.KINDS), hashlib.sha256(",".join(listed(t)).encode()).hexdigest()))
    assert got == sorted(want)


def bootstrapped():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    docs = []
    for i in range(40):
        docs.append((i, f"{prose(20)} please call +49 (30) 555-{1000 + i} {prose(9)} of the +49 (30) 666-{1000 + i} {prose(3)}"))
    for i in range(40, 200):
        docs.append((i, f"{prose(9)} of the {word()} {prose(9)}"))
    docs.append((900, "now please call 555 010 7788 soon"))        # no base match: found by its context
    docs.append((901, "it cost of the 555 010 9999 to mend"))      # a common word pair is no pattern
    docs.append((902, "later 555 010 7788 again there"))           # the same instance elsewhere
    docs.append((903, "never please call the office"))
    return docs


def test_patterns_find_unseen(spark):
    docs = bootstrapped()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.spans for r in P.report(df).collect()}
    text = dict(docs)
    at = lambda i: f"phone:{text[i].index('555')}:{text[i].index('555') + 12}"
    assert got[900] == at(900) and got[901] == "" and got[903] == ""
    assert all(got[i] == ",".join(listed(text[i])) for i in range(200))


def test_patterns_whatever_the_corpus(spark):
    """A context of twelve seeds stays a pattern when unrelated documents bring thousands of seeds."""
    docs = [(i, f"please call +49 (30) 555-{1000 + i}") for i in range(12)] + [(900, "now please call 555 010 7788 soon")]
    more = [(1000 + i, f"w{i} v{i} +49 (40) {1000000 + i}") for i in range(15_000)]
    for rows in (docs, docs + more):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert P.report(df).where("doc_id = 900").first().spans == "phone:16:28"


def test_redact(spark):
    docs = texts()[:120] + [(500, None), (500, None), (501, "a 4111 1111 1111 1111 b x@1.2.3.4 +1 234 567 8901")]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, row int")
    out = P.redact(df)
    assert out.columns == df.columns and out.count() == len(docs)
    for r in out.collect():
        if r.doc_id == 501:
            assert r.text == "a [CARD] b [EMAIL] [PHONE]"
        assert r.text is None or not base(r.text), (r.doc_id, r.text)
    clean = {i for i, t in docs if not base(t)}
    assert {(r.doc_id, r.text) for r in out.collect() if r.doc_id in clean} == {d for d in docs if d[0] in clean}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert P.report(df).count() == 0 and P.redact(df).count() == 0
