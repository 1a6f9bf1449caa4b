"""Personal data against Python's matcher and plain checksum code."""

import random
import re
import time

from marlstone.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PARTS = ["a.b@c.de", "@", ".", "x%", "-", "+1 (555) 123-4567", "4111 1111 1111 1111", "4111111111111112", "10.0.0.1", "1.2.3.4.5", "256.1.1.1", "0001.2.3.004", " ", "5", "é", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "ssn 123-45-6789", "123-45-6789", "\n", "\U0001f600"]


def digits(x):
    return re.sub("[^0-9]", "", x)


def luhn(x):
    total = 0
    for i, d in enumerate(reversed(digits(x))):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def good(kind, x):
    n = len(digits(x))
    return {"email": True, "ip": all(int(p) <= 255 for p in x.split(".")) if kind == "ip" else True, "card": 12 <= n <= 19 and luhn(x), "phone": 9 <= n <= 15}[kind]


def brute(text):
    return sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if good(k, m[0]))


def test_base_spans(spark):
    rng = random.Random(11)
    texts = [None, "", "1" * 100_000, "a" * 100_000 + "@", "a." * 50_000, "+1" + " 2" * 20_000, "1." * 30_000, "x@y." * 20_000]
    texts += ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    docs = spark.createDataFrame([(t, "pii") for t in texts], "text string, kind string").repartition(8)
    for r in pii.find_pii(docs).collect():
        got = [(s.start, list(BASE).index(s.kind), s.stop, s.kind) for s in r.pii if s.kind in BASE]
        assert got == brute(r.text), (r.text or "")[:200]
        assert all(s.value == r.text[s.start : s.stop] and 0 <= s.score <= 1 for s in r.pii)


def test_checksums_and_context(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00", "DE88370400440532013000", "my ssn is 123-45-6789", "part 123-45-6789"]
    rows = pii.find_pii(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    kinds = {r.text: [s.kind for s in r.pii] for r in rows}
    assert "iban" in kinds[texts[0]] and "iban" not in kinds[texts[1]] and "ssn" in kinds[texts[2]] and "ssn" not in kinds[texts[3]]
    assert pii.find_pii(spark.createDataFrame([], "text string")).count() == 0


def test_very_many_spans(spark):
    """A hundred thousand spans of each of two kinds in one text: seconds, and exact."""
    text = "".join(f"email a{i}@b.cd or +1 555 {1000000 + i}; " for i in range(100_000))
    began = time.time()
    r = pii.find_pii(spark.createDataFrame([(text,)], "text string")).select("pii").first()
    assert time.time() - began < 60
    got = [(s.start, list(BASE).index(s.kind), s.stop, s.kind) for s in r.pii if s.kind in BASE]
    assert got == brute(text) and len(got) == 200_000
    assert all(s.score == 1.0 for s in r.pii if s.kind == "email")


def test_context_near_the_edges(spark):
    """Words count within 40 code points, however short the gaps between spans are."""
    texts = ["call +1 555 1234567", "call" + " " * 36 + "+1 555 1234567", "call" + " " * 37 + "+1 555 1234567", "+1 555 1234567" + " " * 36 + "call", "+1 555 1234567" + " " * 37 + "call", "é" * 500 + " fax a@b.cd a@b.cd +1 555 1234567", "\U0001f600" * 255 + "a@b.cd,+1 555 1234567,+1 555 1234567"]
    for r in pii.find_pii(spark.createDataFrame([(t,) for t in texts], "text string")).collect():
        for s in r.pii:
            near = r.text[max(s.start - 40, 0) : s.stop + 40].lower()
            assert s.score == round(pii.PRIOR[s.kind] + (0.2 if re.search(pii.CONTEXT[s.kind], near) else 0), 2)


def test_clashing_names_and_nulls(spark):
    docs = spark.createDataFrame([(None, "a@b.cd", "x", 1, "p"), (None, "a@b.cd", "x", 1, "p"), (1, None, None, None, None)], "doc_id long, text string, _body string, _email int, _EMAIL1 string")
    out = pii.find_pii(docs)
    assert out.columns == [*docs.columns, "pii"]
    assert sorted((r._email or 0, len(r.pii), r._body or "") for r in out.collect()) == [(0, 0, ""), (1, 1, "x"), (1, 1, "x")]
