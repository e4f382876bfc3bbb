import hashlib
import random
import re

from riskflow.llm import pii
from tests.llm.helpers import SCHEMA, frame, rows

PATTERNS = (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"))
CASES = ["a@b.c.d@e.f", "a@b@c.d and @x.y or x@.y", "1.2.3.4.5.6.7.8 and 1.2.3.256 and 1..2.3.4.5", "4111 1111 1111 1111, 4111-1111-1111-1112",
         "7536784127813050 4845168114407329 é", "+1 (017) 555-7713 rest +12 +1234567890- +1234567890123456", "@" * 3000, "1" * 9000, "1 " * 5000,
         "1." * 5000, "+1" * 3000, "a@" * 3000, "a@b.c" * 3000, "🙂 äx@host.example é 10.0.0.1", "x" * 70000 + "@host.example.org"]


def brute(t):
    found = []
    for k, p in enumerate(PATTERNS):
        for m in p.finditer(t or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(len(x.lstrip("0")) > 3 or int(x.lstrip("0") or 0) > 255 for x in m[0].split(".")):
                continue
            if k == 2 and not (14 <= len(digits) <= 19 and sum(
                    sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(digits[::-1])) % 10 == 0):
                continue
            if k == 3 and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), k, m.end()))
    return sorted(found)


def test_base_spans_match_brute_force(spark):
    data = rows() + [(100 + i, t, "en", "s", 1) + rows()[0][5:] for i, t in enumerate(CASES)]
    texts = {}
    for r in data:
        texts.setdefault(r[0], set()).add(r[1])
    out = pii.find(frame(spark, data)).collect()
    assert len(out) == len(data)
    for r in out:
        if len(texts[r["id"]]) > 1:
            continue
        want = brute(next(iter(texts[r["id"]])))
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(w[1] == k for w in want) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(r["spans"].split(","))


def test_random_texts_match_brute_force():
    rng = random.Random(5)
    for alphabet, n in (("1 -.+@aé", 40_000), ("0123456789 -", 20_000), ("12.5+() -", 20_000), ("a1.@-%_ß", 20_000), ("f0:1 @", 5_000)):
        for _ in range(n // 20):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60)))
            base, every = pii.scan(t)
            assert base == brute(t), t
            assert set(base) <= set(every) and every == sorted(every)


def test_added_kinds():
    def added(t):
        base, every = pii.scan(t)
        return [(pii.KINDS[k], t[s:e]) for s, k, e in every if (s, k, e) not in set(base)]
    assert added("mail jürgen.groß@host.example now") == [("mailbox", "jürgen.groß@host.example")]
    assert added('to "a!b"@host.example.') == [("mailbox", '"a!b"@host.example')]
    assert added("ann.lee [at] host [dot] org, or bob(at)host.example") == [("mailbox", "ann.lee [at] host [dot] org"), ("mailbox", "bob(at)host.example")]
    assert added("from 2001:db8:0:0:8a2e::7334 and 00:1b:44:11:3a:b7 at 12:30:45 std::map") == [
        ("address", "2001:db8:0:0:8a2e::7334"), ("address", "00:1b:44:11:3a:b7")]
    assert added("pay DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432, not DE88370400440532013000") == [
        ("account", "DE89 3704 0044 0532 0130 00"), ("account", "GB82WEST12345698765432")]
    assert added("ssn 219-09-9999; 000-12-3456") == [("account", "219-09-9999")]
    assert added("Account number: 12345678 of the account 12") == [("account", "12345678")]
    assert added("tel. 030 1234567, hotel 5551234567") == [("contact", "030 1234567")]
    assert added("at https://ann@host.example/x and https://host.example/a@b") == [("link", "https://ann@host.example")]
    assert added("4111111111111111 4012888888881881") == [("account", "4111111111111111"), ("account", "4012888888881881")]
    for clean in ("The count of all accounts in 2024 was 12 of 300.", "call a::b, at 10:20, see v1.2.3 and a@b", "1999-2000 and 12-34"):
        assert pii.scan(clean) == ([], [])


def test_work_is_linear():
    import time
    for piece in ("@", "1", "+1", "a@", "1.", "1 ", "::", ":a", "://", "tel ", "AB12 "):
        t0 = time.perf_counter()
        pii.scan(piece * 200_000)
        assert time.perf_counter() - t0 < 20, piece


def test_empty_table(spark):
    assert pii.find(spark.createDataFrame([], SCHEMA)).collect() == []
