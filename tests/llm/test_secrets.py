import hashlib
import random
import re
import string

from riskflow.llm import secrets as s
from tests.llm.helpers import SCHEMA, frame, rows

RNG = random.Random(3)
KEY = "".join(RNG.choice(string.ascii_letters + string.digits) for _ in range(40))
CASES = ['x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y', "PassWord: hunter22 and secret=short", "AKIA1234567890ABCD AKIA12", "deadbeef" * 4 + " " + "deadbeef",
         "api_key=api_key=abcdefgh", "toKen = abcdefghij", "ünïcode 🙂 passwd='abc.def-ghi'", "token = token = abcdefgh1", "password=" + "a" * 70000,
         f"authorization header bearer {KEY} end", f"just a name {KEY} end", "credential thonernatandlyounhthetionor and more prose"]


def brute(t):
    found = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or ""):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 32]
    return sorted(found)


def test_base_spans_match_brute_force(spark):
    data = rows() + [(100 + i, t, "en", "s", 1) + rows()[0][5:] for i, t in enumerate(CASES)]
    texts = {}
    for r in data:
        texts.setdefault(r[0], []).append(r[1])
    out = s.find(frame(spark, data)).collect()
    assert len(out) == len(data)
    for r in out:
        if len(set(texts[r["id"]])) > 1:
            continue
        want = brute(texts[r["id"]][0])
        text = ",".join(f"{s.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(1 for w in want if w[1] == k) for k in range(3)]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(r["spans"].split(","))


def test_novel_strings_need_context_and_surprise():
    assert s.joined(s.scan(CASES[9])[1]) == f"novel:{CASES[9].index(KEY)}:{CASES[9].index(KEY) + 40}"
    assert s.scan(CASES[10])[1] == [] and s.scan(CASES[11])[1] == []
    known = "authorization " + s.IDENTIFIERS.split()[0] + " base64 access_key_connection_string_1 x"
    assert s.scan(known)[1] == []                                    # explained by the dictionary
    around = f"{KEY} is the build number. authorization {KEY}"
    assert s.scan(around)[1] == []                                   # explained by the surroundings


def test_mask_takes_effect(spark):
    data = rows() + [(100 + i, t, "en", "s", len(t)) + rows()[0][5:] for i, t in enumerate(CASES)]
    docs = frame(spark, data)
    out = s.mask(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    got = out.collect()
    assert len(got) == len(data)
    for r in got:
        assert s.scan(r["text"])[0] == []
        assert r["text"] is None or r["n_chars"] == len(r["text"]) or r["doc_id"] is None
    clean = {r[0]: r[1] for r in rows()}
    assert all(r["text"] == clean[r["doc_id"]] for r in got if r["doc_id"] is not None and r["doc_id"] < 100)
    assert s.masked("a token=abcdefgh1 b AKIA1234567890ABCD") == "a [SECRET] b [SECRET]"


def test_empty_table(spark):
    assert s.find(spark.createDataFrame([], SCHEMA)).collect() == []


def test_novel_strings_anywhere_in_the_block():
    rng = random.Random(11)
    def of(chars, n):
        return "".join(rng.choice(chars) for _ in range(n))
    base64 = string.ascii_letters + string.digits + "+/"
    body = [of(base64, 64) for _ in range(6)]
    pem = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n" + "\n".join(body) + "\n-----END RSA PRIVATE KEY-----\n"
    mixed, digits, letters, marks = of(base64, 24), of(string.digits, 20), of(string.ascii_letters, 24), "P@ss!w0rd#42%zQ"
    far = " ".join(["the list of all items and their names"] * 40)
    cases = [("see below\n" + pem + "\nthe end", body), (f"credential:\n    {mixed}\nname: x", [mixed]), (f'{{"credential":\n "{mixed}"}}', [mixed]),
             (f"credential {far} {mixed}", [mixed]), (f"{mixed} is the credential", [mixed]), (f"| {digits} | credential |", [digits]),
             (f"credential {letters}", [letters]), (f"credential {marks} of the user", [marks]), (f"credential Tr0ub4dor&3 x", ["Tr0ub4dor&3"]),
             (f'{{"a":1,"credential":"{mixed}","b":[2,3]}}', [mixed]), (f"password=abcdefgh!{marks}", [marks]), ("credential=" + marks, [marks])]
    for text, secrets in cases:
        for secret in secrets:
            assert secret not in s.masked(text), (text, secret)
    plain = "The token of the server is described in the documentation, and understanding every credential takes regular reading."
    assert s.scan(plain)[1] == []
    assert s.scan(f"credential of nobody\n\n{mixed} in another block")[1] == []
    many = "credential " + " ".join(of(base64, 20) for _ in range(2000))
    assert len(s.scan(many)[1]) > 1900                               # other secrets around explain the letters of a few
