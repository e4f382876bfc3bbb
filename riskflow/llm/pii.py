"""Personal data by anchor expansion: Aho-Corasick finds cheap anchors, local parsers expand and validate the boundaries.

One automaton holds every anchor: at-signs (plain and written out), `://`, digit pairs (with a space, hyphen or dot between),
`+` and a digit, a colon and a hex digit, and words that announce an identifier (account, IBAN, phone, ...). A text is read once;
at each anchor a parser that looks only at the neighbourhood grows the span to both sides, stops at the first character that
cannot belong to it, and checks the value (labels of a host, parts of an address, Luhn, mod 97). A parsed region is not parsed
again, so the work is linear in the text.

Base kinds, equal to leftmost non-overlapping matches of their patterns with failing matches dropped: `email`, `ip`, `card`,
`phone`. Added kinds: `mailbox` (a mail address beyond the base alphabet: letters outside ASCII, a quoted name, a host in
brackets, or written out as name [at] host [dot] org), `address` (IPv6 and hardware addresses), `account` (IBAN by mod 97, social
security numbers, card numbers inside longer digit chains, numbers behind an announcing word), `contact` (a phone number without
`+` behind an announcing word), `link` (a URL that carries a user name). An added span inside a base span is not reported.

Whole texts are parsed by a task function over Arrow batches; a row needs no other row, so there is no shuffle.

Defined results: null text is empty and has no span; positions are code points, end exclusive; repeated rows get a row each;
only the two named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from riskflow.llm.common import table

KINDS = ("email", "ip", "card", "phone", "mailbox", "address", "account", "contact", "link")
EMAIL, IP, CARD, PHONE, MAILBOX, ADDRESS, ACCOUNT, CONTACT, LINK = range(len(KINDS))
DIGITS, HEX = "0123456789", "0123456789abcdefABCDEF"
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"

# Pieces of the base patterns, applied at an anchor only.
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUADS = re.compile(r"[0-9]+(?:\.[0-9]+)+")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIAL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (14, 19), (10, 15)

# Pieces of the added kinds.
WIDE_HOST = re.compile(r"\w(?:[\w-]*\w)?(?:\.\w(?:[\w-]*\w)?)*\.[^\W\d_]{2,}(?![\w-])|\[[0-9A-Fa-f:.]{3,45}\]")
WIDE_LOCAL = re.compile(r"[\w%+-]+(?:\.[\w%+-]+)*\Z")
QUOTED = re.compile(r'"[^"\s]{1,64}"\Z')
SPELT_HOST = re.compile(r"\s?[\w-]+(?:\s?(?:\.|[\[({]dot[\])}])\s?[\w-]+)*\s?(?:\.|[\[({]dot[\])}])\s?[^\W\d_]{2,}\b", re.IGNORECASE)
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
USERINFO = re.compile(r"[^\s/?#@\"'<>]+@[^\s/?#@\"'<>]+")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SOCIAL = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}")
ANNOUNCED = re.compile(r"(?:\x20(?:number|num|no|nr|id|code))?\.?\x20?[:=#]?\x20{0,2}([A-Z]{0,3}[0-9](?:[\x20-]?[0-9]){5,16})(?![A-Za-z0-9])", re.IGNORECASE)
DIALLED = re.compile(r"(?:\x20(?:number|no|nr))?\.?\x20?[:=]?\x20{0,2}(\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,14})(?![A-Za-z0-9])", re.IGNORECASE)
GROUPS = re.compile(r"[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}(?![0-9])|[0-9]+")
CARD_PART = (13, 19)                 # digits of a card number inside a longer chain
NEAR = 64                            # farthest that a mailbox name, scheme or colon group reaches to the left

ACCOUNT_CUES = ("account", "acct", "iban", "konto", "kontonummer", "cuenta", "compte", "passport", "ssn", "social security", "routing", "tax id")
CONTACT_CUES = ("phone", "telephone", "mobile", "tel", "fax", "telefon", "teléfono", "téléphone")
SPELT_AT = ("[at]", "(at)", "{at}")


@lru_cache(maxsize=1)
def anchors():
    """The automaton: every anchor with its class and length."""
    import ahocorasick
    found: dict[str, str] = {"@": "at", "://": "scheme", "::": "colon"}
    for a in DIGITS:
        found["+" + a] = "plus"
        for b in DIGITS:
            found[a + b] = found[f"{a} {b}"] = found[f"{a}-{b}"] = "pair"
            found[f"{a}.{b}"] = "dot"
    found.update({":" + h: "colon" for h in HEX})
    for kind, cues in (("account", ACCOUNT_CUES), ("contact", CONTACT_CUES), ("spelt", SPELT_AT)):
        for cue in cues:
            found.update({form: kind for form in (cue, cue.upper(), cue.capitalize())})
    automaton = ahocorasick.Automaton()
    for anchor, kind in found.items():
        automaton.add_word(anchor, (kind, len(anchor)))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def mod97(value: str) -> bool:
    rest = 0
    for c in value[4:] + value[:4]:
        rest = (rest * (10 if c in DIGITS else 100) + int(c, 36)) % 97
    return rest == 1


def only_digits(part: str) -> str:
    return "".join(c for c in part if c in DIGITS)


def left_run(text: str, end: int, least: int, allowed: str) -> int:
    """Start of the run of allowed characters that ends before `end`, not before `least`."""
    return least + len(text[least:end].rstrip(allowed))


def inside_word(text: str, i: int) -> bool:
    return 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")


class Scan:
    """The spans of one text; `done` holds, per class of anchor, where its last parsed region ends."""

    def __init__(self, text: str):
        self.text, self.base, self.more = text, [], []
        self.done = dict.fromkeys(("at", "card", "ip", "phone", "colon", "iban", "social"), 0)
        parsers = {"at": self.at_sign, "spelt": self.spelt_at, "scheme": self.scheme, "pair": self.pair, "dot": self.quad,
                   "plus": self.plus, "colon": self.colons, "account": self.account, "contact": self.contact}
        for end, (kind, size) in anchors().iter(text):
            parsers[kind](end + 1 - size, end + 1)

    # ------------------------------------------------------------ mail

    def at_sign(self, i: int, end: int) -> None:
        text, least = self.text, self.done["at"]
        start = left_run(text, i, least, LOCAL)
        host = HOST.match(text, end)
        self.done["at"] = end
        if start < i and host:
            self.base.append((start, EMAIL, host.end()))
            self.done["at"] = host.end()
        near = text[max(least, i - NEAR):i]
        name = QUOTED.search(near) or WIDE_LOCAL.search(near)
        wide = WIDE_HOST.match(text, end)
        if name and wide:
            span = (i - len(name[0]), MAILBOX, wide.end())
            if not (start < i and host and start <= span[0] and span[2] <= host.end()):
                self.more.append(span)

    def spelt_at(self, i: int, end: int) -> None:
        near = self.text[max(0, i - NEAR):i]
        if near[-1:] == " ":
            near = near[:-1]
        name, host = WIDE_LOCAL.search(near), SPELT_HOST.match(self.text, end)
        if name and host:
            self.more.append((max(0, i - NEAR) + name.start(), MAILBOX, host.end()))

    def scheme(self, i: int, end: int) -> None:
        name, user = SCHEME.search(self.text[max(0, i - 16):i]), USERINFO.match(self.text, end)
        if name and user:
            self.more.append((i - len(name[0]), LINK, user.end()))

    # ------------------------------------------------------------ digits

    def pair(self, i: int, end: int) -> None:
        text = self.text
        if i >= self.done["card"]:
            chain = CHAIN.match(text, i)
            self.done["card"] = chain.end()
            digits = only_digits(chain[0])
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                self.base.append((i, CARD, chain.end()))
            elif len(digits) > CARD_DIGITS[1]:
                self.cards_within(i, chain[0])
            if len(chain[0]) == 11 and SOCIAL.fullmatch(chain[0]) and not inside_word(text, i - 1) and not inside_word(text, chain.end()):
                self.more.append((i, ACCOUNT, chain.end()))
        if end - i == 2 and i >= 2 and i - 2 >= self.done["iban"] and text[i - 1].isupper() and not inside_word(text, i - 3):
            iban = IBAN.match(text, i - 2)
            if iban and mod97(iban[0].replace(" ", "")):
                self.more.append((i - 2, ACCOUNT, iban.end()))
                self.done["iban"] = iban.end()

    def cards_within(self, at: int, chain: str) -> None:
        """Card numbers in a chain too long for one: a run of digits between separators, or four groups of four."""
        for m in GROUPS.finditer(chain):
            digits = only_digits(m[0])
            if CARD_PART[0] <= len(digits) <= CARD_PART[1] and luhn(digits):
                self.more.append((at + m.start(), ACCOUNT, at + m.end()))

    def quad(self, i: int, end: int) -> None:
        if i < self.done["ip"]:
            return
        start = left_run(self.text, i + 1, self.done["ip"], DIGITS)
        chain = QUADS.match(self.text, start)
        self.done["ip"] = chain.end()
        parts, at = chain[0].split("."), start
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                self.base.append((at, IP, at + size))
            at += size + 1

    def plus(self, i: int, end: int) -> None:
        dial = DIAL.match(self.text, i)
        if dial and PHONE_DIGITS[0] <= len(only_digits(dial[0])) <= PHONE_DIGITS[1]:
            self.base.append((i, PHONE, dial.end()))

    # ------------------------------------------------------------ addresses and announced identifiers

    def colons(self, i: int, end: int) -> None:
        text = self.text
        if i < self.done["colon"]:
            return
        start = left_run(text, i, max(self.done["colon"], i - NEAR), HEX + ":")
        stop = end + NEAR
        stop = end + len(text[end:stop]) - len(text[end:stop].lstrip(HEX + ":."))
        self.done["colon"] = end
        value = text[start:stop].rstrip(".")
        if value.endswith(":") and not value.endswith("::"):
            value = value[:-1]
        stop = start + len(value)
        if inside_word(text, start - 1) or inside_word(text, stop) or value.count(":") < 2:
            return
        groups = value.split(":")
        if len(groups) == 6 and all(len(g) == 2 for g in groups):
            hit = True
        else:
            try:
                ipaddress.IPv6Address(value)
            except ValueError:
                return
            hit = sum(len(g) >= 3 for g in groups) >= 2
        if hit:
            self.more.append((start, ADDRESS, stop))
            self.done["colon"] = stop

    def announced(self, i: int, end: int, pattern: re.Pattern, least: int, kind: int) -> None:
        if inside_word(self.text, i - 1):
            return
        value = pattern.match(self.text, end)
        if value and len(only_digits(value[1])) >= least:
            self.more.append((value.start(1), kind, value.end(1)))

    def account(self, i: int, end: int) -> None:
        self.announced(i, end, ANNOUNCED, 6, ACCOUNT)

    def contact(self, i: int, end: int) -> None:
        self.announced(i, end, DIALLED, 7, CONTACT)


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) as (start, kind number, end), sorted; an added span inside a base span is left out."""
    if not text:
        return [], []
    found = Scan(text)
    base = sorted(found.base)
    more, k, reach = [], 0, 0
    for span in sorted(set(found.more)):
        while k < len(base) and base[k][0] <= span[0]:
            reach = max(reach, base[k][2])
            k += 1
        if span[2] > reach:
            more.append(span)
    return base, sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


COUNTS = ("n_email", "n_ip", "n_card", "n_phone")


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [scan(t) for t in batch.column(1).to_pylist()]
        n = [[sum(s[1] == k for s in base) for base, _ in rows] for k in range(len(COUNTS))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in n),
             pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], pa.string()),
             pa.array([joined(every) for _, every in rows], pa.string()),
             pa.array([len(every) - len(base) for base, every in rows], pa.int64())],
            names=["id", *COUNTS, "base_sha256", "spans", "n_added"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end), n_added."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in COUNTS),
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
                           T.StructField("n_added", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_report, schema)


def op13_pii_anchors(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
