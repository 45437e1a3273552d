"""Personal data: wide generators, boosted trees, calibrated thresholds.

Base matches (e-mail addresses, IP addresses, payment cards, international
phone numbers) are always kept.  Further generators with high recall propose
overlapping spans; boosted trees score each by its format and context, and
those over a calibrated threshold are added where no base span lies.

The trees are fitted on the driver to a fixed number of labelled spans that
``training_spans`` makes from templates (``SPANS_PER_KIND`` a kind, positive
and negative; no corpus row is used), half of them for the calibration.  The
fitted trees become one column expression, so that every document is scanned,
scored and written by DataFrame operations only.
"""

from __future__ import annotations

import functools
import math
import random
import re

from pyspark.sql import Column, DataFrame, functions as F

from .text import fresh

KINDS = ("email", "ip", "card", "phone")
#: What is found besides, by the generators and trees alone: passwords, tokens and keys.
EVERY_KIND = (*KINDS, "secret")
#: Labelled spans a kind that the trees are fitted and calibrated on.
SPANS_PER_KIND = 1200
#: Added spans have at least this share of true ones among the calibration spans scored as high.
PRECISION = 0.99
#: Code points of context that features look at, on either side.
CONTEXT = 24

# The patterns below match as the plain ones in the comments do, leftmost and
# non-overlapping, in linear time: possessive, and tried only where a run of
# characters begins or the last match ended (\G).
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
# [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# [0-9]([\x20-]?[0-9])+ of 14 to 19 digits: such a match is a whole run
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
# \+[0-9][\x20().0-9-]+[0-9]
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

_OBFUSCATED = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20{0,2}[\[({<]\x20?at\x20?[\])}>]\x20{0,2}|\x20{1,2}at\x20{1,2}|\x20{1,2}@\x20{0,2}|@\x20{1,2}|(?<=[A-Za-z0-9.-])_at_)[A-Za-z0-9-]{1,63}+(?:(?:\x20?[\[({<]\x20?dot\x20?[\])}>]\x20?|\x20{1,2}dot\x20{1,2}|\x20?\.\x20?|_dot_)[A-Za-z0-9-]{2,63}+){1,4}+"
_ADDRESS = r"(?<![0-9A-Za-z_:.])(?:[0-9A-Fa-f]{0,4}:){2,7}+[0-9A-Fa-f]{0,4}+(?![0-9A-Za-z_:])|(?<![0-9A-Za-z.])[0-9]{1,3}(?:\x20?(?:\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\))\x20?[0-9]{1,3}){3}(?![0-9A-Za-z])"
_CARD_WIDE = r"(?<![0-9])[0-9]{4}(?:[./_\x20-]{1,2}[0-9]{4}){3}(?![0-9])|(?<![0-9])[0-9]{4}[./_\x20-]{1,2}[0-9]{6}[./_\x20-]{1,2}[0-9]{5}(?![0-9])"
_PHONE_WIDE = r"(?<![0-9A-Za-z+.,:/-])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,8}\)?){1,5}+(?![0-9A-Za-z]|[.,:/-][0-9])"
_NAMED = r"(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential)"
_SECRET = rf"(?i)(?<![A-Za-z0-9_])(?:[A-Za-z0-9_-]{{0,24}}?{_NAMED}s?[\"']?\x20{{0,2}}(?:=>|:=|=|:|\x20)\x20{{0,2}}[\"']?[A-Za-z0-9+/_.~!@#$%^&*=-]{{8,200}}+[\"']?|(?:AKIA|ASIA|ghp_|gho_|sk-|xox[bap]-)[A-Za-z0-9_-]{{12,200}}+|[0-9a-f]{{32,128}}+(?![A-Za-z0-9]))"
#: What a text must hold for a pattern to match at all: cheaper than the pattern.
_HINTS = {_EMAIL: r"@", _IP: r"[0-9]\.[0-9]", _CARD: r"[0-9](?:[\x20-]?[0-9]){13}", _PHONE: r"\+[0-9]", _OBFUSCATED: r"(?i)@\x20|\x20@|[\[({<\x20_]at[\])}>\x20_]", _ADDRESS: r":[0-9A-Fa-f]{0,4}:|[0-9]\x20?[\[({]", _CARD_WIDE: r"[0-9]{4}[./_\x20-]{1,2}[0-9]{4}", _PHONE_WIDE: r"[0-9]\)?[\x20./-]{1,2}\(?[0-9]", _SECRET: rf"(?i){_NAMED}|AKIA|ASIA|gh[po]_|sk-|xox|[0-9a-f]{{32}}"}
BASE = dict(zip(KINDS, (_EMAIL, _IP, _CARD, _PHONE)))
WIDE = dict(zip(EVERY_KIND, (_OBFUSCATED, _ADDRESS, _CARD_WIDE, _PHONE_WIDE, _SECRET)))

#: Words that speak for or against a kind where they stand near a span.
_FOR = {"email": "mail|write|contact|reach", "ip": "ip|addr|host|server|ping|login", "card": "card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta", "phone": "phone|tel|call|mobile|cell|fax|dial|sms|contact|ruf", "secret": "key|login|secret|token|export|config|credential"}
_AGAINST = "order|invoice|version|isbn|serial|build|part|page|ref|total|table|id|no\\.|nr|section|line|figure|score|date"

#: Format and context features: name, Java and Python regular expression, what it is matched with.
_PATTERNS = [
    ("paren", r"^\(", "m"), ("paren_in", r"[(\[{]", "m"), ("dots", r"[0-9]\.[0-9]", "m"), ("hyphens", r"[0-9]-[0-9]", "m"), ("spaces", r"[0-9]\x20[0-9]", "m"),
    ("slashes", r"[/_]", "m"), ("zero", r"^\(?0", "m"), ("year", r"(?:19|20)[0-9]{2}", "m"), ("bracket_at", r"(?i)[\[({<]\x20?at\x20?[\])}>]|_at_|@", "m"), ("dot_word", r"(?i)[\[({<\x20_]dot[\])}>\x20_]", "m"), ("tight_dot", r"[A-Za-z0-9-]\.[A-Za-z0-9-]+$", "m"),
    ("tld", r"(?i)(?:\.|dot[\])}>\x20_]{1,2})(?:com|org|net|edu|gov|io|info|biz|eu|de|fr|es|it|nl|uk|us|ch|at|be|pl|se|ca|au|br|jp|cn|in|test|example)$", "m"), ("issuer", r"^(?:4|5[1-5]|3[47]|6)", "m"),
    ("double_colon", r"::", "m"), ("one_gap", r"^(?!.*::.*::)(?!:[^:])(?!.*[^:]:$).*::", "m"), ("eight", r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$", "m"), ("hex_letter", r"[A-Fa-f]", "m"), ("fenced_dots", r"[\[({](?:\.|dot)[\])}]", "m"), ("byte_parts", r"^(?:(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:[^0-9]+|$)){4}$", "m"),
    ("pairs", r"^0[0-9](?:[\x20./-][0-9]{2}){4}$", "m"), ("three_four", r"^[0-9]{3}[\x20.-][0-9]{4}$", "m"), ("date", r"^(?:19|20)[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{2}$|^[0-9]{2}[-/.][0-9]{2}[-/.](?:19|20)?[0-9]{2}$", "m"), ("ten", r"^\(?[0-9]{3}\)?[\x20./-]{1,2}[0-9]{3}[\x20./-][0-9]{4}$", "m"), ("long_prefix", r"^(?:00[1-9]|\(?0[1-9][0-9]{1,4}\)?[\x20/-])", "m"),
    ("named", rf"(?i){_NAMED}", "m"), ("assigned", r"[=:]", "m"), ("quoted", r"[\"']", "m"), ("long_hex", r"(?i)(?<![0-9a-z])[0-9a-f]{32,}", "m"), ("prefix", r"AKIA|ASIA|gh[po]_|sk-|xox[bap]-", "m"), ("mixed", r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])", "m"),
    ("value_digit", r"[=:\x20][\"']?[^=:\x20\"']*[0-9][^=:\x20\"']*[\"']?$", "m"), ("value_long", r"[=:\x20][\"']?[^=:\x20\"']{16,}[\"']?$", "m"), ("checksum", r"(?i)(?:md5|sha|sha1|sha256|commit|hash|checksum|rev|etag|id)[^A-Za-z0-9]{0,3}$", "l"),
    ("against", rf"(?i)(?<![a-z])(?:{_AGAINST})", "l"), ("hash_before", r"[#$€£=/]\x20?$", "l"), ("colon_before", r":\x20?$", "l"),
    ("number_before", r"[0-9][\x20,;.]{1,2}$", "l"), ("number_after", r"^[\x20,;.]{1,2}[0-9]", "r"), ("unit_after", r"(?i)^\x20?(?:kg|km|%|eur|usd|\$|€|pm|am|mm)", "r"),
] + [(f"for_{k}", rf"(?i)(?<![a-z])(?:{v})", "l") for k, v in _FOR.items()]
FEATURES = [*(x[0] for x in _PATTERNS), "digits", "length", "luhn"]


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    each = F.split(F.reverse(digits), "")
    values = F.transform(F.filter(each, lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _luhn(digits: str) -> bool:
    return sum(int(x) if i % 2 == 0 else int(x) * 2 - 9 * (int(x) > 4) for i, x in enumerate(reversed(digits))) % 10 == 0


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern counts."""
    if kind == "ip":
        part = lambda x: F.length(F.regexp_replace(x, "^0+", "")) <= 3
        small = lambda x: F.coalesce(F.substring(F.concat(F.lit("0"), F.regexp_replace(x, "^0+", "")), 1, 4).cast("int"), F.lit(0)) <= 255
        return F.forall(F.split(m, r"\."), lambda x: part(x) & small(x))
    if kind == "card":
        return luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _bound(c: Column, f) -> Column:
    """``f(c)``, with ``c`` worked out once however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), 0)


def _scan(a: Column, zero: Column, step, emit, kind: str) -> Column:
    """What ``emit(state, x)`` (an array) gives for each element of ``a``, one after another, with ``state`` from ``step(state, x)``.

    An array that grows by one element a time is copied each time, so that the
    elements go through in runs of about the square root of their number, and
    the runs' results are joined at the end.
    """
    return _bound(a, lambda v: _scanned(v, zero, step, emit, kind))


def _scanned(a: Column, zero: Column, step, emit, kind: str) -> Column:
    none = F.array().cast(f"array<{kind}>")
    run = F.ceil(F.sqrt(F.size(a).cast("double"))).cast("int")
    runs = _bound(run, lambda n: F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / n).cast("int") - 1), lambda i: F.slice(a, i * n + 1, n)))
    begin = lambda state: F.struct(state.alias("state"), none.alias("out"))
    one = lambda b, x: F.struct(step(b["state"], x).alias("state"), F.concat(b["out"], emit(b["state"], x)).alias("out"))
    done = F.aggregate(runs, F.array(begin(zero)), lambda acc, r: F.concat(acc, F.array(F.aggregate(r, begin(F.get(acc, F.size(acc) - 1)["state"]), one))))
    return F.when(F.size(a) > 0, F.flatten(F.transform(done, lambda x: x["out"]))).otherwise(none)


def _located(text: Column, pattern: str, kind: str, context: bool = False) -> Column:
    """Matches as ``array<struct<s,e,k,m,l,r>>``: start, end, kind's index, match, and with ``context`` what stands around it.

    Places are the lengths of the gaps between the matches and of the matches
    themselves, added up; what stands around is carried along from match to
    match, so that no text is cut from its beginning anew.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ahead = F.zip_with(found, F.slice(gaps, F.lit(2), F.size(gaps)), lambda m, n: F.struct(m.alias("m"), n.alias("n")))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(gaps) - 1), ahead, lambda g, x: F.struct(g.alias("g"), x["m"].alias("m"), x["n"].alias("n")))
    head = lambda c: F.substring(c, 1, CONTEXT)
    tail = lambda c: F.right(c, F.lit(CONTEXT))
    span = "s:int,e:int,k:int,m:string"
    ends = lambda at, x: F.struct((at + F.length(x["g"])).alias("s"), (at + F.length(x["g"]) + F.length(x["m"])).alias("e"), F.lit(EVERY_KIND.index(kind)).alias("k"), x["m"].alias("m"))
    if not context:
        step = lambda at, x: at + F.length(x["g"]) + F.length(x["m"])
        out = _scan(pairs, F.lit(0), step, lambda at, x: F.array(ends(at, x)), f"struct<{span}>")
    else:
        span += ",l:string,r:string"
        right = lambda v: F.reverse(_scan(F.reverse(v), F.lit(""), lambda a, p: head(F.concat(p["m"], head(p["n"]), a)), lambda a, p: F.array(head(F.concat(head(p["n"]), a))), "string"))
        zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("t"))
        both = _bound(pairs, lambda v: F.zip_with(v, right(v), lambda p, r: F.struct(p["g"].alias("g"), p["m"].alias("m"), r.alias("r"))))
        before = lambda a, x: tail(F.concat(a["t"], tail(x["g"])))
        step = lambda a, x: F.struct((a["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"), tail(F.concat(before(a, x), x["m"])).alias("t"))
        emit = lambda a, x: F.array(F.struct(*[ends(a["at"], x)[c].alias(c) for c in "sekm"], before(a, x).alias("l"), x["r"].alias("r")))
        out = _scan(both, zero, step, emit, f"struct<{span}>")
    return F.when(text.rlike(_HINTS[pattern]), out).otherwise(F.array().cast(f"array<struct<{span}>>"))


def _based(text: Column, kind: str) -> Column:
    return F.filter(_located(text, BASE[kind], kind), lambda x: _valid(kind, x["m"]))


def _features(m: Column, left: Column, right: Column) -> dict[str, Column]:
    on = {"m": m, "l": left, "r": right}
    out = {name: on[what].rlike(pattern).cast("int") for name, pattern, what in _PATTERNS}
    digits = _digits(m)
    return out | {"digits": F.length(digits), "length": F.length(m), "luhn": (luhn(digits) & (F.length(digits) > 11)).cast("int")}


def _features_py(m: str, left: str, right: str) -> list[int]:
    on = {"m": m, "l": left, "r": right}
    digits = re.sub("[^0-9]", "", m)
    return [int(bool(re.search(pattern, on[what]))) for _, pattern, what in _PATTERNS] + [len(digits), len(m), int(len(digits) > 11 and _luhn(digits))]


def training_spans(per_kind: int = SPANS_PER_KIND, seed: int = 7) -> dict[str, list[tuple[str, str, str, int]]]:
    """Labelled spans by kind: match, left and right context, 1 if personal."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("aeiou" if i % 2 else "bcdfghlmnprst") for i in range(r.randint(2, 9)))
    cue = re.compile("(?i)" + "|".join([*_FOR.values(), _AGAINST])).search

    def prose() -> str:
        """Words that speak neither for nor against any kind."""
        while cue(text := " ".join(word() for _ in range(5))[-20:] + " "):
            pass
        return text

    near = lambda words: f"{prose()[-9:]}{r.choice(words)}{r.choice([': ', ' ', ' is '])}"
    against = ["order no.", "Invoice", "version", "ISBN", "serial", "build", "part no.", "page", "ref", "Total", "table", "section", "figure", "score"]

    def card(valid: bool) -> str:
        body = r.choice(["4", "51", "55", "6"])
        body += d(15 - len(body))
        check = next(c for c in "0123456789" if _luhn(body + c))
        body += check if valid else str((int(check) + r.randint(1, 9)) % 10)
        return r.choice("./_").join(body[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        return r.choice([
            f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"0049 {d(3)} {d(3)} {d(4)}", f"{d(3)}-{d(4)}", f"{d(3)} {d(4)}",
            f"0{d(1)}" + "".join(r.choice([" ", "."]) + d(2) for _ in range(4)), f"0{d(2)}/{d(r.randint(6, 8))}", f"0{d(4)}-{d(r.randint(5, 7))}", f"(0{d(2)}) {d(r.randint(6, 8))}", f"00{r.choice(['1', '33', '44', '34'])} {d(2)} {d(4)} {d(4)}",
        ])

    def email() -> str:
        at, dot = r.choice([("[at]", "[dot]"), (" (at) ", " (dot) "), (" at ", " dot "), ("{at}", "."), ("(at)", "."), (" AT ", " DOT "), ("<at>", "<dot>"), (" @ ", "."), ("_at_", "_dot_"), (" [AT] ", "."), (" at ", ".")])
        return f"{word()}{r.choice(['.', '_', '', '-'])}{word()}{r.choice(['', d(2)])}{at}{word()}{r.choice(['', dot + word()])}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'co.uk', 'io'])}"

    def v6() -> str:
        groups = [f"{r.randrange(1, 65536):x}" for _ in range(8)]
        if r.random() < 0.4:
            return ":".join(groups)
        keep = r.randint(1, 6)
        left = r.randint(0, keep)
        return ":".join(groups[:left]) + "::" + ":".join(groups[left:keep])

    fenced = lambda: r.choice(["[.]", "(.)", "[dot]", " [.] "]).join(str(r.randrange(256)) for _ in range(4))
    date = lambda: r.choice([f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{r.randint(1990, 2030)}", f"{r.randint(1, 12):02}/{r.randint(1, 28):02}/{r.randint(10, 99)}"])
    hexed = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(r.choice("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(n - 1)) + d(1)
    named = lambda: r.choice(["token", "api_key", "secret", "password", "AUTH_TOKEN", "apiKey", "aws_secret_access_key", "client-secret", "db_password", "Bearer"])

    def secret() -> str:
        value = r.choice([lambda: hexed(r.choice([32, 40, 64])), lambda: mixed(r.randint(16, 44)), lambda: mixed(r.randint(9, 15))])()
        quote = r.choice(["", '"', "'"])
        form = r.choice([lambda: f"{named()}{r.choice([' = ', '=', ': ', ':', ' := '])}{quote}{value}{quote}", lambda: f"Bearer {mixed(30)}", lambda: f"AKIA{''.join(r.choice('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') for _ in range(16))}", lambda: f"ghp_{mixed(36)}", lambda: f"sk-{mixed(40)}"])
        return r.choice([str, str, str.upper])(form())

    plus = {
        "email": lambda: (email(), r.choice([prose(), near(["mail", "contact", "write"])]), " " + prose()),
        "ip": lambda: (r.choice([v6, v6, fenced])(), r.choice([prose(), near(["IP", "host", "addr"])]), " " + prose()),
        "card": lambda: (card(True), r.choice([prose(), near(["card", "Visa", "payment"])]), " " + prose()),
        "phone": lambda: (phone(), near(["phone", "Tel.", "call", "mobile", "fax", "dial", "Tel"]), r.choice([" ", ", ", "."]) + prose()),
    }
    plus["secret"] = lambda: (secret(), r.choice([prose(), near(["config", "export"])]), " " + prose())
    minus = {
        "secret": lambda: r.choice([
            lambda: (f"{r.choice(['token', 'secret', 'password', 'passwords', 'auth', 'bearer'])}{r.choice([' ', ': ', ' = '])}{word()}{word()}{word()}", prose(), " " + prose()), lambda: (hexed(r.choice([32, 40, 64])), f"{prose()}{r.choice(['md5 ', 'sha256: ', 'commit ', 'checksum ', 'etag '])}", " " + prose()),
            lambda: (hexed(r.choice([32, 40, 64])), prose(), " " + prose()), lambda: (f"{r.choice(['token', 'password', 'secret'])} {word()}{word()}{word()}", prose(), " " + prose()), lambda: (f"{r.choice(['auth', 'token', 'secret'])}: {word()}.{word()}.{word()}", prose(), " " + prose()),
        ])(),
        "email": lambda: r.choice([lambda: (f"{word()} at {word()}.{word()}lo", prose(), " " + prose()), lambda: (f"{word()} at {word()}. {r.choice(['It', 'In', 'At', 'Be', 'Us', word().capitalize()])}", prose(), " " + prose()), lambda: (f"{word()} at {word()} dot {word()}lo", prose(), " " + prose())])(),
        "ip": lambda: r.choice([
            lambda: (":".join(d(2) for _ in range(r.randint(3, 6))), r.choice([prose(), near(against)]), " " + prose()), lambda: (":".join(f"{r.randrange(256):02x}" for _ in range(6)), r.choice([prose(), near(["mac", "device"])]), " " + prose()),
            lambda: (f"{d(1)}:{d(2)}:{d(2)}", prose(), " " + prose()), lambda: (r.choice(["::", "a::b::c", "12::34::", ":::", "1:2:3:", ":5:6"]), prose(), " " + prose()), lambda: (r.choice(["[.]", "(.)"]).join(str(r.randrange(256, 1000)) for _ in range(4)), prose(), " " + prose()),
        ])(),
        "card": lambda: r.choice([lambda: (card(False), prose(), " " + prose()), lambda: (" ".join(str(r.randint(1900, 2030)) for _ in range(4)), prose(), " " + prose()), lambda: (card(True), near(against), f" {d(4)} ")])(),
        "phone": lambda: r.choice([
            lambda: (phone(), near(against), " " + prose()), lambda: (f"{d(3)} {d(3)} {d(3)}", f"{prose()}{d(3)} ", f" {d(3)} "), lambda: (f"{d(4)}-{d(4)}-{d(4)}", prose(), " " + prose()), lambda: (phone(), prose(), " " + prose()),
            lambda: (date(), r.choice([prose(), near(["call", "phone", "mail"]), near(against)]), " " + prose()), lambda: (f"{d(2)}-{d(2)}", prose(), " " + prose()), lambda: (f"{d(2)} {d(3)}", near(["phone", "call"]), f" {d(3)}"), lambda: (f"{d(5)} {d(5)} {d(5)}", prose(), " " + prose()),
        ])(),
    }
    out = {}
    for kind in EVERY_KIND:
        rows = [(*plus[kind](), 1) for _ in range(per_kind // 2)] + [(*minus[kind](), 0) for _ in range(per_kind // 2)]
        r.shuffle(rows)
        out[kind] = rows
    return out


def boost(x: list[list[int]], y: list[int], rounds: int = 20, depth: int = 3, rate: float = 0.5) -> list[tuple]:
    """Gradient boosting of logistic loss; a tree is ``(f, cut, low, high)`` or a leaf's value."""
    score = [0.0] * len(y)

    def grow(rows: list[int], g: list[float], h: list[float], deep: int):
        sg, sh = sum(g[i] for i in rows), sum(h[i] for i in rows)
        best = None
        for f in range(len(x[0])) if deep else ():
            for cut in sorted({x[i][f] for i in rows})[1:]:
                low = [i for i in rows if x[i][f] < cut]
                lg, lh = sum(g[i] for i in low), sum(h[i] for i in low)
                gain = lg * lg / (lh + 1) + (sg - lg) ** 2 / (sh - lh + 1) - sg * sg / (sh + 1)
                if gain > 1e-6 and (best is None or gain > best[0]):
                    best = gain, f, cut, low
        if best is None:
            return rate * sg / (sh + 1)
        _, f, cut, low = best
        inside = set(low)
        return f, cut, grow(low, g, h, deep - 1), grow([i for i in rows if i not in inside], g, h, deep - 1)

    trees = []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        tree = grow(list(range(len(y))), [a - b for a, b in zip(y, p)], [b * (1 - b) for b in p], depth)
        trees.append(tree)
        score = [s + value(tree, row) for s, row in zip(score, x)]
        if max(abs(a - b) for a, b in zip(y, p)) < 0.01:
            break
    return trees


def value(tree, row: list[int]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree


@functools.cache
def fitted(kind: str) -> tuple[list, float]:
    """The trees of a kind and the score from which a span is added."""
    rows = training_spans()[kind]
    x, y = [_features_py(m, a, b) for m, a, b, _ in rows], [r[-1] for r in rows]
    half = len(rows) // 2
    trees = boost(x[:half], y[:half])
    scored = sorted(((sum(value(t, row) for t in trees), label) for row, label in zip(x[half:], y[half:])), reverse=True)
    threshold, good = math.inf, 0
    for n, (score, label) in enumerate(scored, 1):
        good += label
        last = n == len(scored) or scored[n][0] < score
        if last and good / n >= PRECISION:  # a little less, so that the order of a sum can't matter
            threshold = score - 1e-6
    return trees, threshold


def _score(trees: list, features: dict[str, Column]) -> Column:
    def tree(t) -> Column:
        if not isinstance(t, tuple):
            return F.lit(float(t))
        return F.when(features[FEATURES[t[0]]] < t[1], tree(t[2])).otherwise(tree(t[3]))

    total = F.lit(0.0)
    for t in trees:
        total = total + tree(t)
    return total


def _accepted(text: Column, kind: str) -> Column:
    trees, threshold = fitted(kind)

    def keep(x: Column) -> Column:
        f = F.struct(*[c.alias(n) for n, c in _features(x["m"], x["l"], x["r"]).items()])
        # named once, so that no feature is worked out anew for every tree
        return F.exists(F.array(f), lambda v: _score(trees, {n: v[n] for n in FEATURES}) >= F.lit(threshold))

    return F.filter(_located(text, WIDE[kind], kind, True), keep)


def find_pii(docs: DataFrame, text_col: str = "text", base_name: str = "base", spans_name: str = "spans") -> DataFrame:
    """``docs`` with two arrays of ``struct<s,e,k>``: base spans and all spans.

    ``s`` and ``e`` (exclusive) are code points, ``k`` an index of ``EVERY_KIND``;
    the base has spans of ``KINDS`` only.
    Both are in order of start, then kind.  A null text is empty and has no
    span.  A name that ``docs`` has already gets underscores in front.  Each row stands for itself, so repeated rows and null ids change
    nothing.  Spans of different kinds may overlap in the base; what is added
    overlaps neither a base span nor an earlier added one.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base_name, spans_name = fresh(docs, base_name, spans_name)
    bare = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    base = F.array_sort(F.concat(*[bare(_based(text, k)) for k in KINDS]))
    more = F.array_sort(F.concat(*[bare(_accepted(text, k)) for k in EVERY_KIND]))
    more_name, free_name = fresh(docs, "__more", "__free")
    out = docs.withColumn(base_name, base).withColumn(more_name, more)
    # an added span is clear of the base if no base span that begins before its end ends after its start
    kind = "struct<s:int,k:int,e:int>"
    event = lambda at, late, x: F.struct(at.alias("at"), F.lit(late).alias("late"), x.alias("x"))
    events = F.array_sort(F.concat(F.transform(base_name, lambda x: event(x["s"], 1, x)), F.transform(more_name, lambda x: event(x["e"], 0, x))))
    reached = lambda a, x: F.when(x["late"] == 1, F.greatest(a, x["x"]["e"])).otherwise(a)
    clear = lambda a, x: F.when((x["late"] == 0) & (a <= x["x"]["s"]), F.array(x["x"])).otherwise(F.array().cast(f"array<{kind}>"))
    free = F.array_sort(_scan(events, F.lit(0), reached, clear, kind))
    out = out.withColumn(free_name, F.when(F.size(more_name) > 0, free).otherwise(F.col(more_name)))
    apart = _scan(F.col(free_name), F.lit(0), lambda a, x: F.when(a > x["s"], a).otherwise(x["e"]), lambda a, x: F.when(a > x["s"], F.array().cast(f"array<{kind}>")).otherwise(F.array(x)), kind)
    return out.withColumn(spans_name, F.array_sort(F.concat(F.col(base_name), apart))).drop(more_name, free_name)


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[{}]") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind; of spans that overlap the first counts, and what reaches beyond it goes too."""
    base, spans, parts = fresh(docs, "base", "spans", "__parts")
    found = find_pii(docs, text_col, base, spans)
    t = F.col(f"`{text_col}`")
    names = F.array(*[F.lit(mask.format(k)) for k in EVERY_KIND])
    put = lambda x: F.struct(x["s"].alias("s"), F.get(names, x["k"]).alias("m"), x["e"].alias("e"))
    # what stays lies between the ends so far and the next start
    emit = lambda a, x: F.when(x["s"] < a, F.array().cast("array<struct<a:int,b:int,m:string>>")).otherwise(F.array(F.struct(a.alias("a"), x["s"].alias("b"), x["m"].alias("m"))))
    kept = _scan(F.transform(spans, put), F.lit(0), lambda a, x: F.greatest(a, x["e"]), emit, "struct<a:int,b:int,m:string>")
    found = found.withColumn(parts, kept)
    last = F.aggregate(spans, F.lit(0), lambda a, x: F.greatest(a, x["e"]))
    # a place in a text is found by counting from its beginning, so that the text is cut into blocks of about the square root of its length first
    size = F.ceil(F.sqrt(F.length(t).cast("double"))).cast("int")
    blocks = lambda n: F.transform(F.sequence(F.lit(0), F.floor(F.length(t) / n).cast("int")), lambda i: F.substring(t, i * n + 1, n))
    first = lambda x, n: F.floor(x["a"] / n).cast("int")
    part = lambda x, b, n: F.substring(F.array_join(F.slice(b, first(x, n) + 1, F.floor(x["b"] / n).cast("int") - first(x, n) + 1), ""), x["a"] - first(x, n) * n + 1, x["b"] - x["a"])
    pieces = _bound(size, lambda n: _bound(blocks(n), lambda b: F.transform(parts, lambda x: F.concat(part(x, b, n), x["m"]))))
    done = F.concat(F.array_join(pieces, ""), F.substring(t, last + 1, F.length(t)))
    return found.withColumn(text_col, F.when(F.size(spans) > 0, done).otherwise(t)).drop(base, spans, parts)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    names = F.array(*[F.lit(k) for k in KINDS])
    digest = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")
    of = lambda i: F.filter("base", lambda x: x["k"] == i)
    n = [F.size(of(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *n, F.sha2(digest("base"), 256).alias("base_sha256"), digest(F.filter("spans", lambda x: x["k"] < len(KINDS))).alias("spans"), F.size("spans").cast("long").alias("n_spans"), F.size(F.filter("spans", lambda x: x["k"] >= len(KINDS))).cast("long").alias("n_secrets"))
