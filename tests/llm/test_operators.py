"""Corpus operators against brute force, and their defined results on odd tables."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stratagraph.llm import components, decontaminate, html_extract, language_id, line_dedup, mixture, pii, simhash, substring_dedup, token_count, topk

DOCS = "doc_id long, text string, lang string, source string"
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "null id null id null id"), (4, "same text here again and again"), (4, "same text here again and again"), (5, "x"), (6, "lang ß 日本   \x00 end"), (7, "word " * 30_000)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None) for i, t in rows], DOCS)


def clash(df):
    """With columns whose names operators might use themselves."""
    return df.withColumns({c: F.lit(1) for c in ("d", "t", "fp", "key", "copy", "size", "__text", "__at", "base", "spans", "lang_pred", "score")})


def prose(r, n):
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()) + str(r.randrange(30)) for _ in range(n))


# --- 1 ---


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    r = random.Random(1)
    texts = [t for _, t in ODD] + ["<|endoftext|> in a text", "don't  we'll\n\n  x", "naïve café 12345 ½ ٣ ́a", "ẞ\U0001f600\U0001f468‍\U0001f469", "a b　c  d"] + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x3000), r.randrange(0x1F000, 0x1FA00)])) for _ in range(60)) for _ in range(60)]
    t = Tokenizer.from_file(path)
    got = {x["doc_id"]: x for x in token_count.count_tokens(clash(docs(spark, enumerate(texts))), path).collect()}
    assert token_count.count_tokens(docs(spark, []), path).count() == 0
    for k, text in enumerate(texts):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[k]["n_tokens"], got[k]["n_bytes"], got[k]["over_limit"]) == (n, len((text or "").encode()), n > 1024), text


def test_whole_tokens_are_proved():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = token_count.whole_tokens(t)
    assert len(whole) > 40_000 and all(len(t.encode(s, add_special_tokens=False).ids) == 1 for s in random.Random(2).sample(sorted(whole), 500))


# --- 2 ---


def brute_hits(text, items, n=10):
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    w, hit, found = words(text), set(), set()
    for i, item in items:
        v = words(item)
        k = min(n, len(v))
        grams = {tuple(v[p : p + k]) for p in range(len(v) - k + 1)} if v else set()
        for p in range(len(w) - k + 1):
            if tuple(w[p : p + k]) in grams:
                hit |= set(range(p, p + k))
                found.add(str(i))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark, monkeypatch):
    r = random.Random(3)
    items = [(10, prose(r, 25)), (9, prose(r, 10)), (8, "Short one!"), (7, ""), (6, None), (8, "Short one!")]
    texts = ODD + [(20, prose(r, 40)), (21, "a " + items[0][1].upper() + " b"), (22, items[1][1] + "  " + items[1][1]), (23, "the short, ONE is short one"), (24, items[0][1][40:] + " end")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(clash(docs(spark, texts)), bench)
    got = sorted((str(x["doc_id"]), x["n_words"], x["n_hit"], x["items"]) for x in found.collect())
    assert got == sorted((str(i), *brute_hits(t, items)) for i, t in texts)
    kept = {x["doc_id"] for x in decontaminate.decontaminate(clash(docs(spark, texts)), bench).collect()}
    assert kept == {i for i, t in texts if not brute_hits(t, items)[1]}
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 200)  # in several slices
    far = decontaminate.find_contamination(docs(spark, texts), bench)
    assert sorted((str(x["doc_id"]), x["n_words"], x["n_hit"], x["items"]) for x in far.collect()) == got
    assert decontaminate.decontaminate(docs(spark, texts), bench.limit(0)).count() == len(texts)
    assert decontaminate.find_contamination(docs(spark, []), bench).count() == 0


# --- 3 ---


def test_line_dedup(spark):
    lines = ["  A line that is shared by many \t", "a LINE that is shared by many", "short", "another line of twenty chars", "unique line number %d of this doc"]
    r = random.Random(4)
    texts = ODD + [(100 + k, "\n".join(r.choice(lines).replace("%d", str(k)) for _ in range(r.randint(1, 6)))) for k in range(12)] + [(105, "another line of twenty chars\n\nx\n")]
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\f\r"))
    where: dict[str, set[int]] = {}
    for n, (_, t) in enumerate(texts):
        for x in (t or "").split("\n"):
            where.setdefault(key(x), set()).add(n)
    want = []
    for i, t in texts:
        parts = (t or "").split("\n")
        low = lambda j: -1 if j is None else j
        stay = [x for x in parts if not (len(key(x)) >= 20 and len(where[key(x)]) >= 3 and max(low(texts[n][0]) for n in where[key(x)]) != low(i))]
        want.append((str(i), "\n".join(stay), len(parts), len(parts) - len(stay)))
    got = line_dedup.line_dedup(clash(docs(spark, texts)), stats=("n1", "n2")).collect()
    assert sorted((str(x["doc_id"]), x["text"] or "", x["n1"], x["n2"]) for x in got) == sorted(want)
    assert set(clash(docs(spark, [])).columns) <= set(got[0].asDict()) and line_dedup.line_dedup(docs(spark, [])).count() == 0


# --- 4 ---

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 14 <= len(digits) <= 19 and pii._luhn(digits)) or (kind == "phone" and 10 <= len(digits) <= 15)
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii(spark):
    r = random.Random(5)
    bits = ["a.b@c.de", "x@y", "@@a@b.c", "1.2.3.4", "1.2.3.400", "01.2.3.0004.5.6.7", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "+49 (170) 123-4567", "+1 2", "+" + "1" * 15, "+" + "1" * 16, "日本", ".", "-", " ", "\n", "12 34", "a@b.c.d-e.", "9" * 25]
    texts = ODD + [(1000 + k, "".join(r.choice(bits) + r.choice(["", " ", ", "]) for _ in range(r.randint(1, 9)))) for k in range(300)]
    got = pii.find_pii(clash(docs(spark, texts))).collect()
    assert len(got) == len(texts) and all(x["base"] == 1 for x in got)  # what was there stays
    assert pii.find_pii(docs(spark, [])).count() == 0
    want = {}
    for i, t in texts:
        want.setdefault(str(i), set()).add((t, tuple(base_spans(t))))
    for x in got:
        own = tuple((s["s"], s["k"], s["e"]) for s in x["_base"])
        assert (x["text"], own) in want[str(x["doc_id"])], x["text"]
        every = [(s["s"], s["k"], s["e"]) for s in x["_spans"]]
        assert set(own) <= set(every) and every == sorted(every)
        for s in set(every) - set(own):
            assert all(s[2] <= o[0] or o[2] <= s[0] for o in own)


def test_pii_trees_find_what_the_base_misses(spark):
    plus = ["Please mail to joe.miller [at] example [dot] com today", "server addr: fe80:1:2:3:4:5:6:7 is down", "Phone: (212) 555-0187, ask"]
    minus = ["invoice 212 555 0187 was paid", "at 10:20:30:40 the end", "the years 1990 1991 1992 1993 were good", "look at something.else there"]
    rows = {x["text"]: x for x in pii.redact(docs(spark, enumerate(plus + minus))).collect()}
    for t in minus:
        assert t in rows
    assert any("[email]" in t for t in rows) and any("[phone]" in t for t in rows)
    for kind in pii.EVERY_KIND:
        trees, threshold = pii.fitted(kind)
        spans = pii.training_spans(seed=99)[kind]
        taken = [(sum(pii.value(t, pii._features_py(m, a, b)) for t in trees) >= threshold, y) for m, a, b, y in spans]
        right = sum(y for hit, y in taken if hit)
        assert right / max(1, sum(hit for hit, _ in taken)) > 0.95 and right / sum(y for _, y in taken) > 0.5, kind


def test_pii_forms_of_another_hand(spark):
    """Forms as people write them, not from the templates that the trees are fitted to."""
    plus = {
        "email": ["You can reach me under jane_doe99 (at) mail-server (dot) org if need be", "write to Bob.Builder[AT]example[DOT]com please", "sales AT shop DOT example DOT com is read daily", "Contact: anna.k @ uni-mainz.de (office)", "help{at}desk.io answers"],
        "ip": ["route to 2001:db8::1 was lost", "the loopback ::1 answered", "neighbour fe80::1ff:fe23:4567:890a on eth0", "host 2001:db8:85a3::8a2e:370:7334 up", "2001:0db8:0000:0000:0000:ff00:0042:8329 is long", "beacon at 203[.]0[.]113[.]9 seen"],
        "card": ["Visa 4111.1111.1111.1111 was used", "paid with 5500/0055/5555/5559 today"],
        "phone": ["Tel. 01 23 45 67 89 (matin)", "call 555-0134 before noon", "phone: (415) 555-0132", "Fax 030/1234567 nur werktags", "mobile 0049 30 1234 5678, please", "Tel: 0171-1234567."],
    }
    plus["secret"] = ['set token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" first', "db_password: hunter2Hunter2", "export API_KEY=AbCdEf0123456789xyz", "TOKEN = '9F86D081884C7D659A2FEAA0C55AD015'", "use ghp_16C7e42F292c6912E7710c838347Ae178B4a now"]
    minus = ["the password was forgotten", "md5 9f86d081884c7d659a2feaa0c55ad015 of the file", "a secret garden", "looked at and. It was late", "sat at home. In time", "token economics explained", "we met at home. Then we left", "the shop at number.seven was shut", "std::vector and a::b are names", "wake me at 10:20:30 sharp", "mac 00:1a:2b:3c:4d:5e of the card", "on 2024-01-15 it rained", "version 10 20 30 of the plan", "pages 100-120 and 200-250", "scores 12 13 14 15", "bid 4111.1111.1111.1112 lost", "ISBN 978 3 16 148410", "order 555-0134 shipped"]
    rows = {x["text"]: {pii.EVERY_KIND[s["k"]] for s in x["spans"]} for x in pii.find_pii(docs(spark, enumerate([t for some in plus.values() for t in some] + minus))).collect()}
    missed = [t for kind, some in plus.items() for t in some if kind not in rows[t]]
    wrong = [t for t in minus if rows[t]]
    assert len(missed) <= 1 and len(wrong) <= 1, (missed, wrong)


def test_pii_in_texts_with_very_many_matches(spark):
    """Costs grow far slower than the square of the matches; so do spans in any order."""
    import time

    took = []
    for n in (1_000, 8_000):
        text = " ".join(f"a{k}@b.de tel 030/{1000000 + k} x{k} [at] y.com 10.0.0.{k % 300}" for k in range(n))
        df = docs(spark, [(1, text)])
        began = time.perf_counter()
        x = pii.find_pii(df).first()
        took.append(time.perf_counter() - began)
        assert sum(s["k"] == 0 for s in x["base"]) == n and [(s["s"], s["k"], s["e"]) for s in x["base"]] == base_spans(text)
        assert len(x["spans"]) > len(x["base"]) + n
        assert pii.redact(df).first()["text"].count("[email]") >= n
    assert took[1] < 24 * took[0] + 5, took


# --- 5 ---


def waterfill(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 2 * sizes[s]} if total else set()
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = 2 * sizes[s]
            left -= 2 * sizes[s]
        open_ -= over


def test_mixture(spark):
    r = random.Random(6)
    rows = [(k, prose(r, r.randint(0, 30)), None, r.choice(["a", "b", "c", "é", "d", None])) for k in range(600)] + [(9000, None, None, "empty"), (9001, " ", None, "empty"), (5, "twice", None, "a")]
    df = spark.createDataFrame(rows, DOCS)
    plan = mixture.plan_mixture(clash(df).drop("size")).collect()  # the plan's own columns
    sizes: dict = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = waterfill(sizes)
    taken: dict = {}
    for x in plan:
        assert x["source_size"] == sizes[x["source"]] and math.isclose(x["target"], want[x["source"]], rel_tol=1e-9, abs_tol=1e-9) and x["taken"] <= 2 * x["size"]
        taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
    for s, n in taken.items():  # within four standard deviations of the draws
        part = want[s] / sizes[s] % 1 if sizes[s] else 0
        spread = math.sqrt(part * (1 - part) * sum(len((t or "").split()) ** 2 for _, t, _, x in rows if x == s))
        assert abs(n - want[s]) <= 4 * spread + 1, (s, n, want[s], spread)
    other = {x["doc_id"]: x["copies"] for x in mixture.plan_mixture(df, seed="7").collect()}
    assert any(other[x["doc_id"]] != x["copies"] for x in plan)
    mixed = mixture.mix(df).collect()
    assert sum(len((x["text"] or "").split()) for x in mixed) == sum(taken.values()) and mixture.mix(df).count() == len(mixed)
    assert mixture.mix(df.limit(0)).count() == 0 and mixture.plan_mixture(df.limit(0)).count() == 0


# --- 6 ---


def test_language_id(spark):
    r = random.Random(7)
    vocab = {"en": "the of and that with from have this which their there would about", "de": "der die und das nicht ein mit sich auf dem eine auch werden", "fr": "le la les des est une dans que pour qui avec sont cette"}
    rows = [(k, " ".join(r.choice(vocab[x].split()) for _ in range(r.randint(3, 60))), x, None) for k, x in enumerate(r.choices(sorted(vocab), k=600))]
    long = " ".join(r.choice(vocab["de"].split()) for _ in range(400_000))
    odd = [(7001, None, "en", None), (7002, "12 34 !", "en", None), (7003, "", None, None), (7004, long, "de", None), (None, rows[0][1], rows[0][2], None)]
    df = spark.createDataFrame([*rows, *rows[:50], *odd], DOCS)
    model = language_id.learn(df)
    assert model.langs == ["de", "en", "fr"]
    found = language_id.identify(clash(df), model).collect()
    assert len(found) == len(rows) + 50 + len(odd) and all(x["lang_pred"] == 1 for x in found)  # what was there stays
    got = {x["doc_id"]: x for x in found}
    assert all(got[i]["_lang_pred"] == "und" and got[i]["_score"] == 0 for i in (7001, 7002, 7003))
    right = [got[i]["_lang_pred"] == x for i, _, x, _ in rows]
    assert sum(right) / len(right) > 0.97 and all(0 <= x["_score"] <= 1 for x in found)
    assert got[7004]["_lang_pred"] == "de" and got[None]["_lang_pred"] == rows[0][2]
    assert language_id.keep_identified(clash(df), model).count() == 652
    none = language_id.learn(df.where("false"))
    assert {x["lang_pred"] for x in language_id.identify(df, none).collect()} == {"und"}


def test_any_number_of_languages(spark, monkeypatch):
    """200 labels, each with words of its own; in one group and in many the predictions agree."""
    r = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzäöüéèßñçøå"
    rows = []
    for k in range(200):
        words = ["".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(12)]
        rows += [(k * 10 + j, " ".join(r.choice(words) for _ in range(40)), f"l{k:03}", None) for j in range(10)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    monkeypatch.setattr(language_id, "GROUP_BYTES", 1 << 40)
    one = language_id.learn(df)
    monkeypatch.setattr(language_id, "GROUP_BYTES", max(language_id.Tree([t.encode() for _, t, x, _ in rows if x == "l000"]).nbytes, 1) * 60)
    many = language_id.learn(df)
    assert len(one.groups) == 1 and len(many.groups) >= 3 and one.langs == many.langs and len(one.langs) == 200
    a, b = ({x["doc_id"]: (x["lang_pred"], round(x["score"], 9)) for x in language_id.identify(df, m).collect()} for m in (one, many))
    assert a == b and sum(a[i][0] == x for i, _, x, _ in rows) / len(rows) > 0.97


def brute_code_length(training, text):
    """Prediction by partial matching with dictionaries, byte by byte."""
    counts: list[dict] = [{} for _ in range(language_id.ORDER + 1)]
    for t in training:
        padded = b"\0" * language_id.ORDER + t
        for at in range(language_id.ORDER, len(padded)):
            for k in range(language_id.ORDER + 1):
                c = counts[k].setdefault(padded[at - k : at], {})
                c[padded[at]] = c.get(padded[at], 0) + 1
    kept: list[set] = [set(counts[0]), set(counts[1])]
    size = {x: i + 1 for i, x in enumerate(sorted({b for t in training for b in t}))}
    code = lambda c: sum(size.get(x, 0) * (len(size) + 1) ** k for k, x in enumerate(reversed(c)))
    for k in (2, 3):
        some = [(-sum(v.values()), code(c), c) for c, v in counts[k].items() if c[1:] in kept[k - 1]]
        kept.append({c for n, _, c in sorted(some)[: language_id.MAX_CONTEXTS] if -n >= language_id.MIN_COUNT})

    def p(symbol, context):
        while context not in kept[len(context)]:
            context = context[1:]
        seen = counts[len(context)].get(context, {})
        n, d = sum(seen.values()), len(seen)
        if symbol in seen:
            return seen[symbol] / (n + d)
        return (d / (n + d) if n else 1.0) * (p(symbol, context[1:]) if context else 1 / 256)

    padded = b"\0" * language_id.ORDER + bytes(x if x in size else 0 for x in text)  # bytes that weren't seen are all one
    return -sum(math.log2(p(padded[at], padded[at - language_id.ORDER : at])) for at in range(language_id.ORDER, len(padded)))


def test_code_lengths_equal_brute_force(monkeypatch):
    monkeypatch.setattr(language_id, "MAX_CONTEXTS", 25)
    r = random.Random(9)
    training = [" ".join(r.choice("die der das und ümlaut nicht".split()) for _ in range(r.randint(1, 40))).encode() for _ in range(12)]
    tree = language_id.Tree(training)
    for text in [b"", b"d", "die zwölf Äpfel".encode(), training[0], bytes(range(1, 256)), " ".join(r.choice("und oder aber ümlaut".split()) for _ in range(30)).encode()]:
        assert math.isclose(language_id.code_lengths([tree], [text])[0, 0], brute_code_length(training, text), rel_tol=1e-5, abs_tol=1e-4)


def test_code_lengths_are_sums_and_independent_of_batches(monkeypatch):
    trees = [language_id.Tree([b"abcabcabc" * 40]), language_id.Tree([b"xyzzy" * 60]), language_id.Tree([])]
    texts = [b"abc", b"", b"xyzzyabc" * 9, bytes([200, 7])]
    together = language_id.code_lengths(trees, texts)
    for k, t in enumerate(texts):
        assert np.allclose(together[k], language_id.code_lengths(trees, [t])[0])
    monkeypatch.setattr(language_id, "SLICE", 7)
    assert np.allclose(together, language_id.code_lengths(trees, texts))


# --- components, 7 ---


def groups(links, n):
    p = list(range(n))

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        p[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_components(spark):
    r = random.Random(8)
    links = [(i, i + 1) for i in range(300)] + [(400, 400 + k) for k in range(60)] + [(r.randrange(500, 600), r.randrange(500, 600)) for _ in range(70)] + [(450, 450)]
    want = groups(links, 700)
    got = {x["node"]: x["root"] for x in components.connected_components(spark.createDataFrame([*links, (None, 3)], "u long, v long")).collect()}
    assert got == {x: want[x] for e in links if e[0] != e[1] for x in e}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_similar_links():
    r = random.Random(9)
    for _ in range(60):
        base = [frozenset(r.sample(range(40), r.randint(2, 16))) for _ in range(5)]
        sets = [frozenset(x for x in {*r.choice(base), *r.sample(range(60), r.randint(0, 3))} if r.random() > 0.05) or frozenset([1]) for _ in range(40)]
        near = [(i, j) for i, j in itertools.combinations(range(40), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
        links = substring_dedup.similar_links(sets)
        assert groups(links, 40) == groups(near, 40) and len(links) == 40 - len(set(groups(near, 40)))


def test_substring_dedup(spark):
    r = random.Random(10)
    passage, other = prose(r, 60), prose(r, 80)
    near = passage.split()
    near[30] = "changed"
    rows = [(1, prose(r, 50) + " " + passage), (2, passage.upper() + " " + prose(r, 40)), (3, prose(r, 30) + "\n" + " ".join(near) + "\n" + prose(r, 20)), (4, prose(r, 200)), (5, other), (6, prose(r, 10) + " " + other), (7, prose(r, 120)), (8, None), (9, "")]
    found = substring_dedup.repeated_paragraphs(docs(spark, rows)).collect()
    covered: dict = {}
    for x in found:
        covered[x["d"]] = covered.get(x["d"], 0) + x["w1"] - x["w0"]
    assert set(covered) == {1, 2, 3, 5, 6} and covered[1] >= 35 and covered[6] >= 55
    assert sum(x["first"] for x in found) == len({x["class"] for x in found})
    removed = {x["d"] for x in found if not x["first"]}
    assert {2, 6} <= removed and 1 not in removed
    assert substring_dedup.repeated_paragraphs(docs(spark, [])).count() == 0
    assert substring_dedup.repeated_paragraphs(docs(spark, [(1, passage), (1, passage)])).count() == 0  # one document


def test_substring_dedup_of_odd_tables(spark):
    """Null, empty, blank and very long texts, repeated rows, null ids (one document) and clashing columns."""
    r = random.Random(17)
    passage = prose(r, 70)
    rows = [*ODD, (20, passage), (21, prose(r, 9) + " " + passage), (21, prose(r, 9) + " " + passage), (22, prose(r, 40_000) + " " + passage)]
    table = clash(docs(spark, rows)).withColumns({c: F.lit(1) for c in ("a", "w", "e", "w0", "w1", "class")})
    found = substring_dedup.repeated_paragraphs(table).collect()
    assert {x["d"] for x in found} == {20, 21, 22} and {x["d"] for x in found if not x["first"]} == {21, 22}


def test_cuts_do_not_depend_on_the_batch():
    r = random.Random(11)
    texts = [prose(r, r.randint(0, 80)) for _ in range(20)]
    one = [[(int(a), int(b)) for a, b in zip(*substring_dedup.cut(*substring_dedup.split_words([t])))] for t in texts]
    hashes, lengths = substring_dedup.split_words(texts)
    begin, end = substring_dedup.cut(hashes, lengths)
    starts = np.cumsum(lengths) - lengths
    got = [[] for _ in texts]
    for a, b in zip(begin, end):
        k = int(np.searchsorted(starts + lengths, a, side="right"))
        got[k].append((int(a - starts[k]), int(b - starts[k])))
    assert got == one


def shared_run(texts):
    """The most words in a row that paragraphs of both texts hold."""
    cuts = []
    for words in texts:
        hashes, lengths = substring_dedup.split_words([" ".join(words)])
        cuts.append([(int(a), int(b), tuple(words[a:b])) for a, b in zip(*substring_dedup.cut(hashes, lengths)) if b - a >= substring_dedup.SHINGLE])
    other = {c for *_, c in cuts[1]}
    best = run = end = 0
    for a, b, c in cuts[0]:
        if c in other:
            run = b - a + (run if a == end else 0)
            best, end = max(best, run), b
    return best


def test_cuts_with_a_very_frequent_word():
    r = random.Random(12)
    words = [f"w{k}" for k in range(20_000)]
    worst = [min(words, key=lambda w: int(substring_dedup._mix(substring_dedup.split_words([w])[0], substring_dedup._MIX[0])[0]))]

    def window(w):
        h = substring_dedup.split_words([w])[0]
        x = np.zeros(1, np.uint64)
        for _ in range(3):
            x = substring_dedup._mix(x + h, substring_dedup._MIX[0])
        return int(x[0])

    worst.append(min(words, key=window))
    for hot in worst:
        some = lambda n: [hot if r.random() < 0.4 else r.choice(words) for _ in range(n)]
        found = 0
        for _ in range(100):
            passage = some(51)
            found += shared_run([some(60) + passage + some(60) for _ in range(2)]) >= substring_dedup.LEAST_RUN
        assert found >= 95, (hot, found)


def test_cuts_in_periodic_text():
    r = random.Random(13)
    for period in range(1, 8):
        passage = ([f"p{r.random()}" for _ in range(period)] * 60)[:55]
        assert shared_run([prose(r, 50).split() + passage + prose(r, 50).split() for _ in range(2)]) >= substring_dedup.LEAST_RUN


def test_near_copies_of_paragraphs(spark):
    """One word in the middle of 51 is changed, so that the exact Jaccard similarity is 42 / 52."""
    r = random.Random(14)
    rows = []
    for k in range(40):
        passage = [f"w{r.randrange(20_000)}" for _ in range(51)]
        rows.append((2 * k, prose(r, 30) + "\n" + " ".join(passage) + "\n" + prose(r, 30)))
        passage[25] = "changed"
        wrapped = " ".join(passage[:17]) + "\n" + " ".join(passage[17:])
        rows.append((2 * k + 1, prose(r, 20) + "\n\n" + wrapped + "\n \n" + prose(r, 20)))
    found = substring_dedup.repeated_paragraphs(docs(spark, rows)).collect()
    whole = {x["d"] for x in found if x["w1"] - x["w0"] == 51 and not x["first"]}
    assert len(whole) >= 38 and all(d % 2 for d in whole)


def test_own_paragraphs():
    lines = substring_dedup._lines("A b\nc\r\n \nd e f\n\n")
    assert substring_dedup.own_paragraphs(lines) == [(0, 2), (0, 3), (2, 3), (3, 6)]
    assert substring_dedup.own_paragraphs(substring_dedup._lines("a b\nc")) == [(0, 2), (2, 3)]


def test_no_word_is_removed_twice(spark, tmp_path):
    r = random.Random(15)
    near = [prose(r, 60).split() for _ in range(6)]
    rows = []
    for d in range(12):
        ps = [list(p) for p in near]
        for p in ps:
            p[r.randrange(60)] = f"x{d}"
        rows.append((d, "\n\n".join(" ".join(p[:30]) + "\n" + " ".join(p[30:]) for p in ps)))
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    for x in substring_dedup.op7_substring_dedup(spark, str(tmp_path)).collect():
        spans = [tuple(map(int, s.split(":"))) for s in x["removed"].split(",") if s]
        words = [w for a, b in spans for w in range(a, b)]
        assert len(words) == len(set(words)) == x["n_words_removed"] and len(spans) == x["n_removed"]
        assert x["doc_id"] == 0 and not words or x["doc_id"] and len(words) > 200


# --- 8 ---


def test_html_held_out_pages():
    pages = html_extract.training_pages(60, seed=77)
    right = wrong = missed = 0
    for html, good in pages:
        text = html_extract.main_text(html)
        right += sum(g in text for g in good)
        missed += sum(g not in text for g in good)
        wrong += sum(b.text in text and b.text not in good for b in html_extract.blocks(html))
    assert right / (right + missed) > 0.97 and wrong / right < 0.03


def test_html_odd_pages(spark):
    html = "<html><head><title>T</title><body><nav><a href=x>Home</a></nav><article><h1>Tom &amp; Jerry&#8217;s</h1><p>One  two<br>three.<p>Four <b>five</b> six seven eight.</article><script>var x='<p>no</p>'</script><footer>&copy; nobody</footer>"
    assert html_extract.main_text(html) == "Tom & Jerry’s One two three. Four five six seven eight."
    rows = [(1, "u", html), (2, "u", None), (2, None, ""), (None, "u", "<div>" * 3000 + "deep " * 50), (3, "u", "< not > html & &bogus; <p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract_text(df).collect()
    assert len(got) == 5 and {x["text"] for x in got if x["page_id"] == 2} == {""}
    assert html_extract.extract_text(df.limit(0)).count() == 0


PARAGRAPHS = [f"Paragraph {k} tells the reader something that matters, at some length, and ends with a full stop." for k in range(8)]
NAMES = ["", "information", "platform", "stock-report", "performance-text", "wrapper has-sidebar", "no-sidebar", "page comments-open", "container menu-open", "post"]


@pytest.mark.parametrize("name", NAMES)
def test_html_articles_in_elements_of_any_name(name):
    nav = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul></nav>"
    foot = "<footer>&copy; 2024 Example Media. All rights reserved.</footer>"
    story = "<h1>A heading of the story</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    want = " ".join(["A heading of the story", *PARAGRAPHS])
    for tag in ("div", "section"):
        for body in (story, story.replace("h1", "h2"), f"<article>{story}</article>"):
            around = lambda x, tag=tag: f'<{tag} class="{name}">{x}</{tag}>'
            assert html_extract.main_text(f"<body>{nav}{around(body)}{foot}</body>") == want
            assert html_extract.main_text(f"<body>{around(nav + body + foot)}</body>") == want


def test_html_hand_written_pages():
    """Pages in the manner of a blog, a shop's help page, a manual and a forum, not from the trainer's templates."""
    long = "The river rose overnight and by morning the lower road was under water, so the school bus took the hill instead."
    more = "Nobody in the village could remember a spring like it; the oldest photographs show the mill dry at this time of year."
    pages = [
        (f"<div id='page' class='site'><div class='site-header'><a href='/'>My Blog</a><p class='tagline'>Notes from the valley</p></div><div id='nav-main'><a href=/a>About</a> <a href=/b>Archive</a></div>"
         f"<div class='hentry'><h1>High water</h1><p>{long}</p><p>{more}</p><p>{long} Again.</p></div><div id='comments'><h3>3 thoughts</h3><ol><li class='comment'><p>{more} I agree with all of that and would add a few things of my own here.</p></li><li class='comment'><p>Great read, thank you, we had the same in our town last year and the year before that.</p></li><li class='comment'><p>First! Also, this comment is meant to be longer than the article itself, so it goes on and on for a while.</p></li></ol></div>"
         "<div class='colophon'>Powered by hand</div></div>", ["High water", long, more], ["thoughts", "agree", "Great read", "First!", "Powered", "Archive", "Notes from"]),
        (f"<table class=layout><tr><td><a href=1>Shop</a><br><a href=2>Cart</a><br><a href=3>Help</a></td><td><h2>How returns work</h2><p>{more}</p><ul><li>Print the label and stick it on the parcel.</li><li>Hand the parcel in at any post office within thirty days.</li></ul><p>{long}</p></td></tr></table><div class='cookie-bar'>We use cookies to improve your visit. <a href=c>Accept</a></div>",
         ["How returns work", more, "Print the label", "thirty days", long], ["Cart", "cookies"]),
        (f"<main><h1>Sums</h1><p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> of two numbers is taken digit by digit, from right to left.</p><pre>x = a + b</pre><p>{long}</p></main><aside class='toc'><a href=#1>Sums</a></aside><form action=/s><label>Search the manual</label></form>",
         ["a+b of two", "x = a + b", long], ["Search the manual"]),
    ]
    for html, kept, gone in pages:
        text = html_extract.main_text(html)
        assert all(k in text for k in kept) and not any(g in text for g in gone), text


def test_html_costs_grow_with_the_page():
    import time

    took = []
    for depth in (2_000, 8_000):
        began = time.perf_counter()
        html_extract.Page("<div>" * depth + "deep text " * 50 + "</b></div>" * depth)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.2


def test_minimum_cut_is_minimal():
    r = random.Random(12)
    for _ in range(40):
        n = r.randint(1, 8)
        gain = [r.uniform(-2, 2) for _ in range(n)]
        ties = [(i, j, r.uniform(0, 1)) for i in range(n) for j in range(i) if r.random() < 0.5]
        cost = lambda x: sum(max(g, 0) if not s else max(-g, 0) for g, s in zip(gain, x)) + sum(c for a, b, c in ties if x[a] != x[b])
        assert math.isclose(cost(html_extract.minimum_cut(gain, ties)), min(cost(x) for x in itertools.product([False, True], repeat=n)), abs_tol=1e-9)


# --- 9 ---


def test_top_k(spark, monkeypatch):
    r = np.random.default_rng(13)
    x = np.concatenate([r.normal(size=(700, 12)), r.normal(size=(700, 12)) * 0.05 + 3 * np.eye(12)[r.integers(0, 4, 700)]]).astype(np.float32)
    x[100:160] = x[100]
    n = len(x)
    odd = [(2001, None), (2050, [None] * 12), (2052, [float("nan")] * 12), (2100, [1.0, 2.0]), (2150, [0.5, 0.5]), (50, x[50].tolist()), (None, x[3].tolist()), (2200, [])]
    df = clash(spark.createDataFrame([*((k, x[k].tolist()) for k in range(n)), *odd], "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "x", "dim", "cell", "rank")}))
    units = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    want = [(2100, 1, 2150, 128 * 256 + 128 * 512), (2150, 1, 2100, 128 * 256 + 128 * 512)]
    for q in range(0, n, 50):
        scores = units @ units[q]
        best = sorted((c for c in range(n) if c != q), key=lambda c: (-scores[c], c))[:5]
        want += [(q, k, c, int(scores[c])) for k, c in enumerate(best, 1)]
    for cell_rows, tree_rows, query_rows in ((5_000, 20_000, 2_000), (100, 60, 3)):
        for name, value in (("CELL_ROWS", cell_rows), ("TREE_ROWS", tree_rows), ("QUERY_ROWS", query_rows), ("LEAF", 16)):
            monkeypatch.setattr(topk, name, value)
        got = sorted((q["query_id"], q["rank"], q["vec_id"], q["score"]) for q in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
        assert got == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_huge_components(spark):
    """Whole numbers beyond 53 bits are exact, scores beyond 64 bits the nearest number."""
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 5.0]), (3, [1e308, -1e308]), (50, [3e6 + 1 / 256, 2e6]), (51, [3e6, 2e6 + 1 / 256]), (52, [0.0, 0.0]), (53, [3e6, 2e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((q["query_id"], q["rank"], q["vec_id"], q["score"]) for q in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    most, units = 2**63 - 1, {i: [math.floor(256 * c) if abs(c) < 1e300 else int(c) for c in v] for i, v in rows}
    want = []
    for q in (0, 50):
        scores = {i: max(-most - 1, min(most, sum(a * b for a, b in zip(units[q], v)))) for i, v in units.items() if i != q}
        want += [(q, k, i, scores[i]) for k, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:5], 1)]
    assert got == want


def test_m_tree_leaves_pages_out():
    """In clusters most rows are never scored, and the results are those of a scan."""
    r = np.random.default_rng(14)
    x = np.floor(np.concatenate([r.normal(size=(500, 8)) + 40 * c for c in r.normal(size=(16, 8))]) * 256)
    space = topk.Space(float(np.abs(x).max()), 0.0)
    space.most = float(((x / space.unit) ** 2).sum(1).max())
    tree, scored = topk.MTree(space, np.arange(len(x)), x), []
    plain = tree._score
    tree._score = lambda page, mine, *rest: scored.append(len(mine) * int(np.diff(tree.row[page])[0])) or plain(page, mine, *rest)
    q, ids, scores = tree.search(x[::50], np.arange(len(x))[::50], 5)
    for k in range(len(x[::50])):
        every = (x @ x[k * 50]).astype(np.int64)
        best = sorted((c for c in range(len(x)) if c != k * 50), key=lambda c: (-every[c], c))[:5]
        assert sorted(zip((-scores[q == k]).tolist(), ids[q == k].tolist())) == [(-int(every[c]), c) for c in best]
    assert sum(scored) < 0.5 * len(x) * len(x[::50])


# --- 10 ---


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark):
    r = random.Random(14)
    base = [prose(r, 150) for _ in range(5)]
    rows = list(ODD)
    for k in range(60):
        w = r.choice(base).split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = "edit"
        rows.append((100 + k, " ".join(w)))
    got = simhash.simhash_components(clash(docs(spark, rows))).collect()
    fps = {}
    for i, t in rows:
        fps.setdefault(i, set()).add(brute_fingerprint(t))
    assert all(x["fp"] % 2**64 in fps[x["doc_id"]] for x in got) and len(got) == len(rows)
    ids = [x["doc_id"] for x in got]
    values = [x["fp"] % 2**64 for x in got]
    near = [(i, j) for i, j in itertools.combinations(range(len(got)), 2) if (values[i] ^ values[j]).bit_count() <= 3]
    root = groups(near, len(got))
    least = {}
    for k, c in enumerate(root):
        if ids[k] is not None:
            least[c] = min(least.get(c, 1 << 60), ids[k])
    assert all(x["component_id"] == least.get(c, x["doc_id"]) for x, c in zip(got, root))
    kept = [x["doc_id"] for x in simhash.drop_near_copies(clash(docs(spark, rows + rows[:30]))).collect()]
    assert len(kept) == len(set(root)) and set(kept) == {least.get(c) for c in set(root)}
    two = docs(spark, [(1, "a b c d e"), (1, "quite another text than that")])
    assert simhash.drop_near_copies(two).count() == 2 and simhash.drop_near_copies(docs(spark, [])).count() == 0
    assert simhash.simhash_components(docs(spark, [])).count() == 0


def test_trie_links_find_all(monkeypatch):
    r = np.random.default_rng(15)
    base = r.integers(0, 2**64, 20, dtype=np.uint64)
    values = set()
    for b in base:
        for _ in range(12):
            v = int(b)
            for bit in r.choice(48, r.integers(0, 5), replace=False):
                v ^= 1 << int(bit)
            values.add(v)
    values = np.array(sorted(values), np.uint64)
    near = [(i, j) for i, j in itertools.combinations(range(len(values)), 2) if int(values[i] ^ values[j]).bit_count() <= 3 and int(values[i]) >> 48 == int(values[j]) >> 48]
    assert groups(simhash.trie_links(values), len(values)) == groups(near, len(values))
    side = np.arange(len(values)) % 2
    cross = [(i, j) for i, j in near if side[i] != side[j]]
    assert groups(simhash.trie_links(values, side=side), len(values)) == groups(cross, len(values))


def test_simhash_hot_bucket(spark, monkeypatch):
    r = random.Random(16)
    monkeypatch.setattr(simhash, "HOT_ROWS", 20)
    values = list({(7 << 48) | sum(1 << b for b in r.sample(range(20), r.randint(0, 3))) for _ in range(150)})
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()
    at = {v: k for k, v in enumerate(values)}
    near = [(i, j) for i, j in itertools.combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= 3]
    assert groups([(at[x["u"]], at[x["v"]]) for x in links], len(values)) == groups(near, len(values))


# --- all of them as queries ---


@pytest.mark.parametrize("name", ["op2_decontaminate", "op3_line_dedup", "op5_mixture", "op9_top_k"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from stratagraph.llm import queries

    at = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        db.sql(f"create view {t} as select * from '{at}/{t}.parquet'")
    df = queries.queries()[name](spark, at)
    names = sorted(df.columns)
    want = db.sql(queries.oracle_sql()[name])
    order = [want.columns.index(n) for n in names]
    assert sorted(tuple(x[n] for n in names) for x in df.collect()) == sorted(tuple(x[k] for k in order) for x in want.fetchall())


def test_digests(spark):
    from stratagraph.llm import queries

    at, q = "/root/testdata/sf0.001", queries.queries()
    texts = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{at}/documents.parquet").collect()}
    for x in q["op4_pii"](spark, at).collect():
        spans = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base_spans(texts[x["doc_id"]]))
        assert x["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
    for x in q["op10_simhash"](spark, at).collect():
        assert x["fingerprint"] == f"{brute_fingerprint(texts[x['doc_id']]):016x}"
