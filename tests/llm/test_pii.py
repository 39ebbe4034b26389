import hashlib
import random
import re
from collections import Counter, defaultdict
from functools import cache

import pytest
import regex
from conftest import SF_SMALL
from llm_fixture import no_documents, odd_documents, odd_texts
from possum.llm import pii
from pyspark.sql import functions as F

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "card":
        v = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 14 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in v) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "phone": 10 <= len(d) <= 15}[kind]


@cache
def brute(text):
    found = sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if valid(k, m[0]))
    spans = ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)
    return tuple(sum(k == x[2] for x in found) for k in BASE), spans


HARD = [
    (201, "a@b.c_d@e.f and x@y.zz. @@ a@b a@-.- é@é.é"), (202, "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3.4444 0001.02.3.255 256.1.1.1"),
    (203, "4111 1111 1111 1111-" + "1" * 5000 + " 4111-1111-1111-1111 é4111111111111111 4111  1111 1111 1111"),
    (204, "+1 (980) 555-6268 +1234 + +12 34567 8901 23" + "a" * 20000 + "@b.c"), (205, "9" * 30000), (206, "1." * 9000), (207, "+" * 3000 + "1"),
    (208, "a" * 50000), (209, "\U0001f600 x@y.zz \U0001f600 10.0.0.1"),
]


def test_base_spans_on_odd_and_hard_texts(spark):
    df = odd_documents(spark).select("doc_id", "text", "key").union(spark.createDataFrame([(*r, "k") for r in HARD], "doc_id long, text string, key string"))
    got = Counter((r.doc_id, (r.n_email, r.n_ip, r.n_card, r.n_phone), r.spans, r.base_sha256) for r in pii.find_personal_data(df).collect())
    assert got == Counter((i, *brute(t), hashlib.sha256(brute(t)[1].encode()).hexdigest()) for i, t in odd_texts() + HARD)


def test_base_spans_on_the_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    for r in pii.find_personal_data(docs).collect():
        base = ",".join(x for x in r.spans.split(",") if not x.startswith(pii.FOUND))
        assert ((r.n_email, r.n_ip, r.n_card, r.n_phone), base) == want[r.doc_id]


def test_patterns_discover_what_base_rules_miss(spark):
    rows = [(i, f"some words here then reach me at user{i}@mail.org thanks a lot") for i in range(8)]
    rows += [(100 + i, f"so reach me at UK-77{i}31-X, thanks {i}") for i in range(3)]
    rows += [(200 + i, f"the count was 88{i}31 units") for i in range(3)]  # an identifier's look, but no seed beside it
    rows += [(300, "again UK-77131-X elsewhere")]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(3):
        a = rows[8 + i][1].index("UK-")
        assert got[100 + i] == f"{pii.FOUND}:{a}:{a + len('UK-77031-X')}"
        assert got[200 + i] == ""
    assert got[300] == f"{pii.FOUND}:6:16"  # a known value, wherever it stands


def test_contexts_are_the_words_of_the_text(spark):
    rows = [(i, f"note office 12 mail user{i}@x.org") for i in range(8)] + [(100 + i, f"note office 12 mail UK-77{i}31-X") for i in range(3)]
    # seeds in a list of one, in a word, behind a long word and at the ends of a text
    rows += [(200, " \t 10.0.0.1 10.0.0.2,10.0.0.3  b7 (a@b.c) 4111 1111 1111 1111 z"), (201, f"q {'x' * 200} c@d.e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_context for r in pii.find_personal_data(df).collect()}
    assert got == {i: int(100 <= i < 103) for i, _ in rows}
    near = {(r.value, r.kind): (r.two or "", r.one or "", r.following or "") for r in pii._spans(df.where("doc_id >= 200"), "doc_id", "text")[1].where("kind <> 'token'").collect()}
    assert near == {
        ("10.0.0.1", "ip"): ("", "", "10.0.0.2,10.0.0.3"), ("10.0.0.2", "ip"): ("", "10.0.0.1", "b7"), ("10.0.0.3", "ip"): ("", "10.0.0.1", "b7"),
        ("4111 1111 1111 1111", "card"): ("b7", "(a@b.c)", "z"), ("a@b.c", "email"): ("10.0.0.2,10.0.0.3", "b7", "4111"), ("c@d.e", "email"): ("q", "x" * 200, ""),
    }


def test_rounds_go_on_until_nothing_is_found(spark):
    names = ("ant", "bee", "cat", "dog", "elk")
    ident = lambda c, i: f"{c}-77{i}31-X"
    rows = [f"x here ant mail user{i}@x.org" for i in range(3)] + [f"x here ant mail {ident('ant', i)}" for i in range(3)]
    rows += [f"x here {b} mail {ident(c, i)}" for a, b in zip(names, names[1:], strict=False) for c in (a, b) for i in range(3)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = pii.find_personal_data(df).collect()
    assert sum(r.n_context for r in got) == 3 + 6 * 4  # every mention of all 15 identifiers
    with pytest.raises(RuntimeError):
        pii.find_personal_data(df, rounds=3)


SHAPES = ["078 05 1120", "A-123", "johndoe_at_mail", "(555) 123-4567", "UK-77031-X"]


def test_instances_are_found_by_their_place(spark):
    rows = [(i, f"reach me at user{i}@mail.org") for i in range(8)] + [(100 + i, f"so reach me at {x}, thanks") for i, x in enumerate(SHAPES)]
    rows += [(200, "so reach me at home"), (201, "home is home 7")]  # a common word at the place stays
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df).where("doc_id >= 100").collect()}
    assert got == dict.fromkeys(range(100, 105), "so reach me at [CONTEXT], thanks") | dict(rows[-2:])
    limited = pii.find_personal_data(df, min_digits=5, min_length=10).where("doc_id between 100 and 104").orderBy("doc_id").collect()
    assert [r.n_context for r in limited] == [1, 0, 0, 1, 1]


def plain_discovery(texts, min_support=3, min_score=0.5):
    """Spans of every text by the docstring of the module, with plain loops."""
    space, rows = regex.compile(r"[\x20\x09-\x0D]+"), []
    for n, t in enumerate(texts):
        base = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in brute(t)[1].split(",") if s)]
        words = space.split(t)

        def add(kind, a, b, n=n, t=t, words=words):
            first, last = len(space.findall(t[:a])), len(space.findall(t[:b]))
            near = lambda i: words[i].lower() if 0 <= i < len(words) else ""
            two, one, following = near(first - 2), near(first - 1), near(last + 1)
            found = ([f"l:{two} {one}"] if two and one else []) + ([f"a:{one} _ {following}"] if one and following else [])
            rows.append((n, kind, a, b, t[a:b].lower(), frozenset(p for p in found if any(c.isalpha() for c in p[2:]))))

        for k, a, b in base:
            add(k, a, b)
        for m in regex.finditer(pii.PATTERNS["token"], t):
            a, b = m.start() + len(regex.search(pii.LEAD, m[0])[0]) if regex.search(pii.LEAD, m[0]) else m.start(), m.end() - len(regex.search(pii.TAIL, m[0])[0])
            if all(e <= a or b <= s for _, s, e in base):
                add("token", a, b)
    total = Counter(r[4] for r in rows if r[1] not in pii.KINDS)
    edges = defaultdict(set)
    for *_, v, patterns in rows:
        for p in patterns:
            edges[p].add(v)
    known = {r[4] for r in rows if r[1] in pii.KINDS}
    while True:
        good = {p for p, v in edges.items() if len(v & known) >= min_support and len(v & known) >= min_score * len(v)}
        at_good = Counter(r[4] for r in rows if r[1] not in pii.KINDS and r[5] & good)
        fresh = {v for v, n in at_good.items() if n >= min_score * total[v]} - known
        if not fresh:
            break
        known |= fresh
    seeds = {r[4] for r in rows if r[1] in pii.KINDS}
    return [sorted((a, b) for m, kind, a, b, v, _ in rows if m == n and kind not in pii.KINDS and v in known - seeds) for n in range(len(texts))]


def planted(seed, n=250):
    """Texts with identifiers at the places of base entities, and the (text, start, end) of the planted ones."""
    r, texts, true = random.Random(seed), [], set()
    words = [a + b for a in ("lo", "mi", "ka", "tu", "re") for b in ("na", "so", "vel", "dra", "pin")]
    for i in range(n):
        body = " ".join(r.choices(words, k=r.randint(3, 12)))
        lead = r.choice(["please call me at", "my account is", "write to", "the total of", "on page"])
        base = r.choice([f"u{i}@mail.org", f"+1 (980) 555-{1000 + i}", f"10.0.{i % 250}.{i % 99}"])
        other = r.choice([f"{100 + i % 900} {10 + i % 90} {1000 + i}", f"{r.choice('ABC')}-{100 + i}", f"who{r.choice(words)}_{r.choice(words)}_{r.choice(words)}", f"({200 + i}) 555-{1000 + i}"])
        if lead in ("the total of", "on page"):
            end = str(r.randint(1, 40))  # numbers at places without seeds
        else:
            end = base if r.random() < 0.7 else other
        texts.append(f"{body} {lead} {end}{r.choice(['', ',', '.'])} {r.choice(words)}")
        if end == other and end != base:
            a = len(f"{body} {lead} ")
            true.add((i, a, a + len(end)))
    return texts, true


def test_discovery_on_planted_identifiers(spark):
    texts, true = planted(4)
    got = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    spans = {i: sorted((int(a), int(b)) for k, a, b in (x.split(":") for x in s.split(",") if x) if k == pii.FOUND) for i, s in got.items()}
    assert spans == dict(enumerate(plain_discovery(texts)))
    found = {(i, a, b) for i, s in spans.items() for a, b in s}
    assert len(found & true) >= 0.95 * len(true) and len(found & true) >= 0.95 * len(found)


def test_discovery_on_the_table(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.n_context for r in pii.find_personal_data(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).collect()}
    assert got == {r.doc_id: len(s) for r, s in zip(rows, plain_discovery([r.text or "" for r in rows]), strict=True)}


def test_redaction(spark):
    df = odd_documents(spark)
    out = pii.redact(df, count_col="n_chars")
    assert out.schema.names == df.schema.names
    got = {r.doc_id: r for r in out.where("doc_id in (1, 2, 6, 17)").collect()}
    assert got[17].text == "mail [EMAIL], [IP] or [PHONE]; card [CARD]." and got[17].n_chars == len(got[17].text)
    assert got[1].text is None and got[2].text == "" and got[6].text == dict(odd_texts()[:8])[6]
    assert out.count() == df.count()
    hard = pii.redact(spark.createDataFrame(HARD, "doc_id long, text string"))
    for r in hard.collect():
        want, at = "", 0
        for s in filter(None, brute(dict(HARD)[r.doc_id])[1].split(",")):
            k, a, b = s.split(":")
            if int(b) > at:
                want += dict(HARD)[r.doc_id][at : max(at, int(a))] + f"[{k.upper()}]"
                at = int(b)
        assert r.text == want + dict(HARD)[r.doc_id][at:]


def test_empty(spark):
    assert pii.find_personal_data(no_documents(spark)).count() == 0
    assert pii.redact(no_documents(spark)).count() == 0
    plain = spark.createDataFrame([(1, "no data")], "doc_id long, text string")
    assert pii.redact(plain).select(F.col("text")).first()[0] == "no data"
