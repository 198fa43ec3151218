"""Personal data: patterns against plain regular expressions, disclosing terms against counting by hand."""

import hashlib
import math
import random
import re
import time

import pytest

from refloom.llm import sanitise
from tests.llm.test_brute import EDGE, _key, docs, edge, edge_dir  # noqa: F401

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(map(int, str(2 * int(c)))) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


def brute_base(text):
    out = []
    for k, kind in enumerate(PLAIN):
        for m in re.finditer(PLAIN[kind], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{sanitise.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def test_patterns_on_random_texts():
    rng = random.Random(4)
    for _ in range(30_000):
        text = "".join(rng.choice(["1", "2", "55", "0", ".", ".", "-", " ", "+", "(", ")", "@", "@", "a", "B.c", "é", "\n", "4465758382889437", "%", "_", "x@y.z"]) for _ in range(rng.randrange(26)))
        assert sanitise.base_spans(text) == brute_base(text), text


@pytest.mark.parametrize("unit", ["1", "a", "a.", "@", "a@", "1.", "1.2.3.4 ", "+1", "+1(", "1 ", "-", "x@y.", "+", "é@"])
def test_long_texts_take_linear_time(unit):
    text = unit * (1_000_000 // len(unit))
    began = time.process_time()
    sanitise.base_spans(text)
    list(sanitise.contexts(text[:100_000]))
    assert time.process_time() - began < 8


def test_luhn():
    assert all(sanitise.luhn(str(n)) == luhn(str(n)) for n in range(3000))


def test_query(spark, small, docs):  # noqa: F811
    got = sanitise.op13_personal_data(spark, small).collect()
    want = []
    for i, t, *_ in docs:
        b = brute_base(t)
        want.append((i, *(sum(k == x for _, x, _ in b) for k in range(4)), digest(b)))
    assert _key((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == _key(want)
    assert all(digest([(int(a), sanitise.KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s) if k != "term"]) == r["base_sha256"] for r in got)


def test_query_on_edge_rows(spark, edge_dir):  # noqa: F811
    got = sanitise.op13_personal_data(spark, edge_dir)
    assert got.count() == len(EDGE) and {r["spans"] for r in got.collect()} == {""}


def _corpus():
    """Prose of made-up words; "Zorblat Quindle" stands near one address in five texts and alone in a sixth, "Vexomar" near another in texts that are
    near copies of each other, "common" everywhere, "halfway" near the address in three of many places."""
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(3, 8))) for _ in range(n))
    rows = []
    for _ in range(5):
        rows.append(f"{prose(30)} so Zorblat Quindle, common, asked z.q@mail.example.org for it {prose(30)}")
    for _ in range(3):
        rows.append(f"{prose(40)} halfway common z.q@mail.example.org {prose(40)}")
    rows.append(f"{prose(20)} it was (Zorblat Quindle!) who left common {prose(20)}")
    rows += [f"{prose(60)} common halfway {prose(9)}" for _ in range(60)]
    copy = f"{prose(60)} Vexomar wrote from 10.20.30.40 about {prose(60)}".split(" ")
    for _ in range(40):
        c = list(copy)
        c[rng.randrange(len(c) // 3)] = prose(1)
        rows.append(" ".join(c))
    passage = f"{prose(25)} ask Pimwick at +1 (555) 555-0101 {prose(25)}"
    rows += [f"{prose(30)} {passage} {prose(30)}" for _ in range(10)]
    return [(i, t, "z") for i, t in enumerate(rows)] + [(None, None, None), (200, "", "z"), (0, rows[0], "z"), (0, rows[0], "z")]


def brute_shares(texts, window=sanitise.WINDOW):
    """(term, entity): how often the term stands near the entity, how often at all, and the words near the entity; of all words the number."""
    near, total, size, words_in_all = {}, {}, {}, 0
    for t in texts:
        spans = brute_base(t)
        found = [(m.start(), m.end(), m[0]) for m in re.finditer(sanitise.WORD if hasattr(sanitise, "WORD") else r"[^\x20\x09-\x0D]+", t or "")]
        words_in_all += len(found)
        clean = [re.sub(r"^[\W_]+|[\W_]+$", "", w).lower() for *_, w in found]
        clean = [w if len(w) >= 3 else "" for w in clean]

        def terms(words, i):
            return ([words[i]] if words[i] else []) + ([f"{words[i]} {words[i + 1]}"] if words[i] and i + 1 < len(words) and words[i + 1] else [])

        for i in range(len(found)):
            for x in terms(clean, i):
                total[x] = total.get(x, 0) + 1
        held = [any(a < e and s < b for a, _, b in spans) for s, e, _ in found]
        free = ["" if h else w for h, w in zip(held, clean, strict=True)]
        places = {}
        for a, k, b in spans:
            first, last = sum(e <= a for _, e, _ in found), sum(s < b for s, _, _ in found)
            places.setdefault(sanitise.entity(k, t[a:b]), set()).update([*range(max(0, first - window), first), *range(last, min(len(found), last + window))])
        for c, at in places.items():
            each = [x for i in at for x in terms(free, i)]
            size[c] = size.get(c, 0) + len(each)
            for x in each:
                near[x, c] = near.get((x, c), 0) + 1
    return near, total, size, words_in_all


def test_disclosing_terms(spark, monkeypatch):
    rows = _corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, found string").selectExpr("*", "1 AS term", "2 AS row", "3 AS id", "4 AS _spans")
    got = {r["term"]: r for r in sanitise.disclosing_terms(df).collect()}
    assert {"zorblat", "quindle", "zorblat quindle"} <= set(got)
    assert not {"vexomar", "pimwick", "common", "wrote from"} & set(got)  # one text's copies, one passage's copies, and no secret
    near, total, size, n = brute_shares([t for _, t, _ in rows])
    for term, r in got.items():
        c = r["entity"]
        assert (r["n_both"], r["n_term"]) == (near[term, c], total[term])
        assert r["share"] == pytest.approx(1 - math.log2(min(1, near[term, c] / total[term])) / math.log2(size[c] / n)) and r["share"] >= sanitise.DISCLOSURE
    # no entity's share reaches the bound for a term that is missing, where contexts suffice
    for term in ("halfway", "common"):
        c = "email:z.q@mail.example.org"
        assert 1 - math.log2(near[term, c] / total[term]) / math.log2(size[c] / n) < sanitise.DISCLOSURE or term in got

    want = {}
    found = sanitise.find(df)
    for r in found.collect():
        t, spans = r["text"] or "", [(s["kind"], s["start"], s["end"]) for s in r["_spans"]]
        assert [s for s in spans if s[0] != "term"] == [(sanitise.KINDS[k], a, b) for a, k, b in brute_base(t)]
        want.setdefault(r["doc_id"], []).append(spans)
        assert [t[a:b] for k, a, b in spans if k == "term" and t[a:b].startswith("Zor")] == [x for x in ("Zorblat", "Zorblat Quindle") if x in t]
    assert found.columns == ["doc_id", "text", "found", "term", "row", "id", "_spans"] and sum(map(len, want.values())) == len(rows)

    # the same by a shuffle
    before = _key((r["doc_id"], r["text"], [tuple(s) for s in r["_spans"]]) for r in found.collect())
    monkeypatch.setattr(sanitise, "BROADCAST_TERMS", 0)
    assert _key((r["doc_id"], r["text"], [tuple(s) for s in r["_spans"]]) for r in sanitise.find(df).collect()) == before


def test_rewritten_texts(spark):
    df = spark.createDataFrame(_corpus(), "doc_id long, text string, found string")
    out = {r["doc_id"]: r["text"] for r in sanitise.sanitise(df).collect()}
    assert out[None] is None and out[200] == ""
    text = " ".join(out[i] for i in range(6))
    assert "[email]" in out[0] and "Zorblat" not in text and "z.q@" not in text and "it was (" in " ".join(t for t in out.values() if t)
    assert sanitise.rewritten("ask Bo 12 at x@y.zz", [(4, 6, "term", False), (4, 9, "term", False), (7, 9, "term", True), (13, 19, "email", False)]) == "ask [name] at [email]"


def test_nothing_in_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sanitise.find(df).collect() == [] and sanitise.sanitise(df).collect() == [] and sanitise.disclosing_terms(df).collect() == []
