import random
import re
import time

from larkspur.llm import licenses
from larkspur.llm.queries import op5_licenses
from tests.llm.fixtures import TEXTS, documents, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def base(text):
    words = WORD.findall((text or "").translate(LOWER))
    found = [(i, label) for p, label in licenses.EXACT.items() for q in [p.split()] for i in range(len(words) - len(q) + 1) if words[i : i + len(q)] == q]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_query_base(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = op5_licenses(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(docs[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_exact_places():
    s = licenses.Scanner(licenses.NOTICES, licenses.EXACT)
    for text in ("MIT License; mit-license MIT\nLICENSE cc by cc by", "İMIT license", "gnu General\x00Public License apache license é", "xmit license"):
        folded, n = s.fold(text)
        places = s.exact_places(folded)
        want = base(text)
        assert (n, len(places), min((w for w, _ in places), default=None), max((w for w, _ in places), default=None)) == want[:4]


def test_edits_within_the_bound_are_found_and_no_more():
    s = licenses.Scanner(licenses.NOTICES, licenses.EXACT)
    notice = "permission is hereby granted free of charge to any person obtaining a copy"
    allowed = len(notice) // licenses.CHARS_PER_EDIT
    for edits in range(allowed + 4):
        text = list(notice)
        for k in range(edits):
            text[k * 8 + 2] = "#" if text[k * 8 + 2] == " " else "q"
        changed = "".join(text)
        folded, _ = s.fold(f"some words before {changed} and after")
        found = [x for x in s.spans(folded) if x[2] == "mit"]
        real = sum(a != b for a, b in zip(s.fold(changed)[0], s.fold(notice)[0])) if len(s.fold(changed)[0]) == len(s.fold(notice)[0]) else None
        if real is not None:
            assert bool(found) == (real <= allowed)
            if found:
                assert folded[found[0][0] : found[0][1]] == s.fold(changed)[0].strip() and found[0][3] == real


def test_clean_words_have_no_labels():
    s = licenses.Scanner(licenses.NOTICES, licenses.EXACT)
    assert s.spans(s.fold("the apache helicopter has a license to fly in public and the mit campus releases papers")[0]) == []


def test_odd_documents(spark):
    out = licenses.scan(documents(spark)).collect()
    assert len(out) == len(TEXTS)
    for r in out:
        assert r["found_"]["n_words"] == base(r["text"])[0] and r["found"] == "found"
    assert licenses.scan(empty(spark)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(corner + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def word_runs(folded, notice, allowed):
    """(start, end) -> edits of all runs of whole words within the bound, by brute force."""
    cuts = [k for k, c in enumerate(folded) if c == " "]
    runs = [(a + 1, b) for a in cuts for b in cuts if abs(b - a - 1 - len(notice)) <= allowed and b > a + 1]
    return {r: d for r in runs if (d := distance(folded[slice(*r)], notice)) <= allowed}


def edited(rng, notice, kinds):
    text = list(notice)
    for kind in kinds:
        k = rng.randrange(len(text))
        text[k : k + (kind != "insert")] = {"insert": ["rdq "[rng.randrange(4)]], "delete": [], "change": ["q"]}[kind]
    return "".join(text)


def test_all_edits_against_brute_force():
    rng = random.Random(5)
    s = licenses.Scanner(licenses.NOTICES, licenses.EXACT)
    for notice in licenses.NOTICES:
        allowed = len(notice) // licenses.CHARS_PER_EDIT
        one = licenses.Scanner({notice: "x"}, {})
        for _ in range(40):
            kinds = [[rng.choice(["insert", "delete", "change"]) for _ in range(rng.randrange(allowed + 2))] for _ in range(2)]
            text = f"see {edited(rng, notice, kinds[0])} {rng.choice(['', 'or ', 'and some more words of '])}{edited(rng, notice, kinds[1])} by us"
            folded, _ = s.fold(text)
            want = word_runs(folded, notice, allowed)
            found = one.spans(folded)
            assert all(want[a, b] == e for a, b, _, e, _ in found)
            # none overlap, and every run within the bound is reported or overlaps one that is no worse
            assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))
            assert all(any(a < d and c < b and e <= n for c, d, _, e, _ in found) for (a, b), n in want.items())
            assert {x[:2] for x in found} <= {x[:2] for x in s.spans(folded)}


def told(text):
    s = licenses.Scanner(licenses.NOTICES, licenses.EXACT)
    folded, _ = s.fold(text)
    return [(folded[a:b], label, e) for a, b, label, e, _ in s.spans(folded)]


def test_an_edit_at_the_end_of_a_word():
    assert told("see: All rights reserverd. by us") == [("all rights reserverd", "all-rights-reserved", 1)]


def test_neighbours_are_told_one_by_one():
    assert told("GNU General Public Licence / GNU General Public License") == [("gnu general public licence", "gpl", 1), ("gnu general public license", "gpl", 0)]
    assert told("Apache Licence; Apache License") == [("apache licence", "apache", 1), ("apache license", "apache", 0)]
    assert told("under the Apache Licence and Apache licensees") == [("apache licence", "apache", 1)]


def test_very_many_hits_take_time_in_proportion():
    s = licenses.Scanner({"apache license": "apache"}, licenses.EXACT)
    took = []
    for n in (2_000, 16_000):
        folded, words = s.fold("MIT License, Apache Licence or Apache License. " * n)
        began = time.process_time()
        places, spans = s.exact_places(folded), s.spans(folded)
        took.append(time.process_time() - began)
        assert words == 7 * n and len(places) == 2 * n and len(spans) == 2 * n
        assert places[0] == (0, "mit") and places[-1] == (7 * n - 2, "apache")
    assert took[1] < 16 * took[0] + 1
