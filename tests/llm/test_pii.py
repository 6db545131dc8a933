import hashlib
import random
import re

import pytest

from seawake.llm import pii
from tests.llm.helpers import documents, with_clashes

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


TEXTS = [
    "a@b.c x@y@z.com a@b.c@d.e é.f@g-h.org, @no.com no@no no@.no", "1.2.3.4.5.6.7.8 1.2.3 256.1.1.1 0001.02.3.4 1.2.3.4", "4539 1488 0343 6467 4539148803436468 12-3",
    "+1 (974) 555-3436 ++1 2345 67890 +1((", "", "+", "@", "0" * 30, "4539-1488-0343-6467 and 4539 1488 0343 6467", "ünï mail@ünï.de p%q+r@s.t",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_is_what_the_patterns_say(text):
    assert pii.find_spans(text) == plain_spans(text)


@pytest.mark.parametrize(
    "text, kind",
    [
        ("john (at) example (dot) com", "email"), ("john dot doe at example dot org", "email"), ("jоhn@exаmple.com", "email"), ("a\u200bb@c\u200b.com", "email"),
        ("192[.]168[.]1[.]1", "ip"), ("192 dot 168 dot 1 dot 1", "ip"), ("10 dot 0 dot 0 dot 7", "ip"), ("one nine two dot one six eight dot one dot one", "ip"), ("４５３９ 1488 0343 6467", "card"), ("4539 l488 O343 6467", "card"),
        ("four five three nine one four eight eight zero three four three six four six seven", "card"),
        ("plus one five five five one two three four five six seven", "phone"),
    ],
)
def test_disguises_are_mapped_back(text, kind):
    around = f"Wörter, x {text} y."
    added = pii.disguised_spans(around, pii.find_spans(around))
    assert [(pii.KINDS[k], around[s:e]) for s, k, e in added] == [(kind, text)]
    assert pii.masked(around) == f"Wörter, x [{kind.upper()}] y."


@pytest.mark.parametrize("text", ["look at example.com", "at one, two, three", "a dot on the map", "mail7 x86 l10n", "Zwei Null drei", "он дома 5", "plus ten", "1 + (2)"])
def test_clean_texts_stay(text):
    assert pii.disguised_spans(text, pii.find_spans(text)) == [] and pii.masked(text) == text


def test_query_columns(spark):
    texts = [*TEXTS, None, "john (at) example (dot) com", "x " * 200_000 + "a@b.cd"]
    got = {r["doc_id"]: r for r in pii.personal_data(with_clashes(documents(spark, texts))).collect()}
    for i, t in enumerate(texts):
        base = plain_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == n for s in base) for n in range(4)]
        assert set(filter(None, pii.written(base).split(","))) <= set(got[i]["spans"].split(","))
    assert got[len(TEXTS) + 1]["spans"] == "email:0:27"
    assert pii.personal_data(documents(spark, [])).count() == 0
    assert pii.personal_data(documents(spark, ["a@b.cd"] * 3).selectExpr("CAST(NULL AS LONG) AS doc_id", "text")).count() == 3


def test_mask_keeps_columns(spark):
    df = with_clashes(documents(spark, ["mail a@b.cd now", None, ""]))
    got = pii.mask_personal_data(df)
    assert got.columns == df.columns
    assert [(r["text"], r["n_chars"]) for r in got.orderBy("doc_id").collect()] == [("mail [EMAIL] now", 16), (None, None), ("", 0)]


@pytest.mark.parametrize(
    "text, kind",
    [
        ("+1 (four one five) 555-2671", "phone"), ("(four five three nine) 1488 0343 6467", None), ("ll4.oo7.1.2", "ip"), ("o4539 1488 0343 646", None),
        ("a@b\tdot\tcom", "email"), ("a@b \tdot \tcom", "email"), ("four/five", None), ("plus\tfour one five five five five two six seven one", "phone"),
        ("ſeven seven seven dot one dot one dot one", None), ("1.1.1.5İ", "ip"), ("ſix dot one one dot one dot one", "ip"), ("\"one nine two dot one dot one dot one\"", None),
    ],
)
def test_hints_do_not_depend_on_other_text(text, kind):
    def found(t):
        return [(pii.KINDS[k], t[s:e]) for s, k, e in pii.disguised_spans(t, pii.find_spans(t))]

    assert found(text) == found(text + "\n. dot .") and (kind is None or found(text)[0][0] == kind)


def test_texts_without_hint_are_not_rewritten():
    rng = random.Random(6)
    parts = [*"+([{<>}])@.,-/\"'_ \t\n\u200b", *"oiOIlL0715xı", " ", " ", " ", ", ", "dot", "DOT", "at", "At", "plus", "Plus", "point", "one", "Two", "fünf", "FÜNF", "zéro", "ſeven", "İ", "\u212a", "é", "word"]
    without = 0
    for _ in range(60_000):
        text = pii.fold("".join(rng.choices(parts, k=rng.randint(1, 9))))
        if not pii.has_hint(text.lower()):
            without += 1
            assert pii.normalise(text)[0] == text
    assert without > 10_000
