"""Personal data in more forms, licence rules, and very long texts."""

import ipaddress
import time

import pytest

from panelworks.llm import licenses, pii


def none(kind, value):
    return None


@pytest.mark.parametrize("text, kinds", [
    ("MR JOHN SMITH came. John Smith left.", ["person", "person"]),
    ("Miss Eva Stone, Prof. Paul Rivers, Doctor Anna Marsh and mr. John Doe", ["person"] * 4),
    ("Mr 山田太郎 said so. 山田太郎 left", ["person", "person"]),
    ("3782 822463 10005 or 378282246310005", ["card", "card"]),
    ("IBAN DE89 3704 0044 0532 0130 00, that is DE89370400440532013000", ["iban", "iban"]),
    ("2001:db8::ff00:42:8329 or 2001:0DB8:0:0:0:FF00:0042:8329", ["ipv6", "ipv6"]),
])
def test_forms_are_found_and_mentions_of_one_share_a_surrogate(text, kinds):
    found = pii.find(text)
    new, spans = pii.rewrite(text, b"k", none)
    assert [m.kind for m in found] == kinds == [s["kind"] for s in spans]
    for m, s in zip(found, spans):
        old = text[m.start : m.end]
        assert old not in new and s["surrogate"] != old
        if m.kind != "person":
            assert len(old) == len(s["surrogate"]) and [c.isdigit() or c.isalpha() for c in old] == [c.isdigit() or c.isalpha() for c in s["surrogate"]]
    if len(set(m.value for m in found)) == 1:
        plain = {"".join(c for c in s["surrogate"].casefold() if c.isalnum()) for s in spans}
        assert len(plain) == 1 or kinds[0] == "ipv6"


def test_checks_hold_and_others_stay():
    new, spans = pii.rewrite("GB82WEST12345698765432", b"k", none)
    assert new[:2] == "GB" and pii._sound_iban(new) and new[4:8].isalpha() and new[8:].isdigit()
    assert pii.rewrite("DE89 3704 0044 0532 0130 01", b"k", none)[1][0]["kind"] == "card"  # the check fails, so it is no account
    _, spans = pii.rewrite("2001:db8::ff00:42:8329 2001:0DB8:0:0:0:FF00:0042:8329", b"k", none)
    assert len({ipaddress.ip_address(s["surrogate"]) for s in spans}) == 1
    for text in ("at 12:30:45", "00:1A:2B:3C:4D:5E", "std::vector", "I miss Paris", "AB12 CDEF GHIJ", "Mr said so"):
        assert pii.rewrite(text, b"k", none) == (text, [])


def test_mail_keeps_its_form_and_domains_stay_together():
    new, _ = pii.rewrite("john.smith-99@corp.co.uk ANN@CORP.CO.UK a@other.de", b"k", none)
    a, b, c = new.split()
    form = lambda x: "".join("9" if ch.isdigit() else "a" if ch.isalpha() else ch for ch in x)
    assert form(a.split("@")[0]) == "aaaa.aaaaa-99" and a.split("@")[1] == b.split("@")[1].lower() != c.split("@")[1]
    assert b.isupper() and a.endswith(".example") and a.split("@")[1].count(".") == 2
    assert len({pii.surrogate_value("email", "a@b.de", b"k", n) for n in range(pii.ATTEMPTS)}) > 50


def slow_rules(found):
    """Each rule in turn, from each place on, over what is left."""
    left, hits = list(found), []
    for name, ids in licenses.RULES:
        at = 0
        while at < len(left):
            taken = []
            for i in range(at, len(left)):
                if taken and left[i][0] - left[taken[-1]][0] > licenses.GAP + 1:
                    break
                if left[i][1] == ids[len(taken)] and (taken or i == at):
                    taken.append(i)
                    if len(taken) == len(ids):
                        break
            if len(taken) == len(ids):
                hits.append((name, [left[i][1] for i in taken], left[taken[0]][0], left[taken[-1]][0]))
                left = [x for i, x in enumerate(left) if i not in taken]
            else:
                at += 1
    return sorted(hits, key=lambda h: (h[2], h[0]))


def test_rules_against_a_plain_search():
    import random

    r, names = random.Random(3), sorted({i for _, ids in licenses.RULES for i in ids})
    for k in range(800):
        place, found = 0, []
        for _ in range(r.randrange(40)):
            place += r.choice([1, 1, 1, 2, 3, 6])
            found.append((place, r.choice(names[:5] if k % 2 else names)))
        got = [(h["license"], h["sentences"], h["first"], h["last"]) for h in licenses.match_rules(found)]
        assert got == slow_rules(found)


def test_very_long_texts_take_time_in_proportion():
    began = time.time()
    assert len(licenses.match_rules(licenses.known_sentences("All rights reserved.\n" * 50_000)[0])) == 50_000
    given = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(20_000)]
    text = " ".join(f"Mr {g.capitalize()} Smith came." for g in given) + " Smith left." * 1000
    found = pii.find(text)
    assert len(found) == 21_000 and found[-1].value == f"{given[-1]} smith"  # the one named last
    assert time.time() - began < 30


def test_language_model_bounds_its_labels(spark, monkeypatch):
    from panelworks.llm import langid

    rows = [(i, f"{w} some words of language {w} number {i % 7}", w) for i in range(60) for w in ("ab", "cd", "ef")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert set(model.languages) == {"ab", "cd", "ef"}
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError):
        langid.fit(docs)
