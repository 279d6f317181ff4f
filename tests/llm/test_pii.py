import random
import re

import pytest
from helpers import AWKWARD, stored

from usagelens.llm.pii import KINDS, base_spans, personal_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(digits[::-1])]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub(r"[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


@pytest.mark.parametrize("seed", range(40))
def test_base_equals_the_patterns(seed):
    random.seed(seed)
    parts = ["a.b@c.de", "@", "x@y", "@c.de", "1.2.3.4", "300.1.1.1", "0001.2.3.255", "4111 1111-1111 1111", "+1 (017) 555-7713", "+", " ", ".", "-", "é", "9", "4111111111111111", "\n", "a", "+4930123456789"]
    text = "".join(random.choice(parts) for _ in range(60))
    assert sorted(base_spans(text), key=lambda s: (s[0], s[2])) == plain(text)


def test_contexts_discover_unseen_identifiers(spark, tmp_path):
    rows = [(i, f"Some words. Please write to user{i}@mail{i % 7}.example.com today, thanks.", "en", "a") for i in range(40)]
    rows += [(100, "Please write to someone@localhost today, thanks.", "en", "a"), (101, "Version 20240101 was released, code 4444.", "en", "a")]
    # In this context half of the numbers are no cards: not to be trusted.
    rows += [(200 + i, f"order number {'4111111111111111' if i % 2 else 1000000000000000 + 7 * i} paid", "en", "a") for i in range(40)]
    got = {r.doc_id: r for r in personal_data(stored(spark, tmp_path, rows)).collect()}
    start = rows[40][1].index("someone")
    assert got[100].spans == f"email:{start}:{start + len('someone@localhost')}" and got[100].n_email == 0
    assert got[100].found[0].learned
    assert got[101].spans == ""
    assert all(not m.learned for i in range(40) for m in got[200 + i].found)
    assert got[3].spans.startswith("email:") and got[3].n_email == 1


def test_hidden_identifiers_are_found_by_context(spark, tmp_path):
    """A third of the numbers is written as no fixed pattern has it. Recall and precision are those of finding them."""
    random.seed(11)
    filler = "river stone field paper window garden little green summer morning".split()

    def around(middle):
        return " ".join(random.choices(filler, k=6)) + f" {middle} " + " ".join(random.choices(filler, k=5))

    rows, hidden = [], {}
    for i in range(240):
        cue = random.choice(["please call me at {}", "phone: {}", "reach us by telephone {} daily"])
        if i % 3:
            value = f"+44 20 {random.randrange(1000, 9999)} {random.randrange(1000, 9999)}"
        else:
            value = random.choice(["020 {} {}", "(030) {} {}"]).format(random.randrange(1000, 9999), random.randrange(1000, 9999))
        text = around(cue.format(value))
        rows.append((i, text, "en", "a"))
        if not i % 3:
            hidden[i] = (text.index(value), text.index(value) + len(value))
    for i in range(240, 480):  # numbers that are none, in contexts of their own
        rows.append((i, around(random.choice(["invoice no {}", "in the year {}", "sold {} pieces"]).format(random.randrange(1000, 99_999_999))), "en", "a"))
    got = {r.doc_id: r for r in personal_data(stored(spark, tmp_path, rows)).collect()}
    learned = {(i, (m.start, m.end)) for i, r in got.items() for m in r.found if m.learned and m.kind == 3}
    right = learned & set(hidden.items())
    assert len(right) / len(hidden) >= 0.9 and len(right) / len(learned) >= 0.95
    assert not any(m.learned for i, r in got.items() if i >= 240 for m in r.found)


def test_what_is_found_leads_to_further_contexts(spark, tmp_path):
    """The second context holds no seed of the base, only numbers that the first one tells."""
    numbers = [f"07{i:03d} {1000 + 37 * i}" for i in range(12)]
    rows = [(i, f"The lake is calm. Dial now +4930123{i:05d} for help.", "en", "a") for i in range(60)]
    rows += [(100 + i, f"The lake is calm. Dial now {n} for help.", "en", "a") for i, n in enumerate(numbers[:10])]
    rows += [(200 + i, f"Old friends wrote: mobile {n} or come by.", "en", "a") for i, n in enumerate(numbers)]
    got = {r.doc_id: r for r in personal_data(stored(spark, tmp_path, rows)).collect()}
    assert all([m.learned for m in got[100 + i].found] == [True] for i in range(10))
    assert all([m.learned for m in got[200 + i].found] == [True] for i in range(12))


def test_ties_go_to_the_kind_that_is_listed_first(spark, tmp_path):
    """One number stands in two contexts of equal confidence."""
    rows = [(i, f"server {10 + i}.1.2.3 up", "en", "a") for i in range(20)] + [(50 + i, f"dotted +49.30.{10000000 + i} up", "en", "a") for i in range(20)]
    rows += [(100, "server 7.22.333 up", "en", "a"), (101, "dotted 7.22.333 up", "en", "a")]
    one, two = ({r.doc_id: r.spans for r in personal_data(stored(spark, tmp_path, rows)).collect()} for _ in range(2))
    assert one == two and one[100].startswith("ip:")


def test_awkward_rows_and_empty_table(spark, tmp_path):
    rows = AWKWARD + [(50, "9" * 5000 + "@" * 50 + "1." * 3000, "en", "a")]
    got = personal_data(stored(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows)
    assert all(r.spans == "" and r.found == [] for r in got if r.doc_id in (1, 2, 3))
    assert personal_data(stored(spark, tmp_path, [])).collect() == []
