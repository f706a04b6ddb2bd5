"""Base patterns against re, the field on sentences it hasn't seen, and redaction."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import crf, pii


def brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if low <= len(d) <= high and (kind == 3 or pii.luhn(d)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.text("a0.1@-+ (2).%é4", max_size=40))
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def test_parts_of_an_address_with_many_zeros():
    zeros = "0" * 5000
    assert pii.base_spans(zeros + "1.2.3.4") == [(0, 1, 5007)] and pii.base_spans(f"1.{zeros}.2.{zeros}256") == []


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "@" * 100_000, "a@" * 50_000, "+1" * 50_000):
        pii.base_spans(text)


def test_field_on_unseen_sentences():
    """Spans found in a table of another seed, by the field alone with its kinds' checks."""
    table = pii.labelled_table(300, seed=77)
    right = wrong = missed = 0
    for (words, labels), found in zip(table, pii.field_spans(pii.train(), [" ".join(w) for w, _ in table]), strict=True):
        text, want, at = " ".join(words), set(), 0
        for k, (w, label) in enumerate(zip(words, labels, strict=True)):
            if label % 2:
                end = k + 1
                while end < len(words) and labels[end] == label + 1:
                    end += 1
                stop = at + len(" ".join(words[k:end]))
                a, b = pii._trim(text[at:stop])
                want.add((at + a, label // 2, at + b))
            at += len(w) + 1
        right, wrong, missed = right + len(want & set(found)), wrong + len(set(found) - want), missed + len(want - set(found))
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.95


def test_long_stretches_are_decoded_whole():
    r = random.Random(5)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    contacts = "\n".join(f"name ({n(3)}) {n(3)}-{n(4)}" for _ in range(2000))
    mixed = " ".join(" ".join(words) for words, _ in pii.labelled_table(1500, seed=3))
    numbers = " ".join(n(r.randint(1, 5)) for _ in range(4000))
    model = pii.train()
    for text, found in zip((contacts, mixed, numbers), pii.field_spans(model, [contacts, mixed, numbers]), strict=True):
        want = []
        for s in pii.neighbourhoods(text):
            features, lengths = pii._padded([pii._features([text[a:b] for a, b in s])])
            want += pii._spans_of(text, s, crf.viterbi(model, features, lengths)[0].tolist())
        assert sorted(found) == sorted(want)
    assert max(map(len, pii.neighbourhoods(contacts))) == 6000
    phones = [(m.start(), 3, m.end()) for m in re.finditer(r"\(\d{3}\) \d{3}-\d{4}", contacts)]
    assert pii.all_spans(model, [contacts])[0][1] == phones
    assert pii.redacted(contacts, phones) == "\n".join(["name <phone>"] * 2000)


def test_long_runs_of_numbers_take_linear_time():
    assert pii.field_spans(pii.train(), ["1 " * 50_000, "1234 " * 50_000])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("1234567890", min_size=1, max_size=6), min_size=1, max_size=40))
def test_groups_of_digit_words(words):
    """The vectorised groups against the rule told plainly."""
    fine = lambda some: 12 <= sum(map(len, some)) <= 19 and pii.luhn("".join(some))
    want, k = [], 0
    while k < len(words):
        ends = [*([len(words)] if fine(words[k:]) else []), *(e for e in range(k + 1, min(k + 20, len(words))) if fine(words[k:e]))]
        want.append((ends[0] - k if ends else 1, bool(ends)))
        k += want[-1][0]
    assert list(pii._card_groups(words)) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["one", "two", "1", "22", "a1"]), max_size=700))
def test_a_phone_is_found_whatever_stands_before(before):
    text = " ".join([*before, "call me at (643) 555-5742 or so"])
    at = text.index("(643)")
    assert (at, 3, at + 14) in pii.field_spans(pii.train(), [text])[0]


def test_shapes_read_whole_words():
    assert pii._shape("#" * 100 + "1") != pii._shape("#" * 100 + "a")


def test_documents(spark, hard, no_documents):
    rows = [(1, "call +1 (643) 555-5742, or (643) 555-5742 now"), (2, None), (3, "x 4111 1111 1111 1111 4111111111111111 y"), (4, "mail a.b@c.example.com. id 9482738473829384"), (4, "a@b.co"), (5, "nothing here")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, spans string")
    got = pii.find_pii(df).collect()
    for r, (_, text) in zip(sorted(got, key=lambda r: (r["doc_id"], -len(r["spans"]))), rows, strict=True):
        base = brute(text or "")
        assert r["base_sha256"] == hashlib.sha256(pii.render(base).encode()).hexdigest()
        assert set(pii.render(base).split(",")) - {""} <= set(r["spans"].split(","))
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_phone"] == 2 and by[3]["n_card"] >= 1 and by[5]["spans"] == "" and by[2]["n_email"] == 0
    assert pii.find_pii(hard).count() == hard.count() and pii.find_pii(no_documents).count() == 0
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).where("doc_id <> 4").collect()}
    assert clean[1] == "call <phone>, or <phone> now" and clean[2] is None and clean[5] == "nothing here"
    assert pii.redact(df).columns == df.columns and pii.redact(no_documents).count() == 0


def test_query_counts_base_spans(spark, tmp_path):
    """The counts of op10 are those of its base spans; what the field adds is in spans and all_<kind>."""
    from tessera.llm.queries import op10_pii

    texts = ["call +1 (643) 555-5742, or (643) 555-5742 now", "(643) 555-5742 is it", "a.b@c.example.com 1.2.3.4 4111 1111 1111 1111", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op10_pii(spark, str(tmp_path)).collect()
    for r in got:
        base = brute(texts[r["doc_id"]] or "")
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[1] == k for s in base) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(pii.render(base).encode()).hexdigest()
        for k in pii.KINDS:
            assert r[f"all_{k}"] == r["spans"].count(f"{k}:") >= r[f"n_{k}"]
    by = {r["doc_id"]: r for r in got}
    assert by[0]["n_phone"] == 1 and by[0]["all_phone"] == 2 and by[1]["n_phone"] == 0 and by[1]["all_phone"] == 1
