import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm import pii as P


#: A corpus that also writes these words small.
MODEL = P.WordModel.of(["adele", "export", "order", "steuer", "tel", "sides", "thanks"], ["North Bench".lower()])


def found(text):
    return {(k, text[a:b]) for a, b, k in P.find_details(text, MODEL)}


CASES = {
    "Mail me at jane.doe+x@lab.example.org.": {("email", "jane.doe+x@lab.example.org")},
    "[write](mailto:a_b@c.example) now": {("email", "a_b@c.example")},
    "contact: <amy [at] lab [dot] example>": {("email", "amy [at] lab [dot] example")},
    "as amy.lee AT lab DOT example DOT org, ok": {("email", "amy.lee AT lab DOT example DOT org")},
    "reach amy(at)lab.example or bob @ mail.example today": {("email", "amy(at)lab.example"), ("email", "bob @ mail.example")},
    "pеter@exаmple.org and bob@ma​il.example": {("email", "pеter@exаmple.org"), ("email", "bob@ma​il.example")},
    "a&#64;b.example": {("email", "a&#64;b.example")},
    "x = token[2:91] @ kernel_clear.T  # plain\nreturn a@b.T": set(),
    "Tel. +44 (0)20 7946 0294, or (303) 555-0145.": {("phone", "+44 (0)20 7946 0294"), ("phone", "(303) 555-0145")},
    "0044 7700 900567 / 030/23125-646 / 01.99.00.39.67": {("phone", "0044 7700 900567"), ("phone", "030/23125-646"), ("phone", "01.99.00.39.67")},
    "gateway 10.3.44.5, row 38331, 2020-06-12 01:12:45, v2.10.1, 493.6 871.5": set(),
    "My SSN: 939-88-3031, passport no: ZK1842649": {("idnum", "939-88-3031"), ("idnum", "ZK1842649")},
    "Steuer-ID 00 187 392 705; DNI 00.545.644-R; national insurance no. QQ 93 84 77 D": {("idnum", "00 187 392 705"), ("idnum", "00.545.644-R"), ("idnum", "QQ 93 84 77 D")},
    "Order number 396-64-8245 of the file": set(),
    "at 287 North Kelber Street, 61008 Larkmoor": {("address", "287 North Kelber Street")},
    "J'habite 17 bis, boulevard Alder, Ville. Vivo en C/ Tarnhof, 141.": {("address", "17 bis, boulevard Alder"), ("address", "C/ Tarnhof, 141")},
    "Bitte an Am Alder 165a senden, nicht Vellmerstraße 279b": {("address", "Am Alder 165a"), ("address", "Vellmerstraße 279b")},
    "Both sides of Harbour Street look late. Am 2023-05-28 lief es.": set(),
    "Dr. Emil T. Lindmann and Petra-Viola van Holt-Marsh told me": {("name", "Emil T. Lindmann"), ("name", "Petra-Viola van Holt-Marsh")},
    "cc: Hirsquist, Nadja; ROSALBA HALESCU; F. Kravini": {("name", "Hirsquist, Nadja"), ("name", "ROSALBA HALESCU"), ("name", "F. Kravini")},
    "Thanks, Oskar! cc: Bastian P. In Sorrel Export 8.2 the index skips.": set(),
    "# author: Ruben T. Fennard Row 88 holds 1.5. The Adele Kelby Street is long.": {("name", "Ruben T. Fennard")},
    "# author: Quendolin Harrowgate": {("name", "Quendolin Harrowgate")},
}


@pytest.mark.parametrize("text", CASES)
def test_details_are_found_as_written(text):
    assert found(text) == CASES[text]


def test_redaction_keeps_the_rest():
    assert P.redact("Hi Petra Lind,\nmail a@b.example or +14155550173!") == "Hi [NAME],\nmail [EMAIL] or [PHONE]!"
    assert P.redact(None) is None and P.redact("") == "" and P.redact("  ") == "  "


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a@b.example", " amy [at] lab [dot] example ", "+44 7700 900193", "ае", "​", "&#64;", " at ", " dot ", "one two three four five six seven", "Petra Lind", " ", "\n", "x", "漢", ". "]), max_size=12))
def test_spans_lie_in_order_and_in_the_text(parts):
    text = "".join(parts)
    at = 0
    for a, b, k in P.find_details(text):
        assert at <= a < b <= len(text) and k in ("email", "phone", "idnum", "address", "name")
        at = b
    norm, starts, ends = P.normalise(text)
    if starts is not None:
        assert len(norm) == len(starts) == len(ends) and all(s < e for s, e in zip(starts, ends)) and starts == sorted(starts)


def test_operators(spark):
    docs = spark.createDataFrame([(1, "a@b.example a@b.example", "x"), (1, "a@b.example", "x"), (2, None, "x"), (3, "", "x"), (4, "z" * 300_000 + " c@d.example", "x")], "doc_id bigint, text string, kind string")
    assert {tuple(r) for r in P.personal_details(docs).collect()} == {(1, "email", "a@b.example"), (4, "email", "c@d.example")}
    assert P.personal_details(docs.limit(0)).count() == 0
    red = [(r.doc_id, r.text) for r in P.redacted_documents(docs.where("doc_id < 4")).collect()]
    assert sorted(red, key=str) == sorted([(1, "[EMAIL] [EMAIL]"), (1, "[EMAIL]"), (2, None), (3, "")], key=str)


def test_inner_capitals_and_words_of_look_alikes():
    for name in ("Sarah O'Brien", "Sarah McDonald", "Sarah MacLeod", "Sarah DeVito", "Sarah D'Angelo", "Sarah McCoy-O’Neil"):
        assert found(f"thanks to {name}, who wrote it") == {("name", name)}
    assert found("write bob@\u0435\u0445ample.org now") == {("email", "bob@\u0435\u0445ample.org")}


def test_names_of_any_kind_by_the_words_of_the_corpus(spark):
    names = ["Sven Lindqvist", "Kenji Tanaka", "Priya Raman", "Oleksandr Kovalenko", "Henrietta Vosk", "Wangari Maathai", "Nguyen Minh-Chau", "Anna Svensson"]
    plain = ["the table of the viewer is large and the suite works", "a bench and a desk stand north of the export", "my colleague wrote it, see the viewer"]
    texts = [f"I asked {n} about the table." for n in names] + plain * 3 + ["We like Vantor Viewer a lot."] * 2 + ["See North Bench for it."] * 25
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r.kind, r.found_text) for r in P.personal_details(docs).collect()}
    assert got == {("name", n) for n in names}
    red = {r.text for r in P.redacted_documents(docs).collect()}
    assert "I asked [NAME] about the table." in red and "See North Bench for it." in red and not any(n in t for n in names for t in red)


def test_word_model_of_nothing(spark):
    m = P.word_model(spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string"))
    assert len(m.ordinary) == len(m.phrases) == 0 and not m.knows("a")
