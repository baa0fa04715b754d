import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import lookalikes
from quillgraph.llm.lookalikes import look_the_same

PAIRS = []


@pytest.fixture(scope="module", autouse=True)
def pairs(spark):
    PAIRS[:] = [lookalikes.confusables(spark)]


def same_form(texts):
    return lookalikes.same_form(texts, PAIRS[0])


MARKED = st.text(st.sampled_from([chr(x) for x in (0x41, 0x61, 0x65, 0x300, 0x301, 0x308, 0x323, 0x327, 0xE9, 0x1EC7, 0x212B, 0x1100, 0x1161, 0x11A8, 0xAC00)]), max_size=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(MARKED, max_size=6))
def test_marks_compose_as_in_the_standard(texts):
    assert same_form(pa.array(texts, pa.string())).to_pylist() == [unicodedata.normalize("NFC", t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=6))
def test_one_form_is_stable(texts):
    once = same_form(pa.array(texts, pa.string()))
    assert same_form(once).to_pylist() == once.to_pylist()


def form(text):
    return same_form(pa.array([text, None, "plain"])).to_pylist()[0]


def test_what_looks_the_same():
    same = [
        ("EGFR", "ＥＧＦＲ"), ("EGFR", "ЕGFR"), ("café", "café"), ("a b", "a b"), ("ab", "a​b"), ("ab", "a­b"), ("12 µg", "12 μg"), ("a-b", "a‑b"), ("TOP", "ΤΟΡ"),
        ("même", "mе̂mе"), ("при", "пpи"), ("x　y", "x y"),
    ]
    for a, b in same:
        assert form(a) == form(b), (a, b)
    for odd, plain in zip("һԁѵνραυօᎪ𝐀ᴏɑ−ⲟꮯ", "hdvvpauoAAoa-oc", strict=True):
        assert form(f"x{odd}y") == f"x{plain}y" and form("\u2163") == "IV"
    for text in ("привет, год", "σοφός νόσος", "Հայոց գիր", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ", "ısı ſo"):
        assert form(text) == text
    for a, b in [("EGFR", "egfr"), ("mm³", "mm3"), ("naïve", "naive"), ("a\nb", "a b"), ("a\tb", "a b"), ("и", "u")]:
        assert form(a) != form(b), (a, b)
    assert form("при YATT4") == "при YATT4" and form("доpога") == "дорога"


def test_documents(spark):
    rows = [(5, "EGFR"), (2, "ЕGFR"), (9, "E​GFR"), (1, None), (3, ""), (4, "​"), (6, " \n"), (7, "egfr"), (8, "x" * 50_000), (10, "x" * 50_000), (10, "x" * 50_000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, look string")
    assert sorted(map(tuple, look_the_same(df).collect())) == [(2, 5), (2, 9), (8, 10)]
    assert look_the_same(df.limit(0)).count() == 0


def test_the_table_holds_the_common_look_alikes():
    found = {chr(a): chr(b) for a, b in PAIRS[0]}
    for own, looks in (("АВСЕНІЈКМОРЅТУХаеіјорсѕух", "ABCEHIJKMOPSTYXaeijopcsyx"), ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo")):
        assert [found[c] for c in own] == list(looks)
    assert "σ" not in found and "ı" not in found and len(found) > 100
