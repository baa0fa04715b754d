import random
from itertools import permutations

import pytest

from quillgraph.llm import canonical as c


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_brute_force():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abc", k=rnd.randint(0, 9)))
    paths = [(word(), i) for i in range(120)]
    asked = [word() for _ in range(150)] + ["", "zzz"]
    trie = c.Trie(paths)
    for d in (1, 2, 3):
        got = set(zip(*(x.tolist() for x in trie.search(asked, d))))
        want = {(i, e, n) for i, w in enumerate(asked) for p, e in paths if (n := levenshtein(w, p)) <= d}
        assert got == want


def test_words():
    assert c.drug_word("generic  Flégerjamab HCl 40 mg (ABC-12345)") == "flegerjamab" and c.drug_word("XYZ.12345 Mod-niarbomab") == "modniarbomab"
    assert c.id_word("chembl id 9O0l2345.0") == "90012345" and c.id_word("CHEMBL00012") == "12" and c.id_word("DB-77") == ""
    assert c.disease_word("pt w/ X_Lobe-Sarcoma's, stage IV [DOID:5]") == "xlobesarcoma"
    assert "carcinoma juvenile x lobe" in c.disease_paths("Juvenile X Lobe Carcinoma")


LISTED = [("Flegerjamab", 1), ("Glidskudjenmab", 2), ("Abcdefghij", 3), ("Abcdefghik", 4), ("Aliasdrug", 1)]
TYPED = [(1, "flegerjamb"), (2, "Flegerjamab"), (3, "unknown thing"), (4, "abcdefghix"), (5, None), (6, " "), (7, "ALIASDRUG (QQQ-12345)"), (8, "flegerjamb"), (9, "x" * 5000), (10, "glidskudgenmab sodium")]
WANT = [(1, 1), (3, -1), (4, -1), (7, 1), (8, 1), (9, -1), (10, 2)]


def inputs(spark, typed, listed, kind="drug", exact=None):
    rows = spark.createDataFrame([(kind, *r, 0) for r in typed], "kind string, row_id bigint, value string, entry int")
    paths = spark.createDataFrame([(kind, *r) for r in listed], "kind string, path string, entry bigint")
    return rows, spark.createDataFrame([(kind, v) for v in (exact if exact is not None else [p for p, _ in listed])], "kind string, value string"), paths


def run(spark, typed=TYPED, listed=LISTED, kind="drug", exact=None):
    return sorted((r["row_id"], r["entry"]) for r in c.map_values(*inputs(spark, typed, listed, kind, exact)).collect())


def test_values(spark):
    assert run(spark) == WANT
    assert run(spark, typed=[]) == [] and {e for _, e in run(spark, listed=[])} == {-1}


def test_long_list_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(c, "BLOCK", 1)
    assert run(spark) == WANT


def test_any_order_against_brute_force():
    rnd = random.Random(8)
    word = lambda most: "".join(rnd.choices("abc", k=rnd.randint(1, most)))
    paths = [(word(9), i) for i in range(80)]
    asked = [tuple(word(4) for _ in range(rnd.randint(2, 5))) for _ in range(60)] + [("zz", "a"), ("a", "b", "a", "b", "a")]
    trie = c.Trie(paths)
    for d in (0, 1, 2, 3):
        got = set(zip(*(x.tolist() for x in c.search(trie, asked, d))))
        orders = [{"".join(o) for o in permutations(bag)} for bag in asked]
        want = {(i, e, n) for i, o in enumerate(orders) for p, e in paths if (n := min(levenshtein(w, p) for w in o)) <= d}
        assert got == want
    assert c.search(c.Trie([]), asked, 2)[0].size == 0


SPLIT = [(1, "clib Skeserfuci WJX22809"), (2, "wialimus (GAN-19491) Miadrol"), (3, "xki ANz-76380* JaRQuE"), (4, "skerlimus / Torlv / ALT-65817"), (5, "a b c e f d g"), (6, "best supportive care"), (7, "Skeserfuci clib")]
NAMES = [("Skeserfuciclib", 1), ("Miadrolwialimus", 2), ("Jarquexki", 3), ("Torluskerlimus", 4), ("Gfedcba", 5)]


def test_words_in_another_order(spark, monkeypatch):
    want = [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, -1), (7, 1)]
    assert run(spark, SPLIT, NAMES) == want
    monkeypatch.setattr(c, "BLOCK", 1)
    assert run(spark, SPLIT, NAMES) == want


@pytest.mark.parametrize("block", [100_000, 1])
def test_candidates_and_ties(spark, monkeypatch, block):
    monkeypatch.setattr(c, "BLOCK", block)
    args = inputs(spark, [(1, "abcdefghix"), (2, "ABCDEFGHIJ"), (3, "unknown thing"), (4, "abcdefghix")], LISTED)
    got = sorted((r["value"], r["entry"], r["distance"]) for r in c.candidates(*args).collect())
    assert got == [("ABCDEFGHIJ", 3, 0), ("ABCDEFGHIJ", 4, 1), ("abcdefghix", 3, 1), ("abcdefghix", 4, 1)]
    assert sorted((r["row_id"], r["entry"], r["tied"]) for r in c.map_values(*args).collect()) == [(1, -1, 2), (2, 3, 1), (3, -1, 0), (4, -1, 2)]


@pytest.mark.parametrize("block", [100_000, 1])
def test_remarks_and_qualifiers_come_from_the_list(spark, monkeypatch, block):
    monkeypatch.setattr(c, "BLOCK", block)
    names = [("Lobar Carcinoma", 1), ("Metastatic Lobar Carcinoma", 2), ("Congenital Flalaje Lobe Sarcoma", 3)]
    typed = [(1, "metastatic lobar carcinoma"), (2, "advanced Lobar Carcinoma, stage IV"), (3, "flalaje lobe sarcoma, congenital"), (4, "Metastatic congenital sarcoma of the flalaje lobe"), (5, "metastatic")]
    assert run(spark, typed, names, "disease", ["other"]) == [(1, 2), (2, 1), (3, 3), (4, 3), (5, -1)]


def test_cells_hold_every_candidate(spark):
    """All entries within the distance, against brute force over the whole list, with hot cells."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("aeibd", k=rnd.randint(3, 24)))
    names = sorted({word() for _ in range(150)})
    values = [rnd.choice(names) for _ in range(120)]
    values = sorted({"".join(ch for ch in v if rnd.random() > 0.06) + rnd.choice(["", "a", "d"]) for v in values} | {word() for _ in range(60)} | {" ".join(rnd.choices(["aeib", "dab", "bee"], k=3)) for _ in range(9)})
    args = inputs(spark, list(enumerate(values)), [(n, i) for i, n in enumerate(names)], exact=[])
    got = {(r["value"], r["entry"], r["distance"]) for r in c.candidates(*args).collect()}
    want = set()
    for v in values:
        d = c.allowed(v.replace(" ", ""))
        orders = {"".join(o) for o in permutations(v.split(" "))}
        want |= {(v, i, n) for i, p in enumerate(names) if (n := min(levenshtein(o, p) for o in orders)) <= d}
    assert got == want and len(got) > 100


def test_words_that_say_nothing_are_learned(spark, monkeypatch):
    monkeypatch.setattr(c, "LEARNED_LEAST", 4)
    names = [("Skeserfuciclib", 1), ("Miadrolwialimus", 2), ("Jarquexki", 3), ("Torluskerlimus", 4)]
    typed = [(i, f"{n} {w} ABC-1234{i}") for i, (n, _) in enumerate(names) for w in ("besylate", "quickmelt")] + [(9, "Skeserfu ciclib"), (10, "besylate placebo")]
    got = dict(run(spark, typed, names))
    assert got == {0: 1, 1: 2, 2: 3, 3: 4, 9: 1, 10: -1}


def test_held_out_noise(spark):
    """Recall and precision on typing noise that is drawn here: two edits at most, case, salts, forms, order, codes."""
    rnd = random.Random(12)
    part = lambda: "".join(rnd.choice("bcdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 3)))
    names = sorted({part() + part() + rnd.choice(["nib", "mab", "lol", "zole"]) for _ in range(400)})
    names = [n for i, n in enumerate(names) if all(levenshtein(n, o) > 4 for o in names[max(0, i - 3) : i])]

    def noisy(name):
        out = list(name)
        for _ in range(rnd.randint(0, 2 if len(name) > 8 else 1)):
            i = rnd.randrange(len(out))
            out[i : i + 1] = rnd.choice([[], [rnd.choice("xqyw")], [out[i], rnd.choice("xqyw")]])
        text = "".join(out)
        words = [text, *rnd.sample(["phosphate", "tablet", "20 mg", "HCl", "fumarate"], rnd.randint(0, 2))]
        rnd.shuffle(words)
        text = " ".join(words) + f" ({''.join(rnd.choices('QWX', k=3))}-{rnd.randint(10000, 99999)})"
        return rnd.choice([str.upper, str.title, str])(text)

    truth = [(i, rnd.randrange(len(names))) for i in range(600)] + [(i, -1) for i in range(600, 700)]
    typed = [(i, noisy(names[e] if e >= 0 else "".join(rnd.choices("bcdfgxqw", k=12)))) for i, e in truth]
    got = dict(run(spark, typed, [(n, e) for e, n in enumerate(names)]))
    said = [(i, e) for i, e in truth if got[i] >= 0]
    assert sum(got[i] == e for i, e in said) >= 0.99 * len(said) and sum(got[i] == e for i, e in truth if e >= 0) >= 0.97 * 600
