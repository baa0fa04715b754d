import random

import duckdb
import pytest

from quillgraph.operators.packed import DELIMITERS, DEPTH, Grammar, parse, unpack
from quillgraph.plans import problems

CASES = [
    (None, []), ("", []), ("  ", []), (";;|,", []), ("a", ["a"]), (" a ; b|c,d\te\nf；g", list("abcdefg")), ("a;a;;a", ["a", "a", "a"]),
    ('"x; y";z', ["x; y", "z"]), ("'x, y' | z", ["x, y", "z"]), ('"a ""b""";c', ['a "b"', "c"]), ('["a", "b, c"]', ["a", "b, c"]), ('{"a b",c}', ["a b", "c"]), ("[a];[b]", ["a", "b"]),
    ('a\n"b; c"\nd', ["a", "b; c", "d"]), ('"a;b', ['"a', "b"]), ("5'-aza;b", ["5'-aza", "b"]), ('""', []), ("x [y];z", ["x [y]", "z"]), ("  'q'  ", ["q"]),
    ("['a;b', 'c]']", ["a;b", "c]"]), ('["a;b", [c]]', ["a;b", "c"]), ("[[a;b]; c]", ["a;b", "c"]), ("{[ 'x;y' ] | [[z]]}", ["x;y", "z"]), ("[a's; b's]", ["a's", "b's"]), ('"[a]"; [["b"]]', ["[a]", "b"]), ("[a; b", ["[a", "b"]),
]


def values(spark, texts, **grammar):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "row_id int, f string, pos string")
    got = {}
    for r in unpack(df, "f", Grammar(**grammar), ["row_id"]).collect():
        got.setdefault(r["row_id"], []).append((r["pos"], r["item_value"], r["parse_error"]))
    return [sorted(got.get(i, [])) for i in range(len(texts))]


def test_values_and_positions(spark):
    for (text, want), got in zip(CASES, values(spark, [t for t, _ in CASES])):
        assert [v for _, v, _ in got] == want, text
        assert [p for p, _, _ in got] == list(range(1, len(want) + 1)), text


def test_errors_and_spaces(spark):
    got = values(spark, ['"a;b', "a;[b", "a b  c", "'1', '2'"], spaces=True)
    assert [e for _, _, e in got[0]] == ["unbalanced_quote", None]
    assert got[1][1][2] == "unbalanced_bracket"
    assert [v for _, v, _ in got[2]] == ["a", "b", "c"] and [v for _, v, _ in got[3]] == ["1", "2"]


def test_errors_of_brackets(spark):
    got = values(spark, ["x [y; z", "x [y] z", "[[[[[a]]]]]; [[[[b]]]]", "a}; {b", "[a] b [c]"])
    assert [[e for *_, e in row] for row in got] == [["unbalanced_bracket", None], [None], ["nested_too_deep", None], ["unbalanced_bracket"] * 2, [None]]
    assert got[2][0][1] == "[[[[[a]]]]]" and got[2][1][1] == "b"


class Reader:
    """The grammar as a parser that keeps its place, one character after the other."""

    def __init__(self, spaces=False):
        self.ends = lambda ch: ch in DELIMITERS or spaces and ch.isspace()

    def quoted(self, s, i):
        j = i + 1
        while j < len(s):
            if s[j] == s[i]:
                if s[j + 1 : j + 2] != s[i]:
                    return j + 1
                j += 1
            j += 1
        return None

    def nested(self, s, i, depth, close=None):
        j = i + 1
        while j < len(s):
            if s[j] in "\"'":
                before = s[max(0, j - 10) : j]
                bare = before.rstrip()
                spaces = len(before) - len(bare)
                opening = any((k := j - n - 1) >= 0 and (s[k] in "[{" or self.ends(s[k])) for n in range(min(9, spaces) + 1))
                end = self.quoted(s, j) if opening else None
                if end is not None:
                    rest = s[end:].lstrip()
                    if not rest or rest[0] in "]}" or self.ends(rest[0]) or any(self.ends(c) for c in s[end : len(s) - len(rest)]):
                        j = end
                        continue
                j += 1
            elif s[j] in "[{":
                end = self.nested(s, j, depth - 1) if depth > 1 else None
                if end is None:
                    return None
                j = end
            elif s[j] in "]}":
                return j + 1 if s[j] == {"[": "]", "{": "}"}[s[i]] else None
            else:
                j += 1
        return None

    def item(self, s, i):
        """End of a quoted or nested item, and its own text; None if there is none."""
        j = i
        while j < len(s) and s[j].isspace():
            j += 1
        if j == len(s) or s[j] not in "\"'[{":
            return None
        end = self.quoted(s, j) if s[j] in "\"'" else self.nested(s, j, DEPTH)
        if end is None:
            return None
        k = end
        while k < len(s) and s[k].isspace() and not self.ends(s[k]):
            k += 1
        return (k, s[j:end]) if k == len(s) or self.ends(s[k]) else None

    def value(self, text):
        for _ in range(DEPTH):
            if text[:1] not in ("[", "{") or self.nested(text, 0, DEPTH) != len(text):
                break
            text = text[1:-1].strip()
        if text[:1] in ("'", '"') and self.quoted(text, 0) == len(text):
            text = text[1:-1].replace(text[0] * 2, text[0])
        return text.strip()

    def read(self, s):
        whole = s.strip()
        if whole[:1] in ("[", "{") and self.nested(whole, 0, DEPTH + 1) == len(whole):
            s = whole[1:-1]
        out, i = [], 0
        while i < len(s):
            if got := self.item(s, i):
                i, text = got
            elif self.ends(s[i]):
                i += 1
                continue
            else:
                j = i
                while j < len(s) and not self.ends(s[j]):
                    j += 1
                i, text = j, s[i:j].strip()
            if v := self.value(text):
                out.append(v)
        return out


@pytest.mark.parametrize("spaces", [False, True])
def test_random_nesting_against_a_reader(spark, spaces):
    rnd = random.Random(17)
    texts = []
    for _ in range(600):
        parts = [rnd.choice(["a", "b c", ";", "; ", ",", " ", "[", "]", "{", "}", '"', "'", '""', "'s", "[x]", '["y; z"]', "'q;r'", "|"]) for _ in range(rnd.randint(1, 12))]
        texts.append("".join(parts))
    reader = Reader(spaces)
    for text, got in zip(texts, values(spark, texts, spaces=spaces)):
        assert [v for _, v, _ in got] == reader.read(text), text


def test_all_fields_against_a_reader(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted((r["table_name"], r["field_name"], r["row_id"], r["pos"], r["item_value"]) for r in problems.p2_found(spark, sf).collect())
    want = []
    for name, field, spaces in problems.PACKED:
        for row, text in duckdb.sql(f"SELECT row_id, {field} FROM '{sf}/{name}.parquet' WHERE {field} IS NOT NULL").fetchall():
            want += [(name, field, row, i, v) for i, v in enumerate(Reader(spaces).read(text), 1)]
    assert got == sorted(want)


class OnlyB(Grammar):
    def item(self):
        return "(b)"


def test_the_grammar_reads_fields_without_marks(spark):
    df = spark.createDataFrame([("abc;b",), ('"abc";b',)], "f string")
    got = df.select(parse(df.f, OnlyB()).alias("v")).collect()
    assert [[x["value"] for x in r["v"]] for r in got] == [["b", "b"], ["b", "b"]]


@pytest.mark.parametrize("n", [20_000])
def test_very_long_field(spark, n):
    assert len(values(spark, [";".join(["ab"] * n) + ';"c;d"'])[0]) == n + 1
