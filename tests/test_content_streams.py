"""The lexer and the page's state, by hand and against a plain character loop."""

import random

import pytest

from quillspark.sources import content_streams as cs


def read(*parts):
    state = cs.PageState()
    return [row for part in parts for row in state.read(part)]


def loop(content):
    """Tokens by walking over the characters."""
    out, i, blank, delimiters = [], 0, b"\x00\t\n\f\r ", b"()<>[]{}/%"
    while i < len(content):
        c = content[i : i + 1]
        if c in blank:
            i += 1
        elif c == b"%":
            while i < len(content) and content[i : i + 1] not in b"\r\n":
                i += 1
        elif c == b"(":
            depth, i = 1, i + 1
            while i < len(content) and depth:
                if content[i : i + 1] == b"\\":
                    i += 2
                    continue
                depth += {b"(": 1, b")": -1}.get(content[i : i + 1], 0)
                i += 1
            out.append("(...)")
        elif content[i : i + 2] in (b"<<", b">>"):
            out.append(content[i : i + 2].decode())
            i += 2
        elif c == b"<":
            end = content.find(b">", i)
            i = len(content) if end < 0 else end + 1
            out.append("<...>")
        elif c in b"[]{}":
            out.append(c.decode())
            i += 1
        elif c in b")>":
            i += 1  # stray
        else:
            j = i + 1
            while j < len(content) and content[j : j + 1] not in blank and content[j : j + 1] not in delimiters:
                j += 1
            out.append(content[i:j].decode("latin-1"))
            i = j
    return out


def test_lexemes_by_hand():
    got = list(cs.lexemes(b"/P <</MCID 3>>BDC % a comment (with\n(a \\) (b) c)Tj <48 65> Tj [(x)-5(y)]TJ/N#20m Do\x00f* (open"))
    assert got == ["/P", "<<", "/MCID", "3", ">>", "BDC", "(...)", "Tj", "<...>", "Tj", "[", "(...)", "-5", "(...)", "]", "TJ", "/N#20m", "Do", "f*", "(...)"]


@pytest.mark.parametrize("seed", range(5))
def test_lexemes_against_a_loop(seed):
    rng = random.Random(seed)
    for _ in range(300):
        content = bytes(rng.choice(b"ab/(<>)[]\\% \n\x00\xe9{}1.-") for _ in range(rng.randrange(40)))
        assert list(cs.lexemes(content)) == loop(content)


def test_matrices_and_content():
    rows = read(b"q 2 0 0 2 10 20 cm /Fig <</MCID 4>> BDC q 3 0 0 5 1 1 cm /Im1 Do Q 1 2 3 4 re f EMC Q /P <</MCID 5>> BDC /Span BMC 0 0 m 9 0 l 9 7 l S EMC EMC 0 0 1 1 re f")
    assert rows == [(1, "image", [4], "Im1", 12.0, 22.0, 18.0, 32.0), (2, "paint", [4], None, 12.0, 24.0, 18.0, 32.0), (3, "paint", [5], None, 0.0, 0.0, 9.0, 7.0)]


def test_text_places():
    rows = read(b"1 0 0 1 5 5 cm /P <</MCID 0>> BDC (outside) Tj BT 1 0 0 1 10 20 Tm (a) Tj 3 -4 TD (b) Tj T* (c) ' 1 Td (one number) Tj 2 2 Td [(d)] TJ ET EMC")
    assert [(r[1], r[4], r[5]) for r in rows] == [("text", 15.0, 25.0), ("text", 18.0, 21.0), ("text", 18.0, 17.0), ("text", 18.0, 17.0), ("text", 20.0, 19.0)]


def test_state_goes_on_over_streams_and_operands_do_not():
    rows = read(b"/Fig <</MCID 1>> BDC 1 0 0 1 100 0 cm 5 5", b"10 20 re f EMC EMC Q Q 7 7 7 7 re f /A <</MCID 2>> BDC 1 1 2 2 re 3 3 m n 9 9 2 2 re f sh EMC")
    assert rows == [(3, "paint", [2], None, 9.0, 9.0, 11.0, 11.0)]
    rows = read(b"/Fig <</MCID 1>> BDC 1 0 0 1 100 0 cm", b"5 5 10 20 re f")
    assert rows == [(1, "paint", [1], None, 105.0, 5.0, 115.0, 25.0)]


def test_nested_content_and_odd_numbers():
    rows = read(b"/A <</MCID 7>> BDC /B <</X /MCID /MCID 2.9>> BDC /C <</MCID x>> BDC 0 0 4 4 re B* EMC EMC 0 0 0 5 re f 0 0 5 0 re f EMC")
    assert rows == [(1, "paint", [2, 7], None, 0.0, 0.0, 4.0, 4.0)]


def test_pages_of_a_table(spark):
    streams = [("a", 1, 1, b"/X <</MCID 1>> BDC 0 0 2 2 re"), ("a", 1, 2, b"f EMC"), ("a", 2, 1, b"f"), ("b", 1, 1, None), (None, None, 1, b"/X <</MCID 3>> BDC /I Do"), ("c", 1, 1, b"")]
    df = spark.createDataFrame(streams, "doc string, page int, part int, content binary").repartition(3)
    got = sorted(cs.paint_log(df, ["doc", "page"]).collect(), key=repr)
    assert [tuple(r) for r in got] == [("a", 1, 1, "paint", [1], None, 0.0, 0.0, 2.0, 2.0), (None, None, 1, "image", [3], "I", 0.0, 0.0, 1.0, 1.0)]


def test_components(spark):
    log = spark.createDataFrame(
        [("p", 1, "image", [1, 2], "I", 0.0, 0.0, 4.0, 4.0), ("p", 2, "image", [1], "I", 0.0, 0.0001, 4.0, 4.0), ("p", 3, "image", [1], "Form", 0.0, 0.0, 9.0, 9.0), ("p", 4, "paint", [2], None, 1.0, 1.0, 2.0, 2.0), ("p", 5, "text", [2], None, 10.0, 10.0, 10.0, 10.0), ("p", 6, "text", [3], None, 50.0, 50.0, 50.0, 50.0), (None, 1, "text", [3], None, 11.0, 9.0, 11.0, 9.0)],
        "page string, seq long, kind string, mcids array<int>, name string, x0 double, y0 double, x1 double, y1 double",
    )
    traces = spark.createDataFrame([("p", 8, 12.0, 11.0, 12.0, 9.0, 30.0, 20.0), ("p", 9, 10.5, 10.0, 10.0, 9.0, 30.0, 21.0), ("p", 9, 14.0, 10.0, 10.0, 9.0, 30.0, 21.0), (None, 1, 11.0, 9.0, 0.0, 0.0, 1.0, 1.0)], "page string, trace long, x double, y double, x0 double, y0 double, x1 double, y1 double")
    names = spark.createDataFrame([("p", "I"), ("p", "J")], "page string, name string")
    got = {tuple(r) for r in cs.components(log, ["page"], traces, names).collect()}
    assert got == {("p", 1, "image", 0.0, 0.0, 4.0, 4.0), ("p", 2, "image", 0.0, 0.0, 4.0, 4.0), ("p", 2, "paint", 1.0, 1.0, 2.0, 2.0), ("p", 2, "text", 10.0, 9.0, 30.0, 21.0), (None, 3, "text", 0.0, 0.0, 1.0, 1.0)}
