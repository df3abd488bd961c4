"""Visibility of page elements against a plain walk over random trees, and bounds of the layout on both sides."""

import random

import pytest

from lectern.llm.htmlrender import Layout, render

CASES = [
    ('<div style="visibility:hidden">a<span style="visibility:visible">b</span></div>c', "b\nc"),
    ("<style>.h{display:none}</style><p class=h>secret</p>shown", "shown"),
    ("<style>p.h{display:none} #x{display:block}</style><p class=h id=x>shown</p>", "shown"),
    ("<style>p{display:none!important}</style><p style='display:block'>secret</p>shown", "shown"),
    ("<style>p{display:none}</style><p style='display:block'>shown</p>", "shown"),
    ("<style>.a.b, i {visibility:hidden}</style><b class='b a'>no</b> <b class=a>yes</b> <i>no</i>", "yes"),
    ("<style media=print>p{display:none}</style><p>shown</p>", "shown"),
    ("<style>@media print {p{display:none}} /* p{display:none} */ @import 'x'; q{display:none}</style><p>shown</p><q>no</q>", "shown"),
    ("<style>div p{display:none} p:first-child{display:none} p > b{display:none}</style><p>shown</p>", "shown"),
    ("<style>p{display:none</style><p>no</p>yes", "yes"),
    ("<style>*{visibility:hidden} .v{visibility:visible}</style>no<p class=v>yes <b>no</b></p>", "yes"),
    ("<p style='visibility:collapse'>no</p><p hidden style='display:block'>shown</p>", "shown"),
    ("a <img src=x alt='a picture'> b <img alt=''><input type=image alt=Go>", "a a picture b Go"),
    ("<ul><li style='visibility:hidden'>no</li><li>yes</li></ul>", "- yes"),
    ("<table><tr style='visibility:hidden'><td>no<td><i style='visibility:visible'>yes</i></table>", "yes"),
    ("<p style='content: \"display:none\"'>shown</p>", "shown"),
    ("<p style='display:none; display:block'>shown</p><p style='DISPLAY : NONE'>no</p>", "shown"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_cases(page, text):
    assert render(page).strip() == text


def test_random_trees():
    r = random.Random(6)
    tags, classes = ["div", "span", "b", "section"], ["a", "b", "c"]
    for _ in range(600):
        rules = []
        for _ in range(r.randint(0, 5)):
            ids, own = r.sample(["i1", "i2"], r.randint(0, 1)), r.sample(classes, r.randint(0, 2))
            tag = r.choice([*tags, ""]) if ids or own else r.choice(tags)
            rules.append((tag, own, ids, r.choice([("display", "none"), ("display", "block"), ("visibility", "hidden"), ("visibility", "visible")]), r.random() < 0.2))
        sheet = "\n".join(f"{t}{''.join('.' + c for c in own)}{''.join('#' + i for i in ids)} {{ color: red; {k}: {v}{' !important' if imp else ''} }}" for t, own, ids, (k, v), imp in rules)
        words, seen = iter(range(10**6)), []

        def walk(depth, shown, visible):
            out = []
            for _ in range(r.randint(1, 3)):
                word = f"w{next(words)}"
                out.append(f" {word} ")
                if shown and visible:
                    seen.append(word)
                if depth and r.random() < 0.7:
                    tag, own, ident = r.choice(tags), r.sample(classes, r.randint(0, 2)), r.choice(["", "", "i1", "i2"])
                    style = r.choice([None, None, ("display", "none"), ("display", "block"), ("visibility", "hidden"), ("visibility", "visible")])
                    state = {}
                    for prop in ("display", "visibility"):
                        found = [(imp, 0, len(ids), len(cs), bool(t), n, v) for n, (t, cs, ids, (k, v), imp) in enumerate(rules) if k == prop and t in ("", tag) and set(cs) <= set(own) and set(ids) <= {ident}]
                        found += [(False, 1, 0, 0, False, 0, style[1])] if style and style[0] == prop else []
                        state[prop] = max(found)[-1] if found else None
                    inner = walk(depth - 1, shown and state["display"] != "none", visible if state["visibility"] is None else state["visibility"] == "visible")
                    css = f' style="{style[0]}:{style[1]}"' if style else ""
                    out.append(f'<{tag} class="{" ".join(own)}" id="{ident}"{css}>{inner}</{tag}>')
            return "".join(out)

        body = walk(4, True, True)
        assert render(f"<style>{sheet}</style><body>{body}").split() == seen


def test_layout_bounds():
    nested = "<table><tr><td>a<td>" * 3 + "x" + "</table>" * 3
    assert render(nested, Layout(nested=2)).split() == render(nested, Layout(nested=9)).split() == ["a", "a", "a", "x"]
    lists = "<ul><li>a" * 5
    assert render(lists, Layout(indent=2)).splitlines()[-1].startswith(" " * 4 + "-") and render(lists, Layout(indent=9)).splitlines()[-1] == " " * 8 + "- a"
    wide = f"<table><tr><td>{'w' * 30}<td>b<tr><td>c<td>d</table>"
    assert render(wide, Layout(pad=10)).splitlines()[1] == "c  d" and render(wide, Layout(pad=30)).splitlines()[1] == "c" + " " * 31 + "d"
    many = "<table><tr>" + "<td>cell" * 9 + "</table>"
    assert render(many, Layout(line=10)).split() == render(many).split() == ["cell"] * 9
