"""Markup and splitting operators."""

import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import markup, splitting

@pytest.fixture(scope="module")
def model(spark):
    return markup.fit_markup(spark, "/root/testdata/sf0.01")


def kinds(model, text):
    return {markup.KINDS[c[4]] for c in model.judge([text])[0] if c[4]}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("# Title\n\nSome **bold** text with a [link](https://a.example/b).", {"markdown"}),
        ("<p>Hello &amp; goodbye</p><br/>", {"html"}),
        ("== Head ==\nA [[link|word]] and '''bold'''.", {"wiki"}),
        ("\\section{A}\nText with $x_i^2$ and \\emph{more}.", {"latex"}),
        ("Title\n-----\n\n.. note::\n\n   Text with :func:`~a.b`.", {"rest"}),
        ("Keep rows where score < 4 and weight > 3. It cost $5 in May and $6 in June.", set()),
        ("The type ARRAY<FLOAT> in C:\\runs\\new is 3 * 4 * 5 long. R&D said a & b.", set()),
        ("def f(a, *, b=None):\n    return a * 2 + b[0]\nx = {'a': []}", set()),
        ("```python\nx = a[0] * b[[1]]  # <b>no</b>\n```", {"markdown"}),
        ("<pre><code>a = '**x**'</code></pre>", {"html"}),
        ("", set()),
    ],
)
def test_kinds(model, text, want):
    assert kinds(model, text) == want


def test_held_out_pages(spark, model):
    """Readers' labels of another table: what a page is mostly marked up in is what its reader is for."""
    d = "/root/testdata/sf0.001"
    files = spark.read.parquet(f"{d}/reader_files.parquet").select("input_path", "reader").dropDuplicates(["input_path"])
    rows = spark.read.parquet(f"{d}/corpus_documents.parquet").join(files, "input_path").selectExpr("reader", "get_json_object(json_data, '$.text') as text").where("text is not null").collect()
    right = total = 0
    for r in rows:
        found = [markup.KINDS[c[4]] for c in model.judge([r.text])[0] if c[4]]
        if r.reader in markup.READS and found:
            total += 1
            right += max(set(found), key=found.count) == markup.READS[r.reader]
    assert total > 50 and right / total > 0.8


def test_tree_follows_tags():
    tree = markup.Tree.of(["<div><ul><li>a<li>b <b>c</b></ul></div>\n<br>x", "plain"])
    names = {x: e[0] for x, e in tree.element.items()}
    up = lambda x: names.get(tree.parent[x])
    assert [(names[x], up(x)) for x in sorted(names)] == [("div", None), ("ul", "div"), ("li", "ul"), ("li", "ul"), ("b", "li")]
    assert tree.page == [0, len(tree.parent) - 1]
    assert max(markup.Tree.of(["<b>x" * 3000]).depth) <= markup.DEEPEST + 2


def test_messages_give_exact_marginals():
    rng = np.random.default_rng(0)
    parent = np.array([-1, 0, 0, 1, 1, 3])
    depth, kind = np.array([0, 1, 1, 2, 2, 3]), np.array([0, 1, 2, 2, 3, 3])
    emit, edge = rng.normal(size=(6, 3)), rng.normal(size=(4, 3, 3))
    got, pairs = markup.sum_product(parent, kind, depth, emit, edge)
    want, both = np.zeros((6, 3)), np.zeros((4, 3, 3))
    for states in itertools.product(range(3), repeat=6):
        w = np.exp(sum(emit[i, s] for i, s in enumerate(states)) + sum(edge[kind[i], states[parent[i]], states[i]] for i in range(1, 6)))
        for i, s in enumerate(states):
            want[i, s] += w
            if i:
                both[kind[i], states[parent[i]], s] += w
    total = want[0].sum()
    assert np.allclose(got, want / total) and np.allclose(pairs, both / total)


def blocks(model, text):
    return markup.clean(text, model.judge([text])[0])


def test_clean_keeps_structure(model):
    text = "# Title\n\nSome **bold** text with $x^2$ in it.\n\n- one\n  - [ ] two\n1. first\n2. second\n\n```\nx = 1\n```\n\n\\[ a^2 \\]\n\n### Third"
    got = blocks(model, text)
    assert ("heading", "markdown", 1, "Title") in got and ("heading", "markdown", 3, "Third") in got
    assert ("code", "none", 0, "x = 1") in got
    assert ("list_item", "markdown", 1, "one") in got and ("list_item", "markdown", 2, "two") in got
    assert [t for k, _, _, t in got if k == "list_item"][2:] == ["first", "second"]
    assert ("formula", "latex", 0, "a^2") in got
    assert any(k == "paragraph" and t == "Some bold text with x^2 in it." for k, _, _, t in got)


def test_clean_of_a_page(model):
    text = (
        "<html><head><title>t</title><style>p{color:red}</style></head><body><nav><a href='/'>Home</a> <a href='/a'>About</a></nav>"
        "<script>var x=1;track();</script><h2>A &amp; B</h2><p>Some text that is said on the page, with a <b>word</b>.</p>"
        "<ul><li>one<ul><li>two</li></ul></li></ul><pre><code>a &lt; <b>b</b></code></pre></body></html>"
    )
    got = blocks(model, text)
    whole = " ".join(t for *_, t in got)
    assert all(x not in whole for x in ("var x", "color", "Home", "About", "&lt;", "&amp;", "<b>", "<code>"))
    assert [(k, level, t) for k, _, level, t in got] == [
        ("heading", 2, "A & B"),
        ("paragraph", 0, "Some text that is said on the page, with a word."),
        ("list_item", 1, "one"),
        ("list_item", 2, "two"),
        ("code", 0, "a < b"),
    ]


def test_clean_leaves_plain_text(model):
    text = "Keep rows where a < 4.\n\nThe type ARRAY<FLOAT> is 3 * 4 long."
    assert blocks(model, text) == [("paragraph", "none", 0, "Keep rows where a < 4."), ("paragraph", "none", 0, "The type ARRAY<FLOAT> is 3 * 4 long.")]
    assert kinds(model, "! Alpha") <= {"wiki"} and re.search(markup.TRIGGER.replace("(?m)", "(?m)"), "! Alpha")


def test_markup_frames(spark, model):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<b>x</b> " * 3000), (4, "plain")], "doc_id int, text string")
    got = {r.doc_id: r.markup_mask for r in markup.markup_masks(df, model).collect()}
    assert got[1] == got[2] == got[4] == 0 and got[3] == 1 << markup.KINDS.index("html")
    assert {r.doc_id for r in markup.clean_documents(df, model).collect()} == {3, 4}
    assert markup.markup_masks(df.where("false"), model).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .!\n，。é😀#="), max_size=400), st.integers(1, 60), st.integers(0, 40))
def test_pieces(text, limit, overlap):
    pieces = splitting.split_text(text, limit, overlap)
    if not text:
        assert pieces == []
        return
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(0 < z - a <= limit for a, z in pieces)
    if len(pieces) > 1:
        lap = min(overlap, limit - 1)
        assert all(y[0] == x[1] - lap and y[1] > x[1] for x, y in zip(pieces, pieces[1:]))


def test_natural_ends():
    text = "First paragraph here.\n\nSecond one is this. It has two sentences.\n\nThird."
    cut = splitting.split_text(text, 30, 0)
    assert [text[a:z] for a, z in cut][0] == "First paragraph here.\n\n"
    assert splitting.split_text("x" * 100, 30, 10) == [(0, 20), (10, 40), (30, 60), (50, 80), (70, 100)]


def test_split_frames(spark):
    df = spark.createDataFrame([(1, None, 5, 1), (2, "", 5, 1), (3, "abc def", None, 1), (4, "abc def", 4, None), (5, "ab " * 40000, 1000, 100)], "doc_id int, text string, max_chars int, overlap_chars int")
    got = splitting.split_documents(df).collect()
    assert {r.doc_id for r in got} == {3, 4, 5}
    assert [r.piece for r in got if r.doc_id == 3] == ["abc def"]
    assert all(len(r.piece) <= 1000 and r.char_end - r.char_start == len(r.piece) for r in got)
