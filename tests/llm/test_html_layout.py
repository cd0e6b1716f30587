import random
import re

from inkstone.llm import html_layout as op

CASES = {
    "": "",
    "plain  text\n here": "plain text here",
    "<p>one<p>two": "one\n\ntwo",
    "<div>a<div>b</div>c</div>d": "a\nb\nc\nd",
    "<b>x</b><i>y</i> z&amp;&eacute;": "xy z&é",
    "<ul><li>one<li>two<ul><li>in</ul><li>three</ul>": "- one\n- two\n  - in\n- three",
    "<ol start=9><li>nine<li>ten<p>more</ol>": "9. nine\n10. ten\n\n    more",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<pre>\n a\n   b\n\n c</pre>x": " a\n   b\n\n c\n\nx",
    "<title>t</title><body>b<script>var x='</p>'</script><style>p{}</style><!-- c --><template>t</template>": "b",
    "<p hidden>h</p><p style='display: none'>n</p><p>v</p>": "v",
    "<style>.x, #y{display:none}</style><p class='a x'>h</p><p id=y>h</p><p class=xx>v</p>": "v",
    "<details><summary>s</summary>more</details><details open><summary>t</summary>shown</details>": "s\nt\nshown",
    "<input type=hidden value=q><input value=typed><input type=submit value=Go>": "Go",
    "<table><tr><th>Name<th>N<tr><td>a<td align=right>1<tr><td>longer<td align=right>22</table>": "Name    N\na        1\nlonger  22",
    "<table><tr><td colspan=2>wide cell here<tr><td>a<td>b</table>": "wide cell here\na  b",
    "<table><tr><td rowspan=2>r<td>1<tr><td>2</table>": "r  1\n   2",
    "<table><tr><td>a<br>b<td>c</table>": "a  c\nb",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "<dl><dt>t<dd>d<dt>u</dl>": "t\n  d\nu",
    "</p></div>x</span><p>y</table>z": "x\n\nyz",
    "<a href='<b>'>l</a> <q>s</q>": 'l "s"',
    "<p>unclosed <b>bold<p>next</b>": "unclosed bold\n\nnext",
    "x < y <3 & z": "x < y <3 & z",
    "<select><option>a<option>b</select>": "a\nb",
    "<h1>T</h1><hr>": "T\n\n---",
    "<!DOCTYPE html><html><head><title>t</head><p>never closed title": "",
    # stray quotes, bare apostrophes, odd comments
    """<div class="a"">hello</div><p>one</p><a href="x">two</a><p>three""": "hello\n\none\n\ntwo\n\nthree",
    """<p data-x=it's>hello</p><p>world</p><p>it's fine</p>""": "hello\n\nworld\n\nit's fine",
    """<body><p>intro</p><input value="5" size=3"><p>rest "of" it""": 'intro\n\nrest "of" it',
    """<p>a<img alt=x">b<p>c""": "ab\n\nc",
    "<p>a<!-->b<p>c<!--->d": "ab\n\ncd",
    "<p>a<!-- x --!>b<!- y>c</ z>d</>e": "abcde",
    """<p title="a>b" 'x' =y=z "q">t</p class="x>y">u""": "t\n\nu",
    """<i hidden"">a</i><i hidden=''>b</i><i "hidden>c</i>""": "ac",
    "<script>x='</scripty>'</script >v": "v",
    "<style>@media not (hover: hover){.t{display:none}} @media not print{.u{display:none}} @media not print and (hover: hover){.w{display:none}}</style><i class=t>t</i><i class=u>u</i><i class=w>w</i>": "t",
    "<style>@supports (--x: y){.a{display:none}} @supports (inset-area: top){.b{display:none}} @supports not (shape: z){.c{display:none}} @supports (shape: z) or (display: grid){.d{display:none}} @supports (shape: z) and (display: grid){.e{display:none}}</style><i class=a>a</i><i class=b>b</i><i class=c>c</i><i class=d>d</i><i class=e>e</i>": "bce",
    "<table><tr><td rowspan=0>r<td>1<tr><td>2<tr><td>3</table>": "r  1\n   2\n   3",
    '<p>left<a href="never closed>lost': "left",
}


def test_layout_of_small_pages():
    for source, want in CASES.items():
        assert op.render(source) == want, source


def test_deep_nesting_and_long_pages_stay_linear():
    deep = "<div>" * 20000 + "x" + "</div>" * 20000
    assert op.render(deep) == "x"
    assert op.render("<table><tr><td>" * 300 + "y").strip() == "y"
    assert len(op.render("<p>a b</p>" * 50000).split("\n\n")) == 50000
    assert op.render("<" * 20000) and op.render("<a " * 5000) is not None


def test_table_of_pages(spark):
    rows = [(1, "u", "<p>a<p>b", 3), (1, "u", "<p>a<p>b", 3), (2, None, None, 4), (None, "v", "", 5)]
    got = op.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert sorted((str(r.page_id), str(r.url), r.text, r.n_chars, r.n_lines) for r in got) == [("1", "u", "a\n\nb", 4, 3), ("1", "u", "a\n\nb", 4, 3), ("2", "None", "", 0, 0), ("None", "v", "", 0, 0)]
    assert op.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def page(rng, depth, shown, words):
    """Markup of a random subtree and, in words, the visible words and the others; shown: displayed and visible above."""
    displayed, visible = shown
    out = []
    for _ in range(rng.randint(1, 4)):
        if rng.random() < 0.4 or depth == 0:
            word = f"w{len(words)}z"
            words[word] = displayed and visible
            out.append(f" {word} ")
            continue
        tag = rng.choice(["div", "p", "span", "b", "ul", "table", "section"])
        style, d, v = rng.choice([("", displayed, visible)] * 4 + [("display:none", False, visible), ("visibility:hidden", displayed, False), ("visibility:visible", displayed, True), ("display:none;display:inline", displayed, visible)])
        if rng.random() < 0.3:
            how = rng.choice(["gone", "back", "veiled", "paper"])
            mark, style = f" class={how}", ""
            d, v = {"gone": (False, visible), "back": (displayed, visible), "veiled": (displayed, False), "paper": (displayed, visible)}[how]
        else:
            mark = ""
        inner = page(rng, depth - 1, (d, v), words)
        inner = f"<li>{inner}</li>" if tag == "ul" else f"<tr><td>{inner}</td></tr>" if tag == "table" else inner
        odd = rng.choice([""] * 4 + [' "', " '", " it's", ' a="b""', " x=it's", ' y=5"', " =", "/ /"])  # never right before a value
        note = rng.choice([""] * 6 + ["<!-->", "<!--->", "<!-- > -- -->", "<!-- x --!>", "<? a 'b>", "</ c\">"])
        out.append(f"<{tag}{mark} style='{style}'{odd}>{note}{inner}</{tag}{odd}>")
    return "".join(out)


def test_visible_words_of_random_pages_come_out_and_hidden_ones_do_not():
    sheet = "<style>.back{display:none} @media print{.paper{display:none}} .gone{display:none} .back{display:revert} .veiled{visibility:hidden}</style>"
    for seed in range(300):
        words = {}
        # p and span may not hold blocks, which moves text but never hides it
        source = page(random.Random(seed), 5, (True, True), words).replace("<p ", "<article ").replace("</p", "</article")
        found = set(re.findall(r"w[0-9]+z", op.render(sheet + source)))
        assert found == {w for w, shown in words.items() if shown}, (seed, source)


def test_style_sheets_of_any_shape_end():
    for sheet in ("@media screen{" * 20000 + "p{display:none}", "{" * 20000, "}" * 20000, "a{b:c" * 20000, '"' * 9999 + "{", "a" * 200000, "@" * 5000, "p,p>p p{display:none}" * 2000):
        assert op.render(f"<style>{sheet}</style><i>v</i>").strip() == "v"
    assert op.render("<table><tr><td>" * 3000 + "deep").strip().endswith("deep")


def random_tree(rng, depth):
    """A list of words, "br" and (tag, children), a word first and a line end after words only; tables hold rows of cells."""
    out = ["w" * rng.randint(1, 5)]
    for _ in range(rng.randint(0, 4)):
        kind = rng.choice(["word", "word", "word", "br", "div", "p", "span", "ul", "ol", "table", "blockquote"]) if depth else "word"
        if kind == "word":
            out.append("w" * rng.randint(1, 5) + str(rng.randint(0, 9)))
        elif kind == "br":
            out += ["br"] * (out[-1] != "br" and isinstance(out[-1], str))
        elif kind == "table":
            out.append((kind, [[random_tree(rng, depth - 1) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 3))]))
        elif kind in ("ul", "ol"):
            out.append((kind, [random_tree(rng, depth - 1) for _ in range(rng.randint(1, 3))]))
        else:
            out.append((kind, random_tree(rng, depth - 1)))
    return out


def markup(nodes, rng):
    out = []
    for node in nodes:
        if isinstance(node, str):
            out.append("<br>" if node == "br" else f" {node} ")
            continue
        tag, inside = node
        if tag == "table":
            body = "".join("<tr>" + "".join(f"<td>{markup(c, rng)}" + rng.choice(["", "</td>"]) for c in row) + rng.choice(["", "</tr>"]) for row in inside)
        elif tag in ("ul", "ol"):
            body = "".join(f"<li>{markup(c, rng)}" + rng.choice(["", "</li>"]) for c in inside)
        else:
            body = markup(inside, rng)
        tag = "article" if tag == "p" and any(isinstance(n, tuple) for n in inside) else tag
        out.append(f"<{tag}>{body}</{tag}>")
    return "".join(out)


def laid_out(nodes, nested=False):
    """Lines of a flow and the gaps (0 none, 1 a line end, 2 a blank line) that it wants before and after: block by block, by recursion."""
    lines, gap, first, open_ = [], 0, 0, False

    def add(more):
        nonlocal gap, first, open_
        if not lines:
            first = gap
        elif gap == 2:
            lines.append("")
        lines.extend(more)
        gap = 0

    def flow(nodes):
        nonlocal gap, open_
        for node in nodes:
            if node == "br":
                gap, open_ = (max(gap, 1) if open_ else 2), False
            elif isinstance(node, str):
                if open_:
                    lines[-1] += " " + node
                else:
                    add([node])
                    open_ = True
            elif node[0] == "span":
                flow(node[1])
            else:
                tag, inside = node
                own, before, after = 1, 0, 0
                if tag == "table":
                    own = 2
                    cells = [[laid_out(c)[0] for c in row] for row in inside]
                    wide = [max((len(x) for row in cells if c < len(row) for x in row[c]), default=0) for c in range(max(map(len, cells)))]
                    rows = []
                    for row in cells:
                        for k in range(max(map(len, row))):
                            text = ""
                            for c, cell in enumerate(row):
                                if k < len(cell) and cell[k]:
                                    text = text.ljust(sum(w + 2 for w in wide[:c] if w)) + cell[k]
                            rows.append(text.rstrip())
                elif tag in ("ul", "ol"):
                    own, rows, after = 1 if nested else 2, [], 0
                    for i, item in enumerate(inside):
                        sign = f"{i + 1}. " if tag == "ol" else "- "
                        part, head, tail = laid_out(item, True)
                        part = [(sign + part[0]).rstrip(), *((" " * len(sign) + x).rstrip() for x in part[1:])] if part else [sign.rstrip()]
                        head, tail = max(1, head), max(1, tail)
                        if rows and max(after, head) == 2:
                            rows.append("")
                        before, after = (before if rows else head), tail
                        rows += part
                else:
                    own = 2 if tag in ("p", "blockquote") and not (tag == "p" and any(isinstance(n, tuple) for n in inside)) else 1
                    rows, before, after = laid_out(inside, nested)
                    rows = ["  " + x if x and tag == "blockquote" else x for x in rows]
                gap, open_ = max(gap, own, before), False
                if rows:
                    add(rows)
                    gap = max(own, after)

    flow(nodes)
    return lines, first, gap


def test_layout_of_random_pages_equals_a_plain_renderer():
    seen = 0
    for seed in range(1500):
        rng = random.Random(seed)
        tree = random_tree(rng, 4)
        want = laid_out(tree)[0]
        assert op.render(markup(tree, rng)).split("\n") == (want or [""]), (seed, markup(tree, random.Random(seed)), want)
        seen += len(want) > 5
    assert seen > 300
