"""Main text against a plain recursive density, and pages with stray quotes, odd comments and random cuts."""

import math

import numpy as np
import pytest

from blockfield.llm import extraction

E = math.e


def text_of(node):
    return node if isinstance(node, str) else "".join(map(text_of, node[1]))


def counts(node):
    """(characters, tags, link characters, link tags) below a node."""
    if isinstance(node, str):
        return len("".join(node.split())), 0, 0, 0
    parts = [counts(x) for x in node[1]]
    c, t, lc, lt = (sum(p[i] for p in parts) for i in range(4))
    t += sum(1 for x in node[1] if not isinstance(x, str))
    lt += sum(1 for x in node[1] if not isinstance(x, str) and x[0] == "a")
    return c, t, (c if node[0] == "a" else lc), lt


def density(node, share):
    c, t, lc, lt = counts(node)
    if not c:
        return 0.0
    t, lt = max(t, 1), max(lt, 1)
    base = math.log(c * lc / max(c - lc, 1) + share * c + E)
    return c / t * math.log(max(c * t / (max(lc, 1) * lt), 1)) / max(math.log(max(base, 1)), 1)


def slow_main(root):
    """Blocks of the node that the densities choose; only div, p, ul and li blocks and links, so every element counts."""
    c, _, lc, _ = counts(root)
    share = lc / max(c, 1)
    blocks = []

    def walk(node, path):
        for x in node[1]:
            if not isinstance(x, str):
                walk(x, [*path, node])
        if node[0] != "a":
            sums = sum(density(x, share) for x in node[1] if not isinstance(x, str) and x[0] != "a")
            blocks.append((sums, node, path))

    walk(root, [])
    best = max(s for s, _, _ in blocks)
    _, lead, path = next(b for b in blocks if b[0] == best)
    chosen = lead if best else root
    if best:
        way = [lead, *reversed(path)]
        least = min(density(x, share) for x in way)
        for child, node in zip(way, way[1:]):
            if any(not isinstance(x, str) and x is not child and density(x, share) >= least for x in node[1]):
                chosen = node
    out, run = [], []

    def flush():
        joined = " ".join("".join(run).split())
        run.clear()
        if joined:
            out.append(joined)

    def emit(node):
        if isinstance(node, str):
            run.append(node)
            return
        if node[0] != "a":
            flush()
        for x in node[1]:
            emit(x)
        if node[0] != "a":
            flush()

    emit(chosen)
    flush()
    return "\n".join(out)


def page(node):
    return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(page, node[1]))}</{node[0]}>"


def random_tree(rng, depth=0):
    words = lambda: " ".join("w" * int(rng.integers(1, 9)) for _ in range(int(rng.integers(1, 60)))) + " "
    inner = lambda: [("a", [words()]) if rng.random() < 0.3 else words() for _ in range(int(rng.integers(1, 4)))]
    out = []
    for _ in range(int(rng.integers(1, 5))):
        kind = rng.random()
        if depth < 4 and kind < 0.45:
            out.append(("div", random_tree(rng, depth + 1)))
        elif kind < 0.85:
            out.append(("p", inner()))
        else:
            out.append(("ul", [("li", inner()) for _ in range(int(rng.integers(1, 5)))]))
    return out


@pytest.mark.parametrize("seed", range(60))
def test_equals_a_plain_density(seed):
    root = ("body", random_tree(np.random.default_rng(seed)))
    assert extraction.main_text("".join(map(page, root[1]))) == slow_main(root)


FIRST = "".join(f"<p>{'word ' * 40}{i}.</p>" for i in range(3))
SECOND = "".join(f"<p>{'more ' * 40}{i}.</p>" for i in range(3))


@pytest.mark.parametrize("probe", [
    "<p data=it's>", "<p it's>", '<p say="one>', "<!-->", "<!--->", "<!-- x --!>", "<!-- x -->", "<!---->", '<p title="a>b">', "<p title='a>b' x=\">", "<img alt=\"x' y=\"z>",
    "<br a=b'c>", "<b\n='x'>", "<p a = 'b>c'>", "<?php echo 'x' ?>", "<!doctype it's>"])
def test_malformed_markup_loses_no_text(probe):
    text = extraction.main_text(f"<html><body><div>{FIRST}{probe}{SECOND}</div></body></html>")
    assert text.count("word") == 120 and text.count("more") == 120


def test_random_quotes_and_cuts_never_fail_and_keep_the_text():
    rng = np.random.default_rng(9)
    whole = f"<html><body><div class='post' id=\"x\">{FIRST}<!-- note --><img alt='a b' src=x>{SECOND}</div></body></html>"
    for _ in range(300):
        at = int(rng.integers(0, len(whole)))
        extraction.main_text(whole[:at])
        extraction.main_text(whole[:at] + str(rng.choice(["'", '"', "<", ">", "<!--", "-->", "=", "='", '="', "</", "&#"])) + whole[at:])
    for _ in range(200):  # a quote in a text, or behind a tag's name
        spots = [i for i in range(len(whole)) if whole.startswith("<p>", i)]
        at = int(rng.choice(spots)) + int(rng.choice([2, 3]))
        text = extraction.main_text(whole[:at] + str(rng.choice([" '", ' "', "'", '"'])) + whole[at:])
        assert text.count("word") >= 119 and text.count("more") >= 119
