"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks: runs of text between tags that break lines.  Each block is a vector of its tag path
(tags, classes, ids and roles, hashed), its words (hashed) and a few ratios; a bidirectional LSTM in numpy reads the whole
sequence both ways, so a block is judged with the page around it, and says for each block whether it belongs to the article.

The network is trained when the operator starts, on pages that :func:`sample_pages` writes from a seed: articles in many
layouts among menus, headers, footers, sidebars, notices, adverts, forms and comments.  No row of the input is a training
row.  Markup that never shows (scripts, styles, head, templates) is not parsed into blocks at all.
"""

from __future__ import annotations

import html as _html
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import free_name, text_batches

PATH_SLOTS, WORD_SLOTS, EXTRA = 96, 64, 8
HIDDEN = 24
#: Training pages, passes over them and their seed.
PAGES, EPOCHS, SEED = 1000, 10, 5
#: Blocks that are labelled at a time: pages of like length go together.
BATCH_BLOCKS = 8_192

#: Elements whose content never shows as text.
HIDDEN_TAGS = ("script", "style", "noscript", "template", "head", "svg", "iframe", "object", "canvas", "audio", "video", "select", "textarea", "datalist")
#: Elements inside a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img ruby rt rp nobr math mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen".split())
#: An opening tag closes these open elements.
CLOSES = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BLOCKS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_MARK = re.compile(r"[>\"']")
_DIGITS = "0123456789"
#: Elements that lie deeper than this are taken as lying side by side, as browsers do.
DEPTH = 512
_ATTR = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in HIDDEN_TAGS}
#: Where a hidden element that no end tag closes ends: at the next of these.
_RESUME = re.compile(r"(?=<(?:p|div|section|article|main|aside|nav|header|footer|h[1-6]|ul|ol|table|form|blockquote|pre)\b)", re.I)
_BODY = re.compile(r"(?=<body\b)", re.I)
_SPLIT = re.compile(r"[^a-z]+")


def _slot(name: str, slots: int) -> int:
    import zlib

    return zlib.crc32(name.encode()) % slots


class _Tags:
    """Markup of a page, one piece after the other, in time linear in the page.

    A tag ends at the first ``>`` outside quotes.  Once a tag runs to the page's end that way, quotes are no longer heeded, so
    that a page of broken tags is not read again and again; behind the last ``>`` there are no tags at all.
    """

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def _end(self, at: int) -> int:
        i = at
        while self.quotes:
            m = _MARK.search(self.page, i)
            if not m:
                self.quotes = False
                break
            if m[0] == ">":
                return m.start()
            close = self.page.find(m[0], m.end())
            i = close + 1 if close >= 0 else m.end()
        return self.page.find(">", at)

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, past, slash, name, attributes) of the next markup from ``at`` on; the name is empty for what is no tag."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), "", "", ""
            if start > self.last:
                return None
            if page.startswith(("<!", "<?"), start):
                return start, page.find(">", start) + 1, "", "", ""
            if m := _NAME.match(page, start + 1):
                end = self._end(m.end())
                return start, end + 1, m[1], m[2].lower(), page[m.end() : end]
            at = start + 1
        return None


class Path:
    """The names of open elements, outermost first: a node under the path of the enclosing ones.

    Equal paths of a page are one node, which its blocks share, and a node's features come from its parent's; so blocks
    cost the same however deep they lie.
    """

    __slots__ = ("parent", "own", "size", "kids", "counts", "row")

    def __init__(self, parent: Path | None = None, own: tuple[str, ...] = ()):
        self.parent, self.own, self.size = parent, own, (len(parent) if parent is not None else 0) + len(own)
        self.kids: dict[tuple[str, ...], Path] = {}
        self.counts = self.row = None

    def under(self, own: tuple[str, ...]) -> Path:
        """The path with one more element."""
        found = self.kids.get(own)
        if found is None:
            found = self.kids[own] = Path(self, own)
        return found

    def nodes(self) -> list[Path]:
        """This node and those above it, innermost first."""
        out, at = [], self
        while at is not None:
            out.append(at)
            at = at.parent
        return out

    def __len__(self) -> int:
        return self.size

    def __iter__(self):
        return (name for node in reversed(self.nodes()) for name in node.own)

    def __getitem__(self, i):
        return tuple(self)[i]

    def __eq__(self, other) -> bool:
        return self is other or (isinstance(other, (tuple, Path)) and tuple(self) == tuple(other))

    __hash__ = object.__hash__

    def features(self):
        """Hashed counts of the names; the innermost four weigh more."""
        import numpy as np

        if self.row is None:
            todo, at = [], self
            while at is not None and at.counts is None:
                todo.append(at)
                at = at.parent
            for node in reversed(todo):
                node.counts = np.zeros(PATH_SLOTS, dtype=np.float32) if node.parent is None else node.parent.counts.copy()
                for name in node.own:
                    node.counts[_slot(name, PATH_SLOTS)] += 1
            self.row = 0.6 * self.counts
            near, at = 4, self
            while near and at is not None:
                for name in at.own[::-1][:near]:
                    self.row[_slot(name, PATH_SLOTS)] += 0.4
                near, at = near - min(near, len(at.own)), at.parent
            self.row = np.minimum(self.row, 1.5)
        return self.row


def blocks(page: str | None) -> list[tuple[str, Path, int]]:
    """(text, path, characters in links) of each leaf block with text, in page order.

    The path holds the open elements that break lines, outermost first, each as its tag and the words of its class, id and
    role; character references are decoded and white space is one space.
    """
    out: list[tuple[str, Path, int]] = []
    page = page or ""
    root = Path()
    stack: list[tuple[str, Path]] = []
    opened: dict[str, int] = {}
    held: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(_html.unescape("".join(held)).split())
            if text:
                out.append((text, stack[-1][1] if stack else root, linked))
            held.clear()
        linked = 0

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            opened[stack.pop()[0]] -= 1

    n = len(page)
    tags, held_head = _Tags(page), False
    unclosed: set[str] = set()
    while at < n:
        m = tags.after(at)
        start, past, slash, tag, attributes = m or (n, n, "", "", "")
        if text := page[at:start]:
            held.append(text)
            if in_link:
                linked += len(text)
        at = past
        if not tag:
            continue
        if slash:
            if tag in INLINE:
                if tag == "a":
                    in_link = 0
                continue
            flush()
            in_link = 0
            if opened.get(tag):
                at_top = len(stack) - 1
                while stack[at_top][0] != tag:
                    at_top -= 1
                close(at_top)
            continue
        if tag in HIDDEN_TAGS:
            if tag not in ("select", "textarea", "datalist"):
                flush()
            if attributes.endswith("/") or (tag == "head" and held_head):
                continue
            held_head = held_head or tag == "head"
            end = None if tag in unclosed else _RAW_END[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in ("script", "style"):  # raw text to the end
                at = n
            else:
                unclosed.add(tag)
                resume = (_BODY if tag == "head" else _RESUME).search(page, at)
                at = resume.start() if resume else at if tag == "head" else n
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 1
            continue
        flush()
        in_link = 0
        if tag in VOID:
            continue
        if tag in _BLOCKS_P and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        for i in range(len(stack) - 1, -1, -1) if tag in CLOSES else ():
            if stack[i][0] in CLOSES[tag]:
                close(i)
                break
            if stack[i][0] in ("ul", "ol", "dl", "table", "article", "section", "div", "nav"):
                break
        names = [tag]
        for a in _ATTR.finditer(attributes):
            names += [f".{w}" for w in _SPLIT.split((a[2] or a[3] or a[4] or "").lower()) if len(w) > 1]
        if len(stack) < DEPTH:
            stack.append((tag, (stack[-1][1] if stack else root).under(tuple(names))))
            opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


def vectors(page_blocks):
    """A row of features for each block of a page."""
    import numpy as np

    x = np.zeros((len(page_blocks), PATH_SLOTS + WORD_SLOTS + EXTRA), dtype=np.float32)
    n = len(page_blocks)
    for i, (text, path, linked) in enumerate(page_blocks):
        x[i, :PATH_SLOTS] = path.features()
        words = [hash_word(w) for w in text.split(" ")]
        x[i, PATH_SLOTS : PATH_SLOTS + WORD_SLOTS] = np.bincount(words, minlength=WORD_SLOTS) / len(words)
        k = PATH_SLOTS + WORD_SLOTS
        size = len(text)
        x[i, k : k + EXTRA] = (min(size, 2000) ** 0.5 / 20, min(1.0, linked / size), size < 25, text[-1] in ".!?:;\"'”»…", i / n, sum(text.count(c) for c in "©|»·") / (size**0.5), 4 * sum(map(text.count, _DIGITS)) / size, 1.0)
    return x


_words: dict[str, int] = {}


def hash_word(w: str) -> int:
    at = _words.get(w)
    if at is None:
        if len(_words) > 200_000:
            _words.clear()
        at = _words[w] = _slot(w.lower(), WORD_SLOTS)
    return at


def _sigmoid(x):
    import numpy as np

    return 0.5 * (np.tanh(0.5 * x) + 1)


class Labeller:
    """Bidirectional LSTM over sequences of block vectors, one logit per block."""

    def __init__(self, seed: int = SEED, inputs: int = PATH_SLOTS + WORD_SLOTS + EXTRA, hidden: int = HIDDEN):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.h = hidden
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = rng.normal(0, 1 / np.sqrt(inputs), (inputs, 4 * hidden)).astype(np.float32)
            self.w[f"h{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
            self.w[f"c{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
        self.w["o"] = rng.normal(0, 0.1, (2 * hidden,)).astype(np.float32)
        self.w["ox"] = np.zeros(inputs, dtype=np.float32)
        self.w["oc"] = np.zeros(1, dtype=np.float32)

    def _run(self, x, mask, d: str, keep: bool):
        """States of one direction; x (steps, rows, inputs) padded at the end of time, mask (steps, rows)."""
        import numpy as np

        steps, rows, _ = x.shape
        pre = (x.reshape(steps * rows, -1) @ self.w[f"x{d}"]).reshape(steps, rows, -1) + self.w[f"c{d}"]
        h, c = np.zeros((rows, self.h), np.float32), np.zeros((rows, self.h), np.float32)
        out, memory = np.zeros((steps, rows, self.h), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = pre[t] + h @ self.w[f"h{d}"]
            gates, new = _sigmoid(g[:, : 3 * self.h]), np.tanh(g[:, 3 * self.h :])
            i, f, o = gates[:, : self.h], gates[:, self.h : 2 * self.h], gates[:, 2 * self.h :]
            m = mask[t][:, None]
            was_c, was_h = c, h
            full = f * c + i * new
            c = np.where(m, full, c)
            th = np.tanh(full)
            h = np.where(m, o * th, h)
            out[t] = h
            if keep:
                memory.append((t, i, f, o, new, was_c, was_h, th, m))
        return out, memory

    def logits(self, x, mask):
        """(steps, rows) logits."""
        f, _ = self._run(x, mask, "f", False)
        b, _ = self._run(x, mask, "b", False)
        return f @ self.w["o"][: self.h] + b @ self.w["o"][self.h :] + x @ self.w["ox"] + self.w["oc"]

    def gradients(self, x, mask, y):
        import numpy as np

        f, mf = self._run(x, mask, "f", True)
        b, mb = self._run(x, mask, "b", True)
        z = f @ self.w["o"][: self.h] + b @ self.w["o"][self.h :] + x @ self.w["ox"] + self.w["oc"]
        dz = np.where(mask, _sigmoid(z) - y, 0).astype(np.float32) / mask.sum()
        flat = dz.reshape(-1)
        g = {"o": np.concatenate([flat @ f.reshape(-1, self.h), flat @ b.reshape(-1, self.h)]), "ox": flat @ x.reshape(len(flat), -1), "oc": np.array([flat.sum()])}
        for d, memory, part in (("f", mf, self.w["o"][: self.h]), ("b", mb, self.w["o"][self.h :])):
            dh, dc = np.zeros_like(memory[0][5]), np.zeros_like(memory[0][5])
            dpre = np.zeros((*x.shape[:2], 4 * self.h), np.float32)
            gh = np.zeros_like(self.w[f"h{d}"])
            for t, i, fg, o, new, was_c, was_h, th, m in reversed(memory):
                dh = dh + dz[t][:, None] * part
                own = np.where(m, dh, 0)
                full = np.where(m, dc, 0) + own * o * (1 - th * th)
                dg = np.concatenate([full * new * i * (1 - i), full * was_c * fg * (1 - fg), own * th * o * (1 - o), full * i * (1 - new * new)], axis=1)
                dpre[t] = dg
                gh += was_h.T @ dg
                dc = np.where(m, full * fg, dc)
                dh = np.where(m, 0, dh) + dg @ self.w[f"h{d}"].T
            g[f"x{d}"] = x.reshape(len(flat), -1).T @ dpre.reshape(len(flat), -1)
            g[f"h{d}"], g[f"c{d}"] = gh, dpre.sum(axis=(0, 1))
        return g

    def fit(self, pages: list, epochs: int = EPOCHS, batch: int = 16, rate: float = 0.02, seed: int = SEED) -> None:
        """Adam over (vectors, labels) pages."""
        import numpy as np

        rng = np.random.default_rng(seed)
        first, second, step = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}, 0
        total = epochs * -(-len(pages) // batch)
        for _ in range(epochs):
            order = sorted(rng.permutation(len(pages)), key=lambda i: len(pages[i][0]) // 8)
            groups = [order[i : i + batch] for i in range(0, len(order), batch)]
            for k in rng.permutation(len(groups)):
                x, mask = padded([pages[i][0] for i in groups[k]])
                y = np.zeros(mask.shape, np.float32)
                for c, i in enumerate(groups[k]):
                    y[: len(pages[i][1]), c] = pages[i][1]
                g = self.gradients(x, mask, y)
                size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                step += 1
                now = rate * (1 - 0.9 * step / total)
                for name, v in g.items():
                    v = v * min(1.0, 1.0 / (size + 1e-9))
                    first[name] = 0.9 * first[name] + 0.1 * v
                    second[name] = 0.99 * second[name] + 0.01 * v * v
                    self.w[name] = (self.w[name] - now * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def padded(rows: list):
    import numpy as np

    steps = max(len(r) for r in rows)
    x, mask = np.zeros((steps, len(rows), rows[0].shape[1]), np.float32), np.zeros((steps, len(rows)), dtype=bool)
    for i, r in enumerate(rows):
        x[: len(r), i], mask[: len(r), i] = r, True
    return x, mask


def sample_pages(count: int = PAGES, seed: int = SEED) -> list[tuple[str, list[str]]]:
    """(html, article blocks) pages with text of made-up words; every part of a layout comes and goes by chance."""
    import random

    rng = random.Random(seed)
    sounds = [a + b for a in "b c d f g l m n p r s t v".split() for b in "a e i o u an en er on is é ü".split()]
    lexicon = ["".join(rng.choice(sounds) for _ in range(rng.choice((1, 1, 2, 2, 3)))) for _ in range(4000)]

    def words(lo: int, hi: int) -> str:
        return " ".join(rng.choice(lexicon) for _ in range(rng.randint(lo, hi)))

    def sentence(lo: int = 4, hi: int = 22) -> str:
        w = words(lo, hi)
        return w[0].upper() + w[1:] + rng.choice(("." * 6) + "?!")

    def prose(lo: int = 1, hi: int = 9) -> str:
        plain = phrase(lo, hi)
        if rng.random() < 0.75:
            return plain
        # numbers, addresses and signs stand anywhere
        w = plain.split(" ")
        for _ in range(rng.randint(1, 4)):
            w.insert(rng.randint(0, len(w)), rng.choice((str(rng.randint(0, 10**rng.randint(1, 16))), f"+{rng.randint(1, 99)} ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}", f"{words(1, 1)}@{words(1, 1)}.example.com", f'"{words(1, 3)}"', f"{rng.getrandbits(128):x}", f"https://{words(1, 1)}.example.org/{rng.randint(1, 999)}", "©", "&", "|", "·", "<b>", f"10.{rng.randint(0, 255)}.0.{rng.randint(1, 255)}")))
        return " ".join(w)

    def phrase(lo: int, hi: int) -> str:
        kind = rng.random()
        if kind < 0.06:
            return " ".join(w + rng.choice(("***", "%%%", "###", "!!")) for w in words(8, 60).split())
        if kind < 0.1:
            return " | ".join(words(3, 30).split())
        if kind < 0.14:
            return " ".join(f"{w} " * rng.randint(2, 14) for w in words(1, 9).split()).strip()
        if kind < 0.17:
            return " ".join(f"{w}!!" for w in words(3, 40).upper().split())
        if kind < 0.27:
            return sentence(1, 4)
        return " ".join(sentence() for _ in range(rng.randint(lo, hi)))

    def attr(*names: str) -> str:
        kind = rng.random()
        if kind < 0.25:
            return ""
        name = rng.choice(names) + rng.choice(("", "", "", "-wrap", "-inner", "-box", "-1", "_area"))
        return f' class="{name}"' if kind < 0.75 else f' id="{name}"' if kind < 0.9 else f' class="{name} {words(1, 1)}"'

    def named(*names: str) -> str:
        while not (a := attr(*names)):
            pass
        return a

    def links(lo: int, hi: int) -> str:
        items = "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(rng.randint(lo, hi)))
        return f"<ul>{items}</ul>"

    def menu() -> str:
        body = links(3, 9) if rng.random() < 0.8 else " ".join(f'<a href="#">{words(1, 2)}</a>' for _ in range(rng.randint(3, 8)))
        return rng.choice((f"<nav{attr('menu', 'nav', 'main-nav')}>{body}</nav>", f"<div{named('menu', 'nav', 'navbar', 'navigation', 'topnav', 'breadcrumb')}>{body}</div>", f"<nav>{body}</nav>"))

    def head() -> str:
        inner = rng.choice((f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 8)}</p>", f'<a href="/">{words(1, 2)}</a>', f"<div>{words(1, 4)}</div><p>{sentence()}</p>"))
        return rng.choice((f"<header{attr('site-header', 'top', 'masthead', 'header')}>{inner}{menu() if rng.random() < 0.4 else ''}</header>", f"<div{named('header', 'masthead', 'topbar', 'site-header', 'banner', 'logo')}>{inner}</div>"))

    def foot() -> str:
        inner = rng.choice((f"&copy; {words(1, 2)} &middot; {prose(1, 2)}", f"<p>&copy; 20{rng.randint(10, 29)} {words(1, 3)}. All rights reserved.</p>{links(2, 6)}", f"<p>{sentence()}</p><p>{words(2, 6)}</p>", f"{words(3, 9)}\n{sentence()}"))
        return rng.choice((f"<footer{attr('footer', 'site-footer', 'bottom')}>{inner}</footer>", f"<footer>{inner}</footer>", f"<div{named('footer', 'copyright', 'bottom', 'colophon', 'site-footer')}>{inner}</div>"))

    def side() -> str:
        inner = rng.choice((f"<h3>{words(1, 3)}</h3>{links(3, 8)}", f"<h4>{words(1, 3)}</h4><p>{prose(1, 3)}</p>", f"<p>{prose(1, 3)}</p>", prose(1, 2)))
        return rng.choice((f"<aside{attr('sidebar', 'related', 'widget')}>{inner}</aside>", f"<div{named('sidebar', 'widget', 'related', 'side', 'recommended', 'popular', 'trending', 'more-stories', 'promo')}>{inner}</div>", f"<section{named('related', 'sidebar', 'recommended')}>{inner}</section>"))

    def advert() -> str:
        inner = rng.choice((prose(1, 2), f"<p>{prose(1, 2)}</p>", f'<a href="#">{words(2, 8)}</a>'))
        return f"<div{rng.choice((' class=\"ad\"', ' class=\"ads\"', named('ad', 'advert', 'ads', 'advertisement', 'sponsor', 'sponsored', 'promo', 'banner-ad')))}>{inner}</div>"

    def notice() -> str:
        inner = rng.choice((f"<p>{prose(1, 3)}</p><button>{words(1, 2)}</button>", f"{prose(1, 2)} <a href='#'>{words(1, 2)}</a>", f"<p>{prose(1, 2)}</p>"))
        return f"<{(t := rng.choice(('div', 'div', 'section', 'dialog')))}{named('cookie', 'consent', 'notice', 'gdpr', 'cookie-banner', 'popup', 'modal', 'alert', 'newsletter', 'paywall', 'subscribe', 'privacy')}>{inner}</{t}>"

    def form() -> str:
        return f"<form{attr('search', 'newsletter', 'login', 'signup', 'contact', 'subscribe')}>{rng.choice(('<label>' + words(1, 4) + '</label>', '<p>' + sentence() + '</p>', '<fieldset><legend>' + words(1, 3) + '</legend>' + words(2, 6) + '</fieldset>'))}<input type='text'><button>{words(1, 2)}</button></form>"

    def comments() -> str:
        one = lambda: rng.choice((f"<div{named('comment', 'reply', 'comment-body')}><p>{prose(1, 4)}</p></div>", f"<li{named('comment', 'reply')}><b>{words(1, 2)}</b><p>{prose(1, 3)}</p></li>", f"<p>{prose(1, 4)}</p>", f"<article{named('comment', 'reply')}><p>{prose(1, 3)}</p></article>"))
        inner = (f"<h3>{words(1, 3)}</h3>" if rng.random() < 0.6 else "") + "".join(one() for _ in range(rng.randint(1, 6)))
        return f"<{(t := rng.choice(('div', 'section', 'ul', 'ol')))}{named('comments', 'comment-list', 'discussion', 'responses', 'replies', 'disqus', 'reader-comments')}>{inner}</{t}>"

    def share() -> str:
        return f"<div{named('share', 'social', 'tags', 'byline', 'meta', 'pager', 'share-buttons', 'toolbar')}>{words(1, 5)}</div>"

    out = []
    extras = (advert, notice, side, form, share)
    for _ in range(count):
        truth: list[str] = []

        def main_text(s: str) -> str:
            truth.append(" ".join(s.split()))
            return _html.escape(s)

        body = []
        if rng.random() < 0.85:
            body.append(f"<h{(k := rng.choice((1, 1, 1, 2)))}>{main_text(words(2, 10))}</h{k}>")
        if rng.random() < 0.15:
            body.append(share())
        for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 13, 20))):
            kind = rng.random()
            if kind < 0.1:
                body.append(f"<p><b>{main_text(prose())}<br>")
            elif kind < 0.16:
                body.append(f"<h{(k := rng.choice((2, 3)))}>{main_text(words(1, 8))}</h{k}>")
            elif kind < 0.23:
                body.append("<ul>" + "".join(f"<li>{main_text(prose(1, 2))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.27:
                body.append(f"<blockquote>{rng.choice(('<p>', ''))}{main_text(prose())}</blockquote>")
            elif kind < 0.3:
                body.append("<table>" + "".join(f"<tr><td>{main_text(words(1, 4))}</td><td>{main_text(words(1, 4))}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif kind < 0.33:
                body.append(f"<pre>{main_text(words(3, 20))}</pre>")
            elif kind < 0.36:
                body.append(f"<figure><figcaption>{main_text(sentence())}</figcaption></figure>")
            elif kind < 0.42:
                body.append(f"<div{attr('text', 'paragraph', 'content')}>{main_text(prose())}</div>")
            else:
                body.append(f"<p{attr('text', 'lead', 'para') if rng.random() < 0.2 else ''}>{main_text(prose())}</p>")
            if rng.random() < 0.07:
                body.append(rng.choice((advert, advert, notice, side, form, share))())
        kind = rng.random()
        text = "".join(body)
        if kind < 0.62:
            story = f"<article{attr('post', 'article', 'entry', 'story') if rng.random() < 0.4 else ''}>{text}{comments() if rng.random() < 0.08 else ''}</article>"
        elif kind < 0.76:
            story = f"<main{attr('content', 'main')}>{text}</main>"
        else:
            story = f"<{(t := rng.choice(('div', 'section')))}{named('content', 'post', 'article', 'entry', 'story', 'article-body', 'post-content', 'main', 'entry-content', 'text')}>{text}</{t}>"
        if rng.random() < 0.2:
            story = f"<main>{story}</main>"
        top = [f() for f, p in ((head, 0.4), (menu, 0.8), (notice, 0.2), (form, 0.15), (advert, 0.5), (side, 0.15)) if rng.random() < p]
        rng.shuffle(top)
        low = [f() for f, p in ((share, 0.15), (comments, 0.35), (side, 0.3), (advert, 0.2), (form, 0.2), (menu, 0.1)) if rng.random() < p]
        rng.shuffle(low)
        if rng.random() < 0.9:
            low.append(foot())
        if rng.random() < 0.15:
            low.append(rng.choice(extras)())
        if rng.random() < 0.06:
            story, truth = "", []
        page = "".join(top) + story + "".join(low)
        if rng.random() < 0.3:
            page = f"<div{attr('page', 'wrapper', 'container')}>{page}</div>"
        out.append((f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{page}</body></html>", truth))
    return out


def labelled(page: str, truth: list[str]) -> tuple[list, list[int]]:
    """Blocks of a made page and whether each is one of the article's, in order."""
    found, labels, at = blocks(page), [], 0
    for text, _, _ in found:
        hit = at < len(truth) and text == truth[at]
        labels.append(int(hit))
        at += hit
    if at != len(truth):
        raise ValueError(f"article blocks that the page lost: {truth[at]!r}")
    return found, labels


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    rows = []
    for page, truth in sample_pages(pages, seed):
        found, labels = labelled(page, truth)
        if found:
            rows.append((vectors(found), labels))
    model = Labeller(seed)
    model.fit(rows, epochs, seed=seed)
    return model


def main_texts(model: Labeller, pages: list[str | None]) -> list[str]:
    """The article of each page: its blocks joined by one line end each."""
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, f in enumerate(found) if f), key=lambda i: len(found[i]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and len(found[order[to]]) * (to + 1 - at) <= BATCH_BLOCKS:
            to += 1
        x, mask = padded([vectors(found[i]) for i in order[at:to]])
        z = model.logits(x, mask)
        for c, i in enumerate(order[at:to]):
            out[i] = "\n".join(b[0] for b, v in zip(found[i], z[:, c]) if v > 0)
        at = to
    return out


def extract(pages: DataFrame, html: str = "html", model: Labeller | None = None) -> DataFrame:
    """``pages`` with ``main_text`` and ``n_chars`` (its code points) in place of ``html``; no shuffle.

    Null and empty html give an empty text, and so does a page without an article.  Pages of any length are read whole, in time
    linear in their length whatever their markup; equal pages give equal texts, and a block whose odds are even is left out; no rows give no rows; new columns whose names are taken get underscores in front.
    """
    text_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast((model or trained()).w)
    text, size = free_name(pages, "main_text"), free_name(pages, "n_chars")

    def read(column):
        import pandas as pd

        net = Labeller()
        net.w = shared.value
        out: list[str] = []
        values = column.tolist()
        at = 0
        while at < len(values):  # about 8 MB of pages at a time
            to, held = at, 0
            while to < len(values) and (to == at or held < 8_000_000):
                held += len(values[to] or "")
                to += 1
            out += main_texts(net, values[at:to])
            at = to
        return pd.Series(out, dtype=object)

    done = pages.withColumn(text, F.pandas_udf(read, "string")(F.col(html).cast("string")))
    return done.withColumn(size, F.length(text).cast("long")).drop(html)
