"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

WS = re.compile("[^\x20\x09-\x0d]+")
ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def repeats(docs, length):
    """``(doc_id, n_words, n_removed, kept)`` of each row."""
    words = [WS.findall(t or "") for _, t in docs]
    times = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (doc, _), w in zip(docs, words):
        gone = {i + j for i in range(len(w) - length + 1) if times[tuple(w[i : i + length])] > 1 for j in range(length)}
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def near(docs, percent=85, size=5):
    """``(doc_id, n_shingles, component_id)`` of rows with different ids."""
    sets = {}
    for doc, text in docs:
        w = WS.findall(lower(text))
        sets[doc] = {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [(d, len(sets[d]), root(d)) for d in ids]


def contaminated(docs, items, window):
    """``(doc_id, n_words, n_hit, item_ids)`` of each row."""
    wanted = defaultdict(set)
    for item, text in items:
        w = ITEM_WORD.findall(lower(text))
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            wanted[tuple(w[i : i + size])].add(item)
    sizes, out = {len(k) for k in wanted}, []
    for doc, text in docs:
        w = ITEM_WORD.findall(lower(text))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (ids := wanted.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    found |= ids
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def personal(text):
    """Base spans as ``(start, order, kind, end)``."""
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), k, kind, m.end()) for k, (kind, pattern, ok) in enumerate(kinds) for m in re.finditer(pattern, text or "") if ok(m[0]))


def secrets(text):
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    kinds = [("assign", assign, lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    return sorted((m.start(), k, kind, m.end()) for k, (kind, pattern, ok) in enumerate(kinds) for m in pattern.finditer(text or "") if ok(m))


def listed(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(rows, key=str)


def markup(tree):
    return tree if isinstance(tree, str) else f"<{tree[0]}>{''.join(map(markup, tree[1]))}</{tree[0]}>"


def shown(page, gone=frozenset()):
    """Texts of a list of trees ``(tag, [text or tree])``, without the subtrees in ``gone``."""
    out = []
    for tree in page:
        if isinstance(tree, str):
            out.append(tree)
        elif markup(tree) not in gone:
            out += shown(tree[1], gone)
    return out


def site_texts(pages, least):
    """Text per page of ``(id, host, trees)`` without subtrees on ``least`` different pages of its host."""

    def subtrees(page):
        for tree in page:
            if not isinstance(tree, str):
                yield markup(tree)
                yield from subtrees(tree[1])

    on = defaultdict(set)
    for _, host, page in pages:
        for subtree in subtrees(page):
            on[host, subtree].add(tuple(shown(page)))
    gone = {host: {s for (h, s), found in on.items() if h == host and len(found) >= least} for _, host, _ in pages}
    return {i: "\n".join(shown(page, gone[host])) for i, host, page in pages}


def parsed(page):
    """Text, first title and links of a page."""
    text, title, links, hidden = [], [], {}, []

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag in ("p", "div", "br", "li"):
                text.append("\n")
            if tag == "a" and dict(attrs).get("href"):
                links[dict(attrs)["href"]] = None
            if tag in ("script", "title"):
                hidden.append(tag)
                text.append(" ")

        def handle_endtag(self, tag):
            if tag in ("p", "div", "li"):
                text.append("\n")
            if tag in ("script", "title") and hidden:
                hidden.pop()

        def handle_comment(self, data):
            text.append(" ")

        def handle_data(self, data):
            if hidden[-1:] == ["title"]:
                title.append(data)
            elif not hidden:
                text.append(data.replace("\n", " "))

    reader = Reader()
    reader.feed(page)
    reader.close()
    lines = [" ".join(x.split()) for x in "".join(text).split("\n")]
    return "\n".join(filter(None, lines)), [" ".join(t.split()) for t in title[:1]], list(links)
