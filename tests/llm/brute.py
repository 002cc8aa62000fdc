"""Plain restatements that the operators are held against."""

import hashlib
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def targets(sizes, weights=(5, 2, 1), most=3):
    """sizes: {source: words}; rounds of sharing until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    cap, done, left = {s: most * sizes[s] for s in order}, {}, float(sum(sizes.values()))
    open_ = list(order)
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > cap[s]]
        if not over:
            return done | {s: left * w[s] / total for s in open_}
        for s in over:
            done[s] = cap[s]
        left -= sum(cap[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return done


def luhn(digits):
    total = 0
    for k, ch in enumerate(reversed(digits)):
        v = int(ch) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PII):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def base_hash(text):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in base_spans(text)).encode()).hexdigest()


def rules(text):
    w = words(text)
    seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {p for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    lines, repeats = set(), 0
    for x in (text or "").split("\n"):
        if WORD.search(x):
            repeats += x in lines
            lines.add(x)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), repeats, len(covered), n < 50 or 100 * len(covered) > 50 * n


def near(docs, threshold=0.8):
    """{row: (least linked id, links)} over (id, text) rows; sets of five-word shingles."""
    sets = []
    for _, t in docs:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    up, links = list(range(len(docs))), [0] * len(docs)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        least[root(i)].append(d)
    return [(min(least[root(i)]), links[i]) for i in range(len(docs))]


def long_repeats(docs, n):
    """Ids of documents that share a run of n words with another document."""
    held = defaultdict(set)
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - n + 1):
            held[tuple(w[i : i + n])].add(d)
    return {d for v in held.values() if len(v) > 1 for d in v}


def repeated_lines(docs, least=8):
    """{row: sorted (start, end) runs}: lines in a least run of so many words that stands earlier by (id, line), without overlap."""
    first, at = {}, defaultdict(list)
    for row, (d, t) in sorted(enumerate(docs), key=lambda x: (x[1][0] is not None, x[1][0] or 0)):
        ls = [x for x in (t or "").split("\n") if WORD.search(x)]
        n = [len(words(x)) for x in ls]
        for i in range(len(ls)):
            j = next((j for j in range(i + 1, len(ls) + 1) if sum(n[i:j]) >= least), None)
            if j is None or sum(n[i + 1 : j]) >= least:
                continue
            row0, i0 = first.setdefault(tuple(ls[i:j]), (row, i))
            if docs[row0] != docs[row] or i - i0 >= j - i:
                at[row].append((i, j))
    runs = {}
    for row, found in at.items():
        out = []
        for i, j in found:
            if out and i <= out[-1][1]:
                out[-1] = (out[-1][0], max(j, out[-1][1]))
            else:
                out.append((i, j))
        runs[row] = out
    return runs


class Page(HTMLParser):
    """Text, title and links of a well-formed page, by the standard library's parser."""

    BLOCK = "address article aside blockquote body br center dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section select table tbody td tfoot th thead title tr ul".split()

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.titles, self.hidden, self.inside = [], [], [], [], False
        self.feed(page)
        self.close()
        clean = lambda t: re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[ \t\r\f]+", " ", t.replace("\xa0", " "))).strip(" \n")
        self.text, self.title = clean("".join(self.out)), clean("".join(self.titles))

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "template"):
            self.hidden.append(tag)
        elif not self.hidden:
            self.out += ["\n"] * (tag in self.BLOCK)
            self.links += [v for k, v in attrs[:] if tag == "a" and k == "href"][:1]
            self.inside |= tag == "title"

    def handle_endtag(self, tag):
        if self.hidden:
            if tag == self.hidden[0]:
                self.hidden = []
                self.out.append(" ")
        else:
            self.out += ["\n"] * (tag in self.BLOCK)
            self.inside &= tag != "title"

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)
            self.titles += [data] * self.inside

    def handle_comment(self, data):
        if not self.hidden:
            self.out.append(" ")


def mil_score(m, passages):
    """Gated attention over the features of passages, number by number."""
    import math

    sig = lambda x: 1 / (1 + math.exp(-x))
    total, mean = 0.0, [0.0] * len(m["b1"])
    for x in passages:
        h = [max(0.0, sum(float(a) * float(w) for a, w in zip(x, m["w1"][:, k], strict=True)) + float(m["b1"][k])) for k in range(len(mean))]
        e = 0.0
        for j in range(len(m["a"])):
            t, g = (sum(h[k] * float(m[n][k, j]) for k in range(len(h))) for n in ("v", "u"))
            e += math.tanh(t) * sig(g) * float(m["a"][j])
        total += math.exp(e)
        mean = [a + math.exp(e) * b for a, b in zip(mean, h, strict=True)]
    return sig(sum(a / total * float(w) for a, w in zip(mean, m["w"], strict=True)) + float(m["b"][0]))
