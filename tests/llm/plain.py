"""Plain versions of the operators, row by row, for small inputs."""

import hashlib
import re


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k):
    w = spaced(fold(text))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def groups(texts, k, pct):
    """{id: smallest id reachable over links}, by comparing every pair."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= pct * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def windows(text, size=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))
    if not w:
        return w, set()
    return w, {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def contamination(text, items):
    """(number of words, covered words, ids of items with a window in the text)."""
    words, _ = windows(text)
    hit, found = set(), set()
    for item, item_text in items:
        for w in windows(item_text)[1]:
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found.add(item)
    return len(words), len(hit), sorted(found)


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = spaced(text)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeated = {i + j for places in at.values() if len(places) > 1 for i in places for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if spaced(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated)


def secrets(text):
    text = text or ""
    assign = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def personal(text):
    text = text or ""

    def digits(s):
        return re.sub("[^0-9]", "", s)

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ips = re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
    out += [("ip", *m.span()) for m in ips if all(int(p) <= 255 for p in m[0].split("."))]
    cards = re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
    out += [("card", *m.span()) for m in cards if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    phones = re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
    out += [("phone", *m.span()) for m in phones if 8 <= len(digits(m[0])) <= 15]
    return [f"{k}:{a}:{b}" for k, a, b in out]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
