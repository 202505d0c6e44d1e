"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def suffix_dedup(docs, size=400):
    count = Counter((t or "").encode()[i : i + size] for _, t in docs for i in range(len((t or "").encode()) - size + 1))
    out = []
    for d, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - size + 1):
            if count[raw[i : i + size]] > 1:
                gone[i : i + size] = b"\x01" * size
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(raw), sum(gone), runs, sha(bytes(b for b, g in zip(raw, gone, strict=True) if not g))))
    return out


_KEYS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = re.compile(rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def redact(text, mark="[secret]"):
    out, at = [], 0
    for s, _, _, e in secrets(text):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + (text or "")[at:] if out else text


def simhash(docs, most=4):
    import numpy as np
    import xxhash

    def fp(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        if not words:
            return 0
        hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [fp(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= most) + i + 1:
            x, y = sorted((find(i), find(int(j))))
            root[y] = x
    least = {}
    for i, (d, _) in enumerate(docs):
        least.setdefault(find(i), []).append(d)
    return [(d, format(f, "016x"), min(least[find(i)])) for i, ((d, _), f) in enumerate(zip(docs, fps, strict=True))]


def contamination(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for item, text in items:
        own = words(text)
        for k in range(max(1, len(own) - window + 1) if own else 0):
            windows.setdefault(tuple(own[k : k + window]), set()).add(item)
    out = []
    for d, t in docs:
        own, hit, ids = words(t), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(own) - n + 1):
                if found := windows.get(tuple(own[k : k + n])):
                    hit.update(range(k, k + n))
                    ids |= found
        out.append((d, len(own), len(hit), len(ids), sha(",".join(sorted(map(str, ids)))), bool(hit)))
    return out


def quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(inside), n < 20 or 100 * len(inside) > 30 * n


def coverage(text, lengths):
    """Shares of word characters inside n-grams and lines of a text that repeat."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    total, out = max(1, sum(map(len, words))), {}
    for n in lengths:
        grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        inside = {k for i in range(len(words) - n + 1) if grams[tuple(words[i : i + n])] > 1 for k in range(i, i + n)}
        out[n] = sum(len(words[k]) for k in inside) / total
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        solid = re.sub(r"[\x20\x09-\x0D]", "", line)
        if solid:
            again += len(solid) * (line in seen)
            seen.add(line)
    out["line"] = again / total
    return out


def judge(pages, rounds=300, damping=0.85):
    """Host, path, rule, verdict, trust and distrust of each page."""
    rules = [("com", "/", True), ("example.com", "/en/", False), ("www.example.com", "/en/", True), ("net", "/es/", False), ("net", "/fr/", False)]
    rows, found = [], Counter()
    for _, url, html in pages:
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host = lower(re.split(r"[/?#]", rest)[0])
        path = re.split(r"[?#]", rest)[0][len(host) :]
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        rows.append((host, path, max(fits, key=lambda r: len(r[0] + r[1]), default=None)))
        for m in re.findall(r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^"'\s>/?#]+)""", html or ""):
            if host and lower(m) not in ("", host):
                found[host, lower(m)] += 1
    hosts = {h for h, _, _ in rows if h}
    n = Counter(h for h, _, _ in rows if h)
    marked = {k: Counter(h for h, _, r in rows if h and r and r[2] is k) for k in (True, False)}
    out = Counter()
    for (a, _), c in found.items():
        out[a] += c
    links = {(a, b): c / out[a] for (a, b), c in found.items()}
    ends = {a for a, _ in links}

    def rank(seeds):
        now = dict(seeds)
        for _ in range(rounds):
            new = Counter({h: (1 - damping) * s for h, s in seeds.items()})
            for h, r in now.items():
                if h not in ends:
                    new[h] += damping * r
            for (a, b), w in links.items():
                new[b] += damping * w * now.get(a, 0)
            now = new
        return now

    def walk(seeds):
        every = {**{x: 0.0 for e in links for x in e}, **seeds}
        now = dict(every)
        for _ in range(rounds):
            got = Counter()
            for (a, b), w in links.items():
                got[a] += w * now[b]
            now = {h: (1 - damping) * s + damping * got[h] if h in ends else s for h, s in every.items()}
        return now

    good, base = rank({h: marked[True][h] / n[h] for h in hosts}), rank({h: 1.0 for h in hosts})
    trust = {h: good[h] / r if r else 0.0 for h, r in base.items()}
    distrust = walk({h: marked[False][h] / n[h] for h in hosts})
    for host, path, r in rows:
        allow = r[2] if r else not (host and distrust[host] > trust[host] and distrust[host] > 0.5)
        yield host, path, r and r[0] + r[1], "allow" if allow else "block", round(trust.get(host, 0.0), 6) if host else 0.0, round(distrust.get(host, 0.0), 6) if host else 0.0


def vocabulary(docs, slip=31):
    """Words of at least 7 letters and 2 occurrences, after slips, by one pass over all runs."""
    counts = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k:] == b[k + 1 :] or (len(a) == len(b) and a[k + 1 :] == b[k + 1 :])


def variants(docs, slip=31):
    """Rows of op12: every word against every other."""
    words, out = vocabulary(docs, slip), {}
    for w, n in words.items():
        near = [(-m, v) for v, m in words.items() if one_edit(w, v)]
        form = min(near)[1] if near and -min(near)[0] >= 10 * n else None
        out[w] = (form, n, len(near), words[form] if form else None)
    rows = []
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, n, n_near, form, form_n, root))
    return sorted(rows)


def lloyd(rows, k=8, rounds=10, dims=64, scale=1024, seed="3"):
    """Rows of op13 in plain integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    cents = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(cents)):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == j]
            if own:
                cents[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    last = [nearest(v) for _, v in kept]
    inertia = Counter()
    for d, j in last:
        inertia[j] += d
    key = lambda r: (r[0] is None, r)
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), cents[j]) for (i, _), (d, j) in zip(kept, last, strict=True)), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def gram_counts(text, bits=15, longest=4):
    """Places of a text's byte grams, with how often each comes."""
    raw = [32 if b < 128 and not chr(b).isalpha() else b + 32 if 65 <= b <= 90 else b for b in text.encode()]
    out = Counter()
    for size in range(1, longest + 1):
        for i in range(len(raw) - size + 1):
            gram = raw[i : i + size]
            if set(gram) != {32}:
                value = 0
                for b in gram:
                    value = value * 257 + b
                out[((value + size - 1) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - bits)] += 1
    return out, sum(b != 32 for b in raw)


def language(text, languages, idf, centroids, owner, least, sharpness=25):
    """Language, score, best cosine and the limit that it is held against."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0, 0.0, None
    tf, solid = gram_counts(text)
    x = {g: math.log1p(n) * float(idf[g]) for g, n in tf.items()}
    size = math.sqrt(sum(v * v for v in x.values())) or 1
    cosines = [sum(v * float(c[g]) for g, v in x.items()) / size for c in centroids]
    best = [max(c for c, o in zip(cosines, owner, strict=True) if o == k) for k in range(len(languages))]
    pick = max(range(len(best)), key=lambda k: (best[k], -k))
    score = 1 / sum(math.exp(sharpness * (b - best[pick])) for b in best)
    return languages[pick], score, best[pick], least[pick][min(15, int(math.log2(max(1, solid))))]


def edits(a, b):
    """Inserted, deleted, replaced letters and swapped neighbours (none edited again) from a to b."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


_REPORT = re.compile(r"\b(said|says|wrote|writes|quoted?|called|reported|according|dit|écrit|selon|sagte|schrieb|laut|dijo|escribió|según)\b")


def toxicity(text, terms, weights, logistic, window=60):
    """The score of one text."""
    import regex

    text = (text or "").lower()
    letter = [bool(regex.match(r"\p{L}", c)) for c in text] + [False] * 2
    other = [bool(regex.match(r"\p{N}", c)) or c in "*@$!#%" for c in text] + [False] * 2
    inside = [
        letter[i] or other[i] and i > 0 and (letter[i - 1] and (letter[i + 1] or other[i + 1] and letter[i + 2]) or letter[i + 1] and i > 1 and other[i - 1] and letter[i - 2])
        for i in range(len(text))
    ]
    words, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and inside[j]:
            j += 1
        if j > i:
            words.append((i, j))
        i = j + 1
    x = [0.0] * 5
    for b, e in words:
        word = text[b:e]
        hits = [(n, k) for k, t in enumerate(terms) if abs(len(t) - len(word)) <= 2 and (n := edits(t, word)) <= (2 if len(t) >= 9 else 1 if len(t) >= 4 else 0)]
        if hits:
            n, k = min(hits)
            before, after = text[max(0, b - window) : b], text[e : e + window]
            marks = "\"“”„«»‘’"
            quote = sum(before.count(q) for q in marks) % 2 == 1 and any(q in after for q in marks) or _REPORT.search(before[-window // 2 :]) is not None
            x[2 * quote + (n > 0)] += weights[k][n > 0]
    x[4] = (x[0] + x[1]) / math.sqrt(max(1, len(words)))
    z = logistic[-1] + sum(math.log1p(v) * w for v, w in zip(x, logistic, strict=False))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
