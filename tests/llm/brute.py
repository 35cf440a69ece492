"""Plain Python versions of the operators, straight from their definitions."""

from __future__ import annotations

import collections
import hashlib
import re
import struct
import zlib

BLANKS = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return (text or "").encode().split()


def shards(docs, k):
    total, before, out, slots = sum(len((t or "").encode()) + 8 for _, t in docs), 0, {}, collections.Counter()
    for d, t in sorted(docs, key=lambda x: x[0]):
        raw = (t or "").encode()
        size = len(raw) + 8
        shard = min(k - 1, (2 * before + size) * k // (2 * total))
        before += size
        out[d] = (size, zlib.crc32(raw), shard, slots[shard])
        slots[shard] += 1
    return out


def line_key(line):
    return line.strip(BLANKS).translate(LOWER)


def lines(docs):
    first, out = {}, {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        for line in (t or "").encode().split(b"\n"):
            first.setdefault(line_key(line), d)
    for d, t in docs:
        all_ = (t or "").encode().split(b"\n")
        kept = [x for x in all_ if len(line_key(x).decode()) < 10 or first[line_key(x)] == d]
        out[d] = (len(all_), len(all_) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest())
    return out


def substrings(docs, n=20):
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if key in seen:
                gone[i : i + n] = [True] * n
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def factors(docs, n=20):
    """Greedy parse against all earlier text, for texts whose windows have at most one earlier place: longest match, then on."""
    places, out = {}, {}
    texts = {d: words(t) for d, t in docs}
    for d in sorted(texts):
        w, out[d], i = texts[d], [], 0
        for j in range(len(w) - n + 1):
            places.setdefault(tuple(w[j : j + n]), (d, j))
        while i <= len(w) - n:
            s, o = places[tuple(w[i : i + n])]
            if (s, o) >= (d, i):
                i += 1
                continue
            k = n
            while i + k < len(w) and o + k < len(texts[s]) and w[i + k] == texts[s][o + k]:
                k += 1
            out[d].append((i, k, s, o))
            i += k - n + 1
    return out


def longest_factors(docs, n=20):
    """Greedy parse of each text against all places further up in it: the longest match, of equal ones the first."""
    out = {}
    for d, t in docs:
        w, out[d], i = words(t), [], 0
        while i <= len(w) - n:
            best, place = 0, 0
            for o in range(i):
                k = 0
                while i + k < len(w) and w[o + k] == w[i + k]:
                    k += 1
                if k > best:
                    best, place = k, o
            if best >= n:
                out[d].append((i, best, d, place))
                i += best - n + 1
            else:
                i += 1
    return out


def shingles(text, k=5):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near(docs, percent):
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owners, common = collections.defaultdict(list), collections.Counter()
    for d, s in sets.items():
        for x in s:
            common.update((o, d) for o in owners[x])
            owners[x].append(d)
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


def secrets(docs):
    kinds = (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    )
    out = {}
    for d, t in docs:
        found = [(m.start(), i, kind, m.end()) for i, (kind, p, ok) in enumerate(kinds) for m in p.finditer(t or "") if ok(m)]
        listed = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))
        out[d] = (*(sum(f[1] == i for f in found) for i in range(3)), hashlib.sha256(listed.encode()).hexdigest(), listed)
    return out


def random_spans(docs):
    """The battery and its two step-up rules token by token; -> {id: [(start, end), ...]}."""
    import math

    from loomtext.llm import secrets as k  # fixed values only

    def tail(z):
        return 1 / (1 + math.exp(min(700.0, 1.5976 * z + 0.070566 * z**3)))

    def battery(token):
        body = token.rstrip("=")
        for name, pattern, alphabet in k.ENCODINGS:
            if re.match(pattern, body):
                break
        else:
            return None
        size, n, values = len(alphabet), len(body), [alphabet.index(c) for c in body]
        x2 = sum(c * c for c in collections.Counter(values).values()) * size / n - n
        extra = size * k.ORDINARY[name] - 1
        z_ordinary = (x2 - (size - 1 + n * extra)) / math.sqrt(2 * (size - 1 + 2 * n * extra))
        f = size - 1
        z_even = ((max(x2, 1e-9) / f) ** (1 / 3) - (1 - 2 / (9 * f))) / math.sqrt(2 / (9 * f))
        high = [v >= size / 2 for v in values]
        up, down = sum(high), n - sum(high)
        expected = 2 * up * down / n + 1
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        z_runs = 9.0 if not up or not down else abs(runs - expected) / math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9))
        mean = sum(values) / n
        variance = sum((x - mean) ** 2 for x in values)
        products = sum((a - mean) * (b - mean) for a, b in zip(values, values[1:]))
        z_serial = 9.0 if not variance else abs(products / variance + 1 / n) * math.sqrt(n)
        return name, n, tail(-z_ordinary), 3 * min(tail(z_even), 2 * tail(z_runs), 2 * tail(z_serial))

    def bin_(p):
        return min(math.floor(-math.log10(max(p, 1e-300)) * k.BINS_PER_DECADE), k.BINS)

    def step_up(pairs, share):
        groups, least = collections.defaultdict(list), {}
        for group, b in pairs:
            groups[group].append(b)
        for group, bins in groups.items():
            good = [b for b in set(bins) if 10 ** (-b / k.BINS_PER_DECADE) <= share * sum(x >= b for x in bins) / len(bins)]
            least[group] = min(good, default=10**9)
        return least

    candidate = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_-]))?")
    tokens = []
    for d, t in docs:
        for i, m in enumerate(candidate.finditer(t or "")):
            places = [m.span()]
            if re.search("[+/_-]", m[0]):
                for part in ("[A-Za-z0-9_-]{20,}", "[A-Za-z0-9+/]{20,}", "[A-Za-z0-9]{20,}"):
                    places += [(m.start() + x.start(), m.start() + x.end()) for x in re.finditer(part, m[0])]
            for a, b in places:
                found = battery(t[a:b])
                if found:
                    name, n, ordinary, random = found
                    tokens.append(((d, i), (name, max(x for x in k.LENGTHS if x <= n)), bin_(random), bin_(ordinary), a, b))
    unlike = step_up([(g, r) for _, g, r, *_ in tokens], k.LOST_SHARE)
    tokens = [x for x in tokens if x[2] < unlike[x[1]]]
    apart = step_up([(g, o) for _, g, _, o, *_ in tokens], k.FALSE_SHARE)
    out, kept = collections.defaultdict(set), collections.defaultdict(list)
    for hit, _, _, _, a, b in sorted((x for x in tokens if x[3] >= apart[x[1]]), key=lambda x: (x[0], x[4] - x[5], -x[4])):
        if all(b <= c or e <= a for c, e in kept[hit]):
            kept[hit].append((a, b))
            out[hit[0]].add((a, b))
    return out


def token_ids(docs, path, end=1):
    from tokenizers import Tokenizer

    coder, start, out = Tokenizer.from_file(path), 0, {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        ids = coder.encode(t or "", add_special_tokens=False).ids + [end]
        out[d] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    return out


def raked(cells, goals, rounds=2000):
    """``{cell: weight}`` with which the tokens of ``{cell: tokens}`` meet ``goals``, one ``{value: share}`` a place of the cell."""
    total, weight = sum(cells.values()), dict.fromkeys(cells, 1.0)
    for _ in range(rounds):
        for place, goal in enumerate(goals):
            have = collections.Counter()
            for cell, n in cells.items():
                have[cell[place]] += n * weight[cell]
            for cell in cells:
                weight[cell] *= goal.get(cell[place], 0.0) * total / have[cell[place]] if have[cell[place]] else 0.0
    return weight


def probabilities(cells, goals, keep_share, rounds=300):
    """``{cell: probability}``: scaled value by value, by bisection, under the bound of 1."""
    budget, rate = keep_share * sum(cells.values()), raked(cells, goals)
    for _ in range(rounds):
        for place, goal in enumerate(goals):
            for value, share in goal.items():
                mine = [c for c in cells if c[place] == value]
                low, high = 0.0, 1e6
                for _ in range(60):
                    f = (low * high) ** 0.5 if low else high / 2**40
                    drawn = sum(cells[c] * min(1.0, f * rate[c]) for c in mine)
                    low, high = (f, high) if drawn < share * budget else (low, f)
                for c in mine:
                    rate[c] *= high
    return {c: min(1.0, r) for c, r in rate.items()}


def quality(docs):
    out = {}
    for d, t in docs:
        t = t or ""
        w = words(t)
        n = len(w)
        counts = collections.Counter(tuple(w[i : i + 3]) for i in range(n - 2))
        repeated = [False] * n
        for i in range(n - 2):
            if counts[tuple(w[i : i + 3])] > 1:
                repeated[i : i + 3] = [True] * 3
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        r = sum(repeated)
        out[d] = (n, sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)), dup, r, n < 50 or 100 * r > 50 * n)
    return out


def script_of(text):
    """By Unicode names: the script of most letters, Japanese by its kana."""
    import unicodedata

    words_of = {
        "LATIN": "Latin", "FEMININE": "Latin", "MASCULINE": "Latin", "GREEK": "Greek", "CYRILLIC": "Cyrillic", "HEBREW": "Hebrew", "ARABIC": "Arabic",
        "DEVANAGARI": "Devanagari", "HANGUL": "Hangul", "HIRAGANA": "Kana", "KATAKANA": "Kana", "KATAKANA-HIRAGANA": "Kana", "CJK": "Han",
    }
    counts = collections.Counter(words_of.get(unicodedata.name(c, "?").split()[0], "Other") for c in text if c.isalpha() or unicodedata.category(c)[0] == "M")
    if 4 * counts["Kana"] > counts["Han"]:
        counts["Kana"] += counts.pop("Han", 0)
    return counts.most_common(1)[0][0] if counts and max(counts.values()) else ""


def fertility(rows, pieces, ranks, pattern, languages, scripts, run=64):
    import base64
    import math

    import sentencepiece
    import tiktoken

    model = sentencepiece.SentencePieceProcessor(model_file=pieces)
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("brute", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    base, out = quality([(d, t) for d, t, _ in rows]), {}
    for d, t, lang in rows:
        t = t or ""
        ids = model.encode(t)
        cuts = [i * run for i in range(max(1, len(ids) // run))] + [len(ids)]
        bits = 0.0
        for a, b in zip(cuts, cuts[1:]):
            n = b - a
            h = -sum(c / n * math.log2(c / n) for c in collections.Counter(ids[a:b]).values())
            bits += n * (h * math.log2(run) / math.log2(n) if n > 1 else 0)
        measures = (len(t) / max(1, len(encoding.encode_ordinary(t))), sum(map(model.is_byte, ids)) / max(1, len(ids)), bits / max(1, len(ids)))
        script = script_of(t)
        band = languages[lang] if lang in languages and script in languages[lang].scripts else scripts.get(script or "Latin")
        good = band is None or (band.least <= measures[0] <= band.most and measures[1] <= band.fallback and measures[2] >= band.entropy)
        out[d] = (*measures, not base[d][5] and good)
    return out
