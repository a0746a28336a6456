"""Brute-force versions, written from the operators' contracts alone."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words((text or "").translate(_LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            n = len(a & b)
            if n and 100 * n >= 80 * (len(a) + len(b) - n):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), root(i)) for i, s in sets]


def without_repeats(rows, window):
    first = {}
    docs = [(i, words(t)) for i, t in rows]
    for i, w in docs:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def quality_base(text):
    text = text or ""
    w, seen, dup = words(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    counts, cover = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
    for i in range(len(w) - 7):
        if counts[tuple(w[i : i + 8])] > 1:
            cover |= set(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


PII = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}
SECRETS = {"assign": re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+")}


def _pii(kind, value):
    digits = re.sub(r"[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def spans(text, patterns):
    out = []
    for rank, (kind, p) in enumerate(patterns.items()):
        for m in p.finditer(text or ""):
            good = _pii(kind, m.group()) if patterns is PII else len(m.group(1)) >= 6 if kind == "assign" else m.end() - m.start() >= (20 if kind == "access" else 24)
            if good:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def digest(found):
    return hashlib.sha256(",".join(found).encode()).hexdigest()


def top_k(vectors, k, ask):
    import math

    q = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, a in q:
        if i % ask == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), j) for j, b in q if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return out


def by_sequence(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.sequence_id].append((r.offset, r.length))
    return out


def copies_by_mix(rows, weights=(3, 1, 2), share=1.5, cap=2.0):
    """How often the mix takes each row (doc_id, text, source): whole turns of its source, and one more by order of a hash until the budget is met."""
    size = [len(words(t)) for _, t, _ in rows]
    total = defaultdict(int)
    for (_, _, s), n in zip(rows, size, strict=True):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    free, left, target = set(order), share * sum(total.values()), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > cap * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: cap * total[s] for s in full}
        left -= sum(cap * total[s] for s in full)
        free -= full
    key = [int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:15], 16) for i, _, _ in rows]
    out = [0] * len(rows)
    for s in order:
        turns = int(target[s] // total[s]) if total[s] else 0
        budget, run, more = target[s] - turns * total[s], 0, set()
        held = defaultdict(int)
        for k, n, (_, _, own) in zip(key, size, rows, strict=True):
            if own == s and n:
                held[k] += n
        for k in sorted(held):
            if run + held[k] <= budget or (run <= budget and held[k] < 2 * (budget - run)):
                more.add(k)
            run += held[k]
        for i, (k, n, (_, _, own)) in enumerate(zip(key, size, rows, strict=True)):
            if own == s:
                out[i] = turns + (n > 0 and k in more)
    return out


def hard_negatives(rows, positives, negatives, low, high, ask):
    import math

    good = {(i, label, tuple(math.floor(256 * x) for x in v)) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, own, a in good:
        if i % ask == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), j, label) for j, label, b in good if j != i)
            for p, j, _ in [s for s in scored if s[2] == own][:positives]:
                fit = [(s, k) for s, k, label in scored if label != own and low * -p <= 100 * -s <= high * -p]
                out += [(i, j, r + 1, k, min(-p, 2**63 - 1), min(-s, 2**63 - 1)) for r, (s, k) in enumerate(fit[:negatives])]
    return out


def contaminated(rows, items, width):
    """(doc_id, n_words, n_hit, ids, stretches of hit words)"""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(_LOW))
        for s in range(max(1, len(w) - width + 1)) if w else ():
            windows[tuple(w[s : s + width])].add(i)
    sizes, out = {len(w) for w in windows}, []
    for i, t in rows:
        places = [m.span() for m in word.finditer((t or "").translate(_LOW))]
        w = word.findall((t or "").translate(_LOW))
        hit, ids = [False] * len(w), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                own = tuple(w[s : s + n])
                if own in windows:
                    hit[s : s + n] = [True] * n
                    ids |= windows[own]
        spans = []
        for k, h in enumerate(hit):
            if h and k and hit[k - 1]:
                spans[-1] = (spans[-1][0], places[k][1], spans[-1][2] + 1)
            elif h:
                spans.append((*places[k], 1))
        out.append((i, len(w), sum(hit), tuple(sorted(x for x in ids if x is not None)), tuple(spans)))
    return out


def aligned(rows, path_a, path_b):
    """Columns of the contract, by whole texts and sets of pairs."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    tok.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    docs, counts = [], Counter()
    for i, t in rows:
        a = tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t, num_threads=1) if t else []
        bytes_a = [bytes(byte[c] for c in tok.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not t or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
            docs.append((i, [], [], []))
            continue
        ends_a, ends_b = ([sum(len(y) for y in own[: k + 1]) for k in range(len(own))] if len(own) < 200 else list(_running(own)) for own in (bytes_a, bytes_b))
        cuts, groups, x, y = sorted(set(ends_a) & set(ends_b)), [], 0, 0
        for c in cuts:
            ga, gb = [], []
            while x < len(a) and ends_a[x] <= c:
                ga.append(a[x])
                x += 1
            while y < len(b) and ends_b[y] <= c:
                gb.append(b[y])
                y += 1
            groups.append((ga, gb))
        docs.append((i, a, b, groups))
        counts.update({(p, q) for ga, gb in groups for p in set(ga) for q in set(gb)})
    best = defaultdict(int)
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    out = []
    for i, a, b, groups in docs:
        links = Counter()
        for ga, gb in groups:
            ca, cb = Counter(ga), Counter(gb)
            links.update({(p, q): n * m for p, n in ca.items() for q, m in cb.items()})
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((i, len(a), len(b), len(groups), sum(links.values()), sum(n for pq, n in links.items() if counts[pq] == best[pq[0]]), sum(n * counts[pq] for pq, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


def _running(own):
    at = 0
    for y in own:
        at += len(y)
        yield at


def disclosures(rows, term, rules):
    """The disclosure of each term and stem that has evidence, by plain counting over different texts; rules has the thresholds."""
    import math

    copies = Counter(t for _, t in rows)
    texts = sorted(copies)
    held, who = defaultdict(set), defaultdict(set)
    for i, text in enumerate(texts):
        blank = list(text)
        for s in spans(text, PII):
            kind, a, b = s.split(":")
            value = text[int(a) : int(b)]
            value = value.lower() if kind == "email" else value if kind == "ip" else re.sub("[^0-9]", "", value)
            who[kind, value].add(i)
            wide = value.rpartition("@")[2] if kind == "email" else ".".join(value.split(".")[:2]) if kind == "ip" else value[:6]
            who[kind + "*", wide].add(i)
            blank[int(a) : int(b)] = " " * (int(b) - int(a))
        for w in {w.lower() for w in term.findall("".join(blank))}:
            held[w].add(i)
            if len(w) > 4:
                held[w[:4] + "*"].add(i)
    n, sets = len(texts), {frozenset(d) for d in who.values() if len(d) >= rules.MEETINGS}
    pairs = len(sets) * sum(len(t) for _, t in rows) / 2

    def chance(k, draws, share):
        q = k / draws
        if q <= share or share >= 1:
            return 0.0
        return -draws * (q * math.log(q / share) + ((1 - q) * math.log((1 - q) / (1 - share)) if q < 1 else 0.0))

    out, z = {}, rules.DEVIATE
    of = lambda docs: sum(copies[texts[i]] for i in docs)
    for w, docs in held.items():
        for e in sets:
            k = len(docs & e)
            if k < rules.MEETINGS or len(e) == n:
                continue
            m = k * of(docs) / of(docs & e)
            if math.log(pairs) + min(chance(k, m, len(e) / n), chance(k, len(e), m / n)) <= math.log(rules.BY_CHANCE):
                q = k / m
                low = (q + z * z / (2 * m) - z * math.sqrt(q * (1 - q) / m + z * z / (4 * m * m))) / (1 + z * z / m)
                if low >= rules.LIKELY:
                    out[w] = max(out.get(w, -9.0), 1 + math.log(low) / -math.log(len(e) / n))
    return out
