"""Plain versions of the corpus queries, for small tables held in memory."""

import base64
import bisect
import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import sentencepiece
import tiktoken
import xxhash
from tokenizers import Tokenizer

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def op1(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i:i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def proximity(docs, items, span=20, window=10):
    wanted = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wanted.setdefault(frozenset(w[i:i + window]), set()).add(item)
    out = []
    for doc, text in dict.fromkeys((k, t or "") for k, t in docs):
        w, found = words(text), set()
        for i in range(max(1, len(w) - span + 1)):
            here = set(w[i:i + span])
            found.update(x for g, ids in wanted.items() if g <= here for x in ids)
        if found:
            out.append((doc, len(found), sha(",".join(sorted(map(str, found))))))
    return out


def op2(docs):
    base = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    out = []
    for doc, text in docs:
        w = words(text)
        at = [(i, label) for p, label in base.items() for i in range(len(w)) if tuple(w[i:i + len(p)]) == p]
        starts = [i for i, _ in at]
        out.append((doc, len(w), len(at), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted({x for _, x in at}))))
    return out


def fingerprint(text):
    w = PLAIN.findall((text or "").translate(UPPER))
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def op3(docs):
    fps = [fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, f"{fps[i]:016x}", least.get(find(i))) for i, (doc, _) in enumerate(docs)]


def op5(docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, start = [], 0
    for doc, text in sorted(docs, key=lambda d: d[0]):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def op7(docs):
    out = []
    for doc, text in docs:
        text = text or ""
        w = PLAIN.findall(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if PLAIN.search(line):
                dup += line in seen
                seen.add(line)
        count = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if count[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        out.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover),
                    len(w) < 10 or 100 * len(cover) > 20 * len(w)))
    return out


def kinds(text):
    """Characters by class, in the order of the quality rules."""
    out = [0] * 9
    for c in text:
        out[8 if ord(c) > 127 else 4 if c == "\n" else 3 if c in " \t\r\v\f" else 2 if c in "0123456789"
            else 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 5 if c in ".,;:!?'\"()-"
            else 6 if c in "#*$%&|<>@/\\=+_~^{}[]`" else 7] += 1
    return out


def divergence(p, q):
    """Jensen-Shannon distance of two histograms; None if one is empty."""
    if not sum(p) or not sum(q):
        return None
    total = 0.0
    for a, b in zip((x / sum(p) for x in p), (x / sum(q) for x in q)):
        total += (a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0)
    return max(0.0, total / 2) ** 0.5


def op7_kept(docs, references, common, max_class, max_word, min_chars, min_words):
    """The quality verdict of (key, text, lang): fixed references, a word
    distance that may be larger the shorter the text is."""
    out = []
    for row, (_, text, lang) in zip(op7([(k, t) for k, t, _ in docs]), docs):
        words = [w.translate(UPPER) for w in PLAIN.findall(text or "")]
        tally, classes = Counter(words), kinds(text or "")
        commons = [tally[w] for w in common]
        commons.append(len(words) - sum(commons))
        if lang in references:
            of_class, of_word = divergence(classes, references[lang][0]), divergence(commons, references[lang][1])
        else:
            letters = [(c[0] + c[1] + c[8], *c[2:8]) for c, _ in references.values()]
            own = (classes[0] + classes[1] + classes[8], *classes[2:8])
            of_class = min((divergence(own, r) for r in letters), key=lambda x: (x is None, x))
            of_word = None
            if lang is None and words:
                of_word = min(divergence(commons, r) for _, r in references.values())
        allowed = max_word + max(0.0, max(len(words), 1) ** -0.5 - min_words ** -0.5)
        odd = row[2] >= min_chars and of_class is not None and of_class > max_class
        odd |= of_word is not None and of_word > allowed
        out.append(not row[6] and not odd)
    return out


def ranks(links, seeds, damping=0.85, rounds=400):
    """Personalised PageRank over (source, target, links), from seeds that sum to 1."""
    left = Counter()
    for a, _, n in links:
        left[a] += n
    now = {h: (1 - damping) * x for h, x in seeds.items()}
    for _ in range(rounds):
        after = Counter({h: (1 - damping) * x for h, x in seeds.items()})
        for a, b, n in links:
            after[b] += damping * now.get(a, 0.0) * n / left[a]
        now = after
    return now


def op8(pages, rules):
    out = []
    for page, url in pages:
        after = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", after)[0]
        path = re.match(r"[^?#]*", after[len(host):])[0]
        host = host.translate(UPPER)
        fits = [(len(h + p), h + p, v) for h, p, v in rules
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        out.append((page, host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None))
    return out


_RANKS = {base64.b64decode(a): int(b) for a, b in map(
    bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_RANKS, special_tokens={})


def op9(docs):
    out = []
    for doc, text in docs:
        ids = TIKTOKEN.encode_ordinary(text or "")
        out.append((doc, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(text or "")))
    return out


def op10(docs, n=50):
    """Keys compare with NULL as the smallest."""
    order = lambda k: (k is not None, k or 0)
    data = [(k, (t or "").encode()) for k, t in docs]
    least = {}
    for k, b in data:
        for i in range(len(b) - n + 1):
            w = b[i:i + n]
            if w not in least or order(k) < least[w]:
                least[w] = order(k)
    out = []
    for k, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if least[b[i:i + n]] < order(k):
                gone[i:i + n] = b"\x01" * n
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((k, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def op11(docs):
    """Rows of (doc_id, source, lang, n_chars, text)."""
    def h(*parts):
        return sha("".join(parts))

    def leaf(row):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    langs = {}
    for k, source, lang, n, text in docs:
        changed = k is not None and n is not None and zlib.crc32(str(k).encode()) % 7 == 0
        langs.setdefault(lang, []).append(
            ((k is not None, k or 0), leaf((k, source, lang, n, text)), leaf((k, source, lang, n + changed if changed else n, text)), k))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = [levels([leaf for _, leaf, _, _ in sorted(langs[x])]) for x in names]
    top = levels([t[-1][0] for t in trees])
    out = []
    for g, name in enumerate(names):
        for i, (_, kept, now, k) in enumerate(sorted(langs[name])):
            siblings = []
            for tree, at in ((trees[g], i), (top, g)):
                for nodes in tree[:-1]:
                    other = nodes[at ^ 1:(at ^ 1) + 1]
                    siblings += other
                    now = h(*other, now) if at % 2 else h(now, *other)
                    at //= 2
            out.append((k, kept, trees[g][-1][0], top[-1][0], h(*siblings), now, now == top[-1][0]))
    return out


def op12(docs, percent=80):
    sets = []
    for _, text in docs:
        w = PLAIN.findall((text or "").translate(UPPER))
        sets.append(frozenset(tuple(w[i:i + 2]) for i in range(max(1, len(w) - 1))) if w else frozenset())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    out = []
    for i, (k, _) in enumerate(docs):
        component = least.get(find(i)) if sets[i] else k
        out.append((k, len(sets[i]), component, k == component))
    return out


def op13(docs):
    a_of = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_of.encode_special_tokens = True
    b_of = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    back = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    held, every = [], Counter()
    for k, text in docs:
        cut, sizes = [], (0, 0)
        if text:
            a, b = a_of.encode(" " + text, add_special_tokens=False), b_of.encode(text, num_threads=1)
            parts = ([bytes(back[c] for c in t) for t in a.tokens],
                     [bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else
                      b_of.id_to_piece(i).replace("\u2581", " ").encode() for i in b])
            if all(b"".join(p) == (" " + text).encode() for p in parts):
                ends = [list(accumulate(map(len, p))) for p in parts]
                common, found = sorted(set(ends[0]) & set(ends[1])), defaultdict(lambda: ([], []))
                for side, ids in enumerate((a.ids, b)):
                    for i, e in zip(ids, ends[side]):
                        found[bisect.bisect_left(common, e)][side].append(i)
                cut, sizes = [found[i] for i in sorted(found)], (len(a.ids), len(b))
        links = Counter((x, y) for p, q in cut for x in p for y in q)
        every.update(links.keys())
        held.append((k, sizes, cut, links))
    best = {}
    for (x, _), n in every.items():
        best[x] = max(n, best.get(x, 0))
    return [(k, *sizes, len(cut), sum(links.values()), sum(m for p, m in links.items() if every[p] == best[p[0]]),
             sum(m * every[p] for p, m in links.items()),
             sha(";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in cut)) if cut else "")
            for k, sizes, cut, links in held]
